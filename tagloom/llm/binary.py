"""Token ids in a binary file format: zstandard frames with a shared, trained dictionary.

Each document's ids are serialised (little-endian, 16 bits where the vocabulary allows, else 32)
and compressed on their own with a dictionary trained on serialised ids, so that one short document
can be read without its neighbours and still compresses well. Frames lie one after another in
blocks; a block carries the hash of its dictionary and an index of document ids, frame offsets and
token counts. Blocks are rows of a Parquet dataset (`blocks/`), so Spark's commit protocol keeps
the files whole when executors are lost and any store that Spark reads will do; the dictionary is a
row of `dictionary/`. Blocks ascend with doc_id: shard by shard, then by number.

Null texts count as empty; an empty document has its end id alone. Null ids are stored as 0 with a
flag (`id_given`) that says so, come before all others and are never looked up. Rows with the same doc_id are
kept, in any order among themselves, and in several shards if they are many. An empty table gives files without blocks
and no rows; other columns aren't stored. With too few or too short documents for a dictionary (8, 8 KB) frames have none.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, kernel
from .tokens import SLICE, encoder

#: The dictionary: its size, and the sample it is trained on (documents with the least hashes). Bounds
#: that don't touch what is stored, only how small it gets.
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS = 512
#: Documents longer than this many characters don't take part in the training.
SAMPLE_CHARS = 20_000
LEVEL = 3
#: Frames of a block; a block also ends after so many bytes.
BLOCK_DOCUMENTS = 1024
BLOCK_BYTES = 4 << 20

BLOCK_SCHEMA = (
    "shard int, block int, dictionary_hash string, width int, n_documents int, first_doc_id long, last_doc_id long, n_tokens long, "
    "doc_ids binary, id_given binary, offsets binary, token_counts binary, frames binary"
)


def serialise(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def deserialise(raw: bytes, width: int) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return raw if width == 4 else np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes()


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary, or no bytes if the samples are too few or too short for one."""
    import zstandard

    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


@lru_cache(maxsize=8)
def _coders(dictionary: bytes, level: int):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=False), zstandard.ZstdDecompressor(dict_data=data)


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _frame_batches(tokenizer: str, end_id: int, width: int, dictionary: bytes):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        kernel.release()
        enc, (coder, _) = encoder(tokenizer, True), _coders(dictionary, LEVEL)
        for batch in batches:
            frames, counts = [], []
            for _, part in kernel.slices(batch.column("text"), SLICE):
                for raw in enc.encode_array(part):
                    raw += end
                    counts.append(len(raw) // 4)
                    frames.append(coder.compress(serialise(raw, width)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n_tokens", "frame"])

    return run


def _block_batches(hashed: str, width: int):
    """Rows of one task, which come shard by shard in ascending doc_id order, as blocks."""

    def run(batches):
        shard, number, ids, counts, frames, held = None, 0, [], [], [], 0

        def block():
            offsets = np.cumsum([0, *map(len, frames)]).astype("<i8")
            known = [i for i in ids if i is not None]
            given = np.asarray([i is not None for i in ids], bool)
            first, last = (known[0], known[-1]) if known else (None, None)
            row = [shard, number, hashed, width, len(ids), first, last, sum(counts), np.asarray([i or 0 for i in ids], "<i8").tobytes(), given.tobytes(), offsets.tobytes(), np.asarray(counts, "<i8").tobytes(), b"".join(frames)]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            names = [x.strip().split(" ")[0] for x in BLOCK_SCHEMA.split(",")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            for s, doc, n, frame in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "frame"))):
                if ids and (s != shard or len(ids) >= BLOCK_DOCUMENTS or held >= BLOCK_BYTES):
                    yield block()
                    number, ids, counts, frames, held = (number + 1 if s == shard else 0), [], [], [], 0
                shard = s
                ids.append(doc)
                counts.append(n)
                frames.append(frame)
                held += len(frame)
        if ids:
            yield block()

    return run


def _sample(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> list[bytes]:
    """Serialised ids of at most SAMPLE_DOCUMENTS whole documents: those with the least hashes."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    usable = docs.filter(F.length("text") <= SAMPLE_CHARS)
    # thinned by a threshold on the hash first, so that tasks don't all send as many rows; if that leaves too few, because others are long, all usable ones are asked
    share = min(1.0, 4 * SAMPLE_DOCUMENTS / max(1, docs.count()))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    for most in dict.fromkeys((int(share * (1 << 30)) + 1, 1 << 30)):
        rows = usable.filter(hashed < most).select("text", hashed.alias("_h"), "doc_id").orderBy("_h", "doc_id").limit(SAMPLE_DOCUMENTS).select("text").collect()
        if len(rows) == SAMPLE_DOCUMENTS:
            break
    return [serialise(raw + end, width) for raw in encoder(tokenizer, True).encode([r[0] or "" for r in rows])]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, vocabulary: int = 50_257) -> None:
    """Writes all documents' ids below `path`, in ascending doc_id order."""
    spark = docs.sparkSession
    common.on_workers(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    dictionary = train(_sample(docs, tokenizer, end_id, width))
    hashed = dictionary_hash(dictionary)
    spark.createDataFrame([(hashed, bytearray(dictionary))], "hash string, data binary").write.parquet(f"{path}/dictionary")
    frames = docs.mapInArrow(_frame_batches(tokenizer, end_id, width, dictionary), "doc_id long, n_tokens long, frame binary")
    shards = 2 * common.shuffle_partitions(spark)
    (
        frames.withColumn("shard", common.range_shard(docs, "doc_id", shards))
        .repartition(common.shuffle_partitions(spark), "shard")
        .sortWithinPartitions("shard", "doc_id")
        .mapInArrow(_block_batches(hashed, width), BLOCK_SCHEMA)
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/blocks")
    )


def _decoded(dictionary: bytes, hashed: str, keep: bool):
    def run(batches):
        _, (_, decoder) = None, _coders(dictionary, LEVEL)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != hashed:
                    raise ValueError("a block was written with another dictionary")
                ids, offsets, counts = (np.frombuffer(row[c], "<i8") for c in ("doc_ids", "offsets", "token_counts"))
                frames = memoryview(row["frames"])
                raws = [deserialise(decoder.decompress(frames[a:b]), row["width"]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                if [len(r) // 4 for r in raws] != counts.tolist():
                    raise ValueError("a frame holds another number of ids than the index says")
                before = np.cumsum(counts) - counts
                given = np.frombuffer(row["id_given"], bool)
                columns = [pa.array(np.full(len(ids), row["shard"], np.int32)), pa.array(np.full(len(ids), row["block"], np.int32)), pa.array(ids, mask=~given), pa.array(before), pa.array(counts), pa.array([zlib.crc32(r) for r in raws], pa.int64())]
                names = ["shard", "block", "doc_id", "_in_block", "n_tokens", "ids_crc32"]
                if keep:
                    columns.append(pa.array(raws, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["hash"], bytes(row["data"])


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files (and its ids, if asked for).

    Starts come from the index: sums of tokens over shards, then blocks of a shard, then documents.
    """
    common.on_workers(spark)
    hashed, dictionary = _dictionary(spark, path)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    index = blocks.select("shard", "block", "n_tokens")
    totals = sorted(index.groupBy("shard").agg(F.sum("n_tokens")).collect())  # one row a shard: as many as the writer chose
    at, shards = 0, []
    for shard, n in totals:
        shards.append((shard, at))
        at += n
    shards = spark.createDataFrame(shards, "shard int, _before_shard long")
    window = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        index.withColumn("_in_shard", F.coalesce(F.sum("n_tokens").over(window), F.lit(0)))
        .join(F.broadcast(shards), "shard")
        .select("shard", "block", (F.col("_before_shard") + F.col("_in_shard")).alias("_block_start"))
    )
    schema = "shard int, block int, doc_id long, _in_block long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    documents = blocks.mapInArrow(_decoded(dictionary, hashed, ids), schema)
    return documents.join(starts, ["shard", "block"]).select("doc_id", (F.col("_block_start") + F.col("_in_block")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents: only blocks whose range can hold them are read, only their frames decompressed."""
    common.on_workers(spark)
    hashed, dictionary = _dictionary(spark, path)
    wanted = sorted(set(doc_ids))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    hit = F.lit(False)
    for d in wanted:
        hit = hit | ((F.col("first_doc_id") <= d) & (F.col("last_doc_id") >= d))

    def run(batches):
        _, decoder = _coders(dictionary, LEVEL)
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets = (np.frombuffer(row[c], "<i8") for c in ("doc_ids", "offsets"))
                at = np.flatnonzero(np.isin(ids, wanted) & np.frombuffer(row["id_given"], bool))
                frames = memoryview(row["frames"])
                raws = [deserialise(decoder.decompress(frames[offsets[i] : offsets[i + 1]]), row["width"]) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(raws, pa.binary())], ["doc_id", "ids"])

    return blocks.filter(hit & (F.col("dictionary_hash") == hashed)).mapInArrow(run, "doc_id long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.new_path(spark, "token-files")
    write(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)
