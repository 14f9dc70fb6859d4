"""Dropping of lines that many documents share, with two Bloom filters.

A line's key is the line without white space at both ends, in lower case (A-Z). Long keys found in many documents lose
all their lines but those of the document with the largest id.

The first filter remembers which keys were seen, the second which were seen again. Both are cut into slices by
the key's hash. A task sends 4 bytes for each of its distinct keys to the slice's owner, marked if the
task met it in two documents; the owner runs these through the two filters of its slice. There are as many slices
as the table's bytes can need, so a slice's filters stay small and sparse at any size. The second filter,
which holds repeated keys alone, goes to all tasks; beyond TWICE_BITS its slices are folded onto each other, which
makes more suspects, never fewer. Only keys that the second filter knows are shuffled, as SHA-256
digests, counted in each task first: that confirms exactly in how many documents they are, and which is last. Up to
MOST_CONFIRMED confirmed keys are sent to the tasks that drop lines; beyond it, documents with suspects (and no
others) are joined with what they lose.

Rows are documents: a repeated row counts as another document, and all rows with the largest id keep
their lines. A null id is smaller than all others; if a key is in rows without ids alone, these keep it. Null
and empty texts have one empty line. A key in one document many times counts once for it. Equal SHA-256 digests stand for equal
keys. Columns of the table named like new ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel

SPACE = b" \t\n\v\f\r"
#: Bits of a filter for each key that the table's bytes can hold, and how many of them a key sets.
BITS, PROBES = 16, 3
#: Bits of a slice at most and at least.
MOST_SLICE, LEAST_SLICE = 1 << 26, 1 << 13
#: Bits of the second filter that all tasks get, at most (32 MB).
TWICE_BITS = 1 << 28
#: Confirmed keys that are sent to all tasks.
MOST_CONFIRMED = 100_000
#: Keys that a task gathers before it passes them on.
GATHERED = 1 << 21

Filter = namedtuple("Filter", "slices slice_bits pieces bits")


def long_keys(text: bytes | None, least: int) -> dict[bytes, bytes]:
    """Digest and key of a text's distinct keys of at least `least` code points."""
    found = {}
    for line in (text or b"").split(b"\n"):
        if len(line) >= least and (digest := key_digest(line, least)):
            found[digest] = line
    return found


def key_digest(line: bytes, least: int) -> bytes | None:
    """SHA-256 of the line's key, None if that is too short."""
    key = line.strip(SPACE).lower()  # of bytes: A-Z alone
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode()) < least):
        return None
    return hashlib.sha256(key).digest()


def hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)


def places(prints: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a slice that each 4-byte print sets: PROBES rows."""
    h = kernel.mix(prints.astype(np.uint64) + np.uint64(1))
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(bits - 1) for i in range(PROBES)])


def known(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def enter(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).ravel(), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8).ravel())


def _prints(least: int, slices: int):
    """A task's keys for each slice: prints of all, and of those in two of its documents."""

    def passed(found: list[np.ndarray]):
        if not found:
            return
        h, times = np.unique(np.concatenate(found), return_counts=True)
        slot = ((h >> np.uint64(32)) % np.uint64(slices)).astype(np.int32)
        order = np.argsort(slot, kind="stable")
        h, times, slot = h[order].astype(np.uint32), times[order], slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]).tolist()
        for lo in range(0, len(first), 1024):
            own = list(zip(first[lo : lo + 1024], [*first[lo + 1 : lo + 1024], first[lo + 1024] if lo + 1024 < len(first) else len(h)]))
            once = [h[a:b].astype("<u4").tobytes() for a, b in own]
            twice = [h[a:b][times[a:b] > 1].astype("<u4").tobytes() for a, b in own]
            yield pa.RecordBatch.from_arrays([pa.array(slot[[a for a, _ in own]]), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["slice", "once", "twice"])

    def run(batches):
        found, size = [], 0
        for batch in batches:
            digests = [d for text in batch.column(0).cast(pa.binary()).to_pylist() for d in long_keys(text, least)]
            if digests:
                found.append(hashes(digests))
                size += len(digests)
            if size > GATHERED:
                yield from passed(found)
                found, size = [], 0
        yield from passed(found)

    return run


def _again(bits: int, pieces: int):
    """The second filter of each slice, from rows in the order of slices."""

    def run(batches):
        at, once, twice = None, None, None

        def done():
            if at is not None and twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([at % pieces], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["piece", "bits"])

        for batch in batches:
            for slot, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                if slot != at:
                    yield from done()
                    at, once, twice = slot, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
                spots = places(np.frombuffer(a, "<u4"), bits)
                if (seen := known(once, spots)).any():
                    enter(twice, spots[:, seen])
                enter(once, spots)
                if b:
                    enter(twice, places(np.frombuffer(b, "<u4"), bits))
        yield from done()

    return run


def _folded(batches):
    """One row a piece, from rows in the order of pieces."""
    at, bits = None, None
    for batch in batches:
        for piece, packed in zip(*[c.to_pylist() for c in batch.columns]):
            more = np.frombuffer(zlib.decompress(packed), np.uint8)
            if piece != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["piece", "bits"])
                at, bits = piece, more.copy()
            else:
                bits |= more
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["piece", "bits"])


def seen_twice(texts: DataFrame, least: int) -> Filter:
    """The second filter of the long keys of texts (one column)."""
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]) + F.lit(1).cast("long"))).first()[0] or 0
    wanted = max(1, BITS * (size // (least + 1) + 1))
    parts = common.shuffle_partitions(texts.sparkSession)
    slices = max(parts, -(-wanted // MOST_SLICE))
    bits = max(LEAST_SLICE, 1 << (-(-wanted // slices) - 1).bit_length())
    pieces = min(slices, max(1, TWICE_BITS // bits))
    prints = texts.mapInArrow(_prints(least, slices), "slice int, once binary, twice binary")
    found = prints.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_again(bits, pieces), "piece int, bits binary")
    if slices > pieces:
        found = found.repartition(parts, "piece").sortWithinPartitions("piece").mapInArrow(_folded, "piece int, bits binary")
    whole = np.zeros((pieces, bits // 8), np.uint8)
    for piece, packed in found.collect():  # TWICE_BITS at most
        whole[piece] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return Filter(slices, bits, pieces, whole.ravel())


def suspected(digests: list[bytes], f: Filter) -> np.ndarray:
    """Which digests the filter knows."""
    h = hashes(digests)
    piece = (h >> np.uint64(32)) % np.uint64(f.slices) % np.uint64(f.pieces)
    return known(f.bits, places(h & np.uint64(0xFFFFFFFF), f.slice_bits) + piece * np.uint64(f.slice_bits))


def _suspects(shared, least: int):
    """A row for each distinct suspected key of a document."""

    def run(batches):
        f = Filter(*shared.value)
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            digests, rows = [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                own = long_keys(text, least)
                digests += own
                rows += [i] * len(own)
            if not digests:
                continue
            at = np.flatnonzero(suspected(digests, f)).tolist()
            rows = pa.array([rows[i] for i in at], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(rows), marks.take(rows), pa.array([digests[i] for i in at], pa.binary())], ["id", "mark", "digest"])

    return run


def _has_suspects(shared, least: int):
    """Rows with a flag: whether any of their keys is suspected."""

    def run(batches):
        f = Filter(*shared.value)
        for batch in batches:
            flags = []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                own = list(long_keys(text, least))
                flags.append(bool(own) and bool(suspected(own, f).any()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(flags)], [*batch.schema.names[:-1], "_suspect"])

    return run


def _kept(least: int, shared=None):
    """Adds kept_text, n_lines and n_dropped to rows whose last two columns are id and text; what goes is shared by
    all rows (digest to last id), or the rows' own in a column before these."""

    def run(batches):
        gone = shared.value if shared is not None else None
        for batch in batches:
            n = batch.num_columns - (2 if shared is not None else 3)
            own = batch.column(n).to_pylist() if shared is None else [None] * batch.num_rows
            kept, lines, dropped = [], [], []
            for mine, key, text in zip(own, batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
                parts = (text or b"").split(b"\n")
                lines.append(len(parts))
                if gone is not None:
                    stays = [p for p in parts if len(p) < least or (d := key_digest(p, least)) is None or gone.get(d, key) == key]
                elif mine:
                    mine = set(mine)
                    stays = [p for p in parts if len(p) < least or key_digest(p, least) not in mine]
                else:
                    stays = parts
                dropped.append(len(parts) - len(stays))
                kept.append(b"\n".join(stays))
            new = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], [*batch.schema.names[:n], *NEW])

    return run


NEW = ["kept_text", "n_lines", "n_dropped"]


def drop_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """df with kept_text, n_lines and n_dropped: texts without the lines whose keys (of `least` code points or more) are in
    `documents` documents or more, but for those of the document with the largest id."""
    spark = df.sparkSession
    common.on_workers(spark)
    rest = [c for c in df.columns if c not in NEW]
    asked = [F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text")]
    shared = spark.sparkContext.broadcast(tuple(seen_twice(df.select(asked[1]), least)))  # TWICE_BITS at most
    mark = F.xxhash64(F.col(f"`{text}`")).alias("_mark")
    occurrences = common.stored(df.select(asked[0], mark, asked[1]).mapInArrow(_suspects(shared, least), "id long, mark long, digest binary"), "line-suspects")
    confirmed = common.stored(occurrences.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter(F.col("n") >= documents).select("digest", "last"), "line-keys")
    schema = common.schema_with(df.select(*[f"`{c}`" for c in rest]), "kept_text string, n_lines long, n_dropped long")
    chosen = [F.col(f"`{c}`") for c in rest]
    if confirmed.count() <= MOST_CONFIRMED:
        gone = spark.sparkContext.broadcast({bytes(r["digest"]): r["last"] for r in confirmed.collect()})  # MOST_CONFIRMED rows
        return df.select(*chosen, *asked).mapInArrow(_kept(least, gone), schema)
    losses = occurrences.join(confirmed, "digest").filter(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id", "mark").agg(F.collect_set("digest").alias("_gone"))  # a document's lines
    packed = df.select(F.struct(*chosen).alias("_row"), asked[0], mark, asked[1].alias("_text"), asked[1].alias("_probe"))
    flagged = packed.mapInArrow(_has_suspects(shared, least), common.schema_with(packed.drop("_probe"), "_suspect boolean"))
    none = F.lit(None).cast("array<binary>").alias("_gone")
    met = flagged.filter("_suspect").alias("a").join(losses.alias("b"), F.col("a._id").eqNullSafe(F.col("b.id")) & (F.col("a._mark") == F.col("b.mark")), "left")
    parts = [flagged.filter("NOT _suspect").select("_row", none, "_id", "_text"), met.select("_row", "_gone", "_id", "_text")]
    return parts[0].unionByName(parts[1]).select(*[F.col("_row").getField(c).alias(c) for c in rest], "_gone", "_id", "_text").mapInArrow(_kept(least), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, doc_id, string_split(text, chr(10)) AS l FROM d),
lines AS (SELECT r, doc_id, p, l[p] AS line, translate(trim(l[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM parts, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS p)),
held AS (SELECT k, count(DISTINCT r) AS n, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k),
judged AS (SELECT r, lines.doc_id, p, line, n >= 5 AND lines.doc_id IS DISTINCT FROM last AS gone FROM lines LEFT JOIN held USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (gone IS NOT TRUE), '')) AS kept_sha256
FROM judged GROUP BY r
"""
