import public_tokenizers

from tagloom.llm import binary, mixing, tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_null_ids_are_mixed(spark):
    rows = [(None, "w w", "s")] * 3 + [(i, "w w", "s") for i in range(3)] + [(None, "w", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, share=2.0).collect()
    assert [(r["copies"], r["taken"]) for r in found if r["source"] == "s"] == [(2, 4)] * 6
    assert [(r["copies"], r["taken"]) for r in found if r["source"] == "t"] == [(2, 2)]
    assert mixing.take(docs, share=2.0).count() == 14
    part = mixing.mix(docs, share=1.5).collect()
    assert all(r["taken"] == r["copies"] * r["size"] for r in part)
    assert len({r["copies"] for r in part if r["source"] == "s" and r["doc_id"] is None}) == 1


def test_null_ids_are_stored(spark, tmp_path):
    rows = [(None, "no id"), (0, "zero"), (3, "three"), (None, "nor here"), (-5, "less")]
    path = str(tmp_path / "files")
    binary.write(spark.createDataFrame(rows, "doc_id long, text string"), path, BYTES)
    raw = tokens.encoder(BYTES, True).encode([t for _, t in rows])
    want = sorted(repr((d, bytes(r) + bytes(4))) for (d, _), r in zip(rows, raw))
    assert sorted(repr((r["doc_id"], bytes(r["ids"]))) for r in binary.read(spark, path, ids=True).collect()) == want
    assert [(r["doc_id"], bytes(r["ids"])) for r in binary.lookup(spark, path, [0]).collect()] == [(0, bytes(raw[1]) + bytes(4))]


def test_rows_of_one_id_lie_in_several_shards(spark, tmp_path):
    rows = [(7, f"hot {i}") for i in range(3000)] + [(None, f"none {i}") for i in range(1500)] + [(i, f"own {i}") for i in range(8, 1000)] + [(-3, "first"), (2**40, "last")]
    path = str(tmp_path / "files")
    binary.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, BYTES)
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = {r[0]: r[1] for r in blocks.groupBy("shard").sum("n_documents").collect()}
    assert sum(shards.values()) == len(rows) and max(shards.values()) < len(rows) / 4
    found = binary.read(spark, path).collect()
    order = sorted(found, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(ids) == len(rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(order, order[1:]))
