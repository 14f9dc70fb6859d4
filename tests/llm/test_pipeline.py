import duckdb
import pytest


pipeline = pytest.importorskip("corpus_pipeline")
from tagloom.llm import common, jaccard, mixing, packing, registry  # noqa: E402

from .test_near_copies import brute  # noqa: E402


def test_stages_follow_each_other(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "toxicity", "ngram_jaccard_join", "mixing", "best_fit_packing"]
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, before, sf_dir), name)
        assert after.columns == docs.columns
        kept, given = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (after, before))
        assert kept <= given
        if name == "toxicity":
            toxic = {r[0] for r in common.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").collect()}
            assert not toxic & kept and len(given) - len(kept) <= 1.5 * len(toxic & given) + 10
        elif name == "language_id":
            assert len(kept) > 0.9 * len(given)
        elif name == "ngram_jaccard_join":
            want = brute([(r["doc_id"], r["text"]) for r in before.collect()], jaccard.NEAR_WIDTH, jaccard.NEAR_PERCENT)
            assert kept == {d for d, _, c in want if d == c}
        elif name == "mixing":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
            got = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
            assert got == {d: n for d, n in want.items() if n}
        before = after
    rows = pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.select("doc_id").collect()}
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_run_gives_the_last_stage(spark, sf_dir):
    found = pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(found.columns) and found.count() > 0


def test_odd_tables_pass_through(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, copies string, lang_pred string, predicted string, component_id string"
    rows = [(1, "the quiet river and the hills", "en", None, 1, *"abcdef"), (1, "the quiet river and the hills", "en", None, 1, *"abcdef"), (None, None, None, None, None, *[None] * 6), (3, "", "en", "s", 0, *"abcdef"), (4, "der Fluss und die Berge", "de", "s", 9, *"abcdef")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in pipeline.STAGES[:-1]:
            docs = common.stored(stage(spark, docs, sf_dir), name)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    with duckdb.connect() as con:
        for t in ("documents", "embeddings", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.sql(registry.ORACLE_SQL[name])
        columns = sorted(want.columns)
        rows = [tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()]
    found = registry.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == columns
    def flat(rs):
        return sorted(repr(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)) for r in rs)
    assert flat(found.select(*columns).collect()) == flat(rows)


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in registry.QUERIES} == {f"op{n}" for n in range(1, 14)}
