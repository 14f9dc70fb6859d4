"""A training corpus from raw documents: five stages, each written and read again before the next.

Language ID drops documents without a language (no letters, null text) or whose largest language
makes up less than half. Toxicity drops those predicted toxic. The n-gram Jaccard join keeps one
document of each group of near copies (five words, 0.8). Mixing repeats or leaves out documents so
that sources have their target weights. Packing tokenizes what is left and fills sequences.

All stages but the last return the columns they were given, whatever their names. Nulls, empty
texts, repeated rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common, jaccard, language, mixing, packing, toxicity

#: Least share of a document's largest language.
LEAST_SHARE = 0.5
#: Pieces that the tokenizer of the last stage remembers: workers have other stages' memory to bear, too.
MEMO_ENTRIES = 40_000


def _aside(docs: DataFrame, *more: str) -> DataFrame:
    """docs with its columns under names that clash with nothing, and copies of some as they are."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], *[F.col(c) for c in more])


def _text(docs: DataFrame) -> str:
    """What _aside calls the text."""
    return f"_c{docs.columns.index('text')}"


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs.select("doc_id", "text", "lang"), F.lit(True))
    if not model.languages:  # nothing to tell languages by: only texts without letters go
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return _back(language.predict(_aside(docs), model, _text(docs)).filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)), docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"), F.lit(True))
    return _back(toxicity.score(_aside(docs), model, _text(docs)).filter("predicted = 0"), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _back(mixing.take(_aside(docs, "doc_id", "text", "source")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo=MEMO_ENTRIES)


STAGES = [
    ("language_id", language_id),
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Its models and its tokenizer are beyond SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
