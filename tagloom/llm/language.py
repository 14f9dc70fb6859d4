"""Language identification as inference of a mixture: which languages a text holds, and how much of each.

Each language has a distribution of byte trigrams (blanks around words included), learned from
labelled documents. A word's likelihood under a language is the product of its trigrams'; a document
is a mixture of languages over its words, and expectation-maximisation estimates the proportions.
Sets are compared by their likelihood less a penalty per language. Each single language is tried;
then sets grow from the best one by the language that takes the most words off it, as long as any
text's set gains by that, and shrink again by their least language if that gains. The best set's
largest language is the prediction, its proportion the score.

Learning reads a bounded sample: PER_LANGUAGE whole documents of each language, those with the least
hashes. Texts that are null or hold no letter get `und` and score 0, as do all texts when nothing
could be learned. Repeated rows get the same result each; an empty table gives no rows. A null id's fold is
that of the empty text, 0: such rows are learned from. Columns of the table named like new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel, tokens

UNKNOWN = "und"
#: Documents of each language that are learned from.
PER_LANGUAGE = 3000
#: Trigrams are counted in so many buckets.
BUCKETS = 1 << 16
SMOOTHING = 0.5
ITERATIONS = 8
#: Bytes of text that are worked on at a time.
SLICE = 1 << 18
#: What a further language of a set must gain, times the log of the number of words.
PENALTY = 4.0


def trigrams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around each byte of all words, and where each word's begin."""
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    where = np.arange(int(lengths.sum())) - np.repeat(first - starts, lengths)
    here = raw[where].astype(np.uint32)
    left = np.empty_like(here)
    left[1:], left[first] = here[:-1], 32
    left[first] = 32
    right = np.empty_like(here)
    right[:-1] = here[1:]
    right[first + lengths - 1] = 32
    packed = left << np.uint32(16) | here << np.uint32(8) | right
    return (packed * np.uint32(2654435761)) >> np.uint32(16), first


def _counts(batches):
    """lang, bucket, n of the trigrams of a task's documents."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
        for lo, part in kernel.slices(batch.column("text"), SLICE):
            raw, offsets = kernel.bytes_of(pc.utf8_lower(part))
            starts, ends, before = kernel.words_of(raw, offsets)
            if not len(starts):
                continue
            grams, first = trigrams(raw, starts, ends)
            edges = np.append(first, len(grams))[before]
            for i in range(len(part)):
                if edges[i + 1] > edges[i]:
                    total = totals.setdefault(langs[lo + i], np.zeros(BUCKETS, np.int64))
                    total += np.bincount(grams[edges[i] : edges[i + 1]], minlength=BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])
    kernel.release()


class Model:
    """languages, and the log-probability of each bucket under each of them (languages x BUCKETS)."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs


def learn(docs: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE) -> Model:
    """From doc_id, text and lang of documents for which the condition holds."""
    spark = docs.sparkSession
    common.on_workers(spark)
    labelled = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = common.least_hashed(labelled.select("doc_id", "lang"), "lang", "doc_id", per_language)
    chosen = common.stored(chosen.distinct(), "language-sample")
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # per_language rows a language
    counts = sample.select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # BUCKETS rows a language at most
    languages = sorted(rows["lang"].unique(), key=lambda s: s.encode())
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    for i, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    del rows
    kernel.release()
    logs = np.log(table / table.sum(axis=1, keepdims=True)) if len(languages) else table
    return Model(languages, logs.astype(np.float32))


def mixtures(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text the index of the largest language of the best set (-1: no words), and its proportion."""
    n, many = len(texts), len(model.languages)
    best, share = np.full(n, -1), np.zeros(n)
    raw, offsets = kernel.bytes_of(texts)
    starts, ends, before = kernel.words_of(raw, offsets)
    if not len(starts) or not many:
        return best, share
    grams, first = trigrams(raw, starts, ends)
    logs = np.stack([np.add.reduceat(row[grams], first) for row in model.logs], axis=1).astype(np.float64)  # words x languages
    words = np.diff(before)
    full = np.flatnonzero(words)
    edges, size = before[:-1][full], words[full]
    doc = np.repeat(np.arange(len(full)), size)
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - top)

    def sums(x):
        return np.add.reduceat(x, edges, axis=0)

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and penalised log-likelihood (apart from the words' own maxima) of each text's set of languages."""
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ITERATIONS):
            part = like * pi[doc]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            pi = sums(part) / size[:, None]
        found = sums(np.log(np.maximum((like * pi[doc]).sum(axis=1), 1e-300)))
        return pi, found - PENALTY * (allowed.sum(axis=1) - 1) * np.log(size + 1)

    single = sums(logs - top)  # log-likelihoods of one language alone
    here = np.arange(len(full))
    value, chosen = single.max(axis=1), np.zeros((len(full), many))
    chosen[here, single.argmax(axis=1)] = 1.0
    shares = chosen.copy()
    growing = np.full(len(full), many > 1)
    while growing.any():
        # the language that words of the texts like better than their set, most of all
        set_like = np.maximum((like * shares[doc]).sum(axis=1), 1e-300)
        gain = sums(np.maximum(0.0, np.log(np.maximum(like, 1e-300)) - np.log(set_like)[:, None]))
        gain[chosen > 0] = -1.0
        allowed = chosen.copy()
        allowed[here, gain.argmax(axis=1)] = 1.0
        tried, penalised = fit(allowed)
        if many > 2:
            # a language that the new one makes superfluous
            fewer = allowed.copy()
            fewer[here, np.where(allowed > 0, tried, np.inf).argmin(axis=1)] = 0.0
            fewer_tried, fewer_value = fit(fewer)
            swap = fewer_value > penalised
            allowed, tried, penalised = np.where(swap[:, None], fewer, allowed), np.where(swap[:, None], fewer_tried, tried), np.where(swap, fewer_value, penalised)
        growing &= (penalised > value + 1e-9) & (gain.max(axis=1) > 0)
        value = np.where(growing, penalised, value)
        chosen, shares = np.where(growing[:, None], allowed, chosen), np.where(growing[:, None], tried, shares)
        growing &= chosen.sum(axis=1) < many
    best[full], share[full] = shares.argmax(axis=1), shares.max(axis=1)
    return best, share


def predict(docs: DataFrame, model: Model, text: str = "text", keep: bool = True) -> DataFrame:
    """docs (without their text, if not keep) with lang_pred and score."""
    spark = docs.sparkSession
    common.on_workers(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers a language
    names = pa.array([*model.languages, UNKNOWN], pa.string())
    kept = docs.drop("lang_pred", "score")
    out = [c for c in kept.columns if keep or c != text]

    def run(batches):
        tokens.forget()
        for batch in batches:
            letters = np.asarray(batch.column("_letters").to_numpy(zero_copy_only=False), dtype=bool)
            best, share = np.full(len(letters), -1), np.zeros(len(letters))
            for lo, part in kernel.slices(batch.column(text), SLICE):
                best[lo : lo + len(part)], share[lo : lo + len(part)] = mixtures(shared.value, pc.utf8_lower(part))
            unknown = (best < 0) | ~letters
            best[unknown], share[unknown] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), names.take(pa.array(best)), pa.array(np.clip(share, 0, 1))], [*out, "lang_pred", "score"])
        kernel.release()

    chosen = kept.withColumn(text, F.col(text).cast("string")).withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return chosen.mapInArrow(run, common.schema_with(chosen.select(*out), "lang_pred string, score double"))


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score; documents whose fold is 2 are never learned from."""
    model = learn(docs, common.fold(F.col("doc_id"), 4) != 2)
    return predict(docs.withColumn("held_out", common.fold(F.col("doc_id"), 4) == 2), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs, common.fold(F.col("doc_id"), 4) != 2)
    held = docs.select("doc_id", "text", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    return predict(held, model, keep=False).select("doc_id", "held_out", "lang_pred", "score")
