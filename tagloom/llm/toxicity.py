"""Toxicity by a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A document's features are the n-grams of characters (lower-cased, white space as blanks) that it
holds, each counted once and valued by the log of its frequency among toxic over its frequency among
other labelled documents; a logistic regression weighs them. N-grams fall into BUCKETS hash buckets,
all of which take part.

The classifier is fitted on a bounded sample: PER_CLASS whole labelled documents of each class,
those with the least hashes, of CLASS_CHARS characters together at most (a document with which they would be more is
skipped; if all are longer than that, the shortest one alone is learned from). Scores are then calibrated: parts of the
sample are scored by models of the other parts, and a logistic curve over these scores gives the classes' true shares (with fewer than
LEAST_CALIBRATED documents of a class the threshold alone is moved to them). Scoring reads whole texts. Null and empty texts have no n-gram and get the
score of none. Documents without a label are scored but never learned from; a document labelled
twice counts as toxic if any label says so, and of rows that repeat an id one text is learned from.
With one class or none to learn from, every score is that class's smoothed share. Repeated rows get
the same score each; an empty table gives no rows. Null ids are never learned from and count as held out (their
fold is that of the empty text, 0). Columns of the table named like new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel, tokens

ORDERS = (3, 4, 5)
BITS = 21
BUCKETS = 1 << BITS
#: Odd multipliers of the hash.
_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)
#: Bytes that are worked on at a time: their arrays stay in a processor's cache.
SLICE = 1 << 17
#: Characters of a text that are worked on at a time.
LONG = 1 << 18
#: Documents of each class that are learned from, and characters of them.
PER_CLASS = 2000
CLASS_CHARS = 6_000_000
SMOOTHING = 1.0
#: Values of the design matrix that the fit works on at a time.
FIT_SLICE = 1 << 20
#: Parts of the sample by which scores are calibrated, and documents that each class must have for that.
FOLDS, LEAST_CALIBRATED = 3, 30
#: Strength of the pull of weights towards 0.
RIDGE = 1.0


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, white space as blanks, and where each text begins; nulls count as empty."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    ends = np.cumsum(np.asarray(pc.utf8_length(lower), dtype=np.int64))
    raw, _ = kernel.bytes_of(lower)
    return np.frombuffer(kernel.spaced(raw).tobytes().decode("utf-8").encode("utf-32-le"), "<u4"), np.append(0, ends)


def ngrams(points: np.ndarray, offsets: np.ndarray):
    """For each order: the buckets of all n-grams, and the places where one would leave its text."""
    packed = points.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            return
        packed = packed[:-1] * _STEP + points[n - 1 :]
        if n in ORDERS:
            ends = (offsets[1:, None] - np.arange(1, n)).ravel()
            yield ((packed + np.uint32(n)) * _SPREAD) >> np.uint32(32 - BITS), ends[(ends >= 0) & (ends < len(packed))]


def _long(text: str) -> np.ndarray:
    """Whether a long text holds an n-gram of each bucket, read a piece at a time; pieces overlap by what an n-gram takes."""
    held = np.zeros(BUCKETS, bool)
    for lo in range(0, len(text), LONG):
        points, offsets = characters(pa.array([text[lo : lo + LONG + max(ORDERS) - 1]]))
        for buckets, _ in ngrams(points, offsets):
            held[buckets] = True
    return held


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram that a text holds, each pair once, in ascending order."""
    found = []
    for lo, part in kernel.slices(texts, SLICE):
        if len(part) == 1 and (pc.binary_length(part)[0].as_py() or 0) > LONG:
            found.append(lo << BITS | np.flatnonzero(_long(part[0].as_py())))
            continue
        points, offsets = characters(part)
        own = []
        for buckets, out in ngrams(points, offsets):
            inside = np.ones(len(buckets), bool)
            inside[out] = False
            at = np.flatnonzero(inside)
            own.append((lo + np.searchsorted(offsets, at, side="right") - 1) << BITS | buckets[at].astype(np.int64))
        if own:
            found.append(np.unique(np.concatenate(own)))
    pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & (BUCKETS - 1)


def _rows(batches):
    """Each document's class and its buckets, as little-endian unsigned 32-bit integers."""
    for batch in batches:
        toxic = batch.column("toxic")
        for lo, part in kernel.slices(batch.column("text"), SLICE):
            doc, bucket = features(part)
            edges = np.searchsorted(doc, np.arange(len(part) + 1))
            rows = [bucket[i:j].astype("<u4").tobytes() for i, j in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([toxic.slice(lo, len(part)), pa.array(rows, pa.binary())], ["toxic", "columns"])
    kernel.release()


def fit_logistic(columns: np.ndarray, edges: np.ndarray, scale: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, ridge: float = RIDGE, steps: int = 6) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps whose equations conjugate gradients solve.

    Row i holds columns[edges[i] : edges[i + 1]], each valued by its column's scale. Rows are worked on
    a slice at a time, so that the columns' numbers are all that is held of the matrix.
    """
    n, n_columns = len(y), len(scale)
    w = np.zeros(n_columns + 1)
    parts, lo = [], 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + FIT_SLICE, side="right")) - 1)
        parts.append((lo, hi))
        lo = hi

    def forward(v):
        scaled, out = (scale * v[:-1]).astype(np.float32), np.full(n, v[-1])
        for lo, hi in parts:
            sums = np.zeros(edges[hi] - edges[lo] + 1)
            np.cumsum(scaled[columns[edges[lo] : edges[hi]]], dtype=np.float64, out=sums[1:])
            out[lo:hi] += np.diff(sums[edges[lo : hi + 1] - edges[lo]])
        return out

    def backward(v):
        out = np.zeros(n_columns)
        for lo, hi in parts:
            out += np.bincount(columns[edges[lo] : edges[hi]], weights=np.repeat(v[lo:hi], np.diff(edges[lo : hi + 1])), minlength=n_columns)
        return np.append(scale * out, v.sum())

    pull = np.append(np.full(n_columns, ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        gradient = backward(sample_weight * (p - y)) + pull * w
        curve = sample_weight * np.maximum(p * (1 - p), 1e-6)
        x, r = np.zeros_like(w), -gradient
        d, rr = r.copy(), float(r @ r)
        stop = 1e-2 * rr
        for _ in range(10):
            if rr <= stop or rr < 1e-18:
                break
            h = backward(curve * forward(d)) + pull * d
            a = rr / float(d @ h)
            x += a * d
            r -= a * h
            new = float(r @ r)
            d, rr = r + (new / rr) * d, new
        size = np.abs(x).max()
        w += x * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-2:
            break
    return w


class Model:
    """table: the weight of each bucket; bias: the score of a text without n-grams, as a logit."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, bucket = features(texts)
        z = self.bias + np.bincount(doc, weights=self.table[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _renumber(columns: np.ndarray, numbers: np.ndarray) -> None:
    for lo in range(0, len(columns), FIT_SLICE):
        columns[lo : lo + FIT_SLICE] = numbers[columns[lo : lo + FIT_SLICE]]


def fitted(columns: np.ndarray, edges: np.ndarray, y: np.ndarray, shares: dict[int, int], learned: np.ndarray | None = None) -> Model:
    """The model of documents with these buckets (row by row) and classes; shares: labelled documents of each class.

    learned: which documents are learned from, if not all. The buckets are numbered anew in place while the model is fitted, for
    the driver has no room for a second copy of them.
    """
    learned = np.ones(len(y), bool) if learned is None else learned
    seen = np.zeros(BUCKETS, bool)
    for lo in range(0, len(columns), FIT_SLICE):
        seen[columns[lo : lo + FIT_SLICE]] = True
    used, index = np.flatnonzero(seen).astype(np.uint32), np.zeros(BUCKETS, np.uint32)
    index[used] = np.arange(len(used), dtype=np.uint32)
    n_pos = int(y[learned].sum())
    n_neg = int(learned.sum()) - n_pos
    _renumber(columns, index)
    try:
        del seen, index
        each = np.zeros((2, len(used)), np.uint32)
        for i in np.flatnonzero(learned):
            each[int(y[i]), columns[edges[i] : edges[i + 1]]] += 1
        ratio = np.log((each[1] + SMOOTHING) / (n_pos + 2 * SMOOTHING)) - np.log((each[0] + SMOOTHING) / (n_neg + 2 * SMOOTHING))
        ratio[each.sum(axis=0) == 0] = 0.0  # of documents that aren't learned from
        del each
        balance = np.where(y > 0, (n_pos + n_neg) / (2 * max(1, n_pos)), (n_pos + n_neg) / (2 * max(1, n_neg))) * learned
        w = fit_logistic(columns, edges, ratio, y, balance)
    finally:
        _renumber(columns, used)
    table = np.zeros(BUCKETS, np.float32)
    table[used] = w[:-1] * ratio
    return Model(table, float(w[-1] + np.log(shares[1] / shares[0])))


def calibrated(model: Model, columns: np.ndarray, edges: np.ndarray, y: np.ndarray, shares: dict[int, int]) -> Model:
    """The model with scores that are the classes' shares among documents that it hasn't learned from.

    Each of FOLDS parts of the sample is scored by a model of the others; a logistic curve over these scores, fitted to the
    classes' true shares, gives the final scores' scale and threshold.
    """
    n = len(y)
    part, z = np.zeros(n, int), np.zeros(n)
    for label in (0, 1):
        part[y == label] = np.arange(int((y == label).sum())) % FOLDS
    for f in range(FOLDS):
        own = fitted(columns, edges, y, {0: 1, 1: 1}, part != f)
        for i in np.flatnonzero(part == f):
            z[i] = own.bias + float(own.table[columns[edges[i] : edges[i + 1]]].sum())
    count = {1: int(y.sum()), 0: n - int(y.sum())}
    weight = np.where(y > 0, shares[1] / count[1], shares[0] / count[0]) * n / sum(shares.values())
    goal = np.where(y > 0, (count[1] + 1) / (count[1] + 2), 1 / (count[0] + 2))  # never quite certain
    middle, width = float(np.median(z)), float(z.std()) or 1.0
    x = np.stack([(z - middle) / width, np.ones(n)])
    line = np.array([1.0, np.log(shares[1] / shares[0])])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(line @ x, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))) @ x.T + 1e-6 * np.eye(2), x @ (weight * (p - goal)))
        line -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(line[0], 1e-3) / width
    bias = model.bias - float(np.log(shares[1] / shares[0]))
    return Model((model.table * slope).astype(np.float32), float(slope * (bias - middle) + line[1]))


def _fitting(rows: list, most: int = CLASS_CHARS) -> list:
    """Ids of (class, characters, id) that fit into `most` characters a class, in the order given; the shortest of a class of which none fits."""
    used: dict = {}
    chosen = [r[2] for r in rows if (n := used.get(r[0], 0) + r[1]) <= most and not used.update({r[0]: n})]
    return chosen + [min(own)[1] for c in {r[0] for r in rows} - used.keys() if (own := [(r[1], r[2]) for r in rows if r[0] == c])]


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = PER_CLASS) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. learn_from: a condition on doc_id."""
    spark = docs.sparkSession
    common.on_workers(spark)
    known = labels.filter(learn_from & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = common.stored(known, "toxicity-labels")
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
    one_class = Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    if len(shares) < 2:
        return one_class
    chosen = common.least_hashed(known, "toxic", "doc_id", per_class)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about per_class rows a class
    sample = common.stored(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    some = spark.createDataFrame([(d,) for d in _fitting(sample.select("toxic", F.coalesce(F.length("text"), F.lit(0)), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect())], sample.select("doc_id").schema)  # per_class rows a class
    design = common.stored(sample.join(F.broadcast(some), "doc_id").select("toxic", "text").mapInArrow(_rows, "toxic int, columns binary"), "toxicity-design")
    # one partition after another: the driver's JVM never holds them all
    held, lengths, toxic = bytearray(), [0], []
    for r in design.toLocalIterator():
        held += r["columns"]
        lengths.append(len(r["columns"]) // 4)
        toxic.append(r["toxic"])
    if len(set(toxic)) < 2:
        return one_class
    sample = np.frombuffer(held, "<u4"), np.cumsum(lengths), np.array(toxic, float), shares  # a bytearray's numbers can be changed in place
    model = fitted(*sample)
    if min(toxic.count(0), toxic.count(1)) >= LEAST_CALIBRATED:
        model = calibrated(model, *sample)
    del sample
    del held
    kernel.release()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: bool = True) -> DataFrame:
    """docs (without their text, if not keep) with score and predicted."""
    spark = docs.sparkSession
    common.on_workers(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers
    kept = docs.drop("score", "predicted")
    names = [c for c in kept.columns if keep or c != text]

    def run(batches):
        tokens.forget()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, part in kernel.slices(batch.column(text), SLICE):
                out[lo : lo + len(part)] = shared.value.scores(part)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], [*names, "score", "predicted"])
        kernel.release()

    chosen = kept.withColumn(text, F.col(text).cast("string"))
    return chosen.mapInArrow(run, common.schema_with(chosen.select(*names), "score double, predicted int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted; documents whose fold is 0 are never learned from."""
    model = learn(docs, labels, common.fold(F.col("doc_id"), 5) != 0)
    return score(docs.withColumn("held_out", common.fold(F.col("doc_id"), 5) == 0), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels"), common.fold(F.col("doc_id"), 5) != 0)
    held = docs.withColumn("held_out", common.fold(F.col("doc_id"), 5) == 0)
    return score(held, model, keep=False).select("doc_id", "held_out", "score", "predicted")
