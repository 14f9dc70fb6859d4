import math
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagloom.llm import language, toxicity


def test_all_ngrams_take_part(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(800)]
    # each class has words of its own, each of them in several documents
    rows = [(i, " ".join(rng.choice(words[:400] if i % 2 else words[400:], 60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"), F.lit(True))
    every = {t[i : i + n] for _, t in rows for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
    assert np.count_nonzero(model.table) > 0.9 * len(every) > 3000


def ngram_sets(text):
    text = "".join(" " if "\t" <= c <= "\r" else c for c in text.lower())
    return {(n, text[i : i + n]) for n in toxicity.ORDERS for i in range(len(text) - n + 1)}


def test_features_are_sets_of_characters():
    texts = ["Ein Dümmkopf", "", None, "ab", "日本語のテキスト", "a\tb a b a b", "x" * 300_000]
    doc, bucket = toxicity.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert len(set(bucket[doc == i].tolist())) == (doc == i).sum() == len(ngram_sets(t or ""))


def test_fit_equals_plain_version():
    """Log-count ratios, and the optimality of the weights, against sums over documents one by one."""
    texts = ["you bad fool", "bad bad day", "a fine day", "fine sea and day", "fool of a day", "the sea"]
    y = np.array([1, 1, 0, 0, 1, 0], float)
    doc, bucket = toxicity.features(pa.array(texts))
    model = toxicity.fitted(bucket.astype("<u4"), np.searchsorted(doc, np.arange(len(texts) + 1)), y, {1: 3, 0: 3})
    sets = [set(bucket[doc == i].tolist()) for i in range(len(texts))]
    ratio = {}
    for b in set().union(*sets):
        pos, neg = (sum(b in s for s, v in zip(sets, y) if v == label) for label in (1, 0))
        ratio[b] = math.log((pos + 1) / (3 + 2)) - math.log((neg + 1) / (3 + 2))
    scores = [model.bias + sum(float(model.table[b]) for b in s) for s in sets]
    assert np.allclose(1 / (1 + np.exp(-np.array(scores))), model.scores(pa.array(texts)), atol=1e-6)
    # at the optimum the pull of each weight equals what the documents ask for
    error = [v - 1 / (1 + math.exp(-z)) for v, z in zip(y, scores)]
    for b, r in ratio.items():
        if r:
            assert abs(float(model.table[b]) / r - r * sum(e for e, s in zip(error, sets) if b in s)) < 0.05


def test_mixture_equals_plain_version():
    rng = np.random.default_rng(1)
    langs = ["a", "b", "c", "d"]
    model = language.Model(langs, np.log(rng.dirichlet(np.full(language.BUCKETS, 0.1), 4) + 1e-7).astype(np.float32))

    def words_of(text):
        found = []
        for w in text.split():
            raw = b" " + w.encode() + b" "
            grams = [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(raw) - 2)]
            found.append(np.array([sum(float(model.logs[k][g]) for g in grams) for k in range(4)]))
        return np.array(found)

    def best_set(text):
        """The best of all sets of languages, each fitted by as many rounds of expectation and maximisation."""
        logs = words_of(text)
        found = []
        for mask in range(1, 16):
            pi = np.array([mask >> k & 1 for k in range(4)], float)
            pi /= pi.sum()
            many = bin(mask).count("1")
            like = np.exp(logs - logs.max(axis=1, keepdims=True))
            for _ in range(language.ITERATIONS if many > 1 else 0):
                part = like * pi
                pi = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
            found.append((float(np.log((like * pi).sum(axis=1)).sum()) - language.PENALTY * (many - 1) * math.log(len(logs) + 1), pi))
        return max(found, key=lambda x: x[0])

    same = 0
    for _ in range(60):
        text = " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(rng.integers(1, 40)))
        value, pi = best_set(text)
        [k], [share] = language.mixtures(model, pa.array([text]))
        same += k == pi.argmax() and abs(share - pi.max()) < 1e-3
    assert same >= 54  # sets grow step by step, which may miss the best of these texts in random languages


def test_one_long_text_leaves_the_class_its_sample(spark, monkeypatch):
    """A document that alone is longer than a class's characters is skipped, whichever class it is in and whatever its hash."""
    rng = np.random.default_rng(3)
    words = {0: ["plain", "kind", "calm", "water"], 1: ["vile", "scum", "filth", "stupid"]}
    rows = [(i, " ".join(rng.choice(words[i % 2], 20).tolist()), i % 2) for i in range(200)]
    monkeypatch.setattr(toxicity, "CLASS_CHARS", 20_000)
    for long in (0, 1, 2, 3):
        own = [(i, t + " x" * 11_000 if i == long else t, c) for i, t, c in rows]
        docs = spark.createDataFrame([(i, t) for i, t, _ in own], "doc_id long, text string")
        labels = spark.createDataFrame([(i, c) for i, _, c in own], "doc_id long, toxic int")
        found = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
        assert all(found[i]["predicted"] == c for i, _, c in own if i != long)


def test_samples_of_classes():
    rows = [(0, 50, "a"), (0, 200, "b"), (0, 40, "c"), (1, 300, "d"), (1, 150, "e"), (0, 20, "f")]
    assert toxicity._fitting(rows, 100) == ["a", "c", "e"]
    assert toxicity._fitting(rows, 1000) == ["a", "b", "c", "d", "e", "f"]
    assert toxicity._fitting([], 5) == []


def test_null_ids_are_held_out_and_scored(spark):
    docs = spark.createDataFrame([(None, "good words"), (1, "bad words"), (2, "good words"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    found = toxicity.classify(docs, labels).collect()
    assert len(found) == 4 and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] for r in found if r["doc_id"] is None)


def test_long_texts_have_the_same_features_in_pieces(monkeypatch):
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcdefgh éÄß\n日🙂"), 5000).tolist())
    short = pa.array([text, "x", text[:50]])
    doc, bucket = toxicity.features(short)
    monkeypatch.setattr(toxicity, "LONG", 97)
    monkeypatch.setattr(toxicity, "SLICE", 1)  # every text by itself
    again = toxicity.features(short)
    assert (doc == again[0]).all() and (bucket == again[1]).all()


def test_scores_are_calibrated_on_documents_that_models_have_not_seen():
    """Words that say nothing: the model tells its own documents apart, but scores must be the classes' share."""
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list("abcdefghij"), 30)) for _ in range(160)]
    y = np.array([i % 4 == 0 for i in range(160)], float)
    doc, bucket = toxicity.features(pa.array(texts))
    sample = bucket.astype("<u4"), np.searchsorted(doc, np.arange(161)), y, {1: 40, 0: 120}
    plain, found = toxicity.fitted(*sample), toxicity.calibrated(toxicity.fitted(*sample), *sample)
    fresh = pa.array(["".join(rng.choice(list("abcdefghij"), 30)) for _ in range(300)])
    assert abs(found.scores(fresh).mean() - 0.25) < 0.05 < found.scores(fresh).std() + 0.05
    order = np.argsort(plain.scores(fresh))
    assert (np.diff(found.scores(fresh)[order]) >= -1e-6).all()  # scale and threshold alone change


def sampled(n, width, seed=5):
    """Documents of as many different buckets each, and their classes."""
    rng = np.random.default_rng(seed)
    y = (np.arange(n) % 2).astype(float)
    rows = [np.sort(rng.choice(4000, width, replace=False) + (2000 if label else 0)) * 300 for label in y]
    return np.concatenate(rows).astype("<u4"), np.arange(n + 1) * width, y


def test_fit_makes_no_copy_of_the_sample():
    columns, edges, y = sampled(4000, 2000)
    before = columns.copy()
    tracemalloc.start()
    try:
        toxicity.calibrated(toxicity.fitted(columns, edges, y, {0: 9, 1: 1}), columns, edges, y, {0: 9, 1: 1})
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (columns == before).all()
    assert most < 2 * columns.nbytes, most


def test_parts_left_out_are_not_learned_from():
    columns, edges, y = sampled(90, 50)
    learned = np.arange(90) % 3 != 1
    rest = np.flatnonzero(learned)
    found = toxicity.fitted(columns, edges, y, {0: 1, 1: 1}, learned)
    want = toxicity.fitted(np.concatenate([columns[edges[i] : edges[i + 1]] for i in rest]), np.arange(len(rest) + 1) * 50, y[rest], {0: 1, 1: 1})
    assert np.allclose(found.table, want.table, atol=1e-6) and np.isclose(found.bias, want.bias, atol=1e-6)
