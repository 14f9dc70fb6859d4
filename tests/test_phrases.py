"""Phrases by a prefix tree in a table, against a walk of a tree of dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import annotate

NAMES = ["chopped", "chopped almonds", "chopped walnuts", "almonds", "walnuts", "a silly god damned tag", "romanesco cauliflower", "tsp", "red small ring", "red large ring", "red", "ground black pepper", "ground white pepper", "salt"]


@pytest.fixture(scope="module")
def words(spark):
    return annotate.lexicon(spark.createDataFrame([(n, n) for n in NAMES], "name string, tag string"))


def lines(spark, *texts):
    return annotate.tokens(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "i", F.col("text"))


def test_signs_points_and_parentheses_are_passed_over(spark, words):
    found = annotate.phrases(lines(spark, "Romanesco (green, or so) cauliflower", "romanesco, cauliflower", "tsp. salt", "a silly god-damned tag", "chopped (almonds)", "chopped (almonds", "a silly god", "(salt) tsp", "ground ( x ) black. pepper"), "i", words)
    rows = sorted((r.i, r.pos, r.words, r.tags[0]) for r in found.collect())
    assert rows == [
        (0, 0, 8, "romanesco cauliflower"), (1, 0, 3, "romanesco cauliflower"), (2, 0, 1, "tsp"), (2, 1, 1, "salt"), (3, 0, 4, "a silly god damned tag"),
        (4, 0, 1, "chopped"), (4, 2, 1, "almonds"), (5, 0, 3, "chopped almonds"), (7, 1, 1, "salt"), (7, 3, 1, "tsp"), (8, 0, 6, "ground black pepper"),
    ]


def test_lists_share_the_first_items_words(spark, words):
    texts = [
        "chopped almonds or walnuts, salt",
        "red small ring, large ring and salt",
        "ground black pepper, and white pepper or salt",
        "almonds, walnuts, salt and tsp, red",
        "salt, nothing",
        "nothing at all",
    ]
    found = annotate.phrase_lists(lines(spark, *texts), "i", words).collect()
    rows = {}
    for r in sorted(found, key=lambda r: (r.i, r.list, r.nth)):
        rows.setdefault((r.i, r.list), []).append(r.tags[0])
    assert rows == {
        (0, 0): ["chopped almonds", "chopped walnuts"], (0, 5): ["salt"],
        (1, 0): ["red small ring", "red large ring", "salt"],
        (2, 0): ["ground black pepper", "ground white pepper"], (2, 8): ["salt"],
        (3, 0): ["almonds", "walnuts", "salt", "tsp"], (3, 8): ["red"],
        (4, 0): ["salt"],
    }


def plain(tokens, lexicon):
    """Longest phrases from left to right over words without signs."""
    out, at = [], 0
    while at < len(tokens):
        length = max((n for n in range(1, len(tokens) - at + 1) if " ".join(tokens[at : at + n]) in lexicon), default=0)
        if length:
            out.append((at, length, " ".join(tokens[at : at + length])))
        at += length or 1
    return out


def test_phrases_equal_a_plain_search(spark):
    rng = random.Random(4)
    lexicon = {" ".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(120)}
    texts = [rng.choices("abcdx", k=rng.randint(0, 40)) for _ in range(150)]
    names = annotate.lexicon(spark.createDataFrame([(n, n) for n in lexicon], "name string, tag string"))
    found = annotate.phrases(lines(spark, *map(" ".join, texts)), "i", names).collect()
    assert sorted((r.i, r.pos, r.words, r.tags[0]) for r in found) == sorted((i, *m) for i, t in enumerate(texts) for m in plain(t, lexicon))


def test_empty_tables(spark, words):
    assert annotate.phrases(lines(spark, "salt").limit(0), "i", words).isEmpty() and annotate.phrase_lists(lines(spark, "x"), "i", words.limit(0)).isEmpty()




def test_words_of_texts_are_never_sent_to_all_tasks(spark):
    docs = spark.createDataFrame([(1, "some red ring and red"), (2, "ring")], "i int, t string")
    words = annotate.lexicon(spark.createDataFrame([("red ring", "a"), ("red", "b")], "name string, tag string"))
    found = annotate.phrases(annotate.tokens(docs, "i", F.col("t")), "i", words)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastExchange") <= 3  # a join with the words a level; the lexicon's tree and its roots
    assert sorted((r.i, r.pos, r.words, *r.tags) for r in found.collect()) == [(1, 1, 2, "a"), (1, 4, 1, "b")]
