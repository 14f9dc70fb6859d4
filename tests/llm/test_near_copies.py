import collections
import hashlib
import random
import re
import statistics

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import components, fingerprints, jaccard, kernel

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i))) for i, (d, s) in enumerate(sets)), key=repr)


def corpus(seed=4, groups=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 11, 14, 22, 40, 90, 300]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                at, what = rng.randrange(len(copy)), rng.random()
                if what < 0.4:
                    copy[at] = rng.choice(words)
                elif what < 0.7 and len(copy) > 1:
                    del copy[at]
                else:
                    copy.insert(at, rng.choice(words))
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(40)]
    rows += ["", None, " \n\t", "same", "same", "Same"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, width, percent):
    rows = corpus()
    found = jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(5), width, percent)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, width, percent)


def test_changed_allowances_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIR_COST", 1e9)
    seen = []
    changed = jaccard._changed
    monkeypatch.setattr(jaccard, "_changed", lambda *a: seen.append(changed(*a)) or seen[-1])
    rows = corpus(9)
    assert sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()), key=repr) == brute(rows, 3, 90)
    assert seen[0], "no band gave up a segment"
    for allowed in seen[0].values():
        assert allowed.sum() == len(allowed)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    rows = corpus(11, 6)
    assert sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()), key=repr) == brute(rows, 3, 90)


def test_similar_sets_always_meet():
    rng = np.random.default_rng(0)
    bands = jaccard.Bands(80)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, n // 4) + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**64, int(rng.integers(0, max(1, n // 4) + 1)), dtype=np.uint64))))
        if not len(b) or 180 * len(np.intersect1d(a, b)) < 80 * (len(a) + len(b)):
            continue
        small = min(bands.of(len(a)), bands.of(len(b)))
        allowed = np.ones(bands.segments(small), int)
        if len(allowed) > 1:
            allowed[0], allowed[1] = 2, 0
        for choice in (None, allowed):
            assert set(jaccard.entries(a, bands, small, choice)) & set(jaccard.entries(b, bands, small, choice))
        assert max(bands.of(len(a)), bands.of(len(b))) - small <= 1


def test_similar_sets_meet_whatever_the_sample_says():
    rng = np.random.default_rng(1)
    met = 0
    for percent in (80, 90):
        bands = jaccard.Bands(percent)
        for _ in range(400):
            n = int(rng.integers(1, 150))
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop, more = (int(rng.integers(0, n // 8 + 2)) for _ in "ab")
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**64, more, dtype=np.uint64))))
            if not len(b) or (100 + percent) * len(np.intersect1d(a, b)) < percent * (len(a) + len(b)):
                continue
            met += 1
            small = min(bands.of(len(a)), bands.of(len(b)))
            m = bands.segments(small)
            allowed = np.ones(m, int)
            if m > 3:
                allowed[:2], allowed[2:4] = 2, 0
            counts = dict(zip(np.union1d(a, b).tolist(), rng.choice([0, 0, 1, 7, 5000], n + more).tolist()))
            known = [np.array([counts[t] for t in x.tolist()]) for x in (a, b)]
            for choice in (None, allowed):
                keys = [jaccard.entries(x, bands, small, choice, k) for x, k in zip((a, b), known)]
                assert set(keys[0]) & set(keys[1])
            assert len(jaccard.entries(a, bands, small, None, known[0])) == bands.differing(small) + 1
    assert met > 300


def test_strangers_that_share_a_line_do_not_meet(spark, monkeypatch):
    """Texts with a common line are compared in pairs if they meet, so their number would count squared."""
    rng = random.Random(6)
    line = " ".join(f"line{i}" for i in range(16))
    texts = [line + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(50, 250))) for _ in range(1500)]
    texts += [t + " end" for t in texts[:20]]
    compared, stored = [], jaccard.common.stored

    def seen(df, name):
        out = stored(df, name)
        if name == "jaccard-classes":
            compared.append(out.select("c").distinct().count())
        return out

    monkeypatch.setattr(jaccard.common, "stored", seen)
    found = jaccard.join(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i % 1500 for i in range(1520)}
    assert 40 <= compared[0] <= 100


def test_join_cases(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (None, "z y x")]
    odd = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, a int, component_id string")
    assert sorted(map(tuple, jaccard.join(odd).collect()), key=repr) == sorted([(None, 6, 3), (None, 6, 3), (3, 6, 3), (3, 6, 3), (None, 1, None)], key=repr)


def test_one_of_each(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (2, base + " more"), (2, base + " more"), (9, "other words entirely here now"), (11, ""), (12, None), (11, "")]
    kept = jaccard.one_of_each(spark.createDataFrame([(*r, "kept") for r in rows], SCHEMA + ", component_id string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in kept) == [(2, "kept"), (9, "kept"), (11, "kept"), (11, "kept"), (12, "kept")]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (300, 301), (301, 300), (-5, -6)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    groups = collections.defaultdict(set)
    for node, root in found:
        groups[root].add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [range(41), range(100, 120), [300, 301], [-6, -5]]))
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 5, 60])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    links = [(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(300)] + [(5000 + i % 40, 5000 + i * i % 40) for i in range(200)] + [(-9, -8), (9000, None)]
    want = {}
    for a, b in links:
        if b is not None and a != b:
            one = want.get(a, {a}) | want.get(b, {b})
            want |= dict.fromkeys(one, one)
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    roots = dict(map(tuple, found))
    assert len(found) == len(roots) == len(want)
    assert all(roots[n] in own and {roots[x] for x in own} == {roots[n]} for n, own in want.items())


def test_few_links_take_few_jobs(spark):
    """The driver keeps something of every job, stage and task: the last rounds of a contraction have hardly a link but as many of them."""
    links = spark.range(1000).selectExpr("id AS a", "id + 1 AS b")
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        assert components.components(links).select("root").distinct().count() == 1
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 10
    finally:
        spark.sparkContext.setJobGroup("", "")


def weighted(text):
    words = re.split(r"[\x09-\x0D\x20]+", text)
    return collections.Counter(zip(words, [*words[1:], None]))


def likeness(a, b):
    a, b = weighted(a), weighted(b)
    return sum((a & b).values()) / sum((a | b).values())


def check_fingerprints(rows, found):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
    found = sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] if r["doc_id"] is not None else 0))
    assert [r["doc_id"] for r in found] == [d for d, _ in rows]
    prints, edited, following, errors = collections.defaultdict(set), [], [], []
    by_id = collections.Counter(d for d, _ in rows)
    for i, ((d, text), r) in enumerate(zip(rows, found)):
        if by_id[d] > 1:
            continue
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        prints[text].add(r["fingerprint"])
        prints[new].add(r["edited_fingerprint"])
        fours = [r["fingerprint"][k : k + 4] == r["edited_fingerprint"][k : k + 4] for k in range(0, len(r["fingerprint"]), 4)]
        assert r["near_edited"] == sum(fours) / len(fours)
        errors += [r["near_edited"] - likeness(text, new), r["near_next"] - likeness(text, after)]
    assert all(len(v) == 1 for v in prints.values())
    return errors


def test_fingerprints_estimate_generalised_jaccard(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    errors = check_fingerprints(rows, fingerprints.query(spark, sf_dir).collect())
    assert abs(statistics.mean(errors)) < 0.01 and statistics.pstdev(errors) < 0.07


def test_weights_count(spark):
    texts = [(0, "a " * 30 + "b " * 10 + "end"), (1, "a " * 10 + "b " * 30 + "end"), (2, "c d")]
    docs = spark.createDataFrame(texts, SCHEMA)
    found = {r["doc_id"]: r for r in fingerprints.fingerprint(docs, 512).collect()}
    assert abs(found[0]["near_next"] - likeness(texts[0][1], texts[1][1])) < 0.09


def test_fingerprint_cases(spark):
    assert fingerprints.fingerprint(spark.createDataFrame([], SCHEMA)).count() == 0
    [one] = fingerprints.fingerprint(spark.createDataFrame([(4, "abcd efgh")], SCHEMA)).collect()
    assert one["near_next"] == 1.0 and one["n_chars"] == 9
    rows = [(None, "no id"), (3, None), (4, ""), (9, "🙂🙂🙂🙂 é\n\n\tx"), (9, "twice"), (10, " lead and trail "), (2**40, "w " * 3000)]
    odd = spark.createDataFrame([(*r, 1, "b") for r in rows], SCHEMA + ", bucket int, next string")
    check_fingerprints(rows, fingerprints.fingerprint(odd).collect())


def test_fingerprints_run_no_python(spark, sf_dir):
    plan = fingerprints.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("bits", [6, 10, 11, 12])
def test_regular_words_have_different_hashes(bits):
    """Words of two letters by the parity of the ones in each place's number have equal sums under any power of a base."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1 << bits))
    words = [word, word.translate(str.maketrans("ab", "ba")), word[::-1], word + word, word + word[::-1], "a" * (1 << bits), "b" * (1 << bits)]
    raw, offsets = kernel.bytes_of(pa.array([" ".join(dict.fromkeys(words))]))
    assert len(np.unique(kernel.word_hashes(raw, *kernel.words_of(raw, offsets)[:2]))) == len(set(words))


def test_documents_of_regular_words_are_not_linked(spark):
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    found = jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (2, 2), (3, 1)]
