"""Periodic runs against trying every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tagloom.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words):
    """All runs: for each period the stretches that have it, kept if no smaller period does."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if length >= max(6, 4 * q) and not any(all(words[i] == words[i + d] for i in range(at, at + length - d)) for d in range(1, q)):
                found.append((at, length, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    """The query's row of a document, as the contract says it."""
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *sha)


def word(seed):
    rng = random.Random(seed)
    out = []
    while len(out) < rng.randint(0, 90):
        if rng.random() < 0.5:
            part = [rng.randint(0, 2) for _ in range(rng.randint(1, 6))]
            inner = part * rng.randint(1, 7)
            out += inner[: len(inner) - rng.randint(0, len(part) - 1)]
            if rng.random() < 0.3:
                out += (inner + [rng.randint(0, 1)]) * rng.randint(1, 5)
        else:
            out += [rng.randint(0, 4) for _ in range(rng.randint(1, 8))]
    return out[:160]


@pytest.mark.parametrize("seed", range(0, 3000, 300))
def test_runs_equal_all_periods_at_all_places(seed):
    for s in range(seed, seed + 300):
        w = word(s)
        assert runs.runs(np.array(w, np.int64)) == plain(w), w


def test_every_short_word_over_two_letters():
    for n in range(13):
        for code in range(1 << n):
            w = [code >> i & 1 for i in range(n)]
            assert runs.runs(np.array(w, np.int64)) == plain(w)


def test_automaton_finds_every_square_seed():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randint(0, 2) for _ in range(rng.randint(1, 40))]
        seeds = set(runs.Automaton(w).squares())
        for end, q in seeds:
            assert end - 2 * q + 1 >= 0 and w[end - 2 * q + 1 : end - q + 1] == w[end - q + 1 : end + 1]
        for start, length, q in plain(w):
            assert any(d == q and start + 2 * q - 1 <= end < start + length for end, d in seeds)


def test_ordered_sets_keep_order_over_several_lists(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 8)
    rng = random.Random(4)
    values = rng.sample(range(1000), 300)
    s, seen = runs.Ordered(values[0]), [values[0]]
    for v in values[1:]:
        below, above = s.put(v)
        assert below == max((x for x in seen if x < v), default=None) and above == min((x for x in seen if x > v), default=None)
        seen.append(v)
    assert list(s) == sorted(seen) and s.size == 300 and len(s.lists) > 10


def test_long_texts():
    w = np.zeros(200_000, np.int64)
    assert runs.runs(w) == [(0, 200_000, 1)]
    rng = np.random.default_rng(1)
    part = rng.integers(0, 50_000, 9001)
    w = np.concatenate((rng.integers(0, 50_000, 5000), np.tile(part, 5)[:40_000], rng.integers(50_000, 60_000, 100)))
    assert runs.runs(w) == [(5000, 40_000, 9001)]


def test_stretches_leave_ordinary_text_out():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 300, 20_000)
    line = rng.integers(0, 300, 12)
    for at in range(100, 19_000, 700):
        w[at : at + 12] = line  # a line that comes again far away
    assert runs.stretches(w) == []
    w[5000:5024] = np.tile(w[4996:5000], 6)
    assert any(a <= 4996 and 5024 <= b for a, b in runs.stretches(w))


CASES = [(i, t) for i, t in enumerate([None, "", " \n\t", "a", "a a a a a a", "a a a a a", "A a A a A a A a", "x\ty\vx y x\fy x\ry\nx", "é é é é é é é", "a a " * 6, "b " * 6 + "b b", "w " * 50_000])]


def test_cases_and_columns(spark):
    rng = random.Random(8)
    rows = CASES + [(None, "q r q r q r q r"), (None, None), (3, "a"), (3, "a")]
    rows += [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))) for i in range(100, 400)]
    rows += [(i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 200)))) for i in range(400, 600)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, collapsed string").repartition(4)
    found = runs.find_runs(runs.tails_repeated(df))
    assert found.columns == ["doc_id", "text", "runs", "best_run", "collapsed"]
    df.write.parquet(path := runs.common.new_path(spark, "runs-test") + "/documents.parquet")
    out = sorted(map(tuple, runs.query(spark, path.removesuffix("/documents.parquet")).collect()), key=repr)
    short = [r for r in rows if len(r[1] or "") < 90_000]
    want = sorted((row(i, t) for i, t in short), key=repr)
    assert [r for r in out if r[0] != 11] == want
    assert next(r for r in out if r[0] == 11)[1:6] == (1, 0, 50_000, 1, 50_000_000)
    empty = df.limit(0)
    assert runs.find_runs(empty).count() == 0 and runs.tails_repeated(empty).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 6000]
    ids = {i for i, _ in docs}
    out = runs.query(spark, sf_dir)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = sorted(tuple(r) for r in out.collect() if r.doc_id in ids)
    assert found == sorted(row(i, t) for i, t in docs)
    assert sum(r[1] > 0 for r in found) > len(found) / 20
