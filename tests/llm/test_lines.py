"""Dropping of shared lines against a dictionary of all keys."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tagloom.llm import common, lines

SCHEMA = "doc_id long, text string, n_lines string, extra int"


def plain(rows, least=40, documents=5):
    def key(line):
        k = line.strip(" \t\n\v\f\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    held = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                held[k].append(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= documents}
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        stays = [x for x in parts if key(x) not in last or last[key(x)] == i]
        out.append((i, len(parts), len(parts) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest(), "\n".join(stays)))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    out = lines.drop_lines(df, **more)
    assert sorted(out.columns) == ["doc_id", "extra", "kept_text", "n_dropped", "n_lines", "text"]
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest(), r.kept_text) for r in out.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    shared = [f"Shared line number {i} " + "w" * rng.randint(15, 60) for i in range(40)]
    shared += ["ß" * 39, "é" * 40, "É" * 40, "ab" * 19 + "Ä", "x" * 40]
    rows = []
    for i in range(400):
        text = []
        for _ in range(rng.randint(0, 12)):
            line = rng.choice(shared) if rng.random() < 0.5 else f"own line {i} {rng.random()} of this document alone, long enough"
            text.append(rng.choice(["", " ", "\t\v", " "]) + (line.upper() if rng.random() < 0.2 else line) + rng.choice(["", "\r", "\f "]))
        rows.append((i if rng.random() < 0.95 else None, "\n".join(text)))
    hot = "The line that every third document holds, whatever else it says."
    rows += [(1000 + i, f"{hot}\n{hot}\nown {i}\n") for i in range(200)]
    rows += [rows[3], rows[3], (5000, None), (5001, ""), (5002, "\n\n"), (5003, "y" * 300_000), (None, hot)]
    rows += [(None, "a line of rows without an id, in five of them at least")] * 6
    rows += [(6000 + i, "a line of four documents only: nothing of it goes anywhere") for i in range(4)]
    return rows


@pytest.mark.parametrize("setting", [{}, {"MOST_CONFIRMED": 0}, {"BITS": 1, "LEAST_SLICE": 64, "TWICE_BITS": 128}, {"GATHERED": 10}])
def test_dropping_equals_a_dictionary(spark, corpus, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(lines, name, value)
    assert found(spark, corpus) == plain(corpus)


def test_other_limits_and_empty_tables(spark, corpus):
    assert found(spark, corpus[:150], least=20, documents=2) == plain(corpus[:150], 20, 2)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == plain([(1, None), (2, "")])


def test_repeated_keys_are_always_suspected(spark, corpus):
    common.on_workers(spark)
    texts = spark.createDataFrame([(t,) for _, t in corpus], "text string").repartition(5)
    f = lines.seen_twice(texts, 40)
    times = defaultdict(int)
    for _, t in corpus:
        for d in lines.long_keys((t or "").encode(), 40):
            times[d] += 1
    digests = sorted(times)
    hit = lines.suspected(digests, f)
    assert all(h for d, h in zip(digests, hit) if times[d] > 1)
    once = np.array([times[d] == 1 for d in digests])
    assert hit[once].mean() < 0.02  # few others are


def test_only_suspects_are_shuffled(spark, corpus, monkeypatch):
    kept, store = {}, common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: kept.setdefault(name, store(df, name)))
    found(spark, corpus)
    keys = sum(len(lines.long_keys((t or "").encode(), 40)) for _, t in corpus)
    repeated = sum(n for n in kept["line-suspects"].groupBy("digest").count().toPandas()["count"] if n > 1)
    assert repeated <= kept["line-suspects"].count() <= repeated + 0.02 * keys


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    out = lines.query(spark, folder)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        want = con.sql(lines.ORACLE)
        assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall())
    assert out.filter("n_dropped > 0").count() > 0
