import itertools
import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagloom.llm import binary, packing
from tagloom.llm.tokens import Encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "\n\n", "a\n", "\na", "a \nb", "a\n b", "don't stop", "x  y", "a\tb", "A.\nB'c\nD.", "tail ", "É.\nÉ", "a\r\nb", "<|endoftext|>", "a<|endoftext|>b", "so <|endoftext|>. <|startoftext|>And", "nb\xa0sp", "word" * 40, "l'été, 1½ ~ 2"]
SCHEMA = "doc_id long, text string"


def ids_of(path, text, end):
    t = Tokenizer.from_file(path)
    return np.asarray([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


@pytest.mark.parametrize(("path", "spaced"), [(WORDS, False), (BYTES, True)])
def test_encoder_equals_library(path, spaced):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abéß ABC.,'!12\n\t -日\xa0") for _ in range(rng.randrange(40))) for _ in range(1500)]
    enc, library = Encoder(path, spaced), Tokenizer.from_file(path)
    for _ in range(2):  # learned, then remembered
        found = enc.encode(texts)
        for text, raw in zip(texts, found):
            assert raw == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_memo_stays_bounded():
    enc = Encoder(WORDS, False, entries=20)
    for i in range(20):
        enc.encode([f"word{i} other{i} third{i}"])
    assert len(enc.memo) + len(enc.old) <= 60


def test_words_are_learned_once_whatever_their_case_and_signs():
    enc, library = Encoder(WORDS, False), Tokenizer.from_file(WORDS)
    texts = ["Word word, (word) WORD. word.", "wOrd, Été", None, " \n", "word.", "été x.y 1a"]
    for text, raw in zip(texts, enc.encode(texts)):
        assert raw == np.asarray(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    assert len(enc.memo) == len(["word", ",", "(word)", ".", "Été", "été", "x.y", "1a"])


def test_letters_whose_lower_case_lies_far_off():
    enc, library = Encoder(WORDS, False), Tokenizer.from_file(WORDS)
    texts = [f"{a}{chr(c)}{b}" for c in range(33, 0x300) for a, b in (("", ""), ("A", ""), ("", "a"), ("a", ","))]
    for text, raw in zip(texts, enc.encode(texts)):
        assert raw == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def brute_bins(sizes, capacity):
    """Least number of bins, by trying all ways."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def bins_of(sizes, capacity):
    counts = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, int)
    plan, used = packing.plan_bins(counts, capacity), np.zeros(capacity + 1, int)
    for filling, times in plan:
        assert sum(s * n for s, n in filling.items()) <= capacity
        for s, n in filling.items():
            used[s] += n * times
    assert (used == counts).all()
    return sum(t for _, t in plan)


def test_plan_is_optimal_on_small_cases():
    rng = random.Random(1)
    for i in range(560):
        capacity = rng.choice([20, 30, 50, 100])
        sizes = [rng.randint(1, capacity * rng.choice([3, 5, 7, 10]) // 10) for _ in range(rng.randint(8, 13) if i > 60 else rng.randint(0, 9))]
        assert bins_of(sizes, capacity) == (brute_bins(sizes, capacity) if sizes else 0), (sizes, capacity)
    assert bins_of([49, 18, 36, 22, 48, 27, 60, 13, 35, 28, 22, 39], 100) == 4


def triplets(n, seed, capacity=1000):
    """Documents of which some three always fill a bin."""
    rng, sizes = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(250, (capacity - a) // 2)
        sizes += [a, b, capacity - a - b]
    return sizes


@pytest.mark.parametrize("seed", range(4))
def test_plan_of_triplets(seed):
    assert bins_of(triplets(20, seed), 1000) == 20
    assert bins_of(triplets(40, seed), 1000) <= 41  # the steps may run out one bin above the least


def test_fillings_are_all_that_nothing_dominates():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 7))]
        left, room = np.bincount(sizes, minlength=16), rng.randint(1, 15)
        every = {tuple(sorted(c)) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= room}

        def dominates(a, b):
            """Whether the documents of b can be dealt to those of a, none of which gets more than its length."""
            if not b:
                return True
            return any(b[0] <= x and dominates((*a[:i], *((x - b[0],) if x > b[0] else ()), *a[i + 1 :]), b[1:]) for i, x in enumerate(a))

        best = {a for a in every if not any(b != a and dominates(b, tuple(reversed(a))) for b in every)}
        found = {tuple(sorted(s for s, n in f.items() for _ in range(n))) for _, f in packing._fillings(room, left, room, [10**6])}
        assert found == best, (sizes, room)


def test_plan_lies_between_its_bound_and_best_fit():
    rng = np.random.default_rng(2)
    for capacity, most in ((256, 50), (100, 1000), (4096, 3)):
        counts = rng.integers(0, most, capacity + 1)
        counts[0] = 0
        bins = sum(t for _, t in packing.plan_bins(counts, capacity))
        assert packing.lower_bound(counts, capacity) <= bins <= sum(t for _, t in packing._best_fit(counts.copy(), capacity))


def test_plan_of_short_documents_meets_the_bound():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.minimum(4096, rng.lognormal(6, 1, 20_000).astype(int) + 1), minlength=4097)
    assert sum(t for _, t in packing.plan_bins(counts)) == packing.lower_bound(counts, 4096)


def check_packed(rows, texts, capacity):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        raw, at = ids_of(WORDS, texts[doc], 1), 0
        for k, p in enumerate(sorted(pieces, key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at)
            assert p["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + p["length"])])
            assert p["length"] == capacity or k == len(pieces) - 1
            at += p["length"]
        assert 4 * at == len(raw)
    for pieces in by_bin.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity


def test_pack_small(spark):
    rng = random.Random(7)
    texts = {i: " ".join(rng.choice(["red", "blue", "greenish", "a"]) for _ in range(rng.randrange(60))) for i in range(80)} | {100: None, 101: "", 102: "x " * 500}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), SCHEMA), WORDS, 64).collect()
    check_packed(rows, texts, 64)


def test_pack_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.query(spark, sf_dir).collect()
    check_packed(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 4096)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 4096) + 1


def test_pack_cases(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0
    clash = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (2, None, None, None)], "doc_id long, text string, length long, sequence_id string")
    rows = packing.pack(clash, WORDS, 8).collect()
    assert sorted(r["length"] for r in rows) == [1, 3, 3] and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_pack_rows_without_ids_and_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    docs = spark.createDataFrame([(None, "a b")] * 30 + [(7, "a b c")] * 30 + [(8, "z " * 100)], SCHEMA)
    rows = packing.pack(docs, WORDS, 16).collect()
    assert len(rows) == 30 + 30 + 7 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 67
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by_bin.values():
        ends = [0, *(a + n for a, n in sorted(found))]
        assert [a for a, _ in sorted(found)] == ends[:-1] and ends[-1] <= 16


def test_other_tokenizers_go_to_the_library(tmp_path):
    path = str(tmp_path / "own.json")
    file = json.loads(Path(BYTES).read_text())
    file["pre_tokenizer"]["add_prefix_space"] = True
    Path(path).write_text(json.dumps(file))
    enc, library = Encoder(path, True), Tokenizer.from_file(path)
    assert not enc.known and Encoder(BYTES, True).known and Encoder(WORDS, False).known
    for text, raw in zip(ODD, enc.encode(ODD)):
        assert raw == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], SCHEMA)
    packed = packing.pack(docs, WORDS, 32, ids=True)
    whole = packing.sequences(packed, 32).collect()
    assert sum(r["length"] for r in whole) == sum(len(r["ids"]) // 4 for r in whole) == packed.selectExpr("sum(length)").first()[0]


def test_binary_round_trip(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    start = 0
    rows = sorted(binary.query(spark, sf_dir).collect())
    assert [r["doc_id"] for r in rows] == sorted(docs)
    for r in rows:
        raw = ids_of(BYTES, docs[r["doc_id"]], 0)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(raw) // 4, zlib.crc32(raw))
        start += r["n_tokens"]


def test_binary_cases(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (7, "again"), (7, "again")]
    path = str(tmp_path / "files")
    binary.write(spark.createDataFrame(docs, SCHEMA), path, BYTES)
    rows = binary.read(spark, path, ids=True).collect()
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in rows) == sorted((d, ids_of(BYTES, t, 0)) for d, t in docs)
    some = binary.lookup(spark, path, [0, 7, 50, 999]).collect()
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in some) == sorted((d, ids_of(BYTES, t, 0)) for d, t in docs if d in (0, 7, 50))
    nothing = str(tmp_path / "nothing")
    binary.write(spark.createDataFrame([], SCHEMA), nothing, BYTES)
    assert binary.read(spark, nothing).count() == 0


def test_binary_of_clashing_columns_and_very_long_texts(spark, tmp_path):
    path, long = str(tmp_path / "files"), "word and word " * 60_000
    docs = [(1, long, 7, "x"), (None, "a b", 7, "x"), (2, "", 7, "x")]
    binary.write(spark.createDataFrame(docs, SCHEMA + ", n_tokens int, ids string"), path, BYTES)
    rows = binary.read(spark, path, ids=True).collect()
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in rows), key=repr) == sorted(((d, ids_of(BYTES, t, 0)) for d, t, _, _ in docs), key=repr)


def test_dictionary_is_shared_and_hashed(spark, sf_dir, tmp_path):
    path = str(tmp_path / "files")
    binary.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, BYTES)
    [stored] = spark.read.parquet(f"{path}/dictionary").collect()
    assert stored["hash"] == binary.dictionary_hash(bytes(stored["data"])) and len(stored["data"]) > 0
    assert {r[0] for r in spark.read.parquet(f"{path}/blocks").select("dictionary_hash").collect()} == {stored["hash"]}


def test_dictionary_of_few_short_among_many_long_documents(spark, monkeypatch):
    monkeypatch.setattr(binary, "SAMPLE_CHARS", 2000)
    rng = random.Random(6)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(100)] + [(1000 + i, "long text " * 300) for i in range(6000)]
    sample = binary._sample(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, 0, 2)
    assert len(sample) == 100 and len(binary.train(sample)) > 1000
