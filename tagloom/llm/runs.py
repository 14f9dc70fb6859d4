"""Periodic runs of words, by a suffix automaton.

A run is a stretch of words with smallest period q, of at least max(LEAST, TIMES * q) words, that no neighbouring
word extends. The automaton's states are sets of equal stretches; the positions at which a state's stretches end
are kept in order and merged up the suffix links, always the smaller set into the larger. Each position put
in meets at most two new neighbours: a distance of at most the state's length means that two equal stretches overlap or
touch, so a square lies there. It is extended to both sides as far as the period reaches; stretches whose period isn't
their smallest or that are too short are no runs. A run of period q holds equal stretches that lie q apart,
neighbours in their state's set, so every run has a seed.

Only stretches in which a run can lie go through the automaton: inside a run of period q, all but the last
words start five words that come again within q, so places where five words come again, but too far away for
the stretch they make, are left out. That is an exact test of a necessary condition, by sorted hashes (a collision
lets more through, never less). Extension looks at the whole text.

Each text is handled whole in one task, its words as numbers: a state takes about 300 bytes, two states at most for each
word of the stretches that come again (a text of a million words all of which repeat takes about 500 MB), other
words 30 bytes. Nothing is shuffled. A null text has no words. Texts without words or runs have no runs,
a null best run and their words joined by one space. Rows stand for themselves: repeated ids or rows change nothing. Columns
of the table named like new ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel

#: Words of a run at least, and periods.
LEAST, TIMES = 6, 4
#: Words that are looked for again when stretches are chosen: the longest for which every run has a place that comes again.
GRAM = 5
#: Positions of an ordered set that lie in one list.
CHUNK = 1 << 11


class Ordered:
    """Positions in ascending order, in lists of bounded length, so that putting one in stays cheap in a large set."""

    __slots__ = ("lists", "size")

    def __init__(self, at: int | None = None):
        self.lists, self.size = ([[at]], 1) if at is not None else ([], 0)

    def __iter__(self):
        for part in self.lists:
            yield from part

    def put(self, at: int) -> tuple[int | None, int | None]:
        """Puts a new position in; returns its neighbours."""
        lists = self.lists
        if len(lists) == 1:
            i = 0
        else:
            i = min(bisect_left(lists, at, key=lambda x: x[-1]), len(lists) - 1)
        part = lists[i]
        k = bisect_left(part, at)
        below = part[k - 1] if k else lists[i - 1][-1] if i else None
        above = part[k] if k < len(part) else lists[i + 1][0] if i + 1 < len(lists) else None
        part.insert(k, at)
        self.size += 1
        if len(part) > CHUNK:
            lists[i : i + 1] = [part[: CHUNK // 2], part[CHUNK // 2 :]]
        return below, above


class Automaton:
    """The suffix automaton of a list of numbers; length, link and end (None: a clone) of each state."""

    def __init__(self, word: list[int]):
        self.length, self.link, self.end, self.go = [0], [-1], [None], [{}]
        last = 0
        for at, c in enumerate(word):
            last = self._extend(last, c, at)

    def _state(self, length: int, link: int, end: int | None, go: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        self.go.append(go)
        return len(self.length) - 1

    def _extend(self, last: int, c: int, at: int) -> int:
        go, link, length = self.go, self.link, self.length
        new = self._state(length[last] + 1, 0, at, {})
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p < 0:
            return new
        q = go[p][c]
        if length[p] + 1 == length[q]:
            link[new] = q
            return new
        clone = self._state(length[p] + 1, link[q], None, dict(go[q]))
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = clone
            p = link[p]
        link[q] = link[new] = clone
        return new

    def squares(self):
        """(end, distance) of new neighbours in the sets of end positions, distances of at most the state's length."""
        self.go = None  # only links are needed from here on
        sets: list[Ordered | None] = [None if e is None else Ordered(e) for e in self.end]
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            own, up = sets[v], self.link[v]
            sets[v] = None
            if up <= 0:
                continue  # the empty stretch has no length
            most, into = self.length[up], sets[up]
            if into is None:
                sets[up] = own
                continue
            if own.size > into.size:
                own, into = into, own
            for at in own:
                below, above = into.put(at)
                if below is not None and at - below <= most:
                    yield at, at - below
                if above is not None and above - at <= most:
                    yield above, above - at
            sets[up] = into


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of a and b are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def smaller_period(word: np.ndarray, q: int) -> bool:
    """Whether a stretch of at least 2 q words with period q has a smaller one (which then divides q)."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if (word[d:q] == word[: q - d]).all():
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def stretches(w: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches [start, end) outside of which no run lies."""
    n = len(w) - GRAM + 1
    if n < 1:
        return []
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = kernel.mix(h + w[k : k + n].astype(np.uint64) + np.uint64(k + 1))
    order = np.argsort(h, kind="stable")
    again = np.full(n, n, np.int64)  # how far away the same five words come next
    same = h[order[1:]] == h[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    at = np.flatnonzero(again < n)
    while len(at):
        group = np.cumsum(np.r_[0, at[1:] != at[:-1] + 1])
        most = (np.bincount(group)[group] + GRAM - 1) // (TIMES - 1)  # the longest period of a run in such a stretch
        stays = again[at] <= most
        if stays.all():
            break
        at = at[stays]
    out: list[tuple[int, int]] = []
    if not len(at):
        return out
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    last = np.r_[first[1:], len(at)] - 1
    for a, b in zip(at[first].tolist(), at[last].tolist()):
        end = min(len(w), b + GRAM + (b - a + GRAM) // (TIMES - 1))
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((a, end))
    return out


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words (numbers), by start, then period."""
    found: list[tuple[int, int, int]] = []
    done: dict[int, list[tuple[int, int]]] = {}  # stretches of a period, by start
    for a, b in stretches(w):
        for end, q in Automaton(w[a:b].tolist()).squares():
            end += a  # its word and that q before it are equal
            known = done.setdefault(q, [])
            i = bisect_right(known, (end - q, len(w)))
            if i and known[i - 1][1] > end:
                continue
            start = end - q + 1 - reach(w[end - q :: -1], w[end::-1])
            stop = end + 1 + reach(w[end + 1 - q :], w[end + 1 :])
            insort(known, (start, stop))
            if stop - start >= max(LEAST, TIMES * q) and not smaller_period(w[start:stop], q):
                found.append((start, stop - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: the smallest start, then period."""
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def numbered(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    """A text's words, and equal numbers for equal words."""
    words, numbers = (text or b"").split(), {}  # of bytes: at ASCII white space
    return words, np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _found(batches):
    for batch in batches:
        n = batch.num_columns - 1
        every, tops, texts = [], [], []
        for text in batch.column(n).cast(pa.binary()).to_pylist():
            words, w = numbered(text)
            own = runs(w)
            every.append([dict(zip(("start", "length", "period"), r)) for r in own])
            top = best(own)
            tops.append(dict(zip(("start", "length", "period"), top)) if top else None)
            if own:
                edge = np.zeros(len(w) + 1, np.int64)
                for start, length, q in own:
                    edge[start + q] += 1
                    edge[start + length] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            texts.append(b" ".join(words))
        new = [pa.array(every, pa.list_(_RUN)), pa.array(tops, _RUN), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], [*batch.schema.names[:n], *NEW])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
NEW = ["runs", "best_run", "collapsed"]


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """df with runs (start, length, period of each, by start and period), best_run (the one with the greatest
    exponent) and collapsed (the words that are in no run after its first period, joined by one space)."""
    common.on_workers(df.sparkSession)
    rest = [c for c in df.columns if c not in NEW]
    chosen = df.select(*[f"`{c}`" for c in rest], F.col(f"`{text}`").alias("_text"))
    run = "start: bigint, length: bigint, period: bigint"
    return chosen.mapInArrow(_found, common.schema_with(chosen.drop("_text"), f"runs array<struct<{run}>>, best_run struct<{run}>, collapsed string"))


def tails_repeated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text: in a tenth of the rows, by the key's hash, the words from some place on repeat the first few from there.

    Null keys leave their texts as they are.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    words = F.filter(F.split(F.col(f"`{text}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size("_words")
    chosen = df.select(f"`{key}`", f"`{text}`", (F.coalesce(h % 10 == 0, F.lit(False)) & F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]")).alias("_asked"), g.alias("_g"))
    asked = chosen.withColumn("_words", F.when(F.col("_asked"), words)).withColumn("_a", (F.col("_g") % n).cast("int"))
    asked = asked.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    tail = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return asked.select(f"`{key}`", F.when(F.col("_asked"), F.concat_ws(" ", tail)).otherwise(F.col(f"`{text}`")).alias(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(tails_repeated(common.table(spark, sf_dir, "documents"))).withColumn("_b", F.col("best_run"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length, period = F.col("_b.length"), F.col("_b.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), length.alias("length"), period.alias("period"),
        ((1000 * length - (1000 * length) % period) / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
