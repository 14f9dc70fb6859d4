"""Exact self-join of documents on the Jaccard similarity of their word shingles.

Method. Shingles are hashed to 64 bits; the range of hashes is the universe. For every band of set
sizes the universe is cut into segments. Two sets that are similar enough differ in at most H
shingles, H following from the band's sizes. Every segment gets an allowance: 0 (not indexed),
1 (the segment's subset is indexed as it is) or 2 (indexed as it is and with each one shingle
left out, so that subsets that differ by one shingle still meet). Where allowances add up to H + 1,
the pigeonhole principle makes any similar pair meet in some segment. All segments start with 1; by
counted costs (how many sets share a segment's subsets) a segment whose subsets are shared by very
many sets gives its allowance to one that is cheap to index with one shingle left out.

Segments without a shingle would make strangers meet, and so would those that hold nothing but
shingles of a line that very many texts share. So there are spare segments, and each set leaves out
as many of its own, the worst in an order that depends on nothing but the segment and its subset:
empty ones first, then those whose rarest shingle is the most common in a bounded sample, then those
of the fewest shingles. Of the segments (one more than the spare ones at least) in which a similar
pair has the same subset, the best is never left out, for all others come before it. Whatever the
sample says, no pair is lost; it only decides how many strangers meet.

Sets that meet are linked to the first of their meeting place only, so rows stay linear in the
number of index entries however large a group is. Components of the meetings in one band's index
hold all pairs that are similar by it. In components of several blocks, sets are first compared with
the heads that they meet most often, and what that links isn't compared again. Then, within each, tasks compare blocks of bounded size with blocks,
twice: first by bitmaps of a few bits a shingle, in which two sets differ in no more places than
shingles (so no similar pair is lost), then, in the much smaller components of what is left, by the
shingles themselves. Either time a spanning forest of the pairs found is kept, which has the same
components as all of them. Sets are
compared by their 64-bit shingle hashes; equal 64-bit set hashes stand for equal sets.

Cases: null, empty and blank texts have empty sets and are linked with nothing, not even each
other. Texts of fewer words than a shingle have one shingle, the whole sequence. Repeated rows and
copies fall into one class before any comparison. A null doc_id takes part, but a component's id is
its smallest non-null doc_id (null if it has none). An empty table gives no rows. Columns other than id and text aren't
carried by `join`, whatever their names; `one_of_each` keeps them all.
"""

from __future__ import annotations

from functools import lru_cache
from math import erfc, exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, kernel
from . import tokens as memos
from .components import components

WIDTH, PERCENT = 3, 90
#: Index entries that a task joins up before it writes them.
HELD = 500_000
#: Sets that a task remembers, to index copies once; what it forgets is indexed again.
REMEMBERED = 200_000
#: Bytes of text that are worked on at a time.
SLICE = 1 << 20
#: Documents and shingles of a block (of bitmaps twice as many documents); two blocks are compared at a time.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: Share of a band's sets that may have more segments without a rare shingle than there are spare ones.
MANY_EMPTY = 0.002
#: Share of a set's shingles that is taken to be common when spare segments are counted.
COMMON_SHARE = 0.25
#: Sets (about) in which shingles are counted, sets of a common one at least, and common ones that are told apart at most.
SAMPLE, LEAST_COMMON, MOST_COMMON = 5_000, 4, 20_000
#: What comparing two sets costs, against an index entry's 1.
PAIR_COST = 0.1
#: Bits of a bitmap for each shingle of the largest set in a band.
BITMAP_BITS = 4
#: Shingles (columns) that are multiplied at a time.
CHUNK = 4096
#: Rows up to which a list of candidates is sent to all tasks; longer lists are joined by a shuffle.
BROADCAST_ROWS = 200_000
U64 = np.uint64

#: A key begins with its band and its segment (modulo 1024): 20 bits by which costs are counted.
_SEGMENT_BITS, _HASH_BITS = 10, 44


# ------------------------------------------------------------------------------------ size bands


def differing(total: int, percent: int) -> int:
    """Most shingles that only one of two similar sets has, if their sizes add up to `total`."""
    return total - 2 * -(-percent * total // (100 + percent))


def _more_empty(k: int, segments: int, shingles: float) -> float:
    """The chance that more than k segments get none of the shingles: by Poisson's distribution if they are few, else the normal one."""
    mean = segments * exp(-shingles / segments)
    if mean > 2:
        variance = mean * (1 - (1 + shingles / segments) * exp(-shingles / segments))
        return 0.5 * erfc((k + 0.5 - mean) / sqrt(2 * variance))
    term = total = exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return 1 - total


class Bands:
    """Bands of sizes: a set's similar partners of at least its size lie in its own band or the next."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [max(1, (100 - 1) // (100 - percent) - 1) if percent < 100 else 1]

    def _extend(self, size: int) -> None:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // self.percent))

    def tops_up_to(self, size: int) -> list[int]:
        self._extend(size)
        return self.tops[: int(np.searchsorted(self.tops, size)) + 1]

    def of(self, size: int) -> int:
        self._extend(size)
        return int(np.searchsorted(self.tops, size))

    @lru_cache(maxsize=None)  # noqa: B019  a few hundred bands
    def differing(self, band: int) -> int:
        """Most shingles that only one of two similar sets has, the smaller of which lies in the band."""
        while len(self.tops) <= band:
            self._extend(self.tops[-1] + 1)
        total = self.tops[band] + self.tops[band] * 100 // self.percent
        return max(differing(t, self.percent) for t in range(max(2, total - 40), total + 1))

    @lru_cache(maxsize=None)  # noqa: B019
    def spare(self, band: int) -> int:
        """Segments beyond those of the pigeonhole principle: as many as most sets of the band have without a rare shingle."""
        size, spare = self.tops[band - 1] + 1 if band else 1, 0
        while True:
            m = self.differing(band) + 1 + spare
            if spare >= 8 + m // 4 or _more_empty(spare, m, (1 - COMMON_SHARE) * size) <= MANY_EMPTY:
                return spare
            spare += 1

    def segments(self, band: int) -> int:
        return self.differing(band) + 1 + self.spare(band)

    @lru_cache(maxsize=None)  # noqa: B019
    def edges(self, band: int) -> np.ndarray:
        """First hash of each segment but the first."""
        m = self.segments(band)
        return np.array([(i << 64) // m for i in range(1, m)], dtype=U64)


def _keys(sums: np.ndarray, band: int, segment: np.ndarray) -> np.ndarray:
    code = U64(band << _SEGMENT_BITS) | (segment.astype(U64) & U64((1 << _SEGMENT_BITS) - 1))
    with np.errstate(over="ignore"):
        mixed = kernel.mix(sums + kernel.mix(segment.astype(U64) + U64(band << 32)))
    return code << U64(_HASH_BITS) | mixed >> U64(64 - _HASH_BITS)


def _worst(n: int, cuts: np.ndarray, common: np.ndarray | None, plain: np.ndarray) -> np.ndarray:
    """Which n of the plain segments (all, if there are fewer) are left out. Places: 24 bits for the segment, 20 for the size, then the sample's count."""
    size = np.diff(cuts)
    rarest = np.zeros(len(size), np.int64)
    filled = size > 0
    if common is not None and len(common):
        rarest[filled] = np.minimum.reduceat(common, cuts[:-1][filled])
    few = (1 << 20) - 1
    order = np.where(filled, rarest << 44 | few - np.minimum(size, few) << 24, 1 << 62) | np.arange(len(size))
    order[~plain] = -1
    if n == 0:
        return np.zeros(len(size), bool)
    return plain if n >= plain.sum() else order >= np.partition(order, len(order) - n)[len(order) - n]


def entries(tokens: np.ndarray, bands: Bands, band: int, allowed: np.ndarray | None = None, common: np.ndarray | None = None) -> np.ndarray:
    """Keys of a set (ascending distinct hashes) in one band's index. allowed: the segments' allowances if they aren't all 1.
    common: in how many sets of the sample each shingle is."""
    cuts = np.concatenate(([0], np.searchsorted(tokens, bands.edges(band)), [len(tokens)]))
    spread = kernel.mix(tokens)
    segment = np.arange(len(cuts) - 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(spread, dtype=U64)))
        whole = sums[cuts[1:]] - sums[cuts[:-1]]
        used = np.ones(len(segment), bool) if allowed is None else allowed > 0
        used = used & ~_worst(bands.spare(band), cuts, common, used if allowed is None else allowed == 1)
        keys = _keys(whole[used], band, segment[used])
        if allowed is None:
            return keys
        # a subset's own key also meets subsets that hold one shingle more
        of = np.repeat(segment, np.diff(cuts))
        near = allowed[of] == 2
        return np.concatenate((keys, _keys((whole[of] - spread)[near], band, of[near])))


# ------------------------------------------------------------------------------------ the index


def _set_hash(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(kernel.mix(np.asarray([kernel.mix(tokens).sum(dtype=U64) + U64(len(tokens)) * kernel.MIX_A], U64)).view(np.int64)[0])


def _joined(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key with its first id, and the meetings of keys with several ids."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    first = np.flatnonzero(new)
    head = ids[first][np.cumsum(new) - 1]
    other = ids != head
    return keys[first], ids[first], _met(keys[other], ids[other], head[other])


def _met(keys: np.ndarray, ids: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Distinct (id, first id, band and segment) as columns."""
    return np.unique(np.stack((ids, heads, keys >> _HASH_BITS & (1 << 64 - _HASH_BITS) - 1)), axis=1) if len(keys) else np.zeros((3, 0), np.int64)


def _sets(width: int, every: int):
    """doc_id, key, b (shingles), c (set hash, 0 for the empty set) of each document, and the shingles of every so manieth set."""

    def run(batches):
        memos.forget()
        for batch in batches:
            for lo, part in kernel.slices(batch.column(2), SLICE):
                tokens, offsets = kernel.shingle_sets(part, width)
                cids = [_set_hash(tokens[a:b]) if b > a else 0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                signed = tokens.view(np.int64)
                sample = [signed[a:b] if b > a and c % every == 0 else None for c, a, b in zip(cids, offsets[:-1].tolist(), offsets[1:].tolist())]
                columns = [*(x.slice(lo, len(part)) for x in batch.columns[:2]), pa.array(np.diff(offsets)), pa.array(cids, pa.int64()), pa.array(sample, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "b", "c", "sample"])

    return run


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sample's common shingles, ascending, and in how many of its sets each is. What is collected is bounded, whatever the input."""
    each = sets.filter("sample IS NOT NULL").select("c", "sample").dropDuplicates(["c"]).select(F.explode("sample").alias("h"))
    found = each.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    hashes, counts = np.array([r["h"] for r in found], np.int64).view(U64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _index(width: int, percent: int, common: tuple[np.ndarray, np.ndarray], changed: dict[int, np.ndarray] | None = None):
    """a (key), c (set), head of index entries. Sets that meet within a task are met here: a row with a head says that c met it
    under a, and only the first goes on. common: of _common. changed: entries of these bands only, by their allowances."""
    bands = Bands(percent)
    known, counts = common

    def rows(keys, ids, heads):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.nulls(len(ids), pa.int64()) if heads is None else pa.array(heads)], ["a", "c", "head"])

    def run(batches):
        memos.forget()
        keys, ids, held, seen = [], [], 0, set()

        def flush():
            nonlocal keys, ids, held
            key, first, (other, head, code) = _joined(np.concatenate(keys).view(np.int64), np.concatenate(ids))
            for lo in range(0, len(key), 1 << 18):
                yield from rows(key[lo : lo + (1 << 18)], first[lo : lo + (1 << 18)], None)
            if len(other):  # their keys need only begin with the code; the rest deals them out
                dealt = kernel.mix(other.view(U64)) >> U64(64 - _HASH_BITS)
                yield from rows((code.view(U64) << U64(_HASH_BITS) | dealt).view(np.int64), other, head)
            keys, ids, held = [], [], 0

        for batch in batches:
            for _, part in kernel.slices(batch.column(0), SLICE):
                tokens, offsets = kernel.shingle_sets(part, width)
                n = np.zeros(len(tokens), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    n = np.where(known[at] == tokens, counts[at], 0)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    if a == b:
                        continue
                    own = tokens[a:b]
                    cid = _set_hash(own)
                    if cid in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(cid)
                    band = bands.of(b - a)
                    for at in (band, band - 1):
                        if at < 0 or (changed is not None and at not in changed):
                            continue
                        k = entries(own, bands, at, None if changed is None else changed[at], n[a:b])
                        keys.append(k)
                        ids.append(np.full(len(k), cid, np.int64))
                        held += len(k)
                if held >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _runs(batches):
    """Entries sorted by key: the meetings wherever several sets share one, and those that tasks have met before."""
    last_key, last_first = None, None
    for batch in batches:
        keys, ids, heads = (batch.column(c) for c in ("a", "c", "head"))
        keys, ids, known = keys.to_numpy(), ids.to_numpy(), np.asarray(heads.is_valid())
        if known.any():
            met = heads.filter(pa.array(known)).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _met(keys[known], ids[known], met)], ["a", "b", "code"])
        keys, ids = keys[~known], ids[~known]
        if not len(keys):
            continue
        new = np.r_[True, keys[1:] != keys[:-1]]
        firsts = ids[np.flatnonzero(new)]
        if last_key is not None and keys[0] == last_key:
            firsts[0] = last_first
        head = firsts[np.cumsum(new) - 1]
        last_key, last_first = keys[-1], head[-1]
        other = ids != head
        if other.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _met(keys[other], ids[other], head[other])], ["a", "b", "code"])


def _meetings(docs: DataFrame, index, parts: int) -> DataFrame:
    """a, b: sets that meet, each with the first of its meeting place; code: band and segment."""
    found = docs.select("text").mapInArrow(index, "a long, c long, head long")
    return found.repartition(parts, "a").sortWithinPartitions("a", "c").mapInArrow(_runs, "a long, b long, code long").distinct()


def allocate(costs: np.ndarray, sets: int, per_segment: float) -> np.ndarray:
    """Allowances of a band's segments, which add up to their number. costs: pairs of sets that meet in each segment.

    The dearest segment hands its allowance to the cheapest as long as that is worth it: indexing
    subsets with one shingle left out costs an entry for each shingle of each set, and makes more
    pairs meet than the subsets themselves do (twice as many are reckoned with, and all pairs of those
    sets that have one shingle there at most: they meet in the empty subset).
    """
    allowed = np.ones(len(costs), np.int64)
    bare = (sets * (1 + per_segment) * exp(-per_segment)) ** 2 / 2
    order = np.argsort(costs, kind="stable")
    for cheap, dear in zip(order, order[::-1]):
        if PAIR_COST * (costs[dear] - 2 * costs[cheap] - bare) <= sets * per_segment or cheap == dear:
            break
        allowed[cheap], allowed[dear] = 2, 0
    return allowed


def _band(sets: DataFrame, percent: int) -> Column:
    """The band of the size b; there are as many bands as the largest size's logarithm says."""
    tops = Bands(percent).tops_up_to(int(sets.agg(F.max("b")).first()[0] or 1))
    return F.size(F.filter(F.array(*[F.lit(t) for t in tops]), lambda t: t < F.col("b")))


def _changed(sets: DataFrame, meetings: DataFrame, percent: int) -> dict[int, np.ndarray]:
    """Allowances of those bands in which they aren't all 1. What is collected has a row for each size band, or segment of one."""
    bands = Bands(percent)
    met = meetings.groupBy("code", "b").agg(F.count("*").alias("n")).groupBy("code").agg(F.sum(F.col("n") * (F.col("n") + 1) / 2).alias("pairs")).collect()
    costs: dict[int, dict[int, float]] = {}
    for r in met:
        costs.setdefault(r["code"] >> _SEGMENT_BITS, {})[r["code"] & (1 << _SEGMENT_BITS) - 1] = r["pairs"]
    counts = {r["band"]: (r["n"], r["t"]) for r in sets.filter("b > 0").select("b", "c").distinct().groupBy(_band(sets, percent).alias("band")).agg(F.count("*").alias("n"), F.sum("b").alias("t")).collect()}
    found = {}
    for band, by_segment in costs.items():
        m = bands.segments(band)
        n, t = (sum(x) for x in zip(counts.get(band, (0, 0)), counts.get(band + 1, (0, 0))))
        allowed = allocate(np.array([by_segment.get(i & (1 << _SEGMENT_BITS) - 1, 0.0) for i in range(m)]), n, t / max(1, n) / m)
        if (allowed != 1).any():
            found[band] = allowed
    return found


# ---------------------------------------------------------------------------------- verification


def similar_pairs(sets: list[np.ndarray], percent: int, apart: np.ndarray | None = None):
    """All pairs of similar sets, as arrays (i, j). apart: which pairs (of a sets x sets table) are of interest."""
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    if n == 2:  # most groups
        total = int(sizes.sum())
        close = 100 * sizes.min() >= percent * sizes.max() and (apart is None or apart[0, 1])
        if close and (100 + percent) * len(np.intersect1d(sets[0], sets[1], assume_unique=True)) >= percent * total:
            yield np.array([0]), np.array([1])
        return
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    column = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    shared = np.bincount(column)[column] > 1  # a shingle of one set alone adds to no intersection
    row, column = owner[order][shared], column[shared]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    met = np.zeros((n, n), np.float32)
    step = max(64, min(CHUNK, (1 << 23) // n))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        block = np.zeros((n, step), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        met += block @ block.T
    ok = (100 + percent) * met.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :])
    if apart is not None:
        ok &= apart
    yield np.nonzero(np.triu(ok, 1))


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """The pairs (arrays i, j at a time) that join what earlier ones haven't joined yet."""
    up = np.arange(n)
    kept = []

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        while (up != up[up]).any():
            up = up[up]
        _, first = np.unique(up[i] * n + up[j], return_index=True)  # of pairs between the same two trees one is enough
        for k in np.sort(first).tolist():
            a, b = top(i[k]), top(j[k])
            if a != b:
                up[max(a, b)] = min(a, b)
                kept.append((int(i[k]), int(j[k])))
    return kept


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    """Parities of how many shingles fall on each of 64 * words places."""
    at = (kernel.mix(tokens) >> U64(32)) * U64(64 * words) >> U64(32)
    odd = np.flatnonzero(np.bincount(at.astype(np.int64), minlength=64 * words) & 1)
    out = np.zeros(words, U64)
    np.bitwise_or.at(out, odd >> 6, U64(1) << (odd & 63).astype(U64))
    return out


def bitmap_words(bands: Bands, band: int) -> int:
    return -(-BITMAP_BITS * bands.tops[band] // 64)


def maybe_similar(bitmaps: np.ndarray, sizes: np.ndarray, percent: int, apart: np.ndarray | None = None):
    """Pairs whose bitmaps differ in no more places than similar sets do in shingles, some arrays (i, j) at a time. apart: as above."""
    n, words = bitmaps.shape
    step = max(1, (1 << 20) // max(1, n * words))
    for lo in range(0, n, step):
        differ = np.bitwise_count(bitmaps[lo : lo + step, None, :] ^ bitmaps[None, lo:, :]).sum(axis=2, dtype=np.int64)
        total = sizes[lo : lo + step, None] + sizes[None, lo:]
        ok = differ <= total - 2 * -(-percent * total // (100 + percent))
        if apart is not None:
            ok &= apart[lo : lo + step, lo:]
        i, j = np.nonzero(ok)
        later = j > i
        yield i[later] + lo, j[later] + lo


def _compare(percent: int, exact: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for (_, x, y), own in group.groupby(["root", "x", "y"], sort=False):
            own = own.drop_duplicates("c")
            ids, label = own["c"].to_numpy(), own["label"].to_numpy()
            apart = label[:, None] != label[None, :]  # the others are linked already
            if x != y:
                left = (own["block"] == x).to_numpy()
                apart &= left[:, None] != left[None, :]
            if not apart.any():
                continue
            if exact:
                pairs = similar_pairs([np.frombuffer(t, U64) for t in own["payload"]], percent, apart)
            else:
                pairs = maybe_similar(np.frombuffer(b"".join(own["payload"]), U64).reshape(len(own), -1), own["b"].to_numpy(), percent, apart)
            out += [(int(ids[i]), int(ids[j])) for i, j in forest(len(ids), pairs)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


_PLACED = "c long, b long, root long, block int, upto int, single boolean, label long, payload binary"


def _payloads(width: int, percent: int, exact: bool):
    """A row for each place of a document: its shingles, or a bitmap of them."""
    bands = Bands(percent)

    def run(batches):
        memos.forget()
        for batch in batches:
            sets, places = batch.column("c"), batch.column("places").to_pylist()
            for lo, part in kernel.slices(batch.column("_text"), SLICE):
                tokens, offsets = kernel.shingle_sets(part, width)
                at, rows = [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own = tokens[a:b]
                    for p in places[lo + i]:
                        at.append(lo + i)
                        bands.segments(max(p["band"], 0))  # so that the band is known
                        payload = own if exact else bitmap(own, bitmap_words(bands, p["band"]))
                        rows.append((b - a, p["root"], p["block"], p["upto"], p["single"], p["label"], payload.tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 7, kinds)]
                yield pa.RecordBatch.from_arrays([sets.take(pa.array(at, pa.int64())), *columns], ["c", "b", "root", "block", "upto", "single", "label", "payload"])
        kernel.release()

    return run


def _blocks(n: Column, t: Column, exact: bool) -> Column:
    """Blocks of n sets with t shingles together. A bitmap takes a sixteenth of the shingles' room."""
    sets, shingles = (BLOCK_SETS, BLOCK_SHINGLES) if exact else (2 * BLOCK_SETS, 16 * BLOCK_SHINGLES)
    return F.greatest(F.ceil(n / sets), F.ceil(t / shingles)).cast("int")


def _linked(docs: DataFrame, candidates: DataFrame, width: int, percent: int, exact: bool) -> DataFrame:
    """a, b: links between sets of one root, enough for the components: true ones, or those that bitmaps don't rule out.

    candidates: key (of a document with the set), b (its size), c, root, label, band (for bitmaps); a set may
    have several roots. Sets with the same label are linked already and aren't compared: those of a
    root's commonest label meet its other sets alone, so a large group of copies costs no pairs of blocks of its own.
    """
    spark = docs.sparkSession
    labels = candidates.groupBy("root", "label").agg(F.count("*").alias("n"), F.sum("b").alias("t"))
    sums = labels.groupBy("root").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.max(F.struct("n", "t", "label")).alias("most")).filter("n > most.n")
    sums = sums.select(
        "root",
        F.col("most.label").alias("_most"),
        (_blocks(F.col("n"), F.col("t"), exact) == 1).alias("single"),
        _blocks(F.col("n") - F.col("most.n"), F.col("t") - F.col("most.t"), exact).alias("_others"),
        _blocks(F.col("most.n"), F.col("most.t"), exact).alias("_crowd"),
    )
    crowd = F.col("label") == F.col("_most")
    within = lambda n: F.pmod(F.xxhash64("c"), n).cast("int")
    block = F.when(F.col("single"), 0).when(crowd, F.col("_others") + within(F.col("_crowd"))).otherwise(within(F.col("_others")))
    upto = F.when(F.col("single"), 1).when(crowd, F.col("_others")).otherwise(F.col("_others") + F.col("_crowd"))
    places = F.struct("root", block.cast("int").alias("block"), upto.cast("int").alias("upto"), "single", "label", "band")
    spread = candidates.join(sums, "root").groupBy("key", "c").agg(F.max("b").alias("b"), F.collect_list(places).alias("places"))  # two places at most
    spread = common.stored(spread, "jaccard-candidates")
    total = spread.agg(F.sum("b"), F.count("*")).first()
    groups = max(4 * common.shuffle_partitions(spark), -(-int(total[0] or 0) // (BLOCK_SHINGLES // 4)))
    chosen = spread.drop("b")
    placed = (
        docs.select("key", F.col("text").alias("_text"))
        .join(F.broadcast(chosen) if total[1] <= BROADCAST_ROWS else chosen, "key")
        .select("c", "places", "_text")
        .mapInArrow(_payloads(width, percent, exact), _PLACED)
    )
    # every block of the others meets itself and all blocks; groups of one block share tasks
    other = F.explode(F.sequence(F.lit(0), F.col("upto") - 1))
    paired = placed.withColumn("_other", other).select("root", "c", "b", "block", "label", "payload", F.least("block", "_other").alias("x"), F.greatest("block", "_other").alias("y"), "single")
    task = F.when(F.col("single"), F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.xxhash64("root", "x", "y"))
    return paired.withColumn("task", task).groupBy("task").applyInPandas(_compare(percent, exact), "a long, b long")


#: Heads that a set of a large root is compared with before blocks are: those that it meets in most segments.
HEADS = 2


def _heads(docs: DataFrame, meetings: DataFrame, roots: DataFrame, candidates: DataFrame, width: int, percent: int) -> DataFrame | None:
    """a, b: true links of sets with their commonest heads, in the roots of several blocks (None if there are none).

    They join most of a large group of near copies by comparisons that grow with its sets, not their pairs.
    """
    sums = candidates.groupBy("root").agg(F.count("*").alias("n"), F.sum("b").alias("t"))
    large = common.stored(sums.filter(_blocks(F.col("n"), F.col("t"), False) > 1).select("root"), "jaccard-large")
    if large.isEmpty():
        return None
    band = F.shiftright("code", _SEGMENT_BITS).cast("int")
    met = meetings.select("a", "b", band.alias("band")).withColumn("node", F.xxhash64("a", "band")).join(roots, "node").join(large, "root", "left_semi")
    met = met.groupBy("a", "b", "band").agg(F.count("*").alias("n"))
    commonest = Window.partitionBy("a").orderBy(F.desc("n"), "b", "band")
    met = common.stored(met.withColumn("_n", F.row_number().over(commonest)).filter(F.col("_n") <= HEADS).select("a", "b", "band"), "jaccard-heads")
    sets = common.stored(candidates.join(large, "root", "left_semi").select("c", "key", "band").distinct(), "jaccard-large-sets")
    limits = Bands(percent)

    def held(exact: bool):
        """c, band, b and the shingles, or a bitmap of them."""

        def run(batches):
            memos.forget()
            for batch in batches:
                bands = batch.column("band").to_pylist()
                for lo, part in kernel.slices(batch.column("text"), SLICE):
                    own, offsets = kernel.shingle_sets(part, width)
                    parts = [own[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                    for at in bands[lo : lo + len(part)]:
                        limits.segments(at)  # so that the band is known
                    payload = [(x if exact else bitmap(x, bitmap_words(limits, at))).tobytes() for x, at in zip(parts, bands[lo:])]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, len(part)) for c in ("c", "band")), pa.array(np.diff(offsets)), pa.array(payload, pa.binary())], ["c", "band", "b", "payload"])
            kernel.release()

        return run

    def tested(exact: bool):
        def run(batches):
            for batch in batches:
                keep = []
                rows = zip(*(batch.column(c).to_pylist() for c in ("m", "n", "x", "y")))
                for i, (m, n, x, y) in enumerate(rows):
                    x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                    if exact:
                        ok = (100 + percent) * len(np.intersect1d(x, y, assume_unique=True)) >= percent * (m + n)
                    else:
                        ok = int(np.bitwise_count(x ^ y).sum()) <= differing(m + n, percent)
                    if ok:
                        keep.append(i)
                yield batch.select(["a", "b", "band"]).take(pa.array(keep, pa.int64()))

        return run

    def those(pairs: DataFrame, exact: bool) -> DataFrame:
        """The pairs that are similar, or that bitmaps don't rule out."""
        asked = pairs.select(F.col("a").alias("c"), "band").unionByName(pairs.select(F.col("b").alias("c"), "band")).distinct()
        chosen = common.stored(sets.join(asked, ["c", "band"]), "jaccard-asked")
        texts = docs.select("key", "text").join(F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen, "key").select("c", "band", "text")
        rows = texts.mapInArrow(held(exact), "c long, band int, b long, payload binary")
        rows = common.stored(rows.dropDuplicates(["c", "band"]), "jaccard-held")  # rows may repeat id and text
        left = rows.select(F.col("c").alias("a"), "band", F.col("b").alias("m"), F.col("payload").alias("x"))
        right = rows.select(F.col("c").alias("b"), "band", F.col("b").alias("n"), F.col("payload").alias("y"))
        return pairs.join(left, ["a", "band"]).join(right, ["b", "band"]).select("a", "b", "band", "m", "n", "x", "y").mapInArrow(tested(exact), "a long, b long, band int")

    maybe = common.stored(those(met, False), "jaccard-maybe")
    return those(maybe, True).select("a", "b")


# -------------------------------------------------------------------------------------- the join


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    common.on_workers(spark)
    every = max(1, docs.count() // SAMPLE)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    parts = 2 * common.shuffle_partitions(spark)
    sets = common.stored(docs.mapInArrow(_sets(width, every), "doc_id long, key long, b long, c long, sample array<long>"), "jaccard-sets")
    frequent = _common(sets)
    sets = sets.drop("sample")
    meetings = common.stored(_meetings(docs, _index(width, percent, frequent), parts), "jaccard-meetings")
    if changed := _changed(sets, meetings, percent):
        again = _meetings(docs, _index(width, percent, frequent, changed), parts)
        meetings = meetings.filter(~F.shiftright("code", _SEGMENT_BITS).isin(list(changed))).unionByName(again)
    # a node is a set in one band's index
    band = F.shiftright("code", _SEGMENT_BITS).cast("int")
    roots = components(meetings.select(F.xxhash64("a", band).alias("a"), F.xxhash64("b", band).alias("b")))
    # one document of each set stands for all
    classes = common.stored(sets.filter("b > 0").groupBy("c", "b").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key")), "jaccard-distinct")
    own = _band(sets, percent)
    nodes = classes.withColumn("band", F.explode(F.array(own, own - 1))).withColumn("node", F.xxhash64("c", F.col("band").cast("int")))
    candidates = common.stored(nodes.join(roots, "node").select("c", "b", "key", "root", "band"), "jaccard-classes")
    true_roots = roots.limit(0)
    if not candidates.isEmpty():
        links = _heads(docs, meetings, roots, candidates, width, percent)
        if links is None:
            labelled = candidates.withColumn("label", F.col("c"))
        else:
            links = common.stored(links, "jaccard-head-links")
            known = components(links).select(F.col("node").alias("c"), F.col("root").alias("_label"))
            labelled = common.stored(candidates.join(known, "c", "left").withColumn("label", F.coalesce("_label", "c")).drop("_label"), "jaccard-labelled")
        left = components(_linked(docs, labelled, width, percent, exact=False)).select(F.col("node").alias("c"), "root")
        own_label = labelled.select("c", "label").distinct()
        rest = common.stored(classes.join(left, "c").join(own_label, "c").select("c", "b", "key", "root", "label", F.lit(0).alias("band")), "jaccard-rest")
        if not rest.isEmpty():
            found = _linked(docs, rest, width, percent, exact=True)
            links = found if links is None else links.unionByName(found)
        if links is not None:
            true_roots = components(links)
    labelled = classes.join(true_roots.select(F.col("node").alias("c"), F.col("root").alias("label")), "c", "left").select("c", "doc_id", F.coalesce("label", "c").alias("label"))
    labelled = common.stored(labelled, "jaccard-members")  # read twice: one plan of all this has more shuffles at a time than the driver has room for
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(least, "label").select("c", "component_id")
    empty = sets.filter("b = 0").select("doc_id", F.col("b").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return sets.filter("b > 0").join(named, "c").select("doc_id", F.col("b").alias("n_shingles"), "component_id").unionByName(empty)


#: What near copies are unless a caller says otherwise.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def one_of_each(docs: DataFrame, width: int = NEAR_WIDTH, percent: int = NEAR_PERCENT) -> DataFrame:
    """Rows of docs without near copies: of each component the document with the smallest id stays, repeated rows once."""
    joined = common.stored(join(docs, width, percent), "jaccard-result")
    gone = joined.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    n = gone.count()
    key = docs["doc_id"].cast("long")
    kept = docs.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, key == F.col("_gone"), "left_anti")
    again = joined.filter("doc_id = component_id AND n_shingles > 0").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        return kept
    # rows that repeat an id: one of them, the first by text
    ids = again.select(F.col("doc_id").alias("_again"))
    key = F.col("doc_id").cast("long")
    once = kept.join(ids, key == F.col("_again"), "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))).filter("_n = 1").drop("_n")
    return kept.join(ids, key == F.col("_again"), "left_anti").unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


#: The same rows by joining documents on all their shingles: for small tables.
ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM split),
each_one AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each_one a JOIN each_one b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS root FROM sets UNION SELECT y, root FROM reach JOIN links ON node = x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON s.doc_id = r.node
"""
