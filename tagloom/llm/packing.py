"""Best-fit packing of token sequences by bin completion with branch and bound.

Only lengths matter for a packing, and a length is at most the capacity: so the search works on a
histogram with one count per length, whatever the number of documents. A filling found for the
largest length left is used as many times as the counts allow, which all but empties one of its
lengths: the plan's size follows the number of lengths, not of documents. Documents then find their place by their length
and their rank among documents of that length: ranks come from counts per (bucket, length), so no
task ever holds all documents of a length, nor all rows of one id.

Empty documents still hold their end id. Null texts count as empty. Repeated rows are packed as
rows of their own, and so are rows without an id; an empty table gives no rows. Columns other than
id and text are not carried, whatever their names.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, kernel
from .tokens import encoder

CAPACITY = 4096
#: Steps of the search; beyond them the best packing so far stands.
STEPS = 3_000_000
#: Dominated fillings in a row after which one is tried all the same.
VAIN = 30
#: Lengths up to which each is tested for a bin that it could be in, and pairs come like with like first.
FEW_LENGTHS = 256
#: States that the search remembers.
SEEN = 200_000
#: Pieces that a worker's tokenizer remembers (twice over), and bytes of text that it cuts up at a time.
MEMO_ENTRIES, SLICE = 250_000, 4 << 20


# ---------------------------------------------------------------------------------- the search


def _mask(counts: np.ndarray) -> int:
    """A number whose bit s says whether there are documents of length s."""
    return int.from_bytes(np.packbits(counts > 0, bitorder="little").tobytes(), "little")


def _dominated(used: dict[int, int], waste: int, left: np.ndarray, there: int) -> bool:
    """Whether a document left out could take the place of some of the filling's, or use its waste, so
    that what it replaces could go where it would have gone (the replaced ones add up to its length at
    most, and it to theirs and the waste; equal single documents don't count).
    """
    one = several = 0  # sums of one document, and of two or more
    free = there
    for s, n in used.items():
        for _ in range(n):
            several |= (several | one) << s
            one |= 1 << s
        if left[s] == n:
            free &= ~(1 << s)
    if waste:
        reach, width = (1 | one | several) << 1, 1  # lengths above a sum by 1 to `waste`
        while width < waste:
            step = min(width, waste - width)
            reach |= reach << step
            width += step
        if free & reach:
            return True
    return bool(free & several)


def _fillings(room: int, left: np.ndarray, allowed: int, steps: list[int]) -> Iterator[tuple[int, dict[int, int]]]:
    """All undominated fillings of `room` that waste `allowed` at most, as (waste, {length: times}), by ascending waste.

    When VAIN in a row were dominated, the
    next one comes anyway: it does no harm, and the search goes on. steps[0] counts down; nothing more
    comes when it is used up.
    """
    there = _mask(left[: room + 1])
    if not there or room == 0:
        if room <= allowed:
            yield room, {}
        return
    if there >> room & 1:  # takes the place of any other filling
        yield 0, {room: 1}
        return
    sizes = np.flatnonzero(left[: room + 1])
    partner = room - sizes
    pairs = sizes[(sizes >= partner) & (left[partner] > (sizes == partner))]
    if len(sizes) > FEW_LENGTHS:  # long with short while there is much choice; then like with like
        pairs = pairs[::-1]
    for a in pairs.tolist():  # no document fits exactly, so none can replace a pair
        yield 0, {a: 1, room - a: 1} if a != room - a else {a: 2}
    # sums of the lengths up to each one tell which targets can be reached, so that no branch is in vain
    whole = (1 << room + 1) - 1
    lengths = sizes.tolist()
    reach = [1]
    steps[0] -= len(lengths) // 8
    for s in lengths:
        if reach[-1] == whole:  # longer ones add nothing
            reach += [whole] * (len(lengths) + 1 - len(reach))
            break
        bits, n, k = reach[-1], min(int(left[s]), room // s), 1
        while n > 0:
            bits |= bits << min(k, n) * s
            n -= k
            k *= 2
        reach.append(bits & whole)

    def exactly(target: int, below: int) -> Iterator[dict[int, int]]:
        if target == 0:
            yield {}
            return
        i = bisect_right(lengths, target, 0, below)
        while i and reach[i] >> target & 1:
            s = lengths[i - 1]
            for n in range(min(int(left[s]), target // s), 0, -1):
                steps[0] -= 1
                if steps[0] < 0:
                    return
                if reach[i - 1] >> target - n * s & 1:
                    for more in exactly(target - n * s, i - 1):
                        yield {s: n, **more}
            i -= 1
            steps[0] -= 1

    vain = 0
    for waste in range(min(allowed, room) + 1):
        if reach[-1] >> room - waste & 1:
            for used in exactly(room - waste, len(lengths)):
                steps[0] -= 10
                if waste or sum(used.values()) > 2:
                    vain += 1
                    if vain > VAIN or not _dominated(used, waste, left, there):
                        yield waste, used
                        vain = 0
                if steps[0] < 0:
                    return


def _unfillable(left: np.ndarray, capacity: int, allowed: int) -> bool:
    """Whether some document can't be in a bin that wastes `allowed` at most. Looks only where few lengths are left."""
    lengths = np.flatnonzero(left).tolist()
    if len(lengths) > FEW_LENGTHS or allowed >= lengths[0]:
        return False
    whole, bits = (1 << capacity + 1) - 1, 1
    for s in lengths:
        n, k = min(int(left[s]), capacity // s), 1
        while n > 0:
            bits |= bits << min(k, n) * s
            n -= k
            k *= 2
        bits &= whole
    window = (1 << allowed + 1) - 1
    return any(not bits >> max(0, capacity - s - allowed) & window for s in lengths)


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on the histogram: each document goes where it leaves least room. Bins that are alike go together."""
    alike: dict[int, list[tuple[dict[int, int], int]]] = {}  # by room
    rooms: list[int] = []  # ascending
    for s in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[s])
        at = bisect_left(rooms, s)
        while n:
            room = rooms[at] if at < len(rooms) else capacity
            filling, times = alike[room].pop() if room < capacity else ({}, n)
            if room < capacity and not alike[room]:
                del alike[room]
                rooms.pop(at)
            each = min(n, room // s)  # a bin that took one has the least room for the next one too
            full = min(times, n // each)
            rest = n - full * each if full < times else 0
            for take, many in ((each, full), (min(rest, each), int(rest > 0)), (0, times - full - int(rest > 0))):
                if many > 0 and (take or filling):
                    left = room - take * s
                    if left not in alike:
                        alike[left] = []
                        insort(rooms, left)
                    alike[left].append(({**filling, s: take} if take else filling, many))
            n -= full * each + rest
            at = bisect_left(rooms, s)
    return [x for group in alike.values() for x in group]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by total length, and by documents too large to share a bin (Martello and Toth)."""
    half, k = capacity // 2, np.arange(capacity // 2 + 1)  # lengths below k are left out
    number, length = np.cumsum(counts), np.cumsum(counts * np.arange(len(counts)))
    big = number[capacity] - number[capacity - k]
    mid = number[capacity - k] - number[half]
    room = capacity * mid - (length[capacity - k] - length[half])
    small = length[half] - np.append(0, length)[k]
    bound = big + mid + np.maximum(0, -(-(small - room) // capacity))
    return max(int(-(-length[-1] // capacity)), int(bound.max()))


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[dict[int, int], int]]:
    """A packing of counts[s] documents of each length s: fillings {length: times} and how often each is used.

    The best-fit packing is the first incumbent. The search takes the largest length left and tries all
    its undominated fillings, from least waste up, each as often as the counts allow, then half as
    often, and so on down to once. A branch is given up when its waste, or the lower bound of what is
    left, can no longer save a bin over the incumbent, or when the same documents were left before
    with no more waste. The search ends when an incumbent meets the lower bound or the tree is done (then it
    is optimal), or after `steps` steps (then the incumbent stands, and `lower_bound` tells how far it
    may be from the least).
    """
    counts = np.asarray(counts, dtype=np.int64).copy()
    counts[0] = 0
    total = int((counts * np.arange(len(counts))).sum())
    best = _best_fit(counts, capacity)
    bins = sum(t for _, t in best)
    bound = lower_bound(counts, capacity) if total else 0
    budget = [steps]
    left = counts.copy()
    draw = random.Random(0)
    mark = [draw.getrandbits(120) for _ in range(len(counts))]
    state = sum(int(counts[s]) * mark[s] for s in np.flatnonzero(counts))
    seen: dict[int, int] = {}  # a number for the documents left, and the least waste they were met with

    def moves(waste: int) -> Iterator[tuple[int, dict[int, int], int]]:
        """Fillings of the node at hand, a few at a time, so that waiting nodes hold little."""
        first, many = 0, 1
        largest = int(np.flatnonzero(left)[-1])
        while True:
            left[largest] -= 1
            found = list(islice(_fillings(capacity - largest, left, (bins - 1) * capacity - total - waste, budget), first, first + many))
            left[largest] += 1
            for w, f in found:
                filling = {**f, largest: f.get(largest, 0) + 1}
                times = min(int(left[s]) // n for s, n in filling.items())
                if w:
                    times = min(times, ((bins - 1) * capacity - total - waste) // w)
                while times > 0:
                    yield w, filling, times
                    times //= 2
            if len(found) < many:
                return
            first, many = first + many, 3 * many

    def use(filling: dict[int, int], times: int) -> int:
        for s, n in filling.items():
            left[s] -= n * times
        return state - sum(n * times * mark[s] for s, n in filling.items())

    # depth-first: at each level the moves still open, and what led there; `left` and `state` follow the path
    stack: list[tuple[Iterator, dict[int, int], int, int, int]] = [(moves(0) if total else iter(()), {}, 0, 0, 0)]
    while stack and bins > bound and budget[0] > 0:
        options, filling, times, waste, used = stack[-1]
        move = next(options, None)
        if move is None:
            stack.pop()
            state = use(filling, -times)
            continue
        budget[0] -= 50
        w, filling, times = move
        waste, used = waste + w * times, used + times
        allowed = (bins - 1) * capacity - total - waste
        if allowed < 0:
            continue
        state = use(filling, times)
        if state == 0 and not left.any():
            if used < bins:
                best, bins = [*((f, t) for _, f, t, _, _ in stack[1:]), (filling, times)], used
        elif seen.get(state, waste + 1) > waste and used + lower_bound(left, capacity) < bins and not _unfillable(left, capacity, allowed):
            if len(seen) < SEEN:
                seen[state] = waste
            stack.append((moves(waste), filling, times, waste, used))
            continue
        state = use(filling, -times)
    return best


# ------------------------------------------------------------------------------ pieces of documents


def _piece_batches(path: str, capacity: int, end_id: int, ids: bool, memo: int = MEMO_ENTRIES):
    end = np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        kernel.release()
        enc = encoder(path, False, memo)
        for batch in batches:
            keys = batch.column(0)
            rows, piece, start, length, crc, raws = [], [], [], [], [], []
            for lo, part in kernel.slices(batch.column(1), SLICE if memo == MEMO_ENTRIES else SLICE // 4):
                for i, raw in enumerate(enc.encode_array(part), lo):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), step)):
                        cut = raw[a : a + step]
                        rows.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if ids:
                            raws.append(cut)
            columns = [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array(raws, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        kernel.release()

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, ids: bool = False, memo: int = MEMO_ENTRIES) -> DataFrame:
    """Every document's ids with the end id, cut after each `capacity` ids. ids: keep them, as little-endian bytes.

    memo: pieces of text that a worker's tokenizer remembers; fewer take less memory and more time.
    """
    common.on_workers(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_piece_batches(tokenizer, capacity, end_id, ids, memo), schema)


# ------------------------------------------------------------------------------- places of pieces

#: Pieces of one length that are ranked in one window, about.
RANK_ROWS = 50_000


def _ranges(plan: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, first sequence, sequences, offset): where the pieces of each length with ranks [from, to) go."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    found, base = [], 0
    for filling, times in plan:
        offset = 0
        for s in sorted(filling, reverse=True):
            n = filling[s]
            found.append((s, int(used[s]), int(used[s] + n * times), base, times, offset))
            used[s] += n * times
            offset += n * s
        base += times
    return found


def place(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity), and a `_row` that differs from row to row.

    `sized` is read several times, so it must be stored. The tables that are broadcast follow the
    number of lengths: one row a length, and two a range of the plan at most.
    """
    spark = sized.sparkSession
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in sized.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[length] = n
    ranges = _ranges(plan_bins(histogram, capacity), capacity)
    # ranks of a length are cut into as many slots as it has ranges: a piece looks at those of its slot alone
    many = np.bincount([r[0] for r in ranges], minlength=capacity + 1)
    slot = np.maximum(1, -(-histogram // np.maximum(1, many)))
    lengths = [(int(s), int(-(-histogram[s] // RANK_ROWS)), int(slot[s])) for s in np.flatnonzero(histogram)]
    lengths = spark.createDataFrame(lengths, "length long, _buckets long, _width long")
    slots = [(s, k, *rest) for s, *rest in ranges for k in range(rest[0] // int(slot[s]), (rest[1] - 1) // int(slot[s]) + 1)]
    slots = spark.createDataFrame(slots, "length long, _slot long, _from long, _to long, _base long, _times long, _offset long")

    bucketed = sized.join(F.broadcast(lengths), "length").withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets")))
    per = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))  # a row for RANK_ROWS pieces, or one a length
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = Window.partitionBy("length", "_bucket").orderBy("_row")
    ranked = (
        bucketed.withColumn("_local", F.row_number().over(rank) - 1)
        .join(offsets, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_local"))
        .withColumn("_slot", F.floor(F.col("_rank") / F.col("_width")))
    )
    inside = F.col("_rank") - F.col("_from")
    kept = [c for c in sized.columns if c != "_row"]
    return (
        ranked.join(F.broadcast(slots), ["length", "_slot"])
        .filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .select(
            *kept,
            (F.col("_base") + inside % F.col("_times")).alias("sequence_id"),
            (F.col("_offset") + F.floor(inside / F.col("_times")) * F.col("length")).cast("long").alias("offset"),
        )
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, ids: bool = False, memo: int = MEMO_ENTRIES) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that they get."""
    cut = pieces(docs, tokenizer, capacity, end_id, ids, memo).withColumn("_row", F.monotonically_increasing_id())
    return place(common.stored(cut, "packing-pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The ids of each sequence, from pack(..., ids=True): at most `capacity` ids, so at most as many rows meet."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
