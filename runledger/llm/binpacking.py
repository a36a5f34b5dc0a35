"""Best-fit packing of token sequences by bin completion with branch and bound.

Pieces of one length are interchangeable, so the search works on the histogram of lengths,
which has at most ``capacity`` entries whatever the number of documents. A filling is a set
of lengths around the largest piece left; it is used as often as the counts allow at once.
Every piece then gets its place from its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.frames import map_texts
from runledger.llm.wordtokens import word_tokens
from runledger.session import materialised

CAPACITY = 4096
END_ID = 1
#: Fillings tried at a branching, branchings in all, and pairs of pieces weighed for the fillings of one branching. The best packing
#: found by then stays, so every piece is packed.
WIDTH = 8
NODES = 800
PAIRS = 100_000
#: Rows that share one salt when pieces of a length are numbered.
SALT_ROWS = 200_000

Packing = list[tuple[int, tuple[tuple[int, int], ...]]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: the ids of a text and ``end_id``, cut after ``capacity``.

    A null text counts as empty and gives one piece with the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, piece, start, length, crc = [], [], [], [], []
        for d, ids in zip(batch.column(0).to_pylist(), word_tokens(tokenizer).encode(batch.column(1).to_pylist())):
            ids += end
            for i, at in enumerate(range(0, len(ids) // 4, capacity)):
                part = ids[4 * at : 4 * (at + capacity)]
                doc.append(d)
                piece.append(i)
                start.append(at)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- search over the histogram ---------------------------------------------------


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the volume, and for each split the pieces that cannot share one (Martello and Toth)."""
    best = -(-sum(x * n for x, n in hist.items()) // capacity)
    sizes = sorted(hist)
    for k in [x for x in sizes if x <= capacity // 2] + [0]:
        big = sum(n for x, n in hist.items() if x > capacity - k)
        mid = [(x, n) for x, n in hist.items() if capacity // 2 < x <= capacity - k]
        small = sum(x * n for x, n in hist.items() if k <= x <= capacity // 2)
        room = sum((capacity - x) * n for x, n in mid)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(hist: dict[int, int], capacity: int) -> Packing:
    """Best fit decreasing: every piece goes where it leaves the least room, else into a new sequence.

    Sequences filled alike are kept as one entry. The sequence with the least room that takes a piece takes the next ones of that
    length, too, as its room is then less still.
    """
    alike: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, filling: tuple, n: int) -> None:
        if room not in alike:
            alike[room] = Counter()
            insort(rooms, room)
        alike[room][filling] += n

    for x in sorted(hist, reverse=True):
        left = hist[x]
        while left:
            i = bisect_left(rooms, x)
            if i == len(rooms):
                k = capacity // x
                n = max(1, left // k)
                put(capacity - min(k, left) * x, ((x, min(k, left)),), n)
                left -= n * min(k, left)
                continue
            room = rooms[i]
            filling, have = next(iter(alike[room].items()))
            k = min(room // x, left)
            n = min(have, left // k)
            alike[room][filling] -= n
            if not alike[room][filling]:
                del alike[room][filling]
            if not alike[room]:
                del alike[room], rooms[i]
            put(room - k * x, (*filling, (x, k)), n)
            left -= n * k
    return [(n, filling) for same in alike.values() for filling, n in same.items()]


def undominated(filling: tuple[tuple[int, int], ...], count: np.ndarray, room: int) -> bool:
    """May no piece, or pair of pieces, be exchanged for one larger piece that is left and fits?

    A filling for which one may is dominated: the exchange leaves smaller pieces for the others.
    """
    used = dict(filling)
    parts = [x for x, n in filling[1:] for _ in range(min(n, 2))]
    sums = set(parts) | {a + b for i, a in enumerate(parts) for b in parts[i + 1 :]} | {0}
    for s in sums:
        spare = np.flatnonzero(count[s + 1 : s + room + 1]) + s + 1
        if any(count[x] > used.get(int(x), 0) for x in spare):
            return False
    return True


def fillings(count: np.ndarray, capacity: int, waste: int, width: int) -> list[tuple[tuple[int, int], ...]]:
    """Undominated fillings around the largest piece that waste at most ``waste``, fullest first.

    ``count`` has the pieces left of every length. Each piece, and each pair of pieces, that fits beside the largest one is completed by
    the largest that still fit; the fullest of these are looked at in detail.
    """
    first = int(np.flatnonzero(count)[-1])
    count = count.copy()
    count[first] -= 1
    largest = np.maximum.accumulate(np.where(count > 0, np.arange(len(count)), 0))
    room = capacity - first
    sizes = np.flatnonzero(count[: room + 1])[::-1]
    if not len(sizes):
        return [((first, 1),)]
    rows = sizes[: max(1, PAIRS // len(sizes))]
    one, two = np.concatenate([sizes, np.repeat(rows, len(sizes))]), np.concatenate([np.zeros_like(sizes), np.tile(sizes, len(rows))])
    left = room - one - two
    ok = (left >= 0) & (two <= one) & ((two != one) | (count[one] > 1))
    one, two, left = one[ok], two[ok], left[ok]
    for _ in range(capacity):
        piece = largest[left]
        if not piece.any():
            break
        left = left - piece
    # Of equally full ones those with the larger pieces first, which are the harder to place later.
    most = min(len(left), 8 * width)
    near = np.argpartition(left * (capacity + 1) - one, most - 1)[:most] if most < len(left) else np.arange(len(left))
    near = near[np.lexsort((-two[near], -one[near], left[near]))]
    found: dict[tuple, int] = {}
    for i in near.tolist():
        rest, used = room, Counter({first: 1})
        own = Counter()
        for x in (int(one[i]), int(two[i])):
            if x and own[x] < count[x]:
                own[x] += 1
                rest -= x
        x = int(largest[rest])
        while x:
            n = min(int(count[x]) - own[x], rest // x)
            if n > 0:
                own[x] += n
                rest -= n * x
            x = int(largest[min(rest, x - 1)]) if rest else 0
        filling = tuple(sorted((used + own).items(), reverse=True))
        if rest <= waste and filling not in found and undominated(filling, count + (np.arange(len(count)) == first), rest):
            found[filling] = rest
            if len(found) == width:
                break
    return sorted(found, key=lambda f: (found[f], [-x for x, _ in f]))


def pack_histogram(hist: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH, nodes: int = NODES) -> Packing:
    """(how often, ((length, pieces), ...)) of a packing into as few sequences as the search finds.

    The best-fit packing is the first incumbent. Where it needs more than the lower bound, depth-first search branches over
    the fillings around the largest piece, each as often as the counts allow or once, and leaves a branch when its waste exceeds what a
    packing better than the incumbent may waste in all. Now and then what is left at a branching is packed by best fit; a better
    incumbent narrows the search but ends no branch. The search holds one histogram and undoes its steps.
    """
    count = np.zeros(capacity + 1, np.int64)
    for x, n in hist.items():
        count[x] += n
    total = sum(x * n for x, n in hist.items())
    sequences = lambda p: sum(n for n, _ in p)
    rest = lambda: {int(x): int(count[x]) for x in np.flatnonzero(count)}
    best = best_fit(rest(), capacity)
    least = sequences(best)
    bound = lower_bound(rest(), capacity)

    def apply(step: tuple[int, tuple], sign: int) -> None:
        for x, k in step[1]:
            count[x] -= sign * step[0] * k

    def branches(wasted: int):
        for filling in fillings(count, capacity, (least - 1) * capacity - total - wasted, width):
            room = capacity - sum(x * k for x, k in filling)
            n = min(int(count[x]) // k for x, k in filling)
            for m in sorted({n, 1}, reverse=True):
                yield m, filling, wasted + m * room

    path: list[tuple[int, tuple]] = []
    stack = [branches(0)] if least > bound and total else []
    while stack and nodes and least > bound:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                apply(path.pop(), -1)
            continue
        n, filling, wasted = step
        if wasted > (least - 1) * capacity - total:
            continue
        apply((n, filling), 1)
        path.append((n, filling))
        if not count.any():
            best, least = list(path), sequences(path)
            apply(path.pop(), -1)
            continue
        nodes -= 1
        if nodes % 8 == 0:
            tail = [*path, *best_fit(rest(), capacity)]
            if sequences(tail) < least:
                best, least = tail, sequences(tail)
        stack.append(branches(wasted))
    return best


# --- places ----------------------------------------------------------------------


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``_ord``, 0 upwards among the pieces of a length, without a task that sees a whole length.

    Pieces of a length are spread over salts; a salt's first number is the count of the salts before it.
    """
    salts = max(1, rows.count() // SALT_ROWS) * 8
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1)
    return ranked.join(firsts, ["length", "_salt"]).withColumn("_ord", F.col("_first") + F.col("_rank")).drop("_salt", "_first", "_rank")


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with ``length``, ``doc_id``, ``piece``, ``ids_crc32``) and their ``sequence_id`` and ``offset``.

    Only the histogram of lengths, at most ``capacity`` rows, goes to the driver. ``rows`` is read several times.
    """
    hist = dict(rows.groupBy("length").count().collect())
    packing = pack_histogram({int(k): int(v) for k, v in hist.items()}, capacity)
    # For each length: the first piece number of each filling, then how to number within it.
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    base = 0
    for n, filling in packing:
        offset = 0
        for x, k in filling:
            ranges.setdefault(x, []).append((seen[x], k, base, offset))
            seen[x] += n * k
            offset += x * k
        base += n
    starts = {x: np.array(r, np.int64) for x, r in ranges.items()}

    def place(batches):
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            order = b.column(b.schema.get_field_index("_ord")).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                r = starts[int(x)][np.searchsorted(starts[int(x)][:, 0], order[at], "right") - 1]
                k = order[at] - r[:, 0]
                seq[at], off[at] = r[:, 2] + k // r[:, 1], r[:, 3] + k % r[:, 1] * x
            keep = [(n, c) for n, c in zip(b.schema.names, b.columns) if n != "_ord"]
            yield pa.RecordBatch.from_arrays([c for _, c in keep] + [pa.array(seq), pa.array(off)], [n for n, _ in keep] + ["sequence_id", "offset"])

    numbered = _numbered(rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "_ord")
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than ``capacity`` are cut. Rows that repeat are packed each on its own; extra columns
    are ignored; an empty table gives no rows.
    """
    return packed(materialised(pieces(docs, tokenizer, capacity, end_id)), capacity)
