"""Hard negatives by exact integer products in a residue number system.

Vectors of integers are reduced modulo a few small primes. Products of the residues are summed by float32 matrix
multiplication, where every partial sum is an integer below 2^24 and so exact; the scores modulo the primes give the signed scores by
Chinese remaindering. Anchors and rows are dealt into blocks, and each block of anchors meets each block of rows in one group
of rows, so a task's memory is fixed whatever the tables hold. A block pair returns the few best of each anchor; windows over these
select the final ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.frames import ship_package
from runledger.session import materialised

#: The largest primes for which 64 products of centred residues stay below 2^24.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
CHUNK = 64
SCALE = 256
#: Rows and anchors of a block, and anchors that are multiplied at once.
ROWS = 4096
ANCHORS = 4096
STRIP = 128
POSITIVES = 5
NEGATIVES = 3
#: Percent of the positive's score that a negative's score may have.
LEAST, MOST = 50, 95


# --- scores ----------------------------------------------------------------------


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p near zero (at most one beyond half of p), for float32 integers below 2^24."""
    return x - np.rint(x * np.float32(1 / p)) * np.float32(p)


def primes_for(bound: float) -> tuple[int, ...]:
    """So many primes that their product is more than four times ``bound``."""
    product, n = 1, 0
    while product <= 4 * bound:
        if n == len(PRIMES):
            raise OverflowError("scores do not fit 64 bits")
        product *= PRIMES[n]
        n += 1
    return PRIMES[: max(n, 1)]


def largest_norm(a: np.ndarray) -> float:
    """No row of the matrix is longer than this."""
    return math.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0)) * (1 + 1e-9)


class Residues:
    """The residues of a matrix of integers, rows x components, modulo each prime, as float32."""

    def __init__(self, a: np.ndarray, primes: tuple[int, ...]):
        self.primes = primes
        self.parts = []
        for p in primes:
            r = a % p
            self.parts.append(np.ascontiguousarray(np.where(r > p // 2, r - p, r).astype(np.float32)))

    def times(self, other: Residues, rows: slice) -> np.ndarray:
        """Exact scores of ``rows`` of this matrix with all rows of the other, int64."""
        digits: list[np.ndarray] = []
        for k, p in enumerate(self.primes):
            a, b = self.parts[k][rows], other.parts[k]
            r = np.zeros((len(a), len(b)), np.float32)
            for at in range(0, a.shape[1], CHUNK):
                r = _centred(r + _centred(a[:, at : at + CHUNK] @ b[:, at : at + CHUNK].T, p) if at else a[:, :CHUNK] @ b[:, :CHUNK].T, p)
            # Mixed radix digits: take away the digits so far and divide by their primes, modulo this one.
            for q, d in zip(self.primes, digits):
                inverse = pow(q, -1, p)
                r = _centred((r - d) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
            digits.append(r)
        score = np.zeros(digits[0].shape, np.int64)
        for p, d in zip(reversed(self.primes), reversed(digits)):
            score *= p
            score += d.astype(np.int64)
        return score


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices of equal width; the true values must be below 2^61."""
    primes = primes_for(largest_norm(a) * largest_norm(b))
    return Residues(a, primes).times(Residues(b, primes), slice(None))


def best(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``n`` largest of each row that are not the least int64; the leftmost of equal ones first. Changes ``scores``."""
    none = np.iinfo(np.int64).min
    n = min(n, scores.shape[1])
    at, value = np.zeros((len(scores), n), np.int64), np.full((len(scores), n), none)
    row = np.arange(len(scores))
    for i in range(n):
        at[:, i] = scores.argmax(1)
        value[:, i] = scores[row, at[:, i]]
        if (value[:, i] == none).all():
            break
        scores[row, at[:, i]] = none
    return at, value


def _matrices(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Integer matrices of one width; missing components are 0."""
    lists = [c.combine_chunks() for c in columns]
    lists = [x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in lists]
    sizes = [np.asarray(x.value_lengths()) for x in lists]
    width = max([1, *(int(s.max()) for s in sizes if len(s))])
    out = []
    for x, s in zip(lists, sizes):
        m = np.zeros((len(x), width), np.int64)
        m[np.arange(width) < s[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
        out.append(m)
    return out


# --- Spark -----------------------------------------------------------------------


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows that can be scored, with ``v``: floor(scale * x) of each component x, as integers.

    Rows with a null vec_id, label or vector, or any null or non-finite component, take no part, nor do vectors whose squared norm
    is 2^60 or more, as scores could leave 64 bits. Vectors may differ in length; missing components count as 0.
    """
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < float(1 << 30)))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(fits)
    return whole.withColumn("v", v).where(norm < float(1 << 60)).withColumn("v", F.col("v").cast("array<int>"))


def _met(anchors: DataFrame, rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn`` of every block of anchors with every block of rows that have the same ``keys``."""
    ship_package(rows.sparkSession)

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    if keys:
        counts = materialised(blocks(anchors, ANCHORS, "_anchor_blocks").join(blocks(rows, ROWS, "_row_blocks"), keys))
    else:
        counts = None
        n_anchors, n_rows = (max(1, -(-df.count() // size)) for df, size in ((anchors, ANCHORS), (rows, ROWS)))

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        at = df.withColumns({"_anchor_blocks": F.lit(n_anchors), "_row_blocks": F.lit(n_rows)}) if counts is None else df.join(counts, keys)
        at = at.withColumn(mine, F.pmod(F.xxhash64("uid"), F.col(own)).cast("int"))
        return at.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_anchor_blocks", "_row_blocks")

    cell = [*keys, "_i", "_j"]
    # The anchors are rows themselves; aliases tell the two sides apart.
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    left = dealt(anchors, "_anchor_blocks", "_row_blocks", "_i", "_j").groupBy(*cell)
    right = dealt(rows, "_row_blocks", "_anchor_blocks", "_j", "_i").groupBy(*cell)
    return left.cogroup(right).applyInArrow(fn, schema)


def _first(rows: DataFrame, keys: list[str], score: str, name: str, n: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(name))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def positives(anchors: DataFrame, rows: DataFrame, n: int = POSITIVES) -> DataFrame:
    """uid, anchor_id, positive_id, positive_score, nth: the first ``n`` rows of the anchor's label and another vec_id."""
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("vec_id")
        a, b = _matrices(left["v"], right["v"])
        primes = primes_for(largest_norm(a) * largest_norm(b))
        ra, rb = Residues(a, primes), Residues(b, primes)
        mine, theirs = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        found = []
        for at in range(0, len(a) if len(b) else 0, STRIP):
            part = slice(at, at + STRIP)
            score = ra.times(rb, part)
            score[mine[part, None] == theirs] = np.iinfo(np.int64).min
            place, value = best(score, n)
            i, k = np.nonzero(value > np.iinfo(np.int64).min)
            found.append((i + at, place[i, k], value[i, k]))
        i, j, s = (np.concatenate(x).astype(np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"uid": left["uid"].to_numpy()[i], "anchor_id": mine[i], "positive_id": theirs[j], "positive_score": s})

    pairs = _met(anchors, rows, ["label"], fn, "uid long, anchor_id long, positive_id long, positive_score long")
    return _first(pairs, ["uid"], "positive_score", "positive_id", n, "nth")


def negatives(anchors: DataFrame, rows: DataFrame, chosen: DataFrame, n: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The rows of ``chosen`` (of ``positives``) with rank, negative_id, negative_score: the first ``n`` rows of another label
    whose score is ``least`` to ``most`` percent of the positive's."""
    lists = chosen.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("wanted"))  # POSITIVES at most
    asked = materialised(anchors.join(lists, "uid"))

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.iinfo(np.int64).min
        right = right.sort_by("vec_id")
        a, b = _matrices(left["v"], right["v"])
        primes = primes_for(largest_norm(a) * largest_norm(b))
        ra, rb = Residues(a, primes), Residues(b, primes)
        mine, theirs, label = left["label"].to_numpy(), right["label"].to_numpy(), right["vec_id"].to_numpy()
        wanted = left["wanted"].to_pylist()
        names = ("uid", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score")
        uid, anchor_id = left["uid"].to_numpy(), left["vec_id"].to_numpy()
        found = [np.zeros((0, len(names)), np.int64)]
        for at in range(0, len(a) if len(b) else 0, STRIP):
            part = slice(at, at + STRIP)
            score = ra.times(rb, part)
            score[mine[part, None] == theirs] = none
            here = wanted[part]
            for k in range(max(map(len, here), default=0)):
                i = np.array([x for x, w in enumerate(here) if len(w) > k])
                p = np.array([here[x][k]["positive_score"] for x in i], dtype=object)
                # In whole numbers, as the bounds are; Python's integers do not overflow.
                lo = np.array([-(-least * int(x) // 100) for x in p], np.int64)[:, None]
                hi = np.array([most * int(x) // 100 for x in p], np.int64)[:, None]
                s = score[i]
                place, value = best(np.where((s >= lo) & (s <= hi), s, none), n)
                x, y = np.nonzero(value > none)
                g = i[x] + at
                nth, pid = (np.array([here[q][k][c] for q in i], np.int64)[x] for c in ("nth", "positive_id"))
                found.append(np.stack([uid[g], anchor_id[g], nth, pid, p[x].astype(np.int64), label[place[x, y]], value[x, y]], 1))
        out = np.concatenate(found)
        return pa.table({c: out[:, q] for q, c in enumerate(names)})

    schema = "uid long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, negative_score long"
    pairs = _met(asked, rows, [], fn, schema)
    return _first(pairs, ["uid", "nth"], "negative_score", "negative_id", n, "rank")


def hard_negatives(rows: DataFrame, is_anchor: Column, vector: str = "embedding", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every anchor and positive.

    ``rows`` has integers ``vec_id`` and ``label`` and a vector; ``is_anchor`` chooses the anchors. Scores are integer inner products of the
    ``quantised`` vectors, higher first, ties by smaller vec_id. A row of the anchor's own vec_id is never its positive. A row that repeats counts
    as often as it occurs, as anchor too. Anchors without a positive, and positives without a negative, give no rows, nor does an
    empty table; other columns are ignored.
    """
    usable = quantised(rows.select("vec_id", "label", F.col(f"`{vector}`").alias("embedding")))
    usable = materialised(usable.select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.col("label").cast("long"), "v"))
    anchors = usable.where(is_anchor)
    chosen = materialised(positives(anchors, usable, n_positives))
    return negatives(anchors, usable, chosen, n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
