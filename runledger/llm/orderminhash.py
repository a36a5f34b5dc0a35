"""Near-duplicate detection by order MinHash, with candidates verified by banded alignment.

A document is its sequence of lower-case words. Its k-mers (five words) are labelled with their
occurrence number, so that repeats count. A sketch takes the few k-mers of smallest hash and keeps
their order in the text; equal sketches therefore speak for small edit distance, not only for common
content. Documents are near duplicates when the alignment of their words has an edit similarity of 0.8
or more: 1 - distance / words of the longer text. Groups are the connected components of the links found.

Families of sketches find candidates. One has k-mers of five words, four to a sketch. One has k-mers of three words, two to a
sketch, and is made for the edit similarity: texts of which every fifth word differs, at random places, still share one of its sketches in
19 cases of 20. In texts of more than LONG words runs of three words recur by chance, so these have k-mers of five words, two to a
sketch, instead: they share one in 98 % of cases where every tenth word differs, 82 % at 15 in 100 and 54 % at every fifth.
Lengths and hashed word counts, which bound the edit distance from below, rule out candidates before their texts are read.

Equal word sequences are one class from the start. In a bucket of equal sketches every class is first
compared with the smallest one, which settles most buckets with one comparison for each member. In buckets that hold more
than one group after that, every two classes of different groups are compared, see ``rest_links``.
"""

from __future__ import annotations


import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runledger.llm.frames import map_texts, ship_package, whole_row
from runledger.session import materialised

KMER = 5
ORDERED = 4
#: Words above which runs of three words recur by chance.
LONG = 2000
#: (words of a k-mer, k-mers of a sketch, sketches, texts of at least so many words, of at most so many) of each family. The last two
#: overlap by so much that any two similar texts have one of them in common.
FAMILIES = ((KMER, ORDERED, 2, 0, None), (3, 2, 28, 0, LONG), (KMER, 2, 20, int(0.8 * LONG), None))
SIMILARITY = 0.8
#: Bytes of text sketched at once; more words of a slice are then hashed once.
SLICE = 4 << 20
#: Rows of a table of links that one task takes, and the fewest tasks.
LINKS_PER_TASK = 200_000
MIN_TASKS = 8
#: Classes that one task aligns.
CELL_ROWS = 2000
#: Classes of a block, and bytes of their texts, at which a bucket is dealt into more blocks.
BLOCK = 512
BLOCK_BYTES = 8 << 20
#: Counts in a bag of words.
BAG = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-case runs of anything but white space; null has none. What ``word_codes`` does for whole arrays."""
    return (text or "").lower().split()


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all words of all texts, and the number of words of each text. Each distinct word is hashed once."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))[real]
    coded = pc.dictionary_encode(flat.filter(pa.array(real)))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return hashes[coded.indices.to_numpy(zero_copy_only=False)], np.bincount(owner, minlength=len(texts))


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def kmers(codes: np.ndarray, lengths: np.ndarray, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-mers with their occurrence numbers, the text of each), in text order. A shorter text is one k-mer."""
    with np.errstate(over="ignore"):
        owner = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.cumsum(lengths) - lengths
        h = np.full(len(codes), kmer, np.uint64)
        for i in range(kmer):
            h[: len(codes) - i] = (h[: len(codes) - i] ^ codes[i:]) * _MIX
            h ^= h >> np.uint64(29)
        whole = np.zeros(len(codes), bool)
        whole[: max(0, len(codes) - kmer + 1)] = owner[: max(0, len(codes) - kmer + 1)] == owner[kmer - 1 :]
        for d in np.flatnonzero((lengths > 0) & (lengths < kmer)):
            at = starts[d]
            whole[at] = True
            x = _MIX
            for c in codes[at : at + lengths[d]]:
                x = _mix((x ^ c) * _MIX)
            h[at] = x
        at = np.flatnonzero(whole)
        h, owner = h[at], owner[at]
        if not len(h):
            return h, owner
        order = np.argsort(h, kind="stable")
        s, o = h[order], owner[order]
        first = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])
        nth = np.empty(len(h), np.uint64)
        nth[order] = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        return _mix(h + nth * np.uint64(0xD1B54A32D192ED03)), owner


def sketches(h: np.ndarray, owner: np.ndarray, texts: int, ordered: int = ORDERED, n: int = 20) -> np.ndarray:
    """(texts x n) sketch keys: of each order, the ``ordered`` smallest k-mers of a text, combined in text order.

    An order is a multiplication of the hashes. A threshold that leaves each text some 8 times as many k-mers
    as needed saves sorting them all; a text for which it leaves too few is sorted whole.
    """
    out = np.zeros((texts, n), np.uint64)
    with np.errstate(over="ignore"):
        factors = _mix(np.arange(1, n + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
        have = np.bincount(owner, minlength=texts)
        need = np.minimum(have, ordered)
        starts = np.cumsum(have) - have
        limit = np.where(have > 8 * ordered, 2.0**64 * 8 * ordered / np.maximum(have, 1), 2.0**64 - 2048).astype(np.uint64)[owner]
        for j in range(n):
            x = h * factors[j]
            at = np.flatnonzero(x <= limit)
            few = np.flatnonzero(np.bincount(owner[at], minlength=texts) < need)
            if len(few):
                at = np.unique(np.concatenate([at, *(np.arange(starts[d], starts[d] + have[d]) for d in few)]))
            at = at[np.lexsort((x[at], owner[at]))]
            got = np.bincount(owner[at], minlength=texts)
            rank = np.arange(len(at)) - np.repeat(np.cumsum(got) - got, got)
            at = np.sort(at[rank < ordered])
            first = np.cumsum(need) - need
            key = need.astype(np.uint64)
            for i in range(ordered):
                d = np.flatnonzero(need > i)
                key[d] = _mix((key[d] ^ h[at[first[d] + i]]) * _MIX)
            out[:, j] = key
    return out


def sequence_keys(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(texts x 2) numbers, 128 bits that depend on all words and their places."""
    out = np.zeros((len(lengths), 2), np.uint64)
    starts = np.cumsum(lengths) - lengths
    full = np.flatnonzero(lengths)
    with np.errstate(over="ignore"):
        at = (np.arange(len(codes)) - np.repeat(starts, lengths)).astype(np.uint64) + np.uint64(1)
        for j in range(2):
            x = _mix(codes ^ _mix(at * _MIX + np.uint64(j)))
            if len(full):
                out[full, j] = np.add.reduceat(x, starts[full])
        out[:, 0] += lengths.astype(np.uint64)
    return out


def bags(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(texts x BAG) counts of words by hash, 255 standing for more. An edit moves at most one count up and one down, so the
    larger of the sums of both differences is no more than the edit distance."""
    out = np.zeros((len(lengths), BAG), np.uint8)
    at = np.repeat(np.arange(len(lengths)), lengths) * BAG + (_mix(codes) % np.uint64(BAG)).astype(np.int64)
    cell, n = np.unique(at, return_counts=True)
    out.ravel()[cell] = np.minimum(n, 255)
    return out


# --- alignment -------------------------------------------------------------------


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two code sequences if at most ``limit``, else ``limit`` + 1.

    For each distance the farthest cell on every diagonal of the band is kept; the band widens by one
    diagonal on each side with the distance and narrows again where the end is out of reach.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n, m = len(a), len(b)
    if not n or not m or abs(n - m) > limit:
        return min(max(n, m), limit + 1)
    end = m - n
    steps = np.arange(16)
    # Cell (x, x + k) on diagonal k; reach[k + limit + 1] is the largest x. The codes past the ends equal nothing.
    reach = np.full(2 * limit + 3, -(1 << 40))
    reach[limit + 1] = 0
    for e in range(1, limit + 1):
        lo, hi = max(-e, -n, end - (limit - e)), min(e, m, end + (limit - e))
        k = np.arange(lo, hi + 1)
        i = k + limit + 1
        x = np.maximum(np.maximum(reach[i], reach[i + 1]) + 1, reach[i - 1])
        top = np.minimum(n, m - k)
        x = np.minimum(x, top)
        live = np.flatnonzero((x >= 0) & (x + k >= 0) & (x < top))
        live = live[a[x[live]] == b[x[live] + k[live]]]
        while len(live):
            at = x[live, None] + steps
            ok = (at < top[live, None]) & (a[np.minimum(at, n - 1)] == b[np.clip(at + k[live, None], 0, m - 1)])
            run = np.where(ok.all(1), len(steps), ok.argmin(1))
            x[live] += run
            live = live[run == len(steps)]
        reach[:] = -(1 << 40)
        reach[i] = x
        if lo <= end <= hi and x[end - lo] >= n:
            return e
    return limit + 1


#: Words of the runs that are compared before an alignment; the longer ones tell texts of few different words apart.
GRAMS = (1, 3, 4)


class Text:
    """A code sequence with its runs of 1, 3 and 4 words as sorted multisets. A member's number among its equals makes them sets."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self._runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def runs(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        if gram not in self._runs:
            with np.errstate(over="ignore"):
                grams = self.codes[: max(0, len(self.codes) - gram + 1)].astype(np.uint64)
                for i in range(1, gram):
                    grams = _mix((grams ^ self.codes[i : i + len(grams)]) * _MIX)
            self._runs[gram] = self._multiset(grams)
        return self._runs[gram]

    @staticmethod
    def _multiset(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.sort(x)
        return x, np.arange(len(x)) - np.searchsorted(x, x)


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two multisets."""
    (x, nth), (y, _) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(x):
        return 0
    rank = np.searchsorted(y, x) + nth
    return int(((rank < len(y)) & (y[np.minimum(rank, len(y) - 1)] == x)).sum())


def _overlap_bound(a: Text, b: Text, limit: int | None = None) -> int:
    """The distance is at least this: an edit changes at most q runs of q words, so it takes a q-th of the longer text's runs that find no partner.
    Beyond ``limit`` no longer runs are looked at."""
    longest, least = max(len(a.codes), len(b.codes)), 0
    for q in GRAMS:
        missing = max(0, longest - q + 1) - _common(a.runs(q), b.runs(q))
        least = max(least, -(-missing // q))
        if limit is not None and least > limit:
            break
    return least


def similarity(a: np.ndarray | Text, b: np.ndarray | Text, least: float = SIMILARITY) -> float:
    """Edit similarity of two code sequences if at least ``least``, else 0."""
    a, b = (x if isinstance(x, Text) else Text(x) for x in (a, b))
    longest = max(len(a.codes), len(b.codes))
    if not longest:
        return 1.0
    limit = int((1 - least) * longest + 1e-9)
    if abs(len(a.codes) - len(b.codes)) > limit or _overlap_bound(a, b, limit) > limit:
        return 0.0
    d = edit_distance(a.codes, b.codes, limit)
    return 1 - d / longest if d <= limit else 0.0


# --- Spark -----------------------------------------------------------------------


def sketched(docs: DataFrame, families: tuple[tuple, ...] = FAMILIES) -> DataFrame:
    """The rows of ``docs`` (as struct ``_row``) with ``_uid``, 128 bits ``_key`` of the word sequence, ``_len`` words, sketches ``_sk`` (0 for those of other families), counts ``_bag``.

    Stored, so that ``_uid`` is the same for all steps and a lost executor repeats no step before it.
    """
    total = sum(f[2] for f in families)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, lengths = word_codes(batch.column(1))
        parts = []
        for kmer, ordered, n, least, most in families:
            mine = (lengths >= least) & (lengths <= (most or lengths.max(initial=0)))
            part = np.zeros((len(lengths), n), np.uint64)
            if mine.any():
                h, owner = kmers(codes[np.repeat(mine, lengths)], lengths[mine], kmer)
                part[mine] = np.maximum(sketches(h, owner, int(mine.sum()), ordered, n), 1)
            parts.append(part)
        sk = np.concatenate(parts, 1).view(np.int64)
        keys = sequence_keys(codes, lengths)
        counts = bags(codes, lengths)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(lengths, pa.int32()),
             pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * total), pa.array(sk.ravel(), pa.int64())),
             pa.array([c.tobytes() for c in counts], pa.binary())],
            ["_row", "_key", "_len", "_sk", "_bag"])

    rows = docs.select(whole_row(docs).alias("_row"), "text")
    more = StructType.fromDDL("_key binary, _len int, _sk array<long>, _bag binary")
    out = map_texts(rows, run, StructType([rows.schema["_row"], *more.fields]), limit=SLICE)
    return materialised(out.withColumn("_uid", F.monotonically_increasing_id()))


def bag_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The edit distance of each pair of bags (rows of counts) is at least this."""
    diff = a.astype(np.int16) - b
    return np.maximum(np.maximum(diff, 0).sum(-1), np.maximum(-diff, 0).sum(-1))


def most_edits(a, b, least: float):
    """Edits that two texts of so many words may have at that similarity."""
    return ((1 - least) * np.maximum(a, b) + 1e-9).astype(np.int64)


def like_lengths(a: Column, b: Column, least: float) -> Column:
    """Do the numbers of words of two texts allow the similarity?"""
    return F.abs(a - b) <= F.floor((1 - least) * F.greatest(a, b) + 1e-9)


def length_class(words: Column, least: float) -> Column:
    """Similar texts lie in the same or in neighbouring classes."""
    return F.floor(F.log(words) / (1.001 * math.log(1 / least) + 1e-3)).cast("int")


def possible(rows: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those of the pairs ``a, b`` whose lengths and word counts allow the similarity, stored."""
    def side(name: str) -> DataFrame:
        return rows.select(F.col("_uid").alias(name), F.col("_len").alias(f"_len_{name}"), F.col("_bag").alias(f"_bag_{name}"))

    near = like_lengths(F.col("_len_a"), F.col("_len_b"), least)
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(near)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BAG) for i in (4, 5))
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(bag_bound(x, y) <= most_edits(n, m, least)))

    return materialised(both.select("a", "b", "_len_a", "_len_b", "_bag_a", "_bag_b").mapInArrow(run, "a long, b long"))


def verified(rows: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those of the pairs ``a, b`` (of ``_uid``) whose texts align, as stored ``a, b, similarity``.

    The joins say how, so that a small table takes the plan that a large one needs.
    """
    ids = pairs.select(F.col("a").alias("_uid")).unionByName(pairs.select(F.col("b").alias("_uid"))).distinct()
    texts = materialised(rows.select("_uid", F.col("_row.text").alias("text")).join(ids.hint("merge"), "_uid", "left_semi"))
    both = (
        pairs.join(texts.select(F.col("_uid").alias("a"), F.col("text").alias("text")).hint("merge"), "a")
        .join(texts.select(F.col("_uid").alias("b"), F.col("text").alias("other")).hint("merge"), "b").select("a", "b", "text", "other"))

    def align(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for column in (batch.column(2), batch.column(3)):
            codes, lengths = word_codes(column)
            parts.append(np.split(codes, np.cumsum(lengths)[:-1]))
        s = [similarity(x, y, least) for x, y in zip(*parts)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return materialised(map_texts(both, align, "a long, b long, similarity double").where("similarity > 0"))


def components(links: DataFrame) -> DataFrame:
    """``_node, _root`` for every node of the links ``a, b``: its component's smallest node.

    Large and small stars in turn (each node, or each of its smaller neighbours, is tied to the smallest
    neighbour) until nothing changes; the number of rounds is logarithmic, and every round is stored.
    """
    # Rounds never have more rows than twice the links; so few files as that needs make them cheap.
    tasks = max(MIN_TASKS, 2 * links.count() // LINKS_PER_TASK)
    stored = lambda df: materialised(df.coalesce(tasks))
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("_node"), F.col("v").alias("_root"))


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, members["_uid"] == roots["_node"], "left").withColumn("_root", F.coalesce("_root", "_uid")).drop("_node")


def _in_mixed(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the buckets that hold more than one group."""
    spread = members.groupBy(*keys).agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).where("_lo != _hi").select(*keys)
    return materialised(members.join(materialised(spread), keys, "left_semi"))


def _joined_roots(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` after new links: the groups that they tie together get one root."""
    def root_of(df: DataFrame, column: str) -> DataFrame:
        r = roots.select(F.col("_node").alias(column), F.col("_root").alias(f"_{column}"))
        return df.join(r, column, "left").withColumn(f"_{column}", F.coalesce(f"_{column}", column))

    ends = root_of(root_of(found.select("a", "b"), "a"), "b")
    ties = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("_node").alias("_old"), F.col("_root").alias("_new"))
    moved = roots.join(ties, roots["_root"] == ties["_old"], "left").select("_node", F.coalesce("_new", "_root").alias("_root"))
    # Nodes that were roots, or had no link, and are tied to another now.
    return materialised(moved.unionByName(ties.select(F.col("_old").alias("_node"), F.col("_new").alias("_root"))).distinct())


class _Groups:
    """Union-find over the groups of one task."""

    def __init__(self, root: np.ndarray):
        _, self.of = np.unique(root, return_inverse=True)

    def tie(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def _open_pairs(i: int, other: np.ndarray, band: int, c: dict[str, np.ndarray], groups: _Groups, least: float) -> np.ndarray:
    """Those of ``other`` that class i may be similar to, in another group, with this bucket as the first that both share."""
    longest = np.maximum(c["_len"][other], c["_len"][i])
    near = np.abs(c["_len"][other] - c["_len"][i]) <= ((1 - least) * longest + 1e-9).astype(np.int64)
    # Those of the length class below meet each other there.
    other = other[near & (groups.of[other] != groups.of[i]) & (c["_native"][other] | c["_native"][i])]
    other = other[((c["_sk"][other] == c["_sk"][i]) & (c["_sk"][i] != 0)).argmax(1) == band] if len(other) else other
    return other[bag_bound(c["_bag"][other], c["_bag"][i]) <= most_edits(c["_len"][other], c["_len"][i], least)] if len(other) else other


def _columns(pdf) -> dict[str, np.ndarray]:
    c = {n: pdf[n].to_numpy() for n in ("_uid", "_root", "_len", "_native", "_i")}
    c["_sk"] = np.stack(pdf["_sk"].to_numpy())
    c["_bag"] = np.frombuffer(b"".join(pdf["_bag"]), np.uint8).reshape(len(pdf), BAG)
    return c


def _cell_links(dealt: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """``a, b``: links between groups, found in the cells of ``dealt``; no more for a cell than it has classes.

    A cell is a block of a bucket, or two of them. Classes that lengths and word counts leave a partner in their cell are
    sifted out first; only their texts are read and aligned. A link ties two groups, and pairs within a group are passed over, so what is
    found spans the groups.
    """
    cell = ["_band", "_bucket", "_size", "_x", "_y"]
    kept = [*cell, "_uid", "_root", "_len", "_native", "_i", "_sk", "_bag"]

    def places(c: dict[str, np.ndarray], x: int, y: int):
        at = np.arange(len(c["_uid"]))
        for i in at[c["_i"] == y].tolist():
            yield i, at[:i][c["_i"][:i] == x] if x == y else at[c["_i"] == x]

    def sifted(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        """Rows of the table, which holds whole cells between ``cuts``, that have a partner in their cell."""
        c = {n: table[n].to_numpy() for n in ("_uid", "_root", "_len", "_native", "_i", "_band", "_x", "_y")}
        c["_sk"] = np.concatenate([np.asarray(x.flatten()) for x in table["_sk"].chunks]).reshape(len(table), -1)
        c["_bag"] = np.frombuffer(b"".join(table["_bag"].to_pylist()), np.uint8).reshape(len(table), BAG)
        hit = np.zeros(len(table), bool)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            own = {n: v[a:b] for n, v in c.items()}
            groups = _Groups(own["_root"])
            for i, other in places(own, own["_x"][0], own["_y"][0]):
                found = _open_pairs(i, other, own["_band"][0], own, groups, least)
                if len(found):
                    hit[a + found] = True
                    hit[a + i] = True
        return table.filter(pa.array(hit))

    def sift(batches):
        # Most cells have two or three classes: many are taken at once, and the last of a batch waits for the next one.
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not len(table):
                continue
            change = np.zeros(len(table) - 1, bool)
            for n in cell:
                v = table[n].to_numpy()
                change |= v[1:] != v[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
            if len(cuts) > 1:
                yield from sifted(table.slice(0, cuts[-1]), cuts).to_batches()
            rest = table.slice(cuts[-1])
        if rest is not None and len(rest):
            yield from sifted(rest, np.array([0, len(rest)])).to_batches()

    def align(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("_uid")
        c = _columns(pdf)
        codes, lengths = word_codes(pa.array(pdf["text"], pa.string()))
        texts = [Text(x) for x in np.split(codes, np.cumsum(lengths)[:-1])]
        groups, found = _Groups(c["_root"]), []
        for i, other in places(c, key[3], key[4]):
            other = _open_pairs(i, other, key[0], c, groups, least)
            while len(other):
                j, other = other[0], other[1:]
                if similarity(texts[i], texts[j], least):
                    found.append((max(c["_uid"][i], c["_uid"][j]), min(c["_uid"][i], c["_uid"][j])))
                    groups.tie(i, j)
                    other = other[groups.of[other] != groups.of[i]]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    told = rows.select("_uid", "_sk", "_bag").join(dealt.select("_uid").distinct().hint("merge"), "_uid", "left_semi")
    full = dealt.join(told.hint("merge"), "_uid").select(*kept)
    ship_package(rows.sparkSession)
    some = materialised(full.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(sift, full.schema))
    texts = rows.select("_uid", F.col("_row.text").alias("text")).join(some.select("_uid").distinct().hint("merge"), "_uid", "left_semi")
    # Tasks by the work there is; by their bytes, few would do.
    tasks = max(MIN_TASKS, some.count() // CELL_ROWS)
    return materialised(some.join(texts.hint("merge"), "_uid").repartition(tasks, *cell).groupBy(*cell).applyInPandas(align, "a long, b long"))


def rest_links(rows: DataFrame, shared: DataFrame, links: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(links, roots) after the buckets in which one comparison for each class did not settle all.

    ``shared`` has ``_band, _bucket, _uid, _len`` of buckets with two or more classes. A bucket may hold several groups,
    as when a passage that unlike texts share supplies all k-mers of a sketch. Of these every two classes of different
    groups are compared. A bucket's classes of like length are dealt into blocks of bounded size: first each block is settled
    by itself, then, where a bucket still holds more than one group, every two blocks meet. So no pair of different groups is left.
    """
    roots = components(links)
    # A class is in the bucket of its own and of the next class of length. Most meet no other group there and are done.
    own = length_class(F.col("_len"), least)
    keys = ["_band", "_bucket", "_size"]
    near = _in_mixed(_with_roots(shared, roots), ["_band", "_bucket"]).withColumn("_own", own)
    near = near.withColumn("_size", F.explode(F.array("_own", F.col("_own") + 1))).withColumn("_native", F.col("_own") == F.col("_size")).drop("_own")
    at = _in_mixed(near, keys)
    # A word and its code take some 16 bytes. A class keeps its block through both steps.
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("_len") * 16 / BLOCK_BYTES)).cast("int")
    counts = materialised(at.groupBy(*keys).agg(blocks.alias("_blocks")))
    at = at.join(counts.hint("merge"), keys).withColumn("_i", F.pmod(F.xxhash64("_uid"), F.col("_blocks")).cast("int"))
    for alone in (True, False):
        if at.isEmpty():
            break
        if alone:
            dealt = at.withColumns({"_x": F.col("_i"), "_y": F.col("_i")})
        else:
            dealt = at.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).where("_i != _j")
            dealt = dealt.withColumns({"_x": F.least("_i", "_j"), "_y": F.greatest("_i", "_j")}).drop("_j")
        # Cells of one group have nothing to compare.
        found = _cell_links(_in_mixed(dealt.drop("_blocks"), [*keys, "_x", "_y"]), rows, least)
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = _joined_roots(roots, found)
        # What was one block is settled.
        at = _in_mixed(_with_roots(at.where("_blocks > 1").drop("_root"), roots), keys)
    return links, roots


def near_duplicate_rows(docs: DataFrame, least: float = SIMILARITY, families: tuple[tuple, ...] = FAMILIES) -> DataFrame:
    """``_row`` (the columns of ``docs``), ``class_id``, ``group_id``, ``class_size``, ``group_size``, ``n_links``, ``kept``.

    class_id and group_id are the smallest doc_id of the equal word sequences, and of the group. Of each group the row
    with the smallest doc_id stays (null is the largest; of rows that repeat it, one stays). n_links counts the
    verified links of the class that were needed to tie its group together; pairs within a group are not all compared. Texts without words, null or empty, form one class.
    """
    rows = sketched(docs, families)
    names = materialised(rows.groupBy("_key").agg(F.min("_uid").alias("_class")))
    reps = rows.select("_uid", "_len", "_sk").where("_len > 0").join(names.select(F.col("_class").alias("_uid")).hint("merge"), "_uid", "left_semi")
    spots = materialised(reps.select("_uid", "_len", F.posexplode("_sk").alias("_band", "_bucket")).where("_bucket != 0"))
    size = length_class(F.col("_len"), least)
    buckets = spots.groupBy("_band", "_bucket").agg(
        F.min("_uid").alias("_first"), F.min_by("_len", "_uid").alias("_first_len"), F.count("*").alias("_n"), F.min(size).alias("_lo"), F.max(size).alias("_hi"))
    # Two texts of unlike lengths that share a sketch, as texts of one language do by chance, are no candidates.
    buckets = materialised(buckets.where("_n > 2 OR (_n = 2 AND _hi - _lo < 2)").drop("_lo", "_hi"))
    shared = materialised(spots.join(buckets.hint("merge"), ["_band", "_bucket"]).select("_band", "_bucket", "_uid", "_len", "_first", "_first_len"))
    pairs = shared.where(F.col("_uid") != F.col("_first")).where(like_lengths(F.col("_len"), F.col("_first_len"), least))
    pairs = materialised(pairs.select(F.col("_uid").alias("a"), F.col("_first").alias("b")).distinct())
    links = verified(rows, possible(rows, pairs, least), least).select("a", "b")
    links, roots = rest_links(rows, shared.select("_band", "_bucket", "_uid", "_len"), links, least)
    ends = links.select(F.col("a").alias("_class")).unionAll(links.select(F.col("b").alias("_class")))
    degree = ends.groupBy("_class").agg(F.count("*").alias("n_links"))

    doc_id = F.col("_row.doc_id")
    order = F.struct(doc_id.isNull().alias("_null"), doc_id.alias("doc_id"), F.col("_uid").alias("_uid"))
    per = rows.groupBy("_key").agg(F.min("_uid").alias("_class"), F.min(order).alias("_first"), F.count("*").alias("class_size"))
    per = per.join(roots, F.col("_class") == F.col("_node"), "left").withColumn("_root", F.coalesce("_root", "_class")).drop("_node")
    per = materialised(per.join(degree, "_class", "left"))
    groups = materialised(per.groupBy("_root").agg(F.min("_first").alias("_keep"), F.sum("class_size").alias("group_size")))
    known = materialised(per.join(groups, "_root").select(
        "_key", F.col("_first.doc_id").alias("class_id"), F.col("_keep.doc_id").alias("group_id"), "class_size", "group_size",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("_keep._uid").alias("_kept")))
    return rows.select("_row", "_uid", "_key").join(known, "_key").select(
        "_row", "class_id", "group_id", "class_size", "group_size", "n_links", (F.col("_uid") == F.col("_kept")).alias("kept"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id and the columns of ``near_duplicate_rows`` after ``_row``, one row per row of ``docs``."""
    out = near_duplicate_rows(docs.select("doc_id", "text"), least)
    return out.select(F.col("_row.doc_id").alias("doc_id"), *out.columns[1:])
