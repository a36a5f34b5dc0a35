"""Prefix trie of conversations: a z-fast trie whose tables are DataFrames.

A conversation is the sequence of its turns and is held as the chain of its prefix hashes, so a prefix is named by one 128-bit
hash. The trie is compacted: a node stands where conversations end or part, and holds the edge from its parent. It is
filed under its handle, the prefix whose depth is the two-fattest number of its edge (the one with most trailing zero bits).
A conversation finds where it leaves the trie by fat binary search: it asks for the handle at the two-fattest depth of the
interval left, goes on behind the node's end if there is one, before it if there is none; so the number of lookups, each a
join, is logarithmic in its turns.

Conversations are inserted in batches: of those that leave the trie at one place by one next turn, one at random is added,
cutting edges where needed, and the others search on from there. A batch holds at least one path of every subtrie
that is missing, and paths are drawn in proportion to the conversations below, so that few batches suffice also for deep tries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runledger.llm.frames import ship_package, word_count
from runledger.session import materialised

WIDTH = 16
#: Member ids that are joined to one text before they are hashed in order.
IDS = 4096
ROOT = b""
HEADS = 3
FAMILY = 20


# --- conversations ---------------------------------------------------------------


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, items: the turns of each conversation as (digest of role and text, words of the text), in order.

    Turns are ordered by ``turn``, null first; of equal ones by role and then by digest. A null role or text counts as empty.
    Rows of a null conv_id belong to no conversation and are left out. Rows that repeat are turns of their own.
    A row holds the digests of one whole conversation, some 30 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("t"), role.alias("r"), digest.alias("d"), word_count(text).alias("w")).alias("_turn"))
    items = F.transform(F.sort_array(F.collect_list("_turn")), lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w")))
    return turns.groupBy("conv_id").agg(items.alias("items"))


def with_family_heads(seqs: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % family and goes on after its own first h turns.

    h is crc32(c) modulo ``heads`` + 1. Where that conversation is shorter or absent, so many fewer turns come from it.
    """
    seqs = materialised(seqs)
    base = seqs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.slice("items", 1, heads).alias("_head"))
    own = seqs.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % family, "_h": (F.crc32(F.col("conv_id").cast("string")) % (heads + 1)).cast("int")})
    none = F.array().cast(base.schema["_head"].dataType)
    head = F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h"))
    rest = F.slice("items", F.col("_h") + 1, F.greatest(F.size("items") - F.col("_h"), F.lit(0)))
    return own.join(base, "_base", "left").select("conv_id", F.concat(head, rest).alias("items"))


def chained(seqs: DataFrame) -> DataFrame:
    """conv_id, n turns, ``chain`` (the hashes of all prefixes, 16 bytes each), ``cum`` (words of the first 0, 1 ... n turns), ``key`` (the last hash)."""
    ship_package(seqs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, chains, cums, keys = [], [], [], []
            for items in batch.column(1):
                values = items.values
                digests, words = values.field("d").to_pylist(), values.field("w").to_numpy(zero_copy_only=False)
                h, out = ROOT, []
                for d in digests:
                    h = hashlib.blake2b(h + d, digest_size=WIDTH).digest()
                    out.append(h)
                n.append(len(out))
                chains.append(b"".join(out))
                cums.append(np.concatenate([[0], np.cumsum(words)]))
                keys.append(h)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(chains, pa.binary()), pa.array(cums, pa.list_(pa.int64())), pa.array(keys, pa.binary())],
                ["conv_id", "n", "chain", "cum", "key"])

    return seqs.select("conv_id", "items").mapInArrow(run, "conv_id long, n int, chain binary, cum array<long>, key binary")


# --- trie ------------------------------------------------------------------------


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b], a < b, that the largest power of two divides: b without the bits below the highest in which they differ."""
    k = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b, k), k)


def hash_at(chain: Column, depth: Column) -> Column:
    """The hash of the prefix of that depth (from 1) in a chain that starts with depth 1."""
    return F.substring(chain, (depth - 1) * WIDTH + 1, F.lit(WIDTH))


def _filed(edges: DataFrame) -> DataFrame:
    """Nodes from ``p, e, pname, hashes, cum``: the edge from depth p to e, with its name, first hash and handle."""
    p, e = F.col("p"), F.col("e")
    return edges.select(
        "p", "e", "pname", "hashes", "cum", hash_at(F.col("hashes"), e - p).alias("name"), hash_at(F.col("hashes"), F.lit(1)).alias("first"),
        hash_at(F.col("hashes"), two_fattest(p, e) - p).alias("handle"))


def located(strings: DataFrame, nodes: DataFrame, turns: int) -> DataFrame:
    """``strings`` (``n``, ``chain``, ``lo``: a depth at which the trie has a node for them) with the place where each leaves the trie.

    ``lo``: depth of the deepest node on its path; ``at``: depth up to which it agrees with the trie, inside the edge ``xname``
    from there if it is more than ``lo``. ``turns``: no string is longer than that behind its ``lo``.
    """
    book = nodes.select(F.col("handle").alias("_handle"), F.col("p").alias("_p"), F.col("e").alias("_e"), F.col("name").alias("_name"))
    out = strings.withColumn("_hi", F.col("n"))
    for _ in range(max(turns, 1).bit_length()):
        ask = F.when(F.col("lo") < F.col("_hi"), two_fattest(F.col("lo"), F.col("_hi")))
        out = out.withColumn("_f", ask).withColumn("_ask", F.when(F.col("_f").isNotNull(), hash_at(F.col("chain"), F.col("_f"))))
        out = out.join(book, out["_ask"] == book["_handle"], "left")
        through = (F.col("_e") <= F.col("n")) & (hash_at(F.col("chain"), F.col("_e")) == F.col("_name"))
        # Through the node: on behind it. Apart inside its edge: the search is over. No such handle: before it.
        lo = F.when(F.col("_handle").isNull(), F.col("lo")).when(through, F.col("_e")).otherwise(F.col("_p"))
        hi = F.when(F.col("_f").isNull(), F.col("_hi")).when(F.col("_handle").isNull(), F.col("_f") - 1).when(through, F.col("_hi")).otherwise(F.col("_p"))
        out = out.select(*strings.drop("lo").columns, lo.alias("lo"), hi.alias("_hi"))
    child = nodes.select(F.col("first").alias("_first"), F.col("name").alias("xname"), F.col("p").alias("xp"), F.col("e").alias("xe"), F.col("hashes").alias("_hashes"))
    out = out.withColumn("_next", F.when(F.col("lo") < F.col("n"), hash_at(F.col("chain"), F.col("lo") + 1)))
    out = out.join(child, out["_next"] == child["_first"], "left")
    # Hashes of prefixes agree up to the place where the turns part, and never after it.
    most = F.least(F.col("n"), F.col("xe")) - F.col("lo")
    agree = F.size(F.filter(F.sequence(F.lit(1), most), lambda i: hash_at(F.col("_hashes"), i) == hash_at(F.col("chain"), F.col("lo") + i)))
    return out.withColumn("at", F.col("lo") + F.when(F.col("xname").isNull(), 0).otherwise(agree)).drop("_hi", "_next", "_first", "_hashes")


def _batch(found: DataFrame) -> DataFrame:
    """``found`` with ``_new``: is it of this batch? One of those that leave the trie at one place by one next turn."""
    leave = F.when(F.col("at") < F.col("n"), hash_at(F.col("chain"), F.col("at") + 1)).otherwise(F.lit(b"end"))
    found = found.withColumn("_leave", leave).withColumn("_place", F.when(F.col("at") > 0, hash_at(F.col("chain"), F.col("at"))).otherwise(F.lit(ROOT)))
    # xxhash64 of a number is one to one.
    found = found.withColumn("_draw", F.xxhash64("conv_id"))
    chosen = found.groupBy("_place", "_leave").agg(F.min("_draw").alias("_drawn")).select("_drawn")
    return found.join(chosen, F.col("_draw") == F.col("_drawn"), "left").withColumn("_new", F.col("_drawn").isNotNull()).drop("_drawn", "_draw", "_leave")


def inserted(nodes: DataFrame, batch: DataFrame, cums: DataFrame) -> DataFrame:
    """The nodes of the trie after the conversations of ``batch`` (of ``located``); ``cums`` has the words of every conversation."""
    inside = F.col("xname").isNotNull() & (F.col("at") > F.col("xp")) & (F.col("at") < F.col("xe"))
    # No more cuts of an edge than it has turns.
    cuts = batch.where(inside).groupBy("xname").agg(F.sort_array(F.collect_set("at")).alias("_cuts"))
    both = nodes.join(cuts, nodes["name"] == cuts["xname"], "left")
    ends = F.concat(F.array("p"), F.coalesce("_cuts", F.array().cast("array<int>")), F.array("e"))
    pieces = both.withColumn("_ends", ends).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_ends") - 1)))
    pieces = pieces.withColumns({"_a": F.element_at("_ends", F.col("_i")), "_b": F.element_at("_ends", F.col("_i") + 1)}).select(
        F.col("_a").alias("p"), F.col("_b").alias("e"),
        F.when(F.col("_i") == 1, F.col("pname")).otherwise(hash_at(F.col("hashes"), F.col("_a") - F.col("p"))).alias("pname"),
        F.substring("hashes", (F.col("_a") - F.col("p")) * WIDTH + 1, (F.col("_b") - F.col("_a")) * WIDTH).alias("hashes"),
        F.slice("cum", F.col("_a") - F.col("p") + 1, F.col("_b") - F.col("_a") + 1).alias("cum"))
    longer = batch.where(F.col("at") < F.col("n")).join(cums, "conv_id")
    leaves = longer.select(
        F.col("at").alias("p"), F.col("n").alias("e"), F.col("_place").alias("pname"), F.substring("chain", F.col("at") * WIDTH + 1, (F.col("n") - F.col("at")) * WIDTH).alias("hashes"),
        F.slice("cum", F.col("at") + 1, F.col("n") - F.col("at") + 1).alias("cum"))
    return materialised(_filed(pieces.unionByName(leaves)))


def build(strings: DataFrame) -> DataFrame:
    """The nodes of the compacted trie of distinct sequences (``conv_id, n, chain, cum``, stored), without the root."""
    spark = strings.sparkSession
    cums = strings.select("conv_id", "cum")
    state = strings.where("n > 0").select("conv_id", "n", "chain", F.lit(0).alias("lo"))
    nodes = spark.createDataFrame([], StructType.fromDDL("p int, e int, pname binary, hashes binary, cum array<long>, name binary, first binary, handle binary"))
    while True:
        turns = state.agg(F.max(F.col("n") - F.col("lo"))).first()[0]
        if not turns:
            return nodes
        found = materialised(_batch(located(state, nodes, turns)))
        nodes = inserted(nodes, found.where("_new"), cums)
        # The rest have a node where they left the trie; one that ended there is done.
        state = found.where("NOT _new AND at < n").select("conv_id", "n", "chain", F.col("at").alias("lo"))


# --- numbers of the nodes --------------------------------------------------------


def subtree(nodes: DataFrame, parts: dict[str, str]) -> DataFrame:
    """``name`` and, for every ``parts`` (column: sum or min), its value over the node and all below it.

    ``nodes`` has ``name``, ``pname`` (null for the root) and the columns. Distances double: after k rounds a node has what lies less
    than 2^k below, and knows its ancestor 2^k above; so rounds are logarithmic in the depth and no node meets all its ancestors.
    """
    state = materialised(nodes.select("name", F.col("pname").alias("_up"), *parts))
    while not state.where("_up IS NOT NULL").isEmpty():
        from_below = state.where("_up IS NOT NULL").groupBy("_up").agg(*[getattr(F, how)(c).alias(f"_{c}") for c, how in parts.items()]).withColumnRenamed("_up", "_to")
        above = state.where("_up IS NOT NULL").select(F.col("name").alias("_mid"), F.col("_up").alias("_top"))
        both = state.join(from_below, state["name"] == from_below["_to"], "left").join(above, state["_up"] == above["_mid"], "left")
        total = {c: F.coalesce(F.col(c) + F.col(f"_{c}"), F.col(c), F.col(f"_{c}")) if how == "sum" else F.least(c, f"_{c}") for c, how in parts.items()}
        state = materialised(both.select("name", F.col("_top").alias("_up"), *[v.alias(c) for c, v in total.items()]))
    return state.drop("_up")


def id_digests(members: DataFrame) -> DataFrame:
    """key, ends_sha256: of each key, SHA-256 of its conv_ids in decimal, ascending, joined by commas.

    Ids are sorted over range partitions, a key of very many ids in several of them, and joined to texts of some thousand ids; then
    the texts of a key, in order, run through one hash. Both steps hold one batch at a time.
    """
    ship_package(members.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, start = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start] or i - start == IDS:
                    out.append((keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))] if out else [pa.array([], t) for t in (pa.binary(), pa.int64(), pa.string())], ["key", "first_id", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is not None and k == key:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    order = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = order.mapInArrow(texts, "key binary, first_id long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first_id").mapInArrow(digests, "key binary, ends_sha256 string")


def prefix_nodes(seqs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences (``conv_id, items``), the empty one included:

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Members of a node are the
    conversations that start with it, also empty ones for the root; n_leaves counts nodes without children in its subtree, itself included;
    saved_tokens sums, over its subtree, members less one times the words of the node's last text; ends_sha256 is of the
    members that end there. No conversations give no rows. Sequences are told apart by 128 bits.
    """
    chains = materialised(chained(seqs))
    same = materialised(chains.groupBy("key").agg(F.count("*").alias("own"), F.min("conv_id").alias("lowest")))
    strings = materialised(chains.join(same.select(F.col("lowest").alias("conv_id")), "conv_id", "left_semi").select("conv_id", "n", "chain", "cum"))
    edges = build(strings)
    root = same.agg(F.count("*").alias("_n")).where("_n > 0").select(
        F.lit(0).alias("p"), F.lit(0).alias("e"), F.lit(None).cast("binary").alias("pname"), F.lit(ROOT).alias("name"), F.array(F.lit(0).cast("long")).alias("cum"))
    nodes = edges.select("p", "e", "pname", "name", "cum").unionByName(root)
    children = nodes.where("pname IS NOT NULL").groupBy("pname").agg(F.count("*").alias("children")).withColumnRenamed("pname", "_of")
    nodes = nodes.join(children, nodes["name"] == children["_of"], "left").drop("_of").join(same, nodes["name"] == same["key"], "left").drop("key")
    nodes = materialised(nodes.withColumns({
        "children": F.coalesce("children", F.lit(0)), "n_convs": F.coalesce("own", F.lit(0)), "words": F.element_at("cum", -1) - F.element_at("cum", 1),
        "n_leaves": F.when(F.col("children").isNull(), 1).otherwise(0).cast("long")}))
    counts = subtree(nodes, {"n_convs": "sum", "lowest": "min", "n_leaves": "sum"})
    nodes = materialised(nodes.drop("n_convs", "lowest", "n_leaves").join(counts, "name").withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    total = subtree(nodes, {"saved": "sum"}).withColumnRenamed("saved", "total")
    above = nodes.select(F.col("name").alias("_above"), F.col("lowest").alias("_above_id"))
    nodes = nodes.join(total, "name").join(above, nodes["pname"] == above["_above"], "left")
    nodes = nodes.join(id_digests(chains), nodes["name"] == F.col("key"), "left")
    # Every depth of an edge has the members of its lower end.
    depth, last = F.col("_d"), F.col("_d") == F.col("e")
    below = F.col("total") - F.col("saved")
    rest = F.element_at("cum", -1) - F.element_at("cum", F.greatest(depth - F.col("p"), F.lit(1)))
    nodes = nodes.withColumn("_d", F.explode(F.sequence(F.least(F.col("p") + 1, F.col("e")), F.col("e"))))
    return nodes.select(
        F.col("lowest").alias("conv_id"), depth.cast("long").alias("depth"), F.when(depth == F.col("p") + 1, F.col("_above_id")).when(depth > 0, F.col("lowest")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (below + (F.col("n_convs") - 1) * rest).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))).otherwise(F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
