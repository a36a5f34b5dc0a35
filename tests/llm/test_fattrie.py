"""The trie of conversations against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from runledger.llm import fattrie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = turns.get(base, [])[:h] + mine[h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k)))).encode()).hexdigest())
        for k, m in members.items())


def table(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(120), -3, -20, 4000, 4020, 4021]:
        n = rng.choice([1, 1, 2, 3, 5, 9])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "maybe so", "go on then", ""])) for t in range(n)]
    same = [("user", "hello there"), ("assistant", "how can I help you"), ("user", "no")]
    rows += [(1000 + c, t, *same[t]) for c in range(60) for t in range(3)]  # a third of them is one conversation
    rows += [(None, 1, "user", "lost")] * 5 + [(77, None, None, None), (78, None, "user", "null turn"), (79, 3, "user", "a"), (79, 3, "user", "a"), (79, 3, "user", "b")]
    rows += [(2000, 0, "user", "x " * 50000), (2001, 0, "user", "x " * 50000), (2002, 0, "u\x00ser", "é\U0001f600 \n\t")]
    return rows


@pytest.mark.parametrize("ids", [3, 4096])
def test_nodes(spark, monkeypatch, ids):
    monkeypatch.setattr(fattrie, "IDS", ids)
    rows = table(ids)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("items", "chain", "n", "_turn", "my col")})
    out = fattrie.prefix_nodes(fattrie.with_family_heads(fattrie.sequences(docs)))
    assert Counter(tuple(r) for r in out.collect()) == brute(rebuilt(rows))


def as_frame(spark, seqs):
    rows = [(c, i, r, t) for c, seq in seqs.items() for i, (r, t) in enumerate(seq)]
    return fattrie.sequences(spark.createDataFrame(rows, SCHEMA))


def test_deep_trie_needs_few_batches(spark, monkeypatch):
    # A spine of 70 turns that a conversation leaves at every depth, and prefixes of it that end inside edges.
    spine = [("u", f"turn {i}") for i in range(70)]
    seqs = {i: spine[:i] + [("u", f"off {i}")] for i in range(1, 70)} | {100 + i: spine[:i] for i in (1, 7, 8, 31, 64, 70)}
    batches = []
    real = fattrie.inserted
    monkeypatch.setattr(fattrie, "inserted", lambda *a: batches.append(1) or real(*a))
    out = fattrie.prefix_nodes(as_frame(spark, seqs))
    assert Counter(tuple(r) for r in out.collect()) == brute(seqs)
    assert len(batches) <= 14


def test_trie_is_compacted_and_filed(spark):
    seqs = rebuilt(table(1))
    strings = fattrie.materialised(fattrie.chained(as_frame(spark, {c: s for c, s in seqs.items() if s})).drop("key").dropDuplicates(["chain"]))
    nodes = fattrie.build(strings).collect()
    prefixes = {tuple(s[:d]) for s in seqs.values() for d in range(1, len(s) + 1)}
    assert sum(r.e - r.p for r in nodes) == len(prefixes)
    below, ends = Counter(bytes(r.pname) for r in nodes), {bytes(r.chain[-16:]) for r in strings.collect()}
    assert all(below[bytes(r.name)] != 1 or bytes(r.name) in ends for r in nodes)
    assert len({bytes(r.handle) for r in nodes}) == len(nodes) == len({bytes(r.first) for r in nodes})


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", fattrie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_no_rows(spark):
    empty = fattrie.sequences(spark.createDataFrame([], SCHEMA))
    assert fattrie.prefix_nodes(fattrie.with_family_heads(empty)).isEmpty()
    # Its own turn goes and its base is absent: a conversation without turns.
    lost = next(c for c in range(1000) if zlib.crc32(str(c).encode()) % 4 and c % 20)
    rows = [(lost, 0, "user", "only turn")]
    out = fattrie.prefix_nodes(fattrie.with_family_heads(fattrie.sequences(spark.createDataFrame(rows, SCHEMA))))
    assert Counter(tuple(r) for r in out.collect()) == brute(rebuilt(rows)) and out.count() == 1
