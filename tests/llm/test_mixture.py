"""Mixing sources by hash thresholds against a plain walk through the documents in hash order."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from runledger.llm import mixture

SCHEMA = "doc_id long, text string, source string, lang string"


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def brute(rows, weights=(3, 1, 2), share=1.5, most=2):
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += n_words(text)
    wanted = brute_targets(sizes, weights, share, most)
    out = []
    for source in sizes:
        docs = defaultdict(list)
        for d, text, s, *_ in rows:
            if s == source:
                key = hashlib.md5(f"{'' if d is None else d} {text or ''}".encode()).hexdigest()[:15]
                docs[key].append((d, n_words(text)))
        full = math.floor(wanted[source] / sizes[source]) if sizes[source] else 0
        budget, below = wanted[source] - full * sizes[source], 0
        for key in sorted(docs):
            size, n = docs[key][0][1], len(docs[key])
            more = max(0, min(n, math.ceil((budget - below) / size - 0.5))) if size and below < math.inf else 0
            below = below + size * n if below + size * n <= budget else math.inf
            for i, (d, size) in enumerate(docs[key]):
                out.append((d, size, sizes[source], round(wanted[source], 6), size * (full + (i < more))))
    return Counter(out)


def table(kind):
    rng = random.Random(kind)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)), rng.choice(["web", "web", "books", "Ärzte", "code", None, ""]), None) for i in range(300)]
    if kind == 1:  # a third of all rows is one row
        rows += [(7, "the same row again", "web", None)] * 150 + [(None, "no id", "code", "x")] * 20
    if kind == 2:  # tiny sources beside a huge one, long and odd texts
        rows += [(1000 + i, "one", f"s{i:02}", None) for i in range(30)] + [(2000, "w " * 90000, "books", None), (2001, None, "books", None), (2002, " \t\n\x0b\x0c\r", "web", None)]
        rows += [(2003, " no break \U0001f600 x", "web", None), (2004, "x" * 50000, "nul", None)]
    return rows


@pytest.mark.parametrize("bits", [3, 12])
@pytest.mark.parametrize("kind", [0, 1, 2])
def test_against_a_walk_in_hash_order(spark, monkeypatch, kind, bits):
    monkeypatch.setattr(mixture.thresholds, "__defaults__", (bits,))
    rows = table(kind)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("size", "taken", "target", "_h", "_key", "_cut", "my col")})
    got = Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixture.decisions(docs).collect())
    assert got == brute(rows)


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixture.decisions(docs)
    longest = docs.select(F.max(mixture.word_count(F.col("text")))).first()[0]
    sums = out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= longest / 2 and r.over <= 0 for r in sums)
    assert sum(r.target for r in sums) == pytest.approx(1.5 * sum(r.source_size for r in sums))


@pytest.mark.parametrize("share", [0.3, 1.0, 1.9, 2.0, 2.5])
def test_shares(spark, share):
    rows = table(0)
    got = Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixture.decisions(spark.createDataFrame(rows, SCHEMA), share=share).collect())
    assert got == brute(rows, share=share)


def test_budgets_are_nested(spark):
    rows = mixture.materialised(mixture.sized(spark.createDataFrame(table(1), SCHEMA)).select("_key", "_size", "_h"))
    budgets = rows.groupBy("_key").agg(F.sum("_size").alias("n")).withColumn("_mix", F.explode(F.sequence(F.lit(0), F.lit(10))))
    cuts = mixture.thresholds(rows, budgets.select("_key", "_mix", (F.col("n") * F.col("_mix") / 10).alias("_budget")))
    by = defaultdict(list)
    for r in cuts.collect():
        by[r._key].append((r._mix, r._cut, r._below, r._budget))
    for key, found in by.items():
        found.sort()
        assert [c for _, c, *_ in found] == sorted(c for _, c, *_ in found)
        for _, cut, below, budget in found:
            words = rows.where((F.col("_key") == key) & (F.col("_h") < cut)).agg(F.sum("_size")).first()[0] or 0
            assert words <= budget and (below == words or cut == 1 << mixture.HASH_BITS)


def test_the_mix_has_whole_rows(spark):
    rows = table(1)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"my col": F.lit(1), "_size": F.lit("own"), "a-b.c": F.struct(F.lit(2).alias("x y"))})
    out = mixture.mixed(docs)
    assert out.schema.names == docs.schema.names
    want = sum(size and n * taken // size for (_, size, _, _, taken), n in brute(rows).items())
    assert out.where(mixture.word_count(F.col("text")) > 0).count() == want
    assert out.join(docs, ["doc_id"], "left_anti").where("doc_id IS NOT NULL").isEmpty()


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixture.decisions(empty).isEmpty() and mixture.mixed(empty).isEmpty()
    blank = spark.createDataFrame([(1, None, None, None), (2, " ", "a", None)], SCHEMA)
    assert sorted(tuple(r) for r in mixture.decisions(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_reruns_agree(spark):
    docs = spark.createDataFrame(table(0), SCHEMA)
    a, b = (sorted(map(str, mixture.decisions(d).collect())) for d in (docs, docs.repartition(7)))
    assert a == b
