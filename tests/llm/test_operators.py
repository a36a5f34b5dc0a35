"""The operators of the subpackage against plain Python, on small tables with every odd case."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runledger.llm import binpacking, blocknames, bytegru, divergence, lengthcurve, linebitmaps, orderminhash, queries, speculativebpe, textstats, warc, weaklabels
from runledger.llm.wordtokens import WordTokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "this is a long line of text that many documents share, more than forty characters"


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "wind", "house", "tree", "Walking", "blue", "seven", "été"]) + str(rng.randint(0, 99)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(5, 60)) + ".\n" + sentence(rng, 12), rng.choice(["en", "fr", None]), "s", 1) for i in range(40)]
    base = sentence(rng, 120)
    rows += [(100 + i, base, "en", "s", 1) for i in range(6)] + [(110, base.upper(), "en", None, None), (111, "", None, None, None), (112, None, "en", "s", 3)]
    near = base.split()
    for i in range(8):
        w = list(near)
        w[10 + i] = "other"
        rows.append((120 + i, " ".join(w), "en", "s", 0))
    rows += [(130 + i, f"first {i}\n  {PASSAGE.upper() if i % 2 else PASSAGE}\t\nlast {i}", "en", "s", 0) for i in range(7)]
    rows += [(140, "x" * 70000, "en", "s", 0), (141, " ".join(["very long"] * 9000), "en", "s", 0), (142, "###", None, "s", 0), (143, "1 2 3", "en", "s", 0)]
    rows += [rows[3], rows[3], (None, "no id here", "en", "s", 0), (None, base, "en", "s", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Columns of the names that the operators make."""
    return docs.withColumns({c: F.lit("own") for c in ("name", "pos", "kept", "score", "n_lines", "length", "n_words", "_uid", "_row", "group_id", "piece", "drops", "_drops", "_doc", "_at", "_gone", "_whole", "my col", "a-b.c", "`")}).withColumn("odd", F.struct(F.lit(1).alias("b c")))


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# --- blocks ---


@pytest.mark.parametrize(("block", "hot"), [(16384, 2000), (7, 2000), (7, 2), (64, 3)])
def test_block_names(spark, docs, block, hot):
    rows = corpus()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[lowered(t)].append(d)
    got = blocknames.exact_duplicates(clashing(docs), block, hot).collect()
    assert len(got) == len(rows)
    want = Counter()
    for d, t, *_ in rows:
        g = groups[lowered(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[d, keep, len(g), hashlib.sha256(lowered(t).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_no_rows(spark, empty):
    assert blocknames.exact_duplicates(empty).count() == 0
    assert linebitmaps.line_dedup(empty).count() == 0
    assert binpacking.pack_documents(empty, WORD).count() == 0
    assert speculativebpe.digests(empty, BYTE).count() == 0
    assert orderminhash.near_duplicates(empty).count() == 0
    assert bytegru.predict(empty, bytegru.fit(empty)).count() == 0
    assert divergence.judge(empty, divergence.references(empty)).count() == 0
    assert weaklabels.classify(empty).count() == 0
    assert lengthcurve.curve(lengthcurve.length_histogram(empty, BYTE)).count() == 0


# --- lines ---


def deduped(rows, min_chars, min_docs):
    holders = defaultdict(set)
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    low = lambda d: -1 if d is None else d
    out = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or low(d) == max(map(low, holders[key(x)]))]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize(("chars", "n", "hot"), [(40, 5, 2000), (40, 5, 3), (3, 2, 2000), (1, 2, 4)])
def test_line_bitmaps(spark, docs, chars, n, hot):
    got = linebitmaps.line_dedup(clashing(docs), chars, n, hot)
    assert {"source", "score", "pos"} <= set(got.columns)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == deduped(corpus(), chars, n)


def test_bitmaps_of_long_documents(spark):
    lines = [f"line number {i} of the shared part which is long enough" for i in range(300)]
    rows = [(d, "\n".join(x for i, x in enumerate(lines) if i % (d + 1) == 0 or i > 250), "en", "s", 0) for d in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = linebitmaps.line_dedup(docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == deduped(rows, 40, 5)
    maps = {r.doc_id: r.drops for r in linebitmaps.keep_bitmaps(docs).collect()}
    assert len(maps[0]) == 5 and 5 not in maps


# --- tokens ---


ALPHABET = st.text(alphabet=st.sampled_from(list("abcdetheing  \n\t\r'1!é<|>Z\x1c\x85\xa0　日🙂́")), max_size=80)
LIBRARY = Tokenizer.from_file(BYTE)
OURS = speculativebpe.SpeculativeBpe(BYTE)
WORD_LIBRARY = Tokenizer.from_file(WORD)
WORDS = WordTokens(WORD)


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=4))
def test_bpe_is_the_library(texts):
    texts = [*texts, "<|endoftext|>".join(texts)]
    for t, (n, ids, back) in zip(texts, OURS.encode(texts)):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert (n, ids) == (len(want), ",".join(map(str, want)))
        assert back.decode() == t == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=4))
def test_word_tokens_are_the_library(texts):
    texts = [*texts, "<|endoftext|>".join(texts), "Straße, ÉTÉ! don't I'LL"]
    for t, ids in zip(texts, WORDS.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == WORD_LIBRARY.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("word", ["a" * 3000, "ab" * 900 + "zqj" * 700, "日本" * 500])
def test_long_words(word):
    assert OURS.encode([word])[0][1] == ",".join(map(str, LIBRARY.encode(word, add_special_tokens=False).ids))


def test_exact_merging_agrees_with_verification():
    words = list({w.encode() for _, t, *_ in corpus() for w in (t or "")[:3000].split()})
    assert OURS.encode_words(words) == [OURS.merge(w) for w in words]


def test_digests(spark, docs):
    got = Counter(tuple(r) for r in speculativebpe.digests(clashing(docs), BYTE).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for d, t, *_ in corpus():
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_length_curve(spark, docs):
    lengths = np.array([len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in corpus()])
    points = lengthcurve.curve(lengthcurve.length_histogram(docs, BYTE), (16, 100000))
    rows = points.collect()
    assert {r.context_limit for r in rows} == {*lengths.tolist(), 16, 100000}
    for r in rows:
        k = r.context_limit
        assert (r.docs, r.docs_at_least, r.tokens_at_least, r.docs_truncated) == ((lengths == k).sum(), (lengths >= k).sum(), lengths[lengths >= k].sum(), (lengths > k).sum())
        assert r.total_tokens == np.minimum(lengths, k).sum() and r.share_within == pytest.approx((lengths <= k).mean())
    got = {r.share: r.length for r in lengthcurve.quantiles(points, (0.1, 0.5, 0.9, 1.0)).collect()}
    assert got == {q: int(np.sort(lengths)[int(np.ceil(q * len(lengths) - 1e-9)) - 1]) for q in got}


def test_length_curve_query(spark, docs, empty, tmp_path):
    """The registered query has the quantiles, and rows for its limits when there are no documents."""
    docs.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    rows = queries.op5_length_curve(spark, str(tmp_path / "some")).collect()
    lengths = np.sort([len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in corpus()])
    got = sorted((q, r.context_limit) for r in rows for q in r.quantile_of)
    assert got == [(q, int(lengths[int(np.ceil(q * len(lengths) - 1e-9)) - 1])) for q in queries.QUANTILES]
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    none = queries.op5_length_curve(spark, str(tmp_path / "none")).collect()
    assert sorted(r.context_limit for r in none) == list(queries.CONTEXT_LIMITS)
    assert {(r.docs, r.docs_at_least, r.docs_truncated, r.total_tokens, r.share_within, tuple(r.quantile_of or ())) for r in none} == {(0, 0, 0, 0, None, ())}


# --- packing ---


def exhaustive(sizes, capacity):
    """Fewest sequences by trying every place for every piece."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=10))
def test_packing_is_the_fewest(sizes):
    packing = binpacking.pack_histogram(Counter(sizes), 30)
    used = Counter()
    for n, filling in packing:
        assert n > 0 and sum(x * k for x, k in filling) <= 30
        used.update({x: n * k for x, k in filling})
    assert used == Counter(sizes)
    assert sum(n for n, _ in packing) == exhaustive(sorted(sizes, reverse=True), 30) >= binpacking.lower_bound(Counter(sizes), 30)


def test_search_beats_best_fit():
    sizes = Counter([11, 12, 13, 17, 20, 20, 20, 22, 22, 22, 25, 27])
    greedy = sum(n for n, _ in binpacking.best_fit(sizes, 60))
    assert sum(n for n, _ in binpacking.pack_histogram(sizes, 60)) == 4 < greedy


def naive_best_fit(sizes, capacity):
    rooms = []
    for x in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 60))
def test_best_fit_is_that_of_single_pieces(sizes, capacity):
    packing = binpacking.best_fit(Counter(sizes), capacity)
    used = Counter()
    for n, filling in packing:
        for x, k in filling:
            used[x] += n * k
    assert used == Counter(sizes)
    assert sorted(capacity - sum(x * k for x, k in f) for n, f in packing for _ in range(n)) == naive_best_fit(sizes, capacity)


@pytest.mark.parametrize(("full", "parts"), [(500, 3), (400, 4), (60, 3), (200, 5)])
def test_planted_packings_are_met_within_a_hundredth(full, parts):
    """Pieces cut from sequences that they fill exactly: the packing may need at most 1 % more, one at least."""
    rng = random.Random(full)
    pieces = []
    for _ in range(full):
        cuts = sorted(rng.sample(range(1, 4096), parts - 1))
        pieces += [b - a for a, b in zip([0, *cuts], [*cuts, 4096])]
    packing = binpacking.pack_histogram(Counter(pieces), 4096)
    used = Counter()
    for n, filling in packing:
        assert sum(x * k for x, k in filling) <= 4096
        used.update({x: n * k for x, k in filling})
    assert used == Counter(pieces)
    assert sum(n for n, _ in packing) <= full + max(1, full // 100)


def packing_holds(spark, rows, got, capacity):
    want = Counter()
    for d, t, *_ in rows:
        ids = np.array([*WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for i, a in enumerate(range(0, len(ids), capacity)):
            want[d, i, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [4096, 50])
def test_pack_documents(spark, docs, capacity):
    n = packing_holds(spark, corpus(), binpacking.pack_documents(clashing(docs), WORD, capacity).collect(), capacity)
    tokens = sum(len(WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in corpus())
    assert n <= -(-tokens // capacity) + 1


# --- language ---


def test_gradients():
    model = bytegru.ByteGru.fresh(["a", "b", "c"], 4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(1)
    x, used, y = rng.integers(97, 110, (9, 5)), np.array([9, 9, 4, 7, 1]), np.array([0, 1, 2, 0, 1])
    loss, g = model.gradients(x, used, y)
    for name in model.p:
        flat = np.argsort(-abs(g[name]).ravel())[:4]
        for i in flat:
            at = np.unravel_index(i, g[name].shape)
            old = model.p[name][at]
            model.p[name][at] = old + 1e-5
            up = model.gradients(x, used, y)[0]
            model.p[name][at] = old - 1e-5
            down = model.gradients(x, used, y)[0]
            model.p[name][at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=0.05, abs=2e-4), name


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = bytegru.fit(docs, sample_docs=150, steps=200)
    got = bytegru.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(bytegru.held_out(F.col("doc_id"))).collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    # Long texts are read to their end.
    en, de = (next(r.text for r in docs.where(f"lang = '{x}'").orderBy("doc_id").collect() if len(r.text) > 1500) for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, en[:300] + de * 20), (2, None), (3, "12 3 !"), (4, ""), (5, en)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bytegru.predict(mixed, model, runs=True).collect()}
    assert rows[1].lang_pred == "de" and rows[5].lang_pred == "en"
    assert [(rows[i].lang_pred, rows[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert sum(r["length"] for r in rows[1].runs) == len((en[:300] + de * 20).encode())
    assert {r.doc_id for r in bytegru.accepted(mixed, model).collect()} == {1, 5}


def test_eighty_languages(spark, monkeypatch):
    """No language is left out: the rarest of eighty is learned and has a reference."""
    rng = random.Random(8)
    rows = []
    for k in range(80):
        letters = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) + chr(0x430 + k % 32) + chr(0x3B1 + k % 24)
        for i in range(30 if k else 12):
            rows.append((len(rows), " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)), f"l{k:02}", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = bytegru.fit(docs, sample_docs=20, steps=5)
    assert model.langs == [f"l{k:02}" for k in range(80)]
    refs = divergence.references(docs, min_words=500)
    assert len(refs.langs) == 80
    monkeypatch.setattr(bytegru, "SAMPLE_TOTAL", 160)
    assert len(bytegru.fit(docs, steps=1).langs) == 80
    # A language of few words has no reference and is not judged by distance; a text without language is, by the nearest.
    some = divergence.references(docs, min_words=1000)
    assert "l00" not in some.langs and len(some.langs) == 79
    got = divergence.judge(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), some).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all((r.word_distance is None) == (r.lang == "l00" and r.doc_id % 2 == 0) for r in got)


@pytest.mark.parametrize("doc_id", [None, 7, 8, 9])
def test_samples_of_one_doc_id(spark, doc_id):
    rng = random.Random(2)
    rows = [(doc_id, sentence(rng, 30), "en" if i % 2 else "de", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = bytegru.fit(docs, sample_docs=20, steps=2)
    assert model is None if doc_id in (7, 8, 9) and zlib.crc32(str(doc_id).encode()) % 3 == 1 else model.langs == ["de", "en"]
    scores = {round(r.score, 6) for r in weaklabels.classify(docs, sample_docs=20).collect()}
    assert scores != {0.5}  # the score of a scorer that trained on nothing


def test_windows_cover_every_byte():
    raw = [b"", b"abc", bytes(range(1, 200)), b"x" * 64]
    x, used, owner = bytegru.windows(raw)
    assert [bytes(np.concatenate([*(a[:n] for a, n in zip(x[owner == i], used[owner == i])), np.zeros(0, np.uint8)])) for i in range(4)] == raw


# --- quality ---


def naive_stats(text):
    s = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    lines = [x for x in s.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab c\n\t\x0b#|é　日🙂")), max_size=60)), max_size=5))
def test_statistics(texts):
    s = textstats.TextStats(pa.array(texts, pa.string()))
    got = list(zip(s.n_words.tolist(), s.word_chars.tolist(), s.n_symbols.tolist(), s.n_dup_lines.tolist(), s.n_repeat_words().tolist()))
    assert got == [naive_stats(t) for t in texts]


def test_divergence(spark, docs):
    refs = divergence.references(docs, min_words=1)
    assert refs.langs == ["en", "fr"]
    words = Counter()
    for _, t, lang, *_ in corpus():
        if lang == "fr":
            words.update(w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    j = refs.langs.index("fr")
    assert refs.words[j] == [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:48]]
    assert refs.shares[j][:-1] == pytest.approx([words[w] / sum(words.values()) for w in refs.words[j]])
    got = divergence.judge(clashing(docs), refs).collect()
    assert len(got) == len(corpus())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((d, *naive_stats(t)) for d, t, *_ in corpus())
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and (r.class_distance or 0) <= 0.29 and (r.word_distance or 0) <= 0.47)
        assert (r.class_distance is None) == (r.word_chars < 200) and (r.word_distance is None) == (r.n_words < 60)
    kept = divergence.accepted(clashing(docs), refs)
    assert kept.columns == clashing(docs).columns and kept.count() == sum(r.kept for r in got)


def naive_distance(p, q):
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def test_verdicts_against_plain_python(spark, docs):
    """Distances and verdicts from histograms that plain Python makes of the whole texts."""
    rows = [r for r in corpus() if len(r[1] or "") < 5000]
    refs = divergence.references(docs, min_words=1)
    limits = divergence.Limits(max_class=0.12, max_word=0.3, min_chars=100, min_words=20)
    kinds = ["lower", "upper", "digit", "blank", "mark", "symbol", "control", "two_bytes", "more_bytes"]

    def kind(c):
        if ord(c) >= 0x80:
            return "two_bytes" if ord(c) < 0x800 else "more_bytes"
        return ("lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c.isdigit() else "blank" if c in " \t\n\x0b\x0c\r" else
                "mark" if c in ".,;:!?'\"()-" else "symbol" if 33 <= ord(c) < 127 else "control")

    def compared(text, j):
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        classes = Counter(map(kind, text))
        common = [words.count(w) for w in refs.words[j]]
        return (naive_distance([classes[k] / max(1, len(text)) for k in kinds], refs.classes[j]),
                naive_distance([n / max(1, len(words)) for n in [*common, len(words) - sum(common)]], refs.shares[j]))

    want = Counter()
    for d, t, lang, *_ in rows:
        t = t or ""
        n, chars, _, _, repeat = naive_stats(t)
        failed = n < 10 or 100 * repeat > 20 * n
        a, b = min((compared(t, j) for j in ([refs.langs.index(lang)] if lang else range(len(refs.langs)))), key=sum)
        want[d, failed, not failed and (chars < 100 or a <= 0.12) and (n < 20 or b <= 0.3), None if chars < 100 else round(a, 6), None if n < 20 else round(b, 6)] += 1
    some = docs.where("text IS NULL OR length(text) < 5000")
    near = lambda x: None if x is None else round(x, 6)
    got = Counter((r.doc_id, r.base_failed, r.kept, near(r.class_distance), near(r.word_distance)) for r in divergence.judge(some, refs, limits).collect())
    assert got == want and len({r[2] for r in want}) == 2


def test_distance():
    p, q = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]), np.array([0.5, 0.5, 0.0])
    assert divergence.js_distance(p, q) == pytest.approx([0, 1])


def test_rules_keep_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = divergence.judge(docs, divergence.references(docs)).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    share = {q: np.mean([r.kept for r in got.where(f"quality = {q} AND NOT base_failed").collect()]) for q in (0, 1)}
    assert share[1] > 0.98 and share[0] < 0.5


def test_weak_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = weaklabels.classify(docs, sample_docs=1000).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([(r.posterior >= 0.5) == (r.quality == 1) for r in rows]) > 0.95
    assert np.mean([r.good == (r.quality == 1) for r in rows]) > 0.93


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.9]
    v = np.stack([np.where(rng.random(len(y)) < 0.1, 0, np.where(rng.random(len(y)) < a, 1 + y, 2 - y)) for a in accuracy], 1)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = weaklabels.expectation_maximisation(patterns, counts.astype(float), weight=0.0)
    assert model.prior == pytest.approx(0.8, abs=0.02)
    assert list(model.accuracies().values()) == pytest.approx(accuracy, abs=0.02)
    assert np.mean((model.posterior(v) > 0.5) == y) > 0.97


def test_weak_labels_of_odd_texts(spark, docs):
    got = weaklabels.classify(clashing(docs)).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)


def test_labels_are_those_of_the_whole_text(spark, monkeypatch):
    """A long text that turns bad after the characters that train has a bad label, and its later parts train too."""
    rng = random.Random(2)
    good = [" ".join(rng.choice(["The", "river", "was", "quiet", "and", "people", "walked", "along", "it."]) for _ in range(400)) + "\n" for _ in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good)]
    rows += [(100 + i, t[:300] + " @@## $$%%" * 3000, "en", "s", 0) for i, t in enumerate(good)]
    seen = []
    train = weaklabels.train_scorer
    monkeypatch.setattr(weaklabels, "train_scorer", lambda texts, labels: seen.append((texts, labels)) or train(texts, labels, iterations=5))
    got = {r.doc_id: r.posterior for r in weaklabels.classify(spark.createDataFrame(rows, SCHEMA), sample_chars=200).collect()}
    texts, labels = seen[0]
    assert len(texts) == 120 and max(map(len, texts)) == 200
    assert sorted(labels) == pytest.approx(sorted(got.values()))
    assert sum("@@##" in t for t in texts) > 50


# --- near duplicates ---


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 30))
def test_alignment(a, b, limit):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    d = levenshtein(a, b)
    assert orderminhash.edit_distance(x, y, limit) == min(d, limit + 1)
    assert orderminhash._overlap_bound(orderminhash.Text(x), orderminhash.Text(y)) <= d
    longest = max(len(a), len(b), 1)
    s = orderminhash.similarity(x, y)
    assert s == pytest.approx(1 - d / longest if d <= 0.2 * longest + 1e-9 else 0)


def test_sketches_are_the_smallest_in_text_order():
    texts = pa.array([t for _, t, *_ in corpus()])
    codes, lengths = orderminhash.word_codes(texts)
    assert lengths.tolist() == [len(orderminhash.words(t)) for t in texts.to_pylist()]
    h, owner = orderminhash.kmers(codes, lengths)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [max(n - 4, 1) if n else 0 for n in lengths]
    got = orderminhash.sketches(h, owner, len(texts))
    mix, factor = orderminhash._mix, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        factors = mix(np.arange(1, 21, dtype=np.uint64) * factor) | np.uint64(1)
        for d in range(0, len(texts), 5):
            own = h[owner == d]
            for j in range(20):
                at = np.sort(np.argsort(own * factors[j], kind="stable")[:4])
                key = np.array([len(at)], np.uint64)
                for i in at:
                    key = mix((key ^ own[i]) * factor)
                assert key[0] == got[d, j]


def linked_groups(rows):
    """Groups of rows by every pair's edit similarity."""
    ws = [orderminhash.words(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            m = max(len(ws[i]), len(ws[j]))
            if ws[i] == ws[j] or (abs(len(ws[i]) - len(ws[j])) <= 0.2 * m and levenshtein(ws[i], ws[j]) <= 0.2 * m):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_near_duplicates(spark, docs):
    rows = [r for r in corpus() if len(r[1] or "") < 3000]
    groups = defaultdict(list)
    for r, g in zip(rows, linked_groups(rows)):
        groups[g].append(r[0])
    want = Counter()
    for g in groups.values():
        first = min((d for d in g if d is not None), default=None)
        for d in g:
            want[d, first, len(g)] += 1
    got = orderminhash.near_duplicates(clashing(docs.where("text IS NULL OR length(text) < 3000"))).collect()
    assert Counter((r.doc_id, r.group_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    whole = orderminhash.near_duplicate_rows(clashing(docs)).select("_row.*")
    assert whole.columns == clashing(docs).columns and whole.count() == len(corpus())


def test_mixed_buckets(spark):
    """Groups that a common passage brings into one bucket with a smaller, unlike text are found all the same."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for g in range(30):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(25 + g)]
        for i in range(4):
            w = passage.split() + own
            w[60 + i * 3] = f"own{g}x{i}"
            rows.append((100 * i + g, " ".join(w), "en", "s", 0))
    got = orderminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    groups = linked_groups(rows)
    want = defaultdict(set)
    for r, g in zip(rows, groups):
        want[g].add(r[0])
    found = defaultdict(set)
    for r in got:
        found[r.group_id].add(r.doc_id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def edited(rng, base, share):
    w = list(base)
    for i in rng.sample(range(len(w)), round(share * len(w))):
        w[i] = f"new{rng.randint(0, 10**9)}"
    return w


@pytest.mark.parametrize("size", [40, 600])
def test_recall_at_every_edit_rate(spark, size):
    """Of pairs of texts whose words differ at random places, those of an edit similarity of 0.8 or more are linked in nine cases of ten."""
    rng = random.Random(size)
    rates, n = (0.05, 0.1, 0.15, 0.2), 120 if size < 100 else 50
    rows = []
    for k, rate in enumerate(rates):
        for i in range(n):
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
            rows += [(k * 1000 + 2 * i, " ".join(base), "en", "s", 0), (k * 1000 + 2 * i + 1, " ".join(edited(rng, base, rate)), "en", "s", 0)]
    got = {r.doc_id: r.group_id for r in orderminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k in range(len(rates)):
        recall = np.mean([got[k * 1000 + 2 * i] == got[k * 1000 + 2 * i + 1] for i in range(n)])
        assert recall >= 0.9, (size, rates[k], recall)
    assert len(set(got.values())) >= len(rates) * n


def test_a_large_bucket_is_not_all_pairs(spark, monkeypatch):
    """Many unlike groups that share a passage: cells return no more links than they have classes, and both steps find them all."""
    monkeypatch.setattr(orderminhash, "BLOCK", 8)
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for g in range(12):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(40)]
        for i in range(5):
            rows.append((100 * i + g, " ".join(passage + edited(rng, own, 0.1)), "en", "s", 0))
    counted = []
    real = orderminhash._cell_links
    monkeypatch.setattr(orderminhash, "_cell_links", lambda cells, *a: counted.append((cells.count(), (out := real(cells, *a)).count())) or out)
    got = orderminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want, found = defaultdict(set), defaultdict(set)
    for r, g in zip(rows, linked_groups(rows)):
        want[g].add(r[0])
    for r in got:
        found[r.group_id].add(r.doc_id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert all(links <= classes for classes, links in counted)


@pytest.mark.parametrize("block", [4, 512])
def test_families_in_a_long_passage(spark, monkeypatch, block):
    """A passage of 75 to 79 % of each text supplies all sketches that near duplicates share, and an unlike text comes first in every bucket."""
    monkeypatch.setattr(orderminhash, "BLOCK", block)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(77)]
    rows = []
    for g in range(16):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(21 + g % 5)]
        for i in range(3):
            w = list(own)
            # No five own words in a row are the same in two texts of a family.
            w[i::5] = [f"own{g}x{i}x{j}" for j in range(len(w[i::5]))]
            rows.append((100 * i + g, " ".join(passage + w), "en", "s", 0))
    got = orderminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want, found = defaultdict(set), defaultdict(set)
    for r, g in zip(rows, linked_groups(rows)):
        want[g].add(r[0])
    for r in got:
        found[r.group_id].add(r.doc_id)
    assert len(want) == 16 and sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_bags_bound_the_distance():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abcdef") for _ in range(rng.randint(1, 30))]
        b = [rng.choice("abcdef") if rng.random() < 0.4 else x for x in a][rng.randint(0, 3) :]
        codes, lengths = orderminhash.word_codes(pa.array([" ".join(a), " ".join(b)]))
        x = orderminhash.bags(codes, lengths).astype(int)
        assert x.sum(1).tolist() == lengths.tolist()
        assert max(np.maximum(x[0] - x[1], 0).sum(), np.maximum(x[1] - x[0], 0).sum()) <= levenshtein(a, b)


def test_components(spark):
    links = [(i, i + 1) for i in range(40) if i != 20] + [(5, 3), (3, 5), (60, 61), (7, 7)]
    got = {r._node: r._root for r in orderminhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{i: 21 for i in range(22, 41)}, 61: 60}


# --- archives ---


PAGES = [
    (5, "http://a/5", "<p>" + "same " * 40 + "</p>"), (3, "http://a/3", "<p>" + "same " * 40 + "</p>"), (9, "http://a/9", "<p>" + "same " * 40 + "</p>"),
    (1, "http://a/1", "short"), (2, "http://a/2", "short"), (4, None, None), (6, "http://a/6", ""), (7, "http://a/ü\r\nX: y", "é\r\n\r\nWARC/1.1\r\n" * 30),
    (8, "u", "x" * 99), (10, "u", "x" * 99), (11, "u", "x" * 100), (12, "u", "x" * 100), (None, "n", "y" * 200), (13, "n", "y" * 200), (3, "http://a/3", "<p>" + "same " * 40 + "</p>"),
    (14, "long", "lang " * 60000)]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "own") for p in PAGES], "page_id long, url string, html string, digest string")
    folder = str(tmp_path / "archives")
    warc.write_archives(pages, folder)
    records = warc.read_records(spark, folder)
    kinds = Counter(r.type for r in records.collect())
    assert kinds == {"request": 16, "metadata": 16, "response": 12, "revisit": 4}
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "archives").glob("part-*"))
    assert text.count(b"WARC-Type: ") == 48 and (("é\r\n\r\nWARC/1.1\r\n" * 30).encode() + b"\r\n\r\n") in text
    captures = warc.assemble(records)
    rows = captures.collect()
    assert len(rows) == 16 and all(r.request and r.response and len(r.metadata) == 1 for r in rows)
    assert all(r.capture_id in r.request.concurrent_to for r in rows)
    sizes = {}
    for p, _, h in PAGES:
        b = (h or "").encode()
        sizes.setdefault(hashlib.sha256(b).hexdigest(), []).append(p)
    want = Counter()
    for p, _, h in PAGES:
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        first = min(x for x in sizes[d] if x is not None)
        again = len(b) >= 100 and p != first
        want[p, len(b), d, "revisit" if again else "response", first if again else None] += 1
    got = warc.archive_round_trip(pages, str(tmp_path / "again")).drop("capture_id").collect()
    assert Counter(tuple(r) for r in got) == want


def test_no_pages(spark, tmp_path):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none")).count() == 0


def test_assembly_in_either_direction(spark):
    row = lambda i, kind, to: (i, kind, to, None, None, None, [])
    records = spark.createDataFrame([
        row("r1", "response", ["q1", "m1"]), row("q1", "request", []), row("m1", "metadata", []),
        row("r2", "response", []), row("q2", "request", ["r2"]), row("m2", "metadata", ["r2"]), row("m3", "metadata", ["r2"]),
        row("r3", "revisit", []), row("q4", "request", []), row("m5", "metadata", ["gone"])], warc.RECORD)
    got = {r.capture_id: (r.request and r.request.record_id, r.response and r.response.record_id, [m.record_id for m in r.metadata]) for r in warc.assemble(records).collect()}
    assert got == {"r1": ("q1", "r1", ["m1"]), "r2": ("q2", "r2", ["m2", "m3"]), "r3": (None, "r3", []), "q4": ("q4", None, []), "gone": (None, None, ["m5"])}


def test_damaged_records():
    good = warc.gzip_member(warc.record("metadata", "urn:x", [], b"a: b\r\n"))
    assert [warc.parse(m)[1] for m in warc.members(good * 2)] == [b"a: b\r\n"] * 2
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(good + good[:-9]))
    with pytest.raises(ValueError, match="announced"):
        warc.parse(warc.record("metadata", "urn:x", [], b"abc")[:-6])
