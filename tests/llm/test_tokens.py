"""Splitting, speculation and merging of the byte-level tokenizer, against the library on every code point."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runledger.llm import speculativebpe

BYTE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTE)
OURS = speculativebpe.SpeculativeBpe(BYTE)


def wanted(texts):
    return [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def agree(texts):
    for text, (n, ids, back), want in zip(texts, OURS.encode(texts), wanted(texts)):
        assert (n, ids) == (len(want), ",".join(map(str, want))), ascii(text)
        assert back == text.encode()
    assert OURS.lengths(texts) == [len(w) for w in wanted(texts)]


@pytest.mark.parametrize("form", ["{c}a{c}1{c}!", "{c}'s {c}x", " {c} {c}{c}"])
def test_every_code_point(form):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # 200 code points to a text; all code points up to plane 3, and every 37th beyond, where none is a letter, number or space.
    points = [c for c in points if c < speculativebpe.PLANES or c % 37 == 0]
    texts = ["|".join(form.format(c=chr(c)) for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    agree(texts)


def test_code_points_newer_than_the_library():
    agree([f"{chr(c)}'s {chr(c)}a {chr(c)}1" for c in (0x088F, 0x0C5C, 0x10940, 0x10957, 0x12550, 0x16EA0, 0x328CE)])


def test_random_texts():
    rng = random.Random(3)
    pool = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and c != 0]
    common = list("etaoin shrdlu  \n\t'1!") + ["'s", "'ll", " the", "<|endoftext|>"]
    agree(["".join(rng.choice(pool) if rng.random() < 0.2 else rng.choice(common) for _ in range(rng.randint(0, 60))) for _ in range(20000)])


def test_generations_do_not_change_results(monkeypatch):
    monkeypatch.setattr(speculativebpe, "MEMORY", 50)
    monkeypatch.setattr(speculativebpe, "COUNTS", 50)
    small = speculativebpe.SpeculativeBpe(BYTE)
    rng = random.Random(4)
    for _ in range(60):
        texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "x" * 99, str(rng.randint(0, 300))]) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        assert [(n, ids) for n, ids, _ in small.encode(texts)] == [(len(w), ",".join(map(str, w))) for w in wanted(texts)]
        assert small.lengths(texts) == [len(w) for w in wanted(texts)]
        assert len(small._ids) <= 200


def test_all_words_at_once_as_one_by_one():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aabbeetthh ing'\xc3\xa9\xe6\x97\xa5") for _ in range(rng.choice([0, 1, 2, 5, 9, 20, 400]))) for _ in range(3000)] + [b"a" * n for n in range(40)]
    sizes = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    for every, one in ((OURS.propose_all, OURS.propose), (OURS.merge_all, OURS.merge)):
        flat, counts = every(data, sizes)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [one(w) for w in words]
    assert OURS.encode_words(words) == [OURS.merge(w) for w in words]


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    table = speculativebpe.Lookup(keys, keys * 3)
    asked = np.concatenate([keys, keys + 1, rng.integers(0, 1 << 40, 5000)])
    assert table.get(asked).tolist() == [k * 3 if k in set(keys.tolist()) else speculativebpe.NONE for k in asked.tolist()]
