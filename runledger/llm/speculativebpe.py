"""Byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of a word. A sequence of tokens is what BPE merging gives
exactly when every two neighbours are compatible, that is, when merging the bytes of the two alone
leaves them as they are. One vectorised pass tests all neighbours of all new words; only words
that fail it are merged step by step.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from runledger.llm.frames import map_texts

#: Fixed value: the split of texts before merging that this family of vocabularies is made for; L, N and S stand for the letters, numbers and spaces.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
#: Code points beyond this are neither letters, numbers nor spaces in any version of Unicode.
PLANES = 0x40000
#: Words a worker remembers of each of two generations; when the younger is full it becomes the older one, whose words come
#: back when they are met again. It changes the speed only.
MEMORY = 300_000
COUNTS = 600_000
LONG_WORD = 64
#: Bytes of text that a worker encodes at once.
SLICE = 2 << 20
NONE = np.iinfo(np.int64).max


@functools.lru_cache(4)
def split_patterns(path: str) -> tuple[str, str]:
    """The split as patterns of ``re``: for texts without code points beyond 16 bits, and for all texts.

    Which code points are letters, numbers and spaces is asked of the library, as its Unicode tables are those of another version
    than Python's: in ``a?1a?!`` a letter goes with the a, a number with the 1, and a mark, but no space, with the !.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    points = np.array([c for c in range(PLANES) if not 0xD800 <= c < 0xE000])
    kinds = []
    for at in range(0, len(points), 1 << 14):
        text = "".join([f"a{c}1a{c}!" for c in map(chr, points[at : at + (1 << 14)].tolist())])
        starts = np.zeros(len(text), bool)
        starts[[place[0] for _, place in split(text)]] = True
        s = starts.reshape(-1, 6)
        kinds.append(np.where(~s[:, 1], "L", np.where(~s[:, 2], "N", np.where(~s[:, 5], "", "S"))))
    kind = np.concatenate(kinds)
    kind[points == ord(" ")] = "S"  # goes with whatever follows it

    def ranges(which: str, top: int) -> str:
        mine = points[(kind == which) & (points <= top)]
        cut = np.flatnonzero(np.diff(mine) != 1)
        return "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in zip(mine[[0, *(cut + 1)]].tolist(), mine[[*cut, len(mine) - 1]].tolist()))

    def pattern(top: int) -> str:
        names = {k: ranges(k, top) for k in "LNS"}
        return re.sub(r"[LNS]", lambda m: names[m[0]], SPLIT)

    return pattern(0xFFFF), pattern(PLANES)


class Lookup:
    """A table from keys (0 or more, different) to numbers that answers whole arrays: open addressing, a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while todo.size:
            slot, first = np.unique(at[todo], return_index=True)
            free = self._keys[slot] < 0
            who = todo[first[free]]
            self._keys[slot[free]], self._values[slot[free]] = keys[who], values[who]
            todo = np.setdiff1d(todo, who, assume_unique=True)
            at[todo] = (at[todo] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NONE where there is none."""
        at = self._slot(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._values[at], NONE)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while rest.size:
            at[rest] = (at[rest] + 1) & self._mask
            found = self._keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self._values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        names[chr(256 + i)] = b
    return names


class SpeculativeBpe:
    """Encoder and decoder of one vocabulary file of the byte-level kind.

    Inside, a token has its order as number: bytes 0 to 255, then the merges by rank. So a lower number
    is merged first.
    """

    def __init__(self, path: str, patterns: tuple[str, str] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        raw = lambda token: bytes(names[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [bytes([b]) for b in range(256)]
        order = {t: i for i, t in enumerate(self.bytes)}
        left, right = list(range(256)), list(range(256))
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            whole = raw(a) + raw(b)
            n = order.setdefault(whole, len(self.bytes))
            if n == len(self.bytes):
                self.bytes.append(whole)
                left.append(order[raw(a)])
                right.append(order[raw(b)])
            self.pairs[order[raw(a)], order[raw(b)]] = n
        by_bytes = {raw(t): i for t, i in vocab.items()}
        self.ids = [by_bytes[t] for t in self.bytes]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.longest = max(map(len, self.bytes))
        self._order = order
        self._size = len(self.bytes)
        self._pair = Lookup(np.array([a * self._size + b for a, b in self.pairs], np.int64), np.fromiter(self.pairs.values(), np.int64, len(self.pairs)))
        # All beginnings of tokens as nodes, with the token that ends there.
        nodes: dict[bytes, int] = {b"": 0}
        steps: list[tuple[int, int]] = []
        for token in self.bytes:
            for i in range(1, len(token) + 1):
                if token[:i] not in nodes:
                    nodes[token[:i]] = len(nodes)
                    steps.append((nodes[token[: i - 1]] * 256 + token[i - 1], nodes[token[:i]]))
        keys, to = np.array(steps, np.int64).T
        self._step = Lookup(keys, to)
        self._token = np.full(len(nodes), -1, np.int64)
        self._token[[nodes[t] for t in self.bytes]] = np.arange(self._size)
        self._id_text = [str(i) for i in self.ids]
        small, every = patterns or split_patterns(path)
        self._split, self._split_every = re.compile(small), re.compile(every)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._ids: dict[str, str] = {}
        self._back: dict[str, bytes] = {}
        self._counts: dict[str, int] = {}
        self._old_ids, self._old_back, self._old_counts = self._ids, self._back, self._counts
        self.failed = self.seen = 0

    # --- words ---

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match, of one word."""
        out, i, n, order = [], 0, len(word), self._order
        while i < n:
            j = min(n, i + self.longest)
            while (token := order.get(word[i:j])) is None:
                j -= 1
            out.append(token)
            i = j
        return out

    def propose_all(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, how many of each) by greedy longest match; ``data`` has the bytes of all words. All words advance at once."""
        found = np.full(len(data), -1, np.int64)
        ends = np.cumsum(lengths)
        start, end = (ends - lengths)[lengths > 0], ends[lengths > 0]
        at, node = start.copy(), np.zeros(len(start), np.int64)
        token, token_end = node.copy(), start.copy()
        while start.size:
            inside = at < end
            to = np.full(len(at), NONE)
            to[inside] = self._step.get(node[inside] * 256 + data[at[inside]])
            go = to != NONE
            node = np.where(go, to, 0)
            at = at + go
            ends_here = go & (self._token[node] >= 0)
            token, token_end = np.where(ends_here, self._token[node], token), np.where(ends_here, at, token_end)
            stop = ~go
            found[start[stop]] = token[stop]
            start, at = np.where(stop, token_end, start), np.where(stop, token_end, at)
            live = start < end
            if not live.all():
                start, end, at, node, token, token_end = (x[live] for x in (start, end, at, node, token, token_end))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        is_start = found >= 0
        return found[is_start], np.bincount(owner[is_start], minlength=len(lengths))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: would merging leave the boundary between them?

        The merges of both tokens are undone from the latest backwards. At each step the two pieces that
        touch the boundary must not have had a merge of their own before the one just undone.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), NONE)
        while at.size:
            made = self._pair.get(a * self._size + b)
            bad = made < limit
            ok[at[bad]] = False
            first = a > b
            # Undo the later of the two; a token that is a single byte cannot be undone, then the other's turn comes.
            a_single, b_single = self.right[a] == a, self.left[b] == b
            undo_a = np.where(first, ~a_single, b_single & ~a_single)
            undo_b = np.where(first, a_single & ~b_single, ~b_single)
            go = ~bad & (undo_a | undo_b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first, then leftmost; a heap keeps long words cheap."""
        token = list(word)
        n = len(token)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i, token[i], token[i + 1]) for i in range(n - 1) if (m := self.pairs.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, x, y = heapq.heappop(heap)
            j = nxt[i] if token[i] == x else n
            if j >= n or token[j] != y:
                continue
            token[i], token[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] < n and (p := self.pairs.get((token[k], token[nxt[k]]))) is not None:
                    heapq.heappush(heap, (p, k, token[k], token[nxt[k]]))
        return [t for t in token if t >= 0]

    def merge_all(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, how many of each) by exact merging. A round merges the earliest pair of every word, wherever it stands.

        A merge makes no pair that comes before its own, as tokens are used in merges only after they are made.
        """
        token, owner = data.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while token.size:
            made = np.full(len(token), NONE)
            made[:-1] = np.where(owner[:-1] == owner[1:], self._pair.get(token[:-1] * self._size + token[1:]), NONE)
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            word = np.cumsum(new) - 1
            least = np.minimum.reduceat(made, np.flatnonzero(new))[word]
            finished = least == NONE
            done.append((owner[finished], token[finished]))
            token, owner, made, least = (x[~finished] for x in (token, owner, made, least))
            hit = made == least
            # Of overlapping pairs, every second one from the left.
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place)) - 1 if len(hit) else place
            hit &= run % 2 == 0
            token = np.where(hit, made, token)
            keep = np.ones(len(token), bool)
            keep[np.flatnonzero(hit) + 1] = False
            token, owner = token[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        owner, token = (np.concatenate(x) for x in zip(*done))
        at = np.argsort(owner, kind="stable")
        return token[at], np.bincount(owner, minlength=len(lengths))

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token numbers of all words, how many of each): proposed, verified, and merged where verification fails."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        long = sizes > 4 * LONG_WORD
        flat, counts = self.propose_all(data[~np.repeat(long, sizes)], np.where(long, 0, sizes))
        if long.any():  # word by word, so that one long word does not hold up the others
            flat, counts = _replaced(flat, counts, {i: self.propose(words[i]) for i in np.flatnonzero(long).tolist()})
        ends = np.cumsum(counts)
        inner = np.ones(len(flat), bool)
        inner[ends[counts > 0] - 1] = False
        at = np.flatnonzero(inner)
        wrong = at[~self.compatible(flat[at], flat[at + 1])]
        fails = np.zeros(len(words), bool)
        fails[np.searchsorted(ends, wrong, "right")] = True
        self.seen += len(words)
        self.failed += int(fails.sum())
        if not fails.any():
            return flat, counts
        again = fails & ~long
        token, n = self.merge_all(data[np.repeat(again, sizes)], sizes[again])
        every, total = np.where(fails, 0, counts), counts.copy()
        total[again] = n
        every[again] = n
        # Kept and merged tokens, each in the order of its words, put in the order of all words.
        owner = np.concatenate([np.repeat(np.arange(len(words)), np.where(fails, 0, counts)), np.repeat(np.flatnonzero(again), n)])
        flat = np.concatenate([flat[~np.repeat(fails, counts)], token])[np.argsort(owner, kind="stable")]
        if (fails & long).any():
            return _replaced(flat, every, {i: self.merge(words[i]) for i in np.flatnonzero(fails & long).tolist()})
        return flat, every

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token numbers of each word."""
        flat, counts = self.encode_flat(words)
        return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if words else []

    # --- texts ---

    def pieces(self, text: str) -> list[str]:
        """The words that are encoded one by one; a special token is a word of its own."""
        if self._cut and any(s in text for s in self.special):
            parts = self._cut.split(text)
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        small = len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (self._split if small else self._split_every).findall(text)

    def _new(self, words: list[list[str]], known: dict, old: dict, most: int) -> tuple[list[str], bool]:
        """(words that are not in ``known``, whether they and it are too many)."""
        met = set().union(*words)
        new = met.difference(known)
        return (list(met), True) if known and len(known) + len(new) > most else (list(new), False)

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, bytes]]:
        """Of each text: number of tokens, decimal ids joined by commas, bytes of the decoded tokens. Null counts as empty."""
        words = [self.pieces(t or "") for t in texts]
        new, full = self._new(words, self._ids, self._old_ids, MEMORY)
        if full:
            self._old_ids, self._old_back, self._ids, self._back = self._ids, self._back, {}, {}
        ids, back, old_ids, old_back = self._ids, self._back, self._old_ids, self._old_back
        learn = []
        for w in new:
            if w in old_ids:
                ids[w], back[w] = old_ids[w], old_back[w]
            elif w in self.special:
                ids[w], back[w] = str(self.special[w]), w.encode()
            else:
                learn.append(w)
        flat, counts = self.encode_flat([w.encode() for w in learn])
        flat, at, names, raw = flat.tolist(), 0, self._id_text, self.bytes
        for w, n in zip(learn, counts.tolist()):
            tokens = flat[at : at + n]
            at += n
            ids[w], back[w] = ",".join([names[x] for x in tokens]), b"".join([raw[x] for x in tokens])
        out = []
        for ws in words:
            text = ",".join(map(ids.__getitem__, ws))
            out.append((text.count(",") + 1 if ws else 0, text, b"".join(map(back.__getitem__, ws))))
        for w in new:
            if len(w) > LONG_WORD:  # not worth remembering
                del ids[w], back[w]
        return out

    def lengths(self, texts: list[str | None]) -> list[int]:
        """Of each text: number of tokens. Remembers counts only."""
        words = [self.pieces(t or "") for t in texts]
        new, full = self._new(words, self._counts, self._old_counts, COUNTS)
        if full:
            self._old_counts, self._counts = self._counts, {}
        known, old = self._counts, self._old_counts
        learn = []
        for w in new:
            if w in old:
                known[w] = old[w]
            elif w in self.special:
                known[w] = 1
            else:
                learn.append(w)
        known.update(zip(learn, self.encode_flat([w.encode() for w in learn])[1].tolist()))
        out = [sum(map(known.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return out


def _replaced(flat: np.ndarray, counts: np.ndarray, some: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat tokens and counts after the words of ``some``, which have none so far, get theirs."""
    starts, out, at = np.cumsum(counts) - counts, [], 0
    counts = counts.copy()
    for i, tokens in sorted(some.items()):
        out += [flat[at : starts[i]], np.array(tokens, np.int64)]
        at = starts[i]
        counts[i] = len(tokens)
    return np.concatenate([*out, flat[at:]]), counts


@functools.lru_cache(2)
def encoder(path: str, patterns: tuple[str, str] | None = None) -> SpeculativeBpe:
    """One instance per worker process and file. The driver finds the patterns and sends them along."""
    return SpeculativeBpe(path, patterns)


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (text, joined by commas), decoded of every row; a null text counts as empty.

    Extra columns are ignored and repeated rows stay repeated.
    """
    patterns = split_patterns(tokenizer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = encoder(tokenizer, patterns).encode(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()),
             pa.array([g[2].decode("utf-8", "replace") for g in got], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids string, decoded string", limit=SLICE)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encoded`` with digests taken beside the tokens."""
    patterns = split_patterns(tokenizer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = encoder(tokenizer, patterns).encode(batch.column(1).to_pylist())
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([sha(g[1].encode()) for g in got]),
             pa.array([sha(g[2].decode("utf-8", "replace").encode()) for g in got])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", limit=SLICE)
