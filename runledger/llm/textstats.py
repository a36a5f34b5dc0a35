"""Counts of characters, words, windows and lines of many texts at once, on Arrow and numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of characters: small letter, capital, digit, blank, sentence mark, symbol, control, and
#: beyond ASCII by the length of the encoding (2 bytes, 3 or 4 bytes).
CLASSES = ("lower", "upper", "digit", "blank", "mark", "symbol", "control", "two_bytes", "more_bytes")
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 5


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("control"), np.uint8)
    t[33:127] = CLASSES.index("symbol")
    for name, values in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", BLANKS), ("mark", b".,;:!?'\"()-")):
        t[list(values)] = CLASSES.index(name)
    t[0xC0:0xE0] = CLASSES.index("two_bytes")
    t[0xE0:] = CLASSES.index("more_bytes")
    t[0x80:0xC0] = len(CLASSES)  # continues a character
    return t


_CLASS = _class_table()


class TextStats:
    """Statistics of a string array; null counts as empty. Words are runs of anything but ASCII blanks."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), texts.type)
        self.n = n = len(texts)
        size = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], size)[: n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and n else np.zeros(0, np.uint8)
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        k = len(CLASSES) + 1
        #: characters of each class, texts x CLASSES
        self.classes = np.bincount(doc * k + _CLASS[data], minlength=n * k).reshape(n, k)[:, :-1]
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        self.n_symbols = np.bincount(doc[symbol[data]], minlength=n)
        self.word_chars = self.classes.sum(1) - self.classes[:, CLASSES.index("blank")]

        split = pc.ascii_split_whitespace(texts)
        words, owner = split.flatten(), np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(words.filter(pa.array(real)))
        #: distinct words, the number of each word's entry there, and its text
        self.vocabulary: pa.Array = coded.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = owner[real]
        self.n_words = np.bincount(self.owner, minlength=n)

        lines = pc.split_pattern(texts, "\n")
        line, of = lines.flatten(), np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
        full = pc.not_equal(pc.ascii_trim_whitespace(line), "").to_numpy(zero_copy_only=False)
        number = pc.dictionary_encode(line).indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
        of = of[full]
        self.n_lines = np.bincount(of, minlength=n)
        first = np.unique(of * (len(line) + 1) + number) // (len(line) + 1)
        self.n_dup_lines = self.n_lines - np.bincount(first, minlength=n)

    def n_repeat_words(self, window: int = WINDOW) -> np.ndarray:
        """Words in windows that occur twice or more in their text, the first time included."""
        w, owner = self.word, self.owner
        m = len(w) - window + 1
        if m <= 0:
            return np.zeros(self.n, np.int64)
        h = owner[:m].astype(np.uint64)
        with np.errstate(over="ignore"):
            for i in range(window):
                h = (h ^ w[i : i + m].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        at = np.flatnonzero(owner[:m] == owner[window - 1 :])
        at = at[np.argsort(h[at], kind="stable")]
        a, b = at[:-1], at[1:]
        same = (h[a] == h[b]) & (owner[a] == owner[b])
        near = np.flatnonzero(same)
        # Equal hashes are looked at word by word.
        for i in range(window):
            near = near[w[a[near] + i] == w[b[near] + i]]
        covered = np.zeros(len(w) + 1, np.int64)
        found = np.unique(np.concatenate([a[near], b[near]]))
        np.add.at(covered, found, 1)
        np.add.at(covered, found + window, -1)
        return np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=self.n)
