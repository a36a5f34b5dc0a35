"""Token ids of whole texts by the tokenizers library, one library call per distinct word and worker.

The word tokenizer drops white space and never merges across it, so a text may be cut at blanks.
"""

from __future__ import annotations

import functools
import os
from array import array

from runledger.llm.speculativebpe import byte_names

#: Words a worker remembers; when full, the memory starts anew. It changes the speed only.
MEMORY = 600_000
LONG_WORD = 64
MARKS = ".,;:!?"


class WordTokens:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._lib.no_truncation()
        self._lib.no_padding()
        self._special = [t.content for t in self._lib.get_added_tokens_decoder().values()]
        self._known: dict[str, bytes] = {"": b""}
        # The model knows bytes beyond ASCII by the characters that stand for them in vocabulary files.
        self._shown = {b: c for c, b in byte_names().items()}
        self._marks = dict(zip(MARKS, self._encoded(list(MARKS))))

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str], known: dict[str, bytes]) -> None:
        """Ids of new words. Letters and one mark after them are never merged, and capitals are made small, so such
        a word needs only the ids of its letters: these the library's model gives, without its other steps."""
        rest, tokenize, shown = [], self._lib.model.tokenize, self._shown
        for w in words:
            mark = w[-1] if w[-1] in MARKS else ""
            stem = w[:-1] if mark else w
            if not stem.isalpha() or not (stem.isascii() or max(stem) <= "\xff"):
                rest.append(w)
                continue
            stem = stem.lower()
            if (ids := known.get(stem)) is None:
                name = stem if stem.isascii() else stem.encode().decode("latin-1").translate(shown)
                ids = known[stem] = array("I", [t.id for t in tokenize(name)]).tobytes()
            known[w] = ids + self._marks[mark] if mark else ids
        known.update(zip(rest, self._encoded(rest)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Unsigned 32-bit ids, in the byte order of the machine (little-endian on all that Spark runs on), of each text; null counts as empty."""
        words = []
        for text in texts:
            text = text or ""
            # A special token may stand anywhere, also with blanks inside; such a text goes to the library whole.
            words.append(None if any(s in text for s in self._special) else text.replace("\n", " ").replace("\t", " ").split(" "))
        known = self._known
        new: set[str] = set()
        for w in words:
            if w is not None:
                new.update(x for x in w if x not in known)
        long = {x for x in new if len(x) > LONG_WORD}
        new -= long
        if len(known) + len(new) > MEMORY:
            known = self._known = {"": b""}
            new = {x for w in words if w is not None for x in w if x and len(x) <= LONG_WORD}
        self._learn(new, known)
        here = dict(zip(long, self._encoded(list(long))))
        out = []
        for text, w in zip(texts, words):
            if w is None:
                out.append(self._encoded([text])[0])
            elif long:
                out.append(b"".join([here[x] if x in here else known[x] for x in w]))
            else:
                out.append(b"".join(map(known.__getitem__, w)))
        return out


@functools.lru_cache(2)
def word_tokens(path: str) -> WordTokens:
    """One instance per worker process and file."""
    return WordTokens(path)
