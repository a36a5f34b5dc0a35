"""Quality rules by distribution divergence.

A document's histogram of character classes, and that of its common words, are compared with
the references of its language by the Jensen-Shannon distance. The references are counted over
all documents of the table. A document too short for a fair comparison is not judged by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.frames import filter_texts, map_texts
from runledger.llm.textstats import CLASSES, TextStats
from runledger.session import materialised, temporary_tables

COMMON_WORDS = 48
#: A language with fewer words in all has no reference, as its shares would be chance; and no more references than this, those of most words.
MIN_REFERENCE_WORDS = 2000
MAX_REFERENCES = 10_000
#: Base rules, see the contract of the query.
BASE_WORDS = 10
BASE_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Limits:
    """Greatest distances, and the guards: characters without blanks, and words, that a text needs to be compared."""

    max_class: float = 0.29
    max_word: float = 0.47
    min_chars: int = 200
    min_words: int = 60


@dataclass
class References:
    """Per language: shares of character classes, common words, and shares of these words and of all others (last)."""

    langs: list[str]
    classes: np.ndarray
    words: list[list[str]]
    shares: list[np.ndarray]


def references(docs: DataFrame, common_words: int = COMMON_WORDS, min_words: int = MIN_REFERENCE_WORDS) -> References:
    """Count all documents with a language; a language of ``min_words`` words or more gets a reference.

    Words count in lower case. The result has at most MAX_REFERENCES * (common_words + classes) numbers, however many values of
    ``lang`` there are. Documents of a language without a reference are not judged by distance.
    """
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = TextStats(batch.column(0))
        lang = pc.dictionary_encode(batch.column(1))
        code, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary
        size = len(stats.vocabulary)
        pairs, n = np.unique(code[stats.owner] * size + stats.word, return_counts=True)
        of, k = np.divmod(pairs, max(size, 1))
        by_class = np.zeros((len(names), len(CLASSES)), np.int64)
        np.add.at(by_class, code, stats.classes)
        langs = pa.concat_arrays([names.take(pa.array(of)), names.take(pa.array(np.repeat(np.arange(len(names)), len(CLASSES))))])
        keys = pa.concat_arrays([pc.utf8_lower(stats.vocabulary.take(pa.array(k))), pa.array(list(CLASSES) * len(names), stats.vocabulary.type)])
        kind = np.repeat([1, 0], [len(k), by_class.size])
        return pa.RecordBatch.from_arrays(
            [langs, pa.array(kind, pa.int32()), keys, pa.array(np.concatenate([n, by_class.ravel()]), pa.int64())], ["lang", "kind", "key", "n"])

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    with temporary_tables(docs.sparkSession):
        counts = materialised(map_texts(known, count, "lang string, kind int, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
        rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
        per = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
        enough = per.where((F.col("kind") == 1) & (F.col("total") >= min_words)).orderBy(F.desc("total"), "lang").limit(MAX_REFERENCES).select("lang")
        top = counts.join(enough, "lang", "left_semi").withColumn("_rank", rank).where(F.col("_rank") <= common_words)
        rows = top.join(per, ["lang", "kind"]).collect()
    words: dict[str, list] = {}
    classes: dict[str, dict] = {}
    for r in rows:
        if r["kind"] == 1:
            words.setdefault(r["lang"], []).append((r["_rank"], r["key"], r["n"] / r["total"]))
        else:
            classes.setdefault(r["lang"], {})[r["key"]] = r["n"] / max(1, r["total"])
    size = {r["lang"]: r["total"] for r in rows if r["kind"] == 1}
    langs = sorted(size)
    ordered = {x: sorted(words[x]) for x in langs}
    shares = [np.array([s for _, _, s in ordered[x]]) for x in langs]
    return References(
        langs, np.array([[classes[x].get(c, 0.0) for c in CLASSES] for x in langs]).reshape(len(langs), len(CLASSES)),
        [[w for _, w, _ in ordered[x]] for x in langs], [np.append(s, max(0.0, 1 - s.sum())) for s in shares])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, 0 to 1, of each row of ``p`` (shares) to ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def distances(stats: TextStats, refs: References, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of character classes and of common words of each text to the reference of number ``lang``; where that is -1, to the
    reference for which they are the least together."""
    by_class, by_word = np.full(stats.n, 2.0), np.full(stats.n, 2.0)
    vocabulary = pc.utf8_lower(stats.vocabulary)
    for j in range(len(refs.langs)) if (lang < 0).any() else np.unique(lang[lang < len(refs.langs)]).tolist():
        at = np.flatnonzero((lang == j) | (lang < 0))
        a = js_distance(stats.classes[at] / np.maximum(stats.classes[at].sum(1), 1)[:, None], refs.classes[j])
        k = len(refs.words[j])
        place = pc.fill_null(pc.index_in(vocabulary, pa.array(refs.words[j], vocabulary.type)), k).to_numpy(zero_copy_only=False)
        number = np.full(stats.n, -1)
        number[at] = np.arange(len(at))
        mine = number[stats.owner] >= 0
        hist = np.bincount(number[stats.owner[mine]] * (k + 1) + place[stats.word[mine]], minlength=len(at) * (k + 1)).reshape(len(at), k + 1)
        b = js_distance(hist / np.maximum(stats.n_words[at], 1)[:, None], refs.shares[j])
        nearer = (a + b) < by_class[at] + by_word[at]
        by_class[at[nearer]], by_word[at[nearer]] = a[nearer], b[nearer]
    return by_class, by_word


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _verdicts(batch: pa.RecordBatch, refs: References, limits: Limits) -> list[pa.Array]:
    """The arrays of COLUMNS."""
    stats = TextStats(batch.column(batch.schema.get_field_index("text")))
    repeat = stats.n_repeat_words()
    failed = (stats.n_words < BASE_WORDS) | (100 * repeat > BASE_REPEAT_PERCENT * stats.n_words)
    lang = batch.column(batch.schema.get_field_index("lang")).cast(pa.string())
    own = pc.fill_null(pc.index_in(lang, pa.array(refs.langs, pa.string())), -2).to_numpy(zero_copy_only=False)
    own = np.where(lang.is_null().to_numpy(zero_copy_only=False), -1, own)
    judged = (own > -2) & bool(refs.langs)
    by_class, by_word = distances(stats, refs, np.where(judged, own, len(refs.langs)))
    no_class = ~judged | (stats.word_chars < limits.min_chars)
    no_word = ~judged | (stats.n_words < limits.min_words)
    kept = ~failed & (no_class | (by_class <= limits.max_class)) & (no_word | (by_word <= limits.max_word))
    counts = [stats.n_words, stats.word_chars, stats.n_symbols, stats.n_dup_lines, repeat]
    return [pa.array(x, pa.int64()) for x in counts] + [
        pa.array(failed), pa.array(kept), pa.array(by_class, mask=no_class), pa.array(by_word, mask=no_word)]


def judge(docs: DataFrame, refs: References, limits: Limits = Limits()) -> DataFrame:
    """doc_id and COLUMNS of every row.

    A document is compared with its own language's reference, or, where that is null, with the nearest.
    A distance is null where the text is too short for it or its language has no reference; then it rejects nothing.
    A null text has no words, so it fails the base rules. Repeated rows stay; extra columns are ignored.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *_verdicts(batch, refs, limits)], ["doc_id", *COLUMNS])

    return map_texts(docs.select("doc_id", "text", "lang"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def accepted(docs: DataFrame, refs: References, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns."""
    return filter_texts(docs, lambda batch: _verdicts(batch, refs, limits)[COLUMNS.index("kept")])
