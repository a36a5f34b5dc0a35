"""Quality classification from weak labels.

Overlapping heuristics vote good, bad or abstain. Expectation-maximisation over the counts of vote patterns, a table
of bounded size, estimates how each heuristic votes on good and on bad documents, without any label. The posterior of
its pattern, that of the whole text, is a document's label; on a bounded sample these labels train a linear scorer over hashed
byte trigrams, which then scores every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.frames import map_texts
from runledger.llm.textstats import CLASSES, TextStats
from runledger.session import materialised

ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("length", "symbols", "repeats", "copied_lines", "capitals", "word_length", "short_words", "shouting", "bare_marks", "odd_ends", "stutter")
ENDS = ".,;:!?'\")"
#: What a labeller is taken for before any data: shares of abstention, bad and good votes on bad and on good documents,
#: and the weight of that against the table's documents. It keeps the two classes apart where bad documents are of several
#: kinds, each seen by other labellers.
BELIEF = ((0.3, 0.35, 0.35), (0.2, 0.01, 0.79))
BELIEF_WEIGHT = 0.5
BUCKETS = 1 << 13
#: Documents of the training sample, and characters of each that train, from a hashed start. Scoring reads all documents and all bytes.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 4096
ITERATIONS = 300


def _vote(value: np.ndarray, good: tuple[float, float], bad_below: float, bad_above: float) -> np.ndarray:
    out = np.full(len(value), ABSTAIN, np.int8)
    out[(value >= good[0]) & (value <= good[1])] = GOOD
    out[(value < bad_below) | (value > bad_above)] = BAD
    return out


def votes(stats: TextStats) -> np.ndarray:
    """(texts x LABELLERS) votes. A text without words gets bad from ``length`` and abstentions otherwise."""
    n = np.maximum(stats.n_words, 1)
    c = {name: stats.classes[:, i] for i, name in enumerate(CLASSES)}
    letters = np.maximum(c["lower"] + c["upper"], 1)
    vocabulary = stats.vocabulary.to_pylist()
    share = lambda test: np.bincount(stats.owner, np.array([test(w) for w in vocabulary], bool)[stats.word], minlength=stats.n) / n
    again = np.flatnonzero((stats.word[1:] == stats.word[:-1]) & (stats.owner[1:] == stats.owner[:-1])) + 1
    inf = float("inf")
    out = np.stack([
        _vote(stats.n_words, (80, 20000), 20, inf), _vote(stats.n_symbols / n, (0, 0.02), -inf, 0.15),
        _vote(stats.n_repeat_words() / n, (0, 0.03), -inf, 0.2), _vote(stats.n_dup_lines / np.maximum(stats.n_lines, 1), (0, 0.0), -inf, 0.3),
        _vote(c["upper"] / letters, (0.005, 0.08), -inf, 0.3), _vote(stats.word_chars / n, (3.5, 7.5), 2.5, 11),
        _vote(share(lambda w: len(w) <= 3), (0.15, 0.6), 0.06, 0.85),
        _vote(share(lambda w: w.endswith("!!") or (len(w) > 2 and w.isupper())), (0, 0.02), -inf, 0.2),
        _vote(share(lambda w: not any(map(str.isalnum, w))), (0, 0.02), -inf, 0.15),
        _vote(share(lambda w: not (w[-1].isalnum() or w[-1] in ENDS)), (0, 0.02), -inf, 0.15),
        _vote(np.bincount(stats.owner[again], minlength=stats.n) / n, (0, 0.02), -inf, 0.2)], 1)
    out[stats.n_words == 0, 1:] = ABSTAIN
    return out


def _code(v: np.ndarray) -> np.ndarray:
    """A pattern of votes as one number, three values for each labeller."""
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(1)


@dataclass
class VoteModel:
    """Share of good documents, and for each labeller the shares of its votes on bad and good ones (labellers x 2 x 3)."""

    prior: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        at = np.arange(v.shape[1])
        logs = np.log(self.table)
        good = np.log(self.prior) + logs[at, 1, v].sum(1)
        bad = np.log1p(-self.prior) + logs[at, 0, v].sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Estimated share of right votes among a labeller's votes that are none of abstention."""
        w = np.array([1 - self.prior, self.prior])
        right = self.table[:, 0, BAD] * w[0] + self.table[:, 1, GOOD] * w[1]
        given = ((self.table[:, :, BAD] + self.table[:, :, GOOD]) * w).sum(1)
        return dict(zip(LABELLERS, (right / np.maximum(given, 1e-12)).tolist()))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, weight: float = BELIEF_WEIGHT) -> VoteModel:
    """Fit to patterns (rows of votes) and how often each occurs; it starts from the majority of each pattern's votes."""
    lead = (patterns == GOOD).sum(1) - (patterns == BAD).sum(1)
    q = 1 / (1 + np.exp(-(lead - 2.0)))
    one_hot = np.eye(3)[patterns]
    belief = np.array(BELIEF) * (1 + weight * counts.sum() * np.array([[0.1], [0.9]]))
    model = VoteModel(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        w = np.stack([counts * (1 - q), counts * q])
        table = np.einsum("cp,plv->lcv", w, one_hot) + belief
        table /= table.sum(2, keepdims=True)
        model = VoteModel(float(np.clip(w[1].sum() / max(w.sum(), 1e-12), 1e-3, 1 - 1e-3)), table)
        new = model.posterior(patterns)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return model


def _buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two."""
    x = data.astype(np.uint32)
    code = x[:-2] | (x[1:-1] << 8) | (x[2:] << 16)
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class LinearScorer:
    """Logistic regression on the shares of hashed byte trigrams."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of good of whole texts; a text shorter than three bytes, or null, has the bias alone."""
        raw = [(t or "").encode() for t in texts]
        out = np.zeros(len(raw))
        for i, r in enumerate(raw):
            if len(r) > 2:
                out[i] = self.weights[_buckets(np.frombuffer(r, np.uint8))].mean()
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def train_scorer(texts: list[str], labels: np.ndarray, iterations: int = ITERATIONS, rate: float = 0.05, decay: float = 1e-4) -> LinearScorer:
    """Fit to soft labels (probability of good) by full-batch Adam; both classes weigh the same."""
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        r = np.frombuffer(t.encode(), np.uint8)
        if len(r) > 2:
            x[i] = np.bincount(_buckets(r), minlength=BUCKETS) / (len(r) - 2)
    scale = 1 / (x.std(0) + 1e-3)
    x *= scale
    y = labels.astype(np.float32)
    weight = np.where(y >= 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    w, b = np.zeros(BUCKETS, np.float32), np.float32(0)
    m = v = np.zeros(BUCKETS + 1, np.float32)
    for i in range(1, iterations + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
        e = (p - y) * weight
        g = np.append(x.T @ e + decay * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return LinearScorer((w * scale).astype(np.float32), float(b))


def classify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, votes (one letter for each labeller: b, g or -), posterior, score, good (score of 0.5 or more) of every row.

    Null and empty texts count as texts without words. Repeated rows stay; an empty table gives no rows.
    """
    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = _code(votes(TextStats(batch.column(1))))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], ["doc_id", "pattern"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    counted = materialised(map_texts(rows, vote, f"doc_id {kind}, pattern long").groupBy("pattern").count())
    # At most 3 ** len(LABELLERS) patterns, whatever the number of documents.
    found = counted.collect()
    n = len(LABELLERS)
    codes, counts = np.array([r[0] for r in found], np.int64).reshape(-1), np.array([r[1] for r in found], float)
    patterns = (codes[:, None] // 3 ** np.arange(n)) % 3
    model = expectation_maximisation(patterns, counts)

    share = min(1.0, sample_docs / max(1.0, counts.sum()))
    unit = F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # The votes are those on the whole text; of a long one as many characters train as the sample takes, from a hashed start.
    start = F.pmod(F.xxhash64(F.lit("start"), "doc_id", "text"), F.greatest(F.char_length("text") - sample_chars + 1, F.lit(1))).cast("int")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = _code(votes(TextStats(batch.column(1))))
        parts = [t[i : i + sample_chars] for t, i in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(parts, pa.string()), pa.array(codes, pa.int64())], ["doc_id", "unit", "text", "pattern"])

    sample = rows.where((unit < share) & (F.length("text") > 0)).select("doc_id", "text", unit.alias("unit"), start.alias("start"))
    sample = map_texts(sample, cut, f"doc_id {kind}, unit double, text string, pattern long").orderBy("unit", "doc_id").limit(2 * sample_docs)
    taken = sample.select("text", "pattern").collect()
    if not taken:  # few rows, or rows that are all alike: those of the smallest hashes
        rest = rows.where(F.length("text") > 0).select("doc_id", "text", unit.alias("unit"), start.alias("start")).orderBy("unit", "doc_id").limit(sample_docs)
        taken = map_texts(rest, cut, f"doc_id {kind}, unit double, text string, pattern long").select("text", "pattern").collect()
    texts = [r["text"] for r in taken]
    own = np.array([r["pattern"] for r in taken], np.int64).reshape(-1)
    labels = model.posterior((own[:, None] // 3 ** np.arange(n)) % 3)
    scorer = train_scorer(texts, labels) if texts else LinearScorer(np.zeros(BUCKETS, np.float32), 0.0)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = votes(TextStats(batch.column(1)))
        s = scorer.score(batch.column(1).to_pylist())
        text = np.array(list("-bg"))[v]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(["".join(x) for x in text], pa.string()), pa.array(model.posterior(v), pa.float64()), pa.array(s, pa.float64()),
             pa.array(s >= 0.5, pa.bool_())], ["doc_id", "votes", "posterior", "score", "good"])

    return map_texts(rows, score, f"doc_id {kind}, votes string, posterior double, score double, good boolean")
