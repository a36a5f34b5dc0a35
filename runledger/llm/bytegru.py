"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, labels every position and is trained in
numpy by backpropagation through time on a bounded sample. All bytes of every text are read;
a document's probabilities are the mean over its letter positions.

Arrays are feature-major: the last axis runs over the windows of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.frames import filter_texts, map_texts
from runledger.session import materialised

WINDOW = 64
HIDDEN = 6
#: The training sample has about this many documents of a language, and this many characters of each at most.
SAMPLE_DOCS = 500
SAMPLE_CHARS = 1024
#: Documents of the sample in all; where there are more languages than give each SAMPLE_DOCS, each gets fewer.
SAMPLE_TOTAL = 32_000
STEPS = 500
BATCH = 256
UNKNOWN = "und"
#: ``accepted`` drops what the network cannot tell. A text of two languages in equal parts has about 0.5.
MIN_SCORE = 0.4
#: Windows that run through the network together: small enough for a core's cache.
LANES = 2048

#: 1 for bytes that are, or are part of, a letter in UTF-8; other scripts' punctuation counts too, which does no harm.
LETTER = np.zeros(256, np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def windows(raw: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as windows x size, bytes in each window, the text of each window). Every byte is in one window."""
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    per = -(-lengths // size)
    owner = np.repeat(np.arange(len(raw)), per)
    index = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    used = np.minimum(size, lengths[owner] - index * size)
    flat = np.frombuffer(b"".join(raw) + bytes(size), np.uint8)
    start = (np.cumsum(lengths) - lengths)[owner] + index * size
    x = flat[start[:, None] + np.arange(size)]
    x[np.arange(size) >= used[:, None]] = 0
    return x, used, owner


@dataclass
class ByteGru:
    """Parameters p: for each direction d a table of input weights x[d] (3H, 256), recurrent weights u[d] (3H, H),
    a bias c[d] (H, 1) of the candidate, output weights o[d] (K, H); and the output bias b (K, 1)."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> ByteGru:
        rng = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {"b": np.zeros((len(langs), 1))}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.2, (3 * hidden, 256))
            p["x" + d][: 2 * hidden] += 0.5
            p["u" + d] = rng.normal(0, 0.7 * hidden**-0.5, (3 * hidden, hidden))
            p["c" + d] = np.zeros((hidden, 1))
            p["o" + d] = rng.normal(0, hidden**-0.5, (len(langs), hidden))
        return cls(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def _step(self, d: str, x: np.ndarray, h: np.ndarray, keep: list | None) -> np.ndarray:
        """One position: update gate z, reset gate r, candidate n; the new state is n + z (h - n).

        Gates and candidate are piecewise linear, cut off at 0 and 1, and at -1 and 1: several times
        as fast as the logistic curve and the hyperbolic tangent.
        """
        p, k = self.p, h.shape[0]
        a = np.take(p["x" + d], x, axis=1, mode="clip")
        g = p["u" + d] @ h
        a[: 2 * k] += g[: 2 * k]
        np.clip(a[: 2 * k], 0, 1, out=a[: 2 * k])
        z, r, n = a[:k], a[k : 2 * k], a[2 * k :]
        m = g[2 * k :]
        m += p["c" + d]
        n += r * m
        np.clip(n, -1, 1, out=n)
        new = h - n
        new *= z
        new += n
        if keep is not None:
            keep.append((x, h, z, r, n, m))
        return new

    def _run(self, d: str, x: np.ndarray, live: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States (T, H, B) of one direction; x is (T, B). Padding leaves the state as it is."""
        k = self.p["u" + d].shape[1]
        h = np.zeros((k, x.shape[1]), np.float32)
        out = np.empty((len(x), k, x.shape[1]), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            new = self._step(d, x[t], h, keep)
            if live is not None and not live[t].all():
                new = np.where(live[t], new, h)
            h = out[t] = new
        return out

    def probabilities(self, x: np.ndarray, used: np.ndarray) -> np.ndarray:
        """(T, K, B) label probabilities of every position; x is (T, B)."""
        live = np.arange(len(x))[:, None] < used
        full = bool(live.all())
        logits = self.p["of"] @ self._run("f", x, None if full else live)
        logits += self.p["ob"] @ self._run("b", x, None if full else live)
        logits += self.p["b"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    # --- training ---

    def gradients(self, x: np.ndarray, used: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions and its gradients, by backpropagation through time."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        live = np.arange(len(x))[:, None] < used
        tape: dict[str, list] = {"f": [], "b": []}
        h = {d: self._run(d, x, live, tape[d]) for d in "fb"}
        logits = p["of"] @ h["f"] + p["ob"] @ h["b"] + p["b"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        total = live.sum()
        loss = -float((np.log(np.maximum(prob[:, y, np.arange(len(y))], 1e-9)) * live).sum() / total)
        prob[:, y, np.arange(len(y))] -= 1
        delta = prob * (live[:, None] / np.float32(total))
        g["b"] = delta.sum((0, 2))[:, None]
        for d in "fb":
            k = p["u" + d].shape[1]
            g["o" + d] = np.einsum("tkb,thb->kh", delta, h[d], optimize=True)
            back = np.zeros_like(h[d][0])
            steps = list(range(len(x))) if d == "f" else list(range(len(x) - 1, -1, -1))
            for t, (xt, prev, z, r, n, m) in zip(reversed(steps), reversed(tape[d])):
                dh = back + p["o" + d].T @ delta[t]
                dh_live = dh * live[t]
                dn = dh_live * (1 - z) * (abs(n) < 1)
                dz = dh_live * (prev - n) * ((z > 0) & (z < 1))
                dr = dn * m * ((r > 0) & (r < 1))
                dm = dn * r
                da = np.concatenate([dz, dr, dn])
                dg = np.concatenate([dz, dr, dm])
                for row in range(3 * k):
                    g["x" + d][row] += np.bincount(xt, da[row], 256).astype(np.float32)
                g["u" + d] += dg @ prev.T
                g["c" + d] += dm.sum(1, keepdims=True)
                back = np.where(live[t], dh * z + p["u" + d].T @ dg, dh)
        return loss, g

    def train(self, x: np.ndarray, used: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam over random batches of windows x (N, T) with labels y; the losses."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses = []
        for i in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            loss, g = self.gradients(np.ascontiguousarray(x[at].T), used[at], y[at])
            losses.append(loss)
            lr = rate * min(1.0, 2.0 * (1 - i / (steps + 1)))
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return losses

    # --- documents ---

    def pooled(self, raw: list[bytes], runs: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int, str]]]]:
        """Mean label probabilities of each text's letter positions (texts x langs; zeros where there is no letter),
        and, on request, runs (first byte, bytes, language) of equal labels."""
        x, used, owner = windows(raw)
        sums, letters = np.zeros((len(raw), len(self.langs))), np.zeros(len(raw))
        labels = np.zeros(x.shape, np.int16) if runs else None
        for a in range(0, len(x), LANES):
            part, u = np.ascontiguousarray(x[a : a + LANES].T), used[a : a + LANES]
            prob = self.probabilities(part, u)
            # Padding is the byte 0, which is no letter.
            weight = LETTER[part]
            np.add.at(sums, owner[a : a + LANES], np.einsum("tkb,tb->bk", prob, weight))
            np.add.at(letters, owner[a : a + LANES], weight.sum(0))
            if runs:
                labels[a : a + LANES] = prob.argmax(1).T
        found: list[list[tuple[int, int, str]]] = []
        if runs:
            ends = np.searchsorted(owner, np.arange(len(raw)), "right")
            for i, text in enumerate(raw):
                row = labels[ends[i - 1] if i else 0 : ends[i]].ravel()[: len(text)]
                cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)] if len(row) else []
                found.append([(s, e - s, self.langs[row[s]]) for s, e in zip(cuts, cuts[1:])])
        return sums / np.maximum(letters, 1)[:, None], found


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, steps: int = STEPS) -> ByteGru | None:
    """Train on a sample of the labelled documents that are not held out; None when there are none.

    The sample is ``sample_docs`` documents of each language by hash of doc_id and text, and ``sample_chars`` characters of each
    from a hashed start, but no more than SAMPLE_TOTAL documents in all. Counts of the languages are taken over all rows, and every
    language has its part of the sample; only where there are more languages than SAMPLE_TOTAL, some have none.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = materialised(known.groupBy("lang").agg(F.count("*").alias("_n")))
    n_langs = counts.count()
    if not n_langs:
        return None
    each = max(1, min(sample_docs, SAMPLE_TOTAL // n_langs))
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64("doc_id", F.lit("start"), "text"), F.greatest(F.length("text") - sample_chars, F.lit(1))).cast("int") + 1
    drawn = known.join(counts, "lang").where(unit <= F.least(F.lit(1.0), F.lit(1.5 * each + 8) / F.col("_n")))
    drawn = drawn.select("lang", F.substring(F.col("text"), start, F.lit(sample_chars)).alias("text"), unit.alias("u"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    rows = drawn.withColumn("_nth", nth).where(F.col("_nth") <= each).orderBy("_nth", "lang").limit(SAMPLE_TOTAL).collect()
    by: dict[str, list[bytes]] = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r["text"].encode())
    langs = sorted(by)
    if not langs:
        return None
    x, used, y = [], [], []
    for i, lang in enumerate(langs):
        a, u, _ = windows(by[lang])
        x.append(a)
        used.append(u)
        y.append(np.full(len(a), i))
    # Languages weigh the same in training.
    most = max(map(len, y))
    pick = [np.resize(np.random.default_rng(3).permutation(len(a)), most) for a in y if len(a)]
    full = [i for i, a in enumerate(y) if len(a)]
    model = ByteGru.fresh(langs)
    model.train(
        np.concatenate([x[i][q] for i, q in zip(full, pick)]), np.concatenate([used[i][q] for i, q in zip(full, pick)]),
        np.concatenate([y[i][q] for i, q in zip(full, pick)]), steps)
    return model


def labelled(texts: list[str | None], model: ByteGru | None, runs: bool = False) -> tuple[list[str], list[float], list[list]]:
    """Language, score and, on request, runs of each text."""
    lang, score, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
    if at:
        prob, found = model.pooled([texts[i].encode() for i in at], runs)
        for j, i in enumerate(at):
            best = int(prob[j].argmax())
            lang[i], score[i] = model.langs[best], min(1.0, float(prob[j, best]))
            if runs:
                spans[i] = found[j]
    return lang, score, spans


def accepted(docs: DataFrame, model: ByteGru | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``; without a model, all rows."""
    def keep(batch: pa.RecordBatch) -> pa.Array:
        lang, score, _ = labelled(batch.column(batch.schema.get_field_index("text")).to_pylist(), model)
        return pa.array([x != UNKNOWN and s >= min_score for x, s in zip(lang, score)], pa.bool_())

    return filter_texts(docs, keep) if model else docs


def predict(docs: DataFrame, model: ByteGru | None, runs: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every row, from the whole text alone; with ``runs`` also the labelled byte ranges.

    A text that is null or has no letter gets ``und`` and score 0, as does every text when there is no model. Repeated rows stay.
    """
    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, spans = labelled(batch.column(1).to_pylist(), model, runs)
        cols = [batch.column(0), pa.array(lang), pa.array(score, pa.float64())]
        if runs:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())]))
            cols.append(pa.array([[dict(zip(("start", "length", "lang"), s)) for s in r] for r in spans], kind))
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "runs"][: len(cols)])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    schema += ", runs array<struct<start:long,length:long,lang:string>>" if runs else ""
    return map_texts(docs.select("doc_id", "text"), label, schema)
