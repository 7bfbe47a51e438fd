"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage becomes features: hashed character trigrams, and how its words look,
repeat in it and repeat in the document. An encoder turns these into a representation, gated attention, learned from
the documents' labels alone, weighs the passages, and the score is that of the weighted sum of representations. The
model is trained on a bounded sample and small; all documents are scored where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, table
from .language import held_out
from .tokens import balanced

#: Parameters of the bounded training sample: documents of each label, those with the smallest hashes, and passages of
#: each document, evenly spaced over it.
TRAIN_DOCS, TRAIN_PASSAGES = 1500, 24
#: Parameters: words of a passage, trigram buckets, widths of the encoder and of the attention, passes over the sample,
#: documents a step, the rate and decay of learning, bytes of texts handled together.
WORDS, BUCKETS, WIDTH, GATE, EPOCHS, STEP, RATE, DECAY, BATCH_BYTES = 64, 192, 24, 12, 24, 64, 0.01, 1e-4, 1 << 20
#: Score from which on a document is predicted as good.
LIMIT = 0.3
_LOOKS = 16
_MIX, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def _white() -> np.ndarray:
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    return white


_WHITE = _white()


def _kinds() -> np.ndarray:
    """By byte: 0 white, 1 lower case, 2 upper case, 3 digit, 4 other ASCII, 5 part of another character."""
    kind = np.full(256, 4, np.uint8)
    kind[_WHITE], kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 3, 5
    return kind


_KIND = _kinds()


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs earlier."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages x BUCKETS + _LOOKS) of texts cut every WORDS words, whatever their length, and by text the first
    passage, with the end of the last. A text without words is one passage of zeros."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_end = np.cumsum(sizes) + 1
    word_byte = ~_WHITE[raw]
    edge = np.diff(word_byte.view(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(text_end, start, "right")
    n_words = np.bincount(doc, minlength=len(texts))
    first_word = np.cumsum(n_words) - n_words
    n_passages = np.maximum(1, -(-n_words // WORDS))
    first = np.concatenate(([0], np.cumsum(n_passages)))
    of = first[doc] + (np.arange(len(start)) - first_word[doc]) // WORDS
    n, count = int(first[-1]), np.maximum(1, np.bincount(of, minlength=int(first[-1])))

    def share(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, n) / count

    # A word's hash is a sum over its bytes and their places, from running sums.
    here = np.arange(len(raw))
    place = here - np.maximum.accumulate(np.where(edge[: len(raw)] == 1, here, 0))
    code = (raw.astype(np.uint64) + np.uint64(1)) * _MIX + place.astype(np.uint64) * _ODD
    code ^= code >> np.uint64(31)
    code *= _MIX
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * word_byte)))
    word = run[stop] - run[start]
    kind = _KIND[raw]
    sums = [np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2, 3, 4, 5)]
    lower, upper, digit, other, high = (s[stop] - s[start] for s in sums)
    length = stop - start
    here = _repeats(word * _ODD + of.astype(np.uint64))
    next_to = np.concatenate(([False], (word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))) if len(word) else np.zeros(0, bool)
    three = np.zeros(len(word), bool)
    if len(word) > 2:
        key = word[:-2] + word[1:-1] * _MIX + word[2:] * _ODD + doc[:-2].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        three[2:] = _repeats(key) & (doc[2:] == doc[:-2])
    single, last = other == length, _KIND[raw[stop - 1]] == 4 if len(stop) else np.zeros(0, bool)
    line = np.concatenate(([0], np.cumsum(raw == 10)))
    breaks = (line[stop + 1] - line[stop]) > 0 if len(stop) else np.zeros(0, bool)
    looks = [length, np.log1p(length), lower > 0, upper == length, upper == 1, digit > 0, other > 0, single, last, other > 1, high > 0, here, next_to, three, breaks, np.ones(len(word))]
    shares = np.stack([share(x) for x in looks], 1)
    shares[:, 0] /= 8
    shares[:, -1] = np.log1p(np.bincount(of, minlength=n)) / math.log(WORDS + 1)
    # Trigrams of a passage: from its first word's start to the next passage's; white space is one byte.
    at = np.full(len(raw), -1, np.int64)
    if len(start):
        at[start[0] :] = np.repeat(of, np.diff(np.append(start, len(raw))))
    even = np.where(word_byte, raw, 32).astype(np.uint32)
    gram = (even[:-2] * np.uint32(2654435761) ^ even[1:-1] * np.uint32(2246822519) ^ even[2:] * np.uint32(3266489917)) if len(raw) > 2 else np.zeros(0, np.uint32)
    gram ^= gram >> np.uint32(15)
    bucket = ((gram * np.uint32(668265263)) >> np.uint32(8)) % np.uint32(BUCKETS)
    own = at[1 : len(gram) + 1]
    fit = (own >= 0) & word_byte[1 : len(gram) + 1]
    counts = np.bincount(own[fit] * BUCKETS + bucket[fit], minlength=n * BUCKETS).reshape(n, BUCKETS)
    grams = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    return np.concatenate((grams, shares), 1).astype(np.float32), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Bags:
    """The model: an encoder W, b; attention V, U, w; a scorer c, d; and the features' mean and scale."""

    def __init__(self, width: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.shift = np.zeros(width), np.ones(width), 0.0
        self.p = {"W": r.normal(0, width**-0.5, (width, WIDTH)), "b": np.zeros(WIDTH), "V": r.normal(0, WIDTH**-0.5, (WIDTH, GATE)), "U": r.normal(0, WIDTH**-0.5, (WIDTH, GATE)), "w": r.normal(0, GATE**-0.5, GATE), "c": r.normal(0, WIDTH**-0.5, WIDTH), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """Per bag its logit, per passage its attention, and what the gradient needs. first: by bag its first passage, and
        the end."""
        p, starts, n = self.p, first[:-1], np.diff(first)
        h = np.maximum(0, x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = np.exp(np.clip((t * s) @ p["w"], -30, 30))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(h * a[:, None], starts)
        return z @ p["c"] + p["d"], a, (h, t, s, z)

    def scores(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score per bag and attention per passage."""
        logit, a, _ = self.forward((x - self.mean) / self.scale, first)
        return _sigmoid(logit + self.shift), a

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        p, starts, n = self.p, first[:-1], np.diff(first)
        logit, a, (h, t, s, z) = self.forward(x, first)
        g = (_sigmoid(logit) - y) / len(y)
        gz = np.repeat(g, n)[:, None] * p["c"]
        ga = (h * gz).sum(1)
        ge = a * (ga - np.repeat(np.add.reduceat(a * ga, starts), n))
        gt, gs = ge[:, None] * p["w"] * s * (1 - t * t), ge[:, None] * p["w"] * t * s * (1 - s)
        gh = (a[:, None] * gz + gt @ p["V"].T + gs @ p["U"].T) * (h > 0)
        return {"W": x.T @ gh, "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ ge, "c": z.T @ g, "d": g.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, odds: float, seed: int = 7) -> None:
        """Learns from bags with labels y (0 to 1) in steps of Adam. odds: of label 1 in all rows over those in these."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x, r = (x - self.mean) / self.scale, np.random.default_rng(seed)
        m, v = ({name: np.zeros_like(w) for name, w in self.p.items()} for _ in range(2))
        k = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for i in range(0, len(y), STEP):
                bags = order[i : i + STEP]
                n = first[bags + 1] - first[bags]
                ends = np.concatenate(([0], np.cumsum(n)))
                rows = np.repeat(first[bags] - ends[:-1], n) + np.arange(ends[-1])
                k += 1
                for name, g in self.gradient(x[rows], ends, y[bags]).items():
                    g = g + DECAY * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - RATE * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)
        self.shift = math.log(odds)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) to (doc_id, label, features as bytes) of at most TRAIN_PASSAGES passages, evenly spaced."""
    for batch in batches:
        for i, j in balanced(pc.binary_length(batch.column(2)).fill_null(0).to_pylist(), BATCH_BYTES):
            x, first = passages([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).slice(i, j - i).to_pylist()])
            out = []
            for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
                rows = np.arange(a, b) if b - a <= TRAIN_PASSAGES else a + np.arange(TRAIN_PASSAGES) * (b - a) // TRAIN_PASSAGES
                out.append(x[rows].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(out, pa.binary())], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = TRAIN_DOCS) -> Bags | float | None:
    """A model of label (0 or 1) in labels (doc_id, label; the mean where a doc_id has several), from a sample of max_docs
    documents of each label, those with the smallest hash of the id; one row of a doc_id that docs has several times. None
    without labelled documents; their share of 1, smoothed, where all have one label. Null labels and ids teach nothing,
    empty texts as the others do."""
    importable(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("label")).withColumn("good", F.col("label") >= 0.5)
    # Ids that docs lacks would only shorten the sample.
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None if not counts else (counts.get(True, 0) + 1) / (sum(counts.values()) + 2)
    # A bounded number of ids.
    place = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    picked = known.filter("good").orderBy(*place).limit(max_docs).unionByName(known.filter("not good").orderBy(*place).limit(max_docs))
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(picked.select("doc_id", "label")), "doc_id").select(F.col("doc_id").cast("bigint"), "label", "text")
    found = rows.mapInArrow(_sampled, "doc_id bigint, label double, x binary").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("s")).select("s.*", "doc_id").orderBy("doc_id").collect()
    width = BUCKETS + _LOOKS
    x = [np.frombuffer(r["x"], np.float16).reshape(-1, width) for r in found]
    y = np.array([r["label"] for r in found])
    model = Bags(width)
    good = max(1, int((y >= 0.5).sum()))
    odds = (counts[True] / counts[False]) / (good / max(1, len(y) - good))
    model.fit(np.concatenate(x).astype(np.float64), np.concatenate(([0], np.cumsum([len(b) for b in x]))), y, odds)
    return model


def scored(docs: DataFrame, model: Bags | float | None) -> DataFrame:
    """Per document (repeated rows and null ids each keep a row): doc_id, score (0 to 1, six decimals), attention (of each
    passage, in order). Null texts count as empty, which is a passage without words; texts of any length give all their
    passages; an empty table gives no rows; other columns aren't read. Without a model the score is its number, 0.5 for
    None, and attention is even."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    importable(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("attention", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for i, j in balanced(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), BATCH_BYTES):
                x, first = passages([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).slice(i, j - i).to_pylist()])
                if isinstance(known, Bags):
                    score, a = known.scores(x, first)
                else:
                    score, a = np.full(j - i, 0.5 if known is None else known), np.repeat(1 / np.diff(first), np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.round(score, 6)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(a.astype(np.float32)))], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double, attention array<float>")


def op11_quality_attention(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from rows that aren't held out: doc_id, held_out, score, predicted. Edge
    cases are those of fit() and scored()."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
