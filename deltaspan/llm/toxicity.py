"""Toxicity by a factorization machine over hashed terms.

The score of a text is the logistic of w0 + sum of w_i + sum over pairs of <v_i, v_j> for the distinct terms i, j that
it holds: the vectors v give pairs of terms, such as an insult and a group, a weight that neither has alone. Terms are
lower-cased words, and the beginnings of words, hashed to buckets; the TERMS buckets that tell the labels apart best are kept. It is fitted by Adam
on a bounded sample of labelled rows, about SAMPLE_ROWS chosen by the hash of doc_id; what it has learnt is applied to
every whole text.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out: their labels are never read. Null texts have no terms and
score as the bias does; null labels and labels of documents that aren't there are left out; a null doc_id isn't held
out. Without labels of both kinds the score is the smoothed share of toxic labels. Repeated rows score alike; of repeated
ids one row is learnt from, once for each label that differs. A score of 0.5 is predicted toxic. An empty table gives an
empty result. Only doc_id and text are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled
from .kernels import Runs, chunks, mix, raw, words

BUCKETS = 1 << 18
TERMS = 4096
FACTORS = 8
#: Besides words, their first bytes are terms: rare forms of a word share them.
STEM = 5
SAMPLE_ROWS = 20_000
EPOCHS = 25


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, and the offset of each text's."""
    out, size = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for a, b in chunks(texts):
        w, data, off = words(part := texts.slice(a, b - a)), *raw(pc.utf8_lower(part))
        head = np.zeros(len(data), dtype=bool)
        for k in range(STEM):
            head[(w.start + k)[w.start + k < w.end]] = True
        stem = Runs(data, off, head)
        each = np.concatenate([w.row() * BUCKETS + (w.hash % np.uint64(BUCKETS)).astype(np.int64), stem.row() * BUCKETS + (mix(stem.hash) % np.uint64(BUCKETS)).astype(np.int64)])
        key = np.unique(each)
        out.append(key % BUCKETS)
        size.append(np.bincount(key // BUCKETS, minlength=b - a))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(size))])


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return total[at[1:]] - total[at[:-1]]


class Machine:
    """place: the term's number for each bucket, or -1; w0, w and v."""

    def __init__(self, place: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.place, self.w0, self.w, self.v = place, w0, w, v

    def logit(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        v = self.v[term]
        return self.w0 + _sums(self.w[term], at) + 0.5 * (_sums(v, at) ** 2 - _sums(v * v, at)).sum(axis=1)

    def known(self, bucket: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        term = self.place[bucket]
        kept = np.concatenate([[0], np.cumsum(term >= 0)])
        return term[term >= 0], kept[at]

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(*self.known(*terms(texts))), -30, 30)))


def train(bucket: np.ndarray, at: np.ndarray, label: np.ndarray, seed: int = 3) -> Machine:
    """Adam on the logistic loss, with a penalty on squares; terms by the z-score of their rates in the two classes."""
    n, hot = len(label), int(label.sum())
    place = np.full(BUCKETS, -1, dtype=np.int32)
    prior = float(np.log((hot + 0.5) / (n - hot + 0.5)))
    if not 0 < hot < n:
        return Machine(place, prior, np.zeros(1), np.zeros((1, FACTORS)))
    row = np.repeat(np.arange(n), np.diff(at))
    seen = np.bincount(bucket, minlength=BUCKETS).astype(np.float64)
    toxic = np.bincount(bucket, weights=label[row], minlength=BUCKETS)
    p1, p0 = toxic / hot, (seen - toxic) / (n - hot)
    rate = seen / n
    z = np.abs(p1 - p0) / np.sqrt(rate * (1 - rate) * (1 / hot + 1 / (n - hot)) + 1e-9)
    z[seen < 3] = 0
    best = np.argsort(-z, kind="stable")[:TERMS]
    # a chance result among this many terms is at about four; of fewer terms than TERMS the rest is noise
    best = best[z[best] >= 3.0]
    place[best] = np.arange(len(best))
    rng = np.random.default_rng(seed)
    size = max(1, len(best))
    model = Machine(place, prior, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    term, off = model.known(bucket, at)
    mean, square, step = [np.zeros(1), np.zeros(size), np.zeros((size, FACTORS))], [np.zeros(1), np.zeros(size), np.zeros((size, FACTORS))], 0
    batch = max(32, min(256, n // 8))
    for epoch in range(max(EPOCHS, min(200, 20_000 // max(1, n // batch * 16)))):
        speed = 0.03 / (1 + epoch / 10)
        order = rng.permutation(n)
        for k in range(0, n, batch):
            own = order[k : k + batch]
            count = off[own + 1] - off[own]
            t = term[np.repeat(off[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            a = np.concatenate([[0], np.cumsum(count)])
            error = (1 / (1 + np.exp(-np.clip(model.logit(t, a), -30, 30))) - label[own]) / len(own)
            each = np.repeat(error, count)
            v = model.v[t]
            slope_v = each[:, None] * (np.repeat(_sums(v, a), count, axis=0) - v)
            gw = np.bincount(t, weights=each, minlength=size) + 1e-4 * model.w
            gv = np.stack([np.bincount(t, weights=slope_v[:, f], minlength=size) for f in range(FACTORS)], axis=1) + 1e-3 * model.v
            step += 1
            for i, g in enumerate((np.array([error.sum()]), gw, gv)):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                move = speed * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
                if i == 0:
                    model.w0 -= float(move[0])
                elif i == 1:
                    model.w -= move
                else:
                    model.v -= move
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    own = sampled(labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id"))), SAMPLE_ROWS)

    def hashed(texts: pa.Array) -> pa.Array:
        bucket, at = terms(texts)
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)))

    use = F.arrow_udf(hashed, "array<int>").asNondeterministic()
    # the sample is bounded, so that it may be broadcast
    each = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("h"), use(F.col("text")).alias("t"))
    # a row for each label, however often its id is repeated: that whose text has the least hash
    sample = each.groupBy("doc_id", "label").agg(F.min_by("t", "h").alias("t")).toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
    lists = sample["t"].combine_chunks()
    label = (sample["label"].to_numpy() > 0).astype(np.float64)
    bucket = lists.flatten().to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
    return train(bucket, at, label)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    model = fit(docs, labels)
    place, w0, w, v = model.place, model.w0, model.w, model.v

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(Machine(place, w0, w, v).score(texts))

    score = F.arrow_udf(run, "double").asNondeterministic()
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
