"""Quality by hierarchical empirical Bayes: a document's own evidence, shrunk site and path posteriors on top.

A logistic model over binned shape counts of the whole text, fitted to a bounded labelled sample, gives each document
its evidence: how many times likelier its counts are among good texts than among bad ones. A site's share of good texts
is unknown; for each of POINTS possible shares, the log-likelihoods of its documents are summed, by host and by path
within the host: two grouped aggregates of a few numbers, whatever a site's size. So weak evidence of many documents
adds up to strong evidence of their site. A host's prior is a Beta around the share of all documents, a path's one
around its host's posterior; how strong these are is what makes the sites' likelihoods largest, so that sparse sites lean
on the level above and large ones on themselves. A document's own evidence is left out of its site's. Its score is the
posterior given both: the path's posterior mean is the prior that its own evidence meets.

Nulls: a null text counts as empty; a null host has the global prior and a null path its host's; null labels are left
out. Without labels of both kinds the document's evidence is their smoothed share. Repeated rows count each; of repeated
ids one row is learnt from. A score of 0.5 is kept. An empty table gives an empty result, and other columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sampled, spread_join
from .quality import counts

SAMPLE_ROWS = 20_000

#: Bins of each ratio, by their upper edges.
EDGES = {
    "words": [5, 10, 20, 50, 200, 2000],
    "mean": [2.5, 3.5, 5, 7, 9, 12],
    "symbols": [0.001, 0.02, 0.1, 0.25, 0.6],
    "copies": [0.001, 0.1, 0.3, 0.6],
    "repeats": [0.001, 0.05, 0.2, 0.5],
    "capitals": [0.01, 0.1, 0.3, 0.6],
    "digits": [0.001, 0.05, 0.2],
    "stops": [0.002, 0.02, 0.2, 0.6],
}


def ratios(c: Column) -> dict[str, Column]:
    one = F.lit(1)
    n = F.greatest(c["n_words"], one)
    return {
        "words": c["n_words"].cast("double"), "mean": c["word_chars"] / n, "symbols": c["n_symbols"] / n, "copies": c["n_dup_lines"] / F.greatest(c["n_lines"], one),
        "repeats": c["n_repeat_words"] / n, "capitals": c["n_upper"] / F.greatest(c["n_letters"], one), "digits": c["n_digits"] / F.greatest(c["word_chars"], one), "stops": c["n_stops"] / n,
    }


def bins(c: Column) -> Column:
    """The bin of each ratio."""
    found = ratios(c)
    return F.array(*[sum((F.when(found[k] > e, 1).otherwise(0) for e in edges), F.lit(0)) for k, edges in EDGES.items()])


def logistic(bin_rows: np.ndarray, label: np.ndarray) -> tuple[float, list[list[float]], float]:
    """Intercept, a weight for each bin of each ratio, by Newton's method with a penalty on squares, and the logit of the labels' share."""
    sizes = [len(e) + 1 for e in EDGES.values()]
    n, hot = len(label), float(label.sum())
    prior = float(np.log((hot + 1) / (n - hot + 1)))
    if not 0 < hot < n:
        return prior, [[0.0] * k for k in sizes], prior
    off = np.concatenate([[0], np.cumsum(sizes)])
    x = np.zeros((n, off[-1] + 1))
    x[:, -1] = 1
    for k in range(len(sizes)):
        x[np.arange(n), off[k] + bin_rows[:, k]] = 1
    w = np.zeros(x.shape[1])
    w[-1] = prior
    penalty = np.append(np.full(off[-1], 1.0), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (label - p) - penalty * w)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[-1]), [[float(v) for v in w[off[k] : off[k + 1]]] for k in range(len(sizes))], prior


def fit(docs: DataFrame, labels: DataFrame) -> tuple[float, list[list[float]], float]:
    own = sampled(labels.select("doc_id", F.col("quality").alias("label")), SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("h"), counts(F.col("text")).alias("c"))
    # a row for each label: of repeated ids the one whose text has the least hash
    rows = rows.select("doc_id", "label", "h", bins(F.col("c")).alias("b")).groupBy("doc_id", "label").agg(F.min_by("b", "h").alias("b")).orderBy("doc_id", "label")
    # 3 to 7 bins for each of 8 ratios: what is gathered is the sample, bounded by SAMPLE_ROWS
    got = rows.toArrow().combine_chunks()
    label = (got["label"].to_numpy() > 0).astype(np.float64)
    return logistic(got["b"].combine_chunks().flatten().to_numpy().reshape(-1, len(EDGES)).astype(np.int64) if len(label) else np.zeros((0, len(EDGES)), dtype=np.int64), label)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: Shares of good texts that a site may have, and strengths of priors that are tried.
POINTS = 41
SHARES = (np.arange(POINTS) + 0.5) / POINTS
STRENGTHS = [2.0**k for k in range(13)]
#: Evidence of one text counts as odds of so much at most.
LARGEST = 20.0


def _log_beta(mean: np.ndarray | float, strength: float) -> np.ndarray:
    """Logarithms of a Beta prior's weights on SHARES, a row a mean, normalised."""
    mean = np.clip(np.atleast_1d(mean), 1e-3, 1 - 1e-3)[:, None]
    out = (strength * mean - 1) * np.log(SHARES) + (strength * (1 - mean) - 1) * np.log(1 - SHARES)
    top = out.max(axis=1, keepdims=True)
    return out - top - np.log(np.exp(out - top).sum(axis=1, keepdims=True))


def site_mean(likelihood: np.ndarray, mean: np.ndarray | float, strength: float) -> np.ndarray:
    """Posterior means of sites' shares, given log-likelihoods on SHARES, a row a site, and the means of their priors."""
    logs = likelihood + _log_beta(mean, strength)
    weight = np.exp(logs - logs.max(axis=1, keepdims=True))
    return (weight @ SHARES) / weight.sum(axis=1)


def marginals(likelihood: np.ndarray, mean: np.ndarray | float) -> np.ndarray:
    """For each site and strength, the logarithm of what the likelihood is on average under that prior."""
    out = []
    for strength in STRENGTHS:
        logs = likelihood + _log_beta(mean, strength)
        top = logs.max(axis=1, keepdims=True)
        out.append(top[:, 0] + np.log(np.exp(logs - top).sum(axis=1)))
    return np.stack(out, axis=1)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of POINTS numbers, a row each; a null is zeros."""
    out = np.zeros((len(lists), POINTS))
    out[np.flatnonzero(lists.is_valid())] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, POINTS)
    return out


def strength_of(groups: DataFrame, mean: str) -> float:
    """The strength of the prior that makes the likelihoods of all groups (likelihood, mean) largest; the largest strength where sites don't differ."""

    def run(likelihood: pa.Array, mean_: pa.Array) -> pa.Array:
        got = marginals(_matrix(likelihood), mean_.to_numpy(zero_copy_only=False)).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(likelihood) + 1, dtype=np.int32) * len(STRENGTHS)), pa.array(got))

    each = groups.select(F.arrow_udf(run, "array<double>")("likelihood", mean).alias("x"))
    sums = each.agg(*[F.sum(F.col("x")[k]).alias(f"x{k}") for k in range(len(STRENGTHS))]).first()
    if sums[0] is None:
        return STRENGTHS[-1]
    return STRENGTHS[max(range(len(STRENGTHS)), key=lambda k: (round(sums[k], 6), k))]


def peak(likelihood: list[float]) -> float:
    """The share of all documents: the top of a parabola through the largest of the sums and its neighbours."""
    k = int(np.clip(np.argmax(likelihood), 1, POINTS - 2))
    a, b, c = (likelihood[k + d] for d in (-1, 0, 1))
    bend = a - 2 * b + c
    return float(np.clip(SHARES[k] + (0.5 * (a - c) / bend if bend < 0 else 0.0) / POINTS, SHARES[0], SHARES[-1]))


def scores(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, the document's own probability, the posteriors of host and path, the score and kept, for every row."""
    intercept, weights, prior = fit(docs, labels)
    c = docs.select("doc_id", host.alias("host"), path.alias("path"), counts(F.col("text")).alias("c"))
    b = bins(F.col("c"))
    logit = sum((F.element_at(F.array(*[F.lit(v) for v in w]), b[k] + 1) for k, w in enumerate(weights)), F.lit(intercept))
    evidence = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), logit - prior))
    seen = cut(c.select("doc_id", "host", "path", logit.alias("logit"), evidence.alias("e")))
    likelihood = F.array(*[F.sum(F.ln(float(x) * F.exp("e") + float(1 - x))) for x in SHARES]).alias("likelihood")

    def level(*keys: str) -> DataFrame:
        return cut(seen.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"), likelihood))

    hosts, paths = level("host"), level("host", "path")
    whole = seen.agg(likelihood).first()[0]
    mean = peak(whole) if whole[0] is not None and max(whole) > min(whole) else 1 / (1 + float(np.exp(-prior)))
    a_host = strength_of(hosts.withColumn("mean", F.lit(mean)), "mean")

    def of_host(rows: pa.Array) -> pa.Array:
        return pa.array(site_mean(_matrix(rows), mean, a_host))

    # a path's prior is around its host; hosts of very many paths are broadcast
    per_host = paths.groupBy("host").agg(F.count("*").alias("w"))
    centre = hosts.select("host", F.arrow_udf(of_host, "double")("likelihood").alias("mean")).join(per_host, "host")
    a_path = strength_of(spread_join(paths.select("host", "likelihood"), cut(centre), ["host"], "w", paths.count()), "mean")

    # rows without a host or path meet the levels above; a site's rows may be any number, so that large sites are broadcast
    total, kind = seen.count(), "array<double>"
    with_path = spread_join(seen.dropna(subset=["host", "path"]), paths.select("host", "path", F.col("likelihood").alias("lp"), F.col("n").alias("w")), ["host", "path"], "w", total)
    rest = seen.where("host is null or path is null").withColumn("lp", F.lit(None).cast(kind))
    both = with_path.select("host", "doc_id", "logit", "e", "lp").unionByName(rest.select("host", "doc_id", "logit", "e", "lp"))
    at_host = spread_join(both.where("host is not null"), hosts.select("host", F.col("likelihood").alias("lh"), F.col("n").alias("w")), ["host"], "w", total)
    out = at_host.select("doc_id", "logit", "e", "lp", "lh").unionByName(both.where("host is null").select("doc_id", "logit", "e", "lp", F.lit(None).cast(kind).alias("lh")))

    def sites(e: pa.Array, lh: pa.Array, lp: pa.Array) -> pa.Array:
        own = np.log(SHARES * np.exp(e.to_numpy(zero_copy_only=False))[:, None] + 1 - SHARES)
        h = np.where(lh.is_valid(), site_mean(_matrix(lh) - own, mean, a_host), mean)
        p = np.where(lp.is_valid(), site_mean(_matrix(lp) - own, h, a_path), h)
        return pa.StructArray.from_arrays([pa.array(h), pa.array(p)], names=["host_posterior", "path_posterior"])

    site = F.arrow_udf(sites, "struct<host_posterior:double,path_posterior:double>").asNondeterministic()
    out = out.select("doc_id", _sigmoid(F.col("logit")).alias("own_probability"), "e", site("e", "lh", "lp").alias("s")).select("doc_id", "own_probability", "e", "s.*")
    score = _sigmoid(F.col("e") + F.ln(F.col("path_posterior") / (1 - F.col("path_posterior"))))
    return out.withColumn("score", score).drop("e").withColumn("kept", F.col("score") >= 0.5)
