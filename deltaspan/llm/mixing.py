"""Mixing to target weights with soft memberships: a classifier gives domain posteriors, projected gradient gives rates.

A naive Bayes model over hashed words is fitted to a labelled table and gives each document a probability of each
domain. Rates r >= 0 minimise the squared distance between the expected tokens of the domains, the sums of
rate x tokens x posterior, and their targets. Documents whose posteriors agree to 1/GRID share a rate: they are summed
up as a cell, its tokens and its expected tokens by domain, both exact, so that the residual is that of all documents.

Projected gradient over the cells, in the metric of their tokens: r <- max(0, y - p . g), where g is the residual over
the largest eigenvalue of the Gram matrix (the step that always descends), y is r carried on by Nesterov's momentum, and
the momentum starts anew when it points uphill. A step is the same small vector for all cells. Up to LOCAL_CELLS cells
are iterated in one place; beyond it each round is one sum over the distributed cells, which replay the steps since their
rates were last written, REWRITE at most.
It ends when the targets are met or, as with targets out of reach, when the duality gap shows that no rates at all have a
residual much less (GAP); ``settled`` tells whether one of these was so before MAX_ROUNDS.

Nulls: a null text has no tokens and the prior as posterior, and gets the rate of its cell, 1 if none there has tokens. Rows without a domain
aren't learnt from; a target above zero for a domain that no labelled row has is an error, and so are over MAX_DOMAINS
domains. Repeated rows get equal rates; of equal posteriors the domain that is first by name is the likeliest. An empty
table gives an empty result. Other columns, whatever their names, pass through ``mix`` (which replaces mix_rate and
mix_copies) and are ignored by ``rates``.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, spread_join
from .kernels import chunks, words

BUCKETS = 1 << 16
#: The classifier learns from about this many labelled rows, chosen by the hash of their ids and texts, and besides of each domain
#: from about DOMAIN_ROWS, or all it has: MAX_DOMAINS x DOMAIN_ROWS more at most. The domains are those of all rows.
SAMPLE_ROWS = 20_000
DOMAIN_ROWS = 300
MAX_DOMAINS = 64
#: A posterior weighs its words as if it had this many at most: words aren't independent.
EVIDENCE = 30.0
GRID = 64
#: Up to so many cells are iterated on the driver (some 8 (3 k + 5) bytes each) and broadcast: all that five domains may have.
LOCAL_CELLS = 1_000_000
#: Rounds of the distributed form after which the cells' rates are written, so that later rounds replay only what follows.
REWRITE = 50
MAX_ROUNDS = 10_000
#: Shares of all tokens: targets are met, or the residual is as near to the least one that is possible.
MET, GAP = 1e-7, 2e-3


def _hash_sample(df: DataFrame, size: dict[str, int]) -> DataFrame:
    """About SAMPLE_ROWS of the rows, and DOMAIN_ROWS at least of each domain that has them, given the domains' sizes."""
    total = sum(size.values())
    if total <= SAMPLE_ROWS:
        return df
    least = [F.when(F.col("domain") == d, int(1_000_003 * min(1.0, max(SAMPLE_ROWS / total, DOMAIN_ROWS / n)))) for d, n in size.items()]
    return df.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < F.coalesce(*least))


class Model:
    """Domains, prior and log-probabilities of hashed words."""

    def __init__(self, domains: list[str], count: np.ndarray, rows: np.ndarray) -> None:
        self.domains = domains
        self.prior = (rows + 1) / (rows + 1).sum()
        seen = count + 0.1
        self.log = np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)

    def posterior(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and the domains' probabilities."""
        n, out = [np.zeros(0, dtype=np.int64)], [np.zeros((0, len(self.domains)))]
        for a, b in chunks(texts):
            w = words(texts.slice(a, b - a))
            bucket = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
            count = np.diff(w.at)
            logs = np.tile(np.log(self.prior), (len(count), 1))
            if (has := np.flatnonzero(count)).size:
                weight = np.minimum(count[has], EVIDENCE) / count[has]
                for k in range(len(self.domains)):
                    logs[has, k] += np.add.reduceat(self.log[k][bucket].astype(np.float64), w.at[has]) * weight
            logs = np.exp(logs - logs.max(axis=1, keepdims=True))
            n.append(count)
            out.append(logs / logs.sum(axis=1, keepdims=True))
        return np.concatenate(n), np.concatenate(out)


def fit(labelled: DataFrame, domain: str = "domain") -> Model | None:
    """A model from rows of doc_id, text and a domain; None if no row has a domain."""
    known = labelled.where(F.col(domain).isNotNull()).select("doc_id", F.col(domain).cast("string").alias("domain"), "text")
    size = {r["domain"]: r["count"] for r in known.groupBy("domain").count().limit(MAX_DOMAINS + 1).collect()}
    if len(size) > MAX_DOMAINS:
        raise ValueError(f"over {MAX_DOMAINS} domains")
    domains = sorted(size)
    if not domains:
        return None
    sample = _hash_sample(known, size).select("domain", "text")

    def count(batches):  # noqa: ANN001, ANN202
        total = np.zeros((len(domains), BUCKETS), dtype=np.int64)
        for batch in batches:
            texts, own = batch["text"], np.array([domains.index(x) for x in batch["domain"].to_pylist()])
            for a, b in chunks(texts):
                w = words(texts.slice(a, b - a))
                np.add.at(total, (own[a:b][w.row()], (w.hash % np.uint64(BUCKETS)).astype(np.int64)), 1)
        k, bucket = np.nonzero(total)
        yield pa.record_batch({"k": k.astype(np.int32), "bucket": bucket.astype(np.int32), "n": total[k, bucket]})

    seen = sample.mapInArrow(count, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(domains), BUCKETS))
    total[seen["k"].to_numpy(), seen["bucket"].to_numpy()] = seen["n"].to_numpy()
    return Model(domains, total, np.array([size[x] for x in domains], dtype=np.float64))


def posterior(model: Model, text: Column) -> Column:
    """struct(tokens, p) of a text."""
    domains, prior, log = model.domains, model.prior, model.log

    def run(texts: pa.Array) -> pa.Array:
        own = Model.__new__(Model)
        own.domains, own.prior, own.log = domains, prior, log
        n, p = own.posterior(texts)
        at = np.arange(len(n) + 1, dtype=np.int32) * len(domains)
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(p.reshape(-1)))], names=["tokens", "p"])

    return F.arrow_udf(run, "struct<tokens:bigint,p:array<double>>").asNondeterministic()(text)


def natural_targets(share: np.ndarray) -> np.ndarray:
    """The default: shares tempered by their square roots, which lifts small domains."""
    root = np.sqrt(share)
    return root / root.sum()


def cell_of(p: Column) -> Column:
    """The number of a posterior's cell."""
    return F.xxhash64(F.transform(p, lambda x: F.floor(x * GRID + 0.5)))


def cells(seen: DataFrame, k: int) -> DataFrame:
    """cell, tokens and expected tokens by domain (t, s) of rows with (tokens, p), and how many they are."""
    s = F.array(*[F.sum(F.col("tokens") * F.col("p")[i]) for i in range(k)])
    return seen.groupBy(cell_of(F.col("p")).alias("cell")).agg(F.sum(F.col("tokens").cast("double")).alias("t"), s.alias("s"), F.count("*").alias("n"))


class Here:
    """Cells in memory with their rates r and the points y that the next step starts from."""

    def __init__(self, t: np.ndarray, s: np.ndarray) -> None:
        self.s = s
        self.t = t
        self.p = s / np.maximum(t, 1e-300)[:, None]
        self.r = self.y = np.ones(len(t))

    def gram(self) -> np.ndarray:
        return self.p.T @ self.s

    def step(self, g: np.ndarray) -> tuple[np.ndarray, float]:
        """The expected tokens after a step, and the least slope of a cell."""
        slope = self.p @ g
        self.new = np.maximum(0.0, self.y - slope)
        return self.new @ self.s, float(slope.min(initial=0.0))

    def carry(self, beta: float) -> None:
        self.y = self.new + beta * (self.new - self.r)
        self.r = self.new


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch["t"], dtype=np.float64), np.asarray(batch["s"].flatten(), dtype=np.float64).reshape(-1, k)


def _replayed(batch: pa.RecordBatch, k: int, steps: list[tuple[np.ndarray, float]]) -> Here:
    here = Here(*_arrays(batch, k))
    here.r, here.y = (np.asarray(batch[c], dtype=np.float64) for c in "ry")
    for g, beta in steps:
        here.step(g)
        here.carry(beta)
    return here


class There:
    """The same over a distributed table of cells: each round sums over it, and replays the steps since the rates r and y were written."""

    def __init__(self, of: DataFrame, k: int) -> None:
        self.of, self.k, self.steps = of.withColumn("r", F.lit(1.0)).withColumn("y", F.lit(1.0)), k, []

    def _sum(self, each, width: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """Sums and minima of ``width`` numbers of each batch."""
        k, steps = self.k, list(self.steps)

        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                yield pa.record_batch({"i": np.arange(width, dtype=np.int32), "x": each(_replayed(batch, k, steps))})

        got = self.of.select("t", "s", "r", "y").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"), F.min("x").alias("least")).orderBy("i").toArrow()
        return got["x"].to_numpy(), got["least"].to_numpy()

    def reached(self) -> np.ndarray:
        return self._sum(lambda here: here.s.sum(axis=0), self.k)[0]

    def gram(self) -> np.ndarray:
        return self._sum(lambda here: here.gram().reshape(-1), self.k**2)[0].reshape(self.k, self.k)

    def step(self, g: np.ndarray) -> tuple[np.ndarray, float]:
        self.g = g

        def each(here: Here) -> np.ndarray:
            reached, least = here.step(g)
            return np.append(reached, least)

        got, least = self._sum(each, self.k + 1)
        return got[:-1], float(least[-1])

    def carry(self, beta: float) -> None:
        self.steps.append((self.g, beta))
        if len(self.steps) >= REWRITE:
            self.of, self.steps = self.rated(), []

    def rated(self) -> DataFrame:
        """The cells with their rates written."""
        k, steps = self.k, list(self.steps)

        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                here = _replayed(batch, k, steps)
                yield pa.record_batch([batch[c] for c in ("cell", "t", "s", "n")] + [pa.array(here.r), pa.array(here.y)], names=["cell", "t", "s", "n", "r", "y"])

        return cut(self.of.select("cell", "t", "s", "n", "r", "y").mapInArrow(run, "cell bigint, t double, s array<double>, n bigint, r double, y double"))


def descend(state: Here | There, reached: np.ndarray, goal: np.ndarray, rounds: int) -> tuple[np.ndarray, bool]:
    """Accelerated projected gradient with restarts, from rates of 1; the expected tokens then, and whether it settled."""
    top = float(np.linalg.eigvalsh(state.gram()).max(initial=0.0))
    if not top:
        return reached, True
    ahead, turn, total, bound = reached, 1.0, np.abs(goal).sum(), 0.0
    for _ in range(rounds):
        if np.abs(reached - goal).max() <= MET * total or np.linalg.norm(reached - goal) - bound <= GAP * total and bound > 0:
            return reached, True
        miss = ahead - goal
        new, least = state.step(miss / top)
        # a dual point: slopes of all cells are raised to zero at least, as posteriors sum to one
        dual = miss + max(0.0, -least * top)
        bound = max(bound, float(-goal @ dual / (np.linalg.norm(dual) or 1.0)))
        uphill = miss @ (new - reached) > 0
        after = 1.0 if uphill else (1 + (1 + 4 * turn**2) ** 0.5) / 2
        beta = 0.0 if uphill else (turn - 1) / after
        state.carry(beta)
        ahead, reached, turn = new + beta * (new - reached), new, after
    return reached, bool(np.abs(reached - goal).max() <= MET * total)


class Solution:
    """cells with their rates, the expected tokens that they reach, the targets in tokens, and whether it settled."""

    def __init__(self, rate: DataFrame, small: bool, reached: np.ndarray, goal: np.ndarray, settled: bool) -> None:
        self.rate, self.small, self.reached, self.goal, self.settled = rate, small, reached, goal, settled

    def join(self, rows: DataFrame, cell: str, rate: str, total: int) -> DataFrame:
        """The rows with the rate of their cell, whose column goes."""
        named = self.rate.select(F.col("cell").alias(cell), F.col("r").alias(rate), F.col("n").alias(f"{cell}_n"))
        if self.small:
            return rows.join(F.broadcast(named.drop(f"{cell}_n")), cell).drop(cell)
        return spread_join(rows, named, [cell], f"{cell}_n", total).drop(cell)


def solve(seen: DataFrame, domains: list[str], targets: dict[str, float] | None = None, rounds: int = MAX_ROUNDS) -> Solution:
    """Rates for the cells of rows of (tokens, p)."""
    k, spark = len(domains), seen.sparkSession
    if lost := sorted(d for d, share in (targets or {}).items() if share > 0 and d not in domains):
        raise ValueError(f"targets for domains without labelled rows: {', '.join(lost)}")
    of = cut(cells(seen, k))
    small = of.count() <= LOCAL_CELLS
    if small:
        own = of.toArrow().sort_by("cell").combine_chunks()
        t, s = (_arrays(own.to_batches()[0], k)) if own.num_rows else (np.zeros(0), np.zeros((0, k)))
        state: Here | There = Here(t, s)
        reached = s.sum(axis=0)
    else:
        state = There(of, k)
        reached = state.reached()
    total = reached.sum()
    share = natural_targets(reached / total) if targets is None and total else np.array([max(0.0, (targets or {}).get(d, 0.0)) for d in domains])
    goal = total * share / (share.sum() or 1.0)
    settled = True
    if total and share.sum():
        reached, settled = descend(state, reached, goal, rounds)
    if small:
        rate = spark.createDataFrame(pa.table({"cell": own["cell"], "r": pa.array(state.r), "n": own["n"]})) if own.num_rows else of.select("cell", F.lit(1.0).alias("r"), "n")
    else:
        rate = state.rated().select("cell", "r", "n")
    return Solution(rate, small, reached, goal, settled)


def rates(docs: DataFrame, labelled: DataFrame, domain: str, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, the likeliest domain, its probability, the rate, and whether the rates settled, for every row."""
    model = fit(labelled, domain)
    if model is None:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("probability"), F.lit(1.0).alias("rate"), F.lit(True).alias("settled"))
    seen = cut(docs.select("doc_id", posterior(model, F.col("text")).alias("s")).select("doc_id", "s.*"))
    got = solve(seen, model.domains, targets)
    best = F.array_max("p")
    name = F.element_at(F.array(*[F.lit(d) for d in model.domains]), F.array_position("p", best).cast("int"))
    out = seen.select("doc_id", "tokens", name.alias("domain"), F.round(best, 6).alias("probability"), cell_of(F.col("p")).alias("cell"))
    return got.join(out, "cell", "rate", 0 if got.small else seen.count()).withColumns({"rate": F.round("rate", 6), "settled": F.lit(got.settled)})


def mix(docs: DataFrame, labelled: DataFrame, domain: str, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents with mix_rate, and mix_copies, the rate rounded up or down by a hash of the row so that sums hold.

    Every row stays: one with no copies has mix_copies 0. A column of these names is replaced. Whether the rates settled
    stands in the metadata of mix_rate, ``settled``; if they didn't, a warning is given besides.
    """
    model = fit(labelled, domain)
    cell = fresh("cell")
    docs = docs.drop("mix_rate", "mix_copies")
    if model is None:
        return docs.withColumn("mix_rate", F.lit(1.0)).withColumn("mix_copies", F.lit(1).cast("bigint"))
    seen = docs.select(posterior(model, F.col("text")).alias("s")).select("s.*")
    got = solve(seen, model.domains, targets)
    marked = docs.withColumn(cell, cell_of(posterior(model, docs["text"])["p"]))
    out = got.join(marked, cell, "mix_rate", 0 if got.small else docs.count())
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    if not got.settled:
        warnings.warn("rates that didn't settle", stacklevel=2)
    rate = F.col("mix_rate").alias("mix_rate", metadata={"settled": got.settled})
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], rate, F.floor(F.col("mix_rate") + u).alias("mix_copies"))
