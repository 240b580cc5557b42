"""Nearest-centroid clustering of integer vectors with Hamerly's bounds.

Each vector carries, from round to round, its centroid, an upper bound of its distance to it and a lower bound of its
distance to the second nearest. When centroids move, the upper bound grows by the drift of its own centroid and the
lower one shrinks by the largest drift of the others. Where the upper bound is below the lower one, or below half the
distance from the centroid to the centroid next to it, the nearest centroid can't have changed. Else the upper bound is
made exact and tried again, and a vector that is still ambiguous is compared to all centroids in integers. Bounds are
rounded away from each other, so that ties are always settled by integers, and go to the smaller number.

Sums of centroids are kept as integers on the driver; after the first round only vectors that moved change them. A round
is one pass without a shuffle but of the sums: at most two rows of them for each centroid and task. Centroids, their drifts and sums are
bounded by the number of centroids. A vector's state stands beside it, persisted, and is made again where an executor is
lost.

Vectors that are null, of another length, or have a null or non-finite component are left out. A component x becomes
floor(scale * x), held to +-2^26, so that squared distances fit in 64 bits; a sum of distances beyond 64 bits is null.
Vectors without an id are assigned, but never start a centroid. Repeated rows are vectors of their own: equal ids start
by the order of their vectors, equal centroids leave the larger number empty, and an empty centroid stays where it is.
With fewer vectors than centroids all of them start. An empty table gives an empty result. Other columns, whatever their
names, don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE = 64
LARGEST = 1 << 26
#: Bounds are moved away from each other by this share, far more than what rounding may take.
MARGIN = 1e-12
_STATE = "struct<c:int,upper:double,lower:double>"


def integers(vector: Column, size: int, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null where the vector doesn't count."""
    fits = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), scale * x.cast("double")))
    return F.when(fits, F.transform(vector, lambda x: F.floor(held(x)).cast("int")))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    far = int(np.abs(v).max(initial=0)) + int(np.abs(c).max(initial=0))
    if v.shape[1] * far * far < 1 << 51:  # whole numbers that doubles hold
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)).astype(np.int64)
    return np.stack([((v.astype(np.int64) - one) ** 2).sum(axis=1) for one in c.astype(np.int64)], axis=1)


def _above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + MARGIN)


def _below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - MARGIN)


def scanned(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, the smaller number on ties, with the bounds that its distances give."""
    d = squared(v, c)
    best, row = d.argmin(axis=1), np.arange(len(v))
    upper = _above(d[row, best])
    if len(c) == 1:
        return best, upper, np.full(len(v), np.inf)
    d[row, best] = np.iinfo(np.int64).max
    return best, upper, _below(d.min(axis=1))


def stepped(v: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids moved, and how many vectors were compared to all of them."""
    moved = _above(((c - before) ** 2).sum(axis=1))
    most = int(moved.argmax())
    others = np.full(len(c), moved[most])
    others[most] = np.delete(moved, most).max(initial=0)
    upper = (upper + moved[best]) * (1 + MARGIN)
    lower = np.maximum((lower - others[best]) * (1 - MARGIN), 0)
    between = squared(c, c)
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    safe = np.maximum(lower, 0.5 * _below(between.min(axis=1))[best])
    doubt = np.flatnonzero(upper >= safe)
    best = best.copy()
    if doubt.size:
        upper[doubt] = _above(((v[doubt].astype(np.int64) - c[best[doubt]]) ** 2).sum(axis=1))
        doubt = doubt[upper[doubt] >= safe[doubt]]
        if doubt.size:
            best[doubt], upper[doubt], lower[doubt] = scanned(v[doubt], c)
    return best, upper, lower, len(doubt)


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _state(best: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(best, type=pa.int32()), pa.array(upper), pa.array(lower)], names=["c", "upper", "lower"])


def _first(c: np.ndarray) -> Column:
    def run(v: pa.Array) -> pa.Array:
        return _state(*scanned(_matrix(v, c.shape[1]), c))

    return F.arrow_udf(run, _STATE).asNondeterministic()(F.col("v"))


def _next(c: np.ndarray, before: np.ndarray) -> Column:
    def run(v: pa.Array, s: pa.Array) -> pa.Array:
        best, upper, lower = (s.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        return _state(*stepped(_matrix(v, c.shape[1]), best.astype(np.int64), upper.copy(), lower, c, before)[:3])

    return F.arrow_udf(run, _STATE).asNondeterministic()(F.col("v"), F.col("s"))


def _distance(c: np.ndarray) -> Column:
    def run(v: pa.Array, best: pa.Array) -> pa.Array:
        return pa.array(((_matrix(v, c.shape[1]).astype(np.int64) - c[best.to_numpy(zero_copy_only=False)]) ** 2).sum(axis=1))

    return F.arrow_udf(run, "bigint")(F.col("v"), F.col("c"))


def start(vectors: DataFrame, size: int, k: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``1:`` and their id."""
    first = vectors.where("id is not null").orderBy(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")).cast("binary"), 256), "v").select("v").limit(k)
    return np.array([r["v"] for r in first.collect()], dtype=np.int64).reshape(-1, size)


def fit(rows: DataFrame, id_: str, vector: str, size: int, k: int, rounds: int, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that counts, after ``rounds`` rounds and a last assignment, and the centroids."""
    vectors = rows.select(F.col(id_).alias("id"), integers(F.col(vector), size, scale).alias("v")).where("v is not null")
    c = start(vectors, size, k)
    if not len(c):
        c = np.zeros((1, size), dtype=np.int64)
    state = vectors.select("id", "v", _first(c).alias("s"), F.lit(None).cast("int").alias("was")).persist()
    total, count = [[0] * size for _ in c], [0] * len(c)
    for _ in range(rounds):
        # what came to a centroid and what left it; in the first round all come
        change = F.array(F.struct(F.col("s.c").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))
        moved = state.where("was is null or was <> s.c").select("v", F.explode(change).alias("m")).where("m.c is not null")
        for r in moved.groupBy("m.c").agg(F.sum("m.sign").alias("n"), *[F.sum(F.col("m.sign") * F.col("v")[i].cast("long")).alias(f"x{i}") for i in range(size)]).collect():  # a row a centroid
            count[r["c"]] += r["n"]
            total[r["c"]] = [a + r[f"x{i}"] for i, a in enumerate(total[r["c"]])]
        before, c = c, np.array([[x // n for x in own] if n else old for own, n, old in zip(total, count, c.tolist(), strict=True)], dtype=np.int64)
        after = state.select("id", "v", _next(c, before).alias("s"), F.col("s.c").alias("was")).persist()
        after.count()
        state.unpersist()
        state = after
    out = cut(state.select("id", "v", F.col("s.c").alias("c")).select("id", F.col("c").alias("cluster"), _distance(c).alias("distance")))
    state.unpersist()
    return out, c


def clustered(rows: DataFrame, id_: str, vector: str, size: int, k: int, rounds: int) -> DataFrame:
    """id, cluster and distance with the sums of distances and the digest of the centroid's components."""
    out, c = fit(rows, id_, vector, size, k, rounds)
    inertia = {r["cluster"]: int(r["x"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # a row a centroid
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(inertia.values()))
    about = [(i, fits(x), whole, hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i, x in inertia.items()]
    of = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(of), "cluster").select(F.col("id").alias(id_), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    return f"""
a{i} AS (
  SELECT vec_id, row, v, c, d FROM (
    SELECT x.vec_id, x.row, x.v, m.c, list_sum(list_transform(list_zip(x.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM own x CROSS JOIN c{i} m)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"""


def _mean_sql(i: int) -> str:
    return f"""
s{i} AS (SELECT c, k, sum(v[k])::BIGINT AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, 65) t(k) GROUP BY c, k),
c{i + 1} AS (
  SELECT m.c, coalesce(n.v, m.v) AS v FROM c{i} m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS v FROM s{i} GROUP BY c) n ON n.c = m.c)"""


#: Three rounds over 16 centroids and 64 components.
ORACLE = f"""
WITH own AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM own WHERE vec_id IS NOT NULL QUALIFY c < 16),
{",".join(_round_sql(i) + "," + _mean_sql(i) for i in range(3))},
{_round_sql(3)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a3 JOIN (SELECT c, v FROM c3) m USING (c)
"""
