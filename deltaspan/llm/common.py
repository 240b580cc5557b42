"""What the operators share: lineage cuts, table access, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset in local mode, as in tests."""
    if (named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()) is not None:
        return named
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def sampled(labels: DataFrame, size: int) -> DataFrame:
    """About ``size`` of the rows of (doc_id, label), nulls and repeats left out, by a hash; all where they are fewer."""
    own = labels.where("doc_id is not null and label is not null").distinct()
    total = own.count()
    return own if total <= size else own.where(F.pmod(F.xxhash64("doc_id", "label"), F.lit(1_000_003)) < int(1_000_003 * size / total))


#: A key with more than this share of the rows is heavy: there are at most 1 / HEAVY of them, so that they may be broadcast.
HEAVY = 1e-4


def spread_join(rows: DataFrame, of: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has each key once and, as ``weight``, how many of the ``total`` rows have it.

    Heavy keys, 10,000 at most, are broadcast, so that their rows stay where they are; the others are joined by shuffle,
    where none has more than its share of HEAVY.
    """
    limit = max(200, int(HEAVY * total))
    plain = of.drop(weight)
    heavy = of.where(F.col(weight) > limit).drop(weight).toArrow()
    if not heavy.num_rows:
        return rows.join(plain, keys)
    few = F.broadcast(rows.sparkSession.createDataFrame(heavy).select(*[F.col(f.name).cast(f.dataType) for f in plain.schema]))
    return rows.join(few, keys).unionByName(rows.join(few, keys, "left_anti").join(of.where(F.col(weight) <= limit).drop(weight), keys))


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


#: Links in a task of a round. Later rounds have few; each file that a task writes is a cost of its own.
LINKS, LEAST_TASKS = 100_000, 4
#: Joins of the last step that are planned at once.
COMPOSED = 3


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) between longs: rows (node, root), root one of the component's nodes.

    Contraction: each node takes the least of its neighbours and itself, links are drawn anew between what was taken, and
    loops and repeats are dropped, until no link is left; the steps are then composed backwards. Links to a least node,
    as bands give them, are done in three rounds at most; later ones have orders of their own (the numbers under an
    exclusive or with a random mask), so that a chain of sorted numbers loses a share of its nodes each time. Each round has equi-joins and partial aggregates only, so that a node
    with very many links is combined before it is shuffled.
    """
    steps: list[DataFrame] = []
    links = cut(edges.select("a", "b").where("a is not null and b is not null and a <> b"))
    while n := links.count():
        parts = max(LEAST_TASKS, -(-n // LINKS))
        links = links.coalesce(parts)
        if not steps:
            width = parts
        turn = len(steps)
        mask = F.lit(int(np.random.default_rng(turn).integers(-(1 << 63), 1 << 63)) if turn >= 3 else 0)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.min(F.col("b").bitwiseXOR(mask))
        step = both.groupBy(F.col("a").alias("node")).agg(low.alias("low")).select("node", F.least("low", F.col("node").bitwiseXOR(mask)).bitwiseXOR(mask).alias("root"))
        steps.append(step := cut(step.coalesce(parts)))
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        links = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct().coalesce(parts))
    if not steps:
        return edges.sparkSession.createDataFrame([], "node bigint, root bigint")
    # a root may itself have moved in a later step; what no later step has stays
    out = steps[-1]
    for k, step in enumerate(reversed(steps[:-1]), 1):
        out = _compose(step, out)
        if k % COMPOSED == 0 or k == len(steps) - 1:  # planning a chain of joins takes time that doubles with its length
            out = cut(out.coalesce(width))
    return out


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    t = then.select(F.col("node").alias("root"), F.col("root").alias("__to"))
    return first.join(t, "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
