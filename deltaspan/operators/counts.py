"""Bootstraps by counts: how often an item is drawn in a round is a hash of the item and the round.

Counts follow the Poisson law of mean one, to which the counts of n draws out of n items tend; what is drawn from them
is a ratio of sums, so that the number of draws, which varies, cancels out. An item's counts depend on nothing but its
key: items need no numbers, no order and no join, a table may be dealt in any way, and any engine that multiplies
integers gets the same counts. A task multiplies a block of counts with the items' values and keeps one row of sums for
each group and round, so that the work is linear in the items, and what is shuffled doesn't grow with them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resample import BROADCAST_GROUPS, order_bounds

PRIME = (1 << 31) - 1
#: A hash of at least the k-th of these means a count above k: the shares of the Poisson law of mean one.
LIMITS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10)]
#: Keys in a block of counts, and groups whose sums a task holds before it hands them on.
BLOCK, HELD = 64, 64
#: The round of the items themselves, each of which counts once.
POINT = -1


#: Items times rounds that are counted at a time: so much stays in a core's own memory.
CELLS = 1 << 15


def _fold(x: np.ndarray, high: np.ndarray) -> None:
    """A number of the same remainder by PRIME: below 2^32 from one below 2^62 and a little, at most 2^31 + 5 from one below 2^34."""
    np.right_shift(x, np.uint64(31), out=high)
    x &= np.uint64(PRIME)
    x += high


def counts_py(x: np.ndarray, y: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Counts of items with the two halves of their key's hash, a row an item, a column a round.

    The hash is made of numbers below 2^64 that are folded only as often as they must be: those below 2^32 may be squared.
    """
    x, y, turns = (v.astype(np.uint64) for v in (x, y, turns))
    own, at = x * np.uint64(48271) % np.uint64(PRIME), (turns * np.uint64(16807) + np.uint64(1)) % np.uint64(PRIME)
    out = np.empty((len(x), len(turns)), dtype=np.int8)
    wide = max(1, min(len(turns), CELLS))
    tall = max(1, CELLS // wide)
    room = [np.empty((tall, wide), dtype=t) for t in (np.uint64, np.uint64, np.uint32, np.bool_)]
    for i in range(0, len(x), tall):
        rows = slice(i, i + tall)
        for j in range(0, len(turns), wide):
            columns = slice(j, j + wide)
            count = out[rows, columns]
            h, high, short, above = (r[: count.shape[0], : count.shape[1]] for r in room)
            np.add(own[rows, None], at[None, columns], out=h)
            for more, folds in ((y[rows, None], 2), (turns[None, columns], 1), (x[rows, None], 2)):
                h *= h
                h += more
                for _ in range(folds):
                    _fold(h, high)
            np.copyto(short, h, casting="same_kind")
            np.greater_equal(short, np.uint32(PRIME), out=above)
            if above.any():
                short[above] -= np.uint32(PRIME)
            np.greater_equal(short, np.uint32(LIMITS[0]), out=count.view(np.bool_))
            for limit in LIMITS[1:]:
                np.greater_equal(short, np.uint32(limit), out=above)
                count += above.view(np.int8)
    return out


def key_halves(key: list[str]) -> tuple[Column, Column]:
    """Two numbers below 2^28 from the MD5 of the key's texts."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    return tuple(F.conv(F.substring(digest, at, 7), 16, 10).cast("long") for at in (1, 8))


def halves_sql(key: str) -> str:
    return ", ".join(f"CAST('0x' || substr(md5({key}), {at}, 7) AS BIGINT) AS {name}" for at, name in ((1, "x"), (8, "y")))


def counts_sql(items: str, rounds: int, keep: str) -> str:
    """A query with the columns ``keep``, turn and w over items that have the columns x and y; round POINT counts all once."""
    steps = f"SELECT {keep}, x, y, turn, (x * 48271 + turn * 16807 + 1) % {PRIME} AS h FROM {items}, (SELECT unnest(range(0, {rounds})) AS turn)"
    for more in ("y", "turn", "x"):
        steps = f"SELECT {keep}, x, y, turn, (h * h + {more}) % {PRIME} AS h FROM ({steps})"
    weight = " + ".join(f"(h >= {t})::INT" for t in LIMITS)
    return f"SELECT {keep}, turn, {weight} AS w FROM ({steps}) UNION ALL SELECT {keep}, {POINT}, 1 FROM {items}"


def counted(rows: DataFrame, by: list[str], key: list[str], values: list[str], rounds: int) -> DataFrame:
    """by, turn, n and the sums of the values over the items drawn in each round; round POINT has the plain sums.

    Rows with a null value are left out. Rows of equal keys in a group are drawn together. The counts of a key are made
    once for its rows that follow one another, whatever their groups.
    """
    x, y = key_halves(key)
    own = rows.select(*by, x.alias("__x"), y.alias("__y"), *[F.col(v).cast("double").alias(v) for v in values]).dropna(subset=values)
    kinds = {f.name: f.dataType for f in own.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c].simpleString()}" for c in by], "turn int", "n double", *[f"`{v}` double" for v in values]])
    turns = np.arange(rounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for group, sums in held.items():
                columns = {c: pa.array([v] * (rounds + 1), type=types[c]) for c, v in zip(by, group, strict=True)}
                columns["turn"] = pa.array(np.concatenate([[POINT], turns]).astype(np.int32))
                yield pa.RecordBatch.from_pydict(columns | {name: pa.array(np.ascontiguousarray(sums[:, i])) for i, name in enumerate(["n", *values])})
            held.clear()

        types: dict[str, pa.DataType] = {}
        for batch in batches:
            types = {c: batch.schema.field(c).type for c in by}
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            for c in by:  # a number for each combination of group values in the batch
                own = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                _, codes = np.unique(np.stack([codes, own]), axis=1, return_inverse=True)
                codes = codes.reshape(-1)
            matrix = np.column_stack([np.ones(batch.num_rows), *[batch.column(v).to_numpy(zero_copy_only=False) for v in values]])
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__x", "__y"))
            if codes.max(initial=0) >= HELD:  # more groups than are held: one after the other
                order = np.argsort(codes, kind="stable")
                x, y, codes, matrix = x[order], y[order], codes[order], matrix[order]
            else:
                order = np.arange(batch.num_rows)
            begins = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
            for a in range(0, len(begins), BLOCK):
                keys = begins[a : a + BLOCK]
                first, last = int(keys[0]), int(begins[a + BLOCK]) if a + BLOCK < len(begins) else batch.num_rows
                w = counts_py(x[keys], y[keys], turns).astype(np.float64)
                place = np.searchsorted(keys, np.arange(first, last), side="right") - 1
                for code in np.unique(codes[first:last]):
                    at = np.flatnonzero(codes[first:last] == code)
                    group = tuple(batch.column(c)[int(order[first + at[0]])].as_py() for c in by)
                    if group not in held:
                        if len(held) >= HELD:
                            yield from out()
                        held[group] = np.zeros((rounds + 1, len(values) + 1))
                    held[group][0] += matrix[first + at].sum(axis=0)
                    held[group][1:] += w[place[at]].T @ matrix[first + at]
        yield from out()

    return own.mapInArrow(run, schema).groupBy(*by, "turn").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in values])


def side_by_side(rows: DataFrame, key: str) -> DataFrame:
    """The same rows, those of a key one after the other; for keys that each have few rows, such as one for each system."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("__rows")).select(key, F.explode("__rows").alias("__r")).select(*[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def _summary(sums: DataFrame, by: list[str], values: list[str], m: Column, rounds: int, upper_less: int = 0) -> DataFrame:
    """by, the plain sums, the bounds of m over the rounds, its mean, and how much of it isn't above, or not below, zero.

    A round that draws nothing from a group, as may be where it has few items, has the plain sums. m is rounded to six
    digits before it is ordered, so that the order of sums can't tell draws apart.
    """
    low, high = order_bounds(rounds)
    names, group = ["n", *values], Window.partitionBy(*by)
    own = sums.withColumns({f"__{v}": F.max(F.when(F.col("turn") == POINT, F.col(v))).over(group) for v in names})
    own = own.withColumns({v: F.when(F.col("n") == 0, F.col(f"__{v}")).otherwise(F.col(v)) for v in [*values, "n"]})
    own = own.withColumn("m", F.when(F.col("turn") != POINT, F.round(m, 6)))
    # a group has as many rows here as there are rounds
    own = own.withColumn("k", F.row_number().over(Window.partitionBy(*by, F.col("turn") == POINT).orderBy("m")) - 1)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("m")))  # noqa: E731  the plain row has no m
    return own.groupBy(*by).agg(
        *[F.max(f"__{v}").alias(v) for v in names], F.avg("m").alias("drawn"), at(low).alias("ci_lo"), at(high - upper_less).alias("ci_hi"),
        F.avg((F.col("m") <= 0).cast("double")).alias("below"), F.avg((F.col("m") >= 0).cast("double")).alias("above"),
    )


def mean_interval(df: DataFrame, by: list[str], value: str, key: list[str], rounds: int = 2000) -> DataFrame:
    """by, n, mean and the bounds of its interval."""
    out = _summary(counted(df, by, key, [value], rounds), by, [value], F.col(value) / F.col("n"), rounds)
    return out.select(*by, F.col("n").cast("long").alias("n"), (F.col(value) / F.col("n")).alias("mean"), "ci_lo", "ci_hi")


def paired_interval(aligned: DataFrame, by: list[str], key: list[str], rounds: int = 2000) -> DataFrame:
    """by, n, the difference of value_hi and value_lo, its interval, a two-sided p, and whether it is above zero."""
    sums = counted(aligned.withColumn("d", F.col("value_hi") - F.col("value_lo")), by, key, ["d"], rounds)
    out = _summary(sums, by, ["d"], F.col("d") / F.col("n"), rounds).withColumn("diff", F.col("d") / F.col("n"))
    p = F.least(F.lit(1.0), 2 * F.when(F.col("diff") >= 0, F.col("below")).otherwise(F.col("above")))
    return out.select(*by, F.col("n").cast("long").alias("n"), "diff", "ci_lo", "ci_hi", p.alias("p"), F.when(F.col("ci_lo") > 0, "PASS").otherwise("fail").alias("gate"))


def ratio_interval(df: DataFrame, by: list[str], top: str, bottom: str, key: list[str], rounds: int = 2000) -> DataFrame:
    """Mean of the drawn ratios of sums and their interval, whose upper bound is one place lower; a ratio to zero is zero."""
    ratio = F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    return _summary(counted(df, by, key, [top, bottom], rounds), by, [top, bottom], ratio, rounds, 1).select(*by, F.col("drawn").alias("mean"), "ci_lo", "ci_hi")


def solved_py(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of normal equations; the least of all solutions where some direction of the design has no weight."""
    return np.einsum("nij,nj->ni", np.linalg.pinv(gram, rcond=1e-11, hermitian=True), right)


def _solved(k: int):  # noqa: ANN202
    rows, cols = np.triu_indices(k)

    def run(sums: pa.Array) -> pa.Array:
        flat = sums.flatten().to_numpy(zero_copy_only=False).reshape(len(sums), -1)
        gram = np.zeros((len(flat), k, k))
        gram[:, rows, cols] = gram[:, cols, rows] = flat[:, : len(rows)]
        solution = solved_py(gram, flat[:, len(rows) :])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * k), pa.array(solution.ravel()))

    return F.arrow_udf(run, "array<double>")


def regression(df: DataFrame, by: list[str], categories: list[str], key: list[str], rounds: int = 1000) -> DataFrame:
    """Least squares of delta on category, standardised length and edit distance for each group, with percentile intervals.

    The first category present in a group is its baseline; a group needs three rows more than categories. Each round's
    normal equations are sums of products, so that rounds are drawn as any other sums are, and solved at the end. Where
    columns of a design can't be told apart, its least solution is taken.
    """
    own = df.where(F.col("delta").isNotNull() & F.col("category").isin(categories) & F.col("length").isNotNull() & F.col("edit_distance").isNotNull())
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category")) - 1
    own = own.select(*by, *[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], "delta", "length", "edit_distance", place.alias("place"))
    about = own.groupBy(*by).agg(
        F.count("*").alias("rows"), F.collect_set("place").alias("present"), F.min("place").alias("base"),
        *[f(c).alias(f"{c}_{name}") for c in ("length", "edit_distance") for name, f in (("mean", F.avg), ("sd", F.stddev_pop))],
    ).where(F.col("rows") >= F.size("present") + 3)
    z = lambda c: F.when(F.col(f"{c}_sd") > 1e-9, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).otherwise(0.0)
    few = about.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    wide = own.join(F.broadcast(about) if few else about, by)
    names = ["intercept", *[f"cat={c}" for c in categories], "length_z", "editdist_z"]
    design = [F.lit(1.0), *[((F.col("place") == i) & (F.col("base") != i)).cast("double") for i in range(len(categories))], z("length"), z("edit_distance")]
    k = len(design)
    wide = wide.withColumns({f"x{i}": x for i, x in enumerate(design)})
    products = {f"g{i}_{j}": F.col(f"x{i}") * F.col(f"x{j}") for i in range(k) for j in range(i, k)} | {f"r{i}": F.col(f"x{i}") * F.col("delta") for i in range(k)}
    sums = counted(wide.withColumns(products), by, [f"__k{i}" for i in range(len(key))], list(products), rounds)
    solved = sums.select(*by, "turn", F.posexplode(_solved(k)(F.array(*products))).alias("i", "b"))
    # percentiles of all draws of a coefficient, as many as there are rounds
    out = solved.groupBy(*by, "i").agg(F.max(F.when(F.col("turn") == POINT, F.col("b"))).alias("estimate"), *[F.percentile(F.when(F.col("turn") >= 0, F.col("b")), p).alias(name) for name, p in (("lo", 0.025), ("hi", 0.975))])
    shown = F.col("i").isin(0, k - 2, k - 1) | (F.array_contains("present", F.col("i").cast("long") - 1) & (F.col("i") - 1 != F.col("base")))
    out = out.join(about.select(*by, "present", "base"), by).where(shown)
    return out.select(*by, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("name"), "estimate", "lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))
