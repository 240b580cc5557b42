"""Paired scores: differences, roll-ups, alignment of systems, ladders.

A score table has system, category, item, clean and noisy; delta is clean minus noisy, positive if noise hurts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_delta(df: DataFrame, clean: str = "clean", noisy: str = "noisy", name: str = "delta") -> DataFrame:
    return df.withColumn(name, F.col(clean) - F.col(noisy))


def relative(delta: Column, clean: Column) -> Column:
    """Share of the clean score that is lost; null where that is null or zero."""
    return F.try_divide(delta, clean)


def scope_rollup(df: DataFrame, digits: int = 4) -> DataFrame:
    """Count and means by system over all, and by system and category; one pass with grouping sets."""
    mean = lambda c: F.round(F.avg(c), digits)
    out = with_delta(df).groupingSets([["system"], ["system", "category"]], "system", "category")
    out = out.agg(F.count("*").alias("n"), mean("noisy").alias("mean_noisy"), mean("clean").alias("mean_clean"), mean("delta").alias("mean_delta"), F.grouping("category").alias("g"))
    return out.select("system", F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("scope"), "n", "mean_noisy", "mean_clean", "mean_delta")


def summary(df: DataFrame, model: str, metrics: list[str], scoreable: Column | None = None) -> DataFrame:
    """Summary rows: for each metric the means of both sides and of the difference, over all and by category.

    Rows that aren't scoreable count in n, not in n_nta or the term accuracy.
    """
    ok = F.lit(True) if scoreable is None else scoreable
    aggs = [F.count("*").alias("n"), F.count_if(ok).alias("n_nta")]
    for m in metrics:
        use = ok if m == "nta" else F.lit(True)
        for side in ("noisy", "clean"):
            aggs.append(F.avg(F.when(use, F.col(f"{m}_{side}"))).alias(f"{m}_{side}"))
        aggs.append(F.avg(F.when(use, F.col(f"{m}_clean") - F.col(f"{m}_noisy"))).alias(f"{m}_delta"))
    out = df.groupingSets([[model], [model, "category"]], model, "category").agg(*aggs, F.grouping("category").alias("g"))
    out = out.withColumn("scope", F.when(F.col("g") == 1, "all").otherwise(F.col("category"))).drop("g", "category")
    if {"xcomet_delta", "xcomet_clean"} <= set(out.columns):
        out = out.withColumn("rel_delta", relative(F.col("xcomet_delta"), F.col("xcomet_clean")))
    return out


def item_means(df: DataFrame) -> DataFrame:
    """One difference for each system and item."""
    return with_delta(df).groupBy("system", "item").agg(F.avg("delta").alias("delta"))


def align(df: DataFrame, pairs: DataFrame, key: str = "item", value: str = "delta") -> DataFrame:
    """Items that both systems of a pair (hi, lo) have scored, with both values. The pair list is tiny by nature:
    it names systems, not items, and Spark broadcasts it by its size."""
    scored = df.where(F.col(value).isNotNull())
    hi = scored.select(F.col("system").alias("hi"), F.col(key), F.col(value).alias("value_hi"))
    lo = scored.select(F.col("system").alias("lo"), F.col(key), F.col(value).alias("value_lo"))
    return pairs.join(hi, "hi").join(lo, ["lo", key]).select("hi", "lo", key, "value_hi", "value_lo")


def align_items(df: DataFrame, pairs: list[tuple[str, str]], key: str = "item", value: str = "delta", category: str | None = None) -> DataFrame:
    """The same from scored rows, for a list of pairs: the means of all systems of an item are made in one row of it.

    ``category``: only items whose first system of a pair has rows of it.
    """
    if category is not None:
        out = [align_items(df.where((F.col("system") != hi) | (F.col("category") == category)), [(hi, lo)], key, value) for hi, lo in pairs]
        return reduce(DataFrame.unionByName, out)
    names = sorted({s for pair in pairs for s in pair})
    own = df.groupBy(key).agg(*[F.avg(F.when(F.col("system") == s, F.col(value))).alias(f"__{i}") for i, s in enumerate(names)])
    at = {s: F.col(f"__{i}") for i, s in enumerate(names)}
    each = F.array(*[F.struct(F.lit(hi).alias("hi"), F.lit(lo).alias("lo"), at[hi].alias("value_hi"), at[lo].alias("value_lo")) for hi, lo in pairs])
    both = F.filter(each, lambda p: p["value_hi"].isNotNull() & p["value_lo"].isNotNull())
    return own.select(key, F.explode(both).alias("p")).select("p.hi", "p.lo", key, "p.value_hi", "p.value_lo")


def pair_means(aligned: DataFrame, digits: int = 4) -> DataFrame:
    return aligned.groupBy("hi", "lo").agg(
        F.count("*").alias("n"),
        F.round(F.avg("value_hi"), digits).alias("mean_hi"),
        F.round(F.avg("value_lo"), digits).alias("mean_lo"),
        F.round(F.avg("value_hi") - F.avg("value_lo"), digits).alias("diff"),
    )


def shared_items(df: DataFrame, n_systems: int | None = None) -> DataFrame:
    """Items that all systems have; counted, not collected, so one shuffle on the item."""
    each = df.groupBy("item").agg(F.count_distinct("system").alias("have"))
    total = df.agg(F.count_distinct("system").alias("total")) if n_systems is None else df.sparkSession.range(1).select(F.lit(n_systems).alias("total"))
    return each.crossJoin(F.broadcast(total)).where("have = total").select("item")


def shared_counts(df: DataFrame) -> DataFrame:
    """How many items all systems share, and how many are dropped for that."""
    each = df.groupBy("item").agg(F.count_distinct("system").alias("have"))
    total = F.broadcast(df.agg(F.count_distinct("system").alias("total")))
    return each.crossJoin(total).agg(F.count_if(F.col("have") == F.col("total")).alias("n_shared"), F.count_if(F.col("have") < F.col("total")).alias("n_dropped"))


def category_grid(df: DataFrame, categories: DataFrame, value: str = "delta") -> DataFrame:
    """Mean of each category of a fixed list and of all; null where a category is absent."""
    own = df.groupBy("category").agg(F.avg(value).alias("mean"))
    whole = df.agg(F.avg(value).alias("mean")).select(F.lit("all").alias("category"), "mean")
    return categories.join(own, "category", "left").select("category", "mean").unionByName(whole)


def contamination_gap(a: DataFrame, b: DataFrame, categories: DataFrame, digits: int = 4) -> DataFrame:
    """By system and category of the grid, the mean difference on either table and their gap; null if one lacks it."""
    systems = a.select("system").distinct().join(b.select("system").distinct(), "system", "left_semi")
    grid = systems.crossJoin(categories.select("category").unionByName(categories.limit(1).select(F.lit("all").alias("category"))))

    def means(df: DataFrame, name: str) -> DataFrame:
        out = df.groupingSets([["system"], ["system", "category"]], "system", "category").agg(F.avg("delta").alias(name), F.grouping("category").alias("g"))
        return out.select("system", F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), name)

    out = grid.join(means(a, "a"), ["system", "category"], "left").join(means(b, "b"), ["system", "category"], "left")
    return out.select("system", "category", F.round("a", digits).alias("delta_a"), F.round("b", digits).alias("delta_b"), F.round(F.col("a") - F.col("b"), digits).alias("gap"))


def contamination_gap_by(df: DataFrame, first: Column, categories: list[str], digits: int = 4) -> DataFrame:
    """The same for one table whose rows a condition divides, and a list of categories: one pass, one row for each system."""
    aggs = []
    for i, c in enumerate([None, *categories]):
        own = F.lit(True) if c is None else F.col("category") == c
        aggs += [F.avg(F.when(side & own, F.col("delta"))).alias(f"__{name}{i}") for name, side in (("a", first), ("b", ~first))]
    each = [F.struct(F.lit("all" if c is None else c).alias("category"), F.col(f"__a{i}").alias("a"), F.col(f"__b{i}").alias("b")) for i, c in enumerate([None, *categories])]
    have = [F.count_if(first).alias("__na"), F.count_if(~first).alias("__nb")]
    out = df.groupBy("system").agg(*aggs, *have).where("__na > 0 and __nb > 0").select("system", F.explode(F.array(*each)).alias("c")).select("system", "c.*")
    return out.select("system", "category", F.round("a", digits).alias("delta_a"), F.round("b", digits).alias("delta_b"), F.round(F.col("a") - F.col("b"), digits).alias("gap"))


def category_pivot(df: DataFrame, categories: list[str], digits: int = 4) -> DataFrame:
    """A row for each system with the count and mean difference of each category; the list is given, so one pass."""
    cells = []
    for c in categories:
        name = c.lower().replace("-", "_").replace(" ", "_")
        own = F.col("category") == c
        cells += [F.count_if(own).alias(f"{name}_n"), F.round(F.avg(F.when(own, F.col("delta"))), digits).alias(f"{name}_delta")]
    return with_delta(df).groupBy("system").agg(*cells)


def tiers_long(df: DataFrame, tiers: dict[str, tuple[str, str]], key: str = "item") -> DataFrame:
    """One row for each tier, item: tiers map a name to (system, column)."""
    parts = [df.where(F.col("system") == s).select(F.lit(t).alias("tier"), key, F.col(c).alias("score")) for t, (s, c) in tiers.items()]
    return reduce(DataFrame.unionByName, parts)


def ladder_items(df: DataFrame, tiers: dict[str, Column], base: str, anchor: str, key: str = "item", digits: int = 4) -> DataFrame:
    """The ladder of scored rows in one pass: tiers map a name, in order, to the score of its rows, null on others."""
    names = list(tiers)
    own = df.groupBy(key).agg(*[F.avg(c).alias(f"__{i}") for i, c in enumerate(tiers.values())]).dropna(subset=[f"__{i}" for i in range(len(names))])
    means = own.agg(F.count("*").alias("n"), *[F.avg(f"__{i}").alias(f"__{i}") for i in range(len(names))])
    low, high = F.col(f"__{names.index(base)}"), F.col(f"__{names.index(anchor)}")
    each = [F.struct(F.lit(t).alias("tier"), F.lit(i).cast("bigint").alias("place"), F.col(f"__{i}").alias("m")) for i, t in enumerate(names)]
    out = means.where("n > 0").select("n", low.alias("low"), high.alias("high"), F.explode(F.array(*each)).alias("t")).select("t.*", "n", "low", "high")
    return out.select("tier", "place", "n", F.round("m", digits).alias("score"), F.round(F.col("high") - F.col("m"), digits).alias("delta_vs_clean"), F.round(F.col("m") - F.col("low"), digits).alias("recovery"))


def ladder(tiers: DataFrame, base: str, anchor: str, order: list[str], digits: int = 4) -> DataFrame:
    """Mean score of each tier over the items that all tiers have; what is missing to the anchor; what is won from the
    base."""
    keep = shared_items(tiers.withColumnRenamed("tier", "system"), len(order))
    means = tiers.join(keep, "item", "left_semi").groupBy("tier").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    ends = means.agg(F.max(F.when(F.col("tier") == base, F.col("m"))).alias("low"), F.max(F.when(F.col("tier") == anchor, F.col("m"))).alias("high"))
    out = with_order(means.crossJoin(F.broadcast(ends)), "tier", order)
    return out.select("tier", "place", "n", F.round("m", digits).alias("score"), F.round(F.col("high") - F.col("m"), digits).alias("delta_vs_clean"), F.round(F.col("m") - F.col("low"), digits).alias("recovery"))


def disagreement(df: DataFrame, gap: float = 20.0, high: float = 80.0) -> DataFrame:
    """Rows where two metrics disagree on the effect of noise, or a high score goes with a missed term, with why."""
    apart = F.abs(F.col("first_d") - F.col("second_d"))
    reasons = F.array_compact(F.array(F.when(apart >= gap, "metrics disagree"), F.when((F.col("first_noisy") >= high) & (F.col("hit_noisy") == 0), "high score, term missed")))
    out = df.withColumn("severity", F.coalesce(apart, F.lit(0.0))).withColumn("reasons", F.array_join(reasons, "; "))
    return out.where(F.size(reasons) > 0)


def with_order(df: DataFrame, column: str, first: list[str], name: str = "place") -> DataFrame:
    """A place for each value: the listed ones in their order, others 99."""
    place = F.when(F.lit(False), 0)
    for i, v in enumerate(first):
        place = place.when(F.col(column) == v, i)
    return df.withColumn(name, place.otherwise(99).cast("long"))


def zscore(df: DataFrame, value: str, by: str, name: str = "z") -> DataFrame:
    """Standard score within a group; zero where the group has no spread.

    Moments are aggregated and joined back, so that a large group isn't gathered in one window.
    """
    m = df.groupBy(by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    out = df.join(m, by)
    return out.withColumn(name, F.when(F.col("__s") > 1e-9, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the first place of its key and whether it comes later; by aggregate and join, not by window."""
    first = df.groupBy(key).agg(F.min(order).alias("first_at"))
    return df.join(first, key).withColumn("is_repeat", F.col(order) > F.col("first_at"))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last; one of each key and task is left before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    own = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return own.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def weighted(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))
