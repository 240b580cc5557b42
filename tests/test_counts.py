import random

import numpy as np
import pandas as pd
import pytest
from deltaspan.operators import counts as N
from deltaspan.operators import resample as R
from pyspark.sql import functions as F


def halves(n):
    return np.random.default_rng(1).integers(0, 1 << 28, (2, n))


def test_law():
    """Counts follow the law, and neither items nor rounds go together, also where keys follow one another."""
    w = N.counts_py(*halves(2000), np.arange(2000)).astype(float)
    assert abs(w.mean() - 1) < 0.003 and abs(w.var() - 1) < 0.005
    assert np.abs(np.bincount(w.astype(int).ravel())[:4] / w.size - [0.3679, 0.3679, 0.1839, 0.0613]).max() < 0.001
    near = N.counts_py(np.arange(2000), np.arange(2000), np.arange(2000)).astype(float)
    for each in (w, w.T, near, near.T):
        c = np.corrcoef(each[:400])[np.triu_indices(400, 1)]
        assert abs(c.mean()) < 0.001 and c.std() < 1.2 / np.sqrt(2000)
        assert abs(np.mean([np.corrcoef(each[i], each[i + 1])[0, 1] for i in range(300)])) < 0.005
    assert abs(near.sum(axis=0).std() / np.sqrt(2000) - 1) < 0.1


def test_plain_integers():
    """The same counts by integers without a bound."""
    x, y = halves(40)
    for i in range(40):
        for turn in (0, 1, 999):
            h = (int(x[i]) * 48271 + turn * 16807 + 1) % N.PRIME
            for more in (int(y[i]), turn, int(x[i])):
                h = (h * h + more) % N.PRIME
            assert N.counts_py(x[i : i + 1], y[i : i + 1], np.array([turn]))[0, 0] == sum(h >= t for t in N.LIMITS)


def rows(n, seed=3):
    rng = random.Random(seed)
    return [(s, i, rng.gauss(k, 2) if i % 9 else None, rng.gauss(0, 1)) for k, s in enumerate(["A", "B", None]) for i in range(n)]


def test_sums(spark):
    """Sums by group and round, however the rows are dealt: null groups, null values, more groups than a task holds."""
    data = rows(80) + [(f"g{i}", i, 1.0, 2.0) for i in range(150)]
    df = spark.createDataFrame(data, "s string, i int, v double, u double")
    plain = {}
    key = {r["i"]: (r["x"], r["y"]) for r in df.select("i", *[h.alias(n) for h, n in zip(N.key_halves(["i"]), "xy")]).distinct().collect()}
    for s, i, v, u in data:
        if v is not None:
            x, y = key[i]
            w = np.concatenate([[1], N.counts_py(np.array([x]), np.array([y]), np.arange(30))[0]])
            plain[s] = plain.get(s, 0) + np.outer(w, [1, v, u])
    for parts in (1, 5):
        got = N.counted(df.repartition(parts), ["s"], ["i"], ["v", "u"], 30).collect()
        assert len(got) == 31 * len(plain)
        for r in got:
            assert np.allclose([r["n"], r["v"], r["u"]], plain[r["s"]][r["turn"] + 1])
    assert N.counted(df.where("i < 0"), ["s"], ["i"], ["v"], 30).count() == 0


@pytest.mark.parametrize("n", [120, 900])
def test_near_full_draws(spark, n):
    """Bounds are those of the full draws but for what two runs of these differ by: a tenth of the interval."""
    data = rows(n)
    df = spark.createDataFrame(data, "s string, i int, v double, u double")
    got = {r["s"]: r for r in N.mean_interval(df, ["s"], "v", ["i"]).collect()}
    for s in ("A", "B", None):
        own = [v for t, _, v, _ in data if t == s and v is not None]
        lo, hi = R.mean_interval_py(own, 2000)
        again = R.mean_interval_py(own, 2000, 1)
        wide = hi - lo
        assert max(abs(lo - again[0]), abs(hi - again[1])) < 0.1 * wide
        assert got[s]["n"] == len(own) and got[s]["mean"] == pytest.approx(np.mean(own))
        assert abs(got[s]["ci_lo"] - lo) < 0.1 * wide and abs(got[s]["ci_hi"] - hi) < 0.1 * wide
    pairs = df.select("s", "i", F.col("v").alias("value_hi"), F.col("u").alias("value_lo"))
    for r in N.paired_interval(pairs, ["s"], ["i"]).collect():
        own = [(v, u) for t, _, v, u in data if t == r["s"] and v is not None]
        want = R.paired_py(*zip(*own))
        assert r["diff"] == pytest.approx(want["diff"]) and abs(r["ci_lo"] - want["lo"]) < 0.1 * (want["hi"] - want["lo"]) and abs(r["p"] - want["p"]) < 0.1
    counts = [(i, rng % 2, 1 + rng % 3) for i, rng in enumerate(random.Random(7).choices(range(30), k=n))]
    ratio = N.ratio_interval(spark.createDataFrame(counts, "i int, a int, b int").withColumn("g", F.lit("x")), ["g"], "a", "b", ["i"]).first()
    mean, lo, hi = R.ratio_frozen_py({"x": [(a, b) for _, a, b in counts]}, 2000)["x"]
    assert abs(ratio["mean"] - mean) < 0.005 and abs(ratio["ci_lo"] - lo) < 0.1 * (hi - lo) and abs(ratio["ci_hi"] - hi) < 0.1 * (hi - lo)


def test_few_items(spark):
    """One item is always drawn; equal values have no spread; a ratio to zero is zero."""
    df = spark.createDataFrame([("one", 1, 4.0, 0), ("two", 2, 5.0, 0), ("two", 3, 5.0, 0)], "s string, i int, v double, z int")
    assert {(r["s"], r["n"], r["mean"], r["ci_lo"], r["ci_hi"]) for r in N.mean_interval(df, ["s"], "v", ["i"], 300).collect()} == {("one", 1, 4.0, 4.0, 4.0), ("two", 2, 5.0, 5.0, 5.0)}
    assert {(r["mean"], r["ci_lo"], r["ci_hi"]) for r in N.ratio_interval(df, ["s"], "v", "z", ["i"], 50).collect()} == {(0.0, 0.0, 0.0)}


CATEGORIES = ["HOM", "PYA", "NEO", "MIX"]


def regression_rows(n, kinds, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c, edit = rng.choice(kinds), rng.randrange(6)
        out.append((i, c, rng.randrange(5, 50), edit, None if i % 17 == 3 else 5 + 2 * edit + 3 * (c == "MIX") + rng.gauss(0, 1)))
    return out


@pytest.mark.parametrize("kinds", [CATEGORIES, ["PYA", "MIX"], ["NEO"]])
def test_regression(spark, kinds):
    """Estimates are those of least squares, intervals near those of the plain draws; the first category present is the baseline."""
    data = regression_rows(400, kinds)
    df = spark.createDataFrame(data, "pos int, category string, length int, edit_distance int, delta double").withColumn("system", F.lit("s"))
    want = R.regression_py(pd.DataFrame(data, columns=["pos", "category", "length", "edit_distance", "delta"]), CATEGORIES, 1000).set_index("name")
    got = {r["name"]: r for r in N.regression(df.repartition(3), ["system"], CATEGORIES, ["pos"]).collect()}
    assert set(got) == set(want.index)
    for name, r in got.items():
        wide = want.hi[name] - want.lo[name]
        assert r["estimate"] == pytest.approx(want.estimate[name], abs=1e-8)
        assert abs(r["lo"] - want.lo[name]) < 0.15 * wide and abs(r["hi"] - want.hi[name]) < 0.15 * wide
    assert got["editdist_z"]["excludes_zero"]


def test_regression_odd(spark):
    """No spread, columns that can't be told apart, too few rows, unknown categories and no rows; no group goes to one task."""
    data = [("flat", i, CATEGORIES[i % 2], 7, 3, float(i)) for i in range(20)] + [("same", i, "HOM", i, i, float(i)) for i in range(20)] + [("few", i, "HOM", i, i % 2, 1.0) for i in range(3)]
    data += [("none", i, "other", 1, 1, 1.0) for i in range(9)]
    df = spark.createDataFrame(data, "system string, pos int, category string, length int, edit_distance int, delta double")
    out = N.regression(df, ["system"], CATEGORIES, ["pos"], 50)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["system"], r["name"]): r["estimate"] for r in out.collect()}
    assert {s for s, _ in got} == {"flat", "same"}
    assert got["flat", "length_z"] == got["flat", "editdist_z"] == 0 and got["flat", "intercept"] == pytest.approx(9) and got["flat", "cat=PYA"] == pytest.approx(1)
    assert got["same", "length_z"] == pytest.approx(got["same", "editdist_z"]) and got["same", "length_z"] == pytest.approx(np.std(range(20)) / 2)
    assert N.regression(df.where("pos < 0"), ["system"], CATEGORIES, ["pos"], 50).count() == 0


def test_keys_counted_once(spark):
    """Rows of a key that follow one another share its counts, whatever their groups; the sums are those of the rows apart."""
    df = spark.createDataFrame([(s, i, float(i % 7 + k)) for i in range(300) for k, s in enumerate(["A", "B", None])], "s string, i int, v double")
    together = N.side_by_side(df.orderBy("s", "i"), "i").coalesce(1)
    ids = [r["i"] for r in together.collect()]
    assert len(ids) == 900 and sum(a != b for a, b in zip(ids, ids[1:])) == 299
    got = {(r["s"], r["turn"]): (r["n"], r["v"]) for r in N.counted(together, ["s"], ["i"], ["v"], 20).collect()}
    apart = {(r["s"], r["turn"]): (r["n"], r["v"]) for r in N.counted(df.orderBy("s", "i"), ["s"], ["i"], ["v"], 20).collect()}
    assert got == apart and len(got) == 63


def test_rows_by_item(spark, monkeypatch):
    """What is grouped by item is dealt over as many tasks as its rows need, and by one exchange of either table."""
    import os

    from deltaspan import registry
    from deltaspan.plans import adapters

    if not os.path.isdir(sf := "/root/testdata/sf0.001"):
        return
    query = registry.queries()["paired_relative_delta"]
    want = sorted(map(tuple, query(spark, sf).collect()))
    monkeypatch.setattr(adapters, "ITEM_ROWS", 500)
    out = query(spark, sf)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert n > 5 and "hashpartitioning(l_orderkey" in plan and plan.count(f", {n}), REPARTITION_BY_NUM") == 2 and plan.count("hashpartitioning") == 2
    assert sorted(map(tuple, out.collect())) == want
