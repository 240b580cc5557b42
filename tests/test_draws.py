"""Draws of the portable bootstraps, made many at a time, against the same draws as rows."""

import pytest
from deltaspan.operators import resample as R
from pyspark.sql import functions as F


@pytest.mark.parametrize("place", [R.hashed_place, R.quick_place])
def test_places(spark, place):
    """The same places as the expressions give, where numbers and rounds get a digit more and blocks end."""
    n, turns = 120_001, [0, 1, 9, 10, 99, 100, 1000, 1999]
    got = {t: [] for t in turns}
    for first, last in ((0, 2), (9, 11), (99, 101), (1000, 1001), (1999, 2000)):
        for turn, at in R.PLACES[place](range(first, last), n):
            got[turn].extend(at.tolist())
    own = spark.range(n).where("id < 30 or id % 997 < 3 or abs(id - 16384) < 3 or abs(id - 32768) < 3 or abs(id - 100000) < 3").crossJoin(spark.createDataFrame([(t,) for t in turns], "turn int"))
    for r in own.select("id", "turn", place(F.col("turn"), F.col("id"), F.lit(n)).alias("at")).collect():
        assert got[r["turn"]][r["id"]] == r["at"]
    assert all(len(x) == n for x in got.values())


@pytest.mark.parametrize("place", [R.hashed_place, R.quick_place])
@pytest.mark.parametrize("limits", [{}, {"HELD_ITEMS": 1024, "TASK_DRAWS": 5000}, {"OWN_GROUPS": 1}])
def test_draws(spark, monkeypatch, place, limits):
    """The sums of a join of all draws, for groups of several tasks, of several blocks, and of a task together; no draw is a row."""
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    rows = [(s, i, float(i * i % 91) if i % 7 else None, i % 3) for s, n in (("A", 2500), ("B", 1024), ("C", 1)) for i in range(n)]
    items = R.numbered(spark.createDataFrame(rows, "s string, i int, v double, u int").repartition(5), ["s"], ["i"])
    picked = items.select("s", "n", "pos", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("turn")).select("s", "turn", place(F.col("turn"), F.col("pos"), F.col("n")).alias("pos"))
    want = picked.join(items, ["s", "pos"]).groupBy("s", "turn").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"), F.sum("u").alias("u"), F.max("n").alias("n"))
    drawn = R.draws(items, ["s"], ["v", "u"], 12, place)
    columns = ["s", "turn", "v", "u", "n"]
    assert sorted(tuple(r) for r in drawn.select(columns).collect()) == sorted(tuple(r) for r in want.select(columns).collect())
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 11" not in plan and "md5" not in plan


def test_hashes_shared(spark, monkeypatch):
    """Groups that a task can hold together are drawn with one pass over the hashes: as many as the largest has, not as many as all have."""
    rows = [(s, i, float(i % 91)) for s, n in (("A", 700), ("B", 500), ("C", 300)) for i in range(n)]
    items = R.numbered(spark.createDataFrame(rows, "s string, i int, v double"), ["s"], ["i"])
    made, real = spark.sparkContext.accumulator(0), R.NUMBERS[R.quick_place]

    def counted(turns, n):
        for turn, first, hashes in real(turns, n):
            made.add(len(hashes))
            yield turn, first, hashes

    monkeypatch.setitem(R.NUMBERS, R.quick_place, counted)
    assert R.draws(items, ["s"], ["v"], 20, R.quick_place).count() == 60
    assert made.value == 20 * 700


def test_rows_made_once(spark):
    """A bootstrap's rows are made once, whatever reads them for the ranges, and then only packed rows are read again; rows without a group or a value are in none."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(s, i, float(i % 91)) for s, n in (("A", 1300), ("B", 700), (None, 5)) for i in range(n)] + [("A", -1, None)]
    own = spark.createDataFrame(rows, "s string, i int, v double").mapInArrow(counted, "s string, i int, v double")
    got = {r["s"]: r for r in R.mean_interval_portable(own, "s", "v", ["i"], 20, R.quick_place).collect()}
    assert made.value == 2006
    for s, n in (("A", 1300), ("B", 700)):
        v = [float(i % 91) for i in range(n)]
        m = sorted(sum(v[a] for _, at in R.PLACES[R.quick_place](range(t, t + 1), n) for a in at.tolist()) / n for t in range(20))
        assert (got[s]["n"], got[s]["mean"]) == (n, pytest.approx(sum(v) / n)) and [got[s][c] for c in ("ci_lo", "ci_hi")] == pytest.approx([m[0], m[19]])
    assert set(got) == {"A", "B"}


def test_paired_without_values(spark):
    """A pair that has no difference counts as zero in the draws and not in the mean."""
    rows = [("A", "N", i, None if i % 3 == 0 else float(i), 1.0) for i in range(1100)]
    (got,) = R.paired_portable(spark.createDataFrame(rows, "hi string, lo string, i int, value_hi double, value_lo double"), ["i"], 10).collect()
    v = [0.0 if i % 3 == 0 else i - 1.0 for i in range(1100)]
    m = sorted(round(sum(v[a] for _, at in R.PLACES[R.hashed_place](range(t, t + 1), 1100) for a in at.tolist()) / 1100, 6) for t in range(10))
    assert got["n"] == 1100 and got["diff"] == pytest.approx(sum(v) / sum(i % 3 > 0 for i in range(1100))) and (got["ci_lo"], got["ci_hi"]) == pytest.approx((m[0], m[9]), abs=2e-6)
