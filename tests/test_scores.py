import random

import numpy as np
import pandas as pd
import pytest
from deltaspan.operators import pairs as P
from deltaspan.operators import resample as R
from deltaspan.operators import spans as M
from pyspark.sql import functions as F


def test_mean_interval():
    assert R.mean_interval_py([7.0] * 24) == (7.0, 7.0)
    lo, hi = R.mean_interval_py([2.0, 12.0] * 22)
    assert lo < 7 < hi
    assert R.mean_interval_py([]) == (None, None)


def test_paired():
    same = R.paired_py([9.0] * 26, [3.0] * 26)
    assert (same["diff"], same["lo"], same["hi"], same["p"]) == (6, 6, 6, 0)
    none = R.paired_py([4.0] * 18, [4.0] * 18)
    assert (none["diff"], none["p"]) == (0, 1)
    apart = R.paired_py([7.0, 13.0] * 14, [1.0, 5.0] * 14)
    assert apart["diff"] == 7 and apart["lo"] > 0
    with pytest.raises(ValueError):
        R.paired_py([1.0], [1.0, 2.0])
    assert R.paired_py([], [])["diff"] is None


def test_stream():
    """The words of Python's generator, across chunks, and from a place on."""
    for n in (1, 2, 3, 7, 40, 1000, 65537, 100_001):
        for draw, plain in (("choices", lambda r, n: r.choices(range(n), k=n)), ("below", lambda r, n: [r.randrange(n) for _ in range(n)])):
            stream, rng = R.Stream.seeded(5), random.Random(5)
            for _ in range(3):
                assert getattr(stream, draw)(n, n).tolist() == plain(rng, n)
                key, pos, at = stream.place()
                stream = R.Stream(np.frombuffer(key, dtype=np.uint32), pos, at)


def test_frozen_draws(spark):
    """Every draw over several tasks, and the bounds, are those of the plain functions; a null is no value, an empty table no row."""
    rng = random.Random(2)
    rows = [(h, i, rng.random(), rng.random() + 0.1 * (h == "B")) for h, n in (("A", 37), ("B", 200), ("C", 1)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "hi string, item int, value_hi double, value_lo double").withColumn("lo", F.lit("x")).repartition(5)
    groups = R._in_order(df, ["hi"], "item", ["value_hi"])
    drawn = R._frozen_rounds(groups, ["hi"], "choices", R._mean_of, 400, R.SEED)
    assert drawn.select(F.spark_partition_id()).distinct().count() > 1
    for h in "ABC":
        values = [r[2] for r in sorted(r for r in rows if r[0] == h)]
        again = random.Random(R.SEED)
        assert [r["m"] for r in drawn.where(F.col("hi") == h).orderBy("turn").collect()] == [sum(again.choices(values, k=len(values))) / len(values) for _ in range(400)]
    got = {r["hi"]: r for r in R.paired_frozen(df, "item", 400).collect()}
    for h in "ABC":
        own = sorted(r for r in rows if r[0] == h)
        want = R.paired_py([r[2] for r in own], [r[3] for r in own], 400)
        assert (got[h]["n"], got[h]["ci_lo"], got[h]["ci_hi"], got[h]["p"]) == (want["n"], want["lo"], want["hi"], want["p"])
        assert got[h]["diff"] == pytest.approx(want["diff"]) and got[h]["gate"] == ("PASS" if want["lo"] > 0 else "fail")
    assert R.mean_interval_frozen(df.where("item < 0"), "hi", "value_hi", "item", 50).count() == 0
    nulls = df.withColumn("value_hi", F.when(F.col("item") % 2 == 0, F.col("value_hi")))
    assert {r["hi"]: r["n"] for r in R.mean_interval_frozen(nulls, "hi", "value_hi", "item", 50).collect()} == {"A": 19, "B": 100, "C": 1}


def test_frozen_equals_plain(spark):
    rng = random.Random(1)
    rows = [(s, i, rng.random()) for s in "AB" for i in range(40)]
    rng.shuffle(rows)
    got = {r["s"]: (r["lo"], r["hi"]) for r in R.mean_interval_frozen(spark.createDataFrame(rows, "s string, i int, v double").repartition(7), "s", "v", "i", 200).collect()}
    for s in "AB":
        assert got[s] == R.mean_interval_py([v for _, _, v in sorted(r for r in rows if r[0] == s)], 200)


def test_ratio_and_floor():
    got = R.ratio_frozen_py({"A": [(1, 1)] * 5, "B": [], "C": [(0, 1), (1, 1)]}, 100)
    assert got["A"] == (1.0, 1.0, 1.0) and "B" not in got and got["C"][1] <= 0.5 <= got["C"][2]
    low = R.random_floor_py([{"category": "HOM", "length": 20, "budget": 1, "gold": [[(0, 4)]]}], [4], 50)
    high = R.random_floor_py([{"category": "HOM", "length": 20, "budget": 8, "gold": [[(0, 4)]]}], [4], 50)
    assert 0 < low["HOM"][0] < high["HOM"][0] <= 1


def test_regression():
    rng = random.Random(3)
    rows = pd.DataFrame([{"category": ["HOM", "PYA"][i % 2], "length": rng.randint(5, 50), "edit_distance": e, "delta": 5 + 2 * e + rng.random()} for i in range(120) for e in [rng.randint(0, 5)]])
    out = R.regression_py(rows, ["HOM", "PYA", "NEO", "MIX"], 100)
    edit = out[out["name"] == "editdist_z"].iloc[0]
    assert list(out["name"]) == ["intercept", "cat=PYA", "length_z", "editdist_z"] and edit["estimate"] > 0 and edit["excludes_zero"]
    assert R.regression_py(rows.head(3), ["HOM", "PYA"]).empty


def test_regression_dealt(spark):
    """Each group's coefficients are those of the plain function, whose draws several tasks repeat; too few rows give none."""
    rng = random.Random(8)
    rows = [(s, i, ["HOM", "PYA", "NEO"][rng.randrange(3)], rng.randint(5, 50), e, None if i % 11 == 5 else 2 * e + rng.random()) for s, n in (("a", 60), ("b", 200), (None, 30), ("few", 4)) for i in range(n) for e in [rng.randint(0, 5)]]
    rng.shuffle(rows)
    names = ["system", "pos", "category", "length", "edit_distance", "delta"]
    df = spark.createDataFrame(rows, "system string, pos int, category string, length int, edit_distance int, delta double").where("system is not null").repartition(5)
    out = R.regression(df, "system", ["HOM", "PYA", "NEO", "MIX"], "pos", 300)
    got = {(r["system"], r["name"]): r for r in out.collect()}
    for s in "ab":
        want = R.regression_py(pd.DataFrame(sorted((r for r in rows if r[0] == s), key=lambda r: r[1]), columns=names), ["HOM", "PYA", "NEO", "MIX"], 300)
        for w in want.itertuples():
            r = got.pop((s, w.name))
            assert (r["estimate"], r["lo"], r["hi"]) == pytest.approx((w.estimate, w.lo, w.hi), rel=1e-9, abs=1e-9) and r["excludes_zero"] == w.excludes_zero
    assert not got


def test_portable_mean(spark):
    df = spark.createDataFrame([("A", i, 5.0) for i in range(30)], "s string, i int, v double")
    r = R.mean_interval_portable(df, "s", "v", ["i"], 50).first()
    assert (r["ci_lo"], r["mean"], r["ci_hi"]) == (5, 5, 5)


def test_ladder(spark):
    rows = [(t, 1, v) for t, v in zip(["a0", "a1", "a2", "a3", "a4"], [60.0, 70.0, 80.0, 85.0, 90.0])] + [("a0", 2, 1.0)]
    got = {r["tier"]: r for r in P.ladder(spark.createDataFrame(rows, "tier string, item int, score double"), "a0", "a4", ["a0", "a1", "a2", "a3", "a4"]).collect()}
    assert got["a2"]["recovery"] == 20 and got["a4"]["delta_vs_clean"] == 0 and got["a0"]["n"] == 1


def test_disagreement(spark):
    rows = [("d1", 5.0, 30.0, 50.0, 1), ("d2", 1.0, 2.0, 85.0, 0), ("d3", 1.0, 1.0, 50.0, 1), ("d4", None, 2.0, 90.0, 0)]
    got = P.disagreement(spark.createDataFrame(rows, "id string, first_d double, second_d double, first_noisy double, hit_noisy int")).orderBy(F.desc("severity"), "id").collect()
    assert [r["id"] for r in got] == ["d1", "d2", "d4"] and got[2]["severity"] == 0


def test_gap(spark):
    a = spark.createDataFrame([("m", "NEO", 10.0)] * 5, "system string, category string, delta double")
    b = spark.createDataFrame([("m", "NEO", 4.0)] * 5, "system string, category string, delta double")
    got = {r["category"]: r["gap"] for r in P.contamination_gap(a, b, spark.createDataFrame([("NEO",), ("HOM",)], "category string")).collect()}
    assert got == {"NEO": 6.0, "HOM": None, "all": 6.0}


def test_summary(spark):
    rows = [("NEO", 0, 100, True), ("HOM", 100, 100, True), ("NEO", 0, 0, False)]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, category string, nta_noisy int, nta_clean int, ok boolean")
    got = {r["scope"]: r for r in P.summary(df, "model", ["nta"], F.col("ok")).collect()}
    assert (got["all"]["n"], got["all"]["n_nta"], got["all"]["nta_noisy"], got["all"]["nta_clean"], got["all"]["nta_delta"]) == (3, 2, 50, 100, 50)
    assert got["NEO"]["nta_delta"] == 100 and got["HOM"]["nta_delta"] == 0


GOLD = [{"occ": [(0, 2), (5, 7)], "category": "HOM"}, {"occ": [(10, 12)], "category": "HOM"}]


def span(a, b, kind="HOM"):
    return {"start": a, "end": b, "type": kind}


def scored(spark, rows):
    """(gold, predictions[, gate]) of sentences as scored rows, in order."""
    schema = "uid int, gold_spans array<struct<occ:array<struct<start:int,end:int>>,category:string>>, spans array<struct<start:int,end:int,type:string>>, fired boolean"
    shown = [(i, [{"occ": [{"start": a, "end": b} for a, b in g["occ"]], "category": g["category"]} for g in r[0]] if r[0] is not None else None, r[1], r[2] if len(r) > 2 else None) for i, r in enumerate(rows)]
    return M.score_sentences(spark.createDataFrame(shown, schema), gate="fired").orderBy("uid").collect()


def by_hand(gold, found):
    """The greedy match by its rule: all pairs that touch, the most overlap first, then the order of gold and of predictions."""
    pairs = []
    for g, one in enumerate(gold):
        for p, f in enumerate(found):
            shares = [min(b, f["end"]) - max(a, f["start"]) for a, b in one["occ"]]
            if shares and max(shares) > 0:
                pairs.append((-max(shares), g, p, one["occ"][shares.index(max(shares))]))
    same = lambda g, p: (found[p]["type"] or "").upper() == (gold[g]["category"] or "").upper()
    n, left, free, exact_typed = dict.fromkeys(M.COUNTERS, 0), set(range(len(gold))), set(range(len(found))), False
    for lost, g, p, (a, b) in sorted(pairs):
        if g in left and p in free:
            left.remove(g)
            free.remove(p)
            exact = (a, b) == (found[p]["start"], found[p]["end"])
            half = -lost / (b - a + found[p]["end"] - found[p]["start"] + lost) >= 0.5
            exact_typed |= exact and same(g, p)
            for kind, yes in (("", True), ("_typed", same(g, p)), ("_exact", exact), ("_exact_typed", exact and same(g, p))):
                n["located" + kind] += yes
                n["predicted_hit" + kind] += yes
            n["located_iou50"] += half
            n["located_iou50_typed"] += half and same(g, p)
    for p in free:
        if touched := [g for _, g, q, _ in pairs if q == p]:
            n["predicted_hit"] += 1
            n["predicted_hit_typed"] += same(min(touched), p)
    n |= {"gold": len(gold), "predicted": len(found), "sentences": 1, "gate_fired": int(bool(found))}
    stratum = "miss" if not found else "fp_only" if not n["located"] else "exact" if exact_typed else "partial"
    return n, sorted(left), stratum


def test_match(spark):
    rows = [(GOLD, [span(5, 7), span(10, 12)]), (GOLD, []), (GOLD, [span(0, 2, "PYA")]), (GOLD, [span(0, 20)]), (GOLD[:1], [span(0, 2), span(1, 3)]), (None, None), (GOLD, [], True)]
    a, b, c, d, e, f, g = scored(spark, rows)
    assert a["located"] == a["located_exact_typed"] == a["predicted_hit"] == a["located_iou50"] == 2 and a["missed"] == []
    assert b["located"] == b["gate_fired"] == 0 and b["missed"] == [0, 1]
    assert (c["located"], c["located_typed"], c["predicted_hit_typed"]) == (1, 0, 0)
    # one prediction claims one gold; a second over the same gold is a hit, not located
    assert d["located"] == 1 and len(d["missed"]) == 1
    assert (e["located"], e["predicted_hit"], e["predicted_hit_exact"]) == (1, 2, 1)
    assert (f["gold"], f["predicted"], f["stratum"], f["missed"]) == (0, 0, "miss", [])
    assert g["gate_fired"] == 1


def test_match_by_hand(spark):
    """Random sentences with ties, overlapping and empty spans, several places of a gold span, and names that are null."""
    rng, rows = random.Random(12), []
    kinds = ["HOM", "hom", "PYA", None, ""]
    for _ in range(400):
        place = lambda: (lambda a: (a, a + rng.randrange(0, 6)))(rng.randrange(25))
        gold = [{"occ": [place() for _ in range(rng.randrange(4))], "category": rng.choice(kinds)} for _ in range(rng.randrange(6))]
        rows.append((gold, [span(*place(), rng.choice(kinds)) for _ in range(rng.randrange(8))]))
    for (gold, found), got in zip(rows, scored(spark, rows), strict=True):
        n, missed, stratum = by_hand(gold, found)
        assert {c: got[c] for c in M.COUNTERS} == n and got["missed"] == missed and got["stratum"] == stratum


def test_overlap_pairs(spark):
    """Against all pairs: widths from one to thousands, empty spans, repeated ones, a uid with a span over everything."""
    rng = random.Random(4)
    width = lambda: rng.choice([0, 1, 2, 15, 16, 17, 40, 255, 256, 257, 5000])
    spans = lambda n: [(rng.randrange(3), i, a, a + width()) for i in range(n) for a in [rng.randrange(4000)]]
    gold, found = [*spans(300), (0, 900, 0, 10000)], [*spans(300), (1, 901, 3, 9000)]
    g = spark.createDataFrame([(*r, "HOM") for r in gold], "uid int, gi int, start int, end int, category string")
    p = spark.createDataFrame([(*r, "HOM") for r in found], "uid int, pi int, start int, end int, type string")
    rows = M.overlap_pairs(g, p).collect()
    want = {(u, i, j): (min(b, d) - max(a, c), d - c + b - a) for u, i, a, b in gold for v, j, c, d in found if u == v and min(b, d) > max(a, c)}
    assert len(rows) == len(want) and all((r["overlap"], round(r["iou"], 9)) == (o, round(o / (t - o), 9)) for r in rows for o, t in [want[r["uid"], r["gi"], r["pi"]]])
    for usual in (1, 16, 17, 3000):  # a hint that is too small or too large changes nothing
        assert sorted(map(tuple, M.overlap_pairs(g, p, usual).collect())) == sorted(map(tuple, rows))
    assert M.overlap_pairs(g.where("uid > 9"), p).count() == M.overlap_pairs(g, p.where("uid > 9")).count() == 0


def test_overlap_pairs_of_one_document(spark):
    """200,000 spans of one uid and one that covers all of them: nothing is compared that isn't near."""
    n = 200_000
    g = spark.range(n).select(F.lit("u").alias("uid"), F.col("id").alias("gi"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 4).alias("end"), F.lit("HOM").alias("category"))
    p = g.select("uid", F.col("gi").alias("pi"), (F.col("start") + 2).alias("start"), (F.col("end") + 2).alias("end"), F.lit("HOM").alias("type"))
    p = p.unionByName(spark.sql(f"SELECT 'u' AS uid, CAST(-1 AS BIGINT) AS pi, CAST(0 AS BIGINT) AS start, CAST({7 * n} AS BIGINT) AS end, 'HOM' AS type"))
    assert M.overlap_pairs(g, p).agg(F.count("*").alias("n"), F.sum("overlap").alias("o")).first() == (2 * n, 2 * n + 4 * n)


def test_rates(spark):
    df = spark.createDataFrame([("u", GOLD_ROWS, [span(0, 2), span(20, 22)]), ("v", GOLD_ROWS, None)], "uid string, gold_spans array<struct<occ:array<struct<start:int,end:int>>,category:string>>, spans array<struct<start:int,end:int,type:string>>")
    scored = M.score_sentences(df)
    assert {r["uid"]: r["stratum"] for r in scored.collect()} == {"u": "exact", "v": "miss"}
    r = M.rates(M.merged(scored)).first()
    assert (r["span_recall"], r["span_precision"], r["gate_fire_rate"], r["gold_spans"]) == (0.25, 0.5, 0.5, 4)
    assert M.macro(M.rates(M.merged(scored, "uid"))).first()["macro_span_recall"] == 0.25


GOLD_ROWS = [{"occ": [{"start": a, "end": b} for a, b in g["occ"]], "category": g["category"]} for g in GOLD]


def test_characters(spark):
    g = spark.createDataFrame([("u", 0, 2), ("u", 5, 7)], "uid string, start int, end int")
    p = spark.createDataFrame([("u", 0, 2), ("u", 3, 4)], "uid string, start int, end int")
    r = M.character_sets(g, p).first()
    assert (r["gold_chars"], r["pred_chars"], r["overlap_chars"]) == (4, 3, 2)


def test_characters_by_hand(spark):
    """Random spans, empty, repeated, nested, longer than a block and at its borders, against sets of characters."""
    rng = random.Random(9)
    spans = lambda: [(rng.randrange(4), a, a + rng.choice([0, 1, 3, 59, 60, 61, 200])) for _ in range(150) for a in [rng.randrange(700)]]
    gold, found = spans(), [*spans(), (9, 60, 120)]
    chars = lambda rows, u: {c for v, a, b in rows if v == u for c in range(a, b)}
    kind = "uid int, start int, end int"
    got = {r["uid"]: tuple(r)[1:] for r in M.character_sets(spark.createDataFrame(gold, kind), spark.createDataFrame(found, kind)).collect()}
    assert got == {u: (len(chars(gold, u)), len(chars(found, u)), len(chars(gold, u) & chars(found, u))) for u in (0, 1, 2, 3, 9)}


def test_sentence_label(spark):
    df = spark.sql("SELECT array(named_struct('confidence', 0.04D, 'type', 'HOM'), named_struct('confidence', 0.81D, 'type', 'neo'), named_struct('confidence', 0.81D, 'type', 'MIX')) AS s")
    assert df.select(M.sentence_label(F.col("s")).alias("l")).first()["l"] == "NEO"
    assert df.select(M.sentence_label(F.filter("s", lambda x: x["type"] == "q")).alias("l")).first()["l"] == "NONE"


def test_regression_items():
    """A group's items come as columns, a code for a category; what they take beside their own buffers is a few bytes an item."""
    import tracemalloc

    import pyarrow as pa

    n = 50_000
    rng = np.random.default_rng(4)
    kinds = [["NEO", "HOM", None][i] for i in rng.integers(0, 3, n)]
    fields = {"category": pa.array(kinds), **{c: pa.array(rng.random(n)) for c in ("length", "edit_distance", "delta")}}
    items = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    tracemalloc.start()
    got = R._table_of(items, list(fields))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * n
    plain = pd.DataFrame(items.to_pylist())
    for categories in (["NEO", "HOM", "PYA"], ["PYA", "HOM"], ["HOM"]):
        (names, x, y), (own, u, v) = R._design(plain, categories), R._design(got, categories)
        assert names == own and np.array_equal(x, u) and np.array_equal(y, v)
