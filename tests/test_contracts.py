"""Readers by role, prediction contracts and ingest steps that no registered query reaches."""

import json

import pytest
from deltaspan.operators import spans as M
from deltaspan.operators import validate as V
from deltaspan.sources import readers as R
from deltaspan.sources import writers as W
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string,type:string,confidence:double,candidates:array<string>>>"
LINES = f"uid string, src_noisy string, spans {SPAN}, model_version string, pos int"


def lines(spark, *rows):
    return spark.createDataFrame(rows, LINES)


def test_prediction_errors(spark):
    records = spark.createDataFrame([("a", "abcdef"), ("b", "xyz"), ("c", "left out"), ("d", "q")], "uid string, src_noisy string")
    ok = (0, 2, "ab", "HOM", 0.5, ["x"])
    df = lines(
        spark, ("a", "abcdef", [ok, (1, 3, "bc", "NEO", 0.5, None)], "v1", 0), ("a", "abcdef", [], "v1", 1),
        ("b", "xyz", [(0, 9, "xyz", "HOM", 0.1, None), (0, 1, "y", "???", 2.0, [""])], "", 2), ("d", "other", [], "v1", 3), ("z", "unknown", [], "v1", 4),
    )
    strict = {(r["uid"], r["error"]) for r in V.prediction_errors(df, records).collect()}
    assert strict == {
        ("a", "span 1: overlaps another"), ("a", "repeated uid"), ("b", "span 0: bad offsets"), ("b", "span 1: text differs from the source"), ("b", "span 1: bad type"),
        ("b", "span 1: bad confidence"), ("b", "span 1: empty candidate"), ("b", "no model version"), ("d", "source differs"), ("z", "unknown uid"), ("c", "no prediction"),
    }
    assert ("z", "unknown uid") not in {(r["uid"], r["error"]) for r in V.prediction_errors(df, records, allow_extra=True).collect()}


def test_valid_predictions(spark):
    records = spark.createDataFrame([("a", "abcdef"), ("b", "xyz")], "uid string, src_noisy string")
    # the looser check passes a missing source, overlaps and missing confidences
    good = lines(spark, ("a", None, [(0, 2, "ab", "HOM", None, None), (1, 3, "bc", "NEO", None, None)], None, 0))
    assert V.valid_predictions(good, records).count() == 1
    with pytest.raises(V.InvalidData, match="a: span 0: bad offsets"):
        V.valid_predictions(lines(spark, ("a", "abcdef", [(2, 2, "", "HOM", None, None)], None, 0)), records)


def test_clean_side(spark):
    records = spark.createDataFrame([("a",), ("b",)], "uid string")
    out = spark.createDataFrame([("a", "A"), ("b", "B"), ("x", "")], "uid string, hyp_clean string")
    assert {tuple(r) for r in R.clean_side(out, records).collect()} == {("a", "A"), ("b", "B")}
    with pytest.raises(R.InvalidData, match="no clean side for b"):
        R.clean_side(out.withColumn("hyp_clean", F.when(F.col("uid") == "b", " ").otherwise(F.col("hyp_clean"))), records)


def test_tiers_and_arms(spark, tmp_path):
    cells = {f"{m}_{side}": float(i + (side == "clean")) for i, m in enumerate(R.METRICS) for side in ("noisy", "clean")}
    base = spark.createDataFrame([("a", "HOM", *cells.values())], "uid string, category string, " + ", ".join(f"{c} double" for c in cells))
    got = {r["tier"]: r for r in R.tiers({"a1": base}, base).collect()}
    assert set(got) == {"a0", "a1", "a4"} and got["a4"][R.METRICS[0]] == got["a0"][R.METRICS[0]] + 1 == got["a1"][R.METRICS[0]] + 1
    with pytest.raises(R.InvalidData):
        R.tiers({"a0": base}, base)
    for stem in ("m-b0", "m-b1"):
        own = base.withColumns({c: F.lit("t") for c in R.TEXTS if c not in base.columns})
        W.segments(own, str(tmp_path / f"segments_{stem}.tsv"))
    out = R.arms(spark, str(tmp_path), {"b0": "m-b0", "b1": "m-b1", "b2": "m-b2"}, lambda p: not p.endswith("b2.tsv"))
    assert sorted(r["arm"] for r in out.select("arm").collect()) == ["b0", "b1"]
    assert R.arms(spark, str(tmp_path), {"b9": "none"}, lambda p: False) is None


def test_logs_and_pool(spark, tmp_path):
    log = tmp_path / "norm.jsonl"
    log.write_text(json.dumps({"uid": "a", "spans": [{"text": "x", "type": "HOM", "std": "y"}], "parse_ok": True}) + "\n" + json.dumps({"uid": "b", "spans": []}) + "\n")
    got = {r["uid"]: r for r in R.norm_logs(spark, str(log)).collect()}
    assert got["a"]["spans"][0]["std"] == "y" and got["b"]["parse_ok"] is None
    pool = tmp_path / "pool.jsonl"
    pool.write_text("\n".join(json.dumps({"noise_span": s}) for s in ("ab‖ｃd", "ab")) + "\n")
    assert sorted(r["word"] for r in R.pool_spans(spark, str(pool)).collect()) == ["ab", "cd"]


def test_synthetic_segments(spark):
    df = R.synthetic_segments(spark, 3, 40)
    assert df.count() == 120 and df.where("xcomet_clean not between 70 and 100 or xcomet_noisy > xcomet_clean").count() == 0
    again = R.synthetic_segments(spark, 3, 40)
    assert df.exceptAll(again).count() == 0 and R.synthetic_segments(spark, 3, 40, 2).exceptAll(df).count() > 0


def test_splice_status_and_served(spark):
    df = spark.createDataFrame([("ab", None, "ab"), ("ａb", None, "ab"), ("x", None, "ab"), (None, "bad", "ab")], "s string, e string, want string")
    assert [r["v"] for r in df.select(V.splice_status(df, "s", "e", "want").alias("v")).collect()] == ["ok", "nfkc_only", "mismatch", "splice_error"]
    ids = spark.createDataFrame([("m-1", ["m-1-2024", "n-1"])], "asked string, served array<string>")
    assert ids.select(V.served_mismatch(F.col("asked"), F.col("served")).alias("v")).first()["v"] == ["n-1"]


def test_quarantine(spark, tmp_path):
    rows = [(1, "A-HOM-1", "HOM", "noisy text here", "clean text here", "ok", "clean text\there", "a"), (2, "A-HOM-1", "HOM", "noisy text here", "c", "BLOCK", None, "a"), (3, "A-NEO-2", "HOM", "short", "c", "rewritten", "c", "a‖b‖c‖d‖e")]
    df = spark.createDataFrame(rows, "row int, uid string, category string, src_noisy string, src_clean string, verdict string, spliced string, noise_gold_en string")
    W.quarantine(df, str(tmp_path / "q"))
    read = lambda name: spark.read.csv(str(tmp_path / "q" / name), sep="\t", header=True).collect()
    assert [r["src_clean"] for r in read("kept")] == ["clean text here"] and [r["uid"] for r in read("review")] == ["A-NEO-2"] and len(read("blocked")) == 1
    assert {r["flag"] for r in read("flags") if r["uid"] == "A-NEO-2"} == {"category differs from uid", "length 5", "many golds"}


def test_sentence_confidence(spark):
    df = spark.createDataFrame([(0.9, 0.5, 0.5, 0.1), (None, 0.5, 0.5, 0.1), (None, None, 0.5, 0.1), (None, None, None, None)], "j double, l double, k double, s double")
    assert [r["v"] for r in df.select(M.sentence_confidence(F.col("j"), F.col("l"), F.col("k"), F.col("s")).alias("v")).collect()] == [0.9, 0.25, 0.1, 1.0]
