"""Calls that are asked once, whatever fails in between."""

import os

import pytest
from deltaspan.functions import models
from deltaspan.operators import outcomes as C
from deltaspan.sources import readers as R
from deltaspan.sources import writers as W
from pyspark.sql import functions as F


def counting(folder, fail_after=None):
    """A model that notes each prompt that it answered in a file of its own, and fails after some."""

    def make():
        def call(prompts):
            if fail_after is not None and len(os.listdir(folder)) >= fail_after:
                raise ConnectionError
            for p in prompts:
                with open(f"{folder}/{p}", "a") as f:
                    f.write("x")
            return [("" if p == "p7" else p.upper(), "served-1") for p in prompts]

        return call

    return make


def asked(folder):
    return {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder)}


def test_resume(spark, tmp_path):
    """A run that dies half way, and one that dies between two waves, repeat no call."""
    folder, log = tmp_path / "calls", str(tmp_path / "log")
    folder.mkdir()
    df = spark.createDataFrame([(i, f"p{i}" if i % 10 else None) for i in range(1, 100)] + [(1, "p1")], "k int, q string").repartition(3)
    with pytest.raises(models.Unanswered, match="calls of wave"):
        models.ask_once(df, "k", "q", "a", counting(folder, 20), log, wave=30, in_flight=2, batch=4)
    half = asked(folder)
    assert 20 <= len(half) < 40 and models.call_log(spark, log).count() == len(half)
    with pytest.raises(models.Unanswered):
        models.ask_once(df, "k", "q", "a", counting(folder, 60), log, wave=25, in_flight=3, batch=4)
    out = models.ask_once(df, "k", "q", "a", counting(folder), log, wave=25, in_flight=3, batch=4)
    assert out.columns == ["k", "q", "a", "a_served"] and out.count() == 100
    assert set(asked(folder).values()) == {1} and len(asked(folder)) == 90  # each prompt once, also of the repeated row
    got = {r["k"]: r for r in out.collect()}
    assert got[3]["a"] == "P3" and got[3]["a_served"] == "served-1" and got[7]["a"] == "" and got[10]["a"] is None
    models.ask_once(df, "k", "q", "a", counting(folder, 0), log).count()  # nothing is left to ask
    assert set(asked(folder).values()) == {1}


def test_reuse(spark, tmp_path):
    """Answers of an earlier run are used again, empty ones and changed prompts are asked; an empty table asks nothing."""
    folder, log = tmp_path / "calls", str(tmp_path / "log")
    folder.mkdir()
    old = spark.createDataFrame([(1, "p1", "one"), (2, "p2", " "), (3, "changed", "three")], "k int, q string, a string")
    models.seed_log(old, "k", "q", "a", log)
    models.seed_log(old, "k", "q", "a", log)
    df = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "k int, q string")
    out = models.ask_once(df, "k", "q", "a", counting(folder), log)
    assert {r["k"]: r["a"] for r in out.collect()} == {1: "one", 2: "P2", 3: "P3"} and set(asked(folder)) == {"p2", "p3"}
    assert models.ask_once(df.limit(0), "k", "q", "a", counting(folder, 0), str(tmp_path / "other")).count() == 0


def test_prediction_scan(spark, tmp_path):
    """Filled up and checked in one call: types by another field, text, confidence and gate by default; a record may have none."""
    path = tmp_path / "p.jsonl"
    good = ['{"uid": "a", "src_noisy": "xyz", "spans": [{"start": 0, "end": 1, "text": "x", "type": "hom", "confidence": 0.5}, {"start": 1, "end": 3, "category": "NEO"}]}', '{"uid": "b", "spans": null}', '{"uid": "c", "spans": [], "noise_present": true}']
    records = spark.createDataFrame([("a", "xyz"), ("b", "q"), ("c", "r"), ("d", "s")], "uid string, src_noisy string")
    path.write_text("\n\n".join(good) + "\n")
    got = {r["uid"]: r for r in R.valid_predictions(spark, str(path), records).collect()}
    assert [(s["start"], s["end"], s["text"], s["type"], s["confidence"]) for s in got["a"]["spans"]] == [(0, 1, "x", "HOM", 0.5), (1, 3, "yz", "NEO", 1.0)]
    assert [got[u]["noise_present"] for u in "abc"] == [True, False, True] and got["b"]["spans"] == []
    assert len(R.valid_predictions(spark, str(path), records, 0.9).where("uid = 'a'").first()["spans"]) == 1
    for bad, why in (('{"uid": "x"}', "unknown uid"), (good[1], "repeated"), ('{"uid": "d", "src_noisy": "t"}', "source differs"), ('{"uid": "d", "spans": [{"start": 0, "end": 1, "text": "q", "type": "HOM"}]}', "text differs"), ('{"uid": "d", "spans": [{"start": 0, "end": 1}]}', "bad type")):
        path.write_text("\n".join([*good, bad]))
        with pytest.raises(Exception, match=why):
            R.valid_predictions(spark, str(path), records)


def test_pool_and_benchmark(spark, tmp_path):
    head = "\t".join(R.REQUIRED)
    (tmp_path / "a.tsv").write_text(f"{head}\nu1\tA\thom\tx y\tz y\tr\tx\tg\n")
    (tmp_path / "b.tsv").write_text(f"{head}\tnoise_std\nu2\tB\tneo\tq\tw\tr\tq\tg‖h\tw\n")
    (tmp_path / "pool.jsonl").write_text('{"uid": "p", "src_noisy": "x"}\n\n{"uid": "q", "src_noisy": "y"}\n')
    pool, bench = R.pool_and_benchmark(spark, str(tmp_path / "pool.jsonl"), [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")])
    assert pool.count() == 2
    assert {(r["uid"], r["category"], len(r["gold_en"]), r["file"][-5:]) for r in bench.collect()} == {("u1", "HOM", 1, "a.tsv"), ("u2", "NEO", 2, "b.tsv")}
    with pytest.raises(Exception, match="no benchmark"):
        R.pool_and_benchmark(spark, str(tmp_path / "pool.jsonl"), [])


def test_strata_and_splice_reports(spark, tmp_path):
    rows = [("A", "xcomet", "miss", 3, 1.234, -0.5, 2.0, 0.04), ("A", "xcomet", "all", 9, 0.5, 0.1, 0.9, 0.0), ("B", "kiwi", "all", 2, -1.0, -2.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "table string, metric string, stratum string, n long, diff double, ci_lo double, ci_hi double, p double")
    text = W.strata(df, str(tmp_path / "strata"))
    assert text == (tmp_path / "strata.txt").read_text() and text.splitlines()[:2] == ["A xcomet", "  all: n=9 diff=0.50 [0.10, 0.90] p=0.0000"] and text.count("A xcomet") == 1
    lines = [x for p in sorted((tmp_path / "strata").glob("*.csv")) for x in p.read_text().splitlines()]
    assert lines[0] == "table\tmetric\tstratum\tn\tdiff\tci_lo\tci_hi\tp_boot" and lines[2] == "A\txcomet\tmiss\t3\t1.23\t-0.50\t2.00\t0.0400"
    checked = spark.createDataFrame([("B", "2", "ok", ""), ("A", "1", "ok", ""), ("A", "0", "differs", "x")], "table string, uid string, status string, detail string")
    assert W.splice_report(checked, str(tmp_path / "splice")) == {"ok": 2, "differs": 1}
    lines = [x for p in sorted((tmp_path / "splice").glob("*.csv")) for x in p.read_text().splitlines()]
    assert [x.split("\t")[:2] for x in lines[1:]] == [["A", "0"], ["A", "1"], ["B", "2"]]


def test_known(spark):
    results = spark.createDataFrame([("a", 1), ("b", 2)], "uid string, n int")
    assert [(r["uid"], r["n"], r["g"]) for r in C.known(results, spark.createDataFrame([("a", "x"), ("c", "y")], "uid string, g string")).collect()] == [("a", 1, "x")]


def test_synthetic_texts(spark):
    df = R.synthetic_segments(spark, 2, 60)
    assert df.where("src_clean = src_noisy or hyp_noisy is null").count() == 0 and {f"{m}_{s}" for m in R.METRICS for s in ("noisy", "clean", "d")} <= set(df.columns)
    spread = df.groupBy("category").agg(F.avg(F.levenshtein("src_clean", "src_noisy")).alias("e")).collect()
    assert len({round(r["e"], 3) for r in spread}) == 4
