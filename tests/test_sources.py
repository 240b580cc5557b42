import json
import zipfile

import pytest
from deltaspan.functions import answers as A
from deltaspan.operators import overlap as O
from deltaspan.operators import validate as V
from deltaspan.sources import readers as I
from deltaspan.sources import writers as W
from pyspark.sql import functions as F

HEADER = "uid\ttable\tcategory\tsrc_noisy\tsrc_clean\tref_en\tnoise_span\tnoise_gold_en\tnoise_std\tsource_meta"
ROWS = [
    'F-HOM-001\tA\thom\t蚌埠住了，笑死我了\t绷不住了，笑死我了\t"a ""b""\nc"\t蚌埠住了\tx‖y\t绷不住了\t',
    "F-MIX-002\tB\tMIX\t分享一个vlog\t分享一个视频日志\tref\tvlog\t\t视频日志\t",
]


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_contrastive(spark, tmp_path):
    rows = {r["uid"]: r for r in I.contrastive(spark, write(tmp_path / "a.tsv", HEADER, *ROWS)).collect()}
    assert rows["F-HOM-001"]["category"] == "HOM" and rows["F-HOM-001"]["gold_en"] == ["x", "y"] and rows["F-HOM-001"]["ref_en"] == 'a "b"\nc'
    assert rows["F-MIX-002"]["gold_en"] == []
    for bad in ([HEADER, ROWS[0].replace("hom", "ZZZ")], [HEADER, ROWS[0], ROWS[0]], ["uid\ttable", "a\tb"], [HEADER]):
        with pytest.raises(V.InvalidData):
            I.contrastive(spark, write(tmp_path / "bad.tsv", *bad))


def test_gold(spark, tmp_path):
    rec = I.contrastive(spark, write(tmp_path / "a.tsv", HEADER, *ROWS))
    got = {r["uid"]: r["gold_spans"] for r in I.gold_spans(rec).collect()}
    assert [(o["start"], o["end"]) for o in got["F-MIX-002"][0]["occ"]] == [(4, 8)] and got["F-MIX-002"][0]["std"] == "视频日志"


def test_segments(spark, tmp_path):
    df = I.segments(spark, write(tmp_path / "segments_m.tsv", "uid\tcategory\txcomet_noisy\txcomet_clean\thyp_noisy", "u\tHOM\t1.5\t\t"))
    r = df.first()
    assert r["xcomet_noisy"] == 1.5 and r["xcomet_clean"] is None and r["nta_d"] is None and r["hyp_noisy"] == ""
    assert I.by_model(spark, str(tmp_path)).first()["model"] == "m"
    cells = W.segment_cells(spark.sql("SELECT 'u' uid, 'HOM' category, 1.005D xcomet_noisy, 2.0D xcomet_clean, CAST(NULL AS DOUBLE) kiwi_noisy, 1D kiwi_clean, 0D nta_noisy, 100D nta_clean, '' src_noisy, '' hyp_noisy, '' src_clean, '' hyp_clean, '' ref_en")).first()
    assert (cells["nta_clean"], cells["kiwi_noisy"], cells["kiwi_d"], cells["xcomet_clean"]) == ("100", "", "", "2.00")


def test_summary_last_wins(spark, tmp_path):
    path = write(tmp_path / "s.jsonl", *(json.dumps({"model": "m", "scope": "all", "n": n}) for n in (1, 2)))
    assert [r["n"] for r in I.summaries(spark, path).collect()] == [2]


def test_tables(spark, tmp_path):
    W.table(spark.createDataFrame([("b", 1), ("a", 2)], "k string, v int"), str(tmp_path / "t"), ["k"])
    assert next((tmp_path / "t").glob("*.csv")).read_text() == "k\tv\na\t2\nb\t1\n"
    W.json_lines(spark.sql("SELECT 'é' a, CAST(NULL AS INT) b"), str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("*.json")).read_text()) == {"a": "é", "b": None}
    assert "| a | 1.00 |" in W.markdown(spark.createDataFrame([("a", 1.0)], "k string, v double"), "T")
    path = write(tmp_path / "f.txt", "x", "y")
    assert W.fingerprint(spark, path)["lines"] == 2
    assert W.manifest("k")["kind"] == "k"
    assert len(W.write_manifest(str(tmp_path / "m.json"), W.manifest("k"))) == 64


def test_sheet(spark, tmp_path):
    def row(k, cells):
        return f'<row r="{k}">' + "".join(f'<c r="{chr(65 + i)}{k}" t="inlineStr"><is><t>{c}</t></is></c>' for i, c in enumerate(cells) if c) + "</row>"

    body = row(1, I.SHEET) + row(2, ["u"] + [""] * 8 + ["m"]) + row(4, ["v"])
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    got = I.sheet(spark, str(tmp_path / "x.xlsx")).collect()
    assert [(r["uid"], r["source_meta"], r["row"]) for r in got] == [("u", "m", 2), ("v", "", 4)]


def sheet_rows(spark, *rows):
    names = ["row", "uid", "category", "src_noisy", "src_clean", "noise_span", "noise_std", "noise_gold_en"]
    return spark.createDataFrame([dict(zip(names, (i, *r))) for i, r in enumerate(rows)], "row int, uid string, category string, src_noisy string, src_clean string, noise_span string, noise_std string, noise_gold_en string")


def test_classify(spark):
    df = sheet_rows(
        spark,
        ("A-HOM-1", "HOM", "蚌埠住了笑", "绷不住了笑", "蚌埠住了", "绷不住了", "a"), ("A-HOM-2", "HOM", "蚌埠住了笑", "绷不住了，笑", "蚌埠住了", "绷不住了", "a"),
        ("A-HOM-3", "HOM", "蚌埠住了笑", "全改了", "蚌埠住了", "绷不住了", "a"), ("A-HOM-4", "HOM", "abc", "abc", "x", "y", "a"), ("A-HOM-5", "HOM", "abc", "abc", "a", "a", "a"),
        ("A-HOM-6", "ZZZ", "abc", "xbc", "a", "x", "a"), ("A-HOM-7", "HOM", "abc", "xbc", "a‖b", "x", "a"), ("A-HOM-8", "HOM", "abc", "xbc", "", "x", "a"), ("A-HOM-1", "PYA", "蚌埠住了笑", "绷不住了笑", "蚌埠住了", "绷不住了", "a‖b‖c‖d‖e"),
    )
    got = V.classify_rows(df).orderBy("row")
    assert [r["verdict"] for r in got.collect()] == ["ok", "punct", "rewritten", *["BLOCK"] * 5, "ok"]
    assert V.kept_rows(got).count() == 3 and V.kept_rows(got, True).count() == 4
    flags = {r["flag"] for r in V.ingest_flags(got).where("row = 8").collect()}
    assert flags == {"repeated uid, first at 0", "repeated src_noisy, first at 0", "category differs from uid", "length 5", "many golds"}


def lines(spark, *rows):
    schema = "pos int, uid string, src_noisy string, model_version string, spans array<struct<start:int,end:int,text:string,type:string,confidence:double,candidates:array<string>>>"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def test_predictions(spark):
    rec = spark.createDataFrame([("u", "bt,不够bt"), ("v", "x")], "uid string, src_noisy string")
    s = lambda a, b, t, k="HOM", c=0.5, cand=None: (a, b, t, k, c, cand)
    errors = lambda *rows, **k: {(r["uid"], r["error"].split(": ")[-1]) for r in V.prediction_errors(lines(spark, *rows), rec, **k).collect()}
    v = ("v", "x", "1", [])
    assert errors(("u", "bt,不够bt", "1", [s(0, 2, "bt"), s(5, 7, "bt")]), v) == set()
    assert errors(v) == {("u", "no prediction")}
    assert errors(("u", "bt,不够bt", "", [s(0, 9, "bt"), s(0, 2, "x", "Q", 2.0), s(1, 3, "t,", cand=[""])]), v, v, ("w", "x", "1", [])) == {
        ("u", "no model version"), ("u", "bad offsets"), ("u", "text differs from the source"), ("u", "bad type"), ("u", "bad confidence"), ("u", "overlaps another"), ("u", "empty candidate"), ("v", "repeated uid"), ("w", "unknown uid"),
    }
    assert errors(("u", "other", "1", []), v, ("w", "x", "1", []), allow_extra=True) == {("u", "source differs")}


def test_contract(spark):
    cases = [("", "empty"), ("a\nb", "multiline"), ("Note: x", "meta"), ("是HOM x", None), ("a HOM b", "code"), ("he said 你好", "echo_src"), ("fine", None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    got = df.select("i", V.contract_violation(F.col("a"), F.lit(" 你好 ")).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in got] == [k for _, k in cases]


def test_overlap(spark):
    from deltaspan.functions.text import char_grams

    side = lambda k, *t: spark.createDataFrame(list(enumerate(t)), f"{k} int, t string").select(k, char_grams(F.col("t")).alias("grams"))
    left, right = side("l", "abcdefghij", "zzzzzz", "ab"), side("r", "abcdefghik", "abcdefghij", "qqq", "ab")
    got = {(r["l"], r["r"]): round(r["jaccard"], 4) for r in O.near_duplicates(left, right, 0.6).collect()}
    assert got == {(0, 0): 0.75, (0, 1): 1.0, (2, 3): 1.0}
    assert {r["l"]: r["r"] for r in O.first_partner(left, right, 0.6).collect()} == {0: 0, 2: 3}


def test_repair_steps(spark):
    rows = [("u", "HOM", "童鞋们好", "同学们好", ["童鞋"], ["同学"], [{"text": "童鞋", "type": "HOM", "start": 0, "end": 2}]), ("v", "MIX", "hold住场面再hold住", "稳住场面再稳住", ["hold住"], ["稳住"], [])]
    df = spark.createDataFrame(rows, "uid string, category string, src_noisy string, src_clean string, noise_span array<string>, noise_std array<string>, detected array<struct<text:string,type:string,start:int,end:int>>")

    def run(tier):
        planned = A.plan(df, tier).withColumn("answer", A.dummy_answer(F.col("given")))
        return {r["uid"]: r["norm"] for r in A.finish(planned, tier).collect()}

    assert run("a4")["v"]["text"] == "稳住场面再稳住"
    assert run("a3")["v"]["text"] == "☆hold住场面再☆hold住"
    a2 = run("a2")
    assert a2["u"]["text"] == "☆童鞋们好" and a2["v"]["text"] == "hold住场面再hold住"
    a1 = run("a1")
    assert a1["u"]["text"] == "童鞋们好" and all(x["parse_ok"] for x in a1.values())
    assert not A.finish_py("a3", "x", [{"text": "x", "type": "HOM"}], None, "[]")["parse_ok"]


def test_differing(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    r = V.differing(a, b, ["k"], ["v"]).first()
    assert (r["n"], r["n_unaligned"], r["n_v"]) == (3, 1, 2)
    assert V.equal_tables(a, a) and not V.equal_tables(a, b)


def test_stream(spark, tmp_path):
    from deltaspan.streaming.rollup import read_scores, windowed_rollup

    spark.sql("SELECT 'A' system, 'c' category, 1L item, 3D clean, 1D noisy, timestamp'2024-01-01 00:10:00' at UNION ALL SELECT 'A', 'c', 2L, 5D, 1D, timestamp'2024-01-01 00:20:00'").write.parquet(str(tmp_path / "in"))
    q = windowed_rollup(read_scores(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.table("rolled").first()
    assert (r["n"], r["mean_delta"]) == (2, 3.0)


def test_table_differences(spark):
    """Rows, repeats, nulls that trade places, nested values, and column order; only buckets that differ are compared."""
    schema = "k int, `odd name` string, c string, v double, l array<string>"
    rows = [(i, "x" if i % 3 else None, None if i % 3 else "x", float(i), ["a", None] if i % 2 else None) for i in range(3000)] + [(1, "x", None, 1.0, ["a", None])]
    a = spark.createDataFrame(rows, schema)
    same = a.repartition(5).select("l", "v", "c", "odd name", "k")
    assert V.equal_tables(a, same) and V.table_differences(a, same).count() == 0
    swapped = [(7, None, "x", 7.0, ["a", None]), *[r for r in rows if r[0] != 7]]
    nested = [(7, "x", None, 7.0, [None, "a"]), *[r for r in rows if r[0] != 7]]
    for other, want in ((rows[:-1], {("a", 1)}), ([*rows, rows[5]], {("b", 5)}), (swapped, {("a", 7), ("b", 7)}), (nested, {("a", 7), ("b", 7)}), ([], {("a", i) for i in range(3000)})):
        b = spark.createDataFrame(other, schema)
        assert not V.equal_tables(a, b)
        got = V.table_differences(a, b).collect()
        assert {(r["side"], r["k"]) for r in got} == want and len(got) == (len(rows) if not other else len(want))
        assert len(V.differing_buckets(a, b)) <= len(want)
    assert V.equal_tables(a.limit(0), a.where("k < 0"))
    with pytest.raises(Exception, match="types"):
        V.equal_tables(a, a.withColumn("k", F.col("k").cast("long")))
