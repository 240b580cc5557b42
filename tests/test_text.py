from deltaspan.functions import splice as S
from deltaspan.functions import text as X
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest


def test_normal_forms():
    assert X.norm_py("  HeLLo  ") == "hello"
    assert X.norm_py("Œuvre “a”　b") == 'oeuvre "a" b'
    assert X.match_key_py(" Ａb-c! ") == "abc"
    assert X.core_py("好，的！😀 a") == "好的a"


def test_terms():
    assert X.usable_golds_py(["!", "…", "a", "HERON", " ", None]) == ["HERON"]
    assert X.term_hit_py("the log of an old harbour pilot", ["harbour pilot"]) == 1
    assert X.term_hit_py("words of quite another kind", ["harbour pilot"]) == 0
    assert X.term_hit_py("We saw the HERON there!", ["the heron"]) == 1
    assert X.term_hit_py("anything", []) == 0
    assert X.term_hit_py("", ["anything"]) == 0


def test_standard_match():
    assert X.standard_match_py("朋友", "朋友") == (True, True)
    assert X.standard_match_py("没关", "没关系") == (False, True)
    assert X.standard_match_py("abc", "xyz") == (False, False)
    assert X.standard_match_py(" 朋友 ", "朋友") == (True, True)


def test_columns(spark):
    df = spark.createDataFrame([("abc", "abc", 0), ("", "abc", 3), ("下雨天了", "夏雪天了", 2), ("小猫", "大老虎", 3)], "a string, b string, n long")
    assert df.where(X.edit_distance(F.col("a"), F.col("b")) != F.col("n")).count() == 0
    row = spark.range(1).select(
        X.char_grams(F.lit("a\nbcd")).alias("g"), X.char_grams(F.lit("ab")).alias("s"), X.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("j"),
        X.split_list(F.lit(" a ‖　‖b")).alias("l"), X.fixed(F.lit(1234.5)).alias("f"), X.fixed(F.lit(None).cast("double")).alias("n"), X.without_thoughts(F.lit("<think>a\nb</think> c ")).alias("t"),
        X.added_characters(F.lit("cabd"), F.lit("ab")).alias("x"), X.interval_cell(F.lit(1.0), F.lit(2.5)).alias("i"), X.norm_text(F.lit("Straße")).alias("u"), X.html_unescape(F.lit("&amp;lt")).alias("h"),
    ).first()
    assert row["g"] == ["a\nbc", "\nbcd"] and row["s"] == ["ab"] and row["j"] == 0.5 and row["l"] == ["a", "b"]
    assert (row["f"], row["n"], row["t"], row["x"], row["i"], row["u"], row["h"]) == ("1234.50", "", "c", "cd", "[1.00, 2.50]", "strasse", "&lt")


def test_locate():
    assert S.locate_py("啊qwer啊qwer", ["qwer", "qwer"]) == [(1, 5, "qwer"), (6, 10, "qwer")]
    assert [x[:2] for x in S.locate_py("A和B", ["B", "A"])] == [(0, 1), (2, 3)]
    for text, spans in (("abc", ["ab", "bc"]), ("abc", ["x"])):
        with pytest.raises(S.SpanError):
            S.locate_py(text, spans)


def test_splice():
    assert S.splice_py("4U 生日快乐", [(0, 2, "给你")]) == "给你 生日快乐"
    assert S.splice_py("x小猫y大老虎z", [(4, 7, "虎"), (1, 3, "猫咪们")]) == "x猫咪们y虎z"
    assert S.splice_py("abcd", [(0, 2, "x"), (2, 4, "y")]) == "xy"
    for bad in ([(0, 2, ""), (1, 3, "")], [(0, 9, "")], [(2, 1, "")]):
        with pytest.raises(S.SpanError):
            S.splice_py("abcd", bad)
    assert S.splice_all_py("kq，还有kq", [("kq", "口琴")]) == "口琴，还有口琴"
    assert S.splice_all_py("a和b", [("a", "xb"), ("b", "y")]) == "xb和y"
    assert [c[:2] for c in S.claim_all_py("4U,qwer", [("4U", "给你"), ("qwer", "键盘上的")])] == [(0, 2), (3, 7)]
    with pytest.raises(S.SpanError):
        S.pair_py(["a", "b"], ["c"])


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", min_size=1, max_size=3))
def test_claims_cover_free_places(text, span):
    try:
        got = S.claim_all_py(text, [(span, "X")])
    except S.SpanError:
        assert span not in text
        return
    assert S.splice_py(text, [(a, b, span) for a, b, _, _ in got]) == text
    assert all(text[a:b] == span for a, b, _, _ in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_splice_columns(spark):
    df = spark.createDataFrame([("a和b", ["a", "b"], ["xb", "y"]), ("zz", ["a"], ["b"]), ("zz", ["a"], [])], "t string, s array<string>, n array<string>")
    got = [r[0] for r in df.select(S.splice_all(F.col("t"), F.col("s"), F.col("n"))).collect()]
    assert got[0]["text"] == "xb和y" and got[1]["error"] and got[2]["error"]
    turn = df.limit(1).select(S.replace_in_turn(F.col("t"), F.col("s"), F.col("n")).alias("t")).first()["t"]
    assert turn == "xy和y"


def test_occurrences(spark):
    cases = [("aaaa", "aa", [0, 1, 2]), ("kq，还有kq", "kq", [0, 5]), ("x", "y", []), ("", "y", []), ("a.b.", ".", [1, 3]), ("\\E\\E", "\\E", [0, 2]), ("😀a😀a", "a", [1, 3])]
    got = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "i int, t string, s string").select("i", S.occurrences(F.col("t"), F.col("s")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [o for _, _, o in cases]


def test_answers():
    ok = '{"spans": [{"text": "a", "type": "HOM", "std": "b"}]}'
    assert S.answer_spans_py(ok) == S.answer_spans_py(f"```json\n{ok}\n```") == [{"text": "a", "type": "HOM", "std": "b"}]
    assert S.answer_spans_py('{"spans": []}') == S.answer_spans_py("[]") == []
    for bad in ("prose", '[{"text": "a", "type": "X", "std": "b"}]', '[{"text": "a", "type": "HOM"}]', '[{"text": "a\\t", "type": "HOM", "std": "b"}]', '[{"text": "a", "type": "HOM", "std": 1}]', '{"x": 1}', None):
        with pytest.raises(S.SpanError):
            S.answer_spans_py(bad)


def test_confidence(spark):
    df = spark.sql("SELECT array(named_struct('confidence', 0.9D), named_struct('confidence', 0.4D)) AS s")
    n = lambda t: len(df.select(S.keep_confident(F.col("s"), t).alias("s")).first()["s"])
    assert (n(None), n(0.5), n(0.9)) == (2, 1, 1)
    with pytest.raises(Exception):
        spark.sql("SELECT array(named_struct('confidence', CAST(NULL AS DOUBLE))) AS s").select(S.keep_confident(F.col("s"), 0.5)).collect()


def test_in_parts():
    """A batch's texts aren't objects all at once; values, nulls and structs come in order, and an empty batch stays one."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None if i % 7 == 3 else chr(97 + i % 26) * 1000 for i in range(20_000)])
    tracemalloc.start()
    got = X._in_parts(lambda t, n: None if t is None else len(t) + n, pa.int64())(texts, pa.array(range(20_000)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2_000_000
    assert got.to_pylist() == [None if i % 7 == 3 else 1000 + i for i in range(20_000)]
    kind = pa.struct([("a", pa.string())])
    assert X._in_parts(lambda t: {"a": t}, kind)(pa.array(["x"] * 300)).to_pylist() == [{"a": "x"}] * 300
    assert X._in_parts(lambda t: t, pa.string())(pa.array([], type=pa.string())).type == pa.string()
