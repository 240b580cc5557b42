"""The roles of the library's tables, taken by the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SYSTEMS = ["A", "N", "R"]
#: Terms that stand for gold spans, with a class each; fixed values.
TERMS = {"token": "HOM", "License": "PYA", "example.com": "NEO", "idiot": "MIX"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that joins or groups by item.
ITEM_ROWS = 1 << 18


def scores(spark: SparkSession, sf_dir: str, by_item: bool = False) -> DataFrame:
    """Lines of orders as scored items: a flag is a system, the price is clean, the discounted price noisy.

    by_item: for what is grouped by item. The rows are dealt by item over as many tasks as they need, so that the memory of
    a task that sorts and groups them doesn't grow with the table, whatever number of partitions the session has.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_discount")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    if by_item:
        n = -(-line.count() // ITEM_ROWS) or 1  # Parquet's own counts
        line, order = line.repartition(n, "l_orderkey"), order.repartition(n, "o_orderkey")
    out = line.join(order, line["l_orderkey"] == order["o_orderkey"])
    return out.select(F.col("l_returnflag").alias("system"), F.col("o_orderpriority").alias("category"), F.col("l_orderkey").alias("item"), F.col("l_extendedprice").alias("clean"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("noisy"), F.col("o_orderdate").alias("day"))


SCORES_SQL = "s AS (SELECT l_returnflag AS system, o_orderpriority AS category, l_orderkey AS item, l_extendedprice AS clean, l_extendedprice * (1 - l_discount) AS noisy, l_extendedprice - l_extendedprice * (1 - l_discount) AS delta, o_orderdate AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with its gold spans: every place of the terms in the whole text."""
    from ..functions.splice import occurrences

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text", "lang")

    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(c).alias("category")) for t, c in TERMS.items()])

    def places(t: Column) -> Column:
        gi = lambda s: F.concat_ws(":", F.lpad(s.cast("string"), 9, "0"), t["term"])
        one = lambda s: F.struct(t["term"].alias("term"), t["category"].alias("category"), s.alias("start"), (s + F.length(t["term"])).alias("end"), gi(s).alias("gi"))
        return F.transform(occurrences(F.col("text"), t["term"]), one)

    return docs.select("uid", "lang", F.flatten(F.transform(terms, places)).alias("gold"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a row for each span."""
    return gold_rows(spark, sf_dir).select("uid", "lang", F.explode("gold").alias("g")).select("uid", "lang", "g.*")


def _prediction(uid: Column, span: Column) -> tuple[Column, Column, Column]:
    """Whether a gold span is predicted, by how much shifted, and as what."""
    k = uid * 31 + span["start"]
    return k % 5 != 0, k % 3, F.when(k % 7 == 0, "NEO").otherwise(span["category"])


def predicted_spans(uid: Column, spans: Column) -> Column:
    """The predictions made from an array of gold spans."""

    def one(s: Column) -> Column:
        _, shift, kind = _prediction(uid, s)
        return F.struct((s["start"] + shift).alias("start"), (s["end"] + shift).alias("end"), kind.alias("type"))

    return F.transform(F.filter(spans, lambda s: _prediction(uid, s)[0]), one)


def predicted(spans: DataFrame) -> DataFrame:
    """Predictions made from gold spans: one in five is missing, others are shifted by up to two places or mistyped."""
    k = F.col("uid") * 31 + F.col("start")
    shift = k % 3
    kind = F.when(k % 7 == 0, "NEO").otherwise(F.col("category"))
    return spans.where(k % 5 != 0).select("uid", "lang", F.col("gi").alias("pi"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), kind.alias("type"))


_STARTS = "list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(term) AS BIGINT))"
GOLD_SQL = (
    "t(term, category) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in TERMS.items()) + "), "
    f"g AS (SELECT uid, lang, term, category, start, start + length(term) AS stop, lpad(CAST(start AS VARCHAR), 9, '0') || ':' || term AS gi FROM (SELECT doc_id AS uid, lang, term, category, unnest({_STARTS}) AS start FROM (SELECT doc_id, lang, term, category, string_split(text, term) AS p FROM documents, t WHERE contains(text, term)))), "
    "p AS (SELECT uid, lang, gi AS pi, start + (uid * 31 + start) % 3 AS start, stop + (uid * 31 + start) % 3 AS stop, CASE WHEN (uid * 31 + start) % 7 = 0 THEN 'NEO' ELSE category END AS type FROM g WHERE (uid * 31 + start) % 5 <> 0)"
)
