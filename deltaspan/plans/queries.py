"""Registered queries: each operator on the driver's tables, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import splice as S
from ..functions import text as X
from ..operators import counts as N
from ..operators import overlap as O
from ..operators import pairs as P
from ..operators import resample as R
from ..operators import spans as M
from ..operators import validate as V
from . import adapters as D
from .adapters import GOLD_SQL, PRIORITIES, SCORES_SQL, SYSTEMS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Draws where SQL is held against a query; the *_full queries take the whole number.
ROUNDS = 100
FULL_ROUNDS = 2000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, column: str, items: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in items], f"{column} string")


PAIRS = [("A", "N"), ("A", "R"), ("R", "N")]
PAIRS_SQL = "pl(hi, lo) AS (VALUES ('A', 'N'), ('A', 'R'), ('R', 'N'))"
ITEM_SQL = "i AS (SELECT system, item, avg(delta) AS delta FROM s GROUP BY ALL)"
CATS_SQL = "c(category) AS (VALUES " + ", ".join(f"('{c}')" for c in [*PRIORITIES, "6-NEVER"]) + ")"


# ---- paired scores


@query(f"WITH {SCORES_SQL} SELECT system, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS scope, count(*) AS n, round(avg(noisy), 4) AS mean_noisy, round(avg(clean), 4) AS mean_clean, round(avg(delta), 4) AS mean_delta FROM s GROUP BY GROUPING SETS ((system), (system, category))")
def paired_scope_rollup(spark: SparkSession, d: str) -> DataFrame:
    return P.scope_rollup(D.scores(spark, d))


@query(f"WITH {SCORES_SQL} SELECT item, system, round(CASE WHEN sum(clean) = 0 THEN NULL ELSE sum(delta) / sum(clean) END, 6) AS rel_delta FROM s GROUP BY ALL")
def paired_relative_delta(spark: SparkSession, d: str) -> DataFrame:
    own = P.with_delta(D.scores(spark, d, by_item=True)).groupBy("item", "system").agg(F.sum("delta").alias("delta"), F.sum("clean").alias("clean"))
    return own.select("item", "system", F.round(P.relative(F.col("delta"), F.col("clean")), 6).alias("rel_delta"))


@query(f"WITH {SCORES_SQL}, {ITEM_SQL}, {PAIRS_SQL} SELECT hi, lo, count(*) AS n, round(avg(a.delta), 4) AS mean_hi, round(avg(b.delta), 4) AS mean_lo, round(avg(a.delta) - avg(b.delta), 4) AS diff FROM pl JOIN i a ON a.system = hi JOIN i b ON b.system = lo AND a.item = b.item GROUP BY ALL")
def system_pair_align(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_means(P.align_items(P.with_delta(D.scores(spark, d, by_item=True)), PAIRS))


@query(f"WITH {SCORES_SQL}, h AS (SELECT item, count(DISTINCT system) AS k FROM s GROUP BY item) SELECT count(*) FILTER (k = (SELECT count(DISTINCT system) FROM s)) AS n_shared, count(*) FILTER (k < (SELECT count(DISTINCT system) FROM s)) AS n_dropped FROM h")
def shared_keys_intersect(spark: SparkSession, d: str) -> DataFrame:
    return P.shared_counts(D.scores(spark, d, by_item=True))


@query(f"WITH {SCORES_SQL}, {ITEM_SQL}, k AS (SELECT item FROM i GROUP BY item HAVING count(*) = 3), m AS (SELECT system AS tier, count(*) AS n, avg(delta) AS m FROM i WHERE item IN (SELECT item FROM k) GROUP BY system) SELECT tier, CAST(CASE tier WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS BIGINT) AS place, n, round(m, 4) AS score, round((SELECT m FROM m WHERE tier = 'R') - m, 4) AS delta_vs_clean, round(m - (SELECT m FROM m WHERE tier = 'A'), 4) AS recovery FROM m")
def ladder_recovery(spark: SparkSession, d: str) -> DataFrame:
    tiers = {s: F.when(F.col("system") == s, F.col("delta")) for s in SYSTEMS}
    return P.ladder_items(P.with_delta(D.scores(spark, d, by_item=True)), tiers, "A", "R")


@query(f"WITH {SCORES_SQL}, {CATS_SQL}, g AS (SELECT system, category FROM (SELECT DISTINCT system FROM s), (SELECT category FROM c UNION ALL SELECT 'all')), m AS (SELECT system, coalesce(category, 'all') AS category, avg(delta) FILTER (day < TIMESTAMP '1998-01-01') AS a, avg(delta) FILTER (day >= TIMESTAMP '1998-01-01') AS b FROM s GROUP BY GROUPING SETS ((system), (system, category))) SELECT g.system, g.category, round(a, 4) AS delta_a, round(b, 4) AS delta_b, round(a - b, 4) AS gap FROM g LEFT JOIN m USING (system, category)")
def contamination_gap(spark: SparkSession, d: str) -> DataFrame:
    own = P.with_delta(D.scores(spark, d))
    old = F.col("day") < F.lit("1998-01-01").cast("timestamp")
    return P.contamination_gap_by(own, old, [*PRIORITIES, "6-NEVER"])


@query(f"WITH {SCORES_SQL}, {CATS_SQL} SELECT category, round(avg(delta), 4) AS mean FROM c LEFT JOIN s USING (category) GROUP BY category UNION ALL SELECT 'all', round(avg(delta), 4) FROM s")
def category_grid(spark: SparkSession, d: str) -> DataFrame:
    return P.category_grid(P.with_delta(D.scores(spark, d)), values(spark, "category", [*PRIORITIES, "6-NEVER"])).withColumn("mean", F.round("mean", 4))


@query(f"WITH {SCORES_SQL} SELECT system, " + ", ".join(f"count(*) FILTER (category = '{c}') AS \"{c.lower().replace('-', '_').replace(' ', '_')}_n\", round(avg(delta) FILTER (category = '{c}'), 4) AS \"{c.lower().replace('-', '_').replace(' ', '_')}_delta\"" for c in PRIORITIES) + " FROM s GROUP BY system")
def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    return P.category_pivot(D.scores(spark, d), PRIORITIES)


FLAGS_SQL = "f AS (SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice * l_discount, 6) AS first_d, round(l_extendedprice * l_tax, 6) AS second_d, l_quantity AS first_noisy, CAST(l_linenumber % 2 AS INTEGER) AS hit_noisy FROM lineitem), x AS (SELECT *, abs(first_d - second_d) >= 2000 AS a, first_noisy >= 45 AND hit_noisy = 0 AS b FROM f)"
FLAGS_OUT = "l_orderkey, l_partkey, l_linenumber, coalesce(abs(first_d - second_d), 0) AS severity, concat_ws('; ', CASE WHEN a THEN 'metrics disagree' END, CASE WHEN b THEN 'high score, term missed' END) AS reasons"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    price = F.col("l_extendedprice")
    own = li.select("l_orderkey", "l_partkey", "l_linenumber", F.round(price * F.col("l_discount"), 6).alias("first_d"), F.round(price * F.col("l_tax"), 6).alias("second_d"), F.col("l_quantity").alias("first_noisy"), (F.col("l_linenumber") % 2).alias("hit_noisy"))
    return P.disagreement(own, 2000.0, 45.0).select("l_orderkey", "l_partkey", "l_linenumber", F.round("severity", 6).alias("severity"), "reasons")


@query(f"WITH {FLAGS_SQL} SELECT l_orderkey, l_partkey, l_linenumber, round(severity, 6) AS severity, reasons FROM (SELECT {FLAGS_OUT} FROM x WHERE a OR b)")
def metric_disagreement_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


@query(f"WITH {FLAGS_SQL} SELECT l_orderkey, l_partkey, l_linenumber, round(severity, 6) AS severity, reasons FROM (SELECT {FLAGS_OUT} FROM x WHERE a OR b) ORDER BY severity DESC, l_orderkey, l_partkey, l_linenumber LIMIT 50")
def top_severity(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).orderBy(F.desc("severity"), "l_orderkey", "l_partkey", "l_linenumber").limit(50)


@query("SELECT p_brand, count(*) AS n, CAST(CASE p_brand WHEN 'Brand#12' THEN 0 WHEN 'Brand#34' THEN 1 ELSE 99 END AS BIGINT) AS place FROM part GROUP BY p_brand")
def custom_order(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return P.with_order(own, "p_brand", ["Brand#12", "Brand#34"]).orderBy("place", "p_brand")


@query(f"WITH {SCORES_SQL}, m AS (SELECT system, avg(delta) AS a, stddev_pop(delta) AS b FROM s GROUP BY system), z AS (SELECT s.system, category, CASE WHEN b > 1e-9 THEN (delta - a) / b ELSE 0 END AS z FROM s JOIN m USING (system)) SELECT system, category, count(*) AS n, round(max(z), 4) AS top, round(min(z), 4) AS low, count(*) FILTER (abs(z) > 1) AS n_far FROM z GROUP BY ALL")
def zscore_by_system(spark: SparkSession, d: str) -> DataFrame:
    z = P.zscore(P.with_delta(D.scores(spark, d)), "delta", "system")
    return z.groupBy("system", "category").agg(F.count("*").alias("n"), F.round(F.max("z"), 4).alias("top"), F.round(F.min("z"), 4).alias("low"), F.count_if(F.abs("z") > 1).alias("n_far"))


# ---- stats, validation, windows


@query("SELECT CASE WHEN grouping(p_brand) = 1 THEN 'all' ELSE p_brand END AS scope, count(*) AS n, round(avg(length(p_name)), 4) AS mean_length, round(avg(levenshtein(p_name, p_type)), 4) AS mean_edit FROM part GROUP BY GROUPING SETS ((), (p_brand))")
def length_stats_scopes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select("p_brand", F.length("p_name").alias("len"), X.edit_distance(F.col("p_name"), F.col("p_type")).alias("edit"))
    out = own.groupingSets([[], ["p_brand"]], "p_brand").agg(F.count("*").alias("n"), F.round(F.avg("len"), 4).alias("mean_length"), F.round(F.avg("edit"), 4).alias("mean_edit"), F.grouping("p_brand").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("p_brand")).alias("scope"), "n", "mean_length", "mean_edit")


@query("SELECT doc_id, first_at, doc_id > first_at AS is_repeat FROM documents JOIN (SELECT text, min(doc_id) AS first_at FROM documents GROUP BY text) USING (text)")
def duplicate_first_seen(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return P.first_seen(docs, "key", "doc_id").select("doc_id", "first_at", "is_repeat")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view') GROUP BY ALL")
def enum_violations(spark: SparkSession, d: str) -> DataFrame:
    return V.outside(table(spark, d, "events"), "event_type", ["click", "view"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys_anti(spark: SparkSession, d: str) -> DataFrame:
    return V.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("WITH g AS (SELECT s AS o_orderstatus, p AS o_orderpriority FROM (VALUES ('F'), ('O'), ('P'), ('X')) a(s), (VALUES " + ", ".join(f"('{c}')" for c in PRIORITIES) + ") b(p)) SELECT g.o_orderstatus, g.o_orderpriority, count(o_orderkey) AS n FROM g LEFT JOIN orders USING (o_orderstatus, o_orderpriority) GROUP BY ALL")
def completeness_grid(spark: SparkSession, d: str) -> DataFrame:
    return V.completeness(table(spark, d, "orders"), values(spark, "o_orderstatus", ["F", "O", "P", "X"]), values(spark, "o_orderpriority", PRIORITIES))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_unaligned, count(*) FILTER (event_id % 10 = 0 AND upper(event_type) <> event_type) AS n_event_type, count(*) FILTER (event_id % 7 = 0 AND value IS NOT NULL) AS n_value FROM events")
def determinism_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select("event_id", "event_type", "value")
    b = a.select("event_id", F.when(F.col("event_id") % 10 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return V.differing(a, b, ["event_id"], ["event_type", "value"])


@query("SELECT role, count(*) AS n, count(*) FILTER (length(trim(text)) >= 2) AS n_scoreable FROM conversations GROUP BY role")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("text")) >= 2).alias("n_scoreable"))


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return P.last_wins(ev, ["user_id"], "o").select("user_id", "event_id", "ts", "event_type")


# ---- resampling


DRAW_SQL = f"r AS (SELECT unnest(range(0, {ROUNDS})) AS turn)"
HASH_SQL = "CAST(('0x' || substr(md5(turn || '|' || pos), 1, 8)) AS BIGINT) % n"


def _place(rounds: int) -> R.Place:
    """The hash that SQL has too for the draws that are held against it, the quick one for the full number."""
    return R.hashed_place if rounds == ROUNDS else R.quick_place


def _boot_ci_portable(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    own = P.item_means(D.scores(spark, d, by_item=True))
    out = R.mean_interval_portable(own, "system", "delta", ["item"], rounds, place=_place(rounds))
    return out.select("system", "n", *[F.round(c, 4).alias(c) for c in ("mean", "ci_lo", "ci_hi")])


@query(f"WITH {SCORES_SQL}, {ITEM_SQL}, v AS (SELECT system, delta, row_number() OVER (PARTITION BY system ORDER BY item) - 1 AS pos, count(*) OVER (PARTITION BY system) AS n FROM i), {DRAW_SQL}, j AS (SELECT system, turn, {HASH_SQL} AS pos FROM v, r), m AS (SELECT j.system, turn, sum(delta) / max(n) AS m FROM j JOIN v USING (system, pos) GROUP BY ALL), k AS (SELECT system, m, row_number() OVER (PARTITION BY system ORDER BY m) - 1 AS k FROM m) SELECT system, n, mean, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi FROM (SELECT system, count(*) AS n, round(avg(delta), 4) AS mean FROM i GROUP BY system) JOIN (SELECT system, max(m) FILTER (k = {R.order_bounds(ROUNDS)[0]}) AS ci_lo, max(m) FILTER (k = {R.order_bounds(ROUNDS)[1]}) AS ci_hi FROM k GROUP BY system) USING (system)")
def boot_ci_portable(spark: SparkSession, d: str) -> DataFrame:
    return _boot_ci_portable(spark, d, ROUNDS)


@query()
def boot_ci_full(spark: SparkSession, d: str) -> DataFrame:
    return _boot_ci_portable(spark, d, FULL_ROUNDS)


def _paired_boot_portable(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    out = R.paired_portable(P.align_items(P.with_delta(D.scores(spark, d, by_item=True)), PAIRS), ["item"], rounds, place=_place(rounds))
    return out.select("hi", "lo", "n", *[F.round(c, 4).alias(c) for c in ("diff", "ci_lo", "ci_hi", "p")], "gate")


@query(f"WITH {SCORES_SQL}, {ITEM_SQL}, {PAIRS_SQL}, q AS (SELECT hi, lo, a.item, a.delta - b.delta AS d FROM pl JOIN i a ON a.system = hi JOIN i b ON b.system = lo AND a.item = b.item), v AS (SELECT hi, lo, d, row_number() OVER (PARTITION BY hi, lo ORDER BY item) - 1 AS pos, count(*) OVER (PARTITION BY hi, lo) AS n FROM q), {DRAW_SQL}, j AS (SELECT hi, lo, turn, {HASH_SQL} AS pos FROM v, r), m AS (SELECT hi, lo, turn, round(sum(d) / max(n), 6) AS m FROM j JOIN v USING (hi, lo, pos) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY hi, lo ORDER BY m) - 1 AS k FROM m), o AS (SELECT hi, lo, count(*) AS n, avg(d) AS diff FROM q GROUP BY ALL), b AS (SELECT hi, lo, max(m) FILTER (k = {R.order_bounds(ROUNDS)[0]}) AS ci_lo, max(m) FILTER (k = {R.order_bounds(ROUNDS)[1]}) AS ci_hi, avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0 END) AS below, avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0 END) AS above FROM k GROUP BY ALL) SELECT hi, lo, n, round(diff, 4) AS diff, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi, round(least(1.0, 2 * CASE WHEN diff >= 0 THEN below ELSE above END), 4) AS p, CASE WHEN ci_lo > 0 THEN 'PASS' ELSE 'fail' END AS gate FROM o JOIN b USING (hi, lo)")
def paired_boot_portable(spark: SparkSession, d: str) -> DataFrame:
    return _paired_boot_portable(spark, d, ROUNDS)


@query()
def paired_boot_full(spark: SparkSession, d: str) -> DataFrame:
    return _paired_boot_portable(spark, d, FULL_ROUNDS)


def _ratio_boot_portable(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return R.ratio_portable(own, "lang", "toxic", "quality", ["doc_id"], rounds, place=_place(rounds)).select("lang", F.round("mean", 4).alias("mean"), "ci_lo", "ci_hi")


@query(f"WITH x AS (SELECT doc_id, lang, toxic AS a, quality AS b FROM labels JOIN documents USING (doc_id)), v AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM x), {DRAW_SQL}, j AS (SELECT lang, turn, {HASH_SQL} AS pos FROM v, r), m AS (SELECT lang, turn, round(coalesce(sum(a) / nullif(sum(b), 0), 0), 6) AS m FROM j JOIN v USING (lang, pos) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m) - 1 AS k FROM m) SELECT lang, round(avg(m), 4) AS mean, max(m) FILTER (k = {R.order_bounds(ROUNDS)[0]}) AS ci_lo, max(m) FILTER (k = {R.order_bounds(ROUNDS)[1] - 1}) AS ci_hi FROM k GROUP BY lang")
def ratio_boot_portable(spark: SparkSession, d: str) -> DataFrame:
    return _ratio_boot_portable(spark, d, ROUNDS)


@query()
def ratio_boot_full(spark: SparkSession, d: str) -> DataFrame:
    return _ratio_boot_portable(spark, d, FULL_ROUNDS)


STRATA_SQL = "e AS (SELECT event_id, value AS a, value * (1 + (event_id % 5 - 2) / 100.0) AS b, CASE WHEN user_id % 4 = 0 THEN 'miss' WHEN user_id % 4 = 1 THEN 'fp_only' WHEN user_id % 4 = 2 THEN 'partial' ELSE 'exact' END AS stratum, event_type FROM events WHERE value IS NOT NULL), x AS (SELECT unnest(['all', stratum, 'type:' || event_type]) AS scope, event_id, a - b AS d FROM e)"


def _strata_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null")
    u = F.col("user_id") % 4
    stratum = F.when(u == 0, "miss").when(u == 1, "fp_only").when(u == 2, "partial").otherwise("exact")
    other = F.col("value") * (1 + (F.col("event_id") % 5 - 2) / 100.0)
    return e.select("event_id", F.col("value").alias("a"), other.alias("b"), F.explode(F.array(F.lit("all"), stratum, F.concat(F.lit("type:"), "event_type"))).alias("scope"))


def _tier_strata_contrast(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    x = _strata_rows(spark, d).withColumn("d", F.col("a") - F.col("b"))
    out = R.mean_interval_portable(x, "scope", "d", ["event_id"], rounds, place=_place(rounds))
    return out.select("scope", "n", *[F.round(c, 4).alias(c) for c in ("mean", "ci_lo", "ci_hi")])


@query(f"WITH {STRATA_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY scope) AS n FROM x), {DRAW_SQL}, j AS (SELECT scope, turn, {HASH_SQL} AS pos FROM v, r), m AS (SELECT scope, turn, round(sum(d) / max(n), 6) AS m FROM j JOIN v USING (scope, pos) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY m) - 1 AS k FROM m) SELECT scope, n, round(mean, 4) AS mean, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi FROM (SELECT scope, count(*) AS n, avg(d) AS mean FROM x GROUP BY scope) JOIN (SELECT scope, max(m) FILTER (k = {R.order_bounds(ROUNDS)[0]}) AS ci_lo, max(m) FILTER (k = {R.order_bounds(ROUNDS)[1]}) AS ci_hi FROM k GROUP BY scope) USING (scope)")
def tier_strata_contrast(spark: SparkSession, d: str) -> DataFrame:
    return _tier_strata_contrast(spark, d, ROUNDS)


@query()
def tier_strata_full(spark: SparkSession, d: str) -> DataFrame:
    return _tier_strata_contrast(spark, d, FULL_ROUNDS)


@query("SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.sample_by_hash(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100)


def _regression_rows(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(c) for c in S.CATEGORIES]), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, d, "part").select(F.substring("p_brand", 1, 7).alias("system"), F.col("p_retailprice").alias("delta"), kind.alias("category"), F.length("p_name").alias("length"), X.edit_distance(F.col("p_name"), F.col("p_type")).alias("edit_distance"), F.col("p_partkey").alias("pos"))


def _coefficients(out: DataFrame) -> DataFrame:
    return out.select("system", "name", *[F.round(c, 4).alias(c) for c in ("estimate", "lo", "hi")], "excludes_zero")


@query()
def regression_frozen(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(R.regression(_regression_rows(spark, d), "system", list(S.CATEGORIES), "pos", 1000))


# ---- resampling by counts, all rounds of the reference


def _counted_sql(items: str, by: str, values: list[str], m: str, out: str, upper_less: int = 0) -> str:
    """items: a query with ``by``, x, y and the values; m: what is drawn, of the sums and n; out: columns of the result."""
    low, high = R.order_bounds(FULL_ROUNDS)
    sums = ", ".join(f"sum(w * {v}) AS {v}" for v in values)
    return (
        f"it AS ({items}), w AS ({N.counts_sql('it', FULL_ROUNDS, ', '.join([by, *values]))}), u AS (SELECT {by}, turn, sum(w) AS n, {sums} FROM w GROUP BY {by}, turn), "
        # a round that draws nothing has the plain sums
        f"t AS (SELECT {by}, u.turn, {', '.join(f'CASE WHEN u.n = 0 THEN v.{c} ELSE u.{c} END AS {c}' for c in ('n', *values))} FROM u JOIN (SELECT * FROM u WHERE turn = {N.POINT}) v USING ({by})), "
        f"k AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY m) - 1 AS k FROM (SELECT *, round({m}, 6) AS m FROM t WHERE turn >= 0)), "
        f"b AS (SELECT {by}, avg(m) AS drawn, max(m) FILTER (k = {low}) AS ci_lo, max(m) FILTER (k = {high - upper_less}) AS ci_hi, avg((m <= 0)::INT) AS below, avg((m >= 0)::INT) AS above FROM k GROUP BY {by}) "
        f"SELECT {out} FROM b JOIN (SELECT * FROM t WHERE turn = {N.POINT}) USING ({by})"
    )


@query(f"WITH {SCORES_SQL}, {ITEM_SQL}, " + _counted_sql(f"SELECT system, delta, {N.halves_sql('item::VARCHAR')} FROM i", "system", ["delta"], "delta / n", "system, n::BIGINT AS n, round(delta / n, 4) AS mean, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi"))
def boot_ci_counts(spark: SparkSession, d: str) -> DataFrame:
    out = N.mean_interval(N.side_by_side(P.item_means(D.scores(spark, d, by_item=True)), "item"), ["system"], "delta", ["item"], FULL_ROUNDS)
    return out.select("system", "n", *[F.round(c, 4).alias(c) for c in ("mean", "ci_lo", "ci_hi")])


CONTRAST_OUT = "n::BIGINT AS n, round(d / n, 4) AS diff, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi, round(least(1.0, 2 * CASE WHEN d >= 0 THEN below ELSE above END), 4) AS p, CASE WHEN ci_lo > 0 THEN 'PASS' ELSE 'fail' END AS gate"


def _contrast(out: DataFrame, by: list[str]) -> DataFrame:
    return out.select(*by, "n", *[F.round(c, 4).alias(c) for c in ("diff", "ci_lo", "ci_hi", "p")], "gate")


@query(f"WITH {SCORES_SQL}, {ITEM_SQL}, {PAIRS_SQL}, q AS (SELECT hi, lo, a.item, a.delta - b.delta AS d FROM pl JOIN i a ON a.system = hi JOIN i b ON b.system = lo AND a.item = b.item), " + _counted_sql(f"SELECT hi, lo, d, {N.halves_sql('item::VARCHAR')} FROM q", "hi, lo", ["d"], "d / n", f"hi, lo, {CONTRAST_OUT}"))
def paired_boot_counts(spark: SparkSession, d: str) -> DataFrame:
    return _contrast(N.paired_interval(P.align_items(P.with_delta(D.scores(spark, d, by_item=True)), PAIRS), ["hi", "lo"], ["item"], FULL_ROUNDS), ["hi", "lo"])


@query("WITH " + _counted_sql(f"SELECT lang, toxic AS a, quality AS b, {N.halves_sql('doc_id::VARCHAR')} FROM labels JOIN documents USING (doc_id)", "lang", ["a", "b"], "coalesce(a / nullif(b, 0), 0)", "lang, round(drawn, 4) AS mean, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi", 1))
def ratio_boot_counts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    out = N.ratio_interval(own, ["lang"], "toxic", "quality", ["doc_id"], FULL_ROUNDS)
    return out.select("lang", *[F.round(c, 4).alias(c) for c in ("mean", "ci_lo", "ci_hi")])


@query(f"WITH {STRATA_SQL}, " + _counted_sql(f"SELECT scope, d, {N.halves_sql('event_id::VARCHAR')} FROM x", "scope", ["d"], "d / n", f"scope, {CONTRAST_OUT}"))
def tier_strata_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _strata_rows(spark, d).withColumns({"value_hi": F.col("a"), "value_lo": F.col("b")})
    return _contrast(N.paired_interval(x, ["scope"], ["event_id"], FULL_ROUNDS), ["scope"])


REGRESSION_ROUNDS = 1000
_K = 3 + len(S.CATEGORIES)
#: What stands in the design, in order; the baseline's column is zero.
_DESIGN_SQL = ["1.0", *[f"(place = {i} AND base <> {i})::INT" for i in range(len(S.CATEGORIES))], *[f"CASE WHEN {c}_sd > 1e-9 THEN ({c} - {c}_mean) / {c}_sd ELSE 0 END" for c in ("length", "edit_distance")]]
_PRODUCTS = [f"g{i}_{j}" for i in range(_K) for j in range(i, _K)] + [f"r{i}" for i in range(_K)]


def _regression_sql() -> str:
    """Normal equations of every round; an inverse by elimination with a little weight in each direction, whose error is taken out by repetition."""
    of = [f"x{i} * x{j} AS g{i}_{j}" for i in range(_K) for j in range(i, _K)] + [f"x{i} * delta AS r{i}" for i in range(_K)]
    about = ", ".join(f"avg({c}) OVER s AS {c}_mean, stddev_pop({c}) OVER s AS {c}_sd" for c in ("length", "edit_distance"))
    gram = "[" + ", ".join("[" + ", ".join(f"g{min(i, j)}_{max(i, j)}" for j in range(_K)) + "]" for i in range(_K)) + "]"
    right = "[" + ", ".join(f"r{i}" for i in range(_K)) + "]"
    names = "['intercept', " + ", ".join(f"'cat={c}'" for c in S.CATEGORIES) + ", 'length_z', 'editdist_z']"
    solved = "SELECT system, turn, g, b, inv, list_transform(inv, lambda row: list_inner_product(row, b)) AS x FROM v"
    for _ in range(4):
        solved = f"SELECT system, turn, g, b, inv, list_transform(inv, lambda row, i: x[i] + list_inner_product(row, rest)) AS x FROM (SELECT *, list_transform(g, lambda row, i: b[i] - list_inner_product(row, x)) AS rest FROM ({solved}))"
    return (
        "WITH RECURSIVE p AS (SELECT substr(p_brand, 1, 7) AS system, p_retailprice AS delta, p_size % 4 AS place, length(p_name) AS length, levenshtein(p_name, p_type) AS edit_distance, p_partkey FROM part), "
        f"a AS (SELECT *, {about}, min(place) OVER s AS base FROM p WINDOW s AS (PARTITION BY system)), x AS (SELECT system, delta, p_partkey, {', '.join(f'{e} AS x{i}' for i, e in enumerate(_DESIGN_SQL))} FROM a), "
        f"it AS (SELECT system, {', '.join(of)}, {N.halves_sql('p_partkey::VARCHAR')} FROM x), w AS ({N.counts_sql('it', REGRESSION_ROUNDS, ', '.join(['system', *_PRODUCTS]))}), "
        f"t AS (SELECT system, turn, {', '.join(f'sum(w * {v}) AS {v}' for v in _PRODUCTS)} FROM w GROUP BY system, turn), q AS (SELECT system, turn, {gram}::DOUBLE[][] AS g, {right}::DOUBLE[] AS b FROM t), "
        f"e AS (SELECT system, turn, 1 AS c, list_transform(g, lambda row, i: list_concat(list_transform(row, lambda v, j: v + CASE WHEN i = j THEN 1e-5 ELSE 0 END), list_transform(range(1, {_K + 1}), lambda j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END))) AS m FROM q UNION ALL "
        f"SELECT system, turn, c + 1, list_transform(m, lambda row, i: list_transform(row, lambda v, j: CASE WHEN i = c THEN v / m[c][c] ELSE v - row[c] * m[c][j] / m[c][c] END)) FROM e WHERE c <= {_K}), "
        f"v AS (SELECT q.*, list_transform(m, lambda row: row[{_K + 1}:]) AS inv FROM q JOIN e USING (system, turn) WHERE c = {_K + 1}), "
        f"b AS (SELECT system, turn, unnest(range(0, {_K})) AS i, unnest(x) AS b FROM ({solved})), "
        "o AS (SELECT system, i, max(b) FILTER (turn < 0) AS estimate, quantile_cont(b, 0.025) FILTER (turn >= 0) AS lo, quantile_cont(b, 0.975) FILTER (turn >= 0) AS hi FROM b GROUP BY ALL), "
        "h AS (SELECT system, min(place) AS base, list(DISTINCT place) AS present FROM p GROUP BY system HAVING count(*) >= count(DISTINCT place) + 3) "
        f"SELECT system, {names}[i + 1] AS name, round(estimate, 4) AS estimate, round(lo, 4) AS lo, round(hi, 4) AS hi, lo > 0 OR hi < 0 AS excludes_zero FROM o JOIN h USING (system) WHERE i IN (0, {_K - 2}, {_K - 1}) OR (list_contains(present, i - 1) AND i - 1 <> base)"
    )


@query(_regression_sql())
def regression_portable(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(N.regression(_regression_rows(spark, d), ["system"], list(S.CATEGORIES), ["pos"], REGRESSION_ROUNDS))


# ---- spans


@query(f"WITH {GOLD_SQL} SELECT uid, term, start, stop AS \"end\" FROM g")
def occurrences_overlapping(spark: SparkSession, d: str) -> DataFrame:
    return D.gold(spark, d).select("uid", "term", "start", "end")


PAIR_SQL = "o AS (SELECT g.uid, g.lang, gi, pi, category, type, greatest(0, least(g.stop, p.stop) - greatest(g.start, p.start)) AS overlap, (g.stop - g.start) + (p.stop - p.start) AS total, g.start = p.start AND g.stop = p.stop AS exact FROM g JOIN p ON g.uid = p.uid AND g.start < p.stop AND p.start < g.stop)"


@query(f"WITH {GOLD_SQL}, {PAIR_SQL} SELECT uid, gi, pi, overlap, round(overlap / (total - overlap), 6) AS iou FROM o")
def span_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = D.gold(spark, d)
    return M.overlap_pairs(g, D.predicted(g), max(map(len, D.TERMS))).select("uid", "gi", "pi", "overlap", F.round("iou", 6).alias("iou"))


@query(f"WITH {GOLD_SQL}, m AS (SELECT g.lang, count(*) AS tp, count(*) FILTER (category = type) AS typed FROM g JOIN p ON g.uid = p.uid AND gi = pi AND g.start = p.start AND g.stop = p.stop GROUP BY ALL), n AS (SELECT lang, count(*) AS n_gold FROM g GROUP BY lang), q AS (SELECT lang, count(*) AS n_pred FROM p GROUP BY lang) SELECT lang, n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(typed, 0) AS typed, round(100.0 * tp / n_pred, 4) AS strict_p, round(100.0 * tp / n_gold, 4) AS strict_r, round(2 * (100.0 * tp / n_pred) * (100.0 * tp / n_gold) / ((100.0 * tp / n_pred) + (100.0 * tp / n_gold)), 4) AS strict_f1 FROM n LEFT JOIN q USING (lang) LEFT JOIN m USING (lang)")
def span_exact_match(spark: SparkSession, d: str) -> DataFrame:
    g = D.gold(spark, d)
    p = D.predicted(g)
    hit = M.exact_matches(g, p).groupBy("lang").agg(F.count("*").alias("tp"), F.count_if(F.col("category") == F.col("type")).alias("typed"))
    out = g.groupBy("lang").agg(F.count("*").alias("n_gold")).join(p.groupBy("lang").agg(F.count("*").alias("n_pred")), "lang", "left").join(hit, "lang", "left")
    a, b, f = M.prf(F.col("tp").cast("double"), F.col("n_pred"), F.col("n_gold"), 100.0)
    return out.select("lang", "n_gold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pred", "tp", "typed")], F.round(a, 4).alias("strict_p"), F.round(b, 4).alias("strict_r"), F.round(f, 4).alias("strict_f1"))


@query(f"WITH {GOLD_SQL}, gc AS (SELECT DISTINCT uid, unnest(range(start, stop)) AS ch FROM g), pc AS (SELECT DISTINCT uid, unnest(range(start, stop)) AS ch FROM p) SELECT uid, count(g1) AS gold_chars, count(p1) AS pred_chars, count(*) FILTER (g1 IS NOT NULL AND p1 IS NOT NULL) AS overlap_chars FROM (SELECT uid, ch, 1 AS g1 FROM gc) FULL JOIN (SELECT uid, ch, 1 AS p1 FROM pc) USING (uid, ch) GROUP BY uid")
def char_overlap_prf(spark: SparkSession, d: str) -> DataFrame:
    g = D.gold(spark, d)
    return M.character_sets(g, D.predicted(g))


# one gold span and at most one prediction a sentence: then the greedy match is a plain join
SINGLE_SQL = "u AS (SELECT uid FROM g GROUP BY uid HAVING count(*) = 1), g1 AS (SELECT * FROM g WHERE uid IN (SELECT uid FROM u)), m AS (SELECT g1.uid, category, p.uid IS NOT NULL AS has, CASE WHEN p.uid IS NULL THEN 0 ELSE greatest(0, least(g1.stop, p.stop) - greatest(g1.start, p.start)) END AS o, (g1.stop - g1.start) + (p.stop - p.start) AS total, p.start = g1.start AND p.stop = g1.stop AS exact, p.type = category AS typed FROM g1 LEFT JOIN p ON g1.uid = p.uid), k AS (SELECT category, count(*) AS gold, count(*) FILTER (has) AS predicted, count(*) FILTER (o > 0) AS located, count(*) FILTER (o > 0 AND typed) AS located_typed, count(*) FILTER (o > 0 AND exact) AS located_exact, count(*) FILTER (o > 0 AND exact AND typed) AS located_exact_typed, count(*) FILTER (o > 0 AND 2 * o >= total - o) AS located_iou50 FROM m GROUP BY category)"


def _single(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of one gold span, with the prediction, as arrays of their rows: no join."""
    own = D.gold_rows(spark, d).where("size(gold) = 1")
    place = lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))
    sides = F.transform("gold", lambda g: F.struct(F.array(place(g)).alias("occ"), g["category"].alias("category")))
    return M.score_sentences(own.select("uid", F.get("gold", F.lit(0))["category"].alias("category"), sides.alias("gold_spans"), D.predicted_spans(F.col("uid"), F.col("gold")).alias("spans")))


@query(f"WITH {GOLD_SQL}, {SINGLE_SQL} SELECT category, gold, predicted, located, located_typed, located_exact, located_exact_typed, located_iou50, round(located / gold, 4) AS span_recall, round(coalesce(located / nullif(predicted, 0), 0), 4) AS span_precision FROM k")
def span_single_best(spark: SparkSession, d: str) -> DataFrame:
    counts = ["gold", "predicted", "located", "located_typed", "located_exact", "located_exact_typed", "located_iou50"]
    sums = M.merged(_single(spark, d), "category").withColumns({f"n_{c}": F.col(c) for c in counts})
    return M.rates(sums).select("category", *[F.col(f"n_{c}").alias(c) for c in counts], "span_recall", "span_precision")


@query(f"WITH {GOLD_SQL}, {SINGLE_SQL}, r AS (SELECT round(located / gold, 4) AS r, round(coalesce(2 * (located / nullif(predicted, 0)) * (located / gold) / nullif(located / nullif(predicted, 0) + located / gold, 0), 0), 4) AS f FROM k) SELECT round(avg(r), 4) AS macro_span_recall, round(avg(f), 4) AS macro_span_f1 FROM r")
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    return M.macro(M.rates(M.merged(_single(spark, d), "category")))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """All sentences with gold spans, a span being all places of a term; a sentence's category is that of its first place."""
    own = D.gold_rows(spark, d).where("size(gold) > 0")
    place = lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))

    def occ(term: str) -> Column:
        return F.array_sort(F.transform(F.filter("gold", lambda g: g["term"] == term), place))

    each = [F.struct(occ(t).alias("occ"), F.lit(c).alias("category")) for t, c in sorted(D.TERMS.items())]
    spans = F.filter(F.array(*each), lambda x: F.size(x["occ"]) > 0)
    first = F.array_min(F.transform("gold", lambda g: F.struct(g["gi"].alias("gi"), g["category"].alias("category"))))["category"]
    return M.score_sentences(own.select("uid", first.alias("category"), spans.alias("gold_spans"), F.array_sort(D.predicted_spans(F.col("uid"), F.col("gold"))).alias("spans")))


def _rates_sql(of: str, by: str) -> str:
    """Rates of summed counters, 0 where undefined."""
    over = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
    shown = ["gold AS gold_spans", "predicted AS predicted_spans", "sentences", f"round({over('predicted', 'sentences')}, 3) AS spans_per_sentence", f"round({over('gate_fired', 'sentences')}, 4) AS gate_fire_rate"]
    for kind in ("", "_typed", "_exact", "_exact_typed"):
        r, p = over(f"located{kind}", "gold"), over(f"predicted_hit{kind}", "predicted")
        shown += [f"round({r}, 4) AS span_recall{kind}", f"round({p}, 4) AS span_precision{kind}", f"round({over(f'(2 * {p} * {r})', f'({p} + {r})')}, 4) AS span_f1{kind}"]
        if not kind:
            shown.append(f"round({over(f'(5 * {p} * {r})', f'(4 * {p} + {r})')}, 4) AS span_f2")
    shown += [f"round({over(f'located{kind}', 'gold')}, 4) AS span_recall{kind}" for kind in ("_iou50", "_iou50_typed")]
    return f"SELECT {by}, {', '.join(shown)} FROM {of}"


#: The greedy match by recursion: a step tries the next pair of each sentence, the most overlap first.
GREEDY_SQL = (
    "gn AS (SELECT *, dense_rank() OVER (PARTITION BY uid ORDER BY term) - 1 AS gn FROM g), pn AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY start, stop, type) - 1 AS pn FROM p), "
    "m AS (SELECT gn.uid, gn.gn, pn.pn, gn.start AS a, gn.stop AS b, pn.start AS c, pn.stop AS d, category = type AS typed, least(gn.stop, pn.stop) - greatest(gn.start, pn.start) AS o FROM gn JOIN pn ON gn.uid = pn.uid AND gn.start < pn.stop AND pn.start < gn.stop), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY o DESC, gn, pn) AS k FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY uid, gn, pn ORDER BY o DESC, a) = 1)), "
    "f AS (SELECT uid, 0::BIGINT AS k, []::BIGINT[] AS ug, []::BIGINT[] AS up, false AS free FROM sent UNION ALL "
    "SELECT f.uid, f.k + 1, CASE WHEN list_contains(ug, gn) OR list_contains(up, pn) THEN ug ELSE list_append(ug, gn) END, CASE WHEN list_contains(ug, gn) OR list_contains(up, pn) THEN up ELSE list_append(up, pn) END, NOT (list_contains(ug, gn) OR list_contains(up, pn)) FROM f JOIN best ON best.uid = f.uid AND best.k = f.k + 1), "
    "took AS (SELECT best.*, a = c AND b = d AS exact, 2 * o >= (b - a) + (d - c) - o AS half FROM f JOIN best USING (uid, k) WHERE free), "
    "rest AS (SELECT uid, pn, arg_min(typed, gn) AS typed FROM best WHERE (uid, pn) NOT IN (SELECT (uid, pn) FROM took) GROUP BY uid, pn), "
    "l AS (SELECT uid, " + ", ".join(f"count(*) FILTER ({rule}) AS located{kind}" for kind, rule in (("", "true"), ("_typed", "typed"), ("_exact", "exact"), ("_exact_typed", "exact AND typed"), ("_iou50", "half"), ("_iou50_typed", "half AND typed"))) + " FROM took GROUP BY uid), "
    "r AS (SELECT uid, count(*) AS hit, count(*) FILTER (typed) AS hit_typed FROM rest GROUP BY uid), ng AS (SELECT uid, count(DISTINCT term) AS gold FROM g GROUP BY uid), np AS (SELECT uid, count(*) AS predicted FROM p GROUP BY uid), "
    "sc AS (SELECT uid, category, gold, coalesce(predicted, 0) AS predicted, 1 AS sentences, (coalesce(predicted, 0) > 0)::INT AS gate_fired, " + ", ".join(f"coalesce(located{kind}, 0) AS located{kind}" for kind in ("", "_typed", "_exact", "_exact_typed", "_iou50", "_iou50_typed"))
    + ", coalesce(located, 0) + coalesce(hit, 0) AS predicted_hit, coalesce(located_typed, 0) + coalesce(hit_typed, 0) AS predicted_hit_typed, coalesce(located_exact, 0) AS predicted_hit_exact, coalesce(located_exact_typed, 0) AS predicted_hit_exact_typed "
    "FROM sent JOIN ng USING (uid) LEFT JOIN np USING (uid) LEFT JOIN l USING (uid) LEFT JOIN r USING (uid)), "
    "st AS (SELECT *, CASE WHEN predicted = 0 THEN 'miss' WHEN located = 0 THEN 'fp_only' WHEN located_exact_typed > 0 THEN 'exact' ELSE 'partial' END AS stratum FROM sc)"
)
#: A sentence's category is that of the first of its spans.
SENTENCES_SQL = "sent AS (SELECT uid, arg_min(category, gi) AS category FROM g GROUP BY uid)"


def _sums_sql(by: str) -> str:
    return f"z AS (SELECT {by}, {', '.join(f'sum({c})::BIGINT AS {c}' for c in M.COUNTERS)} FROM st GROUP BY {by})"


@query(f"WITH RECURSIVE {GOLD_SQL}, {SENTENCES_SQL}, {GREEDY_SQL}, {_sums_sql('stratum')} " + _rates_sql("z", "stratum"))
def span_greedy_score(spark: SparkSession, d: str) -> DataFrame:
    return M.rates(M.merged(_whole(spark, d), "stratum"))


@query(f"WITH RECURSIVE {GOLD_SQL}, {SENTENCES_SQL}, {GREEDY_SQL}, {_sums_sql('category')}, v AS ({_rates_sql('z', 'category')}) SELECT round(avg(span_recall), 4) AS macro_span_recall, round(avg(span_f1), 4) AS macro_span_f1 FROM v")
def macro_average_all(spark: SparkSession, d: str) -> DataFrame:
    """Macro rates over all sentences, a sentence counting for the category of its first span."""
    return M.macro(M.rates(M.merged(_whole(spark, d), "category")))


@query(f"WITH RECURSIVE {GOLD_SQL}, {SENTENCES_SQL}, {GREEDY_SQL} SELECT uid, stratum, predicted, located, predicted_hit, predicted_hit_typed, located_iou50, gold - located AS n_missed FROM st")
def span_greedy_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The match of each sentence."""
    return _whole(spark, d).select("uid", "stratum", "predicted", "located", "predicted_hit", "predicted_hit_typed", "located_iou50", F.size("missed").cast("long").alias("n_missed"))


@query("WITH x AS (SELECT doc_id, quality AS t, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 0 ELSE 1 END AS l FROM labels JOIN documents USING (doc_id)) SELECT t AS quality, count(*) FILTER (l = 0) AS as_0, count(*) FILTER (l = 1) AS as_1 FROM x GROUP BY t")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(_labelled(spark, d), "quality", "label", ["0", "1"])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return own.select("doc_id", "quality", F.when(F.col("text").rlike("[#$%&*]{3}"), "0").otherwise("1").alias("label"))


@query("WITH x AS (SELECT quality AS t, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 0 ELSE 1 END AS l FROM labels JOIN documents USING (doc_id)), k AS (SELECT c, count(*) FILTER (t = c) AS support, count(*) FILTER (t = c AND l = c) AS tp, count(*) FILTER (l = c) AS n_pred FROM x, (VALUES (0), (1)) v(c) GROUP BY c) SELECT CAST(c AS VARCHAR) AS class, round(coalesce(tp / nullif(n_pred, 0), 0), 4) AS precision, round(coalesce(tp / nullif(support, 0), 0), 4) AS recall, round(coalesce(2 * (tp / nullif(n_pred, 0)) * (tp / nullif(support, 0)) / nullif(tp / nullif(n_pred, 0) + tp / nullif(support, 0), 0), 0), 4) AS f1, support FROM k WHERE support > 0")
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.class_scores(_labelled(spark, d).withColumn("quality", F.col("quality").cast("string")), "quality", "label")


@query("WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT round(max(n) / sum(n), 4) AS majority_class_accuracy, round(sum(n * n) / (sum(n) * sum(n)), 4) AS prior_weighted_accuracy FROM n")
def baseline_floors(spark: SparkSession, d: str) -> DataFrame:
    return M.baseline_floors(table(spark, d, "labels"), "quality")


# ---- text


@query("SELECT doc_id, sha256(out) AS digest, CASE WHEN out = text THEN 'unchanged' ELSE 'ok' END AS status FROM (SELECT doc_id, text, replace(replace(text, 'the', 'ye'), 'ye ', 'thou ') AS out FROM documents)")
def sequential_splice(spark: SparkSession, d: str) -> DataFrame:
    spans, stds = F.array(F.lit("the"), F.lit("ye ")), F.array(F.lit("ye"), F.lit("thou "))
    own = table(spark, d, "documents").select("doc_id", "text", S.replace_in_turn(F.col("text"), spans, stds).alias("out"))
    return own.select("doc_id", F.sha2("out", 256).alias("digest"), F.when(F.col("out") == F.col("text"), "unchanged").otherwise("ok").alias("status"))


@query("WITH t AS (SELECT a.conv_id, a.turn, a.text AS hyp, coalesce(u.text, '') AS src FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'), k AS (SELECT *, CASE WHEN hyp IS NULL OR trim(hyp) = '' THEN 'empty' WHEN contains(trim(hyp), chr(10)) THEN 'multiline' WHEN regexp_matches(hyp, 'Note:|Translation:|internet slang') THEN 'meta' WHEN regexp_matches(hyp, '(^|[^A-Za-z0-9_])(HOM|PYA|NEO|MIX)($|[^A-Za-z0-9_])') THEN 'code' WHEN trim(src) <> '' AND contains(hyp, trim(src)) THEN 'echo_src' END AS kind FROM t) SELECT coalesce(kind, 'none') AS kind, count(*) AS n, round(avg(length(hyp)), 4) AS mean_length FROM k GROUP BY kind")
def contract_violation_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src"))
    own = c.where("role = 'assistant'").join(u, ["conv_id", "turn"], "left")
    kind = V.contract_violation(F.col("text"), F.col("src"))
    return own.select(F.coalesce(kind, F.lit("none")).alias("kind"), F.length("text").alias("len")).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("len"), 4).alias("mean_length"))


@query(r"SELECT doc_id, at_user, url, phone FROM (SELECT doc_id, regexp_matches(text, '@[\p{L}\p{N}_\x{4e00}-\x{9fff}-]{2,}') AS at_user, regexp_matches(text, 'https?://[^\s]+|www\.[^\s]+') AS url, regexp_matches(text, '(^|[^A-Za-z0-9_])1[3-9][0-9]{9}($|[^A-Za-z0-9_])') AS phone FROM documents) WHERE at_user OR url OR phone")
def private_flags(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", V.private_hits(["text"]).alias("hits"))
    has = lambda k: F.array_contains("hits", f"text:{k}")
    return own.where(F.size("hits") > 0).select("doc_id", has("@user").alias("at_user"), has("url").alias("url"), has("phone").alias("phone"))


@query("SELECT doc_id, length(text) AS len FROM documents WHERE length(text) NOT BETWEEN 100 AND 5000")
def length_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("len")).where(~F.col("len").between(100, 5000))


@query(r"SELECT item_id, len(list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[^\p{L}\p{N}]*'))) AS n_usable, len(string_split(text, ' ')) AS n_all FROM benchmark")
def clean_candidate_filter(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", " ")
    return table(spark, d, "benchmark").select("item_id", F.size(X.usable_golds(words)).cast("long").alias("n_usable"), F.size(words).cast("long").alias("n_all"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IS NOT NULL AS has_k FROM events")
def json_spans_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"))


# ---- overlap


@query("SELECT level, n FROM (SELECT 'exact' AS level, count(*) AS n FROM documents WHERE text IN (SELECT text FROM documents d2 WHERE d2.doc_id % 2 = 1 AND text IS NOT NULL) AND doc_id % 2 = 0) UNION ALL SELECT 'loose', count(*) FROM documents WHERE lower(trim(text)) IN (SELECT lower(trim(text)) FROM documents d2 WHERE d2.doc_id % 2 = 1 AND text IS NOT NULL) AND doc_id % 2 = 0")
def overlap_membership(spark: SparkSession, d: str) -> DataFrame:
    """Even documents against odd ones: two roles of the whole table, at two strictness levels."""
    docs = table(spark, d, "documents")
    keys = {"exact": F.sha2("text", 256), "loose": F.sha2(F.lower(F.trim("text")), 256)}
    return O.membership_counts(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), keys)


GRAMS = "CASE WHEN length(t) < 4 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) END"


WORDS_SQL = "a AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM benchmark) GROUP BY word), b AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY word)"


@query(f"WITH {WORDS_SQL} SELECT count(a.word) AS bench_distinct, count(*) FILTER (a.word IS NOT NULL AND b.word IS NOT NULL) AS shared_distinct, count(b.word) AS pool_distinct, CAST(sum(a.n) AS BIGINT) AS bench_total, CAST(coalesce(sum(a.n) FILTER (b.word IS NOT NULL), 0) AS BIGINT) AS bench_covered, CAST(sum(b.n) AS BIGINT) AS pool_total, CAST(coalesce(sum(b.n) FILTER (a.word IS NOT NULL), 0) AS BIGINT) AS pool_covered FROM a FULL JOIN b ON a.word = b.word")
def vocabulary_coverage(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.lower("text"), " ")
    return O.coverage(O.vocabulary(table(spark, d, "benchmark"), words), O.vocabulary(table(spark, d, "documents"), words))


@query("WITH w AS (SELECT word, lang, count(*) AS n FROM (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY ALL), p AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark), m AS (SELECT lang, n, CASE WHEN p.word IS NULL THEN 'unseen' ELSE 'seen' END AS seen FROM w LEFT JOIN p USING (word)) SELECT CASE WHEN grouping(seen) = 1 THEN 'total' ELSE seen END AS seen, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_words FROM m GROUP BY CUBE (seen, lang)")
def seen_unseen_cube(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word"), F.lit(1).alias("n"))
    pool = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return O.seen_cube(words, pool, "lang")


@query("SELECT part, o_orderpriority AS category, count(*) AS n FROM (SELECT 'A' AS part, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT 'B', o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') GROUP BY ALL")
def union_tables(spark: SparkSession, d: str) -> DataFrame:
    o, old = table(spark, d, "orders").select("o_orderpriority", "o_orderdate"), F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    both = o.where(old).withColumn("part", F.lit("A")).unionByName(o.where(~old).withColumn("part", F.lit("B")))
    return both.groupBy("part", F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT item_id, '1. ' || text || ' (NEO)' AS hint, '[dummy-en] ' || text AS hyp FROM benchmark")
def dummy_translation(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    spans = F.array(F.struct(F.col("text").alias("text"), F.lit("NEO").alias("type")))
    return A.translate(b, "text", "hyp").select("item_id", A.hint_lines(spans).alias("hint"), "hyp")


def norm_sql(text: str) -> str:
    """The normal form of texts whose characters have no compatibility forms."""
    return f"lower(replace(replace(trim(regexp_replace(nfc_normalize({text}), '\\s+', ' ', 'g')), 'ß', 'ss'), 'œ', 'oe'))"


def window_sql(short: str, long: str, masks: str) -> str:
    """The best window of the longer of two texts; masks: window_masks_sql of them. The shorter has 62 characters at most."""
    m, n = f"length({short})", f"length({long})"
    first, last = f"greatest(1, e - {m} + 1)", f"least(e, {n})"
    rest = f"list_reduce(list_prepend((1::BIGINT << {m}) - 1, {masks}[{first}:{last}]), lambda r, h: ((r + (r & h)) | (r - (r & h))) & ((1::BIGINT << {m}) - 1))"
    return f"coalesce(list_max(list_transform(range(1, {n} + {m}), lambda e: 2.0 * ({m} - bit_count({rest})) / ({m} + {last} - {first} + 1))), 0)"


def window_masks_sql(short: str, long: str) -> str:
    return f"list_transform(string_split({long}, ''), lambda c: list_sum(list_transform(range(1, length({short}) + 1), lambda i: CASE WHEN {short}[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT)"


@query(
    f"WITH t AS (SELECT a.conv_id, a.turn, {norm_sql('a.text')} AS hyp, string_split(u.text, ' ') AS w FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'), "
    f"g AS (SELECT conv_id, turn, hyp, {norm_sql('gold')} AS gold FROM (SELECT conv_id, turn, hyp, unnest([array_to_string(w[:3], ' '), array_to_string(w[4:5], ' '), w[6]]) AS gold FROM t)), "
    "o AS (SELECT *, CASE WHEN length(gold) <= length(hyp) THEN gold ELSE hyp END AS s, CASE WHEN length(gold) <= length(hyp) THEN hyp ELSE gold END AS l FROM g WHERE length(gold) >= 2 AND regexp_matches(gold, '[\\p{L}\\p{N}]')), "
    f"p AS (SELECT conv_id, turn, {window_sql('s', 'l', 'k')} AS r FROM (SELECT *, {window_masks_sql('s', 'l')} AS k FROM (SELECT * FROM o UNION ALL SELECT conv_id, turn, hyp, gold, l AS s, s AS l FROM o WHERE length(s) = length(l)))), "
    "m AS (SELECT conv_id, turn, max(r) AS r FROM p GROUP BY conv_id, turn) "
    "SELECT t.conv_id, t.turn, (coalesce(r, 0) > 0.8)::INT AS hit, (coalesce(r, 0) > 0.65)::INT AS near, round(coalesce(r, 0), 6) AS best FROM t LEFT JOIN m ON m.conv_id = t.conv_id AND m.turn = t.turn"
)
def term_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every answer against phrases of what was asked: whether one is in it, or a window like one, and the best window's likeness."""
    c = table(spark, d, "conversations")
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.split("text", " ").alias("w"))
    own = c.where("role = 'assistant'").join(u, ["conv_id", "turn"])
    golds = F.array(F.array_join(F.slice("w", 1, 3), " "), F.array_join(F.slice("w", 4, 2), " "), F.get("w", F.lit(5)))
    own = own.select("conv_id", "turn", "text", golds.alias("golds"))
    # one row a phrase: the best of them by an ordinary aggregate
    each = own.select("conv_id", "turn", "text", F.explode_outer(X.usable_golds(F.array_compact("golds"))).alias("gold"))
    best = each.groupBy("conv_id", "turn").agg(F.round(F.max(F.coalesce(X.partial_ratio(X.norm_text(F.col("gold")), X.norm_text(F.col("text"))), F.lit(0.0))), 6).alias("best"))
    hits = own.select("conv_id", "turn", X.term_hit(F.col("text"), F.col("golds")).alias("hit"), X.term_hit(F.col("text"), F.col("golds"), 0.65).alias("near"))
    return hits.join(best, ["conv_id", "turn"])


_COMPOSED = "nfc_normalize(coalesce(text, ''))"
#: Forms of texts without compatibility characters.
FORMS_SQL = {
    "norm": norm_sql("coalesce(text, '')"), "nfkc": f"regexp_replace({_COMPOSED}, '^\\s+|\\s+$', '', 'g')", "match_key": f"lower(regexp_replace({_COMPOSED}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))",
    "core": f"regexp_replace({_COMPOSED}, '" + X.PUNCTUATION.replace("'", "''") + "', '', 'g')",
}


@query("SELECT doc_id, " + ", ".join(f"sha256({form}) AS {name}" for name, form in FORMS_SQL.items()) + " FROM documents")
def normalised_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every form of every document."""
    forms = {"norm": X.norm_text, "nfkc": X.nfkc, "match_key": X.match_key, "core": X.core}
    return table(spark, d, "documents").select("doc_id", *[F.sha2(f(F.col("text")), 256).alias(name) for name, f in forms.items()])


# ---- more of the inventory: tallies, identities, set operations, scalar functions


@query("SELECT quality, toxic, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM labels GROUP BY ALL")
def verdict_tallies(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    # a handful of rows by now, one for each verdict
    total = own.agg(F.sum("n").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("quality", "toxic", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query(f"WITH {GOLD_SQL}, {PAIR_SQL} SELECT uid, gi, category FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.uid = g.uid AND o.gi = g.gi)")
def missed_spans(spark: SparkSession, d: str) -> DataFrame:
    g = D.gold(spark, d)
    return g.join(M.overlap_pairs(g, D.predicted(g), max(map(len, D.TERMS))).select("uid", "gi"), ["uid", "gi"], "left_anti").select("uid", "gi", "category")


@query("SELECT role, count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS n_empty, count(*) FILTER (contains(text, chr(10))) AS n_multiline FROM conversations GROUP BY role")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("n_empty"), F.count_if(F.contains("text", F.lit("\n"))).alias("n_multiline"))


@query("SELECT form, (SELECT count(*) FROM documents WHERE contains(text, form)) AS n FROM (VALUES ('token'), ('License'), ('no such form')) f(form)")
def example_leaks(spark: SparkSession, d: str) -> DataFrame:
    return V.leaked(values(spark, "form", ["token", "License", "no such form"]), table(spark, d, "documents").select("text"), ["text"])


@query("WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders) SELECT side, o_orderkey, o_orderstatus FROM (SELECT 'a' AS side, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'b', * FROM (FROM b EXCEPT ALL FROM a))")
def frozen_table_differences(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    return V.table_differences(a, b)


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_unaligned, count(*) FILTER (event_id % 9 = 0 AND value IS NOT NULL) AS n_value FROM events")
def clean_side_identity(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select("event_id", "value")
    b = a.withColumn("value", F.col("value") + F.when(F.col("event_id") % 9 == 0, 0.5).otherwise(1e-9))
    return V.differing(a, b, ["event_id"], ["value"], 1e-6)


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'distinct', count(DISTINCT o_custkey) FROM orders")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "without")).unionByName(n(b.distinct(), "distinct"))


@query(f"WITH a AS (SELECT p_partkey, (SELECT {GRAMS} FROM (SELECT lower(p_name) AS t)) AS a, (SELECT {GRAMS} FROM (SELECT lower(p_type) AS t)) AS b FROM part) SELECT p_partkey, len(a) AS n_grams, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard FROM a")
def gram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select("p_partkey", X.char_grams(F.lower("p_name")).alias("a"), X.char_grams(F.lower("p_type")).alias("b"))
    return own.select("p_partkey", F.size("a").cast("long").alias("n_grams"), F.round(F.coalesce(X.jaccard(F.col("a"), F.col("b")), F.lit(0.0)), 6).alias("jaccard"))


@query("SELECT p_partkey, printf('%.2f', p_retailprice) AS price, '[' || printf('%.2f', p_retailprice - p_size) || ', ' || printf('%.2f', p_retailprice + p_size) || ']' AS interval FROM part")
def number_cells(spark: SparkSession, d: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", X.fixed(price).alias("price"), X.interval_cell(price - size, price + size).alias("interval"))


#: Spans that overlap, with standard forms that hold other spans; in SQL each place is first taken by a mark, longest span first.
OVERLAPPING = {"to": "on", "token": "key", "the": "to the", "tion": "token", "on": ""}


def _spliced_sql() -> str:
    order = sorted(OVERLAPPING, key=len, reverse=True)
    marked, missing = "text", []
    for n, span in enumerate(order):
        missing.append(f"WHEN NOT contains({marked}, '{span}') THEN 'no place for ' || chr(39) || '{span}' || chr(39)")
        marked = f"replace({marked}, '{span}', chr({0xE000 + n}))"
    for n, span in enumerate(order):
        marked = f"replace({marked}, chr({0xE000 + n}), '{OVERLAPPING[span]}')"
    return f"SELECT doc_id, CASE WHEN error IS NULL THEN sha256(done) END AS spliced, error FROM (SELECT doc_id, {marked} AS done, CASE {' '.join(missing)} END AS error FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"


@query(_spliced_sql())
def splice_everywhere(spark: SparkSession, d: str) -> DataFrame:
    """All documents, with the first span that has no free place where there is one."""
    sides = [F.array(*[F.lit(x) for x in side]) for side in (OVERLAPPING.keys(), OVERLAPPING.values())]
    done = table(spark, d, "documents").select("doc_id", S.splice_all(F.col("text"), *sides).alias("s"))
    return done.select("doc_id", F.sha2("s.text", 256).alias("spliced"), "s.error")


@query("SELECT item_id, trim(text) AS answer FROM benchmark")
def leading_thoughts(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select("item_id", X.without_thoughts(F.concat(F.lit("<think>one\ntwo</think>\n "), "text")).alias("answer"))


@query(f"WITH {GOLD_SQL}, x AS (SELECT uid, ((uid * 31 + start) % 10) / 10.0 AS confidence FROM g) SELECT uid, count(*) AS n_all, count(*) FILTER (confidence >= 0.5) AS n_kept FROM x GROUP BY uid")
def confidence_abstention(spark: SparkSession, d: str) -> DataFrame:
    own = D.gold(spark, d).select("uid", F.struct("start", "end", ((F.col("uid") * 31 + F.col("start")) % 10 / 10).alias("confidence")).alias("s"))
    own = own.groupBy("uid").agg(F.collect_list("s").alias("spans"))
    return own.select("uid", F.size("spans").cast("long").alias("n_all"), F.size(S.keep_confident(F.col("spans"), 0.5)).cast("long").alias("n_kept"))


NAMES_SQL = f"x AS (SELECT p_partkey AS k, len(g) AS n, unnest(g) AS w FROM (SELECT p_partkey, {GRAMS} AS g FROM (SELECT p_partkey, lower(p_name) AS t FROM part)))"


@query(f"WITH {NAMES_SQL}, c AS (SELECT a.k AS l, b.k AS r, count(*) AS o, max(a.n) AS n, max(b.n) AS m FROM x a JOIN x b USING (w) WHERE a.k % 2 = 0 AND b.k % 2 = 1 GROUP BY ALL) SELECT l, min(r) AS r FROM c WHERE o >= 0.6 * (n + m - o) GROUP BY l")
def first_near_partner(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select("p_partkey", X.char_grams(F.lower("p_name")).alias("grams"))
    left, right = own.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "l"), own.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "r")
    return O.first_partner(left, right, 0.6)
