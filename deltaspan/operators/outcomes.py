"""What happened to rows: detection and restoration by scope, broken contracts by arm, chance floors, strata.

Long tables have a row for each span; every roll-up is one grouping over them, and no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import splice as S
from . import overlap as O
from . import resample as R
from . import spans as M

Match = Callable[[Column, Column], Column]
#: The category whose spans carry candidates.
WITH_CANDIDATES = "HOM"
STRATA = ("miss", "fp_only", "partial", "exact")


def joined(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """Inner join in which a key of the left side that the right side lacks is an error; it is raised when the rows are read."""
    found = right.withColumn("__found", F.lit(True))
    sure = F.when(F.col("__found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no {what} for "), F.col(key).cast("string"))))
    return left.join(found, key, "left").withColumn(key, sure).drop("__found")


def known(results: DataFrame, gold: DataFrame, key: str = "uid") -> DataFrame:
    """Results with their gold rows; results of which there is no gold are left out."""
    return results.join(gold, key)


def _rate(top: Column, bottom: Column) -> Column:
    return F.round(F.try_divide(100.0 * top, bottom), 2)


def scoped(df: DataFrame, sums: list[str], rows: str = "n_rows") -> DataFrame:
    """Sums over all rows and by category, scopes without rows left out."""
    own = df.groupingSets([[], ["category"]], "category").agg(F.count("*").alias(rows), *[F.sum(c).alias(c) for c in sums], F.grouping("category").alias("__all"))
    return own.where(f"{rows} > 0").select(F.when(F.col("__all") == 1, "all").otherwise(F.col("category")).alias("scope"), rows, *sums)


def detection(sentences: DataFrame, gold: DataFrame, predicted: DataFrame, same: Match) -> DataFrame:
    """Detection by scope, in percent: strict and character rates, right types, and what candidates are worth.

    sentences: uid, category; gold: uid, gi, start, end, std; predicted: uid, pi, start, end, type, candidates. A gold
    and a predicted span of the same bounds match, each once. Candidates count for spans of WITH_CANDIDATES: how many
    matched ones have any, of these how often the first or any is the standard form by ``same``.
    """
    g = gold.join(sentences.select("uid", "category"), "uid") if "category" not in gold.columns else gold
    match = M.exact_matches(g, predicted.drop("candidates")).join(predicted.select("uid", "pi", "candidates"), ["uid", "pi"])
    own = (F.col("category") == WITH_CANDIDATES).cast("long")
    given = own * (F.coalesce(F.size("candidates"), F.lit(0)) > 0).cast("long")
    right = F.transform(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: same(c, F.col("std")))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    hits = match.select(
        "uid", F.lit(1).alias("strict_tp"), (F.col("type") == F.col("category")).cast("long").alias("type_ok"), own.alias("cand_n"), given.alias("cand_given"),
        (given * flag(F.get(right, F.lit(0)))).alias("cand_hit1"), (given * flag(F.exists(right, lambda x: x))).alias("cand_hitany"),
    )
    sums = ["strict_tp", "type_ok", "cand_n", "cand_given", "cand_hit1", "cand_hitany"]
    hits = hits.groupBy("uid").agg(*[F.sum(c).alias(c) for c in sums])
    per_row = sentences.select("uid", "category").join(hits, "uid", "left").join(gold.groupBy("uid").agg(F.count("*").alias("n_gold")), "uid", "left")
    per_row = per_row.join(predicted.groupBy("uid").agg(F.count("*").alias("n_pred")), "uid", "left").join(M.character_sets(gold, predicted), "uid", "left")
    sums += ["n_gold", "n_pred", "gold_chars", "pred_chars", "overlap_chars"]
    out = scoped(per_row.na.fill(0, sums), sums)
    rate = {}
    for name, (tp, a, b) in {"strict": ("strict_tp", "n_pred", "n_gold"), "char": ("overlap_chars", "pred_chars", "gold_chars")}.items():
        rate |= dict(zip((f"{name}_p", f"{name}_r", f"{name}_f1"), [F.round(x, 2) for x in M.prf(F.col(tp), F.col(a), F.col(b), 100.0)], strict=True))
    rate |= {n: _rate(F.col(a), F.col(b)) for n, a, b in (("type_acc", "type_ok", "strict_tp"), ("cand_cov", "cand_given", "cand_n"), ("cand_hit1", "cand_hit1", "cand_given"), ("cand_hitany", "cand_hitany", "cand_given"))}
    return out.select("scope", "n_rows", "n_gold", "n_pred", *[c.alias(n) for n, c in rate.items()])


def restoration(logs: DataFrame, records: DataFrame, gold: DataFrame, exact: Match, fuzzy: Match) -> DataFrame:
    """How well standard forms were restored, by scope.

    logs: uid, spans (array of struct text, std), parse_ok (null reads as true); records: uid, category; gold: uid, n
    (the order within a sentence), text, std. Logs of unknown sentences are left out. A span without a standard form
    isn't scored, one whose text is no gold span is unpaired; of several gold spans of a text the last one's form holds.
    """
    form = gold.groupBy("uid", "text").agg(F.max_by("std", "n").alias("gold_std"))
    known = logs.join(records.select("uid", "category"), "uid")
    each = known.select("uid", "category", F.explode("spans").alias("s")).select("uid", "category", "s.text", "s.std").where("std <> ''")
    paired = each.join(form, ["uid", "text"], "left")
    has = F.col("gold_std").isNotNull()
    flag = lambda c: F.coalesce(has & c, F.lit(False)).cast("long")
    marks = paired.select("category", flag(F.lit(True)).alias("n"), flag(exact(F.col("std"), F.col("gold_std"))).alias("exact"), flag(fuzzy(F.col("std"), F.col("gold_std"))).alias("fuzzy"), (~has).cast("long").alias("unpaired"))
    sums = ["n", "exact", "fuzzy", "unpaired"]
    rows = scoped(known.select("category", (~F.coalesce("parse_ok", F.lit(True))).cast("long").alias("parse_fail")), ["parse_fail"])
    out = rows.join(scoped(marks, sums, "n_spans"), "scope", "left").na.fill(0, sums)
    return out.select("scope", "n_rows", F.col("n").alias("n_scored"), _rate(F.col("exact"), F.col("n")).alias("exact_rate"), _rate(F.col("fuzzy"), F.col("n")).alias("fuzzy_rate"), F.col("unpaired").alias("n_unpaired"), F.col("parse_fail").alias("n_parse_fail"))


def arm_spans(arm: Column, detected: Column, gold: Column) -> Column:
    """The spans that an arm hands over: none, the detector's, or the gold ones; a repaired form (b2s) is as its arm."""
    base = F.regexp_replace(arm, "s$", "")
    return F.when(base == "b2", F.coalesce(detected, F.filter(gold, lambda x: F.lit(False)))).when(base == "b3", gold).otherwise(F.filter(gold, lambda x: F.lit(False)))


def violations(rows: DataFrame, kind: Column, baseline: str) -> tuple[DataFrame, DataFrame]:
    """Rows (arm, uid, score, ...) whose answer broke a rule: counts by (arm, kind), and what they cost each arm.

    cost: the mean difference to the baseline arm over the bad rows that both have scored; pull: the same sum over all
    rows of the arm. Both are null for the baseline, and where there is nothing to compare.
    """
    marked = rows.withColumn("kind", kind)
    base = rows.where(F.col("arm") == baseline).where("score is not null").groupBy("uid").agg(F.max("score").alias("base"))
    bad = marked.where("kind is not null and score is not null").where(F.col("arm") != baseline).join(base, "uid")
    lost = bad.groupBy("arm").agg(F.sum(F.col("score") - F.col("base")).alias("lost"), F.count("*").alias("n"))
    whole = marked.groupBy("arm").agg(F.count("*").alias("n_rows"), F.count("kind").alias("n_bad"))
    cost = whole.join(lost, "arm", "left").select("arm", "n_rows", "n_bad", F.try_divide("lost", "n").alias("cost"), F.try_divide("lost", "n_rows").alias("pull"))
    return marked.where("kind is not null").groupBy("arm", "kind").agg(F.count("*").alias("n")), cost


def widths(gold: DataFrame) -> list[tuple[int, int]]:
    """The lengths of gold spans with their counts; there are no more than a sentence has characters."""
    return [(r["w"], r["n"]) for r in gold.groupBy((F.col("end") - F.col("start")).alias("w")).agg(F.count("*").alias("n")).orderBy("w").collect()]


def chance_recall(sentences: DataFrame, length: list[tuple[int, int]], by: list[str], rounds: int, digits: int = 4) -> DataFrame:
    """Recall that spans of random place reach, by columns of the gold spans: overlap, half overlap, exact.

    sentences: uid, n_chars, budget (how many spans were predicted), gold_spans (array of struct of occ and the
    columns). Each round puts as many spans into a sentence, of lengths drawn from the gold ones. Draws are hashes of
    sentence, round and number, so that any engine makes the same, in any order.
    """
    total, ends = 0, []
    for _, n in length:
        ends.append(total := total + n)
    limits, sizes = F.array(*[F.lit(x).cast("bigint") for x in ends]), F.array(*[F.lit(w).cast("bigint") for w, _ in length])
    n = F.greatest(F.col("n_chars").cast("long"), F.lit(1))

    def draw(slot: Column, what: str) -> Column:
        text = F.concat_ws("|", F.col("uid").cast("string"), F.col("turn").cast("string"), slot.cast("string"), F.lit(what))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")

    def fake(slot: Column) -> Column:
        u = draw(slot, "w") % max(total, 1)
        w = F.least(F.get(sizes, F.size(F.filter(limits, lambda e: e <= u))), n)
        a = draw(slot, "a") % F.greatest(n - w + 1, F.lit(1))
        return F.struct(a.alias("a"), (a + w).alias("b"))

    slots = F.when(F.col("budget") > 0, F.sequence(F.lit(0), F.col("budget").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    turns = sentences.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("fakes", F.transform(slots, fake))

    def any_hit(g: Column, rule: Callable[[Column, Column, Column], Column]) -> Column:
        def one(o: Column, f: Column) -> Column:
            common = M.overlap(o["start"], o["end"], f["a"], f["b"])
            return rule(common, o["end"] - o["start"] + f["b"] - f["a"] - common, (o["start"] == f["a"]) & (o["end"] == f["b"]))

        return F.exists(g["occ"], lambda o: F.exists(F.col("fakes"), lambda f: one(o, f))).cast("long")

    hits = turns.select(F.explode(F.transform("gold_spans", lambda g: F.struct(
        *[g[c].alias(c) for c in by], any_hit(g, lambda c, u, e: c > 0).alias("any"), any_hit(g, lambda c, u, e: (c > 0) & (2 * c >= u)).alias("half"), any_hit(g, lambda c, u, e: e).alias("same"),
    ))).alias("h")).select("h.*")
    return hits.groupBy(*by).agg(F.round(F.avg("any"), digits).alias("chance_recall"), F.round(F.avg("half"), digits).alias("chance_recall_iou50"), F.round(F.avg("same"), digits).alias("chance_recall_exact"))


def strata_scopes(rows: DataFrame) -> DataFrame:
    """Each row (uid, category, stratum, candidates, value_hi, value_lo) once for each of its scopes.

    Scopes: all, the stratum, cand or nocand where the detector found anything, and the category.
    """
    flag = F.when(F.col("stratum") != "miss", F.when(F.col("candidates"), "cand").otherwise("nocand"))
    scopes = F.array_compact(F.array(F.lit("all"), F.col("stratum"), flag, F.col("category")))
    return rows.select("uid", "value_hi", "value_lo", F.explode(scopes).alias("scope"))


def strata_contrast(rows: DataFrame, strata: DataFrame, rounds: int, place: R.Place = R.hashed_place) -> DataFrame:
    """The paired contrast of two arms within each scope; a row without a stratum is an error."""
    return R.paired_portable(strata_scopes(joined(rows, strata, "uid", "stratum")), ["uid"], rounds, ["scope"], place)


def membership_grid(bench: DataFrame, pool: DataFrame, sides: dict[str, str], keys: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Sentences of either side of a benchmark that are sentences of either side of a pool, at each level of strictness.

    sides: names of the sides and their columns; keys: what a sentence is compared by, for each level.
    """
    own = {(side, level): key(F.col(column)) for side, column in sides.items() for level, key in keys.items()}
    # an empty sentence of the pool is none
    other = {(side, level): F.when(F.col(sides[side]) != "", key) for (side, level), key in own.items()}
    return O.membership_table(bench, pool, own, other)


def handed_over(rows: DataFrame, arm: str) -> DataFrame:
    """Adds given, the spans of an arm: of src_noisy's gold ranges in place order, with the sentence's category as type."""
    ranges = S.claim_all(F.col("src_noisy"), F.col("noise_span"), F.col("noise_std"))["ranges"]
    gold = F.transform(ranges, lambda r: F.struct(r["span"].alias("text"), F.col("category").alias("type"), r["std"].alias("std")))
    return rows.withColumn("given", arm_spans(F.lit(arm), F.col("detected"), gold))
