"""Scoring of predicted spans against gold spans.

Long tables: gold (uid, gi, start, end, category[, occ]) and predicted (uid, pi, start, end, type[, confidence]).
Sentence tables hold both as arrays in a row, and their greedy match is an expression over these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind

COUNTERS = (
    "gold", "predicted", "located", "located_typed", "located_exact", "located_exact_typed", "located_iou50", "located_iou50_typed",
    "predicted_hit", "predicted_hit_typed", "predicted_hit_exact", "predicted_hit_exact_typed", "sentences", "gate_fired",
)
CLASSES = ("HOM", "PYA", "NEO", "MIX")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    common = overlap(a0, a1, b0, b1)
    return F.coalesce(F.try_divide(common.cast("double"), (a1 - a0) + (b1 - b0) - common), F.lit(0.0))


#: Spans are put into buckets as wide as a power of 2^RUNG, the least that a span isn't wider than.
RUNG = 4


def _rung(start: Column, end: Column) -> Column:
    return F.floor((F.length(F.bin(end - start - 1)) + RUNG - 1) / RUNG).cast("int")


def _bucket(at: Column, rung: Column) -> Column:
    return F.call_function("shiftright", at.cast("bigint"), rung * RUNG)


def overlap_pairs(gold: DataFrame, predicted: DataFrame, usual: int | None = None) -> DataFrame:
    """Pairs that share a character, with their overlap and intersection over union; a range join within uid.

    Spans meet in buckets of the wider one's width, where either has two at most, and a pair counts in the first bucket
    that both have. So a uid may have any number of spans, and a few wide ones don't widen the buckets of the others. A
    narrower span is put into wider buckets only where the other table has spans of that width: the widths present, a
    handful of numbers, are looked up first. Where the ``usual`` width of spans is known, all are put into buckets of that
    width instead, wider ones into several, and nothing is looked up; it changes no pair.
    """
    g = gold.where("start < end").select("uid", "gi", F.col("start").alias("g0"), F.col("end").alias("g1"), "category", _rung(F.col("start"), F.col("end")).alias("rg"))
    p = predicted.where("start < end").select("uid", "pi", F.col("start").alias("p0"), F.col("end").alias("p1"), "type", _rung(F.col("start"), F.col("end")).alias("rp"))
    if usual is not None:
        rung = F.lit(max(1, -(-(usual - 1).bit_length() // RUNG)))
        spread = lambda df, a, b: df.withColumn("m", rung).withColumn("bucket", F.explode(F.sequence(_bucket(F.col(a), rung), _bucket(F.col(b) - 1, rung))))
        return _meeting(spread(g, "g0", "g1"), spread(p, "p0", "p1"), ["uid", "m", "bucket"])
    have = {side: [r[0] for r in df.select(side).distinct().collect()] for df, side in ((g, "rg"), (p, "rp"))}

    def met(df: DataFrame, rung: str, other: str, a: str, b: str) -> DataFrame:
        # a bucket of its own width for spans up to that width, and wider ones for wider spans of the other side
        wider = F.array(*[F.lit(x) for x in sorted(have[other])]).cast("array<int>")
        rungs = F.array_union(F.array(F.struct(F.col(rung).alias("m"), F.lit(0).alias("wide"))), F.transform(F.filter(wider, lambda m: m > F.col(rung)), lambda m: F.struct(m.alias("m"), F.lit(1).alias("wide"))))
        own = df.withColumn("r", F.explode(rungs)).select(*df.columns, "r.m", "r.wide")
        return own.withColumn("bucket", F.explode(F.sequence(_bucket(F.col(a), F.col("m")), _bucket(F.col(b) - 1, F.col("m")))))

    g = met(g, "rg", "rp", "g0", "g1").withColumnRenamed("wide", "wide_g")
    p = met(p, "rp", "rg", "p0", "p1").withColumnRenamed("wide", "wide_p")
    # both of one width, or either in the buckets of the other: never two narrow ones in a wide bucket
    sides = F.explode(F.when(F.col("wide_g") == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))))
    g = g.withColumn("side", sides)
    p = p.withColumn("side", F.explode(F.when(F.col("wide_p") == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2)))))
    return _meeting(g, p, ["uid", "m", "side", "bucket"])


def _meeting(g: DataFrame, p: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that overlap, in the first bucket that both have."""
    first = F.col("bucket") == _bucket(F.greatest("g0", "p0"), F.col("m"))
    out = g.join(p, keys).where(F.expr("g0 < p1 and p0 < g1") & first)
    return out.select("uid", "gi", "pi", "g0", "g1", "p0", "p1", "category", "type", overlap(F.col("g0"), F.col("g1"), F.col("p0"), F.col("p1")).alias("overlap"), iou(F.col("g0"), F.col("g1"), F.col("p0"), F.col("p1")).alias("iou"))


def exact_matches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Same bounds, each span used once: the n-th gold of some bounds takes the n-th prediction of them."""
    from pyspark.sql import Window

    nth = lambda df, i: df.withColumn("nth", F.row_number().over(Window.partitionBy("uid", "start", "end").orderBy(i)))
    return nth(gold, "gi").join(nth(predicted, "pi").select("uid", "start", "end", "nth", "pi", "type"), ["uid", "start", "end", "nth"]).drop("nth")


#: Characters whose marks one number holds.
MARKS = 60


def character_sets(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """By uid, characters in gold spans, in predicted spans, and in both; repeats and overlaps count once.

    A span is a run of bits in one or a few blocks of MARKS characters, and blocks are joined by an ordinary aggregate of
    bits, so that neither characters nor all spans of a uid are gathered.
    """

    def marked(df: DataFrame, side: str) -> DataFrame:
        block = F.explode(F.sequence(F.floor(F.col("start") / MARKS), F.floor((F.col("end") - 1) / MARKS))).alias("block")
        own = df.where("start < end").select("uid", "start", "end", block)
        upto = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(F.lit(MARKS), F.greatest(F.lit(0), F.col(c) - F.col("block") * MARKS)).cast("int"))
        bits = upto("end") - upto("start")
        return own.select("uid", "block", *[(bits if s == side else F.lit(0).cast("bigint")).alias(s) for s in "gp"])

    blocks = marked(gold, "g").unionByName(marked(predicted, "p")).groupBy("uid", "block").agg(F.bit_or("g").alias("g"), F.bit_or("p").alias("p"))
    n = lambda c: F.sum(F.bit_count(c).cast("bigint"))
    return blocks.groupBy("uid").agg(n(F.col("g")).alias("gold_chars"), n(F.col("p")).alias("pred_chars"), n(F.col("g").bitwiseAND(F.col("p"))).alias("overlap_chars"))


def prf(tp: Column, n_pred: Column, n_gold: Column, scale: float = 1.0) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; null where nothing is to be divided."""
    p, r = F.try_divide(scale * tp, n_pred), F.try_divide(scale * tp, n_gold)
    return p, r, F.try_divide(2 * p * r, p + r)


def greedy(gold: Column, predicted: Column, gate: Column | None = None) -> Column:
    """The greedy match of a sentence's arrays: a struct of the counters, the indexes of missed gold spans, and the stratum.

    gold: structs of occ (an array of places) and category; predicted: structs of start, end and type.
    A gold span meets a prediction with the place that overlaps most, the first of equals. Pairs are folded in order of
    overlap, most first, then of gold and prediction, over what is taken on either side. A prediction left over that
    touches any gold span is a hit as well, typed by the first that it touches. Strata: miss, nothing predicted; fp_only,
    nothing right; exact, a typed exact match; else partial. gate: whether a detector's gate fired, by default whether it
    predicted anything.
    """
    name = lambda c: F.upper(F.coalesce(c, F.lit("")))
    whole = lambda c: c.cast("bigint")

    def meeting(g: Column, gi: Column, p: Column, pi: Column) -> Column:
        none = F.struct(F.lit(0).cast("bigint").alias("o"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))

        def better(s: Column, x: Column) -> Column:
            common = whole(overlap(x["start"], x["end"], p["start"], p["end"]))
            return F.when(common > s["o"], F.struct(common.alias("o"), whole(x["start"]).alias("a"), whole(x["end"]).alias("b"))).otherwise(s)

        def told(s: Column) -> Column:
            total = s["b"] - s["a"] + p["end"] - p["start"]
            return F.struct(
                (-s["o"]).alias("lost"), gi.alias("g"), pi.alias("p"), (name(p["type"]) == name(g["category"])).alias("typed"),
                ((s["a"] == p["start"]) & (s["b"] == p["end"])).alias("exact"), (2 * s["o"] >= total - s["o"]).alias("half"),
            )

        return F.aggregate(F.coalesce(g["occ"], F.array().cast("array<struct<start:int,end:int>>")), none, better, told)

    def folded(pairs: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("g"), F.array().cast("array<int>").alias("p"), F.filter(pairs, lambda x: F.lit(False)).alias("pairs"))
        taken = lambda s, x: F.array_contains(s["g"], x["g"]) | F.array_contains(s["p"], x["p"])
        put = lambda s, x: F.struct(F.array_append(s["g"], x["g"]).alias("g"), F.array_append(s["p"], x["p"]).alias("p"), F.array_append(s["pairs"], x).alias("pairs"))
        return F.aggregate(F.array_sort(pairs), start, lambda s, x: F.when(taken(s, x), s).otherwise(put(s, x)))

    def score(g: Column, p: Column) -> Column:
        # by prediction, the gold spans that it touches, in order
        touched = F.transform(p, lambda y, pi: F.filter(F.transform(g, lambda x, gi: meeting(x, gi, y, pi)), lambda m: m["lost"] < 0))
        return bind(touched, lambda t: bind(folded(F.flatten(t)), lambda s: counted(g, p, t, s)))

    def counted(g: Column, p: Column, t: Column, s: Column) -> Column:
        n = lambda rule: whole(F.size(F.filter(s["pairs"], rule)))
        rules = {"": lambda x: F.lit(True), "_typed": lambda x: x["typed"], "_exact": lambda x: x["exact"], "_exact_typed": lambda x: x["exact"] & x["typed"]}
        rest = F.filter(t, lambda own, pi: (F.size(own) > 0) & ~F.array_contains(s["p"], pi))
        more = {"": whole(F.size(rest)), "_typed": whole(F.size(F.filter(rest, lambda own: F.get(own, F.lit(0))["typed"])))}
        values = {"gold": whole(F.size(g)), "predicted": whole(F.size(p)), "sentences": F.lit(1).cast("bigint"), "gate_fired": whole(F.size(p) > 0 if gate is None else F.coalesce(gate, F.size(p) > 0))}
        for kind, rule in rules.items():
            values |= {f"located{kind}": n(rule), f"predicted_hit{kind}": n(rule) + more.get(kind, F.lit(0))}
        values |= {"located_iou50": n(lambda x: x["half"]), "located_iou50_typed": n(lambda x: x["half"] & x["typed"])}
        every = F.transform(g, lambda x, gi: gi)
        stratum = F.when(F.size(p) == 0, "miss").when(F.size(s["pairs"]) == 0, "fp_only").when(F.exists(s["pairs"], rules["_exact_typed"]), "exact").otherwise("partial")
        return F.struct(*[values[c].alias(c) for c in COUNTERS], F.filter(every, lambda gi: ~F.array_contains(s["g"], gi)).alias("missed"), stratum.alias("stratum"))

    return bind(F.struct(gold.alias("g"), predicted.alias("p")), lambda r: score(r["g"], r["p"]))


_GOLD = "array<struct<occ:array<struct<start:int,end:int>>,category:string>>"
_FOUND = "array<struct<start:int,end:int,type:string>>"


def score_sentences(df: DataFrame, gold: str = "gold_spans", predicted: str = "spans", gate: str | None = None) -> DataFrame:
    """Adds the counters, the indexes of missed gold spans and the stratum of each sentence; a null is no span."""
    found = F.transform(predicted, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["type"].alias("type")))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    score = greedy(empty(F.col(gold).cast(_GOLD), _GOLD), empty(found.cast(_FOUND), _FOUND), None if gate is None else F.col(gate))
    return df.withColumn("__score", score).select(*df.columns, "__score.*")


def merged(scored: DataFrame, *by: str) -> DataFrame:
    """Sums of the counters, by nothing or by some columns."""
    return scored.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def merged_sets(scored: DataFrame, sets: list[list[str]], whole: str = "all") -> DataFrame:
    """Sums of the counters over several groupings in one pass; a column that a grouping leaves out reads as ``whole``."""
    names = sorted({c for s in sets for c in s})
    out = scored.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*[F.sum(c).alias(c) for c in COUNTERS], *[F.grouping(c).alias(f"__{c}") for c in names])
    return out.select(*[F.when(F.col(f"__{c}") == 1, whole).otherwise(F.col(c)).alias(c) for c in names], *COUNTERS)


def rates(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Recall, precision, F1 and F2 of summed counters, 0 where undefined."""
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out, keep = counts, [c for c in counts.columns if c not in COUNTERS]
    show = [F.col("gold").alias("gold_spans"), F.col("predicted").alias("predicted_spans"), "sentences"]
    show.append(F.round(over(F.col("predicted").cast("double"), F.col("sentences")), 3).alias("spans_per_sentence"))
    show.append(F.round(over(F.col("gate_fired").cast("double"), F.col("sentences")), digits).alias("gate_fire_rate"))
    for kind in ("", "_typed", "_exact", "_exact_typed"):
        r, p = over(F.col(f"located{kind}").cast("double"), F.col("gold")), over(F.col(f"predicted_hit{kind}").cast("double"), F.col("predicted"))
        show += [F.round(r, digits).alias(f"span_recall{kind}"), F.round(p, digits).alias(f"span_precision{kind}"), F.round(over(2 * p * r, p + r), digits).alias(f"span_f1{kind}")]
        if not kind:
            show.append(F.round(over(5 * p * r, 4 * p + r), digits).alias("span_f2"))
    for kind in ("_iou50", "_iou50_typed"):
        show.append(F.round(over(F.col(f"located{kind}").cast("double"), F.col("gold")), digits).alias(f"span_recall{kind}"))
    return out.select(*keep, *show)


def macro(per_class: DataFrame, digits: int = 4) -> DataFrame:
    """Means of the rounded rates over the classes present."""
    return per_class.agg(F.round(F.avg("span_recall"), digits).alias("macro_span_recall"), F.round(F.avg("span_f1"), digits).alias("macro_span_f1"))


def sentence_confidence(joint: Column, location: Column, kind: Column, scalar: Column) -> Column:
    return F.coalesce(joint, location * kind, scalar, F.lit(1.0))


def sentence_label(spans: Column) -> Column:
    """Type of the most confident span, the first of equals; NONE without spans or for an unknown type."""
    conf = lambda s: s["confidence"]
    top = F.aggregate(spans, F.struct(F.lit(-1.0).alias("c"), F.lit("NONE").alias("t")), lambda a, s: F.when(conf(s) > a["c"], F.struct(conf(s).alias("c"), F.upper(s["type"]).alias("t"))).otherwise(a), lambda a: a["t"])
    return F.when(top.isin(*CLASSES), top).otherwise("NONE")


def confusion(df: DataFrame, truth: str, label: str, labels: list[str]) -> DataFrame:
    """Counts of labels by true class; every label is a column, every true class present a row."""
    return df.groupBy(truth).agg(*[F.count_if(F.col(label) == x).alias(f"as_{x}") for x in labels])


def class_scores(df: DataFrame, truth: str, label: str, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support by class, from one pass over the pairs of classes."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(label).alias("l")).count()
    rows = cells.groupBy(F.col("t").alias("class")).agg(F.sum("count").alias("support"), F.sum(F.when(F.col("t") == F.col("l"), F.col("count")).otherwise(0)).alias("tp"))
    cols = cells.groupBy(F.col("l").alias("class")).agg(F.sum("count").alias("n_pred"))
    out = rows.join(cols, "class", "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    p, r, f = prf(F.col("tp").cast("double"), F.col("n_pred"), F.col("support"))
    return out.select("class", zero(p).alias("precision"), zero(r).alias("recall"), zero(f).alias("f1"), F.col("support").cast("long"))


def baseline_floors(df: DataFrame, truth: str, digits: int = 4) -> DataFrame:
    """Accuracy of always saying the largest class, and of guessing by the shares."""
    n = df.groupBy(truth).count()
    total = n.agg(F.sum("count").cast("double").alias("total"), F.max("count").alias("most"), F.sum(F.col("count").cast("double") * F.col("count")).alias("squares"))
    return total.select(F.round(F.try_divide(F.col("most"), F.col("total")), digits).alias("majority_class_accuracy"), F.round(F.try_divide(F.col("squares"), F.col("total") * F.col("total")), digits).alias("prior_weighted_accuracy"))
