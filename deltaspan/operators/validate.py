"""Checks that collect what is wrong as rows, and checks that raise."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.splice import CATEGORIES, replace_in_turn
from ..functions.text import added_characters, core, split_list, strip


class InvalidData(ValueError):
    pass


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise InvalidData(f"missing columns: {', '.join(missing)}")
    return df


def empty_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a required value that is null or blank, and which."""
    bad = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", c) for c in columns]))
    return df.withColumn("empty", bad).where(F.size("empty") > 0)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def outside(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*domain))


def require(df: DataFrame, key: str, required: list[str], domain_column: str, domain: list[str], show: int = 20) -> DataFrame:
    """The table itself, if it has rows, none of them lacks a required value, keys are unique and the domain holds."""
    problems = [f"row {r[key]}: empty {', '.join(r['empty'])}" for r in empty_values(df, required).select(key, "empty").limit(show).collect()]
    problems += [f"repeated {key} {r[0]}" for r in repeated_keys(df, key).limit(show).collect()]
    problems += [f"row {r[0]}: bad {domain_column} {r[1]!r}" for r in outside(df, domain_column, domain).select(key, domain_column).limit(show).collect()]
    if not problems and df.isEmpty():
        problems = ["no rows"]
    if problems:
        raise InvalidData("; ".join(problems[:show]))
    return df


def missing_keys(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    return expected.join(got.select(key), key, "left_anti")


def completeness(df: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Count of each cell of the grid of two dimension tables, zero where there is none."""
    keys = [*a.columns, *b.columns]
    have = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return a.crossJoin(b).join(have, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def differing(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], tolerance: float | None = None) -> DataFrame:
    """How many rows of two runs differ in each column; nulls are values, and a row that one run lacks differs."""
    mark = F.lit(1)
    both = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns], mark.alias("in_a")).join(b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns], mark.alias("in_b")), key, "full")

    def unequal(c: str) -> Column:
        if tolerance is None:
            return ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        return F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > tolerance, F.lit(False))

    return both.agg(F.count("*").alias("n"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("n_unaligned"), *[F.count_if(unequal(c)).alias(f"n_{c}") for c in columns])


#: Buckets of row hashes by which tables are compared.
BUCKETS = 4096


def _hashed(df: DataFrame) -> DataFrame:
    """Rows with two hashes, and a bucket by the first. Nulls and their columns count, values of arrays and structs as JSON."""
    nested = ("array", "struct", "map")
    cols = [F.to_json(F.struct(F.col(f"`{c}`"))) if t.startswith(nested) else F.col(f"`{c}`") for c, t in df.dtypes]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
    return df.withColumn("__h", F.xxhash64(nulls, *cols)).withColumn("__g", F.xxhash64(F.lit(1), *cols, nulls)).withColumn("__bucket", F.pmod("__h", F.lit(BUCKETS)))


def differing_buckets(a: DataFrame, b: DataFrame) -> list[int]:
    """Buckets in which two tables of the same columns don't have the same rows, repeats counted.

    The order-free sums of the rows' hashes, those of the second table taken off, are zero in a bucket that is the same.
    One pass over either table; what is shuffled are BUCKETS rows of sums from a task at most.
    """
    if [t for _, t in a.dtypes] != [t for _, t in b.select(*[f"`{c}`" for c in a.columns]).dtypes]:
        raise InvalidData("the tables' types differ")
    signed = None
    for df, sign in ((a, 1), (b.select(*[f"`{c}`" for c in a.columns]), -1)):
        h = _hashed(df)
        halves = [part.alias(f"{name}{k}") for name in ("__h", "__g") for k, part in enumerate((F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(name, 32)))]
        one = h.select("__bucket", F.lit(sign).alias("sign"), *halves)
        signed = one if signed is None else signed.unionByName(one)
    sums = signed.groupBy("__bucket").agg(F.sum("sign").alias("n"), *[F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("__h0", "__h1", "__g0", "__g1")])
    return sorted(r["__bucket"] for r in sums.where("n <> 0 or __h0 <> 0 or __h1 <> 0 or __g0 <> 0 or __g1 <> 0").collect())


def equal_tables(a: DataFrame, b: DataFrame) -> bool:
    """The same rows, repeats counted, by their hashes of 128 bits."""
    return not differing_buckets(a, b)


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (a or b) and the rows that the other table lacks, repeats counted. Only buckets that differ are compared row by row."""
    buckets = differing_buckets(a, b)
    columns = [F.col(f"`{c}`") for c in a.columns]

    def own(df: DataFrame) -> DataFrame:
        if not buckets:
            return df.select(*columns).limit(0)
        return _hashed(df.select(*columns)).where(F.col("__bucket").isin(buckets)).select(*columns)

    first, second = own(a), own(b)
    return first.exceptAll(second).select(F.lit("a").alias("side"), *columns).unionByName(second.exceptAll(first).select(F.lit("b").alias("side"), *columns))


# ---- ingest of sheets


#: Patterns of the ingest contract; fixed values.
PRIVATE = {"@user": r"@[\w一-鿿\-_]{2,}", "url": r"https?://\S+|www\.\S+", "phone": r"\b1[3-9]\d{9}\b"}


def private_hits(columns: list[str]) -> Column:
    """column:kind of each pattern found."""
    return F.array_compact(F.array(*[F.when(F.col(c).rlike("(?U)" + rx), f"{c}:{name}") for c in columns for name, rx in PRIVATE.items()]))


def classify_rows(df: DataFrame) -> DataFrame:
    """Adds spliced, verdict (ok, punct, rewritten or BLOCK) and note, by the first rule that holds."""
    spans, stds = split_list(F.col("noise_span")), split_list(F.col("noise_std"))
    df = df.withColumn("__spans", spans).withColumn("__stds", stds)
    absent = F.filter("__spans", lambda s: ~F.contains(F.col("src_noisy"), s))
    spliced = replace_in_turn(F.col("src_noisy"), F.col("__spans"), F.col("__stds"))
    a, b = core(F.col("__spl")), core(F.col("src_clean"))
    rules = [
        ((F.size("__spans") == 0) | (F.size("__stds") == 0), "BLOCK", F.lit("noise_span or noise_std empty")),
        (F.size("__spans") != F.size("__stds"), "BLOCK", F.format_string("span/std count mismatch (%d vs %d)", F.size("__spans"), F.size("__stds"))),
        (F.size(absent) > 0, "BLOCK", F.concat(F.lit("span not found: "), F.array_join(absent, ", "))),
        (~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "BLOCK", F.concat(F.lit("bad category "), F.coalesce("category", F.lit("")))),
        (F.col("__spl") == F.col("src_noisy"), "BLOCK", F.lit("NOSTD: the splice changes nothing")),
        (F.col("__spl") == F.col("src_clean"), "ok", F.lit("")),
        (F.col("__a") == F.col("__b"), "punct", F.lit("differs in marks, blanks or pictographs only")),
    ]
    verdict = note = None
    for test, name, why in rules:
        verdict = F.when(test, name) if verdict is None else verdict.when(test, name)
        note = F.when(test, why) if note is None else note.when(test, why)
    df = df.withColumn("__spl", spliced).withColumn("__a", a).withColumn("__b", b)
    added = added_characters(F.col("__b"), F.col("__a"))
    df = df.withColumn("verdict", verdict.otherwise("rewritten"))
    df = df.withColumn("note", note.otherwise(F.concat(F.lit("rewritten; new characters: "), F.when(added == "", "(none)").otherwise(added))))
    df = df.withColumn("spliced", F.when(F.col("verdict") == "BLOCK", "").otherwise(F.col("__spl")))
    return df.drop("__spans", "__stds", "__spl", "__a", "__b")


def ingest_flags(df: DataFrame, order: str = "row", low: int = 8, high: int = 60, max_golds: int = 4) -> DataFrame:
    """(row, flag) of kept rows: repeated uid or source with its first row, category against uid, length, many golds."""
    kept = df.where("verdict <> 'BLOCK'")
    first = [kept.groupBy(k).agg(F.min(order).alias(f"__{k}")) for k in ("uid", "src_noisy")]
    out = kept.join(first[0], "uid").join(first[1], "src_noisy")
    n = F.length("src_noisy")
    flags = F.array_compact(F.array(
        F.when(F.col(order) > F.col("__uid"), F.concat(F.lit("repeated uid, first at "), F.col("__uid").cast("string"))),
        F.when(F.col(order) > F.col("__src_noisy"), F.concat(F.lit("repeated src_noisy, first at "), F.col("__src_noisy").cast("string"))),
        F.when(F.substring("uid", 3, 3) != F.col("category"), "category differs from uid"),
        F.when((n < low) | (n > high), F.format_string("length %d", n)),
        F.when(F.size(split_list(F.col("noise_gold_en"))) > max_golds, "many golds"),
    ))
    return out.select(order, "uid", F.explode(flags).alias("flag"))


def kept_rows(df: DataFrame, keep_rewritten: bool = False) -> DataFrame:
    """Rows to be kept, with the spliced text as their clean side and no tabs or line breaks in any text."""
    ok = ["ok", "punct", "rewritten"] if keep_rewritten else ["ok", "punct"]
    out = df.where(F.col("verdict").isin(*ok)).withColumn("src_clean", F.col("spliced"))
    texts = [c for c, t in out.dtypes if t == "string"]
    return out.withColumns({c: F.regexp_replace(c, r"[\t\r\n]", " ") for c in texts})


def splice_status(df: DataFrame, spliced: str, error: str, expected: str) -> Column:
    from ..functions.text import nfkc

    same = nfkc(F.col(spliced)) == nfkc(F.col(expected))
    return F.when(F.col(error).isNotNull(), "splice_error").when(F.col(spliced) == F.col(expected), "ok").when(same, "nfkc_only").otherwise("mismatch")


# ---- predictions


def prediction_errors(lines: DataFrame, records: DataFrame, allow_extra: bool = False, coverage: bool = True, strict: bool = True) -> DataFrame:
    """(uid, error) of everything that is wrong with predictions; nothing is raised.

    lines: uid, src_noisy, spans (array of struct start, end, text, type, confidence, candidates), model_version,
    and pos, their order. strict adds what only the full contract asks: model version, confidence, overlaps.
    """
    known = lines.join(records.select("uid", F.col("src_noisy").alias("__src")), "uid", "left")
    first = lines.groupBy("uid").agg(F.min("pos").alias("__first"))
    known = known.join(first, "uid", "left")
    extra = known.where("__src is null")
    repeat = known.where("__src is not null and pos > __first")
    own = known.where("__src is not null and pos = __first")
    other = own.where("src_noisy is null or src_noisy <> __src" if strict else "src_noisy <> __src")
    good = own.where("src_noisy = __src" if strict else "src_noisy is null or src_noisy = __src")
    e = F.posexplode_outer("spans").alias("i", "s")
    each = good.select("uid", "__src", e).where("s is not null")
    tag = F.concat(F.lit("span "), F.col("i").cast("string"), F.lit(": "))
    fits = F.coalesce((F.col("s.start") >= 0) & (F.col("s.start") < F.col("s.end")) & (F.col("s.end") <= F.length("__src")), F.lit(False))
    cut = F.substr(F.col("__src"), F.col("s.start").cast("int") + 1, (F.col("s.end") - F.col("s.start")).cast("int"))
    tests = [F.when(~fits, "bad offsets"), F.when(fits & ~cut.eqNullSafe(F.col("s.text")), "text differs from the source"), F.when(fits & ~F.coalesce(F.col("s.type").isin(*CATEGORIES), F.lit(False)), "bad type")]
    if strict:
        tests += [F.when(fits & ~F.coalesce(F.col("s.confidence").between(0, 1), F.lit(False)), "bad confidence"), F.when(fits & F.exists(F.coalesce(F.col("s.candidates"), F.array()), lambda c: c.isNull() | (c == "")), "empty candidate")]
    found = [each.select("uid", F.explode(F.array_compact(F.array(*tests))).alias("e"), "i").select("uid", F.concat(tag, F.col("e")).alias("error"))]
    found.append(repeat.select("uid", F.lit("repeated uid").alias("error")))
    found.append(other.select("uid", F.lit("source differs").alias("error")))
    if not allow_extra:
        found.append(extra.select("uid", F.lit("unknown uid").alias("error")))
    if strict:
        a, b = (each.where(fits).select("uid", F.col("i").alias(f"{n}i"), F.col("s.start").alias(f"{n}0"), F.col("s.end").alias(f"{n}1")) for n in "ab")
        found.append(a.join(b, "uid").where("ai < bi and a0 < b1 and b0 < a1").select("uid", F.concat(F.lit("span "), F.col("bi").cast("string"), F.lit(": overlaps another")).alias("error")).distinct())
        found.append(good.where("model_version is null or model_version = ''").select("uid", F.lit("no model version").alias("error")))
    if coverage:
        found.append(records.select("uid").join(lines.select("uid"), "uid", "left_anti").select("uid", F.lit("no prediction").alias("error")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def valid_predictions(lines: DataFrame, records: DataFrame, show: int = 40) -> DataFrame:
    errors = prediction_errors(lines, records, coverage=False, strict=False).limit(show).collect()
    if errors:
        raise InvalidData("; ".join(f"{r['uid']}: {r['error']}" for r in errors))
    return lines


# ---- answers


#: Phrases and codes of the answer contract; fixed values.
META = (
    "Translation:|translation of the sentence|Note:|Resolving the noise|the sentence translates to|The sentence with noise resolved|"
    "Output only the translated result|resolving any such noise|is a pinyin initialism|is a homophone for|internet slang|"
    "more natural translation|Final translation|is an internet neologism"
)
CODES = r"\b(HOM|PYA|NEO|MIX)\b"


def contract_violation(answer: Column, source: Column, meta: str = META, codes: str = CODES) -> Column:
    """The first rule that an answer breaks, or null: empty, multiline, meta, code, echo_src."""
    text, src = strip(F.coalesce(answer, F.lit(""))), strip(F.coalesce(source, F.lit("")))
    return (
        F.when(text == "", "empty").when(text.contains("\n"), "multiline").when(answer.rlike(meta), "meta").when(answer.rlike("(?U)" + codes), "code")
        .when((src != "") & F.contains(answer, src), "echo_src")
    )


#: Forms in a block of a scan for leaks; an automaton takes some hundred bytes for each.
LEAK_FORMS = 100_000


def leaked(examples: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """How many rows hold each example form in any of the fields.

    One pass over the rows for each block of LEAK_FORMS forms, whatever their number: an automaton finds all forms of a
    text at once, and a task counts them before the shuffle. An empty form is in no row.
    """
    blocks = max(1, -(-examples.count() // LEAK_FORMS))
    counts = None
    for k in range(blocks):
        own = examples.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == k).where("form <> ''").select("form").distinct()
        forms = rows.sparkSession.sparkContext.broadcast([r["form"] for r in own.collect()])

        def run(batches: Iterator[pa.RecordBatch], forms: Any = forms) -> Iterator[pa.RecordBatch]:
            found: Counter[int] = Counter()
            if forms.value:
                machine = ahocorasick.Automaton()
                for i, form in enumerate(forms.value):
                    machine.add_word(form, i)
                machine.make_automaton()
                for batch in batches:
                    for texts in zip(*[batch[f].to_pylist() for f in fields], strict=True):
                        found.update({i for t in texts if t for _, i in machine.iter(t)})
            yield pa.record_batch({"form": pa.array([forms.value[i] for i in found], type=pa.string()), "n": pa.array(list(found.values()), type=pa.int64())})

        part = rows.select(*fields).mapInArrow(run, "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    return examples.join(counts, "form", "left").select("form", F.coalesce("n", F.lit(0)).alias("n"))


def served_mismatch(requested: Column, served: Column) -> Column:
    """The ids that were served and don't begin with the one asked for."""
    return F.filter(served, lambda s: ~F.startswith(s, requested))


def reuse_problems(spark: SparkSession, files: dict[str, str], want: int, fields: tuple[str, ...] = ("hyp_noisy", "hyp_clean"), versions: dict[str, dict[str, str]] | None = None) -> list[str]:
    """Why outputs of an earlier run mayn't be used again: a file that isn't there, of other length, with an empty first row, or of other versions.

    files: a name and a path of JSON lines each; want: the rows that each must have. versions: by name, the values that
    the manifest beside the file (path with .manifest.json for .jsonl) must have under ``protocol``.
    """
    from pyspark.errors import AnalysisException

    out = []
    for name, path in files.items():
        try:
            rows = spark.read.schema(", ".join(f"{f} string" for f in fields)).json(path)
            n = rows.count()
        except AnalysisException:
            out.append(f"{name}: missing")
            continue
        if n != want:
            out.append(f"{name}: {n} rows, not {want}")
        elif (first := rows.first()) is None or not all(first[f] for f in fields):
            out.append(f"{name}: empty fields in the first row")
        for key, value in (versions or {}).get(name, {}).items():
            try:
                said = spark.read.option("multiLine", True).json(path.removesuffix(".jsonl") + ".manifest.json").select(f"protocol.{key}").first()[0]
            except AnalysisException:
                said = None
            if said != value:
                out.append(f"{name}: {key} is {said}, not {value}")
    return out
