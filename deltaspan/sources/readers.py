"""Readers with fixed schemas. Nothing is inferred; text files of records keep their order in pos."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.splice import CATEGORIES
from ..functions.text import nfkc, split_list, strip
from ..operators.validate import InvalidData, require, require_columns

REQUIRED = ["uid", "table", "category", "src_noisy", "src_clean", "ref_en", "noise_span", "noise_gold_en"]
SHEET = [*REQUIRED, "noise_std", "source_meta"]
METRICS = ["xcomet", "kiwi", "nta"]
TEXTS = ["src_noisy", "hyp_noisy", "src_clean", "hyp_clean", "ref_en"]

SPAN = "struct<start:int,end:int,text:string,type:string,confidence:double,location_confidence:double,type_confidence:double,joint_confidence:double,candidates:array<string>>"
PREDICTION = f"uid string, src_noisy string, category string, spans array<{SPAN}>, model_version string, noise_present boolean"
OUTPUT = "uid string, `table` string, category string, src_noisy string, src_clean string, ref_en string, noise_span array<string>, gold_en array<string>, hyp_noisy string, hyp_clean string"
SUMMARY = "model string, scope string, n long, n_nta long, " + ", ".join(f"{m}_{k} double" for m in METRICS for k in ("noisy", "clean", "delta", "delta_lo", "delta_hi")) + ", rel_delta double"
NORM_LOG = "uid string, tier string, parse_ok boolean, src_noisy string, src_norm string, llm_raw string, error string, spans array<struct<text:string,type:string,std:string>>, dropped_spans array<struct<text:string,type:string,std:string>>"
POOL = "uid string, src_noisy string, src_clean string, category string, noise_span string, noise_std string, branch string, base_id string, relaxed boolean"


def delimited(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A tab-separated file with a header, quoted fields and line breaks in them; all columns as text, blanks as ''."""
    df = spark.read.csv(path, sep="\t", header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    df = df.withColumn("pos", F.monotonically_increasing_id())
    return df.fillna("", subset=[c for c in df.columns if c != "pos"])


def contrastive(spark: SparkSession, path: str | list[str], check: bool = True) -> DataFrame:
    """Contrastive records: columns checked, texts trimmed, codes in upper case, lists split."""
    df = require_columns(delimited(spark, path), REQUIRED)
    for extra in ("noise_std", "source_meta"):
        if extra not in df.columns:
            df = df.withColumn(extra, F.lit(""))
    df = df.withColumns({c: strip(F.col(f"`{c}`")) for c in SHEET})
    df = df.withColumns({"category": F.upper("category"), "table": F.upper("table"), "noise_std_list": split_list(F.col("noise_std"))})
    df = df.withColumns({"noise_span": split_list(F.col("noise_span")), "gold_en": split_list(F.col("noise_gold_en"))}).drop("noise_gold_en")
    return require(df, "uid", ["uid", "src_noisy", "src_clean", "ref_en"], "category", list(CATEGORIES)) if check else df


def segments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scores by segment; a blank number is null, a missing text ''."""
    df = delimited(spark, path)
    numbers = [f"{m}_{s}" for m in METRICS for s in ("noisy", "clean", "d")]
    own = {c: (F.when(strip(F.col(c)) != "", F.col(c)).cast("double") if c in df.columns else F.lit(None).cast("double")) for c in numbers}
    own |= {c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in TEXTS}
    return df.withColumns(own)


def by_model(spark: SparkSession, directory: str) -> DataFrame:
    """All segments_*.tsv of a directory, with the model from the name of the file."""
    df = segments(spark, f"{directory}/segments_*.tsv")
    return df.withColumn("model", F.regexp_extract(F.input_file_name(), r"segments_(.*)\.tsv$", 1))


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path).withColumn("pos", F.monotonically_increasing_id())


def outputs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return json_lines(spark, path, OUTPUT).withColumn("model", F.regexp_extract(F.input_file_name(), r"([^/]*)\.jsonl$", 1))


def summaries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Summary rows; of several for a model and scope the last counts."""
    from ..operators.pairs import last_wins

    return last_wins(json_lines(spark, path, SUMMARY), ["model", "scope"], "pos").drop("pos")


def predictions(spark: SparkSession, path: str | list[str], least: float | None = None) -> DataFrame:
    from ..functions.splice import keep_confident

    df = json_lines(spark, path, PREDICTION)
    return df if least is None else df.withColumn("spans", keep_confident(F.col("spans"), least))


def valid_predictions(spark: SparkSession, path: str | list[str], records: DataFrame, least: float | None = None) -> DataFrame:
    """Predictions filled up and held against the records that they are of; anything wrong with them is an error that names it.

    A span's type may stand in a field category, in any case; its text is by default what its place holds, its confidence
    one. noise_present is by default whether there are spans. A record without a prediction is no error.
    """
    from ..functions.splice import keep_confident
    from ..operators.validate import valid_predictions as check

    kinds = [x.split(":", 1) for x in SPAN[len("struct<") : -1].split(",")]
    given = PREDICTION.replace(SPAN, SPAN[:-1] + ",category:string>")
    lines = json_lines(spark, path, given).join(records.select("uid", F.col("src_noisy").alias("__src")), "uid", "left")

    def whole(s: Column) -> Column:
        fields = {name: s[name] for name, _ in kinds}
        fields["text"] = F.coalesce(s["text"], F.substr(F.col("__src"), s["start"] + 1, s["end"] - s["start"]))
        fields["type"] = F.upper(F.coalesce(F.when(s["type"] != "", s["type"]), s["category"], F.lit("")))
        fields["confidence"] = F.coalesce(s["confidence"], F.lit(1.0))
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    lines = lines.withColumn("spans", F.transform(F.coalesce("spans", F.array()), whole)).drop("__src")
    lines = check(lines.withColumn("noise_present", F.coalesce("noise_present", F.size("spans") > 0)), records)
    return lines if least is None else lines.withColumn("spans", keep_confident(F.col("spans"), least))


def norm_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return json_lines(spark, path, NORM_LOG)


def pool(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return json_lines(spark, path, POOL)


def pool_spans(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The distinct span forms of a pool, normalised."""
    return pool(spark, path).select(F.explode(split_list(F.col("noise_span"))).alias("s")).select(nfkc(F.col("s")).alias("word")).distinct()


def pool_and_benchmark(spark: SparkSession, pool_path: str | list[str], benchmark_paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """A pool, and the union of several benchmark tables, whatever columns each has besides; file is where a row is from, pos its place there."""
    bench = None
    for path in benchmark_paths:
        own = contrastive(spark, path, check=False).withColumn("file", F.lit(path))
        bench = own if bench is None else bench.unionByName(own, allowMissingColumns=True)
    if bench is None:
        raise InvalidData("no benchmark tables")
    return pool(spark, pool_path), bench


def clean_side(outputs_: DataFrame, records: DataFrame) -> DataFrame:
    """uid and hyp_clean for every record; a missing or blank one is an error."""
    got = records.select("uid").join(outputs_.select("uid", "hyp_clean"), "uid", "left")
    bad = got.where(F.trim(F.coalesce("hyp_clean", F.lit(""))) == "").limit(3).collect()
    if bad:
        raise InvalidData("no clean side for " + ", ".join(r["uid"] for r in bad))
    return got


def tiers(files: dict[str, DataFrame], base: DataFrame) -> DataFrame:
    """Long scores by tier: a0 and a4 are the two sides of the base file, a1 to a3 the noisy side of their own."""
    if {"a0", "a4"} & files.keys():
        raise InvalidData("a0 and a4 come from the base file")

    def side(df: DataFrame, name: str, which: str) -> DataFrame:
        return df.select(F.lit(name).alias("tier"), "uid", "category", *[F.col(f"{m}_{which}").alias(m) for m in METRICS])

    out = side(base, "a0", "noisy").unionByName(side(base, "a4", "clean"))
    for name, df in files.items():
        out = out.unionByName(side(df, name, "noisy"))
    return out


def arms(spark: SparkSession, directory: str, stems: dict[str, str], exists: Callable[[str], bool]) -> DataFrame | None:
    """Segments of the arms whose files are there, with their labels."""
    out = None
    for label, stem in stems.items():
        if exists(path := f"{directory}/segments_{stem}.tsv"):
            df = segments(spark, path).withColumn("arm", F.lit(label))
            out = df if out is None else out.unionByName(df)
    return out


def gold_spans(records: DataFrame) -> DataFrame:
    """Gold sentences: spans as array of struct(text, category, std, occ), with every place where a span occurs."""
    from ..functions.splice import occurrences

    each = records.select("uid", "table", "src_noisy", "category", "noise_span", F.posexplode("noise_span").alias("i", "span"), F.split("noise_std", "‖").alias("stds"))
    starts = occurrences(F.col("src_noisy"), F.col("span"))
    occ = F.transform(starts, lambda a: F.struct(a.cast("int").alias("start"), (a + F.length("span")).cast("int").alias("end")))
    each = each.withColumn("occ", occ).withColumn("std", F.get("stds", F.col("i")))
    lost = each.where(F.size("occ") == 0).limit(5).collect()
    if lost:
        raise InvalidData("spans not found: " + ", ".join(f"{r['uid']} {r['span']}" for r in lost))
    span = F.struct("i", F.col("span").alias("text"), "category", "std", "occ")
    out = each.groupBy("uid", "table", "category", "src_noisy").agg(F.array_sort(F.collect_list(span)).alias("s"))
    return out.select("uid", "table", "category", F.col("src_noisy").alias("text"), F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["category"].alias("category"), x["std"].alias("std"), x["occ"].alias("occ"))).alias("gold_spans"))


def synthetic_segments(spark: SparkSession, systems: int, items: int, seed: int = 1) -> DataFrame:
    """Scores and texts for tests: uniform by a hash, with an offset for each system.

    The clean source differs from the noisy one in one word, and more of it in each category than in the one before, so
    that edit distances have a spread; whether a term was met falls with the noisy score.
    """
    u = lambda *k: F.pmod(F.xxhash64("system", "uid", *[F.lit(x) for x in (seed, *k)]), F.lit(1_000_000)) / 1e6
    df = spark.range(systems).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("system"), F.col("id").alias("k")).crossJoin(spark.range(items).select(F.col("id").alias("uid")))
    clean, place = 70 + 30 * u("c"), (F.col("uid") % len(CATEGORIES)).cast("int")
    df = df.withColumns({"category": F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), place + 1), "xcomet_clean": clean, "xcomet_noisy": clean - F.col("k") - 10 * u("n")})
    df = df.withColumns({"kiwi_clean": F.col("xcomet_clean") - 5 * u("kc"), "kiwi_noisy": F.col("xcomet_noisy") - 5 * u("kn"), "nta_clean": F.lit(1.0), "nta_noisy": (F.col("xcomet_noisy") > 80).cast("double")})
    df = df.withColumns({f"{m}_d": F.col(f"{m}_clean") - F.col(f"{m}_noisy") for m in METRICS})
    word = lambda *k: F.concat(F.lit("w"), F.pmod(F.xxhash64("uid", *[F.lit(x) for x in (seed, *k)]), F.lit(1000)).cast("string"))
    rest = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("uid") % 7 + 3).cast("int")), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("uid"), i), F.lit(1000)).cast("string"))), " ")
    df = df.withColumns({"src_clean": F.concat(word("a"), F.lit(" "), rest), "src_noisy": F.concat(F.repeat(F.lit("x"), place + 1), word("b"), F.lit(" "), rest)})
    return df.withColumns({"hyp_clean": F.concat(F.lit("[en] "), "src_clean"), "hyp_noisy": F.concat(F.lit("[en] "), "src_noisy"), "ref_en": F.concat(F.lit("[ref] "), "src_clean")}).drop("k")


# ---- spreadsheets


def _sheet_rows(path: str) -> Iterator[tuple[int, list[str]]]:
    """Numbered rows of the first sheet of a workbook, by the standard library."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{ns}t")))
        first = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        for row in ElementTree.fromstring(z.read(first)).iter(f"{ns}row"):
            cells: list[str] = []
            for c in row.iter(f"{ns}c"):
                ref = "".join(x for x in c.get("r", "") if x.isalpha())
                at = 0
                for x in ref:
                    at = at * 26 + ord(x) - 64
                cells += [""] * (at - len(cells))
                value = c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text else text
            yield int(row.get("r", "0")), [x.strip() for x in cells]


class SheetSource(DataSource):
    """spark.read.format("sheet").option("path", ...): the ten columns and the row of the sheet; empty rows are left out."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> StructType:
        return StructType([*[StructField(c, StringType()) for c in SHEET], StructField("row", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.options["path"])


class SheetReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, partition: object) -> Iterator[tuple]:
        rows = _sheet_rows(self.path)
        _, header = next(rows)
        if header != SHEET:
            raise InvalidData(f"header is {header}")
        for k, cells in rows:
            own = (cells + [""] * len(SHEET))[: len(SHEET)]
            if any(own):
                yield (*own, str(k))


def sheet(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SheetSource)
    return spark.read.format("sheet").option("path", path).load().withColumn("row", F.col("row").cast("int"))
