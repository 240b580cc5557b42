"""Sinks: tab-separated tables, JSON lines, reports, manifests."""

from __future__ import annotations

import datetime
import hashlib
import json
import platform
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed
from .readers import METRICS, TEXTS


def table(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """A tab-separated table with a header, in one file in order; for reports, which are small."""
    out = df.orderBy(*order) if order else df
    out.coalesce(1).write.mode(mode).csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", lineSep="\n")


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def segment_cells(df: DataFrame) -> DataFrame:
    """Scores as text with two digits, differences from the unrounded values, whole numbers plain, blank for null."""
    cells = {}
    for m in METRICS:
        for side, value in (("noisy", F.col(f"{m}_noisy")), ("clean", F.col(f"{m}_clean")), ("d", F.col(f"{m}_clean") - F.col(f"{m}_noisy"))):
            plain = F.when(value.isNull(), "").otherwise(value.cast("long").cast("string"))
            cells[f"{m}_{side}"] = plain if m == "nta" else fixed(value)
    return df.select("uid", "category", *[c.alias(n) for n, c in cells.items()], *TEXTS)


def segments(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    table(segment_cells(df), path, mode=mode)


def quarantine(classified: DataFrame, path: str) -> None:
    """What an ingest keeps, has to be looked at, and blocks, each to its own folder."""
    from ..operators.validate import ingest_flags, kept_rows

    table(kept_rows(classified), f"{path}/kept")
    table(classified.where("verdict = 'rewritten'"), f"{path}/review")
    table(classified.where("verdict = 'BLOCK'"), f"{path}/blocked")
    table(ingest_flags(classified), f"{path}/flags")


def strata(contrasts: DataFrame, path: str) -> str:
    """Contrasts by table, metric and stratum: a tab-separated table under ``path`` and a text report beside it, whose text is returned.

    contrasts: table, metric, stratum, n, diff, ci_lo, ci_hi, p; a few rows for each table.
    """
    cells = [fixed(F.col(c)).alias(c) for c in ("diff", "ci_lo", "ci_hi")]
    table(contrasts.select("table", "metric", "stratum", "n", *cells, fixed(F.col("p"), 4).alias("p_boot")), path, ["table", "metric", "stratum"])
    lines, head = [], None
    for r in contrasts.orderBy("table", "metric", "stratum").toLocalIterator():
        if head != (head := (r["table"], r["metric"])):
            lines.append(" ".join(head))
        lines.append(f"  {r['stratum']}: n={r['n']} diff={r['diff']:.2f} [{r['ci_lo']:.2f}, {r['ci_hi']:.2f}] p={r['p']:.4f}")
    text = "\n".join([*lines, ""])
    Path(f"{path}.txt").write_text(text, encoding="utf-8")
    return text


def splice_report(checked: DataFrame, path: str) -> dict[str, int]:
    """All rows of a splice check, not only problems, by table and uid; how many there are of each status."""
    table(checked.select("table", "uid", "status", "detail"), path, ["table", "uid"])
    return {r["status"]: r["n"] for r in checked.groupBy("status").agg(F.count("*").alias("n")).collect()}


def markdown(df: DataFrame, title: str) -> str:
    """A report table. Reports are roll-ups, a row for each scope or system; their rows pass one partition at a time."""
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.toLocalIterator()]
    return "\n".join([*lines, ""])


def report(path: str, title: str, sections: Sequence[tuple[str, DataFrame]], notes: Sequence[str] = ()) -> str:
    """A report of several tables, written to a file; its text."""
    text = "\n".join([f"# {title}", "", *[f"{n}\n" for n in notes], *[markdown(df, heading) for heading, df in sections]])
    Path(path).write_text(text, encoding="utf-8")
    return text


def results_report(path: str, summary: DataFrame, table_name: str) -> str:
    """Scores of all systems: whole tables first, then a table for each category."""
    categories = [r["scope"] for r in summary.where("scope <> 'all'").select("scope").distinct().orderBy("scope").collect()]
    own = lambda s: summary.where(F.col("scope") == s).drop("scope")
    return report(path, f"Results of table {table_name}", [("all", own("all")), *[(c, own(c)) for c in categories]])


def analysis_report(path: str, contrasts: DataFrame, gap: DataFrame, regression: DataFrame) -> str:
    """Paired contrasts, the gap between tables, and the regression."""
    return report(path, "Analysis", [("Paired contrasts", contrasts), ("Contamination gap", gap), ("Regression", regression)])


def ladder_report(path: str, ladder: DataFrame, contrasts: DataFrame) -> str:
    """Tiers in order, and what each wins over the one before."""
    return report(path, "Tiers", [("Ladder", ladder), ("Contrasts", contrasts)])


def detection_report(path: str, detection: DataFrame, restoration: dict[str, DataFrame]) -> str:
    """Detection by scope, then the restoration of each tier."""
    return report(path, "Detection and restoration", [("Detection", detection), *[(f"Restoration, {tier}", df) for tier, df in restoration.items()]])


def normalised(df: DataFrame, columns: Sequence[str], path: str, log: DataFrame, log_path: str) -> None:
    """Normalised rows as plain lines between tabs, without quotes, and their log; neither may be there yet.

    A cell with a tab or a line break would change the columns, and is an error.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    sure = [F.when(c.rlike(r"[\t\r\n]"), F.raise_error(F.concat(F.lit(f"a tab or line break in {n}: "), c))).otherwise(c) for n, c in zip(columns, cells, strict=True)]
    head = df.sparkSession.createDataFrame([("\t".join(columns),)], "value string")
    head.unionAll(df.select(F.concat_ws("\t", *sure).alias("value"))).coalesce(1).write.mode("errorifexists").text(path)
    json_lines(log, log_path)


def _nested(part: Any) -> Any:
    """A table as a list of rows or, given as (table, column), by that column; other things as they are."""
    if isinstance(part, DataFrame):
        return [r.asDict(recursive=True) for r in part.toLocalIterator()]
    if isinstance(part, tuple) and isinstance(part[0], DataFrame):
        df, key = part
        return {str(r[key]): {k: v for k, v in r.asDict(recursive=True).items() if k != key} for r in df.orderBy(key).toLocalIterator()}
    if isinstance(part, dict):
        return {k: _nested(v) for k, v in part.items()}
    return part


def nested_json(path: str, parts: dict[str, Any]) -> dict[str, Any]:
    """A report as nested JSON, of tables that are roll-ups."""
    content = _nested(parts)
    Path(path).write_text(json.dumps(content, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return content


def detector_report(path: str, micro: DataFrame, per_class: DataFrame, macro: DataFrame, control: DataFrame | None = None, lift: DataFrame | None = None, **extra: Any) -> dict[str, Any]:
    """A detector's scores: pooled, by class, their means, and the chance level with the lift over it where that was drawn."""
    by = lambda df: None if df is None else (df, "category")
    return nested_json(path, {**extra, "micro": micro, "per_class": by(per_class), "macro": macro, "random_control": by(control), "lift_over_chance": by(lift)})


#: Pairs of near-duplicates that a report lists; it counts all.
REPORT_PAIRS = 20


def overlap_report(path: str, membership: DataFrame, pairs: DataFrame, vocabulary: DataFrame, by_category: DataFrame, **extra: Any) -> dict[str, Any]:
    """What a pool and a benchmark share: sentences by side and level, near-duplicates, vocabulary."""
    hits = {f"{r['bench_side']}~{r['pool_side']}~{r['level']}": r["n"] for r in membership.toLocalIterator()}
    near = {"count": pairs.count(), "pairs": pairs.orderBy(*pairs.columns).limit(REPORT_PAIRS)}
    return nested_json(path, {**extra, "sentence_level": {"hits": hits, "near_duplicates": near}, "span_vocabulary": {"pooled": vocabulary, "by_category": (by_category, by_category.columns[0])}})


def fingerprint(spark: SparkSession, path: str) -> dict[str, Any]:
    """Size, digest and line ends of a file."""
    r = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("sha256"), "content").first()
    return {"path": path, "bytes": r["length"], "sha256": r["sha256"], "lines": bytes(r["content"]).count(b"\n")}


def manifest(kind: str, data: dict[str, Any] | None = None, protocol: dict[str, Any] | None = None, **extra: Any) -> dict[str, Any]:
    """What was run on what; no value of the environment goes in."""
    from pyspark import __version__

    created = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    return {"kind": kind, "created": created, "protocol": protocol or {}, "env": {"python": platform.python_version(), "packages": {"pyspark": __version__}}, "data": data or {}, "extra": extra}


def write_manifest(path: str, content: dict[str, Any]) -> str:
    text = json.dumps(content, ensure_ascii=False, indent=2)
    Path(path).write_text(text, encoding="utf-8")
    return hashlib.sha256(text.encode()).hexdigest()
