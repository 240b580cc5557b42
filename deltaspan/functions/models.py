"""Models outside the library: scorers, the roster of systems, and calls that are tried again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


class Scorer(Protocol):
    """Scores of a batch between 0 and 1: sources, translations and, where the model wants them, references."""

    def __call__(self, sources: list[str], translations: list[str], references: list[str] | None) -> list[float]: ...


def overlap_scorer() -> Scorer:
    """A stand-in that needs no weights: the share of characters that a translation has in common with what it is held against."""

    def score(sources: list[str], translations: list[str], references: list[str] | None) -> list[float]:
        return [len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0 for a, b in zip(references if references is not None else sources, translations, strict=True)]

    return score


def scored(df: DataFrame, target: str, make: Callable[[], Scorer], source: str, translation: str, reference: str | None = None, batch: int = 64) -> DataFrame:
    """Adds a scorer's output times 100, null without a translation. Each task makes the scorer once, in its first batch."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        scorer = make()
        for columns in batches:
            src, mt, *ref = [c.to_pylist() for c in columns]
            out: list[float | None] = [None] * len(mt)
            own = [i for i, t in enumerate(mt) if t is not None]
            for k in range(0, len(own), batch):
                part = own[k : k + batch]
                got = scorer([src[i] or "" for i in part], [mt[i] for i in part], [ref[0][i] or "" for i in part] if ref else None)
                for i, x in zip(part, got, strict=True):
                    out[i] = 100.0 * x
            yield pa.array(out, type=pa.float64())

    hinted: Callable[[Iterator[tuple[pa.Array, ...]]], Iterator[pa.Array]] = run
    return df.withColumn(target, F.arrow_udf(hinted, "double")(*[F.col(c) for c in (source, translation, reference) if c is not None]))


class TryAgain(Exception):
    """A call failed with a status."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


#: Statuses after which a call is tried again, and how often it is tried; fixed values.
AGAIN, TRIES = (429, 500, 502, 503), 5


def patient(call: Callable[..., T], sleep: Callable[[float], None] = time.sleep) -> Callable[..., T]:
    """The call, tried again after 1, 2, 4... seconds while its status is one of AGAIN."""

    def run(*args: object, **named: object) -> T:
        for turn in range(TRIES):
            try:
                return call(*args, **named)
            except TryAgain as e:
                if e.status not in AGAIN or turn == TRIES - 1:
                    raise
                sleep(2.0**turn)
        raise AssertionError

    return run


LOG = "call string, answer string, served string"


class Unanswered(RuntimeError):
    """Calls that failed; what was answered is in the log, and a rerun asks for the rest."""


def call_key(key: Column, question: Column) -> Column:
    """What a call is known by: the same prompt of the same row."""
    return F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("\x00"), question), 256)


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """The answers of a log, an empty one where there is none yet."""
    spark.createDataFrame([], LOG).write.mode("append").parquet(path)
    return spark.read.schema(LOG).parquet(path).dropDuplicates(["call"])


def seed_log(answers: DataFrame, key: str, question: str, answer: str, path: str, served: str | None = None) -> None:
    """Puts answers of an earlier run into a log, so that they are used again and not asked for; empty ones are left out."""
    own = answers.where(F.trim(F.coalesce(F.col(answer), F.lit(""))) != "").select(call_key(F.col(key), F.col(question)).alias("call"), F.col(answer).alias("answer"), (F.col(served) if served else F.lit(None).cast("string")).alias("served"))
    own.join(call_log(answers.sparkSession, path).select("call"), "call", "left_anti").write.mode("append").parquet(path)


def ask_once(df: DataFrame, key: str, question: str, target: str, make: Callable[[], Callable[[list[str]], list[tuple[str, str | None]]]], path: str, wave: int = 1000, in_flight: int = 4, batch: int = 16) -> DataFrame:
    """Adds a model's answers to prompts and what served them, each prompt of a row asked once whatever happens meanwhile.

    Answers are appended to a log, by calls: a rerun asks only for calls that it lacks. Prompts are asked in waves of about
    ``wave`` calls, each of which ends with its answers in the log, and by ``in_flight`` tasks, each with one call of up to
    ``batch`` prompts at a time. The call returns, for each prompt, its answer and the id that served it. When a call
    fails, its task asks nothing more in this wave but keeps the answers that it has, and no other wave is begun: the log
    has what was answered, and Unanswered is raised. If a task or the driver is lost, what is asked again is one wave at
    most. A null prompt isn't asked, and repeated rows are one call.
    """
    spark = df.sparkSession
    own = df.withColumn("__call", F.when(F.col(question).isNotNull(), call_key(F.col(key), F.col(question))))
    todo = own.where("__call is not null").select(F.col("__call").alias("call"), F.col(question).alias("prompt")).dropDuplicates(["call"])
    todo = todo.join(call_log(spark, path).select("call"), "call", "left_anti").persist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, failed = None, False
        for rows in batches:
            calls, prompts = rows["call"].to_pylist(), rows["prompt"].to_pylist()
            for k in range(0, len(calls), batch):
                if failed:
                    return
                try:
                    call = call or make()
                    got = call(prompts[k : k + batch])
                except Exception:
                    failed = True  # what is there already is handed on
                    continue
                if len(got) != len(prompts[k : k + batch]):
                    raise ValueError(f"{len(got)} answers to {len(prompts[k : k + batch])} prompts")
                yield pa.RecordBatch.from_pydict({"call": calls[k : k + batch], "answer": [a for a, _ in got], "served": pa.array([s for _, s in got], type=pa.string())})

    left = todo.count()
    waves = -(-left // wave)
    for w in range(waves):
        part = todo.where(F.pmod(F.xxhash64("call"), F.lit(waves)) == w)
        part.repartition(in_flight).mapInArrow(run, LOG).write.mode("append").parquet(path)
        missing = part.join(call_log(spark, path).select("call"), "call", "left_anti").count()
        if missing:
            todo.unpersist()
            raise Unanswered(f"{missing} calls of wave {w + 1} of {waves} failed")
    todo.unpersist()
    log = call_log(spark, path).select(F.col("call").alias("__call"), F.col("answer").alias(target), F.col("served").alias(f"{target}_served"))
    return own.join(log, "__call", "left").drop("__call")


def call_counts(df: DataFrame, by: str, answer: Column, served: Column) -> DataFrame:
    """How many answers a system gave, how many were empty, and the ids that served them."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim(answer), F.lit("")) == "").alias("n_empty"), F.array_sort(F.collect_set(served)).alias("served"))


#: Systems, their family where they belong to a ladder of sizes, billions of parameters where they are known, and whether
#: they are in the contrast of equal size. Fixed values.
ROSTER = (
    ("nllb-3.3b", None, 3.3, False), ("hunyuan-mt-7b", None, 7.0, True), ("gemmax2-9b", None, 9.0, True), ("aya-101", None, 13.0, False),
    ("aya-expanse-8b", None, 8.0, True), ("qwen3-0.6b", "qwen3", 0.6, False), ("qwen3-1.7b", "qwen3", 1.7, False), ("qwen3-4b", "qwen3", 4.0, False),
    ("qwen3-8b", "qwen3", 8.0, True), ("qwen3-14b", "qwen3", 14.0, False), ("qwen3-32b", "qwen3", 32.0, False), ("gemma3-4b", "gemma3", 4.0, False),
    ("gemma3-12b", "gemma3", 12.0, False), ("gemma3-27b", "gemma3", 27.0, False), ("gpt-4o", None, None, False), ("gemini", None, None, False),
    ("google-translate", None, None, False), ("deepseek", None, None, False),
)


def roster(spark: SparkSession) -> DataFrame:
    """system, ladder, params_b, matched_size, place: a dimension table."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROSTER)], "system string, ladder string, params_b double, matched_size boolean, place int")
