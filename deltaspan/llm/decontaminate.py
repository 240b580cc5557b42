"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A document is contaminated by an item if it holds at least 0.8 of the item's distinct five-word shingles, anywhere in
its whole text. An item's sketch is a bottom-k MinHash: the k least of its shingles' hashes, a random sample of them. How
many of these a long document holds, looked up among all of its own, estimates the containment whatever the document's
length. Items are partitioned by size, each class twice as large as the one before; a class has a number of hits m, a quarter of its least
size, that make a candidate, and k = n - ceil(0.8 n) + m for an item of n shingles. A contaminated document misses n - ceil(0.8 n) of
the item's shingles at most, so that it holds m of any k: no pair is missed, however short the item or scattered the
passage, and the more hits are asked for, the fewer others pass. A document with fewer shingles than 0.8 of an item's
isn't searched for it. Each candidate is verified by exact containment in the whole document.

Nulls: a null text or item has no shingles and matches nothing. An item of under five words has no five-word shingle
and is never found. Repeated documents and repeated items each give rows of their own; null ids are carried. Empty
tables give empty results. Only ids and texts are read; other columns, whatever their names, pass through ``remove`` and
are ignored by ``found``.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, spread_join
from .kernels import chunks, shingles

CONTAINMENT = 0.8
#: Items of up to this many shingles in all are sent to the tasks, 16 MB; larger tables are searched by joins.
INDEX_SHINGLES = 1 << 21
#: Bits of the filter that documents' shingles pass before such a join: 2 MB.
FILTER_BITS = 24

#: A class's hits that make a candidate, one at least, are its least size over this.
SHARE = 4


class Index:
    """Items in memory, and their sketches."""

    def __init__(self, items: list[np.ndarray]) -> None:
        self.items = items
        size = np.array([len(x) for x in items], dtype=np.int64)
        self.need = (4 * size + 4) // 5
        level = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        self.hits = np.maximum(1, (1 << level) // SHARE)
        sketch = [x[: n - need + m] for x, n, need, m in zip(items, size.tolist(), self.need.tolist(), self.hits.tolist(), strict=True)]
        value, owner = np.concatenate([np.zeros(0, dtype=np.uint64), *sketch]), np.repeat(np.arange(len(items)), [len(x) for x in sketch])
        order = np.argsort(value, kind="stable")
        self.value, self.owner = value[order], owner[order]
        self.mask = np.uint64((1 << int(np.clip(4 + len(value).bit_length(), 12, 24))) - 1)
        self.bitmap = np.zeros(int(self.mask) + 1, dtype=bool)
        self.bitmap[self.value & self.mask] = True

    def candidates(self, full: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (row, item) whose text holds as many shingles of the item's sketch as its class asks for, as one sorted array of pairs."""
        if not len(self.value):
            return np.zeros((0, 2), dtype=np.int64)
        count = np.diff(at)
        hit = np.flatnonzero(self.bitmap[full & self.mask])
        row = np.searchsorted(at, hit, side="right") - 1
        lo = np.searchsorted(self.value, full[hit], side="left")
        good = np.searchsorted(self.value, full[hit], side="right") > lo
        # a shingle that a text repeats counts once
        once = np.unique(row[good] * len(self.value) + lo[good])
        row, lo = once // len(self.value), once % len(self.value)
        n = np.searchsorted(self.value, self.value[lo], side="right") - lo
        item = self.owner[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        row = np.repeat(row, n)
        large = count[row] >= self.need[item]
        pair, held = np.unique(row[large] * len(self.items) + item[large], return_counts=True)
        pair = pair[held >= self.hits[pair % len(self.items)]]
        return np.stack([pair // len(self.items), pair % len(self.items)], axis=1)

    def matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and shared shingles of each verified match."""
        out: list[tuple[int, int, int]] = []
        for a, b in chunks(texts):
            full, at, _ = shingles(texts.slice(a, b - a), short=False)
            pairs = self.candidates(full, at)
            held, own = -1, np.zeros(0, dtype=np.uint64)
            for r, i in pairs.tolist():
                if r != held:
                    held, own = r, np.unique(full[at[r] : at[r + 1]])
                item = self.items[i]
                spot = np.minimum(np.searchsorted(own, item), len(own) - 1)
                shared = int((own[spot] == item).sum())
                if shared >= CONTAINMENT * len(item):
                    out.append((a + r, i, shared))
        got = np.array(out, dtype=np.int64).reshape(-1, 3)
        return got[:, 0], got[:, 1], got[:, 2]


def _own(text: Column) -> Column:
    """The distinct shingles of a text, in order."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for a, b in chunks(texts):
            full, at, _ = shingles(texts.slice(a, b - a), short=False)
            out += [np.unique(full[x:y]).view(np.int64) for x, y in zip(at[:-1], at[1:], strict=True)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *out])))

    return F.arrow_udf(run, "array<bigint>").asNondeterministic()(text)


def index(items: DataFrame) -> tuple[list[Any], Index] | None:
    """The items' ids and their index; None if they have more than INDEX_SHINGLES shingles."""
    own = items.select("item_id", "text")
    if (own.select(F.size(_own(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] or 0) > INDEX_SHINGLES:
        return None
    ids, held = [], []
    for r in own.toLocalIterator():
        full, _, _ = shingles(pa.array([r["text"]], type=pa.string()), short=False)
        if len(full):
            ids.append(r["item_id"])
            held.append(np.unique(full))
    return ids, Index(held)


def _matcher(spark: Any, index: Index) -> Any:
    # bounded by INDEX_SHINGLES; each task makes its own index of these, in its first batch
    sent = spark.sparkContext.broadcast((np.concatenate([np.zeros(0, dtype=np.uint64), *index.items]), np.cumsum([len(x) for x in index.items])[:-1]))
    made: list[Index] = []
    kind = pa.struct([("item", pa.int32()), ("shared", pa.int32())])

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Index(np.split(*sent.value)))
        row, item, shared = made[0].matches(texts)
        at = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(item.astype(np.int32)), pa.array(shared.astype(np.int32))], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(at), values)

    return F.arrow_udf(run, "array<struct<item:int,shared:int>>").asNondeterministic()


def _key(df: DataFrame, name: str) -> Column:
    """A number of a row's id and text; repeated rows share it."""
    return F.xxhash64(df[name], df["text"])


def _sets(items: DataFrame) -> DataFrame:
    """q, item_id and the shingles s of items that have any."""
    return cut(items.select(_key(items, "item_id").alias("q"), items["item_id"], _own(items["text"]).alias("s")).where("size(s) > 0"))


def _by_joins(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(r, q, n_shared) of verified matches, r and q the keys of documents and items.

    The same sketches and classes. A document's shingles that pass a filter of all sketches are joined with them and
    counted by document and item, and the whole text of a document that has the hits is verified.
    """
    n = F.size("s")
    need = F.floor((4 * n + 4) / 5).cast("int")
    hits = F.greatest(F.lit(1), F.floor(F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 1) / SHARE).cast("int"))
    one = sets.select("q", "s").dropDuplicates(["q"]).withColumn("need", need).withColumn("hits", hits)
    sketch = cut(one.select("q", "need", "hits", F.explode(F.slice("s", F.lit(1), n - F.col("need") + F.col("hits"))).alias("g")))
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def mark(batches):  # noqa: ANN001, ANN202
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[np.asarray(batch["g"]).view(np.uint64) & mask] = True
        yield pa.record_batch({"bits": pa.array([np.packbits(bits).tobytes()], type=pa.binary())})

    bits = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in sketch.select("g").mapInArrow(mark, "bits binary").toLocalIterator():  # one part at a time
        bits |= np.frombuffer(r["bits"], dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def passing(own: pa.Array) -> pa.Array:
        bits = np.unpackbits(np.frombuffer(sent.value, dtype=np.uint8)).astype(bool)
        flat = np.asarray(own.flatten())
        kept = bits[flat.view(np.uint64) & mask]
        count = np.concatenate([[0], np.cumsum(kept)])
        ends = np.concatenate([[0], np.cumsum(np.asarray(own.value_lengths()))])
        return pa.ListArray.from_arrays(pa.array(count[ends].astype(np.int32)), pa.array(flat[kept]))

    kept = F.arrow_udf(passing, "array<bigint>").asNondeterministic()
    keyed = docs.select(_key(docs, "doc_id").alias("r"), docs["text"])
    own = keyed.select("r", _own(F.col("text")).alias("own"))
    found_ = own.select("r", F.size("own").alias("d"), F.explode(kept(F.col("own"))).alias("g")).join(sketch, "g").where("d >= need")
    meets = cut(found_.groupBy("r", "q").agg(F.count("*").alias("n"), F.max("hits").alias("hits")).where("n >= hits").select("r", "q"))
    often = one.join(meets.groupBy("q").agg(F.count("*").alias("w")), "q")
    listed = spread_join(meets, often, ["q"], "w", meets.count()).groupBy("r").agg(F.collect_list(F.struct("q", "s")).alias("items"))

    def verify(texts: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, items.to_pylist(), strict=True):
            full, _, _ = shingles(pa.array([text.as_py()], type=pa.string()), short=False)
            shared = [(x["q"], int(np.isin(np.array(x["s"], dtype=np.int64).view(np.uint64), full).sum()), len(x["s"])) for x in own]
            out.append([{"q": q, "shared": n} for q, n, size in shared if n >= CONTAINMENT * size])
        return pa.array(out, type=pa.list_(pa.struct([("q", pa.int64()), ("shared", pa.int64())])))

    checked = F.arrow_udf(verify, "array<struct<q:bigint,shared:bigint>>").asNondeterministic()
    each = keyed.join(listed, "r").select("r", F.explode(checked(F.col("text"), F.col("items"))).alias("m"))
    return each.select("r", "m.q", F.col("m.shared").alias("n_shared")).distinct()


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, shared and item's distinct shingles, and the containment, for each contaminated pair."""
    spark, kind = docs.sparkSession, dict(items.dtypes)["item_id"]
    share = F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment")
    if (small := index(items)) is None:
        sets = _sets(items)
        hit = docs.select("doc_id", _key(docs, "doc_id").alias("r")).join(_by_joins(docs, sets), "r")
        return hit.join(sets.select("q", "item_id", F.size("s").cast("long").alias("n_item")), "q").select("doc_id", "item_id", "n_shared", "n_item", share)
    ids, own = small
    names = spark.createDataFrame([(k, i, len(x)) for k, (i, x) in enumerate(zip(ids, own.items, strict=True))], f"item int, item_id {kind}, n_item bigint")
    hit = docs.select("doc_id", F.explode(_matcher(spark, own)(docs["text"])).alias("m"))
    out = hit.select("doc_id", "m.item", F.col("m.shared").cast("long").alias("n_shared")).join(F.broadcast(names), "item")
    return out.select("doc_id", "item_id", "n_shared", "n_item", share)


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no item contaminates, all columns as they were."""
    name = fresh("clean")
    if (small := index(items)) is None:
        bad = _by_joins(docs, _sets(items)).select(F.col("r").alias(name)).distinct()
        return docs.withColumn(name, _key(docs, "doc_id")).join(bad, name, "left_anti").select(*[F.col(f"`{x}`") for x in docs.columns])
    clean: Column = F.size(_matcher(docs.sparkSession, small[1])(F.col("text"))) == 0
    return docs.withColumn(name, clean).where(name).drop(name)


#: The same by brute force: every shingle of every document against every item.
ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, r, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
iw AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT DISTINCT item_id, q, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT item_id, q, w, unnest(range(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 5)),
n AS (SELECT q, count(*) AS n_item FROM t GROUP BY q),
m AS (SELECT s.doc_id, s.r, t.item_id, t.q, count(*) AS n_shared FROM s JOIN t USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment FROM m JOIN n USING (q) WHERE n_shared >= 0.8 * n_item
"""
