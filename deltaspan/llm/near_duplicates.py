"""Near-duplicates by BagMinHash: banded weighted-Jaccard signatures, then exact multiset overlap of shingles.

Two texts are linked if their multisets of five-word shingles overlap by 0.8 or more (sum of minima by sum of maxima
of the counts); classes are the connected components of links. Equal sequences of words are one text, and are merged
by key before anything is compared. 32 bands of 7 registers bring a pair of similarity 0.8 together with 0.9995.

Texts that share a band form candidate clusters; inside a cluster links are checked exactly, so that none between its
members is lost, whichever bands they share. A cluster of over CLUSTER texts or PART_WORDS words is dealt to groups of
about that size: each with eight common pivots first; then the texts that are outside its largest part against all, in
blocks. A group holds its shingles once as they came and once sorted, and counts what they share in blocks of MATCHES.

Nulls and texts without words: a null or empty text is in a class of its own; a text of marks only equals the same
marks; one to four words make one shingle. Repeated rows share a class. A row without doc_id takes a number made from
its text, which is its class's number only if no member has an id. Ties of the least id keep any one of the equal rows.
Only doc_id and text are read; other columns, whatever their names, pass through ``keep_one`` and are ignored by
``assign``. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, fresh, spread_join
from .kernels import chunks, mix, multisets, poisson_signatures, seeded, sequence_keys, shingles

BANDS, ROWS = 32, 7
CLUSTER = 200
PART_WORDS = 1 << 20
PIVOTS = 8
MATCHES = 1 << 20
#: Up to so many clusters that are dealt to several groups are broadcast (about 100 bytes each); beyond it they are joined.
BROADCAST_CLUSTERS = 100_000

_KEYS = "struct<k1:bigint,k2:bigint,words:int,bands:array<bigint>>"
_LINK = "a bigint, a2 bigint, b bigint, parts int"
_SHINGLED = "struct<k1:bigint,k2:bigint,full:binary>"


def _keys(texts: pa.Array, w: object) -> np.ndarray:
    """128-bit keys of word sequences, of the bytes where there are no words, and zeros for an empty text."""
    keys = sequence_keys(w)
    for i in np.flatnonzero(np.diff(w.at) == 0):
        if text := texts[int(i)].as_py():
            keys[i] = np.frombuffer(hashlib.blake2b(text.encode(), digest_size=16).digest(), dtype=np.uint64)
    return keys


def _signed(texts: pa.Array) -> pa.Array:
    k1, k2, n, bands = [], [], [], []
    for a, b in chunks(texts):
        part = texts.slice(a, b - a)
        full, at, w = shingles(part)
        keys = _keys(part, w)
        _, first, same = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        value, weight, off = multisets(full, at)
        # the signatures of distinct texts only
        size = np.diff(off)[first]
        take = np.repeat(off[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        sig = poisson_signatures(value[take], weight[take], np.concatenate([[0], np.cumsum(size)]), BANDS * ROWS)
        band = np.zeros((len(first), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            band = mix(band + sig[:, r::ROWS])
        band = mix(band ^ np.array([seeded(1000 + k) for k in range(BANDS)], dtype=np.uint64))
        k1.append(keys[:, 0])
        k2.append(keys[:, 1])
        n.append(np.diff(w.at))
        bands.append(band[same.reshape(-1)])
    long = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, dtype=np.int64))
    flat = long([x.reshape(-1) for x in bands])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), flat)
    return pa.StructArray.from_arrays([long(k1), long(k2), pa.array(np.concatenate(n).astype(np.int32) if n else np.zeros(0, dtype=np.int32)), lists], names=["k1", "k2", "words", "bands"])


def _shingled(texts: pa.Array) -> pa.Array:
    k1, k2, full_out = [], [], []
    for a, b in chunks(texts):
        part = texts.slice(a, b - a)
        full, at, w = shingles(part)
        keys = _keys(part, w)
        value, weight, off = multisets(full, at)
        # the second, third... of equal shingles become values of their own: sets that overlap as the multisets do
        n = np.repeat(np.arange(len(value)), weight)
        turn = np.arange(len(n)) - np.repeat(np.cumsum(weight) - weight, weight)
        flat = mix(value[n] + turn.astype(np.uint64) * seeded(5))
        ends = np.concatenate([[0], np.cumsum(weight)])[off]
        k1.append(keys[:, 0])
        k2.append(keys[:, 1])
        full_out += [flat[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
    long = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, dtype=np.int64))
    return pa.StructArray.from_arrays([long(k1), long(k2), pa.array(full_out, type=pa.binary())], names=["k1", "k2", "full"])


def linked(flat: np.ndarray, at: np.ndarray, query: np.ndarray | None = None) -> np.ndarray:
    """Roots of the components of sets that overlap by 0.8, by exact counts from an inverted index.

    The sets are the parts of ``flat`` between offsets. ``query``: only pairs with one of these. A member of the growing
    part around member 0 needs no comparison of its own: every pair across parts has a member outside, which is
    compared with all.
    """
    n = len(at) - 1
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    size = np.diff(at)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(n, dtype=np.int32), size)[order]
    value = flat[order]
    del order
    # a set has a value once, so that a block of a text's values has at most MATCHES matches, or those of one value
    width = max(1, MATCHES // max(1, n))
    for i in range(n) if query is None else query.tolist():
        if query is None and i and find(i) == find(0):
            continue
        shared = np.zeros(n, dtype=np.int64)
        for a in range(at[i], at[i + 1], width):
            own = flat[a : min(a + width, at[i + 1])]
            lo = np.searchsorted(value, own, side="left")
            k = np.searchsorted(value, own, side="right") - lo
            shared += np.bincount(owner[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())], minlength=n)
        for j in np.flatnonzero((5 * shared >= 4 * (size + size[i] - shared)) & (size > 0)).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], dtype=np.int64)


def _group(table: pa.Table, query_column: bool) -> pa.Table:
    k1 = np.asarray(table["k1"]).astype(np.int64)
    k2 = np.asarray(table["k2"]).astype(np.int64)
    role = np.asarray(table["role"])
    parts = np.asarray(table["parts"]).astype(np.int32)
    # a text may come twice, as a pivot and on its own, or from repeated rows
    order = np.lexsort((-role, k2, k1)) if query_column else np.lexsort((k2, k1, -role))
    seen: dict[tuple[int, int], int] = {}
    for i in order.tolist():
        seen.setdefault((int(k1[i]), int(k2[i])), i)
    row = np.array(list(seen.values()), dtype=np.int64)
    full = table["full"].combine_chunks().take(pa.array(row)).cast(pa.large_binary())
    del table
    off = np.frombuffer(full.buffers()[1], dtype=np.int64)[full.offset : full.offset + len(full) + 1] // 8
    flat = np.frombuffer(full.buffers()[2] or b"", dtype=np.uint64)[off[0] : off[-1]]
    root = linked(flat, off - off[0], np.flatnonzero(role[row] > 0) if query_column else None)
    return pa.table({"a": k1[row], "a2": k2[row], "b": k1[row[root]], "parts": parts[row]})


def band_links(nodes: DataFrame, total: int) -> DataFrame:
    """(a, b): each distinct text that shares a band with another, and the least of that band; ``total``: the texts' number.

    A band of very many texts is broadcast with its least one, so that its texts stay where they are.
    """
    bands = nodes.where("words > 0").select("k1", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.count("*").alias("weight")).where("low < high").drop("high")
    links = spread_join(bands, cut(shared.coalesce(max(8, total // 1_000_000))), ["band"], "weight", total * BANDS)
    return links.where("k1 <> low").select(F.col("k1").alias("a"), F.col("low").alias("b"))


def clusters(nodes: DataFrame, total: int) -> DataFrame:
    """(node, root) for distinct texts that share a band with another, directly or through others."""
    return components(band_links(nodes, total).distinct())


def row_key(docs: DataFrame) -> Column:
    """A number of a row's id and text; repeated rows share it."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def once(docs: DataFrame, key: str) -> DataFrame:
    """One row of each key. Spark keeps one of each in a task before it deals them, so that a key may have any number."""
    turn = fresh("n")
    return docs.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).where(F.col(turn) == 1).drop(turn)


class Classes:
    """rows: r, d, doc_id, k1, k2 of each row; nodes: the distinct texts; link: (k1, k2, root) of those in a class with others.

    d is a row's number, r the key of its id and text; ``twice``, whether rows have the same. An empty text has k1 = 0
    and its row's number as k2.
    """

    def __init__(self, docs: DataFrame) -> None:
        spark = docs.sparkSession
        d = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))
        signed = F.arrow_udf(_signed, _KEYS).asNondeterministic()
        rows = docs.select(docs["doc_id"], d.alias("d"), row_key(docs).alias("r"), signed(docs["text"]).alias("s")).select("doc_id", "d", "r", "s.*")
        empty = (F.col("k1") == 0) & (F.col("k2") == 0)
        self.rows = cut(rows.withColumn("k2", F.when(empty, F.col("d")).otherwise(F.col("k2"))))
        self.total = self.rows.count()
        self.twice = not self.rows.groupBy("r").count().where("count > 1").isEmpty()
        one = [F.min("d").alias("d"), F.min_by("r", "d").alias("r"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")]
        self.nodes = self.rows.groupBy("k1", "k2", "words", "bands").agg(*one)
        cluster = clusters(self.nodes, self.total)
        if cluster.isEmpty():
            self.link = spark.createDataFrame([], "k1 bigint, k2 bigint, root bigint")
        else:
            self.link = self._links(docs, cluster)

    def _links(self, docs: DataFrame, cluster: DataFrame) -> DataFrame:
        flip = [int(x) for x in mix(np.arange(1, PIVOTS + 1, dtype=np.uint64)).view(np.int64)]
        member = cluster.select(F.col("node").alias("k1"), F.col("root").alias("c")).join(self.nodes.select("k1", "r", "words"), "k1")
        pivots = [F.min(F.col("k1").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)) for x in flip]
        parts = F.ceil(F.greatest(F.count("*") / CLUSTER, F.sum(F.col("words").cast("long")) / PART_WORDS)).cast("int")
        sizes = member.groupBy("c").agg(parts.alias("parts"), F.array(*pivots).alias("pivots"))
        # only the clusters of several parts are in this table, so that the others need no join
        large = self._cut(sizes.where("parts > 1"))
        n_large = large.count()
        with_large = F.broadcast(large) if n_large <= BROADCAST_CLUSTERS else large
        parts = F.coalesce("parts", F.lit(1))
        chosen = member.join(with_large, "c", "left").select(
            F.col("k1").alias("want"), "c", "r", parts.alias("parts"), F.pmod(F.xxhash64("k1"), parts).cast("int").alias("part"),
            F.coalesce(F.array_contains("pivots", F.col("k1")), F.lit(False)).alias("pivot"),
        )
        # one row's text for each distinct text of a cluster; its key is worked out anew, as numbers of rows may meet
        text = docs.select(row_key(docs).alias("r"), docs["text"].alias("t"))
        text = (once(text, "r") if self.twice else text).join(chosen, "r")
        shingled = F.arrow_udf(_shingled, _SHINGLED).asNondeterministic()
        full = text.select("want", "c", "parts", "part", "pivot", shingled(F.col("t")).alias("s")).select("*", "s.*").where("k1 = want").drop("s", "want")
        if n_large:
            full = full.persist(StorageLevel.DISK_ONLY)
        place = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
        dealt = full.select("c", F.explode(place).alias("part"), "parts", F.col("pivot").cast("int").alias("role"), "k1", "k2", "full")

        def resolve(group: pa.Table) -> pa.Table:
            return _group(group, False)

        link = dealt.groupBy("c", "part").applyInArrow(resolve, _LINK).persist()
        keyed = [F.col("a").alias("k1"), F.col("a2").alias("k2")]
        settled = link.where("parts = 1").select(*keyed, F.col("b").alias("root"))
        if not n_large:
            settled = self._cut(settled)
            link.unpersist()
            return settled
        open_ = link.where("parts > 1")
        root = components(open_.select("a", "b"))
        # of the large clusters, what is outside the largest part, against all of the cluster
        of = full.where("parts > 1").join(root.select(F.col("node").alias("k1"), "root"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
        count = of.groupBy("c", "root").agg(F.count("*").alias("n"), F.sum(F.octet_length("full")).alias("bytes")).groupBy("c").agg(
            F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("n"),
            (F.sum("bytes") - F.max_by("bytes", F.struct("n", "root"))).alias("bytes"))
        blocks = F.ceil(F.greatest(F.col("n") / CLUSTER, F.col("bytes") / (8 * PART_WORDS)))
        count = count.where("n > 0").select("c", "main", blocks.cast("int").alias("blocks"))
        of = of.join(F.broadcast(count) if n_large <= BROADCAST_CLUSTERS else count, "c")
        asked = of.where("root <> main").select("c", F.pmod(F.xxhash64("k1", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.lit(1).alias("role"), "k1", "k2", "full")
        against = of.select("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "parts", F.lit(0).alias("role"), "k1", "k2", "full")

        def compare(group: pa.Table) -> pa.Table:
            return _group(group, True)

        more = asked.unionByName(against).groupBy("c", "block", "part").applyInArrow(compare, _LINK).where("a <> b").select("a", "b")
        # new links join whole parts: only their roots meet again
        to = [root.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
        joined = more.join(to[0], "a", "left").join(to[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
        last = components(joined)
        names = open_.select(*keyed).distinct().join(root.select(F.col("node").alias("k1"), "root"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
        # every root with where it goes now; one of very many texts is broadcast
        to = names.groupBy("root").agg(F.count("*").alias("weight")).join(last.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").withColumn("to", F.coalesce("to", "root"))
        names = spread_join(names, self._cut(to), ["root"], "weight", self.total)
        settled = self._cut(settled.unionByName(names.select("k1", "k2", F.col("to").alias("root"))))
        link.unpersist()
        full.unpersist()
        return settled

    def _cut(self, df: DataFrame) -> DataFrame:
        """A checkpoint of at most a row for each document, in files of a million rows or more."""
        return cut(df.coalesce(max(8, self.total // 1_000_000)))

    def of_nodes(self) -> DataFrame:
        """k1, k2, copies, and of the class of each distinct text: the least id and row number, the key of a row that has them, the size."""
        own = [F.min("doc_id").alias("least_id"), F.min("d").alias("least_d"), F.min_by("r", "d").alias("first"), F.sum("copies").alias("size")]
        among = self.link.join(self.nodes.select("k1", "k2", "doc_id", "d", "r", "copies"), ["k1", "k2"])
        by_root = among.groupBy("root").agg(*own, F.count("*").alias("weight"))
        linked_ = spread_join(self.link, self._cut(by_root), ["root"], "weight", self.total).drop("root")
        alone = self.nodes.select("k1", "k2", "copies", "doc_id", "d", "r").join(linked_, ["k1", "k2"], "left")
        return self._cut(alone.select("k1", "k2", "copies", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("least_id"),
            F.coalesce("least_d", "d").alias("least_d"), F.coalesce("first", "r").alias("first"), F.coalesce("size", "copies").alias("size")))


def assign(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, the least doc_id of the class, and class_size, its rows, for every row."""
    of = Classes(docs)
    named = of.of_nodes().select("k1", "k2", "copies", F.coalesce("least_id", "least_d").alias("class_id"), F.col("size").alias("class_size"))
    return spread_join(of.rows.select("doc_id", "k1", "k2"), named, ["k1", "k2"], "copies", of.total).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: that with the least number, all columns as they were."""
    of = Classes(docs)
    r = fresh("r")
    first = of.of_nodes().select(F.col("first").alias(r)).distinct()
    out = docs.withColumn(r, row_key(docs))
    return (once(out, r) if of.twice else out).join(first, r, "left_semi").select(*[F.col(f"`{x}`") for x in docs.columns])


#: The same by brute force: every pair of documents that share a shingle, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT r, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT r, g, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT r, sum(n) AS size FROM c GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN z x ON x.r = a JOIN z y ON y.r = b WHERE 5 * common >= 4 * (x.size + y.size - common)
      UNION ALL SELECT x.r, y.r FROM d x JOIN d y ON x.t = y.t AND x.r <> y.r WHERE x.t <> '' AND len(x.w) = 0),
m AS (SELECT r, r AS other FROM d UNION SELECT m.r, e.b FROM m JOIN e ON e.a = m.other)
SELECT d.doc_id, min(x.doc_id) AS class_id, count(*) AS class_size FROM m JOIN d ON d.r = m.r JOIN d x ON x.r = m.other GROUP BY d.r, d.doc_id
"""
