"""A Merkle manifest of a table: leaves by group, trees of the groups, a tree over their roots, and a proof for each row.

Nodes of a group stand in the order of its rows; every ``arity`` consecutive ones (the last run may have fewer, even
one) become their parent, until one remains, the group's root. The roots, in the order of the groups, give the root of
the table in the same way. A digest is the SHA-256 of its inputs as hex text.

Levels are built from below, BLOCK nodes and all levels over them in a step: the nodes of a step are dealt by group and
block, so that a group may have any number of rows, and each step leaves a persisted table of its blocks, a
BLOCK-th of the one before. Proofs are pushed from above: a block is joined to its parent, and each of its nodes puts its
own siblings before the suffix that the block inherits. Only blocks' suffixes are shuffled, never the proofs of rows.

Rows are numbered by ranges over all tasks; what the driver gets is a count for each task, and the root. Null groups come
first, the others follow by their bytes; rows of a group ascend by their order, nulls first, then by digest, so that
repeated rows are leaves of their own whose proofs may be exchanged among them. Nulls in a leaf read as ``-``; an empty
text has zero bytes; very long texts are read whole. An empty table has no rows and no root. Other columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

ARITY = 2
#: Nodes in a block at most: some 20 KB.
BLOCK = 256
#: Groups whose sizes are broadcast; beyond it they are joined, large ones apart.
BROADCAST_GROUPS = 100_000
PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """``-`` for a null, else the length in bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def _parent(run: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in run).encode()).digest()


def _depth(n: int, arity: int) -> int:
    """Levels over n nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // arity), k + 1
    return k


def _height(arity: int) -> int:
    """Levels over a block."""
    k = 1
    while arity ** (k + 1) <= BLOCK:
        k += 1
    return k


def rows_over(nodes: list[bytes], n: int, arity: int) -> list[list[bytes]]:
    """The nodes of a block and the levels over them, up to the block's own node; n: the nodes of the whole level."""
    out = [nodes]
    for _ in range(min(_depth(n, arity), _height(arity))):
        last = out[-1]
        out.append([_parent(last[i : i + arity]) for i in range(0, len(last), arity)])
    return out


def siblings(rows: list[list[bytes]], at: int, arity: int) -> tuple[list[bytes], list[bytes]]:
    """For each level of a block, the digests left and right of a node's ancestor in its run, put together."""
    left, right = [], []
    for row in rows[:-1]:
        first = at - at % arity
        left.append(b"".join(row[first:at]))
        right.append(b"".join(row[at + 1 : first + arity]))
        at //= arity
    return left, right


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of (key, ..., digest) with their place in their group from 0, and the group's size n."""
    own = cut(rows.repartitionByRange("key", *order, "digest").sortWithinPartitions("key", *order, "digest")).withColumn("at", F.monotonically_increasing_id())
    offset, total = [], 0
    for task, n in sorted((r["task"], r["n"]) for r in own.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("n")).collect()):  # a row for each task
        offset.append((task, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offset, "task long, offset long"))
    own = own.withColumn("task", F.shiftright("at", 33)).join(offsets, "task").withColumn("at", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("task", "offset")
    groups = own.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        own = own.join(F.broadcast(groups), "key")
    else:
        own = spread_join(own, groups.withColumn("weight", F.col("n")), ["key"], "weight", total)
    return own.withColumn("pos", F.col("at") - F.col("first")).drop("at", "first")


def build(nodes: DataFrame, arity: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each step, (key, block, n, nodes), from below, and the roots (key, digest).

    nodes: (key, pos, n, digest) and what is ``carried`` in the blocks of the first step.
    """
    width, steps, roots = arity ** _height(arity), [], []

    def run(blocks: pa.Array) -> pa.Array:
        return pa.array([rows_over([x["digest"] for x in r["nodes"]], r["n"], arity)[-1][0] for r in blocks.to_pylist()], type=pa.binary())

    over = F.arrow_udf(run, "binary")
    while True:
        blocks = nodes.groupBy("key", F.floor(F.col("pos") / width).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("nodes"))
        steps.append(blocks := cut(blocks))
        nodes, carried = blocks.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / width).alias("n"), over(F.struct("n", F.transform("nodes", lambda x: F.struct(x["digest"].alias("digest"))).alias("nodes"))).alias("digest")), []
        nodes = cut(nodes)
        roots.append(nodes.where("n = 1").select("key", "digest"))
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            break
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return steps, out


def pushed(steps: list[DataFrame], tops: DataFrame, arity: int, carried: list[str]) -> DataFrame:
    """For each node of the lowest step, (key, pos, root, digest, carried, path): siblings of its own first, those of the top last.

    tops: (key, root, path), the suffix that each group's root inherits.
    """
    kinds = {f.name: f.dataType for f in steps[0].schema["nodes"].dataType.elementType.fields}
    tops = tops.select("key", F.lit(0).cast("long").alias("block"), "root", F.col("path").alias("suffix"))
    below = None
    for k in reversed(range(len(steps))):
        # groups whose tree begins in this step get their suffix from the top, the others from the step above
        width = arity ** _height(arity)
        begins = steps[k].where(F.col("n") <= width).join(tops, ["key", "block"])
        own = begins if below is None else begins.unionByName(steps[k].where(F.col("n") > width).join(below.select("key", F.col("pos").alias("block"), "root", F.col("path").alias("suffix")), ["key", "block"]))
        names = carried if k == 0 else []
        schema = ", ".join(["key string, pos long, root binary, digest binary", *[f"`{c}` {kinds[c].simpleString()}" for c in names], f"path {PATH}"])
        below = own.select("key", "block", "n", "root", "suffix", "nodes").mapInArrow(_spread(arity, names), schema)
        if k:
            below = cut(below)
    return below


def _spread(arity: int, carried: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time, as paths take many times its size
                block = batch.slice(i, 1).to_pylist()[0]
                nodes, count = block["nodes"], len(block["nodes"])
                rows = rows_over([x["digest"] for x in nodes], block["n"], arity)
                after_left, after_right = [x["left"] for x in block["suffix"]], [x["right"] for x in block["suffix"]]
                left, right, at = [], [], [0]
                for place in range(count):
                    own = siblings(rows, place, arity)
                    left += own[0] + after_left
                    right += own[1] + after_right
                    at.append(len(left))
                pairs = pa.StructArray.from_arrays([pa.array(left, type=pa.binary()), pa.array(right, type=pa.binary())], names=["left", "right"])
                kinds = batch.schema.field("nodes").type.value_type
                columns = {"key": pa.array([block["key"]] * count, type=pa.string()), "pos": pa.array([x["pos"] for x in nodes], type=pa.int64()), "root": pa.array([block["root"]] * count, type=pa.binary()), "digest": pa.array([x["digest"] for x in nodes], type=pa.binary())}
                columns |= {c: pa.array([x[c] for x in nodes], type=kinds.field(c).type) for c in carried}
                yield pa.RecordBatch.from_pydict(columns | {"path": pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pairs)})

    return run


def proofs(rows: DataFrame, group: str, order: list[str], leaf: str, arity: int = ARITY, carried: tuple[str, ...] = ()) -> DataFrame:
    """order, leaf, carried, subroot, root and path of every row; ``leaf`` is a binary column, ``group`` a text.

    path has, for each level from the leaf to the root, the digests left and right of the node in its run.
    """
    names = [*order, *carried]
    inner = {c: f"c{i}" for i, c in enumerate(names)}
    key = F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0"))  # nulls first
    own = rows.select(key.alias("key"), F.col(leaf).alias("digest"), *[F.col(c).alias(i) for c, i in inner.items()])
    keep = list(inner.values())
    steps, subroots = build(placed(own, keep[: len(order)]), arity, keep)
    over = placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), ["group"])
    over_steps, top = build(over, arity, ["group"])
    if (found := top.first()) is None:
        return rows.select(*names, F.col(leaf), F.lit(b"").alias("subroot"), F.lit(b"").alias("root"), F.lit(None).cast(PATH).alias("path")).limit(0)
    root = F.lit(bytes(found["digest"]))
    whole = pushed(over_steps, top.select("key", F.col("digest").alias("root"), F.array().cast(PATH).alias("path")), arity, ["group"])
    out = pushed(steps, cut(whole.select(F.col("group").alias("key"), F.col("digest").alias("root"), "path")), arity, keep)
    return out.select(*[F.col(i).alias(c) for c, i in inner.items()], F.col("digest").alias(leaf), F.col("root").alias("subroot"), root.alias("root"), "path")


def folded(start: Column, path: Column) -> Column:
    """The root as hex text that a leaf and its path give."""
    return F.aggregate(path, hex_text(start), lambda h, s: F.sha2(F.concat(hex_text(s["left"]), h, hex_text(s["right"])).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hex_text(s["left"]), hex_text(s["right"]))), "").cast("binary"), 256)


def documents_checked(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """The manifest of documents by language, each row's proof held against what became of the row since.

    Rows whose crc32(doc_id as text) is a multiple of 7 have been tampered with: one is added to n_chars.
    """
    leaf = lambda n: digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered & F.col("n_chars").isNotNull(), leaf(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("now"))
    got = proofs(rows, "lang", ["doc_id"], "leaf", arity, ("now",))
    got = got.withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("path")))
    return got.select("doc_id", *[hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == hex_text(F.col("root"))).alias("verified"))


def _sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sql, ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"))) + ")"


#: crc32 has no function in SQL; its table of 256 values is made bit by bit.
ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS added
  FROM documents, crc),
leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS key, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + added")} AS now FROM docs),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaves),
up AS (
  SELECT key, 0 AS level, pos, n, leaf AS node FROM numbered
  UNION ALL
  SELECT key, level + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY key, level, pos // 2),
subroots AS (SELECT key, level, node, row_number() OVER (ORDER BY encode(key)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over_up AS (
  SELECT 0 AS level, pos, n, node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(node, '' ORDER BY pos)) FROM over_up WHERE n > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT x.key, x.pos, u.level, u.pos AS at, u.node AS sibling
  FROM numbered x JOIN up u ON u.key = x.key AND u.pos = xor(x.pos >> u.level, 1) AND u.n > 1
  UNION ALL
  SELECT x.key, x.pos, s.level + u.level, u.pos, u.node
  FROM numbered x JOIN subroots s ON s.key = x.key JOIN over_up u ON u.pos = xor(s.pos >> u.level, 1) AND u.n > 1),
proof AS (SELECT key, pos, sha256(string_agg(sibling, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY key, pos),
fold AS (
  SELECT x.key, x.pos, 0 AS level, x.now AS h, s.level + (SELECT max(level) FROM over_up) AS last FROM numbered x JOIN subroots s ON s.key = x.key
  UNION ALL
  SELECT f.key, f.pos, f.level + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.at % 2 = 0 THEN s.sibling || f.h ELSE f.h || s.sibling END), f.last
  FROM fold f LEFT JOIN steps s ON s.key = f.key AND s.pos = f.pos AND s.level = f.level WHERE f.level < f.last)
SELECT x.doc_id, x.leaf, s.node AS subroot, r.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.node AS verified
FROM numbered x JOIN subroots s ON s.key = x.key JOIN over_up r ON r.n = 1 JOIN fold f ON f.key = x.key AND f.pos = x.pos AND f.level = f.last
LEFT JOIN proof p ON p.key = x.key AND p.pos = x.pos
"""
