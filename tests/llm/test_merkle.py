import hashlib
import random
import zlib

import pytest
from deltaspan.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, path int, key string, pos long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def way(levels, at, arity):
    """(siblings left, siblings right) of a node for each level."""
    out = []
    for row in levels[:-1]:
        first = at - at % arity
        out.append((row[first:at], row[at + 1 : first + arity]))
        at //= arity
    return out


def manifest(rows, arity):
    """By definition: a list of the result's rows."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted([r[:5] for r in rows if r[2] == x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for x in langs}
    trees = {x: tree([leaf(*r) for r in own[x]], arity) for x in langs}
    top = tree([trees[x][-1][0] for x in langs], arity)
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            path = way(trees[x], i, arity) + way(top, k, arity)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            now = leaf(*r[:4], r[4] + tampered if r[4] is not None else None)
            for a, b in path:
                now = h(*a, now, *b)
            root = top[-1][0]
            out.append((r[0], leaf(*r), trees[x][-1][0], root, h(*[s for a, b in path for s in (*a, *b)]), now, now == root))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def check(spark, rows, arity=2, parts=3):
    got = merkle.documents_checked(spark.createDataFrame(rows, SCHEMA).repartition(parts), arity)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in got.collect()), key=key)
    assert got == sorted(manifest(rows, arity), key=key)
    return got


def test_odd_rows(spark, odd_texts):
    """Nulls in each column, empty and very long texts, repeated rows and ids, bytewise order of groups, clashing names."""
    langs = [None, "", "en", "de", "é", "z", "\U0001f600", "�"]
    rows = [(i, t, langs[i % 8], None if i % 4 == 0 else "s", None if t is None else len(t), "x", 1, "k", 5) for i, t in enumerate(odd_texts)]
    rows += [rows[3], rows[3], (None, "a", "en", "s", 1, "y", 1, "k", 5), (None, "a", "en", "s", 1, "y", 1, "k", 5), (3, "other", rows[3][2], None, None, "y", 2, "k", 5), (7, "t", None, None, (1 << 63) - 1, "y", 2, "k", 5)]
    got = check(spark, rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize(("n", "arity"), [(1, 2), (2, 2), (3, 2), (7, 3), (256, 2), (257, 2), (700, 2), (1025, 5)])
def test_sizes(spark, n, arity):
    """One group of just as many rows beside a lone leaf: blocks that are full, have one node, or several steps."""
    rng = random.Random(n)
    check(spark, [(rng.randrange(10**6), f"t{i}", "en", "s", i, "x", 1, "k", 5) for i in range(n)] + [(5, "x", "de", None, 1, "x", 1, "k", 5)], arity, 5)
    check(spark, [(i, "t", None, "s", 1, "x", 1, "k", 5) for i in range(n)], arity)


def test_many_steps(spark, monkeypatch):
    """Blocks of four, so that trees have several steps, groups too many to broadcast, and as many groups as rows."""
    monkeypatch.setattr(merkle, "BLOCK", 4)
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 2)
    check(spark, [(i, "t", f"l{i % 5 if i % 3 else 9}", "s", 1, "x", 1, "k", 5) for i in range(90)], 2, 4)
    check(spark, [(i, "t", f"l{i}", "s", 1, "x", 1, "k", 5) for i in range(20)], 2, 4)


def test_no_rows(spark):
    assert merkle.documents_checked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paths(spark):
    """The operator's own result: paths lead from each leaf to the root."""
    rows = spark.range(40).select(F.col("id"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"), merkle.digest(F.col("id")).alias("d"))
    for r in merkle.proofs(rows, "g", ["id"], "d", 3).collect():
        now = bytes(r["d"]).hex()
        for s in r["path"]:
            now = h(bytes(s["left"]).hex(), now, bytes(s["right"]).hex())
        assert now == bytes(r["root"]).hex()
