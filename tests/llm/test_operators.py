import collections
import hashlib
import html
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from deltaspan.llm import common, decontaminate, html_text, licenses, mixing, near_duplicates, pii, quality, site_quality, token_counts, toxicity
from pyspark.sql import functions as F

from .conftest import SCHEMA, prose, rows_of
from .test_kernels import grams, plain


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


# ---- components


def test_components(spark):
    rng = random.Random(2)
    chain = rng.sample(range(1, 90), 20)  # ids are hashes, in no order along a chain
    edges = list(zip(chain, chain[1:])) + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parts = lambda d: {frozenset(x for x in d if d[x] == r) for r in set(d.values())}
    assert parts(got) == parts({x: find(x) for x in root}) and set(got.values()) <= set(got)
    line = {r["node"]: r["root"] for r in common.components(spark.range(24).selectExpr("id as a", "id + 1 as b")).collect()}  # sorted numbers
    assert len(line) == 25 and len(set(line.values())) == 1
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- 8, quality


def test_quality(odd, odd_texts, none):
    got = by_id(quality.verdicts(odd))
    assert quality.verdicts(odd).count() == odd.count()
    for i, t in enumerate(odd_texts):
        r, want = got[i], plain(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.verdicts(none).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and quality.keep_good(none).count() == 0
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(r["doc_id"] for r in quality.verdicts(odd).where("kept and doc_id is not null").collect())


def test_quality_em():
    """EM by its definition, document by document; rules that agree decide, a rule that stands alone doesn't, whatever the start."""
    rng = np.random.default_rng(1)
    n, rules = 600, 5
    bad = rng.random(n) < 0.1
    votes = rng.choice([3, 2, 0], (n, rules), p=[0.92, 0.04, 0.04])
    votes[bad, 0] = rng.choice([1, 2, 3], bad.sum(), p=[0.8, 0.15, 0.05])  # the first three rules see the same
    votes[bad, 1] = rng.choice([1, 2, 3], bad.sum(), p=[0.6, 0.3, 0.1])
    votes[bad, 2] = rng.choice([1, 2, 0], bad.sum(), p=[0.3, 0.3, 0.4])
    votes[:, 4] = np.where(rng.random(n) < 0.08, 1, votes[:, 4])  # the last one shouts alone
    unique, inverse, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(-1)
    post, model = quality.fit(unique, count.astype(float), 25)
    prior, first = quality.start(rules)
    share, chance = prior.copy(), first.copy()

    def expect():
        p = np.array([[share[k] * math.prod(chance[k, r, v - 1] for r, v in enumerate(row) if v) for k in range(2)] for row in votes])
        return p / p.sum(axis=1, keepdims=True)

    for _ in range(25):
        p = expect()
        sums = np.array([[[p[votes[:, r] == v, k].sum() + quality.WEIGHT * n * prior[k] * first[k, r, v - 1] for v in (1, 2, 3)] for r in range(rules)] for k in range(2)])
        for r in range(rules):
            own = [sums[k, r] / sums[k, r].sum() for k in range(2)]
            if own[1][:2].sum() < own[0][:2].sum():  # no better than guessing: no say
                own = [sums[:, r].sum(axis=0) / sums[:, r].sum()] * 2
            chance[0, r], chance[1, r] = own
        share = p.sum(axis=0) + quality.WEIGHT * n * prior
        share /= share.sum()
    assert np.allclose(post[inverse], expect()[:, 0], atol=1e-9) and np.allclose(model["chance"], chance) and np.allclose(model["share"], share)
    post, model = quality.fit(unique, count.astype(float))
    assert np.mean((post[inverse] < 0.5) == bad) > 0.98
    begun = quality.posterior(unique, *quality.start(rules))[:, 0]
    assert (begun[inverse] < 0.5).sum() < 0.5 * bad.sum()  # the start alone hardly says anything
    of = {tuple(v): x for v, x in zip(unique.tolist(), post)}
    assert of[3, 3, 3, 3, 1] > 0.9  # a strong vote that no other rule joins
    assert all(x < 0.5 for v, x in of.items() if 1 <= v[0] <= 2 and 1 <= v[1] <= 2)
    assert (model["chance"][1, :3, :2].sum(axis=1) > 3 * model["chance"][0, :3, :2].sum(axis=1)).all() and model["chance"][1, 4, :2].sum() < 0.3
    more, _ = quality.fit(unique, count * 1000.0)
    assert np.allclose(more, post, atol=1e-6)  # size alone changes nothing


def test_quality_labels(spark):
    """Verdicts on the labelled documents, and that they differ from a filter that all rules must pass."""
    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no tables")
    docs, label = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    c = docs.select("doc_id", quality.counts(F.col("text")).alias("c"))
    blamed = F.lit(False)
    for _, v in quality.rules(F.col("c")):
        blamed = blamed | v.isin(quality.STRONG, quality.WEAK)
    rows = quality.verdicts(docs).join(c.select("doc_id", blamed.alias("blamed")), "doc_id").join(label, "doc_id", "left").toPandas()
    bad, good = rows[rows.quality == 0], rows[rows.quality == 1]
    assert (~bad.kept).sum() >= 560 and (~good.kept & ~good.base_failed).sum() <= 8
    assert (rows.blamed & rows.kept).sum() >= 100
    # what EM has learnt: without it hundreds of verdicts would be others
    codes = docs.select(quality.counts(F.col("text")).alias("c")).where(~quality.base_failed(F.col("c"))).groupBy(quality.pattern(F.col("c")).alias("p")).count().toPandas()
    votes = (codes.p.to_numpy()[:, None] // 4 ** np.arange(len(quality.rules(F.lit(None))))) % 4
    post, model = quality.fit(votes, codes["count"].to_numpy(dtype=float))
    begun = quality.posterior(votes, *quality.start(votes.shape[1]))[:, 0]
    assert codes["count"][(post < 0.5) != (begun < 0.5)].sum() >= 300


# ---- 5, near-duplicates


def test_hot_band(spark):
    """A band of 100,000 distinct texts: its links stay spread over the tasks that have the texts, and none is lost."""
    n, parts = 100_000, 40
    nodes = spark.range(n, numPartitions=parts).select((F.col("id") * 3 + 7).alias("k1"), F.lit(9).alias("words"), F.array(F.lit(5).cast("long"), F.col("id") % 1000 + 10**6, -F.col("id")).alias("bands"))
    links = near_duplicates.band_links(nodes, n)
    size = [r["count"] for r in links.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    # all but the least text of each of the 1,001 bands; the links of the hot band aren't in one task
    assert sum(size) == (n - 1) + (n - 1000)
    assert links.where("b = 7").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 0.1 * n
    assert near_duplicates.clusters(nodes, n).select("root").distinct().count() == 1


def near_fixture():
    rng = random.Random(9)
    texts = [prose(rng, 80) for _ in range(30)]
    for base in texts[:6]:
        w = base.split()
        for k in range(6):  # a chain: each differs from the one before by one word
            w[10 * k + 5] = f"edit{k}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper() + "!", texts[1] + " tail end", " ".join(texts[2].split()[:60]), "short one", "Short, one", None, "", "", "***", "***", "+++"]
    texts.append(" ".join(["again and again the same five words"] * 40))
    texts.append(" ".join(["again and again the same five words"] * 20))
    return texts


def near_classes(texts):
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common_ = sum((sets[i] & sets[j]).values())
            total = sum(sets[i].values()) + sum(sets[j].values()) - common_
            if (total and 5 * common_ >= 4 * total) or (not total and texts[i] and texts[i] == texts[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("cluster", [200, 3])
def test_near_duplicates(spark, monkeypatch, cluster):
    monkeypatch.setattr(near_duplicates, "CLUSTER", cluster)
    texts = near_fixture()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5)
    want = near_classes(texts)
    got = by_id(near_duplicates.assign(docs))
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert {i: r["class_size"] for i, r in got.items()} == {i: collections.Counter(want.values())[c] for i, c in want.items()}


def test_near_duplicates_odd(odd, odd_texts, none):
    rows = near_duplicates.assign(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert got == near_classes(odd_texts)
    # a row without id joins the class of its text
    assert 8 in {r["class_id"] for r in rows if r["doc_id"] is None}
    kept = near_duplicates.keep_one(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns
    # one of each class; the null text without id is a class of its own
    assert sorted(x for x in ids if x is not None) == sorted(set(got.values())) and ids.count(None) == 1
    assert near_duplicates.assign(none).count() == 0 and near_duplicates.keep_one(none).count() == 0


def test_linked_by_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**60, 40).astype(np.uint64)
    sets = [np.sort(np.unique(np.concatenate([rng.choice(base, 38, replace=False), rng.integers(0, 2**60, int(rng.integers(0, 6))).astype(np.uint64)]))) for _ in range(60)]
    alike = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for a in sets] for b in sets])
    reach = alike.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    monkeypatch.setattr(near_duplicates, "MATCHES", 100)
    root = near_duplicates.linked(flat, at)
    assert ((root[:, None] == root[None, :]) == reach).all()


# ---- 1, decontamination


def contained(texts, items):
    sets = [set(grams(t)) if len(re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())) >= 5 else set() for t in texts]
    own = [set(grams(t)) if len(re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())) >= 5 else set() for t in items]
    return sorted((d, i, len(s & q), len(q)) for d, s in enumerate(sets) for i, q in enumerate(own) if q and len(s & q) >= 0.8 * len(q))


def test_decontamination(spark, odd, none, monkeypatch):
    rng = random.Random(3)
    items = [prose(rng, n, 5000) for n in (5, 12, 20, 33, 50, 90, 300)] + ["too short item", None, "", "p q r s t"]
    items.append(items[3])
    texts = []
    for i, it in enumerate(items[:7]):
        w = it.split()
        texts.append(prose(rng, 3000, 3000) + " " + it.upper() + ", " + prose(rng, 500, 3000))
        texts.append(prose(rng, 40) + " " + " ".join([*w[: len(w) // 2], "altered", *w[len(w) // 2 + 1 :]]))
        texts.append(" ".join(w[: len(w) // 2]) + " " + prose(rng, 900, 3000) + " " + " ".join(w[max(0, len(w) // 2 - 4) :]))
        texts.append(" ".join(w[: int(0.7 * len(w))]))
    texts += [None, "", "x", prose(rng, 100)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = contained(texts, items)
    assert len(want) > 15
    key = lambda df: sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in df.collect())
    assert key(decontaminate.found(docs, bench)) == want
    monkeypatch.setattr(decontaminate, "INDEX_SHINGLES", 40)  # several blocks of items
    assert key(decontaminate.found(docs, bench)) == want
    assert {r["doc_id"] for r in decontaminate.remove(docs, bench).collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert decontaminate.remove(odd, bench).columns == odd.columns and decontaminate.remove(odd, bench).count() == odd.count()
    assert decontaminate.found(none, bench).count() == 0 and decontaminate.found(docs, bench.limit(0)).count() == 0


def test_decontamination_short_and_scattered():
    rng = random.Random(13)
    items = [prose(rng, 5 + k % 4, 5000) for k in range(400)] + [prose(rng, n, 5000) for n in (30, 200, 600)]
    texts = [prose(rng, rng.randrange(20, 400), 3000) + " " + it + " " + prose(rng, rng.randrange(20, 400), 3000) for it in items]
    for it in items[400:]:
        w = it.split()  # in pieces far apart: each cut loses four shingles
        cuts = max(1, len(w) // 25 - 1)
        ends = [len(w) * k // (cuts + 1) for k in range(cuts + 2)]
        texts.append(" ".join(" ".join(w[a:b]) + " " + prose(rng, 3000, 3000) for a, b in zip(ends, ends[1:])))
    index = decontaminate.Index([np.array(sorted(np.unique(decontaminate.shingles(pa.array([t]), short=False)[0])), dtype=np.uint64) for t in items])
    row, item, shared = index.matches(pa.array(texts))
    got = sorted((d, i, s, len(index.items[i])) for d, i, s in zip(row.tolist(), item.tolist(), shared.tolist(), strict=True))
    want = contained(texts, items)
    assert len(want) >= 405
    assert got == want


def test_decontamination_sketches():
    """Sketches are the least hashes, k by the class of size; candidates are few beside the pairs that share a shingle, and none is missed."""
    rng = random.Random(29)
    passages = [prose(rng, 40, 4000) for _ in range(6)]  # that many items and texts share
    items = [prose(rng, 4 + 9 * k, 4000) + " " + rng.choice(passages) for k in range(60)]
    sets = [np.unique(decontaminate.shingles(pa.array([t]), short=False)[0]) for t in items]
    index = decontaminate.Index(sets)
    for k, own in enumerate(sets):
        n = len(own)
        m = max(1, 2 ** (n.bit_length() - 1) // 4)
        assert index.need[k] == math.ceil(4 * n / 5) and index.hits[k] == m
        assert sorted(index.value[index.owner == k].tolist()) == sorted(own.tolist())[: n - index.need[k] + m]
    texts = [prose(rng, 400, 4000) + " " + rng.choice(passages) + " " + (items[i] if i % 3 == 0 else "") + " " + prose(rng, 400, 4000) for i in range(60)]
    full, at, _ = decontaminate.shingles(pa.array(texts), short=False)
    pairs = {tuple(x) for x in index.candidates(full, at).tolist()}
    want = {(d, i) for d, i, _, _ in contained(texts, items)}
    own = [set(full[a:b].tolist()) for a, b in zip(at, at[1:])]
    sharing = sum(bool(own[d] & set(s.tolist())) for d in range(60) for s in sets)
    assert want <= pairs and len(want) >= 20 and len(pairs) < 0.4 * sharing


# ---- 9, personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_pii(spark, odd, none):
    rng = random.Random(6)
    pieces = ["a@b.c", "_d@e.f", "x", " ", "\n", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (961) 555-6946", "+", "12", ".", "-", "@", "é😀", "001.02.3.4", "9" * 16]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + [None, "", "a@" + "b." * 5000 + "c", "9" * 20000, "+1" * 5000, "x." * 9000]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = by_id(pii.scan(docs))
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in want) for k in BASE], t[:100]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest(), t[:100]
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(got[i]["spans"].split(","))
    assert pii.scan(odd).count() == odd.count() and pii.scan(none).count() == pii.redact(none).count() == 0


def test_pii_zero_parts(spark):
    rng = random.Random(16)
    parts = ["0", "00", "000", "1", "01", "10", "100", "0255", "255", "256", "0256", "0" * 300, "0" * 300 + "9"]
    texts = ["10.0.0.1", "0.0.0.0", "000.1.1.1", "192.168.0.1 127.0.0.1", "256.0.0.1", "0.0.0"] + [".".join(rng.choice(parts) for _ in range(rng.randrange(3, 10))) for _ in range(200)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = by_id(pii.scan(docs))
    assert [got[i]["n_ip"] for i in range(6)] == [1, 1, 1, 2, 0, 0]
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in want) for k in BASE], t[:100]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest(), t[:100]
    assert by_id(pii.redact(docs))[3]["text"] == "[IP] [IP]"


def test_pii_many_matches(spark):
    """Texts of thousands of matches, in time that grows as they do, and what stays when they go."""
    rng = random.Random(26)
    one = lambda: rng.choice(["a@b.co", "10.0.0.7", "4111 1111 1111 1111", "+1 961 555 6946"])
    texts = [" \n".join(f"{one()} é{'x' * rng.randrange(30)}" for _ in range(n)) for n in (130, 2000, 20000)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got, red = by_id(pii.scan(docs)), by_id(pii.redact(docs))
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
        assert len(got[i]["scores"].split(",")) == len(got[i]["spans"].split(","))
        out, at = [], 0
        for a, b, k in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in got[i]["spans"].split(","))):
            if a >= at:
                out.append(t[at:a] + f"[{k.upper()}]")
            at = max(at, b)
        assert red[i]["text"] == "".join(out) + t[at:] and red[i]["n_chars"] == len(red[i]["text"])


def test_pii_context(spark):
    docs = spark.createDataFrame(rows_of(["server 10.0.0.1", "version 10.0.0.1", "10.0.0.1"]), SCHEMA)
    got = by_id(pii.scan(docs))
    assert [got[i]["scores"] for i in range(3)] == ["0.80", "0.40", "0.60"] and all(got[i]["n_ip"] == 1 for i in range(3))


def test_pii_sql():
    """The base spans by the SQL form, on a table with every kind."""
    c = duckdb.connect()
    texts = ["a@b.c 1.2.3.4", None, "card 4111 1111 1111 1111 and +1 (961) 555-6946", "300.1.1.1 4111-1111-1111-1112", ""]
    c.sql("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    result = c.sql(pii.ORACLE_BASE)
    for row in result.fetchall():
        d = dict(zip(result.columns, row, strict=True))
        want = base_spans(texts[d["doc_id"]])
        assert [d[f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in want) for k in BASE]
        assert d["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()


def test_pii_added(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "room 123-45-6789", 'token = "9765fab7324201a5ddfac0becd9064abbef40be8"', "9765fab7324201a5ddfac0becd9064abbef40be8"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = by_id(pii.scan(docs))
    assert [got[i]["spans"] for i in range(5)] == ["iban:5:32", "ssn:4:15", "", "secret:9:49", ""]
    red = by_id(pii.redact(docs))
    assert red[0]["text"].startswith("IBAN [IBAN], not DE88") and red[1]["text"] == "ssn [SSN]" and red[1]["n_chars"] == 9 and red[2]["text"] == texts[2]
    overlap = by_id(pii.redact(spark.createDataFrame(rows_of(["call +12.34.56.78.90 a@b.c"]), SCHEMA)))[0]["text"]
    assert overlap == "call [PHONE] [EMAIL]"


def test_pii_redacts_all(spark):
    docs = spark.createDataFrame(rows_of(["a@b.c and 1.2.3.4, +1 961 555 6946 or 4111 1111 1111 1111"]), SCHEMA)
    assert by_id(pii.scan(pii.redact(docs)))[0]["spans"] == ""


# ---- 7, mixing


def test_mixing(spark, odd, none):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        k = "abc"[min(2, i % 6 // 2)] if i % 2 else "a"
        rows.append((i, " ".join(f"{k}{rng.randrange(50)}" for _ in range(rng.randrange(5, 40))), k))
    docs = spark.createDataFrame([(*r[:2], r[2]) for r in rows], "doc_id bigint, text string, domain string")
    targets = {"a": 0.2, "b": 0.5, "c": 0.3}
    got = {r["doc_id"]: r for r in mixing.rates(docs, docs, "domain", targets).collect()}
    assert all(got[i]["domain"] == k for i, _, k in rows)
    total = sum(r["tokens"] for r in got.values())
    for d, share in targets.items():
        assert math.isclose(sum(r["tokens"] * r["rate"] for i, r in got.items() if rows[i][2] == d), share * total, rel_tol=0.02)
    # the least squares solution nearest to one, by plain projected gradient on the same posteriors
    model = mixing.fit(docs, "domain")
    n, p = model.posterior(pa.array([r[1] for r in rows]))
    a, goal, r = n[:, None] * p, np.array([targets[d] for d in model.domains]) * n.sum(), np.ones(len(n))
    for _ in range(5000):
        r = np.maximum(0, r - p @ (a.T @ r - goal) / n.sum())
    assert np.allclose([got[i]["rate"] for i in range(len(rows))], r, atol=1e-3)
    zero = mixing.rates(docs, docs, "domain", {"a": 1.0})
    assert zero.agg(F.min("rate")).first()[0] >= 0
    mixed = mixing.mix(odd, odd, "lang")
    assert mixed.columns == [*odd.columns, "mix_rate", "mix_copies"] and mixed.count() == odd.count()
    assert mixing.rates(none, none, "lang").count() == mixing.mix(none, none, "lang").count() == 0


@pytest.mark.parametrize("target", [(0.9, 0.07, 0.01, 0.01, 0.01), (0.5, 0.5, 0, 0, 0), (0.2, 0.2, 0.2, 0.2, 0.2), (0, 0, 0, 0, 1.0)])
def test_mixing_solver(spark, monkeypatch, target):
    """Skewed, zero and unreachable targets, against plain projected gradient over the rows."""
    rng = np.random.default_rng(12)
    p = rng.dirichlet([0.6, 0.5, 0.4, 0.3, 0.3], 2000)
    p = p * 0.9 + 0.02  # no row is wholly of one domain, so that zeros are out of reach
    n = rng.integers(1, 200, 2000)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "tokens bigint, p array<double>").repartition(4)
    names = list("abcde")
    got = mixing.solve(rows, names, dict(zip(names, target)))
    total = float(n.sum())
    a, goal, r = n[:, None] * p, np.array(target) * total, np.ones(2000)
    top = np.linalg.eigvalsh(p.T @ a).max()
    for _ in range(20000):
        r = np.maximum(0, r - p @ (r @ a - goal) / top)
    want, miss = np.linalg.norm(r @ a - goal) / total, np.linalg.norm(got.reached - goal) / total
    assert got.settled and miss <= want + 0.01 * max(1.0, want)
    named = got.join(rows.withColumn("cell", mixing.cell_of(F.col("p"))), "cell", "r", 2000).toPandas()
    reached = (named["tokens"].to_numpy() * named["r"].to_numpy()) @ np.stack(named["p"].to_list())
    assert len(named) == 2000 and named["r"].min() >= 0 and np.allclose(reached, got.reached, atol=1e-6 * total)
    if target[0] == 0.5:  # the distributed form takes the same steps
        short = mixing.solve(rows, names, dict(zip(names, target)), 6)
        monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
        monkeypatch.setattr(mixing, "REWRITE", 4)  # rates are written once, and two steps are replayed
        far = mixing.solve(rows, names, dict(zip(names, target)), 6)
        assert np.allclose(far.reached, short.reached) and not far.small and not far.settled
        named = far.join(rows.withColumn("cell", mixing.cell_of(F.col("p"))), "cell", "r", 2000).toPandas()
        assert np.allclose((named["tokens"].to_numpy() * named["r"].to_numpy()) @ np.stack(named["p"].to_list()), far.reached)


def test_mixing_far_until_settled(spark, monkeypatch):
    """The distributed form, with its rates written every few rounds, until it settles."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.5, 0.5, 0.5], 300)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(rng.integers(1, 90, 300), p)], "tokens bigint, p array<double>").repartition(2)
    targets = {"a": 0.45, "b": 0.3, "c": 0.25}
    near = mixing.solve(rows, list("abc"), targets)
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    monkeypatch.setattr(mixing, "REWRITE", 7)
    far = mixing.solve(rows, list("abc"), targets)
    assert far.settled and near.settled and not far.small and np.allclose(far.reached, near.reached, rtol=1e-5)


def test_mixing_unsettled(odd, monkeypatch):
    """Rates that don't settle are said to."""
    monkeypatch.setattr(mixing, "descend", lambda state, reached, goal, rounds: (reached, False))
    with pytest.warns(UserWarning, match="settle"):
        out = mixing.mix(odd, odd, "lang")
    assert out.schema["mix_rate"].metadata == {"settled": False}


def test_mixing_odd(spark, odd):
    one = mixing.mix(odd, odd.withColumn("lang", F.lit("en")), "lang")
    assert one.count() == odd.count() and one.where("mix_rate is null or mix_copies is null").count() == 0
    assert one.schema["mix_rate"].metadata == {"settled": True}
    many = spark.createDataFrame([(i, f"w{i}", f"d{i}") for i in range(70)], "doc_id bigint, text string, domain string")
    with pytest.raises(ValueError, match="over 64 domains"):
        mixing.rates(many, many, "domain")
    assert {r["rate"] for r in mixing.rates(many, many.withColumn("domain", F.lit(None).cast("string")), "domain").collect()} == {1.0}


def test_mixing_rare_domains(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(mixing, "DOMAIN_ROWS", 20, raising=False)
    rng = random.Random(18)
    kinds = ["a"] * 2000 + ["b"] * 2000 + ["c"] * 2 + ["d"]
    rows = [(i, " ".join(f"{k}{rng.randrange(50)}" for _ in range(20)), k) for i, k in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, domain string")
    model = mixing.fit(docs, "domain")
    assert model.domains == ["a", "b", "c", "d"]
    assert np.allclose(model.prior, np.array([2001, 2001, 3, 2]) / 4007)
    got = {r["doc_id"]: r["domain"] for r in mixing.rates(docs, docs, "domain").collect()}
    assert sum(got[i] != k for i, k in enumerate(kinds)) == 0
    size = {"a": 2000, "b": 2000, "c": 2, "d": 1}
    seen = {r["domain"]: r["count"] for r in mixing._hash_sample(docs, size).groupBy("domain").count().collect()}
    assert seen["c"] == 2 and seen["d"] == 1 and seen["a"] + seen["b"] < 200
    with pytest.raises(ValueError, match="without labelled rows: e"):
        mixing.rates(docs, docs, "domain", {"a": 0.5, "e": 0.5})


# ---- 10, toxicity


def test_toxicity(spark, odd, none, labels):
    rng = random.Random(11)
    rows, toxic = [], []
    for i in range(1200):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(10, 60))]
        a, b = rng.random() < 0.4, rng.random() < 0.4
        w += ["slur"] * a + ["group"] * b  # bad together, not alone
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        toxic.append((i, None, int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(toxic, "doc_id bigint, quality int, toxic int")
    got = toxicity.scores(docs, lab).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]][2] for r in held]) > 0.97
    # labels of held-out rows are never read
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, flipped).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)
    assert toxicity.scores(odd, labels).count() == odd.count()
    assert toxicity.scores(none, labels).count() == 0 and toxicity.scores(odd, labels.limit(0)).where("score is null").count() == 0


def test_toxicity_repeated_ids(spark):
    """A labelled id that thousands of rows have is learnt from once."""
    docs = spark.createDataFrame([(1, f"insult number {i}") for i in range(3000)] + [(i, "plain words") for i in range(2, 60)], "doc_id bigint, text string")
    lab = spark.createDataFrame([(1, 1)] * 5 + [(i, 0) for i in range(2, 60)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, lab)
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(2, 60))
    assert math.isclose(model.w0, math.log(1.5 / (58 - held + 0.5)), abs_tol=2.0)
    rows = toxicity.scores(docs.withColumn("score", F.lit("x")).withColumn("label", F.lit(0)), lab)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == docs.count()


def test_clashing_columns(spark):
    """Columns with the names that the operators use inside don't matter."""
    names = ["s", "c", "d", "r", "k1", "cell", "tokens", "p", "pattern", "kind", "spans", "item", "m", "n", "turn", "label"]
    text = "a mail to a@b.co and some more words that make this text long enough"
    docs = spark.createDataFrame([(1, text, "en", "x"), (2, text + " and an end", "de", "y")], "doc_id bigint, text string, lang string, source string")
    wide = docs.withColumns({c: F.lit(7) for c in names})
    bench = spark.createDataFrame([(5, "some more words that make this text long enough and", 0)], "item_id bigint, text string, n int")
    same = lambda f: sorted(map(str, f(docs).collect())) == sorted(map(str, f(wide).collect()))
    assert same(quality.verdicts) and same(pii.scan) and same(near_duplicates.assign) and same(token_counts.counts) and same(licenses.scan)
    assert same(lambda x: decontaminate.found(x, bench)) and same(lambda x: mixing.rates(x, x, "lang"))
    for f in (quality.keep_good, pii.redact, near_duplicates.keep_one, lambda x: decontaminate.remove(x, bench)):
        assert f(wide).columns == wide.columns and f(wide).count() == f(docs).count()


def test_machine_by_definition():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(10), 0.3, rng.normal(size=10), rng.normal(size=(10, 4)))
    term, at = np.array([1, 4, 7, 2]), np.array([0, 3, 3, 4])
    pairs = sum(m.v[a] @ m.v[b] for a, b in ((1, 4), (1, 7), (4, 7)))
    assert np.allclose(m.logit(term, at), [0.3 + m.w[[1, 4, 7]].sum() + pairs, 0.3, 0.3 + m.w[2]])


# ---- 3, pages


def test_pages(spark):
    def page(i, host="a.example.org"):
        comments = f'<div id="comments"><p>Reader {i} says much more than the article does, again and again and again.</p></div>'
        return f'<html><head><title>T{i}</title><script>var x="</p>";</script></head><body><header><h1>Site</h1></header><nav><li>Home</li></nav><div class="ad">Buy {i}</div><article><h1>Head {i}</h1><p>Text &amp; more of {i}.<br>Line<p>Second <b>bold</b> {i}.<div class="share">Share this</div><p>Read our rules.</p></article><aside>Side {i}</aside>{comments}<footer>&copy; x</footer>'

    rows = [(i, f"http://a.example.org/{i}", page(i)) for i in range(12)] + [(20, None, page(20)), (21, "http://b.example.org/", None), (22, "nonsense", ""), (23, "http://c.example.org/x", "<p>a</p><p>b</p>")]
    rows += [(30 + i, "http://copies.example.org/", page(99)) for i in range(6)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")
    got = {r["page_id"]: r for r in html_text.main_texts(pages).collect()}
    assert len(got) == len(rows)
    for i in range(12):  # "Read our rules." stands in every page of the host: template
        assert got[i]["text"] == f"Head {i}\nText & more of {i}. Line\nSecond bold {i}."
    assert got[20]["text"].endswith("Read our rules.") and got[20]["n_chars"] == len(got[20]["text"])
    assert got[21]["text"] == got[22]["text"] == "" and got[23]["text"] == "a\nb"
    assert "Text & more of 99." in got[30]["text"]  # copies of a page aren't its template
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_pages_broken():
    for bad in ("<", "<p", "a<b", "<!--", "<textarea>" + "a" * 5 + "<p>after", "<div " + "x" * 1000, "<p \"'>", "<script>", "&#xD800;", "<div>" * 3000 + "x", "</div>" * 50 + "y", "<a href='" * 500):
        assert isinstance(html_text.extract(bad, None), str)
    words = html_text.extract("<body><div class=menu>m</div><div><p>One&nbsp;two  three</p></div><form>f</form></body>", None)
    assert words == "One two three" and html.unescape("&amp;") == "&"


def test_pages_contract():
    """Parts that go by block, and parts that stay although their names are near those of others."""
    cases = {
        "<article><p class='advert'>buy</p><p>kept</p></article>": "kept",
        "<article><p hidden>gone</p><p>kept <span style='display:none'>gone <span>too</span></span>whole</p></article>": "kept whole",
        "<article><p>a</p><ul><li class='comment'><p>reader</p></li><li>item</li></ul></article>": "a\nitem",
        "<article><div class='related-work'><p>earlier work</p></div><section id='share'><p>market share</p></section></article>": "earlier work\nmarket share",
        "<article><p>see <math><mi>x</mi></math> and <svg><text>axis</text></svg></p></article>": "see x and axis",
        "<div><p>before</p><textarea><p>after</p></div>": "before\nafter",
        "<div id='notice'>we moved</div><div><p>a</p><div id='comment-12' class='reply'>reader</div></div>": "a",
        "<form><div><h1>title</h1><p>whole page in a form</p></div></form>": "title\nwhole page in a form",
        "<article><p>a</p><form><p>your name</p></form><div class='related-posts'>more</div></article>": "a",
        "<article><p>" + "long " * 200_000 + "</p></article>": ("long " * 200_000).strip(),
        "<article>" + "<div>" * 2000 + "<p>deep</p></article>": "deep",
    }
    for body, want in cases.items():
        assert html_text.extract(f"<html><body><nav><a>x</a></nav>{body}</body></html>", None) == want, body[:80]


def test_page_names():
    """Names of everyday pages that don't make an article go, and parts that go though their names are run together or numbered."""
    body = "<h1>title</h1><p>the text of the page is here, and it is long enough</p>"
    want = "title\nthe text of the page is here, and it is long enough"
    for page in (
        "<main class='with-sidebar'>{}</main>", "<div class='site has-sidebar'><article>{}</article></div>", "<div class='no-sidebar'><article>{}</article></div>",
        "<div class='has-sticky-header'><main>{}</main></div>", "<article class='hentry comments-open'>{}</article>", "<div class='category-search'><article>{}</article></div>",
        "<main><div class='tag-navigation'>{}</div></main>", "<article class='ad-free'>{}</article>", "<main class='sidebar-left'>{}</main>", "<div id='nav'><div class='search'><article>{}</article></div></div>",
        "<div class='menu-wrapper'><div>{}</div></div>", "<article class='search'>{}</article>", "<article class='post newsletter'>{}</article>", "<form><div><p>before</p></div><div class=x>{}</div></form>",
    ):
        got = html_text.extract(f"<html><body><nav><a>x</a></nav>{page.format(body)}<footer>end</footer></body></html>", None)
        assert got == want or got == "before\n" + want, page
    for part in (
        "<ol class='commentlist'><li><article>reader</article></li></ol>", "<section class='responses'><p>reader</p></section>", "<div class='adslot-1'>buy</div>", "<div class='notice-info'>moved</div>", "<div class='cookiebanner'>ok</div>",
        "<div class='sidebar2'>more</div>", "<div id='comments'><article class='comment'>reader says</article></div>", "<div class='comment-list'>reader</div>", "<div class='main-nav'>home</div>", "<div class='site-header'><h1>Site</h1></div>",
        "<div class='ad ad-300x250'>buy</div>", "<div class='social-share-buttons'>share</div>", "<div class='post-comments'>reader</div>", "<div class='sidebar'><article>teaser</article></div>",
    ):
        assert html_text.extract(f"<html><body><article>{body}</article>{part}</body></html>", None) == want, part
        if "<h1>" not in part:
            assert html_text.extract(f"<html><body><div id='content'>{body}{part}</div></body></html>", None) == want, part
    # a teaser in an article doesn't stand for the page
    text = html_text.extract("<html><body><div id='content'><p>The whole text of the page, which is long.</p></div><article>teaser</article></body></html>", None)
    assert text.startswith("The whole text of the page, which is long.")
    # the whole text in a form
    assert html_text.extract("<html><body><nav>x</nav><form><div><p>The whole text of the page.</p></div></form></body></html>", None) == "The whole text of the page."
    assert html_text.extract("<html><body><div><p>The whole text of the page.</p></div><form><label>name</label></form></body></html>", None) == "The whole text of the page."


@pytest.mark.parametrize("n", [3, 5, 12])
def test_pages_by_template(spark, n):
    """Hosts whose menus and notices have neither names nor elements that tell: from MIN_PAGES pages on, only the template drops them."""
    rng = random.Random(n)
    menu = "<div><span>Home of all our pages</span></div><div><span>Find a page by its name here</span></div>"
    notice = "<div><span>This place of ours uses what it may keep of you to work</span></div>"
    truth, rows = {}, []
    for i in range(n):
        text = [" ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randrange(6, 30))) for _ in range(3)]
        truth[i] = "\n".join(text)
        rows.append((i, f"http://h.example.org/{i}", f"<html><body>{menu}<div>{''.join(f'<p>{t}</p>' for t in text)}</div>{notice}</body></html>"))
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    if n >= html_text.MIN_PAGES:
        assert got == truth
    else:  # too few pages to tell a template from a repeated sentence: nothing is lost
        assert all(truth[i] in got[i] and got[i].startswith("Home of all") for i in got)


def test_page_classes(spark, monkeypatch):
    """Vectors and classes by brute force, two layouts on a host, a long disclaimer, and pages without article or main."""
    rng = random.Random(31)
    legal = " ".join(f"clause{k}" for k in range(120))
    body = lambda i: "".join(f"<p>{' '.join(f'w{rng.randrange(5000)}' for _ in range(12))}.</p>" for _ in range(2 + i % 4))
    truth, rows = {}, []
    for i in range(40):
        text = body(i)
        lay = f"<div><ul><li>Home page of us</li><li>All about the site</li></ul></div><div class=c>{text}</div><div><p>{legal}</p></div>"
        if i % 2:  # a layout of its own, and a note at a place of its own
            lay = f"<section><p>Welcome to the second layout here</p>{text}</section><table><tr><td>Cells of the lower frame stand</td></tr></table><div><p>{legal}</p></div>"
        truth[i] = re.sub(r"</p><p>", "\n", text)[3:-4]
        rows.append((i, f"http://a.example.org/{i}", f"<html><body>{lay}</body></html>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
    assert got == truth
    monkeypatch.setattr(html_text, "BROADCAST_TOKENS", -1)  # the salted join
    assert {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()} == truth
    # classes: tokens of equal counts in the same pages
    of = collections.defaultdict(dict)
    for i, _, page in rows:
        for t, n, *_ in html_text.tokens(html_text.events(page)):
            of[t][i] = n
    groups = collections.defaultdict(set)
    for t, vector in of.items():
        if len(vector) >= html_text.MIN_PAGES:
            groups[tuple(sorted(vector.items()))].add(t)
    words = {e.token: max(1, len((e.text or "").split())) for _, _, page in rows for e in html_text.events(page)}
    want = {frozenset(g) for v, g in groups.items() if sum(words[t] for t in g) >= html_text.MIN_CLASS}
    found = html_text.Template(np.array(html_text.templates(html_text.with_host(pages)).first()["packed"]))
    mine = {frozenset(t for t, x in found.of.items() if x[0] == k) for k in range(len(found.wide))}
    texts = {e.token for _, _, page in rows for e in html_text.events(page) if e.text is not None}
    assert mine == {g for g in want if g & texts or g == max(want, key=lambda g: (len(of[next(iter(g))]), len(g)))}


def test_html_without_article():
    menu = '<nav><a href="/">home</a></nav><div class="sidebar">about us</div>'
    cases = {
        "<div id=content><section><p>one two three</p></section><section><p>four five six seven</p></section></div>": "one two three\nfour five six seven",
        "<h1>title</h1><div class=a><p>first part</p></div><div class=b><p>the second part is longer</p></div>": "title\nfirst part\nthe second part is longer",
        "<div><p>short</p><ul><li>a long list item</li><li>another long list item</li></ul><p>end</p></div>": "short\na long list item\nanother long list item\nend",
        "<div><p>text around it</p><p><a href=x>a paragraph that is mostly link</a> so</p></div>": "text around it\na paragraph that is mostly link so",
        "<div><table><tr><td>cell one</td><td>cell two</td></tr></table><p>x</p></div>": "cell one\ncell two\nx",
    }
    for body, want in cases.items():
        assert html_text.extract(f"<html><head><title>t</title></head><body>{menu}{body}<footer>foot</footer></body></html>", None) == want


# ---- 2, licences


def dice_by_force(text, templates, least):
    words = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    pairs = list(zip(words, words[1:]))
    best = {}
    for name, texts in templates.items():
        for t in texts:
            w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", t.lower())
            want = collections.Counter(zip(w, w[1:]))
            b = sum(want.values())
            for i in range(len(pairs)):
                for j in range(i + 1, len(pairs) + 1):
                    common_ = sum((collections.Counter(pairs[i:j]) & want).values())
                    score = 2 * common_ / (j - i + b)
                    if score >= least and score > best.get(name, 0) + 1e-12:
                        best[name] = score
    return best


def test_licenses(spark, odd, none):
    rng = random.Random(12)
    templates = {"A": ["one two three four five six seven", "one two"], "B": ["one two three four five six eight nine ten"], "C": ["the same the same the same word"]}
    pool = "one two three four five six seven eight nine ten the same word x y".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(60)] + ["x One, two three four FIVE six seven! y", "the same the same the same word", None, "", "one"]
    scanner = licenses.Scanner(templates)
    for text, found in zip(texts, scanner.scan(pa.array(texts, type=pa.string()))):
        want, got = dice_by_force(text, templates, 0.8), {n: d for n, d, _, _ in found}
        assert set(got) <= set(want) and all(math.isclose(got[n], want[n]) for n in got)
        if want:  # what is left out meets a better one
            assert math.isclose(max(got.values()), max(want.values()))
    docs = spark.createDataFrame(rows_of(["intro. Released under the MIT License. more", "This work is licensed under the GNU General Public License, version 3.", None]), SCHEMA)
    assert {(r["doc_id"], r["license"], r["dice"]) for r in licenses.scan(docs).collect()} == {(0, "MIT", 1.0), (1, "GPL-3.0", 1.0)}
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == 0


def test_licenses_of_one_family():
    two = "This work is licensed under the GNU General Public License, version 2."
    three = "This work is released under the GNU General Public License, version 3."
    filler = " ".join(f"word{k}" for k in range(60))
    lesser = [licenses.TEMPLATES[x][0] for x in ("LGPL-3.0", "AGPL-3.0")] + [licenses.TEMPLATES["GPL-3.0"][1]]
    bsd = [licenses.TEMPLATES["BSD-2-Clause"][0], licenses.TEMPLATES["BSD-3-Clause"][1]]
    altered = [" ".join(w if k % 40 != 20 else "altered" for k, w in enumerate(x.split())) for x in lesser]
    texts = [f"{two} {filler} {three}", f"{two} {three}", f"{three} {two}", f"{two} {filler} {two} {filler} {two}", f" {filler} ".join(lesser), f" {filler} ".join(altered), f"{bsd[0]} {filler} {bsd[1]}"]
    got = [{n: (round(d, 3), s) for n, d, s, _ in x} for x in licenses.Scanner(licenses.TEMPLATES).scan(pa.array(texts))]
    assert got[0] == {"GPL-2.0": (1.0, 0), "GPL-3.0": (0.818, 72)}
    assert got[1] == {"GPL-2.0": (1.0, 0), "GPL-3.0": (0.818, 12)}
    assert got[2] == {"GPL-2.0": (1.0, 12), "GPL-3.0": (0.818, 0)}
    assert got[3] == {"GPL-2.0": (1.0, 0)}  # every notice counts, reported or not
    assert set(got[4]) == set(got[5]) == {"LGPL-3.0", "AGPL-3.0", "GPL-3.0"}
    assert got[6]["BSD-2-Clause"] == (1.0, 0) and got[6]["BSD-3-Clause"] == (1.0, len(re.findall(r"\w+", bsd[0])) + 60)


# ---- 4, token counts


def best_split(word, pieces):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        spelt = len(word[end - 1].encode("utf-8"))
        options = [(best[end - 1][0] + token_counts.BYTE_SCORE * spelt, -(best[end - 1][1] + spelt))]
        options += [(best[s][0] + pieces[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in pieces]
        score, n = max(options)
        best.append((score, -n))
    return best[-1][1]


@pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="no vocabulary")
def test_token_counts(odd, odd_texts, none):
    pieces = token_counts.vocabulary()
    got = by_id(token_counts.counts(odd))
    for i, t in enumerate(odd_texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[i]["n_pretokens"] == len(words)
        if all(len(w) < 300 for w in words) and len(words) < 500:
            assert got[i]["n_tokens"] == sum(best_split(token_counts.MARK + w, pieces) for w in words)
    assert token_counts.counts(none).count() == 0


def test_trie_by_force():
    rng = random.Random(13)
    pieces = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))): -rng.random() * 5 for _ in range(30)}
    words = {"".join(rng.choice("abéz") for _ in range(rng.randrange(0, 9))) for _ in range(300)}
    assert dict(token_counts.split_counts(words, pieces, max(map(len, pieces)))) == {w: best_split(w, pieces) for w in words}


def test_token_counts_as_a_unigram_tokenizer(spark):
    """A model given as a parameter, against the splits of a public implementation."""
    from tokenizers import Tokenizer, models

    rng = random.Random(23)
    letters = "abcde"
    pieces = {token_counts.MARK: -6.0} | {c: -7.0 - rng.random() for c in letters}
    pieces |= {"".join(rng.choice(letters + token_counts.MARK * (k == 0)) for k in range(rng.randrange(2, 5))): -rng.random() * 6 for _ in range(60)}
    tokenizer = Tokenizer(models.Unigram([("<unk>", -100.0), *pieces.items()], 0, False))
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    got = by_id(token_counts.counts(spark.createDataFrame(rows_of(texts), SCHEMA), pieces))
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == sum(len(tokenizer.encode(token_counts.MARK + w).tokens) for w in t.split())


# ---- 6, site quality


def test_site_quality(spark, odd, none, labels):
    good = "This is a plain sentence about things. It goes on for a while, and then it ends. "
    rows = []
    for i in range(400):
        host = "clean" if i % 2 else "dirty"
        bad = i % 2 == 0 and i % 8 != 0
        rows.append((i, "### $$$ %%% *** &&& " * 10 + str(i) if bad else good * 3 + str(i), host, f"p{i % 3}", bad))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, source string, path string")
    lab = spark.createDataFrame([(r[0], int(not r[4]), 0) for r in rows[::3]], "doc_id bigint, quality int, toxic int")
    got = site_quality.scores(docs, lab, F.col("source"), F.col("path")).collect()
    assert all(r["kept"] == (not rows[r["doc_id"]][4]) for r in got)
    one = {rows[r["doc_id"]][2]: r["host_posterior"] for r in got}
    assert one["clean"] > one["dirty"] + 0.3
    out = site_quality.scores(odd, labels, F.col("source"), F.col("lang"))
    assert out.count() == odd.count() and out.where("score is null").count() == 0
    assert site_quality.scores(none, labels, F.col("source"), F.col("lang")).count() == 0
    assert site_quality.scores(odd, labels.limit(0), F.col("source"), F.col("lang")).count() == odd.count()


def test_large_classes_by_broadcast_or_join(spark, monkeypatch):
    """A class of over CLUSTER rows gets the same ids from the broadcast as from the join, and loses no row."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text) for i in range(300)] + [(1000 + i, f"{text} tail{i}") for i in range(230)] + [(2000, None), (2001, "other words that stand alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_duplicates.assign(docs).orderBy("doc_id").collect()]
    monkeypatch.setattr(near_duplicates, "BROADCAST_CLUSTERS", -1)
    assert [tuple(r) for r in near_duplicates.assign(docs).orderBy("doc_id").collect()] == got
    assert got == [(i, 0, 530) for i, _ in rows[:530]] + [(2000, 2000, 1), (2001, 2001, 1)]
