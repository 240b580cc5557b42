"""Sites that matter: hosts and paths of different quality, documents whose own evidence is weak, labels held out."""

import random

import numpy as np
import pytest
from deltaspan.llm import site_quality
from pyspark.sql import functions as F

from .conftest import prose


@pytest.fixture(scope="module")
def made(spark):
    """Documents of good, bad and mixed hosts; a bad one has symbols a little more often than a good one, whatever its host."""
    rng = random.Random(17)
    share = {"good.example": 0.97, "bad.example": 0.06, "large.example": 0.9, None: 0.6}
    share |= {f"h{k}.example": (0.95, 0.1)[k % 2] for k in range(12)}
    rows = []
    for host, good in share.items():
        for i in range(900 if host == "large.example" else 160):
            path = f"/{i % 4}" if i % 9 else None
            # a part of the large host is as bad as the rest of it is good
            p = 0.05 if host == "large.example" and path == "/3" else good
            label = int(rng.random() < p)
            words = prose(rng, 60).split()
            if rng.random() < (0.3 if label else 0.55):
                words = [w + ("##" if rng.random() < 0.3 else "") for w in words]
            rows.append((len(rows), " ".join(words) + ".", host, path, label))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string, truth int").withColumns({"score": F.lit(9.0), "p": F.lit("x"), "n": F.lit(1)})
    labels = docs.where("pmod(hash(doc_id), 3) = 0").select("doc_id", F.col("truth").alias("quality"))
    return docs.repartition(5).cache(), labels


def test_sites_decide(made):
    """Verdicts flip by host and by path, both ways, and are right more often, and better calibrated, than own evidence."""
    docs, labels = made
    out = site_quality.scores(docs, labels, F.col("host"), F.col("path")).join(docs.select("doc_id", "host", "path", "truth"), "doc_id")
    got = out.join(labels.select("doc_id"), "doc_id", "left_anti").toPandas()  # held out
    own, site = got.own_probability >= 0.5, got.kept
    right, alone = (site == (got.truth == 1)).mean(), (own == (got.truth == 1)).mean()
    assert len(got) > 2000 and right > alone + 0.15 and right > 0.85
    assert ((~own) & site).sum() > 100 and (own & ~site).sum() > 100
    loss = lambda p: -np.mean(np.where(got.truth == 1, np.log(np.clip(p, 1e-6, 1)), np.log(np.clip(1 - p, 1e-6, 1))))
    assert loss(got.score) < 0.8 * loss(got.own_probability)
    # the bad part of a good host
    part = got[got.host == "large.example"]
    worst, rest = part[part.path == "/3"], part[part.path == "/1"]
    assert worst.path_posterior.mean() < worst.host_posterior.mean() - 0.02 and worst.score.mean() < rest.score.mean() - 0.1
    # without a host or a path the level above counts
    assert np.allclose(got[got.path.isna()].path_posterior, got[got.path.isna()].host_posterior)
    assert got[got.host.isna()].host_posterior.nunique() == 1


def test_sites_by_hand(made):
    """Posteriors of some documents by their definition: sums of logarithms over the other documents of the site, each possible share."""
    docs, labels = made
    _, _, prior = site_quality.fit(docs, labels)
    got = site_quality.scores(docs, labels, F.col("host"), F.col("path")).join(docs.select("doc_id", "host", "path"), "doc_id").toPandas()
    e = np.log(got.own_probability / (1 - got.own_probability)) - prior
    assert np.abs(e).max() < site_quality.LARGEST
    shares = site_quality.SHARES
    logs = np.log(shares[None, :] * np.exp(e.to_numpy())[:, None] + 1 - shares[None, :])
    mean = site_quality.peak(logs.sum(axis=0).tolist())
    assert got[got.host.isna()].host_posterior.iloc[0] == pytest.approx(mean)

    def beta(centre, strength):
        w = shares ** (strength * centre - 1) * (1 - shares) ** (strength * (1 - centre) - 1)
        return w / w.sum()

    def fitting(groups):  # (sums of logarithms, centre of the prior)
        return max(site_quality.STRENGTHS, key=lambda a: (round(sum(x.max() + np.log((beta(c, a) * np.exp(x - x.max())).sum()) for x, c in groups), 6), a))

    def after(x, centre, strength):
        w = beta(centre, strength) * np.exp(x - x.max())
        return (w * shares).sum() / w.sum()

    hosts = {h: logs[(got.host == h).to_numpy()].sum(axis=0) for h in got.host.dropna().unique()}
    a_host = fitting([(x, mean) for x in hosts.values()])
    paths = {k: logs[g.index.to_numpy()].sum(axis=0) for k, g in got.dropna(subset=["host", "path"]).groupby(["host", "path"])}
    a_path = fitting([(x, after(hosts[h], mean, a_host)) for (h, _), x in paths.items()])
    assert a_host < site_quality.STRENGTHS[-1]  # hosts differ
    for i in range(0, len(got), 97):
        r = got.iloc[i]
        h = after(hosts[r.host] - logs[i], mean, a_host) if r.host is not None else mean
        p = after(paths[r.host, r.path] - logs[i], h, a_path) if r.host is not None and r.path is not None else h
        assert r.host_posterior == pytest.approx(h, abs=1e-9) and r.path_posterior == pytest.approx(p, abs=1e-9)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(e[i] + np.log(p / (1 - p))))), abs=1e-9)


def test_sites_odd(spark, made):
    """A table of rows without hosts beside one large host, repeated rows, and no labels at all."""
    docs, labels = made
    rows = docs.where("host is null or host = 'large.example'")
    rows = rows.unionByName(rows.limit(50))
    out = site_quality.scores(rows, labels, F.col("host"), F.col("path"))
    assert out.count() == rows.count() and out.where("score is null or kept is null").count() == 0
    assert site_quality.scores(rows, labels.limit(0), F.col("host"), F.col("path")).select("own_probability").distinct().count() == 1
