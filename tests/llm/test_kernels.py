import collections
import random
import re

import numpy as np
import pyarrow as pa
from deltaspan.llm import kernels as K


def plain(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, copies = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), copies, len(cover)


def grams(x):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (x or "").lower())
    return collections.Counter(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_features(odd_texts):
    rng = random.Random(1)
    texts = [*odd_texts, *["".join(rng.choice("ab\n #é\x1c ") for _ in range(rng.randrange(60))) for _ in range(200)]]
    got = K.features(pa.array(texts, type=pa.string()))
    assert list(zip(*(got[k].tolist() for k in K.FEATURES[:5]))) == [plain(t) for t in texts]


def test_shingles(odd_texts):
    full, at, _ = K.shingles(pa.array(odd_texts, type=pa.string()))
    value, count, off = K.multisets(full, at)
    want = [grams(t) for t in odd_texts]
    assert np.diff(at).tolist() == [sum(g.values()) for g in want]
    assert [sorted(count[a:b].tolist()) for a, b in zip(off[:-1], off[1:])] == [sorted(g.values()) for g in want]
    # equal shingles of different texts have equal hashes, others don't
    assert len(np.unique(full)) == len(set().union(*want))


def test_chunks_do_not_matter(odd_texts, monkeypatch):
    texts = pa.array(odd_texts, type=pa.string())
    whole = K.features(texts)
    monkeypatch.setattr(K, "CHUNK_BYTES", 100)
    parts = [K.features(texts.slice(a, b - a)) for a, b in K.chunks(texts)]
    assert len(parts) > 3
    for k in K.FEATURES:
        assert np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist()


def test_weighted_signatures():
    """Registers agree with the probability of the weighted Jaccard similarity, for counts of any size."""
    rng = np.random.default_rng(0)
    for _ in range(4):
        a = dict(zip(rng.integers(1, 2**62, 50).tolist(), rng.integers(1, 40, 50).tolist()))
        b = {k: max(1, int(w * rng.uniform(0.3, 1.6))) for k, w in a.items()}
        sign = lambda d: K.poisson_signatures(np.array(list(d), dtype=np.uint64), np.array(list(d.values())), np.array([0, len(d)]), 4096)[0]
        common = sum(min(a[k], b[k]) for k in a)
        true = common / (sum(a.values()) + sum(b.values()) - common)
        assert abs((sign(a) == sign(b)).mean() - true) < 5 * np.sqrt(true * (1 - true) / 4096)
    empty = K.poisson_signatures(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.array([0, 0]), 8)
    assert empty.tolist() == [[0] * 8]


def test_minimum_signatures():
    a, b = np.arange(1, 101, dtype=np.uint64) * np.uint64(977), np.arange(51, 151, dtype=np.uint64) * np.uint64(977)
    sig = K.minimum_signatures(np.concatenate([K.mix(a), K.mix(b)]), np.array([0, 100, 200, 200]), 2048)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.06 and (sig[2] == 0xFFFFFFFF).all()
