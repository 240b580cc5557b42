"""Unicode forms as expressions against the plain functions: every character, and texts of odd ones."""

import random
import sys

import pytest
from deltaspan.functions import text as X
from pyspark.sql import functions as F

FORMS = {"norm": (X.norm_text, X.norm_py), "nfkc": (X.nfkc, X.nfkc_py), "match_key": (X.match_key, X.match_key_py), "core": (X.core, X.core_py)}
ODD = list("\x1c\x1d\x00\\\t\n\x0b\x0c\r \x85\xa0　​́ͅßœŒ“”ﬁİΣσςÅé각각ｶﾞ①㎏ﷺǅŉ…ཱིো😀☀️￿中A_1-'")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = ["", "plain ascii TEXT  with\tblanks \n", "Straße “Œuvre”　ΑΣ ΑΣΑ", *ODD, *[a + b for a in ODD for b in ODD]]
    out += ["".join(rng.choice(ODD) for _ in range(rng.randrange(2, 12))) for _ in range(3000)]
    every = [chr(k) for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000]
    out += ["|" + "|".join(every[i : i + 400]) + "|" for i in range(0, len(every), 400)]
    out += ["x" + "xy".join(c for c in every[i : i + 400] if X._table(X._single_norm)[0].find(c) < 0) for i in range(0, len(every), 400)]
    return out


def test_forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = df.select("i", *[f(F.col("t")).alias(name) for name, (f, _) in FORMS.items()]).collect()
    assert len(got) == len(texts)
    for r in got:
        for name, (_, plain) in FORMS.items():
            assert r[name] == plain(texts[r["i"]]), (name, ascii(texts[r["i"]])[:200])


def test_simple_texts(spark):
    """Null texts are empty; texts whose characters the tables know don't reach Python but as nulls."""
    row = spark.createDataFrame([(None,)], "t string").select(*[f(F.col("t")).alias(name) for name, (f, _) in FORMS.items()]).first()
    assert tuple(row) == ("", "", "", "")
    seen = [X._table(form) for form in (X._single_norm, X._single_nfkc, X.match_key_py, X.core_py)]
    for have, become in seen:
        odd = {c for c, b in zip(have, become) if b == X.ODD}
        assert "́" in odd and not odd & set("abcÄéñ中。，ＡＢ！？　")
