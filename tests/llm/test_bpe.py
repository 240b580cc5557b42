import hashlib
import json
import os
import random
import unicodedata

import pytest
from deltaspan.llm import bpe
from pyspark.sql import functions as F

if not os.path.exists(bpe.TOKENIZER):
    pytest.skip("no tokenizer files", allow_module_level=True)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.TOKENIZER)
    own.no_truncation()
    own.no_padding()
    return own


@pytest.fixture(scope="module")
def tables():
    return bpe.Tokenizer(bpe.read())


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_words(tables, library):
    rng = random.Random(3)
    for _ in range(3000):
        word = "".join(rng.choice("aeinorstlhd") for _ in range(rng.randrange(1, 16)))
        assert tables.word(word) == ids(library, word)
    for word in ("a" * 3000, "ab" * 1500, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20000))):
        assert tables.word(word) == ids(library, word)


def test_backtracking(library):
    """A small vocabulary in which the longest token first is wrong, held against merges by their definition."""
    file = json.loads(bpe.read())
    merges = [["a", "b"], ["b", "c</w>"], ["ab", "c</w>"], ["b", "c"], ["bc", "a"], ["a", "a"], ["aa", "a"], ["aa", "aa"], ["c", "ab"], ["a", "b</w>"], ["aaa", "a</w>"], ["b", "b"], ["bb", "a"]]
    plain = bpe._byte_symbols()
    names = [*plain, *[s + "</w>" for s in plain], *["".join(m) for m in merges]]
    file["model"] |= {"merges": merges, "vocab": {n: i for i, n in enumerate(names)}}
    file["added_tokens"] = []
    tables = bpe.Tokenizer(json.dumps(file))
    rank = {tuple(m): i for i, m in enumerate(merges)}

    def merged(word):
        own = [*word[:-1], word[-1] + "</w>"]
        while len(own) > 1:
            best = min(range(len(own) - 1), key=lambda i: (rank.get((own[i], own[i + 1]), 99), i))
            if (own[best], own[best + 1]) not in rank:
                break
            own[best : best + 2] = [own[best] + own[best + 1]]
        return own

    rng = random.Random(8)
    greedy = 0
    for _ in range(4000):
        word = "".join(rng.choice("aaabbc") for _ in range(rng.randrange(1, 12)))
        want = [names.index(x) for x in merged(word)]
        assert tables.word(word) == want, word
        greedy += len(want) > 1 and max((n for n in names[512:] if (word[:-1] + word[-1] + "</w>").startswith(n)), key=len, default="") not in ("", names[want[0]])
    assert greedy > 100


def test_characters(tables, library):
    """Each character that is normalised and split here, and texts of odd ones."""
    for k in range(0x110000):
        if not 0xD800 <= k < 0xE000 and bpe._SETTLED.fullmatch(chr(k)):
            text = f"a{chr(k)}!B"
            want, _ = zip(*library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text)))
            assert len(tables.split(text)) == len(want), hex(k)
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(0, 0x560), *range(0x2000, 0x2070), *range(0x3000, 0x3100)]] + list("Ᲊ\U00010940�😀́Σİ\xa0\x85\x1c각각")
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))
        text += rng.choice(["", "<|endoftext|>" + text[:2], "<|startoftext|", "<|endoftext|><|endoftext|>"])
        got, _ = bpe.Pieces(tables).encode([text])
        assert got.tolist() == ids(library, text), ascii(text)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_documents(odd, odd_texts, none, library):
    """Every row against the library: nulls, empty and very long texts and words, repeated rows, clashing names."""
    texts = [*odd_texts, "ΣΑΣ Σ", "<|endoftext|> it's 'S", unicodedata.normalize("NFD", "Übergrößen é"), "Ᲊ\U00010940 x", "\x00\x1c\x85"]
    more = odd.sparkSession.createDataFrame([(i + 100, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text", "score", F.lit(1).alias("ids"), F.lit("x").alias("decoded")).unionByName(more, allowMissingColumns=True)
    got = bpe.round_trip(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == docs.count()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(x := ids(library, r["text"] or "")), digest(" ".join(map(str, x))), digest(library.decode(x, skip_special_tokens=False))) for r in docs.collect())
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got.collect()) == want
    assert bpe.round_trip(none).count() == 0
    back = {r["doc_id"]: r for r in bpe.decode(bpe.encode(more)).collect()}
    assert back[101]["ids"] == [] and back[101]["decoded"] == "" and all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in back.values())


def test_forgetting(tables, library, monkeypatch):
    """Full caches change nothing."""
    monkeypatch.setattr(bpe, "CACHE", 3)
    own = bpe.Pieces(bpe.Tokenizer(bpe.read()))
    rng = random.Random(6)
    for _ in range(20):
        texts = [" ".join(rng.choice(["one", "two", "three's", "four", "fives", "six."]) for _ in range(6)) for _ in range(3)]
        got, at = own.encode(texts)
        assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [ids(library, t) for t in texts]


def test_decode_odd(spark):
    rows = spark.createDataFrame([(1, [0, 49407]), (2, None), (3, []), (4, [49406])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(rows).collect()} == {1: "! <|endoftext|>", 2: "", 3: "", 4: "<|startoftext|>"}
    with pytest.raises(Exception, match="doesn't have"):
        bpe.decode(spark.createDataFrame([(1, [99999])], "doc_id bigint, ids array<int>")).collect()
