"""Byte-pair encoding of whole texts by a backtracking search, and decoding by an offset table.

A token sequence is the one that the merges give if, and only if, each token is what the merges make of its own symbols
and each two neighbours are *compatible*: no merge across their border comes before the merges that form them. So a word
is read from the left: an Aho-Corasick automaton over all tokens finds the longest that starts at a place; where it isn't
compatible with the token before, the longest shorter token that it begins with is tried, and where none is left, the
last token is taken back and its place is marked. For each prefix only one sequence is valid, so that each place is reached once: time is linear in the word.
Compatible pairs are found by undoing the merges of both sides, latest first, and are remembered.

The tokenizer is a parameter: the path of a file of the public ``tokenizers`` library with a BPE model, byte-level
symbols and an end-of-word mark. It is read on the driver and broadcast, bounded by its file. Texts are cut at the six
ASCII blanks, which no token crosses; each distinct piece is normalised (composed, lower-cased), split into words and
encoded once, and remembered up to CACHE pieces, which changes no result. Pieces with characters outside of the ranges
in _SETTLED, where versions of Unicode differ, are normalised and split by the file's own rules. Special tokens in a
text are what the library makes of them.

Null and empty texts have no tokens and decode to an empty text; very long texts and words are read whole; repeated rows
are encoded alike; an empty table gives an empty result; only doc_id and text are read, whatever the other columns' names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: Remembered at most: distinct pieces, words and pairs of tokens.
CACHE = 1 << 18
#: Tokens that are decoded at once.
BLOCK = 1 << 18
#: Characters whose case, composition and class are the same in all versions of Unicode at hand.
_SETTLED = regex.compile(r"[\u0000-՗ -⁤　-〿ぁ-ゖ゠-ヿ一-龥가-힣]*")
_BLANKS, _INNER = regex.compile(r"\s+"), regex.compile(r"[^\S\n]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Tokenizer:
    """Tables of a tokenizer file. Tokens have numbers of their own here: symbols first, then merges in their order."""

    def __init__(self, source: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer as Library

        file = json.loads(source)
        model, pre = file["model"], file["pre_tokenizer"]["pretokenizers"]
        unlike = [k for k in ("continuing_subword_prefix", "unk_token", "dropout") if model.get(k)] + [k for k in ("post_processor", "decoder") if file.get(k)]
        if model["type"] != "BPE" or unlike or not model["end_of_word_suffix"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
            raise ValueError(f"not a byte-level BPE file with ends of words: {unlike}")
        self.rules = Library.from_str(source)
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
        self.lines = regex.compile(rf"\n|{pre[0]['pattern']['Regex']}")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = _byte_symbols()
        # a symbol is a byte within a word or at its end; as text, the bytes are the first 512 code points
        names = [*symbols, *[s + end for s in symbols]]
        number = {name: i for i, name in enumerate(names)}
        self.text = [chr(i) for i in range(512)]
        self.left, self.right, self.pair = [-1] * 512, [-1] * 512, {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            number[a + b] = new = len(names)
            names.append(a + b)
            a, b = number[a], number[b]
            self.left.append(a)
            self.right.append(b)
            self.pair[a, b] = new
            self.text.append(self.text[a] + self.text[b])
        self.id = [vocab[name] for name in names]
        own = [True] * 512  # tokens that the merges make of their own symbols
        for i in range(512, len(names)):
            a, b = self.left[i], self.right[i]
            own.append(own[a] and own[b] and self._free(a, b, i))
        self.automaton = ahocorasick.Automaton()
        for i, text in enumerate(self.text):
            if own[i]:
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.size = [len(text) for text in self.text]
        # of each token, the longest shorter one that it begins with
        known = {text: i for i, text in enumerate(self.text) if own[i]}
        self.shorter = [next((known[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in known), -1) for text in self.text]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}

    def _free(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge below ``limit`` crosses the border of two tokens while they are formed; the left of equal merges goes first."""
        while True:
            if (m := self.pair.get((a, b))) is not None and m < limit:
                return False
            if a > b:
                if a < 512:
                    return True
                limit, a = a, self.right[a]
            else:
                if b < 512:
                    return True
                limit, b = b + 1, self.left[b]

    def _fits(self, a: int, b: int) -> bool:
        if (known := self.compatible.get(a << 32 | b)) is None:
            if len(self.compatible) >= CACHE:
                self.compatible.clear()
            known = self.compatible[a << 32 | b] = self._free(a, b, len(self.id))
        return known

    def word(self, word: str) -> list[int]:
        """Ids of a word."""
        data = word.encode()
        text = data[:-1].decode("latin-1") + chr(256 + data[-1])
        # the longest token at each place, one after another: often these are it already
        taken = [token for _, token in self.automaton.iter_long(text)]
        known, last = self.compatible.get, taken[0]
        for i in range(1, len(taken)):
            token = taken[i]
            if not (fits if (fits := known(last << 32 | token)) is not None else self._fits(last, token)):
                self._search(text, taken, i)
                break
            last = token
        id_ = self.id
        return [id_[token] for token in taken]

    def _search(self, text: str, taken: list[int], i: int) -> None:
        """Completes the first i tokens, which fit."""
        known, size, shorter, longest = self.compatible.get, self.size, self.shorter, self.automaton.iter_long
        at, end = sum([size[token] for token in taken[:i]]), len(text)
        token = shorter[taken[i]]  # the next to be tried at this place
        del taken[i:]
        last = taken[-1]
        spent: set[int] = set()  # places from which the rest can't be encoded
        while at < end:
            while token >= 0:
                if at + size[token] not in spent and (last < 0 or (fits if (fits := known(last << 32 | token)) is not None else self._fits(last, token))):
                    break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                last = token
                at += size[token]
                if at < end:
                    token = next(longest(text, at))[1]
            else:
                spent.add(at)
                last = taken.pop()
                at -= size[last]
                token, last = shorter[last], taken[-1] if taken else -1

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if _SETTLED.fullmatch(text):
            return self.pattern.findall(_normal(_BLANKS.sub(" ", text)))
        text = self.rules.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.rules.pre_tokenizer.pre_tokenize_str(text)]

    def ids_of(self, words: list[str]) -> list[int]:
        out: list[int] = []
        for word in words:
            if (ids := self.words.get(word)) is None:
                if len(self.words) >= CACHE:
                    self.words.clear()
                ids = self.words[word] = self.word(word)
            out += ids
        return out

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of texts without ASCII blanks."""
        out: list[list[int]] = [[]] * len(pieces)
        plain, text = list(range(len(pieces))), "\n".join(pieces)
        if self.specials.search(text) or not _SETTLED.fullmatch(text):
            plain = []
            for i, piece in enumerate(pieces):
                if self.specials.search(piece):
                    parts = self.specials.split(piece)  # every other one is special
                    out[i] = [x for k, part in enumerate(parts) for x in ([self.special[part]] if k % 2 else self.ids_of(self.split(part)))]
                elif _SETTLED.fullmatch(piece):
                    plain.append(i)
                else:
                    out[i] = self.ids_of(self.split(piece))
            text = "\n".join([pieces[i] for i in plain])
        # the plain ones are split together, a line each
        lines, own = iter(plain), []
        for word in self.lines.findall(_normal(_INNER.sub(" ", text))):
            if word == "\n":
                out[next(lines)] = self.ids_of(own)
                own = []
            else:
                own.append(word)
        if plain:
            out[next(lines)] = self.ids_of(own)
        return out


def _normal(text: str) -> str:
    """Composed and in lower case, letter by letter: a sigma at the end of a word is one like any other."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()


class Names:
    """Decoding: the name of each id with a space after it, one after another, and where each begins."""

    def __init__(self, source: str) -> None:
        file = json.loads(source)
        names = file["model"]["vocab"] | {t["content"]: t["id"] for t in file["added_tokens"]}
        by_id = [b""] * (1 + max(names.values()))
        for name, i in names.items():
            by_id[i] = name.encode() + b" "
        self.names, self.offset = np.frombuffer(b"".join(by_id), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in by_id])])
        digits = [b"%d " % i for i in range(len(by_id))]
        self.digits, self.digits_offset = np.frombuffer(b"".join(digits), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in digits])])

    def texts(self, ids: np.ndarray, at: np.ndarray, numbers: bool = False) -> Iterator[bytes]:
        """The names, or the numbers themselves, of each row's ids with a space between them."""
        if ids.size and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.offset) - 1:
            raise ValueError("ids that the tokenizer doesn't have")
        names, offset = (self.digits, self.digits_offset) if numbers else (self.names, self.offset)
        a = 0
        while a < len(at) - 1:  # some BLOCK tokens at once, and a longer row alone
            b = max(a + 1, int(np.searchsorted(at, at[a] + BLOCK, side="right")) - 1)
            part = ids[at[a] : at[b]]
            size = offset[part + 1] - offset[part]
            data = names[_places(offset[part], size)].tobytes()
            end = np.concatenate([[0], np.cumsum(size)])[at[a : b + 1] - at[a]].tolist()
            yield from (data[i : max(i, j - 1)] for i, j in zip(end[:-1], end[1:], strict=True))
            a = b


class Pieces:
    """Numbers of the pieces of texts, and the ids of each: those of piece i are ids[at[i] : at[i + 1]]."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def learn(self, pieces: Iterable[bytes]) -> None:
        if new := [p for p in dict.fromkeys(pieces) if p not in self.number]:
            got = self.tokenizer.pieces([p.decode() for p in new])
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, np.array([i for ids in got for i in ids], dtype=np.int32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(ids) for ids in got])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offset of each text's."""
        pieces = [text.encode().split() if text else [] for text in texts]
        if len(self.number) >= CACHE:
            self.forget()
        flat = [p for own in pieces for p in own]
        self.learn(flat)
        which = np.fromiter(map(self.number.__getitem__, flat), dtype=np.int64, count=len(flat))
        size = self.at[which + 1] - self.at[which]
        ids = self.ids[_places(self.at[which], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.concatenate([[0], np.cumsum([len(own) for own in pieces], dtype=np.int64)])]


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of a size, one run after another."""
    begin = np.cumsum(size) - size
    return np.repeat(start - begin, size) + np.arange(int(size.sum()))


@functools.lru_cache(maxsize=1)
def _pieces(source: str) -> Pieces:
    """Tables are made once in a Python worker."""
    return Pieces(Tokenizer(source))


@functools.lru_cache(maxsize=1)
def _names(source: str) -> Names:
    return Names(source)


def read(path: str = TOKENIZER) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded_py(source: str, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ids of some rows, and the offset of each row's, for chunk after chunk of a batch."""
    for a, b in chunks(texts):
        yield _pieces(source).encode(texts.slice(a, b - a).to_pylist())


def encode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id and ids for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(texts: pa.Array) -> pa.Array:
        lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, type=pa.int32())) for ids, at in encoded_py(sent.value, texts)]
        return pa.concat_arrays(lists) if lists else pa.array([], type=pa.list_(pa.int32()))

    return docs.select("doc_id", F.arrow_udf(run, "array<int>").asNondeterministic()("text").alias("ids"))


def decode(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Rows with ids, and their text as ``decoded``: the tokens' names with a space between them. Null ids are none; unknown ones are an error."""
    sent = rows.sparkSession.sparkContext.broadcast(read(path))

    def run(lists: pa.Array) -> pa.Array:
        lists = lists.fill_null([]) if lists.null_count else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
        return pa.array([x.decode() for x in _names(sent.value).texts(ids, at - at[0])], type=pa.string())

    return rows.withColumn("decoded", F.arrow_udf(run, "string").asNondeterministic()("ids"))


def round_trip(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """n_tokens and digests of the ids and of the text decoded from them, for every row.

    A task encodes and decodes a chunk of texts after another, and hands on digests only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read(path))
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(texts: pa.Array) -> pa.Array:
        n, digests = [], ([], [])
        for ids, at in encoded_py(sent.value, texts):
            n += np.diff(at).tolist()
            for out, numbers in zip(digests, (True, False), strict=True):
                out += [hashlib.sha256(x).hexdigest() for x in _names(sent.value).texts(ids, at, numbers)]
        return pa.StructArray.from_arrays([pa.array(x, type=f.type) for x, f in zip((n, *digests), kind, strict=True)], fields=list(kind))

    got = F.arrow_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>").asNondeterministic()
    return docs.select("doc_id", got("text").alias("r")).select("doc_id", "r.*")
