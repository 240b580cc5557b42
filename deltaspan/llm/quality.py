"""Quality rules as weak supervision: rules vote or abstain, EM learns how far to trust each, a posterior decides.

A word is a maximal run of anything but the six ASCII blanks. Every count is exact over the whole text; a null text
has no words. Texts that fail the base rule (fewer than ten words, or more than a fifth of the words in repeated
five-word windows) are rejected outright, the others are kept if the posterior of good quality is at least 0.5.

Each rule casts a strong or a weak vote against a text, vouches for it, or abstains, which counts as not seen. Texts are
good or bad, and each of the two has chances of its own for every vote of every rule. All rules start alike, a little
better than guessing, with a weak prior that no rule does worse than chance; EM over all texts that pass the base rule
learns the share of bad texts and every rule's chances, in which rules that blame the same texts find each other: where
several agree, each of their votes counts much, and a rule whose votes come alone counts little. A verdict is thus what
the rules' agreement makes of it, not how strongly a single rule is meant.

Repeated rows get equal verdicts; an empty table gives an empty result. Only doc_id and text are read; extra columns,
whatever their names, are passed through by ``keep_good`` and ignored by ``verdicts``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh
from .kernels import FEATURES, chunks, features

_TYPE = "struct<" + ",".join(f"{k}:bigint" for k in FEATURES) + ">"


def _counts(texts: pa.Array) -> pa.Array:
    parts = [features(texts.slice(a, b - a)) for a, b in chunks(texts)]
    whole = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in FEATURES]
    return pa.StructArray.from_arrays([pa.array(x, type=pa.int64()) for x in whole], names=list(FEATURES))


def counts(text: Column) -> Column:
    """The shape counts of a text, as a struct."""

    def run(texts: pa.Array) -> pa.Array:
        return _counts(texts)

    return F.arrow_udf(run, _TYPE).asNondeterministic()(text)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


ABSTAINS, STRONG, WEAK, VOUCHES = range(4)
#: Chances of a strong, a weak and a vouching vote, of any rule, for good and for bad texts, and the share of good ones: where EM
#: starts. They are so near each other that they decide nothing; they only say which class is the bad one.
GOOD, BAD, GOOD_SHARE = (0.03, 0.07, 0.9), (0.06, 0.1, 0.84), 0.9
#: How many texts the prior counts for, as a share of all.
WEIGHT = 0.02


def rules(c: Column) -> list[tuple[str, Column]]:
    """Name and vote of each rule."""
    n = F.greatest(c["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(c["n_lines"], F.lit(1)).cast("double")
    letters = F.greatest(c["n_letters"], F.lit(1)).cast("double")

    def vote(strong: Column, weak: Column, good: Column) -> Column:
        return F.when(strong, STRONG).when(weak, WEAK).when(good, VOUCHES).otherwise(ABSTAINS)

    long, symbols, mean = c["n_words"], c["n_symbols"] / n, c["word_chars"] / n
    copies, upper, repeats = c["n_dup_lines"] / lines, c["n_upper"] / letters, c["n_repeat_words"] / n
    ends, digits, width = c["n_stops"] / n, c["n_digits"] / F.greatest(c["word_chars"], F.lit(1)), n / lines
    prose, marked = long >= 50, c["n_symbol_words"] / n
    return [
        ("symbols", vote(symbols > 0.25, symbols > 0.05, symbols <= 0.02)),
        ("word_length", vote((mean < 2.5) | (mean > 12), (mean < 3.5) | (mean > 7), mean.between(3.8, 6.5))),
        ("digits", vote(digits > 0.3, digits > 0.1, digits <= 0.02)),
        ("sentences", vote(prose & ((ends < 0.002) | (ends > 0.6)), prose & ((ends < 0.01) | (ends > 0.35)), prose & ends.between(0.03, 0.2))),
        ("line_copies", vote(copies > 0.5, copies > 0.3, (c["n_lines"] >= 3) & (copies <= 0.05))),
        ("repeats", vote(repeats > 0.5, repeats > 0.15, (long >= 20) & (repeats <= 0.03))),
        ("capitals", vote(upper > 0.5, upper > 0.2, upper <= 0.1)),
        ("length", vote(long < 10, long < 14, long >= 30)),
        ("symbol_words", vote(marked > 0.2, marked > 0.05, marked <= 0.01)),
        ("line_length", vote(width < 2, width < 3, width >= 8)),
    ]


def pattern(c: Column) -> Column:
    """The votes of all rules as one number in base 4."""
    code = F.lit(0)
    for _, v in reversed(rules(c)):
        code = code * 4 + v
    return code.cast("int")


def start(n_rules: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of good and bad texts, and the chances of the three votes by class and rule, before anything is learnt."""
    return np.array([GOOD_SHARE, 1 - GOOD_SHARE]), np.stack([np.tile(GOOD, (n_rules, 1)), np.tile(BAD, (n_rules, 1))])


def posterior(votes: np.ndarray, share: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Of each pattern, the probabilities of good and bad; an abstention says nothing."""
    seen = np.stack([votes == v for v in (STRONG, WEAK, VOUCHES)], axis=2).astype(np.float64)
    logs = np.einsum("prv,krv->pk", seen, np.log(chance)) + np.log(share)
    out = np.exp(logs - logs.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def fit(votes: np.ndarray, count: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, dict]:
    """EM over patterns of votes with their counts: the posterior of good for each, and the model.

    A rule that would blame good texts more often than bad ones gets the same chances for both, and so no say. As the
    weight of the prior grows with the texts, more texts of the same sorts change nothing.
    """
    prior, first = start(votes.shape[1])
    seen = np.stack([votes == v for v in (STRONG, WEAK, VOUCHES)], axis=2).astype(np.float64)
    weight = WEIGHT * count.sum() * prior
    share, chance, post = prior.copy(), first.copy(), np.full((len(votes), 2), -1.0)
    for _ in range(rounds):
        new = posterior(votes, share, chance)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        held = post * count[:, None]
        sums = np.einsum("pk,prv->krv", held, seen) + weight[:, None, None] * first
        chance = sums / sums.sum(axis=2, keepdims=True)
        blames = chance[:, :, STRONG - 1] + chance[:, :, WEAK - 1]
        both = sums.sum(axis=0) / sums.sum(axis=(0, 2))[:, None]
        chance = np.where((blames[1] < blames[0])[None, :, None], both, chance)
        share = held.sum(axis=0) + weight
        share /= share.sum()
    return posterior(votes, share, chance)[:, 0], {"share": share, "chance": chance}


def posteriors(votes: DataFrame, column: str) -> DataFrame:
    """(pattern, posterior) of all patterns present: 4 to the number of rules at most, 1,048,576, whatever the input."""
    n_rules = len(rules(F.lit(None)))
    seen = votes.groupBy(F.col(column).alias("pattern")).count().collect()
    seen = sorted((r["pattern"], r["count"]) for r in seen)
    codes, n = np.array([x for x, _ in seen], dtype=np.int64), np.array([x for _, x in seen], dtype=np.float64)
    post, _ = fit((codes[:, None] // 4 ** np.arange(n_rules)) % 4, n) if seen else (np.zeros(0), {})
    rows = [(int(c), float(p)) for c, p in zip(codes, post, strict=True)]
    return votes.sparkSession.createDataFrame(rows, "pattern int, posterior double")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, posterior (0 where the base rule rejects) and kept, for every row."""
    c = docs.select("doc_id", counts(F.col("text")).alias("c"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    seen = cut(c.select("doc_id", *[F.col("c")[k].alias(k) for k in base], base_failed(F.col("c")).alias("base_failed"), pattern(F.col("c")).alias("pattern")))
    out = seen.join(F.broadcast(posteriors(seen.where("not base_failed"), "pattern")), "pattern", "left")
    post = F.when(F.col("base_failed"), F.lit(0.0)).otherwise(F.col("posterior"))
    return out.select("doc_id", *base, "base_failed", (post >= 0.5).alias("kept"), F.round(post, 6).alias("posterior"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows with a good verdict, all columns as they were. Reads the texts twice rather than keep them."""
    c, code = fresh("c"), fresh("p")
    model = posteriors(docs.select(counts(F.col("text")).alias("c")).where(~base_failed(F.col("c"))).select(pattern(F.col("c")).alias("p")), "p")
    model = model.where("posterior >= 0.5").select(F.col("pattern").alias(code))
    marked = docs.withColumn(c, counts(docs["text"]))
    marked = marked.where(~base_failed(F.col(c))).withColumn(code, pattern(F.col(c)))
    return marked.join(F.broadcast(model), code, "left_semi").select(*[F.col(f"`{x}`") for x in docs.columns])


#: The columns of verdicts that are counts, and the base rule.
BASE_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: These by brute force.
ORACLE_BASE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, g FROM g GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT DISTINCT g.r, unnest(range(i, i + 5)) AS p FROM g JOIN twice ON g.r = twice.r AND g.g = twice.g),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(c.n, 0) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words
      FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN n ON n.r = d.r)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x
"""
