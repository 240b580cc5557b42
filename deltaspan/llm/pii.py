"""Personal data by patterns, checksums and context, in SQL functions only.

Regular expressions propose spans, leftmost and non-overlapping per kind; checksums confirm them (Luhn for cards,
mod 97 for IBANs) and words before a span adjust its score. Four base kinds are always reported when valid, whatever
their score: email, ip (parts at most 255), card (12 to 19 digits with Luhn) and phone (9 to 15 digits). The method
adds iban (mod 97), ssn (three, two and four digits, if a word such as "ssn" is near) and secret (a long random token
after a word such as "token" or "password").

Places are code points, ends exclusive. Matches are found with split and regexp_extract_all, which stop at the same
places, so that places are sums of lengths. Possessive quantifiers, anchors at the starts of runs, running sums in
blocks and contexts from the gaps keep the time linear in the text and in its matches. Base spans and valid ibans are
reported whatever their scores, which ``scan`` returns; ssn and secret need a score of MIN_SCORE. Nulls: a null text is empty and has no spans. Repeated rows are treated alike; an empty table
gives an empty result; other columns pass through ``redact`` and are ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, running
from .common import fresh

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
CONTEXT = 40
MIN_SCORE = 0.5
BLOCK = 1024

#: A run starts where no character of its class precedes, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
#: Score of a valid match; what a word in the context adds; the words.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.1}
LIFT = {"email": 0.1, "ip": 0.2, "card": 0.2, "phone": 0.3, "iban": 0.1, "ssn": 0.6, "secret": 0.7}
WORDS = {
    "email": r"mail|contact|write", "ip": r"\bip\b|address|host|server", "card": r"card|visa|credit|payment", "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|account|bank|konto", "ssn": r"ssn|social|security|insurance", "secret": r"token|secret|passw|api.?key|credential|bearer",
}
#: Words that speak against a kind.
AGAINST = {"ip": r"version|release|section", "card": r"order|isbn|serial", "phone": r"order|serial|invoice", "ssn": r"order|serial|invoice"}
#: A part of an ip of at most 255, with any leading zeros; zeros alone are a part too.
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|(?<=0))"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Sum of the digits, every second from the right doubled with its digits added, is divisible by ten."""
    digits = F.transform(F.split(F.reverse(_digits(match)), ""), lambda c: c.cast("int"))
    part = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(part, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _mod97(match: Column) -> Column:
    """Country and check digits behind, letters as two digits from 10: the number leaves 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    values = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"


def _by_kind(rank: Column, of: Callable[[str], Column | None], rest: Column) -> Column:
    """of(kind) for the kind of a rank; ``rest`` where that is None."""
    out = F
    for k, kind in enumerate(KINDS):
        if (value := of(kind)) is not None:
            out = out.when(rank == k, value)
    return out.otherwise(rest)


def _valid(rank: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    test = {
        "ip": match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"), "card": n.between(12, 19) & _luhn(match), "phone": n.between(9, 15),
        "iban": _mod97(match), "secret": match.rlike("[0-9]") & match.rlike("[A-Za-z]"),
    }
    return _by_kind(rank, test.get, F.lit(True))


def _has(kind: str, text: Column) -> Column:
    """Whether a text has a match of a kind; what is cheap comes first."""
    has = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
    if kind in ("ip", "card", "phone", "iban", "ssn"):
        has = has & text.rlike("[0-9]")
    if kind == "secret":
        has = has & F.lower(text).rlike(WORDS["secret"])
    return has & text.rlike(PATTERNS[kind])


def _placed(f: Column) -> Column:
    """The valid spans of a kind, in order, as struct(start, rank, end, kind, score), from rank, matches and gaps."""
    zero = F.lit(0).cast("bigint")
    # a match starts after all earlier matches and the gaps up to its own
    before = running(F.transform(f["match"], lambda m, i: (F.length(m) + F.length(F.get(f["gap"], i))).cast("bigint")), zero, lambda a, x: a + x)
    first = F.array(F.lit(""))
    each = F.arrays_zip(f["match"].alias("match"), before.alias("before"), F.slice(f["gap"], 1, F.size(f["match"])).alias("gap"), F.concat(first, f["match"]).alias("last"), F.concat(first, f["gap"]).alias("ahead"))

    def scored(x: Column) -> Column:
        # the text before a match, back over one earlier match at most
        context = F.lower(F.right(F.concat(F.right(x["ahead"], F.lit(CONTEXT)), x["last"], x["gap"]), F.lit(CONTEXT)))
        lift = _by_kind(f["rank"], lambda k: F.when(context.rlike(WORDS[k]), LIFT[k]), F.lit(0.0))
        drop = _by_kind(f["rank"], lambda k: F.when(context.rlike(AGAINST[k]), LIFT[k]) if k in AGAINST else None, F.lit(0.0))
        score = _by_kind(f["rank"], lambda k: F.lit(PRIOR[k]), F.lit(0.0)) + F.coalesce(lift, F.lit(0.0)) - F.coalesce(drop, F.lit(0.0))
        start = x["before"] + F.length(x["gap"])
        kind = _by_kind(f["rank"], F.lit, F.lit(""))
        return F.struct(start.alias("start"), f["rank"].alias("rank"), (start + F.length(x["match"])).alias("end"), kind.alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    spans_ = F.transform(F.filter(each, lambda x: x["match"].isNotNull() & _valid(f["rank"], x["match"])), scored)
    return F.when(f["rank"] < len(BASE), spans_).otherwise(F.filter(spans_, lambda x: x["score"] >= MIN_SCORE))


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind as listed: struct(start, rank, end, kind, score)."""
    text = F.coalesce(text, F.lit(""))
    has = [_has(k, text) for k in KINDS]
    match = [F.when(h, F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))) for k, h in zip(KINDS, has, strict=True)]
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("rank"), m.alias("match")) for i, m in enumerate(match)]), lambda f: f["match"].isNotNull())

    def placed(f: Column) -> Column:
        gap = _by_kind(f["rank"], lambda k: F.split(text, PATTERNS[k], -1), F.array().cast("array<string>"))
        return bind(F.struct(f["rank"].alias("rank"), f["match"].alias("match"), gap.alias("gap")), _placed)

    # the condition is compiled; what follows is interpreted, and only for texts with a match
    return F.when(reduce(Column.__or__, has), F.array_sort(F.flatten(F.transform(found, placed)))).otherwise(F.array().cast(_SPAN))


def _list(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, all spans, and their scores in the same order."""
    s = docs.select("doc_id", spans(F.col("text")).alias("s"))
    base = F.filter("s", lambda x: x["rank"] < len(BASE))

    def count_of(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    count = [count_of(k) for k in BASE]
    scores = F.array_join(F.transform("s", lambda x: F.format_number(x["score"], 2)), ",")
    return s.select("doc_id", *count, F.sha2(_list(base), 256).alias("base_sha256"), _list(F.col("s")).alias("spans"), scores.alias("scores"))


def _without(text: Column, found: Column) -> Column:
    """The text with spans, in order, replaced by their kinds. It is cut into blocks once, and pieces are taken from these."""

    def piece(block: Column, a: Column, b: Column | None) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        n = F.size(block) if b is None else F.floor((b - 1) / BLOCK).cast("int") + 1
        whole = F.array_join(F.slice(block, first + 1, F.greatest(n - first, F.lit(0))), "")
        at = (a - first.cast("bigint") * BLOCK + 1).cast("int")
        return F.substr(whole, at) if b is None else F.substr(whole, at, (b - a).cast("int"))

    def joined(x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            at = F.get(x["at"], i)
            # a span that begins before the end of an earlier one is a part of what that replaced
            return F.when(s["start"] >= at, F.concat(piece(x["block"], at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform(x["found"], one), ""), piece(x["block"], F.array_max(x["found"]["end"]), None))

    last = running(F.transform(found, lambda s: s["end"]), F.lit(0).cast("bigint"), lambda a, e: F.greatest(a, e))
    return bind(F.struct(found.alias("found"), last.alias("at"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("block")), joined)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, and n_chars, if there, counted anew.

    Of spans that overlap, the union goes, under the name of the first.
    """
    s = fresh("s")
    out = docs.withColumn(s, spans(F.col("text")))
    out = out.withColumn("text", F.when(F.size(s) > 0, _without(F.col("text"), F.col(s))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(s) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])


def _oracle() -> str:
    """The base and added spans in DuckDB: places from split and extract likewise, checks by arithmetic."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    test = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(x, '0') AS INTEGER) END)) <= 255",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, 1 + length({digits})), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST({digits}[i] AS INTEGER) ELSE CAST({digits}[i] AS INTEGER) * 2 - CASE WHEN CAST({digits}[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    part = [
        f"SELECT r, doc_id, '{k}' AS kind, {n} AS rank, start, start + length(m) AS stop FROM (SELECT r, doc_id, m, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (SELECT r, doc_id, ms, g, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, doc_id, regexp_extract_all(text, '{plain[k]}') AS ms, regexp_split_to_array(text, '{plain[k]}') AS g FROM d WHERE regexp_matches(text, '{plain[k]}')))) WHERE {test[k]}"
        for n, k in enumerate(BASE)
    ]
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')"
    return (
        "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS (" + " UNION ALL ".join(part) + ")"
        f" SELECT d.doc_id, {count}, sha256({listed}) AS base_sha256 FROM d LEFT JOIN s USING (r) GROUP BY d.r, d.doc_id"
    )


ORACLE_BASE = _oracle()
