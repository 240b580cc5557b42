"""Scalar text functions. Spark's own expressions where they can say it, Arrow UDFs for Unicode rules that they lack."""

from __future__ import annotations

import difflib
import functools
import html
import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "‖"
MATCH_THRESHOLD = 0.8

# ---- plain functions on one value; the UDFs below map them over Arrow batches


def nfkc_py(s: str | None) -> str:
    return unicodedata.normalize("NFKC", s or "").strip()


#: What a normal form puts for some characters; fixed values.
NORM_PARTS = (("“", '"'), ("”", '"'), ("œ", "oe"), ("Œ", "OE"))


def norm_py(s: str | None) -> str:
    """Compatibility form, double quotes straightened, ligature oe spelt out, blanks collapsed, case folded."""
    s = unicodedata.normalize("NFKC", s or "")
    for odd, plain in NORM_PARTS:
        s = s.replace(odd, plain)
    return " ".join(s.split()).casefold()


def match_key_py(s: str | None) -> str:
    """Compatibility form, word characters only, lower case."""
    return re.sub(r"\W+", "", nfkc_py(s)).lower()


#: What a core leaves out; fixed values.
PICTOGRAPHS = "[\U0001f000-\U0001faff☀-➿️]+"
PUNCTUATION = "[\\s。．.！!？?，,、；;：:～~…—\\-\"“”'‘’（）()【】《》]"


def core_py(s: str | None) -> str:
    """Compatibility form without pictographs, blanks and common punctuation."""
    s = re.sub(PICTOGRAPHS, "", unicodedata.normalize("NFKC", s or ""))
    return re.sub(PUNCTUATION, "", s)


def plain_windows_py(needle: str, text: str, above: float = 0.0) -> float:
    """The fallback of the published ratio: matching blocks, windows of the text just as long as the needle, wholes if it isn't shorter."""
    if not needle or not text:
        return 0.0
    if len(needle) < len(text) and needle in text:
        return 1.0
    spare = max(0, len(text) - len(needle))
    windows = (text[k : k + len(needle)] for k in range(spare + 1)) if spare else (text,)
    return max(difflib.SequenceMatcher(None, needle, w).ratio() for w in windows)


#: Windows whose common subsequences are counted at once.
WINDOWS = 256


def best_window_py(needle: str, text: str, above: float = 0.0) -> float:
    """Best similarity of the shorter string to a window of the longer: twice the common subsequence over both lengths.

    Windows are as long as the shorter string, or reach over an end of the longer one; of strings of one length either
    is the shorter. A window can't have more in common than the characters that both hold, which running counts give
    for all windows at once: windows are tried from the best such bound on, many at a time, and no more are where the
    bound is not over what was found, or not over ``above``. So a result over ``above`` is exact, and any other isn't over it.
    """
    if len(needle) > len(text):
        needle, text = text, needle
    if not needle:
        return 0.0
    if needle in text:
        return 1.0
    best = _best_window(needle, text, above)
    return max(best, _best_window(text, needle, max(above, best))) if len(needle) == len(text) else best


def _best_window(needle: str, text: str, above: float) -> float:
    m, n = len(needle), len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.arange(1, n + m)
    first, last = np.maximum(ends - m, 0), np.minimum(ends, n)
    shared = np.zeros(len(ends), dtype=np.int64)
    places = {c: [i for i, x in enumerate(needle) if x == c] for c in dict.fromkeys(needle)}
    for c, own in places.items():
        upto = np.concatenate([[0], np.cumsum(codes == ord(c))])
        shared += np.minimum(upto[last] - upto[first], len(own))
    bound = 2 * shared / (m + last - first)
    order = np.argsort(-bound, kind="stable")
    best = 0.0
    for k in range(0, len(order), WINDOWS):
        part = order[k : k + WINDOWS]
        if bound[part[0]] <= max(best, above):
            break
        part = part[bound[part] > max(best, above)]
        best = max(best, float((2 * _common(places, m, codes, text, first[part], last[part]) / (m + last[part] - first[part])).max()))
    return best


def _common(places: dict[str, list[int]], m: int, codes: np.ndarray, text: str, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a string, given by its characters' places, and of windows of a text: a bit for each place."""
    if m > 64:
        out = []
        bits = {c: sum(1 << i for i in own) for c, own in places.items()}
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            rest = (1 << m) - 1
            for c in text[a:b]:
                hit = rest & bits.get(c, 0)
                rest = (rest + hit) | (rest - hit)
            out.append(m - (rest & ((1 << m) - 1)).bit_count())
        return np.array(out)
    known = np.array([ord(c) for c in places], dtype=np.uint32)
    by_code = np.argsort(known)
    masks = np.array([sum(1 << i for i in own) for own in places.values()] + [0], dtype=np.uint64)
    spot = np.minimum(np.searchsorted(known[by_code], codes), len(known) - 1)
    mask = masks[np.where(known[by_code][spot] == codes, by_code[spot], len(known))]
    full = np.uint64((1 << m) - 1)
    rest = np.full(len(first), full)
    for step in range(int((last - first).max())):
        at = first + step
        hit = np.where(at < last, rest & mask[np.minimum(at, len(codes) - 1)], np.uint64(0))
        rest = (rest + hit) | (rest - hit)
    return m - np.bitwise_count(rest & full).astype(np.int64)


def usable_golds_py(golds: list[str | None] | None) -> list[str]:
    trimmed = [(g or "").strip() for g in golds or []]
    return [g for g in trimmed if len(g) > 1 and re.search(r"[^\W_]", g)]


def term_hit_py(hypothesis: str | None, golds: list[str | None] | None, threshold: float = MATCH_THRESHOLD, ratio: Callable[[str, str, float], float] = best_window_py) -> int:
    """1 if the hypothesis has some usable gold form, or a window that is like one by more than the threshold."""
    text = norm_py(hypothesis)
    wanted = [w for w in map(norm_py, usable_golds_py(golds)) if w]
    return int(bool(text) and (any(w in text for w in wanted) or any(ratio(w, text, threshold) > threshold for w in wanted)))


def standard_match_py(given: str | None, gold: str | None, threshold: float = MATCH_THRESHOLD) -> tuple[bool, bool]:
    """Equal after normalisation, and alike by more than the threshold, whichever of the two is looked for in the other."""
    a, b = norm_py(given), norm_py(gold)
    if a == b:
        return bool(a), bool(a)
    return False, bool(a and b) and best_window_py(a, b, threshold) > threshold


#: Rows whose values are Python's objects at a time.
ROWS_AT_ONCE = 128


def _in_parts(function: Callable, arrow: pa.DataType) -> Callable[..., pa.Array]:
    """A function of values over columns, so that only a few rows of a batch are objects at once."""

    def run(*columns: pa.Array) -> pa.Array:
        out = [pa.array([], type=arrow)]
        for k in range(0, len(columns[0]), ROWS_AT_ONCE):
            rows = zip(*(c.slice(k, ROWS_AT_ONCE).to_pylist() for c in columns), strict=True)
            out.append(pa.array([function(*row) for row in rows], type=arrow))
        return pa.concat_arrays(out)

    return run


def _mapped(function: Callable, kind: str, arrow: pa.DataType) -> Callable[..., Column]:
    run = _in_parts(function, arrow)

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    made = {1: one, 2: two}
    return lambda *columns: F.arrow_udf(made[len(columns)], kind)(*columns)


partial_ratio = _mapped(lambda a, b: best_window_py(a or "", b or ""), "double", pa.float64())
html_unescape = _mapped(lambda s: None if s is None else html.unescape(s), "string", pa.string())
standard_match = _mapped(
    lambda a, b: dict(zip(("exact", "fuzzy"), standard_match_py(a, b), strict=True)), "struct<exact:boolean,fuzzy:boolean>", pa.struct([("exact", pa.bool_()), ("fuzzy", pa.bool_())])
)



def term_hit(hypothesis: Column, golds: Column, threshold: float = MATCH_THRESHOLD) -> Column:
    return _mapped(lambda h, g: term_hit_py(h, g, threshold), "int", pa.int32())(hypothesis, golds)


# ---- Unicode forms: a table of single characters, made from the plain functions, where characters don't act on each other

#: What a character becomes that its table can't say; no character of a text.
ODD = "\uffff"
#: What tables cover: the basic plane but for private characters, pictographs, and Chinese characters. Of the rest, scripts
#: that are rare and versions of Unicode that differ, no table speaks.
COVERED = ((0, 0xD7FF), (0xF900, 0xFFFE), (0x1F000, 0x1FAFF), (0x20000, 0x2FA1F), (0x30000, 0x323AF))
_REST = "[" + "".join(rf"\x{{{a[1] + 1:x}}}-\x{{{b[0] - 1:x}}}" for a, b in zip(COVERED, (*COVERED[1:], (0x110000, 0)), strict=True) if a[1] + 1 != 0xD800) + r"\x{e000}-\x{f8ff}]"


@functools.cache
def _seconds() -> frozenset[str]:
    """Characters that may join or trade places with the one before: combining ones, and what is second in a composition."""
    out = {chr(k) for k in range(sys.maxunicode + 1) if unicodedata.combining(chr(k))}
    for k in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(k)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out | {chr(k) for k in (*range(0x1160, 0x1200), *range(0xD7B0, 0xD800))})  # later parts of Korean syllables


@functools.cache
def _table(form: Callable[[str], str]) -> tuple[str, str]:
    """Characters and what they become, for translate: those that vanish last, those that the table can't say as ODD.

    The form of a text is that of its characters, one after another, if none of them acts on its neighbours, and if each
    becomes one character or none. A character is asked for between two others, so that blanks at the ends don't matter.
    """
    seconds, become, vanish = _seconds(), {}, []
    for k in (k for first, last in COVERED for k in range(first, last + 1)):
        c = chr(k)
        if c in seconds or unicodedata.normalize("NFKD", c)[0] in seconds or c == "Σ":  # whose lower case depends on its place
            become[c] = ODD
            continue
        got = form(f"a{c}a")[1:-1]
        if got != c:
            if got:
                become[c] = got if len(got) == 1 else ODD
            else:
                vanish.append(c)
    return "".join([*become, *vanish]), "".join(become.values())


def _by_table(form: Callable[[str | None], str], ascii_form: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """A form as an expression; texts with characters that the table can't say go through the plain function, others reach it as nulls."""
    plain = _mapped(form, "string", pa.string())

    def made(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        have, become = _table(form)
        by_table = F.translate(text, have, become)
        odd = F.contains(by_table, F.lit(ODD)) | text.rlike(_REST)
        simple = F.octet_length(text) == F.length(text)
        out = F.when(odd, plain(F.when(odd, text))).otherwise(by_table)
        return out if ascii_form is None else F.when(simple, ascii_form(text)).otherwise(out)

    return made


def _blanks_py(s: str) -> str:
    return "".join(" " if c.isspace() else c for c in s)


_BLANK = r"[\x09-\x0d\x1c-\x20]"


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _BLANK + "+", " "))


def _single_norm(s: str | None) -> str:
    """norm_py but for the collapse of blanks."""
    s = unicodedata.normalize("NFKC", s or "")
    for odd, plain in NORM_PARTS:
        s = s.replace(odd, plain)
    return _blanks_py(s).casefold()


def _single_nfkc(s: str | None) -> str:
    return unicodedata.normalize("NFKC", s or "")


_norm, _nfkc = _by_table(_single_norm, F.lower), _by_table(_single_nfkc, lambda c: c)
core = _by_table(core_py)
match_key = _by_table(match_key_py, lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9_]+", "")))


def norm_text(c: Column) -> Column:
    """norm_py of a text; a null is empty."""
    return _collapsed(_norm(c))


def nfkc(c: Column) -> Column:
    """nfkc_py of a text; a null is empty."""
    return strip(_nfkc(c))


# ---- native expressions


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def split_list(c: Column, separator: str = SEPARATOR) -> Column:
    """Parts between separators, trimmed, blanks dropped; a null reads as empty."""
    parts = F.split(F.coalesce(c, F.lit("")), re.escape(separator))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def join_list(c: Column, separator: str = SEPARATOR) -> Column:
    return F.array_join(c, separator)


def usable_golds(c: Column) -> Column:
    """Gold forms of at least two characters that aren't marks only."""
    return F.filter(F.transform(c, strip), lambda x: (F.length(x) >= 2) & ~x.rlike(r"(?U)^[\W_]*$"))


def edit_distance(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b)).cast("long")


def char_grams(c: Column, n: int = 4) -> Column:
    """Distinct n-grams of characters; a shorter text is its own only one."""
    # an empty match at each place that looks n characters ahead: linear, where substrings would be counted from the start
    every = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(c) >= n, F.array_distinct(every)).otherwise(F.array(c))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def added_characters(have: Column, base: Column) -> Column:
    """Distinct characters of the one that the other lacks, sorted."""
    return F.array_join(F.array_sort(F.array_except(F.split(have, ""), F.split(base, ""))), "")


def without_thoughts(c: Column) -> Column:
    """A leading block of thoughts is cut, and blanks at the ends."""
    return strip(F.regexp_replace(c, r"(?sU)^\s*<think>.*?</think>\s*", ""))


def fixed(c: Column, digits: int = 2) -> Column:
    """A number with so many digits, blank for null."""
    return F.when(c.isNull() | F.isnan(c), "").otherwise(F.regexp_replace(F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits)), ",", ""))


def interval_cell(low: Column, high: Column, digits: int = 2) -> Column:
    return F.when(low.isNull() | high.isNull(), "").otherwise(F.concat(F.lit("["), fixed(low, digits), F.lit(", "), fixed(high, digits), F.lit("]")))
