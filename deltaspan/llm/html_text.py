"""Main text of web pages: templates by equivalence classes of tokens across a host's pages, then the remaining slots.

Tokens of a page are its containers and its blocks of text, of any length, each with the path of containers above it.
The occurrence vector of a token over a host's pages is kept as a fingerprint, the exclusive or of hashes of page and
count, so that it is an ordinary partial aggregate and a host may have any number of pages. Pages whose three longest
blocks are the same are copies of one page and count once. Tokens of a host with the same vector, on MIN_PAGES pages and MIN_SUPPORT
of the host's at least, are an equivalence class; it is valid if its words and containers are MIN_CLASS or more.

The template of a host is its class of the widest support, the root, and the other valid classes nested in the root's
gaps. In a page the root's tokens must stand in order (those out of order are left out there), and so must another
class's, all in one gap of the root. Blocks of text that are tokens of the template are dropped: those of classes on
MIN_SHARE of the host's pages wherever they stand, those of rarer classes if they always have the same place from the
start or the end of their container and don't stand in an article or main element, where paragraphs may well recur. What
remains are slots; a page that has none then is another copy of what the template was made from, and keeps its blocks. The
main text is the slots in article or main elements, if these hold at least half of the text in slots, or else all of them,
without the parts that are never content: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments of readers, known by element, role, class or id, or being hidden. A class or id is such a name only if all of its
words are known (sidebar-left, but not has-sidebar). An element with such a name, other than that of comments, which holds
an article, main or h1 element and most of the page's text is a wrapper; so is a form that holds such an element, or nearly
all of the text; and main elements are never dropped for a name, articles for those of comments and notices only.

Character references are decoded, white space within a block becomes one space, blocks are joined by newlines, and
nothing is cut. A null or empty page has the empty text; a null url has no host and so no template; repeated pages
give equal rows; an empty table gives an empty result. Only page_id, url and html are read; other columns, whatever
their names, are ignored. Broken markup is read as far as it goes: an unclosed script or style ends the page, other
unclosed elements hold what follows.
"""

from __future__ import annotations

import bisect
import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

#: Templates of up to this many tokens over all hosts are broadcast (16 bytes each); beyond it they are joined, SALTS times.
BROADCAST_TOKENS = 1_000_000
SALTS = 32
#: Templates that a task keeps unpacked.
KEPT = 256
MIN_PAGES = 5
MIN_SUPPORT = 0.01
MIN_SHARE = 0.8
MIN_CLASS = 5
#: A form with this share of a page's text wraps the page.
ALL = 0.9

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?", re.I)
#: What holds no text of the page, with the pattern of its end.
_RAW = {x: re.compile(rf"</{x}\b[^>]*+>?", re.I) for x in "script style noscript textarea title iframe template select".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset(
    "html head body main article section div nav header footer aside form ul ol li dl table tbody thead tfoot tr td th figure blockquote details summary fieldset menu dialog button label center".split()
)
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 dt dd pre figcaption address caption hr option legend".split())
_NEVER = frozenset("head nav footer aside form menu dialog button fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Names of what readers write, of other parts that aren't content, and of parts that aren't where they stand alone or with each
#: other: related-posts is, related-work isn't.
_READERS = frozenset("comments commentlist respond responses disqus".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar "
    "cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login search searchbox pagination pager toolbar skip".split()
)
_LOOSE = frozenset("related recommended share sharing social notice notices alert widget widgets promo promotion comment reply replies overlay copyright banner".split())
#: Words that a name may have besides; any other makes it the name of something else: has-sidebar, comments-open, ad-free.
_PARTS = frozenset(
    "list box bar button buttons link links section area form block container wrapper wrap inner outer item items post posts article articles message thread icon icons title heading count site page "
    "top bottom left right main primary secondary first second global mobile desktop google slot slots unit units leaderboard rail column col row zone spot panel strip group region module component "
    "trail children child body meta author avatar field fields submit holder placeholder info warning error success fixed floating layer accept policy toggle dropdown tab tabs close up depth even odd alt".split()
)


@functools.lru_cache(maxsize=1 << 16)
def _named(word: str) -> str:
    """What a class or id names: r, what readers write; n, another part that isn't content; l, such a part by a loose name; h, a header; or nothing.

    Every word of the name must be known: the names above and the words that go with them, also where two are run together.
    """
    known = _READERS | _NAMES | _LOOSE
    parts: list[str] = []
    for x in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", word):
        if x := x.lower():
            pairs = [(x[:k], x[k:]) for k in range(2, len(x) - 1)] if x not in known and x not in _PARTS and x != "header" else []
            parts += next((list(p) for p in pairs if (p[0] in known and p[1] in known | _PARTS) or (p[0] in _PARTS and p[1] in known)), [x])
    if not parts or not all(x in known or x in _PARTS or x == "header" for x in parts):
        return ""
    # comment-list is as comments
    if any(x in _READERS for x in parts) or ("comment" in parts and parts != ["comment"]):
        return "r"
    return "n" if any(x in _NAMES for x in parts) else "l" if any(x in _LOOSE for x in parts) else "h" if "header" in parts else ""


def _hidden(attrs: str) -> bool:
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
    return False


def _never(tag: str, attrs: str, in_article: bool) -> tuple[bool, str, str]:
    """Whether an element is never content by itself, what its names say of it, and class and id as part of its token."""
    never, name, sign = tag in _NEVER or (tag == "header" and not in_article), "", ""
    if not attrs or tag in ("html", "body"):
        return never, "", ""
    for m in _ATTR.finditer(attrs):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'")
        if kind in ("class", "id"):
            sign += "." + value
            for word in value.split():
                says = _named(word)
                # an id within an article is often that of a heading: share, notice; a header there is the article's own
                if says == "r" or (says == "n" and name != "r") or (says == "l" and not name and (kind == "class" or not in_article)) or (says == "h" and not name and not in_article):
                    name = says
        elif kind == "role":
            never |= value.lower() in _ROLES
    if tag == "main" or (tag == "article" and name not in ("r", "l")):
        name = ""
    return never or _hidden(attrs), name, sign


def _hash(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), path) >> 1


class Box:
    """A container: path is a hash of its and its ancestors' signs; size counts what stands directly in it.

    own: it is never content; name: what its names say; holds: an article, main or h1 stands in it; chars: of its text.
    """

    __slots__ = ("tag", "parent", "own", "name", "holds", "chars", "main", "path", "size")

    def __init__(self, tag: str, parent: Box | None, own: bool, name: str, main: bool, path: int) -> None:
        self.tag, self.parent, self.own, self.name, self.main, self.path = tag, parent, own, name, main, path
        self.holds, self.chars, self.size = False, 0, 0


class Event:
    """A container that opens, or a block of text, with its place in its box."""

    __slots__ = ("text", "box", "own", "token", "place", "never")

    def __init__(self, text: str | None, box: Box, own: bool, token: int) -> None:
        self.text, self.box, self.own, self.token, self.place, self.never = text, box, own, token, box.size, False
        box.size += 1


def events(page: str) -> list[Event]:
    """The containers and blocks of text of a page, in order."""
    out: list[Event] = []
    root = Box("", None, False, "", False, 0)
    top, own, hidden, depth = root, False, "", 0
    open_: dict[str, int] = {}
    boxes: list[Box] = []
    held: list[str] = []
    endless: set[str] = set()

    def close_block() -> None:
        nonlocal own, hidden
        if text := " ".join("".join(held).split()):
            out.append(Event(text, top, own, _hash(top.path, text)))
        held.clear()
        own, hidden = False, ""

    def pop() -> None:
        nonlocal top
        open_[top.tag] -= 1
        top = top.parent

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at and not hidden:
            held.append(html.unescape(page[at:stop]))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        shut, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _RAW:
            if not shut and not attrs.endswith("/") and tag not in endless:
                if end := _RAW[tag].search(page, at):
                    at = end.end()
                elif tag in ("script", "style"):
                    break
                else:
                    endless.add(tag)
            continue
        if tag == "br":
            held.append(" ")
        if tag not in _BLOCKS:
            # an inline element that isn't shown
            if hidden:
                depth += (tag == hidden) * (-1 if shut else 1)
                hidden = hidden if depth else ""
            elif attrs and not shut and tag not in _VOID and _hidden(attrs):
                hidden, depth = tag, 1
            continue
        close_block()
        if tag not in _CONTAINERS:
            own = not shut and bool(attrs) and any(_never(tag, attrs, top.main)[:2])
        elif shut:
            if open_.get(tag):
                while top.tag != tag:
                    pop()
                pop()
        else:
            if tag == "li" and top.tag == "li":
                pop()
            if tag in ("td", "th", "tr") and top.tag in ("td", "th"):
                pop()
            if tag == "tr" and top.tag == "tr":
                pop()
            if tag in ("article", "main", "h1"):
                _unwrap(top)
            never, name, sign = _never(tag, attrs, top.main)
            box = Box(tag, top, never, name, top.main or tag in ("article", "main"), _hash(top.path, f"{tag}\n{sign}"))
            out.append(Event(None, top, False, box.path))
            boxes.append(box)
            open_[tag] = open_.get(tag, 0) + 1
            top = box
        if tag == "h1" and not shut:
            _unwrap(top)
    close_block()
    for e in out:
        if e.text is not None and not e.own:
            e.box.chars += len(e.text)
    for box in reversed(boxes):
        box.parent.chars += box.chars if not box.own or box.tag == "form" else 0
    # outer boxes come first, so that a box takes over what its parent is
    for box in boxes:
        if box.tag == "form" and box.own and box.chars >= ALL * root.chars:
            box.own = False
        if box.name and not (box.name != "r" and box.holds and 2 * box.chars > root.chars):
            box.own = True
        box.own = box.own or box.parent.own
    for e in out:
        e.never = e.own or e.box.own
    return out


def _unwrap(box: Box | None) -> None:
    """What an article, main or h1 element stands in may be a wrapper of the page."""
    while box is not None:
        box.holds = True
        if box.tag == "form":
            box.own = False
        box = box.parent


def identity(found: list[Event]) -> int:
    """A hash of the three longest blocks that may be content: copies of a page share it."""
    return _hash(0, "\n".join(sorted((e.text for e in found if e.text is not None and not e.never), key=lambda t: (-len(t), t))[:3]))


def tokens(found: list[Event]) -> list[tuple[int, int, int, int, int, int]]:
    """(token, count, order of the first, its place from the start and from the end of its box, words) of a page's tokens; words is 0 for a container."""
    seen: dict[int, list[int]] = {}
    for k, e in enumerate(found):
        seen.setdefault(e.token, [0, k, e.place, e.box.size - 1 - e.place, len(e.text.split()) if e.text is not None else 0])[0] += 1
    return [(t, *x) for t, x in seen.items()]


def in_order(places: list[int]) -> list[int]:
    """The indexes of a longest rising subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect.bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
            at.append(i)
        else:
            tails[k], at[k] = p, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


class Template:
    """A host's classes: where each token belongs, as (class, order in it, is text, has a place of its own), and which classes are wide.

    ``packed``: for each class, the root first, its number of tokens and whether it is wide, then each token with its
    two flags as bits.
    """

    def __init__(self, packed: np.ndarray) -> None:
        self.of: dict[int, tuple[int, int, int, int]] = {}
        self.wide: list[bool] = []
        at, own = 0, packed.tolist()
        while at < len(own):
            for k in range(own[at]):
                token, bits = own[at + 2 + 2 * k : at + 4 + 2 * k]
                self.of[token] = (len(self.wide), k, bits & 1, bits & 2)
            self.wide.append(bool(own[at + 1]))
            at += 2 + 2 * own[at]

    def blocks(self, found: list[Event]) -> set[int]:
        """The numbers of the events that are blocks of the template's text in this page."""
        at: dict[int, list[int]] = {}
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for k, e in enumerate(found):
            if e.token in self.of:
                if e.token not in at:
                    at[e.token] = []
                    group, order, *_ = self.of[e.token]
                    groups.setdefault(group, []).append((order, k, e.token))
                at[e.token].append(k)
        out: set[int] = set()
        gaps: list[int] = []
        for n in sorted(groups):
            here = sorted(groups[n])
            kept = [here[i] for i in in_order([k for _, k, _ in here])]
            if n == 0:
                gaps = [k for _, k, _ in kept]
            elif len({bisect.bisect_left(gaps, k) for _, k, _ in kept}) > 1:
                continue  # not nested in one gap
            for _, _, token in kept:
                _, _, text, still = self.of[token]
                if text:
                    out.update(k for k in at[token] if self.wide[n] or (still and not found[k].box.main))
        return out


def extract(page: str | None, template: Template | None) -> str:
    """The main text, given the host's template."""
    if not page:
        return ""
    found = events(page)
    fixed = template.blocks(found) if template else set()
    texts = [(k, e) for k, e in enumerate(found) if e.text is not None and not e.never]
    # teasers are articles too: only such as hold most of what is left are the page's own
    size = {own: sum(len(e.text) for k, e in texts if e.box.main == own and k not in fixed) for own in (True, False)}
    if size[True] >= size[False] and any(e.box.main for _, e in texts):
        texts = [(k, e) for k, e in texts if e.box.main]
    return "\n".join([e.text for k, e in texts if k not in fixed] or [e.text for _, e in texts])


_STAT = "host bigint, token bigint, page bigint, n bigint, place bigint, ahead bigint, behind bigint, words bigint"


def templates(pages: DataFrame) -> DataFrame:
    """(host, packed): the valid classes of each host, the root first, each with its tokens in order, as Template reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _STAT.split(", ")]
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for h, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                found = events(page or "")
                own = identity(found)
                rows.append((h, -1, own, 1, 0, 0, 0, 0))
                rows += [(h, t, own, *x) for t, *x in tokens(found)]
            a = np.array(rows, dtype=np.int64).reshape(-1, len(names))
            yield pa.record_batch({x: a[:, i] for i, x in enumerate(names)})

    # copies of a page first become one
    each = pages.where("host is not null").select("host", "html").mapInArrow(run, _STAT).groupBy("host", "token", "page")
    each = each.agg(*[F.min(x).alias(x) for x in ("n", "place", "ahead", "behind", "words")])
    stat = each.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.avg("place").alias("place"), F.max("words").alias("words"),
        ((F.min("ahead") == F.max("ahead")) | (F.min("behind") == F.max("behind"))).alias("still"),
    )
    stat = cut(stat.where(F.col("pages") >= MIN_PAGES))
    total = stat.groupBy("host").agg(F.max(F.when(F.col("token") == -1, F.col("pages"))).alias("of"), F.count("*").alias("rows"))
    own = spread_join(stat.where("token <> -1"), total, ["host"], "rows", stat.count()).where(F.col("pages") >= MIN_SUPPORT * F.col("of"))
    # tokens of a host on MIN_SUPPORT of its pages are 1 / MIN_SUPPORT times a page's at most, so that its lists are short
    listed = F.array_sort(F.collect_list(F.struct("place", "token", (F.col("words") > 0).alias("text"), "still")))
    group = own.groupBy("host", "vector").agg(F.first("pages").alias("pages"), F.first("of").alias("of"), F.sum(F.greatest("words", F.lit(1))).alias("size"), listed.alias("tokens"))
    group = group.where(F.col("size") >= MIN_CLASS)
    one = F.struct((-F.col("pages")).alias("order"), (-F.size("tokens")).alias("by"), "vector", (F.col("pages") >= MIN_SHARE * F.col("of")).alias("wide"), "tokens")
    classes = F.array_sort(F.collect_list(one))
    # beside the root, only classes with text change anything
    classes = F.filter(classes, lambda c, i: (i == 0) | F.exists(c["tokens"], lambda t: t["text"]))
    bits = lambda t: (t["text"].cast("int") + 2 * t["still"].cast("int")).cast("bigint")
    packed = F.transform(classes, lambda c: F.concat(
        F.array(F.size(c["tokens"]).cast("bigint"), c["wide"].cast("bigint")), F.flatten(F.transform(c["tokens"], lambda t: F.array(t["token"], bits(t))))))
    return group.groupBy("host").agg(F.flatten(packed).alias("packed"))


def with_host(pages: DataFrame) -> DataFrame:
    name = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", "url", "html", F.when(name != "", F.xxhash64(name)).alias("host"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    pages = with_host(pages)
    found = cut(templates(pages))
    size = found.agg(F.sum(F.size("packed"))).first()[0] or 0
    made: dict[int, Template] = {}

    def template(host: int | None, packed: np.ndarray | None) -> Template | None:
        if packed is None or not len(packed):
            return None
        if host not in made:
            if len(made) >= KEPT:
                made.clear()
            made[host] = Template(packed)
        return made[host]

    if size <= 2 * BROADCAST_TOKENS:
        # bounded by BROADCAST_TOKENS; a page needs its host's number only
        own = pages.sparkSession.sparkContext.broadcast({r["host"]: np.array(r["packed"], dtype=np.int64) for r in found.collect()})

        def look_up(page: pa.Array, host: pa.Array) -> pa.Array:
            return pa.array([extract(p, template(h, own.value.get(h))) for p, h in zip(page.to_pylist(), host.to_pylist(), strict=True)], type=pa.string())

        out = pages.select("page_id", "url", F.arrow_udf(look_up, "string").asNondeterministic()("html", "host").alias("text"))
    else:
        # a host's pages are spread over SALTS tasks, those without a host over all
        spread = F.when(F.col("host").isNull(), F.xxhash64("html")).otherwise(F.col("host"))
        salted = pages.withColumn("host", spread).withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
        joined = salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")

        def beside(page: pa.Array, host: pa.Array, packed: pa.Array) -> pa.Array:
            each = zip(page.to_pylist(), host.to_pylist(), packed, strict=True)
            return pa.array([extract(p, template(h, t.values.to_numpy() if t.is_valid else None)) for p, h, t in each], type=pa.string())

        out = joined.select("page_id", "url", F.arrow_udf(beside, "string").asNondeterministic()("html", "host", "packed").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
