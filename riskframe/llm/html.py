"""Main-text extraction by equivalence-class template deduction.

Tokens of a page are its elements, named by their path (tag, class and id of
every ancestor; digits do not count), and -- on pages that mark no article --
also their text runs.  Pages with equal text runs, or without runs equal markup, are
copies and count once.  Over the pages of one host every token has an occurrence
vector (how often it stands in each page); a commutative fingerprint of that
vector is aggregated over the cluster, so a host with a third of all pages is
a few partial rows per task.  Tokens with equal vectors form a class.  Classes of
two and more tokens that at least half of the host's pages hold are valid; paths
nest by construction, so the valid classes nest into the host's template.

The template's slots are the regions of its elements.  Slots inside menus,
headers, footers, sidebars, notices, adverts, forms and comments are boilerplate; the main
slot is the template element that is marked as article, else as main, else named
like content, else the body, by most text.  An element named like content is a slot
only where it holds most of the page's text; where it does not, as a title or a
date, the nearest block around it that does takes its place.  Each page's main slot is then cut
out: its text runs in page order, white space of a block made one space, blocks
joined by one line feed.  Text runs that belong to the template are dropped only
where no article or main element marks the text.  A page without its host's main
slot, and a host with one page, is its own template.

A class, id or role marks an element as boilerplate only by what it holds: names never
drop an article or main element itself, nor -- on a page that has neither outside such
elements -- an element with most of the page's text (for comments: nearly all of it).

Markup is read by one forward scan: the work on a page is linear in its length and
in the number of its elements, however it is nested, quoted or cut off.

Defined results: null html gives empty text; pages without a URL form one host;
broken and cut-off markup is read as far as it goes; rows with equal ids are
separate pages; an empty table gives an empty table; nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import broadcast_within, save, text_batches
from riskframe.llm.urls import host_path

#: A template token stands in at least this share of the host's pages, a
#: template text run in at least this many pages.
SUPPORT, TEXT_PAGES = 0.5, 3
#: The token of a page itself.
PAGE = -1

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?<![\w:-])([a-zA-Z][\w:-]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
                  "th thead tr ul caption".split())
#: Elements that hold no article text, whatever they are named.
DROP = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea dialog menu object "
                 "embed audio video canvas title".split())
#: Words in a class, id or role that mark a part as boilerplate.
DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar "
                       "navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert popup "
                       "modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
                       "comment comments commentlist disqus replies reply respond widget toolbar pagination pager skip search form contentinfo complementary".split())
#: Those of readers' comments, and the shares of a page's text from which an element is kept whatever its name.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
MOST, NEARLY_ALL = 0.5, 0.9
#: Words that name content.
CONTENT_WORDS = frozenset("article content post entry story main text body".split())
#: An opening tag ends these open elements.
_P = frozenset(["p"])
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
        "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPE = frozenset("article aside body div footer form header html main nav ol section table ul dl td th".split())


_ENDED = {name: ENDS.get(name, frozenset()) | (_P if name in BLOCK and name != "br" else frozenset()) for name in {*ENDS, *BLOCK}}


class Element:
    """An open element: path key, whether it is boilerplate, its rank as main
    slot (3 article, 2 main, 1 named like content, 0 body); ``marked``: the share of the
    text from which it is kept, if only its name makes it boilerplate; ``part``: whether
    a tag makes it or an ancestor boilerplate."""
    __slots__ = ("name", "key", "drop", "rank", "inside", "marked", "part")

    def __init__(self, name: str, attrs: str, parent: "Element | None", spare: frozenset = frozenset()):
        import xxhash
        got = {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in _ATTR.finditer(attrs)} if "=" in attrs else {}
        words = set(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", " ".join(got.get(a, "") for a in ("class", "id", "role"))).lower()))
        mark = re.sub(r"\d+", "", " ".join(sorted(got.get(a, "") for a in ("class", "id", "role"))))
        self.name = name
        self.key = xxhash.xxh64_intdigest(f"{parent.key if parent else 0}/{name} {mark}") >> 1
        #: inside an article or main element
        self.inside = bool(parent) and (parent.inside or parent.rank >= 2)
        main = name == "main" or got.get("role") == "main"
        known = words & DROP_WORDS if name not in ("html", "body", "article") and not main else ()
        self.marked = None if not known or self.key in spare else NEARLY_ALL if words & COMMENT_WORDS else MOST
        self.part = bool(parent and parent.part) or name in DROP or (name == "header" and not self.inside) or "banner" in got.get("role", "") or "hidden" in attrs.lower().split()
        self.drop = bool(parent and parent.drop) or self.part or self.marked is not None
        self.rank = -1 if self.drop else 3 if name == "article" else 2 if main else 1 if words & CONTENT_WORDS else 0 if name == "body" else -1


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Place of the ``>`` that ends the tag whose name ends at ``at``: the first one
    outside quotes, or -- where a quote stays open to the end of the page -- the first
    one.  ``dead``: opening quotes from which no such place is found."""
    first = page.find(">", at)
    if first < 0 or "'" not in (attrs := page[at:first]) and '"' not in attrs:
        return first
    met = []
    pos = at
    while m := _QUOTE.search(page, pos):
        if m.group() == ">":
            return m.start()
        if m.start() in dead:
            break
        met.append(m.start())
        pos = page.find(m.group(), m.end()) + 1
        if not pos:
            break
    dead.update(met)
    return first


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text) of the markup: open, close, text."""
    at, pos, size, last = 0, 0, len(page), page.rfind(">")
    dead: set[int] = set()
    while (pos := page.find("<", pos)) >= 0:
        if page.startswith("<!--", pos):
            end = page.find("-->", pos + 4)
            end = size if end < 0 else end + 3
            name = ""
        elif pos > last:
            break                                   # nothing ends behind here
        elif page[pos + 1:pos + 2] in ("!", "?"):
            end, name = page.find(">", pos) + 1, ""
        else:
            slash = page.startswith("/", pos + 1)
            m = _NAME.match(page, pos + 1 + slash)
            stop = _tag_end(page, m.end(), dead) if m else -1
            if stop < 0:
                pos += 1                            # a plain <
                continue
            end, name, attrs = stop + 1, m.group().lower(), page[m.end():stop]
        if pos > at:
            yield "text", "", page[at:pos]
        at = pos = end
        if not name:
            continue
        if slash:
            yield "close", name, ""
            continue
        yield "open", name, attrs
        if name in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if close is None:
                return                              # a raw element that never ends swallows the rest
            at = pos = close.start()
    if at < size:
        yield "text", "", page[at:]


def walk(page: str, spare: frozenset = frozenset()) -> Iterator[tuple[str, Element, str]]:
    """(kind, element, text): events with the element they open, close or
    stand in; unclosed elements end with their ancestors."""
    stack: list[Element] = []
    places: dict[str, list[int]] = {}               # open elements by name
    top = Element("html", "", None)
    last = lambda names: max((places[n][-1] for n in names if places.get(n)), default=-1)

    def cut_to(i: int):
        while len(stack) > i:
            e = stack.pop()
            places[e.name].pop()
            yield "close", e, ""

    for kind, name, text in events(page):
        if kind == "text":
            yield kind, stack[-1] if stack else top, text
        elif kind == "open":
            if name == "html":
                continue
            ends = _ENDED.get(name, ())
            if any(places.get(n) for n in ends):
                # the outermost element it ends, inside the nearest one that keeps its children
                border = last(SCOPE - ends)
                out = min((places[n][i] for n in ends if places.get(n) and (i := bisect_right(places[n], border)) < len(places[n])), default=None)
                if out is not None:
                    yield from cut_to(out)
            e = Element(name, text, stack[-1] if stack else top, spare)
            yield "open", e, ""
            if name in VOID or text.endswith("/") and name not in BLOCK:
                yield "close", e, ""
            else:
                places.setdefault(name, []).append(len(stack))
                stack.append(e)
        elif stack and stack[-1].name == name:
            yield from cut_to(len(stack) - 1)
        elif places.get(name):
            # a stray end tag does not leave the article
            if name in ("html", "body", "main", "article") or places[name][-1] > last(("article", "main", "body")):
                yield from cut_to(places[name][-1])
    yield from cut_to(0)


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def signature(page: str, runs: dict[int, int]) -> int:
    """Equal for copies of a page: its text runs, or its markup where it has none."""
    import xxhash
    return xxhash.xxh64_intdigest(" ".join(map(str, sorted(runs))) if runs else page) >> 1


def spared(page: str) -> frozenset:
    """Keys of elements that only their name marks as boilerplate but that hold most of
    the text of a page without an article or main element outside such elements."""
    inside: dict[int, int] = {}
    limit: dict[int, float] = {}
    open_: list[list] = []                          # [element, characters inside]
    total = 0
    for kind, e, text in walk(page):
        if kind == "open":
            open_.append([e, 0])
            if e.rank >= 2:
                return frozenset()
        elif kind == "close":
            _, n = open_.pop()
            if e.marked is not None:
                inside[e.key] = inside.get(e.key, 0) + n
                limit[e.key] = e.marked
            if open_:
                open_[-1][1] += n
        elif not e.part and (t := clean(text)):
            total += len(t)
            if open_:
                open_[-1][1] += len(t)
    return frozenset(k for k, n in inside.items() if n > limit[k] * total)


def tokens(page: str, spare: frozenset = frozenset()) -> tuple[dict[int, list], dict[int, int]]:
    """Elements {key: [count, rank, characters of text inside]} and, where no
    article or main marks the text, text runs {key: count}."""
    import xxhash
    found: dict[int, list] = {}
    runs: dict[int, int] = {}
    open_: list[list] = []                          # [element, characters inside, nearest block around it]
    around: dict[int, int | None] = {}              # element -> nearest block around it
    best, total = -1, 0
    for kind, e, text in walk(page, spare):
        if kind == "open":
            x = found.setdefault(e.key, [0, e.rank, 0])
            x[0] += 1
            best = max(best, e.rank)
            up = open_[-1] if open_ else None
            block = None if up is None else up[0].key if up[0].rank <= 0 and up[0].name in BLOCK and up[0].name not in ("html", "body") else up[2]
            around[e.key] = block
            open_.append([e, 0, block])
        elif kind == "close":
            _, n, _ = open_.pop()
            found[e.key][2] += n
            if open_:
                open_[-1][1] += n
        elif not e.drop and (t := clean(text)):
            total += len(t)
            if open_:
                open_[-1][1] += len(t)
            r = xxhash.xxh64_intdigest(f"{e.key} {t}") >> 1
            runs[r] = runs.get(r, 0) + 1
    if best < 2:
        large: dict[int, int | None] = {}           # nearest block that holds most of the text, each chain walked once
        for k in [k for k, x in found.items() if x[1] == 1 and 2 * x[2] <= total]:
            found[k][1] = -1
            way, b = [], around[k]
            while b is not None and b not in large and 2 * found[b][2] <= total:
                way.append(b)
                b = around[b]
            b = large.get(b, b)
            large.update(dict.fromkeys(way, b))
            if b is not None:
                found[b][1] = 1
    return found, {} if best >= 2 else runs


def own_main(found: dict[int, list]) -> int | None:
    """The main slot of a page on its own: highest rank, then most text."""
    known = [(x[1], x[2], -k) for k, x in found.items() if x[1] >= 0]
    return -max(known)[2] if known else None


def cut(page: str, main: int | None, drop_run=None, spare: frozenset = frozenset()) -> tuple[str, bool, bool]:
    """(text of the main slot, whether the page has it, whether an article or
    main element marks it); ``main`` None: the whole page."""
    blocks: list[str] = []
    line: list[str] = []
    inside, seen, marked = (0, False, False) if main is not None else (1, True, False)

    def flush():
        if t := " ".join("".join(line).split()):
            blocks.append(t)
        line.clear()

    for kind, e, text in walk(page, spare):
        if kind == "text":
            if inside and not e.drop and not (drop_run and drop_run(e, text)):
                line.append(entities.unescape(text))
            continue
        if e.name in BLOCK:
            flush()
        if e.key == main:
            inside += 1 if kind == "open" else -1
            seen, marked = True, marked or e.rank >= 2
    flush()
    return "\n".join(blocks), seen, marked


def extract(page: str | None, main: int | None, constant: frozenset = frozenset()) -> str:
    """Text of the host's main slot; without it the page's own choice, without
    any the whole page.  ``constant``: keys of the template's text runs."""
    import xxhash
    if not page:
        return ""
    text, seen, marked = cut(page, main)
    if main is not None and seen and marked and text:
        return text
    if spare := spared(page):
        text, seen, marked = cut(page, main, None, spare)
        if main is not None and seen and marked and text:
            return text
    found, runs = tokens(page, spare)
    if main is None or not seen or found[main][1] < 0:
        main = own_main(found)
    drop = (lambda e, t: xxhash.xxh64_intdigest(f"{e.key} {clean(t)}") >> 1 in constant) if constant and runs else None
    # a page of which nothing would stay is a copy, not a template
    return cut(page, main, drop, spare)[0] or cut(page, main, None, spare)[0]


def _token_fn(batches):
    for b in batches:
        host, page, key, count, rank, chars, run = [], [], [], [], [], [], []
        for h, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            found, runs = tokens(text or "")
            # no article or main element: names may have dropped the text
            if all(x[1] < 2 for x in found.values()) and (spare := spared(text or "")):
                found, runs = tokens(text or "", spare)
            p = signature(text or "", runs)
            # the page itself, as the token that counts a host's pages
            host.append(h); page.append(p); key.append(PAGE); count.append(1); rank.append(-1); chars.append(0); run.append(False)
            for k, (n, r, c) in found.items():
                host.append(h); page.append(p); key.append(k); count.append(n); rank.append(r); chars.append(c); run.append(False)
            for k, n in runs.items():
                host.append(h); page.append(p); key.append(k); count.append(n); rank.append(-1); chars.append(0); run.append(True)
        yield pa.RecordBatch.from_pydict({
            "host": pa.array(host, pa.string()), "page": pa.array(page, pa.int64()), "key": pa.array(key, pa.int64()), "n": pa.array(count, pa.int64()),
            "rank": pa.array(rank, pa.int32()), "chars": pa.array(chars, pa.int64()), "run": pa.array(run, pa.bool_())})


def templates(pages: DataFrame) -> DataFrame:
    """(host, html) -> (host, main, constant): per host the key of the main
    slot and the keys of the template's text runs."""
    tok = pages.mapInArrow(_token_fn, "host string, page long, key long, n long, rank int, chars long, run boolean")
    # copies of a page count once
    tok = tok.groupBy("host", "key", "run", "page").agg(*[F.max(c).alias(c) for c in ("n", "rank", "chars")])
    # the occurrence vector's fingerprint: order-free over pages
    h = F.xxhash64("page", "n")
    vec = save(tok.groupBy("host", "key", "run").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("times"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 40)).alias("s"),
        # named like content: only where most of the pages that have it take it
        F.when((F.max("rank") == 1) & (2 * F.count_if(F.col("rank") == 1) <= F.count(F.lit(1))), F.lit(-1)).otherwise(F.max("rank")).alias("rank"),
        F.sum("chars").alias("chars")), "html-tokens")
    hosts = vec.where(F.col("key") == PAGE).select("host", F.col("pages").alias("all"))
    seen = vec.where(F.col("key") != PAGE).join(broadcast_within(save(hosts, "html-hosts")), "host").where(F.col("pages") >= F.col("all") * SUPPORT)
    classes = seen.groupBy("host", "pages", "times", "x", "s").agg(F.count(F.lit(1)).alias("size"))
    valid = seen.join(classes, ["host", "pages", "times", "x", "s"]).where((F.col("size") >= 2) & (F.col("all") >= 2))
    # a template's tokens stand in half of the pages, so they are at most twice a page's
    return valid.groupBy("host").agg(
        F.max(F.when(~F.col("run") & (F.col("rank") >= 0), F.struct("rank", "chars", (-F.col("key")).alias("k")))).alias("best"),
        F.collect_set(F.when(F.col("run") & (F.col("pages") >= TEXT_PAGES), F.col("key"))).alias("constant")).select(
        "host", (-F.col("best.k")).alias("main"), "constant")


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and text: the main text of every page."""
    text_batches(pages.sparkSession)
    host, _ = host_path(F.col(f"`{url_col}`"))
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), host.alias("host"), F.col(f"`{html_col}`").alias("html"))
    t = save(templates(d.select("host", "html")), "html-templates")
    j = d.join(broadcast_within(t), "host", "left").select("__row", "html", "main", "constant")

    def run(batches):
        for b in batches:
            text = [extract(p, m, frozenset(c or ())) for p, m, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["__row", "__text"])

    out = j.mapInArrow(run, T.StructType([j.schema["__row"], T.StructField("__text", T.StringType())]))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], F.col("__text").alias("text"))
