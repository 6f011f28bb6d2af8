"""Main text of web pages by equivalence classes of occurrence vectors (operator 8).

Tokens of a page are its element paths (names with their roles) and its text blocks, each under its path. Over the pages of
a host every token has an occurrence vector (the pages that have it); tokens with one vector form an equivalence class. A
text block is template if it is in the class of its own element path (so the class is nested: each of its texts lies in an
element of the class), if that class also has an element of the layout (the page itself, a labelled element or one that lays
out others, outside of articles and main elements), if it has enough pages, if its blocks are no more than half of the text of
its pages (a class that holds more is a group of copies, and its text is data), and if the block has one place among the
class's blocks on all pages. So each layout of a host has template text of its own, and text that some pages of a layout lack is never template.

The main slot is what varies: the blocks that are no template and lie in no element that announces menus, adverts, forms,
comments and the like; where a page marks an article or main element, those in it.

Execution: vectors are never gathered. Each task sums, for each (host, path, block), pages, text and an exclusive-or of page
hashes, which identifies the vector; partial sums meet in one aggregation, and classes are found by equality joins. A second
scan numbers the blocks of each class on each page, and keeps the least and greatest number. Pages are never grouped by host: template keys are broadcast where their checked size allows it, and otherwise joined with the host
salted. Paths are chains of 64-bit hashes, so they are whole at any depth.

Defined cases: null html is empty and gives the empty string; pages of any length are read whole, at most 256 of them at a time; a null url is a host of its own; repeated rows stay repeated;
pages of which all blocks are template keep them; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as tk

#: Pages that a class needs, and the most of its pages' text that a class of template text holds.
SUPPORT, TEMPLATE_SHARE = 3, 0.5
MOST_ENTRIES, SALTS, BROADCAST_HOSTS = 100_000, 16, 50_000

#: Element names by how they lay out or end (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg math xmp noembed noframes".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",)}
#: Elements, roles and name parts that announce something else than main text (fixed values).
ASIDE = frozenset("nav footer aside form button select option menu dialog head object canvas audio video input label fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer foot sidebar widget cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond search toolbar pagination pager copyright skip masthead topbar".split()
)
#: Elements that hold text and lay out nothing.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre blockquote".split())
MAIN_WORDS = frozenset("article content main post story entry body text".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


class Element:
    __slots__ = ("name", "path", "aside", "main")

    def __init__(self, name: str, path: int, aside: bool, main: bool):
        self.name, self.path, self.aside, self.main = name, path, aside, main


def _element(name: str, attributes: str, parent: Element) -> Element:
    role = ""
    aside = name in ASIDE or (name == "header" and not parent.main)
    main = parent.main or name in ("article", "main")
    if attributes and name not in ("html", "body"):
        found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attributes)}
        if found:
            names = f"{found.get('class', '')} {found.get('id', '')}"
            words = {w.lower() for w in _WORD.findall(names)}
            if "role" in found and found["role"].lower() in ASIDE_ROLES or "hidden" in found:
                aside = True
            if words & ASIDE_WORDS and not words & MAIN_WORDS - {"text", "body"} and name not in ("article", "main"):
                aside = True
            if words & {"comment", "comments", "commentlist", "sidebar"} and name not in ("article", "main"):
                aside = True
            role = "." + "-".join(sorted(words)) if words else ""
    return Element(name, _hash(parent.path, name, role), aside or parent.aside, main)


def blocks(page: str) -> Iterator[tuple[Element, str, int]]:
    """(block's element, text, path of the outermost ``article``/``main`` or 0) in page order."""
    root = Element("", 0, False, False)
    stack, outer = [root], [0]
    parts: list[str] = []
    at, size = 0, len(page)

    def close_block():
        nonlocal parts
        text = " ".join("".join(parts).split())
        parts = []
        return (_block_of(stack), text, outer[-1]) if text else None

    def add(raw: str):
        if raw:
            parts.append(html_lib.unescape(raw) if "&" in raw else raw)

    def pop_to(depth: int):
        del stack[depth:], outer[depth:]

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if end:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if depth:
                if name not in INLINE or any(e.name not in INLINE for e in stack[depth:]):
                    if (b := close_block()) is not None:
                        yield b
                pop_to(depth)
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = at if attributes.rstrip().endswith("/") else stop.end() if stop else size
            continue
        if name in INLINE:
            if name == "br":
                parts.append("\n")
            elif name not in VOID:
                stack.append(_element(name, attributes, stack[-1]))
                outer.append(outer[-1])
            continue
        if (b := close_block()) is not None:
            yield b
        if name in ENDS_P:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == "p"), 0)
            if depth:
                pop_to(depth)
        if name in ENDS_SELF:
            within = max((k for k in range(1, len(stack)) if stack[k].name in ENDS_SELF[name]), default=0)
            depth = next((k for k in range(len(stack) - 1, within, -1) if stack[k].name == name or (name in ("dt", "dd", "td", "th") and stack[k].name in ("dt", "dd", "td", "th"))), 0)
            if depth:
                pop_to(depth)
        if name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(_element(name, attributes, stack[-1]))
            outer.append(outer[-1] or (stack[-1].path if name in ("article", "main") and not stack[-1].aside else 0))
    if (b := close_block()) is not None:
        yield b


def _block_of(stack: list[Element]) -> Element:
    """The innermost element that lays out a block, with what inline elements around the text add."""
    for e in reversed(stack):
        if e.name not in INLINE:
            return e
    return stack[0]


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", url or "")
    return m[1].lower() if m else ""


def _runs(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short slices of the batches, so that few pages are Python strings at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


_STATS = "host string, path long, block long, pages long, vector long, chars long, whole long, layout long"
_STATS_SCHEMA = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in ("path", "block", "pages", "vector", "chars", "whole", "layout"))])


def _key(e: Element, text: str) -> int:
    return _hash(e.path, text)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the task's pages for each (host, path, block), block 0 the path itself.

    whole is all unlabelled text of the pages; layout is 1 for elements that lay out the page outside of articles.
    """
    sums: dict[tuple, list[int]] = {}

    def flush():
        rows = [(*k, *v) for k, v in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] if k == 0 else int(r[k]) for r in rows], f.type) for k, f in enumerate(_STATS_SCHEMA)], schema=_STATS_SCHEMA)

    for batch in _runs(batches):
        for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            host, seen, whole, layout = _host(url), {(0, 0): 0}, 0, {0}
            for e, text, own in blocks(page or ""):
                seen.setdefault((e.path, 0), 0)
                if not own and (e.aside or e.name not in TEXTUAL):
                    layout.add(e.path)
                if e.aside:
                    continue
                whole += len(text)
                key = (e.path, _key(e, text))
                seen[key] = seen.get(key, 0) + len(text)
            who = _hash(page_id, url)
            for (path, block), chars in seen.items():
                s = sums.setdefault((host, path, block), [0, 0, 0, 0, 0])
                s[0] += 1
                s[1] ^= who
                s[2] += chars
                s[3] += whole
                s[4] |= block == 0 and path in layout
            if len(sums) >= MOST_ENTRIES:
                yield flush()
    if sums:
        yield flush()


def _join_hosts(rows: DataFrame, hosts: DataFrame, spread: Column, how: str) -> DataFrame:
    """Joins a row for each host to ``rows``: broadcast up to a checked number of hosts, else with each host salted."""
    if hosts.count() <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(hosts), "host", how)
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], how)


_HOST = r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)"


def _with_host(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with their host and its columns, where it has any."""
    host = F.coalesce(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit(""))
    return _join_hosts(pages.withColumn("host", host), hosts, F.xxhash64("page_id"), "left")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, block, low, high): the least and greatest place of a block among those of its class, in page order."""
    schema = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in ("block", "low", "high"))])
    found: dict[tuple, list[int]] = {}

    def flush():
        rows = [(*k, *v) for k, v in found.items()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for batch in _runs(batches):
        for host, page, own in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "fixed"))):
            kind = {x["block"]: x["class"] for x in own}
            seen: set[int] = set()
            place: dict[int, int] = {}
            for e, text, _ in blocks(page or ""):
                key = _key(e, text)
                if e.aside or key not in kind or key in seen:
                    continue
                seen.add(key)
                k = place[kind[key]] = place.get(kind[key], -1) + 1
                low_high = found.setdefault((host, key), [k, k])
                low_high[0], low_high[1] = min(low_high[0], k), max(low_high[1], k)
        if len(found) >= MOST_ENTRIES:
            yield flush()
    if found:
        yield flush()


def templates(pages: DataFrame) -> DataFrame:
    """(host, fixed) from rows (page_id, url, html): the keys of each host's template text."""
    stats = pages.mapInArrow(tk.lean(_count), _STATS).groupBy("host", "path", "block").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "whole")], F.bit_xor("vector").alias("vector"), F.max("layout").alias("layout"))
    stats = common.stored(stats.filter(F.col("pages") >= SUPPORT), name="page-tokens")
    own = stats.filter("block = 0").select("host", "path", "pages", "vector")
    text = stats.filter("block <> 0")
    held = text.groupBy("host", "pages", "vector").agg(F.sum("chars").alias("held"), F.max("whole").alias("of"))
    laid = stats.filter("block = 0 and layout = 1").select("host", "pages", "vector")
    valid = held.filter(F.col("held") <= TEMPLATE_SHARE * F.col("of")).select("host", "pages", "vector").join(laid, ["host", "pages", "vector"], "left_semi")
    fixed = text.join(own, ["host", "path", "pages", "vector"], "left_semi").join(valid, ["host", "pages", "vector"], "left_semi")
    fixed = common.stored(fixed.select("host", "block", F.xxhash64("pages", "vector").alias("class")), name="page-classes")
    hosts = fixed.groupBy("host").agg(F.collect_set(F.struct("block", "class")).alias("fixed"))
    kept = _with_host(pages, hosts).filter("fixed is not null").select("host", "html", "fixed")
    seen = kept.mapInArrow(tk.lean(_places), "host string, block long, low long, high long").groupBy("host", "block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ordered = fixed.join(seen.filter("low = high").select("host", "block"), ["host", "block"], "left_semi")
    return ordered.groupBy("host").agg(F.sort_array(F.collect_set("block")).alias("fixed"))


def main_text(page: str, host: str | None, fixed: frozenset | set) -> str:
    """The unlabelled blocks that are no template of the host, in the page's own article or main element where it has one."""
    found = [b for b in blocks(page) if not b[0].aside]
    inside = [b for b in found if b[2]] or found
    kept = [b for b in inside if _key(b[0], b[1]) not in fixed] if fixed else inside
    return "\n\n".join(b[1] for b in kept or inside)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    common.short_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    with common.scratch(pages.sparkSession) as keep:
        found = keep(common.stored(templates(rows), name="templates"))
    joined = _with_host(rows, found)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset] = {}
        for batch in _runs(batches):
            out = []
            for own, page, fixed in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "fixed"))):
                if fixed and own not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[own] = frozenset(fixed)
                out.append(main_text(page or "", own, sets[own] if fixed else frozenset()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema=schema)

    return joined.select("page_id", "url", "html", "host", "fixed").mapInArrow(tk.lean(run), "page_id long, url string, text string, n_chars long")
