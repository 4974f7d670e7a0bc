"""Main text of web pages: page structure, and runs that repeat across a host.

Structure. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are told by element, role, class or id, and dropped. Text
in an ``article`` is the main text; without one, that in ``main``; without either,
that in a container named as content.

Host suffixes. On every page the repeated runs of its host decide too: suffixes whose
first ``run`` tokens, hashed with the host, fall on one value share so long a prefix,
and overlapping ones join to runs of any greater length. A prefix is boilerplate if
``pages`` or more pages share it that differ in the rest of their text: pages whose
sketches (32 min-hashes of their words outside dropped blocks) agree in a share of
``alike`` or more count as copies of one page. Structure is evidence that protects.

* Where structure tells nothing, suffixes start at every token of the page, dropped
  blocks included, and covered tokens go. Text outside the article of pages that
  structure does tell (menus, notices) is evidence here too; articles are not.
* In an article, main or content container suffixes start at blocks, and their prefix
  ends with the block that completes ``run`` tokens, so it holds whole blocks of the
  article alone. Its blocks go if the prefix also stands on a share of ``common`` or
  more of the host's pages: a menu or notice without a telling name stands on most
  pages, a sentence that some articles repeat doesn't. Passages quoted inside a block
  and headings (h1 to h6) always stay.

If nothing would stay, all of it stays. A page counts once for a prefix. Counts of prefixes
and their least sketches are aggregated before they are shuffled, so no line is a hot key.

Blocks: text between block-level tags; white space inside is one space; blocks are
joined by one line feed.

Defined results. Null or empty html: empty text, 0. Repeated rows are extracted alike
and count as one page of the host, as do all pages of a host with the same html. A null
page_id or url stays null. Pages without a host share the empty one. A tag that never
ends is text. Very long or malformed html takes one scan. Empty table: no rows. Other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagbill.llm.common import batches, cut, out, prepare, texts, written


@dataclass(frozen=True)
class Params:
    run: int = 8
    pages: int = 3
    #: Share of equal min-hashes from which two pages are copies of one.
    alike: float = 0.7
    #: Share of a host's pages that a run of blocks inside an article must stand on.
    common: float = 0.5


# Element and attribute names of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table
tbody td tfoot th thead tr ul""".split())
_SPACE = {"br", "td", "th"}
_DROP = set("""aside audio button canvas datalist dialog footer form head iframe input label menu nav noscript object
option select svg template textarea video""".split())
_DROP_ROLE = set("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
toolbar""".split())
_DROP_NAME = set("""ad ads adslot advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent
cookie cookies copyright disqus footer header login masthead menu modal nav navbar navigation newsletter notice
notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search
share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget""".split())
_CONTENT_NAME = set("article articlebody content entry main post story".split())
#: A name that begins with one of these tells of a page's layout, not of what the element holds.
_LAYOUT = set("has no with without".split())
_PLAIN = {"html", "body"}
_HEADING = set("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(>?)""", re.DOTALL | re.IGNORECASE)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?", re.DOTALL | re.IGNORECASE)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[a-z]+")
_ALL = (1 << 64) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(32)], np.uint64)
#: Where a block stands: dropped, anywhere, in a content container, in main, in an article.
CHROME, OPEN, CONTENT, MAIN, ARTICLE = -1, 0, 1, 2, 3


def _named(names: list[list[str]], inside: bool) -> tuple[bool, bool]:
    """(chrome, content) by the names of an element, each as its words.

    The last word says what a name means (article-footer is a footer), but a name
    that only says article, main, story or entry outweighs others beside it. An
    article's own heading is not a page header.
    """
    bad = _DROP_NAME - {"header"} if inside else _DROP_NAME
    sure = _CONTENT_NAME - {"post", "content"}
    names = [n[:-1] if n[1:] == ["header"] and n[0] in _CONTENT_NAME - {"main"} else n for n in names if n[0] not in _LAYOUT]
    content = any(n[-1] in _CONTENT_NAME or (n[0] in _CONTENT_NAME and not bad.intersection(n)) for n in names)
    chrome = any(n[-1] in bad or (bad.intersection(n) and not sure.intersection(n)) for n in names)
    return chrome and not any(sure.issuperset(n) for n in names), content


def _standing(tag: str, attrs: str, now: int) -> int:
    """Where the text of a just opened element stands, given where it is opened."""
    if now == CHROME or tag in _DROP:
        return CHROME
    names: list[list[str]] = []
    role = ""
    if attrs:
        for k, *values in _ATTR.findall(attrs):
            k, v = k.lower(), next((x for x in values if x), "")
            if k in ("class", "id", "itemprop"):
                names += [words for n in v.split() if (words := _NAME.findall(_HUMP.sub("-", n).lower()))]
                continue
            v = v.lower()
            if k == "role":
                role = v.strip()
            elif k == "hidden" or (k == "aria-hidden" and v == "true") or \
                    (k == "style" and "display:none" in v.replace(" ", "")):
                return CHROME
    if tag in _PLAIN:
        return now
    if role in _DROP_ROLE:
        return CHROME
    inside = now >= CONTENT
    chrome, content = _named(names, inside) if names else (False, False)
    if chrome and tag != "main":
        return CHROME
    if tag == "header" and not inside:
        return CHROME
    if tag == "article":
        return ARTICLE
    if tag == "main" or role == "main":
        return max(now, MAIN)
    if content and tag in ("div", "section", "td"):
        return max(now, CONTENT)
    return now


def blocks(page: str) -> list[tuple[int, str]]:
    """(where it stands, text) of each non-empty block, in page order."""
    return parse(page)[0]


def parse(page: str) -> tuple[list[tuple[int, str]], set[int]]:
    """``blocks`` of a page, and the places among them of headings; one scan of the page.

    A tag that never ends is text, as is all that follows it but comments and scripts.
    """
    found: list[tuple[int, str]] = []
    headings: set[int] = set()
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()                  # how many of each name are on the stack
    now, at, inside = OPEN, 0, 0                 # inside: open headings

    def text(piece: str) -> None:
        if piece:
            parts.append(html.unescape(piece) if "&" in piece else piece)

    def close() -> None:
        if parts:
            joined = " ".join("".join(parts).split())
            parts.clear()
            if joined:
                if inside:
                    headings.add(len(found))
                found.append((now, joined))

    for m in _TAG.finditer(page):
        tag = m.group(3)
        if tag is not None and not m.group(5):   # never ends
            break
        text(page[at:m.start()])
        at = m.end()
        if tag is None:                          # comment, script, style, declaration
            continue
        tag = tag.lower()
        if tag in _SPACE:
            parts.append(" ")
        ending = m.group(2)
        if tag in _VOID:
            if tag == "hr":
                close()
            continue
        if tag in _BLOCK or tag in _DROP:
            close()
        if not ending:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                opened[stack.pop()[0]] -= 1          # these end where the next one begins
                now = stack[-1][1] if stack else OPEN
            into = _standing(tag, m.group(4), now)
            if into != now:
                close()
            stack.append((tag, into))
            opened[tag] += 1
            inside += tag in _HEADING
            now = into
        elif opened[tag]:
            place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
            after = stack[place - 1][1] if place else OPEN
            if after != now:
                close()
            for name, _ in stack[place:]:
                opened[name] -= 1
                inside -= name in _HEADING
            del stack[place:]
            now = after
    text(_HIDDEN.sub("", page[at:]))
    close()
    return found, headings


def main_blocks(found: list[tuple[int, str]]) -> list[str] | None:
    """The blocks of the article, or None if structure doesn't tell."""
    level = max((w for w, _ in found), default=CHROME)
    return [t for w, t in found if w == level] if level > OPEN else None


def _tokens(found: list[tuple[int, str]]) -> np.ndarray:
    """Hashes of all tokens of some blocks, in order."""
    return np.array([xxhash.xxh64_intdigest(t) for _, text in found for t in text.split()], np.uint64)


def _stream(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks whose tokens form the page's stream: all but those of an article."""
    return [x for x in found if x[0] <= OPEN]


def _units(found: list[tuple[int, str]], host: int, run: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Places of the article's blocks, and (hash, first, end) of the prefix of whole blocks of each suffix among them."""
    level = max((w for w, _ in found), default=CHROME)
    places = [i for i, (w, _) in enumerate(found) if w == level] if level > OPEN else []
    sizes = [len(found[i][1].split()) for i in places]
    units, end, held = [], 0, 0
    for first, size in enumerate(sizes):
        while held < run and end < len(sizes):
            held += sizes[end]
            end += 1
        if held < run:
            break
        joined = "\n".join(found[i][1] for i in places[first:end])
        units.append((xxhash.xxh64_intdigest(joined, seed=host & _ALL), first, end))
        held -= size
    return places, units


def _prefixes(tokens: np.ndarray, host: int, run: int) -> np.ndarray:
    """Hashes of the host and the ``run``-token prefix of each suffix, in page order."""
    n = len(tokens) - run + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, host & _ALL, np.uint64)
    for k in range(run):
        h = (h ^ (h >> np.uint64(29))) * _MIX + tokens[k:k + n]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _sketch(found: list[tuple[int, str]]) -> bytes:
    """A byte of each of 32 min-hashes of the words outside dropped blocks (of all, if there are none)."""
    x = np.unique(_tokens([b for b in found if b[0] > CHROME] or found))
    return bytes(int((x * m).min() >> np.uint64(16)) & 255 for m in _MULTIPLIERS)


def _without_units(found: list[tuple[int, str]], headings: set[int], repeated: set[int], host: int, run: int) -> list[str]:
    """The blocks of the article without those that repeated runs of blocks hold."""
    places, units = _units(found, host, run)
    gone = {k for w, first, end in units if w in repeated for k in range(first, end)}
    kept = [found[i][1] for k, i in enumerate(places) if k not in gone or i in headings]
    return kept or [found[i][1] for i in places]


def _without_runs(found: list[tuple[int, str]], starts: np.ndarray, run: int) -> list[str]:
    """The open blocks without what repeated suffixes cover."""
    hit: set[int] = {q for s in starts.tolist() for q in range(s, s + run)}
    kept, place = [], 0
    for w, t in found:
        words = t.split()
        if w == OPEN:
            left = [x for k, x in enumerate(words) if place + k not in hit]
            if left:
                kept.append(" ".join(left))
        place += len(words)
    return kept or [t for w, t in found if w == OPEN]


def _unlike(held: DataFrame, p: Params) -> DataFrame:
    """The prefixes (w) of (w, sketch) that ``pages`` pages share which differ from each other.

    Each round takes a prefix's least sketch as a leader and leaves out the pages like it.
    """
    left = held.distinct()
    for _ in range(p.pages - 1):
        left = cut(left)
        leaders = left.groupBy(F.col("w").alias("of")).agg(F.min("sketch").alias("leader"))
        equal = F.expr("size(filter(sequence(1, octet_length(sketch)), i -> substring(sketch, i, 1) = substring(leader, i, 1)))")
        left = (left.join(leaders, F.col("w") == F.col("of"))
                .filter(equal < F.lit(p.alike) * F.octet_length("sketch")).select("w", "sketch"))
    return left.select("w").distinct()


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^.*?://([^/?#]*)", 1))


def extract(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    prepare(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    keyed = (pages.withColumn("host", F.xxhash64(_host(F.col("url"))))
             .withColumn("page", F.xxhash64("host", "html")))
    parsed = pa.schema([("page", pa.int64()), ("host", pa.int64()), ("sketch", pa.binary()),
                        ("units", pa.list_(pa.int64())), ("stream", pa.list_(pa.int64()))])

    def suffixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = []
            for host, page, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
                if found := blocks(t):
                    units = np.unique(np.array([w for w, _, _ in _units(found, host, p.run)[1]], np.uint64))
                    stream = np.unique(_prefixes(_tokens(_stream(found)), host, p.run))
                    rows.append((page, host, _sketch(found), units.view(np.int64), stream.view(np.int64)))
            if rows:
                yield out(parsed, *zip(*rows))

    told = written(keyed.select("host", "page", "html")
                   .mapInArrow(suffixes, "page long, host long, sketch binary, units array<long>, stream array<long>")
                   .dropDuplicates(["page"]))                # pages with the same html are one
    hosts = told.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("host_pages"))
    unit = F.col("pos") < F.size("units")
    prefixes = (told.select("*", F.posexplode(F.concat("units", "stream")).alias("pos", "w"))
                .select("w", "host", "page", "sketch", unit.alias("unit"),
                        (unit | (F.size("units") == 0)).alias("own")))
    # prefixes that enough pages share and that decide on at least one of them
    frequent = written(prefixes.groupBy("w", "unit").agg(F.count("*").alias("n"), F.max("own").alias("decides"))
                       .filter((F.col("n") >= p.pages) & F.col("decides"))
                       .select(F.col("w").alias("v"), F.col("unit").alias("u"), "n"))
    enough = ~F.col("unit") | (F.col("n") >= F.lit(p.common) * F.col("host_pages"))
    held = written(prefixes.join(frequent, (F.col("w") == F.col("v")) & (F.col("unit") == F.col("u")))
                   .join(hosts, F.col("host") == F.col("of")).filter(enough).select("w", "page", "sketch", "own"))
    shared = _unlike(held.select("w", "sketch"), p).withColumnRenamed("w", "v")
    repeats = written(held.filter("own").join(shared, F.col("w") == F.col("v"))
                      .groupBy("page").agg(F.collect_list("w").alias("repeats")))      # bounded by a page's tokens
    result = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    kinds = "page_id long, url string, text string, n_chars long"

    def main_text(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            done = []
            for t, host, repeated in zip(texts(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
                found, headings = parse(t)
                level = max((w for w, _ in found), default=CHROME)
                if level > OPEN and repeated:
                    kept = _without_units(found, headings, {w & _ALL for w in repeated}, host, p.run)
                elif level == OPEN and repeated:
                    ws = _prefixes(_tokens(found), host, p.run).view(np.int64)
                    kept = _without_runs(found, np.flatnonzero(np.isin(ws, np.array(repeated, np.int64))), p.run)
                else:
                    kept = [x for w, x in found if w == level and w > CHROME]
                done.append("\n".join(kept))
            yield out(result, b.column(0), b.column(1), done, [len(t) for t in done])

    return (keyed.join(repeats, "page", "left").select("page_id", "url", "html", "host", "repeats")
            .mapInArrow(main_text, kinds))
