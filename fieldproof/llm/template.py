"""Equivalence-class template deduction: what a host's pages share, and the text in the slots.

A page is a run of blocks, each under a path of elements. Its tokens, in page
order, are each block's path and its text under that path, wherever the block
stands. Per host, grouping adds up each token's occurrence vector over the distinct
payloads (how many pages, least and most per page, and an exclusive-or of a hash of
page and count, which is equal for equal vectors); tokens of equal vectors are a
class, if they span enough of the pages and are two at least.

A second pass over the pages nests the classes. A class has to repeat one order of
its tokens; a token stays in it where the same token of the class comes before it on
every page. Read from the start, a class opens in the slot behind the last token of
the class that is open around it, and has to end there before that one goes on: a
class that crosses another, or lies in different slots, is no template. Texts of what
remains are template where their path keeps its place and occurs equally often on
every page; where the number changes, the path is a list inside a slot and its texts stay, however often
they repeat. What is left is the slots' text.

Tags are evidence besides: blocks inside elements that are no article text by their
kind go, and where <article> holds at least half of the text left on a page, the rest
goes. A template that would take more than half of the text declared by <article> or
<main> is a sign of near copies, and that text then stays.

Defined cases: null html has no text (empty); null url or one without a host has
no template; equal payloads of a host count once; a host of fewer than three has
none; extra columns are not read. Broken markup is read in one pass: a comment,
script or style that never closes goes to the page's end, where no ">" follows the
rest is text, and after a quote that never closes quotes are plain characters.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.common import map_batches
from fieldproof.session import cut_lineage

#: A class spans at least this share of a host's pages, and so many pages and tokens.
SHARE, LEAST_PAGES, LEAST_TOKENS = 0.8, 3, 2

#: Element kinds, after the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head title nav footer aside form button select textarea label menu dialog noscript iframe object svg math template canvas audio video".split())
#: Words of class, id and role that mark what is no article text.
NO_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "disqus footer header menu nav navbar navigation newsletter notice notices popup promo promotion related respond search share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements that an opening of the same kind closes.
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())

#: Elements that hold running text; inside an article only a whole class, id or role drops them.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")


class Block(NamedTuple):
    path: int  # a hash over the elements around it
    text: str
    inside: bool  # of <article>
    declared: bool  # inside <article> or <main>
    no_text: bool  # by kind of an element around it


class Tag(NamedTuple):
    start: int
    end: int
    name: str  # empty for comments and declarations
    closing: bool
    attributes: str


def markup(page: str) -> Iterator[Tag]:
    """Tags, comments and declarations in page order; every character is passed a bounded number of times."""
    last, quotes, at = page.rfind(">"), True, 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith(("!", "?"), at):
            if page.startswith("<!--", start):
                ending, found = "-->", page.find("-->", start + 4)
            elif page.startswith("<![CDATA[", start):
                ending, found = "]]>", page.find("]]>", start + 9)
            elif start > last:
                continue
            else:
                ending, found = ">", page.find(">", at)
            at = len(page) if found < 0 else found + len(ending)
            yield Tag(start, at, "", False, "")
            continue
        if start > last:
            continue
        closing = page.startswith("/", at)
        name = _NAME.match(page, at + closing)
        if not name:
            continue
        end = name.end()
        while quotes:
            stop = _STOP.search(page, end)
            if stop and stop[0] == ">":
                end = stop.start()
                break
            end = page.find(stop[0], stop.end()) + 1 if stop else 0
            if not end:
                quotes = False
        if not quotes:
            end = page.find(">", name.end())
        at, kind = end + 1, name[0].lower()
        if kind in _RAW_END and not closing:
            found = _RAW_END[kind].search(page, at)
            at = found.end() if found else len(page)
            yield Tag(start, at, "", False, "")
            continue
        yield Tag(start, at, kind, closing, page[name.end():end])


def _marks(attributes: str) -> tuple[list[str], bool, bool]:
    """Words of class, id and role; whether one marks no text, and whether a whole one does."""
    values = [(m[1] or m[2] or m[3] or "").lower() for m in _MARKS.finditer(attributes)]
    words = [w for v in values for w in _WORDS.findall(v)]
    return words, not NO_TEXT_WORDS.isdisjoint(words), not NO_TEXT_WORDS.isdisjoint(w for v in values for w in v.split())


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    #: name, path, inside an article, declared, no text
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            _, path, inside, declared, no_text = stack[-1]
            out.append(Block(path, text, inside, declared, no_text))

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at = 0
    for tag in markup(page):
        if tag.start > at:
            parts.append(page[at:tag.start])
        at, name = tag.end, tag.name
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        flush()
        if tag.closing:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in CLOSED_BY_SAME and stack[-1][0] == name:
            pop()
        if name == "body":
            while stack[-1][0] == "head":
                pop()
        if name in VOID or tag.attributes.endswith("/"):
            continue
        _, path, inside, declared, no_text = stack[-1]
        marks, marked, wholly = _marks(tag.attributes) if tag.attributes else ([], False, False)
        if declared and name in RUNNING:
            marked = wholly
        article = name == "article"
        bad = name in NO_TEXT or name == "header" and not declared or name not in ("html", "body", "article", "main") and marked
        stack.append((name, _token(path, ".".join([name, *marks])), inside or article, declared or article or name == "main", no_text or bad))
        opened[name] += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _token(path: int, text: str) -> int:
    value = xxhash.xxh64_intdigest(f"{path}\0{text}")
    return value - (1 << 64) if value >> 63 else value


def host_of(url: str) -> F.Column:
    return F.regexp_extract(F.lower(F.coalesce(F.col(url).cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def page_tokens(page: str) -> Iterator[tuple[int, int]]:
    """(token, path) in page order: of every block its path (with path 0) and then its text."""
    for block in blocks(page):
        yield block.path, 0
        yield _token(block.path, block.text), block.path


def _tokens(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """host, digest, token, the token of its path (0 for paths) and count, of each of the batch's payloads."""
    out: list[tuple] = []
    seen: set[tuple[str, int]] = set()
    for host, page, digest in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2).to_pylist()):
        if (host, digest) not in seen:
            seen.add((host, digest))
            out += [(host, digest, t, p, n) for (t, p), n in Counter(page_tokens(page.as_py())).items()]
    if out:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["host", "digest", "token", "path", "n"])


def nesting(tokens: Iterable[int], class_of: dict[int, int]) -> dict[int, tuple[int, int, bool]]:
    """Per token of a class on this page: the class's token before it, the token before its class's slot, whether the class breaks.

    Zero stands for none. A class breaks by a changing order, by crossing the one
    around it and by lying in several slots.
    """
    run = [(t, class_of[t]) for t in tokens if t in class_of]
    turns: dict[int, list[int]] = {}
    for token, kind in run:
        turns.setdefault(kind, []).append(token)
    order = {k: list(dict.fromkeys(ts)) for k, ts in turns.items()}
    broken = {k for k, ts in turns.items() if ts != order[k] * (len(ts) // len(order[k]))}
    place = {t: i for ts in order.values() for i, t in enumerate(ts)}
    slots: dict[int, set[int]] = {k: set() for k in turns}
    around: list[list[int]] = []  # class and its last token
    for token, kind in run:
        if kind in broken:
            continue
        if place[token] == 0:
            slots[kind].add(around[-1][1] if around else 0)
            around.append([kind, token])
        else:
            while around[-1][0] != kind:
                broken.add(around.pop()[0])
            around[-1][1] = token
        if place[token] == len(order[kind]) - 1:
            around.pop()
    return {
        t: (order[k][i - 1] if i else 0, min(slots[k], default=0), k in broken or len(slots[k]) > 1)
        for k, ts in order.items() for i, t in enumerate(ts)
    }


def _nested(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """host, token, before, slot, broken; rows that say the same are one per batch."""
    classes: dict[str, dict[int, int]] = {}
    out: set[tuple] = set()
    for host, page, tokens, kinds in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2), rows.column(3)):
        if host not in classes:
            classes[host] = dict(zip(tokens.as_py(), kinds.as_py()))
        out.update((host, t, *found) for t, found in nesting((t for t, _ in page_tokens(page.as_py())), classes[host]).items())
    if out:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], ["host", "token", "before", "slot", "broken"])


def templates(pages: DataFrame) -> DataFrame:
    """host, template: hashes of the texts that are its template; about a page's texts at most."""
    rows = pages.select(host_of("url").alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html")).filter("host <> ''")
    # Equal payloads count once: their tokens are folded, so no payload is moved.
    digested = rows.withColumn("digest", F.xxhash64("html"))
    vector = [F.count(F.lit(1)).alias("pages"), F.min("n").alias("least"), F.max("n").alias("most"), F.bit_xor(F.xxhash64("digest", "n")).alias("seen")]
    tokens = (
        map_batches(digested, _tokens, "host string, digest long, token long, path long, n long").dropDuplicates(["host", "digest", "token", "path"])
        .groupBy("host", "token", "path").agg(*vector).filter(F.col("pages") >= LEAST_PAGES)
    )
    hosts = digested.groupBy("host").agg(F.count_distinct("digest").alias("of")).filter(F.col("of") >= LEAST_PAGES)
    wide = cut_lineage(tokens.join(hosts, "host").filter(F.col("pages") >= F.lit(SHARE) * F.col("of")).withColumn("kind", F.xxhash64("pages", "seen")))
    one_class = ["host", "kind"]
    sized = lambda df: df.join(df.groupBy(*one_class).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= LEAST_TOKENS), one_class)
    # One list per host: a class is on most of its pages, so its tokens are about a page's.
    classes = cut_lineage(sized(wide).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "kind"))).alias("members")))
    placed = map_batches(
        rows.join(classes, "host").select("host", "html", F.col("members.token").alias("tokens"), F.col("members.kind").alias("kinds")),
        _nested, "host string, token long, before long, slot long, broken boolean",
    )
    steady = placed.groupBy("host", "token").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("before", "slot") for f in (F.min, F.max)), F.max("broken").alias("broken"))
    judged = cut_lineage(steady.select("host", "token", F.expr("NOT broken AND min_before = max_before AND min_slot = max_slot").alias("steady")))
    nested, moving = judged.filter("steady").drop("steady"), judged.filter("NOT steady").select("host", F.col("token").alias("path"))
    even = wide.filter("path = 0 AND least = most").select("host", F.col("token").alias("path")).join(moving, ["host", "path"], "left_anti")
    return cut_lineage(
        sized(wide.join(nested, ["host", "token"])).filter("path <> 0").join(even, ["host", "path"])
        .groupBy("host").agg(F.collect_set("token").alias("template"))
    )


def _size(found: Iterable[Block]) -> int:
    return sum(len(b.text) for b in found)


def main_text(page: str, template: frozenset[int]) -> str:
    """The blocks left in the slots, two line ends between them."""
    whole = [b for b in blocks(page) if not b.no_text]
    left = [b for b in whole if _token(b.path, b.text) not in template] if template else whole
    if 2 * _size(b for b in left if b.declared) < _size(b for b in whole if b.declared):
        left = [b for b in whole if b.declared or _token(b.path, b.text) not in template]
    if 2 * _size(b for b in left if b.inside) >= _size(left):
        left = [b for b in left if b.inside]
    return "\n\n".join(b.text for b in left)


def _extracted(rows: pa.RecordBatch) -> pa.RecordBatch:
    known: dict[tuple, frozenset] = {}
    texts = []
    for page, template in zip(rows.column(2), rows.column(3).to_pylist()):
        key = tuple(template or ())
        found = known.setdefault(key, frozenset(key))
        texts.append(main_text(page.as_py(), found))
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page.

    The templates are read from a written table, so Spark sends them to every
    task only where their size allows it and else splits a hot host's pages.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host_of("url").alias("host"))
    joined = rows.join(templates(pages), "host", "left").select("page_id", "url", "html", "template")
    return map_batches(joined, _extracted, "page_id long, url string, text string")
