"""Main text of web pages by role and tag names, with a host's template where these do not decide.

Tokens are elements told apart by their path and role (tag, class and id), and text nodes outside
of articles. A token's occurrence vector is how often it stands on each page of a host. Tokens that
half of the host's pages share, inside elements that are shared too, may be the host's template; those
with the same vector are one equivalence class. A class is part of the layout if it holds an element:
text that recurs on pages of its own, without an element that comes and goes with it, is a quotation or a
text told twice, and no template. What stands inside the template's article or main element is kept (on
pages without such an element, all text that is not template), and page furniture is left out by role. A
layout on fewer than half of a host's pages has no template.

Scale: vectors are never gathered: a vector is the XOR of a hash of (page, count) over the pages,
with the number of pages and occurrences, so Spark folds it before the shuffle however many pages
a host has. A host's template is bounded by what half of its pages share. Pages meet their host's
template in a join that Spark can broadcast or split where a host holds many pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm.common import stash

SUPPORT = 0.5  # of a host's pages
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']+|\"[^\"]*\"|'[^']*')*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = re.compile(r"<(script|style|textarea|title|noscript|template|iframe|svg)\b", re.I)
# fixed values of HTML: elements without an end tag, blocks, and elements an open paragraph ends at
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option
    p pre section summary table tbody td tfoot th thead tr ul caption head""".split())
# fixed values: elements and words of class, id and role that mark what is not the article
FURNITURE = frozenset("""nav footer aside form script style noscript template iframe svg head title button select
    textarea input dialog menu object canvas audio video fieldset""".split())
FURNITURE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion
    sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent banner notice notices
    alert popup modal overlay newsletter subscribe subscription share sharing social related recommended comment
    comments respond reply replies disqus search login signup widget toolbar copyright pagination pager masthead
    complementary contentinfo form""".split())
MAIN = frozenset(("article", "main"))


def _roles(tag: str) -> tuple[str, ...]:
    return tuple(sorted({w for m in _ROLE.finditer(tag) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w}))


_parsed: dict[str, tuple] = {}


def _tag(token: str) -> tuple[str, bool, bool, str, bool, bool]:
    """(name, is an end tag, closes itself, role, is furniture, has a furniture word); the commonest are kept."""
    known = _parsed.get(token)
    if known is None:
        name = _NAME.match(token)[1].lower()
        roles = _roles(token)
        known = (name, token[1] == "/", name in VOID or token.endswith("/>"), " ".join((name, *roles)),
                 name in FURNITURE, not FURNITURE_WORDS.isdisjoint(roles) and name not in ("html", "body"))
        if len(_parsed) < 20_000 and len(token) < 200:
            _parsed[token] = known
    return known


class Page:
    """One pass over a page: tags with their paths, and text with the elements around it.

    ``events`` holds (kind, path hash, name, text): "open" and "close" of elements, "text". Text in
    elements with a furniture word is left out, unless they hold the page's main content: then the
    page is passed over again without heeding the words of these elements.
    """

    def __init__(self, source: str):
        self.events: list[tuple[str, int, str, str]] = []
        reopened = self._pass(source, frozenset())
        if reopened:
            self.events = []
            self._pass(source, reopened)

    def _pass(self, source: str, reopened: frozenset[int]) -> frozenset[int]:
        """Fill ``events``; the numbers of the elements with furniture words that hold the main content.

        These are the ones around the largest article or main element if it has more text than all that
        show; on a page without such an element, the ones around the first h1 if none shows, or the
        largest if nothing shows.
        """
        # name, path hash, furniture around, elements with furniture words around, articles around
        stack: list[tuple[str, int, bool, tuple[int, ...], tuple[int, ...]]] = []
        number = shown = shown_main = 0
        mains: dict[int, list] = {}  # article or main: length of its text, elements with furniture words around
        listed: dict[int, int] = {}  # outermost element with a furniture word: length of its text
        headings: list[tuple[int, ...]] = []
        at, end = 0, len(source)
        add = self.events.append

        def pop(depth: int) -> None:
            while len(stack) > depth:
                name, path, *_ = stack.pop()
                add(("close", path, name, ""))

        while at < end:
            m = _TOKEN.match(source, at)
            token, at = m[0], m.end()
            if token[0] != "<" or len(token) == 1:
                inside = stack[-1] if stack else ("", 0, False, (), ())
                if inside[2]:
                    continue
                size = len(token.strip())
                for main in inside[4]:
                    mains[main][0] += size
                if inside[3]:
                    listed[inside[3][0]] = listed.get(inside[3][0], 0) + size
                    continue
                shown += size
                shown_main += size if inside[4] else 0
                add(("text", inside[1], inside[0], token))
                continue
            if token[1] in "!?":
                continue
            name, closing, alone, role, furniture, word = _tag(token)
            if closing:
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] != name:
                    depth -= 1
                if depth >= 0:
                    pop(depth)
                continue
            if name in BLOCKS:  # an open paragraph ends where a block begins; list items end each other
                ends = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
                        "option": "option"}.get(name, "").split()
                depth = len(stack) - 1
                while depth >= 0:
                    opened = stack[depth][0]
                    if opened == "p" or opened in ends:
                        pop(depth)
                    elif opened in BLOCKS:
                        break
                    depth -= 1
            above = stack[-1] if stack else ("", 0, False, (), ())
            path = xxhash.xxh3_64_intdigest(role, seed=above[1]) >> 1
            inside_main = any(s[0] in MAIN for s in stack)
            hidden = above[2] or furniture or name == "header" and not inside_main
            number += 1
            words = above[3] + (number,) if word and number not in reopened else above[3]
            around = above[4]
            if name in MAIN and not hidden and not alone:
                mains[number] = [0, words]
                around += (number,)
            if name == "h1" and not hidden:
                headings.append(words)
            add(("open", path, name, ""))
            raw = _RAW.match(token)
            if raw and not alone:  # its content is no markup
                close = re.compile(rf"</{raw[1]}\b[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                add(("close", path, name, ""))
            elif alone:
                add(("close", path, name, ""))
            else:
                stack.append((name, path, hidden, words, around))
        pop(0)
        if mains:
            size, words = max(mains.values(), key=lambda m: m[0])
            return frozenset(words) if size > shown_main else frozenset()
        if headings and all(headings):
            return frozenset(headings[0])
        return frozenset([max(listed, key=listed.get)]) if listed and not shown else frozenset()


def _text_token(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(text.split()), seed=path) >> 1


def occurrences(page: Page) -> dict[int, tuple[int, int, int, bool]]:
    """For each token: (times, first place, path of the element above, is text).

    Tokens are elements, and whole text nodes outside of article and main elements.
    """
    out: dict[int, list] = {}
    stack, inside = [0], 0
    for place, (kind, path, name, text) in enumerate(page.events):
        if kind == "open":
            out.setdefault(path, [0, place, stack[-1], False])[0] += 1
            stack.append(path)
            inside += name in MAIN
        elif kind == "close":
            stack.pop()
            inside -= name in MAIN
        elif not inside and not text.isspace():
            out.setdefault(_text_token(path, text), [0, place, path, True])[0] += 1
    return {k: tuple(v) for k, v in out.items()}


def main_text(page: Page, template: set[int]) -> str:
    """Text of the article's slots, one line per block.

    The article is what stands inside the template's article or main elements; on a page without
    one, inside any such element; on a page without any, all text that is not itself template.
    """
    found = {path: name for kind, path, name, _ in page.events if kind == "open" and name in MAIN}
    main = {path for path in found if path in template} or set(found)
    lines, block, inside = [], [], 0

    def close_block() -> None:
        line = " ".join("".join(block).split())
        block.clear()
        if line:
            lines.append(line)

    for kind, path, name, text in page.events:
        if kind == "text":
            if inside or not main and _text_token(path, text) not in template:
                block.append(html.unescape(text) if "&" in text else text)
            continue
        if name in BLOCKS:
            close_block()
        elif name == "br":
            block.append(" ")
        if path in main:
            inside += 1 if kind == "open" else -1
    close_block()
    return "\n".join(lines)


def _host(url: str) -> F.Column:
    """Host of the url, lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Template of each host of ``pages(host, page_key, html)``: (host, tokens), each inside a frequent element
    and of a class that holds an element.

    ``page_key`` is a hash of the html; pages of a host with the same key count once.
    ``tokens`` lists (place, token, class): places rise with the order on the host's pages.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(7)]
            for host, key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for token, (times, place, above, is_text) in occurrences(Page(value.as_py() or "")).items():
                    mark = xxhash.xxh3_64_intdigest(str(times), seed=key & (2**64 - 1)) >> 1
                    for column, v in zip(out, (host, token, mark, times, place, above, is_text)):
                        column.append(v)
            kinds = [pa.string()] + [pa.int64()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             ["host", "token", "mark", "times", "place", "above", "is_text"])

    # copies of a page are one page: they say nothing about what the host's pages have in common
    seen = pages.select("host", "page_key", "html").dropDuplicates(["host", "page_key"]).mapInArrow(
        scan, "host string, token long, mark long, times long, place long, above long, is_text boolean")
    vectors = seen.groupBy("host", "token").agg(
        F.bit_xor("mark").alias("vector"), F.count("*").alias("pages"), F.sum("times").alias("times"),
        F.min("place").alias("place"), F.min("above").alias("above"), F.max("is_text").alias("is_text"))
    hosts = pages.groupBy("host").agg(F.count_distinct("page_key").alias("host_pages"))
    # text is template only where several pages agree on it
    frequent = stash(vectors.join(hosts, "host").where(
        (F.col("pages") >= F.col("host_pages") * support) & (~F.col("is_text") | (F.col("pages") >= 3))))
    # tokens nest: every one stands inside a frequent element, or at the top
    elements = frequent.where("not is_text").select("host", F.col("token").alias("above"))
    nested = frequent.where("above <> 0").join(elements, ["host", "above"], "left_semi").unionByName(
        frequent.where("above = 0"))
    by_vector = Window.partitionBy("host").orderBy("vector", "pages", "times")
    classes = nested.withColumn("class", F.dense_rank().over(by_vector))
    # a class without an element is no layout: its texts recur for themselves
    layout = F.max(~F.col("is_text")).over(Window.partitionBy("host", "class"))
    return (classes.withColumn("layout", layout).where("layout").groupBy("host")
            .agg(F.array_sort(F.collect_list(F.struct("place", "token", "class"))).alias("tokens")))


def extract(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Main text of every row of ``pages(page_id, url, html)``: page_id, url, text, n_chars.

    Null html counts as empty; an empty page, or one without article text, has an empty text. Pages
    without a host in the url (or without a url) form one host of their own. Rows are handled one
    by one, repeated rows and ids included.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", _host("url"))
    known = templates(rows.select("host", F.xxhash64("html").alias("page_key"), "html"), support)
    joined = rows.join(known, "host", "left").select("html", "page_id", "url", "tokens.token")
    kind = pages.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(Page(source.as_py() or ""), set(tokens.as_py() or ()))
                   for source, tokens in zip(batch.column(0), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
