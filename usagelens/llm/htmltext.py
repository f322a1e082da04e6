"""Main text of web pages: structure first, then a host suffix array.

Each page is cut into blocks of three zones: *main* (inside an article or main
element), *marked* (menus, headers, footers, sidebars, notices, adverts, reader
comments) and *open* (neither). A page's text is its main blocks, where a page
has none its open ones; both are judged by the host.

Open blocks: the token streams of all pages of a host (marked and open blocks) form one suffix array, of which only
suffixes that share their first ``RUN`` tokens matter. Sorting by those tokens
is a shuffle by (host, hash of RUN tokens, content), pre-aggregated, so a host of
any size is split over many tasks; the union of all substrings of at least RUN
tokens that occur on enough different contents is exactly the union of the
repeated RUN-token runs. Covered tokens are boilerplate and go, the other runs
stay. A content is what a page says outside marked blocks, so copies under any
ids and urls count once; enough are log2 of the host's contents, two at least.

Main blocks: articles quote each other, so a run there has to lie on a quarter
of the host's contents, eight at least, and a block goes only as a whole: if it
has RUN tokens or more and runs of the host's main blocks cover them all. Then
its first run is repeated as well; the others are only sorted for the blocks
that pass this. An article of which less than half would be left is a near copy
of others and stays whole.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.llm.common import col, stored

RUN = 24
SALTS = 64             # parts into which a host is dealt where its size is looked up
MARKED, OPEN, MAIN = 0, 1, 2

# Fixed values of HTML: elements by the way they are treated.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg annotation annotation-xml noembed noframes xmp select button".split())
DROPPED = frozenset("nav aside footer form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
# Words in class or id names that mark boilerplate.
HINTS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice notices nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer popup modal
newsletter subscribe subscription share sharing social related recommended comments comment disqus replies respond
toolbar pagination pager skip login signup""".split())
# Words that name a place or a shape: beside a hint they leave a name boilerplate.
SHAPES = frozenset("""area bar block body bottom box btn button buttons card cards center container content embed entry footer form frame
group head header heading icon icons inline inner item items label large left link links list medium mobile module outer panel post posts
right row section slot small stories tags text title tool tools top unit widget wrap wrapper""".split())
OUTSIDE_HINTS = frozenset("header masthead topbar".split())
COMMENT_HINTS = frozenset("comment comments reply replies".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)", re.S)
_UNQUOTED = re.compile("[^>\"']*+")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marked(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether a start tag opens boilerplate. Outside of an article any part of a
    class or id name may say so; inside one the whole name has to: with parts
    that are neither hints nor shapes nor sizes ("related-work", "notice-board")
    it is taken for prose."""
    if tag in DROPPED or (tag == "header" and not in_main):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    words: set[str] = set()
    whole = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for word in value.split():
                parts = {w for w in _PART.split(_CAMEL.sub("-", word).lower()) if w}
                words |= parts
                whole = whole or (bool(parts & HINTS) and all(w in HINTS or w in SHAPES or w[0].isdigit() for w in parts))
        elif name == "role" and value.lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
    if tag in ("article", "main"):
        return bool(words & COMMENT_HINTS)
    return whole if in_main else bool(words & (HINTS | OUTSIDE_HINTS))


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """Where the tag ends whose name ends at ``at``: at the first '>' outside of
    quotes, or, if quotes leave none, at the first '>' (or the page's end).
    ``dead`` holds the quotes of the page from which no end is reached, so that
    no quote is followed twice in vain, whatever the page holds."""
    pos, opened = at, []
    while True:
        pos = _UNQUOTED.match(html, pos).end()
        if html[pos:pos + 1] == ">":
            return pos
        shut = -1 if pos >= len(html) or pos in dead else html.find(html[pos], pos + 1)
        if pos < len(html):
            opened.append(pos)
        if shut < 0:
            dead.update(opened)
            end = html.find(">", at)
            return len(html) if end < 0 else end
        pos = shut + 1


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order. White space (and <br>) inside
    a block becomes one space, references are decoded, empty blocks vanish."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    html = html or ""
    main = 0                   # open article and main elements
    skip, depth = "", 0        # element that hides what follows, and how often it is open
    head = False

    def zone() -> int:
        return MARKED if skip else MAIN if main else OPEN

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((zone(), text))

    def text(chunk: str):
        if chunk and not head:
            parts.append(unescape(chunk) if "&" in chunk else chunk)

    at, dead = 0, set()
    endless: set[str] = set()  # raw elements that no end tag follows any more
    while True:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        end = _tag_end(html, at, dead)
        tag, closing, attrs = name.lower(), bool(m[1]), html[at:end]
        at = min(end + 1, len(html))
        if tag in RAW and not closing:
            if not attrs.endswith("/"):
                end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if end is None:
                    endless.add(tag)
                # an unclosed script or style runs to the end of the page, other unclosed elements are passed over
                at = end.end() if end else len(html) if tag in ("script", "style") else at
            continue
        if tag == "head":
            flush()
            head = not closing
            continue
        if head and (tag in BLOCKS or tag == "body"):
            parts.clear()
            head = False
        if tag == "br":
            text("\n")
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if skip:
            # an article ends boilerplate that was never closed; a paragraph or list item ends at the next one
            if not closing and tag in ("article", "main") and not main and skip not in ("article", "main") and not _marked(tag, attrs, False):
                flush()
                skip, depth = "", 0
            elif skip in ("p", "li") and not closing and (tag == skip or (skip == "p" and tag in BLOCKS)):
                skip, depth = "", 0
            else:
                if tag == skip:
                    depth += -1 if closing else 1
                    if depth == 0:
                        flush()
                        skip = ""
                continue
        if closing:
            if tag in ("article", "main") and main:
                main -= 1
            continue
        if not attrs.endswith("/") and _marked(tag, attrs, main > 0):
            flush()
            skip, depth = tag, 1
        elif tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I):
            main += 1 if tag in ("article", "main") else 0
    flush()
    return out


_BLOCKS = "array<struct<zone:int,text:string>>"


def _parse(html: Column) -> Column:
    @F.pandas_udf(_BLOCKS)
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([[{"zone": z, "text": t} for z, t in blocks(h)] for h in pages])

    return run(html)


def _often(runs: DataFrame, contents: DataFrame, enough: Column) -> DataFrame:
    """(rh, rk): host and hash of the runs (host, h, content) that occur in
    ``enough`` (a number made of the host's ``contents``) distinct contents."""
    sizes = (contents.groupBy("host").agg(F.count_distinct("content").alias("contents"))
             .select(F.col("host").alias("sh"), enough.alias("enough"),
                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    return (runs.groupBy("host", "h").agg(F.count_distinct("content").alias("n")).where("n > 1")
            .join(sizes, (F.col("host") == F.col("sh")) & (F.pmod("h", F.lit(SALTS)) == F.col("salt")))
            .where("n >= enough").select(F.col("host").alias("rh"), F.col("h").alias("rk")))


def _of(often: DataFrame) -> Column:
    return (F.col("host") == F.col("rh")) & (F.col("h") == F.col("rk"))


def repeated_runs(streams: DataFrame, run: int = RUN) -> DataFrame:
    """(row, starts): where runs of ``run`` tokens start that occur in enough
    distinct contents of the host: log2 of their number, rounded down, and two at
    least. ``streams``: row, host, content, tokens, wanted (whether the row's
    starts are asked for). A stream shorter than ``run`` counts as one run of its
    own length. Pages of equal content are one."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - run, F.lit(0)))
    keys = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("tokens", i + 1, F.lit(run))).alias("h")))
    runs = streams.where(F.size("tokens") > 0).withColumn("keys", keys).select("row", "host", "content", "wanted", F.inline_outer("keys"))
    often = _often(runs, streams, F.greatest(F.lit(2), F.floor(F.log2("contents"))))
    found = runs.where("wanted").join(often, _of(often), "left_semi")
    return found.groupBy("row").agg(F.collect_set("pos").alias("starts"))


def repeated_blocks(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(row, gone): which main blocks (by their index in ``blocks``) are covered
    by runs of ``run`` tokens that lie in main blocks of a quarter of the host's
    distinct contents, eight at least. ``pages``: row, host, content, blocks.
    Blocks of fewer tokens are never named."""
    enough = F.greatest(F.lit(8), F.ceil(F.col("contents") / 4))
    main = (pages.select("row", "host", "content", F.posexplode("blocks").alias("block", "b")).where(F.col("b.zone") == MAIN)
            .select("row", "host", "content", "block", F.col("b.text").alias("text")))
    first = F.slice(F.split("text", " ", run + 1), 1, run)
    begun = main.where(F.size(first) == run).withColumn("h", F.xxhash64(first))
    # few pass; stored, so that a short list is known as one and the texts stay where they are
    heads = stored(_often(begun.select("host", "h", "content"), pages, enough), "page-heads")
    like = begun.join(heads, _of(heads), "left_semi").select("row", "host", "content", "block", F.split("text", " ").alias("tokens"))
    starts = F.sequence(F.lit(0), F.size("tokens") - run)
    keys = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("tokens", i + 1, F.lit(run))).alias("h")))
    runs = like.select("row", "host", "content", "block", F.size("tokens").alias("size"), F.inline(keys))
    often = _often(runs, pages, enough)
    found = runs.join(often, _of(often), "left_semi").groupBy("row", "block", "size").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # covered: from the first token to the last, no two neighbouring runs further apart than their length
    gaps = F.exists(F.sequence(F.lit(1), F.size("at")), lambda i: F.coalesce(F.get("at", i), F.col("size")) - F.get("at", i - 1) > run)
    return found.where((F.get("at", F.lit(0)) == 0) & ~gaps).groupBy("row").agg(F.collect_list("block").alias("gone"))


@F.pandas_udf(T.StringType())
def _unique(found: pd.Series, starts: pd.Series) -> pd.Series:
    """Open blocks without the tokens that repeated runs cover."""
    def one(page, covered):
        at, out, gone = 0, [], set()
        for s in ([] if covered is None else covered):
            gone.update(range(s, s + RUN))
        for b in page:
            if b["zone"] == MAIN:
                continue
            tokens = b["text"].split(" ")
            if b["zone"] == OPEN:
                kept = " ".join(t for i, t in enumerate(tokens, at) if i not in gone)
                if kept:
                    out.append(kept)
            at += len(tokens)
        return "\n\n".join(out)

    return pd.Series([one(p, c) for p, c in zip(found, starts)], dtype=object)


def _content() -> Column:
    """Hash of what a page says in main and open blocks, of a page without any in its marked ones."""
    main, free, marked = (F.array_join(F.transform(F.filter("blocks", lambda b: b["zone"] == z), lambda b: b["text"]), " ")
                          for z in (MAIN, OPEN, MARKED))
    return F.xxhash64(main, free, F.when((main == "") & (free == ""), marked).otherwise(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html, or a page of boilerplate only, has an empty text. Null
    ids and urls are kept (pages without a host form one host); equal rows come
    back as often as they occur; pages of equal text, and articles that are near
    copies of each other, never make each other boilerplate, whatever their ids, urls and menus; other columns are ignored;
    an empty table gives an empty result."""
    host = F.lower(F.coalesce(F.regexp_extract(col(pages, url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    parsed = stored(pages.select(
        F.monotonically_increasing_id().alias("row"), col(pages, id_col).alias("page_id"), col(pages, url_col).alias("url"),
        host.alias("host"), _parse(col(pages, html_col)).alias("blocks")).withColumn("content", _content()), "pages")
    has_main = F.exists("blocks", lambda b: b["zone"] == MAIN)
    has_open = F.exists("blocks", lambda b: b["zone"] == OPEN)
    gone = stored(repeated_blocks(parsed), "page-notices")
    whole, left = (F.array_join(F.transform(F.filter("blocks", keep), lambda b: b["text"]), "\n\n") for keep in (
        lambda b: b["zone"] == MAIN, lambda b, i: (b["zone"] == MAIN) & ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i)))
    text = F.when(F.col("gone").isNull() | (2 * F.char_length(left) < F.char_length(whole)), whole).otherwise(left)
    clear = parsed.where(has_main | ~has_open).join(gone, "row", "left").select("page_id", "url", text.alias("text"))

    # single spaces only: blocks are normalised, so tokens are what lies between spaces
    stream = F.flatten(F.transform(F.filter("blocks", lambda b: b["zone"] != MAIN), lambda b: F.split(b["text"], " ")))
    streams = parsed.select("row", "host", "content", stream.alias("tokens"), (~has_main & has_open).alias("wanted"))
    runs = repeated_runs(streams)
    unclear = parsed.where(~has_main & has_open)
    judged = unclear.join(runs, "row", "left").select("page_id", "url", _unique("blocks", "starts").alias("text"))
    return clear.union(judged).withColumn("n_chars", F.char_length("text").cast("bigint"))
