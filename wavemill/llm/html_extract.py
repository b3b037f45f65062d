"""Main text of web pages: blocks by markup, and a suffix array for each host.

* Blocks: the markup cuts a page into blocks of text.  Elements that mark furniture (menus,
  page headers, footers, asides, forms, scripts, ...) settle theirs as boilerplate; article and
  main elements settle theirs as content.  Class, id and role names are hints only: they count
  as whole names, and never empty an article or a page.
* Host suffix array: the token streams of all pages of a host, less what is settled as content,
  are concatenated.  Suffixes are ranked by their first RUN tokens, so that repeats stand
  together whatever page or partition they come from; a token is *repeated* if a run of RUN
  tokens that covers it also stands on another page of the host.  The array is dealt by
  (host, rank) and counted before it is dealt, so a host may have any number of pages.
* Decision: content stays whole, because an article that is copied to another page is an
  article still, and so is a line that many articles hold.  Of the blocks that the markup
  leaves open, covered boilerplate goes and unique runs stay; where all of a page is
  repeated, the tokens repeated on the fewest pages stay (a copied page has its text still).
  Blocks within an article that only a doubtful hint calls furniture go if they are repeated.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import Scratch, slices

RUN = 8
WEIGHTS = np.random.default_rng(5).integers(0, 1 << 63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

# Element names by what they do.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "title", "iframe", "object", "svg", "canvas", "audio", "video"}
MAIN = {"article", "main"}
OPAQUE = "script|style|noscript|template|textarea|noembed|noframes|title"
# Names of classes, ids and roles that leave little doubt, and those that content has too.
SURE = {
    "ad", "ads", "advert", "advertisement", "adverts", "sponsored", "sidebar", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "comment", "comments", "disqus", "cookie", "cookies", "newsletter", "contentinfo",
}
DOUBTFUL = {
    "sponsor", "promo", "promotion", "banner", "consent", "notice", "notices", "alert", "popup", "modal", "subscribe", "signup", "menu", "nav",
    "header", "masthead", "footer", "share", "sharing", "social", "related", "login", "widget", "complementary",
}

TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({OPAQUE})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
# Zones: settled as boilerplate or content; left open; hinted at outside an article, and within
# one by a sure or a doubtful name; an article within a block that is hinted at.
BOILERPLATE, OPEN, ARTICLE, HINTED, SURELY, DOUBT, TEASER = range(7)


def _hint(attributes: str, inside: bool) -> int | None:
    names = {w for n in NAMED.finditer(attributes) for w in (n[1] or n[2] or n[3] or "").lower().split()}
    if names & SURE:
        return SURELY if inside else HINTED
    return (DOUBT if inside else HINTED) if names & DOUBTFUL else None


def _inner(zone: int, name: str, attributes: str, nested: bool) -> int:
    """The zone within an element; nested: it stands in an article element."""
    inside = zone in (ARTICLE, SURELY, DOUBT)
    if name in MAIN:
        # An article within an article is a comment or the like.  Menus hold no articles: an
        # element of furniture that seems to was never closed.
        if zone in (HINTED, TEASER):
            return TEASER
        return ARTICLE if not inside else SURELY if nested and name == "article" else zone
    if name in FURNITURE and not (inside and name == "header"):
        return BOILERPLATE
    if name in ("html", "body"):
        return zone
    if zone in (OPEN, ARTICLE, DOUBT) and "=" in attributes and (hint := _hint(attributes, inside)) is not None:
        return hint
    return zone


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks that have text, in page order."""
    page, out, parts, stack = page or "", [], [], []
    zone = OPEN

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((zone, text))

    def close(name):
        """Ends the innermost open element of this name and all within it, if there is one."""
        nonlocal zone
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                zone = stack[i][1]
                del stack[i:]
                return

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        inline = name in INLINE
        if m[2] or m[5]:
            if not inline:
                flush()
            elif any(s[0] == name for s in stack):
                flush()
            close(name)
            continue
        attributes = m[4] if m[3] else m[7]
        if not inline:
            flush()
            # A paragraph ends where another block begins, a list item where the next one does.
            if stack and (stack[-1][0] == "p" or name == "li" == stack[-1][0]):
                close(stack[-1][0])
        inner = _inner(zone, name, attributes, any(e[0] == "article" for e in stack))
        if name in VOID or inline and inner == zone:
            continue
        if inline:
            flush()
        stack.append((name, zone))
        zone = inner
    parts.append(html.unescape(page[at:]))
    flush()
    return out


def settle_hints(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Hints take effect where they leave something, else they don't count."""
    zones = {z for z, _ in found}
    if TEASER in zones:
        found = [(z if z != TEASER else HINTED if zones & {ARTICLE, SURELY, DOUBT} else ARTICLE, t) for z, t in found]
        zones = {z for z, _ in found}
    if zones & {ARTICLE, SURELY, DOUBT}:
        sure = BOILERPLATE if zones & {ARTICLE, DOUBT} else ARTICLE
        return [(sure if z == SURELY else BOILERPLATE if z in (HINTED, OPEN) else z, t) for z, t in found]
    return [((BOILERPLATE if OPEN in zones else OPEN) if z == HINTED else z, t) for z, t in found]


def undecided(found: list[tuple[int, str]]) -> bool:
    return any(z in (OPEN, DOUBT) for z, _ in found)


def stream(found: list[tuple[int, str]]) -> list[str]:
    """The tokens of a page that take part in its host's suffix array."""
    return [w for z, t in found if z != ARTICLE for w in t.split(" ")]


def ranks(tokens: list[str]) -> np.ndarray:
    """For each suffix of RUN tokens or more a hash of its first RUN ones."""
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in tokens), np.uint64, len(tokens))
    n = max(0, len(h) - RUN + 1)
    total = np.zeros(n, np.uint64)
    for k in range(RUN if n else 0):
        total += h[k : k + n] * WEIGHTS[k]
    return (total ^ total >> np.uint64(32)) * WEIGHTS[0]


def main_text(found: list[tuple[int, str]], starts, pages) -> str:
    """The text of a page whose suffixes at ``starts`` are repeated on so many ``pages``."""
    tokens = len(stream(found))
    on = np.ones(tokens + RUN, np.int64)
    for a, n in zip(starts, pages):
        np.maximum(on[a : a + RUN], n, out=on[a : a + RUN])
    kept, at, content = [], 0, any(z == ARTICLE for z, _ in found)
    doubt, left = [], [on[0:0]]
    for z, t in found:
        if z == ARTICLE:
            continue
        n = t.count(" ") + 1
        if z == OPEN:
            left.append(on[at : at + n])
        elif z == DOUBT:
            doubt.append(bool((on[at : at + n] > 1).all()))
        at += n
    least = max(1, int(np.concatenate(left).min(initial=1 << 62)))
    stay = not content and all(doubt)  # nothing else is there
    at = 0
    for z, t in found:
        words = t.split(" ")
        if z == ARTICLE or z == DOUBT and (stay or not (on[at : at + len(words)] > 1).all()):
            kept += words
        elif z == OPEN:
            kept += [w for w, n in zip(words, on[at : at + len(words)].tolist()) if n <= least]
        at += 0 if z == ARTICLE else len(words)
    return " ".join(kept)


PARSED = "page_id long, url string, hash long, host long, text string, zones array<tinyint>, texts array<string>"


def _parse(batches):
    """Settled pages get their text; all keep the blocks that the suffix array needs."""
    for batch in slices(batches):
        found = [settle_hints(blocks(h)) for h in batch.column("html").to_pylist()]
        open_ = [undecided(b) for b in found]
        text = pa.array([None if o else " ".join(t for z, t in b if z == ARTICLE) for b, o in zip(found, open_)], pa.string())
        kept = [b if o else [x for x in b if x[0] != ARTICLE] for b, o in zip(found, open_)]
        zones = pa.array([[z for z, _ in b] for b in kept], pa.list_(pa.int8()))
        texts = pa.array([[t for _, t in b] for b in kept], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "hash", "host")), text, zones, texts], names=["page_id", "url", "hash", "host", "text", "zones", "texts"])


def _found(batch):
    return [list(zip(z, t)) for z, t in zip(batch.column("zones").to_pylist(), batch.column("texts").to_pylist())]


def _counted(batches):
    """(host, rank) once for each page."""
    for batch in slices(batches):
        own = [np.unique(ranks(stream(b))) for b in _found(batch)]
        hosts = np.repeat(batch.column("host").to_numpy(), [len(r) for r in own])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(np.concatenate(own).view(np.int64) if own else [], pa.int64())], names=["host", "rank"])


def _asked(batches):
    """(host, rank, page, place) for each suffix of the undecided pages."""
    for batch in slices(batches):
        own = [ranks(stream(b)) for b in _found(batch)]
        n = [len(r) for r in own]
        spread = [batch.column(c).take(pa.array(np.repeat(np.arange(len(n)), n))) for c in ("host", "page_id", "hash")]
        rank = pa.array(np.concatenate(own).view(np.int64) if own else [], pa.int64())
        place = pa.array(np.concatenate([np.arange(k) for k in n]) if n else [], pa.int32())
        yield pa.RecordBatch.from_arrays([spread[0], rank, *spread[1:], place], names=["host", "rank", "page_id", "hash", "place"])


def _decide(batches):
    for batch in slices(batches):
        texts = []
        for found, starts, pages in zip(_found(batch), batch.column("places").to_pylist(), batch.column("pages").to_pylist()):
            texts.append(main_text(found, starts or (), pages or ()))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text.  Pages without a host (null or malformed url)
    form a host of their own.  Repeated rows are pages each, copies of each other; other
    columns are not read.  An empty table gives no rows."""
    scratch = Scratch(pages.sparkSession)
    url, page, source = F.col(url_col).cast("string"), F.col(id_col).cast("long"), F.col(html_col).cast("string")
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)))
    rows = pages.select(page.alias("page_id"), url.alias("url"), F.xxhash64(url, source).alias("hash"), host.alias("host"), source.alias("html"))
    parsed = scratch.save(rows.mapInArrow(_parse, PARSED))
    counts = parsed.select("host", "zones", "texts").mapInArrow(_counted, "host long, rank long").groupBy("host", "rank").agg(F.count("*").cast("int").alias("pages"))
    open_ = parsed.where("text IS NULL")
    # Both sides are plain tables, so that Spark can split a run that very many pages hold.
    repeated = scratch.save(counts.where("pages > 1"))
    asked = scratch.save(open_.select("host", "page_id", "hash", "zones", "texts").mapInArrow(_asked, "host long, rank long, page_id long, hash long, place int"))
    met = asked.join(repeated, ["host", "rank"]).groupBy("page_id", "hash").agg(F.collect_list(F.struct("place", "pages")).alias("met"))
    met = met.select(F.col("page_id").alias("__id"), F.col("hash").alias("__hash"), F.col("met.place").alias("places"), F.col("met.pages").alias("pages"))
    decided = open_.join(met, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left").select("page_id", "url", "zones", "texts", "places", "pages")
    texts = parsed.where("text IS NOT NULL").select("page_id", "url", "text").unionByName(decided.mapInArrow(_decide, "page_id long, url string, text string"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
