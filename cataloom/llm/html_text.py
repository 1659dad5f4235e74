"""Main text of web pages by two-pass block rules.

The markup is cut into blocks.  The first pass classifies each by its container, its length and its densities of
stop words and links; short blocks that these leave open inherit, in the second pass, the class of the
nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Frequent function words of four languages.
STOP_WORDS = frozenset("""
the of and to a in is it you that he was for on are as with his they at be this have from or had by not but what all were we when your can said there an each which she do how their if
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum haben nur oder
de la que el en y los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde
le les des et à une du dans qui ne pas ce il sur au par plus son avec est ou sa se son mais nous leur vous elle
""".split())
# HTML element names by what they do to text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select button canvas audio video".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog head".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figure td th".split())
CLOSES_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "option", "legend", "summary"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
# Words in class, id and role attributes that name what isn't the article.
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert banner popup modal newsletter subscribe subscription comment comments disqus respond reply replies related recommended share sharing social widget toolbar pagination pager copyright contentinfo complementary search".split())

# Of these, the words for what readers add or pages recommend; an article inside is the page's own only if there is no other.
FOREIGN = frozenset("comment comments disqus respond reply replies related recommended".split())
# First words of class names that tell of the page's layout ("has-sidebar"), not of the element.
LAYOUT = frozenset("has no with without is not".split())

# Words that say nothing of what an element holds: "comment-list" names comments, "share-price" names no sharing.
NEUTRAL = frozenset("area bar block body box button buttons container content form group holder inner item items left link links list main outer panel post posts primary right row secondary section signup site slot thread top unit wrap wrapper".split())

LONG, STOP_DENSITY, LINK_DENSITY = 80, 0.12, 0.5
#: Below this share of stop words in all its long blocks, a page is in a language without a list.
KNOWN_DENSITY = 0.02
#: Whether a block is boilerplate: by the name of an element around it or a form, which an article or main inside undoes; by a name of FOREIGN,
#: which one undoes if the page has no other; or for good.
NAMED, ADDED, ALWAYS = 1, 2, 3
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class _Block:
    text: str
    linked: int
    boilerplate: int
    article: bool
    heading: bool
    lone: bool = False


def _tag_end(page: str, at: int) -> int:
    """The place after a tag's ``>``; quoted values may hold one.  An open quote doesn't count."""
    start = at
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        close = page.find(m[0], m.end())
        if close < 0:
            end = page.find(">", start)
            return end + 1 if end >= 0 else len(page)
        at = close + 1
    return len(page)


def _hints(attributes: str, strict: bool) -> frozenset[str]:
    """Words in class, id and role values that name what isn't the article.

    ``strict``: names of several words count only if none of the words says anything else."""
    out: set[str] = set()
    for found in _HINT.findall(attributes):
        for name in "".join(found).lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if words and words[0] not in LAYOUT and not (strict and set(words) - HINTS - NEUTRAL):
                out.update(HINTS.intersection(words))
    return frozenset(out)


def blocks(page: str) -> Iterator[_Block]:
    """The page's text blocks in order; markup, comments, scripts and the like are left out."""
    # Name, boilerplate, article and lone (an article in what is ADDED), with those of all around it.
    stack: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked, anchors, heading = 0, 0, False
    at, n = 0, len(page)

    def flush() -> Iterator[_Block]:
        nonlocal linked, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, boilerplate, article, lone = stack[-1] if stack else ("", 0, False, False)
            yield _Block(text, linked, boilerplate, article, heading, lone)
        parts.clear()
        linked, heading = 0, False

    def close(names: tuple[str, ...]) -> None:
        """Ends the innermost open element of these names, unless a container lies between."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in BLOCKS:
                return

    while at < n:
        cut = page.find("<", at)
        cut = n if cut < 0 else cut
        if cut > at:
            parts.append(page[at:cut])
            if anchors:
                linked += len(page[at:cut].strip())
        if cut == n:
            break
        m = _TAG.match(page, cut)
        if not m:
            if page.startswith("<!--", cut):
                end = page.find("-->", cut + 4)
                at = n if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), cut):
                end = page.find(">", cut)
                at = n if end < 0 else end + 1
            else:  # a bare "<" is text
                parts.append("<")
                at = cut + 1
            continue
        closing, name, at = m[1] == "/", m[2].lower(), _tag_end(page, m.end())
        attributes = page[m.end() : at]
        if name in RAW:
            if not closing and not attributes.endswith("/>"):
                end = re.compile(rf"</{name}\b", re.I).search(page, at)
                at = _tag_end(page, end.end()) if end else n
            continue
        if name in BLOCKS:
            yield from flush()
        elif name == "br":
            parts.append(" ")
        if name == "a":
            anchors = max(0, anchors - 1) if closing else anchors + 1
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in VOID:
            continue
        if name in CLOSES_P:
            close(("p",))
        if name in SAME:
            close(SAME[name])
        if name in BLOCKS:
            anchors = 0
        heading = heading or name in {"h1", "h2", "h3", "h4", "h5", "h6"}
        _, boilerplate, article, lone = stack[-1] if stack else ("", 0, False, False)
        own = name in {"article", "main"}
        hints = _hints(attributes, article or own or name in TEXTUAL) if attributes and name not in {"body", "html"} else frozenset()
        if own and not article:
            boilerplate = 0 if boilerplate == NAMED else boilerplate
            lone = boilerplate == ADDED
        if name in BOILERPLATE or (hints & FOREIGN and (own or article)):
            boilerplate = ALWAYS
        elif hints & FOREIGN:
            boilerplate = max(boilerplate, ADDED)
        elif name == "form" or (hints and not own):
            boilerplate = max(boilerplate, NAMED)
            lone = lone and not article
        stack.append((name, boilerplate, article or own, lone))
    yield from flush()


def _words(text: str) -> list[str]:
    return [w.strip(".,;:!?'\"()[]*#&$%").lower() for w in text.split()]


def _length(text: str) -> int:
    """Code points, ideographs and the like counting three times: they are words rather than letters."""
    return len(text) + 2 * sum(c >= "\u2e80" for c in text)


def _settled(found: list[_Block], names: bool = True) -> list[_Block]:
    """The blocks with boilerplate decided (0 or not): an article in what is ADDED is the page's own if there is no other.

    Without ``names`` only what is boilerplate for good stays so."""
    told = any(b.article and not b.boilerplate for b in found)
    undone = {NAMED, ADDED} if not names else set()
    return [replace(b, boilerplate=0) if b.boilerplate in undone or (b.lone and b.boilerplate == ADDED and not told) else b for b in found]


def _first_pass(found: list[_Block]) -> list[bool | None]:
    """True: content, False: boilerplate, None: open."""
    told = any(b.article and not b.boilerplate for b in found)
    words = [_words(b.text) for b in found]
    stops = [sum(w in STOP_WORDS for w in ws) for ws in words]
    linked = [b.linked > LINK_DENSITY * len(b.text) for b in found]
    long = [i for i, b in enumerate(found) if not b.boilerplate and not linked[i] and _length(b.text) >= LONG]
    foreign = sum(stops[i] for i in long) < KNOWN_DENSITY * sum(len(words[i]) for i in long)
    out: list[bool | None] = []
    for i, b in enumerate(found):
        dense = stops[i] >= STOP_DENSITY * len(words[i])
        if b.boilerplate or linked[i]:
            out.append(False)
        elif b.article and (b.heading or _length(b.text) >= LONG or dense):
            out.append(True)
        elif told and not b.article:
            out.append(False)
        elif _length(b.text) >= LONG:
            out.append(dense or foreign)
        else:
            out.append(None)
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by a space; an empty text for a null, empty or articleless page.

    Where names around the text would leave nothing of it, they don't count."""
    read = list(blocks(page or ""))
    found = _settled(read)
    first = _first_pass(found)
    if all(c is False for c in first):
        again = _settled(read, names=False)
        if True in (second := _first_pass(again)):
            found, first = again, second
    # Second pass: nearest decided neighbours among the blocks that aren't boilerplate by their container.
    near = [i for i, c in enumerate(first) if c is not None and not found[i].boilerplate]
    sided = {side: [k for k in near if found[k].article == side] or near for side in (True, False)}
    keep = []
    for i, c in enumerate(first):
        if c is None:
            around = sided[found[i].article]
            place = bisect_left(around, i)
            before, after = around[place - 1] if place else None, around[place] if place < len(around) else None
            if before is None or after is None:
                side = before if after is None else after
                c = True if side is None else first[side]
            else:
                c = first[before] if first[before] == first[after] or i - before <= after - i else first[after]
        keep.append(c)
    return " ".join(b.text for b, c in zip(found, keep, strict=True) if c)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; null and empty pages have an empty text.

    ``pages`` needs page_id, url and html; other columns are left out.  One row per input row, repeated rows included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
