"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block from its own features: its length, link density and stop-word
density, with the containers it is in as a prior. The second pass gives ambiguous short or near-good blocks the label of their nearest decided neighbours.
One scan, no shuffle; every row is independent, and a page costs memory in proportion to its own length.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches

TAG = re.compile(
    r"<(?:!--(?:.*?--!?>|.*)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*>|.*))", re.S
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
WORD = re.compile(r"[^\W\d_]+")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "svg", "math", "iframe", "object", "select", "option", "button", "audio", "video", "canvas", "noembed", "noframes", "xmp"}
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
BLOCK = set("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul br".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Containers that are seldom main text, and those that mostly are.
DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "header"}
KEEP = {"article", "main"}
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: Words in class, id or role that mark a container as no main text.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup sidebar side menu nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer comment comments "
    "disqus reply replies responses share sharing social related recommended recommendations widget toolbar pagination pager login search form copyright "
    "disclaimer skip hidden contentinfo complementary dialog".split()
)
BODY_HINTS = frozenset("article post entry content story main articlebody".split())
STOP = frozenset(
    "the of and to a in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei wird sie nach einer um am "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont "
    "el y los del las por con no para su al lo como más o pero sus le ha me si sin sobre".split()
)


class Rules:
    """Thresholds of the two passes; lengths in characters."""

    short, long = 70, 200
    low, high = 0.20, 0.30
    links = 0.34
    article_links = 0.67
    revive = 400
    heading_reach = 200


#: Marks of containers: main text, nothing said, no main text by a class word or a form, by a tag, hidden.
MAIN, OPEN, UNLIKELY, ASIDE, HIDDEN = 1, 0, -1, -2, -3


def _container(tag: str, attrs: str) -> int:
    """The mark of a container by itself. Class words of html and body are of the page's layout and say nothing."""
    if tag in KEEP and not ("hidden" in attrs or "style" in attrs):
        return MAIN
    if tag in DROP and not ("hidden" in attrs or "style" in attrs):
        return UNLIKELY if tag == "form" else ASIDE
    by_tag = MAIN if tag in KEEP else (UNLIKELY if tag == "form" else ASIDE) if tag in DROP else OPEN
    if "=" not in attrs and "hidden" not in attrs:
        return by_tag
    main = False
    words: set = set()
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).strip()
        if name in ("class", "id", "role"):
            words.update(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", value))
            main |= name == "role" and value.lower() == "main"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return HIDDEN
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HIDDEN
        elif name == "itemprop" and value == "articleBody":
            main = True
    if by_tag:
        return by_tag
    if main:
        return MAIN
    hit = words & HINTS
    if hit and tag not in ("html", "body") and not (hit == {"header"} and words & BODY_HINTS):
        return UNLIKELY
    return OPEN


def _inside(mark: int, own: int, tag: str) -> int:
    """The mark inside a container of mark `own` that stands in one of mark `mark`."""
    if mark == UNLIKELY and own == MAIN:  # a class word outside says less than the element; comments are articles too
        return OPEN if tag == "article" else MAIN
    if mark < 0:
        return min(mark, own)
    if tag == "header" and mark > 0 and own != HIDDEN:
        return mark
    return mark if own == OPEN else own


def _closed_links(html: str) -> set[int]:
    """Where the links start that are closed before the next one starts."""
    out, at = set(), None
    for m in LINK.finditer(html):
        if not m[1]:
            at = m.start()
        elif at is not None:
            out.add(at)
            at = None
    return out


def blocks(html: str):
    """Yields (text, link characters, heading?, container mark) of the blocks in page order; texts are never empty.

    The mark is below 0 inside a container that is hardly main text, 1 inside one that mostly is, else 0; the lowest wins, but a `header` inside main text says nothing,
    and neither does a class word outside an `article`. Time is in proportion to the page, however its tags nest or stay open.
    """
    parts: list[str] = []
    linked = anchors = 0
    heading = False
    stack: list[tuple[str, int]] = []  # open containers
    depth: Counter = Counter()  # open containers by name
    endless: set[str] = set()  # raw elements that are never closed from here on
    whole = _closed_links(html)
    mark = at = 0

    def pop() -> None:
        depth[stack.pop()[0]] -= 1

    def push(tag: str, mark: int) -> None:
        stack.append((tag, mark))
        depth[tag] += 1

    def flush():
        text = "".join(parts)
        parts.clear()
        text = " ".join((unescape(text) if "&" in text else text).split())
        return (text, min(linked, len(text)), heading, mark) if text else None

    while at < len(html):
        m = TAG.search(html, at)
        end = m.start() if m else len(html)
        if end > at:
            parts.append(html[at:end])
            if anchors:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag == "a":
            anchors = 0 if closing else 1 if m.start() in whole else 2
            continue
        if tag in RAW and not closing:
            if not m[3].rstrip(">").endswith("/"):
                done = None if tag in endless else RAW_END[tag].search(html, at)
                if done is None:
                    endless.add(tag)
                at = done.end() if done else (len(html) if tag in ("script", "style", "title", "textarea", "xmp") else at)
            continue
        if tag not in BLOCK:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if found := flush():
            yield found
        linked = 0
        if anchors == 2:  # a link that is never closed ends with its block
            anchors = 0
        if closing:
            heading = False
            if depth[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
                mark = stack[-1][1] if stack else 0
            continue
        heading = tag in HEADINGS
        if tag in VOID:
            continue
        if tag == "body":
            stack.clear()
            depth.clear()
            mark = 0
        if tag == "p" or tag in HEADINGS or tag == "li":
            # ends an open sibling; only worth a place on the stack if it says something
            own = _container(tag, m[3])
            if stack and stack[-1][0] == tag:
                pop()
                mark = stack[-1][1] if stack else 0
            if own:
                mark = _inside(mark, own, tag)
                push(tag, mark)
            continue
        mark = _inside(mark, _container(tag, m[3]), tag)
        push(tag, mark)
    if found := flush():
        yield found


def _own(text: str, linked: int, rules=Rules) -> str:
    """good, near, short or bad, by links, length and stop words of a block."""
    n = len(text)
    if linked > rules.links * n:
        return "bad"
    if n < rules.short:
        return "bad" if linked else "short"
    words = WORD.findall(text.lower())
    stop = sum(w in STOP for w in words) / max(1, len(words))
    if stop >= rules.high:
        return "good" if n > rules.long else "near"
    return "near" if stop >= rules.low else "bad"


def classify(found: list, rules=Rules) -> list[bool]:
    """Labels of blocks: True for main text. First by each block alone, then by neighbours."""
    own = [_own(text, linked, rules) if mark > HIDDEN else "bad" for text, linked, _, mark in found]
    size = lambda test: sum(len(b[0]) for b, x in zip(found, own) if test(b[3], x))
    inside, outside = size(lambda m, x: m > 0 and x != "bad"), size(lambda m, x: m == 0 and x == "good")
    # class words and forms do not hold where nothing else on the page can be main text
    revived = not size(lambda m, x: m >= 0 and x == "good") and size(lambda m, x: m == UNLIKELY and x == "good") >= max(rules.revive, 1 + size(lambda m, x: m > 0))
    # main text that is mostly outside of the marked container: a teaser
    trusted = inside > outside or not outside and any(mark > 0 for *_, mark in found)
    labels: list[str] = []
    for (text, linked, heading, mark), x in zip(found, own):
        if mark < UNLIKELY or (mark < 0 and not revived):
            labels.append("bad")
        elif mark > 0:  # one step up: what would be short, near or without stop words needs a neighbour only
            dense = linked > rules.article_links * len(text) and not (heading and trusted)
            labels.append("bad" if dense else "good" if x == "good" else "near")
        elif trusted and not revived:  # one step down
            labels.append({"good": "good", "near": "short"}.get(x, "bad"))
        else:
            labels.append(x)
    good = [x == "good" for x in labels]
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    before, p = [None] * len(labels), None
    for i, x in enumerate(labels):
        before[i] = p
        if x in ("good", "bad"):
            p = i
    any_good, up_to = any(good), [0]
    for text, *_ in found:
        up_to.append(up_to[-1] + len(text))
    p = None
    for i in range(len(labels) - 1, -1, -1):
        if labels[i] in ("good", "bad"):
            p = i
            continue
        left, right = before[i], p
        sides = [(abs(i - j), j) for j in (left, right) if j is not None]
        if not sides:
            good[i] = labels[i] == "near" or not decided
            continue
        kinds = {labels[j] for _, j in sides}
        if kinds == {"good"}:
            good[i] = True
        elif kinds == {"bad"}:
            good[i] = labels[i] == "near" and not any_good
        elif labels[i] == "near":
            good[i] = True
        elif found[i][2]:  # a heading goes with what follows
            good[i] = right is not None and labels[right] == "good" and up_to[right] - up_to[i + 1] <= rules.heading_reach
        elif sides[0][0] == sides[1][0]:  # between text and something else: a sentence goes with the text
            good[i] = found[i][0][-1] in ".!?:\u2026"
        else:
            good[i] = labels[min(sides)[1]] == "good"
    return good


def main_text(html: str | None, rules=Rules) -> str:
    """The main text of a page, "" for null, empty and textless pages."""
    found = list(blocks(html or ""))
    return " ".join(b[0] for b, keep in zip(found, classify(found, rules)) if keep)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id long, url string, html string).

    Null and empty pages have an empty text; null ids and URLs stay; repeated rows stay repeated; other columns are not read.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
