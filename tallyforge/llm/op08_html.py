"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies a block by its link density, length and
stop-word density, given where it stands: menus, headers, footers, asides, forms, comments, notices and adverts, told by
tag, role, class or id, are bad whatever they hold. So are blocks that are mostly links, but for those that stop words
show to be prose and for headings and paragraphs of an article; and, outside of articles, blocks of many links and few
stop words. Long prose is good. Headings, short blocks and blocks of few stop words, as of another language, tables or
code, stay ambiguous; on a page where no block reads as prose, stop words say nothing, and length and link density decide
instead. In the second pass an ambiguous block takes the label of its nearest decided neighbours: inside an article it is
good unless both there are bad, as beyond the edge lies good text; elsewhere it is good if one of them is, or if no block
of the page is good.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never main text.
OUTSIDE = frozenset("nav aside footer form dialog select button label fieldset menu head".split())
#: Words of class, id and role that mark the same.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner promo promotion promoted sponsor sponsored sponsors sidebar menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall login search searchbox pagination pager toolbar widget contentinfo complementary copyright legal skip".split()
)
#: The most frequent words of four languages.
STOP_WORDS = frozenset(
    "the of and a to in is that it was for on are as with be by at this from or an not but have has they you we he she his her its which their will would can "
    "der die das und ist nicht ein eine den dem des von zu mit auf für im sich auch als an es bei aus nach wird sind wie oder aber "
    "le la les de des du et un une est que qui dans pour par sur pas au aux ne ce se avec plus son sont il elle "
    "el los las del y en una por con no su para al lo como más pero sus este entre ha".split()
)
SHORT, LONG, LOW, HIGH, SOME_LINKS, LINKS = 70, 200, 0.30, 0.32, 0.2, 0.5
#: Parts of a class or id that come after the word that it means, and those that turn or only mention it.
TRAILING = frozenset("left right top bottom inner outer wrap wrapper container box block area section bar list item items content body text main group row col column panel widget link links button icon holder slot unit zone module label title head".split())
TURNING = frozenset("no not non without has have with free is hide hidden show after before under below".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, UNSURE = "good", "bad", "unsure"


class Block:
    __slots__ = ("text", "links", "heading", "paragraph", "article", "bad", "label")

    def __init__(self, text: str, links: int, heading: bool, paragraph: bool, article: int, bad: bool):
        self.text, self.links, self.heading, self.paragraph, self.article, self.bad, self.label = text, links, heading, paragraph, article, bad, None


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Position after the tag that starts at ``at``. An attribute's quote hides ``>``; a quote that never closes doesn't."""
    i = at
    while True:
        close = page.find(">", i)
        if close < 0:
            return len(page)
        quote = min((q for q in (page.find('"', i, close) if '"' not in missing else -1, page.find("'", i, close) if "'" not in missing else -1) if q >= 0), default=-1)
        if quote < 0:
            return close + 1
        end = page.find(page[quote], quote + 1)
        if end < 0:
            missing.add(page[quote])
        else:
            i = end + 1


def _means(name: str, marks: frozenset[str]) -> bool:
    """Whether a class, id or role is one of the marks: as a whole, or as the word that a compound's other parts
    describe (``site-footer``, ``sidebar-left``), but not where it is turned (``no-sidebar``)."""
    parts = [p for p in _SPLIT.split(_CAMEL.sub("-", name).lower()) if p]
    if TURNING.intersection(parts):
        return False
    while len(parts) > 1 and (parts[-1] in TRAILING and parts[-1] not in marks or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and parts[-1] in marks


def _marked(attributes: str, marks: frozenset[str] = MARKS) -> bool:
    for key, *values in _ATTR.findall(attributes):
        key, raw = key.lower(), next((v for v in values if v), "")
        value = raw.lower()
        if key in ("class", "id", "role"):
            if any(_means(x, marks) for x in raw.split()):
                return True
        elif marks is not MARKS:
            continue
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with what their place tells of them."""
    out: list[Block] = []
    #: name, article number, whether it is outside the main text, whether it is a link, whether it is a heading, whether it is in an article element
    stack: list[tuple[str, int, bool, bool, bool, bool]] = []
    article, articles, bad, link, heading, inside = 0, 0, False, 0, False, False
    texts: list[str] = []
    links = 0
    missing: set[str] = set()

    def flush():
        nonlocal links
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(text, min(links, len(text)), heading, any(x[0] == "p" for x in stack[-4:]), article, bad))
            texts.clear()
        links = 0

    def restore():
        nonlocal article, bad, link, heading, inside
        _, article, bad, _, heading, inside = stack[-1] if stack else ("", 0, False, False, False, False)
        link = sum(1 for s in stack if s[3]) if stack else 0

    def add(raw: str):
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        texts.append(text)
        if link:
            links += len(" ".join(text.split()))

    i, n = 0, len(page)
    while i < n:
        at = page.find("<", i)
        if at < 0:
            at = n
        if at > i:
            add(page[i:at])
        if at >= n:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            i = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            i = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, at + 1)
        if not m:
            add("<")
            i = at + 1
            continue
        name = m[1].lower()
        end = _tag_end(page, m.end(), missing)
        attributes = page[m.end() : end - 1]
        i = end
        if page[at + 1] == "/":
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if depth >= 0:
                changed = any(s[0] in BLOCK or s[2] != (stack[depth - 1][2] if depth else False) for s in stack[depth:])
                if changed:
                    flush()
                del stack[depth:]
                restore()
            elif name in BLOCK:
                flush()
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, i)
                i = n if not close else _tag_end(page, close.end(), missing)
            texts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name != "wbr":
                texts.append(" ")
            continue
        if name in BLOCK:
            flush()
            for closes in ("p", "li" if name == "li" else "", "dt" if name in ("dt", "dd") else "", "dd" if name in ("dt", "dd") else "", "option" if name == "option" else ""):
                if closes and stack and stack[-1][0] == closes:
                    stack.pop()
                    restore()
        worse = bad
        if (name in ("article", "main") or name in ("div", "section") and _MAIN.search(attributes)) and not _marked(attributes, _COMMENTS):
            if not article:
                articles += 1
                article, worse = articles, False
            elif name == "article" and inside:
                #: An article inside an article is a comment on it or a teaser; one inside main is the main text.
                worse = True
            inside = inside or name == "article"
        elif name in OUTSIDE or name == "header" and not article or name == "article" or name not in ("html", "body") and _marked(attributes):
            worse = True
        if worse != bad and name not in BLOCK:
            flush()
        bad = worse
        heading = heading or name in HEADINGS
        stack.append((name, article, bad, name == "a", heading, inside))
        link += name == "a"
    flush()
    return out


_COMMENTS = frozenset({"comment", "comments", "reply", "replies"})
_MAIN = re.compile(r"""role\s*=\s*["']?(?:main|article)\b|itemprop\s*=\s*["']?articleBody\b""", re.I)


def _density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _size(text: str) -> int:
    """Characters, where one of a script without spaces counts as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def _first_pass(b: Block, somewhere: bool) -> str:
    """``somewhere``: the page has an article, and what stands outside it isn't main text."""
    if b.bad or somewhere and not b.article:
        return BAD
    size, links = _size(b.text), b.links / len(b.text)
    if links <= LINKS and (b.heading or size < SHORT):
        return UNSURE
    density = _density(b.text)
    if links > LINKS:
        if size >= SHORT and density >= HIGH:
            return GOOD if b.article else UNSURE
        return UNSURE if b.article and (b.heading or b.paragraph) else BAD
    if density >= HIGH and size > LONG or b.article and density >= LOW:
        return GOOD
    return BAD if links > SOME_LINKS and density < LOW and not b.article else UNSURE


def _by_length(found: list[Block]) -> None:
    """Labels of a page without any prose that stop words tell: long blocks of few links are good."""
    for b in found:
        if b.label == UNSURE and not b.heading and _size(b.text) > LONG and b.links <= SOME_LINKS * len(b.text):
            b.label = GOOD


def main_text(page: str) -> str:
    """The main text: good blocks joined by newlines."""
    found = blocks(page)
    somewhere = any(b.article for b in found)
    for b in found:
        b.label = _first_pass(b, somewhere)
    if not any(b.label == GOOD for b in found):
        _by_length(found)
    good = any(b.label == GOOD for b in found)
    before: list[int] = []
    last = -1
    for k, b in enumerate(found):
        before.append(last)
        last = k if b.label != UNSURE else last
    after, last = [0] * len(found), len(found)
    for k in range(len(found) - 1, -1, -1):
        after[k] = last
        last = k if found[k].label != UNSURE else last
    kept = []
    for k, b in enumerate(found):
        label = b.label
        if label == UNSURE:
            if b.article:
                sides = [found[s].label for s in (before[k], after[k]) if 0 <= s < len(found) and found[s].article == b.article and not found[s].bad]
                label = BAD if sides and all(s == BAD for s in sides) and len(sides) == 2 else GOOD
            else:
                sides = [found[s].label for s in (before[k], after[k]) if 0 <= s < len(found)]
                label = GOOD if GOOD in sides or not good else BAD
        if label == GOOD:
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages``.

    A null or empty html, or one without main text, gives an empty text. Each row stands alone, so ties, repeated rows
    and null ids or urls need nothing; other columns are ignored. Broken markup never fails: unclosed tags end with
    their parent, an unclosed comment or script hides the rest.
    """

    def run(it):
        for batch in it:
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
