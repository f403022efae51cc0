"""Operator 8: main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one looks at each block by
itself: blocks in parts that are never article text (menus, forms, footers, marked adverts, notices,
comments, ...) and link-dense blocks are bad; long blocks rich in stop words, or made of whole sentences, are good; the
rest is short or nearly good.  Pass two gives these the label of their nearest decided neighbours; inside an
``article`` or ``main`` element only blocks of that element are neighbours.

Stop words are those of the fixed list and, as any language's commonest words are its shortest, all words of up to
``SHORT_WORD`` letters.  Scripts without spaces between words count signs instead, each for ``SIGN`` letters, and clause marks for stop words.

A class or id name marks a part for sure if it is made of marking words and words for boxes only, or if its last word but for these and words for parts of
such boxes, which says what it is, is one of the ``SURE_WORDS`` (``user-comments``, not ``comments-on-the-budget``).  A name with such a word elsewhere
is likely to mark a part: it does so unless the running text under such names is more than that of the rest of the page, as then it is the article.  A
name that merely has another marking word in it (``social-science``) does so with a second sign: blocks there are bad if they are short, have many
links or few stop words.

A page without any good block after pass one (dialogue, a few short paragraphs) has its nearly good ones and its short whole sentences without
links as the article, if they hold more text than its links do.

Every page is handled whole and by itself, in time linear in its length.

Defined results: null or empty html: empty text, 0; unclosed tags, comments and
character references at the end of a cut page: a tag or comment that is not closed is markup; repeated rows: one
row each; empty table: empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so what up "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man dann "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou mais comme on lui nous cette ses été sa "
    "el los las y del por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()
)
# Elements that end a block, elements whose content is no text, parts of a page that are no article text.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = "script|style|title|textarea|template|iframe|svg|noembed|noframes|xmp|select|button"
DROP_TAGS = frozenset("nav footer aside form menu dialog fieldset head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended comment comments reply replies disqus respond pagination pager search widget skip toolbar paywall".split())
SURE_WORDS = frozenset("advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr login masthead nav navbar navigation newsletter pagination paywall popup promo promoted replies sidebar signup sponsored subscribe subscription".split())
BOX_WORDS = frozenset("bar block bottom box container google inner left list outer page panel right site slot top unit wrap wrapper".split())
PART_WORDS = frozenset("area author body content copyright count entry form head header item legal link links meta section text thread title".split())
NOT_WORDS = frozenset("closed free has no non not off open with without".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
# Ends of sentences and marks between clauses, in several scripts.
SENTENCE_ENDS = ".!?\u2026\u0589\u061f\u06d4\u0964\u1362\u3002\uff01\uff1f"
CLAUSE_MARKS = SENTENCE_ENDS + ",;:\u3001\uff0c\uff1b\uff1a "

MAX_LINK_DENSITY = 0.5
SOME_LINKS = 0.25
SHORT = 70
LONG = 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
SHORT_WORD = 3
#: Letters that a sign of a script without spaces stands for, and the most signs of a clause of running text.
SIGN, CLAUSE = 3, 30
#: Words (or signs) of a sentence of running text.
SENTENCE = (4, 60)

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|aria-label)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Han, kana, Thai, Lao, Tibetan, Burmese and Khmer: no spaces between words
_SIGNS = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_ENDS = re.compile(rf"[{re.escape(SENTENCE_ENDS)}]+")
_MARKS = re.compile(rf"[{re.escape(CLAUSE_MARKS)}]+")
_NO, _PERHAPS, _LIKELY, _SURE = range(4)
#: A sentence's end, with closing quotes and brackets after it.
_SENTENCE = re.compile(rf"[{re.escape(SENTENCE_ENDS)}][\"'\u00bb\u2019\u201c\u201d\u300d\u300f)\]]*\Z")


class Block:
    __slots__ = ("article", "dropped", "label", "link", "text")

    def __init__(self, text: str, link: int, dropped: int, article: int):
        self.text, self.link, self.dropped, self.article, self.label = text, link, dropped, article, ""


def _marked(name: str) -> int:
    """Whether a class or id name marks a part that is no article text."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not any(p in DROP_WORDS or p in SURE_WORDS for p in parts):
        return _NO
    if any(p in NOT_WORDS for p in parts):
        return _PERHAPS
    # single letters are of sizes and numbers
    said = [p for p in parts if p in DROP_WORDS or p in SURE_WORDS or (p not in BOX_WORDS and len(p) > 1)]
    if all(p in DROP_WORDS or p in SURE_WORDS for p in said) or [p for p in said if p not in PART_WORDS][-1] in SURE_WORDS:
        return _SURE
    return _LIKELY if any(p in SURE_WORDS for p in parts) else _PERHAPS


def _drops(tag: str, attributes: str, in_article: bool) -> int:
    if tag in DROP_TAGS or (tag == "header" and not in_article):
        return _SURE
    out = _PERHAPS if tag == "noscript" else _NO
    for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if tag not in ("body", "html", "article", "main"):
                out = max([out, *map(_marked, value.split())])
        elif name == "role" and value.lower() in DROP_ROLES:
            return _SURE
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return _SURE
    return out


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order; text is decoded and white space is single."""
    out: list[Block] = []
    text: list[str] = []
    link: list[str] = []
    drop: list[list] = []  # [tag, depth, how surely] of open parts that are marked
    article = depth = in_link = number = 0

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, len(" ".join(html.unescape("".join(link)).split())), max((d[2] for d in drop), default=_NO), article))
            text.clear()
            link.clear()

    def add(piece: str) -> None:
        text.append(piece)
        if in_link:
            link.append(piece)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1]:
            add(" ")
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            add(" ")
        if tag == "a":
            in_link = not closing
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        if tag in ("article", "main"):
            if not closing:
                # an article never stands in an advert or menu whose end tag is missing
                if drop and drop[-1][0] in ("div", "p", "span", "head", "nav", "header", "section"):
                    drop.clear()
                if not depth:
                    number += 1
                    article = number
                depth += 1
            elif depth:
                depth -= 1
                if not depth:
                    article = 0
        how = _NO if closing else _drops(tag, attributes, bool(depth))
        if how > max((d[2] for d in drop), default=_NO):
            if tag not in BLOCK_TAGS:
                flush()
            drop.append([tag, 1, how])
        elif drop and drop[-1][0] == tag:
            if closing and drop[-1][1] == 1 and tag not in BLOCK_TAGS:
                flush()
            drop[-1][1] += -1 if closing else 1
            if not drop[-1][1]:
                drop.pop()
        elif closing and any(d[0] == tag for d in drop):
            while drop[-1][0] != tag:
                drop.pop()
            drop[-1][1] -= 1
            if not drop[-1][1]:
                drop.pop()
    if at < len(page):
        add(page[at:])
    flush()
    return out


def measures(text: str, stop_words: frozenset = STOP_WORDS) -> tuple[float, float, int]:
    """(length in letters, share of stop words, number of its sentences if they are whole ones, else 0) of a block."""
    signs = len(_SIGNS.findall(text))
    if 2 * signs > len(_WORDS.sub("", text)) + signs and signs > len(text) / 3:
        n, size = signs, len(text) + (SIGN - 1) * signs
        stops = min(1.0, STOP_HIGH * CLAUSE * len(_MARKS.findall(text)) / n)
    else:
        words = _WORDS.findall(text.lower())
        n, size = len(words), len(text)
        stops = sum(len(w) <= SHORT_WORD or w in stop_words for w in words) / n if n else 0.0
    ends = len(_ENDS.findall(text))
    return size, stops, ends if ends and SENTENCE[0] <= n / ends <= SENTENCE[1] and _SENTENCE.search(text) else 0


def classify(blocks: list[Block], stop_words: frozenset = STOP_WORDS) -> None:
    """Sets each block's label to good or bad."""
    seen = [(*measures(b.text, stop_words), b.link / len(b.text)) for b in blocks]
    if any(b.dropped == _LIKELY for b in blocks):
        runs = [0, 0]
        for b, (size, stops, whole, links) in zip(blocks, seen):
            if b.dropped != _SURE and size >= SHORT and links <= SOME_LINKS and (stops >= STOP_HIGH or whole):
                runs[b.dropped == _LIKELY] += size
        for b in blocks:
            if b.dropped == _LIKELY:
                b.dropped = _PERHAPS if runs[1] > runs[0] else _SURE
    for b, (size, stops, whole, links) in zip(blocks, seen):
        prose = stops >= STOP_HIGH or (whole > 1 and links <= SOME_LINKS)
        if b.dropped == _SURE or links > MAX_LINK_DENSITY:
            b.label = "bad"
        elif b.dropped and (size < SHORT or links > SOME_LINKS or stops < STOP_LOW):
            b.label = "bad"
        elif size < SHORT:
            b.label = "bad" if b.link and not b.article else "short"
        elif prose:
            b.label = "good" if size >= LONG or b.article else "near"
        elif stops >= STOP_LOW or b.article or (whole and links <= SOME_LINKS):
            b.label = "near"
        else:
            b.label = "bad"
    if not any(b.label == "good" for b in blocks):
        # whole sentences without links, however short, are the article of a page that has nothing longer
        told = [b.label == "near" or (b.label == "short" and not b.link and _SENTENCE.search(b.text)) for b in blocks]
        own = sum(len(b.text) for b, t in zip(blocks, told) if t)
        if own >= SHORT and own > sum(b.link for b in blocks if b.dropped != _SURE):
            for b, t in zip(blocks, told):
                if t:
                    b.label = "good"
    n = len(blocks)

    def decided(step: int) -> list[tuple[int, str] | None]:
        """(distance, label) of the nearest decided block before or after each."""
        found: list = [None] * n
        place, last = -1, None
        for i in range(n) if step > 0 else range(n - 1, -1, -1):
            if last is not None and blocks[i].article == blocks[place].article:
                found[i] = (abs(i - place), last)
            # a dropped part inside an article says nothing about the text around it
            if blocks[i].label in ("good", "bad") and not (blocks[i].article and blocks[i].dropped):
                place, last = i, blocks[i].label
        return found

    before, after = decided(1), decided(-1)
    labels = []
    for b, x, y in zip(blocks, before, after):
        if b.label in ("good", "bad"):
            labels.append(b.label)
        elif x is None and y is None:
            labels.append("good" if b.article or b.label == "near" else "bad")
        elif x is None or y is None or x[1] == y[1]:
            label = (x or y)[1]
            labels.append("good" if b.article and b.label == "near" else label)
        elif b.label == "near" or b.article:
            labels.append("good")
        else:
            labels.append(x[1] if x[0] < y[0] else y[1] if y[0] < x[0] else "bad")
    for b, label in zip(blocks, labels):
        b.label = label


def main_text(page: str | None) -> str:
    """The article text of one page: its good blocks, joined by an empty line."""
    found = blocks_of(page or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
