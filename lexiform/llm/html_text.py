"""Main text of web pages by block rules in two passes."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import shielded, slices

#: Elements whose content is never text.
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button datalist".split())
#: Those whose content is raw text, which runs to the end of the page if they aren't closed.
RAW = frozenset("script style textarea title".split())
#: Those that can stand in one of their own kind.
NESTED = frozenset("template svg math object".split())
#: Elements that hold what surrounds an article.
AROUND = frozenset("nav header footer aside menu dialog".split())
#: Elements that hold the article, if density agrees.
INSIDE = frozenset("article main".split())
#: Elements whose blocks stand together.
BOXES = frozenset("html body div section article main td th center fieldset details form aside header footer nav dialog menu".split())
#: Elements that close an open one of their kind in the same parent.
CLOSING = frozenset("p li dt dd tr td th option".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what surrounds an article.
MARKS = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar|foot\w*|head(?:er)?|masthead|breadcrumbs?|comments?|comment-?list|disqus|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social|related|widget|toolbar|search|login|pagination|pager|skip)(?=$|[\s_\d-])", re.I)
#: The same for elements that hold an article.
TEASER = re.compile(r"(?:^|[\s_-])(teasers?|related|comments?|promo\w*|advert\w*|sponsor\w*)(?=$|[\s_\d-])", re.I)
#: Common words of the four languages of the tables.
STOP = frozenset(
    "the of and to a in that is was for it with as be by on this are from at or not an have has but you they which "
    "de la le et les des un une du que qui dans pour par sur au avec est pas en ce il elle ne se plus ou "
    "der die das und ist ein eine den dem mit von zu für auf im nicht als auch sich es des oder aus bei wird "
    "el los las y del se su para al con por lo más como una".split()
)
#: Characters that make a block long or of medium length, and the share of its words that must be common for running text in either.
LONG_CHARS, STOP_SHARE = 140, 0.2
MEDIUM_CHARS, HIGH_SHARE = 70, 0.3
#: Share of a block's characters in links from which it is a list of links.
LINK_SHARE = 0.5

#: A comment, a section, a declaration or a tag. Quotes hold a ">" only where they open an attribute's value.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*+(?:\"|\Z)|=\s*'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACES = re.compile(r"\s+")
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

GOOD, BAD, NEAR = 1, -1, 0


def surrounds(tag: str, attrs: str) -> bool:
    if tag in AROUND:
        return True
    for name, *values in ATTR.findall(attrs):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"):
            return True
        if name in ("class", "id") and tag not in ("html", "body") and (TEASER if tag in INSIDE else MARKS).search(value):
            return True
    return False


class Ends:
    """Where the end tags of a page's elements are; each is looked for once."""

    def __init__(self, page: str) -> None:
        self.page, self._found = page, {}

    def after(self, tag: str, at: int) -> tuple[int, int] | None:
        """(start, end) of the first end tag of ``tag`` from ``at`` on; ``at`` never falls for one tag."""
        got = self._found.get(tag, (-1, -1))
        if got is not None and got[0] < at:
            m = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(self.page, at)
            got = self._found[tag] = m and m.span()
        return got


def dropped_end(page: str, at: int, tag: str, parents: Collection[str], ends: Ends) -> int:
    """Where the content of a dropped element that begins at ``at`` ends.

    That is behind its end tag. Without one, or with another element of its kind before it where those don't nest, raw text runs to the end of the
    page, and others end before the next block or the end tag of one of their ``parents``; head is only its tag, since it holds the body then.
    """
    end = ends.after(tag, at)
    if tag in RAW or tag == "head":
        return end[1] if end else at if tag == "head" else len(page)
    if end and (tag in NESTED or not re.compile(rf"<{re.escape(tag)}[\s/>]", re.I).search(page, at, end[0])):
        return end[1]
    while m := TOKEN.search(page, at):
        at, name = m.end(), (m[2] or "").lower()
        if name in (parents if m[1] else BLOCKS):
            return m.start()
        if name in RAW and not m[1] and not m[3].rstrip().endswith("/"):
            at = dropped_end(page, at, name, parents, ends)
    return len(page)


class Block(NamedTuple):
    """A block of text: its characters in links, whether it stands in surroundings, the outermost form and article it stands in, whether it's a heading, and the two innermost boxes."""

    text: str
    linked: int
    around: bool
    form: int
    article: int
    heading: bool
    boxes: tuple[int, int]


def blocks(page: str) -> list[Block]:
    """A page's blocks, in order.

    Unclosed and stray tags are tolerated: an end tag closes the elements up to the nearest open one of its name. Time grows with the page's
    length alone, whatever the nesting.
    """
    out: list[Block] = []
    open_: list[tuple[str, bool]] = []  # (tag, starts surroundings)
    count: Counter[str] = Counter()  # of open elements by tag
    marks: list[int] = []  # places in open_ of blocks and of elements that others close
    boxes, forms, articles = [0], [0], [0]  # numbers of open ones
    ends = Ends(page)
    text: list[str] = []
    linked: list[str] = []
    around = number = 0
    heading = False

    def flush() -> None:
        whole = SPACES.sub(" ", html.unescape("".join(text))).strip()
        if whole:
            out.append(Block(whole, len(SPACES.sub(" ", html.unescape("".join(linked))).strip()), around > 0, forms[:2][-1], articles[:2][-1], heading, (boxes[-1], boxes[-2:][0])))
        text.clear()
        linked.clear()

    def put(s: str) -> None:
        text.append(s)
        if count["a"]:
            linked.append(s)

    def push(tag: str, starts: bool) -> None:
        nonlocal around, number
        number += 1
        if tag in BLOCKS or tag in CLOSING:
            marks.append(len(open_))
        open_.append((tag, starts))
        count[tag] += 1
        around += starts
        for kind, of in ((BOXES, boxes), (("form",), forms), (INSIDE, articles)):
            if tag in kind:
                of.append(number)

    def pop() -> str:
        nonlocal around
        tag, starts = open_.pop()
        count[tag] -= 1
        around -= starts
        if marks and marks[-1] == len(open_):
            marks.pop()
        for kind, of in ((BOXES, boxes), (("form",), forms), (INSIDE, articles)):
            if tag in kind:
                of.pop()
        return tag

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        put(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
                heading = False
            if count[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in DROPPED:
            if not m[3].rstrip().endswith("/"):
                at = dropped_end(page, at, tag, +count, ends)
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in BLOCKS:
            flush()
            heading = bool(re.fullmatch(r"h[1-6]", tag))
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        if tag in CLOSING and count[tag]:
            for i in reversed(marks):
                if open_[i][0] == tag:
                    while pop() != tag:
                        pass
                    break
                if open_[i][0] != "p":
                    break
        push(tag, surrounds(tag, m[3]))
    flush()
    return out


def first_pass(b: Block) -> int:
    """What a block's length, its share of common words and its share of linked characters say of it."""
    if b.linked > LINK_SHARE * len(b.text):
        return BAD
    words = LETTERS.findall(b.text.lower())
    common = sum(w in STOP for w in words) / max(len(words), 1)
    running = len(b.text) >= LONG_CHARS and common >= STOP_SHARE or len(b.text) >= MEDIUM_CHARS and common >= HIGH_SHARE
    return GOOD if running else NEAR


def most(size: Counter[int]) -> int:
    """The number that holds over half of the characters, 0 being those in none."""
    top = max(size, key=size.__getitem__, default=0)
    return top if 2 * size[top] > sum(size.values()) else 0


def main_text(page: str) -> str:
    """The article of a page: blocks joined by newlines.

    First each block outside surroundings is decided by its length, its share of common words and its share of linked characters; short or unclear ones stay
    ambiguous. Then an ambiguous block takes the label of the nearest decided blocks of its box, else of the box around that one, else of the page, before
    and after it: where they differ a heading follows the next one and others the nearer one. A page without running text keeps its ambiguous blocks.

    Surroundings are elements named or marked as such, headers and asides within an article among them. A form is one unless it holds
    over half of the page's running text. An article element counts only where the running text is found in it: where one holds over half of
    it, blocks outside it are surroundings, and it settles what neighbours leave open.
    """
    found = blocks(page)
    label = [BAD if b.around else first_pass(b) for b in found]
    form, article = Counter(), Counter()
    for b, x in zip(found, label, strict=True):
        if x == GOOD:
            form[b.form] += len(b.text)
            article[b.article] += len(b.text)
    body, own = most(form), most(article)
    outside = [b.around or b.form not in (0, body) or own != 0 and b.article != own for b in found]
    label = [BAD if o else x for o, x in zip(outside, label, strict=True)]
    if GOOD not in label:
        return "\n".join(b.text for b, x in zip(found, label, strict=True) if x == NEAR)
    near: list[list[tuple[tuple[int, int], ...]]] = []
    for seq in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, tuple[int, int]] = {}
        seen = [((NEAR, 0),) * 3] * len(found)
        for i in seq:
            here = (*found[i].boxes, -1)
            seen[i] = tuple((last[k][0], abs(i - last[k][1])) if k in last else (NEAR, 0) for k in here)
            if label[i] != NEAR:
                for k in here[2:] if outside[i] else here:  # surroundings say nothing of the box that they interrupt
                    last[k] = (label[i], i)
        near.append(seen)
    keep = []
    for i, b in enumerate(found):
        mine = label[i]
        for (p, pd), (q, qd) in zip(near[0][i], near[1][i], strict=True):
            if mine != NEAR:
                break
            if p and q and p != q:
                mine = GOOD if own else q if b.heading else p if pd <= qd else q
            else:
                mine = p or q
        if mine == GOOD or mine == NEAR:
            keep.append(b.text)
    return "\n".join(keep)


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without ``column``, with text and n_chars (its code points).

    Null or empty HTML gives an empty text and 0. Every row gives one row, repeated ones too; whole pages are read. An empty table gives an empty result.
    Columns of ``pages`` named like the new ones are replaced; others pass unchanged.
    """
    inner, back = shielded(pages.withColumnRenamed(column, "__html").select(*[F.col(f"`{c}`") for c in pages.columns if c != column], "__html"), ("__html",), ("text", "n_chars"))
    keep = inner.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(x.as_py() or "") for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    out = inner.mapInArrow(run, inner.drop("__html").schema.add("text", "string").add("n_chars", "long"))
    return back(out.withColumn("__html", F.lit(None))).drop("__html")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page; nulls and odd rows as in ``extracted``."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
