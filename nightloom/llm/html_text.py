"""Main text of web pages by two-pass block rules.

The first pass cuts a page into blocks and decides those it can: what stands in navigation, footers, adverts and the like, or
is mostly links, is boilerplate; long blocks with many stop words are text. The second pass gives every block that is still
open - short ones, headings, lists, blocks of a language without listed stop words - the label of its nearest decided
neighbours in the same section of the page. Tokenising a page is a scan with one regular expression; the rules see whole
blocks only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.llm.quality import STOP_WORDS
from nightloom.llm.segments import slices

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"\w+")

#: Elements of HTML by what they mean here.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
NESTED = frozenset("address article aside blockquote body button center details dialog div dl fieldset figure footer form head header hgroup label legend main menu nav object ol search section select svg table ul span".split())
HARD = frozenset("nav footer aside head dialog menu button select object svg search datalist".split())
#: These are boilerplate within a form.
OF_FORMS = frozenset("label legend".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Parts of class names and ids that mark boilerplate; the second set does so even around an article.
SOFT_NAMES = frozenset(
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar widget related recommended recommendations share sharing social pagination pager "
    "login signup register search subscribe newsletter copyright legal skip tags banner promo promotion complementary contentinfo".split()
)
HARD_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice popup modal overlay comment comments disqus reply replies respond".split())
OUTER_NAMES = frozenset(["header"])

#: Lengths in characters; shares of words and of characters.
SHORT, LONG, FEW_STOPS, MANY_STOPS, MANY_LINKS = 70, 200, 0.10, 0.20, 0.33
#: An element that holds more of the page's text than this is no boilerplate for its name: for a part of it, and for a whole one.
MOST, MOST_BY_NAME = 0.5, 0.9
STOPS = frozenset(STOP_WORDS)
TEXT, BOILERPLATE, OPEN = 1, -1, 0


class Block:
    __slots__ = ("text", "links", "outside", "section", "heading", "label", "near")

    def __init__(self, text: str, links: int, outside: bool, section: int, heading: bool):
        self.text, self.links, self.outside, self.section, self.heading = text, links, outside, section, heading
        self.label, self.near = OPEN, False


def standing(tag: str, attributes: str, inside: tuple[int, int]) -> tuple[int, float]:
    """0: may hold text, 1: boilerplate by a name, 2: boilerplate for good by a name, 3: for good by its kind; and, where names decide,
    the share of the page's text beyond which they don't count. ``inside``: (standing, section) around it."""
    above, section = inside
    names: set[str] = set()
    whole: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names.update(x.lower() for x in NAME.findall(value))
            whole.update(value.lower().split())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and NOT_SHOWN.search(value)):
            return 3, 0.0
    if above == 3 or tag in HARD or (tag == "header" and not section):
        return 3, 0.0
    if tag in ("article", "main"):  # part of a name says nothing of them
        return (2, MOST_BY_NAME) if whole & HARD_NAMES else (2 if above == 2 else 0, 0.0)
    if names & HARD_NAMES:
        return 2, MOST_BY_NAME if whole & HARD_NAMES else MOST
    if tag == "form":  # some pages stand in one form as a whole
        return 2, MOST
    if names & SOFT_NAMES or (names & OUTER_NAMES and not section):
        return max(above, 1), MOST
    return above, 0.0


def blocks_of(page: str, spared: frozenset[int] | None = None) -> list[Block]:
    """The blocks of a page. ``spared``: places of elements whose names don't count; unless given, those that hold most of the text."""
    out: list[Block] = []
    named: list[tuple[int, float, int]] = []  # place, share, text within
    read = 0  # text but links, without what is boilerplate for good by its kind
    parts: list[tuple[int, str, int]] = []  # standing, text, of which links
    anchors, heading = 0, False
    stack: list[tuple[str, int, int, tuple[int, float, int] | None]] = []  # element, standing, section (0: none), place, share and text read before
    sections, at, end = 0, 0, len(page)

    def close() -> None:
        """End the block. What stands worse in it than the rest, within an element of a line, is cut out, as a block of its own."""
        if parts:
            least = min((state for state, text, _ in parts if not text.isspace()), default=0)
            section = stack[-1][2] if stack else 0
            for cut in (False, True):
                own = [(text, n) for state, text, n in parts if (state > least) == cut]
                if text := " ".join("".join(t for t, _ in own).split()):
                    out.append(Block(text, sum(n for _, n in own), cut or least > 0, section, heading))
            parts.clear()

    def leave(i: int) -> None:
        named.extend((x[0], x[1], read - x[2]) for *_, x in stack[i:] if x)
        del stack[i:]

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = html.unescape(page[at:stop]) if page.find("&", at, stop) >= 0 else page[at:stop]
            state = stack[-1][1] if stack else 0
            parts.append((state, text, len(text) * anchors))
            if state < 3 and not anchors:
                read += len(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in RAW and not closing:
            over = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if tag == "br":
            parts.append((stack[-1][1] if stack else 0, " ", 0))
        elif tag == "a":
            anchors = 0 if closing else 1
        if tag in BLOCKS:
            close()
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag in NESTED:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        leave(i)
                        break
                    if tag not in BLOCKS and stack[i][0] in BLOCKS:  # an element of a line doesn't end a block
                        break
            elif not m[3].endswith("/"):
                _, state, section, _ = stack[-1] if stack else ("", 0, 0, None)
                now, share = standing(tag, m[3], (state, section))
                if tag in OF_FORMS and any(x[0] == "form" for x in stack):
                    now, share = 3, 0.0
                if spared and m.start() in spared:
                    now = 0 if tag in ("article", "main") and state < 2 else state
                if tag in ("article", "main") and not now and not section:
                    sections += 1
                    section = sections
                if tag == "body":  # a head that wasn't closed ends here
                    leave(0)
                    now, share = 0, 0.0
                stack.append((tag, now, section, (m.start(), share, read) if share else None))
    close()
    leave(0)
    if spared is None and (most := frozenset(place for place, share, n in named if n > share * read)):
        return blocks_of(page, most)
    return out


def decide(b: Block) -> None:
    """The first pass, for one block."""
    n = len(b.text)
    if b.outside or b.links > MANY_LINKS * n or (not b.section and n < SHORT and "\xa9" in b.text):
        b.label = BOILERPLATE
    elif n >= SHORT:
        words = WORD.findall(b.text.lower())
        stops = sum(w in STOPS for w in words) / max(len(words), 1)
        b.near = stops >= FEW_STOPS
        if stops >= MANY_STOPS and n >= LONG:
            b.label = TEXT
        elif not b.near and not b.section and b.links:
            b.label = BOILERPLATE


def inherit(blocks: list[Block]) -> None:
    """The second pass. What is boilerplate by its place tells nothing of its neighbours.

    Where nothing tells that the text lies elsewhere, long blocks without links are text, whatever their words.
    """
    in_sections = sum(len(b.text) for b in blocks if b.section and b.label != BOILERPLATE)
    any_text = any(b.label == TEXT and not b.section for b in blocks) or in_sections > sum(len(b.text) for b in blocks if not b.section and b.label != BOILERPLATE)
    for b in blocks:
        if not any_text and not b.label and not b.section and not b.links and len(b.text) >= SHORT:
            b.label = TEXT
    sure = [OPEN if b.outside else b.label for b in blocks]
    before: list[tuple[int, int]] = []
    last: dict[int, tuple[int, int]] = {}
    for i, b in enumerate(blocks):
        before.append(last.get(b.section, (OPEN, -1)))
        if sure[i]:
            last[b.section] = (sure[i], i)
    last = {}
    after: list[tuple[int, int]] = [(OPEN, -1)] * len(blocks)
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = last.get(blocks[i].section, (OPEN, -1))
        if sure[i]:
            last[blocks[i].section] = (sure[i], i)
    any_text = any_text or any(b.label == TEXT for b in blocks)
    for i, b in enumerate(blocks):
        if b.label:
            continue
        (p, pi), (n, ni) = before[i], after[i]
        if not p and not n:
            b.label = TEXT if b.section or not any_text else BOILERPLATE
        elif not p or not n or p == n:
            b.label = p or n
        elif b.near or (b.heading and n == TEXT):
            b.label = TEXT
        elif b.heading:
            b.label = n
        else:
            b.label = p if i - pi < ni - i else n if ni - i < i - pi else (TEXT if b.section else BOILERPLATE)


def main_text(page: str | None) -> str:
    """The main text of one page, blocks joined by two line feeds; empty for null, empty and textless pages.

    A page that marks an article (or a main part) with the larger share of its text has it there; other pages have it wherever
    the rules find it.
    """
    blocks = blocks_of(page or "")
    for b in blocks:
        decide(b)
    inherit(blocks)
    size = lambda marked: sum(len(b.text) for b in blocks if b.label == TEXT and bool(b.section) == marked)
    marked = size(True) > size(False)
    return "\n\n".join(b.text for b in blocks if b.label == TEXT and (b.section or not marked))


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). Null and empty pages have the empty text; null ids and urls
    stay null; rows that repeat are extracted each; other columns are ignored; no rows, no result. Pages that break off within
    a tag, a comment or a reference keep what stands before."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(partial(extract), "page_id long, url string, text string, n_chars long")
