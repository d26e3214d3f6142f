"""Secret scans: fixed patterns, and guess cost by dynamic programming for values in a credential's context.

The cost of a value is the least sum, over all its segmentations, of the logarithms of the guesses that each segment takes: a
dictionary word by its rank, a date by its distance in days, a repeat by the cheapest cost of its unit and its count, a keyboard walk by
its starts, length and turns, anything else character by character. Values that stand where a credential stands, and that no cheap segmentation
explains, are reported beside the patterns' matches.
"""

from __future__ import annotations

import base64
import heapq
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.llm.segments import slices

#: The base kinds in the order in which ties are listed, their patterns, group and least length of it.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # the same as runs of any length of which 32 and more count
)
KINDS = ("assign", "access", "hex", "guess")
#: A name starts here: no letter before it, or a step of camel case.
_START = r"(?-i:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
#: Where a credential's value stands: after its name (the base patterns' names may stand within any other), in a URL before the
#: host, after an authorization scheme.
CONTEXT = re.compile(
    rf"""(?:password|passwd|secret|token|api[_-]?key|{_START}(?:pwd|pass|passphrase|passcode|credentials?|auth|private[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|auth[_-]?key|db[_-]?pass|login))"""
    r"""["']?\x20*[:=]\x20*(?:(?P<double>")|(?P<single>')|(?P<bare>))"""
    r"""|\b[a-z][a-z0-9+.-]{0,31}://[^\s/:@"']*:(?!\d{1,5}[/?\#])(?P<url>)"""
    r"""|\b(?:Bearer|Basic)\x20+(?P<scheme>)""",
    re.I | re.A,
)
#: What a value may hold, by its context: it ends at white space, in quotes at the quote, in a URL at the host's "@".
VALUE = {
    "double": re.compile(r"""(?:\\\S|[^\s"\\])*+""", re.A), "single": re.compile(r"""(?:\\\S|[^\s'\\])*+""", re.A), "bare": re.compile(r"""[^\s"'<>,;|]*+""", re.A),
    "url": re.compile(r"""(?:[^\s"'<>@]|@(?=[^\s"'<>@/,;]*@))*+""", re.A), "scheme": re.compile(r"""[^\s"'<>,;|@]*+""", re.A),
}
LEAST_VALUE = 6
#: For Arrow: texts that may hold anything of the above.
MAY = r"(?i:passw|secret|token|api_?key|pwd|pass|credential|auth|_?key|login|bearer|basic|://)|AKIA|[0-9a-f]{32}"
#: A value is hard to guess from this many powers of ten on.
THRESHOLD = 10.0
#: Frequent words of passwords, most frequent first.
COMMON = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login princess sunshine football baseball shadow michael "
    "superman hello freedom whatever trustno1 ninja azerty passw0rd love secret test default root guest user access hunter "
    "summer winter spring autumn flower cookie pepper summer2020 changeme example sample company server database system manager "
    "oracle mysql postgres ubuntu linux windows apple google amazon token your value string none null true false here todo "
    "january february march april june july august september october november december monday tuesday wednesday thursday friday "
    "saturday sunday the and for you that with this have from not but all can has was one our out day get"
).split()
#: Words of at least this many characters are looked up; sub-walks, and units of a repeat, have at most so many characters, and
#: repeats are told apart by their count up to so many (beyond, only the whole run of copies and these counts are segments).
LEAST_WORD, MOST_WALK, MOST_UNIT, MOST_COUNT = 3, 32, 64, 16
#: Rows of the keyboard and the two sequences that count as walks in either direction.
WALKS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789", "qazwsxedcrfvtgbyhnujmikolp")
FORWARD = frozenset(a + b for w in WALKS for a, b in zip(w, w[1:], strict=False))
STEPS = FORWARD | frozenset(p[::-1] for p in FORWARD)
#: Characters that stand for letters; 1 stands for two of them.
LEET = (str.maketrans("@43015$7!", "aaeoissti"), str.maketrans("@43015$7!", "aaeolssti"))
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
#: A year; year, month and day; and day and month in either order before a year or the last two digits of one.
DATE = re.compile(rf"(?P<year>{_YEAR})(?:(?P<a>[-./_]?){_MONTH}(?P=a){_DAY})?|(?:{_DAY}(?P<b>[-./_]?){_MONTH}|{_MONTH}(?P<c>[-./_]?){_DAY})(?(b)(?P=b)|(?P=c))(?P<last>{_YEAR}|\d\d)", re.A)


@lru_cache(4)
def dictionary(path: str | None) -> tuple[dict[str, int], dict[str, int], frozenset[str]]:
    """Words with their ranks, the same read backwards, and the beginnings of all of these: COMMON first, then the whole words of a
    tokenizer's rank file.

    The file has a token (base64 of its bytes) and its rank in each line, most frequent first; its whole words are the tokens
    of a space and letters. ``None``: COMMON alone.
    """
    words = [w for w in COMMON if len(w) >= LEAST_WORD]
    if path:
        with open(path, "rb") as f:
            tokens = [base64.b64decode(x.split()[0]) for x in f if x.strip()]
        words += [t[1:].decode().lower() for t in tokens if len(t) > LEAST_WORD and t[:1] == b" " and t[1:].isalpha()]
    ranks: dict[str, int] = {}
    for w in words:
        ranks.setdefault(w, len(ranks) + 1)
    reverse = {w[::-1]: n for w, n in ranks.items()}
    return ranks, reverse, frozenset(w[:n] for w in (*ranks, *reverse) for n in range(LEAST_WORD, len(w) + 1))


#: Kinds of characters and how many there are of each.
CHARACTERS = ((10, re.compile("[0-9]")), (26, re.compile("[a-z]")), (26, re.compile("[A-Z]")), (33, re.compile("[^0-9a-zA-Z]")))


def word_cost(word: str, rank: int, extra: float) -> float:
    case = 0.0 if word == word.lower() else math.log10(2) if word in (word.capitalize(), word.upper()) else 0.3 * len(word)
    return math.log10(rank + 1) + case + extra


def date_cost(date: str) -> float | None:
    """log10 of the guesses of a date in any of its forms; None for what is none."""
    m = DATE.fullmatch(date)
    if not m:
        return None
    year = int(m["year"] or m["last"])
    if year < 100:
        year += 1900 if year >= 50 else 2000
    return math.log10(max(20, abs(year - 2020)) * (1 if len(date) == 4 and m["year"] else 365)) + 0.6 * (not date.isdigit())


def walk_cost(length: int, turns: int) -> float:
    return math.log10(26 * length) + turns * math.log10(3)


def repeat_cost(unit: float, count: int) -> float:
    return unit + math.log10(count)


def lowered(value: str) -> str:
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)  # some letters become two


def dates_from(value: str, i: int) -> Iterator[tuple[int, str, float]]:
    if value[i].isdigit():
        for j in range(i + 4, min(i + 10, len(value)) + 1):
            if (cost := date_cost(value[i:j])) is not None:
                yield j, "date", cost


def walks_from(low: str, i: int, start: int) -> Iterator[tuple[int, str, float]]:
    """Sub-walks of three and more characters from a place; of longer ones than MOST_WALK, the whole one from where it starts in
    the value, which is at ``start``."""
    j, turns, before = i + 1, 0, None
    while j < len(low) and low[j - 1 : j + 1] in STEPS:
        way = low[j - 1 : j + 1] in FORWARD
        turns += before is not None and way != before
        before, j = way, j + 1
        if 3 <= j - i <= MOST_WALK:
            yield j, "walk", walk_cost(j - i, turns)
        elif j - i > MOST_WALK:
            if i > start and low[i - 1 : i + 1] in STEPS:  # within a longer one
                return
    if j - i > MOST_WALK:
        yield j, "walk", walk_cost(j - i, turns)


def periods(value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (unit length, copies) that stand at each place, for units that are no repeats themselves: where each place's begin,
    unit lengths, copies."""
    n = len(value)
    data = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    runs: dict[int, np.ndarray] = {}  # characters from each place on that come again so much later
    places, units, copies = [], [], []
    for u in range(1, min(MOST_UNIT, n // 2) + 1):
        differs = np.append(np.flatnonzero(data[u:] != data[: n - u]), n - u)
        if len(differs) > n - 2 * u + 1 and int(np.diff(differs, prepend=-1).max()) <= u:
            continue  # no run is as long as the unit
        run = np.repeat(differs, np.diff(differs, prepend=-1))[: n - u] - np.arange(n - u)
        runs[u] = run
        found = run >= u
        for v, other in runs.items():
            if v < u and u % v == 0:
                found &= (other[: n - u] < v) | (other[: n - u] // v * v + v < u)
        at = np.flatnonzero(found)
        places.append(at)
        units.append(np.full(len(at), u))
        copies.append(run[at] // u + 1)
    if not places:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = np.concatenate(places)
    order = np.argsort(every, kind="stable")
    return np.searchsorted(every[order], np.arange(n + 1)), np.concatenate(units)[order], np.concatenate(copies)[order]


class Run:
    """A value, and the values that start later in it and end where it ends.

    What segments start at a place is worked out when a search gets there, once for all values of the run.
    """

    def __init__(self, value: str, words: str | None):
        self.value, self.words, self.low = value, words, lowered(value)
        self.forms = [(self.low, 0.0)] + [(t, math.log10(2)) for t in dict.fromkeys(self.low.translate(m) for m in LEET) if t != self.low]
        self.begins, self.units, self.copies = periods(value)
        backwards = value[::-1]
        self.last = [(n, len(value) - m.start()) for n, kind in CHARACTERS if (m := kind.search(backwards))]
        self.held: dict[int, list[tuple[int, str, float]]] = {}

    def each(self, start: int) -> float:
        """log10 of the kinds of characters that the value from ``start`` draws from."""
        return math.log10(max(sum(n for n, end in self.last if end > start), 10))

    def words_from(self, i: int) -> Iterator[tuple[int, str, float]]:
        ranks, reverse, heads = dictionary(self.words)
        for text, extra in self.forms:
            for j in range(i + LEAST_WORD, len(text) + 1):
                part = text[i:j]
                if part not in heads:
                    break
                if part in ranks:
                    yield j, "word", word_cost(self.value[i:j], ranks[part], extra)
                if part in reverse:
                    yield j, "word", word_cost(self.value[i:j], reverse[part], extra + math.log10(2))

    def segments(self, i: int, start: int, each: float) -> list[tuple[int, str, float]]:
        """(end, kind, cost) of what may start at place ``i`` of the value from ``start``."""
        found = self.held.get(i)
        if found is None:
            found = self.held[i] = [*self.words_from(i), *dates_from(self.value, i), *walks_from(self.low, i, 0 if i else i)]
        out = [(i + 1, "brute", each), *found]
        if i == start and i:
            out += walks_from(self.low, i, start)
        for k in range(self.begins[i], self.begins[i + 1]):
            u, count = int(self.units[k]), int(self.copies[k])
            unit = unit_cost(self.value[i : i + u], self.words, each)
            out += [(i + u * n, "repeat", repeat_cost(unit, n)) for n in {*range(2, min(count, MOST_COUNT) + 1), count}]
        return out

    def cheapest(self, start: int = 0, each: float | None = None) -> tuple[float, list[tuple[int, int, str]]]:
        """log10 of the guesses of the value from ``start`` on, and its segments: the shortest path through its places."""
        n, each = len(self.value), self.each(start) if each is None else each
        best, back = [0.0] + [math.inf] * (n - start), [(0, "")] * (n - start + 1)
        for i in range(start, n):
            here = best[i - start]
            for j, kind, cost in self.segments(i, start, each):
                if here + cost < best[j - start]:
                    best[j - start], back[j - start] = here + cost, (i, kind)
            self.held.pop(i, None)  # not needed again
        out: list[tuple[int, int, str]] = []
        j = n
        while j > start:
            i, kind = back[j - start]
            if out and kind == "brute" == out[-1][2] and out[-1][0] == j - start:
                out[-1] = (i - start, out[-1][1], kind)
            else:
                out.append((i - start, j - start, kind))
            j = i
        return best[-1], out[::-1]

    def cheap(self, start: int, threshold: float) -> bool:
        """Whether the value from ``start`` on costs less than ``threshold``: places in the order of their costs, until the end is
        reached or all that is left costs more. Only places within reach of the threshold are looked at."""
        n, each, best, queue = len(self.value), self.each(start), {start: 0.0}, [(0.0, start)]
        while queue:
            here, i = heapq.heappop(queue)
            if here > best[i]:
                continue
            for j, _, cost in self.segments(i, start, each):
                total = here + cost
                if total < threshold and total < best.get(j, math.inf):
                    if j == n:
                        return True
                    best[j] = total
                    heapq.heappush(queue, (total, j))
        return start == n and threshold > 0


@lru_cache(20_000)  # values of at most MOST_UNIT characters
def unit_cost(unit: str, words: str | None, each: float | None) -> float:
    return Run(unit, words).cheapest(0, each)[0]


def cheapest(value: str, words: str | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses of the cheapest segmentation, and its segments.

    Segments are the words (also reversed, or with look-alikes for letters), dates, sub-walks and repeats from every place;
    a unit of a repeat costs what its own cheapest segmentation costs. ``words``: a dictionary's file.
    """
    return Run(value, words).cheapest()


def guesses_of(value: str, words: str | None) -> float:
    return unit_cost(value, words, None) if len(value) <= MOST_UNIT else cheapest(value, words)[0]


class Values:
    """Where values end. A value that starts within another one of its kind ends where that one does, so ends are found once."""

    def __init__(self, text: str):
        self.text, self.known = text, dict.fromkeys(VALUE, (0, -1))

    def end(self, kind: str, a: int) -> int | None:
        """The end of the value that starts at ``a``; None for what is too short, or has no host after it in a URL."""
        lo, hi = self.known[kind]
        if not lo <= a <= hi or kind in ("double", "single"):  # in quotes, what a backslash means depends on the start
            lo, hi = self.known[kind] = VALUE[kind].match(self.text, a).span()
        return hi if hi - a >= LEAST_VALUE and (kind != "url" or self.text[hi : hi + 1] == "@") else None


def spans_of(text: str, threshold: float = THRESHOLD, words: str | None = None, costs: bool = True) -> list[tuple[str, int, int, int, float]]:
    """(kind, start, end, start of the value, log10 of guesses) by start, then kind; places are code points. Without ``costs``
    the last is NaN."""
    out = []
    for kind, pattern, group, least in BASE:
        out += [(kind, m.start(), m.end(), m.start(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    base = sorted((a, b) for _, a, b, _ in out)
    starts, furthest = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    values, runs, at, guesses = Values(text), {}, 0, {}
    while m := CONTEXT.search(text, at):
        kind, a = m.lastgroup, m.end()
        end = values.end(kind, a)
        if end is None:  # another context may start within this one's name
            at = m.start() + 1
            continue
        at = a  # a value that isn't reported here may hold a name with a value of its own
        before = bisect_right(starts, a)
        if before and furthest[before - 1] >= end:
            continue
        runs = {e: r for e, r in runs.items() if e > a}
        if end not in runs:
            runs[end] = a, Run(text[a:end], words)
        first, run = runs[end]
        if not run.cheap(a - first, threshold):
            out.append(("guess", m.start(), end, a))
            guesses[a, end] = run.cheapest(a - first)[0] if costs else math.nan
            at = end
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return [(kind, a, b, v, guesses[v, b] if kind == "guess" else guesses_of(text[v:b], words) if costs else math.nan) for kind, a, b, v in out]


SPANS = "array<struct<kind:string,start:int,end:int,value:int,guesses:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32()), ("guesses", pa.float64())]))


def found(texts: pa.Array, threshold: float, words: str | None) -> pa.Array:
    texts = pc.fill_null(texts, "")
    may = pc.match_substring_regex(texts, MAY).to_pylist()
    names = ("kind", "start", "end", "value", "guesses")
    return pa.array([[dict(zip(names, s, strict=True)) for s in spans_of(texts[i].as_py(), threshold, words)] if m else [] for i, m in enumerate(may)], _ARROW)


def scan_batches(batches: Iterator[pa.RecordBatch], threshold: float, words: str | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__text"):
        keep = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), found(batch.column("__text"), threshold, words)], names=[*keep, "spans"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, words: str | None = None) -> DataFrame:
    """doc_id and spans of every row's whole text, as array of (kind, start, end, value, guesses).

    ``value``: where the credential itself starts within the span; ``guesses``: log10 of its guess cost; ``words``: a rank file
    for the dictionary, at the same place on every executor. Null and empty
    texts have no spans; rows that repeat are scanned each; other columns are ignored; no rows, no result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(partial(scan_batches, threshold=threshold, words=words), f"doc_id long, spans {SPANS}")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digested(spans: DataFrame) -> DataFrame:
    """Counts and digests of ``scanned``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = [x[0] for x in BASE]
    return spans.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base), F.sha2(listed(of(*base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: str, mask: str, threshold: float, words: str | None = None) -> str:
    out, at = [], 0
    for _, _, end, value, _ in sorted(spans_of(text, threshold, words, costs=False), key=lambda x: x[3]):
        if value >= at:
            out += [text[at:value], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_batches(batches: Iterator[pa.RecordBatch], text_col: str, mask: str, threshold: float, words: str | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text_col):
        i = batch.schema.get_field_index(text_col)
        texts = batch.column(i)
        may = pc.match_substring_regex(pc.fill_null(texts, ""), MAY)
        if pc.any(may).as_py():
            new = pa.array([masked(t.as_py(), mask, threshold, words) if m else t.as_py() for t, m in zip(texts, may.to_pylist(), strict=True)], texts.type)
            batch = batch.set_column(i, batch.schema.field(i), new)
        yield batch


def mask_secrets(docs: DataFrame, text_col: str = "text", *, mask: str = "[SECRET]", threshold: float = THRESHOLD, words: str | None = None, length_col: str | None = None) -> DataFrame:
    """``docs`` with every found value replaced by ``mask``; other columns and rows as they are, null texts stay null.
    ``length_col``: a column that holds the text's length in code points and is set anew."""
    out = docs.mapInArrow(partial(mask_batches, text_col=text_col, mask=mask, threshold=threshold, words=words), docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col else out
