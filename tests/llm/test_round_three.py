"""Cases that earlier rounds' operators have been mended for."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from nightloom.llm import bpe, html_text, near_dedup, packing, secrets, shards, token_files
from tests.llm import test_operators as brute

PROSE = "The story of the town and of the people in it is one that many have told before, and it is told here as it was told to us by those who were there on the day when the river came over the wall and into the streets of the old town, and took with it all that was not tied to the ground."


@pytest.mark.parametrize("page, want", [
    ("<article><p>Foo <span>bar</span> baz of the ...</p></article>", "Foo bar baz of the ..."), ('<article><p>Foo <span class="share">..</span> baz</p></article>', "Foo baz"), ("<article><p>Foo <svg/> baz</p></article>", "Foo baz"),
    ("<article><p>Foo <svg><path/><text>x</text></svg> baz</p></article>", "Foo baz"), ("<article><p>Foo <label>bar</label> baz</p></article>", "Foo bar baz"), ("<article><p>a<span hidden>b</span>c <span style='display: none'>d</span>e</p></article>", "ac e"),
    (f'<article title="The hidden valley"><p>{PROSE}</p></article>', PROSE), (f'<article class="prose hidden md:block"><p>{PROSE}</p></article>', PROSE), (f'<article data-t="x display:none"><p>{PROSE}</p></article>', PROSE),
    (f"<article hidden><p>{PROSE}</p></article><div><p>{PROSE} More.</p></div>", f"{PROSE} More."), (f'<p>{PROSE} <b>bold</b> <em class="menu-name">x</em> end</p>', f"{PROSE} bold x end"),
    (f'<body><form id="f"><div id="content"><p>{PROSE}</p><p>{PROSE}</p></div><label>Name</label><select><option>a</option></select><button>Go</button></form></body>', f"{PROSE}\n\n{PROSE}"),
    (f"<form><nav><a href=x>menu</a></nav><article><p>{PROSE}</p></article><legend>Your data</legend></form>", PROSE), (f"<div><p>{PROSE}</p></div><form><label>x</label> Write to us and we will answer</form>", PROSE),
    (f"<p>{PROSE} <button>Like</button> more of it</p>", f"{PROSE} more of it"), ("<article><p>a <span>b</p><p>c</span> d</p></article>", "a b\n\nc d"),
])
def test_inline_elements_attributes_and_forms(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("text, found", [("token:" * 20_000, 0), ("password=1 " * 10_000, 0), ("a://b:" * 10_000, 0), ("token:abcdefgh " * 10_000, 10_000), ("token" + " " * 100_000 + ":", 0), ("a.a." * 20_000 + "://", 0), ("token:xx," * 10_000, 0), ("token:" + "monkeydragon" * 5_000, 1)])
def test_secret_scan_of_repeated_contexts(text, found):
    secrets.spans_of("token: x9$Kq2!vLm7#pR", words=brute.RANKS)  # reads the dictionary
    began = time.process_time()
    spans = secrets.spans_of(text, words=brute.RANKS, costs=False)
    assert len(spans) == found and time.process_time() - began < 5  # a fraction of a second where nothing else runs


#: The contexts and values again, as one pattern.
START = r"(?-i:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
WHOLE = re.compile(
    rf"""(?:password|passwd|secret|token|api[_-]?key|{START}(?:pwd|pass|passphrase|passcode|credentials?|auth|private[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|auth[_-]?key|db[_-]?pass|login))"""
    r"""["']?\x20*[:=]\x20*(?:"(?P<a>(?:\\\S|[^\s"\\]){6,})|'(?P<b>(?:\\\S|[^\s'\\]){6,})|(?P<c>[^\s"'<>,;|]{6,}))"""
    r"""|\b[a-z][a-z0-9+.-]{0,31}://[^\s/:@"']*:(?!\d{1,5}[/?\#])(?P<d>(?:[^\s"'<>@]|@(?=[^\s"'<>@/,;]*@)){6,})(?=@)|\b(?:Bearer|Basic)\x20+(?P<e>[^\s"'<>,;|@]{6,})""",
    re.I | re.A,
)


def added_spans(t):
    """Contexts one after another; a value that is cheap, or within a base span, may hold another context."""
    base = [(m.start(), m.end()) for _, p, g, least in brute.PATTERNS for m in p.finditer(t) if len(m[g]) >= least]
    out, at = [], 0
    while m := WHOLE.search(t, at):
        a, b = m.span(m.lastgroup)
        at = a
        if not any(x <= a and b <= y for x, y in base) and brute.guess_cost(t[a:b], brute.RANKS) >= secrets.THRESHOLD:
            out.append(("guess", m.start(), b))
            at = b
    return out


def test_added_spans_against_all_segmentations():
    rng = random.Random(11)
    parts = ["token:", "pwd=", "password = ", "secret: ", 'api_key="', "://u:", "db", "x9$K", "vR7#", "monkey", "1234", "qwer", "@host", " ", "Bearer ", "'", ",", "aaaa", "Zk", "kq2L"]
    texts = [t for t in brute.SECRETS if t] + ["".join(rng.choice(parts) for _ in range(rng.randint(3, 7))) for _ in range(250)]
    texts = [t for t in texts if len(t) < 60]
    some = 0
    for t in texts:
        got = [s[:3] for s in secrets.spans_of(t, words=brute.RANKS) if s[0] == "guess"]
        assert got == added_spans(t), t
        some += len(got)
    assert some > 40 and len(texts) > 200


def test_plan_of_shards_in_blocks():
    rng = random.Random(2)
    kinds = sorted(((s, rng.choice([1, 2, 39, 40, 41, 500])) for s in rng.sample(range(1, 9000), 700)), reverse=True)
    whole = shards.schedule(*(np.array(x, np.int64) for x in zip(*kinds, strict=True)), 40).to_pylist()
    got = []
    for table in shards.blocks(iter(kinds), 40, block=64):
        for r in table.to_pylist():
            lo = 0
            for hi, shard in zip(r["to"], r["shards"], strict=True):
                got.append({"total": r["total"], "lo": lo, "hi": hi, "shard": shard})
                lo = hi
            assert lo == r["groups"]
    assert got == whole and list(shards.blocks(iter([]), 40)) == []


@pytest.mark.parametrize("seed", range(5))
def test_never_more_sequences_than_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([64, 256, 1024])
    counts = dict(Counter(min(size, max(1, int(rng.lognormvariate(math.log(size / 3), 0.8)))) for _ in range(rng.choice([50, 800, 3000]))))
    made = packing.plan(counts, size)
    assert packing.histogram_of(made) == counts and max(map(sum, made)) <= size
    alone = sum(packing.best_fit(counts, size).values())
    assert -(-sum(x * n for x, n in counts.items()) // size) <= sum(made.values()) <= alone
    assert packing.histogram_of(packing.fullest(counts, size)) == counts and packing.plan({}, size) == Counter()


def test_near_dedup_of_rows_without_an_id(spark):
    """Texts meet their own row, not all rows without an id."""
    base = [brute.prose(i, 60) for i in range(40)]
    rows = [(None, t) for t in base] * 3 + [(7, t) for t in base[:5]] + [(None, brute.edited(t.replace("\n", " "), 70)) for t in base[:10]]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(repr((r.doc_id, r.class_id, r.class_size)) for r in got) == brute.near_truth(rows)


def test_token_files_of_rows_that_share_an_id(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(brute.JSON)
    t.encode_special_tokens = True
    rows = [(None, f"text {i}") for i in range(50)] + [(None, "same")] * 30 + [(3, "a <|endoftext|> b"), (3, "c"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = token_files.read_tokens(token_files.write_tokens(df, brute.JSON), digests=True).collect()
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]
    want = sorted(repr((d, len(ids(x)), zlib.crc32(np.array(ids(x), "<u4").tobytes()))) for d, x in rows)
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert known == sorted(known, key=lambda d: (d is not None, d or 0))


def test_pattern_whose_pieces_cross_spaces(spark):
    """Two words and the space between them are one piece, so texts can't be cut at spaces."""
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    pattern = r"\w+ \w+|\s|\w+|[^\w\s]+"
    ranks = load_tiktoken_bpe(brute.RANKS)
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["one two three four five", "in the of the", "a, b c", "", None]
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), brute.RANKS, pattern).collect()}
    assert got == {i: library.encode_ordinary(x or "") for i, x in enumerate(texts)}
