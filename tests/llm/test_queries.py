"""The registered queries and the pipeline over the smallest tables, against brute-force versions and SQL."""

import collections
import hashlib
import math
import os
import random
import re
from html.parser import HTMLParser

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from nightloom.llm import html_text, quality, queries  # noqa: E402
from tests.llm import test_operators as brute  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op2_html_text": "page_id url text n_chars", "op3_warc": "page_id payload_bytes payload_digest record_type refers_to", "op4_token_files": "doc_id start n_tokens ids_crc32",
    "op5_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op6_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op1_near_dedup": "doc_id class_id class_size",
    "op11_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", "op12_mixing": "doc_id size source_size target taken", "op13_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def results(spark):
    """Each query's rows, computed once."""
    held = {}

    def of(name):
        if name not in held:
            df = queries.QUERIES[name](spark, SF)
            assert set(COLUMNS[name].split()) <= set(df.columns)
            held[name] = df.collect()
        return held[name]

    return of


def test_every_query_is_listed():
    assert sorted(queries.QUERIES) == sorted(COLUMNS)


def test_near_dedup_query(results, texts):
    got = results("op1_near_dedup")
    assert sorted(repr((r.doc_id, r.class_id, r.class_size)) for r in got) == brute.near_truth(texts)


def test_exact_dedup_query(results):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(queries.ORACLE_SQL["op5_exact_dedup"])
    names = [d[0] for d in found.description]
    assert sorted(repr(tuple(r[n] for n in names)) for r in results("op5_exact_dedup")) == sorted(repr(r) for r in found.fetchall())


def test_warc_query(spark, results):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    best = {}
    for r in pages:
        best[r.html or ""] = max(best.get(r.html or "", -1), r.page_id)
    want = [(r.page_id, len((r.html or "").encode()), "response" if best[r.html or ""] == r.page_id else "revisit", r.url) for r in pages]
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.record_type, r.url)) for r in results("op3_warc"))


def test_token_queries(results, texts):
    import base64
    import zlib

    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in texts}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    start = 0
    for r in sorted(results("op4_token_files"), key=lambda r: r.doc_id):
        own = ids[r.doc_id] + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), crc(own))
        start += len(own)
    for r in results("op10_bpe"):
        x = dict(texts)[r.doc_id] or ""
        own = e.encode_ordinary(x)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
    packed, by = results("op9_packing"), collections.defaultdict(list)
    for r in packed:
        own = ids[r.doc_id] + [2]
        assert r.ids_crc32 == crc(own[r.start : r.start + r.length]) and r.length <= 1024
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in packed) == sum(len(x) + 1 for x in ids.values())
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in packed) // 1024) + 2


def test_secret_query(results, texts):
    for r in results("op6_secret_scan"):
        base = brute.base_spans(dict(texts)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) - {""} <= set(r.spans.split(","))


def votes_of(text):
    """The rules written again over plain text: shares of words, lines and characters."""
    text = text or ""
    n, chars, symbols, dup, repeats = brute.rule_values(text)
    bare = brute.bare(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = sum(1 for x in text.split("\n") if brute.bare(x))
    stops = sum(w.lower() in set(quality.STOP_WORDS) for w in words)
    import unicodedata

    kind = [unicodedata.category(c) for c in bare]
    marks, capitals, digits = sum(k[0] not in "LMN" for k in kind), kind.count("Lu"), kind.count("Nd")
    mean = chars / max(n, 1)
    pairs = [
        (n > 0 and 3 <= mean <= 9, n > 0 and (mean < 2.5 or mean > 12)), (n > 0 and symbols <= 0.02 * n, symbols > 0.1 * n), (n > 0 and marks <= 0.1 * max(chars, 1), marks > 0.15 * max(chars, 1)),
        (stops >= 0.08 * n, n >= 50 and stops < 0.03 * n), (lines >= 2 and dup <= 0.05 * max(lines, 1), dup > 0.3 * max(lines, 1)), (n >= 50 and repeats <= 0.2 * n, repeats > 0.4 * n),
        (n > 0 and capitals <= 0.1 * max(chars, 1), capitals > 0.3 * max(chars, 1)), (n > 0 and digits <= 0.1 * max(chars, 1), digits > 0.25 * max(chars, 1)),
    ]
    return tuple(-1 if bad else 1 if good else 0 for good, bad in pairs), n < 50 or 100 * repeats > 50 * n


def test_quality_query(results, texts):
    """Posteriors by expectation-maximisation over single documents, not over counted patterns."""
    seen = [(d, *votes_of(t)) for d, t in texts]
    rows = [v for _, v, failed in seen if not failed]
    prior, on_good, on_bad = 0.9, [0.95] * 8, [0.6] * 8  # how often a vote of 1 is right on good documents, of -1 on bad ones

    def posterior(v):
        a, b = prior, 1 - prior
        for x, g, h in zip(v, on_good, on_bad, strict=True):
            if x:
                a, b = a * (g if x > 0 else 1 - g), b * (1 - h if x > 0 else h)
        return a / (a + b)

    for _ in range(quality.ROUNDS):
        p = [posterior(v) for v in rows]
        prior_ = min(max(sum(p) / len(p), 0.05), 0.95)
        for i in range(8):
            own = [(x, v[i]) for x, v in zip(p, rows, strict=True) if v[i]]
            g = (1.9 + sum(x for x, v in own if v > 0)) / (2.0 + sum(x for x, _ in own))
            h = (1.2 + sum(1 - x for x, v in own if v < 0)) / (2.0 + sum(1 - x for x, _ in own))
            on_good[i], on_bad[i] = min(max(g, quality.LEAST), quality.MOST), min(max(h, 1 - quality.MOST), quality.MOST)
        prior = prior_
    want = {d: (failed, not failed and posterior(v) >= 0.5) for d, v, failed in seen}
    got = {r.doc_id: r for r in results("op7_quality_rules")}
    assert all(math.isclose(got[d].probability, posterior(v), rel_tol=1e-6) for d, v, _ in seen)
    assert {d: (r.base_failed, r.kept) for d, r in got.items()} == want


def test_shard_query(results, texts):
    groups = collections.defaultdict(int)
    for _, t in texts:
        groups[t or ""] += len((t or "").encode()) + 16
    loads, want = collections.Counter(), collections.Counter()
    for r in results("op8_shards"):
        loads[r.shard] += r.size
    for (size, shard), n in brute.one_by_one(groups.values(), 40).items():
        want[shard] += size * n
    assert +loads == +want


class Article(HTMLParser):
    """The text of a page's article by the standard library's parser: what stands in it but not in a dropped element."""

    DROPPED = {"nav", "aside", "footer", "form", "script", "style", "header"}
    BLOCKS = {"h1", "h2", "p", "div", "ul", "li", "article", "section", "br"}

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.parts = [], [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in self.BLOCKS:
            self.cut()
        if tag not in ("p", "b", "i", "meta", "li"):
            self.open.append((tag, tag in self.DROPPED or dict(attrs).get("class") in ("ad", "comments", "sidebar", "notice")))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(d for _, d in self.open):
            self.parts.append(data)


def article(page):
    a = Article()
    a.feed(page)
    a.close()
    a.cut()
    return "\n\n".join(a.blocks)


def test_html_query(spark, results):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in results("op2_html_text")}
    assert got == {p: article(h) for p, h in pages.items()}


def test_html_of_unmarked_pages(spark):
    """Pages whose article is a plain div between menus, adverts, forms, comments and footers: blocks found and lost."""
    rng, right, found, wanted = random.Random(8), 0, 0, 0
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(6)) + "</ul>"
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        if not body:
            continue
        want = article(r.html).split("\n\n")
        extra = ["<div class='sidebar'><p>More from us that you may like to read.</p></div>", "<form><label>Name</label><input></form>", f"<div class='related'>{links}</div>", "<div class='notice'>We use the cookies that you know.</div>"]
        rng.shuffle(extra)
        page = f"<html><body><div id='menu'>{links}</div>{extra[0]}<div class='content'>{body[1]}</div>{extra[1]}{extra[2]}<div class='comments'><p>I like the thing that you say in it, and so does she.</p></div><div class='footer'>&copy; us</div>{extra[3]}</body></html>"
        got = [b for b in html_text.main_text(page).split("\n\n") if b]
        both = sum((collections.Counter(got) & collections.Counter(want)).values())
        right, found, wanted = right + both, found + len(got), wanted + len(want)
    assert right / found > 0.98 and right / wanted > 0.95, (right / found, right / wanted)


def test_pipeline(spark, texts):
    """The pieces of the documents that the stages leave, by brute force for each stage."""
    verdict = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    kept = [(d, t) for d, t in texts if verdict[d]]
    groups = collections.defaultdict(list)
    for d, t in kept:
        groups[brute.bare(t)].append((-len(t), d, t))
    left = [min(g)[1:] for g in groups.values()]
    near = collections.defaultdict(list)
    for line in brute.near_truth(left):
        d, c, _ = eval(line)
        near[c].append(d)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(near)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    by = collections.Counter()
    for r in got:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 1024 and all(len(r.ids) == r.length for r in got)


def test_stages_of_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if "sequence_id" in out.columns else out


def test_dropping_stages_keep_other_columns(spark):
    """Columns whose names clash with the operators' own; repeated rows, null ids and texts."""
    from nightloom.llm import exact_dedup, near_dedup

    good = brute.prose(3, 200)
    rows = [(1, good, True, "a"), (1, good, False, "b"), (2, good + " ", True, "c"), (None, good, True, "d"), (3, None, True, "e"), (4, brute.edited(good, 90), None, "f"), (1, brute.prose(4, 200), True, "g"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, first string").repartition(3)
    for drop, want in ((quality.drop_poor, "abcdfg"), (exact_dedup.drop_exact_copies, "cefg"), (near_dedup.drop_near_copies, "abdeg")):
        out = drop(df)
        assert out.columns == df.columns
        assert "".join(sorted(r.first or "" for r in out.collect())) == want, drop
        assert drop(df.filter("doc_id = 99")).collect() == []
