"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text without its white space is cut into chunks at places that its content fixes, so equal texts have equal chunks.
Every chunk gets a 64-bit identifier; one aggregation over all chunks moves each distinct chunk of a task once and shows
the identifiers that stand for more than one chunk. Where there are such clashes, the chunk's number among those that
share the identifier is added, so identifiers are exact. After that only the ordered identifier lists (the recipes, about
two hundredths of the text) are grouped and joined; texts are not moved again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightloom.llm.common import SPACE, joined, settle, text_of

#: A chunk ends after the first pair of these two classes that follows its least length, or at its greatest length.
BEFORE_CUT, AFTER_CUT = "[aeiouyAEIOUY0-4.,;]", "[bdfgkpvwzBDFGKPVWZ5-9!?]"
LEAST_CHUNK, MOST_CHUNK = 256, 4096
#: Added to lengths so that one decimal orders rows by length, longest first, and then by id, smallest first.
SPAN = 1 << 64


def chunk_pattern(least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> str:
    return rf"(?s).{{{least - 2},{most - 2}}}?{BEFORE_CUT}{AFTER_CUT}|.{{1,{most}}}"


def chunked(docs: DataFrame, id_col: str, text_col: str, least: int, most: int, carry: list[str]) -> DataFrame:
    """doc_id, n (code points of the text), bare (text without white space), chunks."""
    bare = docs.select(F.col(id_col).alias("doc_id"), *carry, F.length(text_of(text_col)).alias("n"), F.regexp_replace(text_of(text_col), f"{SPACE}+", "").alias("bare"))
    return bare.withColumn("chunks", F.regexp_extract_all("bare", F.lit(chunk_pattern(least, most)), F.lit(0)))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, identify=F.xxhash64, carry: list[str] = ()) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; null is the empty text, and all empty texts form one
    group. The row with the longest original text (code points) stays, of those the smallest doc_id; a null doc_id comes
    last. Rows that repeat both a doc_id and a text stay or go together. Other columns are ignored; no rows, no result.
    ``identify`` makes a chunk's identifier (tests pass one that clashes); ``carry``: further columns to keep.
    """
    cut = chunked(docs, id_col, text_col, least, most, carry)
    named = F.transform("chunks", lambda c: identify(c).cast("long"))
    pieces = cut.select(F.explode("chunks").alias("chunk")).select(identify("chunk").cast("long").alias("h"), "chunk")
    distinct = pieces.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("copies"))
    clashes = settle(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1").select("h"))
    rows = cut.select("doc_id", *carry, "n", F.sha2("bare", 256).alias("text_sha256"), named.alias("recipe"))
    keys = ["recipe"]
    if not clashes.isEmpty():
        number = F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
        variants = distinct.join(clashes, "h").select("h", "chunk", number.alias("variant"))
        at = cut.select("doc_id", F.sha2("bare", 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk")).distinct()
        exact = at.withColumn("h", identify("chunk").cast("long")).join(variants, ["h", "chunk"])
        fixes = exact.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "variant"))).alias("found"))
        same = rows["doc_id"].eqNullSafe(fixes["doc_id"]) & (rows["text_sha256"] == fixes["text_sha256"])
        nothing = F.array().cast("array<struct<pos:int,variant:int>>")
        rows = rows.join(fixes, same, "left").select(rows["*"], F.coalesce(fixes["found"], nothing).alias("fix"))
        keys = ["recipe", "fix"]
    span = F.lit(str(SPAN)).cast("decimal(20,0)")
    none = F.lit(str(1 << 63)).cast("decimal(20,0)")  # stands for a null id: more than any other
    last = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), none)
    rows = settle(rows.withColumn("rank", (F.col("n").cast("decimal(10,0)") * span - last).cast("decimal(38,0)")))
    groups = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("best"), F.max("n").alias("longest")))
    keep = (F.col("longest").cast("decimal(10,0)") * span - F.col("best")).cast("decimal(38,0)")
    keep = F.when(keep < none, keep).cast("long")
    # The recipe of a hot group is broadcast: of fewer than a thousand groups, so on average no more than that many rows' recipes.
    found = joined(rows, groups.withColumn("rows", F.col("group_size")), keys, "rows", rows.count())
    return found.select("doc_id", *carry, keep.alias("keep_id"), "group_size", (F.col("rank") == F.col("best")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_classes`` drops; columns as they are, and no rows give none.

    A row goes by its id and text. Ids and digests are gathered, texts move once, to meet the verdict.
    """
    raw = lambda text: F.sha2(F.coalesce(text, F.lit("")), 256)
    seen = exact_classes(docs.withColumn("__raw", raw(F.col(text_col))), id_col, text_col, carry=["__raw"])
    gone = seen.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"), "__raw").distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]) & (raw(docs[text_col]) == gone["__raw"]), "left_anti")
