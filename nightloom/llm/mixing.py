"""Mixing sources to target weights, in DataFrame functions only.

Sources share an amount of words by weight, none above a number of epochs of its own words: the level at which the shares add
up is read off running sums over the sources by the ratio of bound and weight. Within a source rows are in the order of a
hash, range-sorted; sums of the ranges, of which there are as many as partitions, shift the running sums of each range. The
source's budget is spent on whole epochs first and then on the rows in that order; the row at the cut gives its first words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.llm.common import SPACE, WORD, joined, settle, text_of
from nightloom.operators import rank

WEIGHTS, SHARE, MOST_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix"


def words_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, f"{SPACE}+"), "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """``sources`` (no_source, source, source_size and more) with ``target``: double.

    Sources in code point order, the one without a name last, take the weights in turn and share ``share`` times all sizes, at
    most ``most`` times their own size each; what that leaves is shared again by weight. Sums are running sums over ranges, so
    there may be any number of sources.
    """
    placed = rank.numbered(sources, [], F.asc("no_source"), F.asc("source"), out="__no")
    each = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__no") - 1) % len(weights) + 1)
    placed = placed.withColumn("__weight", each).withColumn("__most", F.col("source_size") * most)
    placed = placed.withColumn("__order", F.struct((F.col("__most") / F.col("__weight")).alias("ratio"), F.col("__no").alias("no")))
    placed = settle(rank.running(rank.running(placed, "__order", "__most", "__most_before"), "__order", "__weight", "__weight_before"))
    total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("__weight"), F.lit(0.0)).alias("weight")).first()
    level = (F.lit(total["words"] * share) - F.col("__most_before")) / (F.lit(total["weight"]) - F.col("__weight_before"))
    fits = placed.withColumn("__level", level).filter("__level <= __order.ratio").agg(F.min_by("__level", "__order").alias("level")).first()["level"]
    target = F.col("__most").cast("double") if fits is None else F.least(F.col("__most").cast("double"), F.col("__weight") * F.lit(fits))
    return placed.withColumn("target", target).drop("__no", "__weight", "__most", "__order", "__most_before", "__weight_before")


def planned(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, *,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, carry: list[str] = (),
) -> DataFrame:
    """One row per input row: doc_id, size (words), source_size, target (its source's), epochs (times that it is taken whole), part
    (words of one more copy), taken (all words that the mix takes of it).

    A source's taken words are its target, rounded. Rows come in the order of the md5 of ``seed:id:text``, so reruns agree; rows
    that repeat both are interchangeable. Null texts and texts of white space have size 0 and give 0 words; a null id counts
    as empty in the hash; a null source is one of its own, last; the empty name is another. A share above ``most`` gives every
    source ``most`` times its size. Other columns but ``carry`` are ignored. No rows: no rows.
    """
    t = text_of(text_col)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), t))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        words_of(t).alias("size"), F.unhex(key).alias("key"), *carry,
    )
    rows = settle(rows)
    names = ["no_source", "source"]
    sources = settle(rows.groupBy(*names).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    placed = joined(rows, targets(sources, weights, share, most), names, "n", rows.count())
    # Copies of a row share a key; a number that differs lets ranges part them.
    placed = placed.withColumn("__copy", F.xxhash64(F.monotonically_increasing_id()))
    base = settle(placed.repartitionByRange(*names, "key", "__copy").withColumn("__p", F.spark_partition_id()))
    own = [*names, "__p"]
    ranges = base.groupBy(*own).agg(F.sum("size").alias("__s"))  # a row for each source of a range
    shift = F.coalesce(F.sum("__s").over(Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mine = F.coalesce(F.sum("size").over(Window.partitionBy(*own).orderBy("key", "__copy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = base.withColumn("__o", mine).join(ranges.select(*own, shift.alias("__b")), own)
    budget, size = F.round("target").cast("long"), F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("__o") - F.col("__b")
    part = F.greatest(F.lit(0), F.least(size, left)).cast("long")
    return cut.select("doc_id", *names, *carry, "size", "source_size", "target", epochs.alias("epochs"), part.alias("part"), (epochs * size + part).alias("taken"))


def mixed(docs: DataFrame, *args, text_col: str = "text", **more) -> DataFrame:
    """The mix: the columns of ``docs`` and ``epoch`` (0, 1 ...), a row for each copy that the plan takes, the text of the copy at the
    cut up to its last word taken. Rows of no words are left out, a column named ``epoch`` is replaced; see ``planned``.
    """
    whole = F.struct(*docs.columns).alias("__row")
    plan = planned(docs.withColumn("__row", whole), *args, text_col=text_col, carry=["__row"], **more).filter("taken > 0")
    copies = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - F.when(F.col("part") > 0, 0).otherwise(1))))
    text = F.col("__row")[text_col]
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"{SPACE}*{WORD}"), F.lit(0)), 1, F.col("part").cast("int")), "")
    cut = (F.col("epoch") == F.col("epochs")) & (F.col("part") < F.col("size"))
    columns = [F.when(cut, head).otherwise(text).alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns if c != "epoch"]
    return copies.select(*columns, "epoch")
