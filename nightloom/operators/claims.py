"""Texts against data: claims that texts make, tables of what they may say, and findings where the two differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of claims by their kind; the first group is the value.
PATTERNS = {
    "time": r"(?<!\d)([01]?\d:[0-5]\d|2[0-3]:[0-5]\d)(?!\d)",
    "percent": r"(\d+(?:\.\d+)?)\s*[%％]",
    "km": r"(\d+(?:\.\d+)?)\s*(?:km|キロ)",
    "hours": r"(\d+(?:\.\d+)?)\s*(?:h\b|hours?|時間)",
    "number": r"(?<![\d.:])(\d{5,})(?![\d.:])",
}
#: Words that say nothing about when.
VAGUE = r"(?i)\b(?:sometime|at some point|in due course|eventually|soon)\b|そのうち|やがて|しばらくして"


def sentences(text: Column) -> Column:
    """Sentences with their stops; a stop within a word or number doesn't end one."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?:[^.!?。！？\n]|[.!?](?=[^\s.!?]))+[.!?。！？]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def claims(docs: DataFrame, keys: list[str], text: str, kinds: list[str] | None = None) -> DataFrame:
    """A row per claim: keys, kind, claim. Sentences are gone through where the text is; only claims go on."""

    def of(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("claim")))

    found = [of(k) for k in kinds or PATTERNS]
    return docs.select(*keys, F.explode(F.concat(*found)).alias("c")).select(*keys, "c.kind", "c.claim")


def unsupported(claimed: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Claims that the table of allowed (keys, kind, claim) doesn't hold."""
    return claimed.join(allowed.select(*keys, "kind", "claim").distinct(), [*keys, "kind", "claim"], "left_anti")


def out_of_range(claimed: DataFrame, values: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Numeric claims that differ from their key's value of that kind by more than ``tolerance``."""
    said = claimed.withColumn("said", F.col("claim").try_cast("double"))
    return said.join(values, [*keys, "kind"]).filter(F.abs(F.col("said") - F.col("value")) > tolerance + 1e-9)


def unique_only(directions: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows whose label occurs once for its key: others can't be told apart in a text."""
    once = directions.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return directions.join(once, [*keys, label], "left_semi")


def vague(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    return docs.select(*keys, F.explode(sentences(F.col(text))).alias("sentence")).filter(F.col("sentence").rlike(VAGUE))


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; a rule that is null counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def aliases(name: Column) -> Column:
    """A name and those of its parts between dots and brackets that have three characters or more."""
    parts = F.filter(F.split(name, "[・（）()]"), lambda p: F.length(p) >= 3)
    return F.array_union(F.array(name), parts)
