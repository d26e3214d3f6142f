"""Sentences held against tables: which object and verb a time belongs to, what a frame or a horizon says, and what a text may say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightloom.functions import clock
from nightloom.functions.geo import compass_up, let
from nightloom.operators.claims import sentences

#: Phrases before a time, by what they mean (see clock.phrase_fits).
PHRASES = {"soon after": "after", "shortly before": "before", "around": "about", "in the hour of": "hour", "at": "exact"}
TIME = rf"(?:({'|'.join(PHRASES)}) )?(?<!\d)([01]?\d|2[0-3]):([0-5]\d)(?!\d)"
#: Words for a dark night, and the lit share of the moon from which they are wrong.
DARK, LIT = r"(?i)\b(?:moonless|dark|pitch-black)\b", 0.30


def any_of(names: list[str]) -> str:
    """A pattern of names; of names that begin alike the longest is found."""
    escape = lambda n: "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in n)
    return rf"\b(?:{'|'.join(escape(n) for n in sorted(names, key=len, reverse=True))})\b"


def found(text: Column, pattern: str) -> Column:
    """Array of (at, what): all matches that don't overlap, with their places in the text."""
    what, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(w: Column, g: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,what:string>>").alias("out"))
        step = lambda a, x: let(
            a["end"] + F.length(x["g"]), lambda at: F.struct((at + F.length(x["w"])).alias("end"), F.concat(a["out"], F.array(F.struct(at.alias("at"), x["w"].alias("what")))).alias("out"))
        )
        return F.aggregate(F.zip_with(w, F.slice(g, 1, F.size(w)), lambda x, y: F.struct(x.alias("w"), y.alias("g"))), start, step, lambda a: a["out"])

    return let(what, lambda w: placed(w, gaps))


def nearest(places: Column, at: Column) -> Column:
    """What stands nearest to a place in the text, the first on ties; null if there is nothing."""
    return F.array_min(F.transform(places, lambda x: F.struct(F.abs(x["at"] - at).alias("d"), x["at"].alias("at"), x["what"].alias("what"))))["what"]


def timed_claims(docs: DataFrame, keys: list[str], text: str, names: list[str], verbs: list[str]) -> DataFrame:
    """keys, clause, name, verb, phrase, minute of every time in a text, with the clause's nearest name and verb (null: none)."""
    clauses = docs.select(*keys, F.posexplode(F.flatten(F.transform(sentences(F.col(text)), lambda s: F.split(s, "[,;、]")))).alias("clause", "c"))
    c = F.col("c")
    placed = clauses.select(*keys, "clause", F.explode(found(c, TIME)).alias("t"), found(c, any_of(names)).alias("names"), found(c, any_of(verbs)).alias("verbs"))
    part = lambda n: F.regexp_extract("t.what", TIME, n)
    kind = F.lit("exact")
    for words, k in PHRASES.items():
        kind = F.when(part(1) == words, k).otherwise(kind)
    # the time itself stands at the end of its phrase
    at = F.col("t.at") + F.length("t.what")
    return placed.select(*keys, "clause", nearest(F.col("names"), at).alias("name"), nearest(F.col("verbs"), at).alias("verb"), kind.alias("phrase"), (part(2).cast("int") * 60 + part(3).cast("int")).alias("minute"))


def without_event(claimed: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Timed claims that no event (name, verb, event) of their name and verb fits; those without a name or verb are no claims."""
    own = claimed.filter("name is not null and verb is not null").select(*keys, "clause", "name", "verb", "phrase", "minute")
    held = events.groupBy("name", "verb").agg(F.collect_set("event").alias("__e"))
    fits = F.exists("__e", lambda e: clock.phrase_fits(F.col("phrase"), F.col("minute"), e))
    return own.join(held, ["name", "verb"], "left").filter(~F.coalesce(fits, F.lit(False))).select(own.columns).distinct()


def nearest_frame(claimed: DataFrame, frames: DataFrame, keys: list[str], minute: str = "minute", step: int = 20, tolerance: int = 10) -> DataFrame:
    """``claimed`` with ``frame``: the struct of its keys' frame (keys, m, ...) nearest in time, the earlier on ties, null beyond.

    Frames stand at multiples of ``step`` minutes, so a claim asks for the few of them within the tolerance by equality.
    """
    m = F.col(minute)
    lo, hi = F.ceil((m - tolerance) / step), F.floor((m + tolerance) / step)
    asked = claimed.withColumn("__n", F.monotonically_increasing_id())
    near = asked.select("__n", *keys, m.alias("__m"), F.explode(F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: (k * step).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("m"))
    body = F.struct(*(c for c in frames.columns if c not in keys))
    best = near.join(frames.withColumn("__f", body), [*keys, "m"]).groupBy("__n").agg(F.min_by("__f", F.struct(F.abs(F.col("m") - F.col("__m")), F.col("m"))).alias("frame"))
    return asked.join(best, "__n", "left").drop("__n")


def position_findings(claimed: DataFrame, frames: DataFrame, names: list[str], tolerance: float = 1.0) -> DataFrame:
    """``claimed`` (name, minute, altitude, direction, ...) by what is wrong: no_frame, altitude (off by more than the tolerance),
    direction (another point of the compass)."""
    at = nearest_frame(claimed, frames, names)
    wrong = [
        F.when(F.col("frame").isNull(), "no_frame"),
        F.when(F.abs(F.col("frame.alt") - F.col("altitude")) > tolerance + 1e-9, "altitude"),
        F.when(compass_up(F.col("frame.az")) != F.col("direction"), "direction"),
    ]
    return at.withColumn("finding", F.explode(F.array_compact(F.array(*wrong)))).drop("frame")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def range_findings(claimed: DataFrame, truth: DataFrame, keys: list[str], tolerance: int = 0) -> DataFrame:
    """Claims (keys, low, high) whose bounds differ from the truth's (lowest, highest), rounded half up, by more than the
    tolerance, or for which there is none."""
    off = lambda a, b: F.abs(F.col(a) - half_up(F.col(b))) > tolerance
    wrong = F.coalesce(off("low", "lowest") | off("high", "highest"), F.lit(True))
    return claimed.join(truth, keys, "left").filter(wrong)


def dark_words(docs: DataFrame, moon: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Warnings: texts that call a night dark whose moon (keys, illuminated) is lit by more than LIT at its most."""
    most = moon.groupBy(*keys).agg(F.max("illuminated").alias("most")).filter(F.col("most") > LIT)
    return docs.withColumn("word", F.regexp_extract(text, DARK, 0)).filter("word != ''").join(most, keys)


#: What a verdict may state, with the pattern of its value and how far that may be off; magnitudes never.
VERDICT = {
    "time": (r"\b(\d{1,2}:\d{2})\b", None), "nights": (r"\b(\d+) nights?\b", 0.0), "hours": (r"\b(\d+(?:\.\d+)?) h\b", 0.05), "percent": (r"\b(\d+(?:\.\d+)?)%", 0.0),
    "km": (r"\b(\d+(?:\.\d+)?) km\b", 0.0), "alr": (r"\bALR (\d+(?:\.\d+)?)\b", 0.0), "mag": (r"(?i)\bmag(?:nitude)?\.? ?(-?\d+(?:\.\d+)?)", None),
}


def verdict_findings(docs: DataFrame, allowed: DataFrame, keys: list[str], text: str, names: list[str]) -> DataFrame:
    """keys, kind, claim of what a verdict states that the table of allowed (keys, kind, claim) doesn't: names and times as
    they stand, numbers within their tolerance; a magnitude is never allowed."""

    def all_of(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("claim")))

    stated = [*(all_of(k, p, 1) for k, (p, _) in VERDICT.items()), all_of("name", any_of(names), 0)]
    # a text meets all that it may say in one row; only what is found is exploded
    may = allowed.groupBy(*keys).agg(F.collect_set(F.struct("kind", "claim")).alias("__may"))
    said = docs.select(*keys, F.array_distinct(F.concat(*stated)).alias("__said")).join(may, keys, "left")

    def good(c: Column, m: Column) -> Column:
        off = F.lit(None).cast("double")
        for kind, (_, t) in VERDICT.items():
            off = off if t is None else F.when(c["kind"] == kind, t).otherwise(off)
        near = F.abs(c["claim"].try_cast("double") - m["claim"].try_cast("double")) <= off + 1e-9
        return (m["kind"] == c["kind"]) & (c["kind"] != "mag") & ((c["claim"] == m["claim"]) | near)

    wrong = F.filter("__said", lambda c: ~F.coalesce(F.exists("__may", lambda m: good(c, m)), F.lit(False)))
    return said.select(*keys, F.explode(wrong).alias("c")).select(*keys, "c.kind", "c.claim").distinct()


def walked(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, text of all strings in nested columns: fields by their names, elements by their numbers."""

    def leaves(c: Column, kind: T.DataType, place: Column) -> Column | None:
        """An array of (place, text)."""
        if isinstance(kind, T.StringType):
            return F.when(c.isNotNull(), F.array(F.struct(place.alias("place"), c.alias("text"))))
        if isinstance(kind, T.StructType):
            return joined([leaves(c[f.name], f.dataType, F.concat(place, F.lit(f".{f.name}"))) for f in kind])
        if isinstance(kind, T.ArrayType):
            of = lambda x, i: leaves(x, kind.elementType, F.concat(place, F.lit("["), i.cast("string"), F.lit("]")))
            return None if of(F.lit(None), F.lit(0)) is None else F.flatten(F.transform(c, lambda x, i: F.coalesce(of(x, i), nothing)))
        return None

    nothing = F.array().cast("array<struct<place:string,text:string>>")
    joined = lambda some: F.concat(*(F.coalesce(x, nothing) for x in some if x is not None)) if any(x is not None for x in some) else None
    all_of = joined([leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in df.schema if f.name not in keys])
    return df.select(*keys, F.explode(nothing if all_of is None else all_of).alias("l")).select(*keys, "l.place", "l.text")
