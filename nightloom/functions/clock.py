"""Times of day, texts of them, and other small string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Session times are local times of this zone where a query says so; satellites tell UTC.
ZONE = "Asia/Tokyo"
DAY = 1440


def minutes(hhmm: Column) -> Column:
    """Minutes since midnight of HH:MM."""
    return F.split(hhmm, ":")[0].cast("int") * 60 + F.split(hhmm, ":")[1].cast("int")


def hhmm(minute: Column) -> Column:
    m = F.pmod(minute, F.lit(DAY)).cast("int")
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int"))


def floor_to(ts: Column, step: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / (60 * step)) * 60 * step)


def ceil_to(ts: Column, step: int) -> Column:
    return F.timestamp_seconds(F.ceil(F.unix_seconds(ts.cast("timestamp")) / (60 * step)) * 60 * step)


def half_hour(minute: Column) -> Column:
    """To the nearest 30 minutes; halves to the even one."""
    return (F.rint(minute / 30.0) * 30).cast("int")


def window_hours(start: Column, end: Column) -> Column:
    """Hours from one HH:MM to another, over midnight where the end is earlier."""
    return F.pmod(minutes(end) - minutes(start), F.lit(DAY)) / 60.0


def phrase_fits(kind: Column, said: Column, event: Column) -> Column:
    """Whether a phrase about a minute fits an event: exact within 10, after [0, 30), before [-30, 0), about within 30, hour [0, 60)."""
    d = F.pmod(event - said + DAY + DAY // 2, F.lit(DAY)) - DAY // 2
    fits = F.when(kind == "after", (d >= 0) & (d < 30)).when(kind == "before", (d >= -30) & (d < 0)).when(kind == "about", F.abs(d) <= 30).when(kind == "hour", (d >= 0) & (d < 60))
    return fits.otherwise(F.abs(d) <= 10)


def utc_basetime(text: Column) -> Column:
    """YYYYMMDDHHMMSS in UTC as local time."""
    return F.from_utc_timestamp(F.to_timestamp(text, "yyyyMMddHHmmss"), ZONE)


def tone(mean: Column) -> Column:
    return F.when(mean < 30, "good").when(mean < 60, "mixed").otherwise("poor")


def moon_icon(phase: Column) -> Column:
    """Index of eight phases of a signed phase in degrees, halves to the even one."""
    return F.pmod(F.rint(phase / 45.0), F.lit(8.0)).cast("int")


def season(best: Column, month: Column) -> Column:
    """best, early, late or off; months go round."""
    before, after = F.pmod(month, F.lit(12)) + 1, F.pmod(month + 10, F.lit(12)) + 1
    return F.when(F.array_contains(best, month), "best").when(F.array_contains(best, before), "early").when(F.array_contains(best, after), "late").otherwise("off")


def weekend(today: Column) -> Column:
    """The nights of the coming weekend: from Saturday to Sunday, or Sunday alone on a Sunday."""
    wd = F.weekday(today)
    return F.when(wd == 6, F.array(today)).otherwise(F.array(F.date_add(today, 5 - wd), F.date_add(today, 6 - wd)))


def json_safe(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def script_embed(x: Column) -> Column:
    """JSON that can stand in a script element."""
    return F.replace(F.replace(F.replace(x, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))


def failure_kind(reason: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.substring_index(reason, ":", 1)), F.lit("")), F.lit("unknown"))


def rate_limit(reason: Column) -> Column:
    """daily before hourly before minutely, else unknown."""
    low = F.lower(reason)
    return F.when(low.contains("daily"), "daily").when(low.contains("hourly"), "hourly").when(low.contains("minutely"), "minutely").otherwise("unknown")


def display_width(x: Column) -> Column:
    """Columns of a terminal: wide characters take two."""
    return F.length(x) + F.length(F.regexp_replace(x, "[^\\x{1100}-\\x{115F}\\x{2E80}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE6F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}]", ""))


def padded(x: Column, width: int) -> Column:
    return F.concat(x, F.repeat(F.lit(" "), F.greatest(F.lit(width) - display_width(x), F.lit(0))))


def slug(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_-]+", "_")


def map_url(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps?q="), lat.cast("string"), F.lit(","), lon.cast("string"))


def safe_url(x: Column) -> Column:
    return F.coalesce(x.rlike("^https?://[^\\s\"'<>]+$"), F.lit(False))
