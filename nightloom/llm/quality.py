"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes for a document (1), against it (-1) or abstains (0). Expectation-maximisation over the counts of vote
patterns, which are counted over all documents, estimates how often each rule is right; a document is kept when its
posterior probability of being good reaches a threshold, instead of when it passes every rule. What reaches the driver is
the table of vote patterns, at most 3 to the number of rules rows, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.llm.common import SPACE, WORD, settle, text_of

SYMBOLS = "[#*$%&|<>]"
#: Very frequent words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it as was with be on by at this from are "
    "le la les de des et en un une du que qui dans est pour sur pas au par "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch "
    "el los las y que del se por con una para su al lo como no"
).split()
#: Rounds of expectation-maximisation, and bounds that keep an estimated accuracy away from 0 and 1.
ROUNDS, LEAST, MOST = 50, 0.55, 0.98
#: Bits of a packed window that number its place; longer texts take the plain way.
PLACE_BITS = 24


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once: a lambda's parameter is the one thing that an expression can name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def covered(places: Column) -> Column:
    """How many words the 3-word windows at these ascending places cover."""
    start = F.struct(F.lit(-3).cast("int").alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("total"))
    return F.aggregate(places, start, step, lambda a: a["total"])


def repeat_words(windows: Column) -> Column:
    """Words in windows whose 64-bit hash occurs twice or more; ``windows``: the hashes in text order.

    The hash's upper bits and the window's place share one long, so one sort of primitive values brings equal windows
    together. Neighbours are then compared by the whole hash. If two neighbours agree in the upper bits alone, or the text
    has more windows than places can be numbered, (hash, place) pairs are sorted instead.
    """
    mask = (1 << PLACE_BITS) - 1
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")

    def by_pairs(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: covered(F.sort_array(F.transform(F.filter(s, lambda e, i: ((i > 0) & (e["h"] == F.get(s, i - 1)["h"])) | (e["h"] == F.get(s, i + 1)["h"])), lambda e: e["i"]))))

    def by_packing(h):
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
        whole = lambda x: F.get(h, place(x))
        close = lambda a, b: F.coalesce(a.bitwiseAND(F.lit(~mask)) == b.bitwiseAND(F.lit(~mask)), F.lit(False))

        def found(s):
            near = F.filter(s, lambda e, i: ((i > 0) & close(e, F.get(s, i - 1))) | close(e, F.get(s, i + 1)))
            mixed = lambda n: F.exists(F.transform(n, lambda e, i: F.coalesce(close(e, F.get(n, i + 1)) & (whole(e) != whole(F.get(n, i + 1))), F.lit(False))), lambda x: x)
            return let(near, lambda n: F.when(F.size(n) == 0, F.lit(0).cast("long")).when(mixed(n), by_pairs(h)).otherwise(covered(F.sort_array(F.transform(n, place)))))

        return let(packed, found)

    return let(windows, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0).cast("long")).when(F.size(h) > mask, by_pairs(h)).otherwise(by_packing(h)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the rules need."""
    t = F.col("__t")
    base = docs.select(F.col(id_col).alias("doc_id"), *carry, text_of(text_col).alias("__t")).withColumn("__w", F.array_remove(F.split(t, f"{SPACE}+"), ""))
    w = F.col("__w")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    bare = F.regexp_replace(t, f"{SPACE}+", "")
    return base.select(
        "doc_id", *carry,
        F.size(w).cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(hashes).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        (F.length(bare) - F.length(F.regexp_replace(bare, r"[^\p{L}\p{M}\p{N}]", ""))).cast("long").alias("n_marks"),
        (F.length(bare) - F.length(F.regexp_replace(bare, r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
        (F.length(bare) - F.length(F.regexp_replace(bare, r"\p{Nd}", ""))).cast("long").alias("n_digits"),
    )


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes on the columns of ``features``; thresholds are shares of words, of lines or of word characters."""
    n, chars, lines = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    some = n > 0
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    return {
        "word_length": vote(some & mean.between(3, 9), some & ((mean < 2.5) | (mean > 12))),
        "symbols": vote(some & (F.col("n_symbols") <= 0.02 * n), F.col("n_symbols") > 0.1 * n),
        "marks": vote(some & (F.col("n_marks") <= 0.1 * chars), F.col("n_marks") > 0.15 * chars),
        "stop_words": vote(F.col("n_stop_words") >= 0.08 * n, (n >= 50) & (F.col("n_stop_words") < 0.03 * n)),
        "dup_lines": vote((F.col("n_lines") >= 2) & (F.col("n_dup_lines") <= 0.05 * lines), F.col("n_dup_lines") > 0.3 * lines),
        "repeats": vote((n >= 50) & (F.col("n_repeat_words") <= 0.2 * n), F.col("n_repeat_words") > 0.4 * n),
        "capitals": vote(some & (F.col("n_capitals") <= 0.1 * chars), F.col("n_capitals") > 0.3 * chars),
        "digits": vote(some & (F.col("n_digits") <= 0.1 * chars), F.col("n_digits") > 0.25 * chars),
    }


#: (share of good documents, each rule's accuracy on good documents, and on bad ones) before any estimate.
START = (0.9, 0.95, 0.6)


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents and each rule's two accuracies, from (votes, count) pairs by expectation-maximisation.

    A rule's accuracies are how often its vote is 1 where it votes on a good document, and -1 where it votes on a bad one.
    Rules are taken as independent given the class. From START on, the class that votes of 1 go with is the good one, and
    bounds keep it so. A rule that never votes keeps the start; so do all of them without rows.
    """
    prior, accuracy = START[0], [START[1:]] * n_rules
    patterns = sorted(patterns)
    for _ in range(rounds if patterns else 0):
        sums, good, total = [[1.9, 2.0, 1.2, 2.0] for _ in accuracy], 0.0, 0  # as if START came from two documents of either class
        for votes, count in patterns:
            p = posterior(prior, accuracy, votes)
            good, total = good + p * count, total + count
            for own, v in zip(sums, votes, strict=True):
                if v:
                    own[0] += count * p * (v > 0)
                    own[1] += count * p
                    own[2] += count * (1 - p) * (v < 0)
                    own[3] += count * (1 - p)
        prior = min(max(good / total, 0.05), 0.95)
        accuracy = [(min(max(a / b, LEAST), MOST), min(max(c / d, 1 - MOST), MOST)) for a, b, c, d in sums]
    return prior, accuracy


def weights(accuracy: tuple[float, float]) -> tuple[float, float]:
    """What a vote of 1, and one of -1, adds to the log odds."""
    on_good, on_bad = accuracy
    return math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)


def posterior(prior: float, accuracy: list[tuple[float, float]], votes: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(weights(a)[v < 0] for v, a in zip(votes, accuracy, strict=True) if v)
    return 1 / (1 + math.exp(-odds))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, carry: list[str] = (), threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """``features`` with a vote column ``vote_<rule>`` each, ``probability``, ``base_failed`` and ``kept``.

    The estimate is over all documents that aren't base_failed: the verdict on those stands. One row per input row; null and empty texts have no words and fail. ``base_failed``: under 50 words, or more than half
    of them in repeated windows. ``kept``: not base_failed, and a probability of at least ``threshold``. No rows: no rows.
    """
    names = list(rules())
    seen = settle(features(docs, id_col, text_col, carry).withColumns({f"vote_{k}": v for k, v in rules().items()}))
    votes = [f"vote_{k}" for k in names]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = seen.filter(~failed).groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** len(rules()) rows
    prior, accuracy = estimate([(tuple(r[v] for v in votes), r["n"]) for r in counted], len(votes), rounds)
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, a in zip(votes, accuracy, strict=True):
        odds = odds + F.when(F.col(v) > 0, weights(a)[0]).when(F.col(v) < 0, weights(a)[1]).otherwise(0.0)
    seen = seen.withColumn("probability", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return seen.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))


def drop_poor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` whose text is kept; columns as they are. A row goes by its own text, so rows that share an id may
    fare differently; no rows give none.

    Each row is carried along with its votes, so no text is shuffled; it is written once, where the votes are settled.
    """
    whole = F.struct(*docs.columns).alias("__row")
    return judged(docs.withColumn("__row", whole), id_col, text_col, carry=["__row"], **more).filter("kept").select("__row.*")
