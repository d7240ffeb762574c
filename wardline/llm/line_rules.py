"""Line-first cleaning: rules per line, then a verdict on what is left of the document.

Lines that look like navigation, boilerplate, symbol noise, shouting or word lists without
punctuation are removed. A document goes if it fails the base rules (too short, or mostly
repeated word windows) or if the removed lines held too much of its text. Everything is
one projection of array functions over the text: no shuffle, no Python.

Windows of three words are compared by a 64-bit hash.

Defined results: null, empty and blank texts have no words and no lines, all measures 0,
and fail the base rules; repeated rows get the same result. A column named like an added
one gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
BLANKS = r"[\x20\x09-\x0D]+"
VISIBLE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_LOST_PERCENT = 40
BOILERPLATE = (
    r"(?i)(accept (all )?cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved"
    r"|click here|sign up (now|today)|subscribe to our|enable javascript|log in to|back to top|skip to content"
    r"|licensed under|released under)"
)
#: A phrase fails a line only where it makes up a tenth of it: not an article stored as one line.
PHRASE_SHARE = 10
#: Signs that end or part sentences, in the scripts that have their own.
PUNCTUATION = (
    r"[.!?,;:\x{2026}\x{3001}\x{3002}\x{FF01}\x{FF0C}\x{FF0E}\x{FF1A}\x{FF1B}\x{FF1F}\x{FF61}\x{0964}\x{0965}\x{060C}\x{061B}"
    r"\x{061F}\x{06D4}\x{0589}\x{055C}\x{055D}\x{055E}\x{037E}\x{0387}\x{1362}\x{1363}\x{1364}\x{1367}\x{104A}\x{104B}\x{17D4}"
    r"\x{17D5}\x{0F0D}\x{0F0E}\x{1803}\x{1809}\x{0700}\x{0701}\x{0702}]"
)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three that occurs at least twice in the text."""

    def within(hashes: Column) -> Column:
        size = F.size(hashes) - 2
        pairs = F.zip_with(F.slice(hashes, F.lit(1), size), F.slice(hashes, F.lit(2), size), lambda a, b: F.xxhash64(a, b))
        windows = F.zip_with(pairs, F.slice(hashes, F.lit(3), size), lambda a, b: F.xxhash64(a, b))
        counted = _with(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
        return F.when(size > 1, counted).otherwise(0)

    def covered(windows: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(windows) - 1)
        pairs = F.zip_with(windows, places, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return _with(F.sort_array(pairs), lambda s: spread(repeated(s)))

    def repeated(ordered: Column) -> Column:
        none = F.array(F.lit(None).cast("struct<w:bigint,i:int>"))
        earlier = F.concat(none, F.slice(ordered, F.lit(1), F.size(ordered) - 1))
        later = F.slice(ordered, F.lit(2), F.size(ordered) - 1)
        after = F.zip_with(ordered, later, lambda a, b: F.struct(a.alias("a"), (a["w"] == b["w"]).alias("same")))
        both = F.zip_with(
            after,
            earlier,
            lambda x, b: F.when(F.coalesce(x["same"], F.lit(False)) | F.coalesce(x["a"]["w"] == b["w"], F.lit(False)), x["a"]["i"]),
        )
        return F.sort_array(F.array_compact(both))

    def spread(places: Column) -> Column:
        return _with(
            places,
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
                F.lit(0),
                lambda total, n: total + n,
            ),
        )

    return _with(F.transform(words, lambda w: F.xxhash64(w)), within)


def line_fails(line: Column) -> Column:
    """Whether a line is navigation, boilerplate, noise, shouting or a list without punctuation."""
    gaps, bars, bangs = _count(line, " "), _count(line, "|"), _count(line, "!")
    navigation = (bars >= 2) & (bars * 4 >= gaps)
    noise = _count(line, "#*$%&<>") * 10 > F.length(line)
    shouting = (bangs >= 6) & (bangs * 2 > gaps)
    unpunctuated = (gaps >= 10) & ~line.rlike(PUNCTUATION)
    boilerplate = F.length(F.regexp_extract(line, BOILERPLATE, 0)) * PHRASE_SHARE >= F.length(line)
    return navigation | noise | shouting | unpunctuated | boilerplate


def clean(df: DataFrame, text: str = "text", most_lost_percent: int = MOST_LOST_PERCENT) -> DataFrame:
    """Adds the base measures, ``cleaned``, ``n_lost_chars`` and ``kept``; all rows stay."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, BLANKS), "")
    lines = F.filter(F.split(whole, r"\n", -1), lambda x: x.rlike(VISIBLE))
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails")))

    def chars(marked: Column, lost: bool) -> Column:
        return F.aggregate(
            marked, F.lit(0).cast("long"), lambda n, x: n + F.when(x["fails"] | F.lit(not lost), F.length(x["line"])).otherwise(0)
        )

    line_facts = _with(
        judged,
        lambda m: F.struct(
            F.size(m).cast("long").alias("n"),
            F.size(F.array_distinct(F.transform(m, lambda x: x["line"]))).cast("long").alias("distinct"),
            chars(m, lost=False).alias("chars"),
            chars(m, lost=True).alias("lost"),
            F.array_join(F.transform(F.filter(m, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned"),
        ),
    )
    word_facts = _with(
        words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated"))
    )
    added = {
        "n_words": F.col("_words.n"),
        "word_chars": F.length(F.translate(whole, SPACES, "")).cast("long"),
        "n_symbols": _count(whole, SYMBOLS).cast("long"),
        "n_dup_lines": F.col("_lines.n") - F.col("_lines.distinct"),
        "n_repeat_words": F.col("_words.repeated"),
        "n_lost_chars": F.col("_lines.lost"),
        "cleaned": F.col("_lines.cleaned"),
    }
    facts = df.withColumns({"_words": word_facts, "_lines": line_facts}).withColumns(added)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    lost = 100 * F.col("n_lost_chars") > most_lost_percent * F.col("_lines.chars")
    return facts.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost).drop("_words", "_lines")
