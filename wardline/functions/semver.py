"""Semantic versions and constraints as Column expressions.

A version parses to ``struct<major, minor, patch>`` (pre-release and build tags
do not take part in ordering). An unreadable version parses to NULL so callers
can set it aside instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import strip

_NUMBER = r"(?:0|[1-9][0-9]*)"
_TAGS = r"(?:-[0-9A-Za-z\-.]+)?(?:\+[0-9A-Za-z\-.]+)?"
_CORE = rf"({_NUMBER}\.{_NUMBER}\.{_NUMBER}){_TAGS}"
VERSION = rf"^{_CORE}$"
ATOM = rf"^(==|!=|>=|<=|>|<|\^|~)\s*{_CORE}$"


def _triple(text: Column, pattern: str, group: int) -> Column:
    # One regular expression per text; the rest is a split of a short string.
    core = F.regexp_extract(text, pattern, group)
    numbers = F.split(core, r"\.")
    part = [
        F.get(numbers, F.lit(i)).try_cast("bigint").alias(name) for i, name in enumerate(("major", "minor", "patch"))
    ]
    return F.when(core != "", F.struct(*part))


def parse_version(text: Column) -> Column:
    """``struct<major, minor, patch>`` or NULL; struct comparison orders versions."""
    return _triple(strip(text), VERSION, 1)


def parse_constraint(raw: Column) -> Column:
    """``struct<any_version, valid, atoms>``; parse once per distinct constraint text."""
    text = strip(raw)
    pieces = F.filter(F.transform(F.split(text, ","), strip), lambda a: a != "")
    atoms = F.transform(
        pieces,
        lambda a: F.struct(F.regexp_extract(a, ATOM, 1).alias("op"), _triple(a, ATOM, 2).alias("target")),
    )
    wildcard = text == "*"
    return F.struct(
        wildcard.alias("any_version"),
        (wildcard | F.forall(pieces, lambda a: a.rlike(ATOM))).alias("valid"),
        F.when(wildcard, F.array().cast("array<struct<op:string,target:struct<major:bigint,minor:bigint,patch:bigint>>>"))
        .otherwise(atoms)
        .alias("atoms"),
    )


def satisfies(version: Column, constraint: Column) -> Column:
    """True when a parsed version meets every atom of a parsed constraint."""

    def holds(atom: Column) -> Column:
        op, want = atom["op"], atom["target"]
        same_major = version["major"] == want["major"]
        same_minor = same_major & (version["minor"] == want["minor"])
        return (
            F.when(op == "==", version == want)
            .when(op == "!=", version != want)
            .when(op == ">=", version >= want)
            .when(op == "<=", version <= want)
            .when(op == ">", version > want)
            .when(op == "<", version < want)
            .when(op == "~", same_minor & (version >= want))
            .when((op == "^") & (want["major"] == 0), same_minor & (version >= want))
            .when(op == "^", same_major & (version >= want))
            .otherwise(False)
        )

    fits = version.isNotNull() & constraint["valid"] & F.forall(constraint["atoms"], holds)
    return F.coalesce(constraint["any_version"] | fits, F.lit(False))


_TRIPLE = "struct<major:bigint,minor:bigint,patch:bigint>"
_KEY = f"struct<beyond:int,version:{_TRIPLE}>"


def sort_key(version: Column) -> Column:
    """Place of a parsed version in an order that also has a place below and beyond all versions."""
    return F.struct(F.lit(0).alias("beyond"), version.alias("version"))


def _moved(version: Column, part: str) -> Column:
    """The first version after all that share the parts up to ``part``; there is always one below it."""
    zero, more = F.lit(0).cast("bigint"), F.try_add(version[part], F.lit(1).cast("bigint"))
    parts = {
        "major": (more, zero, zero),
        "minor": (version["major"], more, zero),
        "patch": (version["major"], version["minor"], more),
    }[part]
    return F.struct(*[c.alias(n) for c, n in zip(parts, ("major", "minor", "patch"))])


def spans(constraint: Column) -> Column:
    """Stretches of the version order that a parsed constraint admits: ``array<struct<low, high>>``.

    ``low`` belongs to a stretch and ``high`` does not; both are sort keys. Atoms meet in one
    stretch, which every excluded version inside parts in two. An unreadable or unmeetable
    constraint has none. Agrees with :func:`satisfies` on every version.
    """
    lowest = F.struct(F.lit(0).alias("beyond"), F.lit(None).cast(_TRIPLE).alias("version"))
    highest = F.struct(F.lit(1).alias("beyond"), F.lit(None).cast(_TRIPLE).alias("version"))
    atoms = constraint["atoms"]

    def low(atom: Column) -> Column:
        op, want = atom["op"], atom["target"]
        exact = F.when(op.isin("==", ">=", "^", "~"), sort_key(want))
        return exact.when(op == ">", sort_key(_moved(want, "patch"))).otherwise(lowest)

    def high(atom: Column) -> Column:
        op, want = atom["op"], atom["target"]
        after = F.when(op.isin("==", "<="), _moved(want, "patch")).when(op == "<", want)
        after = after.when((op == "~") | ((op == "^") & (want["major"] == 0)), _moved(want, "minor"))
        after = after.when(op == "^", _moved(want, "major"))
        return F.when(after.isNull(), highest).otherwise(sort_key(after))

    first = F.array_max(F.concat(F.array(lowest), F.transform(atoms, low)))
    last = F.array_min(F.concat(F.array(highest), F.transform(atoms, high)))
    excluded = F.filter(atoms, lambda a: a["op"] == "!=")
    holes = F.array_sort(F.array_distinct(F.transform(excluded, lambda a: a["target"])))
    lows = F.concat(F.array(first), F.transform(holes, lambda v: F.greatest(first, sort_key(_moved(v, "patch")))))
    highs = F.concat(F.transform(holes, lambda v: F.least(last, sort_key(v))), F.array(last))
    pieces = F.filter(F.arrays_zip(lows.alias("low"), highs.alias("high")), lambda s: s["low"] < s["high"])
    return F.when(constraint["valid"], pieces).otherwise(F.array().cast(f"array<struct<low:{_KEY},high:{_KEY}>>"))
