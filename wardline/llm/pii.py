"""Personal data: fixed patterns, extended by bootstrapped contextual extraction.

The fixed patterns find e-mail addresses, IP addresses, card and phone numbers in every
whole text, with code-point offsets. These seeds induce lexical patterns: the word, or the
two words, that stand before them. Pattern and instance scores are then computed in turn
over the pattern-instance graph. A pattern's score is the weight of its known instances
among all its instances and all uses of its words, in all texts, that stand before no
identifier, so that common words never become patterns while a label beside other labels
does; an instance's score joins those of its patterns. Tokens of the right shape that score
high in the end are added as spans of the pattern's kind.

All of it is DataFrame expressions: texts are read twice, for occurrences and for the uses
of the patterns found; only occurrences are shuffled, and counts are combined before the
shuffle.

Defined results: a null text counts as empty and has no spans; spans of one kind never
overlap each other, spans of different kinds may; repeated rows get the same spans; added
columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.plans.stages import Stages

KINDS = ("email", "ip", "card", "phone")
#: The patterns to find. Guards and possessive repeats keep them linear in
#: the text without changing what matches; a match may begin where the last one ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no valid match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_TOKEN = "[A-Za-z0-9@._%+-]"
CANDIDATE = rf"(?<!{_TOKEN})(?:[A-Za-z@._%+-]*+[0-9]|[A-Za-z._%+-]++@){_TOKEN}*+"
#: Runs of digits in pieces joined by brackets, dots, hyphens and single blanks. A piece of
#: seven digits or more ends its run, as a blank after it may part two numbers. A piece that
#: goes on in letters joins no run; alone it is matched with them, to be dropped whole.
_PIECE = r"\(?[0-9]++(?:[().-]{1,2}[0-9]++)*+"
_SHORT = r"\(?[0-9](?:[().-]{0,2}[0-9]){0,5}+\)?(?:\x20|\x20?-\x20)"
_MORE = r"[()._%+@-]{0,2}[A-Za-z0-9]"
RUN = rf"(?<!{_TOKEN})[._%+@-]*+(?:{_SHORT}(?={_PIECE}(?!{_MORE})))*+{_PIECE}(?:{_MORE})?+"
#: Shapes that a token must have to be taken for a kind, and digits that a run must have.
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[A-Za-z0-9.-]*$",
    "ip": r"^[0-9]{1,4}(\.[0-9]{1,4}){3,5}$",
}
DIGITS = {"card": (12, 19), "phone": (7, 15)}
_ONLY_RUN = r"^[0-9().\x20-]+$"
CONTEXT_CHARS = 120
ROUNDS = 3
LEAST_SEEDS = 5
LEAST_PATTERN = 0.6
LEAST_INSTANCE = 0.8
BLOCK = 512
_NO_SPANS = "array<struct<k:int,s:int,e:int,v:string,l:string,first:boolean>>"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums_before(lengths: Column) -> Column:
    """For each element of an int array the sum of those before it, in blocks to stay linear."""

    def local(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("o"))
        return F.aggregate(
            block,
            start,
            lambda a, x: F.struct((a["t"] + x).alias("t"), F.concat(a["o"], F.array(a["t"])).alias("o")),
            lambda a: a["o"],
        )

    def whole(values: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
        return _with(F.transform(cuts, lambda i: F.slice(values, i, F.lit(BLOCK))), joined)

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, local(sums), lambda b, o: F.transform(local(b), lambda x: x + o)))

    return _with(lengths, whole)


def _spans(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Valid matches of a pattern with their code-point offsets, end exclusive, and the text before each.

    The text before a match begins where the last match of the pattern ended; ``first`` tells
    that it begins with the whole text.
    """

    def pieces(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        behind = F.zip_with(
            gaps,
            found,
            lambda gap, m: F.struct(
                F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("v"), F.right(gap, F.lit(CONTEXT_CHARS)).alias("l")
            ),
        )
        return F.slice(behind, F.lit(1), F.size(found))

    def placed(found: Column) -> Column:
        before = _sums_before(F.transform(found, lambda p: p["gap"] + p["size"]))
        return F.zip_with(found, before, span)

    def span(p: Column, b: Column) -> Column:
        start = b + p["gap"]
        first = (b == 0) & (p["gap"] <= CONTEXT_CHARS)
        return F.struct(
            F.lit(kind).alias("k"), start.alias("s"), (start + p["size"]).alias("e"), p["v"].alias("v"), p["l"].alias("l"), first.alias("first")
        )

    return F.filter(_with(_with(F.split(text, pattern, -1), pieces), placed), lambda x: valid(x["v"]))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _with(_digits(match), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by kind, then start."""
    none = F.array().cast(_NO_SPANS)
    parts = [
        F.when(text.rlike(NEEDS[kind]), _spans(text, PATTERNS[kind], i, lambda m, kind=kind: _valid(kind, m))).otherwise(none)
        for i, kind in enumerate(KINDS)
    ]
    return F.concat(*parts)


def candidates(text: Column, base: Column) -> Column:
    """Tokens and runs in the shape of a kind that no fixed pattern covers; ``k`` is that kind.

    What has the shape of several kinds is a candidate of each. The last piece of a run is a
    candidate beside the run, with the same end.
    """
    none = F.array().cast(_NO_SPANS)
    bracket = r"^[._%+@-]*\((?!.*\))"

    def trimmed(x: Column) -> Column:
        rest = F.regexp_replace(x["v"], rf"{bracket}|^[._%+@-]+", "")
        value = F.regexp_replace(rest, r"[._%+@-]+$", "")
        start = x["s"] + F.length(x["v"]) - F.length(rest)
        return F.struct(
            x["k"].alias("k"), start.alias("s"), (start + F.length(value)).alias("e"), value.alias("v"), x["l"].alias("l"), x["first"].alias("first")
        )

    def last_piece(x: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(x["v"], r"\x20(\S+)$", 1), bracket, "")
        left = F.concat(x["l"], F.left(x["v"], F.length(x["v"]) - F.length(value)))
        return F.struct(
            x["k"].alias("k"), (x["e"] - F.length(value)).alias("s"), x["e"].alias("e"), value.alias("v"),
            F.right(left, F.lit(CONTEXT_CHARS)).alias("l"), (x["first"] & (F.length(left) <= CONTEXT_CHARS)).alias("first"),
        )

    def of_kind(spans: Column, name: str, fits: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(spans, lambda x: fits(x["v"])), lambda x: x.withField("k", F.lit(KINDS.index(name))))

    def whole(x: Column) -> Column:
        address = (x["k"] == 0) & x["v"].rlike(PATTERNS["email"])
        return address | ((x["k"] == 1) & _valid("ip", x["v"]))

    def apart(x: Column) -> Column:
        return ~F.exists(base, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))

    def free(spans: Column) -> Column:
        return F.filter(spans, lambda x: F.when(whole(x), False).otherwise(apart(x)))

    def in_tokens(tokens: Column) -> Column:
        return F.concat(*[of_kind(tokens, name, lambda v, shape=shape: v.rlike(shape)) for name, shape in SHAPES.items()])

    def in_runs(runs: Column) -> Column:
        both = F.concat(runs, F.transform(F.filter(runs, lambda x: F.contains(x["v"], F.lit(" "))), last_piece))
        return _with(both, lambda r: F.concat(*[of_kind(r, n, lambda v, d=d: F.length(_digits(v)).between(*d)) for n, d in DIGITS.items()]))

    tokens = F.transform(_spans(text, CANDIDATE, -1, lambda m: F.lit(True)), trimmed)
    found = F.transform(_spans(text, RUN, -1, lambda m: F.length(_digits(m)) >= DIGITS["phone"][0]), trimmed)
    runs = F.filter(found, lambda x: x["v"].rlike(_ONLY_RUN))
    every = F.concat(free(_with(tokens, in_tokens)), free(_with(runs, in_runs)))
    return F.when(text.rlike(r"@|[0-9](?:[\x20().-]*+[0-9]){3}"), every).otherwise(none)


def _stands(left: Column, first: Column, words: int) -> Column:
    """Whether the last words of a left side are words of the whole text as well, not parts of longer ones."""
    last = r"\S++\s++" * words + "$"
    return left.rlike(r"\s" + last) | (first & left.rlike("^" + last))


def _contexts(spans: Column, seed: bool) -> Column:
    def around(x: Column) -> Column:
        left = F.lower(x["l"])
        return F.struct(
            x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lit(seed).alias("seed"),
            F.regexp_extract(left, r"(?<!\S)(\S++)\s*+$", 1).alias("one"),
            F.regexp_extract(left, r"(?<!\S)(\S++\s++\S++)\s*+$", 1).alias("two"),
            _stands(left, x["first"], 1).alias("apart_one"), _stands(left, x["first"], 2).alias("apart_two"),
        )

    return F.transform(spans, around)


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def occurrences(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, _key, its base spans and all occurrences with their contexts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = df.select("doc_id", text_key(text).alias("_key"), whole.alias("_text")).withColumn("_base", base_spans(F.col("_text")))
    both = base.withColumn("_free", candidates(F.col("_text"), F.col("_base")))
    seen = F.concat(_contexts(F.col("_base"), True), _contexts(F.col("_free"), False))
    return both.select("doc_id", "_key", "_base", seen.alias("_seen"))


def _patterns(one: Column, two: Column) -> tuple[Column, Column]:
    return F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), F.regexp_replace(two, r"\s+", " "))


def elsewhere_counts(df: DataFrame, found: DataFrame, graph: DataFrame, stages: Stages, text: str = "text") -> DataFrame:
    """How often, in all distinct texts, the words of a pattern stand before no seed or candidate.

    Only for patterns with instances enough to become good. Each of n copies of a text counts
    as its nth part.
    """
    able = stages.write(
        graph.groupBy("pattern", "word", "k").agg(F.count(F.lit(1)).alias("all"))
        .where(F.col("all") >= LEAST_SEEDS).select("pattern", "word").distinct()
    )
    copies = stages.write(found.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    # the empty one stands for no word before the first of a text
    split = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")
    pairs = F.zip_with(F.concat(F.array(F.lit("")), split), split, lambda p, w: F.struct(p.alias("p"), w.alias("w")))
    weighted = df.select(text_key(text).alias("_key"), pairs.alias("_pairs")).join(copies, "_key", "left")
    words = weighted.select(F.explode("_pairs").alias("x"), (1 / F.coalesce("n", F.lit(1))).alias("part")).select("x.*", "part")
    one, two = _patterns(F.col("w"), F.when(F.col("p") != "", F.concat_ws(" ", "p", "w")))
    used = (
        words.join(able.select(F.col("word").alias("w")).distinct(), "w", "left_semi")
        .select(F.explode(F.array(one, two)).alias("pattern"), "part")
        .join(able.select("pattern"), "pattern", "left_semi")
        .groupBy("pattern").agg(F.sum("part").alias("uses"))
    )
    before = found.select("_key", F.explode("_seen").alias("o")).select("_key", "o.*")
    one, two = _patterns(F.col("one"), F.col("two"))
    aligned = F.explode(F.array(F.when(F.col("apart_one"), one), F.when(F.col("apart_two"), two))).alias("pattern")
    taken = before.select("_key", "s", aligned).where(F.col("pattern").isNotNull()).join(able.select("pattern"), "pattern", "left_semi")
    own = taken.distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("own"))
    left = F.greatest(F.round(F.col("uses") - F.coalesce("own", F.lit(0)), 3), F.lit(0.0))
    return stages.write(used.join(own, "pattern", "left").select("pattern", left.alias("elsewhere")))


def bootstrap(df: DataFrame, found: DataFrame, stages: Stages, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Accepted (value, kind) pairs of unseen identifiers, from the documents and their table of occurrences."""
    each = found.select(F.explode("_seen").alias("o")).select("o.*")
    # distinct values per pattern: copies of a document add nothing
    graph = stages.write(
        each.select(
            F.explode(F.array(*_patterns(F.col("one"), F.col("two")))).alias("pattern"),
            F.col("one").alias("word"), F.col("k"), F.col("v"), F.col("seed"),
        )
        .where(F.length("pattern") > 2)
        .groupBy("pattern", "word", "k", "v").agg(F.max("seed").alias("seed"))
    )
    elsewhere = elsewhere_counts(df, found, graph, stages, text)
    instances = stages.write(graph.groupBy("k", "v").agg(F.max(F.col("seed").cast("double")).alias("score")))
    for _ in range(rounds):
        patterns = (
            graph.join(instances, ["k", "v"])
            .groupBy("pattern", "k")
            .agg(F.sum("score").alias("known"), F.count(F.lit(1)).alias("all"))
            .join(elsewhere, "pattern", "left")
        )
        worth = F.col("known") / (F.col("all") + F.coalesce("elsewhere", F.lit(0)))
        good = patterns.withColumn("worth", worth).where((F.col("known") >= LEAST_SEEDS) & (F.col("worth") >= LEAST_PATTERN))
        hits = graph.where(~F.col("seed")).join(good.select("pattern", "k", "worth"), ["pattern", "k"])
        score = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("worth"), F.lit(1e-6)))))
        scored = hits.groupBy("k", "v").agg(score.alias("new"))
        updated = instances.join(scored, ["k", "v"], "left").withColumn(
            "score", F.greatest("score", F.when(F.col("new") >= LEAST_INSTANCE, F.col("new")).otherwise(F.lit(0.0)))
        )
        instances = stages.write(updated.drop("new"))
    seeds = graph.where("seed").select("k", "v").distinct()
    return instances.where(F.col("score") >= LEAST_INSTANCE).select("k", "v").join(seeds, ["k", "v"], "left_anti")


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, _key, _base spans and _more spans (of unseen identifiers)."""
    stages = Stages(df.sparkSession, "pii")
    found = stages.write(occurrences(df, text))
    accepted = bootstrap(df, found, stages, text)
    each = found.select("doc_id", "_key", F.explode("_seen").alias("o")).where(~F.col("o.seed"))
    more = (
        each.select("doc_id", "_key", "o.k", "o.v", "o.s", "o.e")
        .join(accepted, ["k", "v"])
        # of a run and its last piece, the run
        .groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_text_key"), "k", "e")
        .agg(F.min("s").alias("s"))
        .groupBy("_id", "_text_key")
        .agg(F.collect_set(F.struct("k", "s", "e")).alias("_more"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text_key"))
    bare = F.transform("_base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    return found.join(more, same, "left").select("doc_id", "_key", bare.alias("_base"), F.coalesce("_more", none).alias("_more"))


def listing(spans: Column) -> Column:
    """Spans as kind:start:end, by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    shown = F.transform(
        F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    )
    return F.array_join(shown, ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans by the first one's."""
    found = find(df, text)
    some = (
        found.select(F.col("doc_id").alias("_id"), "_key", F.concat("_base", "_more").alias("_all"))
        .where(F.size("_all") > 0)
        .groupBy("_id", "_key")
        .agg(F.first("_all").alias("_all"))
    )
    keyed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_doc"), text_key(text).alias("_text_key"))
    same = F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col("_doc")[text]
    ordered = F.array_sort(F.transform("_all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(a: Column, x: Column) -> Column:
        fresh = x["s"] >= a["at"]
        piece = F.concat(a["out"], F.substr(body, a["at"] + 1, x["s"] - a["at"]), F.get(names, x["k"]))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(fresh, piece).otherwise(a["out"]).alias("out"))

    hidden = F.aggregate(ordered, start, cut, lambda a: F.concat(a["out"], F.substr(body, a["at"] + 1, F.length(body))))
    joined = keyed.join(some, same, "left")
    shown = F.when(F.col("_all").isNull(), body).otherwise(hidden)
    return joined.select(*[(shown if c == text else F.col("_doc")[c]).alias(c) for c in df.columns])
