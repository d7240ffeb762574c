"""Checks over package-registry entries.

An entry row holds ``seq, name, url, description, author, version, stars`` and,
where the registry offers them, ``readme``, ``scripts``, ``repository``,
``requires``, ``maintainer`` and ``long_description``. Every check looks at one
entry, so scanning a registry is a single projection over its dump.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions import rules as R
from wardline.functions import text as X
from wardline.operators.scan import verdict
from wardline.plans.shape import pick, unnest
from wardline.schemas import FINDINGS_TYPE


def content_findings(text: Column) -> Column:
    return R.first_match_hits(text, C.CONTENT_RULES)


def typosquat_findings(name: Column, fragments: Sequence[str] = C.TYPOSQUAT_FRAGMENTS) -> Column:
    hits = F.filter(X.literals(fragments), lambda f: F.lower(name).contains(f))
    return F.transform(
        hits,
        lambda f: R.finding(
            C.CRITICAL,
            F.concat(F.lit("Name contains typosquatting indicator: "), f),
            "typosquatting",
            "pattern_match",
            name,
        ),
    ).cast(FINDINGS_TYPE)


def auth_findings(description: Column) -> Column:
    """The first phrase, in catalogue order, that says there is no authentication."""
    low = F.lower(description)
    phrase = F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in C.NO_AUTH_PHRASES])
    hit = R.finding(C.HIGH, "Server may lack authentication", "missing_authentication", "pattern_match", phrase)
    return R.collect(F.when(phrase.isNotNull(), hit))


def advisory_findings(version: Column, advisories: dict[str, str] | None = None) -> Column:
    """Exact version match against a small advisory catalogue."""
    known = C.VULNERABLE_SDK if advisories is None else advisories
    plain = X.strip(version)
    hits = []
    for bad, text in known.items():
        found = R.finding(
            C.CRITICAL,
            f"Uses vulnerable SDK version {bad}: {text}",
            "vulnerable_dependency",
            "version_check",
            f"version={bad}",
        )
        hits.append(F.when(plain == bad, found))
    return R.collect(*hits)


def blocklist_findings(name: Column, blocked: Sequence[str]) -> Column:
    message = F.concat(F.lit("Package '"), name, F.lit("' is in the known-malicious list"))
    hit = R.finding(C.CRITICAL, message, "known_malicious", "blocklist_match", name)
    return R.collect(F.when(F.lower(name).isin(*blocked), hit))


def script_findings(scripts: Column) -> Column:
    """Lifecycle-script rules over the ``name: command`` lines joined by blanks."""
    lines = F.transform(F.map_entries(scripts), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    joined = F.coalesce(F.array_join(lines, " "), F.lit(""))
    return R.first_match_hits(joined, C.SCRIPT_RULES, "script_analysis")


def _squash(text: Column) -> Column:
    return F.translate(F.lower(text), "-_", "")


def dependency_findings(requires: Column, names: Sequence[str] = C.SUSPICIOUS_DEPENDENCIES) -> Column:
    """One finding per requirement and suspicious name it contains."""
    plain = X.literals([n.lower().replace("-", "").replace("_", "") for n in names])

    def check(requirement: Column) -> Column:
        first = F.get(F.split(X.strip(requirement), r"\s+"), F.lit(0))
        hits = F.filter(plain, lambda n: _squash(first).contains(n))
        message = F.concat(F.lit("Suspicious dependency: "), first)
        return F.transform(
            hits,
            lambda n: R.finding(C.CRITICAL, message, "malicious_dependency", "dependency_check", requirement),
        )

    found = F.flatten(F.transform(requires, check)).cast(FINDINGS_TYPE)
    return F.coalesce(found, R.none())


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def repository_findings(repository: Column) -> Column:
    hit = R.finding(
        C.LOW, "Package has no linked source repository", "missing_provenance", "metadata_check", "repository=None"
    )
    return R.collect(F.when(_blank(repository), hit))


def author_findings(author: Column, maintainer: Column) -> Column:
    hit = R.finding(
        C.MEDIUM,
        "Package has no declared author or maintainer",
        "missing_provenance",
        "metadata_check",
        "author=None, maintainer=None",
    )
    return R.collect(F.when(_blank(author) & _blank(maintainer), hit))


def _scanned(entries: DataFrame, prefix: str, *findings: Column) -> DataFrame:
    rows = entries.select(
        "seq", "name", F.concat(F.lit(f"{prefix}:"), F.col("name")).alias("skill_name"), F.concat(*findings).alias("findings")
    )
    return rows.withColumns(verdict(rows["findings"]))


def scan_mcp(entries: DataFrame) -> DataFrame:
    """Server entries: name, authentication, SDK version, README and description."""
    return _scanned(
        entries,
        "mcp",
        typosquat_findings(F.col("name")),
        auth_findings(F.col("description")),
        advisory_findings(F.col("version")),
        content_findings(F.coalesce("readme", F.lit(""))),
        content_findings(F.col("description")),
    )


def scan_npm(entries: DataFrame) -> DataFrame:
    """npm entries: blocklist, name, lifecycle scripts, repository and description.

    Entries without ``has_metadata`` skip the checks that need it.
    """
    return _scanned(
        entries,
        "npm",
        blocklist_findings(F.col("name"), C.NPM_BLOCKLIST),
        typosquat_findings(F.col("name")),
        F.when(F.col("has_metadata"), script_findings(F.col("scripts"))).otherwise(R.none()),
        F.when(F.col("has_metadata"), repository_findings(F.col("repository"))).otherwise(R.none()),
        content_findings(F.col("description")),
    )


def scan_pypi(entries: DataFrame, long_description_chars: int | None = None) -> DataFrame:
    """PyPI entries: blocklist, name, requirements, author and both descriptions.

    The long description is read whole; pass ``long_description_chars`` to look
    only at its beginning.
    """
    text = F.coalesce("long_description", F.lit(""))
    if long_description_chars is not None:
        text = F.substring(text, 1, long_description_chars)
    return _scanned(
        entries,
        "pypi",
        blocklist_findings(F.col("name"), C.PYPI_BLOCKLIST),
        typosquat_findings(F.col("name")),
        F.when(F.col("has_metadata"), dependency_findings(F.col("requires"))).otherwise(R.none()),
        F.when(F.col("has_metadata"), author_findings(F.col("author"), F.col("maintainer"))).otherwise(R.none()),
        F.when(F.col("has_metadata"), content_findings(text)).otherwise(R.none()),
        content_findings(F.col("description")),
    )


def findings_long(scanned: DataFrame) -> DataFrame:
    return unnest(scanned, "findings", ["seq", "skill_name"])


def detect(entries: DataFrame, findings: Column) -> DataFrame:
    """Long table of one registry check."""
    return unnest(entries.select("seq", "name", findings.alias("findings")), "findings", ["seq", "name"])


def stats(scanned: DataFrame, registry: str) -> DataFrame:
    """Totals of one registry scan; entries that could not be scanned have NULL findings."""
    done = F.col("findings").isNotNull()
    critical = F.size(F.filter("findings", lambda f: f["severity"] == C.CRITICAL))
    return scanned.agg(
        F.lit(registry).alias("registry"),
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(done).alias("scanned"),
        F.count_if(done & F.col("is_safe")).alias("safe"),
        F.count_if(done & ~F.col("is_safe")).alias("unsafe"),
        F.sum(F.when(done, critical).otherwise(0)).alias("critical_findings"),
    )


def search(entries: DataFrame, keyword: str = "", limit: int | None = None) -> DataFrame:
    """Entries holding a keyword in name, description or author.

    All entries are looked at; with a ``limit`` the first ones by ``seq`` are
    returned: top-k per task, never a global sort.
    """
    pool = entries
    if keyword:
        haystack = F.lower(F.concat_ws(" ", "name", "description", "author"))
        pool = pool.where(haystack.contains(keyword.lower()))
    return pool if limit is None else pool.orderBy("seq").limit(limit)


def merge_searches(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits of several keywords (``keyword_rank``, ``seq``) with the first row of each name."""
    unique = pick(hits, ["name"], ["keyword_rank", "seq"], last=False)
    return unique if limit is None else unique.orderBy("keyword_rank", "seq").limit(limit)


def keyword_hits(entries: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Every entry once per keyword it holds, in one pass over the entries."""
    haystack = F.lower(F.concat_ws(" ", "name", "description", "author"))
    ranks = F.array_compact(
        F.array(*[F.when(haystack.contains(k.lower()), F.lit(i)) for i, k in enumerate(keywords)])
    )
    return entries.select("*", F.explode_outer(ranks).alias("keyword_rank")).where(F.col("keyword_rank").isNotNull())


def readme_key(url: Column) -> Column:
    """``owner/repo`` of a GitHub URL, NULL for anything else: the join key of landed READMEs."""
    pattern = r"^https?://github\.com/([^/]+)/([^/]+)"
    key = F.concat_ws("/", F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2))
    return F.when(url.rlike(pattern), key)


def with_readme(entries: DataFrame, readmes: DataFrame) -> DataFrame:
    """Attach landed README texts (``readme_key, readme``) to entries."""
    keyed = entries.withColumn("readme_key", readme_key(F.col("url")))
    return keyed.join(readmes, "readme_key", "left").drop("readme_key")
