"""Registration points for user parsers and user registries.

A parser is a function from a ``seq, path, content`` frame to skill rows; a
registry scanner is a function from entry rows to scanned rows. Both stay
declarative, so a plug-in is planned together with everything around it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from wardline.operators import registry
from wardline.operators.frameworks import skills_from_source
from wardline.schemas import as_skills
from wardline.sources.manifests import skills_from_claw, skills_from_crews, skills_from_plugins
from wardline.sources.mcp import skills_from_configs
from wardline.sources.skills import skills_from_markdown
from wardline.sources.workflows import skills_from_chatflows, skills_from_workflows

Parser = Callable[[DataFrame], DataFrame]


class Parsers:
    """Named parsers with the path pattern of the files each one reads."""

    def __init__(self) -> None:
        self._parsers: dict[str, tuple[str, Parser]] = {}

    def register(self, name: str, path_pattern: str, parser: Parser) -> None:
        self._parsers[name] = (path_pattern, parser)

    def names(self) -> list[str]:
        return list(self._parsers)

    def parse(self, files: DataFrame) -> DataFrame:
        """Union of what every parser finds; a file may yield rows from several."""
        parts = [as_skills(parser(files.where(files["path"].rlike(p)))) for p, parser in self._parsers.values()]
        return reduce(DataFrame.unionByName, parts)


def default_parsers() -> Parsers:
    parsers = Parsers()
    parsers.register("markdown", r"(^|/)\.claude/skills/[^/]*\.md$", skills_from_markdown)
    parsers.register("mcp", r"\.json$", skills_from_configs)
    parsers.register("n8n", r"\.json$", skills_from_workflows)
    parsers.register("flowise", r"\.json$", skills_from_chatflows)
    parsers.register("openclaw", r"(^|/)\.(claw|openclaw)/[^/]*\.ya?ml$", skills_from_claw)
    parsers.register("dify", r"\.(ya?ml|json)$", skills_from_plugins)
    parsers.register("crewai", r"(^|/)(crew|agents)\.ya?ml$", skills_from_crews)
    parsers.register("source", r"\.(py|ts|js|tsx|jsx)$", skills_from_source)
    return parsers


REGISTRIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "mcp": registry.scan_mcp,
    "npm": registry.scan_npm,
    "pypi": registry.scan_pypi,
}


def register_registry(name: str, scanner: Callable[[DataFrame], DataFrame]) -> None:
    REGISTRIES[name] = scanner


def scan_registry(name: str, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scanned entries of a registry and their totals."""
    scanned = REGISTRIES[name](entries)
    return scanned, registry.stats(scanned, name)
