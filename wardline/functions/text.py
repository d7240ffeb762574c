"""Text extraction as Column expressions: whole text in, array of strings out.

All functions stay in the JVM and look at the whole text. Each one walks the
text once: a pattern with several alternatives is matched as a whole and the
wanted name is cut out of the (short) matches afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import catalog as C

# What str.strip() and str.splitlines() treat as blanks and line ends.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def rx(pattern: str, flags: str = "") -> str:
    """Java form of a rule pattern: only ``\\n`` ends a line, classes are Unicode."""
    return f"(?dU{flags}){pattern}"


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    """True where the pattern occurs anywhere in the text."""
    return text.rlike(rx(pattern, flags))


def find_all(text: Column, pattern: str, group: int = 0, flags: str = "", leads: Sequence[str] = ()) -> Column:
    """All matches of one group, in text order, repeats kept.

    ``leads`` are fixed texts of which every match holds one: a text without any is not searched.
    """
    found = F.regexp_extract_all(text, F.lit(rx(pattern, flags)), F.lit(group))
    if leads:
        found = F.when(any_of(text, leads), found)
    return F.coalesce(found, F.array().cast("array<string>"))


def any_of(text: Column, parts: Sequence[str]) -> Column:
    """Any of some fixed texts; as patterns they are looked for in leaps, many bytes at a time."""
    return reduce(Column.__or__, [text.rlike(re.escape(p)) for p in parts])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def literals(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clip(text: Column, limit: int) -> Column:
    """Display form: at most ``limit`` characters, ending in an ellipsis when cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


# --- URLs ---------------------------------------------------------------------


def urls(text: Column) -> Column:
    return find_all(text, C.URL, leads=("http",))


def urls_in_code(text: Column) -> Column:
    return find_all(text, C.URL_IN_CODE, leads=("http",))


def url_host(url: Column) -> Column:
    """Lower-case host without user part or port; empty when there is none."""
    return F.lower(F.regexp_extract(url, C.URL_HOST, 1))


_SAFE_HOST = "|".join(
    [
        "^(?:" + "|".join(re.escape(h) for h in C.SAFE_HOSTS) + ")$",
        "(?:" + "|".join(re.escape(h) for h in C.SAFE_HOST_SUFFIXES) + ")$",
        "^" + re.escape(C.SAFE_HOST_PREFIX),
    ]
)


def is_safe_url(url: Column) -> Column:
    """Trusted host, a subdomain of one, or a ``docs.`` host; one test, so the host is cut out once."""
    return url_host(url).rlike(_SAFE_HOST)


# --- environment variables ----------------------------------------------------


# A name can be written in several ways. Only the set of names matters, so each
# way is a scan of its own, and scans with a fixed lead-in run only on texts
# that hold the lead-in: far cheaper than one alternation tried at every letter.


def _env_names(text: Column, *scans: tuple[str, str]) -> Column:
    empty = F.array().cast("array<string>")
    found = [
        find_all(text, pattern) if lead == "" else F.when(text.contains(lead), find_all(text, pattern)).otherwise(empty)
        for lead, pattern in scans
    ]
    # Lead-ins hold no upper-case letters: the first upper-case run is the name.
    return sorted_set(F.transform(F.concat(*found), lambda m: F.regexp_extract(m, C.ENV_NAME, 0)))


_DOLLAR = ("$", C.ENV_DOLLAR)
_PYTHON = ("os.", C.ENV_PYTHON_CALL)


def env_in_prose(text: Column) -> Column:
    return _env_names(text, _DOLLAR, _PYTHON, ("export", C.ENV_EXPORT), ("", C.ENV_BARE))


def env_in_manifest(text: Column) -> Column:
    return _env_names(text, _DOLLAR, ("", C.ENV_BARE_MANIFEST))


def env_in_python(text: Column) -> Column:
    return _env_names(text, _DOLLAR, _PYTHON)


def env_in_js(text: Column) -> Column:
    return sorted_set(
        F.concat(*[find_all(text, p, 1, leads=("process.env",)) for p in (C.ENV_JS_DOT, C.ENV_JS_BRACKET)])
    )


def env_in_chatflow(text: Column) -> Column:
    return sorted_set(find_all(text, C.ENV_JS_UPPER, 1))


def env_secret_refs(text: Column) -> Column:
    """Python references plus ``Secret.from_env_var("X")`` and ``"env:X"`` strings."""
    refs = F.concat(
        find_all(text, C.ENV_SECRET_CALL, 1, leads=("Secret.from_env_var",)),
        find_all(text, C.ENV_STRING_REF, 1, leads=("env:",)),
    )
    return sorted_set(F.concat(env_in_python(text), refs))


def is_sensitive_env(name: Column) -> Column:
    return matches(name, C.SENSITIVE_ENV, "i")


def is_sensitive_code_env(name: Column) -> Column:
    return matches(name, C.SENSITIVE_CODE_ENV, "i")


# --- fenced code and shell text -----------------------------------------------


def fences(text: Column) -> Column:
    """Fenced blocks as structs of tag and body, from a single pass over the text."""

    def cut(block: Column) -> Column:
        head = F.instr(block, "\n")
        return F.struct(
            F.substring(block, F.lit(4), head - 4).alias("tag"),
            F.substring(block, head + 1, F.length(block) - head - 3).alias("body"),
        )

    return F.transform(find_all(text, C.FENCE, 0, "s"), cut)


def code_blocks(fence: Column) -> Column:
    return F.transform(fence, lambda b: b["body"])


def shell_lines(fence: Column) -> Column:
    """Trimmed command lines of shell or untagged fences, comments dropped."""
    shell = F.filter(fence, lambda b: F.lower(b["tag"]).isin(*C.SHELL_TAGS))
    lines = F.flatten(F.transform(shell, lambda b: F.split(b["body"], LINE_END)))
    trimmed = F.transform(lines, strip)
    return F.filter(trimmed, lambda line: (line != "") & ~line.startswith("#"))


def shell_call_strings(text: Column) -> Column:
    return find_all(text, C.SHELL_CALL, 1, leads=("subprocess.", "os.system", "os.popen"))


def shell_verb_lines(text: Column, stop_at_quotes: bool = False) -> Column:
    return find_all(text, C.SHELL_VERB_QUOTED if stop_at_quotes else C.SHELL_VERB_LINE)


def js_exec_strings(text: Column) -> Column:
    return find_all(text, C.JS_EXEC_LITERAL, 1)


def js_exec_markers(text: Column, markers: Iterable[str] = C.JS_EXEC_MARKERS) -> Column:
    """Pattern text of every process-start marker present in the code."""
    return F.array_compact(F.array(*[F.when(matches(text, m), F.lit(m)) for m in markers]))


# --- imports and references ---------------------------------------------------


def python_imports(text: Column) -> Column:
    """Top-level modules named on ``import`` and ``from`` lines, distinct and sorted."""
    likely = F.filter(F.split(text, LINE_END), lambda line: line.contains("import ") | line.contains("from "))
    lines = F.transform(likely, strip)
    wanted = F.filter(lines, lambda line: line.startswith("import ") | line.startswith("from "))
    # "import a.b as c, d" names two modules, "from a import b, c" one
    listed = F.flatten(
        F.transform(
            wanted,
            lambda line: F.when(line.startswith("from "), F.array(line.substr(F.lit(6), F.length(line)))).otherwise(
                F.split(line.substr(F.lit(8), F.length(line)), ",")
            ),
        )
    )
    return sorted_set(F.transform(listed, lambda part: F.regexp_extract(strip(part), rx(r"^[^\s.;]*"), 0)))


def js_requires(text: Column) -> Column:
    return sorted_set(find_all(text, C.JS_REQUIRE, 1))


def npm_packages(args: Column) -> Column:
    """Scoped package names among command arguments."""
    return F.filter(args, lambda a: a.startswith("@") & a.contains("/"))


def action_refs(text: Column) -> Column:
    actions = F.transform(find_all(text, C.ACTION_REF, 1, leads=("Action.",)), lambda n: F.concat(F.lit("action:"), n))
    apps = F.transform(find_all(text, C.APP_REF, 1, leads=("App.",)), lambda n: F.concat(F.lit("app:"), n))
    return sorted_set(F.concat(actions, apps))


# --- frontmatter, hashes, hidden runs ------------------------------------------


def frontmatter_block(text: Column) -> Column:
    return F.regexp_extract(text, rx(r"^---\s*\n(.*?)\n---\s*\n", "s"), 1)


def frontmatter_field(block: Column, field: str) -> Column:
    """Value of a flat top-level key, quotes removed; NULL when the key is absent."""
    value = strip(F.regexp_extract(block, rx(rf"^{field}[ \t]*:[ \t]+([^\n]*)$", "m"), 1))
    bare = F.regexp_replace(value, r"^(['\"])(.*)\1$", "$2")
    return F.when(value != "", bare)


def integrity(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def hidden_run(text: Column) -> Column:
    """Characters between the first two byte-order marks; NULL when there are not two."""
    first = F.instr(text, C.HIDDEN_MARK)
    second = F.instr(F.substr(text, first + 1), C.HIDDEN_MARK)
    return F.when((first > 0) & (second > 0), F.substr(text, first + 1, second - 1))


def hidden_text(text: Column) -> Column:
    """Message spelled by the hidden run: eight marks per character, zero-width space is 0."""
    bits = F.regexp_replace(F.regexp_replace(hidden_run(text), f"[^{C.HIDDEN_ZERO}]", "1"), C.HIDDEN_ZERO, "0")
    whole = F.floor(F.length(bits) / 8).cast("int")
    codes = F.transform(
        F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))),
        lambda i: F.conv(F.substr(bits, i * 8 + 1, F.lit(8)), 2, 10).cast("int"),
    )
    letters = F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE"))
    return F.when(bits.isNull() | (whole < 1), F.lit("")).otherwise(F.array_join(letters, ""))
