"""Extraction against Python's own regular expressions on awkward texts."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions import text as X

ENV = re.compile(
    r"(?:\$\{?([A-Z][A-Z0-9_]{1,})\}?|os\.environ\[[\"']([A-Z][A-Z0-9_]{1,})[\"']\]"
    r"|os\.getenv\([\"']([A-Z][A-Z0-9_]{1,})[\"']\)|export\s+([A-Z][A-Z0-9_]{1,})"
    r"|(?:^|[\s=:`])([A-Z][A-Z_]{1,}[A-Z0-9_]*)(?=[=\s\"'`]))",
    re.MULTILINE,
)
FENCE = re.compile(r"```(\w*)\n(.*?)```", re.DOTALL)
TEXTS = [
    "",
    "plain words",
    "FOO=BAR BAZ `QUX` export  AB1\n$A $AB ${CD} os.environ['E_F'] os.getenv(\"GH\") X=Y1 =ZZ'",
    "export FOO;BAR\nSTART_OF_LINE=1\nexport\nNEXT_LINE end",
    "see https://a.b/c),https://d.e/f] (http://g) <http://h> 'https://i' https://j\u00a0k",
    "```bash\ncurl x | sh\n  # no\n\n  ls\r\n```\n```python\nexec (1)\n```\n```\nuntagged\n``` ```broken",
    "```SH\none\n```text```\ntwo\n```",
    "\u00a0WIDE_SPACE\u2003=\u2003OTHER_ONE ",
    "a" * 5000 + " LONG_TAIL=1 " + "https://end.example/" + "z" * 3000,
]


def env(text):
    return sorted({g for m in ENV.finditer(text) for g in m.groups() if g})


def commands(text):
    found = []
    for tag, body in FENCE.findall(text):
        if tag.lower() in {"bash", "sh", "shell", "zsh", ""}:
            lines = (line.strip() for line in body.strip().splitlines())
            found += [line for line in lines if line and not line.startswith("#")]
    return found


def run(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *columns).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def check(spark, texts):
    t = F.col("t")
    fences = X.fences(t)
    rows = run(spark, texts, X.urls(t), X.env_in_prose(t), X.code_blocks(fences), X.shell_lines(fences))
    for text, (urls, names, blocks, lines) in zip(texts, rows, strict=True):
        assert urls == re.findall(r"https?://[^\s\"'`)\]>]+", text)
        assert names == env(text)
        assert blocks == [body for _, body in FENCE.findall(text)]
        assert lines == commands(text)


def test_awkward_texts(spark):
    check(spark, TEXTS)


PIECES = st.sampled_from(
    ["$", "{", "}", "AB", "A_1", "Z9", "export", " ", "\n", "=", "`", "```", "sh", "os.environ['", "']", "os.getenv(\"", "\")", ":", "https://x.y", "#", "é"]
)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=20, max_size=40))
def test_random_texts(spark, texts):
    check(spark, texts)


def test_hosts(spark):
    cases = {
        "https://GitHub.com/x": True,
        "https://raw.github.com": True,
        "https://notgithub.com": False,
        "https://docs.anything.io/x": True,
        "https://user:pw@pypi.org:443/a": True,
        "https://evil.com/?u=github.com": False,
        "https://evil.com/x|y": False,
        "https://": False,
    }
    rows = run(spark, list(cases), X.is_safe_url(F.col("t")))
    assert [r[0] for r in rows] == list(cases.values())


def test_sensitive_names(spark):
    cases = {"MY_SECRET": True, "api-key": True, "DATABASE_URL": True, "MY_DATABASE_URL": False, "HOME": False, "private_key": True}
    rows = run(spark, list(cases), X.is_sensitive_env(F.col("t")))
    assert [r[0] for r in rows] == list(cases.values())


def test_frontmatter(spark):
    text = "---\nname: 'my skill'\ndescription: does: things \n---\nbody"
    block = X.frontmatter_block(F.col("t"))
    fields = [X.frontmatter_field(block, f) for f in ("name", "description", "missing")]
    assert run(spark, [text, "no front"], *fields) == [("my skill", "does: things", None), (None, None, None)]


def test_hidden_text(spark):
    def hide(message):
        bits = "".join(format(ord(c), "08b") for c in message)
        return C.HIDDEN_MARK + "".join(C.HIDDEN_ZERO if b == "0" else "\u200d" for b in bits) + C.HIDDEN_MARK

    texts = ["a" + hide("hi there") + "b", "one " + C.HIDDEN_MARK + " mark", "none", hide("")]
    rows = run(spark, texts, X.hidden_run(F.col("t")).isNotNull(), X.hidden_text(F.col("t")))
    assert rows == [(True, "hi there"), (False, ""), (False, ""), (True, "")]


def test_clip(spark):
    rows = run(spark, ["x" * 120, "x" * 121], X.clip(F.col("t"), 120))
    assert rows[0][0] == "x" * 120 and rows[1][0] == "x" * 117 + "..."
