"""Content rules and definitions are looked for only where a lead of theirs stands; dumps are parsed once, where they are made."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions import definitions as D
from wardline.functions import rules as R
from wardline.functions import text as X
from wardline.operators import frameworks
from workloads import all_cases
from workloads import fixtures as fx

TEXTS = (
    "requests.post ( 'https://a", "HTTPX.POST(\"http://b", "Fetch('HTTPS://c", "WebHook", "eXfil", "phone-HOME", "PhoneHome", "phone_home",
    "Beacon", "BASE64.encode", "socKet.Connect", "ſudo x", "CHMOD  755 x", "chmod 755é", "chown", "chownx", "OS.ſyſtem",
    "subprocess.Popen", "EXEC  (", "eval (", "__İmport__ (", "__ımport__(", "api_Key", "SECRET", "toKen", "Paſſword", "credentİal",
    "OS.environ[", ".AWS x CREDENTIAL", ".gcp\ncredential", ".azure.credential", "KEYRING.", "Keychain", "FULL_ACCESS", "full access",
    "allpermissions", "all permissions", "ADMİN", "Root", "ſuperuser", "*.*", "a/**/*", "read, WRITE ,execute", "Read,wrıte,read", "read, write",
    "plain words", "", None,
)


def test_leads_hide_no_match(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "seq int, text string")
    bare = [r._replace(leads=()) for r in C.CONTENT_RULES]
    found = [
        rows.select("seq", R.first_match_hits(F.col("text"), rules).alias("hits")).collect() for rules in (C.CONTENT_RULES, bare)
    ]
    assert sorted(found[0]) == sorted(found[1])
    assert sum(len(r.hits or ()) for r in found[0]) > 35
    assert all(rule.leads for rule in C.CONTENT_RULES)


def test_pypi_documents_are_parsed_once_and_not_dealt_out(spark):
    df = all_cases()["registry_scan_pypi"].run(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert "plain words" not in plan[plan.index("Repartition") :]


DEFINED = (
    *[code for _, code in fx.SNIPPETS],
    "@x.function_tool(\n  strict=True)\ndef a():\n  pass\nm = MCPServerSse(url='u')\nn = MCPServer(command='c')\nMCPServerStreamableHttp()",
    *[f"from agents import (Agent,\n  {tool})\n" for tool in C.HOSTED_TOOLS],
    "before_tool_callback=f\nOpenAPIToolset(spec_str_type='json')\nQueryEngineTool(metadata=ToolMetadata(name='q'))",
    *[f"a = {reader}()\n" for reader in C.INDEX_READERS],
    *[f"b = {agent}.from_tools([t])\n" for agent in C.INDEX_AGENTS],
    "@tool\ndef a():\n  pass\n@k.tool\ndef b():\n  pass\n@k.tool_plain\ndef c():\n  pass\ns.tool('d')\n@action\ndef e():\n  pass\n@k.action\ndef f():\n  pass",
    "{'type': 'function', 'function': {'name': 'f'}}",
    "class A(Action):\n  pass\nclass B(Role):\n  pass\nclass H(x.Hook):\n  pass\nclass T(Toolkit, Action):\n  pass",
    "@register_tool\ndef a():\n  pass\n@u.register_for_llm()\ndef b():\n  pass\np.add_component(name='n', instance=m.Generator())",
    "an agent, a tool and a function in plain words",
    "",
    None,
)


def test_leads_hide_no_definition(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(DEFINED)], "seq int, content string")
    found = [
        rows.select("seq", *[D.read(k._replace(leads=k.leads if led else ()), F.col("content")).alias(f"k{i}") for i, k in enumerate(D.KINDS)])
        .orderBy("seq")
        .collect()
        for led in (True, False)
    ]
    assert found[0] == found[1]
    never = [(k.format, k.kind, k.pattern[:40]) for i, k in enumerate(D.KINDS) if not any(r[f"k{i}"] for r in found[0])]
    assert never == []
    assert all(k.leads for k in D.KINDS)


def test_leads_hide_no_format(spark, monkeypatch):
    texts = [*DEFINED, "import pyautogen", "from phi import x", "import agno", "require('@mastra/core')", "require( '@modelcontextprotocol/sdk/x')",
             '"type" : "n8n-nodes-base.x"', *[f'"type": "{n}"' for n in C.FLOWISE_NODE_TYPES]]
    paths = ["a.py", "a.ts", "a.json", "tools/a.yaml", "manifest.json", "a.txt"]
    rows = spark.createDataFrame([(p, t) for p in paths for t in texts], "path string, content string")
    led = sorted(rows.select("path", "content", frameworks.formats(F.col("path"), F.col("content"))).collect(), key=str)
    monkeypatch.setattr(C, "FRAMEWORK_MARKERS", tuple(m[:3] for m in C.FRAMEWORK_MARKERS))
    assert led == sorted(rows.select("path", "content", frameworks.formats(F.col("path"), F.col("content"))).collect(), key=str)
    assert {f for r in led for f in r[2]} >= {k.format for k in D.KINDS} | {"mastra", "n8n", "flowise"}


def test_content_patterns_have_leads():
    assert [m for m in C.FRAMEWORK_MARKERS if m[2] and not m[2].startswith("(?i)") and len(m) < 4] == []


def test_capabilities_read_imports_and_variables_once(spark):
    content = F.col("content")
    rows = spark.createDataFrame([("import os, httpx\nimport shutil\nfrom subprocess import run\nk = os.getenv('API_KEY')",), (None,)], "content string")
    python = frameworks.python_capabilities(content, X.python_imports(content), X.env_in_python(content))
    script = frameworks.js_capabilities(F.concat(content, F.lit("fs.x; process.env.MY_TOKEN")), X.env_in_js(F.lit("process.env.MY_TOKEN")))
    df = rows.select(python.alias("python"), script.alias("script"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"^[^\s.;]*") == 1 and plan.count(C.ENV_JS_BRACKET) == 1
    got = df.collect()
    assert got[0].python == sorted(
        ["credentials:read", "env:read", "filesystem:read", "filesystem:write", "network:read", "network:write", "system:execute"]
    )
    assert got[0].script == ["credentials:read", "env:read", "filesystem:read", "filesystem:write"] and got[1].python == []
