import json

from codequarry.operators import preflight

GOOD = {"name": "plug", "version": "1.0.0", "interface": {"displayName": "D", "shortDescription": "S", "defaultPrompt": "one"}}
SKILL = "---\r\nname: \"alpha\"\r\ndescription: 'does it'\r\n---\r\nbody"
CONTRACT = {"schemaVersion": "1", "name": "alpha", "version": "1.0.0", "summary": "s", "evalPrompts": ["tests.md", "../alpha/tests.md"], "safety": {}}


def findings(files, *rows, repo="x/plug"):
    df = files(*[(repo, p, c if isinstance(c, (str, bytes)) else json.dumps(c)) for p, c in rows])
    return sorted((r.severity, r.id, r.file) for r in preflight.preflight_findings(df).collect()), preflight.plugin_preflight(df).first()


def test_clean_plugin(files):
    got, total = findings(files, (".codex-plugin/plugin.json", GOOD), ("skills/alpha/SKILL.md", SKILL), ("skills/alpha/contract.json", CONTRACT), ("skills/alpha/tests.md", ""),
                          ("scripts/commands/plugin_preflight.ps1", "dir"), ("scripts/commands/ok.sh", "ls"))
    assert got == [] and (total.status, total.errors) == ("pass", 0)


def test_missing_everything(files):
    got, total = findings(files, ("README.md", "x"))
    assert [g[1] for g in got] == ["manifest-missing", "skills-missing"] and total.status == "fail"
    got, _ = findings(files, ("skills/alpha/notes.md", "x"), ("skills/node_modules/SKILL.md", SKILL), (".codex-plugin/plugin.json", "[1]"))
    assert [g[1] for g in got] == ["manifest-invalid-json", "skills-empty"]


def test_manifest_rules(files):
    bad = {"name": "other", "version": 1, "interface": {"displayName": "", "shortDescription": "S", "defaultPrompt": ["a", "b", 3, "x" * 129]}}
    got, _ = findings(files, (".codex-plugin/plugin.json", bad), ("skills/alpha/SKILL.md", SKILL), ("skills/alpha/contract.json", CONTRACT), ("skills/alpha/tests.md", ""))
    assert [g[1] for g in got] == ["manifest-interface", "manifest-name", "manifest-version", "prompt-count", "prompt-length"]


def test_skill_and_contract_rules(files):
    base = [(".codex-plugin/plugin.json", GOOD)]
    contract = {"name": "beta", "version": "x", "toolsUsed": ["a", 1], "safety": [], "evalPrompts": ["gone.md"]}
    got, _ = findings(files, *base, ("skills/alpha/SKILL.md", SKILL), ("skills/alpha/contract.json", contract), ("skills/b/SKILL.md", SKILL), ("skills/c/SKILL.md", "[TODO: x"),
                      ("skills/d/SKILL.md", "---\nname: Bad Name\n---\n"), ("skills/b/contract.json", "nope"))
    assert [(g[1], g[2].split("/")[1]) for g in got] == [
        ("contract-field", "alpha"), ("contract-field", "alpha"), ("contract-invalid-json", "b"), ("contract-name", "alpha"), ("contract-name-mismatch", "alpha"),
        ("contract-safety", "alpha"), ("contract-tools", "alpha"), ("contract-version", "alpha"), ("skill-duplicate-name", "b"), ("skill-frontmatter", "c"),
        ("skill-metadata", "d"), ("skill-todo", "c"), ("contract-eval-missing", "alpha"), ("skill-directory-name", "b")]
    got, _ = findings(files, *base, ("skills/alpha/SKILL.md", SKILL), ("skills/alpha/contract.json", {**CONTRACT, "evalPrompts": "tests.md", "toolsUsed": None}))
    assert [g[1] for g in got] == ["contract-eval"]


def test_commands(files):
    key = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    got, _ = findings(files, (".codex-plugin/plugin.json", GOOD), ("skills/alpha/SKILL.md", SKILL), ("skills/alpha/contract.json", CONTRACT), ("skills/alpha/tests.md", ""),
                      ("scripts/commands/deep/a.ps1", f"iex {key}"), ("scripts/other/b.ps1", "iex"))
    assert got == [("error", "dynamic-code-execution", "scripts/commands/deep/a.ps1"), ("error", "potential-secret", "scripts/commands/deep/a.ps1")]


def test_rules_run_once_a_text(files):
    """The plans hold each rule once, over a text that is prepared once."""
    from codequarry.operators import scan

    df = files(("r", "scripts/commands/a.sh", "ls"))
    for found in (preflight._command_findings(df), scan.dangerous_commands(df)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("-EncodedCommand") == 1 and plan.count("make_valid_utf8") + plan.count("makeValid") == 1
