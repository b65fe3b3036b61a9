import json

from codequarry.operators import deps
from codequarry.sinks import documents
from frames import rows


def parse(files, name, content):
    df = deps.dependencies(deps.parsed_manifests(files(("r", f"x/{name}", content)))).orderBy("pos")
    return [(r.name, r.version, r.scope) for r in df.collect()]


def test_package_json(files):
    text = json.dumps({"dependencies": {"z": "1", "a": "^2"}, "devDependencies": {"b": None, "c": "x"}, "peerDependencies": [1], "optionalDependencies": {"d": "3"}})
    assert parse(files, "package.json", text) == [("z", "1", "dependencies"), ("a", "^2", "dependencies"), ("b", "None", "devDependencies"),
                                                  ("c", "x", "devDependencies"), ("d", "3", "optionalDependencies")]


def test_requirements(files):
    text = "# c\r\n-r x\n\n flask==2.0 \nuvicorn[standard] >= 1 ; python_version>'3'\nnumpy\n@bad\n  pkg.name_x~=1\n"
    assert parse(files, "requirements.txt", text) == [("flask", "==2.0", None), ("uvicorn", ">= 1 ; python_version>'3'", None),
                                                      ("numpy", None, None), ("pkg.name_x", "~=1", None)]


def test_pyproject_stops_at_the_first_bracket(files):
    text = ('[project]\nname = "x"\ndependencies = [\n "a>=1",\n \'b\',\n "uvicorn[standard]",\n "lost",\n]\n'
            '[tool.poetry.dependencies]\npython = "^3"\nC = "^1"\nd = {version = "2", extras = []}\n[other]\ne = "1"\n')
    assert parse(files, "pyproject.toml", text) == [("a", ">=1", None), ("b", None, None), ("C", "^1", None), ("d", "{version", None)]
    assert parse(files, "pyproject.toml", text.split("[tool")[0]) == [("a", ">=1", None), ("b", None, None)]


def test_go_mod(files):
    text = ("module m\nrequire one v1\nrequire (\n\ttwo v2 // indirect\n // three v3\n  four  v4\n bad 5\n)\nfive v5\n"
            "require six v6\n  require seven v7\nrequire (\n eight v8\n")
    assert parse(files, "go.mod", text) == [(n, v, None) for n, v in (
        ("one", "v1"), ("two", "v2"), ("four", "v4"), ("six", "v6"), ("seven", "v7"), ("eight", "v8"))]


def test_cargo(files):
    text = '[package]\na = "1"\n [dependencies] \nserde = { version = "1", features = ["x"] }\nrand="0.8"\n# note\n[dependencies.tokio]\nversion = "1"\n[dev-dependencies]\nc = "2" \n'
    assert parse(files, "Cargo.toml", text) == [("serde", '{ version = "1", features = ["x"] }', None), ("rand", "0.8", None), ("c", "2", None)]


def test_errors_are_rows(files):
    df = deps.parsed_manifests(files(("r", "package.json", "{broken"), ("r", "a/package.json", "[1]"), ("r", "requirements.txt", "A==1\na==2\nb"),
                                     ("r", "node_modules/x/package.json", "{}"), ("q", "go.mod", "")))
    assert sorted(r.file for r in deps.parse_errors(df).collect()) == ["a/package.json", "package.json"]
    got = {r.repo: (r.manifest_count, r.parse_errors, r.total_dependencies, r.unique_dependencies) for r in deps.dependency_inventory(df).collect()}
    assert got == {"r": (1, 2, 3, 2), "q": (1, 0, 0, 0)}
    capped = {r.repo: (r.total_dependencies, r.unique_dependencies) for r in deps.dependency_inventory(df, 1).collect()}
    assert capped["r"] == (3, 1)


def test_sbom_documents_split_but_lose_nothing(files):
    df = files(*[("big", f"{i}/requirements.txt", "\n".join(f"p{i}x{j}==1" for j in range(10))) for i in range(10)], ("small", "go.mod", "require a v1"))
    parts = documents.sbom(deps.sbom_components(deps.parsed_manifests(df)), per_document=40).collect()
    assert sum(r.component_count for r in parts if r.repo == "big") == 100 and len([r for r in parts if r.repo == "big"]) == 3
    small = json.loads(next(r.document for r in parts if r.repo == "small"))
    assert (small["bomFormat"], small["specVersion"], small["metadata"]["component"]["name"]) == ("CycloneDX", "1.4", "small")
    assert small["components"] == [{"type": "library", "name": "a", "version": "v1", "scope": "required", "ecosystem": "go", "manifest": "go.mod"}]


def test_sarif(files, tmp_path, spark):
    from codequarry.operators import scan
    key = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    df = scan.secret_findings(files(("r", "a", f"\n{key}"), ("r", "secrets/b", "x")))
    doc = json.loads(documents.sarif(df).first().document)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [x["id"] for x in run["tool"]["driver"]["rules"]] == ["aws-access-key", "sensitive-file"]
    first, second = [x["locations"][0]["physicalLocation"] for x in run["results"]]
    assert first == {"artifactLocation": {"uri": "a"}, "region": {"startLine": 2}} and second == {"artifactLocation": {"uri": "secrets/b"}}
    assert run["tool"]["driver"]["rules"][0]["name"] == "Aws Access Key" and key not in str(doc)
    documents.write_json(df, str(tmp_path / "out"))
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {"line": None, "file": "secrets/b"}.items() <= next(b for b in back if b["signature"] == "sensitive-file").items()
    assert rows(df)
