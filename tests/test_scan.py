import random
import re

import pytest
from pyspark.sql import functions as F

from codequarry import rules
from codequarry.operators import scan
from frames import rows

AKIA = "AK" + "IA" + "ABCDEFGHIJKLMNOP"


def test_planted_key_is_found_and_never_shown(files):
    df = files(("r", "settings.cfg", f"aws_key = {AKIA}\n"), ("c", "clean.txt", "nothing sensitive here\n"))
    found = rows(scan.secret_findings(df).select("repo", "file", "line", "signature", "preview"))
    assert found == [("r", "settings.cfg", 1, "aws-access-key", "aws_key = [REDACTED:aws-access-key]")]
    status = {r.repo: (r.status, r.files_scanned, r.finding_count) for r in scan.secret_scan(df).collect()}
    assert status == {"r": ("warning", 1, 1), "c": ("pass", 1, 0)}
    shown = rows(scan.search_code(df, "aws")) + rows(scan.redacted(df)) + rows(scan.secret_findings(df))
    assert AKIA not in str(shown)


def test_one_finding_per_line_and_named_files_stay_closed(files):
    both = f"  {AKIA} gh" + "p_" + "a" * 30 + "  "
    df = files(("r", "a.txt", both), ("r", "Secrets/x.txt", AKIA), ("r", ".env.example", AKIA), ("r", ".env", AKIA), ("r", "x/.env.prod", "ok"),
               ("r", "bin.dat", AKIA.encode() + b"\0"), ("r", "big.txt", AKIA + "x" * 2000), ("r", "build", AKIA), ("r", "dist/a", AKIA))
    got = {(r.file, r.line, r.signature) for r in scan.secret_findings(df, max_file_bytes=1024).collect()}
    assert got == {("a.txt", 1, "github-token"), ("Secrets/x.txt", None, "sensitive-file"), (".env", None, "sensitive-file"),
                   (".env.example", 1, "aws-access-key")}


def test_preview_is_redacted_before_it_is_cut(files):
    df = files(("r", "a", "x " * 145 + AKIA + " tail"))
    preview = scan.secret_findings(df).first().preview
    assert len(preview) == 300 and "AK" + "IA" not in preview
    shown = scan.search_code(df, "tail", line_chars=300).first()
    assert len(shown.text) == 300 and "AK" + "IA" not in shown.text and shown.text_truncated
    whole = scan.search_code(df, "tail").first()
    assert whole.text.endswith("tail") and "AK" + "IA" not in whole.text and not whole.text_truncated


def test_whole_corpus_by_default(files):
    df = files(("r", "big.txt", "a\n" * 700_000 + AKIA), ("r", "late.bin", b"x" * 20_000 + b"\0"))
    assert [r.line for r in scan.secret_findings(df).collect()] == [700_001]
    assert scan.secret_scan(df).first().files_scanned == 1
    assert scan.secret_scan(df, max_file_bytes=2 * 1_048_576).first().finding_count == 1
    assert scan.search_summary(df, r"(?P<x>A)KI(?P<y>A).*").first().match_count == 1
    assert scan.search_summary(files(("r", "f", "abab\nabba")), r"(?P<p>ab)(?P=p)").first().match_count == 1


def build(files, seed):
    rnd = random.Random(seed)
    lines = ["plain", AKIA, f"k = {AKIA}", "token: '" + "z" * 20 + "'", "hi 0123456789abcdefXYZ", "x='Zx9Yw8Vu7Ts6Rq5Po4'", "TODO"]
    table = [(repo, f"{rnd.choice(['', 'b/', 'A/', 'secret/'])}{i}.txt", "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 6))))
             for repo in "rs" for i in range(rnd.randint(5, 25))]
    return table, files(*table)


def walked(table, repo):
    key = lambda p: [(i < p.count("/"), x.casefold()) for i, x in enumerate(p.split("/"))]
    return sorted(((p, c) for r, p, c in table if r == repo), key=lambda t: key(t[0]))


@pytest.mark.parametrize("seed,cap", [(1, 1), (2, 3), (3, 7), (4, 400)])
def test_caps_stop_where_a_sequential_scan_stops(files, seed, cap):
    table, df = build(files, seed)
    signatures = [(n, re.compile(p, re.I if i else 0)) for n, p, i in rules.SECRET_SIGNATURES]
    token = re.compile(rules.TOKEN_PATTERN)
    for repo in "rs":
        found, scanned = [], 0
        for path, content in walked(table, repo):
            if len(found) >= cap:
                break
            if re.search(rules.SENSITIVE_FILE_PATTERN, path, re.I):
                found.append((path, None, "sensitive-file"))
                continue
            scanned += 1
            for n, line in enumerate(content.splitlines(), 1):
                if len(found) >= cap:
                    break
                hit = next((i for i, p in signatures if p.search(line)), None)
                if hit:
                    found.append((path, n, hit))
        got = scan.secret_findings(df, max_findings=cap).filter(F.col("repo") == repo).orderBy("pos")
        assert [(r.file, r.line, r.signature) for r in got.collect()] == found
        total = scan.secret_scan(df, max_findings=cap).filter(F.col("repo") == repo).first()
        assert (total.files_scanned, total.finding_count, total.findings_limit_reached) == (scanned, len(found), len(found) >= cap)

        seen, high, opened = set(), [], 0
        for path, content in walked(table, repo):
            if len(high) >= cap:
                break
            if not content:
                continue
            opened += 1
            for n, line in enumerate(content.splitlines(), 1):
                if len(high) >= cap:
                    break
                for m in token.finditer(line):
                    if m.group(1) not in seen:
                        seen.add(m.group(1))
                        if len(set(m.group(1))) > 1:  # the planted repeated letter has entropy 0
                            high.append((path, n))
        got = scan.entropy_findings(df, entropy_threshold=2.0, max_findings=cap).filter(F.col("repo") == repo)
        assert sorted((r.file, r.line) for r in got.collect() if r.entropy >= 2) == sorted(high)
        total = scan.entropy_scan(df, entropy_threshold=2.0, max_findings=cap).filter(F.col("repo") == repo).first()
        assert (total.files_scanned, total.finding_count) == (opened, len(high))

        matches, searched = 0, 0
        for path, content in walked(table, repo):
            if matches >= cap:
                break
            searched += 1
            matches = min(cap, matches + sum("TODO" in x for x in content.splitlines()))
        total = scan.search_summary(df, "TODO", max_results=cap).filter(F.col("repo") == repo).first()
        assert (total.files_searched, total.match_count) == (searched, matches)


def test_entropy_threshold_only_removes(files):
    df = files(("r", "data.txt", "token = AbCdEfGh12345678\n"), ("r", "readme.txt", "This is normal English text with no secrets.\n"))
    n = [scan.entropy_findings(df, entropy_threshold=t).count() for t in (2.0, 3.0, 4.0, 4.5, 7.0)]
    assert n == sorted(n, reverse=True) and n[1] == 1 and n[-1] == 0


def test_same_token_once_per_repo(files):
    token = "Q1w2E3r4T5y6U7i8O9p0AsDfGhJkLzXc"
    df = files(("r", "a.txt", token), ("r", "b.txt", f"k={token}\n{token}"), ("s", "z/c.txt", token), ("r", "a.lock", token), ("r", "x.min.js", "var k='" + token[::-1] + "'"))
    got = sorted((r.repo, r.file, r.length) for r in scan.entropy_findings(df).collect())
    assert got == [("r", "a.txt", 32), ("r", "b.txt", 34), ("r", "x.min.js", 32), ("s", "z/c.txt", 32)]
    assert token not in str(rows(scan.entropy_findings(df)))


def test_context_is_clipped(files):
    df = files(("r", "a.txt", "one\ntwo\nhit\nfour"), ("r", "b.md", "hit"))
    got = {r.file: (r.line, r.before, r.after) for r in scan.search_code(df, "^hit$", context_lines=5).collect()}
    assert got == {"a.txt": (3, ["one", "two"], ["four"]), "b.md": (1, [], [])}
    assert scan.search_code(df, "hit", file_pattern=r"\.md$", context_lines=0).collect()[0].before == []


@pytest.mark.parametrize("call", [
    lambda d: scan.search_code(d, "("), lambda d: scan.search_code(d, ""), lambda d: scan.search_code(d, "a" * 501),
    lambda d: scan.search_code(d, "a", context_lines=11), lambda d: scan.search_code(d, "a", max_results=0),
    lambda d: scan.search_code(d, "a", max_results=True), lambda d: scan.search_code(d, "a", redact_secrets=1),
    lambda d: scan.secret_findings(d, max_findings=0), lambda d: scan.secret_findings(d, max_files=0),
    lambda d: scan.entropy_findings(d, entropy_threshold=1.9), lambda d: scan.entropy_findings(d, entropy_threshold="x"),
    lambda d: scan.entropy_findings(d, min_token_length=7), lambda d: scan.secret_findings(d, max_file_bytes=10)])
def test_bad_parameters(files, call):
    with pytest.raises(ValueError):
        call(files(("r", "a", "b")))


def test_dangerous_commands(files):
    df = files(("r", "a.ps1", "Invoke-Expression $x\n"), ("r", "b.sh", "curl http://x\n| sh"), ("r", "c.sh", "CURL http://x | bash"),
               ("r", "d.ps1", "Remove-Item x\n -Recurse -Force"), ("r", "e.ps1", "remove-item x -recurse -force; p -encodedcommand z"))
    assert sorted((r.file, r.signature) for r in scan.dangerous_commands(df).collect()) == [
        ("a.ps1", "dynamic-code-execution"), ("c.sh", "pipe-to-shell"), ("e.ps1", "encoded-powershell"), ("e.ps1", "force-recursive-delete")]
