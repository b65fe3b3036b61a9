import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codequarry.operators import inventory, scan
from codequarry.sources import corpus, tables


def plant(root):
    for path, data in {"README.md": b"hi\n", ".github/workflows/ci.yml": b"on: push\n", ".env": b"K=1\n", "src/deep/er/a.py": b"x = 1\n", "_private/x": b"",
                       "node_modules/m/index.js": b"no", "src/build": b"ignored name", "bin/b": b"\0\1"}.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as handle:
            handle.write(data)
    os.makedirs(os.path.join(root, "hollow"))
    os.symlink(os.path.join(root, "README.md"), os.path.join(root, "link"))
    os.symlink(root, os.path.join(root, "src", "loop"))
    with open(os.path.join(os.fsencode(root), b"bad\xff.txt"), "wb") as handle:
        handle.write(b"z")


@pytest.mark.parametrize("partitions", [1, 64])
def test_scan(spark, tmp_path, partitions):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        plant(str(tmp_path / name))
    roots = {name: str(tmp_path / name) for name in ("one", "two")}
    listing = corpus.scan(spark, roots, min_partitions=partitions)
    got = {(r.path, r.entry_type, r.size_bytes) for r in listing.filter("repo = 'one'").collect()}
    files = {(p, s) for p, kind, s in got if kind == "file"}
    assert files == {("README.md", 3), (".github/workflows/ci.yml", 9), (".env", 4), ("src/deep/er/a.py", 6), ("_private/x", 0), ("bin/b", 2), ("bad�.txt", 1)}
    assert {p for p, kind, _ in got if kind == "symlink"} == {"link", "src/loop"}
    assert {p for p, kind, _ in got if kind == "dir"} == {".github", ".github/workflows", "src", "src/deep", "src/deep/er", "_private", "bin", "hollow"}
    assert listing.count() == 2 * len(got)
    assert corpus.files_of(listing).filter("was_non_utf8").count() == 2
    assert corpus.scan(spark, roots, content=False).filter("content IS NOT NULL").count() == 0


def test_ingest_then_query(spark, tmp_path):
    (tmp_path / "r").mkdir()
    plant(str(tmp_path / "r"))
    corpus.ingest(spark, {"r": str(tmp_path / "r")}, str(tmp_path / "table"))
    df = corpus.files_of(tables.files(spark, str(tmp_path / "table")))
    assert {r.language for r in inventory.language_stats(df).collect()} == {"Markdown", "YAML", "Python", "Other"}
    assert [r.file for r in scan.secret_findings(df).collect()] == [".env"]
    assert inventory.snapshot_counts(df).first().non_utf8_paths == 1
    assert tables.skill_documents(df).count() == 0


def test_flat_folder_and_large_files(spark, tmp_path):
    """One folder of many files and some large ones: reading is spread by bytes, large files come in pieces that add up."""
    root = tmp_path / "flat"
    root.mkdir()
    for i in range(3000):
        (root / f"f{i}.txt").write_bytes(b"x" * (i % 7))
    big = bytes(range(256)) * 4000
    for name in ("big1", "big2"):
        (root / name).write_bytes(big)
    (root / "edge").write_bytes(b"y" * 100_000)  # exactly one piece
    listing = corpus.scan(spark, {"r": str(root)}, min_partitions=8, piece_bytes=100_000)
    files = corpus.files_of(listing)
    assert files.count() == 3003 and files.filter("content IS NULL").count() == 2
    assert files.filter("path = 'edge'").first().content == b"y" * 100_000
    assert {(r.path, r.n) for r in files.groupBy("path").count().withColumnRenamed("count", "n").filter("n <> 1").collect()} == set()
    for name in ("big1", "big2"):
        parts = sorted((r.offset, bytes(r.content)) for r in corpus.pieces_of(listing).filter(f"path = '{name}'").collect())
        assert len(parts) == 11 and b"".join(p for _, p in parts) == big
    loads = [r[0] for r in listing.filter("entry_type = 'file'").groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("content"))).select(F.col("sum(octet_length(content))")).collect()]
    assert len(loads) >= 4 and max(loads) < 0.6 * sum(loads)


def test_folder_that_cannot_be_read(spark, tmp_path, monkeypatch):
    found = list(next(corpus._listed({"r": str(tmp_path)})(iter([pa.RecordBatch.from_pydict({"repo": ["r"], "place": [b"gone"]})]))).to_pylist())
    assert [(r["path"], r["entry_type"]) for r in found] == [("gone", "unreadable_dir")]
    read = next(corpus._reader({"r": str(tmp_path)})(iter([pa.RecordBatch.from_pydict({"repo": ["r"], "place": [b"gone"], "offset": [0], "length": [5]})])))
    assert read.column("content").to_pylist() == [None]


@pytest.mark.parametrize("roots", [{}, {"r": "/nowhere/at/all"}, {"r": "/"}, {"r": __file__}, {"r": ""}])
def test_bad_roots(spark, roots):
    with pytest.raises(Exception):
        corpus.scan(spark, roots).count()


def test_table_contract(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        tables.files(spark, str(tmp_path / "t"))


def test_short_ranges_share_tasks_and_reads(tmp_path, monkeypatch):
    """Ranges far shorter than a chunk: a bounded number of tasks, no more bytes read than there are, and every line once."""
    from codequarry.sources import lines

    data = b"".join(b"%d,%s\n" % (i, b"x" * (i % 50)) for i in range(60_000))
    (tmp_path / "a.log").write_bytes(data)
    reader = lines.LinesReader({"path": str(tmp_path / "a.log"), "splitbytes": "1000"})
    tasks = reader.partitions()
    assert len(data) > 1_500 * 1000 and len(tasks) <= lines.TASKS
    asked, opened = [], lines._buffered

    class Counting:
        def __init__(self, handle):
            self.handle = handle

        def read_at(self, n, offset):
            asked.append(n)
            return self.handle.read_at(n, offset)

    monkeypatch.setattr(lines, "_buffered", lambda handle, end: opened(Counting(handle), end))
    got = [(r["pos"], r["next"], r["raw"]) for t in tasks for batch in reader.read(t) for r in batch.to_pylist()]
    assert "".join(f"{raw}\n" for _, _, raw in got).encode() == data
    assert [n for _, n, _ in got] == [p for p, _, _ in got[1:]] + [len(data)]
    assert sum(asked) < 2 * len(data)


def test_log_files_are_spread_unless_whole(spark):
    """Lines of one folder are sorted by several tasks; asked for whole, they are one file."""
    from catalog.sources import _written

    rows = spark.range(2_000_000).select(F.lit("a").alias("repo"), F.col("id").alias("ord"), F.concat(F.lit("line "), F.sha2(F.col("id").cast("string"), 256)).alias("line"))
    names = {whole: spark.read.text(_written(spark, rows, "spread", whole=whole)).select(F.input_file_name()).distinct().count() for whole in (False, True)}
    assert names[True] == 1 and names[False] > 1
