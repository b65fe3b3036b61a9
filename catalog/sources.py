"""Sources and sinks over files that Spark has written from the driver tables, and streams that run to their end."""

from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.operators import inventory
from codequarry.session import new_path
from codequarry.sinks import documents, ledger
from codequarry.sources import corpus, logs
from codequarry.streaming import scan as stream_scan
from codequarry.streaming.run import finished

from .audit import _CHAIN, records
from .history import _CHANGES, _COMMITS, commit_files, commits
from .registry import ORACLES, query, table
from .views import FILES, files, files_from


def _written(spark, rows, name, folder="repo", whole=False):
    """Text files of ``line`` for each value of ``folder``, in the order of ``ord``; the folder they are in. ``whole``: one file each, for
    positions in it; else a file for each range of ``ord``, so that no task sorts a whole folder."""
    path = new_path(spark, name)
    dealt = rows.repartition(folder) if whole else rows.repartitionByRange(folder, "ord")
    dealt.sortWithinPartitions(folder, "ord").select(folder, F.col("line").alias("value")).write.partitionBy(folder).text(path)
    return path


_FOLDER = r"/repo=([^/]+)/[^/]*\.txt$"
_LINES = """given AS (SELECT event_type AS repo, event_id AS ord, concat('{"id":', event_id, ',"user":', user_id, ',"é":"', coalesce(props, ''), '"}', repeat(' ', CAST(event_id % 5 AS INTEGER))) AS line FROM events),
 placed AS (SELECT repo, line AS raw, CAST(sum(strlen(line) + 1) OVER (PARTITION BY repo ORDER BY ord) AS BIGINT) AS next, strlen(line) + 1 AS size FROM given)"""


def _event_lines(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    line = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"user":'), F.col("user_id").cast("string"), F.lit(',"é":"'), F.coalesce("props", F.lit("")),
                    F.lit('"}'), F.repeat(F.lit(" "), (k % 5).cast("int")))
    return e.select(F.col("event_type").alias("repo"), k.alias("ord"), line.alias("line"))


@query(f"WITH {_LINES} SELECT repo, next - size AS pos, next, raw FROM placed")
def log_lines(spark, sf_dir):
    """Byte positions of every line of the log files, read in ranges of 5,000 bytes."""
    path = _written(spark, _event_lines(spark, sf_dir), "event-log", whole=True)
    return logs.read_lines(spark, f"{path}/repo=*/*.txt", _FOLDER, split_bytes=5_000).drop("file")


@query(f"WITH {_LINES} SELECT repo, next - size AS pos, next, raw FROM placed")
def log_stream(spark, sf_dir):
    path = _written(spark, _event_lines(spark, sf_dir), "event-log", whole=True)
    return finished(logs.stream_lines(spark, f"{path}/repo=*/*.txt", _FOLDER, split_bytes=20_000).drop("file"), "log-stream")


@query("""SELECT concat('src', conv_id % 20) AS repo, CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN role = 'user' THEN 'active' ELSE 'destroyed' END AS status,
 concat('t', turn) AS created_at, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL""")
def session_log(spark, sf_dir):
    """Session records out of JSON lines, among lines that are no JSON."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    record = F.concat(F.lit('{"sessionId": "'), F.col("conv_id").cast("string"), F.lit('", "status": "'), F.when(F.col("role") == "user", "active").otherwise("destroyed"),
                      F.lit('", "createdAtUtc": "t'), F.col("turn").cast("string"), F.lit('"}'))
    rows = c.select(F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("repo"), F.col("conv_id").alias("ord"),
                    F.explode(F.array(record, F.lit("  "), F.lit("not json"))).alias("line"))
    found = logs.session_records(logs.read_lines(spark, f"{_written(spark, rows, 'session-log')}/repo=*/*.txt", _FOLDER, split_bytes=50_000))
    return found.groupBy("repo", "session_id", "status", "created_at").agg(F.count("*").alias("n"))


@query(f"WITH {_COMMITS} SELECT replace(repo, ' ', '_') AS repo, hash, author, email, ts, concat('change of ', hash, ' ', repeat('x', 300)) AS subject FROM commits")
def commit_log(spark, sf_dir):
    """Commits out of lines with fields, whole subjects, among lines that are too short."""
    c = commits(spark, sf_dir)
    subject = F.concat(F.lit("change of "), "hash", F.lit(" "), F.repeat(F.lit("x"), F.lit(300)))
    line = F.concat_ws("\u001f", "hash", "author", "email", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"), subject)
    rows = c.select(F.translate("repo", " ", "_").alias("repo"), F.col("hash").alias("ord"), F.explode(F.array(line, F.lit("short\u001fline"))).alias("line"))
    path = _written(spark, rows, "commit-log")
    return logs.commit_records(logs.read_lines(spark, f"{path}/repo=*/*.txt", _FOLDER, split_bytes=100_000))


@query(f"WITH {_CHANGES} SELECT replace(repo, ' ', '_') AS repo, file, count(*) AS n FROM changes GROUP BY ALL")
def change_log_lines(spark, sf_dir):
    rows = commit_files(spark, sf_dir).select(F.translate("repo", " ", "_").alias("repo"), F.col("file").alias("ord"), F.concat(F.lit(" "), "file", F.lit("\t")).alias("line"))
    path = _written(spark, rows, "change-log")
    return logs.change_records(logs.read_lines(spark, f"{path}/repo=*/*.txt", _FOLDER, split_bytes=100_000)).groupBy("repo", "file").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT concat('d', doc_id % 7) AS folder, concat(coalesce(text, ''), chr(10)) AS t FROM documents)
SELECT folder, count(*) AS documents, CAST(sum(strlen(t)) AS BIGINT) AS bytes, CAST(sum(strlen(t) - strlen(replace(t, chr(10), ''))) AS BIGINT) AS newlines FROM d GROUP BY folder""")
def corpus_scan(spark, sf_dir):
    """A tree of text files, scanned by name and then read in pieces: every byte comes back once."""
    path = new_path(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")).alias("folder"), F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("folder").write.partitionBy("folder").text(path)
    listing = corpus.scan(spark, {"tree": path.removeprefix("file:")}, piece_bytes=100_000)
    texts = listing.filter("entry_type = 'file' AND path LIKE '%.txt'").withColumn("folder", F.regexp_extract("path", "folder=([^/]+)/", 1))
    newlines = F.octet_length("content") - F.octet_length(F.encode(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"), F.lit("")), "ISO-8859-1"))
    read = texts.groupBy("folder").agg(F.sum(F.octet_length("content")).cast("bigint").alias("bytes"), F.sum(newlines).cast("bigint").alias("newlines"))
    return docs.groupBy("folder").agg(F.count("*").alias("documents")).join(read, "folder")


@query(f"""WITH {FILES} SELECT repo, CASE doc_id % 3 WHEN 0 THEN concat(path, chr(65533)) WHEN 1 THEN concat(chr(65533), chr(65533), path) ELSE path END AS path, doc_id % 3 < 2 AS was_non_utf8 FROM files""")
def sanitized_paths(spark, sf_dir):
    """Paths with bytes that are no UTF-8."""
    raw = F.col("path").cast("binary")
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat(raw, F.unhex(F.lit("FF")))).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("80FE")), raw)).otherwise(raw)
    return inventory.sanitize_paths(files(spark, sf_dir).select("repo", broken.cast("string").alias("path")))


@query(f"""WITH {FILES} SELECT repo, count(*) FILTER (WHERE doc_id % 5 = 0) AS skipped_symlinks, count(*) FILTER (WHERE doc_id % 5 = 1) AS inaccessible_directories,
 count(*) FILTER (WHERE doc_id % 5 > 1 AND doc_id % 3 = 0) AS non_utf8_paths FROM files GROUP BY repo""")
def listing_counters(spark, sf_dir):
    k, raw = F.col("doc_id"), F.col("path").cast("binary")
    kind = F.when(k % 5 == 0, "symlink").when(k % 5 == 1, "unreadable_dir").otherwise("file")
    path = F.when(k % 3 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw).cast("string")
    return inventory.listing_counters(files(spark, sf_dir).select("repo", path.alias("path"), kind.alias("entry_type")))


@query("""WITH c AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) * (doc_id % 10) // 10 AS INTEGER) AS k FROM documents)
SELECT doc_id, k > 0.30 * (strlen(t) + k) AS binary FROM c""")
def binary_files(spark, sf_dir):
    """Texts followed by control bytes, fewer and more than may be."""
    t = F.coalesce("text", F.lit(""))
    k = F.expr("cast(octet_length(t) * (doc_id % 10) div 10 AS int)")
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", text.is_binary(F.concat("t", F.repeat(F.lit("\u0001"), k))).alias("binary"))


@query("""SELECT concat('{"s_suppkey":', s_suppkey, ',"s_name":"', s_name, '","nothing":null}') AS value FROM supplier""")
def json_rows(spark, sf_dir):
    path = new_path(spark, "json-rows")
    documents.write_json(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(None).cast("string").alias("nothing")), path)
    return spark.read.text(path)


@query(f"WITH {_CHAIN} SELECT repo, pos, raw FROM log")
def audit_ledger(spark, sf_dir):
    """Three appends to one log; a writer that missed one of them is turned away and leaves nothing."""
    path, given = new_path(spark, "ledger"), records(spark, sf_dir)
    third = given.agg(F.percentile_approx("ord", [0.3, 0.6])).first()[0] or [0, 0]
    ledger.extend(given.filter(F.col("ord") <= third[0]), path)
    ledger.extend(given.filter((F.col("ord") > third[0]) & (F.col("ord") <= third[1])), path)
    try:
        ledger.extend(given.filter(F.col("ord") > third[0]), path, expected=1)
        raise AssertionError("the log has forked")
    except ledger.Conflict:
        ledger.extend(given.filter(F.col("ord") > third[1]), path)
    return ledger.read(spark, path)


def _arriving(spark, sf_dir):
    """The documents as files that come in over several triggers."""
    path, docs = new_path(spark, "arriving-documents"), table(spark, sf_dir, "documents")
    docs.repartition(6, F.xxhash64("doc_id")).write.parquet(path)
    return files_from(spark, spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(path))


@query(ORACLES["secret_findings"])
def stream_secret_findings(spark, sf_dir):
    """The scan of secrets over files as they arrive."""
    return finished(stream_scan.secret_findings(_arriving(spark, sf_dir)), "stream-secrets")


@query("""SELECT repo, token_hash, length FROM (""" + ORACLES["entropy_findings"] + """)""")
def stream_entropy_findings(spark, sf_dir):
    """Each token of a repo once, whichever of its files came first."""
    arriving = _arriving(spark, sf_dir).withColumn("arrived", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return finished(stream_scan.entropy_findings(arriving, entropy_threshold=3.0), "stream-tokens").select("repo", "token_hash", "length")
