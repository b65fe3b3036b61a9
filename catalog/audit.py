"""Audit chains over events, one log per event type; session logs over conversations."""

from pyspark.sql import functions as F

from codequarry.operators import audit, changes
from codequarry.session import materialize, new_path
from codequarry.streaming import audit as stream_audit
from codequarry.streaming.run import finished

from .changes import STAMP, _PLAN, _plan, _rollback
from .registry import query, table
from .views import FILES, ingested

_RECORDS = """records AS (SELECT event_type AS repo, event_id AS ord, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, user_id FROM events),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ord) AS n FROM records)"""
_CHAIN = "RECURSIVE " + _RECORDS + """,
 parts AS (SELECT repo, n, concat('{"bytesAfter":', ord, ',"changeId":"c', ord, '","operation":"write_file","path":"u', user_id, '/', ord, '.txt","prevHash":') AS head,
   concat(',"seq":', n, ',"timestampUtc":"', t, '"}') AS rest, concat('{"seq":', n, ',"timestampUtc":"', t, '","prevHash":') AS lead_in,
   concat(',"changeId":"c', ord, '","operation":"write_file","path":"u', user_id, '/', ord, '.txt","bytesAfter":', ord) AS inner_part FROM numbered),
 chain AS (SELECT repo, n, 'null' AS prev, sha256(concat('GENESIS|', head, 'null', rest)) AS h FROM parts WHERE n = 1
  UNION ALL SELECT p.repo, p.n, concat('"', c.h, '"'), sha256(concat(c.h, '|', p.head, '"', c.h, '"', p.rest)) FROM chain c JOIN parts p ON p.repo = c.repo AND p.n = c.n + 1),
 log AS (SELECT repo, n AS pos, concat(lead_in, prev, inner_part, ',"entryHash":"', h, '"}') AS raw FROM chain JOIN parts USING (repo, n))"""


def records(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    record = F.concat(F.lit('{"changeId":"c'), k, F.lit('","operation":"write_file","path":"u'), F.col("user_id").cast("string"),
                      F.lit("/"), k, F.lit('.txt","bytesAfter":'), k, F.lit("}"))
    return e.select(F.col("event_type").alias("repo"), F.col("event_id").alias("ord"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"), record.alias("record"))


def stored_log(spark, sf_dir):
    """The log of all events, as it lies in storage when it is verified."""
    return ingested(spark, sf_dir, "event-log", lambda: audit.append(records(spark, sf_dir)))


def tampered(spark, sf_dir):
    """The same log with one digit changed in some entries, one line cut, and stray lines added."""
    log = stored_log(spark, sf_dir)
    k = F.col("pos")
    raw = (F.when((k % 97 == 0) & (F.col("repo") != "view"), F.regexp_replace("raw", '"bytesAfter":', '"bytesAfter":1'))
           .when((k == 50) & (F.col("repo") == "click"), F.left("raw", F.lit(40))).otherwise(F.col("raw")))
    lines = F.when((k == 10) & (F.col("repo") == "view"), F.array(F.lit("[1]"), F.lit("  "), raw)).otherwise(F.array(raw))
    return log.select("repo", "pos", F.posexplode(lines).alias("i", "raw")).select("repo", (k * 4 + F.col("i")).alias("pos"), "raw")


@query(f"WITH {_CHAIN} SELECT repo, pos, raw FROM log")
def audit_build(spark, sf_dir):
    return audit.append(records(spark, sf_dir))


@query("SELECT event_type AS repo, count(*) AS entry_count, CAST(NULL AS bigint) AS first_invalid_seq, true AS chain_valid, 'ok' AS status FROM events GROUP BY event_type")
def audit_verify(spark, sf_dir):
    return audit.verify(stored_log(spark, sf_dir), chunk=500)


@query(f"""WITH {_RECORDS}, n AS (SELECT repo, count(*) AS c FROM numbered GROUP BY repo),
 first AS (SELECT *, CASE WHEN repo = 'click' AND c >= 50 THEN 50 WHEN repo <> 'view' AND c >= 97 THEN 97 END AS bad FROM n)
SELECT repo, c AS entry_count, CAST(bad AS bigint) AS first_invalid_seq, bad IS NULL AS chain_valid, CASE WHEN bad IS NULL THEN 'ok' ELSE 'fail' END AS status FROM first""")
def audit_verify_tampered(spark, sf_dir):
    return audit.verify(tampered(spark, sf_dir), chunk=1000)


@query(f"WITH {_CHAIN}, r AS (SELECT repo, pos, raw, row_number() OVER (PARTITION BY repo ORDER BY pos DESC) AS back FROM log) SELECT * FROM r WHERE back <= 50")
def audit_tail(spark, sf_dir):
    return audit.tail(stored_log(spark, sf_dir), 50).drop("corrupt")


_SESSIONS = """sessions AS (SELECT concat('src', conv_id % 20) AS repo, conv_id AS session_id, turn AS pos, CASE WHEN role = 'user' THEN 'active' ELSE 'destroyed' END AS status, length(text) AS size FROM conversations)"""


def sessions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("repo"), F.col("conv_id").alias("session_id"),
                    F.col("turn").alias("pos"), F.when(F.col("role") == "user", "active").otherwise("destroyed").alias("status"),
                    F.length("text").alias("size"))


@query(f"WITH {_SESSIONS} SELECT repo, session_id, max(pos) AS pos, arg_max(status, pos) AS status, arg_max(size, pos) AS size FROM sessions GROUP BY repo, session_id")
def session_latest(spark, sf_dir):
    return audit.latest_sessions(sessions(spark, sf_dir))


@query(f"""WITH {FILES}, {_PLAN}, n AS (SELECT repo, count(*) FILTER (WHERE reject_reason IS NULL) AS c FROM plan GROUP BY repo)
SELECT repo, 2 * c AS entry_count, CAST(NULL AS bigint) AS first_invalid_seq, true AS chain_valid, 'ok' AS status FROM n WHERE c > 0""")
def audit_of_changes(spark, sf_dir):
    """A batch of writes and then its rollback, both logged; the second continues the first."""
    at = F.lit(STAMP).cast("timestamp")
    writes = materialize(audit.append(changes.audit_records(_plan(spark, sf_dir)[1], "batch-1", at)))
    undone = audit.append(changes.rollback_records(_rollback(spark, sf_dir)[1], at), audit.log_state(writes))
    return audit.verify(writes.unionByName(undone), chunk=100)


# numbers as they come, and as they are logged
_NUMBERS = [("1.00", "1.0"), ("1E22", "1e+22"), ("0.0000001", "1e-07"), ("0.30000000000000004", "0.30000000000000004"), ("-0.0", "-0.0"),
            ("12345678901234567890123", "12345678901234567890123"), ("5e-324", "5e-324")]
_NUMBER = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{shown}'" for i, (_, shown) in enumerate(_NUMBERS)) + " END"
_VALUE = "coalesce(CAST(value AS VARCHAR), 'null')"
_NUMBER_CHAIN = f"""RECURSIVE parts AS (SELECT event_type AS repo, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n,
   concat(',"timestampUtc":"', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '"') AS t, concat(',"～":{{"ratio":', {_NUMBER}, ',"😀":', {_VALUE}, '}},"😀":', event_id) AS sorted,
   concat(',"😀":', event_id, ',"～":{{"😀":', {_VALUE}, ',"ratio":', {_NUMBER}, '}}') AS given FROM events),
 chain AS (SELECT repo, n, 'null' AS prev, sha256(concat('GENESIS|', '{{"prevHash":null,"seq":1', t, sorted, '}}')) AS h FROM parts WHERE n = 1
  UNION ALL SELECT p.repo, p.n, concat('"', c.h, '"'), sha256(concat(c.h, '|{{"prevHash":"', c.h, '","seq":', p.n, t, sorted, '}}')) FROM chain c JOIN parts p ON p.repo = c.repo AND p.n = c.n + 1),
 log AS (SELECT repo, n AS pos, concat('{{"seq":', n, t, ',"prevHash":', prev, given, ',"entryHash":"', h, '"}}') AS raw FROM chain JOIN parts USING (repo, n))"""


def _number_log(spark, sf_dir):
    """Entries with numbers that are no decimals, and with keys whose order differs between code points and UTF-16."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    number = F.element_at(F.array(*(F.lit(given) for given, _ in _NUMBERS)), (k % 7 + 1).cast("int"))
    record = F.concat(F.lit('{"😀": '), k.cast("string"), F.lit(', "～": {"😀": '), F.coalesce(F.col("value").cast("string"), F.lit("null")),
                      F.lit(', "ratio": '), number, F.lit("}}"))
    return audit.append(e.select(F.col("event_type").alias("repo"), k.alias("ord"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"), record.alias("record")))


@query(f"WITH {_NUMBER_CHAIN} SELECT repo, pos, raw FROM log")
def audit_build_numbers(spark, sf_dir):
    return _number_log(spark, sf_dir)


@query("""WITH n AS (SELECT event_type AS repo, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
 b AS (SELECT repo, count(*) AS c, min(n) FILTER (WHERE n % 90 = 0 AND repo <> 'view') AS bad FROM n GROUP BY repo)
SELECT repo, c AS entry_count, bad AS first_invalid_seq, bad IS NULL AS chain_valid, CASE WHEN bad IS NULL THEN 'ok' ELSE 'fail' END AS status FROM b""")
def audit_verify_numbers(spark, sf_dir):
    """One digit more in some numbers breaks a chain; the same number in other digits does not."""
    bad = (F.col("pos") % 90 == 0) & (F.col("repo") != "view")
    raw = F.when(bad, F.regexp_replace("raw", '("ratio":-?)', "$11")).otherwise(F.replace(F.replace("raw", F.lit('"ratio":1.0}'), F.lit('"ratio": 10E-1}')), F.lit("1e+22"), F.lit("10.0e21")))
    log = ingested(spark, sf_dir, "number-log", lambda: _number_log(spark, sf_dir))
    return audit.verify(log.withColumn("raw", raw), chunk=500)


@query("""WITH n AS (SELECT event_type AS repo, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position FROM events)
SELECT repo, position, repo = 'view' OR position % 97 <> 0 AS ok, CASE WHEN repo <> 'view' AND position >= 97 THEN CAST(97 AS bigint) END AS first_invalid_seq FROM n""")
def audit_stream(spark, sf_dir):
    """The continuous check over a log that arrives in files by hash, so that most lines come before their predecessors."""
    bad = (F.col("pos") % 97 == 0) & (F.col("repo") != "view")
    log = stored_log(spark, sf_dir).withColumn("raw", F.when(bad, F.regexp_replace("raw", '"bytesAfter":', '"bytesAfter":1')).otherwise(F.col("raw")))
    path = new_path(spark, "arriving-log")
    log.repartition(6, F.xxhash64("pos")).write.parquet(path)
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return finished(stream_audit.verify(arriving), "audit-stream")
