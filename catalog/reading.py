"""Bounded reads."""

from pyspark.sql import functions as F

from codequarry.operators import reading

from .registry import query
from .views import FILES, files, sql_redact

_KEPT = rf"regexp_extract_all(content, '[^\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]*(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}])|[^\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]+$')"
_READ = f"""kept AS (SELECT repo, path, size_bytes, {_KEPT} AS ks FROM files),
 reads AS (SELECT repo, path, size_bytes, false AS is_binary, 0 AS replaced_characters, false AS truncated_bytes, len(ks) > 6 AS truncated_lines,
   least(len(ks), 6) AS lines_returned, {sql_redact("array_to_string(list_slice(ks, 1, 6), '')")} AS content FROM kept)"""

_WHOLE = f"""reads AS (SELECT repo, path, CAST(len({_KEPT}) AS INTEGER) AS lines_returned, {sql_redact("content")} AS content FROM files)"""
ROOT = "/srv/code"


@query(f"WITH {FILES}, {_READ} SELECT * FROM reads")
def bounded_read(spark, sf_dir):
    return reading.read_files(files(spark, sf_dir), max_bytes=None, max_lines=6)


# every path once, spelled in several ways, and as many that do not exist or leave the root
_ASKED = """asked AS (SELECT repo, CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN './' || path WHEN 2 THEN 'x/../' || path ELSE '/srv/code/' || path END AS requested, path AS target, NULL AS error FROM files
 UNION ALL SELECT repo, CASE doc_id % 3 WHEN 0 THEN '../' || path WHEN 1 THEN path || '.missing' ELSE '/etc/' || path END, NULL,
  CASE doc_id % 3 WHEN 1 THEN 'no such file' ELSE 'the path leads out of the repository' END FROM files)"""


def _requests(df):
    k, p = F.col("doc_id"), F.col("path")
    good = F.when(k % 4 == 0, p).when(k % 4 == 1, F.concat(F.lit("./"), p)).when(k % 4 == 2, F.concat(F.lit("x/../"), p)).otherwise(F.concat(F.lit(ROOT + "/"), p))
    bad = F.when(k % 3 == 0, F.concat(F.lit("../"), p)).when(k % 3 == 1, F.concat(p, F.lit(".missing"))).otherwise(F.concat(F.lit("/etc/"), p))
    return df.select("repo", F.explode(F.array(good, bad)).alias("path"))


@query(f"""WITH {FILES}, {_WHOLE}, {_ASKED} SELECT a.repo, a.requested, CASE WHEN a.error IS NULL THEN 'ok' ELSE 'error' END AS status, a.error,
 r.lines_returned, r.content FROM asked a LEFT JOIN reads r ON r.repo = a.repo AND r.path = a.target""")
def batch_read(spark, sf_dir):
    df = files(spark, sf_dir)
    return reading.batch_read(_requests(df), df, ROOT, max_bytes=None, max_lines=None).select(
        "repo", "requested", "status", "error", "lines_returned", "content")


@query(f"""WITH {FILES}, {_ASKED} SELECT repo, count(*) AS file_count, count(*) FILTER (WHERE error IS NULL) AS succeeded,
 count(*) FILTER (WHERE error IS NOT NULL) AS errored, CASE WHEN count(error) = 0 THEN 'ok' WHEN count(error) = count(*) THEN 'error' ELSE 'partial' END AS status FROM asked GROUP BY repo""")
def batch_read_status(spark, sf_dir):
    df = files(spark, sf_dir)
    return reading.batch_status(reading.batch_read(_requests(df), df, ROOT))
