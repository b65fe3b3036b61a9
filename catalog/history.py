"""Commit history over orders (commits) and lineitem (changed files)."""

from pyspark.sql import functions as F

from codequarry.operators import history

from .registry import query, table

_COMMITS = """commits AS (SELECT o_orderpriority AS repo, CAST(o_orderkey AS varchar) AS hash, concat('dev', o_custkey) AS author,
  concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Dev' ELSE 'dev' END, o_custkey, '@example.com') AS email, o_orderdate AS ts,
  concat('order ', o_orderkey) AS subject FROM orders)"""
_CHANGES = _COMMITS + """, changes AS (SELECT c.repo, c.hash, c.ts, concat('parts/', l_partkey, '.txt') AS file, l_linenumber AS pos
  FROM lineitem l JOIN commits c ON c.hash = CAST(l_orderkey AS varchar))"""


def commits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.col("o_orderpriority").alias("repo"), key.cast("string").alias("hash"),
        F.concat(F.lit("dev"), F.col("o_custkey").cast("string")).alias("author"),
        F.concat(F.when(key % 2 == 0, "Dev").otherwise("dev"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("o_orderdate").alias("ts"), F.concat(F.lit("order "), key.cast("string")).alias("subject"))


def commit_files(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderpriority").alias("repo"), F.col("l_orderkey").cast("string").alias("hash"),
        F.concat(F.lit("parts/"), F.col("l_partkey").cast("string"), F.lit(".txt")).alias("file"), F.col("l_linenumber").alias("pos"))


@query(f"WITH {_COMMITS} SELECT repo, count(*) AS commit_count, count(DISTINCT lower(email)) AS distinct_authors FROM commits GROUP BY repo")
def commit_summary(spark, sf_dir):
    return history.commit_summary(commits(spark, sf_dir))


@query(f"""WITH {_COMMITS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS pos FROM commits)
SELECT repo, hash, author, email, strftime(ts, '%Y-%m-%d') AS day, subject, pos FROM r WHERE pos <= 20""")
def recent_commits(spark, sf_dir):
    out = history.recent_commits(commits(spark, sf_dir))
    return out.select("repo", "hash", "author", "email", F.date_format("ts", "yyyy-MM-dd").alias("day"), "subject", "pos")


@query(f"""WITH {_CHANGES}, c AS (SELECT repo, file, count(*) AS changes, min((-epoch_us(ts), hash, pos)) AS seen FROM changes GROUP BY repo, file),
 r AS (SELECT repo, file, changes, row_number() OVER (PARTITION BY repo ORDER BY changes DESC, seen, file) AS pos FROM c) SELECT * FROM r WHERE pos <= 20""")
def churn_top20(spark, sf_dir):
    return history.churn(commits(spark, sf_dir), commit_files(spark, sf_dir))


@query(f"""WITH {_CHANGES}, n AS (SELECT repo, hash FROM (SELECT repo, hash, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS k FROM commits) WHERE k <= 100),
 c AS (SELECT repo, file, count(*) AS changes, min((-epoch_us(ts), hash, pos)) AS seen FROM changes SEMI JOIN n USING (repo, hash) GROUP BY repo, file),
 r AS (SELECT repo, file, changes, row_number() OVER (PARTITION BY repo ORDER BY changes DESC, seen, file) AS pos FROM c) SELECT * FROM r WHERE pos <= 20""")
def churn_latest_commits(spark, sf_dir):
    return history.churn(commits(spark, sf_dir), commit_files(spark, sf_dir), max_commits=100)
