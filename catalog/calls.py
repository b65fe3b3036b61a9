"""Call streams over events."""

from pyspark.sql import functions as F

from codequarry.operators import calls

from .registry import query, table

_LIMIT = """RECURSIVE c AS (SELECT event_type AS key, event_id AS id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT key, id, us, n, us AS window_start FROM c WHERE n = 1
  UNION ALL SELECT c.key, c.id, c.us, c.n, CASE WHEN c.us - r.window_start >= 3600000000 THEN c.us ELSE r.window_start END FROM r JOIN c ON c.key = r.key AND c.n = r.n + 1)"""


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("id"))


@query(f"WITH {_LIMIT} SELECT key, id, us, window_start, row_number() OVER (PARTITION BY key, window_start ORDER BY us, id) <= 3 AS allowed FROM r")
def rate_limit(spark, sf_dir):
    return calls.rate_limit(_calls(spark, sf_dir), limit=3, window_seconds=3600)


@query(f"WITH {_LIMIT} SELECT DISTINCT key, window_start AS start FROM r")
def rate_limit_windows(spark, sf_dir):
    return calls.window_openings(_calls(spark, sf_dir), window_seconds=3600)


@query("""WITH e AS (SELECT user_id AS session_id, epoch_us(ts) AS us FROM events),
 g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 3600000000 THEN 1 ELSE 0 END AS s FROM e WINDOW w AS (PARTITION BY session_id ORDER BY us)),
 k AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT session_id, CAST(run AS bigint) AS run, min(us) AS first_us, max(us) AS last_us, count(*) AS events, max(us) + 3600000000 AS expires_us FROM k GROUP BY session_id, run""")
def idle_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts")
    return calls.idle_sessions(e, 3600)


_OPS = """o AS (SELECT event_type AS tenant, event_id AS id, epoch_us(ts) AS us, user_id AS s,
   CASE WHEN event_id % 5 = 0 THEN 'create' WHEN event_id % 25 = 4 THEN 'destroy' ELSE 'touch' END AS op,
   row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)"""


@query(f"""WITH RECURSIVE {_OPS},
 r AS (SELECT DISTINCT tenant, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS evicted,
   CAST([] AS STRUCT(s BIGINT, us BIGINT)[]) AS live FROM o
  UNION ALL SELECT tenant, n, id,
   CASE WHEN op = 'create' THEN 'created' WHEN NOT known THEN 'unknown' WHEN op = 'touch' THEN 'touched' ELSE 'destroyed' END,
   CASE WHEN op = 'create' AND NOT known AND len(l) >= 10 THEN l[1].s END,
   CASE WHEN op <> 'create' AND NOT known THEN l
    ELSE list_concat(list_filter(CASE WHEN NOT known AND len(l) >= 10 THEN l[2:] ELSE l END, lambda x: x.s <> s),
     CASE WHEN op = 'destroy' THEN CAST([] AS STRUCT(s BIGINT, us BIGINT)[]) ELSE [{{'s': CAST(s AS BIGINT), 'us': CAST(us AS BIGINT)}}] END) END
  FROM (SELECT *, len(list_filter(l, lambda x: x.s = s)) > 0 AS known FROM
   (SELECT o.tenant, o.n, o.id, o.op, o.s, o.us, list_filter(r.live, lambda x: o.us - x.us <= 21600000000) AS l FROM r JOIN o ON o.tenant = r.tenant AND o.n = r.n + 1)))
SELECT tenant, id, outcome, evicted, CAST(len(live) AS INTEGER) AS active FROM r WHERE n > 0""")
def session_cap(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    ops = e.select(F.col("event_type").alias("tenant"), "ts", k.alias("id"),
                   F.when(k % 5 == 0, "create").when(k % 25 == 4, "destroy").otherwise("touch").alias("op"), F.col("user_id").alias("session_id"))
    return calls.session_cap(ops, max_sessions=10, timeout_seconds=21_600)
