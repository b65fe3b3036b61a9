"""Queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, forest, licenses, mixing, ngram_join, pii, quality, simhash, substring_dedup, token_files, topk, vector_codes
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
   ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
 r AS (SELECT DISTINCT x AS doc_id, x AS y FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.y), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id""")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return back.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query(r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM d GROUP BY source),
 r AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(source_size) OVER b, 0) AS stopped, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open_w,
   row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place
   FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, source_size * 4 * open_w < (3 * total - 4 * stopped) * w AS capped FROM r),
 f AS (SELECT 3 * total - 4 * stopped AS rest, open_w FROM c WHERE NOT capped ORDER BY place LIMIT 1),
 g AS (SELECT source, source_size, CASE WHEN capped THEN CAST(source_size * 2 AS DOUBLE) ELSE CAST(w * f.rest AS DOUBLE) / CAST(f.open_w * 2 AS DOUBLE) END AS target FROM c, f),
 j AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS n,
   sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
 CAST(size * (n + CASE WHEN n < 2 AND upto <= target - n * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j""")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
 f AS (SELECT w, min(doc_id) AS first FROM win GROUP BY w),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (w) WHERE first < doc_id),
 g AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
 k AS (SELECT g.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY g.p) FILTER (WHERE gone.p IS NULL) AS kept
  FROM g LEFT JOIN gone ON gone.doc_id = g.doc_id AND gone.p = g.p GROUP BY g.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != pii.TERM)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(F.encode(pii.listed(base), "UTF-8"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query(r"""WITH k(known, license) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in licenses.KNOWN.items()) + r"""),
 d AS (SELECT row_number() OVER () AS i, doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)),
   lambda x: NOT regexp_matches(x, '^[\x20\x09#*/;-]*(copyright|\(c\)|©)[^\n]*[0-9]{4}')) AS ls FROM documents),
 c AS (SELECT i, doc_id, ls, sha256(trim(regexp_replace(array_to_string(ls, chr(10)), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'))) AS digest FROM d),
 l AS (SELECT DISTINCT i, license FROM (SELECT i, sha256(trim(regexp_replace(unnest(ls), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'))) AS known FROM c) JOIN k USING (known)),
 g AS (SELECT i, string_agg(license, ',' ORDER BY license) AS line_licenses FROM l GROUP BY i)
SELECT doc_id, digest, license AS whole_license, coalesce(line_licenses, '') AS line_licenses FROM c LEFT JOIN k ON k.known = c.digest LEFT JOIN g USING (i)""")
def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda t: t[1] * t[2])) AS BIGINT) AS score
   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


@query()
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


_CLOSED = """list_transform(list_transform([{n}], lambda n: {{'z': n.z, 's': n.s, 'u': list_min([n.u, {{'c': n.z.c + 3, 'a': n.z.a || 'I'}}, {{'c': n.s.c + 3, 'a': n.s.a || 'I'}}, {{'c': n.t.c + 3, 'a': n.t.a || 'I'}}]), 't': n.t}}),
     lambda n: {{'z': n.z, 's': n.s, 'u': n.u, 't': list_min([n.t, {{'c': n.u.c + 3, 'a': n.u.a || 'I'}}])}})[1]"""
_STEP = """{'z': {'c': p.z.c + 4, 'a': p.z.a || 'D'},
   's': list_min([{'c': p.s.c + 4, 'a': p.s.a || 'D'}, {'c': CASE WHEN k.k = 's' THEN p.z.c + k.m ELSE 1000000000 END, 'a': p.z.a || 'K'}]),
   'u': list_min(list_append(list_transform([p.z, p.s, p.t], lambda q: {'c': CASE k.k WHEN 'D' THEN 1000000000 WHEN 'u' THEN q.c + k.m ELSE q.c + 3 + k.m END, 'a': q.a || CASE k.k WHEN 'u' THEN 'K' ELSE 'R' END}), {'c': p.u.c + 4, 'a': p.u.a || 'D'})),
   't': list_min([{'c': CASE k.k WHEN 'D' THEN 1000000000 WHEN 'a' THEN p.u.c + k.m ELSE p.u.c + 3 + k.m END, 'a': p.u.a || CASE k.k WHEN 'a' THEN 'K' ELSE 'R' END}, {'c': p.t.c + 4, 'a': p.t.a || 'D'}])}"""
_FIRST = "{'z': {'c': 0::BIGINT, 'a': ''}, 's': {'c': 1000000000::BIGINT, 'a': ''}, 'u': {'c': 3::BIGINT, 'a': 'I'}, 't': {'c': 6::BIGINT, 'a': 'II'}}"


@query(r"""WITH r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295::BIGINT, list_reduce(
   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
   lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END), xor(c, b)), 4294967295::BIGINT)) % 20 AS fate FROM conversations),
 d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
   FROM (SELECT *, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) FROM r WHERE fate <> 0)),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
 f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS two FROM o),
 c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
   count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal,
   list({'k': CASE WHEN fault IN ('blank', 'duplicate') THEN 'D' ELSE role[1:1] END, 'm': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END} ORDER BY i) AS ks, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts FROM f GROUP BY conv_id),
 w AS (SELECT * EXCLUDE (x), list_min([x.z, x.t]) AS best FROM (SELECT *, list_reduce(ks, lambda p, k: """ + _CLOSED.format(n=_STEP) + ", " + _FIRST + r""") AS x FROM c)),
 e AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER v AS pos, count(*) FILTER (WHERE edit <> 'D') OVER v AS q FROM
   (SELECT conv_id, roles, texts, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS j FROM w) WINDOW v AS (PARTITION BY conv_id ORDER BY j)),
 g AS (SELECT *, q - max(CASE WHEN q = 1 AND edit = 'K' AND roles[pos][1:1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS n FROM e),
 t AS (SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN roles[pos] ELSE CASE WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE texts[pos] END, chr(10) ORDER BY j)
   FILTER (WHERE edit <> 'D') AS lines FROM g GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id""")
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_report(table(spark, sf_dir, "conversations"))


@query(r"""WITH v AS (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT i, part, x[part * (len(x) // 16) + 1:(part + 1) * (len(x) // 16)] AS s FROM v, range(16) t(part)),
 f AS (SELECT i, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM v ORDER BY vec_id NULLS LAST, x LIMIT 64),
 c0 AS (SELECT part, e, s FROM p JOIN f USING (i)),
 a0 AS (SELECT i, p.part, any_value(p.s) AS s, min({'d': CAST(list_sum(list_transform(list_zip(p.s, c.s), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT), 'e': e}) AS m FROM p JOIN c0 c USING (part) GROUP BY i, p.part),
 u0 AS (SELECT part, e, list(x ORDER BY j) AS s FROM (SELECT part, m.e AS e, j, CAST(floor(CAST(sum(s[j]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a0, range(1, len(s) + 1) t(j) GROUP BY part, m.e, j) GROUP BY part, e),
 c1 AS (SELECT part, e, coalesce(u0.s, c0.s) AS s FROM c0 LEFT JOIN u0 USING (part, e)),
 a1 AS (SELECT i, p.part, any_value(p.s) AS s, min({'d': CAST(list_sum(list_transform(list_zip(p.s, c.s), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT), 'e': e}) AS m FROM p JOIN c1 c USING (part) GROUP BY i, p.part),
 u1 AS (SELECT part, e, list(x ORDER BY j) AS s FROM (SELECT part, m.e AS e, j, CAST(floor(CAST(sum(s[j]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a1, range(1, len(s) + 1) t(j) GROUP BY part, m.e, j) GROUP BY part, e),
 c2 AS (SELECT part, e, coalesce(u1.s, c1.s) AS s FROM c1 LEFT JOIN u1 USING (part, e)),
 a2 AS (SELECT i, p.part, min({'d': CAST(list_sum(list_transform(list_zip(p.s, c.s), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT), 'e': e}) AS m FROM p JOIN c2 c USING (part) GROUP BY i, p.part),
 r AS (SELECT i, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, e)) FROM c2) AS codebooks_sha256 FROM v JOIN r USING (i)""")
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digests = F.lit(None).cast("string")
    for length, entries in books.items():
        digests = F.when(F.col("length") == length, vector_codes.digest(entries)).otherwise(digests)
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digests.alias("codebooks_sha256"))
