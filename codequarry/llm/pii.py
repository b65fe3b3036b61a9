"""Personal data by pattern, and the words that would give it away.

Pattern matches are the protected entities. Over the whole corpus, co-occurrence tells how much a word reveals of an entity:
the share of the entity's information that the word carries, PMI(entity; word) / IC(entity), with IC = -log p and p the share of
documents. It is 1 for a word found only next to the entity. Words above ``threshold`` are spans too in the entity's documents, if
they were seen with the entity in ``support`` documents that are no copies of each other, or if chance would hardly bring so many
together (``CHANCE``). Most entities stand in one or two documents, so what they share is scored as well: the e-mail domain, the
network, the first digits, the parts of the name in an address. One document is no evidence for any of its many words, but it is for
the one word that the address itself names. Sanitising generalises matches to their kind and takes disclosing words out.

Everything is built-in expressions. Matches and the text between them come out of one anchored pattern, so that positions are running
sums of lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, stored

# Kinds in order, and what a match looks like. A match starts where the one before it ended or where its first run of
# characters does; a later start inside that run could only match if the earlier one had.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
WORD = r"\p{L}{4,}"
TERM = "term"
# a word counts as disclosing if so many documents together have at most this probability, over all words tried for a group
CHANCE = 0.01
NAME, OUTSIDE = "name:", "outside"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, and its digits added."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10)).cast("int"))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(digits)
    return (F.when(kind == "email", True).when(kind == "ip", small)
            .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False)).otherwise(n.between(8, 15)))


def _matches(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Array of (characters before it since the last match, match)."""
    anchored = F.lit(rf"(?s)\G(.*?)({pattern})")
    pairs = F.arrays_zip(F.regexp_extract_all(text, anchored, F.lit(1)).alias("gap"), F.regexp_extract_all(text, anchored, F.lit(2)).alias("value"))
    pairs = F.transform(pairs, lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["value"].alias("value")))
    return pairs if hint is None else F.when(text.rlike(hint), pairs)


def _placed(items: DataFrame) -> DataFrame:
    """(doc_id, tag, kind, start, end, value) from rows (doc_id, tag, kind, pairs); each document's pairs are added up on their own."""
    each = items.select("doc_id", "tag", "kind", F.posexplode("pairs").alias("i", "p"))
    size = F.col("p.gap") + F.length("p.value")
    end = F.sum(size).over(Window.partitionBy("doc_id", "tag", "kind").orderBy("i")).cast("bigint")
    return each.select("doc_id", "tag", "kind", (end - F.length("p.value")).alias("start"), end.alias("end"), F.col("p.value").alias("value"))


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.9, support: int = 3) -> DataFrame:
    """(doc_id, tag, kind, start, end): every span, start and end in code points, end exclusive. ``tag`` is a hash of the text, which
    tells rows of one key apart; equal rows share their spans."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("tag"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    may = F.lit(False)
    for kind in KINDS:
        may = may | t.rlike(HINTS[kind])
    found = rows.filter(may).select("doc_id", "tag", *(_matches(t, PATTERNS[k], HINTS[k]).alias(k) for k in KINDS), _matches(t, WORD).alias(TERM),
                                    F.regexp_extract_all(F.lower(_outside(t)), F.lit(WORD), F.lit(0)).alias(OUTSIDE))
    held = stored(found.groupBy("doc_id", "tag").agg(*(F.first(c).alias(c) for c in (*KINDS, TERM, OUTSIDE))), "entities")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("pairs")) for k in KINDS))
    by_kind = held.select("doc_id", "tag", F.explode(kinds).alias("k")).select("doc_id", "tag", "k.kind", "k.pairs").filter(F.size("pairs") > 0)
    base = stored(_placed(by_kind).filter(_holds(F.col("kind"), F.col("value"))), "base")
    words = _disclosing(rows, held, base, threshold, support)
    return base.select("doc_id", "tag", "kind", "start", "end").union(words)


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by document; a null doc_id is a value like others."""
    right = right.withColumnRenamed("doc_id", "_d").withColumnRenamed("tag", "_t")
    out = left.join(right, left["doc_id"].eqNullSafe(right["_d"]) & left["tag"].eqNullSafe(right["_t"]), how)
    return out.drop("_d", "_t") if how in ("inner", "left") else out


def _outside(text: Column) -> Column:
    """The text without its e-mails, the only matches with letters: a name inside an address is no evidence of the name."""
    return F.when(text.rlike(HINTS["email"]), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)


def _groups(kind: Column, value: Column) -> Column:
    """What an entity is counted under: itself, and what it shares with others."""
    low, digits = F.lower(value), _digits(value)
    entity = F.concat(kind, F.lit(":"), F.when(kind == "email", low).otherwise(digits))
    parts = F.regexp_extract_all(F.substring_index(low, "@", 1), F.lit(WORD), F.lit(0))
    shared = (F.when(kind == "email", F.concat(F.array(F.concat(F.lit("domain:"), F.substring_index(low, "@", -1))),
                                               F.transform(parts, lambda p: F.concat(F.lit(NAME), p))))
              .when(kind == "ip", F.array(F.concat(F.lit("net:"), F.substring_index(value, ".", 3))))
              .when(kind == "card", F.array(F.concat(F.lit("issuer:"), F.substring(digits, 1, 6))))
              .otherwise(F.array(F.concat(F.lit("area:"), F.substring(digits, 1, 4)))))
    return F.concat(F.array(entity), shared)


def _ways(n: Column, k: Column) -> Column:
    """Upper bound of the logarithm of n over k."""
    x = lambda v: F.when(v > 0, v * F.log(v.cast("double"))).otherwise(0.0)
    return x(n) - x(k) - x(n - k)


def _disclosing(rows: DataFrame, held: DataFrame, base: DataFrame, threshold: float, support: int) -> DataFrame:
    where = base.select("doc_id", "tag", F.explode(_groups(F.col("kind"), F.col("value"))).alias("group")).distinct()
    # copies and near copies of a document tend to share the least hash of three words in a row, and are one witness
    triples = F.transform(F.arrays_zip(F.col("terms").alias("a"), F.slice("terms", F.lit(2), F.size("terms")).alias("b"), F.slice("terms", F.lit(3), F.size("terms")).alias("c")),
                          lambda t: F.when(t["c"].isNotNull(), F.xxhash64(t["a"], t["b"], t["c"])))
    lower = held.select("doc_id", "tag", F.col(OUTSIDE).alias("terms"))
    lower = lower.select("doc_id", "tag", F.coalesce(F.array_min(triples), F.col("tag")).alias("sketch"), F.array_distinct("terms").alias("terms"))
    often = where.groupBy("group").agg(F.count("*").alias("n_group"))
    # words of a group of one document are never told from chance, but for the name itself
    named = F.array_intersect("terms", F.array(F.expr(f"substring(group, {len(NAME) + 1})")))
    tried = F.when(F.col("n_group") > 1, F.col("terms")).when(F.col("group").startswith(NAME), named).otherwise(F.array().cast("array<string>"))
    asked = where.join(often, "group").filter((F.col("n_group") > 1) | F.col("group").startswith(NAME))
    contexts = stored(_same(asked, lower).select("doc_id", "tag", "group", "n_group", "sketch", tried.alias("terms")).filter(F.size("terms") > 0), "contexts")
    words = contexts.groupBy("group").agg(F.first("n_group").alias("n_group"), F.sum(F.size("terms")).alias("n_tried"))
    pairs = (contexts.select("group", "sketch", F.explode("terms").alias("term"))
             .groupBy("group", "term", "sketch").agg(F.count("*").alias("c"))
             .groupBy("group", "term").agg(F.sum("c").alias("n_both"), F.count("*").alias("witnesses")))
    is_name = F.col("group") == F.concat(F.lit(NAME), F.col("term"))
    everywhere = (rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(_outside(F.col("t"))), F.lit(WORD), F.lit(0)))).alias("term"))
                  .groupBy("term").agg(F.count("*").alias("n_term")))
    total = rows.agg(F.count("*").cast("double").alias("total"))
    p_group = F.col("n_group") / F.col("total")
    pmi = F.log((F.col("n_both") / F.least("n_term", "total")) / p_group)
    # a word is tried because a document of the group has it, so that one says nothing; a name is tried because of the address
    given = F.when(is_name, 0).otherwise(1)
    k = F.col("witnesses") - given
    n = k + F.greatest(F.col("n_term") - F.col("n_both"), F.lit(0))
    chance = F.when(is_name, 0.0).otherwise(F.log(F.col("n_tried").cast("double"))) + _ways(n, k) + k * F.log(p_group)
    entity = F.substring_index("group", ":", 1).isin(*KINDS)
    sure = (entity & (F.col("witnesses") >= support)) | (chance <= F.log(F.lit(CHANCE)))
    strong = (pairs.filter(is_name | (F.col("witnesses") > 1)).join(words, "group").join(everywhere, "term").join(F.broadcast(total))
              .filter((p_group < 1) & (pmi / -F.log(p_group) >= threshold) & sure).select("group", "term"))
    # by group and word: every document of a group times every word of it would be far more
    reveals = stored(contexts.select("doc_id", "tag", "group", F.explode("terms").alias("term")).join(strong, ["group", "term"])
                     .select("doc_id", "tag", "term").distinct(), "reveals")
    mine = reveals.groupBy("doc_id", "tag").agg(F.collect_set("term").alias("mine"))
    items = _same(held.select("doc_id", "tag", F.lit(TERM).alias("kind"), F.col(TERM).alias("pairs")), mine)
    # running sums need every word; then only the disclosing ones stay, outside the pattern matches
    placed = _placed(items.select("doc_id", "tag", "kind", "pairs")).withColumn("term", F.lower("value"))
    r = reveals.select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), F.col("term").alias("_w"))
    words = placed.join(r, placed["doc_id"].eqNullSafe(r["_d"]) & placed["tag"].eqNullSafe(r["_t"]) & (placed["term"] == r["_w"])).drop("_d", "_t", "_w")
    b = base.select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    free = words.join(b, words["doc_id"].eqNullSafe(b["_d"]) & words["tag"].eqNullSafe(b["_t"]) & (b["_s"] < words["end"]) & (words["start"] < b["_e"]), "left_anti")
    return free.select("doc_id", "tag", "kind", "start", "end")


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """One row per input row: ``key`` and ``spans``, an array of (kind, start, end) by kind as in KINDS, disclosing words last, then by
    start. A null or blank text has none; a null key is kept; equal rows have equal spans. Other columns are not looked at."""
    found = _collected(spans(docs, text, key, **settings))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("tag"))
    return _same(rows, found, "left").select(F.col("doc_id").alias(key), F.coalesce("spans", F.array().cast("array<struct<at:int,start:bigint,end:bigint,kind:string>>")).alias("spans"))


def _collected(found: DataFrame) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, (*KINDS, TERM))), F.col("kind")).cast("int")
    return found.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "start", "end", "kind"))).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """The same rows and columns; in ``text`` each match is replaced by its kind in angle brackets and each disclosing word is removed.
    Overlapping matches are one, named after the first. Texts without spans are unchanged, nulls too."""
    found = _collected(spans(docs, text, key, **settings)).select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), F.col("spans").alias("_spans"))
    rows = docs.withColumn("_tag", F.xxhash64(F.col(text).cast("string")))
    joined = rows.join(found, rows[key].cast("bigint").eqNullSafe(F.col("_d")) & rows["_tag"].eqNullSafe(F.col("_t")), "left")
    by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.lit(0).cast("bigint")
    # (end so far, pieces): the text up to each span, then what stands for it
    folded = F.aggregate(by_start, F.struct(empty.alias("end"), F.array().cast("array<string>").alias("out")), lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        F.when(s["start"] >= a["end"], F.concat(a["out"], F.array(
            F.substring(F.col(text), (a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int")),
            F.when(s["kind"] == TERM, F.lit("")).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))))).otherwise(a["out"]).alias("out")))
    clean = F.concat(F.array_join(folded["out"], ""), F.substring(F.col(text), (folded["end"] + 1).cast("int"), F.length(text)))
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(clean)).drop("_tag", "_d", "_t", "_spans")
