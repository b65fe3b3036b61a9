"""Report documents: one JSON text per repo and part.

A document is a single value, so it may only hold a bounded number of rows. Rows are spread over
``ceil(rows / per_document)`` parts by hash; small repos get exactly one part, a huge repo many,
and no row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JSON = {"ignoreNullFields": "false"}
TOOL = "codequarry"


def _parts(rows: DataFrame, spread: list[str], per_document: int) -> DataFrame:
    counts = rows.groupBy("repo").agg(F.ceil(F.count("*") / per_document).cast("bigint").alias("parts"))
    return rows.join(counts, "repo").withColumn("part", F.pmod(F.xxhash64(*spread), F.col("parts")))


def sarif(findings: DataFrame, per_document: int = 5_000) -> DataFrame:
    """SARIF 2.1.0 from secret findings (repo, file, line, signature, preview): repo, part, document."""
    c = F.col
    place = F.struct(F.struct(c("file").alias("uri")).alias("artifactLocation"),
                     F.when(c("line").isNotNull(), F.struct(c("line").alias("startLine"))).alias("region"))
    result = F.struct(c("signature").alias("ruleId"), F.lit("warning").alias("level"),
                      F.struct(c("preview").alias("text")).alias("message"),
                      F.array(F.struct(place.alias("physicalLocation"))).alias("locations"))
    rule = lambda s: F.struct(
        s.alias("id"), F.initcap(F.translate(s, "-", " ")).alias("name"),
        F.struct(F.concat(F.lit("Secret signature detected ("), s, F.lit("); value redacted.")).alias("text")).alias("shortDescription"))
    ordered = F.struct("file", F.coalesce("line", F.lit(0)).alias("l"), result.alias("r"))
    per = _parts(findings, ["file", "line"], per_document).groupBy("repo", "part").agg(
        F.array_sort(F.collect_list(ordered)).alias("rs"))
    results = F.transform("rs", lambda x: x["r"])
    rules = F.transform(F.array_distinct(F.transform(results, lambda r: r["ruleId"])), rule)
    run = F.struct(F.struct(F.struct(F.lit(TOOL).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"),
                   results.alias("results"))
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"),
                   F.array(run).alias("runs"))
    return per.select("repo", "part", F.to_json(doc).alias("document"))  # null fields (no line) left out


def sbom(components: DataFrame, per_document: int = 5_000, timestamp: Column | None = None) -> DataFrame:
    """CycloneDX 1.4 from component rows: repo, part, component_count, document."""
    now = timestamp if timestamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    entry = F.struct("type", "name", "version", "scope", "ecosystem", "manifest")
    per = _parts(components, ["manifest", "pos"], per_document).groupBy("repo", "part").agg(
        F.array_sort(F.collect_list(F.struct("manifest", "pos", entry.alias("e")))).alias("es"))
    app = F.struct(F.lit("application").alias("type"), F.col("repo").alias("name"), F.lit("unknown").alias("version"))
    doc = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.4").alias("specVersion"),
        F.concat(F.lit("urn:uuid:"), F.uuid()).alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(now.alias("timestamp"), app.alias("component"),
                 F.array(F.struct(F.lit(TOOL).alias("name"))).alias("tools")).alias("metadata"),
        F.transform("es", lambda x: x["e"]).alias("components"))
    return per.select("repo", "part", F.size("es").alias("component_count"), F.to_json(doc, JSON).alias("document"))


def as_json(df: DataFrame) -> DataFrame:
    """One compact JSON document per row, null fields kept."""
    return df.select(F.to_json(F.struct("*"), JSON).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    as_json(df).write.mode(mode).text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only log (audit entries, session records); ``pos`` keeps the order."""
    if "pos" not in df.columns:
        raise ValueError("a log needs its order column 'pos'")
    df.write.mode("append").parquet(path)
