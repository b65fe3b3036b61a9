"""Dependency queries. Manifests of at most 100 parts each are written from ``part`` in five
formats; the SQL side computes the expected rows from ``part`` directly, without the texts."""

from pyspark.sql import functions as F

from codequarry.operators import deps
from codequarry.sinks import documents

from .registry import query, table


def manifests(spark, sf_dir):
    """files(repo, path, content, size_bytes): one manifest per brand and 100 part keys."""
    part = table(spark, sf_dir, "part").withColumn("chunk", F.expr("p_partkey div 100")).withColumn(
        "name", F.translate("p_name", " ", "-"))
    size, odd = F.col("p_size").cast("string"), F.col("p_size") % 2 == 1
    named = F.concat("name", F.lit("-"), F.col("p_partkey").cast("string"))
    k, n = F.col("p_size") % 4, F.col("name")
    lines = F.struct(
        F.col("p_partkey").alias("k"), odd.alias("odd"),
        F.when(k == 0, F.concat(n, F.lit("=="), size, F.lit(".0"))).when(k == 1, F.concat(n, F.lit("[extra]>="), size))
        .when(k == 2, n).otherwise(F.concat(F.lit("  "), n, F.lit(" ~= "), size, F.lit("  "))).alias("req"),
        F.concat(F.lit('"'), named, F.lit('":"^'), size, F.lit('.0"')).alias("npm"),
        F.concat(F.lit("ex.com/"), n, F.lit(" v"), size, F.lit(".0.0")).alias("go"),
        F.concat(n, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(' = { version = "'), size, F.lit('" }')))
                 .otherwise(F.concat(F.lit(' = "'), size, F.lit('"')))).alias("cargo"),
        F.concat(F.lit('"'), n, F.lit(">="), size, F.lit('"')).alias("pep"),
        F.concat(n, F.lit(' = "^'), size, F.lit('"')).alias("poetry"))
    grouped = part.groupBy(F.col("p_brand").alias("repo"), "chunk").agg(F.array_sort(F.collect_list(lines)).alias("ls"))

    def joined(field, want=None, sep="\n"):
        rows = F.col("ls") if want is None else F.filter("ls", lambda x: x["odd"] == F.lit(want))
        return F.array_join(F.transform(rows, lambda x: x[field]), sep)

    c = F.col("chunk") % 5
    broken = (c == 1) & (F.col("repo") == "Brand#7")
    text = F.when(c == 0, F.concat(F.lit("# pins\n-r base.txt\n\n"), joined("req"), F.lit("\n"))) \
        .when(broken, F.lit("{broken")) \
        .when(c == 1, F.concat(F.lit('{"name":"x","dependencies":{'), joined("npm", False, ","), F.lit('},"devDependencies":{'), joined("npm", True, ","), F.lit("}}"))) \
        .when(c == 2, F.concat(F.lit("module x\n\nrequire ex.com/first v0.0.1\nrequire (\n\t"), joined("go", None, " // indirect\n\t"), F.lit("\n)\n"))) \
        .when(c == 3, F.concat(F.lit('[package]\nname = "x"\n[dependencies]\n'), joined("cargo", False), F.lit("\n\n[dev-dependencies]\n"), joined("cargo", True), F.lit("\n[profile]\nopt = 3\n"))) \
        .otherwise(F.concat(F.lit('[project]\nname = "x"\ndependencies = [\n  '), joined("pep", False, ",\n  "), F.lit('\n]\n\n[tool.poetry.dependencies]\npython = "^3.9"\n'), joined("poetry", True), F.lit("\n")))
    names = ["requirements.txt", "package.json", "go.mod", "Cargo.toml", "pyproject.toml"]
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (c + 1).cast("int"))
    return grouped.select("repo", F.concat(F.lit("c"), F.col("chunk").cast("string"), F.lit("/"), name).alias("path"),
                          text.alias("content")).withColumn("size_bytes", F.octet_length("content").cast("bigint"))


_EXPECTED = """p AS (SELECT *, p_partkey // 100 AS chunk, (p_partkey // 100) % 5 AS c, replace(p_name, ' ', '-') AS n, p_size % 2 AS odd FROM part),
 f AS (SELECT *, p_brand AS repo, concat('c', chunk, '/', CASE c WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'package.json' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'Cargo.toml' ELSE 'pyproject.toml' END) AS file,
   c = 1 AND p_brand = 'Brand#7' AS broken FROM p),
 d AS (SELECT repo, file, c, CASE c WHEN 1 THEN 'npm' WHEN 2 THEN 'go' WHEN 3 THEN 'cargo' ELSE 'pypi' END AS ecosystem,
   CASE c WHEN 1 THEN concat(n, '-', p_partkey) WHEN 2 THEN concat('ex.com/', n) ELSE n END AS name,
   CASE c WHEN 0 THEN CASE p_size % 4 WHEN 0 THEN concat('==', p_size, '.0') WHEN 1 THEN concat('>=', p_size) WHEN 2 THEN NULL ELSE concat('~= ', p_size) END
     WHEN 1 THEN concat('^', p_size, '.0') WHEN 2 THEN concat('v', p_size, '.0.0') WHEN 3 THEN CASE WHEN p_size % 3 = 0 THEN concat('{ version = "', p_size, '" }') ELSE CAST(p_size AS varchar) END
     ELSE CASE odd WHEN 0 THEN concat('>=', p_size) ELSE concat('^', p_size) END END AS version,
   CASE c WHEN 1 THEN CASE odd WHEN 0 THEN 'dependencies' ELSE 'devDependencies' END END AS scope,
   row_number() OVER (PARTITION BY repo, file ORDER BY CASE WHEN c IN (1, 3, 4) THEN odd ELSE 0 END, p_partkey) - 1 + CASE c WHEN 2 THEN 1 ELSE 0 END AS pos
  FROM f WHERE NOT broken
  UNION ALL SELECT DISTINCT repo, file, c, 'go', 'ex.com/first', 'v0.0.1', NULL, 0 FROM f WHERE c = 2),
 bad AS (SELECT DISTINCT repo, file FROM f WHERE broken)"""


@query(f"WITH {_EXPECTED} SELECT repo, file, ecosystem, pos, name, version, scope FROM d")
def manifest_dependencies(spark, sf_dir):
    return deps.dependencies(deps.parsed_manifests(manifests(spark, sf_dir)))


@query(f"WITH {_EXPECTED} SELECT repo, file, ecosystem, pos, name, version, scope FROM d WHERE pos < 2")
def manifest_dependencies_capped(spark, sf_dir):
    return deps.dependencies(deps.parsed_manifests(manifests(spark, sf_dir)), max_per_manifest=2)


@query(f"WITH {_EXPECTED} SELECT repo, file, ecosystem, CAST(count(*) AS int) AS dependency_count, count(*) > 2 AS dependency_limit_reached FROM d GROUP BY ALL")
def manifest_summary(spark, sf_dir):
    return deps.manifest_summary(deps.parsed_manifests(manifests(spark, sf_dir)), max_per_manifest=2)


@query(f"""WITH {_EXPECTED}, g AS (SELECT repo, count(DISTINCT file) AS manifest_count, count(*) AS total_dependencies,
  count(DISTINCT ecosystem || ':' || lower(name)) AS unique_dependencies FROM d GROUP BY repo),
 e AS (SELECT repo, count(*) AS n FROM bad GROUP BY repo)
SELECT g.repo, manifest_count, coalesce(e.n, 0) AS parse_errors, total_dependencies, unique_dependencies FROM g LEFT JOIN e USING (repo)""")
def dependency_inventory(spark, sf_dir):
    return deps.dependency_inventory(deps.parsed_manifests(manifests(spark, sf_dir)))


@query(f"WITH {_EXPECTED} SELECT repo, file, 'ValueError' AS error FROM bad")
def manifest_errors(spark, sf_dir):
    return deps.parse_errors(deps.parsed_manifests(manifests(spark, sf_dir)))


@query(f"WITH {_EXPECTED} SELECT repo, file AS manifest, pos, 'library' AS type, name, version, coalesce(scope, 'required') AS scope, ecosystem FROM d")
def sbom_components(spark, sf_dir):
    return deps.sbom_components(deps.parsed_manifests(manifests(spark, sf_dir)))


@query(f"WITH {_EXPECTED} SELECT repo, file AS manifest, 'library' AS type, name, version, coalesce(scope, 'required') AS scope, ecosystem FROM d")
def sbom_documents(spark, sf_dir):
    """The documents are written and read back, so that their content is what is compared."""
    docs = documents.sbom(deps.sbom_components(deps.parsed_manifests(manifests(spark, sf_dir))), per_document=50)
    item = "type STRING, name STRING, version STRING, scope STRING, ecosystem STRING, manifest STRING"
    back = F.from_json("document", f"components ARRAY<STRUCT<{item}>>")
    return docs.select("repo", F.explode(back["components"]).alias("c")).select("repo", "c.*")
