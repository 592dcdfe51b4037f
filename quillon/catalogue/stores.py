"""Queries of packets, chunks, ordinates, packages, bundles and sinks: they write into the work folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dag, index
from ..registry import query
from ..sources import chunks, ordinates, packages, work
from ..sources.tables import table
from .numeric import edges


def packets(spark, d):
    """Orders as JSON packets, one file each hundredth of them: a broken row or a packet of bare fields among them."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), (F.col("o_orderkey") % 50).alias("file"))
    row = F.struct(
        F.when((F.col("file") == 7) & (F.col("o_orderkey") % 2 == 1), F.lit("1.5")).otherwise(F.col("o_orderkey").cast("string")).alias("ordinal"),
        F.create_map(F.lit("price"), F.col("cents").cast("string"), F.lit("tail_1"), F.lit("1"), F.lit("note"), F.lit("x")).alias("values"),
    )
    whole = o.groupBy("file").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0)).alias("rows"))
    body = F.to_json(F.struct(
        F.lit("measurement").alias("kind"), F.col("file").cast("string").alias("lambda_squared"), F.lit("3").alias("n_modes"), F.lit("64").alias("precision_bits"), F.col("rows"),
    ))
    path = work.fresh(spark, "packets")
    whole.select(body.alias("value"), "file").repartition("file").sortWithinPartitions("file").write.option("maxRecordsPerFile", 1).format("text").partitionBy("file").save(path)
    return path


@query("packet_scan", "SELECT CAST(o_orderkey % 50 AS VARCHAR) AS C, count(*) AS n, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 50 <> 7 OR NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey % 50 = 7 AND x.o_orderkey % 2 = 1) GROUP BY 1")
def packet_scan(spark, d):
    """From files to measurements: a file with one bad ordinal gives nothing, a policy drops indexed names, text is no number."""
    measured, _ = index.scan_packets(spark, packets(spark, d), index.policy("indexed:tail_\nprefix:secret"), glob="*.txt")
    return measured.groupBy("C").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("cents"))


@query("packet_inventory", "SELECT CASE WHEN bad THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN bad THEN 'a row is not valid' END AS reason, count(*) AS files FROM (SELECT o_orderkey % 50 AS f, bool_or(o_orderkey % 50 = 7 AND o_orderkey % 2 = 1) AS bad FROM orders GROUP BY 1) GROUP BY ALL")
def packet_inventory(spark, d):
    _, inventory = index.scan_packets(spark, packets(spark, d), glob="*.txt")
    return inventory.groupBy("status", "reason").agg(F.count("*").alias("files"))


@query("jsonl_write", "WITH r AS (SELECT '{\"key\":' || p_partkey || ',\"size\":' || p_size || '}' || chr(10) AS line, p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 100 AS c FROM part) SELECT printf('chunk-%06d.jsonl', c) AS relative_path, sha256(string_agg(line, '' ORDER BY p_partkey)) AS sha256, CAST(sum(length(line)) AS BIGINT) AS bytes, count(*) AS rows FROM r GROUP BY c")
def jsonl_write(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    return chunks.write(p, work.fresh(spark, "jsonl"), ["key"], 100)


def tampered(spark, d):
    """A folder of chunks and a manifest with a wrong digest, a wrong length, a path out of the folder and a chunk that is not there."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    path = work.fresh(spark, "jsonl")
    m = chunks.write(p, path, ["key"], 100)
    name = F.col("relative_path")
    bad = m.withColumns({
        "sha256": F.when(name == "chunk-000001.jsonl", F.sha2(name, 256)).otherwise(F.col("sha256")),
        "bytes": F.when(name == "chunk-000002.jsonl", F.col("bytes") + 1).otherwise(F.col("bytes")),
        "rows": F.when(name == "chunk-000003.jsonl", F.col("rows") + 1).otherwise(F.col("rows")),
    })
    extra = m.filter(name == "chunk-000000.jsonl").select(F.explode(F.array(F.lit("../chunk-000000.jsonl"), F.lit("absent.jsonl"))).alias("relative_path"), "sha256", "bytes", "rows")
    return chunks.read(spark, path, bad.unionByName(extra), "key long, size int")


@query("jsonl_read", "WITH r AS (SELECT *, (row_number() OVER (ORDER BY p_partkey) - 1) AS p FROM part) SELECT p_partkey AS key, p_size AS size, CAST(p % 100 AS INT) AS ordinal FROM r WHERE p // 100 NOT IN (1, 2, 3)")
def jsonl_read(spark, d):
    """Chunks whose digest, length or row count differ from their manifest give no row."""
    return tampered(spark, d)[0].select("key", "size", "ordinal")


@query("jsonl_refusals", "SELECT * FROM (VALUES ('chunk-000001.jsonl', 'digest_differs'), ('chunk-000002.jsonl', 'length_differs'), ('chunk-000003.jsonl', 'row_count_differs'), ('../chunk-000000.jsonl', 'path_escapes'), ('absent.jsonl', 'missing')) t(relative_path, reason)")
def jsonl_refusals(spark, d):
    return tampered(spark, d)[1]


@query("chunked_table_expansion", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part")
def chunked_table_expansion(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    path = work.fresh(spark, "jsonl")
    rows, _ = chunks.read(spark, path, chunks.write(p, path, ["key"], 500), "key long, size int")
    return chunks.expand(None, rows).agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("total"))


def ordinate_file(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.format_string("%.2f", "s_acctbal").alias("text"))
    return ordinates.write_ordinates(s, work.fresh(spark, "ordinates"), "s_suppkey", "text")


@query("external_ordinates", "SELECT row_number() OVER (ORDER BY s_suppkey) AS ordinal, printf('%.2f', s_acctbal) AS text, s_acctbal AS value, round(s_acctbal, CAST(2 - floor(log10(abs(s_acctbal))) AS INT)) AS short FROM supplier ORDER BY s_suppkey LIMIT 8")
def external_ordinates(spark, d):
    """The first eight of a file: as they stand, as doubles, and at three digits."""
    o = ordinates.ordinates(spark, ordinate_file(spark, d), 8)
    short = chunks.at_digits(o, 3).select("ordinal", F.col("text").cast("double").alias("short"))
    return o.join(chunks.as_doubles(o), "ordinal").join(short, "ordinal").select("ordinal", "text", "value", "short")


@query("dataset_identity", "WITH r AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS o, printf('%.2f', s_acctbal) AS t FROM supplier), b AS (SELECT o // 4096 AS b, sha256(string_agg(o || chr(10) || t, chr(10) ORDER BY o)) AS h, count(*) AS n, min(length(regexp_replace(t, '[^0-9]', '', 'g'))) AS g FROM r GROUP BY 1) SELECT 'balances' AS id, sha256(string_agg(h, '' ORDER BY b)) AS sha256, CAST(sum(n) AS BIGINT) AS count, CAST(min(g) AS INT) AS digits FROM b")
def dataset_identity(spark, d):
    n = table(spark, d, "supplier").count()
    return ordinates.identity(ordinates.ordinates(spark, ordinate_file(spark, d), n), "balances")


# --- Packages


def objects(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.to_json(F.struct("p_name", "p_size")).alias("payload"))


@query("zip_json_store", """SELECT p_partkey AS key, sha256('{"p_name":"' || p_name || '","p_size":' || p_size || '}') AS digest, true AS intact, true AS repeatable FROM part""")
def zip_json_store(spark, d):
    """A member for each payload: read back intact, and the same bytes however often it is packed."""
    one, two = packages.zip_store(objects(spark, d)), packages.zip_store(objects(spark, d).repartition(3))
    back = packages.zip_open(one).select("key", "intact")
    # Sides have as many rows as there are members: merged by shuffle, none is sent to the driver.
    same = one.select("key", "digest", "package_digest").join(two.select("key", F.col("package_digest").alias("again")).hint("merge"), "key")
    return same.join(back.hint("merge"), "key").select("key", "digest", "intact", (F.col("package_digest") == F.col("again")).alias("repeatable"))


@query("deterministic_package", "SELECT p_brand AS brand, count(*) AS members, 22 + sum(76 + 2 * length(CAST(p_partkey AS VARCHAR)) + length(p_name)) AS bytes, true AS repeatable FROM part GROUP BY 1")
def deterministic_package(spark, d):
    """An archive a brand: 30 and 46 bytes of headers a member, 22 at its end, and the same digest for any order of rows."""
    m = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("name"), F.col("p_name").cast("binary").alias("data"))
    one, two = packages.package(m, "brand", "name", "data"), packages.package(m.orderBy(F.desc("name")), "brand", "name", "data")
    both = one.join(two.select("brand", F.col("digest").alias("again")), "brand")
    return both.select("brand", "members", F.octet_length("package").cast("long").alias("bytes"), (F.col("digest") == F.col("again")).alias("repeatable"))


@query("reconstruct_package", "SELECT doc_id AS key, CASE WHEN doc_id % 11 = 3 AND octet_length(encode(text)) > 0 THEN NULL ELSE sha256(text) END AS digest, CASE WHEN doc_id % 11 = 3 AND octet_length(encode(text)) > 0 THEN 'part_digest' END AS problem FROM documents")
def reconstruct_package(spark, d):
    """Texts cut into parts of 4,000 bytes and put together; some parts are spoilt on the way."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    pieces = packages.split(docs, "doc_id", "data", 4000)
    spoilt = pieces.withColumn("part", F.when((F.col("key") % 11 == 3) & (F.col("seq") == 0), F.concat(F.substring("part", 2, 1 << 30), F.lit(b"\0"))).otherwise(F.col("part")))
    return packages.reconstruct(spoilt).select("key", F.sha2("data", 256).alias("digest"), "problem")


def artifacts(spark, d):
    """Every customer, nation and region as an artifact whose payload is its name."""
    of = lambda p, t, k, n: table(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("node"), F.lit(t).alias("kind"), F.col(n).alias("payload"))
    all_ = of("c", "customer", "c_custkey", "c_name").unionByName(of("n", "nation", "n_nationkey", "n_name")).unionByName(of("r", "region", "r_regionkey", "r_name"))
    return all_.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))


def deps(spark, d):
    return edges(spark, d).filter("node NOT LIKE 'o%'")


def rich(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 9000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("root"))


@query("export_bundle", "WITH c AS (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 9000) SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'customer' AS kind, 'c' || c_custkey FROM c UNION SELECT 'nation', 'n' || n_nationkey FROM c UNION SELECT 'region', 'r' || r_regionkey FROM c) GROUP BY 1")
def export_bundle(spark, d):
    members, _ = packages.export_bundle(spark, work.fresh(spark, "bundle"), rich(spark, d), deps(spark, d), artifacts(spark, d))
    return members.groupBy("kind").agg(F.count("*").alias("n"))


@query("export_refused", "SELECT DISTINCT 'r' || r_regionkey AS node, 'missing' AS problem FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 9000 AND r_regionkey >= 3")
def export_refused(spark, d):
    """Without the last regions' artifacts nothing is written, and what is missing is told."""
    some = artifacts(spark, d).filter("NOT (kind = 'region' AND node >= 'r3')")
    return packages.export_bundle(spark, work.fresh(spark, "bundle"), rich(spark, d), deps(spark, d), some)[1]


@query("verify_bundle", "WITH c AS (SELECT DISTINCT n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000) SELECT 'n' || n_nationkey AS node, 'digest_differs' AS problem FROM c WHERE n_nationkey % 4 = 1")
def verify_bundle(spark, d):
    """Payloads of some nations are not those of their digests."""
    wrong = artifacts(spark, d).withColumn("payload", F.when(F.col("kind").eqNullSafe("nation") & (F.substring("node", 2, 9).cast("int") % 4 == 1), F.lit("?")).otherwise(F.col("payload")))
    path = work.fresh(spark, "bundle")
    packages.export_bundle(spark, path, rich(spark, d), deps(spark, d), wrong)
    return packages.verify_bundle(spark, path)


@query("consume_bundle", "SELECT r_name AS payload, 'region' AS kind FROM region WHERE r_regionkey = 1")
def consume_bundle(spark, d):
    path = work.fresh(spark, "bundle")
    packages.export_bundle(spark, path, rich(spark, d), deps(spark, d), artifacts(spark, d))
    return packages.consume(spark, path, "r1", F.col("kind").isin("region", "nation")).select("payload", "kind")


@query("fetch_closure", "WITH c AS (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000) SELECT DISTINCT 'c' || c_custkey AS node FROM c UNION SELECT 'r' || n_regionkey FROM c")
def fetch_closure(spark, d):
    """All of the closure but the nations, which are here already."""
    a = artifacts(spark, d)
    return packages.fetch_closure(deps(spark, d), rich(spark, d), a.select("node", "digest"), a.filter("kind = 'nation'")).select("node")


# --- Sinks


@query("publish_table", """WITH t AS (SELECT p_brand AS brand, p_type AS type, count(*) AS n, min(p_size) AS least FROM part GROUP BY 1, 2), l AS (
 SELECT 'csv' AS format, CASE WHEN regexp_matches(brand, '[",\n\r]') THEN '"' || replace(brand, '"', '""') || '"' ELSE brand END || ',' || type || ',' || n || ',' || least AS line FROM t
 UNION ALL SELECT 'latex', replace(replace(brand, '#', '\\#'), '_', '\\_') || ' & ' || type || ' & ' || n || ' & ' || least || ' \\\\' FROM t
 UNION ALL SELECT 'json', '{"brand":"' || brand || '","type":"' || type || '","n":' || n || ',"least":' || least || '}' FROM t)
 SELECT format, 'parts' AS title, count(*) AS lines, CAST(sum(CAST('0x' || substr(sha256(line), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM l GROUP BY 1""")
def publish_table(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(F.count("*").alias("n"), F.min("p_size").alias("least"))
    return packages.publish(p, work.fresh(spark, "publication"), "parts")


@query("archive_plan", "SELECT sha256(text) AS digest, count(*) AS names, CAST(max(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents WHERE lang = 'en' GROUP BY 1")
def archive_plan(spark, d):
    docs = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    return packages.deposit_plan(docs, F.col("lang") == "en")


@query("archive_inventory", "SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'unexpected' ELSE 'digest' END AS problem FROM documents WHERE doc_id % 10 IN (1, 2, 3)")
def archive_inventory(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    observed = docs.filter("doc_id % 10 <> 1").withColumn("digest", F.when(F.col("doc_id") % 10 == 3, "other").otherwise(F.col("digest")))
    return packages.inventory_problems(docs.filter("doc_id % 10 <> 2"), observed, "doc_id", "digest")


@query("compact_export", """SELECT p_partkey AS id, '{"size":"' || p_size || '"}' AS json FROM part""")
def compact_export(spark, d):
    values = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("trace_1"), F.lit("1"), F.lit("raw"), F.col("p_name"))
    return packages.compact(table(spark, d, "part").select(F.col("p_partkey").alias("id"), values.alias("v")), ["id"], "v", ["trace_", "raw"])
