"""Sources and sinks: tables written to the shared folder by a sink and read back by a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import vector
from tallyloom.sources import bundles, digests, passes, readers, sinks
from tallyloom.sources.readers import table
from tallyloom.sources.staging import fresh

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark)
    sinks.write_csv(table(spark, sf_dir, "supplier"), path, ["s_suppkey", "s_name", "s_nationkey"])
    return spark.read.csv(path, header=True, schema="s_suppkey long, s_name string, s_nationkey int")


@query("SELECT '1' AS module, 'Q' || p_partkey AS qid, p_name || ', \"' || p_type || '\"' || chr(10) || p_brand AS text FROM part")
def codebook_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook without header, with commas, quotes and line ends inside its wordings."""
    path = fresh(spark)
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit(" Q"), F.col("p_partkey").cast("string"), F.lit(" ")), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"\n'), "p_brand"))
    rows.write.csv(path, header=False, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.codebook(spark, path, "1").select("module", "qid", "text")


@query("SELECT p_brand AS key, count(*) AS n, 'v1' AS version FROM part GROUP BY p_brand")
def dictionary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON artefact of entries and a version, which must be the one expected."""
    path = fresh(spark)
    entries = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_json(entries.agg(F.lit("v1").alias("version"), F.collect_list(F.struct("key", "n")).alias("entries")).coalesce(1), path)  # some tens of entries
    got, meta = readers.dictionary(spark, path)
    return got.select("key", "n").crossJoin(F.broadcast(readers.expect(meta, "version", "v1").select("version")))  # one row


@query("SELECT event_id, event_type AS tool, value AS ms FROM events UNION ALL SELECT event_id, event_type, value FROM events WHERE value < 50")
def log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines, appended to twice."""
    path = fresh(spark)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"), F.col("value").alias("ms"))
    sinks.append_log(rows, path)
    sinks.append_log(rows.where("ms < 50"), path)
    return readers.json_lines(spark, path, "event_id long, tool string, ms double")


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '2-HIGH' THEN 'again' ELSE 'first' END AS pass FROM orders")
def shard_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of orders, of which one is written again and replaced alone."""
    path = fresh(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    sinks.write_shards(rows.withColumn("pass", F.lit("first")), path, "o_orderpriority")
    sinks.write_shards(rows.where("o_orderpriority = '2-HIGH'").withColumn("pass", F.lit("again")), path, "o_orderpriority")
    return spark.read.option("basePath", path).parquet(path).select("o_orderkey", "o_orderpriority", "pass")


@query("SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 AS remade FROM orders")
def resumed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broken pass that is resumed: what is missing or malformed is made again, and replaces what was there."""
    path = fresh(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    sinks.resume(rows.where("o_orderkey % 2 = 1"), path, "o_orderkey", lambda d: d.select("o_orderkey", F.lit(False).alias("remade"), (F.col("o_orderkey") % 3 != 0).alias("ok")))
    sinks.resume(rows, path, "o_orderkey", lambda d: d.select("o_orderkey", F.lit(True).alias("remade"), F.lit(True).alias("ok")), F.col("ok"))
    return sinks.resumed(spark, path, "o_orderkey").select("o_orderkey", "remade")


@query("SELECT o_custkey, count(*) - 1 AS parked FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def parked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every customer's orders all but the best are parked, in a folder for each priority."""
    from tallyloom.operators import records

    path = fresh(spark)
    placed = records.selected(table(spark, sf_dir, "orders"), "o_custkey", F.desc("o_totalprice"), F.col("o_orderkey"))
    sinks.park(placed.where("place > 1").select("o_custkey", "o_orderkey", "o_orderpriority"), path, "o_orderpriority")
    stored = spark.read.option("basePath", path).schema("o_custkey long, o_orderkey long, o_orderpriority string").json(path)
    return stored.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("parked"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0 ORDER BY 1")
def record_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON records, of which only those with the right tag are read."""
    path = fresh(spark)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "record/1").otherwise("other/1").alias("schema"))
    rows.repartition(25, "n_nationkey").write.option("maxRecordsPerFile", 1).json(path)
    return readers.json_records(spark, path, "record/1").select("n_nationkey")


@query("SELECT 'r' || r_regionkey AS name, r_name || ' convention' AS content FROM region")
def named_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by the stem of their file: conventions by topic, and signed derivations by id."""
    path = fresh(spark)
    for r in table(spark, sf_dir, "region").collect():  # five rows, a file each
        _put(spark, f"{path}/r{r.r_regionkey}.md", f"{r.r_name} convention".encode())
    return readers.named_documents(spark, path)


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(content)
    out.close()


@query("SELECT 'r' || r_regionkey || '.txt' AS file, CASE r_regionkey WHEN 0 THEN 'changed' WHEN 1 THEN 'not listed' ELSE 'ok' END AS state FROM region UNION ALL SELECT 'gone.txt', 'missing'")
def bundle_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle against its manifest: one file was tampered with, one is not listed, one is missing."""
    path = fresh(spark)
    region = table(spark, sf_dir, "region")
    for r in region.collect():  # five rows, a file each
        _put(spark, f"{path}/r{r.r_regionkey}.txt", (r.r_name + ("!" if r.r_regionkey == 0 else "")).encode())
    name = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".txt"))
    listed = sinks.manifest(region.where("r_regionkey <> 1"), name, F.col("r_name")).select("file", F.col("sha256").alias("want"))
    want = listed.union(spark.createDataFrame([("gone.txt", "0")], "file string, want string"))
    return readers.bundle_check(spark, path, want).select("file", "state")


_WEIGHT = "(((i * 7 + j * 3) % 11) - 5) / 8.0"


@query(
    f"""WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  a AS (SELECT key, [list_sum([v[j + 1] * {_WEIGHT} for j in range(64)]) for i in range(16)] AS v FROM v),
  b AS (SELECT key, [list_sum([v[j + 1] * {_WEIGHT} for j in range(16)]) for i in range(4)] AS v FROM a)
SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS row, key, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first, round(v[4] / sqrt(list_dot_product(v, v)), 5) AS last FROM b"""
)
def projected_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written as a raw bundle with their keys, read back, and sent through two dense projections that are
    bundles themselves."""
    path = fresh(spark)
    bundles.write_bundle(table(spark, sf_dir, "embeddings"), f"{path}/vectors", "vec_id", "embedding")
    for name, rows, width in (("first", 16, 64), ("second", 4, 16)):
        grid = spark.range(rows).select(F.format_string("%05d", "id").alias("key"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: (((F.col("id") * 7 + j * 3) % 11) - 5) / 8).alias("w"))
        bundles.write_bundle(grid, f"{path}/{name}", "key", "w")
    weights = bundles.layers(spark, f"{path}/first", f"{path}/second")
    out = vector.project(bundles.read_bundle(spark, f"{path}/vectors"), "vec", weights)
    return out.select("row", "key", F.round(F.col("projected")[0], 5).alias("first"), F.round(F.col("projected")[3], 5).alias("last"))


_ROW = """'{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '","p_size":' || p_size || '}'"""


@query(
    f"""WITH h AS (SELECT sha256({_ROW}) AS h, row_number() OVER (ORDER BY p_partkey, p_brand, p_size) - 1 AS i FROM part),
  leaf AS (SELECT i // 256 AS node, sha256(string_agg(h, '' ORDER BY i)) AS d, count(*) AS n FROM h GROUP BY 1)
SELECT substr(CASE WHEN count(*) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY node)) END, 1, 12) AS version, CAST(sum(n) AS BIGINT) AS n FROM leaf"""
)
def version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.version_hash(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_size")


@query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // 256 AS node FROM lineitem),
  hit AS (SELECT DISTINCT node FROM i WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem)),
  ends AS (SELECT node, arg_min(l_linenumber, l_orderkey * 1000 + l_linenumber) AS low_line, min(l_orderkey) AS low_order, max(l_orderkey) AS high_order, count(*) AS n FROM i GROUP BY node)
SELECT node, low_order, low_line, high_order, n FROM ends JOIN hit USING (node)"""
)
def changed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is frozen and its last order changed: the ranges of keys in which that lies, out of the trees alone."""
    lines, keys, columns = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    path = fresh(spark)
    digests.freeze(lines, path, keys, columns)
    last = F.broadcast(lines.agg(F.max("l_orderkey").alias("_last")))  # one row
    hit = F.col("l_orderkey") == F.col("_last")
    changed = lines.crossJoin(last).withColumn("l_quantity", F.when(hit, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    found = digests.differing(spark.read.parquet(path), digests.tree(changed, keys, columns))
    return found.select("node", F.col("was.low.l_orderkey").alias("low_order"), F.col("was.low.l_linenumber").alias("low_line"), F.col("was.high.l_orderkey").alias("high_order"), F.col("n_was").alias("n"))


@query(
    """SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 7 <> 3 THEN 'signs: ' || length(text) END AS reply, CASE WHEN conv_id % 7 = 3 THEN 'ValueError: no answer' END AS error,
  CAST(CASE WHEN conv_id % 7 = 3 THEN 3 WHEN turn % 3 = 1 THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM conversations WHERE role = 'user'"""
)
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass over the users' turns with a caller that fails once for some and always for others."""

    def make():
        tried = set()

        def call(row: dict) -> str:
            first = row["id"] not in tried
            tried.add(row["id"])
            if row["conv_id"] % 7 == 3:
                raise ValueError("no answer")
            if first and row["turn"] % 3 == 1:
                raise TimeoutError
            return f"signs: {len(row['text'])}"

        return call

    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "turn", "text")
    return passes.model_pass(turns, fresh(spark), "id", make, every=200)


@query("SELECT c_custkey, c_name FROM customer")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.required(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"])
