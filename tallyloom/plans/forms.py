"""Forms of strings, lists, vectors and replies, bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import dictionary, lookup, records, rubric, seams, vector
from tallyloom.sources.readers import first_seen, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_WS = "[ \\t\\n\\x0B\\f\\r]"


@query(
    f"""WITH u AS (SELECT page_id, url, '  ' || replace(url, '/', ' /' || chr(10)) || ' ' AS s FROM pages)
SELECT page_id, trim(regexp_replace(s, '{_WS}+', ' ', 'g')) AS flat, lower(trim(regexp_replace(regexp_replace(url, '[^\\p{{L}}\\p{{N}}_ ]', ' ', 'g'), ' +', ' ', 'g'))) AS construct,
  'm' || page_id AS arg, regexp_replace(regexp_replace(lower(url || '->X'), '[^a-z0-9.]+', '-', 'g'), '^-+|-+$', '', 'g') AS protocol_id FROM u"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space collapsed, punctuation out of names, a browse argument without its prefix, ids of protocols."""
    pages = table(spark, sf_dir, "pages")
    spaced = F.concat(F.lit("  "), F.replace("url", F.lit("/"), F.lit(" /\n")), F.lit(" "))
    arg = T.browse_arg(F.concat(F.lit(" XM"), F.col("page_id").cast("string"), F.lit(" ")), "x")
    return pages.select("page_id", T.flat(spaced).alias("flat"), T.norm_construct(F.col("url")).alias("construct"), arg.alias("arg"), T.protocol_id(F.concat("url", F.lit("->X"))).alias("protocol_id"))


@query(
    "SELECT p_partkey, key, regexp_matches(key, '^(m[123]|clinical|lab|linked|ehr):[A-Za-z0-9._#-]+(~[0-9]+)?$') AS valid, regexp_matches(key, '^Q[0-9]+(\\.[0-9]+)?(_[0-9]+)?$') AS bare"
    " FROM (SELECT p_partkey, ['m1:Q', 'm4:Q', 'lab:x', 'Q', 'ehr:a b'][p_partkey % 5 + 1] || p_partkey || ['', '~2', '_3', '.1_2'][p_partkey % 4 + 1] AS key FROM part)"
)
def key_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    key = F.concat(pick(("m1:Q", "m4:Q", "lab:x", "Q", "ehr:a b")), k.cast("string"), pick(("", "~2", "_3", ".1_2")))
    rows = table(spark, sf_dir, "part").select("p_partkey", key.alias("key"))
    return rows.select("p_partkey", "key", F.col("key").rlike(T.KEY_PATTERN).alias("valid"), F.col("key").rlike(T.BARE_PATTERN).alias("bare"))


@query("SELECT p_partkey, p_type || '|' || p_brand AS exposures, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS outcomes FROM part")
def design_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms on either side of a design's arrow; a design without one has none on the right."""
    design = F.concat(F.lit(" "), "p_type", F.lit(" / "), "p_brand", F.lit(", "), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-> ,"), "p_name", F.lit(" ,"))).otherwise(""))
    side = lambda i: F.array_join(T.design_terms(design, i), "|")
    return table(spark, sf_dir, "part").select("p_partkey", side(0).alias("exposures"), side(1).alias("outcomes"))


@query(
    "WITH t AS (SELECT p_partkey, p_type AS s, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS o FROM part) SELECT p_partkey, s || ' ' || coalesce(o, s) AS dup, s || coalesce(' ' || o, '') AS plain, s || coalesce(' - ' || o, '') AS dash, s AS verbatim FROM t"
)
def target_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    option = F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", *(T.target_text(F.col("p_type"), option, mode).alias(mode) for mode in ("dup", "plain", "dash", "verbatim")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS fragment FROM part")
def stripped_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to a dozen stacked cues, in marks, ahead of a name or of nothing."""
    cues = F.repeat(F.lit(" **Adjusted for: - including "), (F.col("p_partkey") % 13).cast("int"))
    text = F.concat(F.lit("\t"), cues, F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).otherwise(""), F.lit(" ."))
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_cue(text, r"(?:adjusted for|including)[: ]*").alias("fragment"))


@query("WITH q AS (SELECT p_brand, min(p_type) AS low, max(p_type) AS high FROM part GROUP BY p_brand) SELECT low, high, max(i) AS n FROM q, (SELECT unnest(range(0, 60)) AS i) WHERE i <= least(len(low), len(high)) AND substr(low, 1, i) = substr(high, 1, i) GROUP BY p_brand, low, high")
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_type").alias("low"), F.max("p_type").alias("high"))
    return ends.select("low", "high", F.length(T.common_prefix(F.col("low"), F.col("high"))).cast("long").alias("n"))


@query("SELECT p_partkey, p_brand || '|' || p_type AS kept FROM part")
def deduped_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" "), F.upper("p_brand"), F.col("p_type"), F.lower("p_type"), F.lower("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.dedupe_phrases(items), "|").alias("kept"))


@query("SELECT p_partkey, format('{:d}|{:,}', p_size * 1000 + p_partkey % 1000, p_size * 1000 + p_partkey % 1000) AS sizes, printf('%.1f%%|%.1f|%.3f', p_size::DOUBLE, p_size::DOUBLE, p_size::DOUBLE / 100) AS shares FROM part")
def figure_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with and without commas, approximate ones left out, and the spellings of a share."""
    n = F.col("p_size") * 1000 + F.col("p_partkey") % 1000
    sizes = T.size_tokens(F.concat(F.lit("n = "), F.format_number(n, 0), F.lit(" of ~5,000 and 12")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(sizes, "|").alias("sizes"), F.array_join(T.prevalence_tokens(F.col("p_size") / 100), "|").alias("shares"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'too_vague' WHEN 1 THEN 'no_data' END AS reason FROM customer")
def claimed_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, "REFUSAL: no_data, no: REFUSAL: `Too_Vague`, indeed").when(k == 1, "REFUSAL: no_data").when(k == 2, "REFUSAL: unheard_of").otherwise("nothing")
    return table(spark, sf_dir, "customer").select("c_custkey", T.claimed(said, "REFUSAL:", ["too_vague", "no_data"]).alias("reason"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'draft' WHEN o_custkey % 2 = 0 THEN 'reviewed' ELSE 'ready_for_review' END AS status FROM orders")
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", records.status((F.col("o_orderstatus") == "P").cast("int"), F.col("o_custkey") % 2 == 0).alias("status"))


@query("WITH o AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS i FROM part GROUP BY p_brand) SELECT o_orderkey, p_brand FROM orders JOIN o ON i = o_orderkey % 40 + 1")
def options_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks by number among the brands; those out of range are left out, as when a reply names too large a number."""
    from pyspark.sql import Window

    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    options = brands.withColumn("i", F.row_number().over(Window.orderBy("p_brand")))  # some tens of brands
    picks = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 40 + 1).cast("int").alias("i"))
    return lookup.by_index(options, picks, "i", strict=False).select("o_orderkey", "p_brand")


@query("SELECT a.s_suppkey, array_to_string(list_sort(list(b.s_suppkey)), ',') AS siblings FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY a.s_suppkey")
def sibling_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary.siblings(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")
    return found.select("s_suppkey", F.when(F.size("siblings") > 0, F.array_join("siblings", ",")).alias("siblings"))


@query(
    """WITH e AS (SELECT s_suppkey, s_nationkey % 5 AS a, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 2 END AS b FROM supplier)
SELECT x.s_suppkey, array_to_string(list(y.s_suppkey ORDER BY y.s_suppkey), ',') AS family FROM e x JOIN e y ON x.a = y.a AND x.b IS NOT DISTINCT FROM y.b GROUP BY x.s_suppkey"""
)
def family_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("a"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 2).alias("b"))
    return dictionary.families(rows, ["a", "b"], "s_suppkey", "s_suppkey").select("s_suppkey", F.array_join("family", ",").alias("family"))


@query("SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type")
def first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT n_nationkey, n_name AS wording FROM nation")
def cited_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return lookup.cited(nation.select("n_nationkey"), nation.select("n_nationkey", F.col("n_name").alias("wording")), "n_nationkey", "wording")


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS cls, round(embedding[17]::DOUBLE, 6) AS last, round((embedding[1]::DOUBLE + embedding[17]::DOUBLE) / 2, 6) AS mean FROM embeddings")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's quarters as four tokens, of which the first two are kept."""
    tokens = F.array(*(F.slice("embedding", 1 + 16 * i, 16) for i in range(4)))
    mask = F.array(*(F.lit(int(i < 2)) for i in range(4)))
    one = lambda how: F.round(vector.pooled(tokens, mask, how, 16)[0].cast("double"), 6).alias(how)
    return table(spark, sf_dir, "embeddings").select("vec_id", one("cls"), one("last"), one("mean"))


@query("SELECT round(max(g), 9) AS max_abs_diff, count(*) AS n FROM (SELECT vec_id % 7 / 1000.0::DOUBLE AS g FROM embeddings)")
def vector_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of an encoder that differ in one component."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    other = rows.select("vec_id", F.transform("embedding", lambda x, i: F.when(i == 3, x + F.col("vec_id") % 7 / 1000.0).otherwise(x)).alias("embedding"))
    return vector.parity(rows, other, "vec_id", "embedding").withColumn("max_abs_diff", F.round("max_abs_diff", 9))


@query("SELECT round(avg(x), 6) AS mean, round(avg(x * x), 6) AS square, count(*) AS n FROM (SELECT (e - list_avg(es)) / sqrt(list_avg(list_transform(es, lambda y: (y - list_avg(es)) * (y - list_avg(es)))) + 1e-5) AS x FROM (SELECT es, unnest(es) AS e FROM (SELECT CAST(embedding AS DOUBLE[]) AS es FROM embeddings)))")
def layer_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select(F.explode(vector.layer_norm(F.col("embedding"))).alias("x"))
    return each.agg((F.round(F.avg("x"), 6) + 0.0).alias("mean"), F.round(F.avg(F.col("x") * F.col("x")), 6).alias("square"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'lines_of' AS tool, flag, 'ok' AS outcome, count(l_returnflag) AS rows, CAST(CAST(sum(l_linenumber) AS BIGINT) AS VARCHAR) AS numbers FROM (VALUES ('A'), ('N'), ('R'), ('?')) t(flag) LEFT JOIN lineitem ON l_returnflag = flag GROUP BY flag")
def audited_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of four runs of a tool: what each run itself observed as its rows were written."""
    tools = seams.Registry(spark)

    def lines_of(flag: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select("l_orderkey", "l_linenumber")

    tools.add(lines_of)
    for flag in ("A", "N", "R", "?"):
        tools.run("live", "lines_of", {"numbers": F.sum("l_linenumber")}, flag=flag)
    return tools.log().select("tool", F.col("args.flag").alias("flag"), "outcome", "rows", F.col("metrics.numbers").alias("numbers"))


@query("SELECT a.conv_id, a.turn, b.text AS reply FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'")
def stored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the replies of an earlier pass; those without wait for the next."""
    rows = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    asked = rows.where("role = 'user'").select("conv_id", "turn", key.alias("id"))
    stored = rows.where("role = 'assistant'").select(F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("id"), F.col("text").alias("reply"))
    return seams.replies(asked, stored, "id").drop("id")


@query("SELECT o_orderkey, 'run-7' AS model, o_orderkey % 5 AS seed FROM orders")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model"), F.lit(None).cast("long").alias("seed"))
    return records.identified(said, model=F.lit("run-7"), seed=F.col("o_orderkey") % 5)


@query(
    """WITH e AS (SELECT s_suppkey, 's' || s_suppkey AS key, 'name ' || s_nationkey % 7 AS w, s_nationkey % 3 AS m, s_suppkey % 3 AS f FROM supplier), n AS (SELECT w, count(DISTINCT m) AS n FROM e GROUP BY w)
SELECT key, key || ': ' || w || '  (module ' || m || CASE WHEN f > 1 THEN '; asked of each of ' || f || ' roster members' ELSE '' END || CASE WHEN n > 1 THEN '; same wording printed in ' || n || ' modules' ELSE '' END || ')' AS line FROM e JOIN n USING (w)"""
)
def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_nationkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.concat(F.lit("name\n "), (k % 7).cast("string")).alias("w"), (k % 3).alias("m"), (F.col("s_suppkey") % 3).alias("f"))
    return records.candidate_lines(rows, "key", "w", "m", "f")


@query("SELECT conv_id, count(*) FILTER (length(text) > 100 AND contains(lower(text), 'e')) AS n_positive, count(*) AS k, CASE WHEN count(*) FILTER (length(text) > 100 AND contains(lower(text), 'e')) >= 2 THEN 'positive' ELSE 'negative' END AS verdict FROM conversations GROUP BY conv_id")
def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = F.struct((F.length("text") > 100).alias("long"), F.lower("text").contains("e").alias("marked"))
    return rubric.rescored(table(spark, sf_dir, "conversations"), "conv_id", elements, 2)
