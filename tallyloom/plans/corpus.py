"""Text functions, dictionary folds and scans, bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from tallyloom.functions import text as T
from tallyloom.operators import dictionary, documents, enumerate, lookup, ordering, records, reach, scan
from tallyloom.sources import sinks
from tallyloom.sources.readers import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of a codebook made from order lines: identifiers of several shapes, wordings from the lines' fields."""
    li = table(spark, sf_dir, "lineitem")
    q = F.concat(F.lit("Q"), (F.col("l_orderkey") % 30).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    n = F.col("l_linenumber").cast("string")
    qid = (
        F.when(F.col("l_linenumber") == 1, q)
        .when(F.col("l_linenumber") == 2, F.concat(q, F.lit("_"), (F.col("l_partkey") % 5).cast("string")))
        .when(F.col("l_linenumber") == 3, F.concat(n, F.lit("_"), q))
        .when(F.col("l_linenumber") == 4, F.concat(q, F.lit("#1_"), n))
        .when(F.col("l_linenumber") == 5, F.concat(q, F.lit("_4_TEXT")))
        .when(F.col("l_linenumber") == 6, F.concat(q, F.lit("#2_"), n, F.lit("_1")))
        .otherwise(F.concat(n, F.lit("_"), q, F.lit("#1_2")))
    )
    text = F.concat(F.lit("Please list "), F.col("l_returnflag"), F.lit(" - "), F.col("l_linestatus"), F.lit(" - "), (F.col("l_suppkey") % 3).cast("string"))
    module = (F.col("l_orderkey") % 3 + 1).cast("string")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]
    rows = li.select(module.alias("module"), qid.alias("qid"), text.alias("text"), *order)
    return ordering.ordinal(rows, order).select("module", "ord", "qid", "text")


_RAW = """
raw AS (
  SELECT CAST(l_orderkey % 3 + 1 AS VARCHAR) AS module,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS ord,
    'Please list ' || l_returnflag || ' - ' || l_linestatus || ' - ' || (l_suppkey % 3) AS text,
    CASE l_linenumber WHEN 1 THEN q WHEN 2 THEN q || '_' || (l_partkey % 5) WHEN 3 THEN '3_' || q WHEN 4 THEN q || '#1_4'
      WHEN 5 THEN q || '_4_TEXT' WHEN 6 THEN q || '#2_6_1' ELSE l_linenumber || '_' || q || '#1_2' END AS qid
  FROM (SELECT *, 'Q' || (l_orderkey % 30) || '.' || l_linenumber AS q FROM lineitem)),
parsed AS (
  SELECT *, row_number() OVER (PARTITION BY module, qid ORDER BY ord) AS occ, count(*) OVER (PARTITION BY module, qid) AS occ_n,
    regexp_replace(regexp_replace(regexp_replace(qid, '^[0-9]+_', ''), '#[0-9]+(_[0-9]+)*$', ''), '_[0-9]+(_TEXT)?$', '') AS base,
    regexp_matches(qid, '_[0-9]+(_TEXT)?$') AS grid, regexp_replace(regexp_replace(qid, '^[0-9]+_', ''), '_[0-9]+(_TEXT)?$', '') AS stem
  FROM raw),
e AS (
  SELECT *, 'm' || module || ':' || qid || CASE WHEN occ_n > 1 THEN '~' || occ ELSE '' END AS key, 'm' || module || ':' || base AS construct_key,
    CASE WHEN regexp_matches(qid, '^[0-9]+_Q') THEN CAST(regexp_extract(qid, '^([0-9]+)_', 1) AS INTEGER) END AS roster_row,
    CASE WHEN grid THEN regexp_extract(text, '^(.*) - (.*)$', 1) END AS stem_text, CASE WHEN grid THEN regexp_extract(text, '^(.*) - (.*)$', 2) END AS subitem_text
  FROM parsed)
"""


@query(
    f"""WITH {_RAW}, sizes AS (SELECT module, base, count(DISTINCT roster_row) AS n FROM e WHERE roster_row IS NOT NULL GROUP BY ALL)
SELECT e.key, e.construct_key, CASE WHEN grid THEN 'group:m' || e.module || ':' || stem END AS group_key, e.occ::INTEGER AS occurrence, e.occ_n AS occurrence_count,
  roster_row, stem_text, subitem_text, regexp_matches(qid, '^[0-9]+_') AS is_roster_repeat, grid AS is_grid_subitem, true AS is_free_text,
  CASE WHEN regexp_matches(qid, '^[0-9]+_') THEN n END AS roster_family_size,
  CASE WHEN regexp_matches(qid, '^[0-9]+_Q[0-9.]+#') THEN 'N_QN.N#N_N' WHEN regexp_matches(qid, '^[0-9]+_Q') THEN 'N_QN.N' WHEN regexp_matches(qid, '#[0-9]+_[0-9]+_[0-9]+$') THEN 'QN.N#N_N_N'
    WHEN regexp_matches(qid, '#') THEN 'QN.N#N_N' WHEN qid LIKE '%TEXT' THEN 'QN.N_N_TEXT' WHEN regexp_matches(qid, '_') THEN 'QN.N_N' ELSE 'QN.N' END AS shape
FROM e LEFT JOIN sizes ON e.module = sizes.module AND e.base = sizes.base"""
)
def entry_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dictionary.entries(_codebook(spark, sf_dir))
    return e.select("key", "construct_key", "group_key", "occurrence", "occurrence_count", "roster_row", "stem_text", "subitem_text", "is_roster_repeat", "is_grid_subitem", "is_free_text", "roster_family_size", "shape")


@query(
    f"""WITH {_RAW} SELECT qid, count(*) AS n, CASE WHEN count(DISTINCT module) = 1 THEN 'within_module' ELSE 'cross_module' END AS scope,
  string_agg(key, ' | ' ORDER BY ord) AS keys, string_agg(substr(text, 1, 70), ' || ' ORDER BY ord) AS texts
FROM e GROUP BY qid HAVING count(*) > 1"""
)
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dictionary.entries(_codebook(spark, sf_dir))
    return dictionary.collisions(e, "qid", "module", "key", "question_text", "ord")


@query(
    f"""WITH {_RAW}, subs AS (SELECT * FROM e WHERE grid), s AS (SELECT DISTINCT module, stem FROM subs),
  bare AS (SELECT module, count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.module = s.module AND e.qid = s.stem) GROUP BY module)
SELECT subs.module, count(*) AS subitems, count(DISTINCT stem) AS stems, coalesce(any_value(bare.n), 0) AS stems_without_own_row, count(stem_text) AS subitems_with_stem_text_split
FROM subs LEFT JOIN bare ON bare.module = subs.module GROUP BY subs.module"""
)
def grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.grid_summary(dictionary.entries(_codebook(spark, sf_dir)))


@query(f"WITH {_RAW} SELECT key, module, 'questionnaire' AS origin, false AS study_team_confirmed FROM e")
def origin_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.origins(dictionary.entries(_codebook(spark, sf_dir)))


@query(
    f"""WITH {_RAW}, g AS (SELECT construct_key, subitem_text, min(ord) AS first_ord, arg_min(key, ord) AS canonical, string_agg(key, ',' ORDER BY ord) AS members, count(*) AS fold_size FROM e GROUP BY ALL)
SELECT row_number() OVER (ORDER BY first_ord) AS target_id, construct_key, subitem_text, canonical, members, fold_size, count(*) OVER (PARTITION BY construct_key) - 1 AS n_siblings FROM g"""
)
def fold_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dictionary.entries(_codebook(spark, sf_dir)).withColumn("canonical", F.col("key"))
    folds = dictionary.fold(e, ["construct_key", "subitem_text"], "ord", ["canonical"], "key")
    targets = ordering.ordinal(folds, ["first_ord"], "target_id")
    out = dictionary.sibling_counts(targets, "construct_key")
    return out.select("target_id", "construct_key", "subitem_text", "canonical", F.array_join("members", ",").alias("members"), "fold_size", "n_siblings")


@query(f"WITH {_RAW} SELECT construct_key, arg_min(coalesce(stem_text, text), ord) AS stem, string_agg(key, ',' ORDER BY key) AS members, bool_or(grid) AS is_group FROM e GROUP BY construct_key")
def constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dictionary.entries(_codebook(spark, sf_dir))
    out = dictionary.constructs(e, "construct_key", "ord", "key", F.coalesce("stem_text", "question_text"), is_group=F.col("is_grid_subitem"))
    return out.withColumn("members", F.array_join("members", ","))


@query(
    f"""WITH {_RAW}, sizes AS (SELECT module, base, count(DISTINCT roster_row) AS n FROM e WHERE roster_row IS NOT NULL GROUP BY ALL),
  r AS (SELECT e.*, regexp_replace(text, '^\\s*[0-9]+\\s*-\\s*', '') AS display, CASE WHEN regexp_matches(qid, '^[0-9]+_') THEN n END AS family FROM e LEFT JOIN sizes ON e.module = sizes.module AND e.base = sizes.base),
  o AS (SELECT construct_key, display, min(ord) AS first_ord, string_agg(key, ',' ORDER BY ord) AS keys, arg_min(key, ord) AS representative, arg_min(module, ord) AS module, list(family ORDER BY ord)[1] AS roster_family_size FROM r GROUP BY construct_key, display),
  c AS (SELECT construct_key, min(first_ord) AS first, count(*) AS n, min(display) AS low, max(display) AS high FROM o GROUP BY construct_key),
  s AS (SELECT construct_key, first, CASE WHEN n > 1 THEN regexp_extract(substr(low, 1, list_max(list_filter(range(0, least(len(low), len(high)) + 1), lambda i: substr(low, 1, i) = substr(high, 1, i)))), '^(.+) - ', 1) ELSE '' END AS stem FROM c)
SELECT construct_key, display, first_ord, keys, count(*) OVER (PARTITION BY display) > 1 AS shared, row_number() OVER (ORDER BY first, first_ord) AS "index",
  representative, module, roster_family_size, stem, substr(display, len(stem) + 1) AS remainder FROM o JOIN s USING (construct_key)"""
)
def catalogue_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dictionary.entries(_codebook(spark, sf_dir))
    options = dictionary.catalogue(e, "construct_key", T.display(F.col("question_text")), "key", "ord", ["module", "roster_family_size"])
    return options.withColumn("keys", F.array_join("keys", ","))


@query("SELECT source, text IS NULL AS empty, count(*) AS n FROM documents GROUP BY ALL")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", F.col("text").isNull().alias("empty")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS wording, count(DISTINCT source) AS modules, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def duplicate_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.duplicate_modules(table(spark, sf_dir, "documents"), T.flat(F.col("text")), "source")


@query("SELECT count(DISTINCT trim(regexp_replace(text, '^[ \\t\\n]*[0-9]+[ \\t\\n]*-[ \\t\\n]*', ''))) AS n_distinct, count(*) AS n FROM documents")
def wording_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.cardinality(table(spark, sf_dir, "documents"), T.roster_normalise(F.col("text")))


@query("SELECT page_id, CASE WHEN u LIKE '% - %' THEN trim(regexp_extract(u, '^(.*) - (.*)$', 1)) END AS head, CASE WHEN u LIKE '% - %' THEN trim(regexp_extract(u, '^(.*) - (.*)$', 2)) END AS tail FROM (SELECT page_id, replace(url, '/', ' - ') AS u FROM pages)")
def split_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("/"), F.lit(" - ")).alias("u"))
    return rows.select("page_id", T.split_last(F.col("u")).alias("s")).select("page_id", "s.head", "s.tail")


@query("SELECT p_partkey, 'what ' || p_name AS stem FROM part")
def clean_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to a dozen references and indexes, one uncovered by the other, behind each wording."""
    k = F.col("p_partkey").cast("string")
    more = F.repeat(F.concat(F.lit(" - 1_Q1.1 - 2_Q2.2 - 3 - 4_Q3.3 - "), k), (F.col("p_partkey") % 6).cast("int"))
    dirty = F.concat(F.lit("what  "), "p_name", F.lit(" - Q2.4#1 - 7_Q"), k, F.lit(" - "), k, more)
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_stem(dirty).alias("stem"))


@query("SELECT p_partkey, p_name AS wording, upper(p_brand) = p_brand AS ok FROM part")
def roster_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", T.roster_normalise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" - "), "p_name")).alias("wording"), (F.upper("p_brand") == F.col("p_brand")).alias("ok"))


@query("WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS c, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS e FROM documents) SELECT doc_id, CAST(CASE WHEN len(c) > 0 THEN len(c) ELSE len(e) END AS BIGINT) AS n_terms, CAST(CASE WHEN len(c) > 0 THEN len(list_filter(e, lambda x: NOT list_contains(c, x))) ELSE 0 END AS BIGINT) AS n_dropped FROM t")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "documents").select("doc_id", T.query_terms(F.col("text")).alias("q"))
    return q.select("doc_id", F.size("q.terms").cast("long").alias("n_terms"), F.size("q.dropped").cast("long").alias("n_dropped"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_STEM = "CASE WHEN len(w) <= 3 THEN w " + " ".join(f"WHEN ends_with(w, '{s}') AND len(w) >= {n} THEN substr(w, 1, len(w) - {len(s)}) || '{r}'" for s, r, n in T.SUFFIXES) + " ELSE w END"


@query(f"SELECT doc_id, count(DISTINCT w) AS n_words, count(DISTINCT s) FILTER (s <> '' AND NOT list_contains({_STOPS}, s)) AS n_stems FROM (SELECT doc_id, w, {_STEM} AS s FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) WHERE len(w) >= 2 AND NOT list_contains({_STOPS}, w)) GROUP BY doc_id")
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(T.content_words(F.col("text"))).cast("long").alias("n_words"), F.size(T.content_words(F.col("text"), True)).cast("long").alias("n_stems"))
    return rows.where("n_words > 0")


@query(f"SELECT w, {_STEM} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)")
def light_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"), "[a-z]+")).alias("w")).distinct()
    return words.select("w", T.light_stem(F.col("w")).alias("stem"))


_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) >= 2 AND NOT list_contains({_STOPS}, x)))"


@query(
    f"""WITH d AS (SELECT doc_id, len(a) AS n, unnest(a) AS w FROM (SELECT doc_id, {_WORDS} AS a FROM documents)), b AS (SELECT item_id, len(b) AS m, unnest(b) AS w FROM (SELECT item_id, {_WORDS} AS b FROM benchmark)),
  x AS (SELECT doc_id, item_id, count(*) AS i, any_value(n) AS n, any_value(m) AS m FROM d JOIN b USING (w) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, i AS n_shared, i / n AS cov_a, i / m AS cov_b, i / (n + m - i) AS jaccard FROM x"""
)
def overlap_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and held-out items that share a content word, met by an equi-join on the word."""
    return scan.word_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", T.content_words(F.col("text")))


ABSENT = (("license", "(?i)licen[cs]e"), ("address", "@[a-z0-9]"), ("weekday", "(?i)\\bthursday\\b"), ("markup", "<p>"))


@query("WITH r(name, pattern) AS (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in ABSENT) + ") SELECT name, count(*) FILTER (regexp_matches(lang || ' ' || text, pattern)) AS n, count(*) FILTER (regexp_matches(lang || ' ' || text, pattern)) = 0 AS absent FROM r, documents GROUP BY name")
def absence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.absence(table(spark, sf_dir, "documents"), ABSENT, F.concat_ws(" ", "lang", "text"))


_RUNS = """
WITH w AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
  b AS (SELECT item_id AS held, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
  dr AS (SELECT DISTINCT key, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS run FROM w),
  br AS (SELECT DISTINCT held, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS run FROM b)
"""


@query(_RUNS + "SELECT key, count(DISTINCT run) AS n_runs, count(DISTINCT held) AS n_held FROM dr JOIN br USING (run) GROUP BY key")
def ngram_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.shared_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text")


_MARKERS = ("555", "GNU", "4.0", "token", "the", "zzzq")


@query(
    "WITH m(marker) AS (VALUES " + ", ".join(f"('{m}')" for m in _MARKERS) + """)
SELECT marker, count(*) AS n FROM documents JOIN m ON CASE WHEN regexp_full_match(marker, '[0-9,]+') THEN regexp_matches(text, '(^|[^A-Za-z0-9_])' || marker || '($|[^0-9])') ELSE contains(text, marker) END GROUP BY marker"""
)
def marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(m,) for m in _MARKERS], "marker string")
    return scan.markers(table(spark, sf_dir, "documents").select("doc_id", "text"), rows, "text", "marker").groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey % (SELECT max(c_custkey) FROM customer) + 1 AS dst FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)),
  r AS (SELECT min(c_custkey) AS root, min(c_custkey) AS node, 0 AS depth FROM customer GROUP BY c_nationkey UNION SELECT root, dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 40)
SELECT root, node, min(depth) AS depth, min(depth) + 1 AS steps FROM r GROUP BY root, node"""
)
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as edges from their customer to another one: whom the first customer of each nation leads to."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    facts = F.broadcast(customer.agg(F.max("c_custkey").alias("n")).crossJoin(orders.agg(F.min("o_orderpriority").alias("urgent"))))  # one row
    edges = orders.crossJoin(facts).where(F.col("o_orderpriority") == F.col("urgent")).select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % F.col("n") + 1).alias("dst"))
    found = reach.reached(edges, customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("root")))
    return found.select("root", "node", "depth", F.size("path").alias("steps"))


_RUNS = """WITH w AS (SELECT regexp_extract_all(text, '[^ \\t\\n]+') AS ws FROM benchmark),
  m AS (SELECT DISTINCT array_to_string(ws[i : i + 2], ' ') AS marker FROM w, generate_series(1, 400) AS t(i) WHERE i + 2 <= len(ws))"""


@query(_RUNS + " SELECT doc_id, count(*) AS n, min(marker) AS first FROM documents JOIN m ON contains(text, marker) GROUP BY doc_id")
def long_marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of thousands: every run of three words of the held-out texts as a marker."""
    words = T.let(F.regexp_extract_all("text", F.lit("[^ \\t\\n]+"), F.lit(0)), lambda w: T.shingles(w, 3))
    rows = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("marker")).distinct()
    found = scan.markers(table(spark, sf_dir, "documents").select("doc_id", "text"), rows, "text", "marker")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("marker").alias("first"))


@query(
    "WITH m(token) AS (VALUES " + ", ".join(f"('{m}')" for m in _MARKERS) + r""")
SELECT token, count(*) AS n FROM documents JOIN m ON regexp_matches(text, '(^|[^A-Za-z0-9_.])' || regexp_escape(token) || '($|[^A-Za-z0-9_])') GROUP BY token"""
)
def standalone_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(m,) for m in _MARKERS], "token string")
    return scan.tokens_in(table(spark, sf_dir, "documents").select("doc_id", "text"), rows, "text", "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH p AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
  d AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
  ph AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM p),
  known AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM d)
SELECT item_id, count(*) AS n FROM ph WHERE phrase NOT IN (SELECT phrase FROM known) AND NOT (phrase IN ('the of', 'of the', 'the the', 'of of')) GROUP BY item_id"""
)
def phrase_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words of held-out items that no document (the instrument) holds."""
    left = scan.answer_phrases(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "text", 2, ["the", "of"])
    return left.where(F.col("phrase").contains(" ")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(contains(text, 'the')) AS INTEGER) AS control_0, sum(length(text)) >= 30000 AND max(contains(text, 'the')) AS seen FROM documents GROUP BY source")
def blind_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.blind_floors(table(spark, sf_dir, "documents"), "source", "text", 30_000, ["the"])


@query("SELECT lang, count(DISTINCT source) AS n_members, count(*) AS n FROM documents GROUP BY lang")
def set_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lookup.set_signature(docs, "lang", "source").drop("signature").join(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang")


@query(
    """WITH s AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY o_custkey)
SELECT min(k) AS first, len(p) AS n_members, count(*) AS n_equal FROM s GROUP BY p"""
)
def same_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of customers whose orders have the same set of priorities."""
    signed = lookup.set_signature(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
    return signed.groupBy("signature").agg(F.min("o_custkey").alias("first"), F.first("n_members").alias("n_members"), F.count(F.lit(1)).alias("n_equal")).drop("signature")


@query("SELECT n_name AS key, r_name AS label, 'entry' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'AFRICA', 'AFRICA', 'construct' UNION ALL SELECT 'NOWHERE', NULL, 'neither'")
def entry_or_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    entries = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("label"))
    names = region.select(F.col("r_name").alias("key"), F.col("r_name").alias("label"))
    asked = entries.select("key").union(spark.createDataFrame([("AFRICA",), ("NOWHERE",)], "key string"))
    return lookup.either(asked, entries, names)


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority <> (SELECT min(o_orderpriority) FROM orders) GROUP BY o_custkey")
def fixture_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    now = orders.select("o_custkey").distinct().crossJoin(table(spark, sf_dir, "orders").agg(F.min("o_orderpriority").alias("now")))  # one row
    return lookup.drift(orders, now, "o_custkey", "o_orderpriority", "now")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def uncovered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.uncovered(table(spark, sf_dir, "customer").select("c_custkey"), seen, ["c_custkey"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("module"), (F.col("n_nationkey") % 3).alias("block"), (F.col("n_nationkey") % 4 == 0).alias("is_group"), (F.col("n_nationkey") % 7 == 0).alias("is_free_text"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("key"), (F.col("s_nationkey") % 5).alias("module"), (F.col("s_nationkey") % 3).alias("block"), (F.col("s_suppkey") % 4 == 0).alias("is_group"), (F.col("s_suppkey") % 7 == 0).alias("is_free_text"))
    return enumerate.screen(enumerate.prune(enumerate.candidates(n, s)))


_PAIRS = """
WITH p AS (
  SELECT n_nationkey AS e_key, CAST(s_suppkey AS INTEGER) AS o_key, n_nationkey % 7 = 0 OR s_suppkey % 7 = 0 AS free,
    n_regionkey = s_nationkey % 5 AND n_nationkey % 3 = s_nationkey % 3 AS same, n_regionkey = s_nationkey % 5 AS module, n_nationkey % 4 = 0 OR s_suppkey % 4 = 0 AS grp
  FROM nation, supplier WHERE n_nationkey <> s_suppkey),
r AS (SELECT *, CASE WHEN free THEN 'free_text_anchor' WHEN same THEN 'same_battery' END AS reason FROM p),
x AS (SELECT *, CASE WHEN reason IS NULL THEN 'live' ELSE 'pruned' END AS state, reason IS NULL AND grp AS requires_derivation,
  CASE WHEN reason IS NULL AND module THEN 'estimable' WHEN reason IS NULL THEN 'unknown' END AS estimability FROM r)
"""


@query(_PAIRS + "SELECT e_key, o_key, state, reason, requires_derivation, estimability, CASE WHEN estimability = 'unknown' THEN 'module_co_completion' END AS blocked_on FROM x")
def funnel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("e_key", "o_key", "state", "reason", "requires_derivation", "estimability", F.try_element_at("tags", F.lit("blocked_on")).alias("blocked_on"))


@query(_PAIRS + "SELECT count(*) AS enumerated, count(*) FILTER (state = 'live') AS live, count(*) FILTER (reason = 'free_text_anchor') AS pruned_free_text, count(*) FILTER (reason = 'same_battery') AS pruned_same_battery, count(*) FILTER (requires_derivation) AS requires_derivation, count(*) FILTER (estimability = 'estimable') AS estimable FROM x")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enumerate.counts(_pairs(spark, sf_dir))


@query(
    """WITH a AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part WHERE p_size = 1 ORDER BY 1 LIMIT 40),
  b AS (SELECT p_partkey AS partner, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part WHERE p_size = 2 ORDER BY 1 LIMIT 40)
SELECT CAST(place AS INTEGER) AS place, CASE WHEN place % 2 = 0 THEN k ELSE partner END AS exposure, CASE WHEN place % 2 = 0 THEN partner ELSE k END AS outcome
FROM a JOIN b ON pos = place % (SELECT count(*) FROM b) WHERE k <> partner"""
)
def calibration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return enumerate.zipped(part.where("p_size = 1"), part.where("p_size = 2"), "p_partkey", 40)


@query(_PAIRS + "SELECT gate, count(*) AS n FROM (SELECT CASE WHEN free THEN 'free_text' WHEN same THEN 'same_block' WHEN grp THEN 'no_derivation' ELSE 'answerable' END AS gate FROM x) GROUP BY gate")
def pair_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("free_text", F.col("e_is_free_text") | F.col("o_is_free_text")), ("same_block", (F.col("e_module") == F.col("o_module")) & (F.col("e_block") == F.col("o_block"))), ("no_derivation", F.col("e_is_group") | F.col("o_is_group"))]
    return enumerate.gates(_pairs(spark, sf_dir), rules).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) WHERE i % greatest(n // 12, 1) = 0 AND i / greatest(n // 12, 1) < 12")
def pilot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enumerate.spaced(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 12)


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS load, count(*) FILTER (o_orderstatus = 'P') AS unknown, CASE WHEN count(DISTINCT o_orderpriority) <= 3 AND count(*) FILTER (o_orderstatus = 'P') = 0 THEN 'pass' ELSE 'refer' END AS decision FROM orders GROUP BY o_custkey")
def access_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.access_risk(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority"), F.col("o_orderstatus") != "P")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || ' ' ELSE '' END || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' weekly' ELSE '' END || ': zinc, nickel' AS query FROM part"""
)
def template_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = ordering.spread(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), "p_partkey")
    who = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("participant")
    when = F.when(F.col("p_partkey") % 3 == 0, F.lit("weekly"))
    return part.select("p_partkey", T.query_template(F.col("p_brand"), who, when, F.array(F.lit("zinc"), F.lit(" "), F.lit("nickel"), F.lit("zinc"))).alias("query"))


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') OR regexp_matches(text, '[éèá]') AS by_sign_ok, true AS whole_ok FROM documents")
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read by the wrong code page on purpose, and repaired."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("good"))
    bad = F.decode(F.encode("good", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", "good", T.cp1252_repair(bad).alias("by_sign"), T.latin1_repair(bad)["text"].alias("whole")).select("doc_id", (F.col("by_sign") == F.col("good")).alias("by_sign_ok"), (F.col("whole") == F.col("good")).alias("whole_ok"))


@query("SELECT sha256 AS sha256, bytes, count(*) AS n FROM (SELECT sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents) GROUP BY ALL")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text")).groupBy("sha256", "bytes").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'parts' AS check, CAST(count(*) AS VARCHAR) AS got, CAST(count(*) AS VARCHAR) AS want, true AS ok FROM part UNION ALL SELECT 'brands', CAST(count(DISTINCT p_brand) AS VARCHAR), '25', count(DISTINCT p_brand) = 25 FROM part")
def checks_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return dictionary.checks(("parts", part.agg(F.count(F.lit(1))), part.count()), ("brands", part.agg(F.count_distinct("p_brand")), 25))


@query()
def porter_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document counts by stem over the held-out items, the stemmed form of the index."""
    from tallyloom.functions import udfs

    stems = udfs.porter_words(T.words(F.col("text"), "[a-z]+"))
    rows = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(stems)).alias("stem"))
    return rows.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))


@query("SELECT event_id, CASE WHEN value < 10 THEN 'value_label_binding' WHEN value < 20 THEN 'n_point_scale' WHEN value < 30 THEN 'scored_range' END AS coding FROM events")
def coding_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.functions import predicates

    v = F.col("value")
    said = F.when(v < 10, F.lit("coded 1 = Yes in m1:Q2.3_1")).when(v < 20, F.lit("a five-point scale")).when(v < 30, F.lit("scored from 0 to 27")).otherwise(F.lit("uses m1:Q2.3_1 and m2:Q5.8 alone"))
    return table(spark, sf_dir, "events").select("event_id", predicates.states_a_coding(said).alias("coding"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'workplace' WHEN 1 THEN 'school' WHEN 2 THEN 'residence' END AS place, CASE c_custkey % 3 WHEN 0 THEN 'highest versus lowest Likert category' WHEN 1 THEN 'yes versus no' ELSE 'per one standard-deviation increase' END AS contrast FROM customer")
def place_and_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.functions import predicates

    k = F.col("c_custkey")
    wording = F.when(k % 4 == 0, "ZIP of your employer").when(k % 4 == 1, "the school address").when(k % 4 == 2, "What city is it").otherwise("How often")
    kind = F.when(k % 3 == 0, "Agree 1-5").when(k % 3 == 1, "Ever smoked").otherwise("height")
    return table(spark, sf_dir, "customer").select("c_custkey", predicates.place_of(wording).alias("place"), predicates.contrast(kind).alias("contrast"))


@query("SELECT * FROM (VALUES ('the', true), ('zzzq xqx', false), ('12', NULL), ('thonre', (SELECT bool_or(contains(lower(text), 'thonre')) FROM documents))) v(term, carried)")
def carried_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each term, whether any text carries it; a term without tokens stays undetermined."""
    from tallyloom.functions import predicates

    each = predicates.carried(F.array(*map(F.lit, ("the", "zzzq xqx", "12", "thonre"))), table(spark, sf_dir, "documents"), "text")
    return each.groupBy("term").agg(F.bool_or("carried").alias("carried"))


@query("SELECT item_id, 64 AS dim FROM benchmark")
def encoded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoder seam with its model-free stand-in."""
    from tallyloom.operators import seams

    return seams.encode(table(spark, sf_dir, "benchmark"), "text", seams.hashing_encoder).select("item_id", F.size("embedding").alias("dim"))


@query("SELECT event_id, 'k' AS path, 'x' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.regexp_replace("props", r"([0-9]+)", '"x$1"')
    return documents.strings(table(spark, sf_dir, "events").select("event_id", quoted.alias("props")), "event_id", "props")


_ORDER = StructType([
    documents.declared("o_totalprice", DoubleType(), required=True, least=2000.0),
    documents.declared("o_orderpriority", StringType(), pattern="^[1-3]"),
    documents.declared("lines", ArrayType(StructType([
        documents.declared("quantity", DoubleType(), most=45.0),
        documents.declared("flag", StringType(), one_of=["A", "N"]),
        documents.declared("discount", DoubleType(), least=0.02),
    ])), min_items=2),
])


@query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_discount) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
  f AS (
    SELECT l_orderkey AS o_orderkey, i, 'quantity' AS field, 'most' AS rule FROM l WHERE l_quantity > 45
    UNION ALL SELECT l_orderkey, i, 'flag', 'one_of' FROM l WHERE l_returnflag NOT IN ('A', 'N')
    UNION ALL SELECT l_orderkey, i, 'discount', 'least' FROM l WHERE l_discount < 0.02)
SELECT o_orderkey, 'lines[' || i || '].' || field AS path, rule FROM f
UNION ALL SELECT o_orderkey, 'o_totalprice', CASE WHEN o_totalprice IS NULL THEN 'required' ELSE 'least' END FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l) AND (o_totalprice < 2000 OR o_totalprice IS NULL)
UNION ALL SELECT o_orderkey, 'o_orderpriority', 'pattern' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l) AND NOT regexp_matches(o_orderpriority, '^[1-3]')
UNION ALL SELECT DISTINCT l_orderkey, 'lines', 'min_items' FROM l WHERE n < 2"""
)
def declared_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested records, held to rules that their schema declares."""
    line = F.struct("l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("discount"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("_l"))  # an order's few lines
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey").withColumn("lines", F.transform("_l", lambda x: F.struct(x["quantity"].alias("quantity"), x["flag"].alias("flag"), x["discount"].alias("discount"))))
    return documents.violations(rows, "o_orderkey", _ORDER).drop("value")
