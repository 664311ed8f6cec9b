"""Search, browsing, key lookups, vectors and fusion, bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import dictionary, fusion, lookup, metrics, ordering, postings, search, vector
from tallyloom.sources.readers import table
from tallyloom.sources.staging import staged

PHRASE = "thing that thonre zzzq"
PHRASINGS = ("thing that thonre zzzq", "with from thing", "est que thonre")
_TERMS = "['thing', 'that', 'thonre', 'zzzq']"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_SCORED = """
  n AS (SELECT count(*) AS n FROM documents),
  docs AS (SELECT doc_id AS key, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS ws,
             trim(regexp_replace(text, '^\\s*[0-9]+\\s*-\\s*', '')) AS wording FROM documents),
  df AS (SELECT stream, term, (SELECT count(*) FROM docs WHERE list_contains(ws, term)) AS df FROM q),
  w AS (SELECT stream, term, ln((n + 1.0) / (df + 1.0)) AS idf FROM df, n),
  total AS (SELECT stream, sum(idf) AS total FROM w GROUP BY stream),
  scored AS (
    SELECT w.stream, key, wording, round(sum(idf) / any_value(total), 9) AS score, CAST(count(*) AS INTEGER) AS m
    FROM docs JOIN w ON list_contains(ws, w.term) JOIN total ON total.stream = w.stream GROUP BY w.stream, key, wording)
"""


@query(
    f"""
WITH q AS (SELECT 0 AS stream, unnest({_TERMS}) AS term), {_SCORED},
  reps AS (
    SELECT *, row_number() OVER (PARTITION BY wording ORDER BY score DESC, key) AS pos, count(*) OVER (PARTITION BY wording) - 1 AS c FROM scored),
  page AS (SELECT * FROM reps WHERE pos = 1 ORDER BY score DESC, key LIMIT 20)
SELECT key, round(score, 3) AS score, m AS n_matched_terms, c AS collapsed_n, round(score, 3) < 0.523 AS below_threshold,
  CASE WHEN max(round(score, 3)) OVER () < 0.523 THEN 'low_confidence' ELSE 'ok' END AS outcome
FROM page"""
)
def search_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", PHRASE)


_STREAMS = """
WITH q AS (
    SELECT 0 AS stream, unnest(['thing', 'that', 'thonre', 'zzzq']) AS term
    UNION ALL SELECT 1, unnest(['with', 'from', 'thing'])
    UNION ALL SELECT 2, unnest(['est', 'que', 'thonre'])), {scored},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY score DESC, key) AS rank FROM scored),
  pool AS (SELECT * FROM ranked WHERE rank <= 50),
  sums AS (
    SELECT key, min(rank) AS best, min(stream * 1000000 + rank) AS seen, round(sum(1.0 / (60 + rank)), 9) AS rrf, count(*) AS n_streams
    FROM pool GROUP BY key)
"""


@query(_STREAMS.replace("{scored}", _SCORED) + "SELECT key, CAST(best AS INTEGER) AS best, n_streams, CAST(row_number() OVER (ORDER BY best, seen, key) AS INTEGER) AS fused_rank FROM sums QUALIFY fused_rank <= 60")
def search_fused_minrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.many(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", PHRASINGS, 50)
    return fusion.min_rank(pool, cap=60).select("key", "best", "n_streams", "fused_rank")


@query(_STREAMS.replace("{scored}", _SCORED) + "SELECT key, rrf, n_streams, CAST(row_number() OVER (ORDER BY rrf DESC, seen, key) AS INTEGER) AS fused_rank FROM sums QUALIFY fused_rank <= 60")
def search_fused_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.many(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", PHRASINGS, 50)
    return fusion.rrf(pool, cap=60).select("key", "rrf", "n_streams", "fused_rank")


@query(
    f"""
WITH words AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS ws FROM documents),
  n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM words),
  hits AS (SELECT key, term, len(list_filter(ws, lambda x: x = term)) AS tf, len(ws) AS length FROM words, (SELECT unnest({_TERMS}) AS term)),
  df AS (SELECT term, count(*) AS df FROM hits WHERE tf > 0 GROUP BY term)
SELECT key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25
FROM hits JOIN df USING (term), n WHERE tf > 0 GROUP BY key"""
)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = docs.select(F.size(T.words(F.col("text"), "[a-z]{3,}")).alias("n")).agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("n")).first()
    terms = PHRASE.split()
    return search.scored(search.postings(docs, "doc_id", F.col("text"), terms), terms, stats.n, mean_length=stats.mean).select("key", F.round("bm25", 6).alias("bm25"))


@query(
    """
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM benchmark)
SELECT term, count(DISTINCT item_id) AS df, count(*) AS cf FROM w GROUP BY term"""
)
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.index(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS cf FROM w GROUP BY term")
def posting_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a stored index."""
    return postings.build(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).terms.drop("bucket")


_REQUESTS = """
WITH d AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-z]{3,}') AS ws FROM documents),
  n AS (SELECT count(*) AS n, avg(coalesce(len(ws), 0)) AS mean FROM d),
  q AS (SELECT DISTINCT doc_id AS request, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')[2:6]) AS term FROM labels JOIN documents USING (doc_id)),
  p AS (SELECT term, key, count(*) AS tf, any_value(length) AS length FROM (SELECT key, unnest(ws) AS term, len(ws) AS length FROM d) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  w AS (SELECT request, q.term, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) AS idf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS okapi FROM q LEFT JOIN df USING (term), n),
  total AS (SELECT request, sum(idf) AS total FROM w GROUP BY request),
  scored AS (
    SELECT w.request, p.key, round(sum(idf) / any_value(total), 9) AS share, round(sum(okapi * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS bm25, CAST(count(*) AS INTEGER) AS matched
    FROM w JOIN p USING (term) JOIN total USING (request), n GROUP BY w.request, p.key)
"""


def _requests(spark: SparkSession, sf_dir: str, k: int, rule: str) -> tuple[DataFrame, DataFrame]:
    """(hits, requests) of a request for every labelled document: its words from the second to the sixth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    some = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    phrase = F.array_join(F.slice(T.words(F.col("text"), "[a-z]{3,}"), 2, 5), " ")
    some = staged(ordering.spread(some).select("doc_id", phrase.alias("phrase")))  # dealt first, and words taken once
    terms = staged(postings.asked(some.where("phrase <> ''"), "doc_id", F.col("phrase")))
    return postings.search(postings.build(docs, "doc_id", F.col("text")), terms, k, rule)[0], terms.select("request").distinct()


@query(_REQUESTS + "SELECT request, key, share AS score, matched, CAST(row_number() OVER (PARTITION BY request ORDER BY share DESC, key) AS INTEGER) AS rank FROM scored QUALIFY rank <= 10")
def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir, 10, "share")[0]


@query(_REQUESTS + "SELECT request, key, bm25 AS score, matched, CAST(row_number() OVER (PARTITION BY request ORDER BY bm25 DESC, key) AS INTEGER) AS rank FROM scored QUALIFY rank <= 10")
def search_requests_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir, 10, "bm25")[0]


@query(_REQUESTS + """, r AS (SELECT request, key, row_number() OVER (PARTITION BY request ORDER BY share DESC, key) AS rank FROM scored),
  g AS (SELECT q.request, min(rank) FILTER (rank <= 10) AS rank FROM (SELECT DISTINCT request FROM q) q LEFT JOIN r ON r.request = q.request AND r.key = q.request GROUP BY q.request)
SELECT count(*) AS n, count(*) FILTER (rank IS NULL) AS excluded, count(*) FILTER (rank <= 1) / count(*) AS r_at_1, count(*) FILTER (rank <= 5) / count(*) AS r_at_5, count(*) FILTER (rank <= 10) / count(*) AS r_at_10 FROM g""")
def fixture_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole fixture searched in one plan: the gold document of a request is the one that its words are from."""
    hits, requests = _requests(spark, sf_dir, 10, "share")
    gold = hits.where(F.col("request") == F.col("key")).select("request", F.col("rank").cast("long").alias("rank"))
    return metrics.recall(requests.join(gold, "request", "left"), "rank", (1, 5, 10))


@query("SELECT p_type AS wording, min(p_partkey) AS key, count(*) AS n FROM part GROUP BY p_type")
def browse_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.item_rows(table(spark, sf_dir, "part"), T.roster_normalise(F.col("p_type")), "p_partkey")


@query("SELECT p_brand AS section, count(*) AS items, count(DISTINCT p_type) AS constructs FROM part GROUP BY p_brand")
def browse_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.section_rows(table(spark, sf_dir, "part"), F.col("p_brand"), "p_type")


@query("SELECT p_brand AS section, count(*) AS items, count(DISTINCT p_type) AS constructs FROM part GROUP BY p_brand")
def browse_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' page is too large, so the index of sections is shown."""
    part = table(spark, sf_dir, "part")
    items = part.select("p_partkey", "p_name", "p_type", "p_brand")
    return search.browse([("items", items), ("sections", dictionary.section_rows(part, F.col("p_brand"), "p_type"))], most=2000)[1]


_ENTRIES = "SELECT 'm1:' || p_partkey AS key, 'group:' || p_brand AS g, 'c:' || p_type AS c, 'Q' || (p_partkey % 7) AS qid FROM part"


def _part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("m1:"), key).alias("key"), F.concat(F.lit("group:"), "p_brand").alias("g"), F.concat(F.lit("c:"), "p_type").alias("c"), F.concat(F.lit("Q"), (F.col("p_partkey") % 7).cast("string")).alias("qid"), "p_size")


@query(
    f"""
WITH e AS ({_ENTRIES}), asked AS (
    SELECT 'm1:1' AS key UNION SELECT 'm1:77' UNION SELECT min(g) FROM e UNION SELECT min(c) FROM e UNION SELECT 'Q3' UNION SELECT 'nothing'),
  u AS (SELECT key, true AS is_entry FROM e), g AS (SELECT g AS key, list_sort(list(key)) AS l FROM e GROUP BY g),
  c AS (SELECT c AS key, list_sort(list(key)) AS l FROM e GROUP BY c), b AS (SELECT qid AS key, list_sort(list(key)) AS l FROM e GROUP BY qid)
SELECT asked.key, CASE WHEN u.is_entry THEN 'unique' WHEN g.l IS NOT NULL THEN 'is_group' WHEN c.l IS NOT NULL THEN 'is_construct'
    WHEN b.l IS NOT NULL THEN 'ambiguous' ELSE 'not_found' END AS outcome,
  array_to_string(CASE WHEN u.is_entry THEN [asked.key] ELSE coalesce(g.l, c.l, b.l, []) END, ',') AS candidates
FROM asked LEFT JOIN u USING (key) LEFT JOIN g USING (key) LEFT JOIN c USING (key) LEFT JOIN b USING (key)"""
)
def resolve_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _part_entries(spark, sf_dir)
    asked = spark.createDataFrame([("m1:1",), ("m1:77",), ("Q3",), ("nothing",)], "key string").union(entries.agg(F.min("g"))).union(entries.agg(F.min("c")))
    return lookup.resolve(asked, entries, "g", "c", "qid").withColumn("candidates", F.array_join("candidates", ","))


@query("SELECT p_brand, p_partkey, coalesce(p_size, 0) AS position FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return lookup.group_members(part, part.agg(F.min("p_brand").alias("p_brand")), "p_brand", "p_size").select("p_brand", "p_partkey", "position")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.where(F.col("vec_id") % 50 == 0)


_COSINES = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.label AS ql, b.label AS dl, round(list_cosine_similarity(a.e, b.e), 6) AS score, list_cosine_similarity(a.e, b.e) AS raw
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS INTEGER) AS rank FROM s)
"""


@query(_COSINES + "SELECT query_id, rank, doc_id, score FROM hits WHERE rank <= 10")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = _vectors(spark, sf_dir)
    return vector.similar(queries, rows, 10).withColumn("score", F.round("score", 6))


@query(_COSINES + "SELECT query_id, CASE WHEN raw >= 0.35 THEN doc_id END AS answer, score, raw < 0.35 AS abstained FROM hits WHERE rank = 1")
def argmax_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = _vectors(spark, sf_dir)
    return vector.select(vector.similar(queries, rows, 1), 0.35).withColumn("score", F.round("score", 6))


@query(
    _COSINES
    + """SELECT query_id, round(max(raw) FILTER (rank = 1), 6) AS top1, round(max(raw) FILTER (rank = 2), 6) AS top2,
  round(max(raw) FILTER (rank = 1) - max(raw) FILTER (rank = 2), 6) AS margin, max(doc_id) FILTER (rank = 1) AS doc_id
FROM hits WHERE rank <= 2 GROUP BY query_id"""
)
def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = _vectors(spark, sf_dir)
    found = vector.margins(vector.similar(queries, rows, 2))
    return found.select("query_id", *(F.round(c, 6).alias(c) for c in ("top1", "top2", "margin")), "doc_id")


_GOLD = "gold AS (SELECT query_id, min(rank) AS rank FROM hits WHERE ql = dl AND rank <= 50 GROUP BY query_id), every AS (SELECT vec_id AS query_id, rank FROM v LEFT JOIN gold ON vec_id = query_id WHERE vec_id % 50 = 0)"


def _gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = _vectors(spark, sf_dir)
    label = rows.select(F.col("vec_id"), "label")
    hits = vector.similar(queries, rows, 50).join(label.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl")), "doc_id")
    hits = hits.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").where("ql = dl")
    return queries.select(F.col("vec_id").alias("query_id")).join(hits.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


@query(f"{_COSINES.rstrip()}, {_GOLD} SELECT count(*) AS n, count(*) FILTER (rank IS NULL) AS excluded, count(*) FILTER (rank <= 1) / count(*) AS r_at_1, count(*) FILTER (rank <= 5) / count(*) AS r_at_5, count(*) FILTER (rank <= 10) / count(*) AS r_at_10 FROM every")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall(_gold_ranks(spark, sf_dir), "rank", (1, 5, 10))


@query(f"{_COSINES.rstrip()}, {_GOLD}, s2 AS (SELECT list_sort(list(rank)) AS r FROM every WHERE rank IS NOT NULL) SELECT CAST(len(r) AS BIGINT) AS n, r[len(r)] AS rank_max, r[CAST(floor(0.5 * (len(r) - 1)) AS BIGINT) + 1] AS rank_p50, r[least(len(r) - 1, CAST(floor(0.9 * len(r)) AS BIGINT)) + 1] AS rank_p90 FROM s2")
def rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_summary(staged(_gold_ranks(spark, sf_dir)), "rank")  # searched once


@query(
    """
WITH v AS (SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 1) AS DOUBLE[])), 2) AS s FROM embeddings)
SELECT a.vec_id, 1 + count(*) FILTER (b.s > a.s OR (b.s = a.s AND b.vec_id < a.vec_id)) AS position, 1 + count(*) FILTER (b.s > a.s) AS strict
FROM v a, v b WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id"""
)
def rank_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    one = rows.where("vec_id = 1").select(F.col("embedding").alias("q"))
    scored = rows.crossJoin(F.broadcast(one)).select("vec_id", F.round(vector.dot(F.col("embedding"), F.col("q")), 2).alias("s"))  # one row
    return vector.ranks_in(scored, "vec_id", "s").where(F.col("vec_id") % 50 == 0)


@query(_COSINES + ", g AS (SELECT query_id, min(doc_id) AS gold FROM hits WHERE rank <= 10 GROUP BY query_id), s2 AS (SELECT h.query_id, h.doc_id, round(h.raw, 2) AS s, gold FROM hits h JOIN g USING (query_id) WHERE rank <= 10), o AS (SELECT query_id, s AS gs, doc_id AS gd FROM s2 WHERE doc_id = gold) SELECT query_id, 1 + count(*) FILTER (s > gs OR (s = gs AND doc_id < gd)) AS position, 1 + count(*) FILTER (s > gs) AS strict FROM s2 JOIN o USING (query_id) GROUP BY query_id")
def rank_of_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold document's rank among each query's hits, both ways of counting ties."""
    rows, queries = _vectors(spark, sf_dir)
    hits = staged(vector.similar(queries, rows, 10)).withColumn("score", F.round("score", 2))
    gold = hits.groupBy("query_id").agg(F.min("doc_id").alias("gold"))
    return vector.gold_ranks(hits.join(gold, "query_id"), "query_id", "doc_id", "score", "gold")


@query("SELECT vec_id, round(list_dot_product(u, u), 6) AS length, len(u) AS dim FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS e FROM embeddings))")
def matryoshka(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select("vec_id", vector.l2_normalise(F.col("embedding"), 16).alias("u"))
    return unit.select("vec_id", F.round(vector.dot(F.col("u"), F.col("u")), 6).alias("length"), F.size("u").cast("long").alias("dim"))


@query(
    _COSINES
    + """, first AS (SELECT ql AS target, doc_id, min(query_id * 1000 + rank) AS pos FROM hits WHERE rank <= 30 AND ql <> dl GROUP BY ql, doc_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos) AS n FROM first)
SELECT target, count(*) AS n, array_to_string(list(doc_id ORDER BY n), ',') AS negatives FROM r WHERE n <= 120 GROUP BY target"""
)
def mine_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of other labels, by the label asked for."""
    rows, queries = _vectors(spark, sf_dir)
    label = rows.select("vec_id", F.col("label").cast("long").alias("label"))
    hits = staged(vector.similar(queries, rows, 30)).join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("target")), "query_id")
    hits = hits.join(label.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").where("label <> target")
    classes = 1_000_000_000  # labels are no document ids: out of their range
    gold = hits.select("query_id", (F.col("target") + classes).alias("target")).distinct()
    found = vector.mine_negatives(hits.select("query_id", "rank", "doc_id"), gold)
    return found.select((F.col("target") - classes).cast("int").alias("target"), F.size("negatives").cast("long").alias("n"), F.array_join("negatives", ",").alias("negatives"))


@query(
    """
WITH t AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)
SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine
FROM t a JOIN t b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.n <= 8 AND b.n <= 8"""
)
def sibling_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.sibling_cosines(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


def _fused(rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, queries = _vectors(spark, sf_dir)
        hits = vector.similar(queries, rows, 10)
        scores = hits.select((F.col("query_id") / 50 % 4).cast("long").alias("stream"), F.floor(F.col("query_id") / 200).alias("item"), F.col("doc_id").alias("key"), "score")
        fused = fusion.fuse_scores(scores.groupBy("stream", "item", "key").agg(F.max("score").alias("score")), rule, ["item"])
        return ordering.top(fused.withColumn("fused", F.round("fused", 6)), ["item"], [F.desc("fused"), F.col("key")], 5).select("item", "key", "fused", "rank")

    run.__name__ = f"fuse_{rule}"
    return run


_STREAMED = (
    _COSINES
    + """, sc AS (SELECT CAST(query_id / 50 % 4 AS BIGINT) AS stream, CAST(floor(query_id / 200) AS BIGINT) AS item, doc_id AS key, max(round(raw, 12)) AS score FROM hits WHERE rank <= 10 GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY item, stream ORDER BY score DESC, key) AS rank FROM sc), f AS (SELECT item, key, round({rule}, 6) AS fused FROM rk {where} GROUP BY item, key)
SELECT item, key, fused, CAST(row_number() OVER (PARTITION BY item ORDER BY fused DESC, key) AS INTEGER) AS rank FROM f QUALIFY rank <= 5"""
)
for _rule, _expr in (("max_cos", "max(score)"), ("mean_cos", "avg(score)"), ("rrf", "sum(1.0 / (60 + rank))"), ("min_rank", "-min(rank) + (max(score) + 1.0) / 4.0"), ("single", "max(score)")):
    query(_STREAMED.replace("{rule}", _expr).replace("{where}", "WHERE stream = 0" if _rule == "single" else ""))(_fused(_rule))
