"""Call logs, records, rubrics and verdicts, bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import metrics, records, rubric
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


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("value") >= 20
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tool"), ok.alias("ok"), (F.col("event_id") % 4 == F.col("user_id") % 4).alias("own"), F.struct("ts", "event_id").alias("at"), F.round("value", 6).alias("result"), "event_id")


@query(
    """WITH c AS (SELECT user_id, event_type AS tool, bool_or(value >= 20) AS ok, bool_or(value >= 20 AND event_id % 4 = user_id % 4) AS hit FROM events WHERE event_type IN ('purchase', 'signup', 'view') GROUP BY ALL),
  r AS (SELECT DISTINCT user_id, tool FROM events, (VALUES ('purchase'), ('signup'), ('view')) t(tool)),
  j AS (SELECT r.user_id, r.tool, c.ok, c.hit FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.tool = r.tool),
  x AS (SELECT user_id, coalesce(string_agg(tool, ',' ORDER BY tool) FILTER (ok IS NULL), '') AS never, coalesce(string_agg(tool, ',' ORDER BY tool) FILTER (NOT ok), '') AS errored,
    coalesce(string_agg(tool, ',' ORDER BY tool) FILTER (ok AND NOT hit AND tool <> 'signup'), '') AS elsewhere FROM j GROUP BY user_id)
SELECT *, never = '' AND errored = '' AND elsewhere = '' AS passed FROM x"""
)
def tool_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.gate(_calls(spark, sf_dir), "user_id", "tool", F.col("ok"), F.col("own"), ["view", "signup", "purchase"], ["signup"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("never", "errored", "elsewhere")})


@query("SELECT user_id, event_type AS tool, round(arg_max(value, (ts, event_id)), 6) AS result, count(*) AS n_ok FROM events WHERE value >= 20 GROUP BY ALL")
def last_ok_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_ok(_calls(spark, sf_dir), "user_id", "tool", F.col("ok"), F.col("at"), "result")


_AUTH = """WITH l AS (SELECT user_id, event_type AS tool, round(arg_max(value, (ts, event_id)), 6) AS result FROM events WHERE value >= 20 GROUP BY ALL),
  rec AS (SELECT user_id, round(avg(value), 6) AS cost, round(max(value), 6) AS reach FROM events GROUP BY user_id),
  j AS (SELECT rec.*, p.result AS p, v.result AS v FROM rec LEFT JOIN l p ON p.user_id = rec.user_id AND p.tool = 'purchase' LEFT JOIN l v ON v.user_id = rec.user_id AND v.tool = 'view')
"""


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stated = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("cost"), F.round(F.max("value"), 6).alias("reach"))
    return stated, records.last_ok(_calls(spark, sf_dir), "user_id", "tool", F.col("ok"), F.col("at"), "result")


@query(_AUTH + "SELECT user_id, coalesce(p, cost) AS cost, coalesce(v, reach) AS reach, concat_ws(',', CASE WHEN cost <> p THEN 'cost' END, CASE WHEN reach <> v THEN 'reach' END) AS mismatches FROM j")
def tool_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated, owned = _records(spark, sf_dir)
    return records.authoritative(stated, owned, "user_id", {"cost": "purchase", "reach": "view"}).withColumn("mismatches", F.array_join("mismatches", ","))


@query(_AUTH + "SELECT user_id, 'cost' AS field, cost IS NOT DISTINCT FROM p AS match FROM j UNION ALL SELECT user_id, 'reach', reach IS NOT DISTINCT FROM v FROM j")
def record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated, owned = _records(spark, sf_dir)
    return records.audit(stated, owned, "user_id", {"cost": "purchase", "reach": "view"}).select("user_id", "field", "match")


@query("SELECT event_id, concat_ws(',', CASE WHEN NOT value >= 5 THEN 'too_small' END, CASE WHEN NOT event_type <> 'error' THEN 'is_error' END, CASE WHEN NOT coalesce(contains(props, '1'), false) THEN 'no_one' END) AS errors FROM events")
def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"too_small": F.col("value") >= 5, "is_error": F.col("event_type") != "error", "no_one": F.col("props").contains("1")}
    return records.validated(table(spark, sf_dir, "events"), rules).select("event_id", F.array_join("errors", ",").alias("errors"))


_FORM = """'{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","lines":[' || l || ']}'"""


@query(
    f"""WITH l AS (SELECT l_orderkey, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS l FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, substr(sha256({_FORM}), 1, 16) AS record_hash FROM orders JOIN l ON l_orderkey = o_orderkey"""
)
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("lines"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    form = records.canonical(F.col("o_custkey"), F.col("o_orderstatus"), lines=F.col("lines"))
    return rows.select("o_orderkey", records.record_hash(form).alias("record_hash"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderpriority, -floor(o_totalprice), md5(o_orderkey::VARCHAR)) = 1")
def record_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("o_orderstatus") != "F", F.col("o_orderpriority"), -F.floor("o_totalprice"), F.md5(F.col("o_orderkey").cast("string"))]
    return records.selected(table(spark, sf_dir, "orders"), "o_custkey", *order).where("place = 1").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY floor(o_totalprice) DESC, o_orderkey) = 1")
def record_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return records.deduplicated(rows, "o_custkey", "o_orderpriority", F.floor("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@query(
    """WITH s AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'specified' WHEN event_type = 'error' THEN 'refused' ELSE 'failed' END AS state FROM events),
  c AS (SELECT user_id, count(*) FILTER (state = 'specified') AS specified, count(*) FILTER (state = 'refused') AS refused, count(*) FILTER (state = 'failed') AS failed FROM s GROUP BY user_id)
SELECT *, CASE WHEN refused > specified THEN 'refused' WHEN specified > 0 THEN 'specified' ELSE 'failed' END AS outcome FROM c"""
)
def sample_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type").isin("purchase", "signup"), "specified").when(F.col("event_type") == "error", "refused").otherwise("failed")
    return records.outcome(table(spark, sf_dir, "events").select("user_id", state.alias("state")), "user_id", "state")


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER w AS BIGINT) AS used, sum(length(text)) OVER w <= 1200 AS shown FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"), 1200).select("conv_id", "turn", "used", "shown")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS m FROM events GROUP BY ALL) SELECT user_id, max(m) AS agreed, CAST(sum(m) AS BIGINT) AS samples, arg_min(event_type, (-m, event_type)) AS modal FROM c GROUP BY user_id")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.agreement(table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type")


@query("SELECT t AS event_type, (SELECT count(*) FROM events WHERE event_type = t) AS n FROM (VALUES ('view'), ('click'), ('refund')) v(t)")
def tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tally(table(spark, sf_dir, "events").where("event_type in ('view', 'click', 'refund')"), "event_type", ["view", "click", "refund"])


@query("SELECT conv_id, count(*) FILTER (length(text) > 150) AS n_positive, count(*) AS k, CASE WHEN count(*) FILTER (length(text) > 150) >= 2 THEN 'positive' ELSE 'negative' END AS verdict FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def pair_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubric.pair_verdict(table(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id", F.length("text") > 150, 2)


_WORDS = {"roles": ("the", "der"), "directions": ("with", "und"), "contrasts": ("that", "die"), "forms": ("thing", "from")}


def _any(text: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9_])({'|'.join(words)})($|[^a-z0-9_])')"


@query(
    f"""WITH s AS (SELECT conv_id, turn, lower(text) AS t, list_filter(string_split_regex(regexp_replace(lower(text), '([.!?])[ \\t\\n\\r\\f]', '\\1' || chr(1), 'g'), chr(1) || '|\\n[ \\t\\n\\r\\f]*\\n'), lambda x: trim(x) <> '') AS s FROM conversations WHERE role = 'assistant'),
  w AS (SELECT *, list_transform(range(1, greatest(len(s) - 1, 1) + 1), lambda i: array_to_string(s[i:i + 1], ' ')) AS w FROM s)
SELECT conv_id, turn, len(list_filter(w, lambda x: {_any('x', _WORDS['roles'])} AND {_any('x', _WORDS['directions'])})) > 0 AS pairing,
  {_any('t', _WORDS['contrasts'])} AS contrast, {_any('t', _WORDS['forms'])} AS model_form, length(t) >= 100 AS adjustment FROM w"""
)
def rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    scored = rubric.score(F.col("text"), _WORDS["roles"], _WORDS["directions"], _WORDS["contrasts"], _WORDS["forms"], F.length("text"), 100)
    return rows.select("conv_id", "turn", scored.alias("s")).select("conv_id", "turn", "s.*")


@query()
def covariate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the first block that a cue opens; the cue is a frequent word, as the prose is invented."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.size(rubric.covariates(F.col("text"), r"\bthe\b")).alias("n"))


@query(
    """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'family' WHEN 2 THEN 'derive' ELSE 'abstain' END AS kind,
    CASE o_custkey % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'family' WHEN 2 THEN 'derive' WHEN 3 THEN 'absent' ELSE 'ambiguous' END AS verdict, [o_custkey % 3] AS keys, [o_orderkey % 3] AS gold, [o_orderkey % 2] AS acc, o_custkey % 11 <> 0 AS usable FROM orders)
SELECT o_orderkey, CASE WHEN verdict IN ('resolved', 'family') AND NOT usable THEN 'malformed'
  WHEN kind = 'exact' THEN CASE WHEN verdict = 'resolved' THEN CASE WHEN keys[1] = gold[1] THEN 'correct' ELSE 'confident_wrong' END WHEN verdict IN ('absent', 'ambiguous') THEN 'over_abstained' ELSE 'wrong' END
  WHEN kind = 'family' THEN CASE WHEN verdict = 'resolved' THEN 'confident_wrong' WHEN verdict <> 'family' THEN 'wrong' WHEN keys[1] = gold[1] THEN 'correct' WHEN keys[1] = acc[1] THEN 'arguable' ELSE 'wrong' END
  WHEN kind = 'derive' THEN CASE WHEN verdict = 'derive' THEN 'correct' WHEN verdict = 'resolved' THEN 'confident_wrong' ELSE 'wrong' END
  ELSE CASE WHEN verdict IN ('absent', 'ambiguous') THEN 'correct' WHEN verdict = 'resolved' THEN 'confident_wrong' ELSE 'wrong' END END AS outcome FROM r"""
)
def resolver_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    kind, verdict = pick(o % 4, ["exact", "family", "derive", "abstain"]), pick(c % 5, ["resolved", "family", "derive", "absent", "ambiguous"])
    out = rubric.resolver_outcome(kind, verdict, F.array(c % 3), F.array(o % 3), F.array(o % 2), c % 11 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", out.alias("outcome"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", T.parse_reply(T.unfence(fenced), "k long")["k"].alias("k"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'leaked' WHEN 1 THEN 'clean' ELSE 'inconclusive' END AS state FROM customer")
def seal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.operators import scan

    k = F.col("c_custkey") % 3
    answer = F.when(k == 0, F.concat(F.lit("No, but "), "c_name")).when(k == 1, F.lit("**No.** Nothing is loaded.")).otherwise(F.lit("Yes. It may be"))
    return table(spark, sf_dir, "customer").select("c_custkey", scan.seal_state(answer, F.col("c_name")).alias("state"))


@query("SELECT user_id, string_agg(event_type || '=' || event_id, chr(10) ORDER BY event_id) AS log FROM events GROUP BY user_id")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return records.log_lines(rows, "user_id", "event_id", F.concat_ws("=", "event_type", F.col("event_id").cast("string")))


@query("SELECT n_nationkey, 'nation ' || n_name || ' (' || n_regionkey || ')' AS prompt FROM nation")
def rendered_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", records.rendered("nation {name} ({region})", name=F.col("n_name"), region=F.col("n_regionkey")).alias("prompt"))
