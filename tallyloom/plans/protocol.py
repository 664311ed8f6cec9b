"""Records, refusals, adjudication, pools and whole evaluations, bound to the tables."""

from __future__ import annotations

import copy
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import rules as R
from tallyloom.operators import arms, dictionary, protocol, scan, vector
from tallyloom.plans.retrieval import _COSINES
from tallyloom.sources.readers import table
from tallyloom.sources.staging import staged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Wordings that the rules tell apart, one of which every part has ahead of its name.
WORDINGS = (
    "Have you had a mammogram?", "a melanoma diagnosis", "first told that you had gout", "How many cigarettes", "glasses of wine",
    "When do you go to bed", "miles of walking", "your occupation", "health plan", "take ibuprofen regularly", "visit to an emergency room",
    "your zip code and street address", "birth control pills", "your marital status", "your brother", "census tract of home", "nothing of note",
    "please describe your date of birth", "What is your current age", "blood cholesterol test",
)


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    qid = _pick(("Q1.2", "3_Q1.2", "Q1.2_3", "Q1.2_4_TEXT"), k)
    return table(spark, sf_dir, "part").withColumns({"wording": F.concat_ws(" ", _pick(WORDINGS, k), "p_name"), "qid": qid})


_WORDED = f"w AS (SELECT *, {_list(WORDINGS)}[p_partkey % {len(WORDINGS)} + 1] || ' ' || p_name AS wording, ['Q1.2', '3_Q1.2', 'Q1.2_3', 'Q1.2_4_TEXT'][p_partkey % 4 + 1] AS qid FROM part)"


@query(f"WITH {_WORDED} SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(wording, '(?i){p}') THEN '{n}'" for n, p in R.DOMAINS) + " ELSE 'unclassified' END AS domain FROM w")
def classify_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worded(spark, sf_dir).select("p_partkey", R.domain_of(F.col("wording")).alias("domain"))


_FLAGS = {"is_free_text": dictionary.FREE_TEXT, "is_direct_identifier": dictionary.DIRECT_IDENTIFIER, "is_quasi_identifier": dictionary.QUASI_IDENTIFIER}


@query(
    f"WITH {_WORDED} SELECT p_partkey, ends_with(qid, '_TEXT') AS is_text_companion, regexp_matches(qid, '^[0-9]+_') AS is_roster_repeat, regexp_matches(qid, '_[0-9]+(_TEXT)?$') AS is_grid_subitem,"
    + f" regexp_matches(wording, '{_FLAGS['is_free_text']}') OR ends_with(qid, '_TEXT') AS is_free_text, regexp_matches(wording, '{_FLAGS['is_direct_identifier']}') AS is_direct_identifier, regexp_matches(wording, '{_FLAGS['is_quasi_identifier']}') AS is_quasi_identifier FROM w"
)
def classify_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _worded(spark, sf_dir)
    return rows.select("p_partkey", *(c.alias(n) for n, c in dictionary.flags(F.col("wording"), F.col("qid")).items()))


_DOMAIN_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS domain, count(*) FILTER (regexp_matches(wording, '(?i){p}')) AS entries, count(*) FILTER (regexp_matches(p_type || ' ' || wording, '(?i){p}') AND p_size > 10) AS targets, count(DISTINCT CASE WHEN p_size > 10 AND regexp_matches(p_type || ' ' || wording, '(?i){q}') THEN p_brand END) AS adjacent FROM w"
    for n, p, q in R.ABSENCES
)


@query(f"WITH {_WORDED}, r AS ({_DOMAIN_ROWS}) SELECT *, entries = 0 AND targets = 0 AS absent FROM r")
def absence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _worded(spark, sf_dir)
    return scan.absence_report(rows, F.col("wording"), rows.where("p_size > 10"), F.concat_ws(" ", "p_type", "wording"), "p_brand", R.cased())


_SAID = (
    ("coded 1 = Yes", ("value_label_enumeration", "coding_claim")),
    ("a 1 to 5 scale", ("scale_range",)),
    ("a five-point item", ("n_point_scale",)),
    ("scored 0 to 27", ("scored_range",)),
    ("-99 if refused", ("missing_code",)),
    ("the response options", ("response_option_list",)),
    ("walking each week", ()),
    ("9999 = missing", ("value_label_enumeration", "missing_code")),
)


@query(
    "WITH h(i, pattern) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, (_, ps) in enumerate(_SAID) for p in ps) + "), p(path) AS (VALUES ('a'), ('b[0].c'))"
    " SELECT event_id, path, pattern FROM events JOIN h ON i = event_id % 8, p"
)
def scale_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that state a scale in two places, and once more in the transcript of tools, which is exempt."""
    said = _pick([s for s, _ in _SAID], F.col("event_id"))
    whole = F.struct(said.alias("a"), F.array(F.struct(said.alias("c"))).alias("b"), F.struct(F.array(said).alias("tool_calls")).alias("provenance"))
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(whole).alias("record"))
    return protocol.scale_hits(rows, "event_id", "record").select("event_id", "path", "pattern")


_REF = {"kind": "variable", "key": "m3:Q16.1", "quoted_wording": "w"}
_GOOD = {
    "protocol_id": "p", "dictionary_version": "v", "question": "Does walking lower blood pressure?", "exposure": _REF, "outcome": _REF | {"key": "m2:Q5.1"},
    "expected_direction": {"direction": "decrease"}, "falsifier": "no difference between the groups", "falsifier_threshold": {"value": 12.0, "unit": "percentage points", "comparator": ">="},
    "model_spec": {"form": "logistic regression", "unit_of_analysis": "participant", "clustering": "community area"},
    "adjusted_covariates": [{"variable": _REF | {"key": "m1:Q3.1"}, "mechanism": "age changes both of the anchors", "justification": "age is a cause of both of the sides", "role": "confounder"}],
    "excluded_variables": [{"variable": _REF | {"key": "m1:Q3.2"}, "mechanism": "weight lies on the path between", "justification": "weight follows walking and changes it", "role": "mediator"}],
    "undetermined_covariates": [{"variable": _REF | {"key": "m1:Q3.3"}, "mechanism": "which of them came first is not told", "justification": "temporality cannot be recovered here", "role": "unadjudicated"}],
    "sought_covariates": [{"construct_sought": "dietary sodium intake", "search_phrases": ["sodium"], "why_rejected": "nothing that measures it came back", "exposes_the_estimate_to": "confounding by diet of both sides"}],
    "estimability": {
        "n_source": "unknown", "modules_required": ["m2", "m3"], "exposure_contrast": "per one standard deviation",
        "smallest_detectable_effect": {"curve": [{"n": 1000, "sde_percentage_points": 8.0}], "worst_case_curve": [{"n": 1000, "sde_percentage_points": 8.86}], "asserted_baseline_prevalence": 0.2, "value": 8.0, "unit": "percentage points", "at_n": 1000, "assumptions": "a"},
    },
    "access": {"decision": "pass", "reconstruction_load": 1, "budget": 3, "per_place_working": "w"},
    "selection_rationale": {"selection_mode": "enumerated_screen", "screened_from": 256, "prior_work": "w", "why_this_cohort": "w"},
    "provenance": {"dictionary_version": "v", "module_version": "v", "prompt_hash": "h", "model_id": "m"},
    "status": "draft", "blocked_on": ["module_co_completion_counts", R.PREVALENCE_BLOCKER],
}


def _changed(path: str, value) -> dict:
    out = copy.deepcopy(_GOOD)
    at, *rest = path.split(".")
    here = out
    for step in [at, *rest][:-1]:
        here = here[int(step)] if step.isdigit() else here[step]
    last = [at, *rest][-1]
    here[int(last) if last.isdigit() else last] = value
    return out


#: Records that each break what is named behind them.
VARIANTS = (
    (_GOOD, ""),
    (_changed("protocol_id", " "), "identity"),
    (_changed("excluded_variables", []), "lists_not_empty"),
    (_changed("adjusted_covariates.0.role", "mediator"), "roles_match_lists"),
    (_changed("question", "Is it coded 1 = Yes in m1:Q3.1?"), "no_response_coding"),
    (_changed("adjusted_covariates.0.variable.key", "m2:Q5.1"), "no_covariate_is_an_anchor"),
    (_changed("undetermined_covariates.0.variable.key", "m1:Q3.1"), "no_covariate_twice"),
    (_changed("sought_covariates", [*_GOOD["sought_covariates"], _GOOD["sought_covariates"][0] | {"construct_sought": "Dietary  sodium intake."}]), "no_sought_construct_twice"),
    (_changed("estimability.smallest_detectable_effect.at_n", None), "threshold_names_its_size"),
    (_changed("blocked_on", [R.PREVALENCE_BLOCKER]), "threshold_names_its_size"),
    (_changed("blocked_on", ["module_co_completion_counts"]), "prevalence_is_admitted"),
    (_changed("falsifier_threshold.value", 8.5), "falsifier_is_detectable"),
    (_changed("falsifier_threshold.unit", "odds ratio"), "falsifier_is_detectable"),
    (_changed("status", "ready_for_review"), "status_is_derived"),
    (_changed("exposure", {"kind": "derivation", "derivation_id": "d"}), "derivation_is_referenced"),
    (_changed("adjusted_covariates.0.justification", "short"), "reasons_are_long_enough"),
    (_changed("adjusted_covariates.0.role", "proxy"), "proxies_say_for_what"),
    (_changed("sought_covariates.0.why_rejected", "none"), "gaps_are_told"),
    (_changed("sought_covariates.0.construct_sought", "the m2:Q5.8 of the person"), "gaps_are_told"),
    (_changed("expected_direction.magnitude", "10 mmHg"), "magnitude_has_a_source"),
    (_changed("estimability.analytic_n", 1000), "size_and_source_agree"),
    (_changed("selection_rationale.screened_from", None), "screen_has_a_denominator"),
    (_changed("access.reconstruction_load", -1), "access_is_counted"),
    (_changed("provenance.model_id", ""), "provenance_is_told"),
    (_changed("falsifier_threshold", None), ""),
)


def _expected(variants) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{e}')" for i, (_, e) in enumerate(variants)) + ")"


def _stored(spark: SparkSession, sf_dir: str, variants, schema: str) -> DataFrame:
    """An order's record: one of some variants, read from its JSON."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _pick([json.dumps(v) for v, _ in variants], F.col("o_orderkey")).alias("j"))
    return rows.select("o_orderkey", F.from_json("j", schema).alias("r")).select("o_orderkey", "r.*")


@query(f"SELECT o_orderkey, errors FROM orders JOIN {_expected(VARIANTS)} v(i, errors) ON i = o_orderkey % {len(VARIANTS)}")
def protocol_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocol.protocol_errors(_stored(spark, sf_dir, VARIANTS, protocol.PROTOCOL))
    return found.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 25 = 6 THEN '' ELSE 'm1:Q3.3' END AS missing, CASE WHEN o_orderkey % 25 = 2 THEN '' ELSE 'm1:Q3.2' END AS reworded FROM orders")
def wording_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys of the records are worded as quoted, one otherwise, and one is not in the instrument."""
    entries = spark.createDataFrame([("m3:Q16.1", " w\n"), ("m2:Q5.1", "w"), ("m1:Q3.1", "w"), ("m1:Q3.2", "other")], "key string, wording string")
    stored = _stored(spark, sf_dir, VARIANTS, protocol.PROTOCOL)
    found = protocol.wording_errors(stored, entries, "o_orderkey", "key", "wording")
    return found.select("o_orderkey", F.array_join("missing", ",").alias("missing"), F.array_join("reworded", ",").alias("reworded"))


_NO = {"pair_id": "p", "dictionary_version": "v", "reason": "registry_empty", "statement": "the exposure lies in a registry that is empty", "what_would_unblock": "an inventory of area measures", "blocked_on": ["area_measure_inventory"]}
_CITED = [{"tool": "registry_coverage", "argument": "linked", "outcome": "linked: coverage none"}, {"tool": "resolve_variable", "argument": "linked:x", "outcome": "not_found"}]
REFUSED = (
    (_NO | {"evidence": _CITED}, ""),
    (_NO | {"evidence": _CITED[:1]}, "evidence_is_cited,evidence_entails"),
    (_NO | {"evidence": [_CITED[0], _CITED[1] | {"outcome": "unique"}]}, "evidence_entails"),
    (_NO | {"evidence": _CITED, "blocked_on": []}, "remedy_is_named"),
    (_NO | {"evidence": _CITED, "statement": "no"}, "statement_is_long_enough"),
    (_NO | {"evidence": _CITED, "reason": "too_hard"}, "reason_is_known,evidence_is_cited,evidence_entails"),
    (_NO | {"evidence": [{"tool": "check_access", "argument": "x", "outcome": "ok"}], "reason": "access_gate_refused"}, "evidence_entails"),
    (_NO | {"evidence": [{"tool": "list_derivations", "argument": "", "outcome": "ok"}], "reason": "no_signed_derivation"}, ""),
)


@query(f"SELECT o_orderkey, errors FROM orders JOIN {_expected(REFUSED)} v(i, errors) ON i = o_orderkey % {len(REFUSED)}")
def refusal_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocol.refusal_errors(_stored(spark, sf_dir, REFUSED, protocol.REFUSAL))
    return found.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query(
    """WITH s AS (SELECT user_id, list_sort(list(DISTINCT CASE event_type WHEN 'view' THEN 'resolve_variable' WHEN 'click' THEN 'registry_coverage' ELSE 'check_access' END)) AS seen FROM events WHERE value < 5 GROUP BY user_id),
  u AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'registry_empty' WHEN 1 THEN 'access_gate_refused' ELSE 'no_signed_derivation' END AS reason FROM events),
  n(reason, need) AS (VALUES ('registry_empty', ['registry_coverage', 'resolve_variable']), ('access_gate_refused', ['check_access']), ('no_signed_derivation', ['list_derivations']))
SELECT u.user_id, u.reason, array_to_string(list_filter(need, lambda x: NOT list_contains(coalesce(seen, []), x)), ',') AS missing FROM u JOIN n USING (reason) LEFT JOIN s ON s.user_id = u.user_id"""
)
def refusal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    tool = F.when(F.col("event_type") == "view", "resolve_variable").when(F.col("event_type") == "click", "registry_coverage").otherwise("check_access")
    reasons = events.select("user_id").distinct().withColumn("reason", _pick(("registry_empty", "access_gate_refused", "no_signed_derivation"), F.col("user_id")))
    found = protocol.refusal_gate(events.where("value < 5").select("user_id", tool.alias("tool")), "user_id", "tool", reasons)
    return found.withColumn("missing", F.array_join("missing", ","))


@query(
    """SELECT c_custkey AS pair_id, CASE WHEN k = 0 THEN 'anchors_are_the_same_construct' WHEN k = 1 THEN 'registry_empty' WHEN k = 3 THEN 'exposure_unresolvable' WHEN c_custkey % 9 = 0 THEN 'free_text_anchor'
  WHEN k = 4 THEN 'outcome_unresolvable' WHEN (c_custkey + 1) % 9 = 0 THEN 'free_text_anchor' END AS reason, CASE WHEN k = 1 THEN 'area_measure_inventory' END AS blocked_on
FROM (SELECT c_custkey, c_custkey % 6 AS k FROM customer)"""
)
def adjudicated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs over the parts' keys, some of which lie in an empty registry, nowhere, or are free text."""
    entries = table(spark, sf_dir, "part").select(F.concat(F.lit("m1:"), F.col("p_partkey").cast("string")).alias("key"), F.lit("unique").alias("outcome"), (F.col("p_partkey") % 9 == 0).alias("is_free_text"))
    c, k = F.col("c_custkey"), F.col("c_custkey") % 6
    own, after = F.concat(F.lit("m1:"), c.cast("string")), F.concat(F.lit("m1:"), (c + 1).cast("string"))
    none = F.array().cast("array<string>")
    anchor = lambda key, members: F.struct(key.alias("construct_key"), members.alias("member_keys"), F.lit(False).alias("is_free_text"))
    exposure = anchor(F.when(k == 1, F.concat(F.lit("linked:a"), c.cast("string"))).when(k.isin(2, 3), F.concat(F.lit("m1:none"), c.cast("string"))).otherwise(own), F.when(k == 2, F.array(F.lit("m1:zz"), own)).otherwise(none))
    outcome = anchor(F.when(k == 0, own).when(k == 4, F.lit("m2:none")).otherwise(after), none)
    pairs = table(spark, sf_dir, "customer").select(c.alias("pair_id"), exposure.alias("exposure"), outcome.alias("outcome"))
    return protocol.adjudicated(pairs, entries, protocol.registry_coverage(entries, "key"))


@query(
    "WITH n AS (SELECT 'm' || (l_orderkey % 2 + 1) AS registry, count(*) AS n FROM lineitem GROUP BY 1), r(registry, coverage, blocked_on) AS (VALUES ('m1', 'populated', NULL), ('m2', 'populated', NULL), ('m3', 'populated', NULL), ('clinical', 'none', 'study_team_confirmation'),"
    " ('lab', 'none', 'study_team_confirmation'), ('linked', 'none', 'area_measure_inventory'), ('ehr', 'none', 'study_team_confirmation')) SELECT registry, coverage, CASE WHEN coverage = 'populated' THEN coalesce(n, 0) END AS n, blocked_on FROM r LEFT JOIN n USING (registry)"
)
def registry_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), (F.col("l_orderkey") % 2 + 1).cast("string"), F.lit(":Q1")).alias("key"))
    return protocol.registry_coverage(keys, "key")


@query("WITH m AS (SELECT o_custkey, list_sort(list(DISTINCT 'm' || (o_orderkey % 3 + 1))) AS m FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(m, ',') AS modules, 'unknown' AS n_source, CASE WHEN len(m) > 1 THEN 'module_co_completion_counts' END AS blocked_on FROM m")
def analytic_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("m"), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit(":Q"), F.col("o_orderkey").cast("string"))
    sets = table(spark, sf_dir, "orders").select("o_custkey", F.substring_index(key, ":", 1).alias("key")).distinct().groupBy("o_custkey").agg(F.collect_list(F.concat("key", F.lit(":Q"))).alias("keys"))
    found = sets.select("o_custkey", protocol.analytic_size(F.array_append("keys", F.lit("lab:x"))).alias("s"))
    return found.select("o_custkey", F.array_join("s.modules_required", ",").alias("modules"), "s.n_source", "s.blocked_on")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' ELSE 'mean score' END || ',' || 'own' AS units FROM orders")
def restated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derivation that is signed takes its unit; one that is not, and a variable, keep what they say."""
    signed = spark.createDataFrame([("d1", "mean score"), ("d2", "mean score")], "derivation_id string, unit string")
    k = F.col("o_orderkey") % 3
    ref = F.struct(F.lit("derivation").alias("kind"), F.concat(F.lit("d"), k.cast("string")).alias("derivation_id"), F.lit("kept").alias("unit"))
    other = F.struct(F.lit("variable").alias("kind"), F.lit("d1").alias("derivation_id"), F.lit("own").alias("unit"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(ref, other).alias("refs"))
    return protocol.restated_units(rows, signed, "o_orderkey").select("o_orderkey", F.array_join(F.transform("refs", lambda r: r["unit"]), ",").alias("units"))


@query(
    "SELECT e.n_nationkey AS e_key, o.n_nationkey AS o_key FROM nation e, nation o WHERE e.n_regionkey IN (1, 3) AND o.n_regionkey IN (2, 3) AND e.n_nationkey <> o.n_nationkey"
    " AND e.n_nationkey % 7 <> 0 AND o.n_nationkey % 7 <> 0 AND NOT (e.n_regionkey = o.n_regionkey AND e.n_nationkey % 3 = o.n_nationkey % 3)"
)
def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    constructs = table(spark, sf_dir, "nation").select(k.alias("key"), F.col("n_regionkey").alias("module"), (k % 3).alias("block"), (k % 4 == 0).alias("is_group"), (k % 7 == 0).alias("is_free_text"))
    return protocol.frame_pairs(constructs, F.col("module").isin(1, 3), F.col("module").isin(2, 3)).select("e_key", "o_key")


@query(
    "SELECT o_custkey, bool_or(o_orderstatus = 'F') FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P') AS reachable FROM orders GROUP BY o_custkey"
)
def instrument_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.when(F.col("o_orderstatus") == "F", "m2 section 5").when(F.col("o_orderstatus") == "O", "recruitment")
    rows = table(spark, sf_dir, "orders").select("o_custkey", region.alias("region"), "o_orderpriority")
    return protocol.instrument_reach(rows, "o_custkey", "region", ("1-URGENT", "2-HIGH"), "o_orderpriority")


@query(
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'household member' WHEN 2 THEN 'pregnancy' WHEN 3 THEN 'sibling' ELSE 'child' END AS population, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS instances FROM part"
)
def expansion_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    construct = F.concat(_pick(("m3:Q1", "m1:Q6", "m2:Q8", "m2:Q16", "m2:Q18"), k), F.lit(".2"))
    fields = R.expansion_fields(construct, F.when(k % 5 > 0, F.lit(4)), F.when(k % 3 > 0, F.lit(1)), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", fields.alias("f"))
    return rows.select("p_partkey", "f.population", F.array_join("f.instances", ",").alias("instances"))


@query(
    """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_custkey + 4 END AS gold FROM customer), n AS (SELECT count(*) AS n, max(p_partkey) AS last FROM part)
SELECT 'frozen' AS arm, id, 3 AS size, CASE WHEN gold IS NOT NULL THEN true END AS reachable, CASE WHEN gold IS NOT NULL THEN 3 END AS first FROM c
UNION ALL SELECT 'searched', id, 2, CASE WHEN gold IS NOT NULL THEN id % 2 = 1 END, CASE WHEN gold IS NOT NULL AND id % 2 = 1 THEN 2 END FROM c
UNION ALL SELECT 'whole_instrument', id, n, CASE WHEN gold IS NOT NULL THEN gold <= last END, CASE WHEN gold <= last THEN gold - (SELECT min(p_partkey) FROM part) + 1 END FROM c, n"""
)
def pool_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    key = lambda x: F.concat(F.lit("k"), x.cast("string"))
    customers = table(spark, sf_dir, "customer")
    fixture = customers.select(c.alias("id"), F.array(key(c), key(c + 2), key(c + 4)).alias("pool"))
    hits = customers.select(c.alias("id"), F.explode(F.array(F.struct(key(c + 1).alias("key"), F.lit(1).alias("rank")), F.struct(key(c + F.when(c % 2 == 1, 4).otherwise(9)).alias("key"), F.lit(2).alias("rank")), F.struct(key(c + 4).alias("key"), F.lit(46).alias("rank")))).alias("h")).select("id", "h.*")
    gold = customers.select(c.alias("id"), F.when(c % 4 > 0, key(c + 4)).alias("key"))
    entries = table(spark, sf_dir, "part").select(key(F.col("p_partkey")).alias("key"), F.col("p_partkey").alias("ord"))
    return arms.pool_arms(fixture, hits, entries, gold)


def _streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Four streams of scores for each item, from the nearest vectors of four queries, and a gold key for each."""
    rows = table(spark, sf_dir, "embeddings")
    hits = vector.similar(rows.where(F.col("vec_id") % 10 == 0), rows, 12)
    q = F.floor(F.col("query_id") / 10)
    scores = hits.select((q % 4).cast("long").alias("stream"), F.floor(q / 4).alias("item"), F.col("doc_id").alias("key"), "score")
    scores = staged(scores.groupBy("stream", "item", "key").agg(F.max("score").alias("score")))  # searched once
    return scores, scores.where("stream = 1").groupBy("item").agg(F.min("key").alias("key"))


_ITEMS = _COSINES.replace("vec_id % 50", "vec_id % 10").rstrip() + """,
  sc AS (SELECT CAST(floor(query_id / 10) AS BIGINT) % 4 AS stream, CAST(floor(floor(query_id / 10) / 4) AS BIGINT) AS item, doc_id AS key, max(round(raw, 12)) AS score FROM hits WHERE rank <= 12 GROUP BY ALL),
  gold AS (SELECT item, min(key) AS key FROM sc WHERE stream = 1 GROUP BY item),
  rk AS (SELECT *, row_number() OVER (PARTITION BY item, stream ORDER BY score DESC, key) AS place FROM sc),
  singles AS (SELECT s.item, s.stream, min(rk.place) FILTER (rk.key = gold.key) AS place FROM (SELECT DISTINCT item, stream FROM sc) s JOIN gold USING (item) JOIN rk ON rk.item = s.item AND rk.stream = s.stream GROUP BY ALL)"""
_EXPRESSIONS = {"max_cos": "max(score)", "min_rank": "-min(place) + (max(score) + 1.0) / 4.0", "mean_cos": "avg(score)", "rrf": "sum(1.0 / (60 + place))"}


def _ranked(rule: str, where: str = "true", ranks: str = "rk") -> str:
    f = f"(SELECT item, key, round({_EXPRESSIONS[rule]}, 9) AS f FROM {ranks} WHERE {where} GROUP BY item, key)"
    return f"SELECT '{rule}' AS rule, g.item, (SELECT CASE WHEN count(*) FILTER (x.key = g.key) > 0 THEN 1 + count(*) FILTER (x.f > o.f OR (x.f = o.f AND x.key < g.key)) END FROM {f} x, (SELECT max(f) AS f FROM {f} y WHERE y.item = g.item AND y.key = g.key) o WHERE x.item = g.item) AS rank FROM gold g"


@query(
    f"{_ITEMS}, fused AS (" + " UNION ALL ".join(_ranked(r) for r in _EXPRESSIONS) + """),
  every AS (SELECT * FROM fused UNION ALL SELECT 'oracle', item, min(place) FROM singles GROUP BY item UNION ALL SELECT 'single', item, place FROM singles),
  r AS (SELECT rule, count(*) AS n, count(*) FILTER (rank <= 1) / count(*) AS r1, count(*) FILTER (rank <= 10) / count(*) AS r10 FROM every GROUP BY rule)
SELECT rule, n, r1 AS r_at_1, r10 AS r_at_10, round((r1 - (SELECT r1 FROM r WHERE rule = 'single')) / nullif((SELECT r1 FROM r WHERE rule = 'oracle') - (SELECT r1 FROM r WHERE rule = 'single'), 0), 9) AS recovery FROM r"""
)
def fusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.fusion_report(*_streams(spark, sf_dir)).withColumn("recovery", F.round("recovery", 9))


@query(f"{_ITEMS}, " + ", ".join(f"l{s} AS ({_ranked('mean_cos', f'stream <> {s}')})" for s in range(4)) + " " + " UNION ALL ".join(f"SELECT {s} AS left_out, count(*) AS n, count(*) FILTER (rank <= 1) / count(*) AS r_at_1 FROM l{s}" for s in range(4)))
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.leave_one_out(*_streams(spark, sf_dir), "mean_cos", range(4))


@query(
    f"{_ITEMS}, fused AS ({_ranked('max_cos')}), k AS (SELECT item, count(*) FILTER (place = 1) AS k FROM singles GROUP BY item), j AS (SELECT k, count(*) AS n, count(*) FILTER (rank = 1) AS f FROM k JOIN fused USING (item) GROUP BY k)"
    " SELECT t.k::BIGINT AS k, coalesce(n, 0) AS n, coalesce(f, 0) AS now_first FROM (SELECT unnest(range(0, 5)) AS k) t LEFT JOIN j ON j.k = t.k"
)
def rescued_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.rescued(*_streams(spark, sf_dir), "max_cos", 4)


@query(
    f"{_ITEMS}, fused AS (" + " UNION ALL ".join(_ranked(r) for r in ("max_cos", "rrf")) + """), b AS (SELECT item, place = 1 AS was FROM singles WHERE stream = 0),
  t AS (SELECT rule, count(*) FILTER (NOT coalesce(was, false) AND coalesce(rank = 1, false)) AS gained, count(*) FILTER (coalesce(was, false) AND NOT coalesce(rank = 1, false)) AS lost, count(*) AS n, count(*) FILTER (rank = 1) / count(*) AS r_at_1 FROM fused JOIN b USING (item) GROUP BY rule)
SELECT rule, gained, lost, n - gained - lost AS unchanged, n, (gained - lost) / n AS delta, r_at_1 FROM t"""
)
def rewriter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused rules against the first stream alone; p is compared by another query, the interval by tests."""
    scores, gold = _streams(spark, sf_dir)
    base = arms.stream_ranks(scores, gold).where("stream = 0").select("item", "rank")
    ranks = arms.fused_ranks(scores, gold, ["max_cos", "rrf"]).withColumn("cluster", F.floor(F.col("item") / 2))
    return arms.rewriter_report(ranks, base, "item", "cluster").select("rule", "gained", "lost", "unchanged", "n", "delta", "r_at_1")


_A = "j AS (SELECT lang, quality = 1 AS positive, toxic = 0 AS correct, n_chars % 97 / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


@query(
    f"""WITH {_A}, c AS (SELECT lang, score AS tau FROM j WHERE positive GROUP BY ALL),
  s AS (SELECT c.lang, c.tau, count(*) FILTER (positive AND score >= tau) AS a, count(*) FILTER (positive AND correct AND score >= tau) AS k, count(*) FILTER (positive) AS tp, count(*) FILTER (NOT positive AND score >= tau) AS n, count(*) FILTER (NOT positive) AS tn FROM c JOIN j USING (lang) GROUP BY ALL),
  f AS (SELECT *, round(2 * k / (a + tp), 9) AS f1 FROM s),
  b AS (SELECT lang, arg_max(tau, f1 * 1e9 - tau) AS tau, max(f1) AS max_f1, arg_max(1 - n / tn, f1 * 1e9 - tau) AS rejected_at_tau FROM f GROUP BY lang)
SELECT l.lang, round((SELECT sum(CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / count(*) FROM j p, j q WHERE p.lang = l.lang AND q.lang = l.lang AND p.positive AND NOT q.positive), 9) AS auroc_all,
  round((SELECT sum(CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / count(*) FROM j p, j q WHERE p.lang = l.lang AND q.lang = l.lang AND p.positive AND p.correct AND NOT q.positive), 9) AS auroc_correct,
  round((SELECT sum(CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / count(*) FROM j p, j q WHERE p.lang = l.lang AND q.lang = l.lang AND p.positive AND p.correct AND q.positive AND NOT q.correct), 9) AS auroc_right_wrong,
  l.p AS n_positive, l.n AS n_negative, b.tau, b.max_f1, round(b.rejected_at_tau, 9) AS rejected_at_tau, round(l.r, 9) AS rejected_at_fixed, round(l.k, 9) AS r_at_1
FROM (SELECT lang, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n, count(*) FILTER (NOT positive AND score < 0.25) / count(*) FILTER (NOT positive) AS r, count(*) FILTER (positive AND correct) / count(*) FILTER (positive) AS k FROM j GROUP BY lang) l JOIN b USING (lang)
WHERE l.p > 0 AND l.n > 0"""
)
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select("lang", (F.col("quality") == 1).alias("positive"), (F.col("toxic") == 0).alias("correct"), (F.col("n_chars") % 97 / 100.0).alias("score"))
    found = arms.abstention(rows, "lang", 0.25).where("n_positive > 0 and n_negative > 0")
    shown = ("auroc_all", "auroc_correct", "auroc_right_wrong", "rejected_at_tau", "rejected_at_fixed", "r_at_1")
    return found.select("lang", *(F.round(c, 9).alias(c) for c in shown), "n_positive", "n_negative", "tau", "max_f1")


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars % 97 < 25) AS rejected, max(n_chars % 97 / 100.0::DOUBLE) AS largest FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY lang, source")
def negatives_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")
    return arms.negatives_by(rows.withColumn("score", F.col("n_chars") % 97 / 100.0), ["lang", "source"], 0.25)


@query(
    """WITH c AS (SELECT c_custkey AS id, c_custkey % 7 AS pool, c_custkey % 5 AS asked FROM customer),
  s AS (SELECT id, pool, asked, s, CASE WHEN (id + s) % 4 > 0 THEN CASE WHEN s = 2 THEN id % 3 ELSE 0 END END AS first FROM c, (VALUES (0), (1), (2)) t(s)),
  p AS (SELECT id, any_value(pool) AS pool, any_value(asked) AS asked, count(first) AS returned FROM s GROUP BY id),
  b AS (SELECT *, CASE WHEN pool = 0 THEN 'no_pool' WHEN returned < 2 THEN 'too_few_samples' END AS blocked FROM p),
  g AS (SELECT *, CASE WHEN blocked IS NULL THEN greatest(0, least(asked, 6)) ELSE 0 END AS granted FROM b),
  votes AS (SELECT s.id, first FROM s UNION ALL SELECT id, 1 FROM g, (VALUES (0), (1)) t(s) WHERE granted > 0),
  agreed AS (SELECT id, max(m) AS agreed FROM (SELECT id, first, count(*) AS m FROM votes WHERE first IS NOT NULL GROUP BY ALL) GROUP BY id)
SELECT g.id, CAST(3 + granted AS BIGINT) AS drawn, returned, agreed, CAST(granted AS INTEGER) AS granted, CASE WHEN blocked IS NULL THEN CASE WHEN granted > 0 THEN CASE WHEN g.id % 2 = 0 THEN 'correct' ELSE 'confident_wrong' END ELSE 'over_abstained' END END AS outcome, blocked
FROM g LEFT JOIN agreed ON agreed.id = g.id"""
)
def resolver_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shortlists for every customer, two more where asked for; the first verdict abstains, the second names a key."""
    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    text = lambda x: x.cast("string")
    queries = customers.select(c.alias("id"), F.lit("exact").alias("kind"), (c % 7).alias("pool_size"), F.array(text(c % 2)).alias("gold"), F.array(F.lit("-")).alias("accepted"))
    first = F.explode(F.array(*(F.struct(F.lit(1).alias("pass"), F.when((c + s) % 4 > 0, text(c % 3) if s == 2 else F.lit("0")).alias("first")) for s in range(3)), *(F.struct(F.lit(2).alias("pass"), F.lit("1").alias("first")) for _ in range(2))))
    samples = customers.select(c.alias("id"), first.alias("x")).select("id", "x.*")
    both = F.explode(F.array(F.struct(F.lit(1).alias("pass"), F.lit("ambiguous").alias("verdict"), F.array().cast("array<string>").alias("keys"), (c % 5).cast("int").alias("asked")), F.struct(F.lit(2).alias("pass"), F.lit("resolved").alias("verdict"), F.array(F.lit("0")).alias("keys"), F.lit(0).alias("asked"))))
    verdicts = customers.select(c.alias("id"), both.alias("x")).select("id", "x.*")
    return arms.resolver_run(queries, samples, verdicts).withColumn("granted", F.col("granted").cast("int"))


@query()
def template_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search that spells its requests by the template, with the model-free encoder; a test compares it by hand."""
    from tallyloom.operators import seams

    docs = seams.encode(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), "text"), "text", seams.hashing_encoder)
    none = F.array().cast("array<string>")
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("vec_id"), F.col("text").alias("construct"), F.lit("adults").alias("population"), F.lit(None).cast("string").alias("timeframe"), none.alias("instances"))
    return arms.search_request(asked, docs, seams.hashing_encoder, 3)


@query("SELECT event_type AS tool, CASE WHEN value >= 20 THEN 'ok' ELSE 'error' END AS outcome, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY ALL")
def tool_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.surface(table(spark, sf_dir, "events"), "event_type", F.col("value") >= 20, F.col("props"))
