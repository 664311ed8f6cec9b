"""Study records: their nested schema, every rule that a record must meet, refusals, adjudication and registries.

A rule is a Column that holds for a good record. All rules are checked, and a record carries the names of those that it
breaks; nothing is repaired but what a tool owns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import predicates
from tallyloom.functions import rules as R
from tallyloom.functions import text as T
from tallyloom.operators.documents import strings
from tallyloom.operators import enumerate, records

REF = "struct<kind:string,key:string,quoted_wording:string,derivation_id:string,component_keys:array<string>,unit:string,measure_id:string>"
COVARIATE = f"struct<variable:{REF},mechanism:string,justification:string,role:string,proxy_for:string,contestable:boolean>"
SOUGHT = "struct<construct_sought:string,search_phrases:array<string>,why_rejected:string,exposes_the_estimate_to:string>"
CURVE = "array<struct<n:int,sde_percentage_points:double>>"
EFFECT = f"struct<curve:{CURVE},worst_case_curve:{CURVE},asserted_baseline_prevalence:double,value:double,unit:string,at_n:int,assumptions:string>"
ESTIMABILITY = f"struct<analytic_n:bigint,n_source:string,modules_required:array<string>,exposure_contrast:string,collinearity_max:double,smallest_detectable_effect:{EFFECT}>"
ACCESS = "struct<decision:string,reconstruction_load:int,budget:int,location_bearing_keys:array<string>,per_place_working:string,origin_unknown_keys:array<string>>"
RATIONALE = "struct<selection_mode:string,screened_from:bigint,prior_work:string,why_this_cohort:string>"
PROVENANCE = "struct<dictionary_version:string,module_version:string,prompt_hash:string,model_id:string,weights_sha256:string,seed:bigint,tool_calls:array<string>>"
#: A protocol record as DDL: read stored records with it, or build them.
PROTOCOL = (
    f"protocol_id string, dictionary_version string, question string, exposure {REF}, outcome {REF},"
    " expected_direction struct<direction:string,magnitude:string,magnitude_source:string>, falsifier string,"
    " falsifier_threshold struct<value:double,unit:string,comparator:string>,"
    " model_spec struct<form:string,unit_of_analysis:string,clustering:string>,"
    f" adjusted_covariates array<{COVARIATE}>, excluded_variables array<{COVARIATE}>, undetermined_covariates array<{COVARIATE}>,"
    f" sought_covariates array<{SOUGHT}>, estimability {ESTIMABILITY}, access {ACCESS}, derivation_ref string,"
    f" selection_rationale {RATIONALE}, provenance {PROVENANCE}, status string, blocked_on array<string>"
)
#: A refusal as DDL.
REFUSAL = "pair_id string, dictionary_version string, reason string, statement string, evidence array<struct<tool:string,argument:string,outcome:string>>, blocked_on array<string>, what_would_unblock string"
LISTS = tuple(R.ROLES)
RESOLVED = ("unique", "is_group", "is_construct")


def ref_key(ref: Column) -> Column:
    """What a reference names: a key, a derivation or a measure of an area."""
    return F.when(ref["kind"] == "variable", ref["key"]).when(ref["kind"] == "derivation", F.concat(F.lit("derivation:"), ref["derivation_id"])).otherwise(F.concat(F.lit("area:"), ref["measure_id"]))




def _list(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))


def _covariates() -> Column:
    return F.concat(*(_list(name, COVARIATE) for name in LISTS))


def _roles_fit(name: str) -> Column:
    return F.forall(_list(name, COVARIATE), lambda c: F.coalesce(c["role"].isin(*R.ROLES[name]), F.lit(False)))


def _entails(evidence: Column, tool: str, outcomes: Sequence[str]) -> Column:
    """Whether a citation of a tool has an outcome that holds one of some words."""
    told = F.array(*map(F.lit, outcomes))
    return F.exists(evidence, lambda e: (e["tool"] == tool) & F.exists(told, lambda w: F.coalesce(e["outcome"], F.lit("")).contains(w)))


def _long(text: Column, least: int) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= least


def _said(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def derived_status(n_source: Column, blocked_on: Column, decision: Column) -> Column:
    """draft while the sample size is unknown, anything is blocked or access is not passed; else ready_for_review."""
    open_ = (n_source == "unknown") | (F.size(F.coalesce(blocked_on, F.array().cast("array<string>"))) > 0) | ~decision.eqNullSafe(F.lit("pass"))
    return F.when(open_, "draft").otherwise("ready_for_review")


def detectable_enough() -> Column:
    """Whether a threshold lies above what the study can detect: on the bound that no caller chose, at the size named."""
    t, e = F.col("falsifier_threshold"), F.col("estimability.smallest_detectable_effect")
    curved = (F.size(F.coalesce(e["curve"], F.array().cast(CURVE))) > 0) | (F.size(F.coalesce(e["worst_case_curve"], F.array().cast(CURVE))) > 0)
    floor = F.get(F.filter(e["worst_case_curve"], lambda p: p["n"] == e["at_n"]), F.lit(0))["sde_percentage_points"]
    same = e["unit"].isNull() | (t["unit"] == e["unit"])
    bound = same & floor.isNotNull() & (F.abs(t["value"]) >= F.abs(floor))
    plain = e["value"].isNotNull() & (e["unit"].isNull() | (t["unit"] != e["unit"]) | (F.abs(t["value"]) >= F.abs(e["value"])))
    return F.when(t.isNull(), True).when(curved & e["at_n"].isNotNull(), F.coalesce(bound, F.lit(False))).otherwise(F.coalesce(plain, F.lit(False)))


def protocol_rules() -> dict[str, Column]:
    """Every rule of a protocol record that it can be held to by itself, by name."""
    e, t = F.col("estimability.smallest_detectable_effect"), F.col("falsifier_threshold")
    keys = F.transform(_covariates(), lambda c: ref_key(c["variable"]))
    anchors = F.array(ref_key(F.col("exposure")), ref_key(F.col("outcome")))
    blocked = _list("blocked_on", "string")
    gaps = F.array_except(blocked, F.array(F.lit(R.PREVALENCE_BLOCKER)))
    told = F.array(F.col("question"), F.col("expected_direction.magnitude"), F.col("falsifier"), t["unit"], F.col("model_spec.form"), F.col("estimability.exposure_contrast"))
    constructs = F.transform(_list("sought_covariates", SOUGHT), lambda s: T.norm_construct(s["construct_sought"]))
    curved = t.isNotNull() & (F.size(F.coalesce(e["curve"], F.array().cast(CURVE))) > 0)
    admitted = e["at_n"].isNotNull() & ((F.col("estimability.n_source") != "unknown") | (F.size(gaps) > 0))
    known = F.col("estimability.analytic_n").isNotNull()
    return {
        "identity": _said(F.col("protocol_id")) & _said(F.col("dictionary_version")),
        "lists_not_empty": (F.size(_list("adjusted_covariates", COVARIATE)) > 0) & (F.size(_list("excluded_variables", COVARIATE)) > 0),
        "roles_match_lists": F.forall(F.array(*(_roles_fit(n) for n in LISTS)), lambda x: x),
        "no_response_coding": ~F.exists(told, lambda x: predicates.states_a_coding(x).isNotNull()),
        "no_covariate_is_an_anchor": ~F.arrays_overlap(F.coalesce(keys, F.array().cast("array<string>")), anchors),
        "no_covariate_twice": F.size(keys) == F.size(F.array_distinct(keys)),
        "no_sought_construct_twice": F.size(constructs) == F.size(F.array_distinct(constructs)),
        "threshold_names_its_size": ~curved | F.coalesce(admitted, F.lit(False)),
        "prevalence_is_admitted": e["asserted_baseline_prevalence"].isNull() | F.array_contains(blocked, R.PREVALENCE_BLOCKER),
        "falsifier_is_detectable": detectable_enough(),
        "status_is_derived": F.col("status") == derived_status(F.col("estimability.n_source"), F.col("blocked_on"), F.col("access.decision")),
        "derivation_is_referenced": ~F.coalesce((F.col("exposure.kind") == "derivation") | (F.col("outcome.kind") == "derivation"), F.lit(False)) | _said(F.col("derivation_ref")),
        "reasons_are_long_enough": F.forall(_covariates(), lambda c: _long(c["justification"], R.MIN_JUSTIFICATION) & _long(c["mechanism"], R.MIN_MECHANISM)),
        "proxies_say_for_what": F.forall(_covariates(), lambda c: F.when(c["role"] == "proxy", _said(c["proxy_for"])).otherwise(~_said(c["proxy_for"]))),
        "gaps_are_told": F.forall(
            _list("sought_covariates", SOUGHT),
            lambda s: _long(s["construct_sought"], R.MIN_CONSTRUCT)
            & _long(s["why_rejected"], R.MIN_REJECTION)
            & _long(s["exposes_the_estimate_to"], R.MIN_BIAS_STATEMENT)
            & (F.size(F.coalesce(s["search_phrases"], F.array().cast("array<string>"))) > 0)
            & F.forall(s["search_phrases"], lambda p: _long(p, R.MIN_SEARCH_PHRASE))
            & ~s["construct_sought"].rlike(R.KEY_IN_PROSE),
        ),
        "magnitude_has_a_source": ~_said(F.col("expected_direction.magnitude")) | _said(F.col("expected_direction.magnitude_source")),
        "size_and_source_agree": known == (F.col("estimability.n_source") != "unknown"),
        "screen_has_a_denominator": (F.col("selection_rationale.selection_mode") != "enumerated_screen") | F.col("selection_rationale.screened_from").isNotNull(),
        "access_is_counted": (F.col("access.reconstruction_load") >= 0) & (F.col("access.budget") >= 0),
        "provenance_is_told": F.forall(F.array(*(F.col(f"provenance.{c}") for c in ("dictionary_version", "module_version", "prompt_hash", "model_id"))), _said),
    }


def protocol_errors(protocols: DataFrame) -> DataFrame:
    """protocols with `errors`: the rules that each breaks."""
    return records.validated(protocols, protocol_rules())


def wording_errors(protocols: DataFrame, entries: DataFrame, by: str, key: str, wording: str) -> DataFrame:
    """(by, missing, reworded): keys that a record names and that no entry has, and those quoted in other words (white
    space aside). References meet entries by an equi-join on the key."""
    refs = F.concat(F.array("exposure", "outcome"), F.transform(_covariates(), lambda c: c["variable"]))
    each = protocols.select(by, F.explode(F.filter(refs, lambda r: r["kind"] == "variable")).alias("r")).select(by, F.col("r.key").alias("_k"), F.col("r.quoted_wording").alias("_q"))
    both = each.join(entries.select(F.col(key).alias("_k"), F.col(wording).alias("_w"), F.lit(True).alias("_there")), "_k", "left")
    gone, other = F.col("_there").isNull(), F.col("_there") & (T.flat(F.col("_q")) != T.flat(F.col("_w")))
    found = both.groupBy(by).agg(F.array_sort(F.collect_set(F.when(gone, F.col("_k")))).alias("missing"), F.array_sort(F.collect_set(F.when(other, F.col("_k")))).alias("reworded"))
    none = F.array().cast("array<string>")
    return protocols.select(by).join(found, by, "left").select(by, F.coalesce("missing", none).alias("missing"), F.coalesce("reworded", none).alias("reworded"))


def restated_units(protocols: DataFrame, signed: DataFrame, by: str, refs: str = "refs") -> DataFrame:
    """protocols with the unit of every derivation in an array of references taken from the signed file (derivation_id,
    unit) that it names; others stay as they are. References meet signed files by an equi-join and go back in order."""
    each = protocols.select(by, F.posexplode(refs).alias("_at", "_r")).withColumn("_d", F.when(F.col("_r.kind") == "derivation", F.col("_r.derivation_id")))
    own = each.join(signed.select(F.col("derivation_id").alias("_d"), F.col("unit").alias("_u")), "_d", "left")
    said = F.col("_r").withField("unit", F.coalesce("_u", "_r.unit"))
    back = own.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", said.alias("_r")))), lambda x: x["_r"]).alias("_new"))
    return protocols.join(back, by, "left").withColumn(refs, F.coalesce("_new", refs)).drop("_new")


def refusal_rules() -> dict[str, Column]:
    """Every rule of a refusal, by name: its lookups are cited, one of each has an outcome that entails the reason, and
    an empty registry names what would fill it."""
    evidence = F.coalesce(F.col("evidence"), F.array().cast("array<struct<tool:string,argument:string,outcome:string>>"))
    tools = F.transform(evidence, lambda e: e["tool"])
    earned = entailed = F.lit(False)
    for reason, wanted in R.REFUSALS.items():
        cited = F.size(F.array_except(F.array(*map(F.lit, wanted)), tools)) == 0
        follows = F.lit(True)
        for tool, outcomes in wanted.items():
            if outcomes:
                follows = follows & _entails(evidence, tool, outcomes)
        earned = F.when(F.col("reason") == reason, cited).otherwise(earned)
        entailed = F.when(F.col("reason") == reason, follows).otherwise(entailed)
    return {
        "reason_is_known": F.col("reason").isin(*R.REFUSALS),
        "evidence_is_cited": earned,
        "evidence_entails": entailed,
        "remedy_is_named": (F.col("reason") != "registry_empty") | (F.size(_list("blocked_on", "string")) > 0),
        "statement_is_long_enough": _long(F.col("statement"), R.MIN_STATEMENT) & _long(F.col("what_would_unblock"), R.MIN_REMEDY),
    }


def refusal_errors(refusals: DataFrame) -> DataFrame:
    return records.validated(refusals, refusal_rules())


def refusal_gate(calls: DataFrame, by: str, tool: str, reasons: DataFrame) -> DataFrame:
    """(by, reason, missing): the lookups that a reason needs and that a group's log does not hold."""
    need = reasons.sparkSession.createDataFrame([(r, list(w)) for r, w in R.REFUSALS.items()], "reason string, _need array<string>")
    seen = calls.groupBy(by).agg(F.collect_set(tool).alias("_seen"))  # at most as many as there are tools
    out = reasons.join(F.broadcast(need), "reason").join(seen, by, "left")  # eight reasons
    return out.select(by, "reason", F.array_sort(F.array_except("_need", F.coalesce("_seen", F.array().cast("array<string>")))).alias("missing"))


def adjudicated(pairs: DataFrame, resolved: DataFrame, coverage: DataFrame) -> DataFrame:
    """(pair_id, reason, blocked_on) of pairs (pair_id, exposure, outcome: struct of construct_key, member_keys,
    is_free_text), from the instrument alone: resolved (key, outcome, is_free_text) and coverage (registry, coverage,
    blocked_on). A null reason means that a record is the only answer.

    The first of an anchor's keys that resolves speaks for it; sides are judged in order, and the first that cannot be
    used gives the reason. Every key meets the instrument by an equi-join.
    """
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("a")) for i, c in enumerate_sides()))
    anchors = pairs.select("pair_id", F.explode(sides).alias("x")).select("pair_id", "x.side", "x.a")
    every = F.array_distinct(F.concat(F.array("a.construct_key"), F.coalesce("a.member_keys", F.array().cast("array<string>"))))
    keys = anchors.select("pair_id", "side", F.posexplode(every).alias("_at", "key"))
    ok = F.col("outcome").isin(*RESOLVED)
    hits = keys.join(resolved, "key", "left").groupBy("pair_id", "side").agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("_ok"), F.min_by(F.when(ok, F.coalesce("is_free_text", F.lit(False))), F.when(ok, F.col("_at"))).alias("_free"))
    prefix = F.substring_index("a.construct_key", ":", 1)
    empty = coverage.where("coverage = 'none' and blocked_on is not null").select(F.col("registry").alias("_r"), "blocked_on")
    judged = anchors.withColumn("_r", prefix).join(hits, ["pair_id", "side"]).join(empty, "_r", "left")
    unresolvable = F.when(F.col("side") == 0, "exposure_unresolvable").otherwise("outcome_unresolvable")
    reason = F.when(F.col("_ok") & (F.col("_free") | F.coalesce("a.is_free_text", F.lit(False))), "free_text_anchor").when(~F.col("_ok"), F.when(F.col("blocked_on").isNotNull(), "registry_empty").otherwise(unresolvable))
    judged = judged.withColumn("reason", reason).where("reason is not null")
    first = judged.groupBy("pair_id").agg(F.min_by(F.struct("reason", F.when(F.col("reason") == "registry_empty", F.col("blocked_on")).alias("blocked_on")), "side").alias("x"))
    same = F.col("exposure.construct_key") == F.col("outcome.construct_key")
    out = pairs.select("pair_id", same.alias("_same")).join(first, "pair_id", "left")
    return out.select("pair_id", F.when(F.col("_same"), "anchors_are_the_same_construct").otherwise(F.col("x.reason")).alias("reason"), F.when(~F.col("_same"), F.col("x.blocked_on")).alias("blocked_on"))


def enumerate_sides() -> list[tuple[int, str]]:
    return [(0, "exposure"), (1, "outcome")]


def registry_coverage(entries: DataFrame, key: str) -> DataFrame:
    """(registry, coverage, n, blocked_on): the registries with their entries, and those declared and empty."""
    counts = entries.groupBy(F.substring_index(key, ":", 1).alias("registry")).agg(F.count(F.lit(1)).alias("n"))
    every = [(r, "populated", None) for r in R.SURVEYS] + [(r, "none", b) for r, b in R.EMPTY_REGISTRIES]
    known = entries.sparkSession.createDataFrame(every, "registry string, coverage string, blocked_on string")
    return F.broadcast(known).join(counts, "registry", "left").select("registry", "coverage", F.when(F.col("coverage") == "populated", F.coalesce("n", F.lit(0))).alias("n"), "blocked_on")


def analytic_size(keys: Column) -> Column:
    """struct(modules_required, analytic_n, n_source, blocked_on) of a set of keys: the size is never known, and a set
    over several modules says what it lacks."""
    modules = F.array_sort(F.array_distinct(F.filter(F.transform(keys, lambda k: F.substring_index(k, ":", 1)), lambda m: m.startswith("m"))))
    return T.let(modules, lambda m: F.struct(m.alias("modules_required"), F.lit(None).cast("bigint").alias("analytic_n"), F.lit("unknown").alias("n_source"), F.when(F.size(m) > 1, "module_co_completion_counts").alias("blocked_on")))


def scale_hits(documents: DataFrame, by: str, document: str) -> DataFrame:
    """(by, path, pattern, text): where a whole JSON record seems to state a scale or coding; advisory, all hits."""
    each = strings(documents, by, document).withColumnRenamed("value", "text")
    exempt = F.lit(False)
    for prefix in R.SCAN_EXEMPT:
        exempt = exempt | F.col("path").startswith(prefix)
    return each.where(~exempt).select(by, "path", F.explode(R.scales_stated(F.col("text"))).alias("pattern"), "text")


def frame_pairs(constructs: DataFrame, exposures: Column, outcomes: Column) -> DataFrame:
    """The live pairs of a frame: constructs (key, module, block, is_group, is_free_text) that are exposures against those
    that are outcomes, pruned and screened. Two blocks of an instrument, so that their product is as large as the frame."""
    return enumerate.screen(enumerate.prune(enumerate.candidates(constructs.where(exposures), constructs.where(outcomes)))).where("state = 'live'")


def instrument_reach(regions: DataFrame, by: str, region: str, role: Sequence[str], column: str = "role") -> DataFrame:
    """(by, reachable): whether any region of the roles lies in the instrument; null without a region: not known."""
    some = F.when(F.col(column).isin(*role) & F.col(region).isNotNull(), R.in_instrument(F.col(region)))
    return regions.groupBy(by).agg(F.bool_or(some).alias("reachable"))
