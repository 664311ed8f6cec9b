"""Rule tables: domains of wordings, absences, scales, registries, roles, refusals and the floors of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import text as T

# Domains of a wording by what it says, first match wins, in any case.
DOMAINS = (
    ("cancer_screening", r"colonoscopy|sigmoidoscopy|barium enema|mammogram|pap smear|\bpsa\b|digital rectal exam|screening"),
    ("cancer_history", r"cancer|tumor|tumour|melanoma|lymphoma|leukemia|leukaemia|myeloma|carcinoma|chemotherapy|radiation therapy|oncolog"),
    (
        "chronic_condition",
        r"first told that you had|diabet|hypertension|blood pressure|cholesterol|asthma|\bcopd\b|emphysema|heart attack"
        r"|\bstroke\b|arthritis|kidney|liver|depress|anxiet|thyroid|blood clot|anemia|osteoporosis|\bulcer\b|\bgout\b"
        r"|health condition|serious illness|medical condition",
    ),
    ("tobacco", r"cigarette|smok|tobacco|\bvap\b|vaping|nicotine|\bcigar\b|hookah|electronic delivery|snuff|chewing tobacco"),
    ("alcohol", r"alcohol|\bdrink\b|drinks|drinking|\bbeer\b|\bwine\b|liquor"),
    ("sleep", r"\bsleep|wake up|go to bed|\bnap\b|snor|insomnia"),
    (
        "physical_activity",
        r"exercis|walking|\bwalk\b|physical activ|\bsport|bicycl|recreational activit|in what seasons|during these seasons"
        r"|seasons that you|\bchores\b|\byoga\b|pilates|tai chi|\bgolf\b|home repair|garden|mow|\bswim|\bdanc"
        r"|time per day did you spend",
    ),
    (
        "ses_employment",
        r"employ|occupation|\bjob\b|income|wage|salary|work status|currently a student|highest.*(?:grade|degree|education)"
        r"|stress.*at work|work for pay|personal finances",
    ),
    (
        "insurance_access",
        r"insurance|medicaid|medicare|health plan|coverage|usual source of care|delay.*care|afford|out of pocket"
        r"|cost of your medical care|medical care costs|not able to get medical care|needed medical care",
    ),
    (
        "medication",
        r"\bmetformin\b|\binsulin\b|naproxen|ibuprofen|acetaminophen|\baspirin\b|antihistamine|\bstatin|celecoxib|\bnsaid"
        r"|prescription hormone|\bopioid|proton pump|ever taken .* regularly|taking .* regularly|did pain interfere",
    ),
    (
        "healthcare_util",
        r"emergency room|\bdoctor|\bnurse|hospital|health care|healthcare|\bclinic|prescription|medicine|medication|pharmac"
        r"|seen a doctor|overnight|medical care|quality of medical care|where do you usually go",
    ),
    (
        "residence_commute",
        r"commute|\baddress\b|live in|residence|transportation|neighborhood|neighbourhood|zip code|what state|what city"
        r"|moved into|source of water|tap water|baths or showers",
    ),
    (
        "reproductive_hormonal",
        r"hormone|pregnan|menstrua|menopaus|contracept|birth control|breastfe|hysterectomy|ovar|estrogen|progestin",
    ),
    (
        "demographics",
        r"sex was classified|gender identity|marital status|hispanic|\brace\b|religio|birthday|how old are you|height|weight"
        r"|country|years have you lived|how you think of yourself|closer description to your gender",
    ),
    (
        "family_roster",
        r"sibling|this child|your child|parent|mother|father|brother|sister|household|relative|other people live with you"
        r"|additional contact",
    ),
)
# Domains that an instrument must not hold, with what would show them and what may stand beside them.
ABSENCES = (
    (
        "ambient_air_pollution",
        r"pm2\.?5|air quality|particulate|\bozone\b|\bno2\b|air pollut\w* (?:level|concentration|exposure|index)|smog",
        r"pollut|environment",
    ),
    (
        "area_deprivation",
        r"deprivation index|\badi\b|social vulnerability|\bsvi\b|census block group|poverty rate|rural-urban commuting|\bruca\b|area-level",
        r"income|neighborhood|neighbourhood",
    ),
    (
        "geocode_spatial",
        r"census tract|geocod|latitude|longitude|block group|fips|coordinate|green space",
        r"zip code|street address|what state do you live|what city do you live",
    ),
    (
        "biospecimen_assay",
        r"biospecimen|blood draw|\bserum\b|\bplasma\b|\bassay\b|biomarker|genotyp|cotinine|saliva|swab|hba1c|\ba1c\b|blood lead",
        r"blood cholesterol|blood test|diabet",
    ),
    (
        "genomics_ancestry",
        r"ancestry inform|\bsnp\b|polygenic|genom|\bdna\b|\bbrca\b|genetic|sequencing|inherited",
        r"ancestry|\brace\b|family history",
    ),
)
# What in a record seems to state a scale or coding, for a reader to look at; every match is reported.
SCALES = (
    ("value_label_enumeration", r"\b\d+\s*=\s*[A-Za-z]"),
    ("coding_claim", r"\bcod(?:ed|ing|es)\b"),
    ("scale_range", r"\b\d+\s*(?:-|–|\bto\b)\s*\d+\s*(?:point|likert|scale)\b"),
    ("n_point_scale", r"\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)[- ]point\b"),
    ("scored_range", r"\bscor(?:ed|ing)\s+\d+\s*(?:-|–|\bto\b)\s*\d+"),
    (
        "missing_code",
        r"\bmissing\s+cod|(?<![\w-])-\d{2,4}\b|\b9{3,4}\s*=|\b7\s*/\s*8\s*/\s*9\b|\b\d{2,4}\b[^.]{0,30}\b(?:refus|don'?t know|not applicable)",
    ),
    ("response_option_list", r"\bresponse\s+(?:option|categor|code|scale)"),
)
SCAN_EXEMPT = ("provenance.tool_calls",)
# Registries that hold entries, and those that are declared and empty with what would fill them.
SURVEYS = ("m1", "m2", "m3")
EMPTY_REGISTRIES = (
    ("clinical", "study_team_confirmation"),
    ("lab", "study_team_confirmation"),
    ("linked", "area_measure_inventory"),
    ("ehr", "study_team_confirmation"),
)
# Which roles each list of covariates takes.
ROLES = {
    "adjusted_covariates": ("confounder", "cause_of_exposure_only", "precision", "proxy"),
    "excluded_variables": ("mediator", "descendant_of_exposure", "descendant_of_outcome", "not_a_cause_of_either"),
    "undetermined_covariates": ("confounder_or_mediator", "unadjudicated", "unreliable_coding"),
}
# The least lengths of a record's reasons.
MIN_JUSTIFICATION, MIN_MECHANISM, MIN_CONSTRUCT, MIN_SEARCH_PHRASE, MIN_REJECTION, MIN_BIAS_STATEMENT = 25, 20, 12, 2, 25, 25
MIN_STATEMENT, MIN_REMEDY, MIN_SAMPLES = 30, 15, 2
PREVALENCE_BLOCKER = "outcome_prevalence_unconfirmed"
# The lookups that each reason to refuse must cite, and what of their outcomes entails it (none: any).
REFUSALS = {
    "exposure_unresolvable": {"resolve_variable": ("not_found", "ambiguous")},
    "outcome_unresolvable": {"resolve_variable": ("not_found", "ambiguous")},
    "registry_empty": {"registry_coverage": ("coverage none",), "resolve_variable": ("not_found", "ambiguous")},
    "free_text_anchor": {"resolve_variable": ()},
    "no_signed_derivation": {"list_derivations": ()},
    "anchors_are_the_same_construct": {"resolve_variable": ("construct",)},
    "no_contrast_definable": {"get_contrast_convention": ()},
    "access_gate_refused": {"check_access": ("refer", "fail", "refused")},
}
# Who the members of a roster block are.
POPULATIONS = (("m1:Q6", "household member"), ("m2:Q8", "pregnancy"), ("m2:Q16", "sibling"), ("m2:Q18", "child"))

# Fixed value: a variable's key, or a bare question number, inside prose.
KEY_IN_PROSE = r"(?i)(?:m[123]|clinical|lab|linked|ehr)\s*:\s*[A-Za-z0-9._#~-]+|(?<![A-Za-z0-9])Q\s*\d+(?:\.\d+)+(?:[_#~-][A-Za-z0-9.]+)*"


def domain_of(wording: Column) -> Column:
    """The first domain that a wording names, or unclassified."""
    return T.first_rule(F.coalesce(wording, F.lit("")), [(n, f"(?i){p}") for n, p in DOMAINS], "unclassified")


def cased(rules: tuple[tuple[str, str, str], ...] = ABSENCES) -> list[tuple[str, str, str]]:
    """Absence rules that match in any case."""
    return [(n, f"(?i){p}", f"(?i){q}") for n, p, q in rules]


def scales_stated(text: Column) -> Column:
    """The names of all scale patterns that a text trips."""
    return F.filter(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in SCALES)), lambda x: x.isNotNull())


def in_instrument(region: Column) -> Column:
    """Whether a region names a part of the instrument."""
    return region.rlike("^(?:" + "|".join(SURVEYS) + ")")


def population_of(construct: Column, family_size: Column) -> Column:
    """Who a roster target is about, by its block; null for targets of no roster; an unknown block raises."""
    block = F.regexp_extract(construct, r"^m[0-9]+:Q[0-9]+", 0)
    bad = F.raise_error(F.concat(F.lit("no population for the roster block of "), construct)).cast("string")
    named = bad
    for key, who in reversed(POPULATIONS):
        named = F.when(block == key, F.lit(who)).otherwise(named)
    return F.when(family_size.isNotNull(), named)


def expansion_fields(construct: Column, family_size: Column, column: Column, option: Column) -> Column:
    """struct(population, instances) of a target's own metadata, never of its wording."""
    some = column.isNotNull() & (F.coalesce(option, F.lit("")) != "")
    return F.struct(population_of(construct, family_size).alias("population"), F.when(some, F.array(option)).otherwise(F.array().cast("array<string>")).alias("instances"))
