"""Classification rules that carry fixed tables: codings, places, contrasts, carried terms, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T

# What in a text asserts how answers are coded, first match wins; keys of variables are blanked first.
CODINGS = (
    ("value_label_binding", r"(?i)\b[0-9]+\s*=\s*[A-Za-z]{2}"),
    ("anchored_scale_range", r"(?i)\b[0-9]+\s*(?:-|–|\bto\b)\s*[0-9]+\s*(?:point|likert|scale)\b"),
    ("n_point_scale", r"(?i)\b(?:[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)[-\s]point\b[-\s]*(?:likert[-\s]*)?(?:scale|response|categor|item)"),
    ("scored_range", r"(?i)\bscor(?:ed|ing)\s+(?:from\s+)?[0-9]+\s*(?:-|–|\bto\b)\s*[0-9]+"),
    ("missing_code_convention", r"(?i)\bmissing\s+cod\w*[^.]{0,40}[0-9]|[0-9][^.]{0,40}\bmissing\s+cod|(?<![\w-])-(?:7{2,3}|8{2,3}|9{2,3})\b"),
    ("enumerated_response_options", r"(?i)\bresponse\s+(?:option|categor|code|scale)\w*[^.]{0,40}[0-9]"),
)
VARIABLE_KEY = r"(?:m[123]|clinical|lab|linked|ehr):[A-Za-z0-9._#~-]+"
# Wordings that locate a place, and which place.
LOCATING = r"(?i)street address|zip|postal|what city|neighborhood you live|employer|school address|census|community area"
# Design contrasts by what a key or kind says.
CONTRASTS = (
    ("highest versus lowest Likert category", "likert|agree"),
    ("highest versus lowest quintile of the derived scale", "scale|derivation"),
    ("yes versus no", "binary|ever"),
)


def states_a_coding(text: Column) -> Column:
    """The first coding pattern that a text trips, or null."""
    return T.first_rule(F.regexp_replace(F.coalesce(text, F.lit("")), VARIABLE_KEY, " "), CODINGS)


def place_of(wording: Column) -> Column:
    """workplace, school or residence for a wording that locates; null for others."""
    kind = F.when(wording.rlike("(?i)employer|work"), "workplace").when(wording.rlike("(?i)school"), "school").otherwise("residence")
    return F.when(wording.rlike(LOCATING), kind)


def contrast(kind: Column) -> Column:
    return T.first_rule(F.lower(kind), CONTRASTS, "per one standard-deviation increase")


def carried(term: Column, instrument: DataFrame, text: str) -> DataFrame:
    """(term, carried): whether any wording holds any token of a term; null where the term has no token (undetermined).

    instrument: one row with the instrument's whole text in `text`; tokens of four signs or more match inside words.
    """
    rows = instrument.select(F.lower(text).alias("_i"), F.explode(term).alias("term"))
    tokens = T.instrument_tokens(F.col("term"))
    hit = F.exists(tokens, lambda t: F.when(F.length(t) >= 4, F.col("_i").contains(t)).otherwise(F.regexp_like("_i", F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\b")))))
    return rows.select("term", F.when(F.size(tokens) > 0, hit).alias("carried"))


def tier(year: Column, cutoff: int) -> Column:
    """member or held_out by year; null years are held out."""
    return F.when(year <= cutoff, "member").otherwise("held_out")


def side_status(refuted: Column, confirmed_exposure: Column, confirmed_outcome: Column) -> Column:
    """refuted dominates; confirmed needs both sides."""
    return F.when(refuted, "refuted").when(confirmed_exposure & confirmed_outcome, "confirmed").otherwise("undetermined")
