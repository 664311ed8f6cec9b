"""Scoring of free-text answers by a rubric, verdicts over several samples, resolver outcomes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_token(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words stands alone in a text (lower case)."""
    body = "|".join(re.escape(w) for w in words)
    return text.rlike(f"(?:^|[^a-z0-9_])(?:{body})(?:$|[^a-z0-9_])")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?<=[.!?])\s|\n\s*\n"), lambda s: F.trim(s) != "")


def directed_pairing(text: Column, roles: Sequence[str], directions: Sequence[str]) -> Column:
    """Whether two neighbouring sentences assign roles and state a direction."""
    each = sentences(text)
    n = F.greatest(F.size(each) - 1, F.lit(1))
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(each, i, F.lit(2)), " "))
    return F.exists(windows, lambda w: any_token(w, roles) & any_token(w, directions))


def score(text: Column, roles: Sequence[str], directions: Sequence[str], contrasts: Sequence[str], forms: Sequence[str], covariates: Column, least: int = 2) -> Column:
    """struct of the four elements and whether all hold."""
    low = F.lower(text)
    parts = [directed_pairing(text, roles, directions).alias("pairing"), any_token(low, contrasts).alias("contrast"), any_token(low, forms).alias("model_form"), (covariates >= least).alias("adjustment")]
    return F.struct(*parts)


def covariates(text: Column, cue: str, longest: int = 6) -> Column:
    """The items of the first block that says it adjusts: bullets as they stand, else split at commas, semicolons and
    'and', long fragments left out. An Arrow function: a walk over lines with state has no built-in."""

    @F.pandas_udf("array<string>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        starts = re.compile(cue, re.I)
        bullet = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")

        def one(s: str | None) -> list[str]:
            lines = (s or "").split("\n")
            at = next((i for i, x in enumerate(lines) if starts.search(x)), None)
            if at is None:
                return []
            items = []
            for x in lines[at + 1 :]:
                if bullet.match(x):
                    items.append(bullet.sub("", x).strip())
                elif x.strip() or items:
                    break
            if not items:
                rest = lines[at][starts.search(lines[at]).end() :].split(".")[0]
                items = [p.strip() for p in re.split(r",|;|\band\b", rest)]
            return [p for p in items if p and len(p.split()) <= longest]

        for batch in batches:
            yield batch.map(one)

    return walk(text)


def pair_verdict(samples: DataFrame, by: str, positive: Column, least: int) -> DataFrame:
    """(by, n_positive, k, verdict): positive if at least `least` of a group's samples are."""
    out = samples.groupBy(by).agg(F.count_if(positive).alias("n_positive"), F.count(F.lit(1)).alias("k"))
    return out.withColumn("verdict", F.when(F.col("n_positive") >= least, "positive").otherwise("negative"))


def rescored(stored: DataFrame, by: str, elements: Column, least: int) -> DataFrame:
    """Verdicts of stored responses under the rubric as it is now: the texts are scored again, no call is made. A response
    is positive if all of its elements (a struct of booleans) hold."""
    scored = stored.withColumn("_e", elements)
    names = scored.schema["_e"].dataType.names
    every = F.lit(True)
    for name in names:
        every = every & F.col(f"_e.{name}")
    return pair_verdict(scored, by, every, least)


def resolver_outcome(kind: Column, verdict: Column, keys: Column, gold: Column, accepted: Column, usable: Column) -> Column:
    """What a verdict on a request of a kind (exact, family, derive, abstain) is worth. gold and accepted are families."""
    named = verdict == "resolved"
    abstained = verdict.isin("ambiguous", "absent")
    exact = F.when(named & (F.get(keys, F.lit(0)) == F.get(gold, F.lit(0))), "correct").when(named, "confident_wrong").when(abstained, "over_abstained").otherwise("wrong")
    family = F.when(named, "confident_wrong").when((verdict != "family") | (F.size(keys) == 0), "wrong").when(F.arrays_overlap(keys, gold), "correct").when(F.arrays_overlap(keys, accepted), "arguable").otherwise("wrong")
    derive = F.when(verdict == "derive", "correct").when(named, "confident_wrong").otherwise("wrong")
    other = F.when(abstained, "correct").when(named, "confident_wrong").otherwise("wrong")
    by_kind = F.when(kind == "exact", exact).when(kind == "family", family).when(kind == "derive", derive).otherwise(other)
    return F.when(verdict.isin("resolved", "family") & ~usable, "malformed").otherwise(by_kind)


def partition(records: DataFrame, flag: Column, arm: Column) -> DataFrame:
    """`half` of each record: the arm's own pool, flagged or not."""
    return records.withColumn("half", F.when(arm, "arm").when(flag, "flagged").otherwise("unflagged"))
