"""Closed forms: intervals, exact tests, detectable effects, index percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grid of sample sizes, and the bound's conventions (two-sided 0.05, power 0.80, prevalence one half).
N_GRID = (100, 300, 1000, 3000, 10000)
Z_ALPHA, Z_POWER, WORST_PREVALENCE = 1.959963984540054, 0.8416212335729143, 0.5


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): the 95 % Wilson interval, nulls for no trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = k / n, z * z
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    centre, scale = p + z2 / (2 * n), 1 + z2 / n
    return F.struct(((centre - half) / scale).alias("low"), ((centre + half) / scale).alias("high"))


def log_choose(n: Column, k: Column) -> Column:
    """log of n over k, as a sum of logs: no factorial overflows."""
    return F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, i: F.when(k > 0, s + F.log((n - k + i).cast("double")) - F.log(i.cast("double"))).otherwise(s))


def binomial_count(p: Column, n_items: Column, k: int, trials: int = 4) -> Column:
    """How many of n items would succeed k times of `trials`, were trials independent at rate p."""
    ways = 1
    for i in range(k):
        ways = ways * (trials - i) // (i + 1)
    return n_items * ways * F.pow(p, k) * F.pow(1 - p, trials - k)


def mcnemar_exact(gained: Column, lost: Column) -> Column:
    """Two-sided exact binomial p of a paired flip table; 1 without flips."""
    n, m = (gained + lost).cast("int"), F.least(gained, lost).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), m), F.lit(0.0), lambda s, k: s + F.exp(F.when(k > 0, log_choose(n, F.greatest(k, F.lit(1)))).otherwise(0.0) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def detectable(prevalence: Column, n: Column, z_alpha: float = Z_ALPHA, z_power: float = Z_POWER) -> Column:
    """Smallest detectable difference of proportions in percentage points, at n in two equal arms."""
    return (z_alpha + z_power) * F.sqrt(2 * prevalence * (1 - prevalence) / (n / 2)) * 100


def governing_n(curve: Column, analytic: Column, stated: Column) -> Column:
    """The n whose value judges: the analytic one if on the curve (a map by n), else the one stated, else the smallest."""
    keys = F.map_keys(curve)
    return F.coalesce(F.when(F.array_contains(keys, analytic), analytic), F.when(F.array_contains(keys, stated), stated), F.array_min(keys))


def index_of(rule: str, n: Column, q: float) -> Column:
    """0-based place of a percentile under one of the index rules in use: floor (int(q n)), floor1 (int(q (n - 1))),
    nearest (int(q (n - 1) + 0.5)); never past the last."""
    at = {"floor": q * n, "floor1": q * (n - 1), "nearest": q * (n - 1) + 0.5}[rule]
    return F.least(n - 1, F.floor(at).cast("long"))


def grant(asked: Column, drawn: Column, granted: Column, most: int = 9) -> Column:
    """Extra samples: what is asked for within the bound, once."""
    return F.when(granted, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(asked, F.lit(most) - drawn)))
