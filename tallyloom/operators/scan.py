"""Contamination scans: markers, phrases, figures and shared word runs of one table in the texts of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import patterns
from tallyloom.operators.ordering import spread


#: Rows of a list that are tried one by one on every text; longer lists meet texts by their seeds.
SHORT_LIST = 32


def _met(surfaces: DataFrame, rows: DataFrame, text: str, pattern: str, holds: Column, short: int) -> DataFrame:
    return surfaces.join(F.broadcast(rows), holds) if rows.count() <= short else patterns.met(surfaces, rows, text, pattern, holds)


def markers(surfaces: DataFrame, rows: DataFrame, text: str, marker: str, short: int = SHORT_LIST) -> DataFrame:
    """(surface columns, marker) where a marker occurs; figures need number boundaries, any other marker is a substring."""
    return _met(surfaces, rows, text, marker, T.marker_hit(F.col(text), F.col(marker)), short)


def tokens_in(surfaces: DataFrame, rows: DataFrame, text: str, token: str, short: int = SHORT_LIST) -> DataFrame:
    """(surface columns, token) where a token stands alone."""
    return _met(surfaces, rows, text, token, T.standalone(F.col(text), F.col(token)), short)


def word_runs(df: DataFrame, key: str, text: str, k: int, pattern: str = "[a-z0-9]+") -> DataFrame:
    """(key, run): hashes of the distinct runs of k words."""
    runs = F.array_distinct(F.transform(T.shingles(T.words(F.col(text), pattern), k), lambda r: F.xxhash64(r)))
    return df.select(F.col(key).alias("key"), F.explode(runs).alias("run"))


def shared_runs(docs: DataFrame, held_out: DataFrame, key: str, held_key: str, text: str, k: int = 8) -> DataFrame:
    """(key, n_runs, n_held): documents that share runs of k words with held-out texts.

    Runs meet by an equi-join on their hash. The held-out side is the smaller by far and is broadcast when Spark finds
    it small; the documents' runs are filtered before anything of theirs is shuffled.
    """
    small = word_runs(held_out, held_key, text, k).withColumnRenamed("key", "held")
    return word_runs(docs, key, text, k).join(small, "run").groupBy("key").agg(F.count_distinct("run").alias("n_runs"), F.count_distinct("held").alias("n_held"))


def answer_phrases(papers: DataFrame, key: str, design: str, instrument: DataFrame, word: str, longest: int, function_words: Sequence[str]) -> DataFrame:
    """Phrases of a design line that an instrument's runs of words do not hold: an anti join by phrase. Of the instrument's
    runs only those that a design line has are told apart."""
    words = T.words(F.col(design))
    phrases = papers.select(F.col(key), F.explode(T.phrases(words, longest, function_words)).alias("phrase"))
    texts = spread(instrument.select(F.col(word).alias("t")))
    known = texts.select(F.explode(T.runs(T.words(F.col("t")), longest)).alias("phrase")).join(phrases.select("phrase").distinct(), "phrase", "left_semi").distinct()
    return phrases.join(known, "phrase", "left_anti")


def leaks(prompts: DataFrame, text: str, tables: Sequence[tuple[str, DataFrame]], token: str = "token") -> DataFrame:
    """Rows (prompt columns, paper, field, token) for every token of every field table that a prompt holds alone."""
    every = None
    for field, rows in tables:
        one = rows.withColumn("field", F.lit(field))
        every = one if every is None else every.unionByName(one)
    return tokens_in(prompts, every, text, token).drop(text)


def blind_floors(df: DataFrame, by: str, text: str, least_chars: int, controls: Sequence[str]) -> DataFrame:
    """By group: characters seen, controls found, and whether a scan of it could have seen anything."""
    found = [F.max(F.col(text).contains(c).cast("int")).alias(f"control_{i}") for i, c in enumerate(controls)]
    out = df.groupBy(by).agg(F.sum(F.length(text)).alias("chars"), *found)
    sure = F.lit(True)
    for i in range(len(controls)):
        sure = sure & (F.col(f"control_{i}") == 1)
    return out.withColumn("seen", (F.col("chars") >= least_chars) & sure)


def coverage(required: DataFrame, surface: DataFrame, on: Sequence[str]) -> DataFrame:
    """What a surface should show and does not."""
    return required.join(surface, list(on), "left_anti")


def overlap(a: Column, b: Column) -> Column:
    """struct(n_shared, cov_a, cov_b, jaccard) of two arrays of distinct words; shares of an empty set are null."""
    both, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.struct(both.alias("n_shared"), (both / F.nullif(n, F.lit(0))).alias("cov_a"), (both / F.nullif(m, F.lit(0))).alias("cov_b"), (both / F.nullif(n + m - both, F.lit(0))).alias("jaccard"))


def word_overlap(a: DataFrame, b: DataFrame, a_key: str, b_key: str, words: Column) -> DataFrame:
    """(a_key, b_key, n_shared, cov_a, cov_b, jaccard) for pairs that share a word; words are arrays of distinct ones."""

    def each(df: DataFrame, key: str, n: str) -> DataFrame:
        rows = df.select(key, words.alias("_w"))
        return rows.select(key, F.size("_w").alias(n), F.explode("_w").alias("_word"))

    both = each(a, a_key, "_n").join(each(b, b_key, "_m"), "_word").groupBy(a_key, b_key).agg(F.count(F.lit(1)).alias("n_shared"), F.first("_n").alias("_n"), F.first("_m").alias("_m"))
    i = F.col("n_shared")
    return both.select(a_key, b_key, "n_shared", (i / F.col("_n")).alias("cov_a"), (i / F.col("_m")).alias("cov_b"), (i / (F.col("_n") + F.col("_m") - i)).alias("jaccard"))


def absence(df: DataFrame, rules: Sequence[tuple[str, str]], text: Column) -> DataFrame:
    """By rule (name, pattern): how many texts it matches; none is an absence. One pass counts for all rules."""
    counts = df.select(text.alias("_t")).agg(*(F.count_if(F.col("_t").rlike(p)).alias(n) for n, p in rules))
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n, _ in rules))
    return counts.select(F.explode(each).alias("x")).select("x.name", "x.n", (F.col("x.n") == 0).alias("absent"))


def absence_report(entries: DataFrame, entry: Column, targets: DataFrame, target: Column, construct: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """By domain (name, what must be absent, what may stand beside it): entries and targets that match the first, and
    constructs of targets that match the second; a domain is absent if neither entries nor targets match."""
    seen = entries.select(entry.alias("_t")).agg(*(F.count_if(F.col("_t").rlike(p)).alias(f"e_{n}") for n, p, _ in rules))
    shown = targets.select(target.alias("_t"), F.col(construct).alias("_c"))
    found = [F.count_if(F.col("_t").rlike(p)).alias(f"t_{n}") for n, p, _ in rules] + [F.count_distinct(F.when(F.col("_t").rlike(q), F.col("_c"))).alias(f"a_{n}") for n, _, q in rules]
    each = F.array(*(F.struct(F.lit(n).alias("domain"), F.col(f"e_{n}").alias("entries"), F.col(f"t_{n}").alias("targets"), F.col(f"a_{n}").alias("adjacent")) for n, _, _ in rules))
    out = seen.crossJoin(shown.agg(*found)).select(F.explode(each).alias("x")).select("x.*")  # one row each
    return out.withColumn("absent", (F.col("entries") == 0) & (F.col("targets") == 0))


def unchecked(rows: DataFrame, domain: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The domains of a fixture that no rule checks."""
    return rows.select(domain).distinct().where(~F.col(domain).isin(*(n for n, _, _ in rules)))


def seal_state(answer: Column, fact: Column) -> Column:
    """leaked if the fact is there, clean on a denial, else inconclusive."""
    return F.when(F.lower(answer).contains(F.lower(fact)), "leaked").when(T.answered_no(answer), "clean").otherwise("inconclusive")
