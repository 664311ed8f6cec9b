"""Scored lexical search over an inverted index, collapse of equal wordings, outcomes, and adaptive browsing."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators.ordering import top

#: Fixed value: below this rounded score a hit is a candidate to screen.
FLOOR = 0.523


def term_counts(tokens: Column) -> Column:
    """array of struct(term, tf) of an array of words: the words are sorted and their runs measured, linear in the sorted
    array, and no word carries the others with it."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return T.let(begins, lambda at: F.transform(at, lambda p, i: F.struct(F.get(s, p - 1).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(s) + 1) - p).alias("tf"))))

    return F.when(F.size(tokens) > 0, T.let(F.array_sort(tokens), runs)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def index(docs: DataFrame, key: str, text: Column, pattern: str = "[a-z]{3,}") -> DataFrame:
    """Postings (term, key, tf, length): one row for each distinct term of a row; counted in the row, no shuffle. For many
    searches, and to store them, see postings.build."""
    counted = T.let(T.words(text, pattern), lambda t: F.struct(F.size(t).alias("length"), term_counts(t).alias("terms")))
    rows = docs.select(F.col(key).alias("key"), counted.alias("t")).select("key", F.col("t.length").alias("length"), F.inline("t.terms"))
    return rows.select("term", "key", "tf", "length")


def postings(docs: DataFrame, key: str, text: Column, terms: Sequence[str], pattern: str = "[a-z]{3,}") -> DataFrame:
    """Postings of a query's few terms straight from the texts: only matching rows leave the scan's task."""
    tokens = T.words(text, pattern)
    rows = docs.select(F.col(key).alias("key"), tokens.alias("tokens")).where(F.arrays_overlap("tokens", F.array(*map(F.lit, terms))))
    each = rows.select("key", F.size("tokens").alias("length"), "tokens", F.explode(F.array(*map(F.lit, terms))).alias("term"))
    return each.withColumn("tf", F.size("tokens") - F.size(F.array_remove("tokens", F.col("term")))).where("tf > 0").drop("tokens")


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0))


def scored(hits: DataFrame, terms: Sequence[str], n_items: int, k1: float = 1.2, b: float = 0.75, mean_length: float | None = None) -> DataFrame:
    """(key, score, matched, bm25) from postings of a query's terms.

    score is the idf of the terms matched over that of all searched, absent ones included. The terms' document counts
    are a handful of rows, joined as a broadcast.
    """
    searched = hits.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, at int")
    df = searched.join(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    weights = df.withColumn("idf", idf(F.col("df"), F.lit(n_items)))
    weights = F.broadcast(weights.crossJoin(weights.agg(F.sum("idf").alias("total"))))  # as many rows as terms
    rows = hits.join(weights, "term")
    okapi = F.log(1 + (F.lit(n_items) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(1.0) if mean_length is None else 1 - b + b * F.col("length") / F.lit(mean_length)
    return rows.groupBy("key").agg(
        F.round(F.sum("idf") / F.first("total"), 9).alias("score"),  # so that equal sums tie, whatever their order
        F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("matched"),
        F.sum(okapi * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)).alias("bm25"),
    )


def collapse(hits: DataFrame, wording: str, order: Sequence[Column], limit: int, echo: int = 4) -> DataFrame:
    """Hits of equal wording under their best one; the limit counts these alone. collapsed_n, and the first few keys.

    A better hit of a wording always precedes the others, so this equals taking hits one by one: no loop is needed. Of a
    wording that many hits share, every task passes on its count and its first few hits alone.
    """
    counts = hits.groupBy(F.col(wording).alias("_w")).agg((F.count(F.lit(1)) - 1).alias("collapsed_n"))
    first = top(hits, [wording], order, echo + 1, "_at")
    later = F.collect_list(F.when(F.col("_at") > 1, F.struct("_at", "key")))
    keys = first.groupBy(F.col(wording).alias("_v")).agg(F.transform(F.array_sort(later), lambda x: x["key"]).alias("collapsed_keys"))
    best = first.where("_at = 1").drop("_at")
    rows = best.join(counts, best[wording].eqNullSafe(counts["_w"])).join(keys, best[wording].eqNullSafe(keys["_v"])).drop("_w", "_v")
    return top(rows, [], order, limit) if limit else rows


def terms_of(phrase: str) -> tuple[list[str], list[str]]:
    """(terms, dropped) of one phrase, by the rule of text.query_terms."""
    every = list(dict.fromkeys(re.findall("[a-z0-9]+", phrase.lower())))
    content = list(dict.fromkeys(re.findall("[a-z]{3,}", phrase.lower())))
    return (content, [t for t in every if t not in content]) if content else (every, [])


def scored_texts(docs: DataFrame, key: str, text: str, terms: Sequence[str], pattern: str = "[a-z]{3,}", keep: Column | None = None) -> DataFrame:
    """(key, score, matched, and what is kept) of the texts that hold a term, without an index: one aggregate counts the texts that hold
    each of the few terms, and a second pass adds up their idfs in place. Nothing is joined or shuffled."""
    tokens = T.words(F.col(text), pattern)
    held = [F.count_if(F.array_contains("t", w)).alias(f"df_{i}") for i, w in enumerate(terms)]
    counts = docs.select(tokens.alias("t")).agg(F.count(F.lit(1)).alias("n"), *held).first()
    idfs = [math.log((counts.n + 1.0) / (counts[f"df_{i}"] + 1.0)) for i in range(len(terms))]
    total = sum(idfs) or 1.0
    every = F.array(*map(F.lit, terms))
    kept = [] if keep is None else [keep]
    rows = docs.select(F.col(key).alias("key"), *kept, T.let(tokens, lambda t: F.filter(every, lambda w: F.array_contains(t, w))).alias("matched")).where(F.size("matched") > 0)
    parts = [F.when(F.array_contains("matched", w), F.lit(v)).otherwise(0.0) for w, v in zip(terms, idfs, strict=True)]
    return rows.select("key", F.round(sum(parts[1:], parts[0]) / total, 9).alias("score"), "matched", *rows.columns[1:-1])


def search(docs: DataFrame, key: str, text: str, phrase: str, limit: int = 20, floor: float = FLOOR) -> DataFrame:
    """The page of a search: key, score (rounded to three places), n_matched_terms, collapsed_n, below_threshold, outcome.

    outcome: ok; low_confidence if the best hit is below the floor or one term was searched, which cannot tell hits
    apart. No hits, or nothing to search for, give no rows.
    """
    terms = terms_of(phrase)[0] or [""]
    rows = scored_texts(docs, key, text, terms, keep=F.xxhash64(T.roster_normalise(F.col(text))).alias("wording"))
    rows = collapse(rows, "wording", [F.desc("score"), F.col("key")], limit)
    shown = F.round("score", 3)
    best = F.max(shown).over(Window.partitionBy())
    outcome = F.when(F.lit(len(terms) < 2) | (best < floor), "low_confidence").otherwise("ok")
    return rows.select("key", shown.alias("score"), F.size("matched").alias("n_matched_terms"), "collapsed_n", (shown < floor).alias("below_threshold"), outcome.alias("outcome"))


def missed(terms: Sequence[str], matched: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, terms)), matched)


def snippet(text: Column, term: Column, words: int = 12) -> Column:
    """Up to `words` words around the first that holds a term."""
    tokens = F.split(text, r"\s+")
    at = F.array_position(F.transform(tokens, lambda w: F.lower(w).contains(term)), True).cast("int")
    start = F.greatest(at - words // 2, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(tokens, start, F.lit(words)), " "))


def many(docs: DataFrame, key: str, text: str, phrasings: Sequence[str], limit: int) -> DataFrame:
    """(stream, key, rank) of one search for each of a few phrasings; the request itself is stream 0. Tables of requests
    are searched by postings.search."""
    out = None
    for stream, phrase in enumerate(phrasings):
        rows = scored_texts(docs, key, text, terms_of(phrase)[0] or [""])
        page = top(rows.select("key", "score"), [], [F.desc("score"), F.col("key")], limit).select(F.lit(stream).alias("stream"), "key", "rank")
        out = page if out is None else out.unionByName(page)
    return out


def fits(rows: DataFrame, most: int = 21_000) -> DataFrame:
    """One row: how many characters a page takes as JSON, and whether that fits."""
    return rows.select(F.length(F.to_json(F.struct(*rows.columns))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chars")).withColumn("fits", F.col("chars") <= most)


def browse(levels: Sequence[tuple[str, DataFrame]], most: int = 21_000) -> tuple[str, DataFrame]:
    """The first level whose page fits, or the last."""
    for name, rows in levels[:-1]:
        if fits(rows, most).first().fits:
            return name, rows
    return levels[-1]
