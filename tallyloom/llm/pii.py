r"""Personal data: patterns that are checked, and information-theoretic sanitisation of the terms that give them away.

Expressions only. Emails, IP addresses, payment cards and phone numbers are found by patterns in the whole text, and
those that fail their check (parts, length, Luhn) are dropped. Positions follow from the lengths of matches and of the
gaps between them, in code points.

Every value found is a protected entity. For every term of the documents that hold it the corpus tells how much is left
unknown of the entity once the term is seen: -log2 P(entity | term), where P is the share of the term's occurrences in the
whole corpus that lie in the entity's documents. An occurrence that stands within BESIDE code points of the entity counts
as three, and instead of the share its lower confidence bound (Wilson, one deviation) is taken, so that neither one chance
meeting nor the size of the corpus decides: a word that is seen once, far from the entity, leaves it unknown. A term whose
bound reaches `disclose` (0.6: under 0.74 bits are left) is generalised wherever it stands in the entity's documents, at
`remove` (0.9: 0.15 bits) it is removed. Counts are over whole texts of all documents; terms and entities stay in tables,
and only a counted, small table of terms is ever broadcast.

Patterns use possessive loops and start only where a run of signs begins, so that they neither recurse nor go back over
long runs; what they match is the same. The leading zeros of an address part are not possessive: a part may be zero.

Cases: null text is empty; null ids are kept; rows with the same id and text share their spans; an empty table gives an
empty result; extra columns are kept by `sanitised`, not read by `spans`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if, guarded, staged, text_of

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IN_RANGE = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"
TERM = r"\p{L}{3,}+"
#: How near to an entity a term tells more of it, in code points, and how many occurrences that one is worth besides.
BESIDE, WORTH = 64, 2
#: Terms (some 20 bytes each) that may be broadcast; above it the planner shuffles the corpus' terms.
BROADCAST_TERMS = 200_000
#: Ids and hashes (16 bytes each) that may be broadcast; above it all texts are shuffled to their spans.
BROADCAST_KEYS = 1_000_000
#: Lists, by hash, in which words look up the terms told of their document.
LISTS = 32

_LONGS = "array<struct<s:int,e:int,v:string>>"
_MARKS = "array<struct<k:int,s:int,e:int,v:string>>"


def _digits(m: Column) -> Column:
    return F.translate(m, " ().-+", "")


def _places(text: Column, matches: Column, pattern: str | Column) -> Column:
    """Array of (s, e, v) for the matches of a pattern, from the lengths of what lies between them."""
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_LONGS).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        s = state["at"] + F.char_length(pair["gap"])
        e = s + F.char_length(pair["match"])
        return F.struct(e.alias("at"), F.concat(state["out"], F.array(F.struct(s.alias("s"), e.alias("e"), pair["match"].alias("v")))).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(_LONGS))


def _check(kind: str) -> Callable[[Column], Column]:
    """Whether a match of the kind holds."""
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["v"].rlike(IN_RANGE),
        "card": lambda x: F.length(_digits(x["v"])).between(16, 19) & F.call_function("luhn_check", _digits(x["v"])),
        "phone": lambda x: F.length(_digits(x["v"])).between(8, 15),
    }[kind]


def found(docs: DataFrame, text: Column) -> DataFrame:
    """docs with _p_spans: array of (k, s, e, v), by kind and start; v is the entity."""
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    signs = {"email": "@", "ip": ".", "phone": "+"}
    none = F.array().cast("array<string>")
    docs = docs.withColumn("_p_text", text)
    every = {f"_p_{k}": F.regexp_extract_all("_p_text", F.lit(p), F.lit(0)) for k, p in patterns.items()}
    docs = docs.withColumns({c: F.when(F.col("_p_text").contains(signs[c[3:]]), x).otherwise(none) if c[3:] in signs else x for c, x in every.items()})
    docs = docs.withColumns({f"_p_{k}_at": F.filter(_places(F.col("_p_text"), F.col(f"_p_{k}"), p), _check(k)) for k, p in patterns.items()})

    def named(kind: str, i: int) -> Column:
        value = {"email": F.lower, "ip": lambda v: v}.get(kind, _digits)
        return F.transform(f"_p_{kind}_at", lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit(f"{kind}:"), value(x["v"])).alias("v")))

    docs = docs.withColumn("_p_spans", F.concat(*(named(k, i) for i, k in enumerate(KINDS[:4]))))
    return docs.drop(*every, *(f"{c}_at" for c in every))


def _terms(text: Column) -> Column:
    """Every term of a text as often as it stands there: runs of three letters or more, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _beside(rows: DataFrame) -> DataFrame:
    """(_p_row, v, t): terms that stand whole within BESIDE code points before or after an entity."""
    each = rows.select("_p_row", "_p_text", F.inline("_p_spans"))
    before = F.substring("_p_text", F.greatest(F.col("s") - BESIDE, F.lit(0)) + 1, F.least(F.col("s"), F.lit(BESIDE)))
    before = F.when(F.col("s") > BESIDE, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)  # what is cut is no word
    after = F.regexp_replace(F.substring("_p_text", F.col("e") + 1, F.lit(BESIDE + 1)), rf"(?s)^(.{{{BESIDE}}}).$", "$1\u0001")
    after = F.when(after.endswith("\u0001"), F.regexp_replace(after, "\\p{L}*\u0001$", "")).otherwise(after)
    return each.select("_p_row", "v", F.explode(F.concat(_terms(before), _terms(after))).alias("t")).distinct()


def told_share(joint: Column, beside: Column, all_: Column) -> Column:
    """The lower bound of the share of a term's weighed occurrences that lie with an entity."""
    n = all_ + WORTH * beside
    p = (joint + WORTH * beside) / n
    return (p + 0.5 / n - F.sqrt(p * (1 - p) / n + 0.25 / (n * n))) / (1 + 1 / n)


def _standing(rows: DataFrame) -> DataFrame:
    """rows with _p_terms: where the terms of _p_told, an array of (t, how), stand in _p_text outside _p_spans, as an
    array of (k, s, e, v). Words look a term up in one of a few short lists, by hash, so that many terms cost no more.
    Lists and words are staged before they are walked, so that no plan makes them again for every word."""
    terms = F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda i: F.transform(F.filter("_p_told", lambda x: F.pmod(F.hash(x["t"]), F.lit(LISTS)) == i), lambda x: x["t"]))
    rows = rows.withColumns({"_p_words": F.regexp_extract_all("_p_text", F.lit(TERM), F.lit(0)), "_p_gaps": F.split("_p_text", TERM, -1), "_p_lists": terms})
    rows = staged(rows.withColumns({"_p_low": F.transform("_p_words", F.lower), "_p_known": F.map_from_entries("_p_told")}))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_MARKS).alias("out"))

    def step(state: Column, x: Column) -> Column:
        s = state["at"] + F.char_length(x["gap"])
        e = s + F.char_length(x["word"])
        told = F.array_contains(F.get(F.col("_p_lists"), F.pmod(F.hash(x["low"]), F.lit(LISTS))), x["low"])
        more = F.concat(state["out"], F.array(F.struct(F.lit(4).alias("k"), s.alias("s"), e.alias("e"), x["low"].alias("v"))))
        return F.struct(e.alias("at"), F.when(told, more).otherwise(state["out"]).alias("out"))

    every = F.arrays_zip(F.slice("_p_gaps", F.lit(1), F.size("_p_words")).alias("gap"), F.col("_p_words").alias("word"), F.col("_p_low").alias("low"))
    rows = staged(rows.select("doc_id", "_p_hash", "_p_spans", "_p_known", F.aggregate(every, start, step)["out"].alias("_p_found")))
    alone = F.filter("_p_found", lambda t: ~F.exists("_p_spans", lambda x: (x["s"] < t["e"]) & (t["s"] < x["e"])))
    named = F.transform(alone, lambda t: t.withField("v", F.try_element_at(F.col("_p_known"), t["v"])))
    return staged(rows.withColumn("_p_terms", named).select("doc_id", "_p_hash", "_p_spans", "_p_terms"))


def spans(docs: DataFrame, disclose: float = 0.6, remove: float = 0.9) -> DataFrame:
    """doc_id, _p_hash and _p_spans (k, s, e, v) of every row, terms included (their v is generalise or remove)."""
    rows = found(docs.select("doc_id", text_of().alias("text")), F.col("text")).withColumns({"_p_hash": F.xxhash64("text"), "_p_row": F.monotonically_increasing_id()})
    rows = staged(rows.select("_p_row", "doc_id", "_p_hash", "_p_spans", F.when(F.size("_p_spans") > 0, F.col("text")).alias("_p_text")))
    total = rows.count()
    some = rows.where(F.size("_p_spans") > 0)
    held = some.select("_p_row", F.explode(F.array_distinct(F.transform("_p_spans", lambda x: x["v"]))).alias("v"))
    entities = held.groupBy("v").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") < total)
    held = staged(held.join(entities, "v").select("_p_row", "v"))
    if held.isEmpty():
        return rows.select("doc_id", "_p_hash", "_p_spans")
    words = staged(some.select("_p_row", F.explode(_terms(F.col("_p_text"))).alias("t")).groupBy("_p_row", "t").agg(F.count(F.lit(1)).alias("n")))
    near = words.groupBy("t").agg(F.sum("n").alias("n"))
    counts = docs.select(F.explode(_terms(text_of())).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    # a term has a place beside an entity no more often than it has places: so it needs this share of its occurrences near
    least = disclose - (1 - disclose) * WORTH
    rare = staged(counts.join(near, "t").where(F.col("n") >= least * F.col("n_t")).select("t", "n_t"))
    both = words.join(broadcast_if(rare, rare.count(), BROADCAST_TERMS), "t").join(held, "_p_row")
    both = staged(both.join(_beside(some).withColumn("k", F.lit(1)), ["_p_row", "v", "t"], "left"))
    pairs = both.groupBy("v", "t", "n_t").agg(F.sum("n").alias("n_te"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    share = told_share(F.col("n_te"), F.col("k"), F.col("n_t"))
    telling = staged(pairs.withColumn("share", share).where(F.col("share") >= disclose).select("v", "t", "share"))
    each = both.select("_p_row", "v", "t").join(broadcast_if(telling, telling.count(), BROADCAST_TERMS), ["v", "t"])
    how = F.when(F.max("share") >= remove, "remove").otherwise("generalise").alias("how")
    each = staged(each.groupBy("_p_row", "t").agg(how).groupBy("_p_row").agg(F.collect_list(F.struct("t", "how")).alias("_p_told")))
    each_rows = each.select("_p_row")
    # rows without an entity have no terms: they are not moved
    told = _standing(some.join(each, "_p_row")).select("doc_id", "_p_hash", F.concat("_p_spans", "_p_terms").alias("_p_spans"))
    untold = rows.join(broadcast_if(each_rows, each_rows.count(), BROADCAST_KEYS), "_p_row", "left_anti")
    return told.unionByName(untold.select("doc_id", "_p_hash", "_p_spans"))


def _cleaned(text: Column, spans_: Column) -> Column:
    """text with every span replaced by what it generalises to; spans that overlap are one, named by the first."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    order = F.array_sort(F.transform(spans_, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v"))))

    def step(state: Column, x: Column) -> Column:
        label = F.when((x["k"] == 4) & (x["v"] == "remove"), F.lit("")).otherwise(F.element_at(names, x["k"] + 1))
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, F.greatest(x["s"] - state["at"], F.lit(0))), label)
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), F.when(x["s"] >= state["at"], more).otherwise(state["out"]).alias("out"))

    def rest(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.char_length(text)))

    return F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """docs with personal data and the terms that reveal it replaced in text (and n_chars, if there, counted again)."""
    marks = spans(docs, **how).where(F.size("_p_spans") > 0).select(F.col("doc_id").alias("_m_id"), F.col("_p_hash").alias("_m_hash"), "_p_spans")
    marks = staged(marks.dropDuplicates(["_m_id", "_m_hash"]))
    rows, names = guarded(docs, "doc_id", "text", "n_chars")
    same = F.col("doc_id").eqNullSafe(F.col("_m_id")) & (F.xxhash64(text_of()) == F.col("_m_hash"))
    n = marks.count()
    out = rows
    if n <= BROADCAST_KEYS:  # texts without spans, which are most, stay where they are
        keys = F.broadcast(marks.select("_m_id", "_m_hash"))
        clean, out = rows.join(keys, same, "left_anti").select(*names), rows.join(keys, same, "left_semi")
    out = out.join(marks, same, "left").withColumn("text", F.when(F.col("_p_spans").isNull(), F.col("text")).otherwise(_cleaned(F.col("text"), F.col("_p_spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_p_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    out = out.select(*names)
    return (clean.unionByName(out) if n <= BROADCAST_KEYS else out).toDF(*docs.columns)
