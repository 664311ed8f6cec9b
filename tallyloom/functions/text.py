"""Text functions: Column in, Column out, all inside the JVM unless the docstring says otherwise.

Regular expressions use explicit ASCII classes, so that results do not depend on a dialect's reading of \\w, \\d and \\s.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The nine identifier shapes, most specific first; the first that matches wins.
SHAPES = (
    ("N_QN.N#N_N", r"^([0-9]+)_Q([0-9]+\.[0-9]+)#([0-9]+)_([0-9]+)$", ("roster", "q", "blk", "col")),
    ("N_QN.N", r"^([0-9]+)_Q([0-9]+\.[0-9]+)$", ("roster", "q")),
    ("QN.N#N_N_N", r"^Q([0-9]+\.[0-9]+)#([0-9]+)_([0-9]+)_([0-9]+)$", ("q", "blk", "col", "sub")),
    ("QN.N#N_N", r"^Q([0-9]+\.[0-9]+)#([0-9]+)_([0-9]+)$", ("q", "blk", "col")),
    ("QN.N_N_TEXT", r"^Q([0-9]+\.[0-9]+)_([0-9]+)_TEXT$", ("q", "sub")),
    ("QN.N_N", r"^Q([0-9]+\.[0-9]+)_([0-9]+)$", ("q", "sub")),
    ("QN.N", r"^Q([0-9]+\.[0-9]+)$", ("q",)),
    ("QN_N", r"^Q([0-9]+)_([0-9]+)$", ("q", "sub")),
    ("QN", r"^Q([0-9]+)$", ("q",)),
)
# What is stripped from an identifier, in this order, to reach its base.
BASE_STRIPS = (r"^[0-9]+_", r"#[0-9]+(_[0-9]+)*$", r"_[0-9]+(_TEXT)?$")
# The general identifier grammar with seven optional parts.
GRAMMAR = r"^(?:([0-9]+)_)?Q([0-9]+)(?:\.([0-9]+))?(?:#([0-9]+))?(?:_([0-9]+))?(?:_([0-9]+))?(_TEXT)?$"
# References that an export leaves in wording, and an index stranded behind one.
PIPED = r"\s*-\s*[0-9]*_?Q[0-9]+(?:\.[0-9]+)?(?:#[0-9]+)?(?:_[0-9]+)*(?:_TEXT)?(?=\s|$|\s*-)"
STRANDED = r"\s*-\s*[0-9]+\s*$"
ROSTER_INDEX = r"^\s*[0-9]+\s*-\s*"
# Signs of UTF-8 read as a one-byte code page.
MARKERS_CP1252 = ("â€", "Ã‚", "Ã©", "Ã¨", "Ã¡", "â€™", "â€œ")
MARKERS_LATIN1 = ("Ã", "â€", "Â", "�")
# The light stemmer's suffixes, replacements and least lengths, first match wins.
SUFFIXES = (
    ("ies", "y", 5), ("sses", "ss", 6), ("ization", "ize", 8), ("isation", "ise", 8), ("ation", "ate", 7),
    ("ement", "e", 7), ("ment", "", 6), ("ance", "", 6), ("ence", "", 6), ("ing", "", 6), ("edly", "", 7),
    ("ed", "", 5), ("ly", "", 5), ("es", "", 5), ("s", "", 4),
)
# Words that carry no content.
STOPWORDS = tuple(
    """a about above after again against all am an and any are aren as at be because been before being below between
    both but by can cannot could couldn did didn do does doesn doing don down during each few for from further had hadn
    has hasn have haven having he her here hers herself him himself his how i if in into is isn it its itself just me
    more most mustn my myself no nor not now of off on once only or other ought our ours ourselves out over own same shan
    she should shouldn so some such than that the their theirs them themselves then there these they this those through
    to too under until up very was wasn we were weren what when where which while who whom why with won would wouldn you
    your yours yourself yourselves s t don ve ll re d m o please describe following ever another type kind number times
    time many much often long""".split()
)


def nonempty(c: Column) -> Column:
    """'' as null."""
    return F.when(c != "", c)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def _part(c: Column, pattern: str, group: int) -> Column:
    return nonempty(F.regexp_extract(c, pattern, group))


def parse_shape(qid: Column, strict: bool = True) -> Column:
    """struct(shape, roster, q, blk, col, sub): the first of nine shapes; no shape raises, or is null if not strict."""
    return let(qid, lambda q: _shape(q, strict))


def _shape(qid: Column, strict: bool) -> Column:
    out = F.raise_error(F.concat(F.lit("identifier matches no known shape: "), qid)) if strict else F.lit(None)
    kind = "struct<shape:string,roster:int,q:string,blk:int,col:int,sub:int>"
    out = out.cast(kind)
    for name, pattern, groups in reversed(SHAPES):
        at = {g: i + 1 for i, g in enumerate(groups)}
        fields = [F.lit(name).alias("shape")]
        for g in ("roster", "q", "blk", "col", "sub"):
            v = F.regexp_extract(qid, pattern, at[g]) if g in at else F.lit(None).cast("string")
            fields.append((v if g == "q" else v.cast("int")).alias(g))
        out = F.when(qid.rlike(pattern), F.struct(*fields).cast(kind)).otherwise(out)
    return out


def collapse_to_base(qid: Column) -> Column:
    """Roster prefix, matrix suffix and sub-item suffix off, in that order."""
    for strip in BASE_STRIPS:
        qid = F.regexp_replace(qid, strip, "")
    return qid


def stem_id(qid: Column) -> Column:
    """The grid stem: roster prefix, then sub-item suffix off."""
    return F.regexp_replace(F.regexp_replace(qid, BASE_STRIPS[0], ""), BASE_STRIPS[2], "")


def parse_qid(qid: Column, strict: bool = True) -> Column:
    """struct of the grammar's seven parts and the base; no match raises, or is null if not strict."""
    return let(qid, lambda q: _grammar(q, strict))


def _grammar(qid: Column, strict: bool) -> Column:
    names = ("repeat", "block", "question", "grid", "part", "subpart")
    parts = [_part(qid, GRAMMAR, i + 1).cast("int").alias(n) for i, n in enumerate(names)]
    question = F.regexp_extract(qid, GRAMMAR, 3)
    base = F.concat(F.lit("Q"), F.regexp_extract(qid, GRAMMAR, 2), F.when(question != "", F.concat(F.lit("."), question)).otherwise(""))
    found = F.struct(*parts, (F.regexp_extract(qid, GRAMMAR, 7) != "").alias("is_text"), base.alias("base"))
    bad = F.raise_error(F.concat(F.lit("identifier does not match the grammar: "), qid)) if strict else F.lit(None)
    kind = "struct<repeat:int,block:int,question:int,grid:int,part:int,subpart:int,is_text:boolean,base:string>"
    return F.when(qid.rlike(GRAMMAR), found).otherwise(bad.cast(kind))


def split_last(text: Column, separator: str = " - ") -> Column:
    """struct(head, tail) around the last separator, trimmed; nulls without one."""
    n = F.length(text) - F.length(F.substring_index(text, separator, -1))
    head = F.trim(F.substring(text, F.lit(1), n - len(separator)))
    tail = F.trim(F.substring_index(text, separator, -1))
    there = text.contains(separator)
    return F.struct(F.when(there, head).alias("head"), F.when(there, tail).alias("tail"))


def flat(text: Column) -> Column:
    """White space collapsed to single spaces, trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _settled(text: Column, rounds: Column, step: Callable[[Column], Column]) -> Column:
    """step of step of .. text, as often as a text can change at all."""
    return F.aggregate(F.sequence(F.lit(0), rounds), text, lambda t, _: step(t))


def _bare(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_stem(text: Column) -> Column:
    """Piped references and stranded indexes off until nothing changes, then white space collapsed and outer spaces and
    dashes off. A round that changes more than outer space takes a dash away, so a text settles within its dashes."""
    out = _settled(text, F.regexp_count(text, F.lit("-")), lambda t: _bare(F.regexp_replace(_bare(F.regexp_replace(t, PIPED, "")), STRANDED, "")))
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), "^[ -]+|[ -]+$", "")


def roster_normalise(text: Column) -> Column:
    """A leading roster index off, trimmed."""
    return F.trim(F.regexp_replace(text, ROSTER_INDEX, ""))


def display(text: Column) -> Column:
    """How a catalogue shows wording: flat, without roster index and piped references."""
    return F.regexp_replace(F.regexp_replace(flat(text), ROSTER_INDEX, ""), PIPED, "")


def norm_construct(text: Column) -> Column:
    """Punctuation to spaces, flat, lower case."""
    return F.lower(flat(F.regexp_replace(text, r"(?U)[^\w\s]", " ")))


def section_of(key: Column) -> Column:
    """The section number of a construct key such as m2:Q5.8; '?' for other shapes."""
    return F.coalesce(_part(key, r"^m[0-9]+:Q([0-9]+)", 1), F.lit("?"))


def browse_arg(value: Column, prefix: str) -> Column:
    """Lower case, trimmed, without an optional prefix."""
    return F.regexp_replace(F.lower(F.trim(value)), f"^{prefix}", "")


def query_terms(phrase: Column) -> Column:
    """struct(terms, dropped): letter runs of three or more, first seen first; without any, all tokens and none dropped."""
    low = F.lower(phrase)
    content = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0)))
    every = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))
    some = F.size(content) > 0
    return F.struct(F.when(some, content).otherwise(every).alias("terms"), F.when(some, F.array_except(every, content)).otherwise(F.array().cast("array<string>")).alias("dropped"))


def light_stem(word: Column) -> Column:
    """The first suffix of the table that fits, replaced. The last letter picks the few suffixes that are tried."""
    out = word
    for last in dict.fromkeys(suffix[-1] for suffix, _, _ in reversed(SUFFIXES)):
        some = word
        for suffix, put, least in reversed(SUFFIXES):
            if suffix[-1] == last:
                some = F.when(word.endswith(suffix) & (F.length(word) >= least), F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(put))).otherwise(some)
        out = F.when(word.endswith(last), some).otherwise(out)
    return F.when(F.length(word) <= 3, word).otherwise(out)


def content_words(text: Column, stem: bool = False, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Distinct content words: runs of [a-z0-9] of two or more that are no stop words, stemmed or not."""
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    found = F.array_distinct(F.filter(every, lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords)))
    return F.array_distinct(F.filter(F.transform(found, light_stem), lambda w: (w != "") & ~w.isin(*stopwords))) if stem else found


def words(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def shingles(tokens: Column, k: int) -> Column:
    """All runs of k tokens, joined by spaces; none if there are fewer."""
    none = F.array().cast("array<string>")

    def runs(t: Column) -> Column:
        n = F.size(t) - k + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(k)), " "))).otherwise(none)

    return let(tokens, runs)


def runs(tokens: Column, longest: int) -> Column:
    """All runs of one to `longest` tokens, as often as they occur."""
    return let(tokens, lambda t: F.flatten(F.array(*(shingles(t, k) for k in range(1, longest + 1)))))


def phrases(tokens: Column, longest: int, function_words: Sequence[str]) -> Column:
    """Distinct runs of one to `longest` tokens that do not consist of function words alone."""
    fillers = F.array(*map(F.lit, function_words))
    return F.array_distinct(F.filter(runs(tokens, longest), lambda p: F.size(F.array_except(F.split(p, " "), fillers)) > 0))


def instrument_tokens(term: Column) -> Column:
    return F.regexp_extract_all(F.lower(term), F.lit("[a-z][a-z0-9.]{2,}"), F.lit(0))


def standalone(text: Column, needle: Column) -> Column:
    """Whether the literal needle stands in text outside any longer token."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_.])\Q"), needle, F.lit(r"\E(?![A-Za-z0-9_])"))
    return text.contains(needle) & F.regexp_like(text, quoted)


def marker_hit(text: Column, marker: Column) -> Column:
    """Figures need number boundaries, anything else is a substring."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), marker, F.lit(r"\E(?![0-9])"))
    return text.contains(marker) & F.when(marker.rlike("^[0-9,]+$"), F.regexp_like(text, quoted)).otherwise(F.lit(True))


def size_tokens(field: Column, least: int = 3) -> Column:
    """Bare and comma-grouped forms of the figures of a sample-size note; approximate (~) and short ones are left out."""
    raw = F.regexp_extract_all(field, F.lit("~?[0-9][0-9,]*"), F.lit(0))
    kept = F.filter(raw, lambda x: ~x.startswith("~"))
    bare = F.filter(F.transform(kept, lambda x: F.replace(x, F.lit(","), F.lit(""))), lambda x: F.length(x) >= least)
    grouped = F.transform(bare, lambda x: F.regexp_replace(x, r"(?<=[0-9])(?=([0-9]{3})+$)", ","))
    return F.array_distinct(F.concat(bare, grouped))


def prevalence_tokens(value: Column) -> Column:
    """12.3%, 12.3 and 0.123 for a share of 0.123."""
    percent = F.format_string("%.1f", value * 100)
    return F.array(F.concat(percent, F.lit("%")), percent, F.format_string("%.3f", value))


def design_terms(design: Column, side: int, separator: str = "[,/]") -> Column:
    """Terms left (0) or right (1) of an arrow, trimmed, blanks left out."""
    part = F.coalesce(F.get(F.split(design, "->", 2), F.lit(side)), F.lit(""))
    return F.filter(F.transform(F.split(part, separator), lambda x: F.trim(x)), lambda x: x != "")


def covered(phrase: Column, text: Column) -> Column:
    """Whether every stemmed content word of a phrase is in a text; a phrase without any counts as covered."""
    return F.size(F.array_except(content_words(phrase, True), content_words(text, True))) == 0


def query_template(construct: Column, population: Column, timeframe: Column, instances: Column) -> Column:
    """population + construct + timeframe: instances, each only if what stands before does not cover it."""
    start = F.array().cast("array<string>")
    blank = F.lit("")

    def lead(text: Column, who: Column) -> Column:
        return F.when((who != "") & (F.lower(who) != "participant") & ~covered(who, text), F.concat_ws(" ", who, text)).otherwise(text)

    def trail(text: Column, when: Column) -> Column:
        return F.when((when != "") & ~covered(when, text), F.concat_ws(" ", text, when)).otherwise(text)

    def listed(text: Column) -> Column:
        def step(added: Column, one: Column) -> Column:
            before = F.concat_ws(" ", text, F.array_join(added, " "))
            return F.when((one != "") & ~covered(one, before), F.array_append(added, one)).otherwise(added)

        added = F.aggregate(F.transform(F.coalesce(instances, start), lambda x: F.trim(x)), start, step)
        return let(added, lambda x: F.when(F.size(x) > 0, F.concat(text, F.lit(": "), F.array_join(x, ", "))).otherwise(text))

    text = let(F.trim(construct), lambda t: let(F.trim(F.coalesce(population, blank)), lambda w: lead(t, w)))
    text = let(text, lambda t: let(F.trim(F.coalesce(timeframe, blank)), lambda w: trail(t, w)))
    return let(text, listed)


def target_text(stem: Column, option: Column, mode: str) -> Column:
    """How a target is spelt for an encoder: dup repeats a stem without option, plain joins by a space, dash by ' - ',
    verbatim is the stem alone."""
    whole = {
        "dup": F.concat_ws(" ", stem, F.coalesce(option, stem)),
        "plain": F.concat_ws(" ", stem, option),
        "dash": F.concat_ws(" - ", stem, option),
        "verbatim": stem,
    }
    return whole[mode]


def common_prefix(low: Column, high: Column) -> Column:
    """The longest common prefix of a group, from its least and greatest strings."""
    n = F.least(F.length(low), F.length(high))
    upto = F.sequence(F.lit(0), n)
    same = F.filter(upto, lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i))
    return F.substring(low, F.lit(1), F.array_max(same))


def unfence(text: Column) -> Column:
    """A markdown fence around a reply off."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", ""))


def json_body(text: Column) -> Column:
    """From the first { to the last }; null without."""
    return _part(text, r"(?s)\{.*\}", 0)


def parse_reply(text: Column, schema: str) -> Column:
    """The JSON of a reply by schema; null if malformed."""
    return F.from_json(json_body(text), schema, {"mode": "PERMISSIVE"})


def dedupe_phrases(items: Column) -> Column:
    """Trimmed, blanks off, the first of those that differ only in case."""
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(trimmed, F.lower)
    return F.filter(trimmed, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def strip_cue(text: Column, cue: str) -> Column:
    """Stacked cues off the head of a fragment until none is left: as often as it holds cues, and once for what is around."""
    off = lambda t: F.regexp_replace(F.regexp_replace(t, f"(?i)^(?:{cue})", ""), r"^[ .*_#–\t-]+|[ .*_#–\t-]+$", "")
    return _settled(_bare(text), F.regexp_count(text, F.lit(f"(?i)(?:{cue})")), off)


def protocol_id(pair_id: Column) -> Column:
    """Lower case, arrows and other signs to single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(pair_id), "[^a-z0-9.]+", "-"), "^-+|-+$", "")


KEY_PATTERN = r"^(?:m[123]|clinical|lab|linked|ehr):[A-Za-z0-9._#-]+(?:~[0-9]+)?$"
BARE_PATTERN = r"^Q[0-9]+(\.[0-9]+)?(_[0-9]+)?$"
# How an answer opens that denies.
DENIAL = (
    r"(?i)^\W*(?:no\b|nope\b|none\b|nothing\b|not\b|negative\b|i (?:do not|don't|have no|cannot|can't|am not|haven't|do n't)\b"
    r"|i'?m not\b|there (?:is|are) (?:no|nothing|none)\b)"
)


def answered_no(text: Column) -> Column:
    """Whether the first sentence opens with a denial."""
    return F.split(F.trim(text), r"(?<=[.!?])\s|\n", 2)[0].rlike(DENIAL)


def claimed(text: Column, sentinel: str, known: Sequence[str]) -> Column:
    """The first word after the last sentinel, if it is a known one."""
    word = F.lower(_part(F.element_at(F.split(text, sentinel), -1), r"^[^A-Za-z_]*([A-Za-z_]+)", 1))
    return F.when(text.contains(sentinel) & word.isin(*known), word)


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first pattern found in text."""
    out = F.lit(default)
    for name, pattern in reversed(list(rules)):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def latin1_repair(text: Column) -> Column:
    """struct(text, repaired): the latin-1 to UTF-8 round trip, kept only if it removes every marker. Built-ins only:
    texts beyond latin-1 are left alone before anything is encoded."""
    fits = text.rlike(r"^[\x00-\xFF]*$") & _has(text, MARKERS_LATIN1)
    raw = F.encode(F.when(fits, text).otherwise(F.lit("")), "ISO-8859-1")
    fixed = F.when(F.is_valid_utf8(raw.cast("binary")), F.decode(raw, "UTF-8")) if hasattr(F, "is_valid_utf8") else F.try_to_binary(raw)
    good = fits & fixed.isNotNull() & ~_has(F.coalesce(fixed, F.lit("")), MARKERS_LATIN1)
    return F.struct(F.when(good, fixed).otherwise(text).alias("text"), F.coalesce(good, F.lit(False)).alias("repaired"))


def _has(text: Column, markers: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def _cp1252_bytes(text: str) -> bytes:
    """Each sign by cp1252, those that it lacks by latin-1; what neither has raises."""
    return b"".join(c.encode("cp1252", "ignore") or c.encode("latin-1") for c in text)


def cp1252_repair(text: Column) -> Column:
    """Repair of UTF-8 that was read as cp1252, kept only if all markers vanish. An Arrow function: cp1252 with a
    fallback per sign has no built-in; texts without a marker never reach it."""

    @F.pandas_udf("string")
    def repair(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(s: str | None) -> str | None:
            try:
                fixed = _cp1252_bytes(s).decode("utf-8") if s else s
            except UnicodeError:
                return s
            return s if fixed and any(m in fixed for m in MARKERS_CP1252) else fixed

        for batch in batches:
            yield batch.map(one)

    damaged = _has(text, MARKERS_CP1252)
    return F.when(damaged, repair(F.when(damaged, text))).otherwise(text)
