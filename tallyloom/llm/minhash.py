"""Near-duplicate documents by circulant MinHash, banding, and an exact check of every link on full shingle sets.

Two permutations make all signature coordinates: sigma scatters a shingle to one of D places, and coordinate k is the
least value of pi, shifted circularly by k places, over the places of a document's shingles. A row of K neighbouring
entries of pi therefore holds all K coordinates of a shingle, and a signature is the minimum over such rows.

Plan. Texts are read in batches and give a hash of the shingle set, bands and a sketch. Sets that are equal become one
vertex (partial aggregation, so copies are never expanded). Buckets are stars around a centre, by aggregation and join
rather than by collected groups, so one large bucket is split over tasks. Shingles that no other document of any bucket
has bound every intersection from above: documents and pairs that this rules out are left out, then pairs that a sketch
rules out (`deviations` standard deviations off the threshold; None for no sketch); the rest meet the exact Jaccard on
whole sets. Buckets whose members still fall into several components get another centre, and what then still crosses
components meets by its rarest shingles: two sets of the similarity always share one of the first n - ceil(t n) + 1 in
any order that both follow. So no bucket hides a link and none is compared pair by pair. Components are joined up by
minimum labels.

What can be lost: a pair whose signatures share no band (under one in a million at the threshold) and a pair whose
sketches differ by five standard deviations too much (under one in three million). exact=True uses neither: all sets meet
by their rarest shingles. Sets, and shingles in them, are told apart by 64-bit hashes.

Cases: null text and text without words have an empty set and link with nothing; fewer words than a shingle make one
shingle of the whole sequence; repeated rows are one document; rows with the same doc_id and other texts are documents
of their own, and a component is named by its smallest doc_id; a row without a doc_id joins the documents of equal text
but links nothing itself, and has a null component if there are none; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bound_batches, broadcast_if, guarded, held, staged, text_of
from tallyloom.llm.graph import components

PLACES = 1 << 21
COORDINATES = 128
#: One bit each of so many further coordinates says whether two documents may be similar enough.
SKETCH = 1024
KNOWN_WORDS = 100_000
#: Ids that may be broadcast (8 bytes each); above it the planner shuffles.
BROADCAST_IDS = 1_000_000
#: Of a set's rarest shingles, how many before one tell that a pair has met already.
BEFORE = 8
#: Star rounds before the pairs that still cross components meet by their rarest shingles.
ROUNDS = 2


class _Words(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class _Kept:
    """A worker's hashes of words and tables of pi."""

    def __init__(self):
        self.words: _Words = _Words()
        self.tables: dict[tuple[int, int], np.ndarray] = {}


def _kept() -> _Kept:
    return held("minhash", _Kept)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    ids = np.fromiter(map(_kept().words.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    acc = np.full(n, size, np.uint64)
    for j in range(size):
        acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n])
    return np.unique(acc)


def _circulant(seed: int, wide: int) -> np.ndarray:
    """pi, with its first entries again at the end, as rows of `wide` neighbours."""
    tables = _kept().tables
    if (seed, wide) not in tables:
        pi = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
        tables[seed, wide] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:wide]]), wide)
    return tables[seed, wide]


def signature(shingles: np.ndarray, seed: int, wide: int = COORDINATES) -> np.ndarray:
    rows, step = _circulant(seed, wide), 4096 * COORDINATES // wide
    places = (_mixed(shingles ^ np.uint64(seed * 2 + 1)) & np.uint64(PLACES - 1)).astype(np.int64)
    return np.min([rows[places[i : i + step]].min(axis=0) for i in range(0, len(places), step)], axis=0)


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows): as many rows as keep the chance to miss a pair at the threshold under one in a million."""
    for rows in range(12, 1, -1):
        bands = COORDINATES // rows
        if (1 - similarity**rows) ** bands < 1e-6:
            return bands, rows
    return COORDINATES, 1


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return acc.view(np.int64)


def _sketch(shingles: np.ndarray, seed: int) -> np.ndarray:
    bits = (signature(shingles, seed, SKETCH) & 1).astype(np.uint8) if len(shingles) else np.zeros(SKETCH, np.uint8)
    return np.packbits(bits).view(np.int64)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, which tells rows of one doc_id apart) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), "text")


def _signed(docs: DataFrame, size: int, similarity: float, seed: int) -> DataFrame:
    """doc_id, mark, n_shingles, v (a hash of the shingle set, null if empty) and band keys."""
    bands, rows = banding(similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(2).to_pylist():
                got = shingle_set(text, size)
                sig = signature(got, seed) if len(got) else None
                out[0].append(len(got))
                out[1].append(int(np.uint64(xxhash.xxh3_64_intdigest(got.tobytes())).view(np.int64)) if len(got) else None)
                out[2].append([] if sig is None else _band_keys(sig, bands, rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))],
                names=["doc_id", "mark", "n_shingles", "v", "bands"],
            )

    return _marked(docs).mapInArrow(work, "doc_id long, mark long, n_shingles long, v long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, size: int, seed: int) -> DataFrame:
    """v, shingles and sketch for the vertices of ids (doc_id, mark, v)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, size) for text in batch.column(1).to_pylist()]
            sketches = [_sketch(x, seed + 1) for x in sets]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], longs), pa.array(sketches, longs)], names=["v", "shingles", "sketch"])

    n = ids.count()
    rows = _marked(docs).join(broadcast_if(ids, n, BROADCAST_IDS), ["doc_id", "mark"]).select("v", "text")
    sets = staged(rows.mapInArrow(work, "v long, shingles array<long>, sketch array<long>"))
    return sets if sets.count() == n else staged(sets.dropDuplicates(["v"]))  # rows that repeat id and text


def _may_link(percent: int, deviations: float | None) -> Column:
    """What two rows a and b (na, ca, sa and nb, cb, sb) must meet to reach the similarity: sizes, cores, sketches.

    A core is what a set shares with any other document of a bucket, so an intersection is no larger than either core.
    """
    core = F.least("ca", "cb", "na", "nb")
    sizes = 100 * core >= percent * (F.col("na") + F.col("nb") - core)
    if deviations is None:
        return sizes
    t = (1 - percent / 100) / 2  # bits that differ, at the similarity
    limit = int(SKETCH * t + deviations * (SKETCH * t * (1 - t)) ** 0.5) + 1
    odd = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH // 64)), F.lit(0))
    return sizes & (odd <= limit)


def _as(rows: DataFrame, on: str, x: str, *more: str) -> DataFrame:
    return rows.select(on, F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("core").alias(f"c{x}"), F.col("sketch").alias(f"s{x}"), *(F.col(m).alias(f"{m}_{x}") for m in more))


def _crossing(rows: DataFrame, on: str, percent: int, deviations: float | None) -> DataFrame:
    """Pairs (a, b) of rows (on, v, part, n, core, sketch, pos, before) that meet on a column, cross parts and may link.
    Of those that meet, the largest part is not paired with itself. Values of `on` are in one order: pos is a value's place
    in the row's set, so that two sets that first meet there share no more than what comes from there on; and a pair
    that has met by one of the few values before is not made again."""
    parts = rows.groupBy(on, "part").agg(F.count(F.lit(1)).alias("m"))
    mains = parts.groupBy(on).agg(F.max(F.struct("m", "part")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select(on, F.col("main.part").alias("main"))
    rows = rows.join(mains, on)
    pairs = _as(rows.where("part <> main"), on, "a", "part", "pos", "before").join(_as(rows, on, "b", "part", "main", "pos", "before"), on)
    most = 1 + F.least(F.col("na") - F.col("pos_a"), F.col("nb") - F.col("pos_b"))
    left = most * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    crosses = (F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("main_b")) | (F.col("a") < F.col("b")))
    return pairs.where(crosses & left & _may_link(percent, deviations) & ~F.arrays_overlap("before_a", "before_b"))


def _by_rarest(rows: DataFrame, sets: DataFrame, percent: int, deviations: float | None) -> DataFrame:
    """The pairs of rows (v, part, n, core, sketch) that cross parts and share one of the shingles that both must show.

    Shingles are in order of how many of these sets have them, then by hash. Those of one set alone come first and meet
    nothing, so only their number counts; what is left of n - ceil(t n) + 1 is taken from the others.
    """
    each = sets.join(rows.select("v"), "v", "left_semi").select("v", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = staged(each.join(common, "shingle"))
    show = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    left = shared.groupBy("v").agg(F.count(F.lit(1)).alias("held")).join(rows.select("v", "n"), "v")
    left = left.select("v", (show - (F.col("n") - F.col("held"))).alias("show"), (F.col("n") - F.col("held")).alias("lone")).where("show > 0")
    order = Window.partitionBy("v").orderBy("df", "shingle")
    places = {"place": F.row_number().over(order), "before": F.collect_list("shingle").over(order.rowsBetween(-BEFORE, -1))}
    first = shared.join(left, "v").withColumns(places).where("place <= show").select("v", "shingle", (F.col("lone") + F.col("place")).alias("pos"), "before")
    return _crossing(staged(first.join(rows, "v")), "shingle", percent, deviations)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    one = sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb"))
    two = sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa"))
    full = pairs.join(one, "b").join(two, "a").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return staged(full.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b"))


def _cores(facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """v, n, core, sketch and bands of the vertices whose core reaches the similarity of their own set."""
    each = sets.select("v", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("v").alias("v"), F.max("v").alias("last"))
    own = each.where("v = last").groupBy("v").agg(F.count(F.lit(1)).alias("own"))
    cored = facts.join(own, "v", "left").withColumn("core", F.col("n") - F.coalesce("own", F.lit(0))).where(F.col("core") * 100 >= F.col("n") * percent)
    return staged(cored.join(sets.select("v", "sketch"), "v").select("v", "n", "core", "sketch", "bands"))


def _linked(facts: DataFrame, docs: DataFrame, size: int, percent: int, seed: int, deviations: float | None) -> DataFrame:
    """(v, label) of the vertices that links join, by buckets."""
    placed = facts.select("v", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least < most").select("key")
    buckets = staged(placed.join(shared, "key"))
    sets = _sets(docs, staged(buckets.select("v").distinct().join(facts.select("v", "doc_id", "mark"), "v")), size, seed)
    facts = _cores(facts.select("v", "n", "bands"), sets, percent)
    rows = staged(buckets.join(facts.select("v"), "v"))
    labels = components(rows.limit(0).select(F.col("v").alias("a"), F.col("v").alias("b")))
    links = None
    for turn in range(ROUNDS + 1):
        known = rows.join(labels, "v", "left").withColumn("part", F.coalesce("label", "v")).drop("label")
        parts = known.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m"))
        mains = parts.groupBy("key").agg(F.max(F.struct("m", "part")).alias("main"), F.count(F.lit(1)).alias("k"))
        open_ = staged(known.join(mains.where("k > 1").select("key", F.col("main.part").alias("main")), "key"))
        if open_.isEmpty():
            break
        if turn == ROUNDS:
            pairs = _by_rarest(open_.select("v", "part").distinct().join(facts.drop("bands"), "v"), sets, percent, deviations)
        else:  # a star round one more centre in each bucket out of its largest component, and then one of the others
            chosen = F.col("v") if turn == 0 else F.xxhash64("v", F.lit(turn))
            sides = open_.withColumns({"c": chosen, "out": F.col("part") != F.col("main")})
            centre = sides.join(sides.where("out" if turn == 0 else "true").groupBy("key", "out").agg(F.min("c").alias("least")), ["key", "out"]).where("c = least")
            both = [_as(x.select("v", "key", "part").join(facts, "v"), "key", y, "part", "bands") for x, y in ((centre, "a"), (open_, "b"))]
            once = F.array_intersect("bands_a", "bands_b")[0] == F.col("key")
            pairs = both[0].join(both[1], "key").where((F.col("part_a") != F.col("part_b")) & _may_link(percent, deviations) & once)
        more = _confirmed(pairs, sets, percent)
        if not more.isEmpty():
            links = more if links is None else links.union(more)
            labels = components(links)
    return labels


def _all_linked(facts: DataFrame, docs: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """(v, label) of the vertices that links join, without signatures: all sets meet by their rarest shingles."""
    sets = _sets(docs, facts.select("v", "doc_id", "mark"), size, seed)
    rows = _cores(facts.select("v", "n", "bands"), sets, percent).drop("bands").withColumn("part", F.col("v"))
    return components(_confirmed(_by_rarest(rows, sets, percent, None), sets, percent))


def _grouped(docs: DataFrame, size: int, percent: int, seed: int, deviations: float | None, exact: bool) -> DataFrame:
    """doc_id, mark, n_shingles and first (the doc_id and mark of its component's first document) for every row."""
    bound_batches(docs.sparkSession)
    signed = staged(_signed(docs, size, percent / 100, seed))
    firsts = signed.where("v is not null and doc_id is not null").groupBy("v").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    firsts = staged(firsts.select("v", "first.doc_id", "first.mark", "n", "bands"))
    labels = _all_linked(firsts, docs, size, percent, seed) if exact else _linked(firsts, docs, size, percent, seed, deviations)
    own = firsts.select("v", F.struct("doc_id", "mark").alias("own"))
    named = labels.join(own, "v")
    named = named.join(named.groupBy("label").agg(F.min("own").alias("first")), "label").select("v", "first")
    named = staged(own.join(named, "v", "left").select("v", F.coalesce("first", "own").alias("first")))
    return signed.select("doc_id", "mark", "n_shingles", "v").join(named, "v", "left").select("doc_id", "mark", "n_shingles", "first")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, seed: int = 11, deviations: float | None = 5.0, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; links at percent or more of the union."""
    found = _grouped(docs, size, percent, seed, deviations, exact)
    return found.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, seed: int = 11, deviations: float | None = 5.0, exact: bool = False) -> DataFrame:
    """docs without the near duplicates of an earlier document (by doc_id, then by hash of the text); of rows that repeat
    doc_id and text one stays, rows without a doc_id all stay."""
    found = staged(_grouped(docs, size, percent, seed, deviations, exact))
    kept = F.col("first").isNull() | (F.struct("doc_id", "mark") == F.col("first"))
    rows, names = guarded(docs, "doc_id", "text")
    rows = rows.withColumns({"_n_id": F.col("doc_id").cast("long"), "_n_mark": F.xxhash64(text_of())})
    key = ["_n_id", "_n_mark"]
    gone = found.where("doc_id is not null").where(~kept).select(F.col("doc_id").alias("_n_id"), F.col("mark").alias("_n_mark")).distinct()
    twice = found.where("doc_id is not null").where(kept).groupBy(F.col("doc_id").alias("_n_id"), F.col("mark").alias("_n_mark")).count().where("count > 1").drop("count")
    gone, twice = staged(gone), staged(twice)
    again = twice.count()
    out = rows.join(broadcast_if(gone, gone.count(), BROADCAST_IDS), key, "left_anti")
    if again:
        few = out.join(broadcast_if(twice, again, BROADCAST_IDS), key, "left_semi")
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.to_json(F.struct(*names))))
        few = few.withColumn("_n_place", place).where("_n_place = 1").drop("_n_place")
        out = out.join(broadcast_if(twice, again, BROADCAST_IDS), key, "left_anti").unionByName(few)
    return out.select(*names).toDF(*docs.columns)
