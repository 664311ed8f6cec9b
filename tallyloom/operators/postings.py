"""Many requests at once over stored postings.

An index holds, for every term, one row for each block of documents that has it: how many they are, and the documents with
their counts. A block is `per_block` documents of like length that follow each other by key; the same blocks serve all terms.
Rows are partitioned by a hash of the term and sorted by term within, so that a search reads the files and row groups of its
terms alone.

A search takes a table of requests. Blocks are dealt to shards, so that all shards hold documents of all lengths; a task holds
the postings of a shard and lets the requests stream past it, thousands at a time. A request's terms are taken by what they
can add to a score, most first, and their documents are scored until the rest of the terms adds up to less than the k-th best
so far; a document is let go as soon as it cannot reach that. Nothing is lost: a document scores at most what its terms could.
A request's first shard gives it a floor for all others. A task passes on k documents of a request at most, so that what is
stored grows with requests times shards, never with requests times blocks; nothing is collected.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tallyloom.functions import text as T
from tallyloom.operators.ordering import ordinal, spread, top
from tallyloom.operators.search import idf
from tallyloom.sources.staging import fresh, staged

#: Sums of the same terms in another order differ by less than this.
NOISE = 1e-6


def okapi(df: Column, n: int) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


@dataclass
class Postings:
    """blocks (bucket, term, block, n, cf, docs), terms (bucket, term, df, cf), and what scores need of all documents."""

    blocks: DataFrame
    terms: DataFrame
    n: int
    mean: float
    buckets: int
    k1: float
    b: float

    def impact(self, tf: Column, length: Column) -> Column:
        """What a term's count adds to BM25, but for the term's weight."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / F.lit(self.mean or 1.0)))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _counted(texts: DataFrame, pattern: str) -> DataFrame:
    """(key, length, terms: array of (term, tf)) of texts (key, t): how many words each has, and how often each one."""
    kind = texts.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        for batch in batches:
            lengths, ends, terms, tfs = [], [0], [], []
            for text in batch["t"].to_pylist():
                words = find(text)
                times = Counter(words)
                lengths.append(len(words))
                terms.extend(times)
                tfs.extend(times.values())
                ends.append(len(terms))
            each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=["key", "length", "terms"])

    return texts.mapInArrow(work, f"key {kind}, length int, terms array<struct<term:string,tf:int>>")


def _packed(rows: DataFrame) -> DataFrame:
    """(term, block, n, cf, docs) of rows (block, key, length, terms): a block's documents meet in one task, so
    that no posting is shuffled alone."""
    kind = rows.schema["key"].dataType.simpleString()

    def pack(some: pa.Table) -> pa.RecordBatch:
        one = lambda name: some[name].combine_chunks()
        terms = one("terms")
        of, row = terms.flatten(), np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False))
        named = of.field("term").dictionary_encode()
        code, block = named.indices.to_numpy(), one("block").to_numpy()[row]
        order = np.lexsort((row, code, block))  # rows come by key
        code, block, row = code[order], block[order], row[order]
        tf, length = of.field("tf").to_numpy()[order], one("length").to_numpy()[row]
        starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        key, ends = one("key").take(pa.array(row)), np.append(starts, len(code))
        docs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([key, pa.array(tf), pa.array(length)], ["key", "tf", "length"]))
        cf = np.add.reduceat(tf.astype(np.int64), starts) if len(starts) else tf.astype(np.int64)
        columns = [named.dictionary.take(pa.array(code[starts])), pa.array(block[starts]), pa.array(np.diff(ends), pa.int32()), pa.array(cf), docs]
        return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "cf", "docs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            some = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            whole = int(np.searchsorted(some["block"].to_numpy(), some["block"][-1].as_py())) if some.num_rows else 0
            if whole:
                yield pack(some.slice(0, whole))
            left = some.slice(whole)  # its last block may go on
        if left is not None and left.num_rows:
            yield pack(left)

    placed = rows.repartition("block").sortWithinPartitions("block", "key", "length")
    return placed.mapInArrow(work, f"term string, block long, n int, cf long, docs array<struct<key:{kind},tf:int,length:int>>")


def build(docs: DataFrame, key: str, text: Column, path: str | None = None, pattern: str = "[a-z]{3,}", per_block: int = 32, buckets: int = 16, k1: float = 1.2, b: float = 0.75) -> Postings:
    """Writes the index of docs to `path` (without one, to the shared folder until the driver ends) and opens it.

    Documents are numbered by length class (half powers of two) and key, within ranges, not in one task; a block is a run
    of these numbers. A null text has no terms but counts as a document; keys may repeat.
    """
    spark = docs.sparkSession
    path = path or fresh(spark)
    rows = staged(_counted(spread(docs.select(F.col(key).alias("key"), F.coalesce(F.lower(text), F.lit("")).alias("t"))), pattern).withColumn("row", F.monotonically_increasing_id()))  # counted once
    kind = F.floor(2 * F.log2(F.col("length") + 1)).cast("int")
    placed = ordinal(rows.select(kind.alias("kind"), "key", "length", "row"), ["kind", "key", "length", "row"], "at").select("row", "at")
    placed = rows.join(placed, "row")  # terms are not ranged, only keys
    n, total = rows.agg(F.count(F.lit(1)), F.sum("length")).first()
    made = Postings(docs, docs, n, total / n if n else 0.0, buckets, k1, b)
    blocks = _packed(placed.select(F.floor((F.col("at") - 1) / per_block).alias("block"), "key", "length", "terms"))
    blocks = blocks.select(_bucket(F.col("term"), buckets).alias("bucket"), *blocks.columns)
    blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/blocks")
    stored = spark.read.schema(blocks.schema).parquet(f"{path}/blocks")
    stored.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    spark.createDataFrame([(made.n, made.mean, buckets, k1, b, stored.schema.json())], "n long, mean double, buckets int, k1 double, b double, shape string").coalesce(1).write.parquet(f"{path}/about")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Postings:
    """An index that `build` has written."""
    about = spark.read.parquet(f"{path}/about").first()
    blocks = spark.read.schema(StructType.fromJson(json.loads(about.shape))).parquet(f"{path}/blocks")
    return Postings(blocks, spark.read.parquet(f"{path}/terms"), about.n, about.mean, about.buckets, about.k1, about.b)


def asked(requests: DataFrame, request: str, phrase: Column) -> DataFrame:
    """(request, term): the distinct terms of each request, by the rule of text.query_terms."""
    return requests.select(F.col(request).alias("request"), F.explode(T.query_terms(phrase)["terms"]).alias("term"))


@dataclass
class _Shard:
    """The postings of one shard as arrays: for each term a run of documents, which are the ranks of their keys in the shard.
    A term of many documents has bits too, that tell whether a document is in its run, and where."""

    codes: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    gain: np.ndarray | None
    times: np.ndarray | None
    most: np.ndarray
    keys: pa.Array
    row: np.ndarray
    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], impact) -> _Shard:
        rows = pa.Table.from_batches(batches).combine_chunks()  # a row each posting, sorted by term
        one = lambda name: rows[name].combine_chunks()
        named = one("key").dictionary_encode(null_encoding="encode")
        order = pc.array_sort_indices(named.dictionary, null_placement="at_start").to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = one("term").to_numpy()
        first = np.diff(codes, prepend=codes[0] - 1) != 0
        at = (np.cumsum(first) - 1) * len(order) + rank[named.indices.to_numpy()]
        place = np.argsort(at, kind="stable")
        at, gain, times = at[place], None, None
        if impact:
            gain = impact(one("tf").to_numpy()[place].astype(float), one("length").to_numpy()[place].astype(float))
        once = np.flatnonzero(np.diff(at, prepend=-1))
        if len(once) < len(at):  # keys repeat
            times = np.diff(np.append(once, len(at)))
            at, gain = at[once], np.add.reduceat(gain, once) if impact else times.astype(float)
        starts = np.searchsorted(at, np.arange(first.sum() + 1) * len(order))
        most = np.maximum.reduceat(gain, starts[:-1]) if gain is not None else np.ones(len(starts) - 1)
        held = np.flatnonzero(np.diff(starts) * 128 >= len(order))
        row, words = np.full(len(starts) - 1, -1), -(-len(order) // 64)
        row[held], bits = np.arange(len(held)), np.zeros((len(held), words), "<u8")
        for i, t in enumerate(held):
            flags = np.zeros(64 * words, bool)
            flags[at[starts[t] : starts[t + 1]] - t * len(order)] = True
            bits[i] = np.packbits(flags, bitorder="little").view("<u8")
        there = np.bitwise_count(bits)
        before = np.cumsum(there, axis=1, dtype=np.int32) - there
        return cls(codes[first], starts, at, gain, times, most, named.dictionary.take(pa.array(order)), row, bits, before)

    def reached(self, last: pa.Array) -> np.ndarray:
        """How many of the shard's keys are not behind each of `last`, nulls first."""
        known = self.keys.drop_null()
        out = np.full(len(last), len(self.keys) - len(known))
        there = last.is_valid().to_numpy(zero_copy_only=False)
        out[there] += np.searchsorted(known.to_numpy(zero_copy_only=False), last.drop_null().to_numpy(zero_copy_only=False), side="right")
        return out

    def found(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where each document is in the run of its term; -1 where it is not. A term may be -1."""
        out, row = np.full(len(term), -1), np.where(term < 0, -2, self.row[term])
        some = np.flatnonzero(row >= 0)
        held = self.bits[row[some], doc[some] >> 6]
        hit = held >> (doc[some] & 63).astype(np.uint64) & 1 > 0
        some, held = some[hit], held[hit]
        below = (np.uint64(1) << (doc[some] & 63).astype(np.uint64)) - np.uint64(1)
        out[some] = self.starts[term[some]] + self.before[row[some], doc[some] >> 6] + np.bitwise_count(held & below)
        some = np.flatnonzero(row == -1)
        want = term[some] * len(self.keys) + doc[some]
        at = np.minimum(np.searchsorted(self.at, want), len(self.at) - 1)
        hit = self.at[at] == want
        out[some[hit]] = at[hit]
        return out

    def best(self, lengths: np.ndarray, terms: np.ndarray, w: np.ndarray, total: np.ndarray, floor: np.ndarray, last: np.ndarray, k: int, heads: int, flat: bool):
        """(documents, raw, matched) of up to k documents of each request, a row each, documents -1 behind the last; how many
        postings there were and were read; and the largest bound.

        Terms are taken by what they can add, most first: a request's documents with none of the terms so far can no longer
        reach a floor once the rest of its terms adds up to less. A document is let go as soon as it cannot reach it.
        """
        n, many = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
        place = np.minimum(np.searchsorted(self.codes, terms), len(self.codes) - 1)
        known = self.codes[place] == terms
        many, place, w = many[known], place[known], w[known]
        order = np.lexsort((place, -w * self.most[place], many))
        many, place, w = many[order], place[order], w[order]
        count = np.bincount(many, minlength=n)
        width = int(count.max(initial=0))
        column = np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count)
        code, weight, rest = np.full((n, width), -1), np.zeros((n, width)), np.zeros((n, width + 1))
        code[many, column], weight[many, column], rest[many, column] = place, w, w * self.most[place]
        rest = np.cumsum(rest[:, ::-1], axis=1)[:, ::-1]
        sizes = np.bincount(many, np.diff(self.starts)[place], minlength=n).astype(np.int64)
        read = np.zeros(n, np.int64)
        doc, shown, raw, matched = np.full((n, k), -1), np.full((n, k), -np.inf), np.zeros((n, k)), np.zeros((n, k), np.int64)
        slack = np.maximum(NOISE, (2e-9 if flat else 0.0) * total)  # what may be the same at nine decimals
        floor = floor.copy()
        last = last.copy()

        def may(request: np.ndarray, bound: np.ndarray, d: np.ndarray | None = None) -> np.ndarray:
            at = floor[request]
            more = bound > np.where(at == -np.inf, at, at + 1e-12 * (1 + at))
            return more | ((bound >= at - slack[request]) & (d <= last[request] if d is not None else True))

        def taken(request: np.ndarray, j: int, start: np.ndarray, size: np.ndarray) -> None:
            """Scores runs of the j-th term, and puts them to the best."""
            r = np.repeat(request, size)
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            d, s = self.at[at] - code[r, j] * len(self.keys), weight[r, j] * (1.0 if self.gain is None else self.gain[at])
            m = np.ones(len(at), np.int64) if self.times is None else self.times[at]
            read[request] += size
            for i in range(j, width):
                if i > j:
                    at = self.found(code[r, i], d)
                    hit = np.flatnonzero(at >= 0)
                    s[hit] += weight[r[hit], i] * (1.0 if self.gain is None else self.gain[at[hit]])
                    m[hit] += 1 if self.times is None else self.times[at[hit]]
                    read[:] += np.bincount(r[hit], minlength=n)
                kept = may(r, s + rest[r, i + 1], d)
                r, d, s, m = r[kept], d[kept], s[kept], m[kept]
                if not len(r):
                    return
            for i in range(j):  # met with an earlier term
                kept = self.found(code[r, i], d) < 0
                r, d, s, m = r[kept], d[kept], s[kept], m[kept]
            those, own = np.unique(r, return_inverse=True)
            who = np.concatenate([np.repeat(np.arange(len(those)), k), own])
            d, s, m = np.concatenate([doc[those].ravel(), d]), np.concatenate([raw[those].ravel(), s]), np.concatenate([matched[those].ravel(), m])
            v = np.concatenate([shown[those].ravel(), np.round(s[len(those) * k :] / np.where(total > 0, total, 1.0)[r] if flat else s[len(those) * k :], 9)])
            order = np.lexsort((d, -v, who))
            sized = np.bincount(who)
            rank = np.arange(len(who)) - np.repeat(np.cumsum(sized) - sized, sized)
            best, rank = order[rank < k], rank[rank < k]
            to = those[who[best]], rank
            doc[to], shown[to], raw[to], matched[to] = d[best], v[best], s[best], m[best]
            kth = doc[those, k - 1]
            better = (kth >= 0) & ((raw[those, k - 1] > floor[those]) | ((raw[those, k - 1] == floor[those]) & (kth < last[those])))
            floor[those[better]], last[those[better]] = raw[those[better], k - 1], kth[better]

        for j in range(width):
            for begin, most in ((0, heads), (heads, None)) if j == 0 else ((0, None),):
                request = np.flatnonzero((code[:, j] >= 0) & may(np.arange(n), rest[:, j]))
                start, end = self.starts[code[request, j]] + begin, self.starts[code[request, j] + 1]
                size = np.maximum((end if most is None else np.minimum(end, start + most)) - start, 0)
                cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // PIECE, prepend=-1))
                for i, e in zip(cuts, np.append(cuts, len(request))[1:], strict=True):
                    taken(request[i:e], j, start[i:e], size[i:e])
        return doc, raw, matched, sizes, read, rest[:, 0]


def _answers(index: Postings, held: DataFrame, asked: DataFrame, shards: int, k: int, heads: int, flat: bool) -> DataFrame:
    """(request, shard, total, found, terms, read, bound) of asked (shard, request, total, terms: array of (at, code, w), floor,
    last). A shard's postings and the requests to it meet in one task: first the postings, then a stream of requests, so that
    a task holds one shard and a batch of requests."""
    both = held.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "term")
    # a row each posting, or each term of a request: lists that are mostly null cost far more to send
    both = both.select("*", F.inline_outer("docs")).drop("docs").select("*", F.inline_outer("terms")).drop("terms")
    key, request = _key(index).simpleString(), asked.schema["request"].dataType.simpleString()
    shape = f"request {request}, shard int, total double, found array<struct<key:{key},raw:double,matched:int>>, terms long, read long, bound double"
    k1, b, mean = index.k1, index.b, index.mean or 1.0
    impact = None if flat else lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, shard, left = None, [], None, None
        for whole in batches:
            place = np.flatnonzero(np.diff(whole["shard"].to_numpy() * 2 + whole["kind"].to_numpy(), prepend=-1))
            for i, j in zip(place, [*place[1:], whole.num_rows], strict=True):
                some = whole.slice(i, j - i)
                if some["shard"][0].as_py() != now:
                    if left is not None:
                        yield from answers(shard, now, left)
                    now, waiting, shard, left = some["shard"][0].as_py(), [], None, None
                if some["kind"][0].as_py() == 0:
                    waiting.append(some.select(["term", "key", "tf", "length"]))
                elif waiting or shard:  # a shard with postings
                    shard, waiting = shard or _Shard.of(waiting, impact), []
                    some = pa.Table.from_batches([some.select(["request", "total", "floor", "last", "at", "code", "w"])])
                    some = some if left is None else pa.concat_tables([left, some])
                    ready = int(np.flatnonzero(some["at"].to_numpy() == 0)[-1]) if some.num_rows >= PIECE // 8 else 0  # the last request may go on
                    yield from answers(shard, now, some.slice(0, ready))
                    left = some.slice(ready)
        if left is not None:
            yield from answers(shard, now, left)

    def answers(shard: _Shard, now: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = np.append(np.flatnonzero(rows["at"].to_numpy() == 0), rows.num_rows)
        lengths = np.diff(starts)
        step = max(1, PIECE // int(lengths.max(initial=1)))
        for i in range(0, len(lengths), step):
            some = starts[i : i + step + 1]
            yield answer(shard, now, rows.slice(some[0], some[-1] - some[0]), some[:-1] - some[0], lengths[i : i + step])

    def answer(shard: _Shard, now: int, rows: pa.Table, starts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        some = rows.take(pa.array(starts)).combine_chunks().to_batches()[0]
        floor = some["floor"].fill_null(-np.inf).to_numpy(zero_copy_only=False)
        doc, raw, matched, sizes, read, bound = shard.best(lengths, rows["code"].to_numpy(), rows["w"].to_numpy(), some["total"].to_numpy(), floor, shard.reached(some["last"]) - 1, k, heads, flat)
        kept = np.flatnonzero(sizes)
        doc, raw, matched = doc[kept], raw[kept], matched[kept]
        there, of = doc >= 0, some.take(pa.array(kept))
        found = pa.StructArray.from_arrays([shard.keys.take(pa.array(doc[there])), pa.array(raw[there]), pa.array(matched[there], pa.int32())], ["key", "raw", "matched"])
        offsets = pa.array(np.cumsum(np.append(0, there.sum(axis=1))), pa.int32())
        columns = [of["request"], pa.array(np.full(len(kept), now), pa.int32()), of["total"], pa.ListArray.from_arrays(offsets, found), *(pa.array(x[kept]) for x in (sizes, read, bound))]
        return pa.RecordBatch.from_arrays(columns, names=["request", "shard", "total", "found", "terms", "read", "bound"])

    return both.mapInArrow(work, shape)


def _staged(answers: DataFrame) -> DataFrame:
    """staged, with batches for Python bounded by their number of rows alone: these rows are short, and measuring a batch
    after every row costs more than all else."""
    conf, name = answers.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    was = conf.get(name, None)
    conf.set(name, str(2**31 - 1))
    try:
        return staged(answers)
    finally:
        conf.set(name, was) if was else conf.unset(name)


def _key(index: Postings) -> DataType:
    return index.blocks.schema["docs"].dataType.elementType["key"].dataType


#: Blocks of a shard, at most: with blocks of 32 some 30,000 documents.
SHARD = 1024
#: Postings that a task scores at once; a single run may be longer.
PIECE = 1 << 19
#: Terms asked for that are sent to every task; more are shuffled.
BROADCAST_TERMS = 300_000


def search(index: Postings, terms: DataFrame, k: int, rule: str = "share", heads: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, blocks) for the requests of terms (request, term; distinct).

    hits: request, key, score, matched, rank: the k best documents of each request, ties by key. rule `share`: the idf of
    the terms matched over that of all the request's terms, at nine decimals, absent terms included; `bm25`: BM25.
    blocks: request, shard, terms, bound, read: how many postings of its terms each shard has, and how many of them were
    read, with the most that a document could score there. `heads`: so many documents of a request's first term give it a
    floor before others are looked at.
    """
    flat, heads = rule == "share", heads or max(32, k)
    terms = terms.withColumn("bucket", _bucket(F.col("term"), index.buckets))
    wanted = staged(terms.select("bucket", "term").distinct().join(index.terms.select("bucket", "term", "df"), ["bucket", "term"]).withColumn("code", F.monotonically_increasing_id()))
    n = wanted.count()
    sent = F.broadcast(wanted) if n <= BROADCAST_TERMS else wanted
    known = terms.join(sent, ["bucket", "term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    known = known.withColumn("w", idf(F.col("df"), F.lit(index.n)) if flat else okapi(F.col("df"), index.n))
    some = F.sort_array(F.collect_list(F.when(F.col("df") > 0, F.struct("code", "w"))))
    some = F.transform(some, lambda t, i: F.struct(i.alias("at"), t["code"].alias("code"), t["w"].alias("w")))
    asked = staged(known.groupBy("request").agg(F.sum("w").alias("total"), some.alias("terms")).where(F.size("terms") > 0))
    last = index.blocks.agg(F.max("block")).first()[0] or 0
    per_shard = min(SHARD, max(64, -(-(last + 1) // (2 * asked.sparkSession.sparkContext.defaultParallelism))))
    shards = last // per_shard + 1
    held = index.blocks.select("bucket", "term", "block", "docs").join(sent.select("bucket", "term", "code"), ["bucket", "term"])
    held = held.select(F.pmod("block", F.lit(shards)).cast("int").alias("shard"), F.col("code").alias("term"), "docs")  # dealt, as blocks go by length
    home = F.pmod(F.xxhash64("request"), F.lit(shards)).cast("int")  # each request's first shard gives it a floor for the others
    begun = _staged(_answers(index, held, asked.select(home.alias("shard"), "request", "total", "terms", F.lit(None).cast("double").alias("floor"), F.lit(None).cast(_key(index)).alias("last")), shards, k, heads, flat))
    nth = begun.where(F.size("found") == k).select("request", F.element_at("found", -1).alias("x")).select("request", F.col("x.raw").alias("floor"), F.col("x.key").alias("last"))
    others = asked.join(nth, "request", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    every = begun
    if shards > 1:
        every = begun.unionByName(_staged(_answers(index, held, others.select("shard", "request", "total", "terms", "floor", "last"), shards, k, heads, flat)))
    found = every.select("request", "total", F.inline("found")).groupBy("request", "key").agg(F.first("total").alias("total"), F.sum("raw").alias("raw"), F.sum("matched").cast("int").alias("matched"))
    score = F.round(F.col("raw") / F.col("total"), 9) if flat else F.round("raw", 9)
    scored = found.select("request", "key", score.alias("score"), "matched")
    kinds = F.array(F.struct(F.col("read").alias("terms"), F.lit(True).alias("read")), F.struct((F.col("terms") - F.col("read")).alias("terms"), F.lit(False).alias("read")))
    blocks = every.select("request", "shard", "bound", F.inline(kinds)).where("terms > 0")
    return top(scored, ["request"], [F.desc("score"), F.col("key")], k), blocks
