"""Chat formatting at the level of tokens: segments are encoded apart, reserved ids spliced in, masks by prefix sums.

A turn becomes START role BODY text END. Roles that are known have an id of their own, any other is spelt out behind an
id that says so. Reserved ids lie beyond the tokenizer's vocabulary, so no text can produce them; in rendered text they
stand for control strings, and where a text holds such a string, or the escape itself, it is escaped reversibly. The
loss mask of a turn is a run of its ids, found from the running sum of its segments' lengths; a running sum over turns
gives every turn its place in the conversation.

Turns are encoded, and decoded again, by as many tasks as there are batches; only the running sums and digests of one
conversation need its turns in order, and these stream over sorted rows and keep a few numbers each, so a conversation
of any length needs no memory of its size. (A digest of one conversation cannot be split: it is sequential.)

Cases: null text and null role are empty; turns are in order of turn (nulls first), then role, then text, so that ties
and repeated rows, which all stay, have one order; a null conv_id is a conversation; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPELT, bound_batches, held, spelt, text_of

ROLES = ("system", "user", "assistant")
ESCAPE, OPEN, BODY, END = "\\", "### ", ": ", "</turn>\n"
LEARNT = "assistant"
_CONTROL = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(\\|### |</turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


# How byte-level tokenizers cut a text into pieces, which no token crosses.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KNOWN_PIECES = 200_000


class _Encoder(dict):
    """A lossless tokenizer and the ids reserved behind its vocabulary; ids are little-endian 32-bit numbers.

    A byte-level vocabulary is read piece by piece, and pieces are kept while they are few; decoding joins the bytes of
    ids. Any other tokenizer does both by itself.
    """

    def __init__(self, tokenizer: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(str(tokenizer))
        self.tokenizer.encode_special_tokens = True
        first = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.start, self.other, self.body, self.end = range(first, first + 4)
        self.roles = {role: first + 4 + i for i, role in enumerate(ROLES)}
        self.names = {i: role for role, i in self.roles.items()}
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        plain = told["model"]["type"] == "BPE" and not told["normalizer"] and not told["model"].get("byte_fallback")
        self.bytes: list[bytes] | None = None
        if plain and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True):
            back = {c: b for b, c in SPELT.items()}
            self.bytes = [b""] * first
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.bytes[i] = token.translate(back).encode("latin-1")
            self.model = self.tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KNOWN_PIECES:
            self.clear()
        self[piece] = found = np.array([t.id for t in self.model.tokenize(spelt(piece))], "<i4").tobytes()
        return found

    def ids(self, text: str) -> bytes:
        if self.bytes is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))

    def turn(self, role: str, text: str) -> tuple[bytes, int, int]:
        """Ids of a turn, and where its learnt ids begin and end."""
        known = self.roles.get(role)
        one = lambda i: i.to_bytes(4, "little")
        segments = [one(self.start), one(known) if known else one(self.other) + self.ids(escape(role)), one(self.body), self.ids(escape(text)), one(self.end)]
        learnt = [False, False, False, role == LEARNT, False]
        ends = np.cumsum([len(s) // 4 for s in segments])
        lo, hi = (int(ends[2]), int(ends[3])) if any(learnt) else (0, 0)
        return b"".join(segments), lo, hi

    def read(self, ids: np.ndarray, lo: int, hi: int) -> tuple[str, str, str, int]:
        """(role, text, learnt text, rendered length), all from the ids and the mask."""
        ids = ids.tolist()
        body = ids.index(self.body)
        if ids[0] != self.start or ids[-1] != self.end:
            raise ValueError("not a turn")
        spoken = self._text(ids[2:body]) if ids[1] == self.other else None
        role = unescape(spoken) if spoken is not None else self.names[ids[1]]
        text = self._text(ids[body + 1 : -1])
        shown = len(OPEN) + len(role if spoken is None else spoken) + len(BODY) + len(text) + len(END)
        learnt = text if (lo, hi) == (body + 1, len(ids) - 1) else self._text([i for i in ids[lo:hi] if i < self.start])
        return role, unescape(text), unescape(learnt), shown

    def _text(self, ids: list[int]) -> str:
        if self.bytes is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""
        return b"".join(map(self.bytes.__getitem__, ids)).decode()


def _encoder(tokenizer: str) -> _Encoder:
    return held(f"chat {tokenizer}", lambda: _Encoder(tokenizer))


TURNS = "conv_id long, place long, start long, ids array<int>, loss_from int, loss_to int"


def assemble(conversations: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """A row a turn, in order: its place, the ids before it in its conversation, its ids, and its run under the mask."""
    bound_batches(conversations.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(tokenizer)
        for batch in batches:
            rows = [own.turn(role, text) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ids, lo, hi = zip(*rows, strict=True) if rows else ((), (), ())
            ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                names=["conv_id", "turn", "role", "text", "ids", "loss_from", "loss_to"],
            )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, start = object(), 0, 0
        for batch in batches:
            places, starts = [], []
            for one, size in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist(), strict=True):
                if one != conv:
                    conv, at, start = one, 0, 0
                places.append(at)
                starts.append(start)
                at, start = at + 1, start + size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), pa.array(starts, pa.int64()), *batch.columns[1:]], names=[x.split()[0] for x in TURNS.split(", ")])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text"))
    encoded = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids array<int>, loss_from int, loss_to int")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "loss_from", "loss_to")
    return ordered.mapInArrow(place, TURNS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """What assembled turns (in any order) say, a row a conversation: digests of all turns and of all text under the mask."""
    bound_batches(turns.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(tokenizer)
        for batch in batches:
            ends, ids = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            spans = zip(ends[:-1], ends[1:], *(batch.column(i).to_pylist() for i in (3, 4)), strict=True)
            rows = [own.read(ids[a:b], lo, hi) for a, b, lo, hi in spans]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())],
                names=["conv_id", "start", "role", "text", "learnt", "shown"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv, state, done = object(), None, []

        def finish() -> None:
            if state:
                done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for one, role, text, learnt, shown in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if state is None or one != conv:
                    finish()
                    conv, state = one, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += shown
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done.clear()
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    read = turns.select("conv_id", "start", "ids", "loss_from", "loss_to").mapInArrow(decode, "conv_id long, start long, role string, text string, learnt string, shown long")
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(digest, DIGEST)
