"""Vector bin packing by the dot-product heuristic, and packing of tokenised documents into sequences."""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.session import ship_package

POOL = 512  # open pieces among which the heuristic chooses
CACHED = 250_000
LONG = 2_000  # characters; longer pieces are split by the tokenizer's pattern first
BETWEEN_SPACES = re.compile(r"\s (?:\s|$)")


class Packer:
    """Fills one bin at a time with the open item whose demand has the largest dot product with what is left.

    Demands and what is left are taken relative to the limits, so a scarce resource weighs more. ``items`` are
    ``(payload, demand)``. Bins close when no open item fits; at most ``POOL`` items are open.
    """

    def __init__(self, limits: tuple[int, ...]):
        self.limits = np.array(limits, dtype=np.float64)
        self.demand = np.zeros((2 * POOL, len(limits)))
        self.payload: list = [None] * (2 * POOL)
        self.n = 0

    def add(self, payload, demand) -> None:
        self.demand[self.n], self.payload[self.n] = demand, payload
        self.n += 1

    def take(self, k: int):
        out, self.n = (self.payload[k], self.demand[k].copy()), self.n - 1
        self.payload[k], self.demand[k] = self.payload[self.n], self.demand[self.n]
        self.payload[self.n] = None
        return out

    def best(self, left: np.ndarray, must_fit: bool = True) -> int | None:
        """Index of the item to place next; ties go to the one added first among those that did not move."""
        open_ = self.demand[: self.n]
        score = open_ @ (left / (self.limits * self.limits))
        if must_fit:
            score[(open_ > left).any(axis=1)] = -1.0
        if not self.n or (k := int(score.argmax())) is None or score[k] < 0:
            return None
        return k

    def bin(self) -> list:
        """One closed bin of whole items; an item above a limit gets a bin of its own."""
        out, left = [], self.limits.copy()
        while self.n and (k := self.best(left)) is not None:
            payload, demand = self.take(k)
            out.append(payload)
            left = left - demand
        return out or [self.take(0)[0]]


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, segments_col: str, loss_col: str,
                  limits: tuple[int, int, int] = (1024, 16, 1024)) -> DataFrame:
    """``id, bin_id, position, tokens, segments, loss_tokens, fits``: whole examples under limits on all three.

    Each task packs its own partition, so nothing is shuffled and memory is a fixed pool; a bin's id holds the
    partition's number. An example above a limit has a bin of its own with ``fits`` false. Null counts are 0. Repeated
    rows are packed as rows. Empty table: empty result.
    """
    ship_package(examples.sparkSession)
    kind = examples.schema[id_col].dataType.simpleString()

    def run(batches):
        packer, number, base = Packer(limits), 0, TaskContext.get().partitionId() << 40

        def close(keep: int) -> Iterator[tuple]:
            nonlocal number
            while packer.n > keep:
                for at, (ident, t, s, loss) in enumerate(packer.bin()):
                    yield ident, base + number, at, t, s, loss, t <= limits[0] and s <= limits[1] and loss <= limits[2]
                number += 1

        def rows(found):
            found = list(found)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), schema)] if found else
                                              [pa.array([], f.type) for f in schema], schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("id", batch.schema.field(0).type), ("bin_id", pa.int64()), ("position", pa.int32()),
                                          ("tokens", pa.int64()), ("segments", pa.int64()), ("loss_tokens", pa.int64()), ("fits", pa.bool_())])
            found: list = []
            for item in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(item, item[1:])
                if packer.n >= 2 * POOL:
                    found.extend(close(POOL))
            yield rows(found)
        if schema:
            yield rows(close(0))

    count = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    return examples.select(F.col(id_col).alias("id"), count(tokens_col).alias("tokens"), count(segments_col).alias("segments"),
                           count(loss_col).alias("loss_tokens")).mapInArrow(
        run, f"id {kind}, bin_id bigint, position int, tokens bigint, segments bigint, loss_tokens bigint, fits boolean")


class Encoder(dict):
    """Little-endian unsigned 32-bit ids of a text; remembers a bounded number of pieces between single spaces.

    A space with no white space on either side always starts a token of this pattern, so pieces that begin there can be
    encoded on their own. A text that has white space around a space goes to the tokenizer whole, and a long piece is
    split by the pattern before merging, as its cost is not linear otherwise. ``added`` tokens have one id wherever they stand in
    a text; what is between them is encoded as texts of its own.
    """

    def __init__(self, ranks_file: str, added: tuple[tuple[str, int], ...] = ()):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.added = {token: np.array([i], dtype="<u4").tobytes() for token, i in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marker = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None

    def plain(self, text: str) -> bytes:
        if len(text) <= LONG:
            return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()
        merge = self.bpe._encode_single_piece
        return np.array([i for m in self.pattern.finditer(text) for i in merge(m[0])], dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.plain(" " + piece)
        if len(self) < CACHED and len(piece) <= 24:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.marker is None or not self.marker.search(text):
            return self.between(text)
        parts = self.marker.split(text)  # texts and markers in turn
        return b"".join(self.added[p] if k % 2 else self.between(p) for k, p in enumerate(parts) if p)

    def between(self, text: str) -> bytes:
        if BETWEEN_SPACES.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))


@functools.lru_cache(maxsize=1)
def encoder(ranks_file: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    return Encoder(ranks_file, added)


def added_tokens(tokenizer_file: str) -> tuple[tuple[str, int], ...]:
    """Tokens that a tokenizer's JSON file adds to its vocabulary, with their ids."""
    with open(tokenizer_file, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


def powers(n: int) -> Iterator[int]:
    """The powers of two that add up to ``n``, largest first."""
    while n:
        yield (p := 1 << (n.bit_length() - 1))
        n -= p


def pack_documents(docs: DataFrame, ranks_file: str, length: int = 1024, max_segments: int = 256, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """All documents as token sequences of at most ``length``: one row per piece with ``doc_id, start, length,
    doc_tokens, sequence_id, offset, padded_to, ids`` (little-endian unsigned 32-bit ids as bytes).

    A document is its ids and ``end_id``. Full stretches of ``length`` are sequences at once; what is left of each
    document is packed by the dot-product heuristic on tokens, segments and loss-bearing tokens (all of them here),
    and where nothing fits whole the best piece is cut, so only a sequence at its segment limit is padded. What a task
    has at its end goes into sequences of powers of two, which need no padding. Tasks pack their own partitions: no
    shuffle, a fixed pool, and a task that is run again gives the same rows. Null text: empty, one ``end_id``. Null
    ids pass through. Repeated rows are packed as rows. Empty table: empty result. ``length`` is a power of two. ``added`` tokens (see ``added_tokens``) inside a text have their one id.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc, packer, number, base = encoder(ranks_file, added), Packer((length, max_segments, length)), 0, TaskContext.get().partitionId() << 40
        out: list = []
        end = np.array([end_id], dtype="<u4").tobytes()

        def emit(pieces, padded_to: int) -> None:
            nonlocal number
            at = 0
            for ident, start, total, ids in pieces:
                out.append((ident, start, len(ids) // 4, total, base + number, at, padded_to, ids))
                at += len(ids) // 4
            number += 1

        def fill(room: int) -> list:
            pieces, left = [], np.array([room, max_segments, room], dtype=float)
            while packer.n and left[0] > 0 and left[1] > 0:
                whole = packer.best(left)
                (ident, start, total, ids), _ = packer.take(packer.best(left, must_fit=False) if whole is None else whole)
                cut = int(left[0]) * 4
                if len(ids) > cut:
                    n = (len(ids) - cut) // 4
                    packer.add((ident, start + cut // 4, total, ids[cut:]), (n, 1, n))
                    ids = ids[:cut]
                pieces.append((ident, start, total, ids))
                left -= (len(ids) // 4, 1, len(ids) // 4)
            return pieces

        def close(keep: int) -> None:
            while packer.n > keep:
                pieces = fill(length)
                used = sum(len(p[3]) for p in pieces) // 4
                if used < length and not packer.n and used & (used - 1):
                    for p in pieces:
                        packer.add(p, (len(p[3]) // 4, 1, len(p[3]) // 4))
                    for room in powers(used):
                        emit(fill(room), room)
                else:
                    emit(pieces, used if not used & (used - 1) else length)

        def rows():
            columns = list(zip(*out)) or [()] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
            out.clear()
            return batch

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                                          ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_to", pa.int64()), ("ids", pa.binary())])
            for ident, text in zip(*batch.columns):
                ids = enc.encode(text.as_py() or "") + end
                ident, total, start = ident.as_py(), len(ids) // 4, 0
                while total - start >= length:
                    emit([(ident, start, total, ids[start * 4:(start + length) * 4])], length)
                    start += length
                if start < total:
                    packer.add((ident, start, total, ids[start * 4:]), (total - start, 1, total - start))
                    if packer.n >= 2 * POOL - 1:
                        close(POOL)
                if len(out) >= 2_000:
                    yield rows()
            yield rows()
        if schema:
            close(0)
            yield rows()

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_to bigint, ids binary")
