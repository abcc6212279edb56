"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.session import ship_package

HASHES = 3
CELLS = 12  # of the stored sketch
CACHED = 200_000
PIECE_WORDS = 8  # words per piece, on average
BATCH = 512  # documents compared at once
BATCH_KEYS = 1 << 18
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class Ends(dict):
    """Whether a word ends a piece; bounded."""

    def __missing__(self, word: str) -> bool:
        end = "\n" in word or not xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % PIECE_WORDS
        if len(self) < CACHED and len(word) <= 48:
            self[word] = end
        return end


def digests(text: str, ends: Ends) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraphs, long ones in pieces: one ends with a line feed or with a word
    whose hash is divisible by ``PIECE_WORDS``, so an edit changes the pieces it touches only. Empty text: none."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.split(" ")
    stops = [i + 1 for i, end in enumerate(map(ends.__getitem__, words)) if end]
    if not stops or stops[-1] != len(words):
        stops.append(len(words))
    join, digest, start, out = " ".join, xxhash.xxh64_intdigest, 0, []
    for stop in stops:
        out.append(digest(join(words[start:stop]).encode("utf-8", "surrogatepass")))
        start = stop
    return np.unique(np.array(out, dtype=np.uint64))


def mixed(keys: np.ndarray, k: int) -> np.ndarray:
    x = keys * MULTIPLIERS[k]
    x ^= x >> np.uint64(29)
    x *= MULTIPLIERS[(k + 1) % 4]
    return x ^ (x >> np.uint64(32))


def cells_of(keys: np.ndarray, cells: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """The ``HASHES`` cells of each key, one in each third of its sketch."""
    third = (cells // HASHES).astype(np.uint64)
    return [base + k * (cells // HASHES) + (mixed(keys, k) % third).astype(np.int64) for k in range(HASHES)]


def insert(count, total, check, at: list[np.ndarray], keys: np.ndarray, sign: np.ndarray) -> None:
    signed, checks = keys * sign.astype(np.uint64), mixed(keys, 3) * sign.astype(np.uint64)
    for cell in at:
        np.add.at(count, cell, sign)
        np.add.at(total, cell, signed)
        np.add.at(check, cell, checks)


def sketch(keys: np.ndarray, cells: int = CELLS) -> str:
    """The sketch as text: per cell a count, the sum of its digests and the sum of their check values."""
    count, total, check = np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
    whole = np.full(len(keys), cells)
    insert(count, total, check, cells_of(keys, whole, np.zeros(len(keys), np.int64)), keys, np.ones(len(keys), np.int64))
    low = (check >> np.uint64(32)).astype("<u4").tobytes()
    return base64.b64encode(count.astype("<u4").tobytes() + total.astype("<u8").tobytes() + low).decode()


def peel(pairs: list[tuple[np.ndarray, np.ndarray]], cells: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Subtract the second set's sketch from the first's, for many pairs at once, and recover what differs.

    Returns whether a pair's sketch came out empty, and per pair the digests recovered.
    """
    n = len(pairs)
    sizes = np.array([(len(a), len(b)) for a, b in pairs]).reshape(n, 2)
    owner = np.repeat(np.arange(n), sizes.sum(axis=1))
    keys = np.concatenate([x for p in pairs for x in p]) if n else np.empty(0, np.uint64)
    sign = np.concatenate([np.repeat([1, -1], s) for s in sizes]) if n else np.empty(0, np.int64)
    base = np.concatenate([[0], cells.cumsum()])
    count, total, check = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.uint64)
    insert(count, total, check, cells_of(keys, cells[owner], base[owner]), keys, sign)
    cell_owner = np.repeat(np.arange(n), cells)
    found_keys, found_owner = [], []
    while True:
        at = np.flatnonzero(np.abs(count) == 1)
        s = count[at]
        key = total[at] * s.astype(np.uint64)
        pure = mixed(key, 3) * s.astype(np.uint64) == check[at]
        at, s, key = at[pure], s[pure], key[pure]
        if not len(at):
            break
        who = cell_owner[at]
        order = np.lexsort((key, who))
        first = np.ones(len(order), bool)
        first[1:] = (who[order][1:] != who[order][:-1]) | (key[order][1:] != key[order][:-1])
        pick = order[first]
        who, key, s = who[pick], key[pick], s[pick]
        insert(count, total, check, cells_of(key, cells[who], base[who]), key, -s)
        found_keys.append(key)
        found_owner.append(who)
    left = np.bincount(cell_owner, weights=(count != 0) | (total != 0), minlength=n)
    owners = np.concatenate(found_owner or [np.empty(0, np.int64)])
    every = np.concatenate(found_keys or [np.empty(0, np.uint64)])
    order = np.argsort(owners, kind="stable")
    return left == 0, np.split(every[order], np.bincount(owners, minlength=n).cumsum()[:-1]) if n else []


def differing(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The digests in which each pair differs; a pair whose sketch cannot be peeled is tried with four times the cells."""
    out: list = [None] * len(pairs)
    todo, cells = np.arange(len(pairs)), CELLS
    while len(todo):
        done, found = peel([pairs[i] for i in todo], np.full(len(todo), cells))
        for i, ok, x in zip(todo, done, found):
            if ok:
                out[i] = x
        todo, cells = todo[~done], cells * 4
    return out


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Share of all distinct pieces that both have; 1 for two texts without any."""
    out = []
    for (a, b), d in zip(pairs, differing(pairs)):
        both = (len(a) + len(b) - len(d)) // 2
        out.append(both / max(1, both + len(d)) if len(d) or both else 1.0)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` of whole texts. Equal texts have equal fingerprints; a null text counts as empty."""
    ship_package(docs.sparkSession)
    ends = Ends()

    @F.pandas_udf("string")
    def stored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sketch(digests(t, ends)))

    return docs.select(F.col(id_col).alias("id"), stored(F.coalesce(F.col(text_col), F.lit(""))).alias("fingerprint"))


def followed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket, extra, k, id, text`` so that within a bucket each row is followed by the next document.

    Ids are cut at quantiles into buckets; a bucket also gets the first document of the bucket after it (the last one
    the first of all), marked ``extra``. So each text moves once, no order is built over more than a bucket, and only
    bucket bounds reach the driver.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(lowest)).alias("k"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.unique(np.array(rows.select("k").approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n) or [], dtype=np.float64))

    def cut(k: pd.Series) -> np.ndarray:
        return np.searchsorted(bounds, k.to_numpy().astype(np.float64), side="right").astype(np.int32)

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(cut(k))

    first = dict(rows.select("k").withColumn("bucket", bucket_of("k")).groupBy("bucket").agg(F.min("k")).collect())
    full = sorted(first)
    before = {first[b]: full[i - 1] for i, b in enumerate(full)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        return pd.Series([[b, before[x]] if x in before else [b] for b, x in zip(cut(k), k)], dtype=object)

    placed = rows.withColumn("p", places("k")).select("id", "k", "text", F.posexplode("p").alias("extra", "bucket"))
    return placed.repartition(n // 4, "bucket").sortWithinPartitions("bucket", "extra", "k", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for whole texts.

    The edited text has its last half replaced by as much of the next document's beginning, by ascending id and
    then text; after the last comes the first. Likeness is the share of paragraph pieces in common, recovered by
    subtracting and peeling sketches. Null ids come first, null texts count as empty, repeated rows follow each
    other, and a single document follows itself. Empty table: empty result.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        ends, pending, out, keys_held = Ends(), None, [], 0

        def rows():
            nonlocal keys_held
            ids, chars, sha, own, edited, following = zip(*out) if out else ((),) * 6
            near_edited = likeness(list(zip(own, edited)))
            near_next = likeness(list(zip(own, following)))
            batch = pa.RecordBatch.from_arrays([
                pa.array(list(ids), id_type), pa.array(list(chars), pa.int64()), pa.array(list(sha), pa.string()),
                pa.array([sketch(x) for x in own], pa.string()), pa.array([sketch(x) for x in edited], pa.string()),
                pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64())],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            out.clear()
            keys_held = 0
            return batch

        id_type = None
        for batch in batches:
            id_type = id_type or batch.schema.field("id").type
            for bucket, extra, ident, text in zip(*(batch.column(c) for c in ("bucket", "extra", "id", "text"))):
                bucket, extra, text = bucket.as_py(), extra.as_py(), text.as_py()
                own = digests(text, ends)
                if pending and pending[0] == bucket:
                    _, before_id, before, before_keys = pending
                    half = len(before) // 2
                    edited = before[:len(before) - half] + text[:half]
                    edited_keys = digests(edited, ends)
                    out.append((before_id, len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), before_keys, edited_keys, own))
                    keys_held += 2 * (len(before_keys) + len(edited_keys) + len(own))
                pending = None if extra else (bucket, ident.as_py(), text, own)
                if len(out) >= BATCH or keys_held > BATCH_KEYS:
                    yield rows()
            if out:
                yield rows()

    return followed(docs, id_col, text_col).select("bucket", "extra", "id", "text").mapInArrow(
        run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
