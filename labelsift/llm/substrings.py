"""Removal of repeated substrings by buckets of sampled q-grams, refined by hashes of the windows around them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.llm import scratch
from labelsift.session import ship_package

Q = 64  # bytes of the q-gram of the initial buckets; a power of two
CHUNK = 1 << 20  # bytes scanned at once
POSITION_BITS = 27
STEP = 16  # windows in a block of the second level
MIX = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F),
               np.uint64(0x165667B19E3779F9), np.uint64(0x2545F4914F6CDD1D)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``Q`` bytes from every position on, by doubling: hashes of half the length are combined."""
    h = data.astype(np.uint64) * MIX
    h ^= h >> np.uint64(31)
    width = 1
    for m in MULTIPLIERS:
        if width >= Q:
            break
        h = h[:-width] * m + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h * MIX


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done, least = 1, key
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = width - done
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def anchors(data: bytes, starts: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at, lo, hi``: sampled positions of concatenated texts, and the windows of ``length`` bytes that start in
    ``lo..hi`` and have their smallest q-gram (the leftmost of equal ones) at ``at``.

    Whether a position is sampled for a window depends on the window's bytes alone, so equal windows have it at the
    same place. Windows never cross texts.
    """
    whole = np.frombuffer(data, dtype=np.uint8)
    if len(whole) < length:
        return (np.empty(0, np.int64),) * 3
    h = gram_hashes(whole)
    key = (h >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_least(key, length - Q + 1) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    windows = np.zeros(len(whole) + 1, dtype=np.int32)
    long = stops - starts >= length
    windows[starts[long]] += 1
    windows[stops[long] - length + 1] -= 1
    valid = windows.cumsum()[:len(at)] > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    last[-1] = valid[-1]
    return at[lo], lo, np.flatnonzero(last)


def digest(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())


def keyed(batches):
    """``id, check, bytes`` of every row; the check tells rows apart that share an id."""
    for batch in batches:
        for ident, text in zip(batch.column(0), batch.column(1)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            yield ident.as_py(), int(np.uint32(xxhash.xxh32_intdigest(data)).view(np.int32)), data


def chunks(batches, length: int):
    """Lists of ``(id, check, bytes, offset)`` of about ``CHUNK`` bytes; longer texts in slices that share all windows'
    bytes, so that memory does not grow with a text."""
    held, total = [], 0
    for ident, check, data in keyed(batches):
        for offset in range(0, max(1, len(data) - length + 1), CHUNK):
            part = data[offset:offset + CHUNK + length - 1]
            if held and total + len(part) > CHUNK:
                yield held
                held, total = [], 0
            held.append((ident, check, part, offset))
            total += len(part)
    if held:
        yield held


def arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def sampled(texts: DataFrame, length: int) -> DataFrame:
    """Level 0, one row per sampled suffix: ``id, check, at``, its windows ``lo..hi``, ``gram`` (its initial q-gram
    bucket) and ``hull`` (the bucket of all bytes of its windows)."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        id_type = arrow_type(kind)
        for held in chunks(batches, length):
            joined = b"".join(d for _, _, d, _ in held)
            stops = np.cumsum([len(d) for _, _, d, _ in held])
            starts = stops - [len(d) for _, _, d, _ in held]
            at, lo, hi = anchors(joined, starts, stops, length)
            row = np.searchsorted(stops, lo, side="right")
            shift = (np.array([o for *_, o in held]) - starts)[row]
            rows = row.tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([held[r][0] for r in rows], id_type), pa.array([held[r][1] for r in rows], pa.int32()),
                *(pa.array((x + shift).astype(np.int32), pa.int32()) for x in (at, lo, hi)),
                signed([digest(joined[a:a + Q]) for a in at.tolist()]),
                signed([digest(joined[a:b + length]) for a, b in zip(lo.tolist(), hi.tolist())])],
                names=["id", "check", "at", "lo", "hi", "gram", "hull"])

    return texts.mapInArrow(run, f"id {kind}, check int, at int, lo int, hi int, gram bigint, hull bigint")


def refine(members: DataFrame, keys: list[str]) -> DataFrame:
    """One step of refinement: ``members`` have ``keys`` (their bucket) and ``hull``. Buckets of one member are closed and
    their members dropped. Added are

    * ``twin``: another member has the same hull, so all of its windows repeat,
    * ``open``: it stands for its hull in a bucket with other hulls, which later offsets must refine.
    """
    hulls = members.groupBy(*keys, "hull").agg(F.count("*").alias("same"), F.min(F.struct("id", "check", "lo")).alias("first"))
    buckets = hulls.groupBy(*keys).agg(F.sum("same").alias("all"), F.count("*").alias("hulls")).where("all > 1")
    out = members.join(hulls.join(buckets, keys), [*keys, "hull"])
    first = F.struct("id", "check", "lo").eqNullSafe(F.col("first"))
    return out.withColumns({"twin": F.col("same") > 1, "open": first & (F.col("hulls") > 1)}).drop("same", "first", "all", "hulls").where("twin OR open")


def packed(texts: DataFrame) -> DataFrame:
    """``id, check, z``: texts compressed for the shuffle."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        press, rows, total = zstandard.ZstdCompressor(level=3), [], 0
        schema = pa.schema([("id", arrow_type(kind)), ("check", pa.int32()), ("z", pa.binary())])
        for ident, check, data in keyed(batches):
            rows.append((ident, check, press.compress(data)))
            total += len(data)
            if len(rows) >= 2_000 or total > 4 * CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, total = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts.mapInArrow(run, f"id {kind}, check int, z binary")


def by_text(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row per text with the array ``name``, bounded by the text's length."""
    return rows.groupBy(F.col("id").alias("_id"), F.col("check").alias("_check")).agg(F.collect_list(F.struct(*columns)).alias(name))


def with_text(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    return packed(texts).join(lists, F.col("id").eqNullSafe(F.col("_id")) & (F.col("check") == F.col("_check")), how).drop("_id", "_check")


def contexts(texts: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """``id, check, at, lo, hi, gram, bytes``: the bytes ``lo .. hi + length`` of suffixes that must be refined."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        schema = pa.schema([("id", arrow_type(kind)), ("check", pa.int32()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()),
                            ("gram", pa.int64()), ("bytes", pa.binary())])
        for batch in batches:
            for ident, check, z, found in zip(*(batch.column(c) for c in ("id", "check", "z", "found"))):
                data, ident, check = unpress.decompress(z.as_py()), ident.as_py(), check.as_py()
                rows = [(ident, check, f["at"], f["lo"], f["hi"], f["gram"], data[f["lo"]:f["hi"] + length]) for f in found.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = by_text(open_, "found", "at", "lo", "hi", "gram")
    return with_text(texts, found, "inner").mapInArrow(run, f"id {kind}, check int, at int, lo int, hi int, gram bigint, bytes binary")


def blocks(context: DataFrame, length: int) -> DataFrame:
    """Level 1: the windows of a suffix in blocks of ``STEP`` by their distance before it. ``core`` names the bytes that
    every window of the block has, ``hull`` all bytes of the windows that are there."""
    kind = context.schema["id"].dataType.simpleString()

    def run(batches):
        schema = pa.schema([("id", arrow_type(kind)), ("check", pa.int32()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("gram", pa.int64())])
        for batch in batches:
            rows, cores, hulls = [], [], []
            for ident, check, at, lo, hi, gram, data in zip(*(c.to_pylist() for c in batch.columns)):
                for k in range((at - hi) // STEP, (at - lo) // STEP + 1):
                    first, last = max(lo, at - k * STEP - STEP + 1), min(hi, at - k * STEP)
                    core = data[max(0, at - k * STEP - lo):at - k * STEP - STEP + 1 + length - lo]
                    rows.append((ident, check, at, first, last, gram))
                    cores.append(digest(core + bytes([k])))
                    hulls.append(digest(data[first - lo:last + length - lo] + bytes([at - last - k * STEP, at - first - k * STEP])))
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, schema)), signed(cores), signed(hulls)],
                                             names=[*schema.names, "core", "hull"])

    return context.mapInArrow(run, f"id {kind}, check int, at int, lo int, hi int, gram bigint, core bigint, hull bigint")


def single_windows(context: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """Level 2: ``id, check, lo, gram, window`` for every window of the blocks that must be refined."""
    kind = context.schema["id"].dataType.simpleString()
    found = open_.groupBy(F.col("id").alias("_id"), F.col("check").alias("_check"), F.col("at").alias("_at")).agg(
        F.collect_list(F.struct("lo", "hi")).alias("found"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("check") == F.col("_check")) & (F.col("at") == F.col("_at"))

    def run(batches):
        for batch in batches:
            ids, checks, at, grams, names = [], [], [], [], []
            for ident, check, start, stop, gram, data, found in zip(*(c.to_pylist() for c in batch.columns)):
                for f in found:
                    for p in range(max(f["lo"], start), min(f["hi"], stop) + 1):
                        ids.append(ident)
                        checks.append(check)
                        at.append(p)
                        grams.append(gram)
                        names.append(digest(data[p - start:p - start + length]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_type(kind)), pa.array(checks, pa.int32()), pa.array(at, pa.int32()),
                                              pa.array(grams, pa.int64()), signed(names)], names=["id", "check", "lo", "gram", "window"])

    joined = context.join(found, same).select("id", "check", "lo", "hi", "gram", "bytes", "found")
    return joined.mapInArrow(run, f"id {kind}, check int, lo int, gram bigint, window bigint")


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """``id, check, lo, stop``: byte spans made of windows of ``length`` bytes that also start elsewhere."""
    everything = scratch.write(sampled(texts, length))  # texts are scanned and hashed once
    often = everything.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    level0 = scratch.write(everything.join(often, "gram"))
    scratch.drop(everything)  # each table goes once the next has been written from it
    step0 = scratch.write(refine(level0, ["gram"]))
    scratch.drop(level0)
    context = scratch.write(contexts(texts, step0.where("open"), length))
    step1 = scratch.write(refine(blocks(context, length), ["gram", "core"]))
    level2 = scratch.write(single_windows(context, step1.where("open"), length).distinct())
    scratch.drop(context)
    again = level2.groupBy("gram", "window").agg(F.count("*").alias("n")).where("n > 1").select("gram", "window")
    step2 = level2.join(again, ["gram", "window"])
    stop = lambda df, last: df.select("id", "check", "lo", (F.col(last) + length).alias("stop"))
    return stop(step0.where("twin"), "hi").unionByName(stop(step1.where("twin"), "hi")).unionByName(stop(step2, "lo"))


def remove_repeated(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, spans, kept`` per row: whole texts as UTF-8 without the bytes that lie in a string of
    ``length`` bytes which also starts anywhere else, in any text of the input.

    Initial buckets hold sampled suffixes with equal q-grams; a string's sampled suffix depends on its bytes alone, so
    equal strings meet in one bucket. Buckets with one member are closed. The others are refined by hashes of the bytes around
    the q-gram, level by level: all windows of a suffix, blocks of 16, single windows. (Bucket identifiers of later offsets are not
    used: they would take a row for every byte.) At each level members with an equal
    hull are settled and one of them goes on for all, so copies cost one row however many there are.

    Null text: empty, as are texts of fewer than ``length`` bytes left whole. Rows that share an id are told apart by
    their text; repeated rows repeat each other and lose all their long strings. Null ids take part. Buckets are named by
    64-bit hashes within the bucket of a 64-bit hash. Texts cross the shuffle compressed, twice. ``length`` is above ``Q``.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    spans = by_text(repeated_spans(texts, length), "spans", "lo", "stop")

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        schema = pa.schema([("id", arrow_type(kind)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = []
                for ident, z, found in zip(*(batch.slice(begin, 500).column(c) for c in ("id", "z", "spans"))):
                    data, merged, kept, done = unpress.decompress(z.as_py()), [], [], 0
                    for lo, stop in sorted((f["lo"], f["stop"]) for f in found.as_py() or ()):
                        if merged and lo <= merged[-1]["stop"]:
                            merged[-1]["stop"] = max(stop, merged[-1]["stop"])
                        else:
                            merged.append({"start": lo, "stop": stop})
                    for m in merged:
                        kept.append(data[done:m["start"]])
                        done = m["stop"]
                    kept = b"".join([*kept, data[done:]])
                    rows.append((ident.as_py(), len(data), len(data) - len(kept), merged, kept))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return with_text(texts, spans, "left").mapInArrow(
        run, f"id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
