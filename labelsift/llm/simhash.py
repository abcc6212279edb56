"""SimHash near-duplicates through multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.llm import scratch
from labelsift.llm.components import components
from labelsift.llm.scratch import unused
from labelsift.session import ship_package

BITS = 64
SEED = 42
BATCH_SHINGLES = 1 << 16
HALF = BITS // 2  # bits of a segment
RADIUS = 1  # of the ball around a segment: of 2 differing bits, one of the two segments has 1 at most
OFTEN = 64  # fingerprints with the same segment that one table entry lists


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit SimHash of a whole text: a bit is 1 if it is set in over half the shingles' hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(parts)) - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, BATCH_SHINGLES):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo:lo + BATCH_SHINGLES], stops[lo:lo + BATCH_SHINGLES])],
                     dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id, fingerprint`` (a signed BIGINT with the 64 bits), one row per row of ``docs``.

    A-Z are lower-cased; words are runs without ASCII white space; shingles are ``words`` words joined by one
    space, repeats included. Fewer words: the whole sequence is the one shingle. None, or a null text: zero.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint bigint")


def segments(fp: Column) -> list[Column]:
    """The two halves of a fingerprint, low one first, as numbers of 32 bits."""
    low = (1 << HALF) - 1
    return [fp.bitwiseAND(F.lit(low)), F.shiftrightunsigned(fp, HALF)]


def ball(value: Column, upwards: bool) -> list[Column]:
    """The points one bit away from a segment; ``upwards`` only those with a bit more, null in place of the others. Of two
    segments one bit apart exactly one looks upwards to the other."""
    points = [value.bitwiseXOR(F.lit(1 << b)) for b in range(HALF)]
    return [F.when(value.bitwiseAND(F.lit(1 << b)) == 0, p) for b, p in enumerate(points)] if upwards else points


def near_links(fps: DataFrame, fp: str = "fingerprint") -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints with 2 or fewer differing bits.

    There is a table for each of the two 32-bit segments; an entry lists the fingerprints with that segment. Two
    fingerprints at distance 2 have a segment that differs in ``RADIUS`` bits at most, so each looks up the ball of that radius
    around both of its segments (17 points on average, as of two neighbours the one with the lower bit looks) and the complete
    distance to what it fetches is verified.

    An entry of more than ``OFTEN`` fingerprints, as in a large group of near copies, is split by the other segment: the
    fingerprints in it are keyed by the points of the ball around their other segment, those that look in from a neighbouring point by
    that segment itself. Whatever meets under such a key differs in 2 bits at most, so each is linked to the smallest there.
    Rows are linear in the fingerprints, products within an entry are bounded, and the components are those of all pairs.
    Spark takes a side that was inlined or exploded for as many rows as before, a 34th of the looks; so no such side is left to
    the size-checked choice of a broadcast, which would bring it to the driver.
    """
    distinct = fps.select(F.col(fp).alias("fp")).distinct()
    halves = segments(F.col("fp"))
    entries = [F.struct(F.lit(k).alias("segment"), halves[k].alias("value")) for k in (0, 1)]
    table = distinct.select("fp", F.inline(F.array(*entries)))
    sizes = table.groupBy("segment", "value").agg(F.count("*").alias("n"))
    listed = table.join(sizes.hint("merge"), ["segment", "value"])
    few = listed.where(F.col("n") <= OFTEN).groupBy("segment", "value").agg(F.collect_list("fp").alias("members"))
    many = sizes.where(F.col("n") > OFTEN).select("segment", "value", F.lit(None).cast("array<bigint>").alias("members"))
    looks = [F.struct(F.lit(k).alias("segment"), v.alias("value"), F.lit(d).alias("moved"))
             for k in (0, 1) for d, points in ((0, [halves[k]]), (RADIUS, ball(halves[k], upwards=True))) for v in points]
    looks = distinct.select("fp", F.inline(F.filter(F.array(*looks), lambda x: x["value"].isNotNull())))
    met = looks.join(few.unionByName(many).hint("merge"), ["segment", "value"])
    met = scratch.write(met.where("members IS NULL OR moved > 0 OR size(members) > 1"))
    near = F.filter("members", lambda m: (m != F.col("fp")) & (F.bit_count(m.bitwiseXOR(F.col("fp"))) <= 2))
    links = met.where("members IS NOT NULL").select(F.col("fp").alias("a"), F.explode(near).alias("b"))
    other = F.when(F.col("segment") == 0, halves[1]).otherwise(halves[0])
    points = F.when(F.col("moved") == 0, F.array(other, *ball(other, upwards=False))).otherwise(F.array(other))
    inside = met.where("members IS NULL").select("segment", "value", "moved", "fp", F.explode(points).alias("point"))
    keys = ["segment", "value", "point"]
    least = inside.where("moved = 0").groupBy(*keys).agg(F.min("fp").alias("b"))
    shared = inside.join(least.hint("merge"), keys).where("fp != b").select(F.col("fp").alias("a"), "b")
    return links.unionByName(shared).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id, fingerprint, component_id``: documents whose fingerprints differ in 2 or fewer bits are linked; a
    component is named by its smallest id.

    Repeated rows keep one row each. A null id takes part by its fingerprint; a component of null ids only has a
    null name. Empty table: empty result. Tables with a row for each document or fingerprint are not broadcast: they take
    several times the size of their packed files, by which Spark sizes them, in the driver's memory.
    """
    prints = scratch.write(fingerprints(docs, id_col, text_col, words))
    distinct = prints.groupBy("fingerprint").agg(F.min("id").alias("least"))
    roots = components(near_links(distinct)).withColumnRenamed("node", "fingerprint")
    rooted = scratch.write(distinct.join(roots.hint("merge"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names.hint("merge"), "root").select("fingerprint", "component_id")
    return prints.join(named.hint("merge"), "fingerprint").select("id", "fingerprint", "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` rid of every row whose group (of ``near_duplicates``) has a smaller id than its own, or an id where it has
    none. Rows that share their group's smallest id all stay, as do groups without any id. Columns of any name pass through."""
    own = unused(docs, "_id")
    found = near_duplicates(docs, id_col, text_col, words)
    gone = found.where("id != component_id OR (id IS NULL AND component_id IS NOT NULL)").select(F.col("id").alias(own)).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(own)), "left_anti")
