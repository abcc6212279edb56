"""Mixing sources to target weights: capped water-filling and seeded repetitions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelsift.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
CUT_DIGITS = 4  # hexadecimal digits of the order key by which a source is first cut


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *keep: F.Column) -> DataFrame:
    """``id, source, size, key`` (and ``keep``): words per document and a seeded order key."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("key"), *keep)


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``source, source_size, target``: shares of all words by weight, clamped at ``max_epochs`` source sizes.

    Sources in code-point order (null last) take ``weights`` in turn. In order of cap per weight, a source is clamped
    while its share of what the clamped ones leave is above its cap; the rest divide what is left by weight, which is
    where resharing ends. One row per source is sorted here, never rows of documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), (rank - 1) % len(weights) + 1)
    s = by_source.withColumn("rank", rank).withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    s = s.withColumn("c", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn(
        "rest_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("open", (F.col("total") - F.col("c")) * F.col("w") <= F.col("cap") * F.col("rest_w"))
    left = F.col("total") - F.sum(F.when(~F.col("open"), F.col("cap")).otherwise(0)).over(whole)
    open_w = F.sum(F.when(F.col("open"), F.col("w")).otherwise(0)).over(whole)
    target = F.when(F.col("open"), (left * F.col("w")).cast("double") / open_w).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def same(a: str, b: str) -> F.Column:
    return F.col(a).eqNullSafe(F.col(b))


def plan(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Per source: target, whole repetitions, words of the fractional one, and the key digits in which it is cut."""
    aim = targets(rows, weights, max_epochs)
    want = F.floor(F.col("target") + 0.5)
    aim = aim.withColumn("times", F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0))
    aim = aim.withColumn("rest", want - F.col("times") * F.col("source_size"))
    digits = rows.groupBy(F.col("source").alias("_s"), F.substring("key", 1, CUT_DIGITS).alias("cell")).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("_s").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cut = digits.withColumn("after", F.sum("n").over(upto)).join(aim, same("_s", "source")).where("after > rest")
    cut = cut.groupBy("_s").agg(F.min(F.struct("cell", (F.col("after") - F.col("n")).alias("before"))).alias("cut"))
    return scratch.write(aim.join(cut, same("_s", "source"), "left").select(
        F.col("source").alias("_s"), "source_size", "target", "times", "rest", "cut.cell", "cut.before"))


def take(rows: DataFrame, aim: DataFrame) -> DataFrame:
    """``rows`` with ``source_size, target, taken``."""
    own = [F.col(c) for c in rows.columns]
    rows = rows.join(aim, same("source", "_s")).withColumn("_c", F.substring("key", 1, CUT_DIGITS))
    # a source without words has no cut; its documents have size 0
    whole = rows.where("cell IS NULL OR _c != cell").withColumn(
        "part", F.when(F.col("_c") < F.col("cell"), F.col("size")).otherwise(F.lit(0).cast("bigint")))
    order = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.where("_c = cell").withColumn("_at", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    within = within.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_at"))).cast("bigint")).drop("_at")
    taken = (F.col("times") * F.col("size") + F.col("part")).cast("bigint")
    return whole.unionByName(within).select(*own, "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42,
        weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``id, size, source_size, target, taken`` per document: the words of it that the mix takes.

    Every document is taken ``floor(target / source_size)`` times; the fractional repetition takes documents in the
    order of a seeded hash until the source's target is met to the word, so the last of them may be taken in part.
    Sums per leading key digits say where the order is cut; only documents with those digits, 1 / 65,536 of a source,
    are put in order. Null text: size 0, nothing taken. A null source is a source. Repeated rows count as rows; ties
    of the key go by id and size, beyond which rows are interchangeable. Empty table: empty result.
    """
    rows = scratch.write(sized(docs, id_col, text_col, source_col, seed))
    return take(rows, plan(rows, weights, max_epochs)).select("id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42,
                    weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as ``mix`` takes them; one taken in part keeps its first words.

    ``n_chars`` follows the text where there is such a column. Texts do not move: a row's share follows from its key
    and its source's plan, except in the key digits where the source is cut.
    """
    aim = plan(scratch.write(sized(docs, id_col, text_col, source_col, seed)), weights, max_epochs)
    rows = take(sized(docs, id_col, text_col, source_col, seed, F.struct(*docs.columns).alias("doc")), aim).where("taken > 0")
    part = F.col("taken") % F.col("size")
    shares = F.concat(F.array_repeat(F.lit(-1).cast("bigint"), F.floor(F.col("taken") / F.col("size")).cast("int")),
                      F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("doc", F.explode(shares).alias("words"))
    text = F.col("doc")[text_col]
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(F.col("words") < 0, text).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), ""))
    rows = rows.withColumn("text", text)
    fresh = {text_col: F.col("text"), "n_chars": F.length("text")}
    return rows.select(*[(fresh[f.name].cast(f.dataType) if f.name in fresh else F.col("doc")[f.name]).alias(f.name) for f in docs.schema])
