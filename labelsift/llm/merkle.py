"""Merkle manifest of a dataset: a tree for each source, one over the sources, levels kept as concatenated hex strings."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelsift.llm import scratch

ARITY = 16
BLOCK = ARITY * ARITY  # nodes of a block, which therefore holds two levels above its own
HEX = 64  # characters of a digest
RUN = ARITY * HEX
GROUP = ["has", "name"]  # a source: is there a name, and the name


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*columns: Column) -> Column:
    """Digest of a row's values: ``-`` for null, else the byte count of the value as text, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place in their group from 0 in the given order, and ``n``, the group's rows.

    A range shuffle sorts all groups together, so that a group with most of the rows is spread over most partitions. The
    sorted rows are written before places are read from them; only a row for each partition and group is summed up.
    """
    narrow = scratch.write(rows.withColumn("_tie", F.monotonically_increasing_id()))
    order = [*GROUP, *order, "_tie"]
    sorted_ = scratch.write(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    parts = sorted_.groupBy(part, *GROUP).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = W.partitionBy(*GROUP)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.write(parts.select("_part", *GROUP, (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("n")))
    found = sorted_.select("*", part).join(parts, ["_part", *GROUP])
    return found.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift", "_tie")


def blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """One row for every 256 consecutive nodes ``pos, node`` of a group: ``level0``, their digests as one string, ``level1``,
    the digests of its runs of 16, and ``top``, what stands for the block one level of blocks above."""
    rows = nodes.groupBy(*GROUP, "n", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "node", *carried))).alias("items"))
    rows = rows.withColumn("level0", F.array_join(F.col("items.node"), ""))
    runs = F.sequence(F.lit(0), F.expr(f"(length(level0) - 1) div {RUN}").cast("int"))
    parents = F.array_join(F.transform(runs, lambda i: digest(F.substring("level0", i * RUN + 1, F.lit(RUN)))), "")
    rows = rows.withColumn("level1", F.when(F.col("n") > 1, parents))
    top = F.when(F.col("n") > ARITY, digest(F.col("level1"))).otherwise(F.coalesce("level1", "level0"))
    items = F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in carried])) if carried else F.lit(None)
    return rows.withColumns({"top": top, "items": items})


def levels(nodes: DataFrame, *carried: str) -> list[DataFrame]:
    """Tables of blocks, from the nodes up to one block a group. A group leaves with the table that holds its root."""
    tables = []
    while True:
        table = scratch.write(blocks(nodes, *(carried if not tables else ())))
        tables.append(table)
        most = table.agg(F.max("n")).first()[0] or 0
        if most <= BLOCK:
            return tables
        nodes = table.where(F.col("n") > BLOCK).select(*GROUP, F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node"))


def tops(tables: list[DataFrame]) -> DataFrame:
    """``has, name, node``: the root of every group."""
    found = [t.where(F.col("n") <= BLOCK).select(*GROUP, F.col("top").alias("node")) for t in tables]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def segments(place: Column) -> Column:
    """Siblings of the block's node at ``place``, as flanks ``left, right`` of each level that the block holds."""
    i, run = place.cast("int"), (place / ARITY).cast("int")
    at = i % ARITY
    low = F.struct(F.substring("level0", run * RUN + 1, at * HEX).alias("left"),
                   F.substring("level0", (i + 1) * HEX + 1, (ARITY - 1 - at) * HEX).alias("right"))
    high = F.struct(F.substring("level1", F.lit(1), run * HEX).alias("left"),
                    F.substring("level1", (run + 1) * HEX + 1, F.lit(RUN)).alias("right"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    return F.when(F.col("n") > ARITY, F.array(low, high)).when(F.col("n") > 1, F.array(low)).otherwise(none)


def paths(tables: list[DataFrame], above: DataFrame) -> list[DataFrame]:
    """Each table with what stands above its blocks: ``path``, the flanks up to the last root, and the columns of ``above``,
    which has them for every group. A block is joined with its parent, which has 256 children at most."""
    carried = [c for c in above.columns if c not in (*GROUP, "path")]
    out: list[DataFrame] = []
    for table in reversed(tables):
        found = table.where(F.col("n") <= BLOCK).join(above, GROUP)
        if out:
            over = out[0].select(*GROUP, F.col("n").alias("_n"), F.col("block").alias("_block"), "level0", "level1", F.col("path").alias("_path"), *carried)
            child = table.where(F.col("n") > BLOCK).withColumnsRenamed({"level0": "_level0", "level1": "_level1"}).withColumn("_block", F.expr(f"block div {BLOCK}"))
            both = child.withColumnRenamed("n", "_own").join(over.withColumnRenamed("_n", "n"), [*GROUP, "_block"])
            both = both.withColumn("path", F.concat(segments(F.col("block") % BLOCK), "_path")).drop("level0", "level1", "n", "_path", "_block")
            found = found.unionByName(both.withColumnsRenamed({"_level0": "level0", "_level1": "level1", "_own": "n"}))
        out.insert(0, scratch.write(found))
    return out


def manifest(rows: DataFrame) -> DataFrame:
    """``id, leaf, claimed, subroot, root, proof`` for ``rows`` of ``id, source, leaf, claimed``: each row's siblings
    from its leaf up to the root.

    The leaves of a source are in order of id, every 16 consecutive nodes (fewer at the end) become the digest of their
    hex digests, and what remains is the subroot; subroots, in order of source, become the root alike. ``proof`` has for
    each level the siblings left and right of the row's node, as two strings. ``claimed`` (null: the leaf) goes through as it is.

    Null ids come first and null sources too; rows that share an id are in order of leaf, so repeated rows have a proof
    each. A single row: its leaf is the root and its proof is empty. Empty table: empty result. Texts never move: only
    digests are sorted, 256 to a block, and proofs are made where the blocks are read.
    """
    has = F.col("source").isNotNull()
    named = rows.select(has.alias("has"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"), "id", F.col("leaf").alias("node"),
                        F.when(F.col("claimed") != F.col("leaf"), F.col("claimed")).alias("claimed"))
    own = levels(placed(named, "id", "node", "claimed"), "id", "claimed")
    subroots = tops(own).select(F.lit(True).alias("has"), F.lit("").alias("name"), F.col("has").alias("has_source"), F.col("name").alias("source"), "node")
    over = levels(placed(subroots, "has_source", "source"), "has_source", "source")
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = paths(over, tops(over).select(*GROUP, F.col("node").alias("root"), none.alias("path")))[0]
    over = over.select("*", F.posexplode("items").alias("_i", "_item"))
    mine = F.substring("level0", F.col("_i") * HEX + 1, F.lit(HEX))
    above = over.select(F.col("_item.has_source").alias("has"), F.col("_item.source").alias("name"), mine.alias("subroot"), "root",
                        F.concat(segments(F.col("_i")), "path").alias("path"))
    found = paths(own, scratch.write(above))[0].select("*", F.posexplode("items").alias("_i", "_item"))
    return found.select(F.col("_item.id").alias("id"), mine.alias("leaf"), F.coalesce("_item.claimed", mine).alias("claimed"), "subroot", "root",
                        F.concat(segments(F.col("_i")), "path").alias("proof"))


def folded(claimed: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, claimed, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.flatten(F.transform(proof, lambda s: F.array(s["left"], s["right"]))), ""))


def documents_manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                       columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), every: int = 5) -> DataFrame:
    """``manifest`` of documents, where the rows of which ``every`` divides the CRC-32 of the decimal id claim a text with
    A-Z in lower case. A null id claims its own row; a null text stays null. Other columns of ``docs`` play no part.
    """
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    values = [F.col(c) for c in columns]
    changed = [lower_ascii(v) if c == text_col else v for c, v in zip(columns, values)]
    # Only what changes is hashed a second time.
    claimed = F.when(tampered & F.col(text_col).rlike("[A-Z]"), leaf(*changed))
    return manifest(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf(*values).alias("leaf"), claimed.alias("claimed")))
