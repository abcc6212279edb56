"""Exact cuts of many (given class, other class) value columns at once, without exploding the rows.

With K classes every row holds K margins, so a frame of one row per margin has N x K rows. Here the probability
arrays are read as matrices, batch by batch. A first pass counts the values of all wanted columns in histograms, which are
mergeable partial aggregates: tasks send what cells they filled, cells are added up, and the one in which a
cut lies is its bracket. The last pass reads the few values inside the brackets themselves. Where brackets still hold
too many values for that, as with very many rows, they are cut into cells again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelsift.operators import frames
from labelsift.session import ship_package

# Cells that a task keeps over all columns, and values that the last pass may bring to the driver.
CELLS = 1 << 18
SLIVER = 200_000
LEAST_BINS, MOST_BINS = 16, 4_096


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, lengths and values of a list column; null entries are NaN, null lists empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return np.cumsum(lengths) - lengths, lengths, values.to_numpy(zero_copy_only=False).astype(np.float64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    starts, lengths, values = _lists(column)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.full((len(lengths), width), np.nan)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(values)) - np.repeat(starts, lengths)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def _columns(batch: pa.RecordBatch, k: int, by_class: dict[int, np.ndarray], multi_label: bool):
    """``columns, values`` of each class in a batch: for the classes wanted against it the margins ``p_j - p_k``, for the class itself ``-p_k``."""
    p = _matrix(batch.column(0), k)
    if multi_label:
        _, lengths, given = _lists(batch.column(1))
        row = np.repeat(np.arange(len(p)), lengths)
        pairs = np.unique(np.stack([row, np.nan_to_num(given, nan=-1).astype(np.int64)], axis=1), axis=0)
        row, given = pairs[:, 0], pairs[:, 1]
    else:
        given = batch.column(1).to_numpy(zero_copy_only=False)
        row, given = np.arange(len(p)), np.nan_to_num(given.astype(np.float64), nan=-1).astype(np.int64)
    order = np.argsort(given, kind="stable")
    edges = np.searchsorted(given[order], [*by_class, *(c + 1 for c in by_class)])
    for i, (c, others) in enumerate(by_class.items()):
        mine = row[order[edges[i]:edges[i + len(by_class)]]]
        if len(mine):
            own = p[mine, c][:, None]
            yield c, np.where(others[None] == c, -own, p[mine][:, others] - own)


def _wanted_by_class(pending: list[dict]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    by: dict[int, list] = {}
    for i, w in enumerate(pending):
        by.setdefault(w["s"], []).append(i)
    by = dict(sorted(by.items()))
    return {c: np.array([pending[i]["y"] for i in at]) for c, at in by.items()}, {c: np.array(at) for c, at in by.items()}


def _histograms(probs: DataFrame, pending: list[dict], k: int, multi_label: bool, bounded: bool) -> list[dict]:
    """Of each pending column the cell in which its cut lies: ``lo, hi, n`` and ``m``, the place of the cut inside."""
    others, places = _wanted_by_class(pending)
    lo, hi = (np.array([w[c] for w in pending]) for c in ("lo", "hi"))
    bins = int(max(LEAST_BINS, min(MOST_BINS, CELLS // len(pending))))

    def run(batches):
        count: dict[int, np.ndarray] = {}
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, v in _columns(batch, k, others, multi_label):
                at = places[c]
                inside = ~np.isnan(v) if not bounded else (v >= lo[at]) & (v <= hi[at])
                slot = np.clip(np.floor((v - lo[at]) / (hi[at] - lo[at]) * bins), 0, bins - 1)
                cell = (np.where(inside, slot, 0).astype(np.int64) + np.arange(len(at)) * bins)[inside]
                if c not in count:
                    size = len(at) * bins
                    count[c], low[c], high[c] = np.zeros(size, dtype=np.int64), np.full(size, np.inf), np.full(size, -np.inf)
                count[c] += np.bincount(cell, minlength=len(count[c]))
                np.minimum.at(low[c], cell, v[inside])
                np.maximum.at(high[c], cell, v[inside])
        for c, n in count.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places[c][cell // bins]), pa.array((cell % bins).astype(np.int32)), pa.array(low[c][cell]), pa.array(high[c][cell]), pa.array(n[cell])],
                names=["at", "slot", "lo", "hi", "n"])

    cells = probs.select("psx", "s").mapInArrow(run, "at bigint, slot int, lo double, hi double, n bigint")
    cells = cells.groupBy("at", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    seen = cells.withColumn("seen", F.sum("n").over(W.partitionBy("at").orderBy(F.desc("slot"))))
    m = F.element_at(frames.constant_array(probs.sparkSession, [float(w["m"]) for w in pending]), (F.col("at") + 1).cast("int"))
    found = seen.withColumn("m", m).where("seen >= m AND seen - n < m").collect()  # one row per column
    return [{"s": pending[r["at"]]["s"], "y": pending[r["at"]]["y"], "lo": r["lo"], "hi": r["hi"], "n": r["n"], "m": pending[r["at"]]["m"] - (r["seen"] - r["n"])}
            for r in found]


def _inside(probs: DataFrame, pending: list[dict], k: int, multi_label: bool) -> list[dict]:
    """The cuts themselves, from the values that lie inside the brackets."""
    others, places = _wanted_by_class(pending)
    lo, hi = (np.array([w[c] for w in pending]) for c in ("lo", "hi"))

    def run(batches):
        for batch in batches:
            for c, v in _columns(batch, k, others, multi_label):
                row, column = np.nonzero((v >= lo[places[c]]) & (v <= hi[places[c]]))
                pairs, n = np.unique(np.stack([places[c][column].astype(np.float64), v[row, column]], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int64)), pa.array(pairs[:, 1]), pa.array(n)], names=["at", "v", "n"])

    got = probs.select("psx", "s").mapInArrow(run, "at bigint, v double, n bigint").toArrow()  # SLIVER rows at most
    at, v, n = (got[c].to_numpy() for c in ("at", "v", "n"))
    order = np.lexsort((-v, at))
    at, v, n = at[order], v[order], n[order]
    out = []
    for i, w in enumerate(pending):
        a, b = np.searchsorted(at, [i, i + 1])
        out.append({"s": w["s"], "y": w["y"], "cut": float(v[a + np.searchsorted(n[a:b].cumsum(), w["m"])])})
    return out


def largest(probs: DataFrame, wanted: list[dict], k: int, multi_label: bool = False) -> list[dict]:
    """Exact ``{s, y, cut}`` for every ``{s, y, m}`` of ``wanted``: the m-th largest, ties counted, of ``p_y - p_s`` among the rows
    of label s, or of ``-p_s`` where y is s.

    ``probs`` has ``s`` and ``psx`` and is read twice, as long as ``SLIVER`` values or fewer share the cut's cells, and
    once more for each time they do not. A value that many rows repeat gets a cell of its own and needs no further pass. Null or NaN
    probabilities are left out. ``m`` is no larger than the number of values.
    """
    if not wanted:
        return []
    ship_package(probs.sparkSession)
    pending = [dict(w, lo=-1.0, hi=0.0 if w["s"] == w["y"] else 1.0) for w in wanted]
    done, bounded = [], False
    while pending:
        if bounded and sum(w["n"] for w in pending) <= SLIVER:
            return done + _inside(probs, pending, k, multi_label)
        rest = []
        for w in _histograms(probs, pending, k, multi_label, bounded):
            if w["lo"] == w["hi"] or w["m"] == w["n"] or w["m"] == 1:
                done.append({"s": w["s"], "y": w["y"], "cut": w["hi"] if w["m"] == 1 else w["lo"]})
            else:
                rest.append(w)
        pending, bounded = rest, True
    return done
