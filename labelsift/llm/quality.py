"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.llm.scratch import unused
from labelsift.session import ship_package

BUCKETS = 1 << 18
CACHED = 200_000
WORD_SCALE = 0.25
LONGEST_WORD = 64  # longer words are hashed by the shape of their beginning and by all their pieces
PIECE, STRETCH = 4, 1 << 16  # characters of a piece; of what is cut at a time
RUNS = re.compile(r"(.)\1+", re.DOTALL)
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
LOWER, UPPER, DIGIT = re.compile(r"[^\W\d_A-Z]"), re.compile(r"[A-Z]"), re.compile(r"\d")
STEM = 4
SHARES = 16  # buckets at the end hold whole-text figures


def features_of(word: str) -> int:
    """Three hash buckets in one number: the bare lower-case word, its first letters, and its shape (letters a or A,
    digits 0, runs once)."""
    bucket = lambda kind, t: xxhash.xxh32_intdigest((kind + t).encode("utf-8", "surrogatepass")) % (BUCKETS - SHARES)
    if word.isalpha() and word.islower():
        shape = "a"
    else:
        shape = RUNS.sub(r"\1", DIGIT.sub("0", UPPER.sub("A", LOWER.sub("a", word[:LONGEST_WORD]))))
    bare = word.strip(PUNCTUATION).lower() if len(word) <= LONGEST_WORD else ""
    return bucket("w", bare) << 40 | bucket("p", bare[:STEM]) << 20 | bucket("s", shape)


def pieces_of(long_words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of all overlapping pieces of words (with their counts) that are too long to be hashed whole, such
    as text without white space."""
    counts: Counter = Counter()
    for word, times in long_words.items():
        for lo in range(0, len(word) - PIECE + 1, STRETCH):
            part = word[lo:lo + STRETCH + PIECE - 1].lower()
            for piece, n in Counter(part[i:i + PIECE] for i in range(len(part) - PIECE + 1)).items():
                counts[xxhash.xxh32_intdigest(("c" + piece).encode("utf-8", "surrogatepass")) % (BUCKETS - SHARES)] += n * times
    return np.fromiter(counts, dtype=np.int64, count=len(counts)), np.fromiter(counts.values(), dtype=np.float64, count=len(counts))


class Words(dict):
    """Buckets by word; bounded."""

    def __missing__(self, word):
        found = features_of(word)
        if len(self) < CACHED and len(word) <= LONGEST_WORD:
            self[word] = found
        return found


def vector(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text. Words, stems and the pieces of long words count by
    1 + ln(count), shapes by their share of all words, and the
    share of repeated words falls into one of ten buckets. No words: empty."""
    seen = Counter((text or "").split())
    if not seen:
        return np.empty(0, np.int64), np.empty(0)
    both = np.fromiter(map(words.__getitem__, seen), dtype=np.int64, count=len(seen))
    count = np.fromiter(seen.values(), dtype=np.float64, count=len(seen))
    total = count.sum()
    mask = (1 << 20) - 1
    piece, times = pieces_of({w: n for w, n in seen.items() if len(w) > LONGEST_WORD})
    bare, where = np.unique(np.concatenate([both >> 40, both >> 20 & mask, piece]), return_inverse=True)
    shape, there = np.unique(both & mask, return_inverse=True)
    repeated = BUCKETS - SHARES + int(10 * (1 - len(seen) / (total + 1)))
    at = np.concatenate([bare, shape, [repeated]])
    value = np.concatenate([(1 + np.log(np.bincount(where, weights=np.concatenate([count, count, times])))) * WORD_SCALE,
                            np.bincount(there, weights=count) / total, [1.0]])
    return at, value


@dataclass
class Ordinal:
    """``P(grade <= j) = sigmoid(thresholds[j] - weights . x)``."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(self.weights[at] @ value)

    def above(self, score: float) -> np.ndarray:
        """P(grade > j) for every threshold j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, rounds: int = 300, l2: float = 1e-4,
        step: float = 0.3, least_rows: int = 5) -> Ordinal | None:
    """Maximum likelihood by Adam over all rows of the sample; None if only one grade occurs.

    Thresholds are a first one plus positive gaps, so their order holds by construction.
    """
    if len(set(grades.tolist())) < 2:
        return None
    lengths = np.array([len(a) for a, _ in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float32)
    often = np.bincount(at, minlength=BUCKETS) >= least_rows  # what few rows have can only be learned by heart
    used, place = np.flatnonzero(often), np.cumsum(often) - 1
    kept = often[at]
    row, value, at = row[kept], value[kept], place[at[kept]].astype(np.int32)
    share = np.bincount(grades, minlength=n_grades)[:-1].cumsum() / len(grades)
    first = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    w, t0, gaps = np.zeros(len(used)), first[:1].copy(), np.log(np.maximum(np.diff(first), 1e-2))
    params = [w, t0, gaps]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bounds = lambda: np.concatenate([[-np.inf], t0[0] + np.concatenate([[0], np.exp(gaps).cumsum()]), [np.inf]])
    for k in range(1, rounds + 1):
        theta = bounds()
        score = np.bincount(row, weights=w[at] * value, minlength=len(rows))
        hi = 1 / (1 + np.exp(-np.clip(theta[grades + 1] - score, -500, 500)))
        lo = 1 / (1 + np.exp(-np.clip(theta[grades] - score, -500, 500)))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p / len(rows), lo * (1 - lo) / p / len(rows)
        d_score = d_hi - d_lo  # of the negative log-likelihood
        d_theta = np.bincount(grades, weights=-d_hi, minlength=n_grades)[: n_grades - 1]
        d_theta += np.bincount(grades, weights=d_lo, minlength=n_grades)[1:n_grades]
        tail = d_theta[::-1].cumsum()[::-1]
        grads = [np.bincount(at, weights=d_score[row] * value, minlength=len(used)) + l2 * w, tail[:1], tail[1:] * np.exp(gaps)]
        for x, g, a, b in zip(params, grads, m1, m2):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            x -= step / np.sqrt(k) * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-9)
    full = np.zeros(BUCKETS)
    full[used] = w
    return Ordinal(full, bounds()[1:-1])


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` from ``labels``: 0 low quality, 1 toxic, 2 fine. A null in either column: no rating."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", grade.alias("grade"))


def train(docs: DataFrame, rated: DataFrame, n_grades: int = 3, sample: int = 9_000, seed: int = 42, id_col: str = "doc_id",
          text_col: str = "text") -> Ordinal | None:
    """Fit on at most ``sample`` ratings, those with the smallest seeded hash of (id, grade), and as many documents; the
    bound keeps the driver's memory fixed. Features are computed on the executors, from whole texts. Of several ratings
    of a document each counts. No rated documents, or a single grade: None."""
    ship_package(docs.sparkSession)
    # at most ``sample`` ids are broadcast, so texts do not move
    chosen = rated.select("doc_id", "grade", F.xxhash64(F.lit(seed), "doc_id", "grade").alias("order")).orderBy("order", "doc_id", "grade").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "grade", "order")

    def run(batches):
        words = Words()
        for batch in batches:
            found = [vector(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), batch.column(2), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()),
                pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["grade", "order", "at", "value"])

    got = rows.mapInArrow(run, "grade int, order bigint, at binary, value binary").orderBy("order").limit(sample).drop("order").toArrow()
    if not got.num_rows:
        return None
    vectors = [(np.frombuffer(a.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4")) for a, v in zip(got["at"], got["value"])]
    return fit(vectors, got["grade"].to_numpy().astype(np.int64), n_grades)


def rate(docs: DataFrame, model: Ordinal | None, select_grade: int = 2, keep_from: float = 0.75, id_col: str = "doc_id",
         text_col: str = "text", n_grades: int = 3) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of ``select_grade`` or better) and ``kept``.

    Whole texts count. Null and empty texts score by the thresholds alone. Without a model (nothing rated, or one
    grade only) both figures are null and everything is kept. Columns of those names are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("expected_grade", "tail_probability", "kept")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_probability": F.lit(None).cast("double"), "kept": F.lit(True)})
    shared = spark.sparkContext.broadcast(model)  # BUCKETS doubles, whatever the corpus

    @F.pandas_udf("expected double, tail double")
    def scored(texts):
        import pandas as pd

        model = shared.value
        if not hasattr(model, "words"):
            model.words = Words()
        out = np.array([model.above(model.score(*vector(t, model.words))) for t in texts]).reshape(-1, len(model.thresholds))
        return pd.DataFrame({"expected": out.sum(axis=1), "tail": out[:, select_grade - 1]})

    rating = unused(docs, "_rating")
    out = docs.withColumn(rating, scored(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumns({"expected_grade": F.col(rating)["expected"], "tail_probability": F.col(rating)["tail"],
                            "kept": F.col(rating)["tail"] >= keep_from}).drop(rating)
