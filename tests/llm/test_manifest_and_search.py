"""Merkle manifest, multiprobe search and hard negatives against brute force, on plain, skewed and odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsift.llm import hard_negatives, merkle, multiprobe, queries

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        at = i - i % 16
        out.append(("".join(level[at:i]), "".join(level[i + 1:at + 16])))
        i //= 16
    return out


@pytest.mark.parametrize("sizes", [[1], [2], [16, 1], [17, 256, 257], [4097, 3] + [1] * 300])
def test_trees_of_many_sizes(spark, sizes):
    names = [None if g == 0 else f"s{g:04d}" for g in range(len(sizes))]
    rows = [(i * 7 - 50, names[g], sha(f"{g} {i}"), sha(f"{g} {i} other") if i % 11 == 0 else None) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, source string, leaf string, claimed string").repartition(5)
    out = merkle.manifest(df).withColumn("fold", merkle.folded(F.col("claimed"), F.col("proof")))
    out = out.withColumn("digest", merkle.proof_digest(F.col("proof"))).toPandas()
    trees = [fold_levels([sha(f"{g} {i}") for i in range(n)]) for g, n in enumerate(sizes)]
    over = fold_levels([t[-1][0] for t in trees])
    want = {}
    for g, n in enumerate(sizes):
        for i in range(n):
            proof = siblings(trees[g], i) + siblings(over, g)
            node = sha(f"{g} {i} other") if i % 11 == 0 else sha(f"{g} {i}")
            for left, right in proof:
                node = sha(left + node + right)
            want[sha(f"{g} {i}")] = (i * 7 - 50, trees[g][-1][0], over[-1][0], sha("".join(a + b for a, b in proof)), node)
    got = {r.leaf: (r.id, r.subroot, r.root, r.digest, r.fold) for r in out.itertuples()}
    assert len(out) == sum(sizes) and got == want


def test_manifest_of_odd_documents(spark):
    rows = [(None, None, None, None, None), (3, "A:1-", "en", "a", 4), (3, "A:1-", "en", "a", 4), (3, "b", "en", "a", 1), (5, "", "en", "", 0),
            (7, "Ä É ABC " * 50_000, "xx", "é", 9), (8, None, None, "é", 1), (10, "UP", "en", None, 2), (11, "low", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({"has": F.lit(1), "name": F.lit("x"), "node": F.lit(2), "pos": F.lit(3), "n": F.lit(4), "leaf": F.lit("?"), "claimed": F.lit("?")})
    out = merkle.documents_manifest(docs).withColumn("fold", merkle.folded(F.col("claimed"), F.col("proof"))).toPandas()
    piece = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = {sha("".join(piece(r[i]) for i in (0, 3, 2, 4, 1))): r for r in rows}
    assert sorted(out["leaf"]) == sorted(sha("".join(piece(r[i]) for i in (0, 3, 2, 4, 1))) for r in rows)
    for r in out.itertuples():
        ident, text, *_ = leaves[r.leaf]
        low = text and "".join(c.lower() if c.isascii() else c for c in text)
        changed = ident is not None and zlib.crc32(str(ident).encode()) % 5 == 0 and low != text
        assert (r.fold == r.root) != changed


def brute(x, ids, q, k):
    d = np.sqrt(((x[:, None] - x[q][None]) ** 2).sum(axis=2)).T
    out = {}
    for row, i in zip(d, q):
        order = [j for j in np.lexsort((ids, row)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(row[j])) for j in order]
    return out


def held_against(found, want, k):
    """Share of the true neighbours found; ranks, order and scores must be exact."""
    hits = total = 0
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(want)
    for q, near in want.items():
        got = sorted(by[q])
        assert [g[0] for g in got] == list(range(1, len(near) + 1)) and [g[1:] for g in got] == sorted((g[1:] for g in got), key=lambda g: (g[1], g[0]))
        assert len({g[1] for g in got}) == len(got)
        for _, v, s in got:
            assert s >= near[0][1] - 1e-12
        hits += len({v for v, _ in near} & {g[1] for g in got})
        total += len(near)
        exact = dict(near)
        assert all(abs(exact[v] - s) < 1e-12 * max(1, s) for _, v, s in got if v in exact)
    return hits / max(1, total)


def test_search_of_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    found = queries.op12_multiprobe(spark, "/root/testdata/sf0.1").collect()
    assert held_against(found, brute(x, ids, np.flatnonzero(ids % 100 == 0), 10), 10) >= 0.9


def test_search_by_buckets_in_groups_copies_and_noise(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 16)) * 3
    x = np.concatenate([centres[rng.integers(0, 400, 9_000)] + 0.05 * rng.normal(size=(9_000, 16)),  # groups
                        np.repeat(centres[:1], 4_000, axis=0),  # one vector, very often
                        centres[1] + 0.01 * rng.normal(size=(6_000, 16)),  # one large noisy group
                        rng.normal(size=(1_000, 16)) * 3]).astype(np.float32)
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>").repartition(7)
    found = multiprobe.search(df, F.col("vec_id") % 100 == 0).collect()
    assert held_against(found, brute(x.astype(np.float64), ids, np.flatnonzero(ids % 100 == 0), 10), 10) >= 0.9
    assert sum(r["probed"] for r in found) > 0.8 * len(found)  # by buckets, not by reading everything


def test_estimated_success_is_what_happens():
    rng = np.random.default_rng(5)
    tables = multiprobe.Tables(3, 5, 2.0, 1)
    x = rng.normal(size=(60, 12))
    chance = multiprobe.success(tables.places(x), np.full(60, 1.2), tables.width)
    hit = np.zeros_like(chance)
    for _ in range(400):
        step = rng.normal(size=x.shape)
        moved = np.floor(tables.places(x + 1.2 * step / np.linalg.norm(step, axis=1, keepdims=True))) - np.floor(tables.places(x))
        for t in range(3):
            at = ((moved[:, t] + 1) @ (3 ** np.arange(4, -1, -1))).astype(int)
            inside = (np.abs(moved[:, t]) <= 1).all(axis=1)
            hit[np.flatnonzero(inside), t, at[inside]] += 1 / 400
    assert abs(chance.sum(axis=2).mean() - hit.sum(axis=2).mean()) < 0.03
    best = chance.argmax(axis=2)
    assert abs(np.take_along_axis(chance, best[..., None], 2).mean() - np.take_along_axis(hit, best[..., None], 2).mean()) < 0.04
    names, reached = multiprobe.probes(x, np.full(60, 1.2), tables, 0.8, 243)
    few, less = multiprobe.probes(x, np.full(60, 1.2), tables, 0.8, 2)
    assert all(set(a) >= set(b) for a, b in zip(names, few)) and (reached >= less - 1e-12).all() and (reached >= 0.8).mean() > 0.9


ODD = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (200, None, 1), (300, [0.0, -0.0], 1), (400, [1.0, float("nan")], 1), (500, [float("inf"), 1.0], 1),
       (600, [1.0, None], 1), (None, [1.0, 2.0], 1), (700, [], 1), (800, [1.0, 2.0, 3.0], 1), (900, [1e300, 2.0], None), (5, [1.0, -0.0], 0), (6, [1.0, 0.0], 0),
       (8, [-3.0, 1e-300], 0), (9, [1e200, -1e200], 2), (10, [4.0, 4.0], 0)]


def test_search_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id bigint, embedding array<double>, label int")
    df = df.withColumns({c: F.lit(1) for c in ("id", "v", "c", "q", "keys", "rank", "score", "asks")})
    got = {}
    for r in multiprobe.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    flat = {0: [1.0, 2.0], 100: [1.0, 2.0], 5: [1.0, 0.0], 6: [1.0, 0.0], 8: [-3.0, 1e-300], 9: [1e200, -1e200], 10: [4.0, 4.0], 900: [1e300, 2.0]}
    assert set(got) == {0, 100, 900}
    for q, near in got.items():
        want = sorted((float(np.hypot(*(np.subtract(flat[q], v)))), i) for i, v in flat.items() if i != q)
        assert [i for i, _ in near] == [i for _, i in want]
        assert np.allclose([s for _, s in near], [s for s, _ in want], rtol=1e-12)
    assert multiprobe.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert multiprobe.search(df, F.lit(False)).count() == 0


def negatives_by_hand(rows, asks):
    """Rows ``(id, label, integer vector)`` without repeats."""
    out = []
    for a, la, x in rows:
        if not asks(a):
            continue
        s = [(sum(p * q for p, q in zip(x, y)), i, lb == la) for i, lb, y in rows]
        for ps, p, _ in sorted((t for t in s if t[2] and t[1] != a), key=lambda t: (-t[0], t[1]))[:5]:
            inside = sorted((t for t in s if not t[2] and 30 * ps <= 100 * t[0] <= 90 * ps), key=lambda t: (-t[0], t[1]))[:10]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_in_groups_with_copies(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 300)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 10)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 6))
    x = np.concatenate([centres[rng.integers(0, 40, 1_500)] + 0.1 * rng.normal(size=(1_500, 6)), np.repeat(centres[:1], 700, axis=0)])
    ids = rng.permutation(len(x)).tolist()
    label = rng.integers(0, 4, len(x)).tolist()
    df = spark.createDataFrame([(i, v, s) for i, v, s in zip(ids, x.tolist(), label)], "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label"))
    rows = [(i, s, np.floor(256 * v).astype(int).tolist()) for i, v, s in zip(ids, x, label)]
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == \
        negatives_by_hand(rows, lambda i: i % 50 == 0)


def test_hard_negatives_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id bigint, embedding array<double>, label int")
    df = df.withColumns({c: F.lit(1) for c in ("id", "v", "key", "block", "shard", "asks", "rank")})
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label")).collect())
    whole = lambda v: [int(max(-2 ** 28, min(2 ** 28, np.floor(256 * c)))) for c in v]
    fine = [(i, s, whole(v)) for i, v, s in ODD if i not in (None, 200, 400, 500, 600, 700, 900)]
    assert got == negatives_by_hand([r for k, r in enumerate(fine) if r not in fine[:k]], lambda i: i % 100 == 0)
    assert hard_negatives.mine(df.limit(0), F.lit(True), F.col("label")).count() == 0
    assert hard_negatives.mine(df, F.lit(None).cast("boolean"), F.col("label")).count() == 0


def test_curve_visits_neighbours():
    side, n = 8, 3
    grid = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    order = np.argsort(np.array(hard_negatives.hilbert_keys(grid, 3)))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_intervals_hold_every_score():
    rng = np.random.default_rng(4)
    a, rows = rng.integers(-300, 300, (20, 9)), rng.integers(-300, 300, (50, 9))
    least, most = hard_negatives.intervals(a, rows.min(axis=0), rows.max(axis=0))
    s = hard_negatives.scores(a, rows)
    assert (s == a @ rows.T).all() and (s >= least[:, None]).all() and (s <= most[:, None]).all()
    big = np.array([[1 << 28, -(1 << 28) + 1]])
    assert hard_negatives.scores(big, big)[0, 0] == int(big[0, 0]) ** 2 + int(big[0, 1]) ** 2


def test_field_does_not_depend_on_partitions_and_reads_whole_words(spark):
    from labelsift.llm import pii

    rng = np.random.default_rng(8)
    rows = [(i, f"call +44 20 7946 {1000 + i % 40} or {i % 40 + 1000} now, card {'4111 1111 1111 1111' if i % 3 else '12'} {'z' * (i % 90)}{i} end") for i in range(300)]
    rows += [(7, rows[9][1]), (7, rows[9][1]), (8, None)]
    fields = [pii.train(spark.createDataFrame([rows[j] for j in rng.permutation(len(rows))], "doc_id bigint, text string").repartition(n), most_tokens=500) for n in (1, 3, 8)]
    for f in fields[1:]:
        assert f.index == fields[0].index and all((getattr(f, k) == getattr(fields[0], k)).all() for k in ("node", "chain", "skip"))
    a, b = (pii.graph(f"{'w' * 200}{x} 12345 {'v' * 200}{x}", []).features[0] for x in "xy")
    assert a[-2:] != b[-2:] and pii.shape("1" * 90 + "-") != pii.shape("1" * 91 + "-") and len(max(a, key=len)) < 90


def test_ratings_of_odd_texts(spark):
    from labelsift.llm import quality

    rng = np.random.default_rng(9)
    good, bad = (["".join(rng.choice(list(a), 6)) for _ in range(60)] for a in ("abcdef", "uvwxyz"))
    text = lambda words, n=40: " ".join(rng.choice(words, n))
    docs = [(i, text(good if i % 2 else bad)) for i in range(400)]
    long = text(bad, 300_000)
    docs += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "x" * 200_000), (1004, long), (1005, long + " " + text(good, 300_000)), (1006, docs[1][1]), (1, docs[1][1]), (None, docs[1][1])]
    clash = {c: F.lit(c) for c in ("_rating", "grade", "order", "id")}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns(clash)
    rated = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(400)] + [(3, 2), (9999, 2)], "doc_id bigint, grade int")
    first = {}
    for parts in (1, 6):
        rows = df.repartition(parts)
        out = quality.rate(rows, quality.train(rows, rated)).collect()
        assert len(out) == len(docs) and all(r["_rating"] == "_rating" and r["id"] == "id" for r in out)
        by = {}
        for r in out:
            assert r["kept"] == (r["tail_probability"] >= 0.75) and 0 <= r["tail_probability"] <= r["expected_grade"] <= 2
            by.setdefault(r["doc_id"], set()).add((round(r["expected_grade"], 6), round(r["tail_probability"], 6)))
        assert all(len(v) == 1 for v in by.values())  # repeated rows score alike
        assert by[1000] == by[1001] == by[1002] and by[1006] == by[1] == by[None]
        assert all(next(iter(by[i]))[0] > next(iter(by[j]))[0] for i in range(1, 400, 2) for j in (0, 2, 4))
        assert next(iter(by[1005]))[0] > next(iter(by[1004]))[0]  # the end of a long text counts
        first = first or by
        assert all(abs(next(iter(by[k]))[0] - next(iter(first[k]))[0]) < 1e-3 for k in by)
