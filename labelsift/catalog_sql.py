"""The same queries in ANSI-style SQL over the same tables, for a second engine to check results.

Written as named sub-queries that are put in front of each query as needed.
"""

from __future__ import annotations

# name -> (names it reads, sub-query text)
PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: str, text: str) -> None:
    PARTS[name] = (needs.split(), text)


def build(needs: str, final: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in PARTS[name][0]:
            visit(n)
        order.append(name)

    for n in needs.split():
        visit(n)
    head = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    return f"WITH {head}\n{final}" if order else final


# ---------------------------------------------------------------- inputs

part("pe_vec", "", """SELECT vec_id AS id, label AS s, vec_id % 4 AS fold,
    generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings""")
part("pe_cell", "pe_vec", "SELECT s, fold, i, count(*) AS n, sum(v) AS t FROM pe_vec GROUP BY ALL")
part("pe_center", "pe_cell", """SELECT f.out, c.s AS k, c.i, sum(c.t) / sum(c.n) AS v
    FROM pe_cell c JOIN (SELECT unnest(range(4)) AS out) f ON f.out <> c.fold GROUP BY ALL""")
part("pe_cos", "pe_vec pe_center", """SELECT e.id, e.s, c.k, exp(8 * (sum(e.v * c.v)
    / (sqrt(sum(e.v * e.v)) * sqrt(sum(c.v * c.v))))) AS x
    FROM pe_vec e JOIN pe_center c ON c.out = e.fold AND c.i = e.i GROUP BY e.id, e.s, c.k""")
part("pe", "pe_cos", "SELECT id, s, k, round(x / sum(x) OVER (PARTITION BY id), 6) AS p FROM pe_cos")

part("pl_row", "", """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS s FROM orders""")
part("pb_row", "", """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END AS s FROM orders""")
for _n, _k in (("pl", 3), ("pb", 2)):
    part(f"{_n}_w", f"{_n}_row", f"""SELECT id, s, k, (id * 7919 + k * 104729) % 9973 + 1
        + CASE WHEN s = k THEN 3000 ELSE 0 END AS w FROM {_n}_row, (SELECT unnest(range({_k})) AS k)""")
    part(_n, f"{_n}_w", f"""SELECT id, s, CAST(k AS INTEGER) AS k,
        floor(w * 1000000 / CAST(sum(w) OVER (PARTITION BY id) AS DOUBLE)) / 1e6::DOUBLE AS p FROM {_n}_w""")
part("scored", "pb", """SELECT id, s AS label, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted,
    s = 0 AND id % 11 = 0 AS hidden FROM pb WHERE k = 1""")
part("toxic_row", "", """SELECT d.doc_id AS id, l.toxic AS s,
    round(((d.doc_id * 7919 + d.n_chars) % 9973 + 1 + l.toxic * 4000) / 14000.0::DOUBLE, 6) AS p1
    FROM documents d JOIN labels l USING (doc_id)""")
part("tx", "toxic_row", """SELECT id, s, 1 AS k, p1 AS p FROM toxic_row
    UNION ALL SELECT id, s, 0, round(1.0::DOUBLE - p1, 6) FROM toxic_row""")
part("ev_row", "", """SELECT DISTINCT user_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day,
    CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS k FROM events""")
part("ev", "ev_row", """SELECT u.user_id * 1000 + u.day AS id, c.k, e.k IS NOT NULL AS given,
    round(((u.user_id * 17 + u.day * 5 + c.k * 31) % 83 + 1 + CASE WHEN e.k IS NOT NULL THEN 40 ELSE 0 END)
    / 125.0::DOUBLE, 6) AS p
    FROM (SELECT DISTINCT user_id, day FROM ev_row) u CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS k) c
    LEFT JOIN ev_row e ON e.user_id = u.user_id AND e.day = u.day AND e.k = c.k""")

part("label_rows", "", """SELECT l_partkey AS file,
    CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER) AS release,
    CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS vulnerable, l_quantity, l_tax FROM lineitem""")
part("silent_rows", "label_rows", "SELECT DISTINCT file, release FROM label_rows WHERE l_quantity >= 48 AND l_tax <= 0.02")
part("latent_rows", "", """SELECT p_partkey AS file, p_size AS a, p_size + 6 AS b FROM part
    UNION ALL SELECT p_partkey, p_size + 4, p_size + 12 FROM part WHERE p_partkey % 3 = 0""")
part("corrected", "label_rows silent_rows latent_rows", """SELECT l.file, l.release, l.vulnerable,
    EXISTS (SELECT 1 FROM silent_rows x WHERE x.file = l.file AND x.release = l.release) AS in_silent,
    EXISTS (SELECT 1 FROM latent_rows x WHERE x.file = l.file AND l.release BETWEEN x.a AND x.b) AS in_latent
    FROM label_rows l""")

# ---------------------------------------------------------------- joint and latent, per source

# One problem of two classes for each release: class 2 * release + s, with the probabilities of a row's own release only.
MOST_RELEASES = 85
part("rel_rows", "", """SELECT l_partkey AS file, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER) AS release,
    max(CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END) AS s, sum(CAST(l_quantity AS DOUBLE)) AS a, count(*) * 10.0::DOUBLE AS b,
    sum(round(CAST(l_tax AS DOUBLE) * 100)) AS c FROM lineitem GROUP BY ALL""")
part("rel_cell", "rel_rows", "SELECT release, s, file % 4 AS fold, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM rel_rows GROUP BY ALL")
part("rel_left", "rel_cell", """SELECT release, s, f.out, sum(a) / sum(n) AS a, sum(b) / sum(n) AS b, sum(c) / sum(n) AS c
    FROM rel_cell JOIN (SELECT unnest(range(4)) AS out) f ON f.out <> fold GROUP BY ALL""")


def _apart(row: str, centre: str) -> str:
    return "sqrt(" + " + ".join(f"power({row}.{v} - {centre}.{v}, 2)" for v in "abc") + ")"


part("rel_p", "rel_rows rel_left", f"""SELECT file, release, s, round(CASE WHEN d0 IS NULL AND d1 IS NULL THEN 0.5 WHEN d1 IS NULL THEN 0.0
    WHEN d0 IS NULL THEN 1.0 ELSE coalesce(d0 / nullif(d0 + d1, 0.0::DOUBLE), 0.5) END, 6) AS p FROM (SELECT r.file, r.release, r.s,
    CASE WHEN u.a IS NOT NULL THEN {_apart("r", "u")} END AS d0, CASE WHEN v.a IS NOT NULL THEN {_apart("r", "v")} END AS d1 FROM rel_rows r
    LEFT JOIN rel_left u ON u.release = r.release AND u.s = 0 AND u.out = r.file % 4
    LEFT JOIN rel_left v ON v.release = r.release AND v.s = 1 AND v.out = r.file % 4)""")
part("rl", "rel_p", """SELECT file * 1000 + release AS id, 2 * release + s AS s, CAST(2 * release + k AS INTEGER) AS k, CASE k WHEN 1 THEN p ELSE 1.0::DOUBLE - p END AS p
    FROM rel_p, (SELECT unnest([0, 1]) AS k)""")
part("rel_mean", "rel_rows", "SELECT release, s, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM rel_rows GROUP BY ALL")
part("rel_truth", "rel_rows silent_rows latent_rows", """SELECT r.file, r.release, r.s,
    EXISTS (SELECT 1 FROM silent_rows x WHERE x.file = r.file AND x.release = r.release)
    OR EXISTS (SELECT 1 FROM latent_rows x WHERE x.file = r.file AND r.release BETWEEN x.a AND x.b) AS hid FROM rel_rows r""")
part("rel_masks", "rel_truth rel_rows rel_mean rl_rate rl_argmax", f"""SELECT 'pruning' AS technique, t.release, t.s, t.hid, f.flag AND g.y <> g.s AS flagged
    FROM rel_truth t JOIN rl_rate f ON f.id = t.file * 1000 + t.release JOIN rl_argmax g ON g.id = f.id
    UNION ALL SELECT 'propagation1', t.release, t.s, t.hid, NOT (coalesce({_apart("r", "u")} < {_apart("r", "v")}, TRUE) OR r.s = 1)
    FROM rel_truth t JOIN rel_rows r ON r.file = t.file AND r.release = t.release
    LEFT JOIN rel_mean u ON u.release = r.release AND u.s = 0 LEFT JOIN rel_mean v ON v.release = r.release AND v.s = 1""")
part("rel_runs", "rel_p rel_truth", """SELECT r.technique, t.release - 2 AS release, t.s = 1 AS t, t.hid OR t.s = 1 AS truth, p.p >= r.cut AS q FROM rel_p p
    JOIN rel_truth t ON t.file = p.file AND t.release = p.release, (VALUES ('baseline', 0.5::DOUBLE), ('regularize', 0.4::DOUBLE)) r(technique, cut) WHERE t.release > 2""")

# Gaussian naive Bayes: a mean and a variance of every feature and class, and the share of the classes' weights.
part("nb_rows", "", """SELECT vec_id AS id, CASE WHEN label = 0 AND vec_id % 2 = 0 THEN 1 ELSE 0 END AS s, embedding FROM embeddings""")


def order_key(seed: int) -> str:
    return f"((id % 2147483648 + {seed}) * 2654435761) % 4294967296"


def ranked(source: str, by: str, seed: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order_key(seed)}, id) AS rn FROM {source}"


part("nb_rn", "nb_rows", ranked("nb_rows", "s", 42))
part("nb_fold", "nb_rn", "SELECT id, s, embedding, CAST(rn > n // 3 AS INTEGER) + CAST(rn > 2 * n // 3 AS INTEGER) AS fold FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM nb_rn)")


def bayes_parts(tag: str, training: str, scored: str) -> None:
    """``{tag}_p``: ``id, s, p`` of the rows ``scored (id, s, embedding, g)`` by the model of group g of ``training (id, s, embedding, g, w)``."""
    part(f"{tag}_v", training, f"SELECT g, s, w, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM {training}")
    part(f"{tag}_eps", f"{tag}_v", f"SELECT g, 1e-9::DOUBLE * max(e) AS e FROM (SELECT g, i, avg(v * v) - avg(v) * avg(v) AS e FROM {tag}_v GROUP BY g, i) GROUP BY g")
    part(f"{tag}_m", f"{tag}_v {tag}_eps", f"""SELECT t.g, s, i, m, q - m * m + e AS var, lw FROM (SELECT g, s, i, avg(v) AS m, avg(v * v) AS q,
        ln(sum(w) / sum(sum(w)) OVER (PARTITION BY g, i)) AS lw FROM {tag}_v GROUP BY g, s, i) t JOIN {tag}_eps e ON e.g = t.g""")
    part(f"{tag}_x", scored, f"SELECT id, s, g, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM {scored}")
    part(f"{tag}_l", f"{tag}_x {tag}_m", f"""SELECT x.id, any_value(x.s) AS s, m.s AS k, max(m.lw) + sum(-(x.v - m.m) * (x.v - m.m) / (2 * m.var) - 0.5 * ln(2 * pi() * m.var)) AS l
        FROM {tag}_x x JOIN {tag}_m m ON m.g = x.g AND m.i = x.i GROUP BY x.id, m.s""")
    part(f"{tag}_p", f"{tag}_l", f"SELECT id, any_value(s) AS s, 1 / (1 + exp(max(l) FILTER (k = 0) - max(l) FILTER (k = 1))) AS p FROM {tag}_l GROUP BY id")


part("nbcv_train", "nb_fold", "SELECT f.g, id, s, embedding, 1.0::DOUBLE AS w FROM nb_fold JOIN (SELECT unnest(range(3)) AS g) f ON f.g <> fold")
part("nbcv_rows", "nb_fold", "SELECT id, s, embedding, fold AS g FROM nb_fold")
bayes_parts("nbcv", "nbcv_train", "nbcv_rows")
part("nb", "nbcv_p", """SELECT id, s, CAST(k AS INTEGER) AS k, CASE k WHEN 1 THEN round(p, 6) ELSE 1.0::DOUBLE - round(p, 6) END AS p
    FROM nbcv_p, (SELECT unnest([0, 1]) AS k)""")
part("nb_kept", "nb_rate nb_argmax", "SELECT a.id, f.flag AND a.y <> a.s AS is_error FROM nb_argmax a JOIN nb_rate f USING (id)")
part("nb_weight", "nb_nm", """SELECT s, 1 / (c / t) AS w FROM (SELECT s, y, c, sum(c) OVER (PARTITION BY y) AS t FROM
    (SELECT s, y, CASE WHEN s = y THEN p ELSE least(greatest(p, 0.0), 0.9999) END AS c FROM nb_nm)) WHERE s = y""")
part("nbfit_train", "nb_rows nb_kept nb_weight", """SELECT 0 AS g, r.id, r.s, embedding, w.w FROM nb_rows r JOIN nb_kept k ON k.id = r.id AND NOT k.is_error
    JOIN nb_weight w ON w.s = r.s""")
part("nball_rows", "nb_rows", "SELECT id, s, embedding, 0 AS g FROM nb_rows")
bayes_parts("nbfit", "nbfit_train", "nball_rows")
part("nben_rn", "nb_rows", ranked("nb_rows", "s", 5))
part("nben_held", "nben_rn", "SELECT id, s, embedding, s = 1 AND rn <= ceil((SELECT count(*) FROM nben_rn WHERE s = 1) * 0.2::DOUBLE) AS held FROM nben_rn")
part("nben_train", "nben_held", "SELECT 0 AS g, id, s, embedding, 1.0::DOUBLE AS w FROM nben_held WHERE NOT held")
bayes_parts("nben", "nben_train", "nball_rows")

part("nbbag_train", "nb_rows", f"""SELECT g.g, id, s, embedding, 1.0::DOUBLE AS w FROM nb_rows JOIN (SELECT unnest(range(15)) AS g) g
    ON s = 1 OR {order_key(9)} % 15 = g.g""")
part("nbbag_rows", "nb_rows", "SELECT id * 15 + g AS id, s, embedding, g FROM nb_rows, (SELECT unnest(range(15)) AS g)")
bayes_parts("nbbag", "nbbag_train", "nbbag_rows")
part("nbdist_v", "nb_rows", "SELECT id, s, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM nb_rows")
part("nbdist_c", "nbdist_v", "SELECT s AS k, i, avg(v) AS m FROM nbdist_v WHERE id % 4 <> 0 GROUP BY s, i")
part("nbdist_d", "nbdist_v nbdist_c", """SELECT x.id, any_value(x.s) AS s, c.k, 1 - sum(x.v * c.m) / (sqrt(sum(x.v * x.v)) * sqrt(sum(c.m * c.m))) AS d
    FROM nbdist_v x JOIN nbdist_c c ON c.i = x.i WHERE x.id % 4 <> 0 GROUP BY x.id, c.k""")
part("nbdist_near", "nbdist_d", "SELECT id, any_value(s) AS s, max(d) FILTER (k = 0) AS d0, max(d) FILTER (k = 1) AS d1 FROM nbdist_d GROUP BY id")
part("nbtwo_alpha", "", "SELECT * FROM (VALUES (0, 0.8::DOUBLE), (1, 0.9::DOUBLE), (2, 1.0::DOUBLE), (3, 1.1::DOUBLE), (4, 1.2::DOUBLE)) t(g, alpha)")
part("nbtwo_train", "nb_rows nbdist_near nbtwo_alpha", """SELECT a.g, r.id, r.s, embedding, 1.0::DOUBLE AS w FROM nbdist_near n JOIN nbtwo_alpha a ON n.d0 < n.d1 * a.alpha OR n.s = 1
    JOIN nb_rows r ON r.id = n.id""")
part("nbtwo_rows", "nb_rows", "SELECT id * 5 + g AS id, s, embedding, g FROM nb_rows, (SELECT unnest(range(5)) AS g)")
bayes_parts("nbtwo", "nbtwo_train", "nbtwo_rows")
part("nbtwo_auc", "nbtwo_p", """SELECT a.id % 5 AS g, sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc
    FROM nbtwo_p a JOIN nbtwo_p b ON a.id % 5 = b.id % 5 WHERE a.s = 1 AND b.s = 0 AND a.id // 5 % 4 = 0 AND b.id // 5 % 4 = 0 GROUP BY 1""")
part("nbtwo_best", "nbtwo_auc nbtwo_alpha", "SELECT g, alpha FROM nbtwo_auc JOIN nbtwo_alpha USING (g) ORDER BY auc DESC, g LIMIT 1")
part("nbtwo_out", "nbtwo_p nbtwo_best", "SELECT p.id // 5 AS id, p.s, b.alpha, p.p FROM nbtwo_p p JOIN nbtwo_best b ON p.id % 5 = b.g")
part("nbprop_train", "nbtwo_out nb_rows", """SELECT 0 AS g, r.id, CASE WHEN o.p >= 0.5 THEN 1 ELSE r.s END AS s, embedding, 1.0::DOUBLE AS w
    FROM nb_rows r JOIN nbtwo_out o ON o.id = r.id WHERE r.id % 4 <> 0""")
bayes_parts("nbprop", "nbprop_train", "nball_rows")

SOURCES = {"pe": 10, "pl": 3, "pb": 2, "tx": 2, "nb": 2, "rl": 2 * MOST_RELEASES}
for _n, _k in SOURCES.items():
    part(f"{_n}_grid", "", f"""SELECT CAST(a.i AS INTEGER) AS s, CAST(b.i AS INTEGER) AS y
        FROM (SELECT unnest(range({_k})) AS i) a, (SELECT unnest(range({_k})) AS i) b""")
    part(f"{_n}_size", _n, f"SELECT k AS s, count(*) FILTER (s = k) AS class_n FROM {_n} GROUP BY k")
    part(f"{_n}_thr", _n, f"SELECT k, avg(p) AS t FROM {_n} WHERE s = k GROUP BY k")
    part(f"{_n}_guess", f"{_n} {_n}_thr", f"""SELECT id, any_value(s) AS s,
        CASE WHEN count(*) FILTER (p >= t - 1e-6) = 0 THEN NULL
             WHEN count(*) FILTER (p >= t - 1e-6) = 1 THEN min(k) FILTER (p >= t - 1e-6)
             ELSE first(k ORDER BY p DESC, k) END AS y FROM {_n} JOIN {_n}_thr USING (k) GROUP BY id""")
    part(f"{_n}_argmax", _n, f"SELECT id, any_value(s) AS s, first(k ORDER BY p DESC, k) AS y FROM {_n} GROUP BY id")
    for _src, _cells in (("guess", "cells"), ("argmax", "acells")):
        part(f"{_n}_{_cells}", f"{_n}_grid {_n}_{_src} {_n}_size", f"""SELECT g.s, g.y, count(r.s) AS n, any_value(z.class_n) AS class_n
            FROM {_n}_grid g JOIN {_n}_size z ON z.s = g.s
            LEFT JOIN {_n}_{_src} r ON r.s = g.s AND r.y = g.y GROUP BY g.s, g.y""")
        part(f"{_n}_{_cells}_x", f"{_n}_{_cells}", f"""SELECT s, y, class_n, coalesce(CAST(n AS DOUBLE)
            / nullif(CAST(sum(n) OVER (PARTITION BY s) AS DOUBLE), 0), CASE WHEN s = y THEN 1.0 ELSE 0.0 END) * class_n AS x
            FROM {_n}_{_cells}""")
        part(f"{_n}_{_cells}_r", f"{_n}_{_cells}_x", f"""SELECT s, y, class_n, round_even(x, 0) AS b, x - round_even(x, 0) AS f,
            round_even(sum(x) OVER (PARTITION BY s), 0) - sum(round_even(x, 0)) OVER (PARTITION BY s) AS gap FROM {_n}_{_cells}_x""")
        part(f"{_n}_{'cj' if _src == 'guess' else 'acj'}", f"{_n}_{_cells}_r", f"""SELECT s, y, class_n, CAST(b
            + CASE WHEN row_number() OVER (PARTITION BY s ORDER BY f DESC, y DESC) <= gap THEN 1 ELSE 0 END
            - CASE WHEN row_number() OVER (PARTITION BY s ORDER BY f, y) <= -gap THEN 1 ELSE 0 END AS BIGINT) AS n FROM {_n}_{_cells}_r""")
    part(f"{_n}_ps", f"{_n}_size", f"SELECT s, class_n AS n, class_n / CAST(sum(class_n) OVER () AS DOUBLE) AS p FROM {_n}_size")
    for _m, _given in (("nm", "y"), ("inv", "s")):
        part(f"{_n}_{_m}", f"{_n}_cj", f"""SELECT s, y, coalesce(CAST(n AS DOUBLE) / nullif(CAST(sum(n) OVER (PARTITION BY {_given})
            AS DOUBLE), 0), CASE WHEN s = y THEN 1.0 ELSE 0.0 END) AS p FROM {_n}_cj""")
    part(f"{_n}_diag", f"{_n}_nm {_n}_inv", f"""SELECT m.s, m.p AS m, i.p AS i FROM {_n}_nm m JOIN {_n}_inv i
        ON m.s = i.s AND m.y = i.y WHERE m.s = m.y""")

part("py_cnt", "pl_ps pl_diag", "SELECT d.s AS y, d.i / d.m * ps.p AS p FROM pl_diag d JOIN pl_ps ps USING (s)")
part("py_marginal", "pl_cj", "SELECT y, sum(n) / CAST(sum(sum(n)) OVER () AS DOUBLE) AS p FROM pl_cj GROUP BY y")
part("py_marginal_ps", "pl_inv pl_ps", "SELECT i.y, sum(i.p * ps.p) AS p FROM pl_inv i JOIN pl_ps ps USING (s) GROUP BY i.y")
for _m in ("cnt", "marginal", "marginal_ps"):
    part(f"cpy_{_m}", f"py_{_m}", f"""SELECT y, greatest(least(p, 1.0), 1e-5) / sum(greatest(least(p, 1.0), 1e-5)) OVER () AS p FROM py_{_m}""")


def clip_rates(source: str, given: str) -> str:
    c = "CASE WHEN s = y THEN p ELSE least(greatest(p, 0.0), 0.9999) END"
    return f"SELECT s, y, round({c} / sum({c}) OVER (PARTITION BY {given}), 6) AS p FROM {source}"


# ---------------------------------------------------------------- pruning

def prune_parts(src: str, cj: str, tag: str, frac: float = 1.0, budget: list[int] | None = None) -> None:
    """Sub-queries ``{tag}_cnt`` (s, y, n), ``{tag}_rate`` and ``{tag}_class`` (id, flag)."""
    part(f"{tag}_k1", cj, f"""SELECT s, y, class_n, n, greatest(5 - max(n) FILTER (s = y) OVER (PARTITION BY s), 0) AS extra,
        greatest(count(*) FILTER (n <> 0) OVER (PARTITION BY s) - 1, 1) AS cells FROM {cj}""")
    part(f"{tag}_k2", f"{tag}_k1", f"""SELECT s, y, class_n, CASE WHEN s = y THEN CAST(n + extra AS DOUBLE)
        ELSE greatest(n - extra / CAST(cells AS DOUBLE), 0.0) END AS x FROM {tag}_k1""")
    part(f"{tag}_k3", f"{tag}_k2", f"""SELECT s, y, class_n, CAST(floor(CASE WHEN s = y THEN x
        + sum(CASE WHEN s = y THEN 0.0 ELSE x - x * {frac}::DOUBLE END) OVER (PARTITION BY s) ELSE x * {frac}::DOUBLE END) AS BIGINT) AS n FROM {tag}_k2""")
    if budget is None:
        part(f"{tag}_cnt", f"{tag}_k3", f"SELECT s, y, class_n, n FROM {tag}_k3")
    else:
        want = "[" + ", ".join(f"{b}.0" for b in budget) + "]::DOUBLE[]"
        part(f"{tag}_q", f"{tag}_k3", f"""SELECT c.s, c.y, c.class_n, z.class_n AS y_size, coalesce(c.n / nullif(t.t, 0.0), 0.0) AS q,
            ({want})[c.y + 1] AS want FROM {tag}_k3 c
            JOIN (SELECT y AS s, CAST(sum(n) AS DOUBLE) AS t FROM {tag}_k3 GROUP BY y) t ON t.s = c.s
            JOIN {src}_size z ON z.s = c.y""")
        part(f"{tag}_qx", f"{tag}_q", f"""SELECT s, y, class_n, CASE WHEN s = y THEN y_size - want ELSE
            coalesce(q * want / nullif(sum(CASE WHEN s = y THEN 0.0 ELSE q END) OVER (PARTITION BY y), 0.0), 0.0) END AS x FROM {tag}_q""")
        part(f"{tag}_qr", f"{tag}_qx", f"""SELECT s, y, class_n, round_even(x, 0) AS b, x - round_even(x, 0) AS f,
            round_even(sum(x) OVER (PARTITION BY y), 0) - sum(round_even(x, 0)) OVER (PARTITION BY y) AS gap FROM {tag}_qx""")
        part(f"{tag}_cnt", f"{tag}_qr", f"""SELECT s, y, class_n, CAST(b
            + CASE WHEN row_number() OVER (PARTITION BY y ORDER BY f DESC, s DESC) <= gap THEN 1 ELSE 0 END
            - CASE WHEN row_number() OVER (PARTITION BY y ORDER BY f, s) <= -gap THEN 1 ELSE 0 END AS BIGINT) AS n FROM {tag}_qr""")
    part(f"{tag}_margin", src, f"""SELECT id, s, k, p - max(p) FILTER (k = s) OVER (PARTITION BY id) AS m FROM {src}""")
    part(f"{tag}_rate", f"{tag}_margin {tag}_cnt", f"""SELECT id, bool_or(hit) AS flag FROM (SELECT m.id,
        c.class_n > 5 AND c.n > 0 AND rank() OVER (PARTITION BY m.s, m.k ORDER BY m.m DESC) <= c.n AS hit
        FROM {tag}_margin m JOIN {tag}_cnt c ON c.s = m.s AND c.y = m.k WHERE m.k <> m.s) GROUP BY id""")
    part(f"{tag}_class", f"{src} {tag}_cnt", f"""SELECT p.id, c.class_n > 5 AND count(*) OVER (PARTITION BY p.s ORDER BY p.p
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= c.class_n - c.n AS flag
        FROM {src} p JOIN {tag}_cnt c ON c.s = p.s AND c.y = p.s WHERE p.k = p.s""")
    part(f"{tag}_both", f"{tag}_rate {tag}_class", f"SELECT id, r.flag AND c.flag AS flag FROM {tag}_rate r JOIN {tag}_class c USING (id)")


for _n in SOURCES:
    prune_parts(_n, f"{_n}_cj", f"{_n}")
prune_parts("pl", "pl_cj", "pl_half", frac=0.5)
prune_parts("pl", "pl_cj", "pl_budget", budget=[200, 100, 50])
prune_parts("pl", "pl_acells", "pl_am")
prune_parts("pl", "pl_acj", "pl_amc")


def errors(src: str, flags: str) -> str:
    return build(f"{flags} {src}_argmax",
                 f"SELECT a.id, a.s, f.flag AND a.y <> a.s AS is_error FROM {src}_argmax a JOIN {flags} f USING (id)")


for _n in ("pe", "pb"):
    part(f"{_n}_err", f"{_n}_rate {_n}_argmax", f"""SELECT a.id, a.s, f.flag AND a.y <> a.s AS is_error
        FROM {_n}_argmax a JOIN {_n}_rate f USING (id)""")
part("pe_own", "pe", "SELECT id, max(p) FILTER (k = s) AS own, max(p) AS top FROM pe GROUP BY id")


def ordered(score: str) -> str:
    return build("pe_err pe_own", f"""SELECT id, s, round({score}, 6) AS score,
        row_number() OVER (ORDER BY round({score}, 6), id) AS rank FROM pe_err JOIN pe_own USING (id) WHERE is_error""")


# ---------------------------------------------------------------- several labels per row

part("ev_grid", "", """SELECT CAST(a.i AS INTEGER) AS s, CAST(b.i AS INTEGER) AS y
    FROM (SELECT unnest(range(5)) AS i) a, (SELECT unnest(range(5)) AS i) b""")
part("ev_thr", "ev", "SELECT k, avg(p) AS t FROM ev WHERE given GROUP BY k")
part("ev_size", "ev", "SELECT k AS s, count(*) FILTER (given) AS class_n FROM ev GROUP BY k")
part("ev_pairs", "ev ev_thr", """SELECT g.k AS s, h.k AS y FROM ev g JOIN ev h ON h.id = g.id
    JOIN ev_thr t ON t.k = h.k WHERE g.given AND h.p >= t.t""")
part("ev_cells", "ev_grid ev_pairs ev_size", """SELECT g.s, g.y, count(r.s) AS n, any_value(z.class_n) AS class_n FROM ev_grid g
    JOIN ev_size z ON z.s = g.s LEFT JOIN ev_pairs r ON r.s = g.s AND r.y = g.y GROUP BY g.s, g.y""")
part("ev_x", "ev_cells", """SELECT s, y, class_n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY s) AS DOUBLE) * class_n AS x FROM ev_cells""")
part("ev_r", "ev_x", """SELECT s, y, class_n, round_even(x, 0) AS b, x - round_even(x, 0) AS f,
    round_even(sum(x) OVER (PARTITION BY s), 0) - sum(round_even(x, 0)) OVER (PARTITION BY s) AS gap FROM ev_x""")
part("ev_cj", "ev_r", """SELECT s, y, class_n, CAST(b
    + CASE WHEN row_number() OVER (PARTITION BY s ORDER BY f DESC, y DESC) <= gap THEN 1 ELSE 0 END
    - CASE WHEN row_number() OVER (PARTITION BY s ORDER BY f, y) <= -gap THEN 1 ELSE 0 END AS BIGINT) AS n FROM ev_r""")
part("ev_bound", "", "SELECT CAST(0.05 AS DOUBLE) + unnest(range(17)) * CAST(0.05 AS DOUBLE) AS b")
part("ev_f1", "ev ev_bound", """SELECT b, count(*) FILTER (given AND p > b) AS tp, count(*) FILTER (NOT given AND p > b) AS fp,
    count(*) FILTER (given AND NOT p > b) AS fn FROM ev, ev_bound GROUP BY b""")
part("ev_curve", "ev_f1", "SELECT b, tp, fp, fn, 2.0::DOUBLE * tp / (2.0::DOUBLE * tp + fp + fn) AS f1 FROM ev_f1")
part("ev_best", "ev_curve", "SELECT b FROM ev_curve ORDER BY f1 DESC, b LIMIT 1")
part("ev_pred", "ev ev_best", """SELECT id, any_value(b) AS b, bool_and((p > b) = given) AS same,
    coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (p > b), '') AS predicted FROM ev, ev_best GROUP BY id""")
prune_parts("ev", "ev_cj", "evp")
part("evp_margin", "ev", "SELECT g.id, g.k AS s, h.k, h.p - g.p AS m FROM ev g JOIN ev h ON h.id = g.id WHERE g.given")

# ---------------------------------------------------------------- text

def _sql_str(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _clean(col: str) -> str:
    from labelsift.functions import text as t

    out = f"coalesce({col}, '')"
    for pattern, flags in ((t.LEADING_BLOCK_COMMENT, "(?sm)"), (t.INLINE_BLOCK_COMMENT, ""), (t.LINE_COMMENT, "(?m)"), (t.BLANK_LINE, "(?m)")):
        out = f"regexp_replace({out}, {_sql_str(flags + pattern)}, '', 'g')"
    return out


def _literals(col: str) -> str:
    from labelsift.functions import text as t

    out = col
    for pattern, token in ((t.STRING_LITERAL, "TSTRING"), (t.CHAR_LITERAL, "TCHAR"), (t.NUMBER_LITERAL, "TNUM")):
        out = f"regexp_replace({out}, {_sql_str(pattern)}, '{token}', 'g')"
    return out


def _token_pattern() -> str:
    from labelsift.functions import text as t

    return _sql_str(t.TOKEN)


part("page_code", "", f"SELECT page_id AS id, {_clean('html')} AS code FROM pages")
part("page_plain", "page_code", f"SELECT id, {_literals('code')} AS code FROM page_code")
part("page_tok", "page_plain", f"SELECT id, unnest(regexp_extract_all(code, {_token_pattern()})) AS token FROM page_plain")
part("tok_n", "page_tok", "SELECT id, token, count(*) AS n FROM page_tok GROUP BY id, token")
part("vocab", "tok_n", "SELECT token, CAST(sum(n) AS BIGINT) AS total FROM tok_n GROUP BY token ORDER BY total DESC, token LIMIT 4000")

# ---------------------------------------------------------------- evaluation

part("outcome", "scored", """SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
    count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM scored""")
METRICS = """tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy,
    round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
    round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
    round(coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0), 6) AS f1,
    round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
    round(sqrt(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) * coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0)), 6) AS gmean,
    round((tp + fp + fn + tn) * power(tp / CAST(tp + fn AS DOUBLE), 2) / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS gmean_pu,
    round((tp + fp + fn + tn) * power(tp / CAST(tp + fn AS DOUBLE), 2) / CAST(tp + fn AS DOUBLE), 6) AS recall_score"""
part("by_score", "scored", "SELECT p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY p")
part("roc", "by_score", """SELECT p AS score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE) AS tpr, sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE) AS fpr
    FROM by_score WINDOW w AS (ORDER BY p DESC)""")
part("trials", "scored", """SELECT CAST(t AS INTEGER) AS trial, count(*) FILTER (label = 1 AND p >= t / 10.0::DOUBLE) AS tp,
    count(*) FILTER (label = 0 AND p >= t / 10.0::DOUBLE) AS fp, count(*) FILTER (label = 1 AND NOT p >= t / 10.0::DOUBLE) AS fn,
    count(*) FILTER (label = 0 AND NOT p >= t / 10.0::DOUBLE) AS tn FROM scored, (SELECT unnest(range(10)) AS t) GROUP BY t""")

# ---------------------------------------------------------------- positive-unlabelled

part("pu_vec", "", """SELECT vec_id AS id, CASE label WHEN 0 THEN 1 ELSE 0 END AS s, generate_subscripts(embedding, 1) AS i,
    CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings""")
part("pu_center", "pu_vec", "SELECT s AS k, i, avg(v) AS v FROM pu_vec GROUP BY s, i")
part("pu_dist", "pu_vec pu_center", """SELECT e.id, e.s, c.k,
    1.0::DOUBLE - sum(e.v * c.v) / (sqrt(sum(e.v * e.v)) * sqrt(sum(c.v * c.v))) AS cosine, sqrt(sum((e.v - c.v) * (e.v - c.v))) AS euclidean
    FROM pu_vec e JOIN pu_center c ON c.i = e.i GROUP BY e.id, e.s, c.k""")
for _m in ("cosine", "euclidean"):
    part(f"pu_{_m}", "pu_dist", f"""SELECT id, s, max({_m}) FILTER (k = 0) AS d0, max({_m}) FILTER (k = 1) AS d1 FROM pu_dist GROUP BY id, s""")

# ---------------------------------------------------------------- sampling


def key(seed: int) -> str:
    return f"((id % 2147483648 + {seed}) * 2654435761) % 4294967296"


def numbered(source: str, by: str, seed: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {key(seed)}, id) AS rn FROM {source}"


part("fold_rn", "pl_row", numbered("pl_row", "s", 42))
part("noise_rn", "pl_row", numbered("pl_row", "s", 7))
part("noise_nm", "", """SELECT * FROM (VALUES (0,0,0.8::DOUBLE),(0,1,0.1),(0,2,0.0),(1,0,0.15),(1,1,0.85),(1,2,0.3),
    (2,0,0.05),(2,1,0.05),(2,2,0.7)) t(s, y, p)""")
part("noise_cells", "noise_nm pl_row", """SELECT m.s, m.y, c.n, CASE WHEN m.s = m.y THEN 0 ELSE
    CAST(floor(m.p * (c.n / CAST(c.total AS DOUBLE)) * c.total) AS BIGINT) END AS moves FROM noise_nm m
    JOIN (SELECT s AS y, count(*) AS n, sum(count(*)) OVER () AS total FROM pl_row GROUP BY s) c ON c.y = m.y""")
part("noise_bands", "noise_cells", """SELECT y, s, moves, n, sum(moves) OVER (PARTITION BY y ORDER BY s) AS upto,
    sum(moves) OVER (PARTITION BY y) AS total FROM noise_cells""")
part("over_rn", "pb_row", numbered("pb_row", "s", 3))
part("over_n", "pb_row", "SELECT s, count(*) AS n, max(count(*)) OVER () - count(*) AS short FROM pb_row GROUP BY s")
part("hold_rn", "pb_row", numbered("pb_row", "s", 5))

part("tq_row", "toxic_row", "SELECT id, s, least(1.0::DOUBLE, round(p1 * 1.4::DOUBLE, 6)) AS p1 FROM toxic_row")
part("tq", "tq_row", """SELECT id, s, 1 AS k, p1 AS p FROM tq_row
    UNION ALL SELECT id, s, 0, round(1.0::DOUBLE - p1, 6) FROM tq_row""")
part("tq_thr", "tq", "SELECT k, avg(p) AS t FROM tq WHERE s = k GROUP BY k")
part("pu_row", "", """SELECT vec_id AS id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS s,
    list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings""")
part("few_rn", "pu_row", "SELECT * FROM (" + numbered("pu_row", "s", 20) + ") WHERE s = 1")
part("few_n", "pu_row", "SELECT count(*) FILTER (s = 1) AS n, count(*) FILTER (s = 0) - count(*) FILTER (s = 1) AS short FROM pu_row")
part("few_near", "few_rn", """SELECT id, o, y, row_number() OVER (PARTITION BY id ORDER BY d, o) AS r FROM
    (SELECT a.id, b.id AS o, b.x AS y, list_distance(a.x, b.x) AS d FROM few_rn a JOIN few_rn b ON a.id <> b.id)""")
part("few_made", "few_rn few_n", f"""SELECT *, id * 4096 + copy AS k FROM (SELECT r.id, r.s, r.x, unnest(range(1, 1 + n.short // n.n
    + CASE WHEN r.rn <= n.short % n.n THEN 1 ELSE 0 END)) AS copy FROM few_rn r, few_n n)""")
part("bag_n", "pb_row", """SELECT CASE WHEN 2 * a <= n THEN 1 ELSE 0 END AS small,
    CAST(greatest(1, least(50, round((n - least(a, n - a)) / CAST(least(a, n - a) AS DOUBLE)))) AS BIGINT) AS n_bags
    FROM (SELECT count(*) AS n, count(*) FILTER (s = 1) AS a FROM pb_row)""")

SQL: dict[str, str] = {
    "class_counts": """SELECT CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS s,
        count(*) AS n FROM lineitem GROUP BY 1""",
    "noisy_prior": "SELECT label AS s, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS p FROM embeddings GROUP BY label",
    "imbalance_ratio": build("pb_row", """SELECT count(*) FILTER (s = 0) AS n0, count(*) FILTER (s = 1) AS n1,
        round(count(*) FILTER (s = 0) / CAST(count(*) FILTER (s = 1) AS DOUBLE), 6) AS ratio FROM pb_row"""),
    "class_thresholds": build("pl_thr", "SELECT k AS s, round(t, 6) AS t FROM pl_thr"),
    "class_thresholds_pe": build("pe_thr", "SELECT CAST(k AS INTEGER) AS s, round(t, 6) AS t FROM pe_thr"),
    "confident_joint": build("pe_cells", "SELECT s, y, n FROM pe_cells"),
    "confident_joint_pl": build("pl_cells", "SELECT s, y, n FROM pl_cells"),
    "calibrated_joint": build("pl_cj", "SELECT s, y, n FROM pl_cj"),
    "calibrated_joint_pe": build("pe_cj", "SELECT s, y, n FROM pe_cj"),
    "joint_distribution": build("pl_cj", "SELECT s, y, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS p FROM pl_cj"),
    "joint_report": build("pl_cj", """SELECT s, round(sum(p) FILTER (y = 0), 4) AS y_0, round(sum(p) FILTER (y = 1), 4) AS y_1,
        round(sum(p) FILTER (y = 2), 4) AS y_2, any_value(trace) AS trace FROM (SELECT s, y, p,
        round(sum(p) FILTER (s = y) OVER (), 4) AS trace FROM (SELECT s, y, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM pl_cj)) GROUP BY s"""),
    "num_label_errors": build("pe_cj", """SELECT CAST(floor((1.0::DOUBLE - sum(n) FILTER (s = y) / CAST(sum(n) AS DOUBLE))
        * sum(class_n) FILTER (s = y)) AS BIGINT) AS num_errors FROM pe_cj"""),
    "noise_matrix": build("pl_nm", "SELECT s, y, round(p, 6) AS p FROM pl_nm"),
    "inverse_noise_matrix": build("pl_inv", "SELECT s, y, round(p, 6) AS p FROM pl_inv"),
    "clipped_noise_matrix": build("pe_nm", clip_rates("pe_nm", "y")),
    "latent_prior_cnt": build("cpy_cnt", "SELECT y, round(p, 6) AS p FROM cpy_cnt"),
    "latent_prior_marginal": build("cpy_marginal", "SELECT y, round(p, 6) AS p FROM cpy_marginal"),
    "latent_prior_marginal_ps": build("cpy_marginal_ps", "SELECT y, round(p, 6) AS p FROM cpy_marginal_ps"),
    "bayes_inverse": build("pl_nm cpy_cnt pl_ps", clip_rates(
        "(SELECT m.s, m.y, m.p * c.p / ps.p AS p FROM pl_nm m JOIN cpy_cnt c ON c.y = m.y JOIN pl_ps ps ON ps.s = m.s)", "s")),
    "bayes_noise": build("pl_inv pl_ps", clip_rates(
        "(SELECT i.s, i.y, i.p * ps.p / sum(i.p * ps.p) OVER (PARTITION BY i.y) AS p FROM pl_inv i JOIN pl_ps ps ON ps.s = i.s)", "y")),
    "noise_free_class": build("pl_nm", """SELECT s, y, round(CASE WHEN s = y THEN 1.0::DOUBLE - sum(CASE WHEN s <> y THEN q ELSE 0.0 END)
        OVER (PARTITION BY y) ELSE q END, 6) AS p FROM (SELECT s, y, CASE WHEN s = 2 AND y <> 2 THEN 0.0 ELSE p END AS q FROM pl_nm)"""),
    "clean_posterior": build("pl pl_diag", """SELECT id, round(max(c / t) FILTER (k = 0), 6) AS p0, round(max(c / t) FILTER (k = 1), 6) AS p1,
        round(max(c / t) FILTER (k = 2), 6) AS p2 FROM (SELECT id, k, c, sum(c) OVER (PARTITION BY id) AS t FROM
        (SELECT p.id, p.k, least(greatest(p.p * (d.i / d.m), 0.0), 1.0) AS c FROM pl p JOIN pl_diag d ON d.s = p.k)) GROUP BY id"""),
    "learnability_check": build("pl_nm cpy_marginal", """SELECT abs(sum(j) - 1.0) < 1e-6 AND bool_and(CASE WHEN s = y THEN ps * py < j END) AS is_valid
        FROM (SELECT s, y, py, j, sum(j) OVER (PARTITION BY s) AS ps FROM (SELECT m.s, m.y, c.p AS py, m.p * c.p AS j
        FROM pl_nm m JOIN cpy_marginal c ON c.y = m.y))"""),
    "clip_values": build("pl", """SELECT id, round(max(x) FILTER (k = 0), 6) AS p0, round(max(x) FILTER (k = 1), 6) AS p1,
        round(max(x) FILTER (k = 2), 6) AS p2 FROM (SELECT id, k, c / sum(c) OVER (PARTITION BY id) AS x FROM
        (SELECT id, k, least(greatest(p, 0.1), 0.6)::DOUBLE AS c FROM pl)) GROUP BY id"""),
    "argmax_errors": build("pe_argmax", "SELECT id, s, y <> s AS is_error FROM pe_argmax"),
    "argmax_joint_errors": errors("pl", "pl_am_rate"),
    "argmax_calibrated_joint_errors": errors("pl", "pl_amc_class"),
    "argmax_confusion": build("pe_argmax", "SELECT s, CAST(y AS INTEGER) AS y, count(*) AS n FROM pe_argmax GROUP BY s, y"),
    "offdiag_errors": build("pl_guess", "SELECT id, s, y FROM pl_guess WHERE y <> s"),
    "prune_counts": build("pe_cnt", "SELECT s, y, n FROM pe_cnt"),
    "errors_by_noise_rate": errors("pl", "pl_rate"),
    "errors_by_class": errors("pl", "pl_class"),
    "errors_both": errors("pl", "pl_both"),
    "errors_by_noise_rate_pe": errors("pe", "pe_rate"),
    "errors_budget": errors("pl", "pl_budget_rate"),
    "errors_frac_noise": errors("pl", "pl_half_rate"),
    "ordered_errors_margin": ordered("own - top"),
    "ordered_errors_prob": ordered("own"),
    "prune_rows": build("pb_err", "SELECT id, s FROM pb_err WHERE NOT is_error"),
    "flip_labels": build("pb_err", "SELECT id, CASE WHEN is_error THEN 1 - s ELSE s END AS s FROM pb_err"),
    "sample_weights": build("pb_row pb_nm", f"""SELECT r.id, r.s, round(1.0::DOUBLE / c.p, 6) AS weight FROM pb_row r JOIN
        (SELECT s, p / sum(least(p, CASE WHEN s = y THEN p ELSE 0.9999 END)) OVER (PARTITION BY y) AS p, y FROM pb_nm) c ON c.s = r.s AND c.y = r.s"""),
    "self_confidence_scores": build("ev", "SELECT id, round(avg(p), 6) AS score FROM ev WHERE given GROUP BY id"),
    "multilabel_joint": build("ev_cells", "SELECT s, y, n FROM ev_cells"),
    "multilabel_joint_calibrated": build("ev_cj", "SELECT s, y, n FROM ev_cj"),
    "multilabel_f1": build("ev_curve", "SELECT round(b, 2) AS boundary, tp, fp, fn, round(f1, 6) AS f1 FROM ev_curve"),
    "multilabel_predict": build("ev_pred", "SELECT id, round(b, 2) AS boundary, predicted FROM ev_pred"),
    "multilabel_errors": build("evp_rate ev_pred", "SELECT p.id, f.flag AND NOT p.same AS is_error FROM ev_pred p JOIN evp_rate f USING (id)"),
    "silent_relabel": build("corrected", """SELECT file, release, CASE WHEN in_silent THEN 1 ELSE vulnerable END AS vulnerable,
        CASE WHEN in_silent THEN 'silent' ELSE 'given' END AS label_source FROM corrected"""),
    "latent_relabel": build("corrected", """SELECT file, release, CASE WHEN in_latent THEN 1 ELSE vulnerable END AS vulnerable,
        CASE WHEN in_latent THEN 'latent' ELSE 'given' END AS label_source FROM corrected"""),
    "composite_relabel": build("corrected", """SELECT file, release, CASE WHEN in_silent OR in_latent THEN 1 ELSE vulnerable END AS vulnerable,
        CASE WHEN in_latent THEN 'latent' WHEN in_silent THEN 'silent' ELSE 'given' END AS label_source FROM corrected"""),
    "hidden_positives": build("corrected", """SELECT release, vulnerable, in_silent OR in_latent AS hidden_positive, count(*) AS n
        FROM corrected GROUP BY ALL"""),
    "release_splits": build("label_rows", """SELECT DISTINCT release AS train, CASE WHEN release = 79 THEN 81 ELSE release + 1 END AS val,
        CASE release WHEN 78 THEN 81 WHEN 79 THEN 82 ELSE release + 2 END AS test FROM label_rows WHERE release <> 80"""),
    "file_stem": r"SELECT page_id AS id, replace(url, '\', '/') AS file, regexp_replace(replace(url, '\', '/'), '\.[^.]*$', '') AS stem FROM pages",
    "metric_rollup": """SELECT o.o_orderkey AS file, round(o.o_totalprice, 6) AS price, round(coalesce(c.quantity, 0), 6) AS quantity,
        round(coalesce(c.discount, 0), 6) AS discount, round(coalesce(f.a, 0), 6) AS tax_min, round(coalesce(f.b, 0), 6) AS tax_mean,
        round(coalesce(f.c, 0), 6) AS tax_max FROM orders o
        LEFT JOIN (SELECT l_orderkey, min(l_tax) AS a, avg(l_tax) AS b, max(l_tax) AS c FROM lineitem GROUP BY l_orderkey) f ON f.l_orderkey = o.o_orderkey
        LEFT JOIN (SELECT o_custkey, sum(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem
            JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) c ON c.o_custkey = o.o_custkey""",
    "clean_code": build("page_code", "SELECT id, code FROM page_code"),
    "replace_tokens": build("page_plain", "SELECT id, code FROM page_plain"),
    "token_counts": build("tok_n", "SELECT id, token, n FROM tok_n"),
    "vocab_topk": build("vocab", "SELECT token, total FROM vocab"),
    "labelled_text_scan": r"""SELECT '__label__' || toxic AS label, replace(regexp_replace(text, '\s+$', ''), chr(10), ' __newline__ ') AS text
        FROM documents JOIN labels USING (doc_id)""",
    "bow_vectors": build("page_plain tok_n vocab", """SELECT p.id AS file, CAST(count(v.token) AS INTEGER) AS n_tokens FROM page_plain p
        LEFT JOIN tok_n t ON t.id = p.id LEFT JOIN vocab v ON v.token = t.token GROUP BY p.id"""),
    "bow_l2": build("tok_n vocab", """SELECT t.id, t.token, round(t.n / sqrt(sum(CAST(t.n AS DOUBLE) * t.n) OVER (PARTITION BY t.id)), 6) AS w
        FROM tok_n t JOIN vocab v ON v.token = t.token"""),
    "binary_metrics": build("outcome", f"SELECT {METRICS} FROM outcome"),
    "pu_scores": build("outcome", f"SELECT recall, gmean_pu, recall_score FROM (SELECT {METRICS} FROM outcome)"),
    "hidden_recall": build("scored", """SELECT round(count(*) FILTER (hidden AND predicted = 1) / CAST(count(*) FILTER (hidden) AS DOUBLE), 6)
        AS recall_u FROM scored"""),
    "overall_recall": build("scored", """SELECT round(count(*) FILTER ((hidden OR label = 1) AND predicted = 1)
        / CAST(count(*) FILTER (hidden OR label = 1) AS DOUBLE), 6) AS recall_o FROM scored"""),
    "pu_f1": build("scored", """SELECT round(power(count(*) FILTER (p >= 0.5 AND label = 1) / CAST(count(*) FILTER (label = 1) AS DOUBLE), 2)
        / (2.0::DOUBLE * count(*) FILTER (p >= 0.5) / count(*)), 6) AS pu_f1 FROM scored"""),
    "transductive_scores": build("corrected", """SELECT release, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
        round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall,
        round(n * power(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 2) / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS gmean_pu FROM
        (SELECT release, count(*) FILTER (hid AND flagged) AS tp, count(*) FILTER (NOT hid AND flagged) AS fp,
        count(*) FILTER (hid AND NOT flagged) AS fn, count(*) AS n FROM (SELECT release, in_silent OR in_latent AS hid,
        (file + release) % 3 = 0 AS flagged FROM corrected WHERE in_silent OR in_latent OR vulnerable = 0) GROUP BY release)"""),
    "roc_points": build("roc", "SELECT score, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc"),
    "youden_threshold": build("roc", """SELECT score AS threshold, round(round(tpr - fpr, 9), 6) AS j FROM roc
        ORDER BY round(tpr - fpr, 9) DESC, score DESC LIMIT 1"""),
    "exact_auc": build("by_score", """SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS auc FROM
        (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_score)"""),
    "best_trial": build("trials", f"SELECT trial, mcc AS score FROM (SELECT trial, {METRICS} FROM trials) ORDER BY mcc DESC, trial LIMIT 1"),
    "precision_at_k": build("pe", """SELECT round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS precision FROM
        (SELECT s, k, row_number() OVER (PARTITION BY id ORDER BY p DESC, k) AS r FROM pe) WHERE s = k"""),
    "centroids": """SELECT s, count(*) AS n, CAST(i - 1 AS INTEGER) AS i, round(avg(v), 6) AS v FROM (SELECT label AS s,
        generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY s, i""",
    "centroid_distances": build("pu_cosine", "SELECT id, s, round(d0, 6) AS d0, round(d1, 6) AS d1 FROM pu_cosine"),
    "centroid_distances_euclidean": build("pu_euclidean", "SELECT id, s, round(d0, 6) AS d0, round(d1, 6) AS d1 FROM pu_euclidean"),
    "reliable_negatives": build("pu_cosine", "SELECT id, s FROM pu_cosine WHERE d0 < d1 OR s = 1"),
    "alpha_sweep": build("pu_cosine", """SELECT alpha, count(*) FILTER (d0 < alpha * d1 OR s = 1) AS kept,
        count(*) FILTER (s = 1) AS kept_positive FROM pu_cosine,
        (SELECT CAST(unnest([0.8, 0.9, 1.0, 1.1, 1.2]) AS DOUBLE) AS alpha) GROUP BY alpha"""),
    "stratified_folds": build("fold_rn", """SELECT id, s, CAST(rn > n // 5 AS INTEGER) + CAST(rn > 2 * n // 5 AS INTEGER) + CAST(rn > 3 * n // 5 AS INTEGER)
        + CAST(rn > 4 * n // 5 AS INTEGER) AS fold FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM fold_rn)"""),
    "noise_injection": build("noise_rn noise_bands", """SELECT r.id, r.s AS y, coalesce((SELECT min(b.s) FROM noise_bands b
        WHERE b.y = r.s AND b.total <= b.n AND b.moves > 0 AND r.rn <= b.upto), r.s) AS s FROM noise_rn r"""),
    "oversample": build("over_rn over_n", """SELECT id, s, CAST(unnest(range(0, 1 + CAST(extra AS BIGINT))) AS INTEGER) AS copy FROM
        (SELECT r.id, r.s, n.short // n.n + CASE WHEN r.rn <= n.short % n.n THEN 1 ELSE 0 END AS extra
        FROM over_rn r JOIN over_n n ON n.s = r.s)"""),
    "hold_out": build("hold_rn", """SELECT id, s, s = 1 AND rn <= ceil((SELECT count(*) FROM hold_rn WHERE s = 1) * 0.2::DOUBLE) AS held_out FROM hold_rn"""),
    "bags": build("pb_row", f"SELECT CAST({key(9)} % 15 AS INTEGER) AS bag, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM pb_row WHERE s = 0 GROUP BY 1"),
    "smote_rows": build("few_made few_near", f"""SELECT id, CAST(copy AS INTEGER) AS copy, s, CAST(i AS INTEGER) AS i, round(a + (b - a) * u, 6) AS v FROM
        (SELECT m.id, m.copy, m.s, unnest(range(len(m.x))) AS i, unnest(m.x) AS a, unnest(w.y) AS b, m.u
        FROM (SELECT *, ({key(21).replace("id", "k")}) % 2 + 1 AS pick, ({key(22).replace("id", "k")}) / 4294967296.0::DOUBLE AS u FROM few_made) m
        JOIN few_near w ON w.id = m.id AND w.r = m.pick)"""),
    "class_weights": build("pb_row", """SELECT s, n, round((SELECT count(*) FROM pb_row) / (2.0::DOUBLE * n), 6) AS balanced,
        CASE WHEN s = 1 THEN round((SELECT count(*) FROM pb_row WHERE s = 0) / CAST(n AS DOUBLE), 6) ELSE 1.0::DOUBLE END AS ratio
        FROM (SELECT s, count(*) AS n FROM pb_row GROUP BY s)"""),
    "balanced_bags": build("pb_row bag_n", f"""SELECT b.bag, count(*) FILTER (r.s = b.small) AS small, count(*) AS n, CAST(sum(r.id) AS BIGINT) AS id_sum
        FROM (SELECT CAST(unnest(range(n_bags)) AS INTEGER) AS bag, small, n_bags FROM bag_n) b
        JOIN pb_row r ON r.s = b.small OR {key(11)} % b.n_bags = b.bag GROUP BY b.bag"""),
    "pu_thresholds_joint": build("tq tq_thr", """SELECT g.s, g.y, CASE WHEN g.s = 0 AND g.y = 0 THEN 1
        WHEN g.s = 1 AND g.y = 0 THEN 0 ELSE n END AS n, round(max(CASE WHEN g.s = 0 AND g.y = 1 THEN g.n / CAST(g.t AS DOUBLE) END) OVER (), 6) AS unlabelled_share
        FROM (SELECT s, y, n, sum(n) OVER (PARTITION BY s) AS t FROM (SELECT a.s, b.y, count(r.id) AS n
        FROM (SELECT unnest([0, 1]) AS s) a CROSS JOIN (SELECT unnest([0, 1]) AS y) b LEFT JOIN
        (SELECT id, any_value(s) AS s, CASE WHEN count(*) FILTER (c) = 0 THEN NULL WHEN count(*) FILTER (c) = 1 THEN min(k) FILTER (c)
            ELSE first(k ORDER BY p DESC, k) END AS y FROM (SELECT x.*, x.p >= CASE WHEN x.k = 1 THEN 1.0::DOUBLE ELSE t.t END - 1e-6 AS c
            FROM tq x JOIN tq_thr t USING (k)) GROUP BY id) r ON r.s = a.s AND r.y = b.y GROUP BY a.s, b.y)) g"""),
}


# ---------------------------------------------------------------- sources, sinks and all releases

def _raw_metric_features() -> str:
    from labelsift.operators import rollup

    names = [*rollup.FILE_FIRST, *rollup.CLASS_SUM, *rollup.CLASS_MEAN, *rollup.FUNCTION_SPREAD]
    value = {m: f"CAST(((l_partkey + CAST(l_quantity AS BIGINT)) * {i + 3}) % 101 AS DOUBLE)" for i, m in enumerate(names)}
    place = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
    first = ", ".join(f"first({value[m]} ORDER BY {place}) AS {m}" for m in rollup.FILE_FIRST)
    of_class = ", ".join([*(f"sum({value[m]}) AS {m}" for m in rollup.CLASS_SUM), *(f"avg({value[m]}) AS {m}" for m in rollup.CLASS_MEAN)])
    spread = ", ".join(f"{f}({value[m]}) AS {m}_{how}" for how, f in (("Min", "min"), ("Mean", "avg"), ("Max", "max")) for m in rollup.FUNCTION_SPREAD)
    out = ", ".join(f"round(coalesce({c}, 0), 6) AS {c.lower()}" for c in rollup.metric_columns())
    return f"""WITH f AS (SELECT l_orderkey, {first} FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1),
        g AS (SELECT l_orderkey, {spread} FROM lineitem WHERE l_linenumber % 3 = 1 GROUP BY 1),
        c AS (SELECT l_orderkey // 2 AS half, {of_class} FROM lineitem WHERE l_linenumber % 3 = 2 GROUP BY 1)
        SELECT 'src/' || (o_orderkey // 2) % 10 || '/f' || o_orderkey // 2 || CASE WHEN o_orderkey % 2 = 0 THEN '.cpp' ELSE '.h' END AS file,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS vulnerable, {out}
        FROM orders LEFT JOIN f ON f.l_orderkey = o_orderkey LEFT JOIN g ON g.l_orderkey = o_orderkey LEFT JOIN c ON c.half = o_orderkey // 2"""


SQL |= {
    "transductive_report": build("rel_masks", """SELECT release, technique, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
        round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall,
        round(n * power(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 2) / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS gmean_pu FROM
        (SELECT release, technique, count(*) FILTER (hid AND flagged) AS tp, count(*) FILTER (NOT hid AND flagged) AS fp,
        count(*) FILTER (hid AND NOT flagged) AS fn, count(*) AS n FROM rel_masks WHERE (hid OR s = 0) AND release <> 80 GROUP BY ALL)"""),
    "overall_recall_runs": build("rel_runs", """SELECT CAST(release AS INTEGER) AS release, technique,
        round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
        round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
        round(coalesce(hit / nullif(CAST(truths AS DOUBLE), 0), 0), 6) AS recall_o FROM (SELECT release, technique, count(*) FILTER (t AND q) AS tp,
        count(*) FILTER (NOT t AND q) AS fp, count(*) FILTER (t AND NOT q) AS fn, count(*) FILTER (NOT t AND NOT q) AS tn,
        count(*) FILTER (truth AND q) AS hit, count(*) FILTER (truth) AS truths FROM rel_runs GROUP BY ALL)"""),
    "raw_metric_features": _raw_metric_features(),
    "label_sources": build("corrected", """SELECT release, CASE WHEN in_latent THEN 'latent' WHEN in_silent THEN 'silent' ELSE 'given' END AS label_source,
        count(*) AS n, CAST(sum(CASE WHEN in_silent OR in_latent THEN 1 ELSE vulnerable END) AS BIGINT) AS positives FROM corrected GROUP BY ALL"""),
    "side_tables_by_release": build("silent_rows latent_rows", """SELECT CAST(coalesce(x.release, y.release) AS INTEGER) AS release, coalesce(silent, 0) AS silent, coalesce(latent, 0) AS latent
        FROM (SELECT release, count(*) AS silent FROM silent_rows GROUP BY release) x FULL JOIN
        (SELECT release, count(DISTINCT file) AS latent FROM (SELECT file, unnest(range(a, b + 1)) AS release FROM latent_rows) GROUP BY release) y ON x.release = y.release"""),
    "feature_sources": build("rel_rows", """SELECT file, release, s AS vulnerable, a AS quantity, b AS items, c AS tax FROM rel_rows WHERE release IN (63, 64, 65)"""),
    "labelled_text_index": r"""SELECT record, '__label__' || toxic AS label, record % 3 = 0 AS chosen,
        length(trim(replace(regexp_replace(t, '[\x20\x09-\x0D]+$', ''), chr(10), ' __newline__ '))) AS n_chars
        FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS record, toxic, replace(text, '__label__', 'label') AS t
        FROM documents JOIN labels USING (doc_id))""",
    "checked_accuracy": build("pe_argmax", """SELECT round(avg(CASE WHEN y = s THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy,
        round(sum(CASE WHEN y = s THEN id % 3 + 1.0::DOUBLE ELSE 0.0 END) / sum(id % 3 + 1.0::DOUBLE), 6) AS weighted FROM pe_argmax"""),
}

# Cramer's rule for three classes.
part("eqn_row", "pl_nm pl_ps", "SELECT " + ", ".join(f"max(m.p) FILTER (m.s = {a} AND m.y = {b}) AS m{a}{b}" for a in range(3) for b in range(3)) + ", "
     + ", ".join(f"max(ps.p) FILTER (ps.s = {a}) AS v{a}" for a in range(3)) + " FROM pl_nm m JOIN pl_ps ps ON ps.s = m.s")


def _determinant(swapped: int | None) -> str:
    c = lambda a, b: f"v{a}" if b == swapped else f"m{a}{b}"
    return " + ".join(f"{c(0, i)} * ({c(1, j)} * {c(2, k)} - {c(1, k)} * {c(2, j)})" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))


part("eqn_p", "eqn_row", " UNION ALL ".join(f"SELECT {y} AS y, greatest(least(({_determinant(y)}) / ({_determinant(None)}), 1.0), 1e-5) AS p FROM eqn_row" for y in range(3)))


def _converged() -> str:
    """Three times five alternations between P(y|s) and P(y), after each five P(s|y) anew."""
    part("agree_nm0", "pl_nm", "SELECT s, y, c / sum(c) OVER (PARTITION BY y) AS p FROM (SELECT s, y, CASE WHEN s = y THEN p ELSE least(greatest(p, 0.0), 0.9999) END AS c FROM pl_nm)")
    part("agree_py0", "cpy_cnt", "SELECT y, p FROM cpy_cnt")
    step = 0
    for outer in range(3):
        for _ in range(5):
            nm, py, inv = f"agree_nm{outer}", f"agree_py{step}", f"agree_inv{step + 1}"
            part(inv, f"{nm} {py} pl_ps", f"""SELECT s, y, c / sum(c) OVER (PARTITION BY s) AS p FROM (SELECT m.s, m.y, CASE WHEN m.s = m.y THEN m.p * q.p / ps.p
                ELSE least(greatest(m.p * q.p / ps.p, 0.0), 0.9999) END AS c FROM {nm} m JOIN {py} q ON q.y = m.y JOIN pl_ps ps ON ps.s = m.s)""")
            part(f"agree_py{step + 1}", f"{inv} {nm} pl_ps", f"""SELECT y, c / sum(c) OVER () AS p FROM (SELECT i.y, least(greatest(i.p / m.p * ps.p, 1e-5), 1.0) AS c
                FROM {inv} i JOIN {nm} m ON m.s = i.s AND m.y = i.y JOIN pl_ps ps ON ps.s = i.s WHERE i.s = i.y)""")
            step += 1
        part(f"agree_nm{outer + 1}", f"agree_inv{step} agree_py{step} pl_ps", f"""SELECT s, y, c / sum(c) OVER (PARTITION BY y) AS p FROM (SELECT i.s, i.y,
            CASE WHEN i.s = i.y THEN i.p * ps.p / q.p ELSE least(greatest(i.p * ps.p / q.p, 0.0), 0.9999) END AS c
            FROM agree_inv{step} i JOIN pl_ps ps ON ps.s = i.s JOIN agree_py{step} q ON q.y = i.y)""")
    return build("agree_nm3", "SELECT s, y, round(p, 6) AS p FROM agree_nm3").replace(" AS (", " AS MATERIALIZED (")


SQL |= {
    "latent_prior_eqn": build("eqn_p", "SELECT y, round(p / sum(p) OVER (), 6) AS p FROM eqn_p"),
    "latent_converged": _converged(),
    "prior_forcing_joint": build("pl_cj", "SELECT s, y, n FROM pl_cj"),
    "embedded_pages": build("page_plain", f"""SELECT id, CAST(i AS INTEGER) AS i, round((sum((h % 997 * (2 * i + 1)) % 17 - 8) + (2 * i + 1) % 17 - 8) / (count(h) + 1.0::DOUBLE), 6) AS v
        FROM (SELECT id, unnest(range(8)) AS i, t FROM (SELECT id, regexp_extract_all(code, {_token_pattern()})[1:511] AS t FROM page_plain))
        LEFT JOIN LATERAL (SELECT length(w) * 31 + ascii(w) AS h FROM (SELECT unnest(t) AS w)) ON TRUE GROUP BY id, i"""),
}

SQL |= {
    "gaussian_cv_probabilities": build("nbcv_p nb_fold", "SELECT p.id, p.s, f.fold, round(p.p, 6) AS p FROM nbcv_p p JOIN nb_fold f USING (id)"),
    "gaussian_noisy_label_fit": build("nbfit_p nb_kept", "SELECT p.id, p.s, k.is_error, round(p.p, 6) AS p FROM nbfit_p p JOIN nb_kept k USING (id)"),
    "gaussian_elkan_noto": build("nben_p nben_held", """SELECT p.id, p.s, round(p.p / c.c, 6) AS p FROM nben_p p,
        (SELECT avg(p.p) AS c FROM nben_p p JOIN nben_held h ON h.id = p.id AND h.held) c"""),
}

SQL |= {
    "gaussian_bagging_pu": build("nbbag_p", "SELECT id // 15 AS id, any_value(s) AS s, round(avg(p), 6) AS p FROM nbbag_p GROUP BY id // 15"),
    "gaussian_two_stage_pu": build("nbtwo_out", "SELECT id, s, alpha, round(p, 6) AS p FROM nbtwo_out"),
    "gaussian_label_propagation": build("nbprop_p", "SELECT id, s, round(p, 6) AS p FROM nbprop_p"),
}
