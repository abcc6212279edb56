"""Personal data: base patterns and a skip-chain conditional random field that extends them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.session import ship_package

# The kinds in their order, and their patterns. The first two start where a run of their first characters
# starts, which is where the leftmost match of the plain pattern starts, so that long runs stay linear.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
TOKEN_REST = re.compile(r"[0-9@]\S*")
NOT_DIGIT = re.compile(r"[^0-9]+")
DIGIT, LETTERS, WORD = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+"), re.compile(r"\S+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LABELS = 1 + len(KINDS)  # 0: none
EDGE = "\"'()[]{}<>,;:!?.|"
LEAST_SAME = 5  # digits that make two tokens the same
LEAST_TAIL = 7  # last digits that make two tokens similar
PRIOR_AGREEMENT = 4.0
PRIOR_PULL = 0.05


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            done = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, end, kind`` of every base match, by start, then kind."""
    if not ANY.search(text):
        return []
    out = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255
    out += [(*m.span(), 1) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        out += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


@dataclass
class Graph:
    """Tokens with a digit or an at sign: features, observed labels (0: not observed), and edges."""

    spans: list = field(default_factory=list)
    features: list = field(default_factory=list)
    seen: list = field(default_factory=list)
    chain: list = field(default_factory=list)
    skip: list = field(default_factory=list)


def named(word: str) -> str:
    """The word itself, or its hash if it is long: names of features stay short, whole words count."""
    return word if len(word) <= 64 else f"#{xxhash.xxh64_hexdigest(word.encode('utf-8', 'surrogatepass'))}"


def shape(core: str) -> str:
    return named(LETTERS.sub("a", DIGIT.sub("0", core)))


def word_before(text: str, start: int) -> str:
    stop = start
    while stop > 0 and text[stop - 1].isspace():
        stop -= 1
    at = stop
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return text[at:stop]


def word_after(text: str, end: int) -> str:
    m = WORD.search(text, end)
    return m[0] if m else ""


def graph(text: str, base: list[tuple[int, int, int]], g: Graph | None = None) -> Graph:
    """The variables of one text, added to ``g``. All other words are observed as none and enter as context.

    A token is linked to the next word if that is a token (chain), and to the next occurrence of its digits, of their
    last seven, or of its address (skip), so repetitions are linked through one another, not pairwise.
    """
    g = g if g is not None else Graph()
    last_key: dict[str, int] = {}
    b, before = 0, -1
    for m in TOKEN_REST.finditer(text):
        start = m.start()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        token = text[start:m.end()]
        lead = len(token) - len(token.lstrip(EDGE))
        core = token.strip(EDGE)
        if not ANY.search(core):
            continue
        lo, hi = start + lead, start + lead + len(core)
        while b < len(base) and base[b][1] <= lo:
            b += 1
        label = next((k + 1 for s, e, k in base[b:b + 4] if s < hi and e > lo), 0)
        digits = NOT_DIGIT.sub("", core)
        n = len(g.spans)
        g.spans.append((lo, hi))
        g.seen.append(label)
        g.features.append([f"shape:{shape(core)}", f"digits:{min(20, len(digits))}", f"at:{'@' in core}", f"plus:{'+' in core}", f"letters:{any(c.isalpha() for c in core)}",
                           f"before:{named(word_before(text, start).strip(EDGE).lower())}", f"after:{named(word_after(text, m.end()).strip(EDGE).lower())}"])
        if before >= 0 and text[g.spans[before][1]:lo].strip(EDGE).isspace():
            g.chain.append((before, n))
        before = n
        keys = ["@" + core.lower()] if "@" in core else ["=" + digits] * (len(digits) >= LEAST_SAME) + ["~" + digits[-LEAST_TAIL:]] * (len(digits) >= LEAST_TAIL)
        linked = set()
        for key in keys:
            other = last_key.get(key)
            if other is not None and other not in linked:
                g.skip.append((other, n))
                linked.add(other)
            last_key[key] = n
    return g


@dataclass
class Field:
    """Weights: features to labels, neighbouring labels, labels across a skip edge."""

    index: dict[str, int]
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def potentials(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), LABELS))
        for i, names in enumerate(features):
            known = [self.index[n] for n in names if n in self.index]
            if known:
                out[i] = self.node[known].sum(axis=0)
        return out + self.node[-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(model: Field, g: Graph, rounds: int = 12, damping: float = 0.5) -> np.ndarray:
    """Loopy sum-product beliefs; observed tokens hold their label."""
    theta = model.potentials(g.features)
    seen = np.array(g.seen, dtype=np.int64)
    theta[seen > 0] = -1e6
    theta[np.flatnonzero(seen), seen[seen > 0]] = 0.0
    edges = np.array(g.chain + g.skip, dtype=np.int64).reshape(-1, 2)
    pair = np.concatenate([np.repeat(model.chain[None], len(g.chain), 0), np.repeat(model.skip[None], len(g.skip), 0)])
    source, to = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
    messages, half = np.zeros((len(to), LABELS)), len(edges)
    belief = theta
    for _ in range(rounds if len(edges) else 0):
        belief = theta.copy()
        np.add.at(belief, to, messages)
        without = belief[source] - np.concatenate([messages[half:], messages[:half]])
        new = log_sum(without[:, :, None] + pair, 1)
        new -= log_sum(new, 1)[:, None]
        messages = damping * messages + (1 - damping) * new
    if len(edges):
        belief = theta.copy()
        np.add.at(belief, to, messages)
    return np.exp(belief - log_sum(belief, 1)[:, None])


def train(docs: DataFrame, sample: int = 20_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", least_rows: int = 3,
          rounds: int = 300, l2: float = 1e-3, most_tokens: int = 60_000) -> Field | None:
    """Pseudo-likelihood fit with base matches as labels, on the ``sample`` documents with the smallest seeded hash of
    their id and at most ``most_tokens`` of their tokens. Agreement across skip edges has a prior, as repeats are rare.
    None if the sample has no base match."""
    ship_package(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "id", "left_semi")  # at most ``sample`` ids

    def run(batches):
        for batch in batches:
            found: list[tuple] = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                g = graph(text, base_spans(text))
                left, right, skip = (np.zeros((len(g.seen), LABELS), np.int64) for _ in range(3))
                for i, j in g.chain:
                    left[j, g.seen[i]] += 1
                    right[i, g.seen[j]] += 1
                for i, j in g.skip:
                    skip[i, g.seen[j]] += 1
                    skip[j, g.seen[i]] += 1
                found += [(ident, i, f, y, a.tolist(), b.tolist(), c.tolist()) for i, (f, y, a, b, c) in enumerate(zip(g.features, g.seen, left, right, skip))]
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "at", "features", "y", "l", "r", "s"), x)) for x in found], schema=pa.schema([
                ("id", batch.schema.field(0).type), ("at", pa.int32()), ("features", pa.list_(pa.string())), ("y", pa.int32()), *((k, pa.list_(pa.int64())) for k in "lrs")]))

    kind = rows.schema["id"].dataType.simpleString()
    tokens = rows.mapInArrow(run, f"id {kind}, at int, features array<string>, y int, l array<bigint>, r array<bigint>, s array<bigint>")
    # one order whatever the partitions: the same tokens in the same order give the same field
    got = tokens.orderBy(F.xxhash64(F.lit(seed), "id"), "id", "at", "features", "y", "l", "r", "s").limit(most_tokens).toPandas()
    if not len(got) or not (got["y"] > 0).any():
        return None
    counts: dict[str, int] = {}
    for names in got["features"]:
        for name in names:
            counts[name] = counts.get(name, 0) + 1
    index = {name: i for i, name in enumerate(sorted(n for n, c in counts.items() if c >= least_rows))}
    known = [[index[n] for n in names if n in index] for names in got["features"]]
    row, col = np.repeat(np.arange(len(known)), list(map(len, known))), np.array([i for k in known for i in k], dtype=np.int64)
    y = np.eye(LABELS)[got["y"].to_numpy()]
    left, right, skip = (np.array(got[k].tolist(), dtype=float) for k in "lrs")
    prior = np.eye(LABELS) * PRIOR_AGREEMENT
    params = [np.zeros((len(index) + 1, LABELS)), np.zeros((LABELS, LABELS)), prior.copy()]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        node, chain, across = params
        score = np.zeros_like(y) + node[-1]
        np.add.at(score, row, node[col])
        score += left @ chain + right @ chain.T + skip @ across
        d = (np.exp(score - log_sum(score, 1)[:, None]) - y) / len(y)
        g_node = np.concatenate([np.zeros((len(index), LABELS)), d.sum(axis=0, keepdims=True)])
        np.add.at(g_node, col, d[row])
        g_skip = skip.T @ d
        grads = [g_node + l2 / len(y) * node, left.T @ d + d.T @ right + l2 * chain, (g_skip + g_skip.T) / 2 + PRIOR_PULL * (across - prior)]
        for p, g, a, b in zip(params, grads, m1, m2):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= 0.1 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return Field(index, *params)


def extended(texts: list[str], model: Field | None, threshold: float) -> list[tuple[list, list]]:
    """Per text: base spans, and base plus added ones. Messages of all texts pass at once; no edge leaves a text."""
    bases, g, owner = [base_spans(t) for t in texts], Graph(), []
    for i, (t, base) in enumerate(zip(texts, bases)):
        if model is not None and ANY.search(t):
            own = graph(t, base)
            at = len(g.spans)
            g.spans += own.spans
            g.features += own.features
            g.seen += own.seen
            g.chain += [(a + at, b + at) for a, b in own.chain]
            g.skip += [(a + at, b + at) for a, b in own.skip]
            owner += [i] * len(own.spans)
    added: list[list] = [[] for _ in texts]
    if g.spans:
        belief = marginals(model, g)
        label = belief.argmax(axis=1)
        chosen = (label > 0) & (belief.max(axis=1) >= threshold) & (np.array(g.seen) == 0)
        follows, last = {b: a for a, b in g.chain}, -1
        for n in np.flatnonzero(chosen):
            (lo, hi), k, mine = g.spans[n], int(label[n]) - 1, added[owner[n]]
            if mine and last >= 0 and follows.get(int(n)) == last and mine[-1][2] == k:
                mine[-1] = (mine[-1][0], hi, k)
            else:
                mine.append((lo, hi, k))
            last = int(n)
    return [(base, sorted(base + more, key=lambda x: (x[0], x[2], x[1]))) for base, more in zip(bases, added)]


def find(docs: DataFrame, model: Field | None, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``base`` and ``spans`` (arrays of ``kind, start, end`` in code points, end exclusive) of whole texts.

    Base matches are found by linear scans, always stay, and are what the field observes; it adds tokens whose belief
    in a kind is at least ``threshold``, neighbours with one label joined. No model: base matches only. Null text:
    empty. Repeated rows keep a row each. A narrow projection of the scan: no shuffle, memory bounded by a batch.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    span = "array<struct<kind:string,start:int,end:int>>"

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans]
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                found = extended([t or "" for t in part.column(1).to_pylist()], shared.value, threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([named(b) for b, _ in found], kind), pa.array([named(s) for _, s in found], kind)],
                                                 names=["id", "base", "spans"])

    out = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {out}, base {span}, spans {span}")
