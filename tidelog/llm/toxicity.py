"""Operator 8: toxicity by a linear-chain conditional random field.

Labels are of documents; tokens get theirs from them: first, a token of a toxic document is toxic if
its word or one of its beginnings is much more frequent in toxic documents than in others; then a
chain is trained, and its own marginals on the toxic documents give the labels of the next round, in
which each toxic document keeps at least its likeliest token. A chain has two states; its features
are the word and its beginnings of PREFIXES letters.

Scoring runs forward-backward over a whole document. Tokens without a feature all have the same
potentials, so stretches of them are powers of one matrix, and work is done only at the others; the
marginals are those of the whole chain. A document's score is a logistic function, fitted on the
training rows, of the sum, the largest and the mean of its marginals, where tokens without a feature
count as 0; offending offsets are the runs of tokens with a marginal of at least 0.5.

Training runs on the driver, on a sample bounded in all respects: at most MAX_ROWS labelled rows of
either class, in the order of a hash of doc_id, from the rows that `held_out` leaves; none of more than
MAX_BYTES / 100, and MAX_BYTES of text in all; the MAX_FEATURES words and beginnings that speak most for
toxic text; and of their windows of WINDOW tokens those with such a feature and about PLAIN_WINDOWS
others. Scoring has no bound: every whole text is read.

Labels, lang, source and doc_id are no inputs. Defined results: null and empty text score as no token; a
doc_id labelled twice counts as toxic if either label does; null labels are left out; without both
classes to learn from every score is the share of toxic rows (0 if there are no rows); ties in the
sample's order go by doc_id, then a hash of the text; repeated rows are rows each; an empty table gives
an empty result; other columns, whatever their names, are not read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, ship, stored, text_of

WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)
MAX_ROWS, MAX_BYTES, MAX_FEATURES, WINDOW, PLAIN_WINDOWS = 2500, 32 << 20, 50_000, 64, 3000
ROUNDS, STEPS, L2 = 2, 40, 1e-3
CUT, KEPT = 0.3, 150_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    change: tuple[float, float, float] = (0.0, 0.0, 0.0)  # log potentials of 0-1, 1-0, 1-1; 0-0 has 0
    document: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    constant: float | None = None

    def token(self, word: str) -> float:
        """What a token adds to the bias: 0 where it has no feature."""
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word.lower()))


class Tagger:
    """Marginals of documents under a model."""

    def __init__(self, model: Model):
        self.model = model
        a, b, c = map(math.exp, model.change)
        self.step = np.array([[1.0, a], [b, c]])
        plain = self.step @ np.diag([1.0, math.exp(model.bias)])
        ratio = abs(np.linalg.eigvals(plain))
        far = ratio.min() / ratio.max()
        # beyond so many plain tokens a power equals its limit in double precision
        self.far = min(4096, 2 + int(-40 / math.log(far))) if 0 < far < 1 else 4
        power, self.gaps = np.eye(2), []
        for _ in range(self.far + 1):
            self.gaps.append(tuple(power.reshape(-1).tolist()))
            power = power @ plain
            power /= power.sum()
        outer = self

        class Memo(dict):
            def __missing__(self, word: str) -> float:
                if len(self) >= KEPT:
                    self.clear()
                x = self[word] = outer.model.token(word)
                return x

        self.memo = Memo()

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens have features, and the probability of state 1 there."""
        at = np.flatnonzero(scores)
        if not len(at):
            return at, np.empty(0)
        (_, a), (b, c) = self.step.tolist()
        bias = self.model.bias
        emit = [math.exp(min(50.0, bias + s)) for s in scores[at].tolist()]
        gaps = [self.gaps[min(g, self.far)] for g in np.diff(np.concatenate([[-1], at, [len(scores)]])) - 1]
        ahead = []
        # the first token has a change into it like any other, from either state alike
        x, y = 1.0, 1.0
        for g, e in zip(gaps, emit):
            x, y = x * g[0] + y * g[2], x * g[1] + y * g[3]
            x, y = x + y * b, (x * a + y * c) * e
            t = x + y
            x, y = x / t, y / t
            ahead.append((x, y))
        out = [0.0] * len(emit)
        u, v = gaps[-1][0] + gaps[-1][1], gaps[-1][2] + gaps[-1][3]
        for k in range(len(emit) - 1, -1, -1):
            x, y = ahead[k]
            out[k] = y * v / (x * u + y * v)
            e, g = emit[k], gaps[k]
            u, v = u + a * e * v, b * u + c * e * v
            u, v = g[0] * u + g[1] * v, g[2] * u + g[3] * v
            t = u + v
            u, v = u / t, v / t
        return at, np.array(out)

    def read(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        words = WORD.findall(text)
        scores = np.fromiter(map(self.memo.__getitem__, words), float, len(words))
        return len(words), *self.marginals(scores)

    def score(self, summary: tuple[float, ...]) -> float:
        if self.model.constant is not None:
            return self.model.constant
        z = sum(w * x for w, x in zip(self.model.document, summary))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def summary(n: int, marginals: np.ndarray) -> tuple[float, float, float, float]:
    total = float(marginals.sum())
    return 1.0, math.log1p(total), float(marginals.max()) if len(marginals) else 0.0, total / max(1, n) * 10


def spans(text: str, at: np.ndarray, marginals: np.ndarray) -> list[tuple[int, int]]:
    hit = set(at[marginals >= 0.5].tolist())
    out: list[tuple[int, int]] = []
    last = -2
    if hit:
        for k, m in enumerate(WORD.finditer(text)):
            if k in hit:
                if last == k - 1:
                    out[-1] = (out[-1][0], m.end())
                else:
                    out.append((m.start(), m.end()))
                last = k
    return out


def _forward_backward(emit: np.ndarray, size: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 (n x length) and expected counts of the changes 0-1, 1-0, 1-1, of many
    sequences at once. emit: log potentials of state 1; size: their lengths."""
    n, length = emit.shape
    a, b, c = np.exp(change)
    e = np.exp(np.clip(emit, -50, 50))
    inside = np.arange(length) < size[:, None]
    fx, fy = np.empty((length, n)), np.empty((length, n))
    x, y = np.ones(n), np.ones(n)
    for t in range(length):
        x, y = x + y * b, (x * a + y * c) * e[:, t]
        s = x + y
        x, y = x / s, y / s
        fx[t], fy[t] = x, y
    marginal = np.zeros((n, length))
    u, v = np.ones(n), np.ones(n)
    counts = np.zeros(3)
    for t in range(length - 1, -1, -1):
        live = inside[:, t]
        z = fx[t] * u + fy[t] * v
        marginal[:, t] = np.where(live, fy[t] * v / z, 0)
        px, py = (fx[t - 1], fy[t - 1]) if t else (np.ones(n), np.ones(n))
        ev = e[:, t] * v
        edge = np.stack([px * a * ev, py * b * u, py * c * ev])
        counts += (edge / (edge.sum(axis=0) + px * u) * live).sum(axis=1)
        nu, nv = u + a * ev, b * u + c * ev
        s = nu + nv
        u, v = np.where(live, nu / s, 1.0), np.where(live, nv / s, 1.0)
    return marginal, counts


def train(rows: list[tuple[str, int]], seed: int = 5) -> Model:
    """rows: (text, toxic)."""
    toxic = sum(y for _, y in rows)
    if not toxic or toxic == len(rows):
        return Model(constant=toxic / len(rows) if rows else 0.0)
    types: dict[str, int] = {}
    docs = [np.fromiter((types.setdefault(w.lower(), len(types)) for w in WORD.findall(t)), np.int32) for t, _ in rows]
    label = np.array([y for _, y in rows])
    words = list(types)
    in_docs: list[Counter] = [Counter(), Counter()]
    for d, y in zip(docs, label):
        in_docs[y].update({f for k in np.unique(d).tolist() for f in features(words[k])})
    share = [max(1, int((label == y).sum())) for y in (0, 1)]
    odds = {f: math.log((n + 0.1) / (share[1] + 0.2)) - math.log((in_docs[0][f] + 0.1) / (share[0] + 0.2)) for f, n in in_docs[1].items() if n >= 2}
    chosen = sorted((f for f, o in odds.items() if o >= 1.5), key=lambda f: (-odds[f] * in_docs[1][f], f))[:MAX_FEATURES]
    number = {f: k for k, f in enumerate(chosen)}
    pairs = [(k, number[f]) for k, w in enumerate(words) for f in features(w) if f in number]
    of_type, of_feature = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
    active = np.zeros(len(words), bool)
    active[of_type] = True
    # a beginning counts as evidence where nearly all that it begins is toxic
    strong = np.zeros(len(words))
    np.maximum.at(strong, of_type, np.array([odds[f] for f in chosen])[of_feature] if len(chosen) else 0.0)

    windows, owner, offset = [], [], []
    rng = np.random.default_rng(seed)
    for k, d in enumerate(docs):
        for at in range(0, len(d), WINDOW):
            w = d[at : at + WINDOW]
            if active[w].any() or rng.random() < PLAIN_WINDOWS * WINDOW / max(1, sum(map(len, docs[:200])) / min(200, len(docs)) * len(docs)):
                windows.append(w)
                owner.append(k)
                offset.append(at)
    if not windows:
        return Model(constant=toxic / len(rows))
    size, owner = np.array(list(map(len, windows))), np.array(owner)
    grid = np.zeros((len(windows), WINDOW), np.int64)
    for k, w in enumerate(windows):
        grid[k, : len(w)] = w
    inside = np.arange(WINDOW) < size[:, None]
    poison = (label[owner] == 1)[:, None] & inside
    y = poison & (strong[grid] >= 3.0)

    weights, bias, change = np.zeros(len(chosen)), -4.0, np.zeros(3)
    for turn in range(ROUNDS):
        theta = np.concatenate([weights, [bias], change])
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        before = np.concatenate([np.zeros((len(y), 1), bool), y[:, :-1]], axis=1)
        first = np.zeros_like(y)
        first[:, 0] = True
        seen = np.array([(~before & ~first & y).sum(), (before & ~y & inside).sum(), (before & y).sum()], float)
        for step in range(1, STEPS + 1):
            weights, bias, change = theta[:-4], theta[-4], theta[-3:]
            by_type = np.bincount(of_type, weights=weights[of_feature], minlength=len(words))
            marginal, counts = _forward_backward(bias + by_type[grid], size, change)
            off = np.where(inside, y - marginal, 0.0)
            per_type = np.bincount(grid.reshape(-1), weights=off.reshape(-1), minlength=len(words))
            gradient = np.concatenate([np.bincount(of_feature, weights=per_type[of_type], minlength=len(chosen)), [off.sum()], seen - counts]) / len(windows) - L2 * theta
            m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient**2
            theta = theta + 0.25 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            theta[-3:] = np.clip(theta[-3:], -5, 5)
        weights, bias, change = theta[:-4], float(theta[-4]), theta[-3:]
        if turn + 1 < ROUNDS:
            by_type = np.bincount(of_type, weights=weights[of_feature], minlength=len(words))
            marginal, _ = _forward_backward(bias + by_type[grid], size, change)
            y = poison & (marginal >= 0.5) & active[grid]
            most = np.zeros(len(docs))
            np.maximum.at(most, owner, np.where(poison & active[grid], marginal, 0.0).max(axis=1))
            y |= poison & active[grid] & (marginal > 0) & (marginal >= most[owner][:, None])

    model = Model({f: round(float(w), 6) for f, w in zip(chosen, weights) if abs(w) > 1e-3}, bias, tuple(map(float, change)))
    tagger = Tagger(model)
    x = []
    for text, _ in rows:
        n, _, marginals = tagger.read(text)
        x.append(summary(n, marginals))
    x, w = np.array(x), np.array([-3.0, 1.0, 1.0, 0.0])
    for _ in range(50):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        d = np.linalg.solve(h, x.T @ (label - p) - 0.05 * w)
        w = w + d * min(1.0, 5 / max(1e-9, np.abs(d).max()))
    model.document = tuple(map(float, w))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS, most_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """At most `most` labelled texts of either class and most_bytes of them. The rows are chosen from the
    labels alone; texts are then looked up by that bounded list."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    ids = chosen[0].union(chosen[1]).withColumnRenamed("doc_id", "__id")
    own = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    found = own.join(F.broadcast(ids), own["doc_id"] == ids["__id"])
    found = stored(found.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("of"), F.monotonically_increasing_id().alias("row"), F.octet_length("text").cast("long").alias("size"), "y", "text"), "toxic-sample")
    # sizes of a bounded number of rows
    first = found.drop("text", "y").where(F.col("size") <= most_bytes // 100).orderBy("h", "doc_id", "of", "row").limit(2 * most)
    total = F.sum("size").over(Window.orderBy("h", "doc_id", "of", "row"))
    fits = first.withColumn("total", total).where(F.col("total") <= most_bytes).select("row")
    rows = found.join(F.broadcast(fits), "row").orderBy("h", "doc_id", "of").select("text", "y").toPandas()
    return list(zip(rows["text"], map(int, rows["y"])))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> Model:
    model = train(training_rows(docs, labels, most))
    release()  # the driver's Python lives on
    return model


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start:end, comma-joined)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            scores, found = [], []
            for x in b.column("text"):
                text = x.as_py()
                n, at, marginals = tagger.read(text)
                scores.append(tagger.score(summary(n, marginals)))
                found.append(",".join(f"{s}:{e}" for s, e in spans(text, at, marginals)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array(found, pa.string())], names=["doc_id", "held_out", "score", "spans"])
        tagger.memo.clear()
        release()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), text_of(docs).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, spans string")
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"), "spans")


def score_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """docs less those that the model rejects, all columns as they were; texts go through the model in
    the rows themselves, so nothing is joined."""
    spark = docs.sparkSession
    model = fit(docs, labels)
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            keep = []
            for x in b.column("text"):
                n, _, marginals = tagger.read(x.as_py() or "")
                keep.append(tagger.score(summary(n, marginals)) < cut)
            yield b.filter(pa.array(keep, pa.bool_()))
        tagger.memo.clear()
        release()

    return docs.mapInArrow(run, docs.schema)
