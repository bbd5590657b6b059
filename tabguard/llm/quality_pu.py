"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is a sample of
all documents, whatever their labels. A small network g is trained in numpy to
minimise the non-negative estimate of the risk
    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])
with the logistic loss l: when the second term falls below zero, its gradient is
reversed. The class prior is estimated from a first classifier of positives against
unlabelled rows (mean output on the unlabelled over mean on positives). Documents
labelled bad serve for nothing but to make a doc_id labelled both ways untrusted.

The inputs are shape statistics of the whole text: how often each pair of byte
classes is adjacent, and ratios of repeated words, lines and neighbours. No
label, language, source or identifier is among them.

At most sample_rows positives and sample_rows unlabelled documents, the first by
the hash of doc_id and text, are used for training; rows of one doc_id and text count
as one. Rows held out (crc32 of doc_id divisible by 5) take no part. Every document is
scored on its whole text. A doc_id may be of any type.

Defined cases: a null text is the empty text; an empty text is scored like any
other; without a positive row every score is the prior, 0.5; a doc_id labelled both
good and bad is not trusted; repeated rows get the same score; a null doc_id counts
as held out; an empty table gives an empty result; other columns pass through, and
one that bears the name of an output gives way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.llm.common import cut, held_out, map_arrow, quoted, slices

SAMPLE_ROWS = 6000
HIDDEN = 24
EPOCHS = 40
BATCH = 512
CUT = 0.3


def byte_classes() -> np.ndarray:
    """A class for each byte: letters, digits, spaces and kinds of signs."""
    out = np.full(256, 13, np.uint8)  # other signs and control characters
    groups = (
        range(ord("a"), ord("z") + 1),
        range(ord("A"), ord("Z") + 1),
        range(ord("0"), ord("9") + 1),
        b" \t\r\x0b\x0c",
        b"\n",
        b".",
        b",;:",
        b"!",
        b"?",
        b"#*$%&",
        b"|<>",
        b"'\"()-",
        range(128, 256),
    )
    for i, g in enumerate(groups):
        out[list(g)] = i
    return out


CLASSES = byte_classes()
N_CLASSES = 14
N_RATIOS = 6
N_INPUTS = N_CLASSES * N_CLASSES + N_RATIOS


def inputs(text: str | None) -> np.ndarray:
    text = text or ""
    out = np.zeros(N_INPUTS, np.float32)
    if not text:
        return out
    c = CLASSES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int32)
    if len(c) > 1:
        pairs = np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_CLASSES * N_CLASSES)
        out[: N_CLASSES * N_CLASSES] = np.sqrt(pairs / (len(c) - 1))
    w = text.split()
    if not w:
        return out
    n = len(w)
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(a == b for a, b in zip(w, w[1:]))
    out[-N_RATIOS:] = (
        len(set(w)) / n**0.9,
        again / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(c) / n / 10,
        np.log(n) / 10,
        n / max(1, len(lines)) / 200,
    )
    return np.minimum(out, 4)


class Network:
    """One hidden layer; output is the logit of being good."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_INPUTS), np.ones(N_INPUTS)
        self.w = {
            "a": rng.normal(0, 1 / np.sqrt(N_INPUTS), (N_INPUTS, HIDDEN)),
            "b": np.zeros(HIDDEN),
            "c": rng.normal(0, 0.2, (HIDDEN, 1)),
            "d": np.zeros(1),
        }

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w["a"] + self.w["b"])
        return (h @ self.w["c"] + self.w["d"])[:, 0]

    def gradient(self, x: np.ndarray, d: np.ndarray) -> dict:
        """d: derivative of the risk by the logits."""
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ self.w["a"] + self.w["b"])
        back = (d[:, None] @ self.w["c"].T) * (1 - h * h)
        return {"a": z.T @ back, "b": back.sum(0), "c": h.T @ d[:, None], "d": d.sum(0, keepdims=True)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def risk(net: Network, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the unbiased risk: of positives, and of what else is unlabelled; the latter may be negative."""
    gp, gu = net.logits(p), net.logits(u)
    return prior * _loss(gp).mean(), _loss(-gu).mean() - prior * _loss(-gp).mean()


def risk_gradient(net: Network, p: np.ndarray, u: np.ndarray, prior: float) -> dict:
    """Of the sum of the terms, or of the second one reversed, where that is negative."""
    gp, gu = net.logits(p), net.logits(u)
    # derivatives of the three means by the logits
    on_p_good = -prior * _sigmoid(-gp) / len(p)
    on_p_bad = -prior * _sigmoid(gp) / len(p)
    on_u_bad = _sigmoid(gu) / len(u)
    if risk(net, p, u, prior)[1] >= 0:
        return _sum(net.gradient(p, on_p_good + on_p_bad), net.gradient(u, on_u_bad))
    return _sum(net.gradient(p, -on_p_bad), net.gradient(u, -on_u_bad))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 11) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    everything = np.concatenate([positive, unlabelled])
    net.mean, net.scale = everything.mean(0), everything.std(0) + 0.02
    first = {n: np.zeros_like(v) for n, v in net.w.items()}
    second = {n: np.zeros_like(v) for n, v in net.w.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.003 * (1 - epoch / EPOCHS) + 0.0003
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), BATCH):
            u = unlabelled[order[at : at + BATCH]]
            p = positive[rng.integers(0, len(positive), BATCH)]
            grad = risk_gradient(net, p, u, prior)
            step += 1
            for n, g in grad.items():
                g = g + 1e-4 * net.w[n]
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                net.w[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return net


def _sum(a: dict, b: dict) -> dict:
    return {n: a[n] + b[n] for n in a}


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows."""
    share = len(positive) / (len(positive) + len(unlabelled))
    net = train(positive, unlabelled, share)
    c = _sigmoid(net.logits(positive)).mean()
    return float(np.clip(_sigmoid(net.logits(unlabelled)).mean() / max(c, 1e-6), 0.05, 0.95))


def _sample(rows: DataFrame, sample_rows: int, seed: int) -> DataFrame:
    """At most sample_rows of the distinct rows (doc_id, hash), the first by their hash.

    About twice as many as are wanted pass a filter by the hash first: a task then sends
    few, however many tasks there are. The estimate of how many are distinct is of
    bounded size.
    """
    n = rows.agg(F.approx_count_distinct(F.xxhash64("doc_id", "hash"))).first()[0]
    draw = F.pmod(F.xxhash64("doc_id", "hash", F.lit(seed)), F.lit(1 << 40))
    few = rows.filter(draw < int(min(1.0, (2 * sample_rows + 100) / max(1, n)) * (1 << 40)))
    return few.select("doc_id", "hash", draw.alias("draw")).distinct().orderBy("draw", "doc_id", "hash").limit(sample_rows)


def _features(docs: DataFrame, chosen: DataFrame) -> dict[int, np.ndarray]:
    """The inputs of the rows chosen (doc_id, hash, draw, part), which are few, by part and in the order of their draw."""
    # bounded: at most 2 * sample_rows rows of an identifier and numbers
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").join(F.broadcast(chosen), ["doc_id", "hash"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 3):
                x = [inputs(t).tobytes() for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(x, pa.binary())], names=["part", "draw", "hash", "x"])

    found = map_arrow(rows.select("part", "draw", "hash", "text"), run, "part int, draw long, hash long, x binary")
    # rows of one doc_id and text have the same inputs, and one of them is enough
    one = sorted(found.groupBy("part", "draw", "hash").agg(F.first("x").alias("x")).collect())
    return {k: np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in one if r["part"] == k], np.float64) for k in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """A network from the labelled and unlabelled rows that are not held out; None without positives."""
    learnable = ~held_out(F.col("doc_id"))
    good = (
        labels.filter(learnable & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"))
        .filter("low = 1")
        .select("doc_id")
    )
    rows = cut(docs.filter(learnable).select("doc_id", F.xxhash64("text").alias("hash")))
    parts = [_sample(x, sample_rows, i + 1).withColumn("part", F.lit(i)) for i, x in enumerate((cut(rows.join(good, "doc_id", "left_semi")), rows))]
    both = _features(docs, cut(parts[0].unionByName(parts[1])))
    if not len(both[0]) or not len(both[1]):
        return None
    return train(both[0], both[1], float(np.clip(estimate_prior(both[0], both[1]), 0.02, 0.98)))


def classify(docs: DataFrame, network: Network | None, least: float = CUT) -> DataFrame:
    """docs with held_out, score and predicted."""
    new = ("held_out", "score", "predicted")
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in new])
    out = kept.withColumn("held_out", held_out(F.col("doc_id")))
    if network is None:
        return out.withColumns({"score": F.lit(0.5), "predicted": F.lit(int(least <= 0.5))})
    at = kept.columns.index("text")
    schema = T.StructType([*out.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                x = np.array([inputs(t) for t in part.column(at).to_pylist()], np.float64)
                score = _sigmoid(network.logits(x))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score, pa.float64()), pa.array((score >= least).astype(np.int32))],
                    names=[f.name for f in schema.fields],
                )

    return map_arrow(out, run, schema)
