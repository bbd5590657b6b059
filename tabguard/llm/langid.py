"""Language identification by a byte convolutional network.

A text is lower-cased, encoded in UTF-8 and cut into windows of WINDOW bytes.
The network embeds each byte, runs filters of several widths over a window,
takes each filter's maximum and ends in a softmax over the languages. It is
trained in numpy on windows of labelled documents. A document's probabilities
are the mean over all its windows, weighted by their bytes.

The filters are linear up to the maximum, so for application the products of
embedding and filter are tabulated for pairs of bytes.

The training rows are a sample of at most sample_rows documents, drawn by the
hash of doc_id so that languages are about equally frequent; rows held out
(crc32 of doc_id divisible by 5), without a label or without letters take no
part. Every window of every document is scored.

Defined cases: a null text, or one without a letter, is und with score 0; if
there is no row to learn from, every row is und with score 0; texts shorter
than a window are padded; repeated rows get the same answer; a null doc_id counts
as held out; an empty table gives an empty result; other columns pass through,
and one that bears the name of an output gives way.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.llm.common import held_out, map_arrow, quoted, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
SAMPLE_ROWS = 6000
WINDOWS_PER_ROW = 2
EPOCHS = 8
BATCH = 64
#: Windows that are scored at a time, to stay in the processor's cache.
BLOCK = 48

_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: dict = field(hash=False, compare=False)
    key: int = 0


def encode(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _patches(x: np.ndarray, width: int) -> np.ndarray:
    """(n, L, E) to (n, L - width + 1, width * E)."""
    n, length, size = x.shape
    a, b, c = x.strides
    view = np.lib.stride_tricks.as_strided(x, (n, length - width + 1, width * size), (a, b, c))
    return view


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], seed: int = 7) -> Model:
    """windows (n, WINDOW) of bytes, padded with 0; labels: indices into languages."""
    rng = np.random.default_rng(seed)
    k, total = len(languages), FILTERS * len(WIDTHS)
    w = {"embed": rng.normal(0, 0.5, (256, EMBEDDING))}
    for width in WIDTHS:
        w[f"filter{width}"] = rng.normal(0, 1 / np.sqrt(width * EMBEDDING), (width * EMBEDDING, FILTERS))
        w[f"bias{width}"] = np.zeros(FILTERS)
    w |= {"out": rng.normal(0, 0.1, (total, k)), "out_bias": np.zeros(k)}
    w = {n: v.astype(np.float32) for n, v in w.items()}
    first = {n: np.zeros_like(v) for n, v in w.items()}
    second = {n: np.zeros_like(v) for n, v in w.items()}
    step, count = 0, len(windows)
    for epoch in range(EPOCHS):
        rate = 0.004 * (1 - epoch / EPOCHS) + 0.0004
        order = rng.permutation(count)
        for at in range(0, count, BATCH):
            rows = order[at : at + BATCH]
            x, y = windows[rows].copy(), labels[rows]
            # short texts must be recognised as well: half of the windows are cut
            cut = np.where(rng.random(len(rows)) < 0.5, rng.integers(12, WINDOW, len(rows)), WINDOW)
            x[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
            grad = _gradients(w, x, y, k)
            step += 1
            for n, g in grad.items():
                g = g + 1e-5 * w[n]
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                w[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-7)
    return Model(languages, w, zlib.crc32(b"".join(w[n].tobytes() for n in sorted(w))))


def _gradients(w: dict, x: np.ndarray, y: np.ndarray, k: int) -> dict:
    n = len(x)
    embedded = np.ascontiguousarray(w["embed"][x])
    pooled, best = [], {}
    for width in WIDTHS:
        a = _patches(embedded, width) @ w[f"filter{width}"] + w[f"bias{width}"]
        best[width] = a.argmax(1)
        pooled.append(np.take_along_axis(a, best[width][:, None, :], 1)[:, 0])
    h = np.concatenate(pooled, 1)
    active = np.maximum(h, 0)
    logits = active @ w["out"] + w["out_bias"]
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    d = (p - np.eye(k, dtype=np.float32)[y]) / n
    grad = {"out": active.T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(w["embed"])}
    back = (d @ w["out"].T) * (h > 0)
    for i, width in enumerate(WIDTHS):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        where = best[width][:, :, None] + np.arange(width)
        hit = x[np.arange(n)[:, None, None], where]
        patch = w["embed"][hit].reshape(n, FILTERS, -1)
        grad[f"filter{width}"] = np.einsum("nfe,nf->ef", patch, g)
        grad[f"bias{width}"] = g.sum(0)
        to = np.einsum("nf,ef->nfe", g, w[f"filter{width}"]).reshape(-1, EMBEDDING)
        np.add.at(grad["embed"], hit.reshape(-1), to)
    return grad


class Scorer:
    """Applies a model; the products for pairs of bytes are looked up."""

    def __init__(self, model: Model):
        w = {n: v.astype(np.float32) for n, v in model.weights.items()}
        single = lambda width, j: w["embed"] @ w[f"filter{width}"][j * EMBEDDING : (j + 1) * EMBEDDING]
        pair = lambda width, j: (single(width, j)[:, None] + single(width, j + 1)[None]).reshape(1 << 16, FILTERS)
        self.near = np.concatenate([pair(2, 0) + w["bias2"], pair(3, 0) + w["bias3"], pair(4, 0) + w["bias4"]], 1)
        self.third = single(3, 2)
        self.far = pair(4, 2)
        self.out, self.out_bias = w["out"], w["out_bias"]
        self.languages = model.languages

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (n, languages) of windows (n, WINDOW)."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), BLOCK):
            b = x[at : at + BLOCK]
            p = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            a = self.near[p]
            two = a[:, :, :FILTERS].max(1)
            three = a[:, :-1, FILTERS : 2 * FILTERS]
            three += self.third[b[:, 2:]]
            four = a[:, :-2, 2 * FILTERS :]
            four += self.far[p[:, 2:]]
            h = np.maximum(np.concatenate([two, three.max(1), four.max(1)], 1), 0)
            logits = h @ self.out + self.out_bias
            e = np.exp(logits - logits.max(1, keepdims=True))
            out[at : at + BLOCK] = e / e.sum(1, keepdims=True)
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        data = [encode(t) if t and _LETTER.search(t) else b"" for t in texts]
        sizes = np.array([len(d) for d in data], np.int64)
        counts = -(-sizes // WINDOW)
        flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
        at = 0
        for d, n in zip(data, counts):
            flat[at : at + len(d)] = np.frombuffer(d, np.uint8)
            at += int(n) * WINDOW
        x = flat.reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(data)), counts)
        weight = np.full(len(x), WINDOW, np.float64)
        ends = np.cumsum(counts) - 1
        some = counts > 0
        weight[ends[some]] = sizes[some] - (counts[some] - 1) * WINDOW
        sums = np.zeros((len(data), len(self.languages)))
        if len(x):
            np.add.at(sums, owner, self.windows(x) * weight[:, None])
        share = sums / np.maximum(sizes, 1)[:, None]
        top = share.argmax(1)
        names = [self.languages[i] if s else "und" for i, s in zip(top, some)]
        scores = np.where(some, np.minimum(share[np.arange(len(data)), top], 1.0), 0.0)
        return names, scores.tolist()


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the labelled rows that are not held out; None if there are none."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    frequency = rows.groupBy("lang").agg(F.count("*").alias("__n")).collect()  # a row for each language
    if not frequency:
        return None
    n_of = F.create_map(*[F.lit(x) for r in frequency for x in (r["lang"], r["__n"])])
    draw = lambda seed: F.pmod(F.xxhash64(F.col("doc_id"), F.length("text"), F.lit(seed)), F.lit(1 << 30)) / F.lit(1 << 30)
    start = lambda i: (1 + F.floor(draw(i + 2) * F.greatest(F.length("text") - WINDOW // 2, F.lit(1)))).cast("int")
    part = lambda i: F.substr(F.col("text"), start(i), F.lit(WINDOW))
    sample = (
        rows.select(
            "lang",
            (draw(1) * F.element_at(n_of, F.col("lang"))).alias("__draw"),
            F.array(*[part(i) for i in range(WINDOWS_PER_ROW)]).alias("__parts"),
        )
        # twice as many rows as are wanted pass, so that a task sends few, however many tasks there are
        .filter(F.col("__draw") < 2 * sample_rows / len(frequency))
        .orderBy("__draw", "lang", "__parts")
        .limit(sample_rows)
        .collect()
    )
    languages = tuple(sorted({r["lang"] for r in frequency}))
    pairs = [(languages.index(r["lang"]), p) for r in sample for p in r["__parts"]]
    x = np.zeros((len(pairs), WINDOW), np.uint8)
    for i, (_, p) in enumerate(pairs):
        data = encode(p)[:WINDOW]
        x[i, : len(data)] = np.frombuffer(data, np.uint8)
    return train(x, np.array([y for y, _ in pairs]), languages)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score."""
    new = ("lang_pred", "score")
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in new])
    if model is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    at = kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())])

    def run(batches):
        apply = Scorer(model)
        for batch in batches:
            for part in slices(batch, at):
                names, scores = apply.texts(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[f.name for f in schema.fields],
                )

    return map_arrow(kept, run, schema)
