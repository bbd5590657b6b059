"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped edges.

1. Each document's set of hashed shingles gives a signature by one permutation:
   the range of the hash is cut into BANDS * ROWS bins, a bin's value is the least
   hash in it, and an empty bin takes the value of the bin that a fixed random
   sequence of its own reaches first (optimal densification).
2. Documents with the same set are one node, named by its smallest doc_id.
3. Nodes that agree in a band share a bucket. Each bucket has a centre, drawn by
   hash, and only the pairs of a centre and a member are candidates: their number
   is that of the members.
4. Candidates are confirmed on the full sets; confirmed links give components.
5. A link between two members that are not the centre may still be open where a
   bucket holds several components. Those buckets are gone through exactly. Members
   are sorted into units by the size of their sets, on a scale on which a link spans
   one step at most, and a component with many members of a size is a unit by itself.
   Units that are too far apart, or of one and the same component, don't meet; the
   others do, in blocks of bounded size, where sizes of all intersections come from
   a product of matrices. Only links between different components leave a block.
6. Components by contraction; the links never leave the executors.

A link of similarity 0.85 shares no band, and is lost, with a chance of 3e-7; for a
lower PERCENT, bands and rows are parameters as well.
Shingles are compared by 64-bit hashes. A doc_id may be of any type with an order.

Defined cases: a null or empty text, or one of white space, has an empty set and is
linked with nothing; a text with fewer words than a shingle is one shingle; very
long texts are hashed whole; rows with the same doc_id count as one document, linked
with whatever one of them is; a row without doc_id has no component and is kept;
an empty table gives an empty result; other columns pass through, and one that
bears the name of an output gives way.
"""

from __future__ import annotations

import functools
import hashlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm.common import cut, map_arrow, slices
from tabguard.operators.graph import components

SHINGLE = 3
#: A link: 100 * size of the intersection >= PERCENT * size of the union.
PERCENT = 85
BANDS, ROWS = 32, 6
#: Elements of sets, and sets, that one block of an open bucket holds, about.
BLOCK_ELEMENTS, BLOCK_ROWS = 100_000, 400
#: Identifiers that may be broadcast (8 bytes each); more are joined.
BROADCAST_IDS = 1_000_000
CHUNK = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
for _i in range(65, 91):  # A-Z count as a-z
    _BYTE[_i] = _BYTE[_i + 32]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1 << 16, np.uint64)
_POWERS[1:] = _FACTOR
_POWERS = np.cumprod(_POWERS)
#: For each bin the order in which it looks for a bin that isn't empty.
_PROBES = _rng.permuted(np.tile(np.arange(BANDS * ROWS), (BANDS * ROWS, 1)), axis=1)
_EDGES = (np.arange(BANDS * ROWS, dtype=np.float64) * (2.0**64 / (BANDS * ROWS))).astype(np.uint64)
_MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_TURN = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(32))


def _word_hashes(data: np.ndarray) -> np.ndarray:
    inside = ~_GAP[data]
    change = np.flatnonzero(np.diff(inside.view(np.int8)))
    starts, ends = [], []
    edge = change + 1
    begin = inside[edge]
    starts = edge[begin]
    ends = edge[~begin]
    if len(data) and inside[0]:
        starts = np.concatenate([[0], starts])
    if len(data) and inside[-1]:
        ends = np.concatenate([ends, [len(data)]])
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]])), ) if starts[0] == 0 else None
    if at is None:
        lead = starts[0]
        at = np.concatenate([np.zeros(lead, np.int64), np.arange(lead, len(data)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]])))])
    value = _BYTE[data] * _POWERS[at & 0xFFFF] + (at >> 16).astype(np.uint64)
    value[~inside] = 0
    sums = np.add.reduceat(value, starts)
    return _mix(sums ^ (sizes.astype(np.uint64) * _FACTOR))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= 2 * CHUNK:
        return _word_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not _GAP[data[end]]:
            gap = np.flatnonzero(_GAP[data[end : end + CHUNK]])
            end = end + int(gap[0]) if len(gap) else min(end + CHUNK, len(data))
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.full(n, len(w) if len(w) < size else size, np.uint64)
    for i in range(min(size, len(w))):
        h = (h + w[i : i + n]) * _TURN[i]
        h ^= h >> np.uint64(31)
    return np.unique(_mix(h))


@functools.cache
def _bins(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower edges of n bins, and the order in which each looks for a bin that isn't empty."""
    if n == BANDS * ROWS:
        return _EDGES, _PROBES
    probes = np.random.default_rng(n).permuted(np.tile(np.arange(n), (n, 1)), axis=1)
    return (np.arange(n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64), probes


def signature(found: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    edges, probes = _bins(bins)
    first = np.searchsorted(found, edges)
    last = np.append(first[1:], len(found))
    full = last > first
    out = found[np.minimum(first, len(found) - 1)].copy()
    empty = np.flatnonzero(~full)
    if len(empty):
        source = probes[empty, full[probes[empty]].argmax(1)]
        out[empty] = out[source]
    return out


def bucket_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    values = signature(found, bands * rows).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _FACTOR
    for i in range(rows):
        h = _mix((h + values[:, i]) * _TURN[i + 8])
    return h.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b)
    common = both - len(np.union1d(a, b))
    return 100 * common >= percent * (both - common)


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _sketches(docs: DataFrame, size: int, n_bands: int, n_rows: int) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set; null if empty), bands."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                counts, keys, bands = [], [], []
                for value in part.column(1):
                    s = shingles(value.as_py(), size)
                    counts.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bands.append(bucket_keys(s, n_bands, n_rows) if len(s) else [])
                found = (pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["doc_id", "n_shingles", "key", "bands"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {_kind(docs)}, n_shingles long, key binary, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """node and the bytes of its set, for the given nodes (column node); distinct."""
    rows = docs.select(F.col("doc_id").alias("node"), "text")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = rows.join(ids, "node", "left_semi")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                s = [shingles(t.as_py(), size).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.binary())], names=["node", "set"])

    found = map_arrow(rows, run, f"node {_kind(docs)}, set binary").filter(F.length("set") > 0)
    return found.dropDuplicates(["node", "set"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = [
                linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(both, run, f"a {kind}, b {kind}")


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between different labels in the blocks (g, side, node, label, set)."""

    def solve(rows: list[tuple]):
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(rows)), sizes)
        _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1  # an element of one set is in no intersection
        owner, element = owner[shared], inverse[shared]
        order = np.argsort(element, kind="stable")
        owner, element = owner[order], element[order]
        renumbered = np.cumsum(np.concatenate([[0], np.diff(element) > 0])) if len(element) else element
        common = np.zeros((len(rows), len(rows)), np.int64)
        step = max(256, 2_000_000 // max(1, len(rows)))
        at = 0
        while at < len(owner):
            end = np.searchsorted(renumbered, renumbered[at] + step)
            m = np.zeros((len(rows), step), np.float32)
            m[owner[at:end], renumbered[at:end] - renumbered[at]] = 1
            common += (m @ m.T).astype(np.int64)  # at most step, so exact in 32 bits
            at = end
        union = sizes[:, None] + sizes[None] - common
        label = np.array([r[3] for r in rows])
        side = np.array([r[1] for r in rows])
        meets = (side[:, None] != side[None]) | (side.max() == side.min())
        hit = (100 * common >= percent * union) & (label[:, None] < label[None]) & meets
        # one link is enough for two labels
        seen = set()
        for i, j in zip(*np.nonzero(hit)):
            if (k := (label[i], label[j])) not in seen:
                seen.add(k)
                yield min(rows[i][2], rows[j][2]), max(rows[i][2], rows[j][2])

    def run(batches):
        group, rows, kind = None, [], None
        pack = lambda found: pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i in (0, 1)], names=["a", "b"])
        for batch in batches:
            found, kind = [], batch.column(2).type
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != group:
                    if len(rows) > 1:
                        found += solve(rows)
                    group, rows = r[0], []
                rows.append(r)
            yield pack(found)
        if len(rows) > 1:
            yield pack(list(solve(rows)))

    kind = members.schema["node"].dataType.simpleString()
    return map_arrow(members.repartition("g").sortWithinPartitions("g"), run, f"a {kind}, b {kind}")


def _open_members(buckets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The members of buckets in which, besides the centre, there is more than one label, dealt to blocks."""
    # a bit more than the step that a link can span, so that rounding loses none
    span = max(0.01, 1.001 * log(100 / percent))
    named = cut(
        buckets.filter("size > 2 and node <> centre")
        .join(labels, "node", "left")
        .select("bucket", "node", "n", F.floor(F.log("n") / span).cast("int").alias("step"), F.coalesce("label", "node").alias("label"))
    )
    counts = cut(named.groupBy("bucket", "step", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("elements")))
    wide = counts.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    full = (F.col("rows") > BLOCK_ROWS // 2) | (F.col("elements") > BLOCK_ELEMENTS // 2)
    own = F.when(full, F.concat(F.lit("="), F.col("label").cast("string"))).otherwise("")
    parts = counts.join(wide, "bucket", "left_semi").withColumn("unit", F.concat_ws("|", F.col("step").cast("string"), own))
    blocks = F.greatest(F.ceil(F.sum("elements") / BLOCK_ELEMENTS), F.ceil(F.sum("rows") / BLOCK_ROWS)).cast("int")
    units = cut(
        parts.groupBy("bucket", "step", "unit").agg(blocks.alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high"))
    )
    a = units.select("bucket", *[F.col(c).alias(f"{c}_a") for c in units.columns[1:]])
    b = units.select("bucket", *[F.col(c).alias(f"{c}_b") for c in units.columns[1:]])
    one = (F.col("low_a") == F.col("high_b")) & (F.col("high_a") == F.col("low_b"))  # both of one label, the same
    meet = cut(
        a.join(b, "bucket")
        .filter((F.col("unit_a") <= F.col("unit_b")) & (F.abs(F.col("step_a") - F.col("step_b")) <= 1) & ~one)
        .select("bucket", "unit_a", "unit_b", "blocks_a", "blocks_b")
    )
    placed = cut(
        named.join(parts.select("bucket", "step", "label", "unit"), ["bucket", "step", "label"])
        .join(units.select("bucket", "unit", "blocks"), ["bucket", "unit"])
        .select("bucket", "unit", "node", "label", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int").alias("block"))
    )
    twin = F.col("unit_a") == F.col("unit_b")
    left = placed.withColumnRenamed("unit", "unit_a").join(meet, ["bucket", "unit_a"])
    left = left.withColumn("other", F.explode(F.sequence(F.when(twin, F.col("block")).otherwise(0), F.col("blocks_b") - 1)))
    right = placed.withColumnRenamed("unit", "unit_b").join(meet, ["bucket", "unit_b"]).filter(~twin | (F.col("block") > 0))
    right = right.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(twin, F.col("block")).otherwise(F.col("blocks_a")) - 1)))
    group = lambda x, y: F.xxhash64("bucket", "unit_a", x, "unit_b", y).alias("g")
    left = left.select(group("block", "other"), F.lit(0).alias("side"), "node", "label")
    return left.unionByName(right.select(group("other", "block"), F.lit(1).alias("side"), "node", "label"))


def _twice(some: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that hold rows of one doc_id with different sets."""
    several = some.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("doc_id")
    rows = cut(some.select("doc_id", "key").join(cut(several), "doc_id", "left_semi").distinct())
    named = cut(rows.join(nodes.select("key", "node"), "key").select("doc_id", "node").distinct())
    first = named.groupBy("doc_id").agg(F.min("node").alias("a"))
    return named.join(first, "doc_id").filter("a < node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for each row."""
    sketches = cut(_sketches(docs, size, n_bands, n_rows))
    some = sketches.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    # equal sets have equal bands
    nodes = cut(some.groupBy("key").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")))
    twice = _twice(some, nodes)
    bands = cut(nodes.select("node", "n", F.explode("bands").alias("bucket")))
    centres = (
        bands.groupBy("bucket")
        .agg(F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), F.col("node"))).alias("c"), F.count("*").alias("size"))
        .filter("size > 1")
        .select(F.col("bucket"), F.col("c.node").alias("centre"), "size")
    )
    buckets = cut(bands.join(cut(centres), "bucket"))
    stars = cut(
        buckets.filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    )
    sets = cut(_sets(docs, stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), size))
    links = cut(_confirm(stars, sets, percent).union(twice).distinct())
    labels = components(links)
    rest = _open_members(buckets, labels, percent).join(sets, "node").select("g", "side", "node", "label", "set")
    more = cut(_block_links(rest, percent).distinct())
    if more.limit(1).count():
        labels = components(links.union(more))
    labels = labels.withColumnRenamed("node", "l")
    named = nodes.join(labels, F.col("node") == F.col("l"), "left").select(
        F.col("key").alias("k"), F.coalesce("label", "node").alias("component")
    )
    out = sketches.join(cut(named), F.col("key") == F.col("k"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
