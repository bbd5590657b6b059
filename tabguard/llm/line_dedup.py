"""Removal of passages that repeat anywhere in the corpus, by windows of lines.

From each line with a word a window goes down, and another up, as far as MIN_WORDS
words need; a line with that many is a window by itself. So the windows inside a
passage are the same wherever it stands, and cover each of its lines. Windows are
looked for in the whole corpus by hash. The first occurrence (by doc_id, then
position) stays. Another one is a repeat if its bytes equal those of the first; where
both lie in one document and overlap, what belongs to the first stays. The lines
without a word on each side go along, as far as they are the same as beside the first,
and so do such lines between two repeats. Runs of repeated lines with LEAST_RUN words
are removed; two short lines that happen to meet twice stay.

Counting sends a hash for each window; texts travel only for windows that repeat.
A frequent window is counted before the shuffle, and its occurrences meet its text
in a join that Spark may split.

Defined cases: a null text stays null; an empty text stays; very long texts are
gone through whole; rows of the same doc_id and text are one document and are treated
alike; a doc_id may be of any type with an order, and a null one comes last; kept is false for documents of which less than
LEAST_LEFT percent of the words are left; an empty table gives an empty result;
other columns pass through, and one that bears the name of an output gives way.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.llm.common import cut, map_arrow, quoted, shielded, slices

MIN_WORDS = 10
#: Words of a run of lines from which on it is a passage and goes.
LEAST_RUN = 30
LEAST_LEFT = 20


def chunks(lines: list[str]) -> list[tuple[int, int, int]]:
    """Start, number of lines and hash of each window."""
    words = [(i, n) for i, line in enumerate(lines) if (n := len(line.split()))]
    found: set[tuple[int, int]] = set()
    for k, (i, n) in enumerate(words):
        if n >= MIN_WORDS:
            found.add((i, i + 1))
            continue
        total, j = n, k
        while total < MIN_WORDS and (j := j + 1) < len(words):
            total += words[j][1]
        if total >= MIN_WORDS:
            found.add((i, words[j][0] + 1))
        total, j = n, k
        while total < MIN_WORDS and (j := j - 1) >= 0:
            total += words[j][1]
        if total >= MIN_WORDS:
            found.add((words[j][0], i + 1))
    return [(a, b - a, _hash(lines[a:b])) for a, b in sorted(found)]


def _hash(lines: list[str]) -> int:
    value = xxhash.xxh64_intdigest("\n".join(lines).encode("utf-8", "surrogatepass"), seed=1)
    return value - (1 << 64) if value >= 1 << 63 else value


def _with_id(docs: DataFrame) -> DataFrame:
    """docs with __rid, the order and identity of a document."""
    return docs.withColumn("__rid", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))


def _occurrences(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows, starts, sizes, hashes = [], [], [], []
                for i, value in enumerate(part.column(1)):
                    lines = (value.as_py() or "").split("\n")
                    for start, n, value in chunks(lines):
                        rows.append(i)
                        starts.append(start)
                        sizes.append(n)
                        hashes.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())],
                    names=["rid", "start", "n", "hash"],
                )

    rows = _with_id(docs.select("doc_id", "text")).select(F.col("__rid").alias("rid"), "text")
    return map_arrow(rows, run, f"rid {rows.schema['rid'].dataType.simpleString()}, start int, n int, hash long").distinct()


def _passages(rows: DataFrame, kept: list[str], firsts: DataFrame) -> DataFrame:
    """hash, the lines of the first occurrence, and the lines without a word before and after it.

    All columns kept go through the join: the shuffle of the documents is then the same
    as that of the last join, and Spark makes it once for both.
    """
    at, where = kept.index("text"), len(kept)

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                found = [[] for _ in range(4)]
                for value, places in zip(part.column(at), part.column(where)):
                    lines = value.as_py().split("\n")
                    for p in places.as_py():
                        a, b = p["start"], p["start"] + p["n"]
                        for column, x in zip(found, (p["hash"], lines[a:b], _wordless(lines, a - 1, -1), _wordless(lines, b, 1))):
                            column.append(x)
                strings = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(found, (pa.int64(), strings, strings, strings))], names=["hash", "lines", "before", "after"]
                )

    places = firsts.groupBy(F.col("rid").alias("__owner")).agg(F.collect_list(F.struct("hash", "start", "n")).alias("__places"))
    found = rows.join(places, F.col("__rid") == F.col("__owner")).select(*[quoted(c) for c in kept], "__places")
    kinds = "hash long, lines array<string>, before array<string>, after array<string>"
    # rows of one doc_id and text hold the same passage
    return map_arrow(found, run, kinds).dropDuplicates(["hash"])


def _wordless(lines: list[str], at: int, step: int) -> list[str]:
    """The lines from a place on, up or down, until one with a word."""
    out = []
    while 0 <= at < len(lines) and not lines[at].split():
        out.append(lines[at])
        at += step
    return out


def rewrite(text: str, repeats: list[dict]) -> tuple[str, int]:
    """The text without the repeats whose bytes are the same as at the first occurrence."""
    lines = text.split("\n")
    gone: set[int] = set()
    for r in repeats:
        a, b = r["start"], r["start"] + len(r["lines"])
        if lines[a:b] != r["lines"]:
            continue
        while a - 1 >= 0 and r["start"] - a < len(r["before"]) and lines[a - 1] == r["before"][r["start"] - a]:
            a -= 1
        end = b
        while b < len(lines) and b - end < len(r["after"]) and lines[b] == r["after"][b - end]:
            b += 1
        gone.update(range(max(a, r.get("least", 0)), b))
    run: list[int] = []
    size, last = 0, -1
    for i in [*sorted(gone), len(lines)]:
        if run and (i == len(lines) or any(lines[j].split() for j in range(last + 1, i))):
            if size < LEAST_RUN:
                gone.difference_update(run)
            run, size = [], 0
        if i < len(lines):
            if run:
                gone.update(range(last + 1, i))
                run += range(last + 1, i)
            run.append(i)
            size += len(lines[i].split())
            last = i
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


NEW = ("n_lines", "n_removed_lines", "kept")


def line_dedup(docs: DataFrame, least_left: int = LEAST_LEFT) -> DataFrame:
    """docs, text without repeated passages; n_lines, n_removed_lines and kept."""
    return shielded(docs, ("doc_id", "text"), NEW, lambda d: _line_dedup(d, least_left))


def _line_dedup(docs: DataFrame, least_left: int) -> DataFrame:
    found = cut(_occurrences(docs))
    place = F.struct("rid", "start", "n")
    firsts = cut(
        found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").select("hash", "first.*")
    )
    same = F.struct("rid", "start") == F.struct("frid", "fstart")
    # where the first occurrence ends, if it is in the same document
    least = F.when(F.col("rid") == F.col("frid"), F.col("fstart") + F.col("fn")).otherwise(0).alias("least")
    repeats = cut(
        found.join(firsts.toDF("fhash", "frid", "fstart", "fn"), F.col("hash") == F.col("fhash")).filter(~same).select("hash", "rid", "start", least)
    )
    kept, rows = docs.columns, _with_id(docs)
    # another key than that of the distinct hashes, so that both sides are dealt anew and Spark may split a frequent one
    passages = _passages(rows, kept, firsts).withColumn("key", F.col("hash").bitwiseXOR(F.lit(1))).drop("hash")
    by_document = (
        repeats.withColumn("key", F.col("hash").bitwiseXOR(F.lit(1)))
        .join(passages, "key")
        .groupBy(F.col("rid").alias("__owner"))
        .agg(F.collect_list(F.struct("start", "least", "lines", "before", "after")).alias("__repeats"))
    )
    rows = rows.join(by_document, F.col("__rid") == F.col("__owner"), "left").select(*[quoted(c) for c in kept], "__repeats")
    at, where = kept.index("text"), len(kept)
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(k, t) for k, t in zip(NEW, (T.LongType(), T.LongType(), T.BooleanType()))]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                texts, counts, removed, good = [], [], [], []
                for value, todo in zip(part.column(at), part.column(where)):
                    text, gone, ok = value.as_py(), 0, True
                    counts.append(text.count("\n") + 1 if text else 0)
                    if text and todo.is_valid:
                        shorter, gone = rewrite(text, todo.as_py())
                        ok = 100 * len(shorter.split()) >= least_left * len(text.split())
                        text = shorter
                    texts.append(text)
                    removed.append(gone)
                    good.append(ok)
                columns = [*part.columns[:where], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(good, pa.bool_())]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return map_arrow(rows, run, schema)
