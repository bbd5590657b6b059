"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put into a shuffled order (by the MD5 of seed and
doc_id). A copy of a document has the virtual finish time
    (words of its source up to and including this copy) / (target of its source)
and the mix is the prefix of all copies, sorted by finish time, that fits the
budget. All of it is DataFrame expressions.

The running totals are sums in two levels: a source's order is cut into ranges
of the MD5, the ranges are summed first, and only the rows of one range meet in
a window. No task holds a source. The sort for the budget works the same way
over ranges of the finish time.

All this is done on slim rows (identifier, size, hashes), and words are counted once
for them. What a source has in the mix is, for each copy, a prefix of its order. So
the rows that are given back whole are not shuffled: their place in the order is
compared with the ends of the prefixes, a row for each source. Only rows that are
the same in all columns as the last one of a prefix are numbered.

The targets need one row for each source in one task; sources are the entries
of a mixing configuration, not data.

Defined cases: a null text has size 0; documents of size 0 take nothing and
count as one copy if their time fits; null sources are one source, the last in
order; a null doc_id is shuffled by the word null; rows with the same doc_id,
size and text are interchangeable; an empty table gives an empty result; other
columns pass through, and one that bears the name of an output gives way.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.llm.common import cut, n_words, quoted, shielded

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MAX_COPIES = 2
SEED = "mix"
#: Rows that one range of the order should hold, and the least number of ranges.
RANGE_ROWS, LEAST_RANGES = 20_000, 256
#: Sources (a row of some 300 bytes for each) that may be broadcast; more are joined.
BROADCAST_SOURCES = 10_000


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(
    sources: DataFrame, weights: tuple[int, ...], percent: int, copies: int
) -> DataFrame:
    """sources (source, source_size) with target; shares above copies * size are shared out again.

    Sources sorted by limit over weight fill up in this order, so the ones
    that end at their limit are a prefix, found with running totals.
    """
    one = F.lit(0)
    order = Window.partitionBy(one).orderBy(F.asc_nulls_last("source"))
    p, q = percent // gcd(percent, 100), 100 // gcd(percent, 100)
    df = (
        sources.withColumn("rank", (F.row_number().over(order) - 1) % len(weights))
        .withColumn("weight", F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("rank")))
        .withColumn("limit", copies * F.col("source_size"))
        .withColumn("all_size", F.sum("source_size").over(Window.partitionBy(one)))
    )
    fill = Window.partitionBy(one).orderBy(
        F.col("limit") / F.col("weight"), F.asc_nulls_last("source")
    )
    df = df.withColumn(
        "before", F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("open_weight", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    left = p * F.col("all_size") - q * F.col("before")
    df = df.withColumn("open", left * F.col("weight") <= q * F.col("limit") * F.col("open_weight"))
    df = df.withColumn("left", left)
    first = F.min(
        F.when(F.col("open"), F.struct(-F.col("open_weight"), F.col("left").alias("left"), F.col("open_weight").alias("w")))
    ).over(Window.partitionBy(one))
    df = df.withColumn("first", first)
    share = (F.col("weight") * F.col("first.left")).cast("double") / (q * F.col("first.w")).cast("double")
    return df.select(
        "source", "source_size", F.when(F.col("open"), share).otherwise(F.col("limit").cast("double")).alias("target")
    )


NEW = ("size", "source_size", "target", "n_copies", "taken")
ORDER = ("__key", "__doc_id", "__size", "__hash")


def _base(docs: DataFrame, seed: str) -> DataFrame:
    """docs with its group (source) and its place in the order."""
    text = quoted("text") if "text" in docs.columns else F.lit(None).cast("string")
    source = quoted("source").cast("string")
    # equal hashes of rows with the same identifier: the rows are the same
    cells = [F.to_json(quoted(f.name)) if "map" in f.dataType.simpleString() else quoted(f.name) for f in docs.schema.fields]
    return docs.withColumns(
        {
            "__source": source,
            "__group": F.coalesce(F.concat(F.lit("="), source), F.lit("null")),
            "__key": shuffle_key(quoted("doc_id"), seed),
            "__doc_id": quoted("doc_id"),
            "__size": n_words(text),
            "__hash": F.xxhash64(*cells),
        }
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = BUDGET_PERCENT,
    copies: int = MAX_COPIES,
    seed: str = SEED,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """docs with size, source_size, target, n_copies (in the mix) and taken (words).

    carry: the columns that are wanted beside these. They then travel in the slim rows,
    and the table is read once; without, all columns are given back.
    """
    own = [c for c in docs.columns if c.lower() not in NEW]
    places = None if carry is None else [own.index(c) for c in carry]
    return shielded(docs, ("doc_id", "text", "source"), NEW, lambda d: _mix(d, weights, percent, copies, seed, places))


def _mix(docs: DataFrame, weights: tuple[int, ...], percent: int, copies: int, seed: str, carry: list[int] | None) -> DataFrame:
    """carry: the places of the columns that travel in the slim rows; None for rows given back whole."""
    kept = [c for i, c in enumerate(docs.columns) if carry is None or i in carry]
    slim = cut(_base(docs, seed).select(*(kept if carry is not None else ()), "__source", "__group", *ORDER))
    ranges = max(LEAST_RANGES, slim.count() // RANGE_ROWS)
    prefix = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    slim = slim.withColumn("__range", F.floor(prefix * ranges / F.lit(float(1 << 32))).cast("int"))
    sums = cut(slim.groupBy("__group", "__range", F.col("__source").alias("source")).agg(F.sum("__size").alias("size")))
    sources = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sources, weights, percent, copies)
    earlier = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    places = cut(
        sums.withColumn("__before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(
            F.col("__group").alias("__g"),
            F.col("__range").alias("__r"),
            "__before",
            F.col("source_size").alias("__source_size"),
            F.col("target").alias("__target"),
        )
    )
    within = Window.partitionBy("__group", "__range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut(
        slim.join(places, (F.col("__group") == F.col("__g")) & (F.col("__range") == F.col("__r")))
        .withColumn("__end", F.sum("__size").over(within) + F.col("__before"))
        .drop("__before", "__g", "__r", "__range")
    )
    # for each copy its finish time and what breaks ties, as one sortable value
    copy = lambda c: F.struct(
        F.coalesce(F.try_divide((c * F.col("__source_size") + F.col("__end")).cast("double"), F.col("__target")), F.lit(0.0)).alias("t"),
        F.col("__group").alias("g"),
        F.lit(c).alias("c"),
        F.col("__key").alias("k"),
        F.col("__end").alias("e"),
    )
    each = F.array(*[copy(c) for c in range(copies)])
    fits = _budget(placed.select(F.inline(each), "__size"), percent, copies, ranges)
    placed = placed.withColumn("__n", F.size(F.filter(each, fits)))
    if carry is None:
        return _whole(_base(docs, seed), kept, placed, copies)
    return placed.select(*kept, *_new())


def _new() -> list[Column]:
    return [
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__n").cast("int").alias("n_copies"),
        (F.col("__n") * F.col("__size")).cast("long").alias("taken"),
    ]


def _budget(rows: DataFrame, percent: int, copies: int, ranges: int):
    """Whether a copy (t, g, c, k, e) is in the prefix of all copies that fits the budget."""
    slot_of = lambda t: F.least(F.floor(t * ranges), F.lit(1 << 40))
    budget = (percent * F.col("all")) / 100
    total = Window.partitionBy(F.lit(0))
    upto = total.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        rows.groupBy(slot_of(F.col("t")).alias("slot"))
        .agg(F.sum("__size").alias("n"))
        .withColumn("all", F.sum("n").over(total) / copies)
        .withColumn("end", F.sum("n").over(upto))
        .filter(F.col("end") > budget)
        .orderBy("slot")
        .limit(1)
        .select("slot", (budget - (F.col("end") - F.col("n"))).alias("room"))
        .first()
    )
    if last is None:
        return lambda x: F.lit(True)
    # only the copies whose finish time lies in the range where the budget ends
    run = total.orderBy("t", "g", "c", "k", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    final = (
        rows.filter(slot_of(F.col("t")) == last["slot"])
        .withColumn("run", F.sum("__size").over(run))
        .filter(F.col("run") <= last["room"])
        .agg(F.max(F.struct("t", "g", "c", "k", "e")).alias("x"))
        .first()["x"]
    )
    if final is None:
        return lambda x: slot_of(x["t"]) < last["slot"]
    end = F.struct(*[F.lit(final[k]).cast(t).alias(k) for k, t in (("t", "double"), ("g", "string"), ("c", "int"), ("k", "string"), ("e", "long"))])
    return lambda x: (slot_of(x["t"]) < last["slot"]) | ((slot_of(x["t"]) == last["slot"]) & (x <= end))


def _whole(base: DataFrame, kept: list[str], placed: DataFrame, copies: int) -> DataFrame:
    """The rows of base as they are, with what the slim rows say of the ends of each source's prefixes."""
    here = F.struct(*ORDER)
    tops = cut(
        placed.groupBy("__group", "__source_size", "__target").agg(*[F.max(F.when(F.col("__n") > c, here)).alias(f"__top{c}") for c in range(copies)])
    )
    few = tops.count() <= BROADCAST_SOURCES
    # of the rows at an end, how many there are and how many are in
    at = [here.eqNullSafe(F.col(f"__top{c}")) for c in range(copies)]
    ends = placed.drop("__source_size", "__target").join(F.broadcast(tops) if few else tops, "__group")
    ends = ends.groupBy("__group", "__source_size", "__target", *[f"__top{c}" for c in range(copies)])
    ends = cut(
        ends.agg(*[f(x).alias(f"{n}{c}") for c in range(copies) for n, f, x in (("__all", F.count_if, at[c]), ("__in", F.count_if, at[c] & (F.col("__n") > c)))])
    )
    split = ends.agg(*[F.count_if(F.col(f"__in{c}") < F.col(f"__all{c}")).alias(f"x{c}") for c in range(copies)]).first()
    joined = base.join(F.broadcast(ends) if few else ends, "__group")
    within = lambda c: F.coalesce(here <= F.col(f"__top{c}"), F.lit(False))
    n = sum((within(c).cast("int") for c in range(copies)), F.lit(0))
    if not any(split):
        return joined.withColumn("__n", n).select(*kept, *_new())
    split = F.lit(False)
    for c in range(copies):
        split = split | (at[c] & (F.col(f"__in{c}") < F.col(f"__all{c}")))
    plain = joined.filter(~split).withColumn("__n", n).select(*kept, *_new())
    # rows that are the same in all columns: one stands for all, with their number
    same = [c for c in joined.columns if c not in (*kept, *ORDER, "__source")]
    one = joined.filter(split).groupBy(*ORDER, *same).agg(F.first(F.struct(*kept)).alias("__row"), F.count("*").alias("__m"))
    each = one.withColumn("__j", F.explode(F.sequence(F.lit(1), F.col("__m"))))
    n = sum((F.when(at[c], F.col("__j") <= F.col(f"__in{c}")).otherwise(within(c)).cast("int") for c in range(copies)), F.lit(0))
    return plain.unionByName(each.withColumn("__n", n).select(*[F.col("__row").getField(c).alias(c) for c in kept], *_new()))
