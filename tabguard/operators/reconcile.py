"""Reconciliation of two tables: matched, discrepancies, only in A, only in B.

The result is one frame (bucket, match_level, key_similarity, a, b, differences);
the buckets are filters on it.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.errors import TableError, need
from tabguard.functions.similarity import length_bound, ratio
from tabguard.functions.text import ROW, col, data_columns, is_date, is_number, norm_text, number_text, try_date, try_number
from tabguard.operators.clean import apply_ops, dedupe
from tabguard.operators.graph import components, cut

DIFFERENCE = "struct<field:string,a:string,b:string,diff_abs:double,diff_pct:double>"
SECONDS_A_DAY = 86_400
#: What a profile may hold; the name says nothing here.
PROFILE_KEYS = {"name", "keys", "tolerance", "fuzzy_keys", "pre_recipe_a", "pre_recipe_b", "dedupe_a", "dedupe_b"}


def _key(c: Column, kind) -> Column:
    """A key as text, so that 7 and 7.0 and '7' meet; null stays null and meets null."""
    if is_number(kind):
        number = c.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        return F.when(whole, F.floor(number).cast("string")).otherwise(c.cast("string"))
    return norm_text(number_text(c, kind))


def _equal(a: Column, b: Column, kind_a, kind_b, tolerance: dict) -> Column:
    """Never null. Numbers by difference, dates by whole days, else text; fuzzy if asked for."""
    x, y = try_number(a, kind_a), try_number(b, kind_b)
    numbers = F.abs(x - y) <= F.lit(float(tolerance.get("numeric", 0)))
    same = norm_text(number_text(a, kind_a)) == norm_text(number_text(b, kind_b))
    fuzzy = tolerance.get("fuzzy", 0)
    text = same
    if fuzzy:
        p, q = norm_text(number_text(a, kind_a)), norm_text(number_text(b, kind_b))
        text = same | ((length_bound(p, q) >= fuzzy) & (ratio(p, q, fuzzy) >= fuzzy))
    out = F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False)
    out = out.when(same, True)  # what reads the same is the same number and the same date, without parsing either
    if not (is_date(kind_a) or is_date(kind_b)):
        out = out.when(x.isNotNull() & y.isNotNull(), numbers)
    if not (is_number(kind_a) or is_number(kind_b)):
        d, e = try_date(a, kind_a), try_date(b, kind_b)
        # seconds of the day count: whole days are those of the floored difference
        days = F.floor((F.unix_micros(d.cast("timestamp")) - F.unix_micros(e.cast("timestamp"))) / (SECONDS_A_DAY * 1_000_000))
        out = out.when(d.isNotNull() & e.isNotNull(), F.abs(days) <= tolerance.get("days", 0))
    return F.coalesce(out.otherwise(text), F.lit(False))


def _difference(field: str, a: Column, b: Column, kind_a, kind_b) -> Column:
    x, y = try_number(a, kind_a), try_number(b, kind_b)
    return F.struct(
        F.lit(field).alias("field"),
        number_text(a, kind_a).alias("a"),
        number_text(b, kind_b).alias("b"),
        F.round(y - x, 6).alias("diff_abs"),
        F.round(100 * F.try_divide(y - x, F.abs(x)), 4).alias("diff_pct"),
    )


def _sorted(df: DataFrame) -> DataFrame:
    """df, not to be broadcast: records and keys can be far larger than the files that Spark estimates them by."""
    return df.hint("merge")


def _sides(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    fields = data_columns(df)
    for k in keys:
        need(k, fields, f"key column of {name}")
    joined = F.array(*[F.coalesce(F.concat(F.lit("="), _key(col(k), df.schema[k].dataType)), F.lit("null")) for k in keys])
    record = F.struct(*[col(c) for c in fields]) if fields else F.struct()
    return df.select(joined.alias("key"), col(ROW).alias("row"), record.alias("rec"))


def reconcile(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    tolerance: dict | None = None,
    fuzzy_keys: float | None = None,
) -> DataFrame:
    if not keys:
        raise TableError("reconcile needs a key column")
    kinds_a = {c: a.schema[c].dataType for c in data_columns(a)}
    kinds_b = {c: b.schema[c].dataType for c in data_columns(b)}
    fields = [c for c in kinds_a if c in kinds_b and c not in keys]
    left, right = _sides(a, keys, "a").toDF("ka", "ra", "a"), _sides(b, keys, "b").toDF("kb", "rb", "b")
    paired = _best(left.join(_sorted(right), F.col("ka") == F.col("kb")), fields, kinds_a, kinds_b, tolerance)
    paired = paired.withColumn("key_similarity", F.lit(None).cast("double"))
    alone_a = left.join(_sorted(right.select("kb").distinct()), F.col("ka") == F.col("kb"), "left_anti")
    alone_b = right.join(_sorted(left.select("ka").distinct()), F.col("ka") == F.col("kb"), "left_anti")
    if fuzzy_keys:
        links = cut(_fuzzy_links(alone_a, alone_b, fuzzy_keys))
        joined = alone_a.join(_sorted(links), F.col("ka") == F.col("la")).join(_sorted(alone_b), F.col("kb") == F.col("lb"))
        close = _best(joined, fields, kinds_a, kinds_b, tolerance, "similarity").withColumnRenamed("similarity", "key_similarity")
        close = close.withColumn("match_level", F.lit("L3"))
        alone_a = alone_a.join(_sorted(links.select("la").distinct()), F.col("ka") == F.col("la"), "left_anti")
        alone_b = alone_b.join(_sorted(links.select("lb").distinct()), F.col("kb") == F.col("lb"), "left_anti")
        paired = paired.unionByName(close.select(*paired.columns))
    level = F.when(F.size("differences") == 0, F.col("match_level")).otherwise(
        F.when(F.col("match_level") == "L3", "L3").otherwise("exact")
    )
    both = paired.select(
        F.when(F.size("differences") == 0, "matched").otherwise("discrepancy").alias("bucket"),
        level.alias("match_level"),
        "key_similarity",
        "a",
        "b",
        "differences",
    )
    nothing = lambda kind: F.lit(None).cast(kind)
    kind_a, kind_b = left.schema["a"].dataType, right.schema["b"].dataType
    empty = F.array().cast(f"array<{DIFFERENCE}>")
    only_a = alone_a.select(F.lit("only_in_a").alias("bucket"), nothing("string").alias("match_level"), nothing("double").alias("key_similarity"), "a", nothing(kind_b).alias("b"), empty.alias("differences"))
    only_b = alone_b.select(F.lit("only_in_b").alias("bucket"), nothing("string").alias("match_level"), nothing("double").alias("key_similarity"), nothing(kind_a).alias("a"), "b", empty.alias("differences"))
    return both.unionByName(only_a).unionByName(only_b)


def _best(pairs: DataFrame, fields, kinds_a, kinds_b, tolerance, *more: str) -> DataFrame:
    """For each row of A the row of B that differs in the fewest fields, the earliest on ties."""
    tests = {}
    for f in fields:
        x, y = F.col("a").getField(f), F.col("b").getField(f)
        same = _equal(x, y, kinds_a[f], kinds_b[f], tolerance or {})
        tests[f] = F.when(~same, _difference(f, x, y, kinds_a[f], kinds_b[f]))
    found = F.array_compact(F.array(*tests.values())) if tests else F.array()
    pairs = pairs.withColumn("differences", found.cast(f"array<{DIFFERENCE}>"))
    carried = F.struct("rb", "a", "b", "differences", *more)
    # a mergeable minimum: the candidates of one key need not meet in one task
    best = pairs.groupBy("ra", "ka").agg(F.min_by(carried, F.struct(F.size("differences").alias("n"), F.col("rb"))).alias("x")).select("x.*")
    level = F.lit("L1")
    if tolerance is not None and fields:
        exact = F.lit(True)
        for f in fields:
            exact = exact & _equal(F.col("a").getField(f), F.col("b").getField(f), kinds_a[f], kinds_b[f], {})
        level = F.when(exact, "L1").otherwise("L2")
    return best.withColumn("match_level", level).select("match_level", "a", "b", "differences", *more)


#: Pairs of keys that a product of matrices compares in the time of one joined pair, pairs up to which nothing else is tried, and classes in a block.
GAIN, FEW_PAIRS, BLOCK = 20, 5_000_000, 2000
#: Candidates whose groups are assigned in one task.
LINKS_A_TASK = 50_000


def _lengths(keys: DataFrame) -> dict[int, int]:
    """How many keys have each length; no length is 0."""
    return {r["n"]: r["count"] for r in keys.filter("t <> ''").groupBy(F.length("t").alias("n")).count().collect()}


def _combinations(left: dict[int, int], right: dict[int, int], threshold: float) -> dict[tuple[int, int], int]:
    """The characters that keys of two lengths must match to reach the threshold, for lengths that can."""
    least = lambda n, m: max(1, ceil(threshold * (n + m) / 2 - 1e-9))
    return {(n, m): least(n, m) for n in left for m in right if least(n, m) <= min(n, m)}


def _segments(a: DataFrame, b: DataFrame, combinations: dict[tuple[int, int], int]) -> tuple[DataFrame, DataFrame]:
    """Tokens (n, m, i, s) of the keys of both sides, one of which any partners have in common.

    Partners with M matched characters leave e = n + m - 2 M unmatched, each of which
    spoils one segment of A at most. So one of e + 1 segments is found in B as it is, moved
    back by as many characters as A has unmatched ones and on by as many as B has.
    """
    table = [(n, m, n - least, m - least, n + m - 2 * least + 1) for (n, m), least in combinations.items()]
    table = F.broadcast(a.sparkSession.createDataFrame(table, "n int, m int, back int, on int, parts int"))
    start = lambda i: F.floor(i * F.col("n") / F.col("parts")).cast("int")
    size = lambda i: start(i + 1) - start(i)
    numbers = F.sequence(F.lit(0), F.col("parts") - 1)
    piece = lambda i, at: F.struct(i.alias("i"), F.substr("t", at + 1, size(i)).alias("s"))
    last = lambda i: F.least(F.col("m") - size(i), start(i) + F.col("on"))
    first = lambda i: F.least(F.greatest(F.lit(0), start(i) - F.col("back")), last(i))
    own = F.transform(numbers, lambda i: piece(i, start(i)))
    moved = F.flatten(F.transform(numbers, lambda i: F.transform(F.sequence(first(i), last(i)), lambda at: piece(i, at))))
    x = a.withColumn("n", F.length("t")).join(table, "n").select("n", "m", F.col("p").alias("pa"), F.inline(own))
    y = b.withColumn("m", F.length("t")).join(table, "m").select("n", "m", F.col("p").alias("pb"), F.inline(F.array_distinct(moved)))
    return x, y


def _blocks(keys: DataFrame, lengths: dict[int, int], n: str, class_: str) -> tuple[DataFrame, DataFrame]:
    """Keys with their class, and blocks of classes: keys with the same characters are of one class."""
    letters = F.array_join(F.array_sort(F.split("t", "")), "")
    classes = keys.filter("t <> ''").groupBy(letters.alias("letters")).agg(F.min("p").alias(class_), F.collect_list("p").alias("members"))
    classes = cut(classes.withColumn(n, F.length("letters")))
    table = F.broadcast(keys.sparkSession.createDataFrame([(k, -(-v // BLOCK)) for k, v in lengths.items()], f"{n} int, parts int"))
    block = F.pmod(F.xxhash64("letters"), F.col("parts")).alias("block")
    blocks = classes.join(table, n).groupBy(n, block).agg(F.collect_list(F.struct(class_, "letters")).alias(f"{class_}s"))
    return classes.select(class_, F.explode("members").alias("p")), blocks.drop("block")


def _characters(texts: list[str], slots: dict) -> list[tuple[int, int]]:
    """Cells of a matrix of the texts by the first, second .. occurrence of each character."""
    out = []
    for i, text in enumerate(texts):
        seen: Counter = Counter()
        for c in text:
            seen[c] += 1
            out.append((i, slots.setdefault((c, seen[c]), len(slots))))
    return out


def _products(a: DataFrame, b: DataFrame, left: dict[int, int], right: dict[int, int], combinations: dict[tuple[int, int], int]) -> DataFrame:
    """(pa, pb) of the keys that have enough characters in common, by products of matrices of their classes."""
    table = a.sparkSession.createDataFrame([(n, m, least) for (n, m), least in combinations.items()], "n int, m int, least int")
    keys_a, blocks_a = _blocks(a, left, "n", "ca")
    keys_b, blocks_b = _blocks(b, right, "m", "cb")

    def compare(batches):
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                slots: dict = {}
                cells = [_characters([c["letters"] for c in r[k]], slots) for k in ("cas", "cbs")]
                x, y = (np.zeros((len(r[k]), len(slots)), dtype=np.float32) for k in ("cas", "cbs"))
                for matrix, at in zip((x, y), cells):
                    matrix[tuple(np.array(at).T)] = 1
                ca, cb = (np.array([c[k] for c in r[f"{k}s"]], dtype=np.int64) for k in ("ca", "cb"))
                for at in range(0, len(ca), 100):
                    i, j = np.nonzero(x[at : at + 100] @ y.T > r["least"] - 0.5)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(ca[i + at]), pa.array(cb[j])], names=["ca", "cb"])

    work = blocks_a.join(F.broadcast(table), "n").join(_sorted(blocks_b), "m").select("least", "cas", "cbs")
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = work.repartition(parts).mapInArrow(compare, "ca bigint, cb bigint")
    return near.join(_sorted(keys_a.withColumnRenamed("p", "pa")), "ca").join(_sorted(keys_b.withColumnRenamed("p", "pb")), "cb").select("pa", "pb")


def _candidates(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Pairs of keys that may reach the threshold: those that share a segment or enough characters.

    For each two lengths it is counted how many pairs share a segment. Where these are not
    far fewer than all pairs, as with keys that begin alike, all are compared at once.
    """
    left, right = _lengths(a), _lengths(b)
    combinations = _combinations(left, right, threshold)
    all_ = {(n, m): left[n] * right[m] for n, m in combinations}
    split = {c: least for c, least in combinations.items() if 2 * (sum(c) - 2 * least + 1) <= c[0]}
    near = a.sparkSession.createDataFrame([], "pa long, pb long")
    if split and sum(all_.values()) > FEW_PAIRS:
        x, y = _segments(a, b, split)
        tokens = ["n", "m", "i", "s"]
        often = x.groupBy(tokens).agg(F.count("*").alias("x")).join(_sorted(y.groupBy(tokens).agg(F.count("*").alias("y"))), tokens)
        met = {(r["n"], r["m"]): r["z"] for r in often.groupBy("n", "m").agg(F.sum(F.col("x") * F.col("y")).alias("z")).collect()}
        split = {c: least for c, least in split.items() if GAIN * met.get(c, 0) <= all_[c]}
        if split:
            x, y = _segments(a, b, split)
            near = x.join(_sorted(y), tokens).select("pa", "pb")
    else:
        split = {}
    rest = {c: least for c, least in combinations.items() if c not in split}
    if rest:
        near = near.unionByName(_products(a, b, left, right, rest))
    x, y = a.toDF("ka", "pa", "ta"), b.toDF("kb", "pb", "tb")
    return near.distinct().join(_sorted(x), "pa").join(_sorted(y), "pb")


def _fuzzy_links(alone_a: DataFrame, alone_b: DataFrame, threshold: float) -> DataFrame:
    """(la, lb, similarity): keys of A, in order of appearance, take the most similar free key of B.

    Candidates lose no pair at the threshold. The assignment depends on its order, so it
    runs in sequence within the groups of keys that candidates connect, many groups in a task.
    """
    words = lambda k: F.array_join(F.transform(k, lambda x: F.when(x == "null", "").otherwise(F.substr(x, F.lit(2)))), " ")
    a = cut(alone_a.groupBy("ka").agg(F.min("ra").alias("p")).select(F.col("ka").alias("k"), "p", words(F.col("ka")).alias("t")))
    b = cut(alone_b.groupBy("kb").agg(F.min("rb").alias("p")).select(F.col("kb").alias("k"), "p", words(F.col("kb")).alias("t")))
    near = _candidates(a, b, threshold)
    found = cut(near.withColumn("s", ratio(F.col("ta"), F.col("tb"), threshold)).filter(F.col("s") >= threshold).select("ka", "pa", "kb", "pb", "s"))

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        out, done, used = [], set(), set()
        rows = rows.sort_values(["pa", "s", "pb"], ascending=[True, False, True], kind="stable")
        for r in rows.itertuples():
            if r.pa not in done and r.pb not in used:
                done.add(r.pa)
                used.add(r.pb)
                out.append((r.ka, r.kb, round(r.s, 4)))
        return pd.DataFrame(out, columns=["la", "lb", "similarity"])

    # a pair without rivals is a group by itself
    rivals = lambda p: found.groupBy(p).count().filter("count > 1").select(p, F.lit(True).alias(f"more_{p}"))
    marked = found.join(rivals("pa"), "pa", "left").join(rivals("pb"), "pb", "left")
    alone = F.col("more_pa").isNull() & F.col("more_pb").isNull()
    columns = ["ka", "pa", "kb", "pb", "s"]
    single = marked.filter(alone).select(*columns, (2 * F.col("pa")).alias("label"))
    rest = marked.filter(~alone).select(*columns)
    grouped = single
    if not rest.isEmpty():
        # keys of A are even, keys of B odd, so that both are nodes of one graph
        edges = rest.select((2 * F.col("pa")).alias("a"), (2 * F.col("pb") + 1).alias("b"))
        group = components(edges)
        grouped = grouped.unionByName(rest.join(_sorted(group), 2 * F.col("pa") == F.col("node")).select(*columns, "label"))
    kind = alone_a.schema["ka"].dataType.simpleString()
    tasks = -(-found.count() // LINKS_A_TASK) or 1
    return grouped.groupBy(F.pmod(F.xxhash64("label"), F.lit(tasks))).applyInPandas(assign, f"la {kind}, lb {kind}, similarity double")


def buckets(result: DataFrame) -> dict[str, DataFrame]:
    return {b: result.filter(F.col("bucket") == b) for b in ("matched", "discrepancy", "only_in_a", "only_in_b")}


def bucket_counts(result: DataFrame) -> DataFrame:
    return result.groupBy("bucket").agg(F.count("*").alias("n"))


def summary(result: DataFrame) -> DataFrame:
    """One row: counts, match rate, counts by level, and the absolute variance of each field."""
    n = lambda b: F.count_if(F.col("bucket") == b)
    level = lambda v: F.count_if((F.col("bucket") == "matched") & (F.col("match_level") == v))
    whole = n("matched") + n("discrepancy") + n("only_in_a")
    return result.agg(
        n("matched").alias("matched"),
        n("discrepancy").alias("discrepancies"),
        n("only_in_a").alias("only_in_a"),
        n("only_in_b").alias("only_in_b"),
        F.round(F.coalesce(F.try_divide(n("matched"), whole), F.lit(0.0)), 4).alias("match_rate"),
        level("L1").alias("level_1"),
        level("L2").alias("level_2"),
        level("L3").alias("level_3"),
    )


def variance_by_field(result: DataFrame) -> DataFrame:
    rows = result.select(F.explode("differences").alias("d")).select("d.*")
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(F.abs("diff_abs")), F.lit(0.0)), 4).alias("total_abs"))


def run_profile(a: DataFrame, b: DataFrame, profile: dict) -> DataFrame:
    """Recipes and dedupe for each side, then reconcile."""
    for key in profile:
        need(key, PROFILE_KEYS, "profile key")
    sides = []
    for df, name in ((a, "a"), (b, "b")):
        recipe = profile.get(f"pre_recipe_{name}")
        if recipe:
            df = apply_ops(df, recipe["steps"] if isinstance(recipe, dict) else recipe)
        if once := profile.get(f"dedupe_{name}"):
            df = dedupe(df, **once)
        sides.append(df)
    return reconcile(*sides, profile["keys"], profile.get("tolerance"), profile.get("fuzzy_keys"))
