"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression; no user function runs. The compiler
turns each row of RULES into a comparison of whole numbers, so the verdict does
not depend on rounding.

Defined cases: a null text has no words; a text without words fails the base
rules; very long texts take the same path (positions of the repeated windows
are verified word for word, so a hash collision cannot change a count);
repeated rows are judged one by one; an empty table gives an empty result;
other columns pass through, and one that bears the name of an output gives way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.llm.common import SPACES, quoted, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it was on with as be by at this from or an are a "
    "der die das und den von zu mit ist im ein nicht auf des dem als "
    "le la les de et en un une est que qui dans pour sur au du pas par "
    "el los las del y se con una su al es lo para"
).split()
STOP_WORDS = sorted(set(STOP_WORDS))

SYMBOLS = "#*$%&|<>"
POSITION_BITS = 24


@dataclass(frozen=True)
class Rule:
    """low <= 100 * measure / of <= high, in whole percent; None: no bound."""

    name: str
    measure: str
    of: str
    low: int | None = None
    high: int | None = None


#: The thresholds.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_exclamations", "n_words", high=20),
    Rule("stop_words", "n_stop_words", "n_words", low=5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=40),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _measures(df: DataFrame) -> DataFrame:
    """df has __text; adds the measures as __name columns."""
    text = F.col("__text")
    df = df.withColumn("__words", words(text)).withColumn(
        "__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    w = F.col("__words")
    n = F.size(w)
    window_hash = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    mask = (1 << POSITION_BITS) - 1
    # one long per window: the upper bits of its hash, below them its position
    packed = F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda _, i: window_hash(i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn("__packed", F.sort_array(packed))
    p = F.col("__packed")
    upper = lambda x: F.shiftright(x, POSITION_BITS)
    alike = F.filter(
        p, lambda x, j: (upper(x) == upper(F.get(p, j - 1))) | (upper(x) == upper(F.get(p, j + 1)))
    )
    positions = F.transform(alike, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))
    everything = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    df = df.withColumn("__alike", F.when(n - 2 > mask, everything).otherwise(positions))
    # the windows themselves decide; only those with a twin by hash are built
    spelled = F.transform(
        F.col("__alike"),
        lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i")
        ),
    )
    df = df.withColumn("__spelled", F.sort_array(spelled))
    s = F.col("__spelled")
    twice = F.filter(
        s,
        lambda x, j: (x["s"] == F.get(s, j - 1)["s"]) | (x["s"] == F.get(s, j + 1)["s"]),
    )
    df = df.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    starts = F.col("__starts")
    covered = F.aggregate(
        F.transform(
            starts, lambda x, j: F.least(F.lit(3), F.coalesce(x - F.get(starts, j - 1), F.lit(3)))
        ),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    lines = F.col("__lines")
    return df.select(
        "__row",
        n.cast("long").alias("__n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("__word_chars"),
        _count(text, SYMBOLS).alias("__n_symbols"),
        _count(text, "!").alias("__n_exclamations"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("__n_stop_words"),
        F.size(lines).cast("long").alias("__n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("__n_dup_lines"),
        covered.alias("__n_repeat_words"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks, as an array."""

    def broken(r: Rule) -> Column:
        value, of = 100 * F.col(f"__{r.measure}"), F.col(f"__{r.of}")
        tests = [value < r.low * of] * (r.low is not None) + [value > r.high * of] * (r.high is not None)
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return F.when(out, F.lit(r.name))

    return F.array_compact(F.array(*[broken(r) for r in rules]))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the measures, base_failed, failed_rules and kept."""
    df = docs.select(
        F.struct(*[quoted(c) for c in docs.columns]).alias("__row"),
        F.coalesce(quoted(text), F.lit("")).alias("__text"),
    )
    df = _measures(df)
    n, repeats = F.col("__n_words"), F.col("__n_repeat_words")
    base = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    df = df.withColumns({"__base": base, "__broken": compile_rules(rules)})
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop_words n_exclamations".split()
    new = {k: F.col(f"__{k}") for k in names} | {
        "base_failed": F.col("__base"),
        "failed_rules": F.col("__broken"),
        "kept": ~F.col("__base") & (F.size("__broken") == 0),
    }
    taken = set(new)
    old = {c: F.col("__row").getField(c) for c in docs.columns if c.lower() not in taken}
    return df.select(*[e.alias(c) for c, e in old.items()], *[e.alias(c) for c, e in new.items()])


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The thresholds as one condition over the measures, for the SQL twin."""
    tests = [f"100 * {r.measure} >= {r.low} * {r.of}" for r in rules if r.low is not None]
    tests += [f"100 * {r.measure} <= {r.high} * {r.of}" for r in rules if r.high is not None]
    return " AND ".join(tests)
