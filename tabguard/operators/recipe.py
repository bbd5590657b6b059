"""Replayable recipes of cleaning steps, with an optional semantic map by a callable."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.errors import RecipeError, need
from tabguard.functions.text import col, data_columns, number_text, type_of
from tabguard.operators.clean import OPS, apply_ops
from tabguard.plans.planner import Planner, context, json_call

Mapper = Callable[[str, str], str]
#: Steps that change values, and so write copies unless told to replace.
VALUE_OPS = {"trim", "case", "replace_text", "remove_chars", "math", "absolute", "strip_currency", "parse_date", "slice_text", "fill_down"}
SUFFIX = "_ai"
MAP_OP = "llm_map"
PREVIEW_ROWS = 20


def validate_recipe(recipe: dict) -> list[dict]:
    """The steps of a well-formed recipe."""
    if not isinstance(recipe, dict) or not isinstance(recipe.get("steps"), list) or not recipe["steps"]:
        raise RecipeError('a recipe is {"steps": [{"op": ..., "params": {...}}, ...]} with a step at least')
    for i, step in enumerate(recipe["steps"]):
        if not isinstance(step, dict):
            raise RecipeError(f"step {i} is no dict")
        name = need(step.get("op"), {*OPS, MAP_OP}, f"op in step {i}", RecipeError)
        if extra := set(step) - {"op", "params"}:
            raise RecipeError(f"step {i}: put {', '.join(sorted(extra))} into params")
        params = step.get("params", {})
        if not isinstance(params, dict):
            raise RecipeError(f"step {i}: params is no dict")
        if name == MAP_OP:
            if missing := {"column", "into", "instruction"} - set(params):
                raise RecipeError(f"step {i}: {MAP_OP} needs {', '.join(sorted(missing))}")
            continue
        known = [p for p in inspect.signature(OPS[name]).parameters if p != "df"]
        for p in params:
            need(p, known, f"parameter in step {i}", RecipeError)
    return recipe["steps"]


def map_values(df: DataFrame, column: str, mapper: Mapper, instruction: str, into: str) -> DataFrame:
    """df with mapper(value, instruction) for each value; each distinct value is mapped once."""
    need(column, data_columns(df), "column")

    def run(batches):
        for batch in batches:
            out = []
            for v in batch["__v"]:
                try:
                    out.append(str(mapper(v, instruction)))
                except Exception:  # a mapper may fail in any way; its value is then empty
                    out.append("")
            yield pd.DataFrame({"__v": batch["__v"], "__m": out})

    text = number_text(col(column), type_of(df, column))
    values = df.select(text.alias("__v")).filter("__v IS NOT NULL").distinct()
    mapped = values.mapInPandas(run, "__v string, __m string").withColumnRenamed("__v", "__w")
    out = df.drop(into) if into != column else df
    joined = out.join(mapped, text == F.col("__w"), "left")
    if into == column:
        return joined.withColumn(column, F.col("__m")).drop("__w", "__m")
    return joined.withColumn(into, F.col("__m")).drop("__w", "__m")


def split_values(df: DataFrame, column: str, splitter: Callable[[str], list[str]], names: list[str], into: str = "parts") -> DataFrame:
    """df with an array of as many parts as there are names."""
    n = len(names)

    def joined(value: str, _: str) -> str:
        parts = [str(p) for p in splitter(value)][:n]
        return "\x1f".join(parts + [""] * (n - len(parts)))

    out = map_values(df, column, joined, "", "__joined")
    empty = F.array(*[F.lit("")] * n)
    parts = F.split(F.col("__joined"), "\x1f", -1)
    return out.withColumn(into, F.when(F.size(parts) == n, parts).otherwise(empty)).drop("__joined")


def apply_recipe(df: DataFrame, recipe: dict, replace: bool = False, mapper: Mapper | None = None) -> DataFrame:
    """The steps in order; value steps work on copies with a suffix unless told to replace."""
    for i, step in enumerate(validate_recipe(recipe)):
        name, params = step["op"], dict(step.get("params", {}))
        if name == MAP_OP:
            if mapper is None:
                raise RecipeError(f"step {i}: {MAP_OP} needs a mapper")
            df = map_values(df, params["column"], mapper, params["instruction"], params["into"])
            continue
        if name in VALUE_OPS and not replace:
            key = next((k for k in ("columns", "column", "left") if k in params), "columns")
            given = params.get(key)
            if key == "left" and given not in df.columns:  # a number
                given = None
            if given is not None and not params.get("into"):
                names = [given] if isinstance(given, str) else list(given)
                copies = {}
                for c in names:
                    # a later step on the same column goes on from its copy
                    target = c if c.endswith(SUFFIX) else c + SUFFIX
                    if target not in df.columns:
                        copies[target] = col(need(c, data_columns(df), f"column in step {i}", RecipeError))
                if copies:
                    df = df.withColumns(copies)
                targets = [c if c.endswith(SUFFIX) else c + SUFFIX for c in names]
                params[key] = targets[0] if isinstance(given, str) else targets
        df = apply_ops(df, [{"op": name, "params": params}])
    return df


def preview(df: DataFrame, instruction: str, planner: Planner, mapper: Mapper | None = None) -> dict:
    """A recipe for the instruction, and a few rows before and after it."""
    prompt = f'Write a JSON recipe {{"steps": [...]}} with the ops {", ".join(sorted(OPS))}.\n{context(df)}\nTask: {instruction}'
    recipe = json_call(planner, prompt)
    validate_recipe(recipe)
    some = df.limit(PREVIEW_ROWS)
    rows = lambda d: [r.asDict(recursive=True) for r in d.collect()]
    return {"recipe": recipe, "before": rows(some), "after": rows(apply_recipe(some, recipe, mapper=mapper))}
