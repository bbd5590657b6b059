"""Questions answered by a planner that returns JSON, and by execute_plan.

The planner is any callable from a prompt to text, so none is needed for tests.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.errors import PlanError
from tabguard.functions.text import col, data_columns
from tabguard.plans.query_plan import execute_plan

Planner = Callable[[str], str]
CONTEXT_CHARS, CONTEXT_ROWS, EVIDENCE_ROWS = 4000, 20, 200


class PlannerError(RuntimeError):
    """The planner gave no usable JSON, twice."""


@dataclass
class Answer:
    text: str
    plan: dict | None = None
    evidence: list[dict] = field(default_factory=list)
    refused: bool = False


def extract_json(reply: str):
    """The first JSON object or array in a reply that may hold prose or a code fence."""
    decoder = json.JSONDecoder()
    for i, c in enumerate(reply):
        if c in "{[":
            try:
                return decoder.raw_decode(reply, i)[0]
            except ValueError:
                continue
    raise ValueError("no JSON in the reply")


def json_call(planner: Planner, prompt: str):
    """The planner's JSON, with one chance to repair it."""
    reply = planner(prompt)
    try:
        return extract_json(reply)
    except ValueError:
        reply = planner(f"{prompt}\n\nThis reply was not valid JSON:\n{reply}\nReply with valid JSON only.")
    try:
        return extract_json(reply)
    except ValueError as e:
        raise PlannerError(str(e)) from None


def context(df: DataFrame) -> str:
    """Rows, types, distinct counts and a few rows, within a bound."""
    names = data_columns(df)
    counts = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(names)]).first()
    lines = [f"{counts['n']} rows"]
    lines += [f"- {c}: {df.schema[c].dataType.simpleString()}, about {counts[f'd{i}']} distinct" for i, c in enumerate(names)]
    lines += df.select(*map(col, names)).limit(CONTEXT_ROWS).toJSON().collect()
    return "\n".join(lines)[:CONTEXT_CHARS]


def ask(df: DataFrame, question: str, planner: Planner) -> Answer:
    """An answer computed from a plan; the planner plans and narrates, it never computes."""
    prompt = (
        "Answer a question about a table with a JSON plan of filters, group_by, aggregates, sort and limit, "
        'or with {"refuse": reason}.\n' + context(df) + f"\nQuestion: {question}"
    )
    try:
        plan = json_call(planner, prompt)
    except PlannerError as e:
        return Answer(f"no plan could be made: {e}", refused=True)
    if not isinstance(plan, dict) or "refuse" in plan:
        return Answer(str(plan.get("refuse") if isinstance(plan, dict) else "the plan is no object"), refused=True)
    try:
        rows = [r.asDict(recursive=True) for r in execute_plan(df, plan).limit(EVIDENCE_ROWS).collect()]
    except PlanError as e:
        return Answer(f"the plan was refused: {e}", plan, refused=True)
    try:
        text = str(planner(f"Question: {question}\nRows: {json.dumps(rows, default=str)[:CONTEXT_CHARS]}\nSay the answer.")).strip()
    except Exception:  # a planner may fail in any way; the rows stand
        text = ""
    return Answer(text or f"{len(rows)} row(s) match.", plan, rows)
