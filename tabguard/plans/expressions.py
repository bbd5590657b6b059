"""Row conditions written as Python comparisons, compiled to Columns.

Only names, constants, comparisons, arithmetic and and/or/not are allowed. A
comparison with a missing side is false, except != which is true.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.errors import PlanError
from tabguard.functions.text import col, is_number, try_number, type_of

_COMPARE = {
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}
_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
}


def compile_expression(df: DataFrame, text: str) -> Column:
    """The condition as a Column that is never null."""
    # & and | as used for frames, and names in back quotes
    quoted: dict[str, str] = {}

    def keep(m: re.Match) -> str:
        quoted[key := f"__q{len(quoted)}"] = m[1]
        return key

    source = re.sub(r"`([^`]+)`", keep, text).replace("&", " and ").replace("|", " or ").replace("~", " not ")
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise PlanError(f"can't read expression {text!r}: {e.msg}") from None

    def value(node: ast.AST) -> tuple[Column, bool]:
        """Column, and whether it is a number."""
        if isinstance(node, ast.Name):
            name = quoted.get(node.id, node.id)
            if name not in df.columns:
                raise PlanError(f"unknown column {name!r} in {text!r}; valid: {', '.join(df.columns)}")
            kind = type_of(df, name)
            return (try_number(col(name), kind), True) if is_number(kind) else (col(name), False)
        if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float, str)):
            is_a_number = isinstance(node.value, (int, float)) and not isinstance(node.value, bool)
            return F.lit(float(node.value) if is_a_number else node.value), is_a_number
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            a, _ = value(node.operand)
            return (-a if isinstance(node.op, ast.USub) else a), True
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            a, b = value(node.left)[0], value(node.right)[0]
            return _ARITHMETIC[type(node.op)](a.try_cast("double"), b.try_cast("double")), True
        raise PlanError(f"{ast.dump(node)[:60]} is not allowed in {text!r}")

    def condition(node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [condition(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~condition(node.operand)
        if isinstance(node, ast.Compare):
            out, left = None, node.left
            for op, right in zip(node.ops, node.comparators):
                if type(op) not in _COMPARE:
                    raise PlanError(f"{type(op).__name__} is not allowed in {text!r}")
                (a, a_number), (b, b_number) = value(left), value(right)
                if a_number != b_number:
                    a, b = (a if a_number else try_number(a)), (b if b_number else try_number(b))
                test = F.coalesce(_COMPARE[type(op)](a, b), F.lit(isinstance(op, ast.NotEq)))
                out, left = test if out is None else out & test, right
            return out
        if isinstance(node, ast.Name):
            name = quoted.get(node.id, node.id)
            if name in df.columns and isinstance(type_of(df, name), T.BooleanType):
                return F.coalesce(col(name), F.lit(False))
        raise PlanError(f"{text!r} is no condition")

    return condition(tree)
