"""The condition language: compiled to a Column for filters, evaluated on values for steps.

Literals, names, dotted attributes, ``and``, ``or``, ``not``, chained comparisons, and ``exists(x)``.
Everything else (calls, subscripts, ``in``, lambdas, arithmetic, dunder attributes) is refused.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConditionError(ValueError):
    """The condition is malformed, refused or names something unknown."""


_OPS = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def parse(condition: str) -> ast.expr:
    text = condition.strip()
    if text.lower() in ("true", "false"):
        return ast.Constant(text.lower() == "true")
    try:
        return ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise ConditionError(f"not an expression: {condition!r}") from e


def _argument(node: ast.Call) -> ast.expr:
    if not isinstance(node.func, ast.Name) or node.func.id != "exists" or len(node.args) != 1 or node.keywords:
        raise ConditionError("only exists(x) may be called")
    return node.args[0]


def _attribute(node: ast.Attribute) -> str:
    if node.attr.startswith("__"):
        raise ConditionError(f"unknown attribute {node.attr!r}")
    return node.attr


def evaluate(condition: str, values: Mapping[str, Any]) -> bool:
    """Truth of a condition over values; attributes reach into mappings only."""

    def of(n: ast.expr) -> Any:
        match n:
            case ast.Constant():
                return n.value
            case ast.Name():
                if n.id not in values:
                    raise ConditionError(f"unknown name {n.id!r}")
                return values[n.id]
            case ast.Attribute():
                owner, name = of(n.value), _attribute(n)
                if not isinstance(owner, Mapping) or name not in owner:
                    raise ConditionError(f"unknown attribute {name!r}")
                return owner[name]
            case ast.BoolOp():
                all_of = [bool(of(v)) for v in n.values]  # every side is evaluated, so unknown names show
                return all(all_of) if isinstance(n.op, ast.And) else any(all_of)
            case ast.UnaryOp(op=ast.Not()):
                return not of(n.operand)
            case ast.Compare():
                left = of(n.left)
                for op, right in zip(n.ops, map(of, n.comparators)):
                    if type(op) not in _OPS:
                        raise ConditionError("this comparison is not allowed")
                    if not _OPS[type(op)](left, right):
                        return False
                    left = right
                return True
            case ast.Call():
                arg = _argument(n)
                if isinstance(arg, ast.Name):
                    return arg.id in values
                try:
                    return of(arg) is not None
                except ConditionError:
                    return False
        raise ConditionError(f"not allowed in a condition: {type(n).__name__}")

    return bool(of(parse(condition)))


def compile_condition(condition: str, schema: T.StructType) -> Column:
    """The condition as a Column over a schema, so that Catalyst can push it into the scan.

    A comparison with null is false, as a filter has it; ``exists(name)`` asks the schema.
    """

    def kind(n: ast.expr) -> T.DataType | None:
        """The type of a path; None if it does not exist."""
        if isinstance(n, ast.Name):
            return schema[n.id].dataType if n.id in schema.names else None
        if isinstance(n, ast.Attribute):
            owner, name = kind(n.value), _attribute(n)
            if isinstance(owner, T.StructType):
                return owner[name].dataType if name in owner.names else None
            return owner.valueType if isinstance(owner, T.MapType) else None
        return None

    def of(n: ast.expr) -> Column:
        match n:
            case ast.Constant():
                return F.lit(n.value)
            case ast.Name():
                if n.id not in schema.names:
                    raise ConditionError(f"unknown name {n.id!r}")
                return F.col(f"`{n.id}`")
            case ast.Attribute():
                if kind(n) is None:
                    raise ConditionError(f"unknown attribute {n.attr!r}")
                return of(n.value)[_attribute(n)]
            case ast.BoolOp():
                sides = [truth(v) for v in n.values]
                return reduce(operator.and_ if isinstance(n.op, ast.And) else operator.or_, sides)
            case ast.UnaryOp(op=ast.Not()):
                return ~F.coalesce(truth(n.operand), F.lit(False))
            case ast.Compare():
                ends = [of(x) for x in (n.left, *n.comparators)]
                if any(type(op) not in _OPS for op in n.ops):
                    raise ConditionError("this comparison is not allowed")
                return reduce(operator.and_, [_OPS[type(op)](a, b) for op, a, b in zip(n.ops, ends, ends[1:])])
            case ast.Call():
                arg = _argument(n)
                if isinstance(arg, ast.Name):
                    return F.lit(arg.id in schema.names)
                try:
                    return of(arg).isNotNull()
                except ConditionError:
                    return F.lit(False)
        raise ConditionError(f"not allowed in a condition: {type(n).__name__}")

    def truth(n: ast.expr) -> Column:
        """The value of a side as a truth value: numbers by being other than 0, strings by not being empty."""
        c, t = of(n), kind(n)
        if isinstance(n, ast.Constant):
            return F.lit(bool(n.value))
        if isinstance(t, T.NumericType):
            return c != 0
        if isinstance(t, T.StringType):
            return c != ""
        return c

    return truth(parse(condition))


def where(df: DataFrame, condition: str) -> DataFrame:
    return df.where(compile_condition(condition, df.schema))
