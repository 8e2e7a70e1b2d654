"""Arithmetic expressions compiled to columns.

Numbers, a-d, + - * / // % **, unary minus and plus, min max abs round sqrt floor ceil clamp. Division by
zero gives 0 where it stands; // and % by zero, and every error of the syntax or of a function, make the
whole result 0. Exponents are clamped to +-100. Division and modulo floor, rounding is to even. A result
that is no finite number is 0.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = ("a", "b", "c", "d")


class _Bad(ValueError):
    pass


def _floor_div(x: Column, y: Column) -> Column:
    return F.floor(F.try_divide(x, y)).cast("double")


def _power(x: Column, y: Column) -> Column:
    e = F.when(y > 100, 100.0).when(y < -100, -100.0).otherwise(y)
    return F.when((x == 0) & (e < 0), F.lit(None)).otherwise(F.pow(x, e))


def _call(name: str, args: list[Column]) -> Column:
    one = {"abs": F.abs, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "sqrt": lambda x: F.when(x >= 0, F.sqrt(x))}
    if name in one and len(args) == 1:
        return one[name](args[0])
    if name == "round" and len(args) == 1:
        return F.rint(args[0])
    if name in ("min", "max") and len(args) >= 2:
        return (F.least if name == "min" else F.greatest)(*args)
    if name == "clamp" and len(args) == 3:
        return F.greatest(args[1], F.least(args[2], args[0]))
    raise _Bad(name)


def _compile(node: ast.AST, names: dict[str, Column]) -> Column:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name) and node.id in names:
        return names[node.id]
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        inner = _compile(node.operand, names)
        return -inner if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.BinOp):
        x, y = _compile(node.left, names), _compile(node.right, names)
        if isinstance(node.op, ast.Div):
            return F.when(y == 0, 0.0).otherwise(F.try_divide(x, y))
        made = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.FloorDiv: lambda: _floor_div(x, y), ast.Mod: lambda: x - y * _floor_div(x, y), ast.Pow: lambda: _power(x, y)}
        if type(node.op) in made:
            return made[type(node.op)]()
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        return _call(node.func.id, [_compile(x, names) for x in node.args])
    raise _Bad(ast.dump(node))


def math_eval(expression: str, variables: dict[str, Column] | None = None, round_to: int = -1) -> Column:
    """struct(result, int_result) of an expression; Catalyst folds what is constant."""
    names = {k: (variables or {}).get(k, F.lit(0.0)).cast("double") for k in _NAMES}
    try:
        value = _compile(ast.parse(expression, mode="eval").body, names)
    except (SyntaxError, _Bad, ValueError):
        value = F.lit(0.0)
    value = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    if round_to >= 0:
        value = F.bround(value, round_to)
    whole = F.when(F.abs(value) < 9.2e18, value.cast("long"))
    return F.struct(value.alias("result"), whole.alias("int_result"))


def fold_positions(text: str, names: dict[str, float] | None = None) -> list[tuple[float, float]]:
    """Lines ``x, y`` of + and - over numbers and earlier x1, y1, ..., folded when the plan is built."""
    known, out = dict(names or {}), []

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return float(node.value)
        if isinstance(node, ast.Name) and node.id in known:
            return known[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return value(node.operand) * (-1 if isinstance(node.op, ast.USub) else 1)
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub)):
            x, y = value(node.left), value(node.right)
            return x + y if isinstance(node.op, ast.Add) else x - y
        raise ValueError(f"position {ast.unparse(node)!r} is not a sum")

    for line in filter(str.strip, text.splitlines()):
        x, y = (value(ast.parse(part.strip(), mode="eval").body) for part in line.split(","))
        out.append((x, y))
        known |= {f"x{len(out)}": x, f"y{len(out)}": y}
    return out
