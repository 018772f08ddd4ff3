"""Formula text -> Column over a map of symbol values.

Only numbers, names, + - * / **, unary signs and a few functions are allowed; the names a
formula may use are given, so no name is ever a constant. A division by zero, a root of a
negative number or a missing value gives null.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = {
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "Max": lambda *xs: F.when(_all_known(xs), F.greatest(*xs)),
    "Min": lambda *xs: F.when(_all_known(xs), F.least(*xs)),
    "abs": F.abs,
}
OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Pow: F.pow}


def _all_known(columns):
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def symbols(expression: str) -> list[str]:
    """Names that an expression uses, without its functions."""
    tree = ast.parse(expression, mode="eval")
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called})


def compile_expression(expression: str, value) -> Column:
    """``value`` maps a symbol to its Column; ValueError on anything that isn't allowed."""

    def build(node) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            return value(node.id)
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            return OPERATORS[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return build(node.operand) if isinstance(node.op, ast.UAdd) else -build(node.operand)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            return FUNCTIONS[node.func.id](*[build(a) for a in node.args])
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    return build(ast.parse(expression, mode="eval"))
