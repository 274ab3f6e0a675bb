"""Row predicates written the way data-frame users write them, as Spark columns.

The text is read by Python's own parser; only a short list of node types is accepted, and every name
must be a column of the table. Nothing is ever evaluated, so there is nothing to escape from.
"""

from __future__ import annotations

import ast
import io
import tokenize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mldiag.functions.columns import is_floating, ref

_WORDS = {"&": "and", "|": "or", "&&": "and", "||": "or"}
_ORDER = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}
_FLAGS = {"isnull": True, "isna": True, "notnull": False, "notna": False}


class UnsafePredicate(ValueError):
    """The text is not a predicate over the table's columns."""


def _parse(text: str) -> ast.expr:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"" and text[0] not in text[1:-1]:
        text = text[1:-1].strip()
    try:
        tokens = [
            (t.type, " " + _WORDS[t.string] + " " if t.string in _WORDS else t.string)
            for t in tokenize.generate_tokens(io.StringIO(text.replace("\n", " ")).readline)
        ]
        return ast.parse(tokenize.untokenize(tokens).strip(), mode="eval").body
    except (SyntaxError, tokenize.TokenError, ValueError) as error:
        raise UnsafePredicate(f"not a valid predicate: {text!r}") from error


class _Translator:
    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def dtype(self, node: ast.expr) -> str:
        if isinstance(node, ast.Constant):
            if isinstance(node.value, bool):
                return "bool"
            return "string" if isinstance(node.value, str) else "number"
        if isinstance(node, ast.Name) and node.id in self.types:
            kind = self.types[node.id]
            if isinstance(kind, T.NumericType):
                return "number"
            if isinstance(kind, T.StringType):
                return "string"
            return "bool" if isinstance(kind, T.BooleanType) else "other"
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            return "number" if node.func.attr in ("len", "abs") else "string"
        return "number"

    # -- values ---------------------------------------------------------------------------------
    def value(self, node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id in self.types:
                return ref(node.id)
            raise UnsafePredicate(f"unknown column: {node.id}")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            inner = self.value(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.BinOp):
            return self.arithmetic(node)
        if isinstance(node, ast.Call):
            return self.text_function(node)
        raise UnsafePredicate(f"not allowed here: {type(node).__name__}")

    def arithmetic(self, node: ast.BinOp) -> Column:
        a, b = self.value(node.left), self.value(node.right)
        if isinstance(node.op, ast.Add):
            return F.concat(a, b) if self.dtype(node.left) == "string" else a + b
        if isinstance(node.op, ast.Sub):
            return a - b
        if isinstance(node.op, ast.Mult):
            return a * b
        if isinstance(node.op, ast.Pow):
            return F.pow(a, b)
        if isinstance(node.op, (ast.Div, ast.FloorDiv, ast.Mod)):
            infinite = F.when(a > 0, float("inf")).when(a < 0, float("-inf"))
            if isinstance(node.op, ast.Mod):
                return F.when(b > 0, F.pmod(a, b)).when(b < 0, -F.pmod(-a, -b))  # the sign of the divisor
            quotient = F.when(b == 0, infinite).otherwise(F.try_divide(a, b))
            return F.floor(quotient) if isinstance(node.op, ast.FloorDiv) else quotient
        raise UnsafePredicate(f"operator not allowed: {type(node.op).__name__}")

    def text_function(self, node: ast.Call) -> Column:
        owner, name, arguments = self.method(node)
        if isinstance(owner, ast.Attribute) and owner.attr == "str":
            text = self.value(owner.value)
            if not arguments and name in ("lower", "upper", "strip", "len"):
                return {"lower": F.lower, "upper": F.upper, "strip": F.trim, "len": F.length}[name](text)
        if name == "abs" and not arguments:
            return F.abs(self.value(owner))
        raise UnsafePredicate(f"call not allowed: {name}")

    @staticmethod
    def method(node: ast.Call) -> tuple[ast.expr, str, list[ast.expr]]:
        if not isinstance(node.func, ast.Attribute) or node.keywords:
            raise UnsafePredicate("call not allowed")
        return node.func.value, node.func.attr, node.args

    # -- conditions: never NULL, as a missing value fails every test but `!=` and `not in` ---------
    def condition(self, node: ast.expr, bare: bool = False) -> Column:
        """`bare` leaves may yield NULL instead of false: at the top level both drop the row, and a
        comparison without a wrapper reaches the scan."""
        if isinstance(node, ast.BoolOp):
            both = isinstance(node.op, ast.And)
            parts = [self.condition(v, bare and both) for v in node.values]
            result = parts[0]
            for part in parts[1:]:
                result = (result & part) if both else (result | part)
            return result
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
            return ~self.condition(node.operand)
        if isinstance(node, ast.Compare):
            left, result = node.left, None
            for op, right in zip(node.ops, node.comparators):
                link = self.comparison(op, left, right, bare)
                result = link if result is None else result & link
                left = right
            return result
        if isinstance(node, ast.Call):
            return self.test(node)
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Name) and self.dtype(node) == "bool":
            return F.coalesce(self.value(node), F.lit(False))
        raise UnsafePredicate(f"not a condition: {type(node).__name__}")

    def members(self, node: ast.expr) -> list:
        if isinstance(node, (ast.Tuple, ast.List, ast.Set)) and all(
            isinstance(e, ast.Constant) for e in node.elts
        ):
            return [e.value for e in node.elts]
        if isinstance(node, ast.Constant):
            return [node.value]
        raise UnsafePredicate("membership needs a list of literals")

    def fits(self, node: ast.expr, values: list) -> list:
        """Only values of the column's kind can match; others would force a failing cast."""
        kind = self.dtype(node)
        if kind == "string":
            return [v for v in values if isinstance(v, str)]
        if kind == "number":
            return [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        return values

    def comparison(self, op: ast.cmpop, left: ast.expr, right: ast.expr, bare: bool) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            values = self.fits(left, self.members(right))
            inside = self.value(left).isin(values) if values else F.lit(False)
            if isinstance(op, ast.In):
                return inside if bare and values else F.coalesce(inside, F.lit(False))
            return ~F.coalesce(inside, F.lit(False))
        if isinstance(right, (ast.List, ast.Tuple)) and isinstance(op, (ast.Eq, ast.NotEq)):
            return self.comparison(ast.In() if isinstance(op, ast.Eq) else ast.NotIn(), left, right, bare)
        kinds = {self.dtype(left), self.dtype(right)}
        if kinds == {"string", "number"}:
            if isinstance(op, (ast.Eq, ast.NotEq)):
                return F.lit(isinstance(op, ast.NotEq))
            raise UnsafePredicate("text and numbers cannot be ordered")
        if type(op) not in _ORDER:
            raise UnsafePredicate(f"comparison not allowed: {type(op).__name__}")
        test = _ORDER[type(op)](self.value(left), self.value(right))
        nan = [F.isnan(self.value(n).cast("double")) for n in (left, right) if self.floating(n)]
        if isinstance(op, ast.NotEq):
            test = F.coalesce(test, F.lit(True))
            for flag in nan:
                test = test | F.coalesce(flag, F.lit(False))
            return test
        if isinstance(op, (ast.Gt, ast.GtE, ast.Eq)) or len(nan) == 2 or self.floating(right):
            for flag in nan:
                test = test & ~flag
        return test if bare else F.coalesce(test, F.lit(False))

    def floating(self, node: ast.expr) -> bool:
        """May the value be NaN?"""
        return any(
            isinstance(n, (ast.Div, ast.Pow))
            or (isinstance(n, ast.Name) and is_floating(self.types.get(n.id, T.NullType())))
            for n in ast.walk(node)
        ) and self.dtype(node) == "number"

    def test(self, node: ast.Call) -> Column:
        owner, name, arguments = self.method(node)
        if name in _FLAGS and not arguments:
            missing = self.value(owner).isNull()
            if self.floating(owner):
                missing = missing | F.coalesce(F.isnan(self.value(owner)), F.lit(False))
            return missing if _FLAGS[name] else ~missing
        if name == "isin" and len(arguments) == 1:
            return self.comparison(ast.In(), owner, arguments[0], False)
        if name == "between" and len(arguments) == 2:
            low = self.comparison(ast.GtE(), owner, arguments[0], False)
            return low & self.comparison(ast.LtE(), owner, arguments[1], False)
        if isinstance(owner, ast.Attribute) and owner.attr == "str" and len(arguments) == 1:
            text, pattern = self.value(owner.value), arguments[0]
            if isinstance(pattern, ast.Constant) and isinstance(pattern.value, str):
                tests = {
                    "contains": text.rlike,
                    "startswith": text.startswith,
                    "endswith": text.endswith,
                }
                if name in tests:
                    return F.coalesce(tests[name](pattern.value), F.lit(False))
        raise UnsafePredicate(f"call not allowed: {name}")


def predicate(df: DataFrame, text: str) -> Column:
    """Translate a predicate such as ``price > 5 and label in ('a', 'b')`` to a column."""
    return _Translator(df).condition(_parse(text), bare=True)


def filter_expr(df: DataFrame, text: str) -> DataFrame:
    """The rows for which the predicate holds."""
    return df.where(predicate(df, text))


def filter_summary(df: DataFrame, text: str) -> DataFrame:
    """One row: the predicate, how many rows match and how many there are."""
    holds = F.coalesce(predicate(df, text), F.lit(False))
    return df.agg(
        F.lit(text).alias("expression"),
        F.count_if(holds).alias("matches"),
        F.count(F.lit(1)).alias("total"),
    )
