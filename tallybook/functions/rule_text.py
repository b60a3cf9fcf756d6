"""Rule texts that never stop a job: arithmetic and casts of a SQL predicate become their ``try_`` forms.

The session's settings are left alone.  Only operands and ``+ - * / %`` between them are looked at; comparisons, AND, OR,
BETWEEN, IN and all else pass as written, and Spark reads the result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import types as T

_TOKEN = re.compile(
    r"""\s*(?:(?P<text>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:BD|[LSYDF])?\b)"""
    r"""|(?P<name>`(?:[^`]|``)+`|[^\W\d]\w*)|(?P<sign><=>|<=|>=|<>|!=|==|\|\||::|->|[-+*/%=<>(),.\[\]&|^~!]))""",
    re.IGNORECASE,
)
# Words between operands, comparison signs, functions of numbers.
_BETWEEN_OPERANDS = {"AND", "OR", "NOT", "IN", "IS", "BETWEEN", "LIKE", "RLIKE", "ILIKE", "ESCAPE", "DISTINCT", "FROM", "WHEN", "THEN", "ELSE", "END", "AS"}
_COMPARISONS = {"=", "==", "<=>", "<", ">", "<=", ">=", "<>", "!="}
_NUMERIC_FUNCTIONS = {"abs", "round", "floor", "ceil", "ceiling", "sqrt", "pow", "power", "sign", "mod"}
_TRY = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "/": "try_divide", "%": "try_mod"}
_CASTS = {"number": "DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP_NTZ"}
_LITERALS = {"DATE": "date", "TIMESTAMP": "timestamp", "TIMESTAMP_NTZ": "timestamp_ntz", "INTERVAL": "other", "X": "other"}


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.NumericType):
        return "number"
    return data_type.simpleString() if data_type.simpleString() in _CASTS else "other"


class _Reader:
    """Reads tokens left to right; every method returns SQL text and the kind of its value."""

    def __init__(self, text: str, kinds: Mapping[str, str]):
        self.tokens: list[tuple[str, str]] = []
        self.kinds = kinds
        at = 0
        while text[at:].strip():
            found = _TOKEN.match(text, at)
            if found is None:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.at = 0

    def next(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def what(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def terms(self, *stops: str) -> tuple[str, str]:
        """Operands and what stands between them, up to one of the stops."""
        items: list[list[str]] = []
        while self.at < len(self.tokens) and self.next().upper() not in stops:
            between = self.what() == "name" and self.next().upper() in _BETWEEN_OPERANDS
            if between or (self.what() == "sign" and self.next() not in ("(", "-", "+", "~")):
                items.append([self.take(), "sign"])
            else:
                items.append(list(self.sum()))
        for i, (sign, kind) in enumerate(items):
            left = i - 2 if i > 1 and items[i - 1][0].upper() == "NOT" else i - 1
            if kind != "sign" or left < 0 or i + 1 == len(items) or not (sign in _COMPARISONS or sign.upper() in ("BETWEEN", "IN")):
                continue
            for one, other in ((left, i + 1), (i + 1, left)):
                if items[one][1] == "text" and items[other][1] in _CASTS:
                    items[one] = [f"try_cast({items[one][0]} AS {_CASTS[items[other][1]]})", items[other][1]]
        return " ".join(item[0] for item in items), items[0][1] if len(items) == 1 else "other"

    def sum(self) -> tuple[str, str]:
        return self.chain("+-", lambda: self.chain("*/%", self.signed))

    def chain(self, signs: str, operand) -> tuple[str, str]:
        left = operand()
        while self.what() == "sign" and self.next() in signs:
            sign = self.take()
            right = operand()
            left = f"{_TRY[sign]}({_number(left)}, {_number(right)})", left[1] if left[1] in _CASTS and left[1] != "number" else "number"
        return left

    def signed(self) -> tuple[str, str]:
        if self.what() == "sign" and self.next() in ("-", "+"):
            sign = self.take()
            literal = self.what() == "number"
            inner = self.signed()
            if sign == "+":
                return inner
            return (f"-{inner[0]}" if literal else f"try_subtract(0, {_number(inner)})"), "number"
        if self.next() == "~":
            return self.take() + self.signed()[0], "number"
        value = self.atom()
        while self.next() in (".", "[", "::"):
            sign = self.take()
            if sign == ".":
                value = f"{value[0]}.{self.take()}", "other"
            elif sign == "[":
                inside = self.terms("]")[0]
                self.take()
                value = f"{value[0]}[{inside}]", "other"
            else:
                value = f"try_cast({value[0]} AS {self.type_name()})", "other"
        return value

    def type_name(self) -> str:
        name = self.take()
        if self.next() == "(":
            while self.next() != ")":
                name += self.take()
            name += self.take()
        return name

    def arguments(self) -> tuple[list[tuple[str, str]], str]:
        """What stands in parentheses, part by part, and the kind that all parts share."""
        self.take()
        parts = [self.terms(")", ",")]
        while self.next() == ",":
            self.take()
            parts.append(self.terms(")", ","))
        self.take()
        kinds = {p[1] for p in parts}
        return parts, kinds.pop() if len(kinds) == 1 else "other"

    def atom(self) -> tuple[str, str]:
        kind, word = self.what(), self.next()
        if kind == "text":
            return self.take(), "string"
        if kind == "number":
            return self.take(), "number"
        if word == "(":
            parts, inner = self.arguments()
            return f"({', '.join(p[0] for p in parts)})", inner
        self.take()
        upper = word.upper()
        if upper == "CASE":
            inside = self.terms("END")[0]
            self.take()
            return f"CASE {inside} END", "other"
        if upper in ("CAST", "TRY_CAST") and self.next() == "(":
            self.take()
            inside = self.terms("AS")[0]
            self.take()
            target = self.type_name()
            self.take()
            return f"try_cast({inside} AS {target})", "other"
        if upper in _LITERALS and (self.what() == "text" or (upper == "INTERVAL" and self.what() == "number")):
            out = [word, self.take()]
            while upper == "INTERVAL" and self.what() == "name" and self.next().upper() not in _BETWEEN_OPERANDS:
                out.append(self.take())
            return " ".join(out), _LITERALS[upper]
        if self.next() == "(":
            parts, _ = self.arguments()
            numeric = word.lower() in _NUMERIC_FUNCTIONS
            return f"{word}({', '.join(_number(p) if numeric else p[0] for p in parts)})", "number" if numeric else "other"
        return word, self.kinds.get(word.strip("`").replace("``", "`").lower(), "other")


def _number(value: tuple[str, str]) -> str:
    return f"try_cast({value[0]} AS DOUBLE)" if value[1] == "text" else value[0]


def safe_predicate(rule: str, schema: T.StructType) -> str:
    """The rule with ``try_`` arithmetic and casts, and text columns read as numbers or dates where they meet such.

    An overflow, a quotient by zero or an unreadable cell makes a term null.  A text this cannot follow is returned as it is.
    """
    try:
        reader = _Reader(rule, {f.name.lower(): _kind(f.dataType) for f in schema.fields})
        out = reader.terms()[0]
        return out if reader.at == len(reader.tokens) else rule
    except (ValueError, IndexError):
        return rule
