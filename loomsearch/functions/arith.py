"""Integer arithmetic: ``+ - * /``, parentheses and repeated unary minus over 64-bit integers; division truncates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ERROR = "Syntax error"
_KEPT = re.compile(r"[^0-9+\-*/()]")
_NUMBER = re.compile(r"\+?[0-9]+")
_LIMIT = 1 << 63


def _wrap(x: int) -> int:
    return (x + _LIMIT) % (2 * _LIMIT) - _LIMIT


class _Cursor:
    def __init__(self, text: str):
        self.text, self.at = _KEPT.sub("", text), 0

    def take(self, signs: str) -> str:
        c = self.text[self.at:self.at + 1]
        if c and c in signs:
            self.at += 1
            return c
        return ""

    def total(self) -> int:
        value = self.product()
        while sign := self.take("+-"):
            other = self.product()
            value = _wrap(value + other if sign == "+" else value - other)
        return value

    def product(self) -> int:
        value = self.factor()
        while sign := self.take("*/"):
            other = self.factor()
            if sign == "*":
                value = _wrap(value * other)
            else:
                size = abs(value) // abs(other)
                value = _wrap(size if (value < 0) == (other < 0) else -size)
        return value

    def factor(self) -> int:
        negative = False
        while self.take("-"):
            negative = not negative
        if found := _NUMBER.match(self.text, self.at):
            self.at = found.end()
            value = min(int(found.group()), _LIMIT - 1)
        elif self.take("("):
            value = self.total()
            if not self.take(")"):
                raise ValueError
        else:
            raise ValueError
        return _wrap(-value) if negative else value


def evaluate(text: str | None) -> str:
    """The value as text, or ERROR. Characters other than digits, signs and parentheses are deleted first."""
    cursor = _Cursor(text or "")
    try:
        value = cursor.total()
    except (ValueError, ZeroDivisionError, RecursionError):
        return ERROR
    return str(value) if cursor.at == len(cursor.text) else ERROR


@F.pandas_udf(StringType())
def _evaluate(texts: pd.Series) -> pd.Series:
    return texts.map(evaluate)


def evaluate_column(c: Column) -> Column:
    return _evaluate(c)
