"""Building blocks of Column expressions, as Columns and as SQL text."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = count(1)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fresh_name() -> str:
    """A name for a variable that no other text uses."""
    return f"v{next(_NUMBERS)}"


def let_text(value: str, use: Callable[[str], str]) -> str:
    """The SQL text of use(value), with the value computed once."""
    name = fresh_name()
    return f"get(transform(array({value}), {name} -> {use(name)}), 0)"


def of_text(value: Column, use: Callable[[str], str]) -> Column:
    """A Column from SQL text over one value, which the text knows by name."""
    name = fresh_name()
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {use(name)}")), F.lit(0))


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
