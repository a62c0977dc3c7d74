"""YAML texts of any depth as rows of paths and values."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices

_KEY = re.compile(r"""^("[^"]*"|'[^']*'|[^\s'"\[{#&*|>-][^:]*?|-[^\s:][^:]*?)\s*:(?:\s+(.*))?$""")
_COMMENT = re.compile(r"""^((?:"[^"]*"|'[^']*'|[^"'#]|(?<=\S)#|["'])*?)(?:^|\s+)#.*$""")
_FLOW = re.compile(r"""\s*("[^"]*"|'[^']*'|[^,]+?)\s*(?:,|$)""")


def bare(value: str) -> str:
    """A scalar without its quotes."""
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _folded(lines: list[str], style: str) -> str:
    """A block of lines under | or >: less its indentation; > joins lines that an empty one does not part."""
    indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    lines = [x[indent:].rstrip() for x in lines]
    while lines and not lines[-1]:
        lines.pop()
    text = "\n".join(lines)
    return re.sub(r"(?<=\S)\n(?=\S)", " ", text).replace("\n\n", "\n") if style == ">" else text


def values(text: str | None) -> list[tuple[str, str]]:
    """(path, value) of every scalar in order: names joined by dots, places in lists in brackets from 0.

    The open parts stand on a stack with their indentation. A list may stand at the indentation of
    its name. Bracketed lists on a line are lists; other flow collections stay text. A line that is
    neither a name nor an item goes on with the value before.
    """
    lines = (text or "").splitlines()
    found: list[tuple[str, str]] = []
    open_: list[tuple[int, bool, str]] = [(-1, False, "")]  # indentation, list item or name, path
    count: dict[str, int] = {}

    def add(path: str, value: str) -> None:
        if value[0] == "[" and value[-1] == "]":
            found.extend((f"{path}[{i}]", bare(m[1])) for i, m in enumerate(_FLOW.finditer(value[1:-1])))
        else:
            found.append((path, bare(value)))

    at = 0
    while at < len(lines):
        line = _COMMENT.sub(r"\1", lines[at]).rstrip()
        at += 1
        body = line.lstrip()
        if not body or body == "---":
            continue
        indent = len(line) - len(body)
        while body == "-" or body.startswith("- "):
            while open_[-1][0] > indent or (open_[-1][0] == indent and open_[-1][1]):
                open_.pop()
            parent = open_[-1][2]
            count[parent] = count.get(parent, -1) + 1
            open_.append((indent, True, f"{parent}[{count[parent]}]"))
            rest = body[1:].lstrip()
            indent, body = indent + len(body) - len(rest), rest
        if m := _KEY.match(body):
            while open_[-1][0] >= indent:
                open_.pop()
            parent = open_[-1][2]
            path = f"{parent}.{bare(m[1])}" if parent else bare(m[1])
            open_.append((indent, False, path))
            value = m[2] or ""
            if value[:1] in ("|", ">") and len(value) <= 2:
                first = at
                while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > indent):
                    at += 1
                found.append((path, _folded(lines[first:at], value[0])))
            elif value:
                add(path, value)
        elif body and open_[-1][1] and indent > open_[-1][0] and (not found or found[-1][0] != open_[-1][2]):
            add(open_[-1][2], body)
        elif body and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {bare(body)}")
    return found


def yaml_paths(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, path, value) of every scalar of each YAML text; a null text gives no row."""
    kind = pa.struct([("path", pa.string()), ("value", pa.string())])

    def run(batches):
        for batch in slices(batches, 1):
            parts = [[{"path": p, "value": v} for p, v in values(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(kind))], names=[key, "found"])

    held = rows.select(key, body).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, found array<struct<path: string, value: string>>")
    return held.select(key, F.posexplode("found").alias("place", "f")).select(key, "place", "f.*")
