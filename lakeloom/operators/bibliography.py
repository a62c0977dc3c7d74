"""BibTeX text to rows: entries and tags.

A text is cut into tokens by one pattern (escapes, braces, quotes, separators, and what stands
between), and a small machine reads them once, in Arrow batches where the rows are: time in
proportion to the text, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.batches import slices

_TOKEN = re.compile(r"\\.|[{}\"@=,#%\n]|[ \t\r\f\v]+|[^\\{}\"@=,#%\s]+|.", re.DOTALL)
#: Entries that hold no tags.
_BARE = {"comment", "preamble", "string"}


class _Broken(Exception):
    """The entry ends too early, or something else stands where a part is due."""


class _Reader:
    """Reads the tokens of one text; `at` is the place of the next one."""

    def __init__(self, text: str):
        self.tokens = _TOKEN.findall(text)
        self.at = 0

    def skip(self) -> None:
        """Past blanks, and comments from % to the end of the line."""
        while self.at < len(self.tokens) and (self.tokens[self.at] == "%" or self.tokens[self.at].isspace()):
            if self.tokens[self.at] == "%":
                while self.at < len(self.tokens) and self.tokens[self.at] != "\n":
                    self.at += 1
            else:
                self.at += 1

    def next(self) -> str:
        """The next token that says something."""
        self.skip()
        if self.at == len(self.tokens):
            raise _Broken
        return self.tokens[self.at]

    def take(self, wanted: str) -> None:
        if self.next() != wanted:
            raise _Broken
        self.at += 1

    def name(self, more: str) -> str:
        """A name: what stands up to a brace, comma or equals sign (or one of `more`)."""
        self.skip()
        first = self.at
        while self.at < len(self.tokens) and self.tokens[self.at] not in "{},=" + more and not self.tokens[self.at].isspace():
            self.at += 1
        if first == self.at:
            raise _Broken
        return "".join(self.tokens[first : self.at])

    def enclosed(self, close: str) -> str:
        """What stands up to the closing brace of this depth, or the next quote mark; escapes do not close."""
        depth, first = 0, self.at
        while self.at < len(self.tokens):
            token = self.tokens[self.at]
            if token == close and not depth:
                self.at += 1
                return "".join(self.tokens[first : self.at - 1])
            if close == "}":
                depth += (token == "{") - (token == "}")
            self.at += 1
        raise _Broken

    def value(self) -> str:
        """Pieces in braces or quotes, or bare words, joined where # stands between them."""
        parts = []
        while True:
            head = self.next()
            if head in '{"':
                self.at += 1
                parts.append(self.enclosed("}" if head == "{" else '"'))
            else:
                word = self.name("#")
                parts.append(word.lower() if word.lower() in _MONTHS else word)
            if self.at == len(self.tokens) or self.next() != "#":
                return "".join(parts)
            self.at += 1

    def entry(self) -> tuple[str, str, dict[str, str]] | None:
        """(type, key, tags) of the entry after @; None for one that holds no tags."""
        kind = self.name("").lower()
        self.take("{")
        if kind in _BARE:
            self.enclosed("}")
            return None
        key = self.name("")
        tags: dict[str, str] = {}
        while self.next() == ",":
            self.at += 1
            if self.next() == "}":
                break
            name = self.name("").lower()
            self.take("=")
            tags.pop(name, None)
            tags[name] = re.sub(r"\s+", " ", self.value()).strip()
        self.take("}")
        return kind, key, tags


#: The month names that stand without quotes.
_MONTHS = frozenset("jan feb mar apr may jun jul aug sep oct nov dec".split())


def read(text: str | None) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Entries of a text in order; after one that is broken, reading goes on at the next @ behind its own."""
    reader = _Reader(text or "")
    while True:
        while reader.at < len(reader.tokens) and reader.tokens[reader.at] != "@":
            reader.at += 1
        if reader.at == len(reader.tokens):
            return
        reader.at += 1
        start = reader.at
        try:
            found = reader.entry()
        except _Broken:
            reader.at = start
            continue
        if found:
            yield found


def entries(docs: DataFrame, key: str, bibtex: str) -> DataFrame:
    """(key, ord, entry_type, citation_key, tags): the entries of each text in order from 0, and their tags by lower-case name.

    Values lose their braces or quotes and keep what stands inside, with blanks run together;
    pieces around # are joined; month names are lower-cased; other bare words stay as they are. Of
    repeated names the last wins. A trailing comma, comments after % and text outside of entries do
    not count. Comments, preambles, strings and broken entries give no row, nor does a null text;
    entries without tags have an empty map.
    """

    def run(batches):
        for batch in slices(batches, 1):
            rows = [(k, n, *e) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, e in enumerate(read(text))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            tags = pa.array([list(t.items()) for t in cols[4]], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), tags], names=[key, "ord", "entry_type", "citation_key", "tags"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, bibtex).mapInArrow(run, f"`{key}` {kind}, ord int, entry_type string, citation_key string, tags map<string, string>")
