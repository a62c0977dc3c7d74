"""Texts cut into typed segments between delimiters, and into tokens of a grammar."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices


@dataclass(frozen=True)
class Delimiter:
    left: str
    right: str
    display: bool = False


def _end(marks: re.Pattern, right: str, text: str, at: int) -> int:
    """Where the right delimiter stands outside of braces, or -1; a backslash hides the character behind it."""
    depth = 0
    while m := marks.search(text, at):
        at = m.start()
        if depth <= 0 and text.startswith(right, at):
            return at
        at += 2 if m[0] == "\\" else 1
        depth += {"{": 1, "}": -1}.get(m[0], 0)
    return -1


def cut(text: str, delimiters: tuple[Delimiter, ...]) -> list[tuple[str, str, str, bool]]:
    """(kind, data, raw, display) of a text; the raw parts, joined, are the text.

    Delimiters are tried one after the other, each on what the ones before left as text. An opening
    delimiter without an end begins a text segment that goes on to the end of its run.
    """
    plain = lambda t: [("text", t, t, False)] if t else []
    parts = plain(text)
    for d in delimiters:
        marks = re.compile(r"[\\{}]|" + re.escape(d.right[0]))
        done: list[tuple[str, str, str, bool]] = []
        for part in parts:
            if part[0] != "text":
                done.append(part)
                continue
            run, at = part[1], 0
            while (start := run.find(d.left, at)) >= 0:
                done += plain(run[at:start])
                at, stop = start, _end(marks, d.right, run, start + len(d.left))
                if stop < 0:
                    break
                at = stop + len(d.right)
                done.append(("math", run[start + len(d.left) : stop], run[start:at], d.display))
            done += plain(run[at:])
        parts = done
    return parts


def _each(df: DataFrame, key: str, text: Column, run, kind: pa.DataType, ddl: str) -> DataFrame:
    """(key, place, fields of run's rows) for each text; run reads one text at a time."""

    def batches_of(batches):
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([run(t or "") for t in batch.column(1).to_pylist()], pa.list_(kind))], names=[key, "found"])

    rows = df.select(key, text.alias("_text")).mapInArrow(batches_of, f"`{key}` {dict(df.dtypes)[key]}, found array<struct<{ddl}>>")
    return rows.select(key, F.posexplode("found").alias("place", "f")).select(key, "place", "f.*")


_SEGMENT = pa.struct([("kind", pa.string()), ("data", pa.string()), ("raw", pa.string()), ("display", pa.bool_())])


def segments(df: DataFrame, key: str, text: str, delimiters: tuple[Delimiter, ...]) -> DataFrame:
    """(key, place, kind, data, raw, display): segments of each text in order, kind text or math.

    Texts that hold no opening delimiter are one segment and are not scanned. Empty segments are
    left out, so an empty or null text gives no row.
    """
    held = F.lit(False)
    for d in delimiters:
        held |= F.contains(F.col(text), F.lit(d.left))
    whole = df.filter(~F.coalesce(held, F.lit(False)) & (F.col(text) != "")).select(key, F.lit(0).alias("place"), F.lit("text").alias("kind"), F.col(text).alias("data"), F.col(text).alias("raw"), F.lit(False).alias("display"))
    names = [f.name for f in _SEGMENT]
    scanned = _each(df.filter(held), key, F.col(text), lambda t: [dict(zip(names, p, strict=True)) for p in cut(t, delimiters)], _SEGMENT, "kind: string, data: string, raw: string, display: boolean")
    return whole.unionByName(scanned)


@dataclass(frozen=True)
class Rule:
    """Pattern of a kind of token. The first group of a `behind` pattern must stand before the token and is no part of it.

    A `greedy` rule may take what rules before have cut off as tokens, as long as it starts in text.
    `inside` are the rules for the token's own text.
    """

    kind: str
    pattern: str
    behind: bool = False
    greedy: bool = False
    inside: tuple[Rule, ...] = field(default=())


@dataclass
class Piece:
    """A run of text, or a token if `kind` is set."""

    start: int
    stop: int
    kind: str = ""
    greedy: bool = False
    parts: list[Piece] = field(default_factory=list)


def _apply(number: int, rules: tuple[Rule, ...], text: str, pieces: list[Piece]) -> list[Piece]:
    """One rule over a list of pieces.

    An ordinary rule looks for matches inside each run of text. A greedy one takes the first match
    from where a run begins on: if it begins in this run, it takes all pieces that it touches. What
    is left of the last one is text again, together with the run behind it if the piece was an
    ordinary token, and is read once more by the rules before this one.
    """
    rule, compiled = rules[number], re.compile(rules[number].pattern, re.MULTILINE)
    out: list[Piece] = []
    queue = pieces[::-1]
    ahead: re.Match | None = None
    while queue:
        piece = queue.pop()
        if piece.kind:
            out.append(piece)
            continue
        if not rule.greedy:
            ahead = compiled.search(text, piece.start, piece.stop)
        elif ahead is None or ahead.start() < piece.start:
            ahead = compiled.search(text, piece.start)
        if ahead is None and rule.greedy:
            return [*out, piece, *reversed(queue)]
        start = (ahead.end(1) if rule.behind and ahead[1] else ahead.start()) if ahead else piece.stop
        if start >= piece.stop or start == ahead.end():
            out.append(piece)
            continue
        stop, last = ahead.end(), piece
        while last.stop < stop:
            last = queue.pop()
        if last.kind and not last.greedy and queue and not queue[-1].kind:
            last = queue.pop()
        if start > piece.start:
            out.append(Piece(piece.start, start))
        out.append(Piece(start, stop, rule.kind, rule.greedy, tokenize(text[start:stop], rule.inside) if rule.inside else []))
        if last.stop > stop:
            left = [Piece(stop, last.stop)]
            for earlier in range(number if last is not piece else 0):
                left = _apply(earlier, rules, text, left)
            queue += left[::-1]
    return out


def tokenize(text: str, rules: tuple[Rule, ...]) -> list[Piece]:
    """The pieces of a text in order, without gaps. In patterns, ^ and $ stand for the ends of lines."""
    pieces = [Piece(0, len(text))] if text else []
    for number in range(len(rules)):
        pieces = _apply(number, rules, text, pieces)
    return pieces


def _flat(pieces: list[Piece], base: int, depth: int) -> Iterator[dict]:
    for p in pieces:
        yield {"kind": p.kind or None, "start": base + p.start, "stop": base + p.stop, "depth": depth}
        yield from _flat(p.parts, base + p.start, depth + 1)


_TOKEN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("depth", pa.int32())])


def tokens(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, place, kind, start, stop, depth): tokens and runs of text (kind null) in order, each before its own parts.

    Rules are applied in order, each to what the ones before left as text; those of depth 0 cover
    the whole text without gaps. A null or empty text has none.
    """
    return _each(df, key, F.col(text), lambda t: list(_flat(tokenize(t, rules), 0, 0)), _TOKEN, "kind: string, start: bigint, stop: bigint, depth: int")
