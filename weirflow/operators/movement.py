"""Data movement: fork, join, head, tail, repeat, duplicate, interfaces, delays.

All are projections, filters, unions and one bounded explode over positions.
`f` below is the firing a token belongs to, its position div the rate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weirflow.operators.tokens import POS, TokenStream, zeros


class RateError(ValueError):
    """Rates that do not fit each other."""


@dataclass(frozen=True)
class Piece:
    """`length` tokens from place `offset` on of each block of `rate` tokens of a stream."""

    stream: TokenStream
    rate: int
    offset: int
    length: int


@dataclass(frozen=True)
class Blocks:
    """What data movement makes, before any of it is read: each firing's block
    is these pieces in a row. Forks cut pieces, joins put them in a row, and
    pieces that lie side by side in their stream become one again, so whatever
    movement cancels out is never planned. `stream` reads each stream once."""

    pieces: tuple[Piece, ...]
    like: TokenStream

    @classmethod
    def of(cls, stream: TokenStream, rate: int) -> Blocks:
        return cls((Piece(stream, rate, 0, rate),) if rate else (), stream)

    @classmethod
    def joined(cls, parts: Sequence[Blocks]) -> Blocks:
        out: list[Piece] = []
        for x in [x for b in parts for x in b.pieces]:
            last = out[-1] if out else None
            if last is not None and last.stream is x.stream and last.rate == x.rate and last.offset + last.length == x.offset:
                out[-1] = Piece(x.stream, x.rate, last.offset, last.length + x.length)
            else:
                out.append(x)
        return cls(tuple(out), parts[0].like)

    @property
    def size(self) -> int:
        return sum(x.length for x in self.pieces)

    def cut(self, first: int, length: int) -> Blocks:
        if not 0 <= first <= self.size - length:
            raise RateError(f"{length} tokens from {first} on of {self.size}")
        out, at = [], 0
        for x in self.pieces:
            low, high = max(first, at), min(first + length, at + x.length)
            if low < high:
                out.append(Piece(x.stream, x.rate, x.offset + low - at, high - low))
            at += x.length
        return Blocks(tuple(out), self.like)

    def stream(self) -> TokenStream:
        if not self.pieces:
            return empty(self.like)
        if len(self.pieces) == 1 and self.pieces[0].length == self.pieces[0].rate:
            return self.pieces[0].stream
        by_stream: dict[tuple[int, int], list[tuple[Piece, int]]] = {}
        for x, at in zip(self.pieces, accumulate([0, *(x.length for x in self.pieces)]), strict=False):
            by_stream.setdefault((id(x.stream), x.rate), []).append((x, at))
        parts = [_placed(found, self.size).df for found in by_stream.values()]
        return TokenStream(reduce(lambda a, b: a.unionByName(b), parts))


def _placed(found: list[tuple[Piece, int]], size: int) -> TokenStream:
    """Pieces of one stream at their places in blocks of `size`."""
    stream, rate = found[0][0].stream, found[0][0].rate
    inside = [f"pos % {rate} BETWEEN {x.offset} AND {x.offset + x.length - 1}" for x, _ in found]
    places = [f"(pos div {rate}) * {size} + {at - x.offset} + pos % {rate}" for x, at in found]
    if sum(x.length for x, _ in found) == _covered([x for x, _ in found]):
        where = " OR ".join(inside)
        pos = places[0] if len(found) == 1 else "CASE " + " ".join(f"WHEN {w} THEN {p}" for w, p in zip(inside, places, strict=True)) + " END"
        return stream.at(pos, where)
    copies = ", ".join(f"IF({w}, {p}, NULL)" for w, p in zip(inside, places, strict=True))
    spread = stream.df.withColumn("__p", F.expr(f"explode(array_compact(array({copies})))"))
    return TokenStream(spread.select(F.col("__p").cast("bigint").alias(POS), *stream.values))


def _covered(pieces: Sequence[Piece]) -> int:
    """How many places of a block some piece has."""
    total, end = 0, 0
    for x in sorted(pieces, key=lambda x: x.offset):
        total += max(0, x.offset + x.length - max(end, x.offset))
        end = max(end, x.offset + x.length)
    return total


def fork(stream: TokenStream, rate: int, outs: Sequence[int]) -> list[TokenStream]:
    """Each block of `rate` tokens into consecutive slices."""
    if rate != sum(outs):
        raise RateError(f"a fork of {rate} tokens gives {sum(outs)}")
    firsts = [0, *accumulate(outs)]
    return [empty(stream) if r == 0 else stream.at(f"(pos div {rate}) * {r} + pos % {rate} - {o}", f"pos % {rate} BETWEEN {o} AND {o + r - 1}") for r, o in zip(outs, firsts, strict=False)]


def join(streams: Sequence[TokenStream], rates: Sequence[int], out: int | None = None) -> TokenStream:
    """Blocks of each stream one after the other, firing by firing."""
    total = sum(rates)
    if out is not None and out != total:
        raise RateError(f"a join of {total} tokens gives {out}")
    firsts = [0, *accumulate(rates)]
    parts = [s.at(f"(pos div {r}) * {total} + {o} + pos % {r}") for s, r, o in zip(streams, rates, firsts, strict=False) if r]
    return TokenStream(reduce(lambda a, b: a.unionByName(b), [p.df for p in parts])) if parts else empty(streams[0])


def head(streams: Sequence[TokenStream], rates: Sequence[int], out: int) -> TokenStream:
    """The first `out` tokens of the joined inputs of each firing. Inputs that lie beyond are not read."""
    return _cut(streams, rates, 0, out)


def tail(streams: Sequence[TokenStream], rates: Sequence[int], out: int) -> TokenStream:
    """The last `out` tokens of the joined inputs of each firing."""
    return _cut(streams, rates, sum(rates) - out, out)


def _cut(streams: Sequence[TokenStream], rates: Sequence[int], first: int, out: int) -> TokenStream:
    if not 0 <= first <= sum(rates) or out > sum(rates):
        raise RateError(f"{out} tokens of {sum(rates)}")
    parts = []
    for s, r, o in zip(streams, rates, [0, *accumulate(rates)], strict=False):
        low, high = max(first, o), min(first + out, o + r)  # what of this input is used
        if low < high:
            parts.append(s.at(f"(pos div {r}) * {out} + {o - first} + pos % {r}", f"pos % {r} BETWEEN {low - o} AND {high - o - 1}"))
    return TokenStream(reduce(lambda a, b: a.unionByName(b), [p.df for p in parts])) if parts else empty(streams[0])


def repeat(stream: TokenStream, rate: int, out: int) -> TokenStream:
    """Output offset j of a firing is input offset j mod rate; fewer outputs than inputs keep the first."""
    if rate == out:
        return stream
    if rate == 0:
        raise RateError("nothing cannot be repeated")
    if out < rate:
        return stream.at(f"(pos div {rate}) * {out} + pos % {rate}", f"pos % {rate} < {out}")
    copies = F.expr(f"sequence(0L, ({out} - 1 - pos % {rate}) div {rate})")
    spread = stream.df.withColumn("__k", F.explode(copies))
    return TokenStream(spread.select(F.expr(f"(pos div {rate}) * {out} + __k * {rate} + pos % {rate}").alias(POS), *stream.values))


def duplicate(stream: TokenStream, n: int) -> list[TokenStream]:
    return [stream] * n


def empty(like: TokenStream) -> TokenStream:
    return TokenStream(like.df.where(F.lit(False)))


def input_interface(stream: TokenStream, outer: int, inner: int) -> TokenStream:
    """A nested graph reads its input as a circular buffer: `outer` tokens a firing, `inner` reads."""
    return repeat(stream, outer, inner)


def output_interface(stream: TokenStream, inner: int, outer: int) -> TokenStream:
    """Only the last `outer` of `inner` tokens of a firing leave a nested graph."""
    return stream if inner == outer else tail([stream], [inner], outer)


def persistent_delay(stream: TokenStream, size: int, total: int, state: TokenStream | None = None) -> tuple[TokenStream, TokenStream]:
    """(delayed stream, next state): `size` tokens wait, at first those of
    `state` (zeros without one). Unlike lag() this needs no global window."""
    spark: SparkSession = stream.df.sparkSession
    first = state if state is not None else zeros(spark, size, stream)
    whole = first.df.unionByName(stream.at(f"pos + {size}").df)
    return TokenStream(whole.where(f"pos < {total}")), TokenStream(whole).at(f"pos - {total}", f"pos >= {total}")


def local_delay(stream: TokenStream, size: int, block: int, firings: int, setter: TokenStream | None = None) -> tuple[TokenStream, TokenStream]:
    """(consumer, getter): in each graph firing, `size` tokens of the setter (or
    zeros) and `block` of the stream; the consumer has the first `block`, the
    getter the last `size`."""
    first = setter if setter is not None else zeros(stream.df.sparkSession, size * firings, stream)
    line = first.at(f"(pos div {size}) * {size + block} + pos % {size}").df.unionByName(stream.at(f"(pos div {block}) * {size + block} + {size} + pos % {block}").df)
    whole = TokenStream(line)
    n = size + block
    return whole.at(f"(pos div {n}) * {block} + pos % {n}", f"pos % {n} < {block}"), whole.at(f"(pos div {n}) * {size} + pos % {n} - {block}", f"pos % {n} >= {block}")
