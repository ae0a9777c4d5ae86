"""Folds over arrays inside one row whose work grows with n log n, however long the array is.

A fold that appends to its own accumulator copies it at every element. These go over the whole array a
logarithmic number of times instead: running totals by doubling distances, chains by doubling jumps,
look-ups by halving. All of them are Catalyst expressions. What a lambda uses of its surroundings must be a
variable of ``let``: a column that stands in a lambda once is put there as its expression, and computed for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many spans are cut out of a text one by one.
FEW = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), in which the value is computed once, wherever and however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _powers(n: Column) -> Column:
    """1, 2, 4, ... as many as n has binary digits (one for 0)."""
    return F.slice(F.array(*[F.lit(1 << k) for k in range(31)]), F.lit(1), F.length(F.bin(n)))


def scan(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array by an associative function."""

    def step(acc: Column, width: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i < width, x).otherwise(plus(F.get(acc, i - width), x)))

    return let(values, lambda v: F.aggregate(_powers(F.greatest(F.size(v) - 1, F.lit(0))), v, step))


def below(values: Column, limit: Column) -> Column:
    """How many elements of a sorted array (a variable of ``let``) are less than a limit."""
    step = lambda low, width: F.when(F.get(values, low + width - 1) < limit, low + width).otherwise(low)
    return F.aggregate(F.reverse(_powers(F.greatest(F.size(values), F.lit(0)))), F.lit(0), step)


def lookup(keys: Column, values: Column, key: Column) -> Column:
    """The value that stands where a key stands among sorted keys, the first of equal ones; null where it does not."""
    return let(below(keys, key), lambda i: F.when(F.get(keys, i) == key, F.get(values, i)))


def chain(jumps: Column) -> Column:
    """The indexes 0, jumps[0], jumps[jumps[0]], ... of an array whose jumps all go forward, up to the first beyond its end."""

    def walk(all_jumps: Column) -> Column:
        n = F.size(all_jumps)

        def step(acc: Column, _: Column) -> Column:
            # after k steps: the first 2^k indexes, and jumps over as many
            ahead = F.filter(F.transform(acc["reached"], lambda i: F.get(acc["jumps"], i)), lambda j: j < n)
            twice = F.transform(acc["jumps"], lambda j: F.get(acc["jumps"], j))
            return F.struct(twice.alias("jumps"), F.concat(acc["reached"], ahead).alias("reached"))

        start = F.struct(all_jumps.alias("jumps"), F.array(F.lit(0)).alias("reached"))
        return F.when(n > 0, F.aggregate(_powers(n - 1), start, step, lambda acc: acc["reached"])).otherwise(F.array().cast("array<int>"))

    return let(jumps, walk)


def ranks(groups: Column, order: Column) -> Column:
    """For each element of ``groups`` its number, from 1, among equal ones by ``order`` (an array beside it) and then by place."""
    both = F.zip_with(groups, order, lambda g, o: F.struct(g.alias("g"), o.alias("o")))
    rows = F.sort_array(F.transform(both, lambda x, i: F.struct(x["g"].alias("g"), x["o"].alias("o"), i.alias("i"))))

    def number(r: Column) -> Column:
        first = scan(F.transform(r, lambda x, j: F.when(x["g"].eqNullSafe(F.get(r, j - 1)["g"]), 0).otherwise(j)), lambda a, b: F.greatest(a, b))
        back = let(first, lambda f: F.sort_array(F.transform(r, lambda x, j: F.struct(x["i"].alias("i"), (j - F.get(f, j) + 1).alias("n")))))
        return F.transform(back, lambda x: x["n"])

    return let(rows, number)


def cut(text: Column, spans: Column, piece: Callable[[Column, Column, Callable[[Column, Column], Column]], Column]) -> Column:
    """An array with piece(span, index, part) of each span (a column), where part(start, end) is the text between two code points.

    The text is not walked through from its start for every piece: one of single bytes is cut as bytes, another, where there are
    more than FEW spans, is made into four bytes a code point once, and a piece is found by its place.
    """

    def single(bytes_: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            return F.when(end > start, F.substr(bytes_, start + 1, end - start).cast("string")).otherwise(F.lit(""))

        return F.transform(spans, lambda x, i: piece(x, i, part))

    def plain(start: Column, end: Column) -> Column:
        return F.when(end > start, F.substr(text, start + 1, end - start)).otherwise(F.lit(""))

    def placed(wide: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            # with a byte order mark before it, so that one that the piece may begin with stays
            held = F.concat(F.lit(bytearray(b"\x00\x00\xfe\xff")), F.substr(wide, start * 4 + 1, (end - start) * 4))
            return F.when(end > start, F.decode(held, "UTF-32")).otherwise(F.lit(""))

        return F.transform(spans, lambda x, i: piece(x, i, part))

    few = F.size(spans) <= FEW
    others = F.when(few, F.transform(spans, lambda x, i: piece(x, i, plain))).otherwise(let(F.encode(text, "UTF-32"), placed))
    return F.when(F.octet_length(text) == F.length(text), let(text.cast("binary"), single)).otherwise(others)
