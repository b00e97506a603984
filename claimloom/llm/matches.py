"""Where a regular expression matches in a text, with DataFrame functions only.

Offsets are code points, ends exclusive. A text is split at the matches, and lengths are added up; in two
levels, so that the work stays close to proportional in texts with very many matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of text kept on either side of a match.
CONTEXT = 40
_BLOCK = 256

#: start, end, text of the match, text before and after it.
MATCH = "struct<start:int,end:int,value:string,before:string,after:string>"


def _running(x: Column, first: Column) -> Column:
    """(gap, length, value, before, after) as matches, the text before them having ``first`` code points."""
    init = F.struct(first.alias("at"), F.array().cast(f"array<{MATCH}>").alias("out"))

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        one = F.struct(start.alias("start"), (start + m["size"]).alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after"))
        return F.struct((start + m["size"]).alias("at"), F.concat(acc["out"], F.array(one)).cast(f"array<{MATCH}>").alias("out"))

    return F.aggregate(x, init, add, lambda acc: acc["out"])


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, only_if: Column) -> Column:
    """All leftmost non-overlapping matches, as an array of MATCH; empty where ``only_if`` isn't true.

    Before and after are the text's own CONTEXT code points there, other matches included. The pattern must not match the empty text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(f"array<{MATCH}>")

    def placed(both: Column) -> Column:
        n = F.size(both["m"])
        joined = F.zip_with(
            F.zip_with(F.slice(both["g"], F.lit(1), n), both["m"], lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
            F.slice(both["g"], F.lit(2), n),
            lambda x, after: F.struct(
                F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("size"), x["m"].alias("value"), F.right(x["g"], F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after")
            ),
        )
        return F.when(n > 0, _once(_once(joined, _with_neighbours), lambda rows: _once(_blocks(rows), _offset))).otherwise(none)

    return F.when(only_if, _once(F.struct(found.alias("m"), gaps.alias("g")), placed)).otherwise(none)


def _with_neighbours(rows: Column) -> Column:
    """Where the gap beside a match is shorter than CONTEXT, the matches and gaps beyond it fill up before and after.

    A match has a code point at least, so CONTEXT neighbours are enough; each gives CONTEXT code points at most.
    """
    most = F.lit(CONTEXT)

    def joined(first: Column, size: Column, part) -> Column:
        return F.array_join(F.transform(F.slice(rows, first, size), part), "")

    def filled(m: Column, i: Column) -> Column:
        left = joined(F.greatest(i - CONTEXT, F.lit(0)) + 1, F.least(i, most), lambda x: F.concat(x["before"], F.right(x["value"], most)))
        right = joined(i + 2, most, lambda x: F.concat(F.left(x["value"], most), x["after"]))
        whole = lambda gap, both, cut: F.when(F.char_length(gap) >= CONTEXT, gap).otherwise(cut(both, most))
        before = whole(m["before"], F.concat(left, m["before"]), F.right)
        after = whole(m["after"], F.concat(m["after"], right), F.left)
        return F.struct(m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value"), before.alias("before"), after.alias("after"))

    return F.when(F.size(rows) > 1, F.transform(rows, filled)).otherwise(rows)


def _blocks(rows: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _BLOCK).cast("int")), lambda b: F.slice(rows, b * _BLOCK + 1, F.lit(_BLOCK)))


def _offset(blocks: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def total(acc: Column, block: Column) -> Column:
        size = F.aggregate(block, F.lit(0), lambda n, m: n + m["gap"] + m["size"])
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).cast("array<int>").alias("starts"))

    starts = F.aggregate(blocks, start, total, lambda acc: acc["starts"])
    return F.flatten(F.zip_with(blocks, starts, _running))
