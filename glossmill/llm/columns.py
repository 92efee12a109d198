"""Native Column helpers for text operators: words, running sums, regular-expression spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
GAP = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Runs of anything but space and \\t to \\r; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP, -1))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array under an associative `join`, by doubling: n log n steps and no growing accumulator."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def doubled(totals: Column, r: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            before = F.get(totals, i - F.call_function("shiftleft", F.lit(1), r))
            return F.when(before.isNull(), x).otherwise(join(before, x))

        return F.transform(totals, step)

    return F.aggregate(rounds, values, doubled)


def running_sums(lengths: Column) -> Column:
    return running(lengths, lambda a, b: a + b)


def gaps(text: Column, pattern: str) -> Column:
    """What lies between a pattern's matches; one more than there are matches, as no match is empty."""
    return F.split(text, pattern, -1)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def found(text: Column, match_list: Column, pattern: str, near: int) -> Column:
    """Array of (text, before, step) of a pattern's matches: `before` is what precedes one, at most `near` code points and back to the
    previous match, and `step` counts the code points from the previous match's end to its own."""
    own = F.slice(gaps(text, pattern), 1, F.size(match_list))
    return F.zip_with(match_list, own, lambda m, g: F.struct(m.alias("text"), F.substring(g, -near, near).alias("before"), (F.length(g) + F.length(m)).alias("step")))
