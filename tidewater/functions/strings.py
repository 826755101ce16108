"""Text functions on names, signatures and source lines, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_level_out(name: Column) -> Column:
    """A class without its innermost level: ``La/B$C$D;`` is ``La/B$C;``."""
    return F.regexp_replace(name, r"\$[^$;]*(?=;?$)", "")


def barred(signature: Column) -> Column:
    """A signature with bars between class and method: ``LA;.f:()V`` is ``LA;||f:()V``."""
    return F.replace(signature, F.lit(";."), F.lit(";||"))


def class_of(signature: Column) -> Column:
    return F.regexp_extract(signature, r"^([^;]*;)\.", 1)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """``template`` with each marker ``%name%`` replaced by its value; a null value is 'unknown'."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"%{name}%"), F.coalesce(value, F.lit("unknown")))
    return template


def text_bounds(line: Column) -> Column:
    """STRUCT<first, last>: the columns of a line's first and last character that is no white space,
    from 0; null for a blank line."""
    left, right = F.length(F.regexp_replace(line, r"^\s+", "")), F.length(F.regexp_replace(line, r"\s+$", ""))
    return F.when(left > 0, F.struct((F.length(line) - left).alias("first"), (right - 1).alias("last")))


def closing_paren(line: Column, opening: Column) -> Column:
    """Where the parenthesis that opens at ``opening`` (from 0) closes; null if it does not."""
    chars = F.split(F.substring(line, opening + 1, F.length(line)), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))
    deeper = lambda s, c: s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
    step = lambda s, c: F.when(s["end"] >= 0, s).otherwise(F.struct(deeper(s, c).alias("depth"), (s["at"] + 1).alias("at"), F.when((deeper(s, c) == 0) & (c == ")"), s["at"]).otherwise(-1).alias("end")))
    found = F.aggregate(chars, start, step, lambda s: s["end"])
    return F.when((F.substring(line, opening + 1, F.lit(1)) == "(") & (found >= 0), opening + found)
