"""Titles that contain one another, without pairing every two titles of an employer.

The titles of a group that has few are compared with one another.  In larger groups, a title
can be part of another only if every piece of it is.  So each title is looked up by
one piece of its own, the one that fewest titles of its group hold, among the pieces of
WIDTH characters of all titles; what is found is then compared.  Pieces grow with the length
of the titles, and a title meets those that hold its rarest piece, not all of its group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfold.session import settle

#: Characters in a piece; shorter titles are pieces themselves.
WIDTH = 4
#: Titles of a group that are compared with one another: fewer comparisons than a title has pieces to deal, or not many more.
FEW = 64


def pieces(title: Column, width: int) -> Column:
    """The distinct parts of ``width`` characters."""
    starts = F.sequence(F.lit(1), F.length(title) - F.lit(width - 1))
    return F.when(F.length(title) >= width, F.array_distinct(F.transform(starts, lambda i: F.substring(title, i, F.lit(width)))))


def containing_titles(titles: DataFrame, group: Sequence[str], width: int = WIDTH) -> DataFrame:
    """(group, part, title) for all titles of a group where ``part`` is contained in ``title`` or equal to it.

    ``titles`` has the group's columns and ``title``; null and empty titles contain nothing.

    The planner takes exploded pieces to be as few as titles, so it would send them to the driver
    to broadcast them: their joins are merge joins.
    """
    keys = list(group)
    own = settle(titles.select(*keys, "title").filter(F.length("title") > 0).distinct(), "titles")
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= FEW:
        return _compared(own, keys)
    sized = settle(own.join(sizes.hint("merge"), keys), "sized-titles")
    few, own = sized.filter(F.col("n") <= FEW).drop("n"), sized.filter(F.col("n") > FEW).drop("n")
    held = own.select(*keys, "title", F.explode(pieces(F.col("title"), width)).alias("piece"))
    frequent = held.groupBy(*keys, "piece").agg(F.count("*").alias("n"))
    rarest = held.join(frequent.hint("merge"), [*keys, "piece"]).groupBy(*keys, F.col("title").alias("part")).agg(
        F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    found = held.join(rarest.hint("merge"), [*keys, "piece"]).filter(F.col("title").contains(F.col("part"))).select(*keys, "part", "title")
    # Titles under the width of a piece are few kinds of strings: they are looked up by themselves.
    sizes = range(1, width)
    short = own.filter(F.length("title") < width).select(*keys, F.col("title").alias("part"))
    lengths = short.select(*keys, F.length("part").alias("size")).distinct()
    parts = F.coalesce(*[F.when(F.col("size") == k, pieces(F.col("title"), k)) for k in sizes], F.array().cast("array<string>"))
    small = own.join(lengths.hint("merge"), keys).select(*keys, "title", F.explode(parts).alias("part")).join(short.hint("merge"), [*keys, "part"])
    return _compared(few, keys).unionByName(found).unionByName(small.select(*keys, "part", "title"))


def _compared(titles: DataFrame, keys: list[str]) -> DataFrame:
    """Every title with the titles of its group that are part of it."""
    parts = titles.select(*keys, F.col("title").alias("part"))
    return titles.join(parts.hint("merge"), keys).filter(F.col("title").contains(F.col("part"))).select(*keys, "part", "title")
