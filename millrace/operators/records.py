"""Lines into records: single lines, or groups by a pattern on each line.

Positions within a path are found in two steps, within a block and over the blocks of
the path, so a file of any size is as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import Scope, keeps
from millrace.sources.logs import broken, noise

DEFAULT_LINES, MOST_LINES = 1024, 4096


def single_lines(lines: DataFrame) -> DataFrame:
    """Each line a record; broken lines and noise are dropped."""
    return lines.filter(~broken(F.col("line")) & ~noise(F.col("line"))).withColumn("lines", F.array("line"))


def positions(lines: DataFrame, flag: Column) -> DataFrame:
    """lines with no (1, 2, ... within the path), flags (flagged lines up to this one), and last and prior (no of the last flagged line up to and before this one, 0 if none)."""
    block = Window.partitionBy("path", "block").orderBy("ord")
    here = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = lines.withColumn("flag", flag).withColumn("no", F.row_number().over(block))
    local = local.withColumn("flags", F.sum(F.col("flag").cast("long")).over(here)).withColumn("last", F.max(F.when(F.col("flag"), F.col("no"))).over(here))
    local = local.withColumn("prior", F.lag("last").over(block))
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = local.groupBy("path", "block").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("flag").cast("long")).alias("in_block"), F.max("last").alias("last_in_block"))
    sizes = sizes.withColumn("base", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    sizes = sizes.select("path", "block", "base", F.coalesce(F.sum("in_block").over(ahead), F.lit(0)).alias("base_flags"), F.coalesce(F.max(F.col("base") + F.col("last_in_block")).over(ahead), F.lit(0)).alias("base_last"))
    joined = local.join(sizes, ["path", "block"])
    exact = {"no": F.col("no") + F.col("base"), "flags": F.col("flags") + F.col("base_flags"), "last": F.coalesce(F.col("last") + F.col("base"), F.col("base_last")), "prior": F.coalesce(F.col("prior") + F.col("base"), F.col("base_last"))}
    return joined.withColumns(exact).drop("base", "base_flags", "base_last")


def multiline(lines: DataFrame, where: dict, what: str = "previous", max_lines: int = 0) -> DataFrame:
    """Records of several lines: path, ord (no of the first line), line (the first), lines.

    what=previous: a line that matches joins the record before it, lines ahead of the
    first head are dropped, and so is what follows the cap until the next head.
    what=next: matching lines wait for the first that does not match, which closes the
    record; every cap lines a record is closed anyway. Lines at the end of a path form a
    record without a close.
    """
    cap = min(MOST_LINES, max(2, max_lines or DEFAULT_LINES))
    matches = keeps(where, Scope(lines=F.array("line"), columns=F.array().cast("array<string>"), column_map=F.create_map().cast("map<string,string>")))
    at = positions(lines, ~matches)
    if what == "previous":
        placed = at.filter("flags > 0").withColumn("record", F.col("flags")).withColumn("chunk", F.lit(0)).filter(F.col("no") - F.col("last") < cap)
    else:
        # A head closes its record, so the lines of a record count the heads before them.
        before = F.col("flags") - F.col("flag").cast("long")
        placed = at.withColumn("record", before).withColumn("chunk", F.floor((F.col("no") - F.col("prior") - 1) / cap))
    kept = [c for c in ("path_tags", "log_tags", "file_time") if c in lines.columns]
    grouped = placed.groupBy("path", "record", "chunk").agg(F.sort_array(F.collect_list(F.struct("no", "line"))).alias("all"), *[F.first(c).alias(c) for c in kept])
    return grouped.select("path", F.col("all")[0]["no"].alias("ord"), F.col("all")[0]["line"].alias("line"), F.transform("all", lambda x: x["line"]).alias("lines"), *kept)
