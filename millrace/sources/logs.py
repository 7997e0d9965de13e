"""Lines of log files and of log-group tables as one record table.

Every source returns path, block, ord (order within the block), line, path_tags and
log_tags; (path, block, ord) is the order in which lines were written. Files read as
batches also give file_time, when they were last written, which orders lines of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.dialect import plain_groups
from millrace.sources.paths import checked_glob, path_matches, path_tags, template_regexp

MAX_LINE_BYTES = 1 << 20
MAX_NULS = 4096
#: Charsets read as GB18030.
_CHINESE = ("gb18030", "gbk", "gb2312")


def no_tags() -> Column:
    return F.create_map().cast("map<string,string>")


def shaped(df: DataFrame, pattern: str | None = None, charset: str | None = None) -> DataFrame:
    """Lines (path, block, ord, line) in the shape of a source, of the paths that match."""
    df = df.withColumn("line", F.regexp_replace(decoded(F.col("line"), charset), "\r$", ""))
    tags = path_tags(F.col("path"), pattern) if pattern else no_tags()
    df = df.filter(path_matches(F.col("path"), pattern)) if pattern else df
    return df.withColumns({"path_tags": tags, "log_tags": no_tags()})


def _lines(reader, paths, pattern: str | None = None, charset: str | None = None) -> DataFrame:
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return shaped(reader.option("lineSep", "\n").text(paths).select(path.alias("path"), block.alias("block"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("file_time")), pattern, charset)


def read_log_lines(spark: SparkSession, paths: list[str], charset: str | None = None) -> DataFrame:
    """Lines of the files at exact paths or globs."""
    return _lines(spark.read, [checked_glob(p) for p in paths], charset=charset)


def read_matching(spark: SparkSession, directory: str, pattern: str, charset: str | None = None) -> DataFrame:
    """Lines of all files below a directory whose path matches; named groups become path tags."""
    if directory.rstrip("/") in ("", "file:"):
        raise ValueError("the root is not searched")
    return _lines(spark.read.option("recursiveFileLookup", "true"), [directory], pattern, charset)


def read_template(spark: SparkSession, directory: str, template: str) -> DataFrame:
    """Lines of the files below a directory that fit a template with {name} parts."""
    return read_matching(spark, directory, template_regexp(template).replace("^", "^.*", 1))


def stream_log_lines(spark: SparkSession, path: str, ordered: bool = False, charset: str | None = None) -> DataFrame:
    """Lines of files as they arrive.

    ordered: number the lines, for what depends on their order; each file is then read
    whole and must fit in memory. Otherwise ord is 0.
    """
    at = F.col("_metadata.file_path").alias("path")
    if not ordered:
        return shaped(spark.readStream.option("lineSep", "\n").text(path).select(at, F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("ord"), F.col("value").alias("line")), charset=charset)
    whole = spark.readStream.text(path, wholetext=True)
    lines = F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)).alias("ord", "line")
    return shaped(whole.select(at, F.lit(0).cast("long").alias("block"), lines).withColumn("ord", F.col("ord").cast("long")), charset=charset)


def decoded(line: Column, charset: str | None) -> Column:
    """A line in its charset; one that is valid UTF-8 already, or cannot be decoded, stays. Needs spark.sql.legacy.javaCharsets."""
    if (charset or "").lower() not in _CHINESE:
        return line
    raw = line.cast("binary")
    return F.when(F.is_valid_utf8(line), line).otherwise(F.decode(raw, "GB18030"))


def container_line(line: Column) -> Column:
    """The log field of a container's JSON line without its line end; any other line as it is."""
    return F.regexp_replace(F.coalesce(F.get_json_object(line, "$.log"), line), "[\r\n]+$", "")


def broken(line: Column) -> Column:
    """True for lines to drop: thousands of NULs, or too long."""
    nuls = F.contains(line, F.lit("\0")) & (F.length(F.regexp_replace(line, "[^\\x00]", "")) >= MAX_NULS)
    return nuls | (F.octet_length(line) > MAX_LINE_BYTES)


def broken_reads(lines: DataFrame, by: list[str]) -> DataFrame:
    """For each source, or source and window: broken (some line was), broken_lines and nul_bytes."""
    nuls = F.length("line") - F.length(F.replace("line", F.lit("\0"), F.lit("")))
    counts = lines.groupBy(*by).agg(F.count_if(broken(F.col("line"))).alias("broken_lines"), F.coalesce(F.sum(nuls), F.lit(0)).cast("long").alias("nul_bytes"))
    return counts.withColumn("broken", F.col("broken_lines") > 0)


def noise(line: Column) -> Column:
    """True for what single-line mode ignores: blank lines and stack frames."""
    return (line == "") | line.startswith("\tat") | (line.startswith("\t... ") & line.endswith(" more"))


def explode_log_groups(groups: DataFrame) -> DataFrame:
    """One row for each log of (tags MAP, logs ARRAY<STRUCT<time seconds, contents MAP>>); content is the line."""
    at = groups.select(F.col("tags").alias("log_tags"), F.posexplode("logs").alias("ord", "log"))
    contents = F.col("log.contents")
    return at.select("log_tags", "ord", F.timestamp_seconds("log.time").alias("time"), contents.alias("column_map"), F.coalesce(contents["content"], F.lit("")).alias("line"))


def split_to_map(line: Column, pattern: str) -> Column:
    """map of the pattern's named groups; NULL for a line that does not match."""
    expression, names = plain_groups(pattern)
    pairs = [c for i, n in enumerate(names, 1) if n for c in (F.lit(n), F.regexp_extract(line, expression, i))]
    return F.when(line.rlike(expression), F.create_map(*pairs))


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each path.

    Lines after a block are counted per block, so that no file is one task.
    """
    sizes = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("size"))
    after = Window.partitionBy("path").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = sizes.withColumn("after", F.coalesce(F.sum("size").over(after), F.lit(0))).filter(F.col("after") < n).drop("size")
    back = Window.partitionBy("path", "block").orderBy(F.col("ord").desc())
    ranked = lines.join(last, ["path", "block"]).withColumn("rank", F.row_number().over(back) + F.col("after"))
    return ranked.filter(F.col("rank") <= n).drop("after", "rank")
