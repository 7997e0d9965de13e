"""Queries of sources, records, aggregates, details, log analysis and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.expressions import Scope
from millrace.operators import aggregate as agg
from millrace.operators import patterns, quality, records
from millrace.plans.task import LogTask
from millrace.queries import analysis_sql
from millrace.queries.scalars import COST, LEVEL, USER
from millrace.queries.tables import DOCUMENT_LINES, LINES, document_lines, event_lines, table
from millrace.sources import logs, paths

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DAY = "CAST(epoch_ms(date_trunc('day', ts)) AS BIGINT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _task(values: list[dict], groups: list[dict] | None = None, where: dict | None = None, **more) -> LogTask:
    conf = {"select": {"values": values}, "from": {"type": "log", "log": {"time": {"type": "auto"}} | more.pop("log", {})}, "where": where, "groupBy": {"groups": groups or []} | more.pop("group", {}), "window": {"interval": more.pop("interval", "1d")}}
    return LogTask(conf, **more)


_value = lambda name, kind, **k: {"as": name, "agg": kind, "elect": COST, **k}
BY_LEVEL = [{"name": "level", "elect": LEVEL}]
ALL = [_value("n", "count"), _value("total", "sum"), _value("mean", "avg"), _value("least", "min"), _value("most", "max")]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    df = df.withColumns({c: F.round(c, 6) for c in columns})
    return df.withColumn("window_start", F.unix_millis("window_start")) if "window_start" in df.columns else df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: cost by level and day."""
    return _rounded(_task(ALL, BY_LEVEL).run(event_lines(spark, sf_dir)), "total", "mean", "least", "most")


QUERIES["A1_to_A7_log_to_metric"] = flagship
ORACLE_SQL["A1_to_A7_log_to_metric"] = f"""WITH {LINES} SELECT {DAY} AS window_start, upper(event_type) AS level, count(*) AS n, round(CAST(sum(cost) AS DOUBLE), 6) AS total,
    round(CAST(sum(cost) AS DOUBLE) / count(*), 6) AS mean, round(CAST(min(cost) AS DOUBLE), 6) AS least, round(CAST(max(cost) AS DOUBLE), 6) AS most FROM lines GROUP BY ALL"""


# sources


@query(f"WITH {DOCUMENT_LINES} SELECT path, count(*) AS lines, count(*) FILTER (line = '') AS noise FROM doc_lines GROUP BY path")
def S1_S11_lines_and_noise(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(logs.noise(F.col("line"))).alias("noise"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)/([^/]+)/[^/]+$', 2) AS lang FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]+/[^/]+/[^/]+$')")
def S4_S6_path_tags(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    pattern = paths.template_regexp("{scheme}://{host}/{lang}/{page}").replace("(?P<scheme>[^/]+)", "[a-z]+")
    return pages.filter(paths.path_matches(F.col("url"), pattern)).select("page_id", paths.path_tags(F.col("url"), pattern)["lang"].alias("lang"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'plain ' || event_type ELSE event_type END AS line FROM events")
def S7_container_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wrapped = F.to_json(F.struct(F.concat("event_type", F.lit("\n")).alias("log"), F.lit("stdout").alias("stream")))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("plain "), F.col("event_type"))).otherwise(wrapped)
    return e.select("event_id", logs.container_line(raw).alias("line"))


@query("SELECT role AS source, count(*) AS lines, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM conversations GROUP BY role")
def S8_log_groups(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    log = F.struct((F.col("turn") + 1_700_000_000).alias("time"), F.create_map(F.lit("content"), F.col("text")).alias("contents"))
    groups = turns.select(F.create_map(F.lit("__source__"), F.col("role")).alias("tags"), F.array(log).alias("logs"))
    return logs.explode_log_groups(groups).groupBy(F.col("log_tags")["__source__"].alias("source")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT event_id, event_type AS line FROM events WHERE event_id % 7 <> 0")
def S10_broken_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("line", F.when(F.col("event_id") % 7 == 0, F.repeat(F.lit("\0"), 5000)).otherwise(F.col("event_type")))
    return e.filter(~logs.broken(F.col("line"))).select("event_id", "line")


@query("""SELECT user_id AS path, count(*) FILTER (event_id % 7 = 0) AS broken_lines, CAST(5000 * count(*) FILTER (event_id % 7 = 0) AS BIGINT) AS nul_bytes, count(*) FILTER (event_id % 7 = 0) > 0 AS broken FROM events GROUP BY ALL""")
def S10_broken_reads(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("line", F.when(F.col("event_id") % 7 == 0, F.repeat(F.lit("\0"), 5000)).otherwise(F.col("event_type")))
    return logs.broken_reads(e.withColumn("path", F.col("user_id")), ["path"])


@query(f"WITH {DOCUMENT_LINES} SELECT path, ord, line FROM doc_lines QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord DESC) <= 3")
def S12_tail(spark, sf_dir):
    return logs.tail(document_lines(spark, sf_dir), 3).select("path", "ord", "line")


# records

_JOINS = {"not": {"regexp": {"elect": {"type": "line"}, "expression": "^[A-H]"}}}


def _records_sql(cap: int) -> str:
    return f"""WITH {DOCUMENT_LINES}, heads AS (SELECT *, count(*) FILTER (regexp_matches(line, '^[A-H]')) OVER (PARTITION BY path ORDER BY ord) AS record FROM doc_lines),
        placed AS (SELECT *, row_number() OVER (PARTITION BY path, record ORDER BY ord) AS pos FROM heads WHERE record > 0)
        SELECT path, min(ord) + 1 AS ord, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM placed WHERE pos <= {cap} GROUP BY path, record"""


def _record_shape(df: DataFrame) -> DataFrame:
    return df.select("path", "ord", F.size("lines").cast("long").alias("n"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(_records_sql(1024))
def G1_multiline_previous(spark, sf_dir):
    return _record_shape(records.multiline(document_lines(spark, sf_dir), _JOINS, "previous"))


@query(f"""WITH {DOCUMENT_LINES}, marked AS (SELECT *, count(*) FILTER (regexp_matches(line, '^[A-H]')) OVER (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS record FROM doc_lines)
    SELECT path, min(ord) + 1 AS ord, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM marked GROUP BY path, coalesce(record, 0)""")
def G2_multiline_next(spark, sf_dir):
    return _record_shape(records.multiline(document_lines(spark, sf_dir), _JOINS, "next"))


@query(_records_sql(3))
def G3_max_lines(spark, sf_dir):
    return _record_shape(records.multiline(document_lines(spark, sf_dir), _JOINS, "previous", 3))


# variables, aggregates, details


@query(f"WITH {LINES} SELECT {DAY} AS window_start, 'u' || user_id AS who, count(*) AS value FROM lines GROUP BY ALL")
def V1_vars(spark, sf_dir):
    var = {"name": "who", "elect": USER}
    log = {"vars": {"vars": [var]}}
    group = [{"name": "who", "elect": {"type": "refVar", "refVar": {"name": "who"}, "transform": {"filters": [{"regexpReplaceV1": {"expression": "(.*)", "replacement": "u$1"}}]}}}]
    return _rounded(_task([_value("n", "count")], group, log=log).run(event_lines(spark, sf_dir)))


@query(f"WITH {LINES} SELECT {DAY} AS window_start, count(*) AS value FROM lines GROUP BY ALL")
def A2_A15_no_keys_single_value(spark, sf_dir):
    return _rounded(_task([_value("n", "count")]).run(event_lines(spark, sf_dir)))


@query()
def A8_distinct_sketch(spark, sf_dir):
    return _rounded(_task([{"as": "users", "agg": "hll", "elect": USER}, _value("n", "count")], BY_LEVEL).run(event_lines(spark, sf_dir)))


@query(f"""WITH {LINES} SELECT {DAY} AS window_start, upper(event_type) AS level, count(DISTINCT user_id) AS users, true AS near FROM lines GROUP BY ALL
    UNION ALL SELECT CAST(NULL AS BIGINT), upper(event_type), count(DISTINCT user_id), true FROM lines GROUP BY ALL""")
def A8_sketch_error(spark, sf_dir):
    """Sketches of a day and level, and those of all days merged, against exact counts: near is a difference of at most three standard deviations, 15 % and 5 %."""
    task = _task([{"as": "estimate", "agg": "hll", "elect": USER}, _value("n", "count")], BY_LEVEL)
    lines = event_lines(spark, sf_dir)
    front = task.front(task.records(lines)).withColumn("user", F.regexp_extract("line", r"user-(\d+)", 1))
    exact = front.groupBy("window_start", "level").agg(F.countDistinct("user").alias("users"))
    daily = task.run(lines).join(exact, ["window_start", "level"]).withColumn("most", F.lit(0.15))
    merged = agg.merge_partials(agg.partials(front, F.col("user").cast("double"), ["window_start", "level"]), ["level"]).select("level", F.col("distinct").alias("estimate"))
    merged = merged.join(front.groupBy("level").agg(F.countDistinct("user").alias("users")), "level").withColumn("most", F.lit(0.05))
    both = daily.select("window_start", "level", "users", "estimate", "most").unionByName(merged, allowMissingColumns=True)
    return _rounded(both.select("window_start", "level", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.col("most") * F.col("users")).alias("near")))


@query(f"""WITH {LINES} SELECT {DAY} AS window_start, upper(event_type) AS level, count(*) FILTER (cost > 50) AS high, round(coalesce(CAST(sum(cost) FILTER (cost > 400) AS DOUBLE), 0), 4) AS top
    FROM lines GROUP BY ALL""")
def A10_A11_filtered_values(spark, sf_dir):
    over = lambda n: {"numberOp": {"elect": COST, "gt": n}}
    return _rounded(_task([_value("high", "count", where=over(50)), _value("top", "sum", where=over(400))], BY_LEVEL).run(event_lines(spark, sf_dir)), "top")


@query("SELECT event_type, round(sum(CASE WHEN event_id % 9 = 0 THEN 0 ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END), 4) AS total FROM events GROUP BY event_type")
def A12_not_finite(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value").cast("decimal(18,2)").cast("double"))
    return e.groupBy("event_type").agg(F.round(F.sum(agg.finite(value)), 4).alias("total"))


@query(f"""WITH {LINES}, seen AS (SELECT {DAY} AS window_start, CAST(user_id AS VARCHAR) AS who, min(event_id) AS seen, count(*) AS value FROM lines GROUP BY ALL)
    SELECT window_start, who, value FROM seen QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY seen) <= 5""")
def A13_max_keys(spark, sf_dir):
    return _rounded(_task([_value("n", "count")], [{"name": "who", "elect": USER}], group={"maxKeySize": 5}).run(event_lines(spark, sf_dir)))


@query(f"""WITH {LINES}, ranked AS (SELECT {DAY} AS window_start, upper(event_type) AS level, event_id, line, row_number() OVER (PARTITION BY date_trunc('day', ts), event_type ORDER BY event_id) AS r FROM lines WHERE cost > 20)
    SELECT window_start, level, '{{"maxCount":2,"samples":[' || string_agg('{{"hostname":"","logs":["' || substr(line, 1, 40) || '"]}}', ',' ORDER BY event_id) || ']}}' AS log_samples FROM ranked WHERE r <= 2 GROUP BY ALL""")
def A14_log_samples(spark, sf_dir):
    task = _task(ALL, BY_LEVEL)
    front = task.front(task.records(event_lines(spark, sf_dir)))
    conf = {"enabled": True, "maxCount": 2, "maxLength": 40, "where": {"numberOp": {"elect": COST, "gt": 20}}}
    return _rounded(agg.samples(front, conf, ["level"], task.scope(front)))


@query("""SELECT event_type, round(sum(v), 4) AS sum, count(v) AS count, round(min(v), 4) AS min, round(max(v), 4) AS max, round(sum(v) / count(v), 4) AS avg
    FROM (SELECT event_type, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS v FROM events) GROUP BY event_type""")
def A16_merge_partials(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value").cast("decimal(18,2)").cast("double"))
    daily = agg.partials(e, F.col("v"), ["event_type", "user_id"])
    merged = agg.merge_partials(daily, ["event_type"]).drop("distinct")
    return merged.withColumns({c: F.round(c, 4) for c in ("sum", "min", "max", "avg")})


@query(f"WITH {LINES} SELECT {DAY} AS window_start, upper(event_type) AS level, 2 * count(*) AS value FROM lines GROUP BY ALL")
def A17_many_sources(spark, sf_dir):
    one = event_lines(spark, sf_dir)
    other = one.withColumn("path", F.lit("copy"))
    return _rounded(_task([_value("n", "count")], BY_LEVEL).run(one.union(other)))


@query(f"WITH {LINES} SELECT CAST(epoch_ms(date_trunc('millisecond', ts)) AS BIGINT) AS ts, upper(event_type) AS level, CAST(cost AS DOUBLE) AS cost, CAST(1 AS DOUBLE) AS n FROM lines WHERE cost > 10")
def L1_details(spark, sf_dir):
    task = _task([_value("cost", "sum"), _value("n", "count")], BY_LEVEL, {"numberOp": {"elect": COST, "gt": 10}}, group={"details": {"enabled": True}})
    return task.run(event_lines(spark, sf_dir)).withColumn("ts", F.unix_millis("ts"))


# log analysis

_PATTERNS = [{"name": "errors", "where": {"contains": {"elect": {"type": "line"}, "value": "ERROR"}}}, {"name": "high", "where": {"numberOp": {"elect": COST, "gt": 50}}}]


def _windowed(spark, sf_dir) -> DataFrame:
    task = LogTask({"select": {"values": [{"agg": "loganalysis"}]}, "from": {"log": {"time": {"type": "auto"}}}, "window": {"interval": "10d"}})
    return task.front(task.records(event_lines(spark, sf_dir)))


@query(f"""WITH {LINES}, named AS (SELECT CAST(epoch_ms(ts) // 864000000 * 864000000 AS BIGINT) AS window_start, CASE WHEN event_type = 'error' THEN 'errors' WHEN cost > 50 THEN 'high' END AS "eventName", event_id, line FROM lines)
    SELECT window_start, "eventName", count(*) AS value, min_by(line, event_id) AS line FROM named WHERE "eventName" IS NOT NULL GROUP BY ALL""")
def K1_known_patterns(spark, sf_dir):
    return _rounded(patterns.known_counts(_windowed(spark, sf_dir), _PATTERNS, Scope()))


@query(f"""WITH {DOCUMENT_LINES}, t AS (SELECT path, unnest(words) AS w FROM {analysis_sql.words("doc_lines")})
    SELECT path, count(*) AS tokens, count(*) FILTER (w.important) AS important, count(*) FILTER (w.source) AS source FROM t GROUP BY path""")
def K2_K3_tokens(spark, sf_dir):
    words = document_lines(spark, sf_dir).select("path", F.explode(patterns.signature(F.col("line"))).alias("t"))
    return words.groupBy("path").agg(F.count(F.lit(1)).alias("tokens"), F.count_if("t.important").alias("important"), F.count_if("t.source").alias("source"))


_WINDOWED = f"{LINES}, windowed AS (SELECT CAST(epoch_ms(ts) // 864000000 * 864000000 AS BIGINT) AS window_start, event_id AS seq, line, CASE WHEN event_type = 'error' THEN 'errors' WHEN cost > 50 THEN 'high' END AS known FROM lines)"


@query(f"WITH {_WINDOWED}, {analysis_sql.clusters('windowed', 8)} SELECT window_start, cluster, count, line FROM clusters")
def K4_K5_clusters(spark, sf_dir):
    return _rounded(patterns.cluster(_windowed(spark, sf_dir), most_patterns=8))


@query(f"""WITH {DOCUMENT_LINES}, windowed AS (SELECT CAST(path AS BIGINT) // 100 AS window_start, row_number() OVER (ORDER BY path, ord) AS seq, line FROM doc_lines),
    {analysis_sql.clusters("windowed", 16)} SELECT window_start AS part, cluster, count, line FROM clusters""")
def K5_document_clusters(spark, sf_dir):
    """Lines of documents, a hundred documents a window: many signatures, more of them than a window has room for."""
    lines = document_lines(spark, sf_dir).withColumn("part", F.floor(F.col("path").cast("long") / 100))
    return patterns.cluster(lines, "part", most_patterns=16)


@query(r"""WITH hosts AS (
        SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS word FROM pages WHERE url IS NOT NULL
    ), counted AS (
        SELECT regexp_extract(word, '[a-z]+$') AS kind, word, count(*) AS count, min(page_id) AS seen FROM hosts
        WHERE length(word) > 5 AND (regexp_matches(word, '^(com|java|org)[.]|[.]com$') OR regexp_matches(word, '([0-9]{1,3}[.]){3}[0-9]{1,3}')) GROUP BY ALL
    )
    SELECT kind, word, count FROM counted QUALIFY row_number() OVER (PARTITION BY kind ORDER BY seen, word) <= 61""")
def K6_source_words(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)/", 1)
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract(host, "[a-z]+$", 0).alias("kind"), F.col("page_id").alias("ord"), host.alias("line"))
    return patterns.source_words(pages, ["kind"])


@query(f"""WITH {_WINDOWED}, {analysis_sql.clusters("(SELECT * FROM windowed WHERE known IS NULL)", 4)}, counted AS (SELECT window_start, known, count(*) AS value, min_by(line, seq) AS line FROM windowed WHERE known IS NOT NULL GROUP BY ALL)
    SELECT window_start, known AS "eventName", value, '{{"known":true,"sample":' || to_json(line) || '}}' AS analysis FROM counted
    UNION ALL SELECT window_start, '__analysis', CAST(sum(count) AS BIGINT), '{{"analyzedLogs":[' || string_agg('{{"cluster":' || cluster || ',"count":' || count || ',"sample":' || to_json(line) || '}}', ',' ORDER BY cluster) || ']}}' FROM clusters GROUP BY window_start""")
def K7_analysis(spark, sf_dir):
    task = LogTask({"select": {"values": [{"agg": "loganalysis"}]}, "from": {"log": {"time": {"type": "auto"}}}, "groupBy": {"logAnalysis": {"patterns": _PATTERNS, "maxUnknownPatterns": 4}}, "window": {"interval": "10d"}})
    return _rounded(task.run(event_lines(spark, sf_dir)))


# quality

_FUNNEL = _task([_value("n", "count")], BY_LEVEL, {"numberOp": {"elect": COST, "lt": 20}}, log={"time": {"type": "auto"}, "parse": {"where": {"not": {"contains": {"elect": {"type": "line"}, "value": "VIEW"}}}, "type": "regexp", "regexp": {"expression": r"user-(\d+)\]"}}})
_FUNNEL_SQL = f"""WITH {LINES}, staged AS (SELECT {DAY} AS day, CASE WHEN event_id % 6 = 0 THEN 'ignored' WHEN event_type = 'view' THEN 'pre_where' WHEN event_id % 5 = 0 THEN 'parse' WHEN cost >= 20 THEN 'where' ELSE 'processed' END AS stage FROM lines)"""


def _spoiled(spark, sf_dir) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    spoiled = F.when(F.col("ord") % 6 == 0, "").when(F.col("ord") % 5 == 0, F.replace(F.col("line"), F.lit("user-"), F.lit("nobody"))).otherwise(F.col("line"))
    return lines.withColumn("line", spoiled)


@query(f"{_FUNNEL_SQL} SELECT stage, count(*) AS records FROM staged GROUP BY stage")
def Q1_funnel(spark, sf_dir):
    return quality.funnel(_FUNNEL.staged(_spoiled(spark, sf_dir)))


@query(f"{_FUNNEL_SQL} SELECT day AS window_start, count(*) FILTER (stage = 'where') AS filtered, count(*) FILTER (stage = 'processed') AS processed, day + 86400000 <= epoch_ms(TIMESTAMP '2024-01-20') AS ok FROM staged WHERE stage IN ('where', 'processed') GROUP BY ALL")
def Q2_T5_window_status(spark, sf_dir):
    staged = _FUNNEL.staged(_spoiled(spark, sf_dir)).filter("window_start is not null")
    status = quality.window_status(staged, F.lit("2024-01-20 00:00:00").cast("timestamp"), 86_400_000)
    return status.select(F.unix_millis("window_start").alias("window_start"), F.col("where").alias("filtered"), "processed", "ok")


@query(f"""WITH {LINES}, b AS (SELECT *, {DAY} AS day, event_id % 11 = 0 AS spoilt FROM lines), seen AS (SELECT day, user_id, min(event_id) AS first FROM b WHERE day >= epoch_ms(TIMESTAMP '2024-01-03') GROUP BY ALL),
    kept AS (SELECT day, user_id FROM seen QUALIFY row_number() OVER (PARTITION BY day ORDER BY first) <= 20)
    SELECT day AS window_start, CASE WHEN day < epoch_ms(TIMESTAMP '2024-01-03') THEN 'late' WHEN kept.user_id IS NULL THEN 'keys_cap' WHEN spoilt THEN 'select' ELSE 'processed' END AS stage, count(*) AS records FROM b LEFT JOIN kept USING (day, user_id) GROUP BY ALL""")
def Q1_A13_T4_caps_and_late(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    spoilt = lines.withColumn("line", F.when(F.col("ord") % 11 == 0, F.replace(F.col("line"), F.lit("cost="), F.lit("cost=x"))).otherwise(F.col("line")))
    task = _task([_value("total", "sum")], [{"name": "who", "elect": USER}], group={"maxKeySize": 20})
    staged = task.staged(spoilt, emitted_before=F.lit("2024-01-03 00:00:00").cast("timestamp"))
    return quality.funnel(staged, ["window_start"]).withColumn("window_start", F.unix_millis("window_start"))


@query(f"""{_FUNNEL_SQL}, windows AS (SELECT CAST(epoch_ms(w) AS BIGINT) AS day FROM unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS u(w))
    SELECT day AS window_start, count(*) FILTER (stage = 'where') AS filtered, count(*) FILTER (stage = 'processed') AS processed, day + 86400000 <= epoch_ms(TIMESTAMP '2024-01-20') AND day >= epoch_ms(TIMESTAMP '2024-01-04 12:00:00') AS ok
    FROM windows LEFT JOIN (SELECT * FROM staged WHERE stage IN ('where', 'processed')) s USING (day) GROUP BY ALL""")
def T5_every_window(spark, sf_dir):
    moment = lambda text: F.lit(text).cast("timestamp")
    staged = _FUNNEL.staged(_spoiled(spark, sf_dir)).filter("window_start is not null")
    times = {"watermark": moment("2024-01-20 00:00:00"), "interval_ms": 86_400_000, "opened": moment("2024-01-04 12:00:00")}
    status = quality.every_window(quality.window_status(staged, **times), moment("2023-12-25 00:00:00"), moment("2024-02-05 00:00:00"), **times)
    return status.select(F.unix_millis("window_start").alias("window_start"), F.col("where").alias("filtered"), "processed", "ok")


@query(f"WITH {LINES} SELECT event_id AS ord, CASE WHEN event_type = 'error' AND cost > 50 THEN 'processed' ELSE 'where' END AS stage, '/and=' || (event_type = 'error' AND cost > 50) || ' /and[0]/contains=' || (event_type = 'error') || ' /and[1]/numberOp=' || (cost > 50) AS conditions, upper(event_type) AS level, CAST(cost AS DOUBLE) AS total FROM lines")
def Q3_explain(spark, sf_dir):
    where = {"and": [{"contains": {"elect": {"type": "line"}, "value": "ERROR"}}, {"numberOp": {"elect": COST, "gt": 50}}]}
    told = _task([_value("total", "sum")], BY_LEVEL, where).explain(event_lines(spark, sf_dir))
    tree = F.concat_ws(" ", F.transform("conditions", lambda n: F.concat(n["node"], F.lit("="), n["result"].cast("string"))))
    return told.select("ord", "stage", tree.alias("conditions"), F.col("keys")["level"].alias("level"), F.col("values")["total"].alias("total"))
