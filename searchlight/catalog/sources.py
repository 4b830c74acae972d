"""Readers on log lines made from the requests: what is read must be what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlight import fixtures
from searchlight.sources import exports as E
from searchlight.sources import logs as L
from searchlight.storage import new_folder

WEB = fixtures.cte("fx_weblog")


def _requests(s, d):
    return fixtures.view(s, d, "fx_weblog").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))


def _combined(s, d):
    line = F.format_string('%s - - [%s] "%s %s HTTP/1.1" %d %d "%s" "%s"', "ip", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"), "method", "url", "status", "bytes", "referrer", "user_agent")
    spoiled = F.when(F.col("event_id") % 97 == 0, F.lit("no request at all")).otherwise(line)
    return _requests(s, d).select("event_id", (F.col("event_id") % 3).cast("string").alias("file"), spoiled.alias("value"))


def _json(s, d):
    fields = F.to_json(F.struct(F.col("ip").alias("remote_addr"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("method").alias("request_method"), F.col("url").alias("uri"), F.lit(0).alias("status"), F.col("status").alias("sc-status"), F.col("bytes").alias("body_bytes_sent"), "user_agent", "referrer"))
    return _requests(s, d).select("event_id", fields.alias("value"))


def _iis(s, d):
    words = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("10.0.0.1"), "method", F.substring_index("url", "?", 1), F.when(F.col("url").contains("?"), F.substring_index("url", "?", -1)).otherwise("-"), F.lit("443 -"), "ip", F.replace("user_agent", F.lit(" "), F.lit("+")), "referrer", F.col("status").cast("string"), F.lit("0 0 12"))
    return _requests(s, d).select("event_id", words.alias("value"))


def _times(s, d):
    """The same times in different formats; those of the first kind stand two hours east of UTC."""
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0200"))).when(kind == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return _requests(s, d).select("event_id", text.when(kind == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(kind == 3, F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")).otherwise("no time").alias("value"))


def _tsv(s, d):
    return _requests(s, d).select("event_id", F.concat(F.lit("tabs-"), F.col("event_id") % 2).alias("file"), F.when(F.col("event_id") < 6, F.lit("# note")).when(F.col("event_id") < 8, F.lit("Page URL\tHits")).otherwise(F.concat("url", F.lit("\t1"))).alias("value"))


def _changing(s, d):
    """Blocks of 300 lines of one file; every third block begins with another header, in the ones after it that header still holds."""
    r = _requests(s, d).withColumn("at", F.col("event_id") % 900)
    query = F.when(F.col("url").contains("?"), F.substring_index("url", "?", -1)).otherwise("-")
    one = F.concat_ws(" ", F.col("status").cast("string"), query, F.substring_index("url", "?", 1))
    two = F.concat_ws(" ", "method", F.substring_index("url", "?", 1), F.col("status").cast("string"))
    lines = r.select(F.lit("f").alias("file"), F.floor(F.col("event_id") / 300).alias("block"), (F.col("event_id") * 2 + 1).alias("line"), F.when(F.col("at") < 400, one).otherwise(two).alias("value"), "event_id")
    heads = r.where("at in (0, 400)").select(F.lit("f").alias("file"), F.floor(F.col("event_id") / 300).alias("block"), (F.col("event_id") * 2).alias("line"), F.when(F.col("at") == 0, "#Fields: sc-status cs-uri-query cs-uri-stem").otherwise("#Fields: cs-method cs-uri-stem sc-status").alias("value"), "event_id")
    return lines.unionByName(heads)


def _packed(s, d):
    """The lines as packed and plain text files in the shared folder, read again and parsed."""
    folder = new_folder(s, "logs")
    for kind in ("gzip", "bzip2", "none"):
        number = {"gzip": 0, "bzip2": 1, "none": 2}[kind]
        _combined(s, d).where(F.col("file") == str(number)).select("value").write.option("compression", kind).text(f"{folder}/{number}")
    lines = L.read_logs(s, *[f"{folder}/{number}" for number in range(3)])
    parsed = L.parse_combined(lines.withColumn("file", F.regexp_extract("file", "/([0-9])/[^/]*$", 1)))
    return parsed.where("ok").select("file", "ip", "ts", "method", "url", "status", "bytes", "user_agent", "referrer")


def _disavowed(s, d):
    folder = new_folder(s, "disavow")
    L.write_disavow(s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("s"), F.col("s_nationkey"), F.lit(".example")).alias("domain")), folder)
    lines = s.read.text(folder)
    return L.read_disavow(lines)


def _tables(s, d):
    """Requests a URL, written in four formats for a day and read again."""
    folder = new_folder(s, "tables")
    table = fixtures.view(s, d, "fx_weblog").groupBy("url").agg(F.count("*").alias("requests"))
    E.write_tables({"urls": table}, folder, "2024-05-01", ("parquet", "json", "csv", "tsv"))
    read = {"parquet": s.read, "json": s.read.schema("url string, requests bigint, run_date date").format("json"), "csv": s.read.schema("url string, requests bigint, run_date date").option("header", True).format("csv")}
    read["tsv"] = s.read.schema("url string, requests bigint, run_date date").option("header", True).option("sep", "\t").format("csv")
    parts = [reader.load(f"{folder}/urls.{kind}").select(F.lit(kind).alias("kind"), F.col("run_date").cast("string").alias("run_date"), "url", "requests") for kind, reader in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


#: The rule for a file's first sample; a spoiled first line tells nothing.
FORMATS = f"""WITH {WEB} SELECT file, CASE WHEN event_id % 97 = 0 THEN 'unknown' ELSE 'bracket' END AS format FROM (SELECT CAST(event_id % 3 AS VARCHAR) AS file, min(event_id) AS event_id FROM fx_weblog GROUP BY 1) x
UNION ALL SELECT 'json', 'json' UNION ALL SELECT 'iis', 'iis' UNION ALL SELECT 'tabs-' || k, CASE WHEN n BETWEEN 6 AND 7 THEN 'tsv' ELSE 'unknown' END FROM (SELECT event_id % 2 AS k, min(event_id) FILTER (event_id >= 6) AS n FROM fx_weblog GROUP BY 1) y"""
_FIELDS = "event_id, ip, date_trunc('second', ts) AS ts, method, url, status, bytes, user_agent, referrer"
ALL = {
    "parse_combined": (lambda s, d: L.parse_combined(_combined(s, d)).where("ok").drop("ok", "file"), f"WITH {WEB} SELECT {_FIELDS} FROM fx_weblog WHERE event_id % 97 <> 0"),
    "read_logs": (_packed, f"WITH {WEB} SELECT CAST(event_id % 3 AS VARCHAR) AS file, {_FIELDS.removeprefix('event_id, ')} FROM fx_weblog WHERE event_id % 97 <> 0"),
    "write_disavow": (_disavowed, "SELECT DISTINCT 's' || s_nationkey || '.example' AS domain FROM supplier"),
    "write_tables": (_tables, f"WITH {WEB} SELECT kind, '2024-05-01' AS run_date, url, count(*) AS requests FROM fx_weblog, (VALUES ('parquet'), ('json'), ('csv'), ('tsv')) AS k(kind) GROUP BY ALL"),
    "parse_json_logs": (lambda s, d: L.parse_json_logs(_json(s, d)).drop("ok"), f"WITH {WEB} SELECT {_FIELDS} FROM fx_weblog"),
    "parse_iis": (lambda s, d: L.parse_iis(_iis(s, d)).drop("ok", "bytes"), f"WITH {WEB} SELECT {_FIELDS.replace(' bytes,', '')} FROM fx_weblog"),
    "parse_stats": (lambda s, d: L.parse_stats(L.parse_combined(_combined(s, d))), f"WITH {WEB} SELECT CAST(event_id % 3 AS VARCHAR) AS file, count(*) AS lines, count(*) FILTER (event_id % 97 = 0) AS failed, 1 - count(*) FILTER (event_id % 97 = 0) / count(*) AS rate FROM fx_weblog GROUP BY 1"),
    "detect_log_format": (lambda s, d: L.detect_log_format(_combined(s, d).unionByName(_json(s, d).withColumn("file", F.lit("json"))).unionByName(_iis(s, d).withColumn("file", F.lit("iis"))).unionByName(_tsv(s, d)), order="event_id"), FORMATS),
    "normalise_ts": (lambda s, d: _times(s, d).select("event_id", L.normalise_ts(F.col("value")).alias("x")).select("event_id", "x.ts", "x.tz_aware"), f"WITH {WEB} SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 4 THEN NULL ELSE date_trunc('second', ts) END AS ts, event_id % 5 IN (0, 1) AS tz_aware FROM fx_weblog"),
    "parse_iis_files": (lambda s, d: L.parse_iis_files(_changing(s, d)).select("event_id", "url", "status", "method"), f"WITH {WEB} SELECT event_id, CASE WHEN event_id % 900 < 400 OR NOT contains(url, '?') THEN url ELSE string_split(url, '?')[1] END AS url, status, CASE WHEN event_id % 900 < 400 THEN '-' ELSE method END AS method FROM fx_weblog"),
    "parse_hits_csv": (lambda s, d: L.parse_hits_csv(_requests(s, d).groupBy(F.col("url").alias("Page URL"), F.col("status").cast("string").alias("Response Code")).agg((F.count("*") * 20).cast("string").alias("Hits"))), f"WITH {WEB} SELECT url, status, '' AS user_agent, '-' AS ip, CAST(least(count(*) * 20, 1000) AS INT) AS weight FROM fx_weblog GROUP BY url, status"),
}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items()}
