"""Readers of raw web-server logs: lines to request rows, as column expressions.

Each parser takes a DataFrame with the column ``value`` (a line, as spark.read.text gives it; gz and bz2 are
read as they are) and keeps its other columns. Lines that are no requests get ok = false and null fields, so
a file is parsed and counted in one pass.
"""

from __future__ import annotations

import lzma

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ["ip", "ts", "method", "url", "status", "bytes", "user_agent", "referrer"]
# Names that a field has in JSON logs, in the order in which they are tried.
JSON_NAMES = {
    "url": ["uri", "url", "path", "cs-uri-stem", "request_uri", "ClientRequestURI"],
    "status": ["status", "EdgeResponseStatus", "sc-status", "response_status"],
    "ip": ["ip", "remote_addr", "client_ip", "ClientIP", "c-ip"],
    "user_agent": ["user_agent", "http_user_agent", "ClientRequestUserAgent"],
    "method": ["method", "request_method", "ClientRequestMethod"],
    "bytes": ["bytes", "body_bytes_sent", "EdgeResponseBytes"],
    "referrer": ["referrer", "http_referer"],
    "ts": ["timestamp", "time", "EdgeStartTimestamp"],
}
IIS_FIELDS = ["date", "time", "s-ip", "cs-method", "cs-uri-stem", "cs-uri-query", "s-port", "cs-username", "c-ip", "cs(User-Agent)", "cs(Referer)", "sc-status", "sc-substatus", "sc-win32-status", "time-taken"]


def is_log_name(path: Column) -> Column:
    """Whether a file is called like a log, rotated and compressed ones included."""
    name = F.lower(F.substring_index(path, "/", -1))
    bare = F.regexp_replace(name, r"\.(gz|bz2|xz)$", "")
    return bare.rlike(r"\.(log|txt|csv|tsv|json|jsonl)(\.\d+)?$|\.log[.-]\d+|access_log|access\.log|error_log")


def log_role(path: Column) -> Column:
    """What kind of log a file is, by its name."""
    name = F.regexp_replace(F.lower(F.substring_index(path, "/", -1)), r"\.(gz|bz2|xz)$", "")
    return (
        F.when(name.contains(".error.log") | name.endswith("error.log") | name.contains(".error."), "error")
        .when(name.startswith("php-app.access"), "cloudways_php")
        .when(name.startswith("backend_") & name.contains(".access.log"), "cloudways_backend")
        .when(name.startswith("static_") & name.contains(".access.log"), "cloudways_static")
        .otherwise("access")
    )


def primary_roles(files: DataFrame) -> DataFrame:
    """role, files, main: whether a role's requests count in the main totals. A backend log goes before others, error logs never count."""
    roles = files.groupBy(log_role(F.col("path")).alias("role")).agg(F.count("*").alias("files"))
    w = Window.partitionBy(F.lit(0))
    has = lambda r: F.bool_or(F.col("role") == r).over(w)
    main = F.when(has("cloudways_backend"), F.col("role").isin("cloudways_backend", "access")).when(has("access"), F.col("role") == "access").when(has("cloudways_php"), F.col("role") == "cloudways_php").when(has("cloudways_static"), F.col("role") == "cloudways_static").otherwise(F.col("role") != "error")
    return roles.withColumn("main", main)


def _time(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("dd/MMM/yyyy:HH:mm:ss Z", "dd/MMM/yyyy:HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX")])


def normalise_ts(text: Column) -> Column:
    """struct(ts, tz_aware): a log's time in UTC, and whether it came with a zone; without one it counts as UTC. A text that is no time has null and false."""
    ts = F.coalesce(_time(text), *[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")])
    return F.struct(ts.alias("ts"), F.coalesce(ts.isNotNull() & F.trim(text).rlike(r"([+-]\d{2}:?\d{2}|Z)$"), F.lit(False)).alias("tz_aware"))


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{1,18}$"), text.cast("bigint"))


def _finish(lines: DataFrame, fields: dict[str, Column]) -> DataFrame:
    ok = F.coalesce(fields["status"] > 0, F.lit(False))
    kinds = {"ts": "timestamp", "status": "int", "bytes": "bigint"}
    kept = [c for c in lines.columns if c not in ("value", *FIELDS)]
    return lines.select(*kept, ok.alias("ok"), *[F.when(ok, fields[f].cast(kinds.get(f, "string"))).alias(f) for f in FIELDS])


def parse_combined(lines: DataFrame) -> DataFrame:
    """Lines with a time in brackets: the combined format, the one-line form with two percentages at its end, the form with
    a host in front and an unquoted method, and, failing these, any line with a method and a three-digit status."""
    v = F.col("value")
    stamp = F.regexp_extract(v, r"\[([^\]]*)\]", 1)
    before, after = F.trim(F.regexp_extract(v, r"^([^\[]*)\[", 1)), F.trim(F.regexp_extract(v, r"^[^\[]*\[[^\]]*\](.*)$", 1))
    parts = F.split(after, '"', -1)
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(""))
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    word = lambda c, i: F.coalesce(F.try_element_at(words(c), F.lit(i)), F.lit(""))
    first = F.trim(at(0))
    ips = F.filter(words(before), lambda w: w.rlike(r"^\d+\.\d+\.\d+\.\d+$|^(?=.*:)[0-9a-fA-F:]{5,}$"))
    ip = F.coalesce(F.try_element_at(ips, F.lit(1)), F.try_element_at(words(before), F.lit(1)), F.lit("-"))
    three = lambda c: F.try_element_at(F.filter(words(c), lambda w: w.rlike(r"^\d{3}$")), F.lit(1))
    quoted, unquoted = (first == "") & (F.size(parts) >= 2), (first != "") & ~first.rlike(r"^\d")
    tokens = words(at(2))
    single = (F.size(parts) >= 4) & (F.size(tokens) >= 8) & word(at(2), -1).endswith("%") & word(at(2), -2).endswith("%")
    plain = F.replace(after, F.lit('"'), F.lit(" "))
    method = r"\b(GET|POST|HEAD|PUT|DELETE|OPTIONS|PATCH|CONNECT|TRACE)\s+(\S+)"
    last = F.try_element_at(parts, F.lit(-1))
    size_after = F.try_element_at(F.filter(words(last), lambda w: w.rlike(r"^\d+$")), F.lit(1))
    request = F.split(at(1), " ", 3)
    fields = {
        "ip": ip,
        "ts": _time(F.trim(stamp)),
        "method": F.when(quoted, F.try_element_at(request, F.lit(1))).when(unquoted, word(first, 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract(plain, method, 1), F.lit("")), F.lit("-"))),
        "url": F.when(quoted & single & (F.trim(at(3)) != ""), F.trim(at(3))).when(quoted, F.coalesce(F.try_element_at(request, F.lit(2)), F.lit("-"))).when(unquoted, F.when(F.size(parts) >= 2, at(1)).otherwise("-")).otherwise(F.coalesce(F.nullif(F.regexp_extract(plain, method, 2), F.lit("")), F.lit("-"))),
        "status": F.when(quoted, _number(word(at(2), 1))).when(unquoted, _number(three(at(2)))).otherwise(_number(three(plain))),
        "bytes": F.coalesce(F.when(quoted, _number(word(at(2), 2))).when(unquoted & (F.size(parts) >= 7), _number(size_after)), F.lit(0)),
        "user_agent": F.when((quoted & ~single) | unquoted, at(5)).otherwise(""),
        "referrer": F.when((quoted & ~single) | unquoted, at(3)).otherwise(""),
    }
    bracketed = (stamp != "") & v.contains("]")
    return _finish(lines, fields | {"status": F.when(bracketed, fields["status"])})


def parse_json_logs(lines: DataFrame) -> DataFrame:
    """JSON lines; the first of a field's names that is there and neither empty nor zero counts.

    A line is parsed once, to a map of its texts: maps and found texts are columns of their own, as an expression in another
    counts again for each use. A time has a T or has not, so one format is tried; one that fails is dear.
    """
    told = F.map_filter(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,string>"), lambda _, x: ~x.isin("", "0")).alias("__told")
    texts = lines.select("*", told).select(*lines.columns, *[F.coalesce(*[F.try_element_at("__told", F.lit(n)) for n in JSON_NAMES[f]]).alias(f"__{f}") for f in FIELDS])
    text = lambda f, none: F.coalesce(f"__{f}", F.lit(none))
    ts, whole = F.trim("__ts"), lambda f, kind: F.col(f"__{f}").try_cast(kind)
    stamp = F.when(ts.contains("T"), F.try_to_timestamp(ts, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))).otherwise(F.try_to_timestamp(ts, F.lit("yyyy-MM-dd HH:mm:ss")))
    done = texts.withColumns({"__ts": stamp, "__status": whole("status", "int"), "__bytes": F.coalesce(whole("bytes", "bigint"), F.lit(0))})
    fields = {"ip": text("ip", "-"), "ts": F.col("__ts"), "method": text("method", "-"), "url": text("url", "-"), "status": F.col("__status"), "bytes": F.col("__bytes"), "user_agent": text("user_agent", ""), "referrer": text("referrer", "")}
    return _finish(done, fields).drop(*[f"__{f}" for f in FIELDS])


def parse_iis(lines: DataFrame, fields: Column | None = None) -> DataFrame:
    """Lines of words under a list of field names (an array column, by default the usual list)."""
    names = F.array(*map(F.lit, IIS_FIELDS)) if fields is None else fields
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    at = lambda n: F.when(F.array_position(names, n) > 0, F.try_element_at(words, F.array_position(names, n).cast("int")))
    query = at("cs-uri-query")
    url = F.coalesce(at("cs-uri-stem"), F.lit("-"))
    url = F.when(query.isNotNull() & ~query.isin("", "-"), F.concat(url, F.lit("?"), query)).otherwise(url)
    status = F.when(~F.col("value").startswith("#"), at("sc-status").try_cast("int"))
    ts = F.try_to_timestamp(F.concat_ws(" ", at("date"), at("time")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return _finish(lines, {"ip": F.coalesce(at("c-ip"), F.lit("-")), "ts": ts, "method": F.coalesce(at("cs-method"), F.lit("-")), "url": url, "status": status, "bytes": F.coalesce(_number(at("sc-bytes")), F.lit(0)), "user_agent": F.replace(F.coalesce(at("cs(User-Agent)"), F.lit("")), F.lit("+"), F.lit(" ")), "referrer": F.coalesce(at("cs(Referer)"), F.lit(""))})


def parse_fpm3(files: DataFrame, year: int) -> DataFrame:
    """Whole files (file, content) of the form with three lines a request: time, address, request. It has no agent and no year."""
    lines = F.array_join(F.filter(F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    group = r"(?m)^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\n\d{1,3}(?:\.\d{1,3}){3}\n.*$"
    three = files.withColumn("g", F.explode(F.regexp_extract_all(lines, F.lit(group), F.lit(0)))).withColumn("g", F.split("g", "\n")).drop("content")
    parts = F.split(F.col("g")[2], '"', -1)
    word = lambda c: F.nullif(F.regexp_extract(F.trim(c), r"^(\S+)", 1), F.lit(""))
    url = F.coalesce(F.nullif(F.trim(F.element_at(parts, -1)), F.lit("")), F.lit("-"))
    stamp = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(F.col("g")[0], r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    status = F.when(F.size(parts) >= 2, _number(word(parts[1])))
    return _finish(three, {"ip": F.col("g")[1], "ts": stamp, "method": F.coalesce(word(parts[0]), F.lit("-")), "url": F.when(url.startswith("/") | (url == "-"), url).otherwise(F.concat(F.lit("/"), url)), "status": status, "bytes": F.lit(0), "user_agent": F.lit(""), "referrer": F.lit("")}).drop("g")


def parse_last_resort(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Requests in the lines (file, value) of files from which ``parsed`` (file, ok) has none: an address, a method, a URL and a status."""
    hopeless = parsed.groupBy("file").agg(F.count_if("ok").alias("n")).where("n = 0").select("file")
    pattern = r"(\S+).*?[\"\s]([A-Z]+)\s+(\S+).*?(\d{3})"
    part = lambda i: F.regexp_extract(F.trim("value"), pattern, i)
    status = F.when(part(1) != "", part(4).try_cast("int"))
    return _finish(lines.join(hopeless, "file", "left_semi"), {"ip": part(1), "ts": F.lit(None).cast("timestamp"), "method": part(2), "url": part(3), "status": F.when(status.between(100, 599), status), "bytes": F.lit(0), "user_agent": F.lit(""), "referrer": F.lit("")}).where("ok")


def parse_hits_csv(rows: DataFrame) -> DataFrame:
    """Rows of a crawl export with text columns of any names: url, status, user_agent, ip, weight.

    A row stands for up to 1000 hits; they become its weight rather than as many rows.
    """
    names = rows.columns

    def find(*parts: str) -> Column | None:
        return next((F.col(f"`{c}`") for p in parts for c in names if p in c.lower()), None)

    url, status, hits, ua, ip = find("url", "path", "uri", "page"), find("status", "response", "code"), find("hits", "count", "events", "requests"), find("user_agent", "user-agent", "agent"), find("ip", "address", "remote")
    if url is None:
        raise ValueError(f"no column of {names} looks like a URL")
    weight = F.lit(1) if hits is None else F.least(F.greatest(F.coalesce(hits.try_cast("double").cast("int"), F.lit(1)), F.lit(1)), F.lit(1000))
    return rows.select(F.coalesce(url, F.lit("-")).alias("url"), (F.lit(200) if status is None else F.coalesce(F.trim(status).try_cast("int"), F.lit(200))).alias("status"), (F.lit("") if ua is None else F.coalesce(ua, F.lit(""))).alias("user_agent"), (F.lit("-") if ip is None else F.coalesce(ip, F.lit("-"))).alias("ip"), weight.alias("weight"))


def parse_stats(parsed: DataFrame, file: str = "file") -> DataFrame:
    """Per file: lines, failed lines, parse rate."""
    return parsed.groupBy(file).agg(F.count("*").alias("lines"), F.count_if(~F.col("ok")).alias("failed")).withColumn("rate", 1 - F.col("failed") / F.greatest("lines", F.lit(1)))


# What the lines of a three-line request look like.
FPM_LINES = [r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$", r"^\d{1,3}(?:\.\d{1,3}){3}$", r'^[A-Z]+ "']
#: Lines of a file's head that are looked at, and those of them that count.
HEAD_LINES, SAMPLES = 20, 5


def detect_log_format(lines: DataFrame, file: str = "file", order: str = "line") -> DataFrame:
    """Per file: json, csv, tsv, iis, bracket, fpm3 or unknown, by the first rule that applies to its samples.

    Samples are the first five lines, of the file's first twenty, that are neither empty nor begin with #; most rules look at the first. ``lines`` may be
    whole files, of which only the heads are kept by a rank limit, or better what ``read_heads`` reads.
    """
    first = Window.partitionBy(file).orderBy(order)
    head = lines.select(file, order, F.trim("value").alias("v")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= HEAD_LINES)
    use = (F.col("v") != "") & ~F.col("v").startswith("#")
    samples = F.slice(F.transform(F.array_sort(F.collect_list(F.when(use, F.struct("r", "v")))), lambda x: x["v"]), 1, SAMPLES)
    at = lambda i: F.coalesce(F.try_element_at("s", F.lit(i)), F.lit(""))
    one, lower = at(1), F.lower(at(1))
    says = lambda *words: lower.rlike("|".join(words))
    kind = F.when(one.startswith("{"), "json").when(one.contains(",") & says("url", "status", "path"), "csv").when(one.contains("\t") & says("url", "status"), "tsv")
    kind = kind.when(one.rlike(r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+"), "iis").when(one.contains("[") & one.contains("]"), "bracket")
    kind = kind.when(at(1).rlike(FPM_LINES[0]) & at(2).rlike(FPM_LINES[1]) & at(3).rlike(FPM_LINES[2]), "fpm3").otherwise("unknown")
    return head.groupBy(file).agg(samples.alias("s")).select(file, kind.alias("format"))


def read_heads(spark: SparkSession, *paths: str, lines: int = HEAD_LINES, most_bytes: int = 1 << 16) -> DataFrame:
    """file, line, value of the first lines of files, plain or packed by gz, bz2 or xz, reading no more than ``most_bytes`` unpacked bytes of each.

    Only names are listed by Spark; a task opens a file and stops after its head, so the work does not grow with the files.
    A line that is longer than what is read counts as what was read of it; an empty file has no line.
    """

    def heads(batches):
        import io

        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, where = fs.FileSystem.from_uri(path)
                kind = {"gz": "gzip", "bz2": "bz2"}.get(path.rsplit(".", 1)[-1])
                with store.open_input_stream(where, compression=kind, buffer_size=1 << 14) as stream:
                    # A reader that gives its bytes in pieces; xz is unpacked as they come.
                    raw = io.BufferedReader(stream, 1 << 14) if not path.endswith(".xz") else lzma.LZMAFile(stream)
                    found = raw.read(most_bytes).decode("utf-8", "ignore").splitlines()[:lines]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], ["file", "line", "value"])

    listed = spark.read.format("binaryFile").load(list(paths)).select("path")
    return listed.mapInArrow(heads, "file string, line bigint, value string")


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file, block, line, value of text files. block is where the line's split of the file begins, and line grows within a block, so
    (block, line) is the order of the file; no line is counted and no file needs to be in one task."""
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def parse_iis_files(lines: DataFrame, file: str = "file", block: str = "block", order: str = "line") -> DataFrame:
    """parse_iis of files whose ``#Fields:`` header may change on the way: each line is read by the last header before it.

    A block's lines are ordered by themselves. What a block begins with is the last header of the blocks before it, found over
    one row a block. Lines before any header have the usual fields.
    """
    names = F.filter(F.split(F.trim(F.regexp_replace("value", "#Fields:", "")), r"\s+"), lambda x: x != "")
    marked = lines.withColumn("__own", F.when(F.trim("value").startswith("#Fields:"), names))
    # Blocks are numbered by place, as a null block would not join.
    marked = marked.withColumn("__block", F.coalesce(F.col(block), F.lit(-1)))
    last = marked.where("__own is not null").groupBy(file, "__block").agg(F.max_by("__own", order).alias("__last"))
    blocks = marked.select(file, "__block").distinct().join(last, [file, "__block"], "left")
    earlier = Window.partitionBy(file).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(file, "__block", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    within = Window.partitionBy(file, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = marked.withColumn("__own", F.last("__own", ignorenulls=True).over(within)).join(carried, [file, "__block"])
    body = known.where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    fields = F.coalesce("__own", "__carried", F.array(*map(F.lit, IIS_FIELDS)))
    return parse_iis(body.withColumn("__fields", fields), F.col("__fields")).drop("__fields", "__own", "__carried", "__block")


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """file, value of text logs, plain or compressed by gz or bz2; xz files are decompressed one a task."""
    text = spark.read.text([p for p in paths if not p.endswith(".xz")]) if any(not p.endswith(".xz") for p in paths) else None
    plain = text.select(F.col("_metadata.file_path").alias("file"), "value") if text is not None else None
    packed = [p for p in paths if p.endswith(".xz")]
    if not packed:
        return plain

    def unpack(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = lzma.decompress(content).decode("utf-8", "ignore").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(lines, pa.string())], ["file", "value"])

    lines = spark.read.format("binaryFile").load(packed).select("path", "content").mapInArrow(unpack, "file string, value string")
    return lines if plain is None else plain.unionByName(lines)


def read_sitemap(lines: DataFrame) -> DataFrame:
    """loc: the addresses in sitemap text."""
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc"))


def read_disavow(lines: DataFrame) -> DataFrame:
    """domain: the domains of a disavow file, comments left out."""
    name = F.lower(F.trim(F.regexp_replace("value", r"#.*$|^\s*domain:", "")))
    return lines.where(~F.trim("value").startswith("#")).select(F.regexp_replace(name, r"^www\.", "").alias("domain")).where("domain != ''").distinct()


def write_disavow(domains: DataFrame, path: str) -> None:
    """One sorted file of ``domain:`` lines; a list of domains to disavow is small."""
    domains.select("domain").distinct().orderBy("domain").coalesce(1).select(F.concat(F.lit("domain:"), "domain").alias("value")).write.mode("overwrite").text(path)
