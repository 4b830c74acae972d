"""Operators on small hand-made rows."""

import datetime
import os
import shutil
import subprocess
import sys
from pathlib import Path
import lzma
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from searchlight import catalog, fixtures
from searchlight.operators import clusters, intents, links, page_audit, page_checks, page_tree, pages, periods, routing, search, trust, weblog
from searchlight.sources import exports, logs
from searchlight.streaming import weblog as live

SF = "/root/testdata/sf0.001"

ROUTED = {
    "organic traffic dropped on Shopify": "decline-diagnosis",
    "ranking down after the core update": "decline-diagnosis",
    "lost traffic after migration": "decline-diagnosis",
    "indexed but not ranking, not graduating": "decline-diagnosis",
    "build a topical map for this niche": "topical-map",
    "content cluster and keyword map": "topical-map",
    "javascript rendered DOM vs raw html": "technical-seo",
    "robots.txt crawl blocked googlebot": "technical-seo",
    "google-selected canonical mismatch": "technical-seo",
    "log file crawl budget waste": "technical-seo",
    "toxic link and backlink profile": "technical-seo",
    "location page": "local-gbp",
    "gbp google business profile": "local-gbp",
    "city page doorway same content": "service-location-pages",
    "eeat authorship author missing": "content-eeat",
    "affiliate review site disclosure": "content-eeat",
    "new site new domain what is this business": "domain-understanding",
    "money page conversion cro": "money-pages",
    "schema structured data rich result": "structured-data",
    "weekly report for the client": "weekly-reporting",
    "asdf qwerty zxcv banana": "decision-router",
}


def test_routes(spark):
    rows = routing.route_situations(spark.createDataFrame([(t,) for t in [*ROUTED, "topical map"]] + [(None,)], "t string"), "t", "t").collect()
    got = {r.t: r for r in rows}
    assert {t: got[t].section for t in ROUTED} == ROUTED
    assert (got["location page"].confidence, got["location page"].alternate) == ("low", "service-location-pages")
    assert (got["topical map"].confidence, got["topical map"].alternate) == ("high", None) and got[None].section == "decision-router"


LINES = {
    '66.249.66.1 - - [10/Oct/2024:13:55:36 +0200] "GET /a?b=1 HTTP/1.1" 200 2326 "https://r.example/" "Mozilla/5.0"': ("66.249.66.1", "GET", "/a?b=1", 200, 2326, "Mozilla/5.0", "https://r.example/"),
    'host.example 1.2.3.4 [10/Oct/2024:13:55:36 +0000] GET "/url" HTTP/2.0 404 "ref" "agent" 9.9.9.9 "/index.php" - 0.5 4321 1.0 2.0': ("1.2.3.4", "GET", "/url", 404, 4321, "agent", "ref"),
    '1.2.3.4 - - [10/Oct/2024:13:55:36 +0000] "GET /index.php HTTP/1.1" 200 - 1 2 3 4 5.0% 6.0% "/real"': None,
    '1.2.3.4 - - [10/Oct/2024:13:55:36] "POST /x HTTP/1.1" 500 -': ("1.2.3.4", "POST", "/x", 500, 0, "", ""),
    "1.2.3.4 [10/Oct/2024:13:55:36 +0000] 17 GET /raw 301 x": ("1.2.3.4", "GET", "/raw", 301, 0, "", ""),
    "::1abc - - [bad time] \"GET / HTTP/1.1\" 200 1": ("::1abc", "GET", "/", 200, 1, "", ""),
    "garbage": None,
    "": None,
}


def test_combined_lines(spark):
    rows = {r.value2: r for r in logs.parse_combined(spark.createDataFrame([(x, x) for x in LINES], "value string, value2 string")).collect()}
    for line, want in LINES.items():
        r = rows[line]
        if want:
            assert (r.ip, r.method, r.url, r.status, r.bytes, r.user_agent, r.referrer) == want, line
    assert not rows["garbage"].ok and rows["garbage"].status is None and not rows[""].ok
    first = next(iter(LINES))
    assert rows[first].ts == datetime.datetime(2024, 10, 10, 11, 55, 36)


def test_json_and_roles(spark):
    lines = ['{"uri":"","url":"/u","status":0,"sc-status":404,"ip":"1.1.1.1"}', '{"url":"/x"}', "not json", None]
    rows = logs.parse_json_logs(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.ok, r.url, r.status) for r in rows] == [(True, "/u", 404), (False, None, None), (False, None, None), (False, None, None)]
    files = spark.createDataFrame([("/l/backend_x.access.log.gz",), ("/l/access.log.1",), ("/l/x.error.log",), ("/l/static_a.access.log",)], "path string")
    assert {r.role: r.main for r in logs.primary_roles(files).collect()} == {"cloudways_backend": True, "access": True, "error": False, "cloudways_static": False}
    assert [r[0] for r in files.select(logs.is_log_name(F.col("path"))).collect()] == [True] * 4


def test_packed_logs(spark, tmp_path):
    (tmp_path / "a.log.xz").write_bytes(lzma.compress(b"one\ntwo\xff\n"))
    (tmp_path / "b.log").write_text("three\n")
    rows = logs.read_logs(spark, str(tmp_path / "a.log.xz"), str(tmp_path / "b.log")).collect()
    assert sorted(r.value for r in rows) == ["one", "three", "two"]


def test_range_join_takes_the_first_in_the_list(spark):
    ranges = spark.createDataFrame([(2, "a", "Wide", 0, 2**32 - 1), (1, "b", "Narrow", 16909056, 16909311), (3, "c", "Other", 16909056, 16909056)], "list_order int, class string, agent string, lo long, hi long")
    ips = spark.createDataFrame([("1.2.3.4",), ("1.2.3.0",), ("9.9.9.9",), ("::1",), ("1.2.3.4",), (None,)], "ip string")
    got = {r.ip: r.verified_agent for r in weblog.verify_bot_ip(ips, ranges).collect()}
    assert got == {"1.2.3.4": "Narrow (verified IP)", "1.2.3.0": "Narrow (verified IP)", "9.9.9.9": "Wide (verified IP)"}


def test_class_counts_add_up(spark):
    requests = fixtures.view(spark, SF, "fx_weblog")
    classified = weblog.classify_requests(requests, fixtures.view(spark, SF, "fx_ranges"))
    assert weblog.traffic_segments(classified).agg(F.sum("requests")).first()[0] == requests.count()


@pytest.mark.parametrize("dof, chi2, p", [(1, 3.841458820694124, 0.05), (5, 11.070497693516351, 0.05), (10, 2.0, 0.9963401531726563), (4, 40.0, 4.3284225607e-08)])
def test_gamma_tail(dof, chi2, p):
    assert math.isclose(periods.gamma_tail(dof / 2, chi2 / 2), p, rel_tol=1e-6)


def test_changepoint_finds_the_cliff(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("s", day + datetime.timedelta(i), 1000.0 if i < 40 else 300.0 + i % 3) for i in range(80)] + [("short", day, 1.0)]
    found = periods.changepoint(spark.createDataFrame(rows, "page string, date date, impressions double"), "page").collect()
    assert [(r.series, r.break_date) for r in found] == [("s", day + datetime.timedelta(40))]


def test_shift_and_position_parts_add_up(spark):
    keys = catalog.periods._keys(spark, SF)
    shift = periods.shift_share(keys, 56, 56).first()
    assert shift.share_lost + shift.share_retained + shift.share_new == pytest.approx(1)
    p = periods.position_decomposition(keys).first()
    assert p.compositional + p.real == pytest.approx(p.b_all - p.a_all)


def test_star_clusters_equal_the_greedy_ones(spark):
    rng = random.Random(4)
    names = [f"p{i:02d}" for i in range(30)]
    clicks = {n: rng.randrange(8) for n in names}
    edges = {tuple(sorted(rng.sample(names, 2))) for _ in range(45)}
    want, claimed = {}, set()
    for page in sorted(names, key=lambda n: (-clicks[n], n)):
        if page not in claimed:
            for other in [n for n in names if tuple(sorted((page, n))) in edges and n != page and n not in claimed] + [page]:
                want[other] = page
                claimed.add(other)
    found = clusters.star_clusters(spark.createDataFrame(list(clicks.items()), "page string, clicks long"), spark.createDataFrame(list(edges), "a string, b string"))
    assert {r.page: r.primary for r in found.collect()} == want


def test_action_plan_has_each_page_once(spark):
    rows = catalog.QUERIES["action_plan"](spark, SF).collect()
    wanted = fixtures.view(spark, SF, "fx_dense").select("page").distinct().count()
    assert len({r.page for r in rows}) == len(rows) == wanted


def test_crossover():
    """a fades while b grows: the hand-off is found; with equal or constant series there is none."""
    a = np.array([20, 22, 25, 24, 20, 15, 10, 6, 2, 0, 0, 0, 0, 0, 0, 0], float)
    b = np.array([0, 0, 1, 3, 6, 10, 14, 18, 22, 25, 26, 27, 28, 29, 30, 31], float)
    at, reason = intents.crossover(a, b)
    assert reason == "handoff" and 5 <= at <= 8
    assert intents.crossover(a, a)[0] is None and intents.crossover(b, a)[0] is None
    assert intents.crossover(a[:7], b[:7])[1] == "few weeks" and intents.crossover(np.ones(16), b)[1] == "low peak"


def test_query_blocks(spark):
    queries = spark.createDataFrame([("red shoes",), ("blue shoes",), ("blue hat",), ("alone here",), ("green tea",), ("tea pot",)], "query string")
    found = {r.query: r.block for r in clusters.query_blocks(queries).collect()}
    assert found == {"red shoes": "blue hat", "blue shoes": "blue hat", "blue hat": "blue hat", "green tea": "green tea", "tea pot": "green tea"}


def test_robots(spark):
    rules = spark.createDataFrame([("h", "*", False, "/"), ("h", "*", True, "/public"), ("h", "bot", False, "/x"), ("h", "bot", False, "")], "host string, agent string, allow boolean, path string")
    asked = spark.createDataFrame([("h", "/public/a", "Other"), ("h", "/b", "Other"), ("h", "/b", "Bot"), ("h", "/x/1", "Bot"), ("none", "/", "Bot")], "host string, path string, bot string")
    assert {(r.host, r.path, r.bot): r.allowed for r in pages.robots_access(rules, asked).collect()} == {("h", "/public/a", "Other"): True, ("h", "/b", "Other"): False, ("h", "/b", "Bot"): True, ("h", "/x/1", "Bot"): False, ("none", "/", "Bot"): True}


def test_signals_of_odd_pages():
    page = '<html><head><title>A &amp; B</title><meta name="description" content="d"><link rel="canonical" href="/c"><script type="application/ld+json">{"@graph":[{"@type":["Article","Thing"]},{"author":{"@type":"Person"}}]}</script></head><body><h1>One<h2>Two</h2><img src="a"><img src="b" alt="x"><a href="/l">l</a><b>'
    s = pages.signals_of(page)
    assert (s["title"], s["description"], s["canonical"], s["links"], s["images_without_alt"]) == ("A & B", "d", "/c", ["/l"], ["a"])
    assert sorted(s["jsonld_types"]) == ["Article", "Person", "Thing"] and not s["failed"]
    assert pages.signals_of(None)["links"] == [] and pages.signals_of("<![broken")["title"] is None


def test_disavow_files(spark, tmp_path):
    lines = spark.createDataFrame([("# note",), ("domain:www.A.example",), ("b.example # x",), ("",), ("domain:a.example",)], "value string")
    domains = logs.read_disavow(lines)
    logs.write_disavow(domains, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["domain:a.example", "domain:b.example"]
    assert [r.loc for r in logs.read_sitemap(spark.createDataFrame([("<url><loc> https://a/ </loc></url><url><loc>b</loc></url>",)], "value string")).collect()] == ["https://a/", "b"]


def test_stream_equals_batch(spark):
    stream = {r.day: r.total for r in catalog.QUERIES["stream_crawl_trend"](spark, SF).collect()}
    batch = {r.day: r.total for r in catalog.QUERIES["crawl_trend"](spark, SF).collect()}
    assert stream and set(batch) - set(stream) <= {max(batch)} and all(batch[d] == n for d, n in stream.items())


def test_trend_labels(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("up", day + datetime.timedelta(7 * i), float(10 + i)) for i in range(12)] + [("none", day + datetime.timedelta(7 * i), 0.0) for i in range(12)] + [("short", day, 5.0)]
    weekly = search.weekly_clicks(spark.createDataFrame(rows, "page string, date date, clicks double"))
    assert {r.page: r.trend for r in search.trend_label(weekly).collect()} == {"up": "Positive, Growing & Stable Position", "none": "Hits 0 Clicks", "short": "Stable, Flat"}


def test_keyword_master_fills_zeros(spark):
    rows = [("Red Hat", 5.0, 0.0, 1.0, "s", 1), ("red hat", 9.0, 0.0, 0.0, "t", 2), ("RED HAT", 9.0, 4.0, 2.0, "u", 3)]
    r = links.keyword_master(spark.createDataFrame(rows, "keyword string, search_volume double, kd double, cpc double, seed string, ordinal long")).collect()
    assert [(x.keyword, x.kd, x.cpc, x.seed) for x in r] == [("red hat", 4.0, 2.0, "t")]


def test_driver_contract(spark):
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("away", [("searchlight/llm", "tests/llm", "corpus_pipeline.py"), ("searchlight/llm", "tests/llm"), ()])
def test_driver_contract_without_the_training_data_folders(tmp_path, away):
    """In a copy without those folders, and on a machine without the vocabularies, all other queries stay."""
    root = Path(__spark_entry__.__file__).parent
    for name in ("searchlight", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    for name in away:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        else:
            (tmp_path / name).unlink(missing_ok=True)
    hide = "" if away else "import sys; sys.modules['public_tokenizers'] = None; "
    said = subprocess.run([sys.executable, "-c", hide + "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.splitlines()[-1].split() == sorted(catalog.QUERIES)


def test_names_in_referrers(spark):
    """One pass finds any name anywhere; the number of blocks changes nothing."""
    texts = ["https://a.example/x/y", "/x", "", None, "https://ü.example/é?q=/p/1", "https://none.example"]
    names = [("/x",), ("/p/1",), ("é?",), ("",), (None,), ("zzz",)]
    frame, names = spark.createDataFrame([(t,) for t in texts], "referrer string"), spark.createDataFrame(names, "source string")
    for most_chars in (10**6, 3):
        assert sorted(r[0] for r in weblog.naming(frame, names, most_chars).collect()) == sorted([texts[0], texts[1], texts[4]])
    assert weblog.naming(frame, names.where("source = ''")).collect() == []


def test_ip6_addresses(spark):
    import ipaddress

    good = ["::", "::1", "2001:db8::8:800:200c:417a", "FF01::101", "1:2:3:4:5:6:7:8", "1::8"]
    bad = ["1.2.3.4", "1:2:3", "1::2::3", "g::1", "12345::", "1:2:3:4:5:6:7:8:9", "", None]
    rows = {r.ip: r.h for r in spark.createDataFrame([(x,) for x in good + bad], "ip string").select("ip", weblog.ip6_hex(F.col("ip")).alias("h")).collect()}
    assert all(rows[x] == f"{int(ipaddress.ip_address(x)):032x}" for x in good) and all(rows[x] is None for x in bad)
    rng = random.Random(3)
    ips = [str(ipaddress.IPv6Address(rng.getrandbits(128) if rng.random() < 0.5 else (0x2001 << 112) + rng.getrandbits(20))) for _ in range(200)]
    networks = [str(ipaddress.ip_network((int(ipaddress.ip_address(ip)), rng.choice([0, 1, 3, 29, 64, 109, 127, 128])), strict=False)) for ip in ips[:40]]
    ranges = spark.createDataFrame([(i, "c", f"n{i}", n, None, None) for i, n in enumerate(networks)], "list_order int, class string, agent string, cidr string, lo long, hi long")
    got = {r.ip: r.verified_agent for r in weblog.verify_bot_ip(spark.createDataFrame([(x,) for x in ips], "ip string"), ranges).collect()}
    first = lambda ip: next((f"n{i} (verified IP)" for i, n in enumerate(networks) if ipaddress.ip_address(ip) in ipaddress.ip_network(n)), None)
    assert all(got.get(ip) == first(ip) for ip in ips)


def test_trees_of_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>x</p>" * 3000
    rows = [(1, None), (2, ""), (3, "<p>a<p>b</i></p><![broken"), (4, deep), (5, "<html><body>" + "<ul>" + "<li>a b" * 6 + "</ul><h2></h2><div class='  x y '><h3> </h3><i></i><b></b><u></u></div></body>"), (5, "<p>again")]
    elements = page_tree.page_elements(spark.createDataFrame(rows, "page_id long, html string").withColumn("node", F.lit("extra")))
    metrics = {r.page_id: (r.nodes, r.depth, r.children) for r in page_tree.dom_metrics(elements).collect() if r.page_id != 5}
    assert metrics == {3: (2, 2, 1), 4: (6000, 3001, 3000)}
    found = [(r.page_id, r.rank, r.label, r.nodes, r.words) for r in page_tree.page_sections(elements).where("page_id < 5").collect()]
    assert found == [(4, 1, "div", 6000, 3000)]
    own = page_tree.page_elements(spark.createDataFrame(rows[4:5], "page_id long, html string"))
    assert [(r.rank, r.label, r.nodes, r.words) for r in page_tree.page_sections(own).orderBy("rank").collect()] == [(1, "ul", 7, 12), (2, "x", 5, 0)]
    assert page_tree.page_sections(own.limit(0)).collect() == [] and page_tree.dom_metrics(own.limit(0)).collect() == []


def test_graph_of_odd_pages(spark):
    rows = [(1, None), (2, "<script type=application/ld+json>[1, null, \"x\", {}]</script>"), (3, '<script type="application/ld+json">' + '{"a":' * 400 + "1" + "}" * 400 + "</script>"), (4, '<script type="application/ld+json">{"@type":[1,"Article"],"author":["Ann",{"@id":"#x"}]}</script><script type="application/ld+json">{"@id":"#x","@type":"Person","name":["N"]}</script>')]
    got = {r.page_id: r for r in trust.trust_signals(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert len(got) == 4 and got[1].blocks == 0 and got[2].article_type is None and not got[3].names_nobody
    assert (got[4].article_type, got[4].author_type, got[4].byline, got[4].persons) == ("Article", "Person", None, 1)
    assert trust.trust_signals(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_rules_are_data(spark):
    features = spark.createDataFrame([(1, "a", 3.0), (1, "b", None), (2, "a", -1.0)], "page_id long, metric string, value double")
    rules = spark.createDataFrame([("r1", "High", "a", "between", "0", "3"), ("r2", "Low", "b", ">", "0", None), ("r3", "Low", "a", "in", "x, -1", None), ("r4", "Low", "none", "=", "1", None), ("r5", "Low", None, None, None, None), ("r6", "Low", "a", "<", "zero", None)], "rule_id string, severity string, metric string, operator string, low string, high string")
    got = {(r.page_id, r.rule_id): r.status for r in page_tree.rule_catalogue_check(features, rules).collect()}
    assert got == {(1, "r1"): "pass", (2, "r1"): "fail", (1, "r2"): "not measured", (1, "r3"): "fail", (2, "r3"): "pass", (None, "r4"): "needs review", (None, "r5"): "needs review", (1, "r6"): "not measured", (2, "r6"): "not measured"}


def test_robots_files(spark):
    text = "User-agent: A\nUser-agent: b\nDisallow: /x\n\nUser-agent: *\nDisallow: /\nAllow: /ok\nUser-agent: c\nDisallow:\nSitemap: https://h/s.xml"
    lines = spark.createDataFrame([("h", i, x) for i, x in enumerate(text.split("\n"))] + [("h2", 0, "Disallow: /early"), ("h2", 1, None)], "host string, line int, value string")
    asked = spark.createDataFrame([("h", p, b) for p in ("/x/1", "/ok", "/z") for b in ("A", "B", "C", "other")] + [("h2", "/early", "A"), ("h2", None, None), ("h", "/x/1", "A")], "host string, path string, bot string")
    got = {compat: {(r.host, r.path, r.bot): r.allowed for r in pages.robots_access(pages.parse_robots(lines, compat), asked, compat).collect()} for compat in (False, True)}
    blocked = {compat: {k[1:] for k, v in rows.items() if not v} for compat, rows in got.items()}
    assert blocked[False] == {("/x/1", "A"), ("/x/1", "B"), ("/x/1", "other"), ("/z", "other")}
    assert blocked[True] == {(p, b) for p in ("/x/1", "/z") for b in ("A", "B", "C", "other")}


def test_stream_takes_up_a_new_profile(spark, tmp_path):
    """An IP that a batch run finds to be a logged-in user's is one from the next batch on."""
    requests = fixtures.view(spark, SF, "fx_weblog").withColumn("ts", F.col("ts").cast("timestamp")).where("user_agent like '%Chrome/137%'").limit(8).withColumn("ip", F.lit("10.9.9.9"))
    requests.coalesce(1).write.parquet(str(tmp_path / "in"))
    profile = lambda share: spark.createDataFrame([("10.9.9.9", 10, share)], "ip string, hits long, admin_share double").write.mode("overwrite").parquet(str(tmp_path / "profile"))
    out = lambda: [agent for _, agent in sorted({(r.batch, r.agent) for r in spark.read.parquet(str(tmp_path / "out")).select("batch", "agent").collect()})]

    def run():
        stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
        write = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))
        query = live.classify_batches(stream, lambda: spark.read.parquet(str(tmp_path / "profile")), lambda: fixtures.view(spark, SF, "fx_ranges"), write).option("checkpointLocation", str(tmp_path / "state")).start()
        return query

    profile(0.0)
    query = run()
    query.processAllAvailable()
    assert set(out()) == {"Human"}
    profile(0.9)
    requests.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert out() == ["Human", "Logged-in Admin / Session"]


def test_links_in_any_quotes(spark):
    html = """<a href="/a">1</a><A class=x HREF='/b"c'>2</A><a href=/d>3</a><a name=x>4</a><a href="">5</a>"""
    rows = page_checks.page_links(spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string")).orderBy("position").collect()
    assert [r.href for r in rows] == ["/a", '/b"c', "/d", ""]


def test_formats_by_heads(spark, tmp_path):
    import bz2
    import gzip

    texts = {
        "a.log": '\n# c\n1.1.1.1 - - [10/Oct/2024:13:55:36 +0000] "GET / HTTP/1.1" 200 1\n', "b.log": "\n" * 25 + "{}", "c.csv": "Page URL,Hits\n/x,1\n", "d.tsv": "URL\thits\n", "e.log": "2024-01-01 00:00:00 GET /\n",
        "f.log": 'Jan  5 10:00:01\n10.0.0.1\nGET "200 0.1" /p\n', "g.log": "words, only\n", "h.log": "", "i.log": "{" + "x" * 300_000,
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "j.log.gz").write_bytes(gzip.compress(b'{"a":1}\n' * 100_000))
    (tmp_path / "k.log.bz2").write_bytes(bz2.compress(b"2024-01-01 00:00:00 x\n" * 1000))
    (tmp_path / "l.log.xz").write_bytes(lzma.compress(b"x [y] z\n" * 100_000))
    heads = logs.read_heads(spark, str(tmp_path))
    assert max(r.n for r in heads.groupBy("file").agg(F.count("*").alias("n")).collect()) <= 20 and heads.agg(F.max(F.length("value"))).first()[0] <= 1 << 16
    got = {r.file.rsplit("/", 1)[-1]: r.format for r in logs.detect_log_format(heads).collect()}
    assert got == {"a.log": "bracket", "b.log": "unknown", "c.csv": "csv", "d.tsv": "tsv", "e.log": "iis", "f.log": "fpm3", "g.log": "unknown", "i.log": "json", "j.log.gz": "json", "k.log.bz2": "iis", "l.log.xz": "bracket"}


def test_headers_that_change_in_a_file(spark, tmp_path):
    (tmp_path / "a.log").write_text("#Software: x\n#Fields: cs-uri-stem sc-status\n/a 200\n#Fields: sc-status cs-uri-stem\n404 /b\n" + "404 /c\n" * 5)
    (tmp_path / "b.log").write_text("500 /no-header\n")
    lines = logs.numbered_lines(spark, str(tmp_path))
    rows = logs.parse_iis_files(lines).where("ok")
    assert sorted((r.url, r.status) for r in rows.collect()) == [("/a", 200), ("/b", 404)] + [("/c", 404)] * 5
    split = spark.createDataFrame([("f", b, i, v) for i, (b, v) in enumerate([(0, "#Fields: cs-uri-stem sc-status"), (0, "/a 200"), (7, "/b 200"), (9, "/c 200"), (9, "#Fields: sc-status cs-uri-stem"), (9, "200 /d"), (12, "200 /e")])], "file string, block long, line long, value string")
    assert sorted(r.url for r in logs.parse_iis_files(split).where("ok").collect()) == ["/a", "/b", "/c", "/d", "/e"]


def test_candidates_by_smallest_hashes(spark):
    """Pages that share over half of their lines meet; measured against the join of all lines."""
    rng = random.Random(8)
    rows = []
    for family in range(12):
        template = [f"<p>{family} {i}" for i in range(30)]
        rows += [(family * 10 + k, "g", "<header>\n" + "\n".join(x for x in template if rng.random() < rng.choice([0.5, 0.8, 0.95])) + f"\nown {family} {k}") for k in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, grp string, html string")
    found = [{(r.a, r.b): r.similarity for r in page_audit.template_similarity(frame, "grp", bands=bands).collect()} for bands in (0, 32)]
    assert set(found[1].items()) <= set(found[0].items()) and len(found[1]) >= 0.9 * len(found[0]) > 50
    met = page_audit.alike_candidates(page_audit.page_lines(frame, "grp"), "grp").count()
    assert met < 0.5 * len(rows) * (len(rows) - 1) / 2


def test_rule_texts(spark):
    """Every rule that makes findings has its texts; what has none keeps its row."""
    from searchlight.operators import advice

    issues = ["404 Not Found", "503 Server Error", "Backend URL Crawled: wp-admin", "Sensitive File: a: b", "robots.txt Returning Error", "no such rule", None, "404 Not Found"]
    rows = advice.with_rule_texts(spark.createDataFrame([(i, x) for i, x in enumerate(issues)], "n int, issue string"), advice.rule_texts(spark)).orderBy("n").collect()
    assert [r.owner for r in rows] == ["SEO", "Engineering", "Engineering", "Security", "Engineering", None, None, "SEO"]
    assert len({r[0] for r in advice.RULES}) == len(advice.RULES) and all(all(r) for r in advice.RULES)


def test_saved_sources_keep_what_no_escaping_wrote(spark):
    """Only references with a semicolon come from escaping; the page's own stay as they stood."""
    source = "<!DOCTYPE html><title>a &amp; b &#65;&#x42; &amp &notit; &nope; &&&amp</title>" + "<p>x</p>" * 20
    files = spark.createDataFrame([("/d/a.example.html", source.replace("&amp;", "&amp;amp;").replace("<", "&lt;").replace(">", "&gt;"))], "file string, content string")
    assert exports.read_page_snapshots(files).first().html == source.replace("&#65;&#x42;", "AB")


def against_sql(spark, folder, name, **tables):
    """The rows of a query over small tables, and those of its SQL."""
    with duckdb.connect() as c:
        for table, frame in tables.items():
            frame.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        frame = catalog.QUERIES[name](spark, str(folder))
        want = c.execute(f"SELECT {', '.join(frame.columns)} FROM ({catalog.ORACLE_SQL[name]}) x").fetchall()
    return sorted(map(tuple, frame.collect()), key=str), sorted(want, key=str)


def test_signals_keep_references_as_the_sql_does(spark, tmp_path):
    texts = ["a &amp; b", "&&&amp", "t = &quot;x", "&amp;amp; &lt;", "& &# &#65; &x"]
    html = "<html><head><title>{0}</title></head><body><h1>{0}</h1><a href=\"/l\">l</a></body></html>"
    frame = spark.createDataFrame([(i, "u", html.format(t)) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got, want = against_sql(spark, tmp_path, "page_signals", pages=frame)
    assert got == want and [r[1] for r in got] == ["a & b", "&&&amp", "t = &quot;x", "&amp; &lt;", "& &# &#65; &x"]


def shared_urls(spark):
    """Pages of which many have the URL of others, or none."""
    return spark.createDataFrame([(i, None if i % 7 == 6 else f"https://h.example/{i % 4}", "x") for i in range(150)], "page_id long, url string, html string")


def test_task_states_of_pages_that_share_a_url(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "task_regression", pages=shared_urls(spark))
    assert got == want and len(got) > len({r[:2] for r in got})
    log = spark.createDataFrame([("u", "i", "done", 1), ("u", "i", "open", 2), (None, "i", "done", 1), ("v", "i", "done", 3)], "url string, issue string, status string, ts int")
    found = spark.createDataFrame([("u", "i"), (None, "i"), (None, "i"), ("w", "i")], "url string, issue string")
    assert {tuple(r) for r in routing.latest_task_state(found, log).collect()} == {("u", "i", "open"), (None, "i", "regressed"), ("v", "i", "done"), ("w", "i", "open")}


def test_weights_of_pages_that_share_a_url(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "priority_weighting", pages=shared_urls(spark))
    assert got == want and len(got) == 150
    found = spark.createDataFrame([("u", "i", "P1 - x"), ("v", "i", "P2 - x"), (None, "i", "P3 - x")], "url string, issue string, urgency string")
    traffic = spark.createDataFrame([("u", 4, 30.0), ("u", 3, 15.0), (None, 5, 1.0)], "url string, clicks long, position double")
    assert sorted(map(tuple, page_checks.priority_weighting(found, traffic).collect()), key=str) == [("u", "i", 42), ("v", "i", 2), (None, "i", 5)]


@pytest.mark.parametrize("name", ["pair_verdict", "evidence_rows", "action_plan", "plan_summary"])
def test_verdicts_read_the_tables_once(spark, name):
    """The matrix and the evidence are tables of their own by then; a plan that made them anew for each use was too large for the driver."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and plan.count("\n") < 250


def test_templates_on_many_pages_move_no_pairs(spark, monkeypatch):
    """Where all pages of a group share lines they are compared in blocks; the pairs are those of a plain comparison, whatever the blocks' size."""
    rng = random.Random(5)
    lines = {i: {"<head>", "same", *(f"l{rng.randrange(12)}" for _ in range(rng.randrange(8))), *([f"own {i}"] * (i % 3 > 0))} for i in range(160)}
    lines |= {200 + i: {f"x{i // 2}", f"y{i // 2}", f"z{i}"} for i in range(40)}
    rows = [(i, None if i == 7 else "dense" if i < 200 else "sparse", "\n".join(sorted(x))) for i, x in lines.items()] + [(500, "dense", None), (501, "dense", "")]
    frame = spark.createDataFrame(rows, "page_id long, grp string, html string")
    want = {}
    for least in (0.5, 0.85):
        same = [(a, b) for a in lines for b in lines if a < b and 7 not in (a, b) and (a < 200) == (b < 200)]
        want[least] = {(a, b): (c := len(lines[a] & lines[b]), round(2 * c / (len(lines[a]) + len(lines[b])), 9)) for a, b in same}
        want[least] = {k: v for k, v in want[least].items() if v[1] > least}
    for most in (1024, 23):
        monkeypatch.setattr(page_audit, "BLOCK_PAGES", most)
        for least, bands in ((0.5, 0), (0.85, 32)):
            found = page_audit.template_similarity(frame, "grp", least, bands=bands)
            got = {(r.a, r.b): (r.common, round(r.similarity, 9)) for r in found.collect()}
            assert got == want[least] and len(got) == found.count() > 20


def test_common_lines(monkeypatch):
    rng = random.Random(6)
    pages_of = lambda n, m: [rng.sample(range(m), rng.randrange(min(m, 12))) for _ in range(n)]
    side = lambda p: (np.repeat(np.arange(len(p)), [len(x) for x in p]), np.array([y for x in p for y in x], np.int64))
    for most, n, k, m in ((1 << 22, 70, 50, 15), (50, 70, 50, 200), (50, 1, 1, 1), (1 << 22, 40, 60, 40)):
        monkeypatch.setattr(page_audit, "MEETINGS", most)
        a, b = pages_of(n, m), pages_of(k, m)
        assert page_audit.common_lines(side(a), side(b), (n, k)).tolist() == [[len({*x} & {*y}) for y in b] for x in a]


def test_json_lines_are_parsed_once(spark):
    """One parse and one lookup a name in the whole plan, and the same fields from odd lines."""
    lines = ['{"uri":"/a","status":"200","time":" 2024-01-05 10:00:00 ","bytes":"0"}', '{"path":"/b","uri":"0","sc-status":404,"timestamp":"2024-01-05T10:00:00+02:00","EdgeResponseBytes":7}', '{"url":"/c","status":"x","sc-status":500}', '{"url":"/d","status":1.0,"time":"2024-01-05T10:00"}', "[1]", '{"url":', "", None]
    frame = logs.parse_json_logs(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string"))
    got = [(r.n, r.ok, r.url, r.status, r.bytes, r.ts and r.ts.hour) for r in frame.orderBy("n").collect()]
    assert frame.columns == ["n", "ok", *logs.FIELDS]
    assert got == [(0, True, "/a", 200, 0, 10), (1, True, "/b", 404, 7, 8), (2, False, None, None, None, None), (3, True, "/d", 1, 0, None), *[(n, False, None, None, None, None) for n in range(4, 8)]]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 2 and plan.count("sc-status") == 1
