"""Paged feeds and polled bars against a loopback server that fails at times."""

import datetime as dt
import json
import re
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.sources import live


class Server:
    """Answers by path; keeps what was asked. ``fails`` holds, by path, codes to be answered first."""

    def __init__(self):
        self.asked, self.fails, self.answers, lock = [], {}, {}, threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(handler):  # noqa: N802, N805
                path, query = urlparse(handler.path).path, {k: v[0] for k, v in parse_qs(urlparse(handler.path).query).items()}
                with lock:
                    self.asked.append((path, query))
                    key = (path, query.get("page"))
                    code = self.fails[key].pop(0) if self.fails.get(key) else 200
                handler.send_response(code)
                if code == 429:
                    handler.send_header("Retry-After", "0")
                handler.end_headers()
                if code == 200:
                    handler.wfile.write(json.dumps(self.answers[path](query)).encode())

            def log_message(handler, *args):  # noqa: N805
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


DAYS = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(250)]


def balances(query):
    """Twenty a page, thirteen pages; every tenth closing balance is missing."""
    size, page = 20, int(query["page"])
    held = [d for d in DAYS if query["since"] <= d.isoformat() <= query["until"]]
    rows = [{"record_date": d.isoformat(), "close": "null" if d.day % 10 == 0 else f"{1000 + d.day:,}", "open": str(d.day)} for d in held[size * (page - 1) : size * page]]
    return {"data": rows, "meta": {"total-pages": max(1, -(-len(held) // size))}}


def test_pages_are_spread_and_asked_for_again(spark, server):
    server.answers["/tga"] = balances
    server.fails = {("/tga", "2"): [503, 429], ("/tga", "13"): [500]}
    feed = live.Feed("tga", server.url + "/tga?page={page}&since={since}&until={until}", "data", {"balance": ["close", "open"]}, "record_date", scale=0.5, pages="meta.total-pages", limit=20)
    rows = live.observations(spark, [feed], status=True)
    assert rows.rdd.getNumPartitions() == 2
    server.asked.clear()
    server.fails = {("/tga", "2"): [503, 429], ("/tga", "13"): [500]}
    got = rows.collect()
    assert {r.d: r.value for r in got if r.d} == {d: (d.day if d.day % 10 == 0 else 1000 + d.day) * 0.5 for d in DAYS}
    assert sorted((r.status, r.attempts, r.value) for r in got if r.status) == [("ok", 4, 50.0), ("ok", 12, 200.0)]
    # The plan is made once and each page is asked for as often as it failed, and once more.
    pages = Counter(q["page"] for _, q in server.asked)
    assert pages["2"] == 3 and pages["13"] == 2 and pages["5"] == 1


def test_date_bounds_reach_the_requests(spark, server):
    server.answers["/tga"] = balances
    feed = live.Feed("tga", server.url + "/tga?page={page}&since={since}&until={until}", "data", {"balance": ["close", "open"]}, "record_date", pages="meta.total-pages", limit=20)
    rows = live.observations(spark, [feed]).where((F.col("d") >= F.lit("2024-03-01").cast("date")) & (F.col("d") < F.lit("2024-03-11").cast("date")) & (F.col("value") > 5))
    assert {r.d.isoformat() for r in rows.collect()} == {f"2024-03-{i:02d}" for i in range(1, 11)}
    assert {(q["since"], q["until"]) for _, q in server.asked} == {("2024-03-01", "2024-03-10")}
    bounded = live.observations(spark, [feed], "2024-02-01", "2024-02-03").where(F.col("d") > F.lit("2024-02-01").cast("date"))
    assert {r.d.day for r in bounded.collect()} == {2, 3}


def test_a_feed_that_fails_says_so_and_others_stay(spark, server):
    server.answers |= {"/tga": balances, "/short": lambda q: {"observations": [{"date": "2024-01-0" + q["offset"], "value": q["offset"]}] * (2 if q["offset"] == "0" else 1)}}
    tga = live.Feed("tga", server.url + "/tga?page={page}&since={since}&until={until}", "data", {"balance": ["close"]}, "record_date", pages="meta.total-pages", limit=20)
    server.fails = {("/tga", "3"): [404]}
    short = live.Feed("short", server.url + "/short?offset={offset}&limit={limit}", "observations", {"value": ["value"]}, limit=2)
    gone = live.Feed("gone", "http://127.0.0.1:1/x", "data", {"value": ["value"]})
    rows = live.observations(spark, [tga, short, gone], status=True)
    live_pause, live.PAUSE = live.PAUSE, 0.0
    try:
        got = rows.collect()
    finally:
        live.PAUSE = live_pause
    table = spark.createDataFrame(got, rows.schema)
    health = {r.source: r for r in live.health(table).collect()}
    assert {k: r.status for k, r in health.items()} == {"tga": "failed", "short": "ok", "gone": "failed"}
    assert "404" in health["tga"].error and health["gone"].attempts == live.TRIES and health["short"].error is None
    assert health["short"]["rows"] == 1  # 2024-01-00 is no date; the second page is short
    assert live.latest(table).where("source = 'tga'").count() > 80
    server.fails = {("/tga", "3"): [404]}
    with pytest.raises(Exception, match="404"):
        live.observations(spark, [tga]).collect()


def test_pages_on_disk(spark, tmp_path):
    for page, values in ((1, ["1", "2", "."]), (2, ["9", ".", "7"])):
        folder = tmp_path / f"page={page}"
        folder.mkdir()
        (folder / "part-0.json").write_text(json.dumps({"count": 6, "observations": [{"date": f"2024-01-0{2 + i}", "value": v} for i, v in enumerate(values)]}))
        (folder / "_SUCCESS").write_text("")
    feed = live.Feed("x", f"file://{tmp_path}/page={{page}}", "observations", {"value": ["value"]}, count="count", limit=3)
    assert {(r.d.day, r.value) for r in live.latest(live.observations(spark, [feed])).collect()} == {(2, 9.0), (4, 7.0)}  # the last of a date counts, even if it is none


def test_polled_bars_survive_restarts(spark, server, tmp_path):
    """Stopped and started again between batches, with failing requests: every bar once."""
    minutes, now = range(100, 400), {"minute": 100}
    bar = lambda symbol, m: {"minute": m, "open": m, "high": m + 1, "low": m - 1, "close": m + len(symbol), "volume": m}
    server.answers["/clock"] = lambda q: dict(now)
    server.answers["/bars"] = lambda q: {"bars": [bar(q["symbol"], m) for m in minutes if int(q["after"]) - 5 <= m <= int(q["upto"]) + 5 and m <= now["minute"]]}  # more than was asked for
    stream = live.bar_stream(spark, server.url + "/bars?symbol={symbol}&after={after}&upto={upto}", server.url + "/clock", ["SPY", "QQQ"], 99, 40)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    reached = lambda query: int((re.findall(r"\d+", str(query.lastProgress["sources"][0]["endOffset"])) or [0])[0]) if query.lastProgress else 0
    for until in (150, 151, 151, 270, 399):
        again = now["minute"] == until  # a start without anything new
        now["minute"] = until
        server.fails = {("/bars", None): [503]}
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(processingTime="200 milliseconds").start()
        try:
            deadline = dt.datetime.now() + dt.timedelta(seconds=60)
            while reached(query) < until and not again:
                assert dt.datetime.now() < deadline and query.exception() is None
                query.awaitTermination(0.2)
            query.awaitTermination(2 if again else 0.1)
        finally:
            query.stop()
    got = spark.read.schema(live.BARS).parquet(out).selectExpr("symbol", "unix_timestamp(ts) div 60 m", "close", "volume").collect()
    assert Counter((r.symbol, r.m) for r in got) == Counter((s, m) for s in ("SPY", "QQQ") for m in range(100, 400))
    assert all(r.close == r.m + 3 and r.volume == r.m for r in got)
    steps = [int(q["upto"]) - int(q["after"]) for p, q in server.asked if p == "/bars"]
    assert max(steps) <= 40
