"""Texts of the event matrix, panels, and documents without a declared schema."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import documents
from tidemark.operators import reports


def day(n):
    return dt.date(2024, 1, n)


def test_event_matrix(spark):
    schema = "d date, scope string, metric string, window_scope string, layer string, severity int, confidence double, explanation string, resonance_key string, lag_days int"
    rows = [
        (day(1), "MACRO", "vix", "1D", "single", 2, 0.29, "vix beyond its bound: 31.00", "", 0), (day(1), "SPY", "ivr_pct", "252D", "single", 3, 0.5, "low", "", 2),
        (day(1), None, "RESONANCE", "multi", "resonance", 3, 0.98, "theme: 4/5 conditions [a, b]", "theme", 0), (day(1), "MACRO", "move", "1D", "single", 1, 1.0, "move", "", None), (day(3), "MACRO", "vix", "1D", "single", 1, 0.5, "no day asks for it", "", 0),
    ]
    days = spark.createDataFrame([(day(1),), (day(2),), (day(2),)], "d date")
    got = {r.d.day: (r.events, r.text.split("\n")) for r in reports.event_matrix(spark.createDataFrame(rows, schema), days).collect()}
    assert got[2] == (0, ["no notable anomaly"]) and set(got) == {1, 2}
    assert got[1] == (4, [
        "🔴 [resonance|multi] theme: 4/5 conditions [a, b] (severity 3/3, confidence 98%)", "🔴 [single|252D] [SPY] low (severity 3/3, confidence 50%, 2 sessions late)",
        "🟠 [single|1D] vix beyond its bound: 31.00 (severity 2/3, confidence 28%)", "🟡 [single|1D] move (severity 1/3, confidence 100%)",
    ])


def test_ticker_details(spark):
    schema = "ticker string, d date, reference double, source string, price double, prev_close double, poc double, dpsv int, ivr double, flip double, charm double"
    rows = [("A", day(1), 1234.5, "mid", 9.0, 0.0, 10.005, 41, None, 8.0, -2.5), ("B", day(1), None, None, 9.0, 8.0, None, 0, 12.5, 0.0, None), ("C", day(1), *[None] * 9)]
    got = {r.ticker: r.text for r in reports.ticker_details(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"A": f"[A]: reference $1234.50 (mid) | cost core ${10.005:.2f} | short volume 41% | gamma flip $8.00 | charm -2.5M", "B": "[B]: reference $9.00 (price) | previous close $8.00 | volatility rank 12.5%", "C": "[C]: "}


def test_environment_panels(spark):
    scores = spark.createDataFrame([(day(1), "a", 1.0, 0.9), (day(1), "b", 2.0, 0.1), (day(2), "b", 3.0, 1.0)], "d date, index string, score double, coverage double")
    composite = spark.createDataFrame([(day(1), 1.0)], "d date, composite double")
    assert sorted(map(tuple, reports.environment_panels(scores, composite, ["a", "b", "c"]).collect())) == [(day(1), 1.0, 2.0, None, 1.0), (day(2), None, 3.0, None, None)]


def test_documents_drift(spark):
    texts = [(1, '{"a": 1, "b": {"x": "2024-01-05T00:00"}, "c": "7.5"}'), (2, '{"a": "two", "b": null, "d": [1]}'), (3, "[1]"), (4, "{broken"), (5, None), (6, "{}"), (7, '{"a": 2.5, "b": {"x": "soon", "y": "2024-01-03"}, "e": true}')]
    rows = spark.createDataFrame([(i, t, 9.0) for i, t in texts], "i int, text string, c double").select("i", "c", F.lit(1.0).alias("m"), documents.document(F.col("text")).alias("doc"))
    got = {r.i: r for r in documents.expanded(rows, "doc", {"a": "$.a", "c": "$.c", "deep": "$.b.x.z"}).select("i", "a", "c", "deep", F.col("doc").isNull().alias("none")).collect()}
    assert {i: (r.a, r.c, r.deep) for i, r in got.items()} == {1: (1.0, 7.5, None), 2: (None, 9.0, None), 3: (None, 9.0, None), 4: (None, 9.0, None), 5: (None, 9.0, None), 6: (None, 9.0, None), 7: (2.5, 9.0, None)}
    assert {i for i, r in got.items() if r.none} == {3, 4, 5}
    dated = documents.source_dated(rows, "doc", "b", {"c": "x", "m": "y", "absent": "x"}, {"m2": ["c", "m"], "i": ["c", "m"]}).drop("doc")
    assert dated.columns == ["i", "c", "m", "c_source_date", "m_source_date", "i_source_date"]
    assert {r.i: (r.c_source_date and r.c_source_date.day, r.m_source_date and r.m_source_date.day, r.i_source_date and r.i_source_date.day) for r in dated.collect() if r.i in (1, 2, 7)} == {1: (5, None, 5), 2: (None, None, None), 7: (None, 3, 3)}
    kinds = {(r.field, r.kind): (r.n, r.low, r.high) for r in documents.fields(rows.where("doc is not null"), "doc", []).collect()}
    assert kinds == {("a", "number"): (2, 1.0, 2.5), ("a", "text"): (1, None, None), ("b", "object"): (2, None, None), ("b", "null"): (1, None, None), ("c", "text"): (1, None, None), ("d", "list"): (1, None, None), ("e", "boolean"): (1, None, None)}
