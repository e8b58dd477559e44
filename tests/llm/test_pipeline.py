"""The corpus pipeline against its operators' brute-force versions."""

import corpus_pipeline
from test_operators import ALNUM, brute_components, frame, lower, odd_texts

from tidemark.llm import quality_classifier
from tidemark.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    network = quality_classifier.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    good = {r.doc_id for r in quality_classifier.score_quality(docs, network).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    kept = {k for k, _, component in brute_components(rows) if k == component}
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(ALNUM.findall(lower(t)))
    items = [grams(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {k for k, t in rows if k in kept and not any(4 * len(grams(t) & i) >= 3 * len(i) for i in items)}
    got = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in got} == clean and len(got) == len(clean) and all(r.round_trip for r in got)


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns


def test_odd_rows_and_empty_tables(spark, data, tmp_path):
    """Nulls, blanks, long and repeated rows and columns of any name pass all stages; empty tables give nothing."""
    rows = [*odd_texts(), *odd_texts()[:12]]
    frame(spark, rows).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    frame(spark, []).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    for folder in ("a", "b"):
        for name in ("labels", "benchmark"):
            table = spark.read.parquet(f"{data}/{name}.parquet")
            (table if folder == "a" else table.limit(0)).write.parquet(str(tmp_path / folder / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "a" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path / "a"))
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert {r.doc_id for r in got} <= {k for k, _ in rows}
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_names():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLE_SQL) <= set(QUERIES)
