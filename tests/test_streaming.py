"""Documents that arrive in two batches give the marks of all of them, each once."""

from pageloom.operators.redact import Rule, literal_marks
from pageloom.sources.tables import document_files, table
from pageloom.streaming.arrivals import stream_marks


def test_arrivals(spark, small, tmp_path):
    docs = table(spark, small, "documents").select("doc_id", "text")
    rules = [Rule(1, "the"), Rule(2, "of the")]
    inbox = str(tmp_path / "in")
    for half in (docs.filter("doc_id < 100"), docs.filter("doc_id >= 100")):
        half.write.mode("append").parquet(inbox)
        stream_marks(spark, inbox, docs.schema, rules, str(tmp_path / "out"), str(tmp_path / "done")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, literal_marks(docs, rules).collect())) and got


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"junk %PDF-1.7 rest")
    (tmp_path / "b.pdf").write_bytes(b"no header" * 200 + b"%PDF-1.7")
    (tmp_path / "c.txt").write_bytes(b"%PDF-1.7")
    assert {r.path.rsplit("/", 1)[1]: r.has_header for r in document_files(spark, str(tmp_path)).collect()} == {"a.pdf": True, "b.pdf": False}
