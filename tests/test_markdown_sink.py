"""Files of Markdown: what was written is what is read, and no table is listed for it."""

import pytest

from folioframe.operators import sinks
from folioframe.plans.operator_queries import markdown_sink

TEXTS = [(1, "one line"), (2, "ends in a newline\n"), (3, "in two\n\n"), (4, ""), (5, "\n"), (-6, "a negative id\r\n"), (None, "no id"), (7, None), (8, "é …"), (9, "twice"), (9, "the same id")]


def test_texts_come_back_as_they_were(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.md) for r in markdown_sink(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((i, t) for i, t in TEXTS if t is not None), key=str)


def test_written_again_without_a_partition_for_each_document(spark, tmp_path, monkeypatch):
    docs = lambda *r: spark.createDataFrame(list(r), "doc_id string, md string")
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.partitionBy", lambda *_: pytest.fail("a partition for each document"))
    sinks.write_markdown(docs(*((f"a/{i}.pdf", f"old {i}") for i in range(40))), f"file://{tmp_path}")
    sinks.write_markdown(docs(("a/3.pdf", "new 3"), ("a/3.pdf", "more of 3")), str(tmp_path))
    texts = sorted(p.read_text() for p in tmp_path.glob("doc=*/*.txt"))
    assert texts == sorted([f"old {i}\n" for i in range(40) if i != 3] + ["new 3\n", "more of 3\n"])
    assert sorted(spark.read.text(str(tmp_path), wholetext=True).filter("doc like '3!_%' escape '!'").toPandas().value) == ["more of 3\n", "new 3\n"]
