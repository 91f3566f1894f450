"""Queries against their planted cases."""

from folioframe.plans import operator_queries as Q


def test_spacing_examples_are_the_planted_ones(spark, tmp_path):
    spark.createDataFrame([(1, "ein eine dorf berg wald zaun")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.nth, r.example) for r in Q.spacing_examples(spark, str(tmp_path)).collect()}
    assert got == {(1, "glued: berg|dorf"), (2, "split: e|ine")}


def test_equal_images_are_made_once(spark, tmp_path, monkeypatch):
    made, plain = spark.sparkContext.accumulator(0), Q.tensors

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield from plain([b])

    monkeypatch.setattr(Q, "tensors", counted)
    spark.createDataFrame([(i * 30 * 17 * 127 + i % 2,) for i in range(40)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = Q.image_tensors(spark, str(tmp_path)).collect()
    assert len(got) == 40 and {r.p_partkey for r in got} == {i * 30 * 17 * 127 + i % 2 for i in range(40)} and made.value == 2


def test_spacing_marks_move_no_tokens(spark):
    from folioframe.operators import scoring

    p = spark.createDataFrame([("a", "informa tion theresult", "information the result"), ("b", "clean text", "clean text"), ("c", None, "x")], "file string, gen string, gt string")
    marks = scoring.spacing_marks(p)
    assert "Join" not in marks._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in scoring.spacing_errors(p).collect()} == {("a", 1, 1), ("b", 0, 0)}
    twice = spark.createDataFrame([("a", "informa tion", "x"), ("a", "x", "information")], "file string, gen string, gt string")
    assert [tuple(r) for r in scoring.spacing_errors(twice).collect()] == [("a", 1, 0)]
