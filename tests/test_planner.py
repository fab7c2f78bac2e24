"""The planner's batch loop, stored vectors and probes: resuming, odd rows and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablemill.operators import planner, probes, retrieve
from tablemill.sources import matrices


def model_of(answers):
    def load():
        return lambda prompts, temperature: [answers[p][temperature > 0] for p in prompts]

    return load


def test_attempts_resume_from_the_log(spark, tmp_path):
    good, bad = "```\ndf1.a.sum()\n```", "df1.a * 98765"
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "a")], "id int, prompt string")
    answers = {"a": (good, bad), "b": (bad, good), "c": (bad, bad)}
    log = str(tmp_path / "log")
    # no time for a second attempt, then a call that goes on
    first = planner.plan(asked, model_of(answers), log, temperatures=(0.0,))
    assert sorted((r["id"], r["attempt"], r["ok"]) for r in first.collect()) == [(1, 0, True), (2, 0, False), (3, 0, False)]
    got = {r["id"]: r for r in planner.plan(asked, model_of(answers), log).collect()}
    assert {k: (r["attempt"], r["ok"]) for k, r in got.items()} == {1: (0, True), 2: (1, True), 3: (2, False)}
    assert got[2]["code"] == "df1.a.sum()" and "98765" in got[3]["reason"]
    # each attempt is in the log once, as it was answered
    assert sorted(map(tuple, spark.read.parquet(log).select("id", "attempt").collect())) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    planner.plan(asked, model_of({}), log)  # nothing is left to ask
    assert planner.plan(asked, model_of(answers), str(tmp_path / "other"), seconds=-1).count() == 0
    assert planner.plan(asked.limit(0), model_of(answers), str(tmp_path / "none")).count() == 0


def test_scope(spark):
    with pytest.raises(ValueError):
        planner.in_scope(F.col("a"), F.col("b"), F.col("c"), "some")
    row = spark.range(1).select(planner.in_scope(F.array(F.lit("COUNT")), F.lit(None), F.lit(None).cast("int"), "hard").alias("h"), planner.in_scope(F.array(F.lit("")), F.lit("vnd"), F.lit(1)).alias("a")).first()
    assert row["h"] and row["a"]


def test_vectors_without_a_model_are_judged_by_shape(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<float>")
    bare = str(tmp_path / "bare")
    rows.write.parquet(bare)
    assert matrices.usable(spark, bare, "any", 2, 2) and not matrices.usable(spark, bare, "any", 2, 3)
    path = str(tmp_path / "own")
    again = []
    for model in ("a", "a", "b"):
        assert matrices.load(spark, path, model, 2, 2, lambda: again.append(1) or rows).count() == 2
    assert len(again) == 2  # stored once, reused, and made anew for the other model
    mixed = str(tmp_path / "mixed")
    matrices.save(spark.createDataFrame([(1, [1.0]), (2, [0.0, 1.0])], "id long, vec array<float>"), mixed, "a")
    assert not matrices.usable(spark, mixed, "a", 2, 2)


def test_probes(spark):
    hits = spark.createDataFrame([(7, 0, "D", 1, 5, None, 9), (7, 1, "D", 2, 5, None, 8), (7, 2, "D", 3, 6, 1, 7)], "qid int, rank int, doc_id string, table_idx int, line_no int, page_no int, char_start int")
    one = {r["tag"]: r["refs"] for r in probes.probe(hits).collect()}
    assert one == {"probe1_all_folder": ["D|1", "D|5", "D|9"], "probe2_all_stem": ["D_extracted|1", "D_extracted|5", "D_extracted|9"]}
    two = {r["tag"]: r["refs"] for r in probes.probe(hits, 2).collect()}
    assert two == {"probe_table_idx": ["D|1", "D|2"], "probe_line_no": ["D|5"], "probe_char_start": ["D|9", "D|8"]}
    assert probes.probe(hits.limit(0)).count() == 0
    with pytest.raises(ValueError):
        probes.matrix(3)


def test_top_scores(spark):
    rows = spark.createDataFrame([(1, 10, 0, 1.0), (1, 11, 1, 9.0), (2, 10, 0, 3.0)], "qid int, id int, rank int, rerank_score double")
    assert tuple(retrieve.top_scores(rows).first()) == (2, pytest.approx(1.2), 2.0)
    assert tuple(retrieve.top_scores(rows.limit(0)).first()) == (0, None, None)
