"""The pipeline's stages one after another against plain versions of each."""

from __future__ import annotations

import random

import corpus_pipeline
from tablemill.llm import quality, secrets
from tablemill.llm.queries import PATTERN, RANKS
from tests.llm import reference_versions as plain
from tests.llm.test_operators import check_layout, pieces_by_library


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            rows = [(d, t) for d, t in rows if not any(r.rejects(quality.Features((t or "").encode())) for r in quality.RULES)]
        elif name == "ngram_jaccard_join":
            root = plain.jaccard_components(rows, 5, 80)
            rows = [(d, t) for d, t in rows if root[d][1] == d or root[d][0] == 0]
        elif name == "substring_dedup":
            kept = {d: (removed, digest) for d, _, removed, digest in plain.repeats(rows, 35)}
            now = {r["doc_id"]: r["text"] for r in docs.collect()}
            for d, t in rows:
                removed, digest = kept[d]
                assert now[d] == t if not removed else plain.sha(now[d]) == digest
            rows = [(d, now[d]) for d, _ in rows]
        elif name == "secret_scans":
            s = secrets.Scanner(RANKS, PATTERN, 2.0)
            rows = [(d, secrets.redact(t, s.spans(t)[1], "[SECRET]")) for d, t in rows]
        else:
            assert sorted((tuple(r) for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr) == pieces_by_library(rows)
            check_layout([tuple(r) for r in docs.select("length", "sequence_id", "offset").collect()], 1024)
            continue
        assert docs.columns == columns
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(rows)
        assert docs.where("n_chars <> length(text)").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing names and an empty table: every stage keeps the columns, clean documents come through."""
    def prose(seed, n):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 3))) for _ in range(n))

    names = "doc_id long, text string, lang string, source string, n_chars long, _row long, __row_key long, runs int, `a.b` int"
    texts = [None, "", " \n", "short", prose(1, 200), prose(1, 200), prose(3, 30_000), prose(7, 300), "password = 'hunter22x' " + prose(9, 200)]
    rows = [(i, t, "en", None, None if t is None else len(t), i, None, 1, 2) for i, t in enumerate(texts)]
    rows += [rows[7], (None, prose(11, 150), None, "s", 1, None, None, None, None)]
    for part, n in ((rows, 1), ([], 0)):
        docs = spark.createDataFrame(part, names).repartition(3)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            path = str(tmp_path / f"{name}-{n}")
            out.write.parquet(path)
            before, docs = docs, spark.read.parquet(path)
            if name != "best_fit_packing":
                assert docs.columns == before.columns and docs.count() <= before.count()
            if n and name == "quality_rules":
                assert {r["doc_id"] for r in docs.collect()} >= {4, 5, 6, 7, None}
            if n and name == "ngram_jaccard_join":
                ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
                assert (False, 4) in ids and (False, 5) not in ids and ids.count((False, 7)) == 1 and (True, 0) in ids
            if n and name == "secret_scans":
                assert docs.where("text like '%hunter22x%'").count() == 0 and docs.where("doc_id = 8 and text like '%[SECRET]%'").count() == 1
        assert (docs.count() > 0) == bool(n)
