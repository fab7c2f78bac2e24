"""What queries shuffle on a larger copy of the documents, their index built anew: far fewer records than its postings."""

from __future__ import annotations

import duckdb
import pytest

from tablemill import queries
from tests.test_queries import TABLES

COPIES = 8


@pytest.fixture(scope="module")
def grown(sf, tmp_path_factory):
    """The tables with COPIES times the documents; and their words, distinct in each document."""
    out = tmp_path_factory.mktemp("grown")
    c = duckdb.connect()
    for t in TABLES:
        copies = f"SELECT doc_id + 1000000 * k AS doc_id, d.* EXCLUDE (doc_id) FROM '{sf}/{t}.parquet' d, range({COPIES}) r(k)" if t == "documents" else f"SELECT * FROM '{sf}/{t}.parquet'"
        c.execute(f"COPY ({copies}) TO '{out}/{t}.parquet' (FORMAT PARQUET)")
    words = c.execute(f"SELECT sum(len(list_distinct({queries.TOKENS.format('text')}))) FROM '{out}/documents.parquet'").fetchone()[0]
    return str(out), words


def shuffled(spark) -> int:
    """Records that this application has written to shuffles."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name, share", [
    ("cover_idf_substring", 0.25),  # F1
    ("select_doc_coverage", 0.25),  # F2
    ("retrieve_tables", 0.25),  # F3
    ("block_max_top", 0.25),  # F4
    ("bm25_score_topk", 0.25),  # F5
    ("bm25_subset_maxnorm", 0.25),  # F6
    ("lexical_combined", 0.25),  # F7
    ("phrase_ngram", 0.25),  # F8
])
def test_shuffles_less_than_the_postings(spark, grown, name, share):
    path, words = grown
    queries._STORED.clear()  # with its index
    before = shuffled(spark)
    assert queries.QUERIES[name](spark, path).count() > 0
    moved = shuffled(spark) - before
    assert moved < share * words, (moved, words)
