"""Exact vector search and model hooks: embeddings are columns, a search is a join of stated queries with all rows in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.vectors import truncate

from .retrieve import rank_from, rerank_scores, top_k


def embed(df: DataFrame, text: str, model: Callable[[], Callable[[pd.Series], list]], dims: int | None = None, out: str = "embedding") -> DataFrame:
    """Embeds a text column by a hook that loads its model once a worker; cut to `dims`, then normalised."""

    def run(batches):
        encode = model()
        for texts in batches:
            yield pd.Series(list(encode(texts)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    df = df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))
    return df.withColumn(out, truncate(F.col(out), dims)) if dims else df


def with_instruction(question: Column, instruction: str) -> Column:
    """A question as an instruction-tuned encoder wants it; passages go without. The question itself, not its folded search terms."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), question)


def save_clustered(rows: DataFrame, path: str, key: str = "key") -> None:
    """Vectors in order of their key, so that a search for some keys reads their row groups only."""
    rows.repartitionByRange(key, "id").sortWithinPartitions(key, "id").write.mode("overwrite").option("compression", "zstd").parquet(path)


class Heaps:
    """The k best (score, id) of each of n queries, best first; ties by the lesser id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (queries `which` x rows) of the rows `ids`; minus infinity is no offer. Rows that enter no heap are left out before any are ordered."""
        enters = (score > self.score[which, -1:]) | ((score == self.score[which, -1:]) & (ids < self.id[which, -1:]) & (score > -np.inf))
        some = np.flatnonzero(enters.any(axis=0))
        if not len(some):
            return
        both = np.concatenate([self.score[which], np.where(enters, score, -np.inf)[:, some]], axis=1)
        names = np.concatenate([self.id[which], np.broadcast_to(ids[some], (len(which), len(some)))], axis=1)
        names = np.where(both == -np.inf, np.iinfo(np.int64).max, names)
        order = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.score[which], self.id[which] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def rows(self, qids: np.ndarray) -> pd.DataFrame:
        held = self.score > -np.inf
        return pd.DataFrame({"qid": np.repeat(qids, held.sum(axis=1)), "id": self.id[held], "score": self.score[held]})


def search(rows: DataFrame, queries: DataFrame, k: int, same: bool = True) -> DataFrame:
    """(qid, id, score, rank): the k nearest rows (id, vec) of each query (qid, qvec), by inner product to six digits; ties by id.

    With a column `key` in rows and `keys` (an array) in queries, a query meets the rows of its keys only; one without keys meets all. If every query
    has keys, the rows' scan is filtered by them. same: whether a row may be its own query's hit.

    Queries are a stated set, broadcast; more than MAX_QUERIES are refused. A task keeps one heap a query over all of its rows, so k rows a query leave it at
    most. Products are made for some CELLS of rows and queries at once.
    """
    keyed = "key" in rows.columns and "keys" in queries.columns
    stated = queries.select("qid", "qvec", *(["keys"] if keyed else [])).limit(MAX_QUERIES + 1).collect()
    if len(stated) > MAX_QUERIES:
        raise ValueError(f"a search takes {MAX_QUERIES} queries at most; split them")
    qids, q = np.array([r[0] for r in stated], np.int64), np.array([r[1] for r in stated], np.float64)
    by_key: dict[object, list[int]] = {}
    free = []
    for j, r in enumerate(stated):
        own = set(r[2] or ()) if keyed else set()
        for x in own:
            by_key.setdefault(x, []).append(j)
        if not own:
            free.append(j)
    if keyed and not free:
        rows = rows.where(F.col("key").isin(list(by_key)))
    groups = {x: np.array(sorted({*js, *free}), np.int64) for x, js in by_key.items()}
    shared = rows.sparkSession.sparkContext.broadcast((qids, q, groups, np.array(free, np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q, groups, free = shared.value
        heaps = Heaps(len(qids), k)
        for b in batches:
            if not len(b) or not len(qids):
                continue
            for key, part in b.groupby("key", dropna=False, sort=False) if keyed else [(None, b)]:
                which = groups.get(key, free)
                step = max(1, CELLS // max(len(which), 1))
                for at in range(0, len(part) if len(which) else 0, step):
                    some = part.iloc[at : at + step]
                    ids = some["id"].to_numpy(np.int64)
                    score = np.round(q[which] @ np.stack(some["vec"].to_numpy()).astype(np.float64).T, 6) + 0.0
                    if not same:
                        score[qids[which][:, None] == ids] = -np.inf
                    heaps.offer(which, score, ids)
        if len(qids):
            yield heaps.rows(qids)

    cols = ["id", "vec", *(["key"] if keyed else [])]
    found = rows.where("vec is not null").select(*cols).mapInPandas(run, "qid long, id long, score double")
    best = top_k(found, k, [F.desc("score"), F.col("id")], "qid")
    return best.withColumn("rank", rank_from([F.desc("score"), F.col("id")], "qid"))


def dense_stage(rows: DataFrame, queries: DataFrame, model: Callable[[], Callable[[pd.Series, pd.Series], list]], dense: int = 50, keep: int = 10) -> DataFrame:
    """(qid, id, rank, rerank_score, dense_rank, dense_score): the `dense` nearest rows of a query's keys, reranked by a model of (query, passage), the best `keep`.

    rows: (id, vec, key, passage); queries: (qid, qvec, keys, query). Passages are joined to the candidates only.
    """
    near = search(rows, queries, dense).withColumnsRenamed({"score": "dense_score", "rank": "dense_rank"})
    pairs = near.join(rows.select("id", "passage"), "id").join(queries.select("qid", "query"), "qid")
    order = [F.desc("rerank_score"), F.col("dense_rank")]
    best = top_k(rerank_scores(pairs, model), keep, order, "qid")
    return best.withColumn("rank", rank_from(order, "qid")).select("qid", "id", "rank", "rerank_score", "dense_rank", "dense_score")


#: Stated queries that one search takes, and products that are made at once.
MAX_QUERIES, CELLS = 20_000, 1 << 21
