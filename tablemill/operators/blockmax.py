"""Best documents by BM25 without scoring all: postings in blocks of documents, each with its largest weight.

A question's bound for a block is the sum of the block's largest weights of its terms. The blocks of highest bound are scored first; the k-th best
score there is one that no final hit falls below, so blocks whose bound is under it are never read. The rest are scored too, and all answers are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.session import store

from . import bm25

#: Documents of a block, and how many times k hits the blocks that are scored first hold.
BLOCK_DOCS, FIRST_SHARE = 256, 2
#: Entries of the lists that a task makes at once, or those of one block.
MADE_ENTRIES = 1 << 20
#: Sums in another order may differ in their last digits: a bound counts as this much more.
SLACK = 1 + 1e-9


@dataclass
class BlockIndex:
    """blocks: (term, block, top, n, entries array<struct<id, weight>>), weights without the term's idf; terms: (term, df, idf)."""

    blocks: DataFrame
    terms: DataFrame
    block_docs: int

    def save(self, path: str) -> None:
        """In order of terms, so that row groups of other terms are skipped."""
        self.blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks-{self.block_docs}")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def load(spark: SparkSession, path: str, block_docs: int = BLOCK_DOCS) -> BlockIndex:
        return BlockIndex(spark.read.parquet(f"{path}/blocks-{block_docs}"), spark.read.parquet(f"{path}/terms"), block_docs)


def build(index: bm25.Index, block_docs: int = BLOCK_DOCS) -> BlockIndex:
    """Blocks of neighbours by length: their weights for a term are alike, so a block's largest is close to all of them.

    Documents are numbered where they are sorted, without a global counter, and a block's lists are made where its documents lie: only documents are shuffled.
    """
    avg = index.totals.select("avg_len").first()
    kind = index.docs.schema["id"].dataType
    make = partial(_blocks, block_docs=block_docs, avg=avg[0] if avg else None)
    rows = index.docs.repartitionByRange("len", "id").sortWithinPartitions("len", "id").select("id", "len", "terms", "tfs")
    blocks = rows.mapInArrow(make, f"term string, block long, top double, n long, entries array<struct<id: {kind.simpleString()}, weight: double>>")
    return BlockIndex(store(blocks, "blocks"), store(index.terms, "terms"), block_docs)


def _blocks(batches: Iterator[pa.RecordBatch], block_docs: int, avg: float) -> Iterator[pa.RecordBatch]:
    """Lists of whole blocks from a task's documents in order; weights are without the term's idf. Of a few blocks at once, by term."""
    block, rest = TaskContext.get().partitionId() << 33, None
    for b in chain(batches, [None]):
        if rest is not None:
            b = rest if b is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            last = b is rest
        else:
            last = False
        if b is None:
            return
        whole = b.num_rows if last else b.num_rows // block_docs * block_docs
        longest = pc.max(b.column(2).value_lengths()).as_py() or 1
        step = block_docs * max(1, MADE_ENTRIES // (block_docs * longest))
        for at in range(0, whole, step):
            docs = b.slice(at, min(step, whole - at))
            yield _lists(docs, block, block_docs, avg)
            block += -(-docs.num_rows // block_docs)
        rest = b.slice(whole) if whole < b.num_rows else None


def _lists(docs: pa.RecordBatch, first: int, block_docs: int, avg: float) -> pa.RecordBatch:
    words = docs.column(2).flatten().dictionary_encode()
    names = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(names), np.int64)
    rank[names] = np.arange(len(names))
    doc = np.repeat(np.arange(docs.num_rows), docs.column(2).value_lengths().to_numpy(zero_copy_only=False))
    weight = bm25.term_weight(docs.column(3).flatten().to_numpy(zero_copy_only=False), docs.column(1).to_numpy(zero_copy_only=False)[doc], avg)
    blocks = -(-docs.num_rows // block_docs)
    key = rank[words.indices.to_numpy(zero_copy_only=False)] * blocks + doc // block_docs
    order = np.argsort(key, kind="stable")
    own, starts, n = np.unique(key[order], return_index=True, return_counts=True)
    entries = pa.StructArray.from_arrays([docs.column(0).take(pa.array(doc[order])), pa.array(weight[order])], ["id", "weight"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), entries)
    columns = [words.dictionary.take(pa.array(names[own // blocks])), pa.array(first + own % blocks), pa.array(np.maximum.reduceat(weight[order], starts)), pa.array(n), lists]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "top", "n", "entries"])


def search(index: BlockIndex, queries: DataFrame, k: int, text: str = "query") -> tuple[DataFrame, DataFrame]:
    """(qid, id, bm25) of each query's k best documents, ties to nine digits by id; and (qid, block, bound, read): which blocks were read.

    Documents without a term of the query are no hits; a query may have fewer than k. queries: (qid, query), a stated set.
    """
    from .retrieve import top_k

    best = [F.desc(F.round("bm25", 9)), F.col("id")]
    asked = store(bm25.query_terms(queries, text).join(index.terms.select("term", "idf"), "term").select("qid", "term", "idf"), "asked")
    askers = store(asked.groupBy("term", "idf").agg(F.collect_list("qid").alias("asked_by")), "askers")
    heads = index.blocks.select("term", "block", "top", "n")  # entries stay unread
    bounds = store(heads.join(asked, "term").groupBy("qid", "block").agg((F.sum(F.col("top") * F.col("idf")) * SLACK).alias("bound"), F.max("n").alias("hits")), "bounds")

    def scored(opened: DataFrame) -> DataFrame:
        wanted = opened.groupBy("block").agg(F.collect_list("qid").alias("qids"))  # a list of a block and term is read once for all of its queries
        lists = index.blocks.select("term", "block", "entries").join(askers, "term").join(wanted, "block").withColumn("qids", F.array_intersect("asked_by", "qids"))
        hits = lists.select("idf", "entries", F.explode("qids").alias("qid")).select("qid", "idf", F.explode("entries").alias("e"))
        return hits.groupBy("qid", F.col("e.id").alias("id")).agg(F.sum(F.col("e.weight") * F.col("idf")).alias("bm25"))

    # blocks of highest bound until they hold FIRST_SHARE * k hits; each holds one, so no more blocks than that are ordered
    order = [F.desc("bound"), F.col("block")]
    before = F.sum("hits").over(Window.partitionBy("qid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    first = store(top_k(bounds, FIRST_SHARE * k, order, "qid").withColumn("_before", before).where(F.coalesce("_before", F.lit(0)) < FIRST_SHARE * k).select("qid", "block"), "first")
    early = store(top_k(scored(first), k, best, "qid"), "early")
    least = early.groupBy("qid").agg(F.count("*").alias("n"), F.min("bm25").alias("least")).where(F.col("n") >= k).select("qid", "least")
    open_ones = bounds.join(least, "qid", "left").withColumn("can", F.coalesce(F.col("bound") >= F.col("least"), F.lit(True)))
    opened = open_ones.join(first.withColumn("read_first", F.lit(True)), ["qid", "block"], "left").withColumn("read_first", F.coalesce("read_first", F.lit(False)))
    opened = store(opened.select("qid", "block", "bound", "read_first", (F.col("read_first") | F.col("can")).alias("read")), "opened")
    late = scored(opened.where("read and not read_first"))
    return top_k(early.unionByName(late), k, best, "qid"), opened.select("qid", "block", "bound", "read")
