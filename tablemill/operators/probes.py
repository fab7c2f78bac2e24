"""The probe matrix: what each way of encoding references would submit, for all of them in one pass over the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import emit

# Tag, position ("all": every encoding), document scheme and tables a question of the first stage's probes.
FIRST = (("probe1_all_folder", "all", "folder", 1), ("probe2_all_stem", "all", "file_stem", 1))
# Fixed value: tables a question of the second stage, one probe a position.
SECOND_TABLES = 2


def matrix(stage: int = 1, scheme: str = "folder") -> tuple[tuple[str, str, str, int], ...]:
    """The probes of a stage; the second takes the document scheme that the first one found."""
    if stage not in (1, 2):
        raise ValueError(f"there is no stage {stage}")
    return FIRST if stage == 1 else tuple((f"probe_{p}", p, scheme, SECOND_TABLES) for p in emit.POSITIONS)


def probe(hits: DataFrame, stage: int = 1, scheme: str = "folder") -> DataFrame:
    """(tag, qid, refs) of hits (qid, rank from 0, doc_id and the positions): distinct references by rank, as each probe submits them.

    A table without a position gives that encoding no reference; a question whose tables give none has no row.
    """
    rows = []
    for tag, position, docs, k in matrix(stage, scheme):
        refs = emit.table_refs(docs) if position == "all" else F.array_compact(F.array(emit.table_ref(position, docs)))
        rows.append(F.when(F.col("rank") < k, F.struct(F.lit(tag).alias("tag"), refs.alias("refs"))))
    most = max(k for *_, k in matrix(stage, scheme))
    each = hits.where(F.col("rank") < most).select("qid", "rank", F.explode(F.array_compact(F.array(*rows))).alias("p")).where(F.size("p.refs") > 0)
    own = F.sort_array(F.collect_list(F.struct("rank", "p.refs")))  # at most SECOND_TABLES entries
    return each.groupBy("p.tag", "qid").agg(F.array_distinct(F.flatten(F.transform(own, lambda x: x["refs"]))).alias("refs"))
