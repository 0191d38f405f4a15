"""Dense and fused retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import broadcast_checked, written


def _blocks(df: DataFrame, id_col: str, vector_col: str, rows: int) -> DataFrame:
    """Vectors of unit length packed into rows ``(ids, data)`` of at most ``rows`` vectors."""
    kind = df.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                v = np.array(part.column(1).to_pylist(), dtype=np.float64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)), pa.array([v.tobytes()], pa.binary())], names=["ids", "data"])

    found = df.filter(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    return found.mapInArrow(pack, f"ids array<{kind}>, data binary")


def dense_topk(queries: DataFrame, points: DataFrame, k: int, digits: int = 6, block: int = 1024) -> DataFrame:
    """``(q, id, score, rank)``: the ``k`` points of the largest cosine for each query ``(q, embedding)``, exactly.

    Queries and points ``(id, embedding)`` meet in blocks, each block of points gives its best ``k``
    for each query of a block, and these are ranked. Ties go by id. The queries are broadcast only if
    a count shows few blocks; vectors that are null are passed over, zero vectors have no cosine."""
    kinds = (queries.schema["q"].dataType.simpleString(), points.schema["id"].dataType.simpleString())
    asked = broadcast_checked(written(_blocks(queries, "q", "embedding", block).toDF("q_ids", "q_data"), "queries"), 64)
    pairs = _blocks(points, "id", "embedding", block).crossJoin(asked)  # of blocks, not of rows

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, data, q_ids, q_data = (batch.column(c)[row].as_py() for c in range(4))
                p, q = np.frombuffer(data).reshape(len(ids), -1), np.frombuffer(q_data).reshape(len(q_ids), -1)
                scores, ids = np.round(q @ p.T, digits), np.array(ids)
                for who, s in zip(q_ids, scores):
                    at = np.flatnonzero(s >= (np.partition(s, -k)[-k] if k < len(s) else -np.inf))
                    at = at[np.lexsort((ids[at], -s[at]))][:k]
                    yield pa.RecordBatch.from_arrays([pa.array([who] * len(at), batch.schema.field(2).type.value_type), pa.array(ids[at], batch.schema.field(0).type.value_type), pa.array(s[at])], names=["q", "id", "score"])

    found = pairs.select("ids", "data", "q_ids", "q_data").mapInArrow(best, f"q {kinds[0]}, id {kinds[1]}, score double")
    return top_k(found, k)


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("q",)) -> DataFrame:
    """The k best rows of each query, ties by id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(channels: list[tuple[str, DataFrame]], quotas: list[int]) -> DataFrame:
    """``(q, id, score, channel, channel_no)``: each channel's best rows, by quota."""
    out = None
    for no, ((name, scores), k) in enumerate(zip(channels, quotas)):
        part = top_k(scores, k).select("q", "id", "score", F.lit(name).alias("channel"), F.lit(no).alias("channel_no"))
        out = part if out is None else out.unionByName(part)
    return out


def best_per_id(candidates: DataFrame) -> DataFrame:
    """A row for each id: its best score, of equal ones the one of the first channel."""
    order = Window.partitionBy("q", "id").orderBy(F.desc("score"), "channel_no")
    return candidates.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def overlap_score(query: Column, text: Column) -> Column:
    """The default reranker: the share of the query's distinct terms that the text has."""
    q, t = F.array_distinct(query), F.array_distinct(text)
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))


def payload_filter(df: DataFrame, wanted: dict) -> DataFrame:
    """All fields must match: one value is equality (containment in arrays), a list any of it."""
    kinds = dict(df.dtypes)
    for field, value in wanted.items():
        many = value if isinstance(value, list) else [value]
        if kinds[field].startswith("array"):
            df = df.filter(F.arrays_overlap(F.col(field), F.array(*map(F.lit, many))))
        else:
            df = df.filter(F.col(field).isin(many))
    return df


def upsert(old: DataFrame, new: DataFrame, key: str = "id", required: str | None = None) -> DataFrame:
    """Insert or replace by key; new rows that lack the required column are dropped."""
    new = new if required is None else new.filter(F.col(required).isNotNull())
    return old.join(new.select(key), key, "left_anti").unionByName(new)
