"""Merging batches of writes into nodes and edges that are stored."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Store, Transaction
from ..storage import written
from .graph import last_write


@dataclass
class Kind:
    """A stored table: its keys, and the columns that each write overwrites (null too), that the last
    write with a value sets, and that only the first write sets. ``types`` is its schema."""

    name: str
    types: str
    keys: list[str]
    overwrite: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    first: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.overwrite, *self.keep, *self.first]


def merge(tx: Transaction, kind: Kind, batch: DataFrame, order: list[str]) -> list[int]:
    """Merge a batch, whose writes come in ``order``, into the stored table; gives the buckets that it touches.

    A key that is not stored is created, one that is gets what the kind's columns say. Only the buckets
    in which the batch has keys are read and written. A null key is an error, and leaves the table
    as it was; an empty batch changes nothing. Rows that repeat a key count in their order."""
    folded = last_write(batch, kind.keys, order, kind.overwrite, kind.keep, kind.first)
    bad = F.raise_error(F.concat(F.lit(f"a null key of {kind.name}: "), F.to_json(F.struct(*kind.keys))))
    some = " OR ".join(f"{k} IS NULL" for k in kind.keys)
    folded = folded.withColumn(kind.keys[0], F.when(F.expr(some), bad.cast(dict(folded.dtypes)[kind.keys[0]])).otherwise(F.col(kind.keys[0])))
    folded = written(folded.select(*kind.columns), "batch")
    only = tx.touched(kind.keys, folded)
    if not only:
        return only
    old = tx.read(kind.name, kind.types, only).select(*kind.columns, F.lit(0).alias("_age"))
    both = old.unionByName(folded.withColumn("_age", F.lit(1)))
    tx.write(kind.name, last_write(both, kind.keys, ["_age"], kind.overwrite, kind.keep, kind.first).select(*kind.columns), kind.keys, only)
    return only


def merge_graph(store: Store, batches: list[tuple[Kind, DataFrame, list[str]]]) -> dict[str, list[int]]:
    """Merge batches of several kinds (nodes and their edges, say) in one commit; gives the touched buckets by table."""
    return store.run(lambda tx: {kind.name: merge(tx, kind, batch, order) for kind, batch, order in batches})
