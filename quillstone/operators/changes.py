"""Change logs: (ts, txn, collection, type, id, payload), applied to tables and masked for readers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def state(log: DataFrame, id_col: str = "id", order: Sequence[str] = ("ts", "txn"), type_col: str = "type") -> DataFrame:
    """The table that a log of whole-row changes leaves: the last change of each id, unless it deletes."""
    rest = [c for c in log.columns if c != id_col]
    last = log.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(id_col, "_last.*")
    return last.where(F.col(type_col) != DELETE)


def apply(table: DataFrame, log: DataFrame, id_col: str = "id", order: Sequence[str] = ("ts", "txn"), type_col: str = "type") -> DataFrame:
    """table after the changes of the log, which has the table's columns besides its own."""
    touched = log.select(id_col).distinct()
    return table.join(touched, id_col, "left_anti").unionByName(state(log, id_col, order, type_col).select(*table.columns))


def log_of(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """The changes between two versions of a table: type and the columns of the newer row (the older one's for deletes)."""
    rest = [c for c in new.columns if c != id_col]
    a = old.select(F.col(id_col).alias("a_id"), F.struct(*rest).alias("was"))
    b = new.select(F.col(id_col).alias("b_id"), F.struct(*rest).alias("is"))
    both = a.join(b, F.col("a_id") == F.col("b_id"), "full").where(~F.col("was").eqNullSafe(F.col("is")))
    kind = F.when(F.col("a_id").isNull(), INSERT).when(F.col("b_id").isNull(), DELETE).otherwise(UPDATE)
    return both.select(kind.alias("type"), F.coalesce("b_id", "a_id").alias(id_col), F.coalesce("is", "was").alias("row")).select("type", id_col, "row.*")


@dataclass(frozen=True)
class Watch:
    """What a reader of changes sees. An allowlist wins over everything; else personal data is masked, then the blocklist applies."""

    payload: bool = True
    only: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    reveal: bool = False
    mask: str | None = "***"


def masked(df: DataFrame, personal: Sequence[str], watch: Watch, keep: Sequence[str] = ()) -> DataFrame:
    """df as `watch` shows it; names compare without case; `keep` are columns of the log itself, always shown."""
    always = {k.lower() for k in keep}

    def among(c: str, names: Sequence[str]) -> bool:
        return c.lower() in {n.lower() for n in names}

    fields = [c for c in df.columns if c.lower() not in always]
    if not watch.payload:
        return df.select(*keep)
    if watch.only is not None:
        return df.select(*keep, *(c for c in fields if among(c, watch.only)))
    out: list[Column | str] = list(keep)
    for c in fields:
        if among(c, watch.exclude):
            continue
        if not watch.reveal and among(c, personal):
            if watch.mask is not None:
                out.append(F.lit(watch.mask).alias(c))
        else:
            out.append(c)
    return df.select(*out)
