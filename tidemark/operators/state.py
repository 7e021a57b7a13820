"""State: claims about one owner and dimension folded in order into clusters, with what supersedes what."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType

from .lineage import cut


def fold_changes(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters of claims (claim_id, value, at, keys): a value that differs from the one before opens a new cluster.

    Each cluster has its first and last claim, size and status: the last of its key is current, the others historical,
    superseded by the first claim of the next. Windows by key; no order over keys.
    """
    order = Window.partitionBy(*keys).orderBy("at", "claim_id")
    changed = claims.withColumn("new", (~F.col("value").eqNullSafe(F.lag("value").over(order)) | (F.row_number().over(order) == 1)).cast("int"))
    numbered = changed.withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("at", "claim_id")
    clusters = numbered.groupBy(*keys, "cluster").agg(F.min_by("claim_id", at).alias("first_claim"), F.max_by("claim_id", at).alias("primary_claim"), F.count(F.lit(1)).alias("n_claims"), F.first("value").alias("value"))
    by = Window.partitionBy(*keys).orderBy("cluster")
    after = F.lead("first_claim").over(by)
    return clusters.withColumn("superseded_by", after).withColumn("status", F.when(after.isNull(), "current").otherwise("historical"))


class _Key:
    """The clusters of one key that a coming claim may still touch; what is settled leaves at once."""

    def __init__(self, keys: list, dialog: str | None, most_active: int | None):
        self.keys, self.dialog, self.most_active = keys, dialog, most_active
        self.active: dict[int, dict] = {}  # by a number that is never used again
        self.number, self.over = 0, False

    def _row(self, c: dict, status: str) -> list:
        return [*self.keys, c["support"][-1], c["support"], status, c["by"], "; ".join(dict.fromkeys(c["errors"]))]

    def claim(self, claim_id, decided: list[dict], dialog) -> list[list]:
        """Take the next claim in order; rows of the clusters that it settles."""
        told = {d["existing"]: d for d in decided}
        if self.most_active is not None and len(self.active) > self.most_active:
            self.over = True
        seen = [(i, told[c["support"][-1]]) for i, c in self.active.items() if c["support"][-1] in told]
        ends = [(i, d["winner"]) for i, d in seen if d["decision"] in ("SUPERSEDES", "CORRECTS")]
        lost = [i for i, winner in ends if winner == "existing"]
        fit = [i for i, d in seen if d["decision"] == "COMPATIBLE"]
        errors = ["compatible and retired"] * bool(fit and lost)
        if self.dialog is not None and any(self.active[i]["dialog"] != dialog for i in lost):
            errors.append("contradicts chronology")
        by = self.active[lost[0]]["support"][-1] if lost else None
        settled = []
        for i in [i for i, winner in ends if winner == "incoming"]:
            gone = self.active.pop(i)
            gone["by"] = claim_id
            settled.append(self._row(gone, "historical"))
        for c in self.active.values():
            c["foes"] &= set(self.active)
        self.number += 1
        if fit:
            home = fit[0]
            mine = self.active[home]
            for i in fit[1:]:
                taken = self.active.pop(i)
                mine["support"] += taken["support"]
                mine["foes"] |= taken["foes"]
                mine["errors"] += taken["errors"]
            for i, c in self.active.items():  # who was at odds with a cluster taken in is so with its new home
                c["foes"] = {home if f in fit else f for f in c["foes"]} - {i}
            mine["support"].append(claim_id)
        else:
            home = self.number
            mine = {"support": [claim_id], "by": by, "foes": set(), "errors": []}
            if not lost:
                self.active[home] = mine
        mine["errors"] += errors
        mine["dialog"] = dialog
        for i, d in seen:
            if d["decision"] == "CONFLICTS_WITH" and i != home and i in self.active and home in self.active:
                mine["foes"].add(i)
                self.active[i]["foes"].add(home)
        if lost and not fit:
            settled.append(self._row(mine, "historical"))
        return settled

    def end(self) -> list[list]:
        rows = [self._row(c, "ambiguous" if c["foes"] & set(self.active) else "current") for c in self.active.values()]
        return rows + [[*self.keys, None, None, None, None, "active-cluster limit exceeded"]] * self.over


def fold_decided(claims: DataFrame, decisions: DataFrame, keys: list[str], dialog: str | None = None, most_active: int | None = None) -> DataFrame:
    """Ordered fold with decisions from a table (existing, incoming, decision, winner), one row a cluster.

    COMPATIBLE joins (and merges all clusters it fits, whose conflicts with each other end), DIFFERENT_TARGET opens one,
    SUPERSEDES and CORRECTS retire the loser, CONFLICTS_WITH keeps both as ambiguous while both are active; pairs without
    a decision are different targets. `error` names what must not be: a claim that is compatible and retired at once, an
    earlier winner across dialogs (where the column `dialog` is given), more than `most_active` active clusters for a
    claim to be held against (all clusters of the key carry it; none is left out). Null keys are keys.

    A fold is a chain: each claim is held against what the claims before have left. The claims of a key stream through one
    task in order, sorted by Spark, and only clusters still active are held; a cluster leaves as soon as nothing can touch
    it. So memory hangs on the active clusters of one key, which have a limit by contract, and not on the key's claims.
    """
    asked = decisions.select(F.col("incoming").alias("claim_id"), F.struct("existing", "decision", "winner").alias("d")).groupBy("claim_id").agg(F.collect_list("d").alias("decided"))
    held = F.col(dialog) if dialog is not None else F.lit(None).cast("string")
    rows = claims.select(*keys, "claim_id", "at", held.alias("_dialog")).join(asked, "claim_id", "left")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "at", "claim_id")
    kind = claims.schema["claim_id"].dataType
    schema = claims.select(*keys).schema.add("primary_claim", kind).add("support", ArrayType(kind)).add("status", StringType()).add("superseded_by", kind).add("error", StringType())
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                own = [r[k] for k in keys]
                if key is None or own != key.keys:
                    out += key.end() if key else []
                    key = _Key(own, dialog, most_active)
                out += key.claim(r["claim_id"], r["decided"] or [], r["_dialog"])
            yield told(out)
            out = []
        if key:
            yield told(key.end())

    def told(found: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(arrow)], schema=arrow)

    every = rows.mapInArrow(fold, schema)
    if most_active is None:
        return every
    every = cut(every)
    over = every.where("primary_claim is null").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("error").alias("_over"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return every.where("primary_claim is not null").join(over, same, "left").withColumn("error", F.concat_ws("; ", F.nullif("error", F.lit("")), "_over")).select(*every.columns)


def asserted(folded: DataFrame) -> DataFrame:
    """folded, but a row with an error fails the job that reads it."""
    wrong = F.raise_error(F.concat(F.lit("fold of claims: "), F.col("error"), F.lit(", at "), F.col("primary_claim").cast("string")))
    return folded.withColumn("error", F.when(F.col("error") != "", wrong).otherwise(F.col("error")))
