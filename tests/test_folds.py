"""The decided fold in a stream against a fold that keeps everything, on a query whose decisions branch."""

from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tidemark import plans
from tidemark.operators import state
from tidemark.plans import folds

from .conftest import SF


def keep_all(claims, told, most):
    """Clusters of one key's claims (id, day) in order; every cluster ever made is kept, and looked through each time."""
    made, over = [], False
    for claim, day in claims:
        live = [c for c in made if c["live"]]
        over |= len(live) > most
        how = {id(c): told.get((c["ids"][-1], claim)) for c in live}
        of = lambda *names, how=how, live=live: [c for c in live if how[id(c)] and how[id(c)][0] in names]
        losers = [c for c in of("SUPERSEDES", "CORRECTS") if how[id(c)][1] == "incoming"]
        winners = [c for c in of("SUPERSEDES", "CORRECTS") if how[id(c)][1] == "existing"]
        fit, odds = of("COMPATIBLE"), of("CONFLICTS_WITH")
        errors = (["compatible and retired"] if fit and winners else []) + (["contradicts chronology"] if any(c["day"] != day for c in winners) else [])
        by = winners[0]["ids"][-1] if winners else None
        for c in losers:
            c.update(live=False, by=claim)
        if fit:
            home = fit[0]
            for c in fit[1:]:
                home["ids"] += c["ids"]
                home["errors"] += c["errors"]
                made.remove(c)
                for other in made:
                    if any(x is c for x in other["foes"]):
                        other["foes"] = [x for x in other["foes"] if x is not c] + [home]
                home["foes"] += c["foes"]
            home["ids"].append(claim)
            home["foes"] = [x for x in home["foes"] if x is not home and not any(x is f for f in fit)]
        else:
            home = {"ids": [claim], "live": not winners, "by": by, "foes": [], "errors": []}
            made.append(home)
        home["errors"] += errors
        home["day"] = day
        for c in odds:
            if home["live"] and c["live"]:
                home["foes"].append(c)
                c["foes"].append(home)
    status = lambda c: "historical" if not c["live"] else "ambiguous" if any(f["live"] for f in c["foes"]) else "current"
    return [(c["ids"][-1], ",".join(map(str, c["ids"])), status(c), c["by"], "; ".join([*dict.fromkeys(c["errors"]), *["active-cluster limit exceeded"] * over])) for c in made]


def test_branching_fold(spark):
    claims, told = defaultdict(list), {}
    c = folds._claims(spark, SF)
    for r in c.orderBy("at", "claim_id").collect():
        claims[tuple(r[k] for k in folds.KEYS)].append((r["claim_id"], r["at"].day))
    for r in folds.branching(c).collect():
        told[r["existing"], r["incoming"]] = (r["decision"], r["winner"])
    want = {(*key, *row) for key, rows in claims.items() for row in keep_all(rows, told, 5)}
    got = [tuple(r) for r in plans.queries()["f4_fold_errors"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[4] for r in got} == {"current", "historical", "ambiguous"} and any(r[6] for r in got)


def test_null_keys_and_many_claims_of_one_key(spark):
    rows = spark.range(30_000).select(F.col("id").alias("claim_id"), F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise("hot").alias("owner"), F.col("id").alias("at"))
    last = rows.select(F.col("claim_id").alias("incoming"), (F.col("claim_id") - 3).alias("existing"), F.lit("SUPERSEDES").alias("decision"), F.lit("incoming").alias("winner")).where("existing >= 0")
    out = state.fold_decided(rows, last, ["owner"])
    assert out.count() == 30_000 and sorted((r["owner"] or "", r["n"]) for r in out.where("status = 'current'").groupBy("owner").agg(F.count(F.lit(1)).alias("n")).collect()) == [("", 1), ("hot", 2)]


def test_an_error_fails_the_job(spark):
    rows = spark.createDataFrame([(1, "o", 1), (2, "o", 2)], "claim_id long, owner string, at int")
    told = spark.createDataFrame([(1, 2, "SUPERSEDES", "existing")], "existing long, incoming long, decision string, winner string")
    fine = state.fold_decided(rows, told, ["owner"])
    assert state.asserted(fine).count() == 2
    with pytest.raises(PySparkException, match="contradicts chronology"):
        state.asserted(state.fold_decided(rows.withColumn("day", F.col("at")), told, ["owner"], "day")).collect()
