import pytest
from tidemark import plans

from .common import normal
from .conftest import SF

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    assert normal(QUERIES[name](spark, SF).toPandas()).equals(normal(duck.sql(SQL[name]).df()))


def test_greedy_chunks_stay_within_budget(spark):
    out = QUERIES["c10_greedy_chunks"](spark, SF).toPandas()
    assert out.groupby("conv_id")["chunk"].apply(lambda c: c.is_monotonic_increasing).all()


def test_diversified_picks_first_hit_first(spark):
    out = QUERIES["r18_diversified"](spark, SF).toPandas()
    hits = QUERIES["r1_bm25"](spark, SF).toPandas()
    first = hits[hits["rank"] == 1].set_index("query_id")["doc_id"]
    picked = out[out["pick"] == 1].set_index("query_id")["doc_id"]
    assert picked.to_dict() == first.loc[picked.index].to_dict()


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
