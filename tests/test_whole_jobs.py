"""Registered queries do their whole job: no parameter or column list leaves part of it out."""

import datetime

import pytest

from casetrail.catalog import models as _catalog  # noqa: F401
from casetrail.catalog import registry
from casetrail.operators import models as M


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    rows = [(k, 1 + k % 5, "OF"[k % 2], float(1000 * (k * 37 % 91)), datetime.datetime(2020, 1, 1 + k % 28), ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")[k * 7 % 4])
            for k in range(1, 121)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(
        f"{folder}/orders.parquet")
    return folder


def test_boosted_query_fits_all_rounds(spark, orders, monkeypatch):
    class Seen(Exception):
        pass

    def seen(train, columns, kind="forest", label="y", weighted=True, **parameters):
        raise Seen(columns, M.learner(kind, label, **parameters))

    monkeypatch.setattr(M, "train_model", seen)
    with pytest.raises(Seen) as found:
        registry.QUERIES["m09_boosted"](spark, orders)
    columns, learner = found.value.args
    assert columns == ["p", "q", "price", "late"]
    assert (learner.getMaxIter(), learner.getMaxDepth()) == (400, 5)


def test_selection_query_searches_all_columns(spark, orders, monkeypatch):
    seen, forests = [], []

    def select(train, columns, method, label="y", k=20, ids=(), strength=0.01, **parameters):
        seen.append((method, list(columns)))
        forests.append(parameters)
        return list(columns)

    monkeypatch.setattr(M, "select_vars", select)
    registry.QUERIES["m13_select_vars"](spark, orders)
    assert seen == [(m, ["p", "q", "price", "late"]) for m in ("l1", "importance", "forward")]
    assert all("numTrees" not in p for p in forests)
