"""Order, selection and incremental runs of models."""

import pytest

from terraloom.operators.models import Model, Warehouse, stored


def models():
    return [
        Model("mart", ("fact", "dim"), lambda f, d: f.join(d, "k")),
        Model("fact", ("raw",), lambda r: r.select("id", "k", "day", "v"), key=("id",), period="day"),
        Model("dim", ("raw", "names"), lambda r, n: r.select("k").distinct().join(n, "k", "left")),
        Model("alone", ("names",), lambda n: n),
    ]


def test_order_and_selection():
    w = Warehouse(models(), None)
    order = w.order()
    assert sorted(order) == ["alone", "dim", "fact", "mart"] and order.index("mart") > max(order.index("fact"), order.index("dim"))
    assert w.order("dim") == ["dim"] and "alone" not in w.order("mart")
    with pytest.raises(ValueError):
        Warehouse([Model("a", ("b",), None), Model("b", ("a",), None)], None).order()
    with pytest.raises(KeyError):
        w.order("missing")


def test_incremental_runs(spark, tmp_path):
    raw = spark.createDataFrame([(1, "x", 1, 10), (2, "y", 1, 20)], "id int, k string, day int, v int")
    tables = {"raw": raw, "names": spark.createDataFrame([("x", "X"), ("y", "Y")], "k string, name string")}
    w = Warehouse(models(), tables.__getitem__, *stored(spark, str(tmp_path)))
    rows = lambda out: sorted(tuple(r) for r in out.select("id", "k", "day", "v").collect())
    assert rows(w.build("mart")["mart"]) == [(1, "x", 1, 10), (2, "y", 1, 20)]
    tables["raw"] = spark.createDataFrame([(1, "x", 2, 11), (3, "y", 2, 30), (4, "y", 1, 40)], "id int, k string, day int, v int")
    for _ in range(2):  # the late row of an old day stays out, and a second run changes nothing
        assert rows(w.build("mart", "fact")["fact"]) == [(1, "x", 2, 11), (2, "y", 1, 20), (3, "y", 2, 30)]
    assert set(w.build()) == {"mart", "fact", "dim", "alone"}


def test_bridge_needs_no_facts():
    """Its repeats are dropped before keys are made, so it isn't made of the facts."""
    from terraloom.plans import models as plans

    assert "fact_trade" not in Warehouse(plans.MODELS, None).order("bridge_product_place")
