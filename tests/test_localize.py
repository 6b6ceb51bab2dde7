"""A hand-made crash: a checkout whose tax rate has no entry. Scores are worked out by hand from the weights."""

from decimal import Decimal

import pytest

from rootweave.plans import localize as P
from rootweave.plans.explain import explain

NODES = [
    ("shop.py", "module", "shop.py", "shop.py", None), ("cart.py", "module", "cart.py", "cart.py", None), ("price.py", "module", "price.py", "price.py", None), ("tax.py", "module", "tax.py", "tax.py", None),
    ("shop.py::checkout", "function", "checkout", "shop.py", 3), ("cart.py::Cart", "class", "Cart", "cart.py", 1), ("cart.py::Cart.total", "method", "Cart.total", "cart.py", 2),
    ("price.py::net", "function", "net", "price.py", 5), ("tax.py::rate", "function", "rate", "tax.py", 2), ("tax.py::table", "function", "table", "tax.py", 9),
    ("shop.py::region", "variable", "region", "shop.py", 1), ("tax.py::rate::code", "variable", "code", None, None), ("price.py::net::amount", "variable", "amount", None, None),
]
EDGES = [
    ("shop.py", "cart.py", "imports"), ("shop.py", "price.py", "imports"), ("price.py", "tax.py", "imports"),
    ("shop.py::checkout", "cart.py::Cart.total", "calls"), ("shop.py::checkout", "price.py::net", "calls"), ("price.py::net", "tax.py::rate", "calls"), ("tax.py::rate", "tax.py::table", "calls"),
    ("tax.py::rate", "tax.py::rate::code", "reads"), ("cart.py::Cart.total", "tax.py::rate::code", "writes"), ("shop.py::checkout", "shop.py::region", "writes"), ("price.py::net", "price.py::net::amount", "writes"),
]
STDERR = """Traceback (most recent call last):
  File "{0}shop.py", line 12, in <module>
  File "{0}shop.py", line 6, in checkout
  File "{0}price.py", line 8, in net
  File "{0}tax.py", line 4, in rate
KeyError: 'XX'
"""
EVENTS = [("call", "checkout", "shop.py", None), ("call", "total", "cart.py", None), ("return", "total", "cart.py", None), ("call", "net", "price.py", None), ("call", "rate", "tax.py", None), ("exception", "rate", "tax.py", {"code": "'XX'", "region": "'eu'"})]
SCORES = {
    "tax.py::rate": 0.7 * 0.02 + 1.0 * 0.30 + 1.0 * 0.20,
    "price.py::net": 0.5 * 0.02 + 0.6 * 0.03 + 1.0 * 0.10 + 0.75 * 0.30 + 0.8 * 0.20,
    "shop.py::checkout": 0.5 * 0.02 + 0.4 * 0.03 + 0.7 * 0.10 + 0.8 * 0.20 + 0.3 * 0.30 + 0.6 * 0.20,
    "tax.py::rate::code": 0.5 * 0.02 + 1.0 * 0.20 + 0.7 * 0.30,
    "shop.py::region": 0.5 * 0.02 + 0.8 * 0.20 + 0.7 * 0.30,
    "cart.py::Cart.total": 0.5 * 0.02 + 1.0 * 0.20 + 0.5 * 0.30,
    "tax.py::table": 0.7 * 0.02 + 0.7 * 0.10,
    "price.py": 0.5 * 0.02 + 0.8 * 0.03,
    "shop.py": 0.5 * 0.02 + 0.5 * 0.03,
}


def _inputs(spark, root="", blocks=(), flows=()):
    nodes = spark.createDataFrame([(*n, None, False, i) for i, n in enumerate([*NODES, *blocks])], "id string, kind string, label string, file string, line int, stmt string, runtime boolean, ord long")
    edges = spark.createDataFrame([*EDGES, *((a, b, "flows_to") for a, b in flows)], "source string, target string, kind string")
    run = spark.createDataFrame([("Python", STDERR.format(root), "KeyError", "'XX'")], "language string, stderr string, exception_type string, exception_message string")
    events = spark.createDataFrame([("r", i, t, f, root + p, v) for i, (t, f, p, v) in enumerate(EVENTS)], "run_id string, seq long, type string, function string, filename string, variables map<string,string>")
    return nodes, edges, run, events


def test_ranking_scores_and_report(spark):
    nodes, edges, run, events = _inputs(spark)
    ranked, result = P.localize(nodes, edges, run, events, threshold="0.5")
    scores = [(r["node_id"], r["score"]) for r in ranked.collect()]
    assert scores == [(n, round(x, 4)) for n, x in sorted(SCORES.items(), key=lambda kv: (-round(kv[1], 4), kv[0]))]
    found = result.first()
    assert found["resolved"] and found["root_cause"]["node_id"] == "tax.py::rate" and found["confidence"] == 0.514
    assert found["propagation_path"] == ["checkout", "net", "rate"] and found["missing_sources"] == ["dependency_graph", "call_graph", "cfg", "data_flow"]
    assert found["suggested_fix"] == P.ADVICE["runtime_trace"]
    report = explain("p", result, nodes, run).first()
    assert report["error_summary"] == "KeyError: 'XX'" and report["root_cause"] == "rate (tax.py:2)"
    assert [w["function"] for w in report["where"]] == ["rate", "checkout", "net"] and report["insufficient_evidence"]
    assert "net" in report["why"] and "checkout" in report["why"]


@pytest.mark.parametrize("reached", [True, False])
def test_absolute_paths_threshold_and_control_flow(spark, reached):
    at = "tax.py::rate"
    blocks = [(f"{at}:start", "block", "rate()", "tax.py", 2), (f"{at}:block0", "condition", "if", None, 3), (f"{at}:block1", "return", "return", None, 4), (f"{at}:end", "block", "end", "tax.py", None)]
    flows = [(f"{at}:start", f"{at}:block0")] + [(f"{at}:block0", f"{at}:block1")] * reached
    nodes, edges, run, events = _inputs(spark, "D:\\shop\\", blocks, flows)
    ranked, result = P.localize(nodes, edges, run, events, threshold="0.7")
    by_id = {r["node_id"]: r for r in ranked.collect()}
    cfg = Decimal("1.0") if reached else Decimal("0.3")
    assert {e["source"]: e["score"] for e in by_id[at]["evidence"]}["cfg"] == cfg
    assert by_id[at]["score"] == round(SCORES[at] + float(cfg) * 0.15, 4) and by_id["price.py::net"]["score"] == round(SCORES["price.py::net"], 4)
    assert not result.first()["resolved"] and result.first()["root_cause"] is None


def test_weights_must_sum_to_one_and_graph_must_not_be_empty(spark):
    nodes, edges, run, events = _inputs(spark)
    with pytest.raises(ValueError):
        P.E.checked({"ast": "0.5"})
    with pytest.raises(ValueError):
        P.localize(nodes.limit(0), edges, run, events)
