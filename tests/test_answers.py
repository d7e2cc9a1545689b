"""Answers by intent from a context, with items that depend on it."""

from terraza.operators import answers as N
from terraza.plans import answers as P

ITEMS = (N.Item("sum", "next_step", "go", "name"), N.Item("sum", "answer", "total", "n"), N.Item("sum", "limitations", "few", "n", "n < 3"), N.Item("sum", "limitations", "none", "0", "coalesce(n, 0) = 0"), N.Item("other", "data", "n", "n"))


def test_items_follow_intent_and_context(spark):
    asked = spark.createDataFrame([(1, "a", "sum"), (2, "b", "sum"), (3, None, "sum"), (4, "a", "other"), (5, "a", None), (6, "zz", "sum"), (1, "a", "sum")], "id long, district string, intent string")
    known = spark.createDataFrame([("a", 5, "A"), ("b", 2, None)], "district string, n long, name string")
    got = {}
    for r in N.answered(asked, known, "district", ITEMS).collect():
        got.setdefault(r["id"], []).append((r["position"], r["block"], r["item"], r["value"]))
    full = [(0, "answer", "total", "5"), (1, "next_step", "go", "A")]
    assert {k: sorted(v) for k, v in got.items()} == {
        1: sorted(full * 2), 2: [(0, "answer", "total", "2"), (1, "limitations", "few", "2"), (2, "next_step", "go", "")], 3: [(0, "answer", "total", ""), (1, "limitations", "none", "0"), (2, "next_step", "go", "")],
        4: [(0, "data", "n", "5")], 6: [(0, "answer", "total", ""), (1, "limitations", "none", "0"), (2, "next_step", "go", "")],
    }


def test_every_intent_has_an_answer_and_a_next_step():
    for items, last in ((P.ITEMS, True), (P.LEGACY, False)):
        for intent in {x.intent for x in items}:
            blocks = {x.block for x in items if x.intent == intent}
            assert "answer" in blocks and blocks <= set(N.BLOCKS) and (not last or "next_step" in blocks)
