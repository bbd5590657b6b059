import random
from difflib import SequenceMatcher

import pytest

from tabguard.errors import PlanError, TableError
from tabguard.operators import entity, reconcile
from tabguard.plans import planner
from tabguard.plans.query_plan import execute_plan


@pytest.fixture(scope="module")
def sales(table):
    return table(["vendor", "amount", "state"], [["Acme", 500, "MH"], ["acme ", 499, "KA"], ["Beta", 300, None], ["Gamma", 100, "MH"], ["Delta", 99, "ka"]])


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_filters(sales):
    run = lambda **f: sorted(r["amount"] for r in execute_plan(sales, {"filters": [f]}).collect())
    assert run(column="amount", op="gt", value="299") == [300, 499, 500]
    assert run(column="vendor", op="eq", value=" ACME") == [499, 500]
    assert run(column="state", op="ne", value="mh") == [99, 300, 499]
    assert run(column="vendor", op="contains", value="a.") == []
    assert run(column="vendor", op="startswith", value="GA") == [100]
    assert run(column="state", op="in", value=["Ka", "x"]) == [99, 499]
    assert run(column="state", op="isnull") == [300]
    assert run(column="amount", op="in", value=[100, "99"]) == [99, 100]
    assert run(column="amount", op="gt", value="lots") == []


def test_groups_keep_null_and_last_sort_key_dominates(sales):
    plan = {"group_by": ["state"], "aggregates": [{"column": "amount", "fn": "sum"}], "sort": [{"column": "sum_amount"}, {"column": "state", "desc": True}]}
    assert rows(execute_plan(sales, plan)) == [("ka", 99), ("MH", 600), ("KA", 499), (None, 300)]
    assert rows(execute_plan(sales, {"group_by": ["state"], "filters": [{"column": "amount", "op": "lt", "value": 200}], "sort": ["state"]})) == [("MH", 1), ("ka", 1)]


def test_global_aggregates(sales):
    plan = {"aggregates": [{"column": "amount", "fn": f, "as": f} for f in ("count", "mean", "min", "max", "nunique")]}
    assert rows(execute_plan(sales, plan)) == [(5, 299.6, 99, 500, 5)]


def test_limits(sales):
    for limit, n in ((2, 2), (True, 5), (0, 5), ("3", 5), (5000, 5)):
        assert execute_plan(sales, {"limit": limit}).count() == n


@pytest.mark.parametrize(
    "bad",
    [
        {"select": ["x"]},
        {"filters": [{"column": "vendor", "op": "regex", "value": ".*"}]},
        {"filters": [{"column": "__class__", "op": "eq", "value": 1}]},
        {"filters": ["amount > 1"]},
        {"aggregates": [{"column": "amount", "fn": "eval"}]},
        {"group_by": ["nope"]},
        {"sort": ["nope"]},
        {"group_by": ["state"], "aggregates": [{"column": "amount", "fn": "sum", "as": "state"}]},
        [],
    ],
)
def test_escapes_are_refused(sales, bad):
    with pytest.raises(PlanError):
        execute_plan(sales, bad)


def test_hostile_literals_are_values(sales):
    for v in ("'; DROP TABLE x; --", "amount` or 1=1", "${x}", "\\"):
        assert execute_plan(sales, {"filters": [{"column": "vendor", "op": "eq", "value": v}]}).count() == 0


def test_ask_with_a_scripted_planner(sales):
    replies = ['no json', '```json\n{"group_by": ["vendor"], "limit": 3}\n```', "Three."]
    asked = []

    def script(prompt):
        asked.append(prompt)
        return replies.pop(0)

    got = planner.ask(sales, "who?", script)
    assert got.text == "Three." and len(got.evidence) == 3 and "not valid JSON" in asked[1]
    assert planner.ask(sales, "?", lambda p: '{"refuse": "no such data"}').refused
    assert planner.ask(sales, "?", lambda p: '{"drop": 1}').refused
    assert planner.ask(sales, "?", lambda p: "never").refused


@pytest.fixture(scope="module")
def books(table):
    a = table(["invoice", "vendor", "amount", "date"], [["I1", "Acme Ltd", 100.0, "2024-01-01"], ["I2", "Beta", 200.0, "2024-01-02"], ["I3", "Gamma Co", 300.0, "2024-01-03"], ["I4", "Delta", 400.0, "2024-01-04"]])
    b = table(["invoice", "vendor", "amount", "date"], [["i1 ", "ACME LTD", 100.0, "01/01/2024"], ["I2", "Beta", 200.04, "2024-01-03"], ["I3", "Gama Co", 300.0, "2024-01-03"], ["I9", "Zeta", 1.0, "2024-01-04"]])
    return a, b


def counts(result):
    return {r["bucket"]: r["n"] for r in reconcile.bucket_counts(result).collect()}


def test_exact_and_tolerant(books):
    got = reconcile.reconcile(*books, ["invoice"])
    assert counts(got) == {"matched": 1, "discrepancy": 2, "only_in_a": 1, "only_in_b": 1}
    got = reconcile.reconcile(*books, ["invoice"], {"numeric": 0.05, "days": 1, "fuzzy": 0.85})
    assert counts(got) == {"matched": 3, "only_in_a": 1, "only_in_b": 1}
    levels = {r["a"]["invoice"]: r["match_level"] for r in got.filter("bucket = 'matched'").collect()}
    assert levels == {"I1": "L1", "I2": "L2", "I3": "L2"}


def test_variance_and_fuzzy_keys(table):
    a = table(["txn_id", "amount", "merchant"], [["T001", 900.0, "A"], ["T002", 50.0, "B"], ["T003", 10.0, "C"], [None, 5.0, "N"]])
    b = table(["txn_id", "amount", "merchant"], [["T001", 850.0, "A"], ["T002", 50.0, "B"], ["T0O3", 10.0, "C"], [None, 5.0, "N"]])
    got = reconcile.reconcile(a, b, ["txn_id"], {"numeric": 0.01}, fuzzy_keys=0.7).collect()
    diff = next(r for r in got if r["bucket"] == "discrepancy")
    assert (diff["differences"][0]["diff_abs"], diff["differences"][0]["diff_pct"]) == (-50.0, -5.5556)
    close = next(r for r in got if r["match_level"] == "L3")
    assert close["a"]["txn_id"] == "T003" and close["b"]["txn_id"] == "T0O3" and close["key_similarity"] == 0.75
    assert sum(r["bucket"] == "matched" for r in got) == 3


def test_fuzzy_keys_by_brute_force(table):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde12 ") for _ in range(r.randint(3, 12))).strip() or "x"
    left = sorted({word() for _ in range(60)})
    right = sorted({"".join(c if r.random() < 0.9 else r.choice("abcde") for c in w).strip() or "y" for w in left} - set(left))
    r.shuffle(left)
    r.shuffle(right)
    got = reconcile.reconcile(table(["k"], [[w] for w in left]), table(["k"], [[w] for w in right]), ["k"], fuzzy_keys=0.75)
    pairs = {(x["a"]["k"], x["b"]["k"]) for x in got.filter("match_level = 'L3'").collect()}
    want, free = set(), list(right)
    for w in left:
        best = max(free, key=lambda v: (SequenceMatcher(None, w, v).ratio(), -right.index(v)), default=None)
        if best is not None and SequenceMatcher(None, w, best).ratio() >= 0.75:
            want.add((w, best))
            free.remove(best)
    assert pairs == want and want


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85, 0.95])
def test_fuzzy_candidates_lose_no_pair(table, threshold):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdef-01") for _ in range(n))
    left = sorted({word(r.randint(1, 25)) for _ in range(70)} | {"", "a", "ab"})
    change = lambda w: "".join(c for x in w for c in ([x] if r.random() < 0.93 else [r.choice("abcdef"), x][: r.randint(0, 2)]))
    right = sorted({change(w) for w in left for _ in range(2)} | {w[::-1] for w in left})
    frame = lambda ws: table(["k", "t"], [[w, w] for w in ws]).selectExpr("k", "_row AS p", "t")
    got = {(x["ka"], x["kb"]) for x in reconcile._candidates(frame(left), frame(right), threshold).collect()}
    want = {(x, y) for x in left for y in right if x and y and SequenceMatcher(None, x, y).ratio() >= threshold}
    assert want <= got and len(got) < len(left) * len(right)


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.9])
def test_fuzzy_segments_lose_no_pair(table, threshold, monkeypatch):
    monkeypatch.setattr(reconcile, "FEW_PAIRS", 0)
    monkeypatch.setattr(reconcile, "GAIN", 0)
    monkeypatch.setattr(reconcile, "BLOCK", 7)
    test_fuzzy_candidates_lose_no_pair(table, threshold)


def test_fuzzy_keys_that_begin_alike(table):
    """Where most keys share their pieces, those with too few characters in common are no candidates."""
    names = [f"Supplier#{i:09d}" for i in range(0, 60_000, 300)]
    frame = lambda ws: table(["k", "t"], [[w, w] for w in ws]).selectExpr("k", "_row AS p", "t")
    assert reconcile._candidates(frame(names), frame([n.replace("0", "O") for n in names]), 0.8).isEmpty()


def test_fuzzy_keys_broadcast_no_records(table):
    """Small files may hold large records; these go by sorted joins."""
    rows = [[f"key{i}", i] for i in range(20)]
    a, b = table(["k", "v"], rows), table(["k", "v"], [[k.replace("key1", "kez1"), v] for k, v in rows])
    plan = reconcile.reconcile(a, b, ["k"], fuzzy_keys=0.7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_one_to_many_takes_the_closest(table):
    a, b = table(["k", "v"], [["x", 1], ["x", 2]]), table(["k", "v"], [["x", 1]])
    assert counts(reconcile.reconcile(a, b, ["k"])) == {"matched": 1, "discrepancy": 1}
    assert counts(reconcile.reconcile(b, a, ["k"])) == {"matched": 1}
    with pytest.raises(TableError, match="valid: k, v"):
        reconcile.reconcile(a, b, ["nope"])


def test_profile_run(table):
    a = table(["id", "amt"], [["a", 15], ["b", 1]])
    b = table(["id", "amt"], [[" A", 5], ["a", 10], ["b", 1]])
    profile = {"keys": ["id"], "pre_recipe_b": [{"op": "trim"}, {"op": "case", "params": {"mode": "lower"}}], "dedupe_b": {"keys": ["id"], "keep": "aggregate", "aggregations": {"amt": "sum"}}}
    got = reconcile.summary(reconcile.run_profile(a, b, profile)).first()
    assert (got["matched"], got["match_rate"]) == (2, 1.0)


def test_names(table):
    df = table(["a", "b", "g"], [["Ramesh Kumar", "ramesh  kumar", "x"], ["Ramesh Kumar", "Suresh Patel", "X "], [None, "x", "y"], ["...", "x", "y"]])
    got = {r["row"]: r["similarity"] for r in entity.pairwise(df, "a", "b").collect()}
    assert got[2] == 100.0 and got[3] < 60 and got[5] == 0.0 and 4 not in got
    pairs = entity.match_names(df, "b", group_by="g", threshold=0).collect()
    assert {(r["row_a"], r["row_b"]) for r in pairs} == {(2, 3), (4, 5)}
    with pytest.raises(TableError, match="bound of 1"):
        entity.match_names(df, "b", most_pairs=1)
    judged = entity.match_names(df, "a", "b", threshold=90, judge=lambda x, y: "match").collect()
    assert [r["verdict"] for r in judged] == ["match"]
    assert {r["verdict"] for r in entity.match_names(df, "a", "b", threshold=0, judge=lambda x, y: "?").collect()} == {"unverified"}


def test_entities(table):
    df = table(["name", "city", "pan"], [["Acme Traders", "Pune", None], ["ACME  traders", "pune", "P1"], ["Acme Trader", "Pune", "P1"], ["Zenith", "Delhi", None], ["Beta Works", "Kochi", "P3"]])
    kept, log = entity.dedupe_entities(df, ["name", "city"], threshold=85)
    assert sorted(r["_row"] for r in kept.collect()) == [3, 5, 6]
    assert [tuple(r) for r in log.collect()] == [(3, [2, 4])]
    assert sorted(r["_row"] for r in entity.dedupe_entities(df, ["name"], 85, "last")[0].collect()) == [4, 5, 6]
    assert entity.dedupe_entities(df.filter("false"), ["name"], 85)[0].count() == 0
