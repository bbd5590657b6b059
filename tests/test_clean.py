import pytest
from pyspark.sql import functions as F

from tabguard.errors import RecipeError, TableError
from tabguard.operators import clean, recipe
from tabguard.operators.ordered import neighbours


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("_row").collect()]


def test_registry_lists_every_op():
    assert len(clean.list_ops()) == 16
    assert all(clean.list_ops().values())


def test_trim_and_case(table):
    df = table(["a"], [["  x \t y "], [None], ["o'neil bob"]])
    assert rows(clean.trim(df), "a") == [("x y",), (None,), ("o'neil bob",)]
    assert rows(clean.case(df, "a", "title"), "a")[2] == ("O'Neil Bob",)
    assert rows(clean.case(df, "a", "sentence"), "a")[2] == ("O'neil bob",)


def test_replace_with_groups(table):
    df = table(["a"], [["john smith $1"]])
    assert rows(clean.replace_text(df, "a", r"(\w+) (\w+)", r"\2 \1", regex=True), "a") == [("smith john $1",)]
    assert rows(clean.replace_text(df, "a", "$1", "x"), "a") == [("john smith x",)]


def test_split_to_the_widest_row(table):
    df = clean.split_column(table(["a"], [["1| 2 |3"], ["4"]]), "a", "|")
    assert df.columns == ["_row", "a", "a_1", "a_2", "a_3"]
    assert rows(df, "a_2") == [("2",), (None,)]


def test_slice(table):
    df = table(["a"], [["abcdef"]])
    for mode, length, start, want in (("left", 2, 1, "ab"), ("right", 2, 1, "ef"), ("mid", 2, 3, "cd"), ("right", 0, 1, "abcdef")):
        assert rows(clean.slice_text(df, "a", mode, length, start), "a") == [(want,)]


def test_math_by_zero_is_empty(table):
    df = table(["a", "b"], [[6, 3], [6, 0]])
    assert rows(clean.math(df, "a", "/", "b", "c"), "c") == [(2.0,), (None,)]
    with pytest.raises(TableError, match="valid: a, b"):
        clean.math(df, "a", "+", "nope")


def test_currency_and_dates(table):
    df = table(["p", "d"], [["₹ 1,200.50", "5/3/2024"], ["free", "soon"]])
    assert rows(clean.strip_currency(df, "p"), "p") == [(1200.5,), (None,)]
    assert rows(clean.parse_date(df, "d", "%d %b %Y"), "d") == [("05 Mar 2024",), ("soon",)]


def test_empty_rows_and_columns(table):
    df = table(["a", "b"], [["x", None], ["nan", " "], ["y", "N/A"]])
    assert rows(clean.drop_empty_rows(df), "a") == [("x",), ("y",)]
    assert clean.drop_empty_columns(df).columns == ["_row", "a"]


def test_set_header_renumbers(table):
    df = clean.set_header(table(["c1", "c2"], [["junk", None], ["id", "id"], ["1", "2"]]), 3)
    assert df.columns == ["_row", "id", "id_"]
    assert rows(df, "_row", "id", "id_") == [(2, "1", "2")]


def test_fill_down_across_ranges(spark, table):
    values = ["A", None, "", "B", None] + [None] * 40 + ["C"] + ["nan"] * 5
    df = table(["g"], [[v] for v in values])
    want, last = [], None
    for v in values:
        last = v if v not in (None, "", "nan") else last
        want.append((last,))
    assert rows(clean.fill_down(df, "g"), "g") == want


def test_fill_down_without_a_value_above(table):
    assert rows(clean.fill_down(table(["g"], [[None], [""], ["x"]]), "g"), "g") == [(None,), ("",), ("x",)]


def test_dedupe(table):
    df = table(["id", "amt", "note"], [["a", 5, None], ["a", 10, "first"], [None, 1, "x"], [None, 2, "y"]])
    assert rows(clean.dedupe(df, "id"), "id", "amt") == [("a", 5), (None, 1)]
    assert rows(clean.dedupe(df, "id", "last"), "id", "amt") == [("a", 10), (None, 2)]
    got = clean.dedupe(df, "id", "aggregate", {"amt": "sum"})
    assert rows(got, "id", "amt", "note") == [("a", 15.0, "first"), (None, 3.0, "x")]


def test_errors_name_the_step(table):
    df = table(["a"], [["x"]])
    with pytest.raises(RecipeError, match="step 1"):
        clean.apply_ops(df, [{"op": "trim"}, {"op": "case", "params": {"columns": "nope"}}])
    with pytest.raises(RecipeError, match="valid: absolute"):
        clean.apply_ops(df, [{"op": "explode"}])


def test_recipe_writes_copies(table):
    df = table(["name"], [["  Bob "]])
    steps = {"steps": [{"op": "trim", "params": {"columns": ["name"]}}, {"op": "case", "params": {"columns": ["name"], "mode": "upper"}}]}
    got = recipe.apply_recipe(df, steps)
    assert rows(got, "name", "name_ai") == [("  Bob ", "BOB")]
    assert rows(recipe.apply_recipe(df, steps, replace=True), "name") == [("BOB",)]
    assert rows(recipe.apply_recipe(df, steps), "name_ai") == rows(got, "name_ai")


@pytest.mark.parametrize(
    "bad",
    [{}, {"steps": []}, {"steps": [{"op": "nope"}]}, {"steps": [{"op": "trim", "columns": "a"}]}, {"steps": [{"op": "llm_map", "params": {}}]}, {"steps": [{"op": "trim", "params": {"x": 1}}]}],
)
def test_bad_recipes(bad):
    with pytest.raises(RecipeError):
        recipe.validate_recipe(bad)


def test_map_each_distinct_value_once(table):
    df = table(["v"], [["a"], ["b"], ["a"], [None], ["boom"]])

    def mapper(value, instruction):
        if value == "boom":
            raise ValueError
        return f"{instruction}{value}"

    got = recipe.map_values(df, "v", mapper, "x", "m")
    assert rows(got, "v", "m") == [("a", "xa"), ("b", "xb"), ("a", "xa"), (None, None), ("boom", "")]
    parts = recipe.split_values(df, "v", lambda v: list(v), ["p", "q"], "parts")
    assert rows(parts, "parts") == [(["a", ""],), (["b", ""],), (["a", ""],), (["", ""],), (["b", "o"],)]


@pytest.mark.parametrize("n", [0, 1, 5, 60])
def test_neighbours_are_the_next_in_order(table, n):
    values = [f"{(i * 37) % 101:03d}" for i in range(n)]
    df = table(["k"], [[v] for v in values]) if n else table(["k"], [["x"]]).filter("false")
    got = {(r["a"]["_row"], r["b"]["_row"]) for r in neighbours(df, ["k", "_row"], 3).collect()}
    order = sorted((v, i + 2) for i, v in enumerate(values))
    assert got == {(order[i][1], order[j][1]) for i in range(n) for j in range(i + 1, min(i + 4, n))}


def test_stored_recipes_of_other_names_replay(table):
    df = table(["name", "code", "amount", "when"], [["  ram  o'neil ", "AB1234", 10, "5/3/2024"], ["SITA", "XY9876", 4, "soon"]])
    steps = [
        {"op": "trim", "params": {"columns": ["name"]}},
        {"op": "case", "params": {"columns": "name", "to": "title"}},
        {"op": "slice_text", "params": {"columns": ["code"], "side": "mid", "start": 3, "length": 2}},
        {"op": "math", "params": {"into": "rest", "left": 100, "op": "-", "right": "amount"}},
        {"op": "parse_date", "params": {"columns": "when", "output_format": "%d.%m.%Y"}},
    ]
    saved = {"instruction": "monthly", "steps": steps, "note": "n"}
    assert recipe.validate_recipe(saved) == steps
    out = recipe.apply_recipe(df, saved, replace=True)
    assert rows(out, "name", "code", "rest", "when") == [("Ram O'Neil", "12", 90.0, "05.03.2024"), ("Sita", "98", 96.0, "soon")]
    beside = recipe.apply_recipe(df, {"steps": [steps[2], {"op": "case", "params": {"columns": "name", "to": "lower"}}]})
    assert rows(beside, "code", "code_ai", "name_ai")[1] == ("XY9876", "98", "sita")
    agg = clean.apply_ops(table(["id", "amt", "note"], [["1", 10, "a"], ["1", 5, "b"], ["2", 7, "c"]]), [{"op": "dedupe", "params": {"columns": ["id"], "aggregate": {"amt": "sum"}}}])
    assert rows(agg, "id", "amt", "note") == [("1", 15.0, "a"), ("2", 7.0, "c")]
    for bad in ({"op": "math", "params": {"left": 1, "op": "+", "right": 2}}, {"op": "case", "params": {"columns": "name", "to": "loud"}}, {"op": "dedupe", "params": {"columns": ["name"], "aggregate": {"amount": "median"}}}):
        with pytest.raises(RecipeError, match="step 0"):
            clean.apply_ops(df, [bad])


def test_title_as_python(table):
    texts = ["o'neil bob", "3rd of éTÉ", "straße ẞx", "a-b_c.d", "日本a b", "ΟΔΟΣ ab", "", "x1y2 MCDONALD's", "ﬁne"]
    assert rows(clean.case(table(["a"], [[t] for t in texts]), "a"), "a") == [(t.title(),) for t in texts]


def test_neighbours_of_one_prefix_and_of_other_scripts(table, spark):
    """Keys with a long common prefix, beyond Latin-1 and equal ones, over several blocks."""
    from tabguard.operators import ordered

    keys = [f"customer#000{i % 700:05d}" for i in range(900)] + [f"{c}{i}" for c in "kÿĀж日😀" for i in range(60)] + ["same"] * 80 + [""]
    df = table(["k"], [[k] for k in keys])
    order = sorted((k.encode(), i + 2) for i, k in enumerate(keys))
    want = {(order[i][1], order[j][1]) for i in range(len(order)) for j in range(i + 1, min(i + 4, len(order)))}
    for block in (20_000, 50, 1):
        old, ordered.BLOCK = ordered.BLOCK, block
        try:
            got = {(r["a"]["_row"], r["b"]["_row"]) for r in neighbours(df, ["k", "_row"], 3).collect()}
        finally:
            ordered.BLOCK = old
        assert got == want
