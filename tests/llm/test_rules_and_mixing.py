import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tabguard.llm import queries
from tabguard.llm.mixing import mix
from tabguard.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "a b c a b c",
    "a b c d a b c",
    "x x x x",
    "l1\nl1\n\nl1\n \nl2",
    "#*$%&|<> word",
    "the of and to " * 30,
    "wort\xa0mit nbsp\x85end",
    "p q r s " * 3000,
    "nul\x00byte a\x1fb",
]


def repeated(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    return len({p for i, x in enumerate(windows) if n[x] > 1 for p in (i, i + 1, i + 2)})


def test_measures(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'z' AS n_words", "1 AS `we``ird`")
    out = quality_rules(df)
    got = {r["doc_id"]: r for r in out.collect()}
    assert "we`ird" in out.columns and out.columns.count("n_words") == 1
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert r["n_words"] == len(w)
        assert r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(t)
        assert r["base_failed"] == (len(w) < 50 or 100 * repeated(t) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules(df.filter("false")).count() == 0


def test_clean_prose_is_kept(spark):
    text = " ".join(f"the w{i} of word{i * 7} and" for i in range(60))
    bad = " ".join(f"w{i}### $$x{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, bad)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and "symbols" in got[2]["failed_rules"]


def documents():
    rows, n = [], 0
    for source, count, size in (("b", 300, 5), ("a", 40, 50), (None, 25, 7), ("c", 3, 1000), ("d", 2, 0)):
        for i in range(count):
            rows.append((n, " ".join(["w"] * (size + i % 3 if size else 0)) or None, source))
            n += 1
    return rows


def test_mix_meets_targets(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, source string").selectExpr("*", "1 AS size")
    rows = mix(df).collect()
    assert len(rows) == len(documents())
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in documents()}
    total, taken, biggest = sum(sizes.values()), Counter(), defaultdict(int)
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    target = {r["source"]: r["target"] for r in rows}
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert 1.5 * total - max(biggest.values()) <= sum(taken.values()) <= 1.5 * total
    for s, t in target.items():
        assert abs(taken[s] - t) <= 2 * max(biggest.values())
    again = {r["doc_id"]: r["taken"] for r in mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (None, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(empty).collect()] == [0, 0]


def test_mix_as_sql_with_ties_and_repeats(spark):
    rows = documents() + [(None, "a b", "a"), (7, "same words", "b"), (7, "same words", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(queries.OP8_SQL).fetchall()
    names = ("doc_id", "size", "source_size", "target", "taken")
    got = [tuple(r[n] for n in names) for r in mix(df).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    singles = lambda rs: sorted((r for r in rs if r[0] != 7), key=key)
    assert singles(got) == singles([tuple(None if x != x else x for x in r) for r in want])


@pytest.mark.parametrize("copies", [1, 2, 3])
def test_whole_rows_as_slim_rows(spark, copies):
    """Rows given back whole take what the slim rows say, with repeated rows at the ends of the prefixes too."""
    rows = documents() + [(7, "same words of a row", "b")] * 900 + [(7, "same words of a row", "c")] * 40 + [(None, None, None)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "map('k', source) AS m", "1 AS `a.b`", "2 AS __group")
    slim = mix(df, copies=copies, carry=("doc_id", "source"))
    whole = mix(df, copies=copies)
    assert whole.columns == [*df.columns, "size", "source_size", "target", "n_copies", "taken"]
    count = lambda d: Counter((r["doc_id"], r["source"], r["size"], r["target"], r["n_copies"], r["taken"]) for r in d.collect())
    assert count(whole) == count(slim)
    assert sorted(map(str, whole.select("doc_id", "text", "`a.b`").collect())) == sorted(map(str, df.select("doc_id", "text", "`a.b`").collect()))


def test_texts_with_more_windows_than_positions(spark, monkeypatch):
    from tabguard.llm import quality_rules as q

    monkeypatch.setattr(q, "POSITION_BITS", 3)
    test_measures(spark)
