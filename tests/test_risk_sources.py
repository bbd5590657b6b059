import random

import pytest
from pyspark.sql import functions as F

from tabguard.errors import IngestError, TableError
from tabguard.operators import risk
from tabguard.sources import files
from tabguard.sources.xlsx import write_xlsx
from tabguard.streaming import quality_stream
from tabguard.workspace import Jobs, Workspace, file_fingerprint, table_fingerprint


@pytest.fixture(scope="module")
def labelled(table):
    r = random.Random(4)
    rows = []
    for i in range(400):
        amount, hour, age, channel = r.uniform(10, 9000), r.randrange(24), r.randrange(400), r.choice(["web", "app", "pos"])
        hit = (amount > 5000) + (hour < 6) + (age < 60) >= 2
        rows.append([f"T{i}", round(amount, 2), hour, age, channel, "fraud" if hit != (r.random() < 0.03) else "ok"])
    return table(["txn_id", "amount", "hour", "payee_age_days", "channel", "label"], rows)


@pytest.fixture(scope="module")
def trained(labelled):
    return risk.train(labelled, "label", "demo", trees=12, folds=2)


def test_training(trained, labelled):
    _, card = trained
    assert card.positive == "fraud" and set(card.features) == {"amount", "hour", "payee_age_days", "channel"}
    assert card.metrics["f1"] > 0.6 and card.metrics["roc_auc"] > 0.85
    assert sum(card.metrics["confusion"].values()) == card.rows == 400
    assert card.importances[0][0] != "channel"


def test_parallel_fits_change_nothing(labelled):
    cards = [risk.train(labelled, "label", "demo", trees=3, folds=2, parallel=n)[1] for n in (1, 3)]
    assert cards[0].metrics == cards[1].metrics and cards[0].importances == cards[1].importances


def test_scoring(trained, labelled):
    model, card = trained
    got = risk.score(labelled, model, card).collect()
    assert len(got) == 400 and all(0 <= r["probability"] <= 1 for r in got)
    assert all(r["flagged"] == (r["band"] in ("high", "critical")) for r in got if abs(r["probability"] - 0.5) > 1e-4)
    assert all(len(r["top_factors"]) <= 3 for r in got) and any(r["top_factors"] for r in got)
    assert risk.check_schema(labelled, card) == ["txn_id"]
    with pytest.raises(TableError, match="amount"):
        risk.score(labelled.drop("amount"), model, card)
    assert risk.evaluate(labelled, "label", model, card)["holdout"]["roc_auc"] > 0.85


def test_saved_models(trained, labelled, tmp_path):
    risk.save(*trained, str(tmp_path))
    model, card = risk.load("demo", str(tmp_path))
    assert card.fingerprint == trained[1].fingerprint and [m["name"] for m in risk.list_models(str(tmp_path))] == ["demo"]
    assert risk.score(labelled.limit(3), model, card, explain=False).count() == 3


def test_leaks_and_refusals(labelled):
    leaky = labelled.withColumn("flag", (F.col("label") == "fraud").cast("int")).withColumn("outcome", F.upper("label"))
    rows, _ = risk.resolve_label(leaky, "label")
    assert {r["column"] for r in risk.leakage(rows, ["amount", "flag"], ["channel", "outcome"]).collect()} == {"flag", "outcome"}
    with pytest.raises(TableError, match="too few"):
        risk.train(labelled.limit(50), "label", "x")
    with pytest.raises(TableError, match="gradient_boosting"):
        risk.train(labelled, "label", "x", algorithm="magic")
    with pytest.raises(TableError, match="classes"):
        risk.resolve_label(labelled, "txn_id")


def test_auc_by_brute_force(spark):
    r = random.Random(7)
    rows = [(float(r.random() < 0.4), round(r.random(), 2)) for _ in range(200)]
    got = risk.metrics(spark.createDataFrame(rows, "__y double, probability double"))
    pairs = [(p > q) + 0.5 * (p == q) for y, p in rows if y for z, q in rows if not z]
    assert got["roc_auc"] == round(sum(pairs) / len(pairs), 4)


def test_csv_with_odd_rows(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id;name;n\n1;"a;b";5\n2;short\n3;x;7;extra\n4;é;8\n', "utf-8")
    got = files.load(spark, str(p)).orderBy("_row").collect()
    assert [(r["id"], r["name"], r["n"]) for r in got] == [(1.0, "a;b", 5.0), (2.0, "short", None), (4.0, "é", 8.0)]
    assert [r["_row"] for r in got] == [2, 3, 4]


def test_encodings_and_tsv(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("ville,n\nOrléans “€”,1\n".encode("cp1252"))
    assert files.load(spark, str(tmp_path / "l.csv")).first()["ville"] == "Orléans “€”"
    (tmp_path / "b.csv").write_bytes("﻿k,n\nx,1\n".encode())
    assert files.load(spark, str(tmp_path / "b.csv")).columns == ["_row", "k", "n"]
    (tmp_path / "t.tsv").write_text("a\tb\n1,5\tx\n")
    assert files.load(spark, str(tmp_path / "t.tsv")).first()["a"] == "1,5"


def test_unreadable_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(tmp_path / "no.csv"))
    with pytest.raises(IngestError, match=".csv"):
        files.load(spark, str(tmp_path / "x.doc"))
    (tmp_path / "bad.xlsx").write_text("no zip")
    with pytest.raises(Exception, match="no workbook"):
        files.load(spark, str(tmp_path / "bad.xlsx")).count()


def test_workbooks(spark, tmp_path, table):
    df = table(["k", "n", "ok"], [["a <&>", 1.5, True], [None, None, False]])
    path = write_xlsx({"One": df.drop("_row"), "Two": df.select("k")}, str(tmp_path / "w.xlsx"))
    got = files.load(spark, path, infer=True).orderBy("_row").collect()
    assert [(r["_row"], r["k"], r["n"], r["ok"]) for r in got] == [(2, "a <&>", 1.5, "true"), (3, None, None, "false")]
    assert files.load(spark, path, "Two").columns == ["_row", "k"]
    with pytest.raises(Exception, match="valid: One, Two"):
        files.load(spark, path, "Three").count()
    with pytest.raises(TableError, match="exists"):
        write_xlsx({"One": df}, path)


def test_row_numbers_follow_the_scan(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "r.parquet"))
    got = files.load(spark, str(tmp_path / "r.parquet"))
    assert got.filter("_row <> id + 2").count() == 0 and got.count() == 1000
    many = files.with_row_id(spark.range(100).repartition(7))
    assert sorted(r["_row"] for r in many.collect()) == list(range(2, 102))


def test_write_spares_its_input(spark, tmp_path, table):
    df = table(["a"], [["x"]])
    path = str(tmp_path / "o.csv")
    with pytest.raises(TableError):
        files.write(df, path, source=path)
    files.write(df, path)
    assert spark.read.option("header", True).csv(path).collect() == [("x",)]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write(df, path)


def test_workspace(tmp_path):
    w = Workspace(str(tmp_path))
    w.save("rulesets", "mine", {"required": ["a"]})
    assert w.get("rulesets", "mine") == {"required": ["a"]} and w.names("rulesets")[-1] == "mine"
    for name in ("kyc", "../x", "a/b", ""):
        with pytest.raises(TableError):
            w.save("rulesets", name, {})
    with pytest.raises(TableError, match="keys"):
        w.save("profiles", "p", {"tolerance": {}})
    w.save("recipes", "r", {"steps": [{"op": "trim"}]})
    w.delete("rulesets", "mine")
    with pytest.raises(TableError, match="unknown ruleset"):
        w.get("rulesets", "mine")
    assert [x["action"] for x in w.history()] == ["delete_rulesets", "save_recipes", "save_rulesets"]


def test_fingerprints_and_jobs(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert len(file_fingerprint(str(tmp_path / "f"))) == 16
    a = spark.range(100).repartition(5)
    assert table_fingerprint(a) == table_fingerprint(a.orderBy("id")) != table_fingerprint(spark.range(99))
    jobs = Jobs(spark)
    good, bad = jobs.submit("count", lambda: spark.range(7).count()), jobs.submit("fail", lambda: 1 / 0)
    assert jobs.wait(good, 60)["result"] == 7 and jobs.wait(bad, 60)["state"] == "error"
    assert len(jobs.list()) == 2


def test_streams(spark, tmp_path):
    rows = [(i + 2, f"2024-01-01 00:{i:02d}:00", "p1" if i in (3, 8) else f"v{i}", "x@y.com" if i % 4 else "bad") for i in range(20)]
    df = spark.createDataFrame(rows, "_row long, t string, v string, mail string").withColumn("t", F.to_timestamp("t"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = quality_stream.read_stream(spark, str(tmp_path / "in"), df.schema, 10)

    def drain(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert len(drain(quality_stream.validate_stream(stream, {"formats": {"mail": "email"}}), "findings", "append")) == 5
    seen = drain(quality_stream.duplicate_sightings(stream, "v", "t", "1 day"), "seen", "complete")
    assert [(r["value"], r["n"]) for r in seen] == [("p1", 2)]
    profile = {r["column"]: r for r in drain(quality_stream.profile_stream(stream, ["v", "mail"]), "prof", "complete")}
    assert profile["v"]["n_rows"] == 20
    assert len(drain(quality_stream.first_sightings(stream, "v", "t", "1 day"), "firsts", "append")) == 19
    with pytest.raises(TableError):
        quality_stream.validate_stream(stream, {"unique": ["v"]})


def test_the_query_trains_on_all_labelled_rows(spark, monkeypatch):
    from tabguard import queries

    rows = [(k, n, float(k * n % 50), k % 10 / 100, float(k), "R" if n % 2 else "N") for k in range(1, 60) for n in range(1, 8)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double, l_returnflag string")
    monkeypatch.setattr(queries, "read", lambda *_: df)
    monkeypatch.setattr(risk, "train", lambda rows, *_, **settings: (rows.count(), settings))
    monkeypatch.setattr(risk, "score", lambda rows, count, settings: (rows.count(), count, settings))
    assert queries.queries()["risk_score"](spark, "") == (413, 413, {})


def test_large_sheets_in_parts(spark, tmp_path):
    from tabguard.sources import xlsx

    df = spark.range(30000).selectExpr("id AS k", "concat('name <', id, '>') AS name", "id / 4 AS x").coalesce(1)
    path = write_xlsx({"One": df}, str(tmp_path / "large.xlsx"))
    for size in (1 << 30, 300_000, 70_001):
        got = xlsx.read_xlsx(spark, path, None, size)
        assert got.rdd.getNumPartitions() == -(-_sheet_size(path) // size)
        rows = sorted((r["_row"], r["k"], r["name"], r["x"]) for r in got.collect())
        assert rows == [(i + 2, str(i), f"name <{i}>", str(i / 4)) for i in range(30000)]


def _sheet_size(path):
    import zipfile

    with zipfile.ZipFile(path) as book:
        return book.getinfo("xl/worksheets/sheet1.xml").file_size


def test_rows_that_exceed_a_sheet_go_on(spark, tmp_path, monkeypatch):
    from tabguard.sources import xlsx

    monkeypatch.setattr(xlsx, "MOST_ROWS", 40)
    path = write_xlsx({"A": spark.range(100).coalesce(1), "B": spark.range(3).coalesce(1)}, str(tmp_path / "o.xlsx"))
    got = [r["id"] for s in ("A", "A (2)", "A (3)") for r in files.load(spark, path, s).orderBy("_row").collect()]
    assert got == list(range(100)) and files.load(spark, path, "B").count() == 3


def test_sheets_with_prefixes_and_without_numbers(tmp_path):
    import io

    from tabguard.sources import xlsx

    head = b'<?xml version="1.0"?><x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:m="urn:m"><x:cols/><x:sheetData>'
    body = b"".join(b'<x:row m:a="1"><x:c t="inlineStr"><x:is><x:t>v%d</x:t></x:is></x:c></x:row>' % i for i in range(3000)) + b"<x:row/>"
    data = head + body + b"</x:sheetData><x:rowBreaks/></x:worksheet>"
    for cuts in ([0, 1 << 62], [0, 999, 50000, 100000, 1 << 62]):
        got = [(n, x) for a, b in zip(cuts, cuts[1:]) for n, x, _ in xlsx._elements(io.BytesIO(data), a, b)]
        assert [n for n, _ in got] == list(range(1, 3002)) and b"".join(x for _, x in got) == body


def test_long_cells_and_splits(spark, tmp_path):
    (tmp_path / "m.csv").write_text('k,note\n1,"two\nlines, ""quoted"""\n2,plain\n')
    got = files.load(spark, str(tmp_path / "m.csv")).orderBy("_row").collect()
    assert [(r["k"], r["note"]) for r in got] == [(1.0, 'two\nlines, "quoted"'), (2.0, "plain")]
    (tmp_path / "s [1].csv").write_text("k,v\n" + "".join(f'{i},"a ""b"" {i}"\n' for i in range(200000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        df = files.load(spark, str(tmp_path / "s [1].csv"))
        assert df.rdd.getNumPartitions() > 4
        assert df.filter("_row <> k + 2 OR v <> concat('a \"b\" ', CAST(k AS INT))").count() == 0 and df.count() == 200000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_the_head_of_a_file_is_read(spark, tmp_path):
    (tmp_path / "h.csv").write_text("k,v\n" + "1,2\n" * 50000)
    assert len(files._head(spark, str(tmp_path / "h.csv"))) == files.HEAD_BYTES


def test_rows_across_the_end_of_a_chunk_are_counted(monkeypatch):
    import io

    from tabguard.sources import xlsx

    body = "".join(f"<row><c><v>{'1' * (i % 23)}</v></c></row>" for i in range(300))
    data = f"<worksheet><sheetData>{body}</sheetData></worksheet>".encode()
    whole = [(n, x) for n, x, _ in xlsx._elements(io.BytesIO(data), 0, 1 << 62)]
    assert [n for n, _ in whole] == list(range(1, 301))
    for chunk in (150, 211, 256, 997):
        monkeypatch.setattr(xlsx, "CHUNK", chunk)
        assert [(n, x) for n, x, _ in xlsx._elements(io.BytesIO(data), 9000, 1 << 62)] == [w for w in whole if data.index(b"<row") + sum(len(x) for _, x in whole[: w[0] - 1]) >= 9000]


def test_boosted_trees_are_those_of_spark(spark, table, monkeypatch):
    r = random.Random(9)
    rows = [[r.randrange(9), r.choice([0.5, 1.5, 4.0, None]), r.choice("abc")] for _ in range(600)]
    rows = [[*x, "fraud" if (x[0] > 5) + ((x[1] or 0) > 1) + (x[2] == "b") + r.random() > 2 else "ok"] for x in rows]
    df = table(["hour", "rate", "channel", "label"], rows)
    monkeypatch.setattr(risk.boosting, "MOST_CELLS", 0)
    slow, slow_card = risk.train(df, "label", "x", trees=6, folds=2)
    monkeypatch.undo()
    # on counts of binned rows, without Spark's own fit
    monkeypatch.setattr(risk, "GBTClassifier", None)
    fast, card = risk.train(df, "label", "x", trees=6, folds=2)
    p = [[x["probability"] for x in risk.score(df, m, c, explain=False).orderBy("_row").collect()] for m, c in ((slow, slow_card), (fast, card))]
    assert max(abs(x - y) for x, y in zip(*p)) <= 0.0002
    assert card.metrics == slow_card.metrics and card.rows == 600
    assert [(c, round(v, 2)) for c, v in card.importances] == [(c, round(v, 2)) for c, v in slow_card.importances]
