import random

from pyspark.sql import functions as F

import corpus_pipeline as p


def prose(r, lang, n):
    pool = {"en": "the of and to in was that with ere ing tion", "fr": "le la les des une est que qui dans eau ment", "de": "der die das und nicht ein mit sch ung heit keit"}[lang].split()
    return " ".join("".join(r.choices(pool, k=r.randint(1, 2))) for _ in range(n))


def test_stages(spark):
    r = random.Random(1)
    rows = [(i, prose(r, lang := ("en", "fr", "de")[i % 3], 80) + "\n" + prose(r, lang, 30), lang, f"s{i % 4}", 0) for i in range(120)]
    copy = rows[5][1]
    near = copy.split(" ")
    near[10] = "changed"
    passage = prose(r, "en", 60)
    rows += [(500, copy, "de", "s1", 0), (501, " ".join(near), "de", "s1", 0), (502, "123 456", "en", "s1", 0), (503, None, "en", "s1", 0)]
    rows += [(600 + i, prose(r, "en", 50) + "\n" + passage, "en", "s2", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns, seen = docs.columns, []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, None)
        seen.append((name, {x["doc_id"] for x in docs.select("doc_id").collect()}))
        if name != "BPE":
            assert docs.columns == columns
        if name == "line dedup":
            assert docs.filter(docs.text.contains(passage)).count() == 1
    assert len(p.STAGES) == 5
    kept = dict(seen)
    clean = set(range(120)) | set(range(600, 604))
    assert kept["language ID"] == clean | {500, 501}
    assert clean <= kept["line dedup"] and 500 not in kept["line dedup"]
    assert clean - {5} <= kept["MinHash near-dedup"]
    assert {"ids", "n_tokens", "decoded"} <= set(docs.columns)


def test_copies_with_a_block_more_go(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(40):
        text = " ".join(r.choices(words, k=200))
        rows += [(2 * i, text), (2 * i + 1, text + "\n" + " ".join(r.choices(words, k=45)))]
    # three words changed apart leave 0.73 of 100 words' shingles
    w = r.choices(words, k=100)
    other = [f"x{i}" if i in (20, 50, 80) else x for i, x in enumerate(w)]
    rows += [(100, " ".join(w)), (101, " ".join(other))]
    got = p.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert {x["doc_id"] for x in got.collect()} == {*range(0, 80, 2), 100, 101}


def test_documents_stay_where_no_language_can_be_learned(spark):
    rows = [(1, "plain words", None, "s", 0), (2, "123 456", None, "s", 0), (3, None, None, "s", 0), (4, "\u4e16", None, "s", 0), (5, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.language(spark, docs, None)
    assert got.columns == docs.columns and {x["doc_id"] for x in got.collect()} == {1, 4}


def test_any_columns_and_empty_tables(spark):
    r = random.Random(4)
    rows = [(i, prose(r, lang := ("en", "fr")[i % 2], 60), lang if i % 9 else None, "s", 0) for i in range(60)]
    rows += [(70, "x", None, None, None), (71, "long " * 50000, "en", "s", 0), (None, prose(r, "en", 60), "en", "s", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["a.b", "__gone", "gone", "lang_pred", "score", "copy", "__copy", "size", "kept", "__0_", "n_copies", "component_id"]
    docs = docs.select("*", *[F.lit(k).alias(k) for k in extra])
    columns, empty = docs.columns, docs.filter("false")
    for name, stage in p.STAGES:
        docs, empty = stage(spark, docs, None), stage(spark, empty, None)
        assert empty.count() == 0
        if name == "language ID":
            assert docs.count() == len(rows) and {x["lang"] for x in docs.filter("doc_id < 60").collect()} == {"en", "fr"}
        if name != "BPE":
            assert docs.columns == empty.columns == columns
            assert all(x[k] == k for x in docs.collect() for k in extra)
    assert set(extra) <= set(docs.columns) and docs.count() > 0


def test_stages_by_brute_force(spark):
    """All five stages against plain Python over the same rows, but for the language model, which is taken as it is."""
    r = random.Random(11)
    pool = [f"w{i}" for i in range(4000)]
    text = lambda n: "\n".join(" ".join(r.choices(pool, k=min(12, n - i))) for i in range(0, n, 12))
    rows = [(i, text(r.randint(40, 120)), "en", ("a", "b", "c", None)[i % 4], 0) for i in range(120)]
    shared = "\n".join(" ".join(r.choices(pool, k=15)) for _ in range(4))
    rows += [(200 + i, text(60) + "\n" + shared, "en", "a", 0) for i in range(5)]
    for i in range(10):  # near copies, by a word of each line, so that no line repeats
        rows.append((300 + i, "\n".join(x + f" extra{i}" for x in rows[i * 3][1].split("\n")[:1]) + "\n" + rows[i * 3][1].split("\n", 1)[1].replace(" ", "  ", 3), "en", "b", 0))
    rows += [(400, "12 34", "en", "a", 0), (401, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out, seen = docs, []
    for _, stage in p.STAGES:
        out = stage(spark, out, None)
        seen.append([x.asDict() for x in out.collect()])
    assert {x["doc_id"] for x in seen[0]} == {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    # line dedup: what stays of each document has no run of lines that an earlier one has
    first: dict[str, int] = {}
    for i, t in sorted((x["doc_id"], x["text"]) for x in seen[0]):
        for line in t.split("\n"):
            first.setdefault(line, i)
    for x in seen[1]:
        before = next(y["text"] for y in seen[0] if y["doc_id"] == x["doc_id"]).split("\n")
        size = lambda ls: sum(len(y.split()) for y in ls)
        runs, run = [], []
        for line in [*before, None]:
            if line is not None and first[line] < x["doc_id"]:
                run.append(line)
            else:
                runs, run = [*runs, run], []
        gone = [line for run in runs if size(run) >= 30 for line in run]
        assert x["text"].split("\n") == [line for line in before if line not in gone] and x["n_chars"] == len(x["text"])
    # near-duplicates: five words, 0.8, all pairs
    sets = {x["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for x in seen[1] for w in [x["text"].lower().split()]}
    up = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up = {k: min(up[i], up[j]) if v in (up[i], up[j]) else v for k, v in up.items()}
    assert {x["doc_id"] for x in seen[2]} == {i for i in sets if up[i] == i}
    # mixing: copies of documents as the SQL twin of the operator has them
    import duckdb

    from tabguard.llm import queries

    con = duckdb.connect()
    con.register("documents", spark.createDataFrame([(x["doc_id"], x["text"], x["source"]) for x in seen[2]], "doc_id long, text string, source string").toPandas())
    want = {r[0]: r[4] // r[1] for r in con.execute(queries.OP8_SQL).fetchall()}
    assert sorted(x["doc_id"] for x in seen[3]) == sorted(i for i, n in want.items() for _ in range(n))
    # tokens: as the library
    import public_tokenizers
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    texts = {x["doc_id"]: x["text"] for x in seen[3]}
    assert all(x["ids"] == t.encode(texts[x["doc_id"]], add_special_tokens=False).ids and x["n_tokens"] == len(x["ids"]) for x in seen[4])
    assert all(x["decoded"] == t.decode(x["ids"], skip_special_tokens=False) for x in seen[4])
