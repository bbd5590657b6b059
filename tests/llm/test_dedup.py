import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabguard.llm import line_dedup, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows):
    """Components by comparing all pairs."""
    sets, up = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def near_copies(r, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(1, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "One", "one", "one two", "A b C", "a B c"]
    for n, size, edits in ((90, 150, 6), (30, 60, 2), (12, 400, 14), (40, 25, 2)):
        base = r.choices(words, k=size)
        texts += near_copies(r, base, n, edits)
        texts += [" ".join(base)] * 4
    texts += [" ".join(r.choices(words, k=r.randint(1, 80))) for _ in range(60)]
    r.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("rows_a_block", [400, 7])
def test_near_duplicates_as_all_pairs(spark, corpus, monkeypatch, rows_a_block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows_a_block)
    df = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "'q' AS n_shingles", "0 AS node")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    want = brute(corpus)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_links_beside_the_centre_are_found(spark, corpus):
    """The exact pass alone finds every link between members of a bucket."""
    sets = {i: minhash.shingles(t) for i, t in corpus if t and t.split()}
    rows = [(1, 0, i, i, s.tobytes()) for i, s in sets.items()]
    df = spark.createDataFrame(rows, "g long, side int, node long, label long, set binary")
    found = {(r["a"], r["b"]) for r in minhash._block_links(df, 85).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and minhash.linked(sets[i], sets[j], 85)}
    assert found == want


def test_near_duplicates_edge_cases(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "x y z"), (6, "X y z"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, 2, None, True), (5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 0, 7, True), (7, 0, 7, True)]
    assert minhash.near_duplicates(df.filter("false")).count() == 0


def test_shingles_are_sets_of_words():
    for t in ("", " ", "a", "a b", "a b c", "a b c a b c a b c", "é ü\tß\nA", "\x1f x\xa0y z w"):
        assert len(minhash.shingles(t)) == len(shingle_set(t))
    assert (minhash.shingles("Ab c\nd") == minhash.shingles(" aB  C d ")).all()
    assert not set(minhash.shingles("ab c d")) & set(minhash.shingles("a bc d"))


def test_long_texts_are_hashed_whole(monkeypatch):
    text = " ".join(f"word{i % 977}" for i in range(20000)) + " " + "y" * 5000
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "CHUNK", 1000)
    assert (minhash.word_hashes(text) == whole).all() and len(whole) == 20001


def test_bands_catch_links():
    r, hit = np.random.default_rng(4), 0
    for _ in range(300):
        base = r.integers(0, 2**63, r.integers(30, 300), dtype=np.uint64) * np.uint64(2)
        m = max(1, int(0.075 * len(base)))
        a, b = np.unique(base[m:]), np.unique(base[:-m])
        assert minhash.linked(a, b, 85) or len(base) < 60
        hit += (minhash.bucket_keys(a) == minhash.bucket_keys(b)).any()
    assert hit == 300


def passage(r, n_lines, words_a_line):
    return [" ".join(f"p{r.randrange(10**5)}" for _ in range(words_a_line)) for _ in range(n_lines)]


@pytest.fixture(scope="module")
def shared():
    """Documents of own lines; some hold a long line, others a passage of short lines."""
    r = random.Random(9)
    own = lambda: passage(r, r.randint(2, 6), 9)
    long, block = passage(r, 1, 60), passage(r, 12, 8)
    rows = []
    for i in range(60):
        lines = own()
        if i % 3 == 0:
            lines[1:1] = long
        if i % 4 == 0:
            lines[len(lines) // 2 : len(lines) // 2] = block
        rows.append((i, "\n".join(["common short line"] + lines)))
    return rows, long, block


def test_passages_stay_once(spark, shared):
    rows, long, block = shared
    df = spark.createDataFrame([*rows, (100, None), (101, "")], "doc_id long, text string").selectExpr("*", "'k' AS kept", "1 AS hash", "2 AS rid", "3 AS repeats", "4 AS lines")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert len(got) == 62 and got[100]["text"] is None and got[101]["text"] == ""
    texts = [got[i]["text"].split("\n") for i, _ in rows]
    assert sum(long[0] in t for t in texts) == 1 and long[0] in texts[0]
    assert all(line in texts[0] for line in block)
    assert sum(line in t for t in texts[1:] for line in block) == 0
    for i, text in rows:
        lost = [x for x in text.split("\n") if x not in texts[i]]
        assert all(x in long + block for x in lost)
        assert len(lost) == got[i]["n_removed_lines"]


def test_clean_documents_are_unchanged(spark, shared):
    rows = [(i, t) for i, t in shared[0] if i % 3 and i % 4]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(rows) and all(r["kept"] for r in got)


def test_copies_lose_all_but_the_first(spark):
    r = random.Random(2)
    text = "\n".join(passage(r, 3, 40))
    rows = [(5, text), (3, text), (3, text), (None, text)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["kept"], r["text"] == text) for r in got) == [("3", True, True), ("3", True, True), ("5", False, False), ("None", False, False)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_dedup(empty).count() == 0


def test_chunks_move_with_their_lines():
    r = random.Random(8)
    lines = passage(r, 60, 8)
    shifted = passage(r, 7, 8) + lines
    ends = {a + n for a, n, _ in line_dedup.chunks(lines)}
    moved = {a + n - 7 for a, n, _ in line_dedup.chunks(shifted)}
    assert {e for e in ends if e > 2} == {e for e in moved if e > 2}


def test_rewrite_compares_bytes():
    b, c, d = (" ".join(x * 3 for x in "abcdefghijkl") + y for y in "bcd")
    text = f"a\n{b}\n{c}\n{d}"
    same = {"start": 1, "lines": [b, c], "before": ["x"], "after": [d, "e"]}
    assert line_dedup.rewrite(text, [same]) == ("a", 3)
    assert line_dedup.rewrite(text, [{**same, "lines": [b, c.upper()]}]) == (text, 0)
    short = {"start": 0, "lines": ["a"], "before": [], "after": []}
    assert line_dedup.rewrite(text, [short]) == (text, 0)


SHAPES = [(2, 29), (2, 26), (3, 18), (4, 13), (4, 20), (5, 11), (6, 9), (8, 7), (13, 4), (18, 3)]


def test_passages_of_short_lines_are_found(spark):
    """Wherever it stands, the second copy goes whole and nothing else does."""
    r = random.Random(6)
    rows, want = [], {}
    for k in range(200):
        n_lines, words = SHAPES[k % len(SHAPES)]
        block = passage(r, n_lines, words)
        if k % 4 == 3:  # paragraphs
            block = [x for line in block for x in (line, "")][:-1]
        for i in (2 * k, 2 * k + 1):
            above, below = passage(r, r.randint(0, 4), 9), passage(r, r.randint(7, 9), 9)
            rows.append((i, "\n".join(above + block + below)))
            want[i] = "\n".join(above + below) if i % 2 else rows[-1][1]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want


def test_a_passage_that_overlaps_itself_stays_once(spark):
    a, b = passage(random.Random(1), 2, 20)
    got = line_dedup.line_dedup(spark.createDataFrame([(1, "\n".join([a, b] * 4)), (2, "x y\n" * 30)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: f"{a}\n{b}", 2: "x y\n" * 5}
    assert [(x, n) for x, n, _ in line_dedup.chunks(["x y"] * 6 + ["", "z"])] == [(0, 5), (1, 5), (1, 7)]


def repeated_lines(rows):
    """By brute force: the lines (document, place) of runs with LEAST_RUN words that stand, whole, at an earlier place too."""
    seen, out = {}, set()
    for i, text in sorted(rows):
        lines = text.split("\n")
        size = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(size[a:b]) >= line_dedup.LEAST_RUN and size[a] and size[b - 1]:
                    run = tuple(lines[a:b])
                    if run in seen and (seen[run][0] < i or seen[run][1] <= a):
                        out.update((i, k) for k in range(a, b))
                    seen.setdefault(run, (i, b))
    return out


def test_recall_of_all_repeated_runs(spark):
    """Runs of 2 to 12 lines out of a pool, anywhere, with lines without words between; none that repeats stays."""
    r = random.Random(14)
    pool = [passage(r, r.randint(2, 12), r.choice([3, 5, 8, 13, 30])) for _ in range(12)]
    rows = []
    for i in range(150):
        lines = passage(r, r.randint(0, 3), 9)
        for _ in range(r.randint(0, 3)):
            block = list(r.choice(pool))
            a, b = sorted(r.sample(range(len(block) + 1), 2))
            lines += block[a:b] + [""] * r.choice([0, 0, 1, 12]) + passage(r, r.randint(0, 2), r.choice([2, 9, 20]))
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts, want, left = dict(rows), repeated_lines(rows), 0
    for i, k in want:
        line = texts[i].split("\n")[k]
        # a line may stand again in the document, outside of the run
        kept, all_, gone = got[i].split("\n"), texts[i].split("\n"), sum(1 for j, m in want if j == i and texts[i].split("\n")[m] == line)
        left += bool(line.split()) and kept.count(line) > all_.count(line) - gone
    assert len(want) > 200 and left == 0


def test_many_lines_without_words_go_along(spark):
    a, b = passage(random.Random(3), 2, 25)
    text = "\n".join(["x1"] + [""] * 40 + [a, *[" "] * 30, b] + [""] * 40 + ["x2"])
    rows = [(1, text), (2, text.replace("x1", "y1").replace("x2", "y2"))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: text, 2: "y1\ny2"}


def test_clashing_names_long_texts_and_text_ids(spark):
    r = random.Random(5)
    block = "\n".join(passage(r, 5, 12))
    long = "\n".join(passage(r, 20000, 6))
    rows = [("b", "one\n" + block), ("a", block), ("c", long + "\n" + block), (None, "x\n" + block)]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS __owner", "2 AS `a.b`", "3 AS __rid", "4 AS __repeats", "5 AS hash", "6 AS KEPT")
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns[:-1], "n_lines", "n_removed_lines", "kept"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: x["text"] for i, x in got.items()} == {"a": block, "b": "one", "c": long, None: "x"}
    assert all((x["__owner"], x["a.b"], x["__rid"]) == (1, 2, 3) for x in got.values())
    pairs = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df.withColumn("text", F.coalesce(F.lit(block), "text"))).collect()}
    assert pairs == {"a": "a", "b": "a", "c": "a", None: None}


def test_large_components_of_one_bucket(spark, monkeypatch):
    """Units of one component don't meet, others do, over steps of size as well; as all pairs."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 6)
    r = random.Random(21)
    words = [f"w{i}" for i in range(4000)]
    base = r.choices(words, k=120)
    texts = [" ".join(base)]
    for k in range(70):  # a core that all share, so that bands do too, with tails of many lengths
        texts.append(" ".join(base + r.choices(words, k=k // 2)))
        w = list(base)
        w[r.randrange(120)] = f"y{k}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
