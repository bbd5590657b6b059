import random

import public_tokenizers
import pytest
import tokenizers

from tabguard.llm.bpe import SHORT, Tokenizer, bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return Tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_random_texts_as_the_library(coder, library):
    r = random.Random(5)
    pool = [*"abcXYZ 019'sΣςéÉ.,!?<|>\t\n\x1c\x85\xa0 　日本😀ﬀ½ǅİ", "<|endoftext|>", "'re", " the "]
    for _ in range(4000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 14)))
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == want
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_scan_and_heap_merge_alike(coder):
    r = random.Random(6)
    for n in (1, 2, 3, SHORT, SHORT + 1, 300):
        for _ in range(20):
            word = "".join(r.choice("thaeinorsl") for _ in range(n)).encode()
            ids = [coder.inner[b] for b in word[:-1]] + [coder.last[word[-1]]]
            assert coder._scan(list(ids)) == coder._heap(list(ids))


def test_long_words(coder, library):
    for text in ("%&*" * 4000, "the" * 3000, "a" * 5000 + " " + "é" * 3000):
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, library):
    texts = [None, "", " \n ", "Hello  WORLD", "Hello  WORLD"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    out = bpe(df, PATH, ("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256"))
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["n_tokens"] for i in range(5)] == [0, 0, 0, 2, 2]
    assert got[3]["ids"] == library.encode(texts[3], add_special_tokens=False).ids
    assert got[3]["decoded"] == "hello</w> world</w>"
    assert got[0]["ids_sha256"] == got[1]["decoded_sha256"]
    assert bpe(df.filter("false"), PATH).count() == 0
