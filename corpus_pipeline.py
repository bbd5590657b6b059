"""A corpus pipeline of five stages: language ID, line dedup, near-dedup, mixing, tokens.

Defined cases, for all stages: a null text goes with the language stage, and so do texts
without a letter; empty tables pass through; very long texts are gone through whole;
repeated rows are decided alike, but that one of each group of near-duplicates stays;
null doc_ids are never near-duplicates; other columns than those of documents are
carried along under any name (with dots, or one that a stage uses itself), only those
that the last stage adds give way.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm import bpe, langid, line_dedup, minhash, mixing
from tabguard.llm.common import cut, shielded, table

#: No SQL: the language model, the byte-pair merges and the hashes have no twin there.
ORACLE_SQL = None
#: Near-duplicates share 80 percent of their shingles of five words; 40 bands of 5 rows lose such a link with a chance of 1.3e-7.
PERCENT, SHINGLE, BANDS, ROWS = 80, 5, 40, 5
#: A text of this many characters is in no learned language if none has half of the probability; a shorter one tells too little.
ENOUGH_CHARS, LEAST_SCORE = 64, 0.5
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), which is to return these columns, on columns that clash with nothing."""
    return shielded(docs, DOCUMENT, (), lambda d: work(d).select(*d.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, whose prediction fills a lang that isn't given.

    Texts without a letter are rejected, and only those if there is nothing to learn from.
    """
    model = langid.fit(docs)
    if model is None:  # no row to learn from
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    unsure = (F.col("score") < LEAST_SCORE) & (F.length("text") >= ENOUGH_CHARS)
    known = lambda d: langid.identify(d, model).filter((F.col("lang_pred") != "und") & ~unsure)
    return _stage(docs, lambda d: known(d).withColumn("lang", F.coalesce("lang", "lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere; scraps of documents go."""
    left = lambda d: line_dedup.line_dedup(d).filter("kept")
    return _stage(docs, lambda d: left(d).withColumn("n_chars", F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near-duplicates."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), PERCENT, SHINGLE, BANDS, ROWS)
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return _stage(docs, lambda d: d.join(gone, F.col("doc_id") == F.col("gone"), "left_anti"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document in the mix."""
    copies = F.explode(F.array_repeat(F.lit(1), F.col("n_copies"))).alias("copy")
    return _stage(docs, lambda d: mixing.mix(d).select("*", copies))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their tokens and the text that these stand for."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.bpe(docs, path, ("ids", "n_tokens", "decoded")).drop("text")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing", mixture),
    ("BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; what each returns is written before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
