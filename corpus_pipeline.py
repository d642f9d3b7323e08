"""The corpus pipeline: toxicity, near-dedup, suffix-array dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainloom.llm.common import materialize, read
from chainloom.llm.neardup import near_duplicates
from chainloom.llm.packing import pack
from chainloom.llm.suffix import cut_repeats
from chainloom.llm.toxicity import reject, train

#: Passages of over 50 words go where they repeat, and strings of so many bytes whatever their words.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 400
#: Per cent of shared shingles from which two documents are near copies of each other.
NEAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the model is learnt from the labelled documents of sf_dir. Null and empty texts stay,
    repeated rows go or stay together, columns of any name are kept, an empty table stays empty."""
    return reject(docs, train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component, and documents without words. Rows without a doc_id stay. Of rows that
    repeat a doc_id and its text one stays; a doc_id with different texts is one document, whose rows stay or go together. Texts
    are only compared where ids repeat at all."""
    gone = near_duplicates(docs, NEAR).where("not kept").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    ids = docs.select("doc_id")
    return out.dropDuplicates(["doc_id", "text"]) if ids.count() != ids.distinct().count() else out


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; those of which nothing but white space is left go."""
    return cut_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS, drop_emptied=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences. Null and empty texts are the end id alone, repeated rows are packed one by one, an empty table
    gives no pieces, other columns are ignored."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: SQL has no Viterbi decoding, suffix arrays or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
