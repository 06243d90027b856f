"""The corpus pipeline: toxicity, near-duplicates, substrings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents; all but the last return the columns of documents.

Every stage takes null, empty and very long texts, null ids, repeated rows and empty tables; extra columns, of any name, stay with
their rows. What becomes of each is told with the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import mixing, neardup, packing, substring, toxicity
from weftline.llm._arrow import kept, shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold; learnt from the labelled ones among ``docs``.

    Null and empty texts have a score like any text, that of a text without words, and repeated rows have equal scores, so all stay or all go.
    Without labels of both classes the score is a constant.  A score at the threshold is rejected.
    """
    labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels), passing=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on five-word shingles: that with the smallest id.

    Texts without words are linked with nothing and stay.  Rows that repeat an id and its text become one; an id's different texts stay or
    go together.  Rows without an id stay.
    """
    return neardup.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start earlier elsewhere.

    Texts that lose nothing stay as they are, with their spaces, null ones too; of the others the kept words are joined by a space, and a document
    of which no word is left goes.  "Earlier" is by id; rows without an id stay as they are.
    """
    return substring.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Texts without words are never taken.  Repeated rows count each; equal rows are interchangeable, so which of them gives its first words only,
    where a source's target falls into it, makes no difference.  Null sources are one source, the last.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences.

    A null text counts as empty and is a piece of one token; repeated rows are packed each; a text of any length is cut into pieces of 2,048 tokens.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the learnt model nor the tokenizer; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
