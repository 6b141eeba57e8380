"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of documents.

1. language: rows whose text has no letter, or no learned language with a
   probability of at least a half, go.
2. lines: lines on more than a tenth of a source's documents go from its texts.
3. near_duplicates: of documents joined by shingle similarity of 0.8 or more (five
   words), the one with the smallest id stays.
4. mix: documents are sampled towards the target weights of source, language, topic.
5. pack: token pieces with their places in sequences of 2048.

Defined cases: rows whose text is null, empty or blank go in the first stage, as do all
rows if none has a language to learn from; a null source is a source of its own for
lines and mixing; a null id is never a near-duplicate; repeated rows are near-duplicates
that all have the smallest id and stay together; very long texts are worked on whole;
an empty table passes every stage as an empty one; other columns pass unchanged through
all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rampart.llm.common import materialise
from rampart.llm.language_id import keep_known
from rampart.llm.line_dedup import cleaned
from rampart.llm.minhash import one_of_each
from rampart.llm.mixing import mixed
from rampart.llm.packing import pack, pieces, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs, tokenizer_path()))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", packed)]
#: Language ID and near-duplicate grouping can't be stated in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
