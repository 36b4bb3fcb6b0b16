"""A training-data pipeline over `documents`: five stages, each one of the operators of lodeline.llm.

Each stage takes what its predecessor kept, as written and read again; all but the last return the columns of documents.

Nulls and edges, alike in all stages: a null text is an empty one (the mix takes no words of it, so it ends there), null ids
come after all others, repeated rows are documents of their own unless a stage removes copies, columns besides doc_id, text and
source pass through whatever their names, and an empty table gives none. Each operator's docstring says the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodeline.llm import bpe_codec, line_dedup, mixing, ordinal, simhash
from lodeline.llm._batches import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose chance of the top grade is too small go."""
    return ordinal.select(docs, ordinal.fit(docs, ordinal.graded(table(spark, sf_dir, "labels"))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: later matching lines go."""
    return line_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: identifiers and the text decoded from them, as counts and digests."""
    return bpe_codec.round_trip(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near), ("source mixing", mix), ("bpe encoding and decoding", encode)]
#: None: the classifier, the codec and the digests have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None, folder: str | None = None) -> DataFrame:
    """The stages over documents, each written as Parquet below the folder (by default spark.checkpoint.dir) and read again.

    With a name, the written stages stay in the folder of that name, and a later run takes up after the last whole one;
    without, each goes when the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        for _, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
    at = f"{folder.rstrip('/')}/pipeline-{name or uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        if not (name and _there(spark, f"{at}/{i}/_SUCCESS")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i and not name:
            _path(spark, f"{at}/{i - 1}", lambda fs, path: fs.delete(path, True))
    return STAGES[-1][1](spark, docs, sf_dir)


def _path(spark: SparkSession, name: str, do):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return do(path.getFileSystem(spark._jsc.hadoopConfiguration()), path)


def _there(spark: SparkSession, name: str) -> bool:
    return _path(spark, name, lambda fs, path: fs.exists(path))
