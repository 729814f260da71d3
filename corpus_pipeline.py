"""A corpus pipeline of five stages: quality, near-dedup, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirstone.llm import binary, decontam, mixing, neardup, quality
from weirstone.llm._spark import shared_dir
from weirstone.llm.queries import model_path, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts.

    A null text is scored as an empty one, and repeated rows score alike. Without labels, or without
    documents, nothing can be told apart and all documents stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select("row.*")


#: Five-word shingles at 0.8. A pair there shares one of 13 ** 2 tables with probability 0.9998; of 10 ** 2 it would be 0.9985.
NEAR = {"shingle": 5, "threshold": 80, "bands": 13}


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, or one of a group without any.

    Repeated rows of an id and a text count as one document; a text without words is in no group.
    """
    return neardup.one_of_each(docs, **NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of ten consecutive words of a benchmark item (or of a whole shorter one).

    Documents without words or without an id stay like any other, repeated rows stay or go together,
    and items without words match nothing.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: the pieces of its blocks, and twice what it takes twice.

    ``n_chars`` is that of a piece; all other columns are the document's. Texts without words have no
    pieces, a null source is a source of its own, and repeated rows each add their words.
    """
    return mixing.mixed(docs, mixing.mix(docs))


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every record of the binary shards, with its slot, place and owner, as read from the files.

    Each row of ``docs`` has sequences of its own, repeated rows and rows without an id too; null and
    empty texts have none. Without any sequence nothing is written.
    """
    return binary.materialise(docs, model_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: The classifier and the permutations can't be put in SQL.
ORACLE_SQL = None
