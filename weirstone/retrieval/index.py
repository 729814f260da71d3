"""A vector index as a table with its embedder's fingerprint, exact search, and answers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirstone.functions import dot
from weirstone.retrieval.chunks import citation
from weirstone.retrieval.embed import Embedder, embedded


class FingerprintMismatch(RuntimeError):
    """The index was made by another embedder than the one that asks."""


def build_index(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunks with ``vec`` (of citation and text) and ``fingerprint``."""
    text = F.concat(citation(), F.lit("\n"), F.col("text"))
    return chunks.withColumn("vec", embedded(text, embedder)).withColumn("fingerprint", F.lit(embedder.fingerprint))


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def top_k(rows: DataFrame, vector: Sequence[float], k: int, vec_col: str = "vec", tie: str = "chunk_idx") -> DataFrame:
    """The k rows of highest inner product; each task keeps k, the driver merges k by task. Ties go to the larger ``tie``."""
    asked = F.array(*(F.lit(float(x)) for x in vector))
    return rows.withColumn("score", dot(F.col(vec_col), asked)).orderBy(F.desc("score"), F.desc(tie)).limit(k)


#: Rows and questions that meet in a task.
ROW_BLOCK, QUESTION_BLOCK = 8192, 1024


def _best(k: int, key: tuple, rows: pa.Table, questions: pa.Table) -> pa.Table:
    """(question, id, score): the k best rows of a block for each question of another; ties go to the larger id."""
    ids, asked = rows["id"].to_numpy(), questions["question"].to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    if len(ids) and len(asked):
        matrix = lambda x: x.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
        order = np.argsort(-ids, kind="stable")
        ids, held = ids[order], matrix(rows["vec"])[order]
        scores = matrix(questions["vec"]) @ held.T
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        out.append((np.repeat(asked, best.shape[1]), ids[best.ravel()], np.take_along_axis(scores, best, 1).ravel()))
    question, found, score = (np.concatenate([np.zeros(0, kind), *(x[j] for x in out)]) for j, kind in ((0, np.int64), (1, np.int64), (2, np.float64)))
    return pa.table({"question": question, "id": found, "score": score})


def top_k_many(rows: DataFrame, questions: DataFrame, k: int, vec_col: str = "vec", id_col: str = "id") -> DataFrame:
    """(question, id, score, rank): the k rows of highest inner product for each of many questions (of the same columns).

    Blocks of questions meet blocks of rows in tasks of bounded size, which give back k by question; a
    second level ranks these. Ids are whole numbers; ties go to the larger one. Rows without a vector are left out.
    """
    held = lambda df, name: df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias(name), F.col(vec_col).alias("vec"))
    left, right = held(rows, "id"), held(questions, "question")
    n_left, n_right = 1 + left.count() // ROW_BLOCK, 1 + right.count() // QUESTION_BLOCK
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = left.withColumn("row_block", block("id", n_left)).withColumn("question_block", every(n_right))
    right = right.withColumn("q_block", block("question", n_right)).withColumn("r_block", every(n_left))

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return _best(k, key, a, b)

    found = left.groupBy("row_block", "question_block").cogroup(right.groupBy("r_block", "q_block")).applyInArrow(meet, "question long, id long, score double")
    line = Window.partitionBy("question").orderBy(F.desc("score"), F.desc("id"))
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def search(index: DataFrame, embedder: Embedder, question: str, k: int = 3) -> DataFrame:
    found = index.select("fingerprint").first()
    if found is not None and found[0] != embedder.fingerprint:
        raise FingerprintMismatch(f"the index has {found[0]!r}, the question {embedder.fingerprint!r}: rebuild the index")
    return top_k(index, embedder.embed([question])[0].tolist(), k)


def format_answer(question: str, hits: Sequence) -> str:
    """The best passage with its citation, and where else to look."""
    if not hits:
        return f"Q: {question}\n\nNo relevant passages found."
    cite = lambda h: f"{h['doc_title']} > {h['heading']}"
    best, *rest = hits
    body = "\n".join("    " + line for line in best["text"].splitlines())
    others = "".join(f"\n  - {cite(h)} (score {h['score']:.3f})" for h in rest)
    return f"Q: {question}\n\nA (top passage, score {best['score']:.3f}) [{cite(best)}]:\n\n{body}\n\nOther sources:{others}"
