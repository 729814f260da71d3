"""Character n-grams of the words of texts: of a batch's words in Python, and their counts over a whole table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (3, 4, 5)

#: Words that a worker counts at once; cells (text, gram) that it marks at once.
SLICE_WORDS, CELLS = 1 << 19, 1 << 24


def cut_words(words: Sequence[str], sizes: Sequence[int] = SIZES) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(which word, which gram) of all grams of the given words in marks ^ and $, by word, and the distinct grams.

    Words are ASCII. One that is shorter than a gram gives one cut-off gram.
    """
    width = max(8, *sizes)
    line = np.frombuffer("".join(f"^{w}$" for w in words).encode("ascii") + bytes(width), np.uint8)
    length = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.cumsum(length) - length
    many = np.stack([np.maximum(length - n + 1, 1) for n in sizes], axis=1)
    runs = many.ravel()
    inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    owner = np.repeat(np.arange(len(words)), many.sum(axis=1))
    size = np.minimum(np.repeat(np.tile(sizes, len(words)), runs), length[owner])
    cells = np.arange(width)
    # A gram is a row of bytes with zeros behind; up to eight of them are compared as one number.
    cuts = np.where(cells < size[:, None], line[(begin[owner] + inside)[:, None] + cells], np.uint8(0))
    found, which = np.unique(cuts.view(np.uint64 if width == 8 else f"S{width}").ravel(), return_inverse=True)
    return owner, which.ravel(), found.view(f"S{width}").tolist()


def spread(chosen: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of all that the chosen words own, of which word w owns ``count[w]`` from ``first[w]`` on."""
    many = count[chosen]
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[chosen], many)


def _counted(batch: pa.RecordBatch, sizes: Sequence[int]) -> pa.RecordBatch:
    """(gram, n, docs) of a slice's rows; ``named`` says whether a row counts as a document."""
    lists, named = batch.column("words"), batch.column("named").to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    said, n_words = coded.indices.to_numpy(), len(coded.dictionary)
    owner, gram, names = cut_words(coded.dictionary.to_pylist(), sizes)
    count = np.bincount(owner, minlength=n_words)
    first = np.cumsum(count) - count
    n = np.bincount(gram, weights=np.bincount(said, minlength=n_words)[owner], minlength=len(names)).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    pair = np.unique(row[named[row]] * np.int64(n_words) + said[named[row]])
    row, said = pair // n_words, pair % n_words
    docs = np.zeros(len(names), np.int64)
    step = max(1, CELLS // len(names))
    for k in range(0, len(lists), step):
        low, high = np.searchsorted(row, (k, k + step))
        held = np.zeros((min(step, len(lists) - k), len(names)), bool)
        held[np.repeat(row[low:high] - k, count[said[low:high]]), gram[spread(said[low:high], first, count)]] = True
        docs += np.count_nonzero(held, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)], names=["gram", "n", "docs"])


def _in_slices(sizes: Sequence[int], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy())
            start, done = 0, 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(upto, done + most, "right")))
                if upto[end - 1] > done:
                    yield _counted(batch.slice(start, end - start), sizes)
                start, done = end, upto[end - 1]

    return run


def grams(word: Column, sizes: Sequence[int] = SIZES) -> Column:
    """All grams of a word, as ``cut_words`` has them."""

    def cuts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word) + 3 - n, F.lit(1))), lambda i: F.substring(F.concat(F.lit("^"), word, F.lit("$")), i, F.lit(n)))

    return F.concat(*(cuts(n) for n in sizes))


def gram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sequence[int] = SIZES, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(gram, n, docs): how often a gram occurs, and in how many documents by their ids, of which null is none.

    A slice of texts gives a row for each of its grams, and only these are shuffled. Rows of one id are
    one document: what they say more than once is taken off again, with work for such rows only.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9]+"), 0).alias("words"))
    said = rows.select(F.col("id").isNotNull().alias("named"), "words").mapInArrow(_in_slices(sizes, slice_words), "gram string, n long, docs long")
    repeated = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("rows")).where("rows > 1 and id is not null").select("id")
    if not repeated.isEmpty():
        own = F.array_distinct(F.flatten(F.transform(F.array_distinct("words"), lambda w: grams(w, sizes))))
        held = rows.join(repeated.hint("merge"), "id", "left_semi").select("id", F.explode(own).alias("gram"))
        again = held.groupBy("id", "gram").agg(F.count("*").alias("times")).where("times > 1")
        said = said.union(again.select("gram", F.lit(0).cast("long"), 1 - F.col("times")))
    return said.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
