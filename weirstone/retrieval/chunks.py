"""Markdown documents as chunks, with SQL functions only.

A document's headings (one to three #) cut it into sections. A section above the size budget is cut at
blank lines, never inside a paragraph; each further piece begins with the tail of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirstone.functions import slug, strip

MAX_CHARS, OVERLAP = 1200, 150

#: Heading marks and titles at the start of a line.
HEADING = r"(?m)^(#{1,3})\s+(.*)$"


def pieces(body: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """A section's pieces as an array, in order."""
    paragraphs = F.filter(F.transform(F.split(body, "\n\n"), strip), lambda p: p != "")
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc: Column, paragraph: Column) -> Column:
        full = (acc["held"] != "") & (F.char_length(acc["held"]) + F.char_length(paragraph) + 2 > max_chars)
        tail = F.concat(F.right(acc["held"], F.lit(overlap)), F.lit("\n\n")) if overlap else F.lit("")
        done = F.when(full, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.concat(F.when(full, tail).otherwise(acc["held"]), paragraph, F.lit("\n\n")).alias("held"))

    made = F.aggregate(paragraphs, begin, step, lambda acc: F.concat(acc["done"], F.array(acc["held"])))
    return F.when(F.char_length(body) <= max_chars, F.array(body)).otherwise(F.transform(made, strip))


def chunk_documents(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_slug, text) as chunk_idx, chunk_id, doc_slug, doc_title, heading, text, in document order.

    Text before the first heading is dropped, as are sections without a body. The title is the
    first heading of level one, or the slug.
    """
    marks = F.regexp_extract_all("text", F.lit(HEADING), 1)
    titles = F.transform(F.regexp_extract_all("text", F.lit(HEADING), 2), strip)
    bodies = F.slice(F.transform(F.split("text", HEADING), strip), 2, 1 << 30)
    cut = docs.select("doc_slug", F.arrays_zip(marks.alias("mark"), titles.alias("heading"), bodies.alias("body")).alias("sections"))
    first = F.filter("sections", lambda s: s["mark"] == "#")
    cut = cut.withColumn("doc_title", F.coalesce(F.when(F.size(first) > 0, F.get(first, F.lit(0))["heading"]), F.col("doc_slug")))
    cut = cut.select("doc_slug", "doc_title", F.posexplode("sections").alias("section_no", "s")).where("s.body <> ''")
    cut = cut.select("doc_slug", "doc_title", "section_no", F.col("s.heading").alias("heading"), F.posexplode(pieces(F.col("s.body"), max_chars, overlap)).alias("piece_no", "text"))
    name = F.concat("doc_slug", F.lit("/"), slug(F.col("heading")), F.when(F.col("piece_no") > 0, F.concat(F.lit("-"), F.col("piece_no").cast("string"))).otherwise(""))
    order = F.row_number().over(Window.partitionBy("doc_slug").orderBy("section_no", "piece_no")) - 1
    return cut.select(order.alias("chunk_idx"), name.alias("chunk_id"), "doc_slug", "doc_title", "heading", "text")


def citation() -> Column:
    return F.concat_ws(" > ", "doc_title", "heading")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_slug, text) of a folder's Markdown files."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("doc_slug"), F.col("value").alias("text"))


def chunk_corpus(spark: SparkSession, folder: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    found = chunk_documents(read_markdown(spark, folder), max_chars, overlap)
    if found.isEmpty():
        raise FileNotFoundError(f"no Markdown sections in {folder}")
    return found
