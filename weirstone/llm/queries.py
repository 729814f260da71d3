"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.llm import binary, capfilters, chat, decontam, divergence, licenses, mixing, neardup, oracles, quality, sessions, shards, tokens, topk


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.windows(turns.union(more)))
    spelt = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(spelt).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), "formatted_chars")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["base"])
    sure = F.filter("spans", lambda x: x["base"] | (x["score"] >= 0.8))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
    places = F.transform(base, lambda x: x["first"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), labels(base).alias("base_labels"), labels(sure).alias("labels"), score.alias("score"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"), [1.0] * 40, grown_weight=1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), share=1.5, limit=2.0))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontam.find_matches(docs.select("doc_id", "text"), benchmark, window=10, with_spans=False)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=85, bands=10)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), model_path(), carry=["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.materialise(table(spark, sf_dir, "documents"), model_path())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, labels), carry=["doc_id"])
    return scored.select("row.doc_id", quality.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op11_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.sessions(table(spark, sf_dir, "clicks"))
    path = F.array_join(F.col("path").cast("array<string>"), ",")
    return found.select(*sessions.COLUMNS[:-1], F.sha2(path.cast("binary"), 256).alias("path_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_license_scan, op3_top_k, op4_rendezvous_shards, op5_mix_sources, op6_decontaminate, op7_near_duplicates, op8_token_counts, op9_sequences, op10_quality, op11_gap_sessions, op12_source_divergence, op13_near_vectors)}


def oracle_sql() -> dict[str, str]:
    """The other queries give hashes, draws, scores or token counts that SQL lacks; tests hold them against brute force."""
    return {"op1_chat_format": oracles.CHAT, "op2_license_scan": oracles.LICENSES, "op3_top_k": oracles.TOP_K, "op6_decontaminate": oracles.DECONTAMINATE, "op7_near_duplicates": oracles.NEAR_DUPLICATES, "op11_gap_sessions": oracles.SESSIONS, "op12_source_divergence": oracles.DIVERGENCE, "op13_near_vectors": oracles.NEAR_VECTORS}
