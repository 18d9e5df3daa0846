"""Registered queries of the text operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import collocations, merkle, mixing, near_dedup, oracles, packing, quality_rules, sharding, token_counts, topk_search, toxicity, url_filters, warc, wavelet
from framelake.runtime import Scratch, discard, shared_dir, small_batches, staged, swept, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "by_alias")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.label_columns())
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", F.round("toxicity.p_low_quality", 6).alias("p_low_quality"), F.round("toxicity.p_toxic", 6).alias("p_toxic"), "toxic")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return judged.select("doc_id", *[f"q.{m}" for m in (*quality_rules.MEASURES, "base_failed")], "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    names = [sharding.range_quantised(F.col(c), sharding.name_bounds(docs, c)) for c in ("source", "lang")]
    dimensions = [*names, sharding.log_quantised(F.col("size"))]
    placed = sharding.shard(docs, dimensions, "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    with swept(spark):  # the query's answer is what the archive held, not the archive
        records = warc.read_records(spark, warc.write_archive(table(spark, sf_dir, "pages")))
        return staged(records.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")), path=path)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk_search.quantised(F.col("embedding")).alias("v"))
    return topk_search.top_k(rows, rows.where("id % 20 = 0"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return staged(merkle.verified(table(spark, sf_dir, "documents"), scratch))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return staged(collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"), scratch))


def op13_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    with Scratch(spark) as scratch:
        found = staged(wavelet.read_documents(spark, path, scratch).withColumnRenamed("key", "doc_id"))
    discard(spark, path)  # the query's answer is what the files held, not the files
    return found


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_url_filters, op3_toxicity, op4_packing, op5_quality_rules, op6_mixing, op7_sharding, op8_warc, op9_topk_search, op10_near_dedup, op11_merkle_manifest, op12_collocations, op13_wavelet_shards)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
