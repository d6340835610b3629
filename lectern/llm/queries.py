"""The thin queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import chat, decontaminate, jaccard, langid, licenses, mixing, periodic, pseudo_likelihood, quality, secrets, spelling, token_ids, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(turns.unionByName(extra)))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.read(warc.write(_table(spark, sf_dir, "pages")))
    return got.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *secrets.digest_columns())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ratio = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.assess(docs, ratio).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.fit(docs))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spelling.spelling_variants(_table(spark, sf_dir, "documents"), deletions=31)
    return got.select("word", "form", "root", "n", "n_near", "form_n")


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    got = token_ids.read(token_ids.write(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json")))
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic.periodic_runs(docs).select("doc_id", *periodic.digest_columns())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_chat_format, op3_ngram_jaccard, op4_warc, op5_secret_scan, op6_quality_rules, op7_license_scan, op8_lm_score, op9_decontaminate, op10_language_id, op11_spelling_variants, op12_token_ids, op13_periodic_runs)}
