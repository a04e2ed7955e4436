"""Queries of the numbered operators: thin steps from the given tables to an operator and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.llm import (
    bpe_transducer,
    collocations,
    decontamination,
    mixing,
    neighbours,
    quality,
    resharding,
    secret_scan,
    simhash,
    token_files,
    tokens,
    toxicity,
    word_runs,
)
from stringwatch.llm.records import alarms, as_alarms, as_documents, table
from stringwatch.llm.sql import MIXING

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_CHECKS: dict[str, str] = {}


TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def llm_query(name: str, sql: str | None = None):
    def register(function):
        LLM_QUERIES[name] = function
        if sql is not None:
            LLM_CHECKS[name] = sql
        return function

    return register


def equal_weights(records: DataFrame) -> DataFrame:
    """Every station is wanted alike."""
    return records.select("station_name").distinct().withColumn("weight", F.lit(1.0))


@llm_query("op1_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(tokens.alarm_token_counts(alarms(spark, sf_dir), tokenizer_file()))


@llm_query("op9_token_files")
def token_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_alarm_tokens(alarms(spark, sf_dir), tokenizer_file(), token_files.token_path(spark))
    return as_documents(token_files.read_alarm_tokens(spark, path, with_ids=False))


@llm_query("op2_decontamination")
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = as_alarms(table(spark, sf_dir, "benchmark"))
    return as_documents(decontamination.contaminated_alarms(alarms(spark, sf_dir), items))


@llm_query("op6_near_copies")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(simhash.alarm_near_copies(alarms(spark, sf_dir)))


@llm_query("op10_secrets")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(secret_scan.alarm_secrets(alarms(spark, sf_dir), tokenizer_file()))


@llm_query("op8_source_mixing", MIXING)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = alarms(spark, sf_dir)
    mixed = as_documents(mixing.mix_alarm_sources(records, equal_weights(records)))
    return mixed.select("doc_id", "source", "copy_no", "shuffle_key", F.md5("text").alias("text_md5"))


@llm_query("op7_nearest_profiles")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "embeddings").withColumnsRenamed({"vec_id": "device_no", "embedding": "current_profile"})
    found = neighbours.nearest_profiles(profiles, F.col("device_no") % 100 == 0)
    return found.withColumnRenamed("device_no", "vec_id")


@llm_query("op4_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(quality.alarm_quality(alarms(spark, sf_dir), as_alarms(table(spark, sf_dir, "labels"))))


OLD_SHARDS, NEW_SHARDS = 16, 24


def old_shard() -> Column:
    """Where alarms lie before resharding: stations are dealt to shards, so sizes are uneven."""
    return F.pmod(F.crc32("station_name"), F.lit(OLD_SHARDS))


@llm_query("op3_resharding")
def resharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = resharding.reshard_alarms(alarms(spark, sf_dir), old_shard(), NEW_SHARDS)
    return as_documents(placed).select(
        "doc_id",
        resharding.row_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@llm_query("op5_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(toxicity.alarm_toxicity(alarms(spark, sf_dir), as_alarms(table(spark, sf_dir, "labels"))))


@llm_query("op11_bpe_transducer")
def bpe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = bpe_transducer.alarm_token_ids(alarms(spark, sf_dir), tokenizer_file(RANKS), public_tokenizers.PATTERN, decoded=True)
    return as_documents(ids).select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded_name", 256).alias("decoded_sha256"),
    )


def with_planted_runs(records: DataFrame) -> DataFrame:
    """In a tenth of all messages the words from some place on repeat, as the contract of op12 says."""
    words, n = F.array_remove(F.split("alarm_name", "[ \t-\r]+"), ""), F.size("_words")
    tail = n - F.col("_a")
    return (
        records.withColumn("_h", F.crc32(F.col("alarm_event_id").cast("string")))
        .withColumn("_g", F.expr("_h div 10"))
        .withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
        .withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
        .withColumn("_p", (F.lit(1) + F.floor(tail / (F.lit(3) + F.col("_g") % 8))).cast("int"))
        .withColumn("_copies", F.ceil(tail / F.col("_p")).cast("int"))
        .withColumn(
            "alarm_name",
            F.when(
                F.col("_a").isNotNull(),
                F.array_join(
                    F.concat(
                        F.slice("_words", F.lit(1), F.col("_a")),
                        F.slice(F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.col("_copies"))), F.lit(1), tail),
                    ),
                    " ",
                ),
            ).otherwise(F.col("alarm_name")),
        )
        .drop("_h", "_g", "_words", "_a", "_p", "_copies")
    )


@llm_query("op12_word_runs")
def word_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = as_documents(word_runs.alarm_word_runs(with_planted_runs(alarms(spark, sf_dir))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed_name", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_name", 256).alias("collapsed_sha256"),
    )


@llm_query("op13_collocations")
def phrase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = alarms(spark, sf_dir).withColumn("alarm_code", F.coalesce("alarm_code", F.lit("und")))
    found = collocations.alarm_phrases(records).withColumnsRenamed(
        {"occurrences": "a", "first_occurrences": "l", "rest_occurrences": "r", "words": "n"}
    )
    return as_documents(found).withColumn("rank", F.col("rank").cast("bigint"))
