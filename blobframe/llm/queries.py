"""Driver queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.objects import spread
from . import decontaminate


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", *columns: str) -> DataFrame:
    """A table whose texts take long, over all cores."""
    df = table(spark, sf_dir, name)
    return spread(df.select(*columns) if columns else df)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode(docs, path, pattern(), decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import passages

    found = passages.merged(passages.repeated_passages(texts(spark, sf_dir, "documents", "doc_id", "text")))
    spans = F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", "n_passages", "n_words", F.array_join(spans, ",").alias("spans"), "partner_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    df = secrets.find_secrets(texts(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda x: x["kind"] != "literal")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    return df.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count("literal").alias("n_literal"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    scored = quality.score(docs, quality.fit(docs), output="score").drop("text")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(texts(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import common, tokens

    path = common.new_path(spark, "token-files")
    tokens.write(texts(spark, sf_dir, "documents", "doc_id", "text"), path, vocabulary("word_bpe_49k.json"))
    return tokens.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_items",
        F.concat_ws(",", F.col("item_ids").cast("array<string>")).alias("item_ids"),
        F.col("matched").cast("long").alias("matched"),
        F.round("coverage", 6).alias("coverage"),
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    found = html.extract(texts(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import covertree

    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, output="score").select(
        "doc_id",
        (~toxicity.in_training("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_decontaminate": op5_decontaminate,
    "op6_main_text": op6_main_text,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_secret_scan": op10_secret_scan,
}
ORACLE_SQL: dict[str, str] = {"op5_decontaminate": decontaminate.oracle_sql()}
