"""The thin queries opN_<name>: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, decontaminate, hmm, jaccard, languages, mixing, quality, secrets, styletree, tokens, toxicity, warc
from .common import crc_mod5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.through_archives(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), crc_mod5(F.col("doc_id")) == 1)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.RULES if r.base]

    def of(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secrets.joined(of(*base)), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(table(spark, sf_dir, "documents")).drop("reason")


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod5(F.col("doc_id")) != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op11_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    found = languages.identify(docs, languages.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_benchmark_leaks": op2_benchmark_leaks,
    "op3_warc_records": op3_warc_records,
    "op4_main_text": op4_main_text,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_source_mix": op6_source_mix,
    "op7_hidden_markov": op7_hidden_markov,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_cascade": op9_quality_cascade,
    "op10_toxic_segments": op10_toxic_segments,
    "op11_language_spans": op11_language_spans,
    "op12_token_alignment": op12_token_alignment,
    "op13_collocations": op13_collocations,
}
