"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import fill_in_middle, licenses, merkle, minhash, quality, toxicity, url_filters, warc
from lodestar.llm.common import new_folder, sized, table
from lodestar.llm.decontamination import benchmark_matches
from lodestar.llm.mixing import mix_copies
from lodestar.llm.sharding import external_shuffle, write_shards
from lodestar.llm.simhash import simhash_groups
from lodestar.llm.token_counts import token_counts


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.files_of(table(spark, sf_dir, "documents"))
    return licenses.license_scan(files).select("doc_id", "own_license", "own_score", "license", "inherited_from")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    decided = url_filters.url_filter(url_filters.captures_of(pages), url_filters.entries_of(pages))
    return decided.select("page_id", "fetched_at", "blocked", "pattern", "valid_from")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.quality_verdicts(docs).select("doc_id", *quality.METRICS, "base_failed", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "shards")
    write_shards(external_shuffle(table(spark, sf_dir, "documents")), at)
    return spark.read.parquet(at).select(
        "doc_id",
        (sized("text") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_groups(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = fill_in_middle.fim_restored(fill_in_middle.fill_in_middle(docs))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim_output", 256).alias("output_sha256"), F.sha2("restored_text", 256).alias("restored_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    proofs = merkle.merkle_proofs(docs, tampered={"text": merkle.tampered_text()})
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_url_filters": op4_url_filters,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_minhash": op11_minhash,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.ORACLE,
    "op2_warc": warc.ORACLE,
    "op4_url_filters": url_filters.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op11_minhash": minhash.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
