"""The queries of this subpackage: opN_<name> applies operator N to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundforge.llm import alignment, decontamination, filter_audit, html_extract, langid, media, ngram_join, oracles, packing, pii, quality_rules, sentencepiece_codec, sharding, toxicity
from roundforge.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Documents whose crc32(doc_id as text) leaves this remainder are held out: (modulus, remainder).
LANG_FOLD = (4, 2)
TOXIC_FOLD = (5, 0)


def held_out(fold: tuple[int, int], key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.fit())


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def _only(kind: str):
    return lambda x: F.when(x == kind, x)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.fit(spark))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    added = [F.size(F.array_compact(F.transform("added.kind", _only(k)))).cast("long").alias(f"n_added_{k}") for k in pii.KINDS if k != "card"]
    return found.select("doc_id", *counts, F.sha2(pii.digest(pii.base_only()), 256).alias("base_sha256"), pii.digest(pii.all_spans()).alias("spans"), F.size("added").cast("long").alias("n_added"), *added)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(LANG_FOLD)))
    return langid.predict(docs, model).select("doc_id", held_out(LANG_FOLD).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: the square roots of the sources' token counts, so that a source with a third of the table doesn't fill a third of each window."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.PackConfig(tokenizer_path(), flatten=0.5))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "depleted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out(TOXIC_FOLD)))
    return toxicity.score(docs, model).select("doc_id", held_out(TOXIC_FOLD).alias("held_out"), "score", "predicted", "n_hits")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    made = (op1_html_extraction, op2_sentencepiece, op3_ngram_jaccard_join, op4_pii, op5_language_id, op6_packing, op7_sharding, op8_media_columns, op9_quality_rules, op10_toxicity, op11_decontamination, op12_alignment, op13_filter_audit)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": oracles.OP3, "op9_quality_rules": oracles.OP9, "op11_decontamination": oracles.OP11, "op13_filter_audit": oracles.OP13}
