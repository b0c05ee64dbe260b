"""The queries of this subpackage, each over its whole table; SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm import bpe, decontaminate, hard_negatives, importance, katz, language, line_dedup, media, mixing, simhash, site_quality, token_planes, warc
from itemloom.llm.common import documents, id_remainder


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and repeated ids are rows like others; labels of a repeated id count by their largest value."""
    return mixing.mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have fingerprint zero; repeated rows stay; a null id names no component unless it has no other."""
    return simhash.simhash_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id", "n_copies")


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages there."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"))
    return site_quality.site_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are one frame of spaces; repeated rows are files of their own."""
    probed = media.media_digest(media.probe_media(media.write_media(documents(spark, sf_dir))))
    return probed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "key_starts", "key_ends")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a passage have no row; null texts hold nothing; repeated rows of an id are one document."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and texts without letters are und, with score 0; ids play no part in predictions."""
    docs = documents(spark, sf_dir)
    profiles = language.fit_profiles(docs.filter(id_remainder("doc_id", 3) != 1))
    found = language.predict_language(docs, profiles)
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are one end; equal texts have equal scores; a null id counts as the text '' when rows are held out."""
    docs = documents(spark, sf_dir)
    model = katz.fit(docs.filter(id_remainder("doc_id", 5) != 1))
    held_out = (id_remainder("doc_id", 5) == 1).alias("held_out")
    return katz.score(docs, model).select("doc_id", held_out, "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no lines; rows of one id and different texts are documents of their own, and so are rows without an id."""
    cut = line_dedup.line_dedup(documents(spark, sf_dir))
    return cut.select("doc_id", "n_lines", "n_dropped", F.col("partners").alias("n_partners"), F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are the end id alone; null ids come first, repeated ones in order of a hash of their text."""
    return token_planes.read_token_files(token_planes.write_token_files(documents(spark, sf_dir)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; a row without a page_id revisits the smallest id of its payload, if there is one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.read_archives(warc.write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no ids and decode to ''; repeated rows and null ids are rows like others."""
    return bpe.digests(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id's label is moved first. Rows with nulls or non-finite components take no part; repeated rows are rows of their own."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no features and weight 0; repeated rows and null ids are rows like others, null ids last among ties."""
    found = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("doc_id").cast("long"), "n_features", "weight", "score", F.col("rank").cast("long"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_site_quality, op4_media, op5_decontaminate, op6_language, op7_katz, op8_line_dedup, op9_token_planes, op10_warc, op11_bpe, op12_hard_negatives, op13_importance)}

ORACLE_SQL: dict[str, str] = {"op5_decontaminate": decontaminate.SQL, "op12_hard_negatives": hard_negatives.SQL}
