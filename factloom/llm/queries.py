"""The queries opN_<name> over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer(PIECES))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import read_token_files, write_token_files

    folder, manifest = write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer(WORDS), end=2)
    return read_token_files(spark, folder, manifest)


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialise
    from .gif import media_column, media_digests

    return media_digests(materialise(media_column(table(spark, sf_dir, "documents", "doc_id", "text")), "media"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import score_texts

    return score_texts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer(PIECES))


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketches import containment, distinct_shingles, edited, printed, resemblance

    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return edited(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(a).alias("fingerprint"), printed(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"),
        containment(a, b).alias("contained_in_edited"), distinct_shingles(a).alias("distinct_shingles"),
    )


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .separators import document_token_counts

    counts = document_token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer(WORDS), end=49407)
    return counts.select("doc_id", "n_tokens")


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, tables=1, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.get("prints", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_texts

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score_texts(docs, fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_sentencepiece_round_trip, op3_token_files, op4_gif_media, op5_warc_index,
        op6_lattice_scores, op7_bottom_k, op8_separator_scan, op9_simhash_groups, op10_toxicity,
    )
}

ORACLES: dict[str, str] = {
    "op5_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
             k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN k.kept <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN k.kept <> d.page_id THEN k.kept END AS refers_to
        FROM d LEFT JOIN k ON k.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
    """,
}
