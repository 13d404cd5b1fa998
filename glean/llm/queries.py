"""The registered corpus queries: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.llm import chat, cube, decontam, fm, hilbert, langid, license, packing, repair, simhash, sitetree, squares, winnow
from glean.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, a row for each such pair."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op4_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document along the Hilbert curve."""
    return hilbert.shards(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return fm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return winnow.near_next(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and accepted license templates of every document."""
    found = license.license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
    )


def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return cube.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2,048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op12_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, and the digest of its text without the repeats."""
    return squares.run_digests(squares.repeats(squares.damaged(table(spark, sf_dir, "documents"))))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest structural repair of every damaged conversation."""
    return repair.repair_report(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_decontaminate": (op1_decontaminate, None),
    "op2_language_id": (op2_language_id, None),
    "op3_site_tree": (op3_site_tree, None),
    "op4_hilbert": (op4_hilbert, None),
    "op5_simhash": (op5_simhash, None),
    "op6_quality": (op6_quality, None),
    "op7_winnowing": (op7_winnowing, None),
    "op8_license_scan": (op8_license_scan, None),
    "op9_cube_mix": (op9_cube_mix, None),
    "op10_chat": (op10_chat, chat.ORACLE_SQL),
    "op11_packing": (op11_packing, None),
    "op12_squares": (op12_squares, None),
    "op13_repair": (op13_repair, None),
}
