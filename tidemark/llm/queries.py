"""One query per operator over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, mixing, neighbours, negatives, token_files, toxicity
from .language import identify
from .near_dup import near_duplicates
from .packing import pack
from .quality import quality
from .spelling import spelling_variants
from .suffix_sort import remove_repeats
from .suffix_tree import dedup_substrings


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer() -> str:
    """The vocabulary file of the packing contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup_substrings(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"), size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    pieces, facts = mixing.mix(_table(spark, sf, "documents"))
    return mixing.taken(pieces, facts).select("doc_id", "size", "source_size", "target", "taken")


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_table(spark, sf, "documents"), tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_rotated_one_bit_codes(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(_table(spark, sf, "embeddings"))


def op4_perspective_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return chat.rotate(_table(spark, sf, "conversations"))


def op6_toxicity_chain(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels, TOXICITY), list(TOXICITY))


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality(_table(spark, sf, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return identify(_table(spark, sf, "documents"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.mine(negatives.quantised(negatives.moved_labels(_table(spark, sf, "embeddings"))))


def op12_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf, "documents"), tokenizer())


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(_table(spark, sf, "documents"), drop_every=199)


#: Categories in the order of the chain, as expressions over the labels.
TOXICITY = {"low_quality": "1 - quality", "toxic": "toxic"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rotated_one_bit_codes": op1_rotated_one_bit_codes,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_perspective_rotation": op4_perspective_rotation,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_toxicity_chain": op6_toxicity_chain,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_files": op12_token_files,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL: dict[str, str] = {"op1_rotated_one_bit_codes": neighbours.SQL, "op4_perspective_rotation": chat.SQL, "op11_hard_negatives": negatives.SQL}
