"""The numbered operators as registered queries over whole tables, with oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import bitplanes, chunks, decontam, langid, license, lines, negatives, packing
from meterline.llm import ppm, quality, secret_scan, simhash, spelling, tokens
from meterline.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template passages of every whole text; one row per document, null and empty texts have none."""
    return license.scan(table(spark, sf_dir, "documents"))


ORACLE["op1_license_scan"] = license.oracle_sql()


@_register
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every benchmark item in every whole text; one row per passage, repeated rows give theirs each."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of every whole text under the policies base and v1; null texts have no word."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality.verdict("base")).alias("base_failed"), quality.verdict("v1").alias("kept"), "failed")


ORACLE["op3_quality_rules"] = quality.oracle_sql("v1")


@_register
def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, alone and besides others, and what would be kept without it, from the ledger of all documents."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")), "v1")


ORACLE["quality_ablation"] = quality.ablation_sql("v1")


@_register
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all secrets of every whole text; one row per document, null and empty texts have none."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@_register
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, written to files of byte planes and read back; one row per document in ascending id order."""
    manifest = bitplanes.write(table(spark, sf_dir, "documents"), bitplanes.folder(spark),
                               tokens.public_path("byte_bpe_50k.json"))
    return bitplanes.read(manifest)


@_register
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text; texts without a word have fingerprint zero and link like any other."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_register
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text under a model of those that are not held out (one in five is)."""
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out()
    parts = langid.learn(docs.where(~held & F.col("doc_id").isNotNull()), tokens.public_path("piece_bpe_32k.model"))
    return langid.predict(docs, parts).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@_register
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every whole text in a sequence of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokens.public_path("word_bpe_49k.json"))


@_register
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the lines that repeat an earlier one, exactly or nearly; one row per document."""
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@_register
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every whole text that stand earlier in the corpus; one row per passage."""
    return chunks.repeats(table(spark, sf_dir, "documents")).drop("h")


@_register
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the corpus, thinned by one in 97, with their near words, forms and roots."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), thin=97))


@_register
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts under the model of those that are not held out (one in ten is; rows without an id teach nothing)."""
    docs = table(spark, sf_dir, "documents")
    held = ppm.held_out()
    model = ppm.learn(docs.where(~held & F.col("doc_id").isNotNull()))
    return ppm.score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_register
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are moved on by one first."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = negatives.vectors(table(spark, sf_dir, "embeddings"), label=label)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLE["op13_hard_negatives"] = negatives.ORACLE_SQL
