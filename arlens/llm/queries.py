"""Registered queries of the training-data operators: each applies its operator,
with production parameters, to a whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arlens.llm import bands, bpr, decontam, editcount, packing, parity, quality, recurrent, resampling, secrets, sharding, spelling, toxicity
from arlens.llm.common import table


def _fold(mod: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op1_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; fold 2 of 4 is held out of the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(_fold(4) != 2).select("doc_id", F.col("quality").alias("label")))
    scored = docs.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.KEEP).cast("int"))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of the rules, the compression figures and the verdict."""
    docs = table(spark, sf_dir, "documents")
    r = F.col("r")
    failed = bands.base_failed(r)
    return docs.select("doc_id", bands.text_rules(F.col("text")).alias("r")).select(
        "doc_id", r["n_words"].alias("n_words"), r["word_chars"].alias("word_chars"), r["n_symbols"].alias("n_symbols"),
        r["n_dup_lines"].alias("n_dup_lines"), r["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & r["band_ok"]).alias("kept"), r["zstd_ratio"].alias("zstd_ratio"), r["n_chunks"].alias("n_chunks"), r["bad_chunks"].alias("bad_chunks"),
    )


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's shingle set and the smallest linked doc_id."""
    return parity.near_duplicates(table(spark, sf_dir, "documents")).withColumn("n_shingles", F.col("n_shingles").cast("long"))


def op4_bucket_pointer_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document removed as parts of repeated 400-byte strings."""
    found = bpr.repeated_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.sha2("kept", 256), F.col("text_sha256")).alias("kept_sha256"))


def op5_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after an edit taken from its own
    columns: a note of language and source replaces part of the middle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.floor(F.length(text) / 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), start.alias("start"), (start + F.col("doc_id") % 40).alias("end"), F.concat_ws(" ", F.lit(" note:"), "lang", "source").alias("new"))
    treed = docs.withColumn("tree", editcount.token_tree(F.col("text")))
    edited = treed.withColumn("after", editcount.apply_edit(F.col("text"), F.col("tree"), F.col("start"), F.col("end"), F.col("new")))
    return edited.select("doc_id", editcount.count(F.col("tree")).alias("n_tokens"), editcount.count(F.col("after")).alias("n_tokens_after"), F.col("after.encoded").alias("chars_encoded"), F.length("after.text").cast("long").alias("n_chars_after"))


def op6_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; fold 0 of 5 is held out of the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(_fold(5) != 0).select("doc_id", F.col("toxic").alias("label")))
    scored = docs.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each packed piece of a document."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each document, base kinds counted and hashed."""
    spans = F.col("s")
    docs = table(spark, sf_dir, "documents").select("doc_id", secrets.secret_spans(F.col("text")).alias("s"))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["kind"].isin(*secrets.BASE))
    return docs.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(spans).alias("spans"))


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near-equal bytes."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    out = sharding.shard_by_bytes(docs, F.col("h"), F.col("size"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item that a document holds."""
    return decontam.found_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op11_trie_node_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, form and root."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards ``benchmark``."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; fold 2 of 7 is held out of the fit."""
    held_out = F.coalesce(_fold(7) == 2, F.lit(False))
    return recurrent.score_documents(table(spark, sf_dir, "documents"), ~held_out, held_out)


QUERIES = {f.__name__: f for f in (op1_quadratic_discriminant, op2_compression_bands, op3_parity_sketch_join, op4_bucket_pointer_refinement, op5_edit_aware_counts, op6_kneser_ney_toxicity, op7_best_fit_packing, op8_structural_secrets, op9_sampled_splitters, op10_block_max_wand, op11_trie_node_pairs, op12_importance_resampling, op13_gated_recurrent_lm)}
ORACLE_SQL: dict[str, str] = {}
