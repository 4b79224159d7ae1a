"""Queries of the operators of this package, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.llm import (
    decontamination, exact_copies, exact_topk, hamming_dedup, hard_negatives, line_dedup, quality_ranking,
    source_mixing, suffix_dedup, token_counts, url_lists, warc_bundles, word_runs)
from eventloom.llm.storage import ship_package

TOP_K = 20
VECTOR_SCALE = 64.0
NEGATIVE_SCALE = 256.0
TOKEN_LIMIT = 4096
TOKENIZER = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.whole_vectors(_table(spark, sf_dir, "embeddings"), VECTOR_SCALE)
    return exact_topk.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), TOP_K)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed_documents(_table(spark, sf_dir, "documents"))


def captures_and_entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetch dates for the pages and dated list entries for their hosts and the domains above
    them, both by a rule, as the tables hold none."""
    start = F.to_date(F.lit("2024-01-01"))
    captures = pages.select(
        "page_id", "url", F.date_add(start, ((F.col("page_id") * 7919) % 730).cast("int")).alias("fetch_date"))
    hosts = pages.select("page_id", url_lists.host("url").alias("host")).filter("host is not null")
    rules = hosts.withColumn("rule", F.explode(url_lists.rules_of("host"))).groupBy("rule").agg(
        F.min("page_id").alias("least"), F.count("*").alias("pages"))
    dated = rules.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    entries = dated.select(
        "rule", (F.col("least") * 4 + F.col("k")).alias("entry_id"),
        F.when((F.col("least") + F.col("pages") + F.col("k")) % 2 == 0, "block").otherwise("allow").alias("verdict"),
        F.date_add(start, ((F.col("least") * 31 + F.col("k") * 181 + F.length("rule") * 17) % 730).cast(
            "int")).alias("entry_date"))
    return captures, entries


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.judged_captures(*captures_and_entries(_table(spark, sf_dir, "pages")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_ranking.fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality_ranking.quality_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality_ranking.held_out().alias("held_out"), "score", "predicted")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hamming_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_shingles", "component_id", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(decontamination.benchmark_hits(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_bundles.write_bundles(_table(spark, sf_dir, "pages"))
    return warc_bundles.read_bundles(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return token_counts.over_limit(counts, TOKEN_LIMIT)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_units", "n_removed", "removed_chars", "removed_spans",
                          F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of a tenth of the documents, chosen by a hash of the id, repeat a stretch of
    words from some word on; the others as they are. A null id chooses nothing."""
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("_words")
    made = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), g.alias("_g"))
    made = made.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn(
        "_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    repeated = F.transform(F.col("_words"), lambda word, i: F.when(i < F.col("_a"), word).otherwise(F.get(
        "_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return made.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of most periods, and digests of all runs and of what is left."""
    order = "case when a.length * b.period > b.length * a.period then -1 " \
            "when a.length * b.period < b.length * a.period then 1 " \
            "when a.start < b.start then -1 when a.start > b.start then 1 " \
            "when a.period < b.period then -1 else 1 end"
    best = F.get(F.expr(f"array_sort(runs, (a, b) -> {order})"), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"),
        F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return run_digests(word_runs.periodic_runs(docs))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.labelled_vectors(_table(spark, sf_dir, "embeddings"), NEGATIVE_SCALE, moved)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op13_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_copies(_table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_mix_sources": op2_mix_sources,
    "op3_url_lists": op3_url_lists,
    "op4_quality": op4_quality,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination,
    "op7_warc_bundles": op7_warc_bundles,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_line_dedup": op10_line_dedup,
    "op11_word_runs": op11_word_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_copies": op13_exact_copies,
}
