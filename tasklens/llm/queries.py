"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklens.llm import byte_bpe, chat_format, decontaminate, language_id, license_scan, packing, pca_means, simhash_dedup, spelling, suffix_dedup, toxicity, url_filters, voronoi_knn
from tasklens.llm.oracle import ORACLE  # noqa: F401  (the queries' SQL twins)
from tasklens.session import table

#: Host, path and verdict of the registered URL rules (fixed by the query).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector."""
    return voronoi_knn.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0,
                              k=20, scale=64)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash_dedup.hex_digits("fp").alias("fingerprint"),
                        "component_id")


def id_fold(n: int) -> Column:
    """crc32 of the doc_id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; remainder 2 of 4 is held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(id_fold(4) != 2))
    out = docs.withColumn("held_out", F.coalesce(id_fold(4) == 2, F.lit(False)))
    found = out.select("doc_id", "held_out", language_id.language(F.col("text"), model).alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"),
                        F.col("f.score").alias("score"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL by rules and redirect equivalence."""
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired and rendered turns of all conversations."""
    found = chat_format.format_chats(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "sub", "action", "role", "segment")


def tokenizer_file() -> str:
    """Path of the byte-level BPE file of the public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), window=1024)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in an earlier 100-byte string."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], length=100)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in an occurrence of a test phrase."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark"), ["doc_id"], window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; remainder 0 of 5 is held out."""
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, docs.filter(id_fold(5) != 0), table(spark, sf_dir, "labels"))
    held = docs.withColumn("held_out", F.coalesce(id_fold(5) == 0, F.lit(False)))
    found = held.select("doc_id", "held_out", toxicity.toxicity(F.col("text"), index).alias("f"))
    score = F.least(F.greatest(F.col("f.score"), F.lit(0.0)), F.lit(1.0))
    return found.select("doc_id", "held_out", score.alias("score"),
                        (score >= 0.5).cast("int").alias("predicted"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and pasted notices of every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the words one edit apart and their forms."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), spoil=97, shortest=5, least=3)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of what they decode to."""
    import public_tokenizers
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = byte_bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"], ranks, public_tokenizers.PATTERN,
                            decoded="decoded")
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector after three rounds from 16 centroids."""
    assigned, centroids = pca_means.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64, seed=1)
    return pca_means.with_inertia(assigned.drop("verified"), centroids)


QUERIES = {
    "op1_top_k_search": op1_top_k_search,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_language_id": op3_language_id,
    "op4_url_filters": op4_url_filters,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_packing": op6_packing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_license_scans": op10_license_scans,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_centroid_clustering": op13_centroid_clustering,
}
