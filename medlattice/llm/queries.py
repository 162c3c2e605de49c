"""Registered queries of this package: each runs one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlattice.llm import alignment, byte_repeats, conversations, decontaminate, language, licenses, packing, passages, pieces, quality, secrets, vector_search
from medlattice.llm.common import crc_mod, table
from medlattice.llm.simhash import hex_digits, simhash_groups


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "component_size")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on this machine (the same on every executor)."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def held_out(m: int, remainder: int) -> F.Column:
    """A row that nothing is learned from; a null id counts as one."""
    return F.coalesce(crc_mod(F.col("doc_id"), m) == remainder, F.lit(True))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) != 0)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
                       F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       decontaminate.contaminated().alias("contaminated"))


def is_kind(kind: str):
    return lambda span: span["kind"] == kind


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    count = [F.size(F.filter("spans", is_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE_RULES]
    return found.select("doc_id", *count, F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vector_search.top_k(vectors, F.col("vec_id") % 50 == 0)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summaries(conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations"))))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    back = pieces.decode(encoded.drop("text"), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"),
                              keep=lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256)))
    return aligned.withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_language, op3_quality, op4_passages, op5_packing, op6_byte_repeats,
                                   op7_decontaminate, op8_secrets,
                                   op9_vector_search, op10_licenses, op11_conversations, op12_sentencepiece, op13_alignment)}
ORACLES = {"op4_passages": passages.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op9_vector_search": vector_search.ORACLE}
