"""The queries of the corpus operators: each applies one operator, with production
parameters, to its whole table. ORACLES holds DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, common, fingerprints, html_text, licenses, mixing, quality, sharding, similarity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sharding.write_shards(table(spark, sf_dir, "documents"), common.new_path(spark, "shards"), shards=24)
    text = F.col("row.text")
    rows = sharding.slots(
        written,
        F.col("row.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def vocabulary() -> str:
    """The vocabulary file of op3; LAPIDARY_VOCABULARY names another place."""
    import os

    named = os.environ.get("LAPIDARY_VOCABULARY")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


#: (verdict, host, start of the path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: those of the document whose number the path of a page names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.path_of(F.col("url")), r"^/[a-z]+/([0-9]{1,18})(?![0-9])", 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("number"), (F.col("quality") == 0).alias("bad"))
    labelled = pages.select("url", number.alias("number")).join(labels, "number").select("url", "bad")
    judged = urls.judge(pages, labelled, URL_RULES)
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = fingerprints
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a text is digested once: the next document's digests and base come along with its text
    rows = fp.with_next(fp.fingerprint(docs, "text"), "doc_id", ["text", "digests", "base"], ties=["text"])
    rows = rows.withColumn("edited", fp.edited_text(F.col("text"), F.col("next_text")))
    rows = fp.fingerprint(rows, "edited", "edited_")
    near = lambda p: fp.likeness(F.col("digests"), F.col(p + "digests"), F.col(p + "differing"))
    for p in ("edited_", "next_"):
        rows = rows.withColumn(p + "differing", fp.difference(*map(F.col, ("digests", p + "digests", "base", p + "base"))))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        near("edited_").alias("near_edited"),
        near("next_").alias("near_next"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.join(table(spark, sf_dir, "documents"), width=5, threshold=0.8, recall=0.9999)
    return found.select("doc_id", "class_id", "n_links", "set_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs, rules)
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    records = chat.conversation_records(rows.unionByName(more))
    return chat.read_back(chat.format_records(records, "record"), "conv_id")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprints": op6_fingerprints,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_html": op9_html,
    "op10_chat": op10_chat,
}
ORACLES: dict[str, str] = {"op5_license_scan": licenses.oracle()}
