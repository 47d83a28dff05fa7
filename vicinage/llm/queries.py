"""Registered queries of the corpus operators: thin digests of what each operator returns, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm import (
    chat_format,
    conversation_repair,
    decontaminate,
    embedding_dedup,
    language_id,
    packing,
    secret_scan,
    simhash_dedup,
    source_mix,
    substring_dedup,
    suffix_dedup,
    token_alignment,
    toxicity,
)
from vicinage.llm.common import table

TOKENIZERS = "/opt/tokenizers"   # where the vocabulary files lie that are not on the Python path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return register


def _remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


@query("op1_embedding_dedup")
def embeddings(spark, sf_dir):
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query("op2_suffix_dedup")
def suffixes(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op3_secret_scan")
def secrets(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
made AS (
  SELECT *, 32 + length(regexp_replace(role, e, '\1\\\2\3', 'g')) + length(regexp_replace(text, e, '\1\\\2\3', 'g')) AS size
  FROM rows, (SELECT '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\])' AS e)),
placed AS (
  SELECT *, sum(size) OVER w AS upto, lead(1) OVER w IS NULL AS last FROM made
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR last)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id"""


@query("op4_chat_format", CHAT_SQL)
def chats(spark, sf_dir):
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digest(chat_format.examples(rows)).withColumnRenamed("conv", "conv_id")


@query("op5_source_mix")
def mix(spark, sf_dir):
    found = source_mix.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "epochs")


@query("op6_language_id")
def languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder(4) == 2
    model = language_id.learn(docs.where(~held_out))
    found = language_id.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op7_decontaminate")
def benchmark(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "share", "answer")


@query("op8_toxicity")
def toxic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder(5) == 0
    model = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op9_simhash_dedup")
def simhash(spark, sf_dir):
    found = simhash_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op10_substring_dedup")
def substrings(spark, sf_dir):
    found = substring_dedup.remove_later(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


@query("op11_token_alignment")
def aligned(spark, sf_dir):
    return token_alignment.link_statistics(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query("op12_conversation_repair")
def repaired(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(rows), rows).drop("signature")


@query("op13_best_fit_packing")
def packed(spark, sf_dir):
    found = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
