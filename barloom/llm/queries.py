"""The contract queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chat, chosen_path, decontaminate, jaccard, language, media, mixing, periodic, phrases, suffix, tokens, trie, urls
from barloom.llm.common import saved, ship, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    said = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return said.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(ship(spark), sf_dir, "documents"))
    listed = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return counted.select(
        "doc_id", "n_tokens", F.size("lines").cast("long").alias("n_sections"), F.col("lines_crossing").alias("n_crossing"), F.coalesce(F.array_max("lines.tokens"), F.lit(0)).alias("max_tokens"),
        listed("lines.start").alias("starts_md5"), listed("lines.tokens").alias("tokens_md5"),
        F.size("blocks").cast("long").alias("n_blocks"), F.col("blocks_crossing").alias("n_block_crossing"), listed("blocks.start").alias("block_starts_md5"), listed("blocks.tokens").alias("block_tokens_md5"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return suffix.digests(docs, suffix.dedup(docs))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.load(media.store(media.store_media(table(ship(spark), sf_dir, "documents")))))


#: Conversation -1 of the contract: fixed values.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(probe)))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(ship(spark), sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return phrases.digests(docs, phrases.dedup(docs))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(ship(spark), sf_dir, "documents"))


def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.link_documents(table(ship(spark), sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(table(ship(spark), sf_dir, "documents"), periodic.planted))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = saved(trie.turns_of(table(ship(spark), sf_dir, "conversations")))
    return trie.prefix_trie(trie.rebuild(turns), trie.conversations_of(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_decontamination, op3_token_counts, op4_mixing, op5_suffix_dedup, op6_audio_features, op7_chat_formatting, op8_url_filter, op9_phrase_dedup, op10_jaccard_join, op11_chosen_path, op12_periodic_runs, op13_prefix_trie)
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE,
    "op4_mixing": mixing.oracle(),
    "op13_prefix_trie": trie.ORACLE,
    # marks: 8 + 8 + 7 characters a turn, 9 before them; where any content holds a control string, \\, < and [ take two
    "op7_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sizes AS (
            SELECT *, len(regexp_extract_all(role || text, '[\\<\[]')) AS escaped,
                regexp_matches(role, '<\||<s>|</s>|\[INST\]|\[/INST\]') OR regexp_matches(text, '<\||<s>|</s>|\[INST\]|\[/INST\]') AS held
            FROM rows
        ), chats AS (
            SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                9 + sum(length(role) + length(text) + 23) + CASE WHEN bool_or(held) THEN sum(escaped) ELSE 0 END AS formatted_chars
            FROM sizes GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
            sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM chats""",
}
