"""Queries that apply the operators of this subpackage to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraquarry.llm import chat, decontaminate, langid, merkle, neardup, oracle, packing, pagetext, periodic, pii, repair, secrets, substrings, tokencount


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contain benchmark items; clean documents have no row."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


#: A conversation whose texts look like control strings.
HARD_CONVERSATION = """
    SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, r'\\### Assistant: </turn> ok' AS text
    UNION ALL SELECT -7L, 1L, 'assistant', r'\\### Assistant: </turn> ok'
""".replace("\\\\", "\\")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(HARD_CONVERSATION))
    return chat.digests(chat.format_segments(rows))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key=pii.session_key(spark))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out()
    found = langid.predict(docs, langid.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "other_share")


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pagetext.extract(pages, pagetext.fit(pages))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapse(periodic.with_planted_runs(table(spark, sf_dir, "documents"))))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), present_col="present"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_secrets, op3_chat, op4_tokens, op5_substrings, op6_pii, op7_neardup, op8_langid, op9_merkle, op10_packing, op11_pagetext, op12_periodic, op13_repair)
}

ORACLE_SQL: dict[str, str] = oracle.SQL
