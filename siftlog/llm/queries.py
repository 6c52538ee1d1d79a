"""The registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlog.llm import conversations, decontaminate, html_text, langid, minhash, pieces, pii, quality, queries_sql, ranked, sstable, tokencount, toxicity, warc
from siftlog.llm.common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_digests(table(spark, sf_dir, "documents"), sstable.default_tokenizer(), end_id=2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.derive(warc.responses(table(spark, sf_dir, "pages"))))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_sstable, op3_quality_rules, op4_pii, op5_pieces, op6_language, op7_toxicity, op8_html_text, op9_warc, op10_decontamination, op11_ranked_search, op12_conversation_repair, op13_token_counts)}
#: The others can't be written in SQL: they need a tokenizer, a model, hashing of windows or a parser.
ORACLES: dict[str, str] = {"op11_ranked_search": queries_sql.RANKED, "op12_conversation_repair": queries_sql.CONVERSATIONS}
