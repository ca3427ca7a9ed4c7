"""The operators as queries over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm.bktree import simhash_components
from eventlake.llm.chat import CHAT_SQL, render_chats
from eventlake.llm.decontam import leaks
from eventlake.llm.lexical import SEARCH_SQL, search
from eventlake.llm.linededup import dedup_lines
from eventlake.llm.mixing import MIX_SQL, mix_report
from eventlake.llm.neardup import NEAR_SQL, near_duplicates
from eventlake.llm.ngram import lm_scores
from eventlake.llm.quality import quality_scores
from eventlake.llm.rolerepair import repair_report
from eventlake.llm.secretscan import secrets
from eventlake.llm.tokens import token_files
from eventlake.llm.topk import TOP_SQL, top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file of the token outputs; a path is a parameter of the operator itself."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_exact_top_k", TOP_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), by="edits").select("doc_id", "n_lines", "n_dropped", "text")


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op4_mix_sources", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


@query("op6_benchmark_leaks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


@query("op8_chat_format", CHAT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chats(table(spark, sf_dir, "conversations"))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_near_duplicates", NEAR_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_ranked_search", SEARCH_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_role_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


@query("op13_simhash_duplicates")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
