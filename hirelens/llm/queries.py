"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.session import read_table

from . import apportion, chat_grammar, kneser_ney, language_spans, packing, periodic_runs, projection_search, secret_battery, simhash_pigeonhole, slots, template_decontam, token_spans, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op2_slot_shards", slots.oracle())
def op2_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard(read_table(spark, sf_dir, "documents"))


@query("op3_apportioned_mix", apportion.oracle())
def op3_apportioned_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix(read_table(spark, sf_dir, "documents"))


@query("op9_simhash_components")
def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pigeonhole.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op4_kneser_ney_quality")
def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_template_decontamination")
def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), veto=False, run=template_decontam.RUN)


@query("op10_secret_battery")
def op10_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_battery.secrets(read_table(spark, sf_dir, "documents"))


@query("op6_chat_round_trip")
def op6_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_grammar.digests(chat_grammar.format_conversations(rows.union(chat_grammar.hostile(spark))))


@query("op8_language_spans")
def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_spans.identify(read_table(spark, sf_dir, "documents"))


@query("op5_token_spans")
def op5_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.count(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op1_projected_neighbours")
def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_search.nearest(read_table(spark, sf_dir, "embeddings"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def looped_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's loops: a text whose id's crc32 is divisible by ten repeats its words from a place on. A null id has none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.detect(read_table(spark, sf_dir, "documents"), looped_words))


@query("op11_differencing_packs")
def op11_differencing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pieces(read_table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_to")
