"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

Words are counted per document; the targets of the sources are their weights' shares of all
words, held under three times what a source has, the excess reshared by weight. About
``BLOCKS`` equal-token blocks are apportioned to the sources by highest quotients, each
source's quota is apportioned to its shards in the same way, and every shard then takes
its integer quota: whole passes over its stream of documents, and a seeded selection of
blocks for the rest. A block may cut a document, so ``taken`` counts words.

* Null ids hash as the empty string; a null source is a source of its own, last in order; null texts have size 0.
* Repeated rows are separate documents; a table without words takes nothing; an empty one gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialize, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCKS = 1 << 20
LEAST_BLOCK = 1
SHARDS = 64
DOCS_A_SHARD = 1_000_000
SEED = "mix-1"
STRIDE = 2_147_483_647  # a prime above any number of blocks in a stream


BLANK, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Number of words. Each word and the blanks around it shrink to one character
    (regexp_count would build an array of all words of the text)."""
    shrunk = F.regexp_replace(text, f"{BLANK}*{WORD}+{BLANK}*", "x")
    return F.when(text.rlike(WORD), F.length(shrunk)).otherwise(F.lit(0)).cast("long")


def seeded_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), id_text(), F.lit(":"), F.md5(text_of("text"))))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size and the seeded key that orders documents and deals them to shards."""
    return docs.select("doc_id", "source", words(text_of("text")).alias("size"), seeded_key(seed).alias("key"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> + weight, target. One row a source.

    Ordered by how early a source meets its ceiling, the level at which the uncapped
    ones share what is left is found with running sums.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    ranked = ranked.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                               / F.sum("weight").over(after))
    held = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.coalesce(F.max(held).over(everything), F.lit(0.0))
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("cap", "level")


def sainte_lague(df: DataFrame, group: list[str], key: str, vote: str, seats: str) -> DataFrame:
    """Adds ``quota``: ``seats`` (constant in a group) dealt by the highest quotients
    vote / 1, vote / 3, vote / 5 ...; ties to the smaller key.

    Every quotient above votes / (seats - n/2) surely wins, so those seats are counted at
    once; of the rest a key can win at most its share of n, plus one, and only
    these quotients are ranked. Rows: a small multiple of the number of keys.
    """
    w = Window.partitionBy(*group)
    total, n = F.sum(vote).over(w), F.count("*").over(w)
    sure = F.when((F.col("_t") > 0) & (F.col(seats) > F.col("_n") / 2),
                  F.floor(F.col(vote) * (F.col(seats) - F.col("_n") / 2) / F.col("_t") + 0.5)).otherwise(F.lit(0)).cast("long")
    base = (df.withColumn("_t", total.cast("double")).withColumn("_n", n).withColumn("_sure", sure)
            .withColumn("_left", F.col(seats) - F.sum("_sure").over(w)))
    more = F.when(F.col("_t") > 0, F.ceil(F.col("_n") * F.col(vote) / F.col("_t")) + 1).otherwise(F.lit(1)).cast("int")
    tried = base.withColumn("_j", F.explode(F.sequence(F.lit(1), more))).withColumn(
        "_q", F.col(vote) / (2 * (F.col("_sure") + F.col("_j")) - 1))
    place = F.row_number().over(w.orderBy(F.col("_q").desc(), F.col(key).asc_nulls_last(), "_j"))
    won = tried.withColumn("_won", ((place <= F.col("_left")) & (F.col("_q") > 0)).cast("long"))
    return (won.groupBy(*df.columns).agg((F.max("_sure") + F.sum("_won")).alias("quota")))


def streams(rows: DataFrame) -> DataFrame:
    """One row for each (source, shard): its words, block count, whole passes and blocks of the last pass."""
    loads = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    sources = loads.groupBy("source").agg(F.sum("words").alias("source_size"))
    aimed = targets(sources)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    aimed = aimed.withColumn("block", F.greatest(F.lit(LEAST_BLOCK), F.floor(total / BLOCKS)).cast("long"))
    aimed = aimed.withColumn("seats", F.round(total / F.col("block")).cast("long"))
    per_source = sainte_lague(aimed, [], "source", "target", "seats").withColumnRenamed("quota", "source_quota")
    small = per_source.select(F.col("source").alias("_s"), "source_size", "target", "block", "source_quota")
    both = loads.join(small, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    quota = sainte_lague(both, ["source"], "shard", "words", "source_quota")
    tokens = F.least(F.col("quota") * F.col("block"), F.col("words") * MAX_EPOCHS)
    passes = F.when(F.col("words") > 0, F.floor(tokens / F.col("words"))).otherwise(F.lit(0)).cast("long")
    blocks = F.ceil(F.col("words") / F.col("block")).cast("long")
    return (quota.withColumn("passes", passes).withColumn("blocks", blocks)
            .withColumn("rest", F.least("blocks", F.round((tokens - F.col("passes") * F.col("words")) / F.col("block")).cast("long"))))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Every document with the words the mix takes from it.

    Returns key, doc_id, size, source_size, target (its source's), taken, shard. One
    exchange deals (source, shard) streams; texts stay out of it. A source that holds a third
    of the corpus is spread over all shards.
    """
    rows = materialize(sized(docs, seed), "mix-rows")
    n = F.greatest(F.lit(SHARDS), F.floor(F.count("*") / DOCS_A_SHARD)).cast("long")
    shards = rows.agg(n.alias("n")).first()["n"]
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(shards)))
    quota = streams(rows).select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "source_size", "target",
                                 "block", "passes", "blocks", "rest")
    order = Window.partitionBy("source", "shard").orderBy("key", "doc_id")
    laid = rows.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("start", F.col("end") - F.col("size"))
    j = laid.join(quota, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    # block k of a stream is chosen when a seeded permutation puts it among the first `rest`
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit("/"), F.col("shard").cast("string"))), 1, 7), 16, 10).cast("long")
    j = j.withColumn("offset", offset)
    n_blocks = F.greatest(F.col("blocks"), F.lit(1))
    chosen = lambda k: F.pmod(k * (F.lit(STRIDE) % n_blocks) + F.col("offset"), n_blocks) < F.col("rest")
    overlap = lambda k: F.least(F.col("end"), (k + 1) * F.col("block")) - F.greatest(F.col("start"), k * F.col("block"))
    part = F.aggregate(
        F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block"))), F.lit(0).cast("long"),
        lambda acc, k: acc + F.when(chosen(k), overlap(k)).otherwise(F.lit(0).cast("long")))
    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("passes") * F.col("size") + part)
    return j.select("key", "doc_id", "size", "source_size", "target", taken.alias("taken"), "shard")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard of every document."""
    return mixed(docs, seed).drop("key")


def copies(taken: Column, size: Column, key: Column) -> Column:
    """Whole copies for the words taken: the fraction that a cut leaves is rounded by a seeded draw,
    so that sources keep their words on average and no document exceeds its passes."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("round:"), key)), 1, 8), 16, 10).cast("double") / (1 << 32)
    return F.when(size > 0, F.floor(taken / size + draw)).otherwise(F.lit(0)).cast("int")


def apply(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` as the mix takes them, whole: each row as often as it has copies, or not at all.
    Repeated rows share what was taken from them evenly; documents without words are left out."""
    wanted = mixed(docs, seed).groupBy(F.col("key").alias("__key")).agg(F.avg("taken").alias("t"), F.max("size").alias("n"))
    wanted = wanted.select("__key", copies(F.col("t"), F.col("n"), F.col("__key")).alias("__copies")).where("__copies > 0")
    keyed = docs.withColumn("__key", seeded_key(seed))
    return keyed.join(wanted, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


#: The same mix in DuckDB SQL.
def oracle(docs: str = "documents", seed: str = SEED) -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM {docs}),
rows_ AS (
  SELECT *, ('0x' || key[1:8])::BIGINT % (SELECT greatest({SHARDS}, count(*) // {DOCS_A_SHARD}) FROM sized) AS shard FROM sized),
loads AS (SELECT source, shard, sum(size)::BIGINT AS words FROM rows_ GROUP BY ALL),
sources AS (SELECT source, sum(words)::BIGINT AS source_size FROM loads GROUP BY ALL),
weighed AS (
  SELECT *, 3 * source_size AS cap,
         [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
  FROM sources),
leveled AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aimed AS (
  SELECT source, source_size, total, greatest({LEAST_BLOCK}, total // {BLOCKS}) AS block,
         least(cap::DOUBLE, weight * coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), 0)) AS target
  FROM leveled),
v1 AS (
  SELECT 0 AS grp, source AS key, target AS vote, round(total / block)::BIGINT AS seats FROM aimed),
b1 AS (SELECT *, sum(vote) OVER ()::DOUBLE AS t, count(*) OVER () AS n FROM v1),
s1 AS (SELECT *, CASE WHEN t > 0 AND seats > n / 2 THEN floor(vote * (seats - n / 2) / t + 0.5)::BIGINT ELSE 0 END AS sure FROM b1),
e1 AS (SELECT *, unnest(range(1, 2 + CASE WHEN t > 0 THEN ceil(n * vote / t)::BIGINT + 1 ELSE 1 END - 1)) AS j,
              seats - sum(sure) OVER () AS spare FROM s1),
q1 AS (
  SELECT key AS source, max(sure) + count(*) FILTER (place <= spare AND q > 0) AS source_quota FROM (
    SELECT *, vote / (2 * (sure + j) - 1) AS q,
           row_number() OVER (ORDER BY vote / (2 * (sure + j) - 1) DESC, encode(key) NULLS LAST, j) AS place FROM e1)
  GROUP BY key),
v2 AS (
  SELECT l.source, l.shard, words, a.source_size, a.target, a.block, q.source_quota AS seats
  FROM loads l JOIN aimed a ON l.source IS NOT DISTINCT FROM a.source JOIN q1 q ON l.source IS NOT DISTINCT FROM q.source),
b2 AS (SELECT *, sum(words) OVER w::DOUBLE AS t, count(*) OVER w AS n FROM v2 WINDOW w AS (PARTITION BY source)),
s2 AS (SELECT *, CASE WHEN t > 0 AND seats > n / 2 THEN floor(words * (seats - n / 2) / t + 0.5)::BIGINT ELSE 0 END AS sure FROM b2),
r2 AS (SELECT *, seats - sum(sure) OVER (PARTITION BY source) AS spare FROM s2),
e2 AS (SELECT *, unnest(range(1, 1 + CASE WHEN t > 0 THEN ceil(n * words / t)::BIGINT + 1 ELSE 1 END)) AS j FROM r2),
q2 AS (
  SELECT source, shard, words, source_size, target, block, max(sure) + count(*) FILTER (place <= spare AND q > 0) AS quota FROM (
    SELECT *, words / (2 * (sure + j) - 1) AS q,
           row_number() OVER (PARTITION BY source ORDER BY words / (2 * (sure + j) - 1) DESC, shard, j) AS place FROM e2)
  GROUP BY ALL),
k2 AS (SELECT *, least(quota * block, words * {MAX_EPOCHS}) AS tokens, ceil(words / block)::BIGINT AS blocks FROM q2),
str AS (
  SELECT *, CASE WHEN words > 0 THEN tokens // words ELSE 0 END AS passes,
         least(blocks, round((tokens - CASE WHEN words > 0 THEN tokens // words ELSE 0 END * words) / block)::BIGINT) AS rest,
         ('0x' || md5('{seed}/' || shard)[1:7])::BIGINT AS off
  FROM k2),
laid AS (
  SELECT doc_id, source, shard, key, size, sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS e
  FROM rows_),
pieces AS (
  SELECT l.*, s.source_size, s.target, s.passes, s.block, s.blocks, s.rest, s.off, l.e - l.size AS b
  FROM laid l JOIN str s ON l.source IS NOT DISTINCT FROM s.source AND l.shard = s.shard)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE passes * size + coalesce(list_sum(list_transform(
         list_filter(range(b // block, (e - 1) // block + 1), lambda k: (k * ({STRIDE} % greatest(blocks, 1)) + off) % greatest(blocks, 1) < rest),
         lambda k: least(e, (k + 1) * block) - greatest(b, k * block))), 0) END::BIGINT AS taken, shard
FROM pieces"""
