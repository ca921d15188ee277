"""SimHash near-duplicates through the generalised pigeonhole principle.

64-bit fingerprints of three-word shingles link when at most two bits differ. The 64
bits are grouped into four partitions of 16, correlated bits together. A fingerprint searches
with its own threshold vector: thresholds t_i >= -1 (-1: partition left out) with
sum(t_i + 1) = max_bits + 1 cannot miss a neighbour, since a pair beyond every t_i would
differ in more than max_bits bits. A dynamic programme picks the vector with the fewest
candidates, counted with the partitions' key histograms; the partitions are then probed
and candidates verified on all 64 bits.

Where even the best vector has more candidates than a fingerprint has one-bit variants
(inside large groups of near copies), the fingerprint takes the whole width as its one
partition instead: two such fingerprints within two bits share a variant, so grouping by variant
links them through one representative and no pair is enumerated. A pair of which only one side
went this way is found from the other side, which probes an index of everything.

Nothing grows on the driver: it sees a 64 x 64 bit co-occurrence table and four
histograms of 65,536 counts.

* Null and wordless texts have fingerprint zero and link like any other.
* Null ids get the component of their fingerprint, and never name one unless all ids of it are null.
* Repeated rows come back as often as they were given; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import append_columns, chunks, mark, materialize, run_starts, small_batches, with_fields
from .components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
PARTS, WIDTH = 4, 16
#: What a probe costs beside a candidate, and a fingerprint's own one-bit variants.
PROBE_COST = 0.05
VARIANTS = 65


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle. Only A-Z are lower-cased and only ASCII white space
    separates words, which is just what the bytes methods do."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b - 1], SEED) for a, b in zip(starts, ends[size - 1:])]


def fingerprints_of(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints: a bit is one if set in over half the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    plain = [t or "" for t in texts]
    for a, b in chunks(plain, 1_500_000):
        hashes = [shingle_hashes(t, size) for t in plain[a:b]]
        n = np.array([len(h) for h in hashes], np.int64)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(n.sum()))
        sums = np.empty((len(some), 64), np.int64)
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k, s in enumerate(run_starts(n[some])):
            sums[k] = bits[s:s + n[some[k]]].sum(axis=0, dtype=np.int64)
        ones = (sums * 2 > n[some][:, None]).astype(np.uint8)
        out[a + some] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(docs: DataFrame, name: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """``docs`` with a column of their fingerprints, as signed 64-bit integers."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprints_of(batch.column(batch.schema.get_field_index("text")).to_pylist(), size)
            yield append_columns(batch, **{name: pa.array(fps.view(np.int64))})

    return docs.mapInArrow(run, with_fields(docs.schema, **{name: LongType()}))


def bit_groups(fps: DataFrame) -> list[list[int]]:
    """Four groups of 16 bits, each grown from the bit most correlated with the rest."""
    def run(batches):
        total, rows = np.zeros((65, 64), np.int64), 0
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            y = x.astype(np.float64)
            total[:64] += (y.T @ y).astype(np.int64)
            total[64] += x.sum(axis=0, dtype=np.int64)
            rows += len(x)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, 65)), pa.array(np.append(j, 0)), pa.array(np.append(total[i, j], rows))], names=["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, ones, n = np.zeros((64, 64)), np.zeros(64), 1
    for r in rows:  # 64 x 64 counts and the margins
        if r.i == 65:
            n = max(1, r.n)
        elif r.i == 64:
            ones[r.j] = r.n
        else:
            both[r.i, r.j] = r.n
    p = ones / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for _ in range(PARTS):
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < WIDTH:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def part_keys(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """int64 key of each fingerprint in each partition, shape (n, parts)."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    return np.stack([bits[:, g] @ (1 << np.arange(len(g))) for g in groups], axis=1) if len(fps) else np.zeros((0, len(groups)), np.int64)


def ball(radius: int, width: int = WIDTH) -> np.ndarray:
    """Masks of at most ``radius`` set bits."""
    return np.array([reduce(lambda m, b: m | 1 << b, c, 0) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def candidate_counts(hist: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """counts[part, t, key]: fingerprints whose key is within t bits of ``key``."""
    at = np.arange(hist.shape[1])
    return np.stack([[sum(h[at ^ m] for m in ball(t)) for t in range(max_bits + 1)] for h in hist])


def allocate(keys: np.ndarray, counts: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The threshold vector of the least cost for each fingerprint, and that cost.

    best[s]: least cost of giving s units (t_i + 1) to the partitions so far.
    """
    n, parts = keys.shape
    probes = np.array([len(ball(t)) for t in range(max_bits + 1)])
    best = np.full((max_bits + 2, n), np.inf)
    best[0] = 0
    given = np.zeros((parts, max_bits + 2, n), np.int8)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for s in range(max_bits + 2):
            for u in range(s + 1):
                cost = best[s - u] + (counts[i, u - 1][keys[:, i]] + PROBE_COST * probes[u - 1] if u else 0)
                better = cost < new[s]
                new[s][better] = cost[better]
                given[i, s][better] = u
        best = new
    vector, s = np.empty((n, parts), np.int8), np.full(n, max_bits + 1)
    for i in reversed(range(parts)):
        u = given[i, s, np.arange(n)]
        vector[:, i] = u - 1
        s = s - u
    return vector, best[max_bits + 1]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fps(fp long, distinct) -> edges (a, b) whose components are those of all pairs within ``max_bits``."""
    if max_bits > 2:
        raise ValueError("variants meet at two bits at most")
    groups = bit_groups(fps)

    def count(batches):
        hist = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for batch in batches:
            keys = part_keys(batch.column(0).to_numpy(zero_copy_only=False), groups)
            for i in range(PARTS):
                hist[i] += np.bincount(keys[:, i], minlength=1 << WIDTH)
        i, k = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(hist[i, k])], names=["part", "key", "n"])

    # at most PARTS x 65,536 counts
    hist = np.zeros((PARTS, 1 << WIDTH), np.int64)
    got = fps.mapInArrow(count, "part long, key long, n long").groupBy("part", "key").agg(F.sum("n").alias("n")).toPandas()
    hist[got["part"].to_numpy(np.int64), got["key"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    counts = fps.sparkSession.sparkContext.broadcast(candidate_counts(hist, max_bits))  # 4 x 3 x 65,536 integers

    def emit(batches):
        """kind 0: index rows; 1: probes; 2: one-bit variants."""
        flips = np.append(np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = part_keys(fp, groups)
            vector, cost = allocate(keys, counts.value, max_bits)
            dense = cost > VARIANTS
            kind, part, key, own = [], [], [], []

            def add(k, p, values, f):
                kind.append(np.full(len(f), k)), part.append(np.full(len(f), p)), key.append(values), own.append(f)

            for i in range(PARTS):
                add(0, i, keys[:, i], fp)
                for t in range(max_bits + 1):
                    me = (vector[:, i] == t) & ~dense
                    masks = ball(t)
                    add(1, i, (keys[me, i][:, None] ^ masks).ravel(), np.repeat(fp[me], len(masks)))
            add(2, PARTS, (fp[dense][:, None] ^ flips).ravel().view(np.int64), np.repeat(fp[dense], 65))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(kind).astype(np.int8)), pa.array(np.concatenate(part).astype(np.int8)),
                 pa.array(np.concatenate(key)), pa.array(np.concatenate(own).view(np.int64))], names=["kind", "part", "key", "fp"])

    rows = materialize(fps.mapInArrow(emit, "kind byte, part byte, key long, fp long"), "probes")
    index = rows.where("kind = 0").select("part", "key", F.col("fp").alias("b"))
    probe = rows.where("kind = 1").select("part", "key", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = probe.join(index, ["part", "key"]).where((F.col("a") != F.col("b")) & near).select("a", "b")
    variants = rows.where("kind = 2").select("key", "fp")
    shared = variants.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).where("b <> c").select("key", "b")
    stars = variants.join(shared, "key").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars if max_bits == 2 else stars.where(near))


def group(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp) of every document -> fp, component (its smallest fingerprint), component_id (smallest doc_id)."""
    own = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(own.select("fp"), max_bits)).withColumnRenamed("v", "fp")
    named = own.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return materialize(named.join(least, "component").select("fp", "component", "component_id"), "components")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document."""
    fps = materialize(fingerprint(docs.select("doc_id", "text"), "fp", size).select("doc_id", "fp"), "simhash")
    return fps.join(group(fps, max_bits), "fp").select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id
    (of rows repeating it, and of components with null ids only, any one).

    Fingerprints are decided on without the texts. Ids that go, and ids that are null or repeated, are set
    in a bit filter; a text that it clears stays without a join, the others meet the exact sets. Rows whose id is null or
    repeated are fingerprinted again and told apart by their component."""
    fps = materialize(fingerprint(docs.select("doc_id", "text"), "fp", size).select("doc_id", "fp"), "simhash")
    groups = group(fps, max_bits)
    marked = fps.join(groups, "fp").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("least"))
    ids = materialize(marked.select(F.col("doc_id").alias("__id"), ((F.col("n") > 1) | F.col("doc_id").isNull()).alias("unclear"), "least")
                      .where("unclear or not least"), "ids")
    again = ids.where("unclear and least").select("__id")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    rows = mark(docs, "doc_id", ids.select("__id"), "__suspect")
    kept = rows.where("not __suspect").unionByName(rows.where("__suspect").join(ids, same, "left_anti")).select(*docs.columns)
    unclear = mark(docs, "doc_id", again, "__unclear").where("__unclear").select(*docs.columns)
    told = groups.select(F.col("fp").alias("__fp"), F.col("component").alias("__component"), F.col("component_id").alias("__least"))
    told = (fingerprint(unclear.join(again, same, "left_semi"), "__fp", size)
            .join(told, "__fp").where(F.col("doc_id").eqNullSafe(F.col("__least"))))
    return kept.unionByName(told.dropDuplicates(["__component"]).select(*docs.columns))
