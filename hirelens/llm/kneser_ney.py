"""Quality classifier: interpolated modified Kneser-Ney perplexity against trusted text.

A character n-gram model is trained on the text of the trusted documents (label quality 1).
A symbol is a code point below 2048, and one of 2048 further classes above; five symbols of
12 bits pack into one 60-bit code, from which context and suffix are bit operations.

Training: workers count the n-grams of the highest order batch by batch, Spark adds them up
per code; the lower orders' continuation counts, the discounts from counts of counts, the
context totals and the interpolation weights are grouped and joined by code (hash-sharded
joins). The model is a table (n, code, p, bow).

Scoring: the probability of an n-gram is found by its own row, else by its context's weight times
the probability of its suffix, and so on down. If the model has at most ``BROADCAST_ROWS``
rows (25 bytes each) workers hold it whole; a larger one stays sharded by code: distinct
n-grams of the corpus are joined with the count shards order by order, and the documents' n-grams with these.

A document is kept if its perplexity is at most a limit of its language, learnt from the trusted documents held out of
training: the language's mean plus the ``QUANTILE`` of the documents' distances from it. That distance is the mean of the language's own
quantile, weighed by its held-out documents, and of the quantile over all languages, weighed ``PRIOR_DOCS``: one rule for languages
of every size. ``PRIOR_SYMBOLS`` symbols of the language's mean are added to every document, so that very short texts
neither set the limit nor fail it by chance. A language without held-out documents has the mean and the quantile of all.

* Null and empty texts hold nothing to judge: perplexity null, not kept.
* A null language is a language of its own. Null, repeated and contradictory labels: trusted
  if every label that is not null is 1, and there is one. Repeated rows are judged alike.
* Without any trusted document there is no model: everything with text is kept. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .common import append_columns, chunks, id_text, mark, materialize, run_starts, small_batches, with_fields

ORDER = 5
BITS = 12
PLAIN = 1 << (BITS - 1)  # code points below are symbols of their own
START = 2  # the symbol before a text
SYMBOLS = 1 << BITS
HELD_ONE_IN = 5
QUANTILE = 0.995
PRIOR_DOCS = 2000  # ten documents beyond the quantile: with far fewer, a language's own one is its farthest document
PRIOR_SYMBOLS = 50
BIN = 1e-3  # thresholds are exact to this step of the mean log-probability
BROADCAST_ROWS = 4_000_000
ROW = np.dtype([("n", np.int8), ("code", np.int64), ("p", np.float64), ("bow", np.float64)])
SCORED_CHARS = 1_000_000  # a worker's arrays hold so many symbols at once
HELD_GRAMS = 1_000_000
LANGS = 10_000  # so many languages' thresholds are broadcast; beyond, they are joined by shuffle


def symbols(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``order - 1`` start symbols, and the texts' lengths."""
    parts, lengths = [], np.empty(len(texts), np.int64)
    pad = np.full(order - 1, START, np.uint32)
    for i, t in enumerate(texts):
        cps = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths[i] = len(cps)
        parts += [pad, cps]
    s = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return np.where(s < PLAIN, s, PLAIN + s % PLAIN), lengths


def ngrams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams ending at each symbol of each text, and the texts' lengths."""
    s, lengths = symbols(texts, order)
    if not len(s):
        return s, lengths
    code = s.copy()
    for k in range(1, order):
        code[k:] |= s[:-k] << (BITS * k)
    own = np.ones(len(s), bool)  # not the start symbols
    at = run_starts(lengths + order - 1)
    for k in range(order - 1):
        own[at + k] = False
    return code[own], lengths


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(code, c): n-grams of the highest order over all given documents."""
    small_batches(docs.sparkSession)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return code, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a partition are added up before they leave, as far as ``HELD_GRAMS`` allows."""
        parts, held = [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts, SCORED_CHARS):
                parts.append(np.unique(ngrams(texts[a:b])[0], return_counts=True))
                held += len(parts[-1][0])
                if held > HELD_GRAMS:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > HELD_GRAMS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["code", "c"])
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], names=["code", "c"])

    return docs.where("text <> ''").select("text").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the counts of counts 1 to 4 (one row comes back)."""
    r = counts.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [max(1, r[f"n{k}"]) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1), k + 0.9) for k in range(3)]


def low_bits(code: Column, n: int) -> Column:
    return code.bitwiseAND(F.lit((1 << (BITS * n)) - 1))


def train(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs(text) -> the model: (n, code, p, bow). ``p``: interpolated probability of the n-gram
    ``code`` (null if it was only seen as a context); ``bow``: weight of the shorter
    context after the context ``code``."""
    counts = {order: materialize(count_ngrams(docs), "ngrams")}
    for n in range(order - 1, 0, -1):  # continuation counts: distinct n-grams one longer
        counts[n] = materialize(counts[n + 1].groupBy(low_bits(F.col("code"), n).alias("code")).agg(F.count("*").alias("c")), "ngrams")
    lower, model = None, None
    for n in range(1, order + 1):
        d = discounts(counts[n])
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counts[n].withColumn("ctx", F.shiftrightunsigned("code", BITS)).withColumn("d", taken)
        contexts = rows.groupBy("ctx").agg((F.sum("d") / F.sum("c")).alias("bow"), F.sum("c").alias("total"))
        rows = rows.join(contexts, "ctx").withColumn("suffix", low_bits(F.col("code"), n - 1))
        if lower is None:
            rows = rows.withColumn("p_low", F.lit(1.0 / SYMBOLS))
        else:
            rows = rows.join(lower.select(F.col("code").alias("suffix"), F.col("p").alias("p_low")), "suffix")
        lower = materialize(rows.select("code", ((F.col("c") - F.col("d")) / F.col("total") + F.col("bow") * F.col("p_low")).alias("p")), "probabilities")
        part = lower.select(F.lit(n).alias("n"), "code", "p", F.lit(None).cast("double").alias("bow"))
        weights = contexts.select(F.lit(n - 1).alias("n"), F.col("ctx").alias("code"), F.lit(None).cast("double").alias("p"), "bow")
        model = part.union(weights) if model is None else model.union(part).union(weights)
    return materialize(model.groupBy("n", "code").agg(F.max("p").alias("p"), F.max("bow").alias("bow")), "model")


class Table:
    """Codes to numbers: open addressing in arrays, looked up for a whole array at once."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.codes, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        at, left = self._home(codes), np.arange(len(codes))
        while len(left):
            free = self.codes[at[left]] == -1
            slot, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.codes[slot], self.values[slot] = codes[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, codes: np.ndarray, missing: float) -> np.ndarray:
        """Values of the codes, ``missing`` where there is none."""
        at = self._home(codes)
        found = self.codes[at]
        out = np.where(found == codes, self.values[at], missing)
        left = np.flatnonzero((found != codes) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.codes[at[left]]
            hit = found == codes[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class Model:
    """The whole model in a worker's memory."""

    def __init__(self, n: np.ndarray, code: np.ndarray, p: np.ndarray, bow: np.ndarray, order: int = ORDER):
        self.order, self.p, self.bow = order, {}, {}
        for k in range(order + 1):
            me = (n == k) & ~np.isnan(p)
            self.p[k] = Table(code[me], np.log(p[me]))
            me = (n == k) & ~np.isnan(bow)
            self.bow[k] = Table(code[me], np.log(bow[me]))

    def log_p(self, code: np.ndarray) -> np.ndarray:
        out, back = np.empty(len(code)), np.zeros(len(code))
        left = np.arange(len(code))
        for n in range(self.order, 0, -1):
            got = self.p[n].get(code, 1.0)  # a log-probability is never above 0
            hit = got <= 0
            out[left[hit]] = back[hit] + got[hit]
            miss = ~hit
            left, code, back = left[miss], code[miss], back[miss]
            back = back + self.bow[n - 1].get(code >> BITS, 0.0)
            code = code & ((1 << (BITS * (n - 1))) - 1)
        out[left] = back - np.log(SYMBOLS)
        return out


def packed(model: DataFrame) -> list[bytes]:
    """The model's rows as arrays of 25 bytes a row, one for each partition; for models of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            rows = np.empty(batch.num_rows, ROW)
            for name, column in zip(ROW.names, batch.columns):
                rows[name] = column.to_numpy(zero_copy_only=False)
            parts.append(rows.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["rows"])

    return [bytes(r.rows) for r in model.select("n", "code", "p", "bow").mapInArrow(run, "rows binary").collect()]


def loaded(held: Broadcast) -> Model:
    """The model of a broadcast. Built for each task (half a second) and not kept, so that
    idle worker processes hold none."""
    rows = np.concatenate([np.frombuffer(b, ROW) for b in held.value])
    return Model(rows["n"].astype(np.int64), rows["code"].copy(), rows["p"].copy(), rows["bow"].copy())


def score(docs: DataFrame, model: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with __n (symbols) and __nll (their summed negative log-probability).

    A model of more than ``most`` rows is not broadcast: see ``score_sharded``."""
    if model.count() > most:
        return score_sharded(docs, model)
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(packed(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(held)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            n, nll = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for a, b in chunks(texts, SCORED_CHARS):
                codes, n[a:b] = ngrams(texts[a:b])
                some = a + np.flatnonzero(n[a:b])
                if len(some):
                    nll[some] = -np.add.reduceat(own.log_p(codes), run_starts(n[some]))
            yield append_columns(batch, __n=pa.array(n), __nll=pa.array(nll))

    return docs.mapInArrow(run, with_fields(docs.schema, __n=LongType(), __nll=DoubleType()))


def score_sharded(docs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """The same scores by joins: nothing of the model is held whole anywhere.

    Documents are matched by a hash of their text, so copies are counted once."""
    keyed = docs.withColumn("__text", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = keyed.where("text <> ''").groupBy("__text").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code, c = np.unique(ngrams([text])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(code)), pa.array(code), pa.array(c.astype(np.int64))], names=["__text", "code", "c"])

    grams = materialize(texts.select("__text", "text").mapInArrow(run, "__text string, code long, c long"), "grams")
    open_ = grams.select("code").distinct().select("code", F.col("code").alias("at"), F.lit(0.0).alias("back"))
    done = None
    for n in range(order, 0, -1):
        seen = model.where((F.col("n") == n) & F.col("p").isNotNull()).select(F.col("code").alias("at"), "p")
        tried = materialize(open_.join(seen, "at", "left"), "cascade")
        hit = tried.where("p is not null").select("code", (F.col("back") + F.log("p")).alias("lp"))
        done = hit if done is None else done.union(hit)
        weights = model.where((F.col("n") == n - 1) & F.col("bow").isNotNull()).select(F.col("code").alias("ctx"), "bow")
        open_ = (tried.where("p is null").withColumn("ctx", F.shiftrightunsigned("at", BITS)).join(weights, "ctx", "left")
                 .select("code", low_bits(F.col("at"), n - 1).alias("at"), (F.col("back") + F.coalesce(F.log("bow"), F.lit(0.0))).alias("back")))
    done = done.union(open_.select("code", F.col("back") - float(np.log(SYMBOLS))))
    sums = grams.join(done, "code").groupBy("__text").agg(F.sum("c").alias("__n"), (-F.sum(F.col("c") * F.col("lp"))).alias("__nll"))
    return (keyed.join(sums, "__text", "left").drop("__text")
            .withColumns({"__n": F.coalesce("__n", F.lit(0)), "__nll": F.coalesce("__nll", F.lit(0.0))}))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(__id, __held): ids whose labels all say quality 1; one in five is held out of training."""
    held = F.crc32(id_text().cast("binary")) % HELD_ONE_IN == 0
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null").select(
        F.col("doc_id").alias("__id"), held.alias("__held"))


def few(df: DataFrame) -> DataFrame:
    """A table of a row a language, broadcast if it has at most ``LANGS`` rows."""
    return F.broadcast(df) if df.count() <= LANGS else df


def smoothed(prior: Column) -> Column:
    """Mean negative log-probability of a document, with ``PRIOR_SYMBOLS`` symbols of its language's mean added:
    a few words alone are too little to be out of the ordinary."""
    return (F.col("__nll") + prior * PRIOR_SYMBOLS) / (F.col("__n") + PRIOR_SYMBOLS)


def standards(held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """held(lang, __n, __nll) of held-out documents -> (__all, lang, prior, limit): mean negative log-probability a
    symbol, and the smoothed one that a document may not exceed, for each language and (``__all``) for those not among them."""
    rows = held.where("__n > 0")
    mean = F.sum("__nll") / F.sum("__n")
    priors = materialize(rows.groupBy("lang").agg(mean.alias("prior")), "priors").select(F.col("lang").alias("__lang"), "prior")
    bin_ = F.ceil((smoothed(F.col("prior")) - F.col("prior")) / BIN)
    bins = (rows.join(few(priors), F.col("lang").eqNullSafe(F.col("__lang"))).groupBy("lang", "prior", bin_.alias("bin")).agg(F.count("*").alias("c")))
    bins = materialize(bins, "distances")  # a row for each language and step of its distances

    def upper(bins: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by)
        ranked = bins.withColumn("upto", F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("docs", F.sum("c").over(w))
        return ranked.where(F.col("upto") >= F.ceil(F.col("docs") * quantile)).groupBy(*by, "docs").agg((F.min("bin") * BIN).alias("far"))

    own = upper(bins, "lang", "prior")
    pooled = bins.groupBy("bin").agg(F.sum("c").alias("c")).withColumn("__all", F.lit(True))  # a row a step: bounded by log(SYMBOLS) / BIN
    whole = upper(pooled, "__all").select("__all", F.col("far").alias("__far")).crossJoin(rows.agg(mean.alias("__prior")))  # one row and one row
    far = (F.col("far") * F.col("docs") + F.col("__far") * PRIOR_DOCS) / (F.col("docs") + PRIOR_DOCS)
    each = own.join(F.broadcast(whole), F.lit(True)).select(F.lit(False).alias("__all"), "lang", "prior", (F.col("prior") + far).alias("limit"))
    return each.union(whole.select("__all", F.lit(None).cast("string"), "__prior", F.col("__prior") + F.col("__far")))


def labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text, lang of the documents with the ids (__id); a bit filter spares the join most other texts,
    and the join shuffles at any size (labels grow with the corpus)."""
    texts = mark(docs.select("doc_id", "text", "lang"), "doc_id", ids.select("__id"), "__may").where("__may")
    return texts.join(ids.hint("merge"), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "lang")


def judged(docs: DataFrame, labels: DataFrame, carry: list[str], quantile: float = QUANTILE) -> DataFrame:
    """The columns ``carry`` (doc_id and lang among them) of ``docs``, with __n, __mean, __smooth, __limit and __keep.
    The model and the thresholds are learnt first; then one pass over all documents judges them where they are."""
    trusted = materialize(trusted_ids(labels), "trusted")
    model = train(labelled(docs, trusted.where("not __held")))
    held = materialize(score(labelled(docs, trusted.where("__held")), model).select("lang", "__n", "__nll"), "held")
    learnt = materialize(standards(held, quantile), "standards")
    own = learnt.where("not __all").select(F.col("lang").alias("__lang"), F.col("prior").alias("__p"), F.col("limit").alias("__own"))
    whole = learnt.where("__all").select(F.col("prior").alias("__q"), F.col("limit").alias("__whole"))  # one row at most
    scored = score(docs, model).select(*carry, "__n", "__nll")
    scored = scored.join(few(own), F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")
    scored = scored.join(F.broadcast(whole), F.lit(True), "left")
    judged_by = F.when(F.col("__n") > 0, F.coalesce(smoothed(F.coalesce("__p", "__q")), F.lit(0.0)))
    return (scored.withColumn("__limit", F.coalesce("__own", "__whole")).withColumn("__smooth", judged_by)
            .withColumn("__mean", F.when(F.col("__n") > 0, F.col("__nll") / F.col("__n")))
            .withColumn("__keep", F.coalesce(F.col("__smooth") <= F.coalesce("__limit", F.lit(float("inf"))), F.lit(False))))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, smoothed_perplexity, max_perplexity (of the smoothed one), keep of every document."""
    rows = judged(docs.select("doc_id", "text", "lang"), labels, ["doc_id", "lang"], quantile)
    return rows.select("doc_id", "lang", F.col("__n").alias("n_symbols"), F.exp("__mean").alias("perplexity"),
                       F.exp("__smooth").alias("smoothed_perplexity"), F.exp("__limit").alias("max_perplexity"), F.col("__keep").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents that the classifier does not reject, as they came."""
    return judged(docs, labels, docs.columns, quantile).where("__keep").select(*docs.columns)
