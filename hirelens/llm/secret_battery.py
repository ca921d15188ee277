"""Secret scan: fixed patterns, and strings that a battery of randomness tests takes for keys.

Patterns (kinds ``assign``, ``access``, ``hex``) are matched leftmost, without overlap, per kind,
and matches that are too short are dropped. Beside them every run of ``LEAST``-plus characters of the
base64 alphabets is a candidate, and so is every piece as long of it between ``-`` and ``_``, between ``+`` and ``/``,
and between any of these (keys in paths and after prefixes). For its inferred encoding (hex, base32, base36, base62, base64)
three tests ask whether its characters look drawn at random:

* chi-squared uniformity over the encoding's alphabet,
* the number of runs above and below the middle of the alphabet,
* the serial correlation of neighbouring characters.

A candidate passes the battery if Fisher's combination of the three p-values is at least ``ALPHA``.
That alone would let ordinary short words pass, so the same chi-squared statistic is held against what ordinary
text of that length would give (a non-central chi-squared whose non-centrality grows with the length;
the text's letter frequencies are counted over all documents), and Benjamini-Hochberg over
all candidates of the corpus, pieces included, bounds the share of false discoveries by ``FDR``. A piece inside
another discovery is not reported again.

Offsets are code points, ends exclusive. Null texts are empty, repeated rows are scanned each, an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import chunks, materialize, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)  # maximal runs, so shorter ones need not be matched and dropped
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
PIECES = [re.compile(r"[%s]{%d,}" % (held, LEAST)) for held in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")]
KINDS = ["assign", "access", "hex", "random"]
ALPHA = 1e-3
FDR = 0.01
ALPHABETS = [
    ("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
INDEX = [(name, {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(s: str) -> tuple[str, dict[str, int]] | None:
    """The first, smallest alphabet that holds all characters."""
    used = set(s)
    return next(((name, index) for name, index in INDEX if used <= index.keys()), None)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs and of their pieces between separators, each once, in order."""
    out = set()
    for m in CANDIDATE.finditer(text):
        out.add(m.span())
        if not m[0].isalnum():
            out |= {p.span() for held in PIECES for p in held.finditer(text, *m.span())}
    return sorted(out)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, k: float) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson-Hilferty)."""
    return normal_tail(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def battery(s: str) -> tuple[str, int, float, float] | None:
    """(encoding, alphabet size, chi-squared statistic, combined p-value for being random)."""
    found = encoding(s)
    if found is None:
        return None
    name, index = found
    x = np.array([index[c] for c in s], float)
    n, k = len(x), len(index)
    counts = np.bincount(x.astype(int), minlength=k)
    chi2 = float(((counts - n / k) ** 2).sum() * k / n)
    p_chi2 = chi2_tail(chi2, k - 1)
    high = x >= k / 2
    n1, n2 = int(high.sum()), int(n - high.sum())
    if n1 == 0 or n2 == 0:
        p_runs = 2.0 ** (1 - n)
    else:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * n1 * n2 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = 2 * normal_tail(abs(runs - mean) / math.sqrt(var))
    dev = x - x.mean()
    r = float((dev[1:] * dev[:-1]).sum() / (dev @ dev)) if dev.any() else 1.0
    p_serial = 2 * normal_tail(abs(r + 1 / n) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi2, p_runs, p_serial))
    # upper tail of chi-squared with 6 degrees of freedom, in closed form
    half = fisher / 2
    return name, k, chi2, math.exp(-half) * (1 + half + half * half / 2)


FOUND = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("encoding", StringType()),
                    StructField("size", LongType()), StructField("chi2", DoubleType()), StructField("p_random", DoubleType())])


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, base (array of start, kind, end), found (array of
    candidates), letters (null but in one extra row a batch: counts of the 128 ASCII characters)."""
    small_batches(docs.sparkSession)
    spans = ArrayType(ArrayType(LongType()))
    schema = StructType([StructField("doc_id", LongType()), StructField("base", spans), StructField("found", ArrayType(FOUND)),
                         StructField("letters", ArrayType(LongType()))])
    types = [pa.int64(), pa.list_(pa.list_(pa.int64())),
             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("size", pa.int64()),
                                 ("chi2", pa.float64()), ("p_random", pa.float64())])), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            base, found, letters = [], [], np.zeros(128, np.int64)
            for a, b in chunks(texts):
                raw = np.frombuffer("".join(texts[a:b]).encode("ascii", "ignore"), np.uint8)
                letters += np.bincount(raw, minlength=128)
                for t in texts[a:b]:
                    base.append([list(x) for x in base_spans(t)])
                    own = []
                    for start, end in candidates(t):
                        got = battery(t[start:end])
                        if got:
                            own.append({"start": start, "end": end, "encoding": got[0], "size": got[1], "chi2": got[2], "p_random": got[3]})
                    found.append(own)
            cols = [[*ids, None], [*base, None], [*found, None], [None] * len(ids) + [letters.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def text_shares(letters: DataFrame) -> dict[str, float]:
    """Sum of squared shares of an encoding's characters in ordinary text, one number an encoding (128 counts come back)."""
    total = np.zeros(128)
    for r in letters.select(F.posexplode("letters").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect():
        total[r.c] = r.n
    out = {}
    for name, index in INDEX:
        one_case = len({c.lower() for c in index}) == len(index)  # such text has the letters of either case
        own = np.array([sum(total[ord(x)] for x in ({c, c.lower(), c.upper()} if one_case else {c})) for c in index])
        q = own / own.sum() if own.sum() else np.full(len(own), 1 / len(own))
        out.setdefault(f"{name}/{len(index)}", float((q * q).sum()))
    return out


def text_z(f: Column, shares: dict[str, float]) -> Column:
    """How even the candidate ``f`` looks beside ordinary text of its length: its chi-squared statistic
    against a non-central chi-squared, as a normal deviate (low: too even for text)."""
    n, k = (f["end"] - f["start"]).cast("double"), f["size"].cast("double")
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.concat_ws("/", f["encoding"], f["size"])]
    shift = n * F.greatest(share * k - 1, F.lit(0.0))
    return (f["chi2"] - (k - 1) - shift) / F.sqrt(2 * (k - 1 + 2 * shift))


def bh_limit(p: DataFrame, fdr: float = FDR) -> float:
    """Benjamini-Hochberg: the largest z-bin whose p-value is at most rank * fdr / tests.
    z falls into bins of 0.01, so ranks come from a bounded histogram and not from a sort of all tests."""
    bins = p.select(F.greatest(F.lit(-4000), F.least(F.lit(4000), F.ceil(F.col("z") * 100))).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    rank = F.sum("n").over(Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    rows = bins.select("bin", rank.alias("rank"), total.alias("tests")).collect()  # 8,001 bins at most
    passed = [r.bin for r in rows if normal_tail(-r.bin / 100) <= r["rank"] * fdr / r.tests]
    return max(passed) / 100 if passed else -math.inf


def outermost(spans: Column) -> Column:
    """The spans (struct of start, kind, end) that lie in no other one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"))))
    none = F.struct(F.lit(-1).cast("long").alias("reach"), F.filter(spans, lambda s: F.lit(False)).alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        own = F.array(F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), (-s["less"]).alias("end")))
        return F.when(-s["less"] <= acc["reach"], acc).otherwise(F.struct((-s["less"]).alias("reach"), F.concat(acc["kept"], own).alias("kept")))

    return F.aggregate(ordered, none, step, lambda acc: acc["kept"])


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and random ones), n_random."""
    scanned = materialize(scan(docs), "secrets")
    shares = text_shares(scanned.where("letters is not null"))
    rows = scanned.where("letters is null")
    # those that fail the battery are tests, too, and never discoveries
    z_of = lambda f: F.when(f["p_random"] >= ALPHA, text_z(f, shares)).otherwise(F.lit(40.0))
    limit = bh_limit(rows.select(F.explode("found").alias("f")).select(z_of(F.col("f")).alias("z")), fdr)

    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    span = lambda a, k, b: F.struct(a.alias("start"), k.cast("int").alias("kind"), b.alias("end"))
    base = F.transform("base", lambda s: span(s[0], s[1], s[2]))
    extra = outermost(F.transform(F.filter("found", lambda f: z_of(f) <= F.lit(limit)), lambda f: span(f["start"], F.lit(3), f["end"])))
    count = lambda k: F.size(F.filter("base", lambda s: s[1] == k)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.array_sort(F.concat(base, extra))).alias("spans"),
        F.size(extra).cast("long").alias("n_random"))
