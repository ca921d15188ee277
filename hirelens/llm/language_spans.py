"""Language identification of mixed-language text.

A word is a maximal run of letters. Its script (by code point ranges) leaves the languages that were
seen to use it; its score for each of them is the log-probability of its letter trigrams, learnt
per language into a fixed number of hash buckets. A Viterbi pass over the words, with a penalty
for switching, labels spans; the document's language is the label of most letters.

The model is a table of languages x ``BUCKETS`` counts: its size follows the number of languages, not
the corpus. Texts stay where they are: one pass to count, one to label, no shuffle of text.

* Null texts and texts without a letter are ``und`` with score 0, and so is all if nothing could be learnt.
* Null ids hash as the empty string. Repeated rows are labelled alike, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_text, run_starts, small_batches

BUCKETS = 1 << 16
SMOOTHING = 0.1
SWITCH = 12.0
LEAST_SHARE = 0.01  # of a language's letters, for a script to count as its own
NEVER = -1e6
UNKNOWN = "und"

# Where scripts begin (code points); a letter belongs to the last one that begins at or before it.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"),
    (0x1680, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1900, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3400, "Han"),
    (0xA000, "Yi"), (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAB30, "Latin"),
    (0xAB70, "Cherokee"), (0xABC0, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF65, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"),
    (0x20000, "Han"),
]
NAMES = sorted({n for _, n in SCRIPTS})


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case if it is a letter or else 0, and its script's number."""
    lower = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    script = np.zeros(0x110000, np.int8)
    for start, name in SCRIPTS:
        script[start:] = NAMES.index(name)
    return lower, script


def words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Over all texts, joined with a gap between: buckets of the trigrams that end at each place, starts and ends
    of words (places), scripts of words, each word's text, and the place where each text begins."""
    lower, scripts = tables()
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    t = np.zeros(len(raw) + 1, np.int64)
    t[:-1] = lower[raw]
    letter = t > 0
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    one = np.concatenate([[0], t[:-1]])
    two = np.where(one > 0, np.concatenate([[0, 0], t[:-2]]), 0)
    mixed = (t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (one.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (two.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    bucket = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 16)
    places = run_starts(np.array([len(x) + 1 for x in texts], np.int64))
    return bucket.astype(np.int32), start, end, scripts[raw[start]] if len(start) else np.zeros(0, np.int8), np.searchsorted(places, start, "right") - 1, places


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place from a word's start to just after its end, and where each word's places begin."""
    n = end - start + 1
    first = run_starts(n)
    return np.arange(int(n.sum())) - np.repeat(first - start, n), first


def held_out() -> Column:
    return F.crc32(id_text().cast("binary")) % 4 == 2


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """docs(text, lang) -> languages, log-probabilities (BUCKETS x languages), scripts in use (scripts x languages)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            total: dict[str, np.ndarray] = {}
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                total[lang] = np.zeros(BUCKETS + len(NAMES), np.int64)
                for a, b in chunks(own, 2_000_000):
                    bucket, start, end, script, _, _ = words(own[a:b])
                    if len(start):
                        total[lang][:BUCKETS] += np.bincount(bucket[spread(start, end)[0]], minlength=BUCKETS)
                        total[lang][BUCKETS:] += np.bincount(script, end - start, minlength=len(NAMES)).astype(np.int64)
            for lang, c in total.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    counts = (docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # languages x (BUCKETS + scripts) at most
    langs = sorted(set(counts["lang"]))
    n = np.zeros((BUCKETS + len(NAMES), len(langs)))
    n[counts["bucket"].to_numpy(np.int64), [langs.index(x) for x in counts["lang"]]] = counts["n"].to_numpy(float)
    seen = n[:BUCKETS] + SMOOTHING
    share = n[BUCKETS:] / np.maximum(n[BUCKETS:].sum(axis=0), 1)
    return langs, np.log(seen / seen.sum(axis=0)).astype(np.float32), share >= LEAST_SHARE


def viterbi(score: np.ndarray, first: np.ndarray, n: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of each word. Texts (words first .. first + n) advance side by side, word by word, longest first."""
    k = score.shape[1]
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    back = np.empty(score.shape, np.int8 if k < 128 else np.int16)
    label = np.zeros(len(score), back.dtype)
    active = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")  # texts longer than t
    best = np.zeros((len(n), k))
    same = np.arange(k)
    for t, m in enumerate(active):
        at = first[:m] + t
        top = best[:m].argmax(axis=1)
        switched = best[np.arange(m), top][:, None] - penalty
        change = switched > best[:m]
        back[at] = np.where(change, top[:, None], same)
        best[:m] = np.where(change, switched, best[:m]) + score[at]
    now = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        label[at] = now[:m]
        now[:m] = back[at, now[:m]]
    return label


def label(texts: list[str], langs: list[str], logp: np.ndarray, uses: np.ndarray, penalty: float = SWITCH) -> list[tuple]:
    """(language, share of letters, spans) of each text."""
    bucket, start, end, script, text, places = words(texts)
    out: list[tuple] = [(UNKNOWN, 0.0, [])] * len(texts)
    if not len(start) or not langs:
        return out
    at, first = spread(start, end)
    score = np.add.reduceat(logp[bucket[at]], first, axis=0)
    allowed = uses[script]
    allowed |= ~allowed.any(axis=1)[:, None]  # a script that no language uses tells nothing
    score[~uses[script].any(axis=1)] = 0
    score = np.where(allowed, score, NEVER)
    n = np.bincount(text, minlength=len(texts))
    some = np.flatnonzero(n)
    lab = viterbi(score, run_starts(n[some]), n[some], penalty)
    letters = np.zeros((len(texts), len(langs)))
    np.add.at(letters, (text, lab), end - start)
    new = np.flatnonzero(np.concatenate([[True], (lab[1:] != lab[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(lab)]]) - 1
    spans: dict[int, list] = {}
    for a, b in zip(new, last):
        d = int(text[a])
        spans.setdefault(d, []).append({"start": int(start[a] - places[d]), "end": int(end[b] - places[d]), "lang": langs[lab[a]]})
    for d in some:
        best = int(letters[d].argmax())
        out[d] = (langs[best], float(letters[d, best] / letters[d].sum()), spans[int(d)])
    return out


def identify(docs: DataFrame, penalty: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of letters labelled so), spans (array of start, end, lang).

    Learns from the documents that are not held out, and labels all."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    langs, logp, uses = learn(rows.where("not held_out"))
    model = docs.sparkSession.sparkContext.broadcast((langs, logp, uses))  # languages x BUCKETS floats
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = [t or "" for t in batch.column(2).to_pylist()], []
            for a, b in chunks(texts):
                out += label(texts[a:b], *model.value, penalty)
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], span)],
                                             names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, schema)
