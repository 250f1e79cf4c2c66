"""Quality rules on repetition.

Words are runs of characters outside [\\x20\\x09-\\x0D]. Word hashes are rolled into n-gram hashes of
several lengths with numpy, a chunk of documents at a time, and the share of word characters (code points) inside
n-grams found twice or more, and of characters in repeated lines, is held against a limit for each length.
A null or empty text has no words and is rejected by the base rule. Each row is judged on its own
whole text; repeated rows get equal verdicts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, bound_batches, byte_column, chunks, mix64, pieces

SYMBOLS = b"#*$%&|<>"
#: The largest share of word characters inside n-grams of n words that occur twice or more, first included.
#: Those of 2 to 4 words catch stuffing with short phrases, which repeats no 5 words. Longer texts repeat short n-grams by nature, so
#: their limit is (up to LEVEL_WORDS words, what each doubling beyond adds, most).
NGRAM_LIMITS = {2: (0.35, 0.06, 0.90), 3: (0.30, 0.04, 0.75), 4: (0.28, 0.02, 0.55), 6: 0.25, 8: 0.22, 10: 0.20}
LEVEL_WORDS = 200
#: The largest share of line characters in lines that repeat an earlier one.
LINE_LIMIT = 0.30
CHUNK_BYTES = 1 << 20
_ROLL = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ngram_shares map<int,double>, line_share double"


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode())


def _covered(keys: np.ndarray, starts_ok: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words whose key occurs twice or more."""
    inside = np.zeros(len(starts_ok) + 1, np.int32)
    at = np.flatnonzero(starts_ok)
    if len(at) > 1:
        k = keys[at]
        s = np.sort(k)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            twice = np.unique(twice)
            p = np.minimum(np.searchsorted(twice, k), len(twice) - 1)
            hit = at[twice[p] == k]
            np.add.at(inside, hit, 1)
            np.add.at(inside, np.minimum(hit + n, len(starts_ok)), -1)
    return np.cumsum(inside[:-1]) > 0


def repetition(texts: list[bytes], lengths: tuple[int, ...]) -> tuple[list[list[bytes]], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The words of each text, and for each n the words and the word characters that lie in repeated n-grams."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    total = int(counts.sum())
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(ends, counts) - np.arange(total)  # words from here to the text's end
    base = mix64(np.fromiter((hash(x) for w in words for x in w), np.int64, total).view(np.uint64))
    chars = np.fromiter((code_points(x) for w in words for x in w), np.int64, total)
    out = {}
    with np.errstate(over="ignore"):
        rolled, n = base, 1
        salt = mix64(doc.astype(np.uint64) + np.uint64(1))
        for want in sorted(lengths):
            while n < want:  # one word longer
                longer = rolled * _ROLL
                longer[: max(0, total - n)] += base[n:]
                rolled, n = longer, n + 1
            inside = _covered(mix64(rolled) ^ salt, left >= n, n)
            out[want] = (np.bincount(doc[inside], minlength=len(texts)), np.bincount(doc[inside], weights=chars[inside], minlength=len(texts)))
    return words, out


def limit_at(limit: float | tuple[float, float, float], n_words: int) -> float:
    """The limit that holds for a text of ``n_words`` words."""
    if not isinstance(limit, tuple):
        return limit
    level, doubling, most = limit
    return min(most, level + doubling * math.log2(max(n_words, LEVEL_WORDS) / LEVEL_WORDS))


def _judge(limits: dict[int, float | tuple[float, float, float]], line_limit: float):
    lengths = tuple(sorted({5, *limits}))

    def run(batches):
        for b in pieces(batches):
            texts, ids = byte_column(b), b.column("doc_id").to_pylist()
            points = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
            rows = []
            for lo, hi in chunks([len(t) for t in texts], CHUNK_BYTES):
                words, found = repetition(texts[lo:hi], lengths)
                for i in range(lo, hi):
                    t, w = texts[i], len(words[i - lo])
                    solid = points[i] - (len(t) - len(t.translate(None, SPACE_BYTES)))
                    lines = [x for x in t.split(b"\n") if x.strip()]
                    once = set(lines)
                    of_lines = sum(map(code_points, lines))
                    line_share = (of_lines - sum(map(code_points, once))) / of_lines if of_lines else 0.0
                    repeat = int(found[5][0][i - lo])
                    failed = w < 10 or 100 * repeat > 20 * w
                    shares = {n: float(found[n][1][i - lo]) / solid if solid else 0.0 for n in limits}
                    kept = not failed and line_share <= line_limit and all(shares[n] <= limit_at(limits[n], w) for n in limits)
                    rows.append(
                        (ids[i], w, solid, sum(map(t.count, _SINGLE)), len(lines) - len(once), repeat, failed, kept, list(shares.items()), line_share)
                    )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 10, _KINDS, strict=True)], names=_NAMES
            )

    return run


_SINGLE = [bytes([s]) for s in SYMBOLS]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [*[pa.int64()] * 6, pa.bool_(), pa.bool_(), pa.map_(pa.int32(), pa.float64()), pa.float64()]


def judge_repetition(
    docs: DataFrame, limits: dict[int, float | tuple[float, float, float]] | None = None, line_limit: float = LINE_LIMIT
) -> DataFrame:
    """One row for each document: counts, the shares measured, ``base_failed`` and ``kept``."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_judge(limits or NGRAM_LIMITS, line_limit), SCHEMA)


def _keep(limits: dict[int, float | tuple[float, float, float]], line_limit: float):
    judge = _judge(limits, line_limit)

    def run(batches):
        for b in pieces(batches):
            for verdict in judge([pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column("text")], names=["doc_id", "text"])]):
                yield b.filter(verdict.column("kept"))

    return run


def keep_good(docs: DataFrame, limits: dict[int, float | tuple[float, float, float]] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The documents that the rules keep, with all their columns, in one pass without a shuffle."""
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(_keep(limits or NGRAM_LIMITS, line_limit), docs.schema)
