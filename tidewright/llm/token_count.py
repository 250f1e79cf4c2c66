"""Token counts without tokens: byte-pair merging over a heap and a linked list.

A sentencepiece BPE model gives scores to pieces. A segment's count is its initial symbols less its
merges, taken best score first and leftmost among equals; symbols outside the vocabulary count as
their UTF-8 bytes. No identifiers are made. Texts are cut where no piece of the vocabulary can span
the cut, so that counts of segments can be kept and reused.

A null or empty text has no tokens. Texts are counted whole, whatever their length.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, byte_column, kept, pieces

MOST_CACHED = 300_000
SPACE = "▁"


def _fields(buf: bytes):
    """The fields of a protocol buffer: (number, value)."""

    def varint(i):
        n = shift = 0
        while True:
            n |= (buf[i] & 0x7F) << shift
            shift, i = shift + 7, i + 1
            if not buf[i - 1] & 0x80:
                return n, i

    i = 0
    while i < len(buf):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = buf[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, i = buf[i : i + n], i + n
        yield key >> 3, value


def read_scores(model: bytes) -> dict[str, float]:
    """The scores of the normal pieces. Models that would be counted wrongly are refused: another type than BPE, another normalisation than
    identity, pieces defined by a user, no byte pieces to fall back on."""
    import struct

    normal, user_defined, byte, bpe, scores = 1, 4, 6, 2, {}
    fallback, kind = 0, None
    for number, value in _fields(model):
        if number == 1:
            piece = {n: v for n, v in _fields(value)}
            if piece.get(3, normal) == user_defined:
                raise ValueError("pieces that a user defined are not supported")
            fallback += piece.get(3, normal) == byte
            if piece.get(3, normal) == normal:
                scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
        elif number == 3:
            how = dict(_fields(value))
            if how.get(1, b"") != b"identity" or not how.get(3, 1) or how.get(4, 1) or not how.get(5, 1):
                raise ValueError("only identity normalisation with a dummy prefix and kept white space is supported")
    if kind != bpe or fallback != 256:
        raise ValueError("only BPE models with all byte pieces are supported")
    return scores


class Counter(dict):
    """Segment -> number of tokens."""

    def __init__(self, scores: dict[str, float]):
        order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        joined = {c for p in self.rank if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece goes on after a word's end")
        lone = "" if "\n" in joined else "\n"
        self.find = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + "|\n" * bool(lone)).findall

    def __missing__(self, segment: str) -> int:
        n = self.merge(segment)
        if len(segment) <= 64:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[segment] = n
        return n

    def merge(self, segment: str) -> int:
        rank = self.rank
        parts = list(segment)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, p) for i in range(n - 1) if (r := rank.get(p := segment[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not parts[i] or parts[i] + parts[j] != piece:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = piece, ""
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(p := piece + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank.get(p := parts[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, p))
        return n - merges + sum(len(p.encode()) - 1 for p in parts if p and p not in rank)

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.find(SPACE + text.replace(" ", SPACE)))) if text else 0


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document."""
    with open(vocabulary, "rb") as f:
        scores = docs.sparkSession.sparkContext.broadcast(read_scores(f.read()))  # as large as the vocabulary

    bound_batches(docs.sparkSession)

    def run(batches):
        c = kept("token_count", vocabulary, lambda: Counter(scores.value))
        for b in pieces(batches):
            texts = byte_column(b)
            n = [c.count(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_())
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
