"""Byte-level BPE through a sentencepiece model that is serialised from the ranks.

Each byte is mapped to one printable character; a vocabulary entry becomes a piece of such
characters scored by its negative rank, under identity normalisation. No model is trained. Texts are
cut into pre-tokens by the pattern; a pre-token that is itself an entry gets that id, any other is
encoded by the model. Ids map back to bytes through the inverse of the byte map.

A null text counts as empty and has no ids; the SHA-256 columns are then those of no bytes.
Repeated rows get equal results; very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, byte_column, free_names, kept, pieces

MOST_CACHED = 150_000


def byte_characters() -> list[str]:
    """A character for each byte value: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One field of a protocol buffer: an integer, a float or a length-delimited value."""
    if isinstance(value, bool | int):
        return _varint(number << 3) + _varint(int(value))
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: <unk>, then the entries in order of rank, so that an id is a rank plus 1."""
    chars = byte_characters()
    unknown, normal, bpe = 2, 1, 2  # values of the model's enumerations
    out = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for entry, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(chars[b] for b in entry)) + _field(2, -float(rank)) + _field(3, normal)))
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, 0)
    for special in (41, 42, 43):  # no begin, end or padding
        trainer += _varint(special << 3) + _varint((1 << 64) - 1)
    normalizer = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec(dict):
    """Pre-token -> its ids as little-endian bytes; made once in each worker."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.table = {i: c for i, c in enumerate(self.chars)}
        back = {c: b for b, c in enumerate(self.chars)}
        pieces = [self.processor.id_to_piece(i) for i in range(1, self.processor.get_piece_size())]
        self.whole = {p: i for i, p in enumerate(pieces)}
        self.bytes_of = [bytes(back[c] for c in p) for p in pieces]

    def __missing__(self, token: str) -> bytes:
        mapped = token.encode().decode("latin-1").translate(self.table)
        known = self.whole.get(mapped)
        ids = [known] if known is not None else [i - 1 for i in self.processor.encode(mapped)]
        out = np.array(ids, "<u4").tobytes()
        if len(token) <= 64:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[token] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text))), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(model: bytes, pattern: str) -> Codec:
    return kept("byte_bpe", hashlib.sha256(model + pattern.encode()).digest(), lambda: Codec(model, pattern))


def _model(spark: SparkSession, path: str):
    bound_batches(spark)
    return spark.sparkContext.broadcast(serialise(read_ranks(path)))  # as large as the vocabulary, about 1.5 MB


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>) and ``decoded`` (binary), the bytes that the ids map back to, as the last two columns.

    Where ``docs`` has columns of these names, they stay, and the new ones have underscores before their names.
    """
    model = _model(docs.sparkSession, vocabulary)
    names = free_names(docs.columns, ("token_ids", "decoded"))

    def run(batches):
        c = codec(model.value, pattern)
        for b in pieces(batches):
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [c.encode(t.decode()) for t in byte_column(part)]
                flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
                yield part.append_column(names[0], lists).append_column(names[1], pa.array([c.decode(x.tolist()) for x in ids], pa.binary()))

    return docs.mapInArrow(run, docs.limit(0).withColumns({names[0]: F.lit(None).cast("array<int>"), names[1]: F.lit(None).cast("binary")}).schema)


def add_tokens(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``docs`` with token_ids, n_tokens and round_trip (whether the ids map back to the text), named like ``encode_documents`` names its columns."""
    coded = encode_documents(docs, vocabulary, pattern)
    ids, decoded = coded.columns[-2:]
    n_tokens, round_trip = free_names(coded.columns, ("n_tokens", "round_trip"))
    same = F.col(f"`{decoded}`") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.withColumns({n_tokens: F.size(f"`{ids}`").cast("long"), round_trip: same}).drop(F.col(f"`{decoded}`"))


def decode_ids(ids: DataFrame, vocabulary: str, pattern: str, column: str = "token_ids") -> DataFrame:
    """``ids`` with ``decoded`` (binary, the last column, named as in ``encode_documents``); a null list maps to no bytes."""
    model = _model(ids.sparkSession, vocabulary)
    (name,) = free_names(ids.columns, ("decoded",))

    def run(batches):
        c = codec(model.value, pattern)
        for b in batches:
            yield b.append_column(name, pa.array([c.decode(x or []) for x in b.column(column).to_pylist()], pa.binary()))

    return ids.mapInArrow(run, ids.limit(0).withColumn(name, F.lit(None).cast("binary")).schema)


def token_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what ``encode_documents`` gives, without moving it."""
    model = _model(docs.sparkSession, vocabulary)

    def run(batches):
        c = codec(model.value, pattern)
        for b in pieces(batches):
            n, a, z = [], [], []
            for t in byte_column(b):
                ids = c.encode(t.decode())
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                z.append(hashlib.sha256(c.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
