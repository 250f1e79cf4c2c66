"""Removal of passages that documents share: windows of words, level by level.

Each word is removed that lies in a window of ``width`` consecutive words whose word sequence also starts in a document with a
smaller doc_id. Windows are judged on the input and never cross documents.

Lengths double from ``shortest`` words to ``width`` (7 and 13 by default; 7, 14, 28, 50 for a width of 50), and only windows that hold
a window repeated at the last length go on to the next. No candidates left at a length ends the work: nothing is removed.

1. Below ``width``, windows are looked at where their content chooses: of the windows of one length within a window
   of the next, the one with the least hash. So equal windows of the next length choose equal ones, a window whose chosen part is in
   one document alone can't repeat, and about a quarter of all windows is sent. Hashes only propose here.
2. At ``width`` all windows go out that are still candidates, by 128-bit digests of 128-bit digests of their words, and the least doc_id
   of each comes back to that document alone: every other candidate is removed. So a passage that very many documents share is
   added up before it is sent, and nothing is sent to all of them.
3. The texts are dealt by doc_id once; the last two passes read that exchange.

A document whose words are those of an earlier one throughout is found in the first pass, by a digest of the whole, and loses all of them; its windows
go no further, as those of the earlier one stand for them.

At a shorter length, a window that several documents of one piece of a task's input hold is known to be repeated there: one row tells the others, the rest
go on without meeting. So the rows of one window grow with the pieces (``GATHER_BYTES`` of text each), not with its documents.

Null texts have no words. Rows with a null doc_id have no smaller doc_id and are none: they lose nothing and take nothing from others. Rows of
one doc_id are one document in two or more parts, none before the other. Long texts are taken whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, bound_batches, byte_column, chunks, gather, give_back, kept, materialize, mix64, pieces

WIDTH, SHORTEST = 13, 7
CHUNK_BYTES = 1 << 20
#: Text in which equal windows are merged before they are sent.
GATHER_BYTES = 24 << 20
_ROLL = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
#: Bytes that are hashed at a time; longer words are hashed alone.
HASHED_BYTES = 256 << 10
_GAP = np.isin(np.arange(256), list(SPACE_BYTES))


def lengths(width: int = WIDTH, shortest: int = SHORTEST) -> list[int]:
    """The lengths of the levels, each at most twice the one before."""
    if width < 2 or shortest < 1:
        raise ValueError("windows have two words at least")
    out = [min(shortest, -(-width // 2))]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


class _Digests(dict):
    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh3_128_digest(word)
        if len(word) <= 48:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, the powers of an odd number, and those of its inverse, all modulo 2^64."""
    up = lambda r: np.cumprod(np.r_[np.uint64(1), np.full(HASHED_BYTES, r, np.uint64)])
    r = int(_ROLL[0])
    return mix64(np.arange(1, 257).astype(np.uint64)), up(r), up(pow(r, -1, 1 << 64))


def quick_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from running sums of bytes times powers. Such hashes only propose."""
    b = np.frombuffer(text, np.uint8)
    gap = np.r_[True, _GAP[b], True]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends, out = edges[::2], edges[1::2], np.empty(len(edges) // 2, np.uint64)
    of_byte, powers, inverse = _powers()
    i = 0
    while i < len(out):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + HASHED_BYTES, "right"))
        if j == i:
            out[i], i = xxhash.xxh3_64_intdigest(text[lo : ends[i]]), i + 1
            continue
        x = of_byte[b[lo : ends[j - 1]]]
        x *= powers[: len(x)]
        upto = np.r_[np.uint64(0), np.cumsum(x)]
        out[i:j] = (upto[ends[i:j] - lo] - upto[starts[i:j] - lo]) * inverse[starts[i:j] - lo]
        i = j
    return mix64(out)


class Words:
    """The words of some texts in one row of arrays."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.total = int(counts.sum())
        self.ends = np.cumsum(counts)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.left = np.repeat(self.ends, counts) - np.arange(self.total)  # words from here to the text's end
        self.base = quick_hashes(b"\n".join(texts))

    def keys(self, n: int) -> np.ndarray:
        """A hash of the n words from each place on, without meaning where fewer are left."""
        out = self.base.copy()
        with np.errstate(over="ignore"):
            for k in range(1, min(n, max(self.total, 1))):
                out *= _ROLL[0]
                out[: self.total - k] += self.base[k:]
        return mix64(out)

    def digests(self, at: np.ndarray, n: int) -> np.ndarray:
        """128-bit digests, as two numbers, of the n words from each of some places on; only words in them are looked at."""
        held = np.zeros(self.total + 1, np.int32)
        np.add.at(held, at, 1)
        np.add.at(held, at + n, -1)
        held = np.cumsum(held[:-1]) > 0
        of = kept("word-digests", 0, _Digests).__getitem__
        found = b"".join(map(of, compress(chain.from_iterable(self.words), held.tobytes())))
        base = np.ascontiguousarray(np.frombuffer(found, "<u8").reshape(-1, 2).T) if found else np.zeros((2, 0), np.uint64)
        place = (np.cumsum(held) - 1)[at]
        out = base[:, place]
        with np.errstate(over="ignore"):
            for k in range(1, n):
                out *= _ROLL[:, None]
                out += base[:, place + k]
        return mix64(out)

    def chosen(self, keys: np.ndarray, n: int, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of ``longer`` words, and the start of the window of n words that each chooses, the leftmost of least ``keys``."""
        at = np.flatnonzero(self.left >= longer)
        pick, least = at.copy(), keys[at]
        for k in range(1, longer - n + 1):
            x = keys[at + k]
            lower = x < least
            pick[lower] = at[lower] + k
            least = np.minimum(least, x)
        return at, pick

    def candidates(self, rows: pa.RecordBatch, n: int, longer: int, width: int) -> np.ndarray:
        """Starts of the windows of ``longer`` words whose chosen window is among the ``keys`` of its row; none of texts that repeat an earlier one."""
        held = [None if copy else s for s, copy in zip(_sets(rows.column("keys")), _copies(self.words, rows, width), strict=True)]
        keys = self.keys(n)
        at, pick = self.chosen(keys, n, longer)
        found, cuts = [], np.searchsorted(self.doc[at], np.arange(len(held) + 1))
        for i, h in enumerate(held):
            a, z = cuts[i], cuts[i + 1]
            if z > a and h is not None and len(h):
                found.append(at[a:z][np.isin(keys[pick[a:z]], h)])
        return np.concatenate(found) if found else at[:0]


def _wholes(words: list[list[bytes]], width: int) -> np.ndarray:
    """The 128-bit digest of each text's words as two numbers; without meaning for texts that hold no window."""
    digests = b"".join([xxhash.xxh3_128_digest(b" ".join(w)) if len(w) >= width else bytes(16) for w in words])
    return np.frombuffer(digests, "<i8").reshape(-1, 2)


def _copies(words: list[list[bytes]], rows: pa.RecordBatch, width: int) -> np.ndarray:
    """Which rows are known to repeat the words of an earlier document throughout."""
    out = np.zeros(rows.num_rows, bool)
    for i, known in enumerate(rows.column("copies")):
        if known.is_valid and len(words[i]) >= width:
            out[i] = _wholes([words[i]], width)[0, 0] in known.as_py()
    return out


def _sets(column: pa.Array) -> list[np.ndarray | None]:
    """The 64-bit keys of each row; None where there are none."""
    return [None if not s.is_valid else s.values.to_numpy(zero_copy_only=False).view(np.uint64) for s in column]


def _parts(batch: pa.RecordBatch):
    """Words of some rows at a time, with the rows' numbers."""
    for lo in range(0, batch.num_rows, 1000):
        rows = batch.slice(lo, 1000)
        texts = byte_column(rows)
        for a, z in chunks([len(t) for t in texts], CHUNK_BYTES):
            yield Words(texts[a:z]), rows.slice(a, z - a)


#: What a row of the first passes says: a window of one document here, one of several, a whole text, a whole text that repeats another here.
ONE, SEVERAL, WHOLE, COPY = range(4)


def _first_of(keys: tuple[np.ndarray, ...], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (keys, document) pairs in order: their places, whether each is the first of its keys, and whether it is alone with them."""
    order = np.lexsort((docs, *keys[::-1]))
    sorted_ = [x[order] for x in (*keys, docs)]
    new = lambda columns: np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])] if len(docs) else np.zeros(0, bool)
    at = np.flatnonzero(new(sorted_))
    first = new([c[at] for c in sorted_[:-1]])
    return order[at], first, first & np.r_[first[1:], True][: len(first)]


def _propose(n: int, longer: int, before: int, width: int):
    """Keys of chosen windows of n words, one row for each document and key, and in the first pass one for each whole text.

    Rows of one ``slot`` meet: of those that are equal here only the first has the slot of its key.
    """

    def run(batches):
        for b in gather(batches, GATHER_BYTES):
            keys, docs, wholes, owners = [], [], [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
            for w, rows in _parts(b):
                of, ids = w.keys(n), rows.column("doc_id").to_numpy()
                _, pick = w.chosen(of, n, longer)
                pick = np.unique(pick)
                if before:
                    near = np.zeros(w.total, bool)  # windows of n words that hold a repeated one
                    near[w.candidates(rows, before, n, width)] = True
                    pick = pick[near[pick]]
                else:
                    long = np.array([len(x) >= width for x in w.words])
                    wholes.append(_wholes(w.words, width)[long])
                    owners.append(ids[long])
                keys.append(of[pick].view(np.int64))
                docs.append(ids[w.doc[pick]])
            if not keys:
                continue
            k, d = np.concatenate(keys), np.concatenate(docs)
            at, first, alone = _first_of((k,), d)
            k, d = k[at], d[at]
            whole, owner = np.concatenate(wholes), np.concatenate(owners)
            at, leads, _ = _first_of((whole[:, 0], whole[:, 1]), owner)
            whole, owner = whole[at], owner[at]
            elsewhere = lambda key, doc: mix64(key.view(np.uint64) ^ mix64(doc.view(np.uint64))).view(np.int64)
            columns = [
                np.r_[np.where(first, k, elsewhere(k, d)), np.where(leads, whole[:, 0], elsewhere(whole[:, 0].copy(), owner))], np.r_[d, owner],
                np.r_[k, whole[:, 0]], np.r_[np.zeros(len(k), np.int64), whole[:, 1]],
                np.r_[np.where(alone, ONE, SEVERAL), np.where(leads, WHOLE, COPY)].astype(np.int8)
            ]
            known = np.r_[first, leads]  # such rows have their key for a slot
            yield pa.RecordBatch.from_arrays([pa.array(c, mask=known if i == 2 else None) for i, c in enumerate(columns)], names=_SENT_NAMES)
        give_back()

    return run


_SENT = "slot long, doc_id long, key long, rest long, kind byte"
_SENT_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _repeated(batches):
    """Of rows in the order of ``slot``: (doc_id, key, null) of windows that several documents hold, (doc_id, null, copy) of texts that
    repeat an earlier document's. Rows of one slot are held until it ends."""
    held: list[pa.RecordBatch] = []

    def settle(t: pa.Table):
        slot, doc, rest, kind = (t.column(c).to_numpy() for c in ("slot", "doc_id", "rest", "kind"))
        key = pc.coalesce(t.column("key"), t.column("slot")).to_numpy()
        window, lead = np.flatnonzero(kind <= SEVERAL), np.flatnonzero(kind == WHOLE)
        hit = window[:0]
        if len(window):
            starts = np.flatnonzero(np.r_[True, slot[window][1:] != slot[window][:-1]])
            several = np.maximum.reduceat(doc[window], starts) != np.minimum.reduceat(doc[window], starts)
            several |= np.maximum.reduceat(kind[window], starts) == SEVERAL
            hit = window[np.repeat(several, np.diff(np.r_[starts, len(window)]))]
        at, first, _ = _first_of((slot[lead], rest[lead]), doc[lead])
        late = np.r_[lead[at[~first]], np.flatnonzero(kind == COPY)]
        out = np.r_[hit, late]
        is_copy = np.arange(len(out)) >= len(hit)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[out]), pa.array(key[out], mask=is_copy), pa.array(key[out], mask=~is_copy)], names=["doc_id", "key", "copy"]
        )

    for b in batches:
        if not b.num_rows:
            continue
        slot = b.column("slot").to_numpy()
        last = int(np.searchsorted(slot, slot[-1]))
        if held and (last or slot[0] != held[-1].column("slot")[-1].as_py()):
            yield settle(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = []
        elif last:
            yield settle(pa.Table.from_batches([b.slice(0, last)]))
        held.append(b.slice(last))
    if held:
        yield settle(pa.Table.from_batches(held))
    give_back()


def _digests(n: int, width: int):
    """Digests of the candidates, with the least doc_id of each among the rows at hand."""

    def run(batches):
        for b in gather(batches, GATHER_BYTES):
            found = []
            for w, rows in _parts(b):
                at = w.candidates(rows, n, width, width)
                found.append((*w.digests(at, width), rows.column("doc_id").to_numpy()[w.doc[at]]))
            x, y, d = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((d, y, x))
            x, y, d = x[order], y[order], d[order]
            first = np.ones(len(x), bool)
            first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[first].view(np.int64)) for c in (x, y, d)], names=["x", "y", "doc_id"])
        give_back()

    return run


def _keep(n: int, width: int, make):
    """Rows made from the words of each document and which of them stay."""

    def run(batches):
        for b in pieces(batches):
            for w, rows in _parts(b):
                removed = np.zeros(w.total + 1, np.int32)
                for i in np.flatnonzero(_copies(w.words, rows, width)):
                    removed[w.ends[i] - len(w.words[i])] += 1
                    removed[w.ends[i]] -= 1
                if rows.column("keys").null_count < rows.num_rows:
                    at = w.candidates(rows, n, width, width)
                    own, cuts = w.digests(at, width)[0], np.searchsorted(w.doc[at], np.arange(rows.num_rows + 1))
                    for i, firsts in enumerate(_sets(rows.column("firsts"))):
                        mine = at[cuts[i] : cuts[i + 1]]
                        late = mine if firsts is None else mine[~np.isin(own[cuts[i] : cuts[i + 1]], firsts)]
                        removed[late] += 1
                        removed[late + width] -= 1
                stays = np.cumsum(removed[:-1]) == 0
                yield make(rows, w.words, np.split(stays, w.ends[:-1]))

    return run


def _clean(docs: DataFrame) -> DataFrame:
    """doc_id and text; a column that is a string already is left as it is, so that Spark sees both uses of the dealt texts as one exchange."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text" if docs.schema["text"].dataType.simpleString() == "string" else F.col("text").cast("string").alias("text"))


def _by_doc(found: DataFrame, **lists: str) -> DataFrame:
    """Lists of the values that aren't null; an empty one is null."""
    listed = found.groupBy("doc_id").agg(*[F.collect_list(c).alias(n) for n, c in lists.items()])
    return listed.select("doc_id", *[F.when(F.size(n) > 0, F.col(n)).alias(n) for n in lists])


def _judged(docs: DataFrame, width: int, shortest: int) -> tuple[DataFrame, int]:
    """doc_id, text, keys (chosen windows of the last but one length that are repeated), copies (digests of texts of this doc_id that repeat an
    earlier document's) and firsts (windows of ``width`` that are first here)."""
    clean, levels, lists = _clean(docs), lengths(width, shortest), ("keys", "copies", "firsts")
    at_hand, before = clean.where(F.col("doc_id").isNotNull()), 0
    texts = at_hand.repartition("doc_id")
    untouched = lambda df, names: df.withColumns({c: F.lit(None).cast("array<long>") for c in names})
    for n, longer in pairwise(levels):
        sent = at_hand.mapInArrow(_propose(n, longer, before, width), _SENT)
        found = sent.repartition("slot").sortWithinPartitions("slot").mapInArrow(_repeated, "doc_id long, key long, copy long")
        if before:  # copies are known from the first pass
            held = _by_doc(found, keys="key").join(held.select("doc_id", "copies").where("copies IS NOT NULL"), "doc_id", "full")
        else:
            held = _by_doc(found, keys="key", copies="copy")
        held = materialize(held, "repeated", "zstd")
        at_hand, before = texts.join(held.where("keys IS NOT NULL").hint("shuffle_hash"), "doc_id"), n
        if held.where("keys IS NOT NULL").isEmpty():
            break
    joined = texts.join(held.hint("shuffle_hash"), "doc_id", "left")
    if before == levels[-2]:
        firsts = at_hand.mapInArrow(_digests(before, width), "x long, y long, doc_id long").groupBy("x", "y").agg(F.min("doc_id").alias("doc_id"))
        joined = joined.join(_by_doc(firsts, firsts="x").hint("shuffle_hash"), "doc_id", "left")
    else:
        joined = untouched(joined, ["firsts"])
    return joined.unionByName(untouched(clean.where(F.col("doc_id").isNull()), lists)), before


def remove_passages(docs: DataFrame, width: int = WIDTH, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, kept (the words that stay, joined by a space) and n_removed."""

    def make(rows, words, stays):
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"), pa.array([b" ".join(compress(w, s.tobytes())) for w, s in zip(words, stays, strict=True)], pa.binary()),
                pa.array([int((~s).sum()) for s in stays], pa.int64())
            ],
            names=["doc_id", "kept", "n_removed"]
        )

    judged, n = _judged(docs, width, shortest)
    kept_words = judged.mapInArrow(_keep(n, width, make), "doc_id long, kept binary, n_removed long")
    return kept_words.withColumn("kept", F.col("kept").cast("string"))


def passage_digests(docs: DataFrame, width: int = WIDTH, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: digests of what ``remove_passages`` gives, without moving it."""

    def make(rows, words, stays):
        kept_words = [hashlib.sha256(b" ".join(compress(w, s.tobytes()))).hexdigest() for w, s in zip(words, stays, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([int((~s).sum()) for s in stays], pa.int64()),
                pa.array(kept_words, pa.string())
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"]
        )

    judged, n = _judged(docs, width, shortest)
    return judged.mapInArrow(_keep(n, width, make), "doc_id long, n_words long, n_removed long, kept_sha256 string")
