"""Removal of repeated passages: column-wise construction of sorted suffixes over many short documents.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller doc_id, or the same document and an
earlier start) is removed; strings are judged on the input, and never cross documents.

1. Each window of ``length`` bytes has an anchor, the string of ``gram`` bytes in it with the least hash
   (the leftmost of equals). Equal windows have equal anchors at equal offsets, so a window whose anchor
   occurs once in the corpus repeats nowhere. A filter over the anchors' hashes (see ``repeats``) rules these out.
2. The other anchors go out with their context, the bytes of the windows that they stand for; contexts that are equal in
   a batch go out once. A context is a short document, aligned at its anchor.
3. Contexts of one anchor are a collection. Its suffixes are sorted column by column, last to first: each round inserts one
   symbol of each document that reaches the column, sorts stably by it (the order of the last round is that of the
   rests), and updates the common prefixes of neighbours by minima over the last round's. The symbols in
   the rests' order are the column of the collection's Burrows-Wheeler transform. Equal windows are
   neighbours with a common prefix of ``length``; all but the earliest are marked.
4. Anchors with more than ``most`` contexts are split by document; of the windows that are first in their part, equal ones
   are found by their digests, aggregated before they meet.

Since equal windows are aligned at their anchors, suffixes of different columns never have to be compared, and the
transform is built a column at a time. Collections are bounded by ``most``, so that the sequential files of the
method are arrays in memory here; nothing is written on a machine's own disk.

Null texts are empty. Rows of equal doc_id and text are one document and get equal results. A null doc_id
stands after all others. A long text is taken in slices that overlap, with the same result. Where the filter of the allowed size would help little (above about eight keys a cell pair), it is
left out and all contexts go out: the result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, chunks, gather, give_back, materialize, mix64, pieces
from .repeats import MOST_BYTES, probe, repeat_filter

LENGTH, GRAM = 100, 32
MOST = 20_000
CHUNK_BYTES = 1 << 20
#: Text in which equal contexts are merged before they are sent.
GATHER_BYTES = 24 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, _INVERSE)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                _powers[k] = np.cumprod(x)
    return _powers


class Anchors:
    """The anchors of some texts (or slices of long ones): text, place, first and last window start, hash, and hash of the context."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.data = b"".join(texts)
        x = np.frombuffer(self.data, np.uint8)
        n, wide = len(x), length - gram + 1
        ends = np.cumsum(sizes)
        self.begins = ends - sizes
        if n < length:
            self.text = self.place = self.first = self.last = np.zeros(0, np.int64)
            self.key = self.whole = np.zeros(0, np.uint64)
            return
        up, down = _power(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
            h = mix64((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        low = np.uint64((1 << 28) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # slices are far shorter than 2**28 bytes
        span = 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        starts = np.flatnonzero(np.arange(n - length + 1) + length <= np.repeat(ends, sizes)[: n - length + 1])
        place = (least[starts] & low).astype(np.int64)
        text = np.searchsorted(ends, starts, "right")
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        self.text, self.place, self.first = text[at], place[at], starts[at]
        self.last = starts[np.append(at[1:], len(starts)) - 1] if len(at) else starts[at]
        self.key = h[self.place]
        with np.errstate(over="ignore"):
            self.whole = mix64((total[self.last + length] - total[self.first]) * down[self.first] + (self.place - self.first).astype(np.uint64))


def mark_repeats(group: np.ndarray, before: np.ndarray, contexts: list[bytes], rank: np.ndarray, length: int) -> np.ndarray:
    """Marks (context, window start) of windows that an earlier context of the group (by rank) has too.

    ``group`` is sorted; ``before`` is how many bytes of a context stand before its anchor. Column ``wide - before`` of a
    row is the context's first byte, and the anchor starts in column ``wide``.
    """
    n, wide = len(contexts), int(before.max(initial=0))
    sizes = np.array([len(c) for c in contexts], np.int64)
    left, right = wide - before, wide - before + sizes
    columns = int(right.max(initial=0))
    symbols = np.zeros((columns, n), np.uint8)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    row = np.repeat(np.arange(n), sizes)
    symbols[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + left[row], row] = flat
    marks = np.zeros((n, wide + 1), bool)
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    entering = np.argsort(right, kind="stable")[::-1]
    entered = 0
    first_out = int(left.max(initial=0))
    for c in range(columns - 1, -1, -1):
        if c < first_out and len(order):  # contexts that end before this column leave
            stay = np.flatnonzero(left[order] <= c)
            if len(stay) < len(order):
                if not len(stay):
                    order, common = order[:0], common[:0]
                else:
                    common = np.minimum.reduceat(common[: stay[-1] + 1], np.append(0, stay[:-1] + 1))
                    order = order[stay]
        until = entered
        while until < n and right[entering[until]] == c + 1:
            until += 1
        if until > entered:  # empty rests stand first in their group
            order = np.append(entering[entered:until], order)
            common = np.append(np.zeros(until - entered, np.int64), common)
            entered = until
            by_group = np.argsort(group[order], kind="stable")
            order, common = order[by_group], common[by_group]
        if not len(order):
            continue
        key = group[order] * 256 + symbols[c][order]  # the transform's column, by group
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        same = np.flatnonzero(key[1:] == key[:-1])
        a, b = moved[same], moved[same + 1]
        longer = common[b]
        far = np.flatnonzero(b > a + 1)
        if len(far):
            pairs = np.stack([a[far] + 1, b[far] + 1], 1).ravel()
            longer[far] = np.minimum.reduceat(np.append(common, 0), pairs)[::2]
        order = order[moved]
        common = np.zeros(len(order), np.int64)
        common[same + 1] = longer + 1
        if c <= wide:
            runs = np.flatnonzero(common < length)
            if len(runs) < len(order):
                of = rank[order]
                least = np.repeat(np.minimum.reduceat(of, runs), np.diff(np.append(runs, len(order))))
                marks[order[of != least], c] = True
    return marks


def slices(texts: list[bytes], length: int, most: int = CHUNK_BYTES):
    """Lists of texts of about ``most`` bytes, with each one's number and offset. A longer text comes in slices that share ``length`` - 1 bytes, so that
    each window stands in exactly one."""
    whole = [(t[a : a + most + length - 1], i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - length + 1), most)]
    for lo, hi in chunks([len(t) for t, _, _ in whole], most):
        yield tuple(map(list, zip(*whole[lo:hi], strict=True)))


def _clean(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("twin"))


def _keys_of(length: int, gram: int):
    def run(batches):
        for b in pieces(batches):
            texts = byte_column(b)
            for part, _, _ in slices(texts, length):
                yield Anchors(part, length, gram).key

    return run


_CONTEXT = "key long, doc_id long, twin long, place int, before int, first int, last int, context binary"


def _by_age(ids: np.ndarray, absent: np.ndarray, twin: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.lexsort((place, twin, ids, absent))


def _differ(lead: np.ndarray, *age: np.ndarray) -> np.ndarray:
    """Whether each row differs in age from the row that leads it; rows of equal age are one document's, repeated."""
    return np.any([x != x[lead] for x in age], axis=0)


def _contexts(bits, length: int, gram: int):
    """Contexts of anchors that may be repeated. Of equal ones in a batch the earliest has its bytes; the others are settled."""

    def run(batches):
        for b in gather(batches, GATHER_BYTES):
            texts, twins = byte_column(b), b.column("twin").to_numpy()
            ids = b.column("doc_id")
            absent, ids = np.array(ids.is_null()), ids.fill_null(0).to_numpy()
            parts = []
            for part, number, offset in slices(texts, length):
                a = Anchors(part, length, gram)
                on = np.flatnonzero(probe(bits.value, a.key)) if bits is not None else np.arange(len(a.key))
                shift = np.array(offset, np.int64) - a.begins
                parts.append(
                    (a.key[on], a.whole[on], np.array(number, np.int64)[a.text[on]], *(x[on] + shift[a.text[on]] for x in (a.place, a.first, a.last)))
                )
            if not parts:
                continue
            key, whole, text, place, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = _by_age(ids[text], absent[text], twins[text], place)
            if len(order):
                _, at, of = np.unique(np.stack([key, whole], 1)[order], axis=0, return_index=True, return_inverse=True)
                lead = np.empty(len(key), np.int64)
                lead[order] = order[at[of.reshape(-1)]]
                context_at = lambda i: texts[text[i]][first[i] : last[i] + length]
                for i in np.flatnonzero(lead != np.arange(len(key))).tolist():  # hashes only propose: bytes decide
                    if context_at(i) != context_at(lead[i]):
                        lead[i] = i
                sent = np.flatnonzero(  # a repeated row is no later copy
                    (lead == np.arange(len(key))) | _differ(lead, absent[text], ids[text], twins[text], place)
                )
                own = lead[sent] == sent
                key, text, place, first, last = (x[sent] for x in (key, text, place, first, last))
            else:
                own = np.zeros(0, bool)
            context = [
                texts[t][f : z + length] if o else None for t, f, z, o in zip(text.tolist(), first.tolist(), last.tolist(), own.tolist(), strict=True)
            ]
            for i in range(0, len(key), 20_000):
                s = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[s].view(np.int64)), pa.array(ids[text[s]], pa.int64(), mask=absent[text[s]]), pa.array(twins[text[s]]),
                        *(pa.array(x[s].astype(np.int32)) for x in (place, place - first, first, last)), pa.array(context[s], pa.binary())
                    ],
                    names=["key", "doc_id", "twin", "place", "before", "first", "last", "context"],
                )

    return run


def _settle(length: int, most: int):
    """Compares collections; rows come sorted by (key, part). Gives removed byte ranges, and digests of the first windows of split collections."""

    def compare(t: pa.Table):
        key = t.column("key").to_numpy()
        part, parts = t.column("part").to_numpy(), t.column("parts").to_numpy()
        absent = np.array(t.column("doc_id").combine_chunks().is_null())
        ids = t.column("doc_id").fill_null(0).to_numpy()
        twin, place, before, first, last = (t.column(c).to_numpy() for c in ("twin", "place", "before", "first", "last"))
        contexts = t.column("context").to_pylist()
        new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
        group = np.cumsum(new) - 1
        rank = np.empty(len(key), np.int64)
        rank[_by_age(ids, absent, twin, place)] = np.arange(len(key))
        best: dict[tuple, int] = {}
        for i, c in enumerate(zip(group.tolist(), before.tolist(), contexts, strict=True)):
            j = best.setdefault(c, i)
            if rank[i] < rank[j]:
                best[c] = i
        alone = np.array(sorted(best.values()), np.int64)
        lead = np.array([best[c] for c in zip(group.tolist(), before.tolist(), contexts, strict=True)], np.int64)
        twice = _differ(lead, absent, ids, twin, place)
        out = [(i, int(first[i]), int(last[i]) + length) for i in np.flatnonzero(twice).tolist()]
        several = np.bincount(group[alone], minlength=int(group[-1]) + 1)[group[alone]] > 1
        used = alone[several]
        marks = mark_repeats(
            group[used], before[used].astype(np.int64), [contexts[i] for i in used], rank[used], length
        ) if len(used) else np.zeros((0, 1), bool)
        wide = marks.shape[1] - 1
        padded = np.zeros((len(marks), marks.shape[1] + 2), np.int8)
        padded[:, 1:-1] = marks
        edge = np.diff(padded, axis=1)
        (r, a), (_, z) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        base = place[used] - wide
        out += list(zip(used[r].tolist(), (base[r] + a).tolist(), (base[r] + z - 1 + length).tolist(), strict=True))
        firsts = []
        of = dict(zip(used.tolist(), range(len(used)), strict=True))
        for i in alone[parts[alone] > 1].tolist():
            for s in range(int(first[i]), int(last[i]) + 1):
                if i not in of or not marks[of[i], s - place[i] + wide]:
                    w = contexts[i][s - first[i] : s - first[i] + length]
                    firsts.append((i, s, hashlib.blake2b(w, digest_size=16).digest()))
        rows = [(i, a, z, None) for i, a, z in out] + [(i, s, s + length, d) for i, s, d in firsts]
        at = np.array([x[0] for x in rows], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[at], pa.int64(), mask=absent[at]) if len(at) else pa.array([], pa.int64()),
                pa.array(twin[at]) if len(at) else pa.array([], pa.int64()), pa.array([x[1] for x in rows], pa.int32()),
                pa.array([x[2] for x in rows], pa.int32()), pa.array([x[3] for x in rows], pa.binary())
            ],
            names=["doc_id", "twin", "start", "end", "window"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= most:
                t = pa.Table.from_batches(held)
                k, p = t.column("key").to_numpy(), t.column("part").to_numpy()
                cut = int(np.flatnonzero((k != k[-1]) | (p != p[-1]))[-1]) + 1 if ((k != k[-1]) | (p != p[-1])).any() else 0
                if cut:
                    yield compare(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))
        give_back()

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, max_filter_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, twin, ranges) of documents with repeated bytes; twin is xxhash64 of the text, ranges may overlap."""
    spark, clean = docs.sparkSession, _clean(docs)
    n = (clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 2 // (length - gram + 2)
    bits = repeat_filter(clean.select("text"), _keys_of(length, gram), n, max_filter_bytes)
    shared = None if bits is None else spark.sparkContext.broadcast(bits)
    found = materialize(clean.mapInArrow(_contexts(shared, length, gram), _CONTEXT), "contexts", "zstd")
    sent = found.where("context IS NOT NULL")
    large = materialize(
        sent.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts")), "large"
    )
    parted = sent.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "doc_id", "twin"), "parts").cast("int"))
    settled = materialize(
        parted.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(
            _settle(length, most), "doc_id long, twin long, start int, end int, window binary"
        ),
        "ranges"
    )
    ranges = settled.where("window IS NULL").select("doc_id", "twin", "start", "end").unionByName(
        found.where("context IS NULL").select("doc_id", "twin", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    )
    windows = settled.where("window IS NOT NULL")
    age = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "twin", "start")
    if not large.isEmpty():
        earliest = materialize(windows.groupBy("window").agg(F.min(age).alias("age"), F.count("*").alias("n")).where("n > 1").drop("n"), "windows")
        late = windows.withColumn("own", age).join(earliest, "window").where(~F.col("own").eqNullSafe(F.col("age")))
        ranges = ranges.unionByName(late.select("doc_id", "twin", "start", "end"))
    return ranges.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def _merge(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted((r["start"], r["end"]) for r in ranges or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def _with_ranges(docs: DataFrame, **how) -> DataFrame:
    ranges = materialize(repeated_ranges(docs, **how), "by_doc").select(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin"), "ranges")
    return _clean(docs).join(
        ranges, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_twin")), "left"
    ).select("doc_id", "text", "ranges")


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """doc_id, kept (binary: the bytes that remain, which may split a character) and spans (array<struct<start, end>>)."""

    def run(batches):
        for b in pieces(batches):
            spans = [_merge(r) for r in b.column("ranges").to_pylist()]
            kept = [_cut(t, s) for t, s in zip(byte_column(b), spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(kept, pa.binary()),
                    pa.array(
                        [[{"start": a, "end": z} for a, z in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    )
                ],
                names=["doc_id", "kept", "spans"]
            )

    return _with_ranges(docs, **how).mapInArrow(run, "doc_id long, kept binary, spans array<struct<start:int,end:int>>")


def repeat_digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: digests of what ``remove_repeats`` gives, without moving it."""

    def run(batches):
        for b in pieces(batches):
            texts, spans = byte_column(b), [_merge(r) for r in b.column("ranges").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(z - a for a, z in s) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                    pa.array([hashlib.sha256(_cut(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string())
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _with_ranges(docs, **how).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
