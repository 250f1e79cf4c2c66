import hashlib
import random

import numpy as np
import pytest

from tidewright.llm import suffix_dedup


def brute(rows, length=100):
    """Rows in order of age; (doc_id, n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    seen, out = {}, []
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, _twin(r[1]))):
        b = t.encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                mark[s : s + length] = b"\1" * length
            seen[b[s : s + length]] = 1
        spans = sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        out.append((i, len(b), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(b, mark, strict=True) if not m)).hexdigest(), t))
    return out


_twins = {}


def _twin(t):
    return _twins[t]


def check(spark, df, **how):
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    for r in df.select(F.coalesce("text", F.lit("")).alias("t")).distinct().select("t", F.xxhash64("t").alias("h")).collect():
        _twins[r.t] = r.h
    want = {(x[0], x[5]): x[:5] for x in brute(rows, how.get("length", 100))}
    got = sorted((tuple(r) for r in suffix_dedup.repeat_digests(df, **how).collect()), key=str)
    assert got == sorted((want[i, t or ""] for i, t in rows), key=str)


def test_equals_brute_force(spark, docs):
    check(spark, docs)


@pytest.mark.parametrize("how", [{"most": 3}, {"max_filter_bytes": 0}, {"length": 60, "gram": 20}])
def test_other_ways(spark, docs, how):
    """Split collections, no filter, other lengths: the same rule."""
    check(spark, docs.where("doc_id < 120").repartition(7), **how)


def test_odd_rows(spark, odd, none, clashing):
    check(spark, odd)  # with its two long texts, all but equal
    assert suffix_dedup.repeat_digests(none).count() == 0 == suffix_dedup.remove_repeats(none).count()
    assert suffix_dedup.repeat_digests(clashing).count() == clashing.count()


def test_shared_passage(spark):
    """One passage in most documents, with other neighbours each time, and small collections."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    rows = [
        (
            i, " ".join([*(word() for _ in range(r.randrange(30))), passage[r.randrange(20) :], *(word() for _ in range(r.randrange(30)))])
        ) for i in range(60)
    ]
    rows += [(100, "a" * 700), (101, "b" * 99), (102, "ab" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check(spark, df, most=10)
    check(spark, df)


@pytest.mark.parametrize("how", [{}, {"most": 3}, {"max_filter_bytes": 0}])
def test_repeated_rows(spark, how):
    """Rows of equal doc_id and text are one document, in one batch or several: its earliest copy stays in each of them."""
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    alone, shared = text(80), text(100)
    rows = [(1, alone)] * 9 + [(2, shared)] * 5 + [(2, text(50))] + [(3, f"{text(9)} {shared}")] * 4 + [(None, text(60))] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        check(spark, df.repartition(parts), **how)
    got = suffix_dedup.repeat_digests(df, **how).where("doc_id = 1").collect()
    assert len(got) == 9 and {x.n_removed for x in got} == {0}


def test_long_texts_in_slices(spark, monkeypatch):
    """Texts far longer than a slice, with repeats inside a slice, across cuts and between documents."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(70))
    long = " ".join(passage if k % 400 == 399 else word() for k in range(2000))
    df = spark.createDataFrame([(1, long), (2, word() + long[3000:9000] + word()), (3, passage), (4, "x" * 8000)], "doc_id long, text string")
    want = sorted(map(str, suffix_dedup.repeat_digests(df).collect()))
    check(spark, df)
    texts = [t.encode() for _, t in df.collect()]
    for most in (150, 1000, 1 << 20):  # the same anchors, whatever the slices
        found = set()
        for part, number, offset in suffix_dedup.slices(texts, 100, most):
            a = suffix_dedup.Anchors(part, 100, 32)
            for t, f, z, p in zip(a.text, a.first, a.last, a.place, strict=True):
                shift = offset[t] - int(a.begins[t])
                found |= {(number[t], s + shift, int(p) + shift) for s in range(int(f), int(z) + 1)}
        assert len({x[:2] for x in found}) == len(found) == sum(max(0, len(t) - 99) for t in texts)
        if most > 1000:
            assert found == every
        every = found
    assert want


def test_equal_hashes_of_unequal_contexts(spark, monkeypatch):
    """Hashes propose, bytes decide."""
    r = random.Random(10)
    core = "".join(r.choice("abcdefghij") for _ in range(40))
    rows = [(i, "".join(r.choice("abcdefghij") for _ in range(80)) + core + "".join(r.choice("abcdefghij") for _ in range(80))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    run = suffix_dedup._contexts(None, 100, 32)
    original = suffix_dedup.Anchors.__init__

    def same(self, *a):
        original(self, *a)
        self.whole = np.zeros_like(self.whole)
        self.key = np.zeros_like(self.key)

    monkeypatch.setattr(suffix_dedup.Anchors, "__init__", same)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "twin": list(range(6))})
    got = [x for b in run([batch]) for x in b.column("context").to_pylist()]
    assert df.count() == 6 and None not in got


def test_kept_text(spark, docs):
    d = {r.doc_id: r for r in suffix_dedup.repeat_digests(docs).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in suffix_dedup.remove_repeats(docs).collect():
        t, kept, at = texts[r.doc_id], b"", 0
        for s in r.spans:
            kept, at = kept + t[at : s.start], s.end
        assert bytes(r.kept) == kept + t[at:] and hashlib.sha256(r.kept).hexdigest() == d[r.doc_id].kept_sha256


def test_marks():
    """The column-wise construction against plain comparison of windows."""
    r = random.Random(6)
    for _ in range(20):
        group, before, contexts = [], [], []
        for g in range(4):
            core = "".join(r.choice("ab") for _ in range(6)).encode()
            for _ in range(r.randrange(1, 9)):
                a, z = (bytes(r.choice(b"ab") for _ in range(r.randrange(5))) for _ in range(2))
                group.append(g), before.append(len(a)), contexts.append(a + core + z)
        n, length, wide = len(group), 7, max(before)
        rank = np.array(r.sample(range(n), n))
        marks = suffix_dedup.mark_repeats(np.array(group), np.array(before), contexts, rank, length)
        windows = {}
        for i in range(n):
            for s in range(len(contexts[i]) - length + 1):
                windows.setdefault((group[i], s - before[i], contexts[i][s : s + length]), []).append(i)
        want = np.zeros_like(marks)
        for (_, s, _), who in windows.items():
            for i in who:
                if s <= 0 and rank[i] != min(rank[k] for k in who):
                    want[i, s + wide] = True
        assert (marks == want).all()
