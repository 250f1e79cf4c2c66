"""Removal of shared passages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import COLUMNS, SF
from tests.oracle import assert_same, connect
from tidewright.llm import queries, substring_dedup


def brute(docs, width=13):
    """The rows of the query, from (doc_id, text)."""
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    least = defaultdict(list)
    for d, w in split:
        if d is not None:
            for i in range(len(w) - width + 1):
                least[tuple(w[i : i + width])].append(d)
    least = {k: min(v) for k, v in least.items()}
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and least[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def run(docs, **how):
    return Counter(tuple(r) for r in substring_dedup.passage_digests(docs, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_equals_sql(spark):
    assert_same(queries.QUERIES["op13_substring_dedup"](spark, SF), connect(SF), queries.ORACLES["op13_substring_dedup"])


def test_equals_brute_force(docs, rows):
    assert run(docs) == brute(rows)


def made(seed, n=60):
    """Texts of few words with shared passages of all lengths, repeated within and across documents."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    shared = [[r.choice(words) for _ in range(r.randint(3, 60))] for _ in range(6)]
    out = []
    for d in range(n):
        w = []
        for _ in range(r.randint(0, 4)):
            w += r.choice(shared)[r.randint(0, 5) :] if r.random() < 0.5 else [r.choice(words) + str(r.randint(0, 9)) for _ in range(r.randint(0, 20))]
        out.append((d if r.random() < 0.9 else r.randint(0, n), r.choice([" ", "\n", "\t "]).join(w)))
    return out


@pytest.mark.parametrize("width", [2, 3, 5, 13, 30, 64])
def test_equals_brute_force_at_other_widths(spark, width):
    data = made(width)
    assert run(spark.createDataFrame(data, "doc_id long, text string"), width=width) == brute(data, width)


def test_pieces_of_a_task_agree(spark, monkeypatch):
    """The same whether equal windows meet in a task or not."""
    data = made(7) * 2 + [(1000 + i, "a b c d e f g h i j k l m n o p") for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute(data)
    assert run(df.repartition(9)) == want == run(df.coalesce(1))


def test_odd_rows(odd):
    assert run(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_no_rows_and_clashing_names(spark, none, clashing, rows):
    assert run(none) == Counter()
    assert run(clashing) == brute(rows)
    alone = [(1, "a b c"), (2, " ".join(map(str, range(50)))), (None, "x")]
    assert run(spark.createDataFrame(alone, "doc_id long, text string")) == brute(alone)  # no candidate is left at the first length


def test_a_null_doc_id_takes_and_loses_nothing(spark):
    text = " ".join(f"t{i}" for i in range(20))
    data = [(None, text), (3, text), (None, text), (4, "x " + text + " y")]
    got = {(r.doc_id, r.kept, r.n_removed) for r in substring_dedup.remove_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(None, text, 0), (3, text, 0), (4, "x y", 20)}


def test_rows_of_one_doc_id_are_one_document(spark):
    text = " ".join(f"t{i}" for i in range(20))
    data = [(3, text, "en", "a", 1), (3, text, "en", "a", 1), (3, "é " + text, None, None, None), (2, "z", "en", "a", 1)]
    assert run(spark.createDataFrame(data, COLUMNS)) == brute([r[:2] for r in data])


def test_lengths_double():
    assert substring_dedup.lengths(13) == [7, 13]
    assert substring_dedup.lengths(50) == [7, 14, 28, 50]
    assert substring_dedup.lengths(2) == [1, 2] and substring_dedup.lengths(64, 4) == [4, 8, 16, 32, 64]
    with pytest.raises(ValueError):
        substring_dedup.lengths(1)


def test_rows_in_order_of_slot_may_come_in_any_batches():
    """A slot that spans batches is settled when it ends."""
    import pyarrow as pa

    one, several, whole, copy = range(4)
    rows = [(1, 5, one), (1, 5, one), (2, 6, one), (3, 1, one), (3, 1, one), (3, 1, one), (3, 2, one), (7, 4, whole), (7, 3, whole), (8, 9, copy), (9, 8, several)]
    kinds = [("slot", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("rest", pa.int64()), ("kind", pa.int8())]
    table = pa.Table.from_pylist([{"slot": s, "doc_id": d, "key": None, "rest": 0, "kind": k} for s, d, k in rows], pa.schema(kinds))
    for size in range(1, 12):
        got = pa.Table.from_batches(list(substring_dedup._repeated(table.to_batches(size)))).to_pylist()
        assert sorted((r["key"], r["doc_id"]) for r in got if r["copy"] is None) == [(3, 1), (3, 1), (3, 1), (3, 2), (9, 8)]
        assert sorted((r["copy"], r["doc_id"]) for r in got if r["key"] is None) == [(7, 4), (8, 9)]


@pytest.mark.parametrize("width", [13, 30])
def test_whole_copies_alone(spark, width):
    """Copies of whole texts, beside which nothing is repeated, at one and at several lengths; one doc_id with a copy and another text."""
    text = " ".join(f"t{i}" for i in range(40))
    other = " ".join(f"u{i}" for i in range(40))
    data = [(5, text), (2, text.replace(" ", "  ")), (9, text), (9, other), (9, text), (1, "short " * 3), (4, "short " * 3), (7, text + " more"), (None, text)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert run(df, width=width) == brute(data, width) == run(df.repartition(5), width=width)
    copies = [(i, text) for i in range(20)]
    assert run(spark.createDataFrame(copies, "doc_id long, text string").repartition(6), width=width) == brute(copies, width)


def test_words_are_hashed_once_and_digested_in_candidates_alone(monkeypatch):
    """Equal words have equal hashes wherever they stand, long ones too; 128-bit digests are made of the words of given windows."""
    long = b"x" * (substring_dedup.HASHED_BYTES + 5)
    texts = [b"", b" one  two\x0bone\n", long + b" two " + long, b"w " * 200_000, "é ß\xa0x é".encode(), b"two"]
    w = substring_dedup.Words(texts)
    words = [x for t in texts for x in t.split()]
    assert len(w.base) == w.total == len(words)
    assert len(set(zip(words, w.base.tolist(), strict=True))) == len(set(words)) == len(set(w.base.tolist()))
    assert len(substring_dedup.Words([b"", b" "]).base) == 0 == len(substring_dedup.Words([b""]).base)
    seen = []
    digest = substring_dedup.xxhash.xxh3_128_digest
    monkeypatch.setattr(substring_dedup.xxhash, "xxh3_128_digest", lambda x: seen.append(x) or digest(x))
    v = substring_dedup.Words([b"a1 b1 c1 d1 e1", b"z1 b1 c1 q1"])
    x = v.digests(np.array([1, 6]), 2)
    assert sorted(seen) == [b"b1", b"c1"] and x[:, 0].tolist() == x[:, 1].tolist() and v.digests(np.zeros(0, int), 2).shape == (2, 0)
