"""Filter interactions and source divergence against brute force, on the test tables and on odd rows."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tests.oracle import assert_same, connect
from tidewright.llm import divergence, filter_audit, queries


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_source_divergence"])
def test_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(4, 1, 0), (5, 0, 1), (5, 1, 0), (7, 1, 1), (12, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )


def brute_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, bad = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    fails = defaultdict(list)
    for d, t, part in docs:
        t = t or ""
        w = words(t)
        f = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d
        }
        fails[part or ""].append(({x for x in f if f[x]}, d in good, d in bad))
    out, shapley = [], Counter()
    for part, rows in fails.items():
        for o in map("".join, permutations("ABCDE")):
            for step, x in enumerate(o):
                early = set(o[:step])
                gone = [r for r in rows if x in r[0] and not r[0] & early]
                shapley[part, x] += len(gone)
                out.append([
                    part, o, step + 1, sum(not r[0] & (early | {x}) for r in rows), len(gone), sum(x in r[0] and bool(r[0] & early) for r in rows),
                    sum(r[0] == {x} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)
                ])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_odd_rows(odd, labels):
    got = sorted(tuple(r) for r in filter_audit.audit(odd, labels).select(*AUDIT).collect())
    want = brute_audit([(r.doc_id, r.text, r.lang) for r in odd.collect()], [tuple(r) for r in labels.collect() if r.doc_id is not None])
    assert got == want


def test_audit_of_no_rows_and_clashing_names(none, clashing, labels):
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(clashing, labels).count() == 600 * clashing.select("lang").distinct().count()
    assert filter_audit.audit(clashing, labels.limit(0)).agg(F.max("good_lost")).first()[0] == 0


def test_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("x", 0), ("x", 1), ("x", 3), ("x", 2)], "part string, mask int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.interactions(masks, "PQ").collect()}
    assert got == {("PQ", 1): (2, 2, 0, 1, 3), ("PQ", 2): (1, 1, 1, 1, 3), ("QP", 1): (2, 2, 0, 1, 3), ("QP", 2): (1, 1, 1, 1, 3)}
    for letters in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            filter_audit.interactions(masks, letters)


def brute_divergence(docs, min_docs, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text)))
        counts[lang, source].update(found)
        held[lang].update(found.keys())
    out = []
    for lang, source in counts:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        all_of = Counter()
        for (other, _), c in counts.items():
            if other == lang:
                all_of.update(c)

        def shares(c, kept=kept):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) * (p - q) // (p + q)
        p, q = shares(counts[lang, source]), shares(all_of)
        pairs = []
        for other, s in counts:
            if other == lang and s != source:
                r = shares(counts[other, s])
                pairs.append((s, sum(f(p[t], r[t]) for t in kept)))
        marks = [(t, f(p[t], q[t])) for t in kept if counts[lang, source][t] > 0 and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", marks, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


DIVERGENCE = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_divergence_of_odd_rows(odd, min_docs):
    got = sorted(tuple(r) for r in divergence.source_divergence(odd, min_docs, 3).select(*DIVERGENCE).collect())
    assert got == brute_divergence([(r.text, r.lang, r.source) for r in odd.collect()], min_docs, 3)


def test_divergence_of_no_rows_and_clashing_names(none, clashing, docs):
    assert divergence.source_divergence(none).count() == 0
    same = lambda df: sorted(tuple(r) for r in divergence.source_divergence(df).select(*DIVERGENCE).collect())
    assert same(clashing) == same(docs)


def test_counts_of_one_task_go_on_in_parts(docs, monkeypatch):
    """Terms sent on before a task's end are added up."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"lang": "en", "source": s, "text": t} for s in "ab" for t in ("b a a", "c a", None, "b")])
    whole = Counter()
    for b in divergence._tally([batch]):
        whole.update({(r["source"], r["term"], k): r[k] for r in b.to_pylist() for k in ("n", "docs")})
    monkeypatch.setattr(divergence, "HELD_BYTES", 1)
    parts = Counter()
    for b in divergence._tally([batch]):
        parts.update({(r["source"], r["term"], k): r[k] for r in b.to_pylist() for k in ("n", "docs")})
    assert whole == parts and whole["a", b"a", "n"] == 3 and whole["a", b"a", "docs"] == 2


def test_shares_are_exact_for_large_counts(spark):
    big = 9 * 10**18
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(big), F.lit(7))).first()[0]
    assert row == 1 + 10**9 * (big + 2) // (big + 14)
