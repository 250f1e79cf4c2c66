"""Secret scan with linking of credentials that come in parts. DataFrame functions only.

Base kinds stand alone: ``assign`` (a keyword set to a value of 12 or more characters), ``access``
(AKIA and more, 18 or more characters) and ``hex`` (16 or more lower-case digits). Weak candidates
(``id``: a prefixed access identifier; ``key``: a run of 32 or more base64 characters that isn't ``hex``; ``endpoint``: a
URL or a storage host) are noise alone. They are reported where complementary parts stand within
``scope`` code points of each other in one document: an identifier or an endpoint near a secret. That
is an interval join on (document, block of ``scope`` code points), so that no document's
candidates meet all of each other.

Positions are code points, end exclusive. A null or empty text has no spans. Each input row gives one
row, repeated rows too. Texts are scanned whole.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

#: Kinds in the order of ties, with their patterns (Java). Runs are maximal, so a least length in
#: the pattern finds what a filter on all runs would; ``assign`` needs the filter, see LEAST_VALUE.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA|GOOG)[A-Z0-9]{12,}",
    "key": r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9a-f]*[A-Zg-z+/])[A-Za-z0-9+/]{32,}={0,2}",
    "endpoint": r"""(?:https?|s3|ftp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}|[a-z0-9][a-z0-9.-]{1,80}\.(?:amazonaws|azure|googleapis)\.com""",
}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 12
#: What counts as which part of a credential.
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "id"), ("assign", "hex", "key"), ("endpoint",)
#: An endpoint of a store. A bare ``hex`` run is often a commit or a checksum, and commits stand beside links: it counts as a secret near
#: identifiers and such endpoints, not near any link.
STORE = r"^s3://|\.(?:amazonaws|azure|googleapis)\.com"
#: Text that every match of a kind has; texts without it are not searched for the kind.
HINTS = {"access": ("AKIA",), "id": ("AKIA", "ASIA", "AIDA", "AROA", "GOOG"), "endpoint": ("://", ".com")}


def _found(kind: str, text: Column) -> Column:
    """array<struct<kind, gap, n, ok, store>> of one kind: the text before a match since the last one, and its length."""
    pattern = F.lit(PATTERNS[kind])
    gaps, matches = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else matches
    zipped = F.filter(F.arrays_zip(gaps.alias("g"), matches.alias("m"), values.alias("v")), lambda x: x["m"].isNotNull())
    ok = (lambda x: F.length(x["v"]) >= LEAST_VALUE) if kind == "assign" else (lambda x: F.lit(True))
    rows = F.transform(
        zipped,
        lambda x: F.struct(
            F.lit(list(PATTERNS).index(kind)).alias("kind"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("n"), ok(x).alias("ok"),
            (F.regexp_like(x["m"], F.lit(STORE)) if kind == "endpoint" else F.lit(True)).alias("store")
        )
    )
    found = F.regexp_like(text, pattern)
    hints = [F.contains(text, F.lit(h)) for h in HINTS.get(kind, ())]
    return F.when(functools.reduce(lambda a, b: a | b, hints) & found if hints else found, rows)


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (_row, doc_id), and the candidates (_row, kind, start, end, store) of every kind; texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("_row"))
    hits = materialize(rows.select("doc_id", "_row", *[_found(k, F.col("text")).alias(k) for k in PATTERNS]), "hits")
    each = None
    for k in PATTERNS:
        one = hits.where(F.col(k).isNotNull()).select("_row", F.posexplode(k).alias("i", "x")).select("_row", "i", "x.*")
        each = one if each is None else each.unionByName(one)
    before = W.partitionBy("_row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    spans = each.withColumn("end", end).where("ok").select("_row", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "store")
    return hits.select("doc_id", "_row"), materialize(spans, "spans")


def _kinds(names: tuple[str, ...]) -> Column:
    return F.col("kind").isin([list(PATTERNS).index(k) for k in names])


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """The spans of ``left`` that have one of ``right`` within ``scope``: an interval semi-join on blocks."""
    blocks = lambda a, z: F.explode(F.sequence(F.floor(a / scope), F.floor(z / scope)))
    a = left.withColumn("_block", blocks(F.col("start") - scope, F.col("end") + scope))
    b = right.select(
        "_row", F.col("start").alias("s"), F.col("end").alias("e"), F.col("kind").alias("k"), F.col("store").alias("st")
    ).withColumn("_block", blocks(F.col("s"), F.col("e")))
    same = (F.col("a.kind") == F.col("b.k")) & (F.col("a.start") == F.col("b.s"))
    bare, link_ = list(PATTERNS).index("hex"), list(PATTERNS).index("endpoint")
    loose = ((F.col("a.kind") == bare) & (F.col("b.k") == link_) & ~F.col("b.st")) | (
        (F.col("a.kind") == link_) & (F.col("b.k") == bare) & ~F.col("a.store")
    )
    met = a.alias("a").join(
        b.alias("b"),
        (F.col("a._row") == F.col("b._row")) & (F.col("a._block") == F.col("b._block")) & (F.col("b.s") <= F.col("a.end") + scope) & (
            F.col("b.e") >= F.col("a.start") - scope
        ) & ~same & ~loose,
        "left_semi"
    )
    return met.select("_row", "kind", "start", "end").distinct()


def link(spans: DataFrame, scope: int = 200) -> DataFrame:
    """The weak candidates with a complementary part in scope."""
    secrets, partners = spans.where(_kinds(SECRETS)), spans.where(_kinds(IDENTIFIERS + ENDPOINTS))
    weak = F.col("kind").isin([list(PATTERNS).index(k) for k in PATTERNS if k not in BASE])
    return _near(partners.where(weak), secrets, scope).unionByName(_near(secrets.where(weak), partners, scope))


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id and ``spans`` (array<struct<start, kind, end, name>>, by start, kind, end), one row for each document."""
    rows, spans = scan(docs)
    names = F.array(*[F.lit(k) for k in PATTERNS])
    told = spans.where(_kinds(BASE)).drop("store").unionByName(link(spans, scope)).select(
        "_row", F.struct("start", "kind", "end", names[F.col("kind")].alias("name")).alias("x")
    )
    by_row = told.groupBy("_row").agg(F.array_sort(F.collect_list("x")).alias("spans"))
    return rows.join(by_row, "_row", "left").select("doc_id", F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text)."""
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    text = lambda a: F.array_join(
        F.transform(a, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans")
    )
