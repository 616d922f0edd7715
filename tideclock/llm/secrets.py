"""Secret scans over an incremental blob ledger.

Texts are content-addressed: every version of every path that has the same
text is one blob. The ledger holds what each rule version found in each blob;
only pairs of blob and rule version that it lacks are scanned, and findings
are joined back to all paths and versions of a blob.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideclock.llm import scratch

#: Kind, pattern, group that must be long enough, least length. Base kinds come first.
RULES = (
    ("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
BASE_KINDS = 3
#: Stands for RULES in the ledger: other rules have another version.
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]

LEDGER = "blob string, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string"
#: A finding row of a blob goes to so many tasks when it is joined back to its paths.
SALTS = 32

# A run of 24 hex digits at least is what remains of maximal runs once short ones are dropped.
_COMPILED = [(kind, re.compile(r"[0-9a-f]{24,}" if kind == "hex" else pattern), group, least) for kind, pattern, group, least in RULES]


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all spans by start, then kind; code points, end exclusive."""
    found = []
    for i, (_, pattern, group, least) in enumerate(_COMPILED):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), i, m.end()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            spans = find(text.as_py() or "")
            base = [s for s in spans if s[1] < BASE_KINDS]
            counts = [sum(s[1] == k for s in base) for k in range(BASE_KINDS)]
            out.append((blob, RULE_VERSION, *counts, joined(base), joined(spans)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_spans", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def blob_id(text):
    """Content address of a text column; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, key: str, text: str) -> DataFrame:
    """New ledger rows: of each blob that the ledger lacks under this rule version.

    One path stands for each unseen blob; only (key, blob) pairs are compared
    to find it, and the texts are dealt once, to meet the list of those paths.
    """
    addressed = versions.select(F.col(key).alias("key"), blob_id(F.col(text)).alias("blob"))
    stand_ins = addressed.groupBy("blob").agg(F.min("key").alias("key"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob")
        stand_ins = stand_ins.join(seen, "blob", "left_anti")
    # A key may have many versions: the text that is meant is met by key and blob.
    texts = versions.select(F.col(key).alias("key"), blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = texts.join(stand_ins.hint("shuffle_hash"), ["key", "blob"]).select("blob", "text")
    return chosen.mapInArrow(_scan, LEDGER)


def scan(versions: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): a row per row of ``versions``, and the ledger with the new rows.

    Findings have key, blob, the counts, base_spans and spans. A null text is
    an empty one and has no spans. Rows with equal texts share one scan. A null
    key, and equal rows, give a findings row each. Other columns are not read.
    """
    spark = versions.sparkSession
    scratch.small_batches(spark)
    # A path whose key is null can still stand for its blob.
    keyed = versions.select(F.struct(F.col(key).alias("key"), F.col(key).isNull().alias("none")).alias("k"), F.col(text).cast("string").alias("text"))
    keyed = keyed.select(F.col("k.key").alias("key"), F.coalesce(F.col("k.key").cast("string"), F.lit("\x00null")).alias("path"), "text")
    new = scan_unseen(keyed.select("path", "text"), ledger, "path", "text").dropDuplicates(["blob", "rule_version"])
    new = scratch.materialize(new, "ledger")
    full = new if ledger is None else ledger.unionByName(new)
    current = full.filter(F.col("rule_version") == RULE_VERSION).drop("rule_version")
    hits = current.filter(F.col("spans") != "").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = keyed.select("key", blob_id(F.col("text")).alias("blob"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    found = paths.join(hits, ["blob", "salt"], "left").drop("salt")
    return found.na.fill(0, ["n_assign", "n_access", "n_hex"]).na.fill("", ["base_spans", "spans"]).withColumnRenamed("key", key), full
