"""Quality rules with host verdicts.

Every document is measured on its whole text. Rule failures are summed by
domain, each domain's failure rate is shrunk towards the corpus with a beta
prior fitted to the domains themselves, and the domain's verdict is joined
back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideclock.llm import scratch, worker

#: The symbols that count.
SYMBOLS = b"#*$%&|<>"
#: The characters that part words.
BLANKS = b" \t\n\x0b\x0c\r"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 30
#: A domain goes when its shrunk failure rate is above this.
HOST_CUT = 0.8
#: At most so many domains are broadcast; beyond, the join is dealt by salted domain.
BROADCAST_HOSTS = 100_000
SALTS = 64

_MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # ids too wide to share one number: number the pairs first
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * len(seen) + ids[2:]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    hit = np.isin(keys, twice)
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= hit
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()  # of bytes: splits at the six ASCII blanks and nothing else
    points = len(text.decode("utf-8", "replace"))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        points - sum(text.count(c) for c in BLANKS),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.claim("rules")
    for batch in batches:
        rows = [measure(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(2)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)],
            names=["key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def _measures(text: pd.Series) -> pd.DataFrame:
    """The five measures of each text as a struct."""
    worker.claim("rules")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return pd.DataFrame([measure(x if x is None else bytes(x)) for x in text], columns=names, dtype="int64")


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def symbol_failed(n_words, n_symbols):
    return 100 * n_symbols > MAX_SYMBOL_PERCENT * n_words


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta by the method of moments, from (failed, total) of each host.

    One aggregate row comes to the driver. Without hosts, or where they differ
    by no more than chance, the prior has the weight of 1000 documents.
    """
    rate = F.col("failed") / F.col("total")
    m, v, inverse = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("total"))).first()
    if m is None:
        return 0.5, 0.5
    m = min(max(m, 1e-4), 1 - 1e-4)
    between = (v or 0.0) - m * (1 - m) * inverse
    weight = 1000.0 if between <= 0 else min(max(m * (1 - m) / between - 1, 1.0), 1000.0)
    return m * weight, (1 - m) * weight


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, shrunk_rate, host_rejected) from one row per document with host and failed."""
    hosts = measured.groupBy("host").agg(F.sum(F.col("failed").cast("long")).alias("failed"), F.count(F.lit(1)).alias("total"))
    alpha, beta = beta_prior(hosts)
    shrunk = (F.col("failed") + F.lit(alpha)) / (F.col("total") + F.lit(alpha + beta))
    return hosts.select("host", shrunk.alias("shrunk_rate"), (shrunk > HOST_CUT).alias("host_rejected"))


def with_hosts(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Join each document with its host's verdict; null hosts are one host.

    A checked, small number of hosts is broadcast. More are joined by (host,
    salt), which deals the documents of a hot host over all tasks.
    """
    verdicts = verdicts.withColumn("host_key", F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("n"))).drop("host")
    measured = measured.withColumn("host_key", F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("n")))
    if verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        return measured.join(F.broadcast(verdicts), "host_key", "left").drop("host_key")
    salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = measured.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["host_key", "salt"], "left").drop("host_key", "salt")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: key, host, the measures, base_failed, shrunk_rate, host_rejected, kept.

    A null or empty text has zero words and so fails; a null host is a host of
    its own; repeated rows are judged and counted each for itself; other
    columns of ``docs`` are not looked at, whatever their names.
    """
    scratch.small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    narrow = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), F.col(text).cast("binary").alias("text"))
    measured = narrow.mapInArrow(_measure_batches, f"key {kind}, host string, {_MEASURES}")
    measured = measured.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).withColumn(
        "failed", F.col("base_failed") | symbol_failed(F.col("n_words"), F.col("n_symbols"))
    )
    measured = scratch.materialize(measured, "rules")  # small: no texts
    joined = with_hosts(measured, host_verdicts(measured))
    return joined.withColumn("kept", ~F.col("failed") & ~F.col("host_rejected")).drop("failed").withColumnRenamed("key", key)


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that their own rules and their host's verdict let pass, with their columns.

    Null and empty texts have no words and go. A null host is a host of its own;
    null keys do not matter. Repeated rows count and are judged each for itself.
    Columns of any name are carried; an empty table stays empty. The measured corpus is written once, so that no text is measured twice or shuffled.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    marked = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.pandas_udf(_measures, _MEASURES)(F.col(text).cast("binary")).alias("m"))
    marked = marked.select(
        "row",
        F.col(f"row.`{host}`").cast("string").alias("host"),
        (base_failed(F.col("m.n_words"), F.col("m.n_repeat_words")) | symbol_failed(F.col("m.n_words"), F.col("m.n_symbols"))).alias("failed"),
    )
    marked = scratch.materialize(marked, "rules")
    verdicts = host_verdicts(marked.select("host", "failed"))
    passed = marked.filter(~F.col("failed")).withColumn("key", F.xxhash64("row"))
    return with_hosts(passed, verdicts).filter(~F.col("host_rejected")).select("row.*")
