"""Benchmark decontamination by a BM25 index of the test items.

The items are the index and every passage of the corpus is a query. An item's
score is divided by the score it gives itself, so one threshold serves all.

The index is inverted: each term has its postings in order of items, cut into
blocks of neighbouring items with the most that the term adds in each
(block-max). Passages are searched by block-max WAND. A passage has a cursor on
each of its terms' lists. In the order of the cursors' blocks, the terms' most
are added up; where the sum reaches the threshold lies the pivot, and no block
before it can hold a hit. The cursors before the pivot skip to it. Where the
most that the terms add in the pivot's block falls short of the threshold, the
block is passed over unscored, else its items are scored in full. All passages
of a batch of texts take their steps at the same time.

What scores above the threshold is verified by the share of the item's word
shingles that the passage holds, for the question and for the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideclock.llm import scratch, worker

K1, B = 1.2, 0.75
#: Share of its own score that an item must reach in a passage.
THRESHOLD = 0.4
#: Share of a part's shingles, question or answer, at which the passage holds that part.
OVERLAP = 0.5
WIDTH = 5
#: An answer found without its question is a leak if it has at least so many words; shorter ones occur by chance.
TELLING = 8
BLOCK_ITEMS = 8
#: Least words in half a passage; longer items make longer passages.
HALF = 64
#: Bytes of item text of one index. A larger benchmark makes more indexes, each of which is broadcast and meets the whole corpus.
SHARD_BYTES = 8 << 20
#: Passages that are searched at the same time.
BATCH = 4096

_FOLD = bytes(32 if b < 33 or b in b".,;:!?\"'()[]{}" else b + 32 if 65 <= b <= 90 else b for b in range(256))

LEAKS = "key {key}, item_id bigint, score double, question_overlap double, answer_overlap double, leaked string"

Item = tuple[int | None, str | None, str | None]


def words(text: bytes | str | None) -> list[bytes]:
    """Words without common ASCII punctuation, A-Z folded."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


def shingles(of: list[bytes]) -> set[bytes]:
    n = min(WIDTH, len(of))
    return {b" ".join(of[i : i + n]) for i in range(len(of) - n + 1)} if n else set()


class Statistics:
    """What scores take from the whole benchmark: items with words, their words, the longest, and how many items hold each term."""

    def __init__(self, items: int = 0, words: int = 0, longest: int = 0, frequency: dict[bytes, int] | None = None) -> None:
        self.items, self.words, self.longest, self.frequency = items, words, longest, frequency or {}

    @staticmethod
    def of(items: list[Item]) -> Statistics:
        made = Statistics()
        for _, question, answer in items:
            found = words(question) + words(answer)
            made.items += bool(found)
            made.words += len(found)
            made.longest = max(made.longest, len(found))
            for w in set(found):
                made.frequency[w] = made.frequency.get(w, 0) + 1
        return made


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges from first to before last, one after the other, and the range that each is of."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of], of


class Index:
    """Postings of all terms, in blocks of items with each term's most per block.

    ``whole`` are the statistics of the benchmark that ``items`` are a part of; without it they are all of it.
    """

    def __init__(self, items: list[Item], whole: Statistics | None = None) -> None:
        whole = whole or Statistics.of(items)
        made = []
        for item, question, answer in items:
            q, a = words(question), words(answer)
            if q or a:
                made.append((item, q, a))
        self.terms: dict[bytes, int] = {}
        rows: list[dict[int, int]] = []
        for _, q, a in made:
            counts: dict[int, int] = {}
            for w in q + a:
                t = self.terms.setdefault(w, len(self.terms))
                counts[t] = counts.get(t, 0) + 1
            rows.append(counts)
        n = len(rows)
        frequency = np.array([whole.frequency[w] for w in self.terms], dtype=float)
        idf = np.log1p((whole.items - frequency + 0.5) / (frequency + 0.5))
        mean = whole.words / whole.items if whole.items else 1.0
        self.half = max(HALF, whole.longest)
        # Items that share their commonest terms share blocks, so that a block's most is close to its members'.
        common = [sorted(counts, key=lambda t: (-frequency[t], t))[:2] for counts in rows]
        order = sorted(range(n), key=lambda i: (common[i], len(rows[i]), i))
        self.items = [(made[i][0], b" ".join(made[i][1]), b" ".join(made[i][2])) for i in order]
        self.blocks = -(-n // BLOCK_ITEMS)
        terms, places, impacts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for place, i in enumerate(order):
            tf, length = np.array(list(rows[i].values()), dtype=float), sum(rows[i].values())
            held = np.array(list(rows[i]), dtype=np.int64)
            w = idf[held] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            terms.append(held)
            places.append(np.full(len(held), place))
            impacts.append(w / w.sum())
        term, place, impact = np.concatenate(terms), np.concatenate(places), np.concatenate(impacts)
        sort = np.lexsort((place, term))
        term, self.place, self.impact = term[sort], place[sort], impact[sort]
        # Postings of one term in one block of items are neighbours; ``first`` bounds them, ``key`` names term and block.
        key = term * max(1, self.blocks) + self.place // BLOCK_ITEMS
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.key, self.first = key[first], np.append(first, len(key))
        most = np.maximum.reduceat(self.impact, first) * (1 + 1e-6) if len(first) else np.zeros(0)
        self.block_most, self.block = most, self.key % max(1, self.blocks)
        self.ends = np.cumsum(np.bincount(self.key // max(1, self.blocks), minlength=len(self.terms)))
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.most = np.maximum.reduceat(most, self.starts) if len(self.terms) else np.zeros(0)

    def hits(self, passages: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block-max WAND: passage, place of the item and score of all scores that reach the threshold.

        ``terms`` are the distinct terms of each passage.
        """
        cursor, end, who, most = self.starts[terms], self.ends[terms], passages, self.most[terms]
        found_who, found_list = [], []
        while len(cursor):
            sort = np.argsort(who * self.blocks + self.block[cursor], kind="stable")
            cursor, end, who, most = cursor[sort], end[sort], who[sort], most[sort]
            at = self.block[cursor]
            fresh = np.flatnonzero(np.diff(who, prepend=-1))
            number = np.cumsum(np.diff(who, prepend=-1) != 0) - 1
            total = np.cumsum(most)
            reached = total - (total[fresh] - most[fresh])[number] >= THRESHOLD
            # The pivot of each passage is its first cursor where the sum is reached; passages without one are done.
            pivot = np.full(len(fresh), -1)
            hit = np.flatnonzero(reached)[::-1]
            pivot[number[hit]] = hit
            live = pivot[number] >= 0
            goal = at[pivot[number]]
            before = live & (at < goal)
            cursor[before] = np.searchsorted(self.key, self.key[cursor[before]] - at[before] + goal[before])
            moved = live & (at <= goal)
            here = moved & (cursor < end)
            here[here] = self.block[cursor[here]] == goal[here]
            bound = np.bincount(number[here], self.block_most[cursor[here]], minlength=len(fresh))
            score = here & (bound >= THRESHOLD)[number]
            found_who.append(who[score])
            found_list.append(cursor[score])
            cursor[here] += 1
            stay = live & (cursor < end)
            cursor, end, who, most = cursor[stay], end[stay], who[stay], most[stay]
        if not found_who:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0)
        lists = np.concatenate(found_list)
        entries, of = _spread(self.first[lists], self.first[lists + 1])
        pairs, which = np.unique(np.concatenate(found_who)[of] * len(self.items) + self.place[entries], return_inverse=True)
        scores = np.bincount(which, self.impact[entries], minlength=len(pairs))
        good = scores >= THRESHOLD
        who, place = np.divmod(pairs[good], max(1, len(self.items)))
        return who, place, scores[good]

    def search(self, texts: list[bytes | None]) -> list[dict[int | None, tuple[float, float, float, str]]]:
        """For each text: item -> (best score, question overlap, answer overlap, leaked part).

        Passages are pairs of neighbouring halves, so that every run of words as
        long as the longest item lies within one.
        """
        out: list[dict] = [{} for _ in texts]
        if not self.items:
            return out
        n, get = len(self.terms), self.terms.get
        held: list[tuple[int, int, list[bytes]]] = []  # text, first word of the passage, words of the text
        passages, terms, count = [], [], 0
        for number, text in enumerate(texts):
            of = words(text)
            ids = np.fromiter((get(w, -1) for w in of), dtype=np.int64, count=len(of))
            at = np.flatnonzero(ids >= 0)
            if not len(at):
                continue
            half = at // self.half
            last = max(0, (len(of) - 1) // self.half - 1)  # the last passage is the last two halves
            own = np.minimum(half, last) * n + ids[at]
            before = half > 0
            pairs = np.unique(np.concatenate([own, (half[before] - 1) * n + ids[at[before]]]))
            which, term = np.divmod(pairs, n)
            firsts = np.flatnonzero(np.diff(which, prepend=-1))
            for low in range(0, len(firsts), BATCH):  # a very long text takes several batches
                some = firsts[low : low + BATCH]
                a, b = some[0], firsts[low + BATCH] if low + BATCH < len(firsts) else len(term)
                passages.append(np.cumsum(np.diff(which[a:b], prepend=-1) != 0) - 1 + count)
                terms.append(term[a:b])
                held += [(number, int(p) * self.half, of) for p in which[some]]
                count += len(some)
                if count >= BATCH:
                    self._verify(np.concatenate(passages), np.concatenate(terms), held, out)
                    held, passages, terms, count = [], [], [], 0
        if count:
            self._verify(np.concatenate(passages), np.concatenate(terms), held, out)
        return out

    def _verify(self, passages: np.ndarray, terms: np.ndarray, held: list[tuple[int, int, list[bytes]]], out: list[dict]) -> None:
        now, run, full = -1, [], set()
        for who, place, score in zip(*(x.tolist() for x in self.hits(passages, terms)), strict=True):
            number, start, of = held[who]
            if now != who:
                now, run = who, of[start : start + 2 * self.half]
                full = shingles(run) if len(run) >= WIDTH else set()
            item, q, a = self.items[place]
            q, a = q.split(), a.split()
            question, answer = _share(q, full, run), _share(a, full, run)
            if (q and question >= OVERLAP) or (a and answer >= OVERLAP and (not q or len(a) >= TELLING)):
                old = out[number].get(item, (0.0, 0.0, 0.0, ""))
                question, answer = max(old[1], question), max(old[2], answer)
                parts = [name for name, part, share in (("question", q, question), ("answer", a, answer)) if part and share < OVERLAP]
                leaked = "whole" if not parts else "answer" if parts == ["question"] else "question"
                out[number][item] = (max(old[0], score), question, answer, leaked)


def _share(wanted: list[bytes], full: set[bytes], run: list[bytes]) -> float:
    """The share of an item part's shingles that a run of words holds; short parts have short shingles."""
    if not wanted:
        return 0.0
    width = min(WIDTH, len(wanted))
    have = full if width == WIDTH else {b" ".join(run[i : i + width]) for i in range(len(run) - width + 1)}
    want = shingles(wanted)
    return len(want & have) / len(want)


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _open(shared)
        for batch in batches:
            found = index.search([text.as_buffer().to_pybytes() if text.is_valid else None for text in batch.column(1)])
            out = [(key, item, *facts) for key, hits in zip(batch.column(0).to_pylist(), found, strict=True) for item, facts in hits.items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [batch.column(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "item_id", "score", "question_overlap", "answer_overlap", "leaked"])

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, word, items, n_words): a row per item without a word, and one per distinct word of each item."""
    for batch in batches:
        out = []
        for shard, question, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = words(question) + words(answer)
            out += [(shard, None, len(found))] if found else []
            out += [(shard, w, 0) for w in set(found)]
        shards, found, sizes = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], names=["shard", "word", "n_words"])


def indexes(spark: SparkSession, items: DataFrame) -> Iterator[object]:
    """Broadcast indexes of about SHARD_BYTES of item text each; items without words are left out.

    All take their statistics from the whole benchmark, so parts score as one
    index does. The driver holds one part at a time: its items and the
    frequencies of their words.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "question", "answer").dropDuplicates()
    size = rows.agg(F.sum(F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0] or 0
    shards = size // SHARD_BYTES + 1
    rows = scratch.materialize(rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(shards)).cast("long")), "items")
    terms = scratch.materialize(rows.select("shard", "question", "answer").mapInArrow(_terms, "shard bigint, word binary, n_words bigint"), "terms")
    facts = terms.filter("word IS NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.max("n_words"), F.lit(0))).first()
    frequency = scratch.materialize(terms.filter("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n")), "frequency")
    for shard in range(shards):
        own = terms.filter((F.col("shard") == shard) & F.col("word").isNotNull()).select("word").distinct()
        known = {bytes(r["word"]): r["n"] for r in frequency.join(own.hint("merge"), "word").collect()}
        found = rows.filter(F.col("shard") == shard).drop("shard").orderBy("item_id", "question", "answer").collect()
        yield spark.sparkContext.broadcast(pickle.dumps(Index([tuple(r) for r in found], Statistics(*facts, known))))
    scratch.drop(rows, terms, frequency)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` and leaked item: key, item_id, score, question_overlap, answer_overlap, leaked.

    ``items``: item_id, question, answer (nullable). A passage leaks an item if
    it scores above the threshold and holds the question, or the answer where
    that is long enough to be telling or there is no question. ``leaked`` tells
    which parts were found: ``whole`` if all that the item has, else
    ``question`` or ``answer``.

    Items with a null id are searched like others and give rows with a null
    ``item_id``; all leaks of one id, null included, in one row of ``docs`` are
    one row. Null and empty texts have no leaks; repeated rows have theirs each;
    a null key is carried; an empty table on either side gives no rows. Texts of
    any length are searched whole. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    kind = dict(docs.dtypes)[key]
    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    out = None
    for index in indexes(spark, items):
        found = narrow.mapInArrow(_search(index), LEAKS.format(key=kind))
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("key", key)


def split_items(benchmark: DataFrame) -> DataFrame:
    """Items with one text: the last sentence is the answer where there is more than one."""
    parts = r"(?s)^(.*[.!?])\s+(\S.*)$"
    answer = F.regexp_extract("text", parts, 2)
    more = answer != ""
    return benchmark.select("item_id", F.when(more, F.regexp_extract("text", parts, 1)).otherwise(F.col("text")).alias("question"), F.when(more, answer).alias("answer"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that leak an item, be it whole or in part: texts are judged where they lie and not shuffled.

    Null and empty texts stay; repeated rows stay or go together; null keys and
    columns of any name are carried; an empty table on either side takes nothing away.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    for index in indexes(spark, items):
        docs = docs.filter(~F.pandas_udf(_leaky(index), "boolean")(docs[f"`{text}`"].cast("binary")))
    return docs


def _leaky(shared):
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        found = _open(shared).search([None if t is None else bytes(t) for t in texts])
        return pd.Series([bool(x) for x in found], dtype=bool)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return run


_opened: tuple = (None, None)


def _open(shared) -> Index:
    """This process's copy of a broadcast index."""
    global _opened
    worker.claim("decontaminate", _close)
    if _opened[0] is not shared:
        _opened = (shared, pickle.loads(shared.value))
    return _opened[1]


def _close() -> None:
    global _opened
    _opened = (None, None)
