"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: the first scatters the shingles, the
second, shifted round by k places, gives coordinate k. Coordinates are banded;
documents that agree in a band are candidates, and every link is confirmed on
the full shingle sets.

Documents with equal sets are one class and are compared once, through a
representative. What counts is which documents hang together, so within a large
bucket no pairs are listed: members are compared to a pivot, and what that does
not connect is compared in full, in blocks of members whose shared shingles are
counted by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F
import xxhash

from tideclock.llm import scratch, worker

BANDS, ROWS = 20, 4
#: Buckets of up to so many representatives are compared in full.
SMALL = 16
#: Members and shingles of one block of a larger bucket; two blocks meet in one group of rows.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: A shingle is counted by matrix product if it is in at least one of so many pairs of a block, else pair by pair.
DENSE = 200
SALTS = 16
#: A key with more rows than this and than one in HOT_KEYS of all is hot; so there are at most HOT_KEYS hot keys.
HOT, HOT_KEYS = 1000, 10_000
_MEMORY = 200_000

_M1, _M2, _P = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that mixes well."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``width`` words.

    A-Z count as a-z. A text of fewer words has all of them as one shingle; a
    text without words has none.
    """
    words = text.lower().split() if text else []  # of bytes: ASCII letters and blanks only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    worker.claim("minhash", _hashes.clear)
    if len(_hashes) > _MEMORY:
        _hashes.clear()
    look = _hashes.__getitem__
    h = np.array([look(w) for w in words], dtype=np.uint64)
    n = min(width, len(h))
    x = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        x = mix64(x * _P + h[i : len(h) - n + 1 + i])
    return np.unique(x)


def signature(found: np.ndarray) -> np.ndarray:
    """Circulant MinHash: BANDS * ROWS coordinates from a scattered set and one shifted permutation."""
    scattered = (mix64(found ^ _P) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(scattered), 2048):
        x = scattered[None, at : at + 2048] + _SHIFTS
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number for each band."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        x = mix64(x * _P + rows[:, i])
    return x.view(np.int64)


def _buffer(x: pa.Scalar) -> bytes | None:
    return x.as_buffer().to_pybytes() if x.is_valid else None


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for x in batch.column(1):
                found = shingles(_buffer(x), width)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(signature(found)) if len(found) else np.zeros(0, dtype=np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_shingles", "digest", "bands"])

    return run


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(key, n_shingles, digest, bands) of each row of (key, text)."""
    kind = dict(docs.dtypes)["key"]
    return docs.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(_sketch(width), f"key {kind}, n_shingles bigint, digest binary, bands array<bigint>")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(_buffer(x), width).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "found"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def full_sets(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(key, found): the whole shingle sets of the wanted keys, from one pass over the texts."""
    kind = dict(docs.dtypes)["key"]
    texts = docs.join(wanted.hint("shuffle_hash"), "key").select("key", F.col("text").cast("binary").alias("text"))
    return scratch.materialize(texts.mapInArrow(_sets(width), f"key {kind}, found binary"), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets are similar enough."""
    kind = dict(sets.dtypes)["key"]
    left = pairs.select("a", "b").join(sets.select(F.col("key").alias("a"), F.col("found").alias("x")).hint("merge"), "a")
    full = left.join(sets.select(F.col("key").alias("b"), F.col("found").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")
    return scratch.materialize(full.mapInArrow(_confirm(percent), f"a {kind}, b {kind}"), "links")


def spread_join(rows: DataFrame, counted: DataFrame, key: str, total: int, value: str) -> DataFrame:
    """``rows`` with the row of ``counted`` of the same ``key``; no task gets all rows of a hot key.

    ``counted`` tells for each key, in ``n``, how many of the ``total`` rows
    have it, and ``value``, never null. Rows of hot keys stay where they are and
    meet a broadcast of at most HOT_KEYS rows; the others are dealt by key.
    """
    floor = max(HOT, total // HOT_KEYS)
    hot = F.broadcast(counted.filter(F.col("n") > floor).drop("n"))
    met = rows.join(hot, key, "left")
    cold = met.filter(F.col(value).isNull()).select(*rows.columns)
    cold = cold.join(counted.filter(F.col("n") <= floor).drop("n").hint("merge"), key)
    return met.filter(F.col(value).isNotNull()).select(*cold.columns).unionByName(cold)


def _observed(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges written down, and their number and sum of hashes, taken on the way."""
    seen = Observation()
    table = scratch.materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    return table, seen.get


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b); a component's name is its least node.

    Alternates the large-star and small-star steps, each written to the shared
    folder, until no edge changes. A node with very many links, such as the
    centre of a star, is met by broadcast.
    """
    now, mark = _observed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while mark != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = spread_join(both, least, "u", 2 * mark["n"], "m").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, least, "u", mark["n"], "m")
        # Each neighbour points at the least one, and so does the node itself; one row brings both.
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before = mark
        after, mark = _observed(small.filter("u <> v").distinct())
        scratch.drop(now, large)
        now = after
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _labelled(table: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """``table`` with the component of column ``key`` as ``name``; a node without edges is its own."""
    known = labels.select(F.col("node").alias(key), F.col("component").alias(name))
    return table.join(known.hint("merge"), key, "left").withColumn(name, F.coalesce(F.col(name), F.col(key)))


def bucket_members(bands: DataFrame) -> DataFrame:
    """(bucket, key, n_shingles, size, pivot) of all buckets with more than one member."""
    ranked = bands.withColumn("rank", F.xxhash64("key"))
    buckets = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min_by("key", "rank").alias("pivot")).filter("n > 1")
    seen = Observation()
    buckets = scratch.materialize(buckets.observe(seen, F.sum("n").alias("total")), "buckets")
    members = spread_join(bands, buckets.withColumn("size", F.col("n")), "bucket", seen.get["total"] or 0, "pivot")
    members = scratch.materialize(members, "members")
    scratch.drop(buckets)
    return members


def _star(members: DataFrame) -> DataFrame:
    """(a, b), a < b: each member of a bucket with its pivot."""
    return members.filter(F.col("key") != F.col("pivot")).select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"))


def first_pairs(members: DataFrame) -> DataFrame:
    """Candidate (a, b, votes): pivots with members, and all pairs of small buckets; votes count shared buckets."""
    few = members.filter(F.col("size") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    few = few.select(F.posexplode("keys").alias("i", "a"), "keys").select("a", F.explode(F.slice("keys", F.col("i") + 2, F.lit(SMALL))).alias("b"))
    return _star(members.filter(F.col("size") > SMALL)).unionByName(few).groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, bucket, n_shingles, size, pivot, component) of the larger buckets whose members are in several components."""
    owned, seen = _labelled(members.filter(F.col("size") > SMALL), labels, "key", "component"), Observation()
    owned = scratch.materialize(owned.observe(seen, F.count(F.lit(1)).alias("n")), "owned")
    buckets = owned.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.min("component") != F.max("component")).alias("split"))
    buckets = scratch.materialize(buckets, "split")
    opened = spread_join(owned, buckets, "bucket", seen.get["n"], "split").filter("split").drop("split")
    opened = scratch.materialize(opened, "open")
    scratch.drop(owned, buckets)
    return opened


def _units(opened: DataFrame) -> DataFrame:
    """(unit, key, n_shingles, component): each pair of an open bucket meets in a unit.

    Buckets that hang together are a family. A family is one unit if that makes
    no more pairs than its buckets do one by one; else each bucket is a unit.
    """
    families = components(_star(opened))
    known = _labelled(opened, families, "key", "family")
    costs = known.groupBy("family", "key").agg(F.sum("size").alias("pairs")).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("pairs").alias("pairs"))
    costs = scratch.materialize(costs.select("family", (F.col("n") * F.col("n") <= F.col("pairs")).alias("whole")), "families")
    unit = F.when(F.col("whole"), F.xxhash64(F.lit("family"), "family")).otherwise(F.col("bucket"))
    return scratch.materialize(known.join(costs.hint("merge"), "family").select(unit.alias("unit"), "key", "n_shingles", "component").distinct(), "units")


def _block_pairs(units: DataFrame) -> DataFrame:
    """(unit, i, j, salt, key, component): the members of blocks i and j of a unit, for all pairs of blocks that can hold a new link.

    The largest component has blocks of its own, which do not meet each other.
    """
    counts = units.groupBy("unit", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    totals = counts.groupBy("unit").agg(F.max(F.struct("n", "w", "component")).alias("home"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    others, own = blocks(F.col("n") - F.col("home.n"), F.col("w") - F.col("home.w")), blocks(F.col("home.n"), F.col("home.w"))
    totals = scratch.materialize(totals.filter(F.col("n") > F.col("home.n")).select("unit", F.col("home.component").alias("home"), others.alias("others"), own.alias("own")), "totals")
    dealt = units.join(totals.hint("merge"), "unit")
    at = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    dealt = dealt.withColumn("salt", F.when(F.col("component") == F.col("home"), F.col("others") + at(F.col("own"))).otherwise(at(F.col("others"))))
    last = F.when(F.col("salt") < F.col("others"), F.col("others") + F.col("own")).otherwise(F.col("others")) - 1
    met = dealt.select("unit", "salt", "key", "component", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return met.select("unit", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "key", "component")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each set on the left shares with each on the right."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    entries = []
    x, y = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(x, y)
    if not len(common):
        return out
    for flat, sets in ((x, left), (y, right)):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[at] == flat
        row, column = np.repeat(np.arange(len(sets)), [len(z) for z in sets])[hit], at[hit]
        order = np.argsort(column, kind="stable")
        entries.append((row[order], column[order]))
    (ra, ca), (rb, cb) = entries
    na, nb = np.bincount(ca, minlength=len(common)), np.bincount(cb, minlength=len(common))
    dense = na * nb * DENSE >= out.size
    number = np.cumsum(dense) - 1
    da, db = dense[ca], dense[cb]
    for low in range(0, int(dense.sum()), 2048):
        sides = []
        for row, column, n in ((ra[da], number[ca[da]], len(left)), (rb[db], number[cb[db]], len(right))):
            a, b = np.searchsorted(column, [low, low + 2048])
            m = np.zeros((n, 2048), dtype=np.float32)
            m[row[a:b], column[a:b] - low] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    starts = np.cumsum(nb) - nb
    ra, ca = ra[~da], ca[~da]
    ends = np.cumsum(nb[ca])
    low = 0
    while low < len(ra):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + 2_000_000, side="right")))
        n = nb[ca[low:high]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        met = np.repeat(ra[low:high], n) * len(right) + rb[np.repeat(starts[ca[low:high]], n) + within]
        out += np.bincount(met, minlength=out.size).reshape(out.shape)
        low = high
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric matrix ``linked`` connects, no more than it takes."""
    fresh, out = np.ones(len(linked), dtype=bool), []
    for start in range(len(linked)):
        if fresh[start]:
            fresh[start] = False
            todo = [start]
            while todo:
                x = todo.pop()
                new = np.flatnonzero(linked[x] & fresh).tolist()
                fresh[new] = False
                out += [(x, y) for y in new]
                todo += new
    return out


def _compare(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        worker.claim("minhash", _hashes.clear)
        named = rows.column("component").combine_chunks().dictionary_encode()
        names, codes = named.dictionary, named.indices.to_numpy()
        edges = []
        if len(names) > 1:
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column("found")]
            i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
            salt = rows.column("salt").to_numpy()
            a, b = np.flatnonzero(salt == i), np.flatnonzero(salt == j)
            if len(a) and len(b):
                both = shared_counts([sets[x] for x in a], [sets[x] for x in b])
                sizes = np.array([len(x) for x in sets])
                p, q = np.nonzero(100 * both >= percent * (sizes[a][:, None] + sizes[b] - both))
                linked = np.zeros((len(names), len(names)), dtype=bool)
                linked[codes[a][p], codes[b][q]] = True
                edges = _forest(linked | linked.T)
        take = lambda side: names.take(pa.array([e[side] for e in edges], pa.int64()))
        return pa.table({"a": take(0), "b": take(1)})

    return run


def block_links(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of components that a link joins, such that all links between members of an open bucket are told."""
    kind = dict(sets.dtypes)["key"]
    units = _units(opened)
    full = _block_pairs(units).join(sets.hint("merge"), "key").select("unit", "i", "j", "salt", "component", "found")
    found = scratch.materialize(full.groupBy("unit", "i", "j").applyInArrow(_compare(percent), f"a {kind}, b {kind}"), "joined")
    scratch.drop(units)
    return found


def _shared_keys(sketched: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(a, b): representatives of sets and the keys that hold them, for keys whose rows differ in their sets; None without such keys."""
    known = sketched.filter(F.col("key").isNotNull())
    several = known.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("key")
    several = scratch.materialize(several, "several")
    if several.isEmpty():
        return None
    held = known.filter("n_shingles > 0").select("key", "digest").join(several.hint("merge"), "key", "left_semi").distinct()
    return held.join(classes.select("digest", "rep").hint("merge"), "digest").select(F.col("rep").alias("a"), F.col("key").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * intersection >= percent * union are
    linked; a component's id is its smallest key. Null and empty texts have no
    shingles and are linked with nothing. Rows of one key are one document. A
    null key is in no component and its row is kept. An empty table gives no
    rows. Columns other than ``key`` and ``text`` are not read.
    """
    scratch.small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # A row's salt is written down with it, so that rows of one hot key or text are dealt over several tasks.
    salted = sketch(source, width).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    sketched = scratch.materialize(salted, "sketch")
    usable = sketched.filter(F.col("key").isNotNull() & (F.col("n_shingles") > 0))
    classes = usable.groupBy("digest").agg(
        F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"), F.min("salt").alias("salt")
    )
    classes = scratch.materialize(classes, "classes")

    # Only representatives go into buckets: a copy is never compared.
    members = bucket_members(classes.select(F.col("rep").alias("key"), "n_shingles", F.explode("bands").alias("bucket")))
    candidates = scratch.materialize(first_pairs(members), "pairs")
    wanted = candidates.select(F.col("a").alias("key")).unionByName(candidates.select(F.col("b").alias("key"))).distinct()
    sets = full_sets(wanted, source.filter(F.col("key").isNotNull()), width)
    # First the most promising partner of each document; then what is not yet connected.
    best = scratch.materialize(candidates.groupBy("b").agg(F.max_by("a", "votes").alias("a")).select("a", "b"), "best")
    links = confirm(best, sets, percent)
    # Two steps along these links, which lead to smaller keys, tell most connected pairs; a pair they miss is just compared.
    once = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    labels = scratch.materialize(_labelled(once, once, "component", "further").select("node", F.col("further").alias("component")), "labels")
    apart = candidates.select("a", "b").join(best.hint("merge"), ["a", "b"], "left_anti")
    apart = scratch.materialize(_labelled(_labelled(apart, labels, "a", "ca"), labels, "b", "cb").filter("ca <> cb").select("a", "b"), "apart")
    more_links = confirm(apart, sets, percent)
    labels = components(links.unionByName(more_links))
    scratch.drop(links, more_links, best, apart)
    edges = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    # A pair of a larger bucket that its pivot did not connect is compared, whatever the bucket's size.
    opened = _open_members(members, labels)
    if not opened.isEmpty():
        edges = edges.unionByName(block_links(opened, sets, percent))
    scratch.drop(opened)
    shared = _shared_keys(sketched, classes)
    labels = components(edges if shared is None else edges.unionByName(shared))
    # A class has its representative's component, and so has each of its rows; a class of one row is met by that row's salt alone.
    salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array("salt"))
    owned = _labelled(classes.select("digest", "rep", "copies", "salt"), labels, "rep", "component_id").filter("copies > 1 or component_id <> rep")
    owned = owned.select("digest", F.explode(salts).alias("salt"), "component_id")
    named = usable.select("key", "n_shingles", "digest", "salt").join(owned.hint("merge"), ["digest", "salt"], "left")
    named = named.select("key", "n_shingles", F.coalesce("component_id", "key").alias("component_id"))
    rest = sketched.filter(F.col("key").isNull() | (F.col("n_shingles") == 0)).select("key", "n_shingles")
    named = named.unionByName(_labelled(rest, labels, "key", "component_id"))
    scratch.drop(sets, members, candidates)
    return named.withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True))).withColumnRenamed("key", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but the first document of each group of near-duplicates.

    Rows with a null key and rows with null or empty texts stay. Rows of one key
    are one document and stay or go together. Columns of any name are carried;
    an empty table stays empty.
    """
    (gone_key,) = scratch.free_names(docs, "gone_key")
    gone = near_duplicates(docs, key, text, width, percent).filter(~F.col("kept")).select(F.col(key).alias(gone_key)).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[f"`{key}`"] == gone[f"`{gone_key}`"], "left_anti")
