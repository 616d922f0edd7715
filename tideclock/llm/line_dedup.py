"""Near-duplicate lines by a deletion-neighbourhood join; built-in functions only.

Two lines are duplicates if at most one character has to be changed, added or
left out to turn one into the other. A line is dropped if an earlier line, by
document and number, is its duplicate.

Lines that share a deletion variant are the candidates. To keep the variants of
a whole corpus few, two filters come first, neither of which loses a pair. A
duplicate pair agrees in its first or in its last half; lines that agree in
neither half with another line are left out. The others are cut into pieces in
such a way that a duplicate pair agrees in all but one of them; lines that agree
with another in all but one piece emit variants, and only of that piece. Variants carry the place of the deletion: lines of one length
that agree after a deletion at one place are all duplicates of each other, and
a line that is itself a variant is a duplicate of all lines that have it, so
each group needs its earliest member only and no pairs are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tideclock.llm import scratch

#: Characters, blanks at the ends left off, from which on lines are compared by edit distance, and
#: from which on they are judged at all: one edit is a small part of a long line, and most of a short one.
NEAR_CHARS = 25
MIN_CHARS = 1
BLANKS = " \t\r"


def _shape(n: Column) -> Column:
    """Number and width of the pieces of a line whose shorter twin has ``n`` characters."""
    count = F.when(n < 256, 4).when(n < 2048, 8).when(n < 16384, 32).otherwise(128)
    width = F.floor(n / count).cast("int")
    return F.struct(count.alias("m"), (width - width % 4).alias("w"))


def _shapes(line: Column) -> Column:
    """A line takes part with its own length and as the longer one of a pair."""
    n = F.length(line)
    return F.array_distinct(F.array(_shape(n), _shape(n - 1)))


def _piece_key(line: Column, shape: Column, q: Column) -> Column:
    """Number of all that is outside piece q: equal for lines that differ within it only."""
    return F.xxhash64(shape["m"], shape["w"], q, F.left(line, (q * shape["w"]).cast("int")), F.right(line, ((shape["m"] - 1 - q) * shape["w"]).cast("int")))


def half_keys(line: Column) -> Column:
    """Numbers of a line's first and last half, as the shorter and as the longer one of a pair."""
    n = F.length(line)
    half = lambda k: (k - k % 16) / 2
    own, other = half(n).cast("int"), half(n - 1).cast("int")
    keys = [F.xxhash64(F.lit(side), w, part) for w in (own, other) for side, part in ((1, F.left(line, w)), (2, F.right(line, w)))]
    return F.when(own == other, F.array(*keys[:2])).otherwise(F.array(*keys))


def piece_keys(line: Column) -> Column:
    per_shape = F.transform(_shapes(line), lambda s: F.transform(F.sequence(F.lit(0), s["m"] - 1), lambda q: _piece_key(line, s, q)))
    return F.array_distinct(F.flatten(per_shape))


def _pieces(line: Column) -> Column:
    """(key, body) of each piece; the body is what lies between prefix and suffix."""
    per_shape = F.transform(
        _shapes(line),
        lambda s: F.transform(
            F.sequence(F.lit(0), s["m"] - 1),
            lambda q: F.struct(
                _piece_key(line, s, q).alias("key"),
                F.substring(line, (q * s["w"] + 1).cast("int"), (F.length(line) - (s["m"] - 1) * s["w"]).cast("int")).alias("body"),
            ),
        ),
    )
    return F.array_distinct(F.flatten(per_shape))


def _variants(piece: Column) -> Column:
    """(v, at) of a piece: itself at 0, and the piece without its character at 1, 2, ..."""
    body = piece["body"]
    return F.transform(
        F.sequence(F.lit(0), F.length(body)),
        lambda i: F.struct(F.xxhash64(piece["key"], F.when(i == 0, body).otherwise(F.concat(F.left(body, i - 1), F.substring(body, i + 1, F.length(body))))).alias("v"), i.alias("at")),
    )


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(key, th, line_no, h1, h2, halves) of every judged line of (key, th, text); narrow, without texts.

    Lines that are not compared by edit distance have no halves.
    """
    lines = docs.select("key", "th", F.posexplode(_split(F.col("text"))).alias("line_no", "raw")).select("key", "th", "line_no", _trimmed(F.col("raw")).alias("line"))
    lines = lines.filter(F.length("line") >= min_chars)
    halves = F.when(F.length("line") >= near_chars, half_keys(F.col("line")))
    return lines.select("key", "th", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), halves.alias("halves"))


def _agreeing(keyed: DataFrame) -> DataFrame:
    """(h1, h2, keys): of (h1, h2, k), each line with the keys that it shares with another line."""
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    return keyed.join(shared.hint("merge"), "k", "left_semi").groupBy("h1", "h2").agg(F.collect_set("k").alias("keys"))


def _suspects(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """(h1, h2, first, line): distinct lines that agree with another in a half, with their texts."""
    named = _agreeing(firsts.select("h1", "h2", F.explode("halves").alias("k"))).select("h1", "h2").join(firsts.select("h1", "h2", "first").hint("merge"), ["h1", "h2"])
    wanted = named.groupBy("first.key", "first.th").agg(F.collect_list(F.struct("first.line_no", "h1", "h2")).alias("lines")).select(F.col("key").alias("k"), F.col("th").alias("t"), "lines")
    met = docs.join(wanted.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("k")) & (F.col("th") == F.col("t")))
    each = met.select("key", "th", F.transform("lines", lambda x: F.struct(x.alias("x"), _trimmed(_split(F.col("text"))[x["line_no"]]).alias("line"))).alias("lines"))
    rows = each.select("key", "th", F.explode("lines").alias("r")).select(F.col("r.x.h1").alias("h1"), F.col("r.x.h2").alias("h2"), F.struct("key", "th", F.col("r.x.line_no").alias("line_no")).alias("first"), "r.line")
    return rows.dropDuplicates(["h1", "h2"])


def _leaders(suspects: DataFrame) -> DataFrame:
    """(h1, h2, lead, l1, l2): for each suspect line that has one, an earlier duplicate."""
    bad = _agreeing(suspects.select("h1", "h2", F.explode(piece_keys(F.col("line"))).alias("k"))).withColumnRenamed("keys", "bad")
    suspects = scratch.materialize(suspects.join(bad.hint("merge"), ["h1", "h2"]), "pieces")
    pieces = suspects.select("h1", "h2", "first", F.explode(F.filter(_pieces(F.col("line")), lambda p: F.array_contains(F.col("bad"), p["key"]))).alias("piece"))
    rows = pieces.select(F.struct("first", "h1", "h2").alias("who"), F.explode(_variants(F.col("piece"))).alias("x")).select("who", "x.v", "x.at")
    same = F.min("who").over(W.partitionBy("v", "at"))
    whole = F.min(F.when(F.col("at") == 0, F.col("who"))).over(W.partitionBy("v"))
    longer = F.min(F.when(F.col("at") > 0, F.col("who"))).over(W.partitionBy("v"))
    led = rows.select("who", F.when(F.col("at") == 0, longer).otherwise(F.least(same, whole)).alias("lead")).filter(F.col("lead") < F.col("who")).distinct()
    led = led.select("who.h1", "who.h2", F.col("lead.first").alias("lead"), F.col("lead.h1").alias("l1"), F.col("lead.h2").alias("l2"))
    texts = suspects.select("h1", "h2", "line")
    both = led.join(texts.hint("merge"), ["h1", "h2"]).join(texts.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), F.col("line").alias("lead_line")).hint("merge"), ["l1", "l2"])
    proven = both.filter(F.levenshtein("line", "lead_line", 1).between(0, 1))
    found = scratch.materialize(proven.groupBy("h1", "h2").agg(F.min("lead").alias("lead")), "leaders")
    scratch.drop(suspects)
    return found


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """One row per dropped line: key, th, line_no, kept_key, kept_line_no, distance.

    Equal lines are duplicates from ``min_chars`` characters on, with 0 the
    blank ones too; lines at an edit distance of 1 if both have ``near_chars``.
    ``line_no`` counts from 0 over lines ended by ``\\n``; ``th`` is a hash of
    the document's text, so that different texts under one key stay apart;
    equal rows are one document. ``kept_*`` name the earliest equal line, or
    else an earlier line at distance 1, which may itself be dropped in favour
    of a third. Null keys come first; null and empty texts have no lines. An
    empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    seen = scratch.materialize(occurrences(rows, min_chars, near_chars), "lines")
    place = F.struct("key", "th", "line_no")
    firsts = seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("halves").alias("halves"))
    firsts = scratch.materialize(firsts, "firsts")
    suspects = scratch.materialize(_suspects(firsts, rows), "suspects")
    leaders = _leaders(suspects)
    scratch.drop(suspects)
    judged = firsts.select("h1", "h2", "first", "n").join(leaders.hint("merge"), ["h1", "h2"], "left").filter((F.col("n") > 1) | F.col("lead").isNotNull())
    judged = scratch.materialize(judged.drop("n"), "judged")  # so that both sides of the next join are dealt anew and a hot line can be split
    scratch.drop(firsts, leaders)
    found = seen.select("key", "th", "line_no", "h1", "h2").join(judged.hint("merge"), ["h1", "h2"])
    again = (F.col("first") != place).alias("again")
    found = found.select("key", "th", "line_no", "first", "lead", again).filter(F.col("again") | F.col("lead").isNotNull())
    kept = F.when(F.col("again"), F.col("first")).otherwise(F.col("lead"))
    out = found.select("key", "th", "line_no", kept["key"].alias("kept_key"), kept["line_no"].alias("kept_line_no"), F.when(F.col("again"), 0).otherwise(1).alias("distance"))
    return out.distinct().withColumnRenamed("key", key)


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` without their duplicate lines, with the same columns; ``length``, if there, is counted anew.

    Every document stays, be it with an empty text. A null text stays null, a
    null key is a key like others and comes first. Equal rows are one document
    and keep the same lines. Columns of any name are carried; an empty table
    stays empty.
    """
    gone_key, gone_th, gone_lines = scratch.free_names(docs, "gone_key", "gone_th", "gone_lines")
    found = duplicate_lines(docs, key, text, min_chars, near_chars)
    gone = found.groupBy(F.col(key).alias(gone_key), F.col("th").alias(gone_th)).agg(F.collect_set("line_no").alias(gone_lines))
    lines, own = gone[gone_lines], F.xxhash64(docs[f"`{text}`"])
    met = docs.join(gone.hint("shuffle_hash"), docs[f"`{key}`"].eqNullSafe(gone[gone_key]) & (own == gone[gone_th]), "left")
    kept = F.array_join(F.filter(_split(docs[f"`{text}`"]), lambda x, i: ~F.array_contains(lines, i)), "\n")
    clean = F.when(lines.isNull(), docs[f"`{text}`"]).otherwise(kept)
    columns = [clean.alias(c) if c == text else F.length(clean).cast(dict(docs.dtypes)[c]).alias(c) if c == length else docs[f"`{c}`"] for c in docs.columns]
    return met.select(*columns)
