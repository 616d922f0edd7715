"""Near-duplicate lines against all-pairs brute force."""

import random

from tideclock.llm import line_dedup

SCHEMA = "doc_id bigint, text string, th string, line_no string, n_chars int"


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(docs, min_chars=line_dedup.MIN_CHARS, near_chars=line_dedup.NEAR_CHARS):
    seen, out = [], []
    for key, text in sorted(docs):
        for no, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\r")
            if len(line) < min_chars:
                continue
            same = [p for p, x in seen if x == line]
            near = [x for _, x in seen if min(len(x), len(line)) >= near_chars and x != line and distance_one(x, line)]
            first = {x: p for p, x in reversed(seen)}
            if same:
                out.append((key, no, *same[0], 0))
            elif near:
                out.append((key, no, *min(first[x] for x in near), 1))
            seen.append(((key, no), line))
    return sorted(out)


def ours(spark, docs, **chars):
    frame = spark.createDataFrame([(*d, "x", "y", 0) for d in docs], SCHEMA).repartition(3)
    return sorted((r["doc_id"], r["line_no"], r["kept_key"], r["kept_line_no"], r["distance"]) for r in line_dedup.duplicate_lines(frame, **chars).collect())


def edited(rng, line):
    at = rng.randrange(len(line))
    kind = rng.randrange(4)
    if kind == 0:
        return line[:at] + rng.choice("abc é🙂") + line[at + 1 :]
    if kind == 1:
        return line[:at] + rng.choice("abcé🙂") + line[at:]
    if kind == 2:
        return line[:at] + line[at + 1 :]
    return line


def test_against_brute_force(spark):
    rng, docs = random.Random(7), []
    lines = ["".join(rng.choice("ab é") for _ in range(n)).strip() or "x" for n in [*range(24, 60), 63, 64, 65, 127, 128, 129, 255, 256, 257, 300, 511, 512, 513, 2047, 2048, 2049]]
    lines += ["a" * 40, "a" * 41, "a" * 42, "ab" * 30]
    for i in range(60):
        mine = [rng.choice(lines) for _ in range(8)]
        docs.append((i, "\n".join(edited(rng, edited(rng, x)) if rng.random() < 0.5 else edited(rng, x) for x in mine)))
    docs += [(100, None), (101, ""), (102, "\n\n  \n"), (103, "  " + lines[3] + "\t\r")]
    got, want = ours(spark, docs), brute(docs)
    assert len(want) > 200 and got == want


def test_drop_keeps_columns_and_documents(spark):
    line, other = "a line that is long enough to judge", "another line that is long enough"
    docs = [(1, f"{line}\n{other}\nhere"), (2, f"short\n{line}!\n{other}"), (2, f"short\n{line}!\n{other}"), (3, None), (None, "x"), (4, f"{other}")]
    frame = spark.createDataFrame([(*d, "t", "l", len(d[1] or "")) for d in docs], SCHEMA)
    got = line_dedup.drop_lines(frame)
    assert got.columns == frame.columns and got.dtypes == frame.dtypes
    rows = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()), key=str)
    assert rows == sorted([(1, f"{line}\n{other}\nhere", 73), (2, "short", 5), (2, "short", 5), (3, None, None), (0, "x", 1), (4, "", 0)], key=str)


def test_short_lines(spark):
    """All lengths, blank lines too, by edit distance as well; or exact repeats only; or none."""
    rng, docs = random.Random(11), []
    pool = ["".join(rng.choice("ab c") for _ in range(n)) for n in [0, 1, 2, 3, 15, 16, 17, 24, 25, 33] * 3]
    for i in range(40):
        mine = [rng.choice(pool) for _ in range(6)]
        docs.append((i, "\n".join(edited(rng, x) if x and rng.random() < 0.4 else x for x in mine)))
    for chars in ({"min_chars": 0, "near_chars": 0}, {"min_chars": 0}, {}, {"min_chars": 20, "near_chars": 20}, {"min_chars": 25}):
        got = ours(spark, docs, **chars)
        assert len(got) > 5 and got == brute(docs, **{"min_chars": line_dedup.MIN_CHARS, "near_chars": line_dedup.NEAR_CHARS} | chars)


def test_columns_named_like_helpers(spark):
    line = "a line that is long enough to judge"
    rows = [(1, line, "a", "b", "c", 1), (2, f"{line}\nother", "a", "b", "c", 2), (None, f"other\n{line}", "a", "b", "c", 3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, gone_key string, gone_th string, GONE_lines string, h1 int")
    got = line_dedup.drop_lines(frame, length=None)
    assert got.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, f"other\n{line}"), (1, ""), (2, "")]


def test_very_long_line_and_empty_table(spark):
    assert ours(spark, []) == []
    rng = random.Random(9)
    long = "".join(rng.choice("abcd ") for _ in range(40_000)).strip()
    docs = [(1, long), (2, long[:20_000] + "x" + long[20_000:]), (3, long[:7] + long[8:]), (4, long[:5] + "y" + long[6:100] + "z" + long[101:])]
    assert ours(spark, docs) == [(2, 0, 1, 0, 1), (3, 0, 1, 0, 1)]


def test_no_python_in_the_plan(spark, data):
    plan = line_dedup.duplicate_lines(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
