"""Quality rules against a plain reading of their definition."""

import re

import pytest

from tideclock.llm import quality_rules as Q

SCHEMA = "doc_id bigint, text string, source string, kept string, host string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = ["", None, "  \n\t", "a", "a b c", "a b c a b c", "a a a a", "é\xa0ü x\x1cy z", "x\n\nx\n x\nx", "#1 <a> | & $ % * b", "one two three four one two three five two three five"]


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    assert Q.measure(None if text is None else text.encode()) == plain(text)


def test_many_distinct_words(monkeypatch):
    words = [b"%d" % (i % 7) for i in range(50)]
    few = Q.repeat_words(words)
    monkeypatch.setattr(Q.np, "int64", Q.np.int64)
    assert few == plain(" ".join(str(i % 7) for i in range(50)))[4]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], SCHEMA)


GOOD = " ".join(f"word{i}" for i in range(60))


def test_hosts_decide(spark, monkeypatch):
    rows = [(i, GOOD, "clean") for i in range(40)] + [(100 + i, "junk", "dirty") for i in range(39)] + [(200, GOOD, "dirty"), (201, GOOD, None), (202, None, None), (203, "| " * 60, "clean"), (203, "| " * 60, "clean")]
    for most in (Q.BROADCAST_HOSTS, 0):  # the broadcast, and the salted join beyond its bound
        monkeypatch.setattr(Q, "BROADCAST_HOSTS", most)
        got = Q.judge(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        kept = {r["doc_id"] for r in got if r["kept"]}
        assert kept == {*range(40), 201}
        assert {r["host_rejected"] for r in got if r["host"] == "dirty"} == {True}
        stays = Q.keep_documents(frame(spark, rows))
        assert stays.columns == ["doc_id", "text", "source", "kept", "host", "key"]
        assert {r["doc_id"] for r in stays.collect()} == kept


def test_small_hosts_are_shrunk(spark):
    rows = [(i, GOOD if i % 2 else "junk", f"h{i // 20}") for i in range(200)] + [(900, "junk", "one-page")]
    got = {r["doc_id"]: r for r in Q.judge(frame(spark, rows)).collect()}
    assert not got[900]["host_rejected"] and got[900]["shrunk_rate"] < 0.8
    assert all(got[i]["kept"] == bool(i % 2) for i in range(200))


def test_empty_table(spark):
    assert Q.judge(frame(spark, [])).count() == 0
    assert Q.keep_documents(frame(spark, [])).count() == 0
