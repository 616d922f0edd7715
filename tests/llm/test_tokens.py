"""Word-by-word encoding against the tokenizer itself."""

import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tideclock.llm import tokens

PATH = tokens.default_tokenizer()


UNTOUCHED = Tokenizer.from_file(PATH)


def plain(texts):
    return [x.ids for x in UNTOUCHED.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    return [x.tolist() for x in tokens.documents(pa.array(texts, pa.string()), PATH)]


def check(texts):
    assert ours(texts) == [x + [tokens.END_ID] for x in plain(texts)]


def test_awkward_texts():
    check(["", " ", "\n\n", "a  b", "it's 'tis we'll--'s don't", "É ÀÉ é́ é ñ ÿ ß ẞ", "<|endoftext|> a<|startoftext|>b", "\t\x1c\x85\xa0 x y", "İstanbul ſ ΣΑΣ 12,5 ½ ²", "日本語 text 🙂🙂", "a" * 5000, "x." * 3000, "́a ́"])
    assert ours([]) == []


def test_added_tokens():
    """The file's own added tokens become their ids, in any surroundings; parts of them and other cases are plain text."""
    start, end = "<|startoftext|>", "<|endoftext|>"
    assert ours([f"a {end} b"]) == [[320, 49407, 321, tokens.END_ID]]
    check([f"a {end} b", "plain", f"{start}{end}", f"x{end}y", f"{start} {start}a", "<|endoftext|", "endoftext|>", "<|ENDOFTEXT|>", "<|endof text|>", f"{end}\u0338", f"<{end}>", "", "also plain, it's", f"\n{end}\n"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|", "|>", "endoftext", "startoftext", " ", "a", "É", "\n", "<", "|", ">", "\u0338", "ENDOFTEXT"]), max_size=12).map("".join), max_size=6))
def test_texts_around_added_tokens(texts):
    check(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("abzAZ019'\"|%.,-_ \n\t") + ["é", "É", "ß", "ç", "́", "ſ", "'s", "'ll", "İ", "½", "🙂", "\xa0", "×", "µ"]), max_size=60).map("".join), max_size=5))
def test_mixed_texts(texts):
    check(texts)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 5)
    check(["one two three four five six seven"] * 3)
    check(["one eight nine", "two"])


def test_nulls_and_slices():
    texts = pa.array(["zero", "one two", None, "three"], pa.string())
    assert [x.tolist() for x in tokens.documents(texts[1:], PATH)] == ours(["one two", "", "three"])


def test_runs_cover_all():
    texts = pa.array(["x" * n for n in (0, 5, 3, 0, 9, 1)])
    assert [t for r in tokens.runs(texts, 6) for t in texts[r].to_pylist()] == texts.to_pylist()
    assert tokens.runs(texts[:0]) == []
