"""A worker holds one operator's memory at a time."""

from tideclock.llm import minhash, tokens, worker


def test_memory_changes_hands():
    path = tokens.default_tokenizer()
    minhash.shingles(b"a b c d", 3)
    assert minhash._hashes
    tokens.encoder(path)
    assert not minhash._hashes and tokens._encoders
    first = tokens.encoder(path)
    assert tokens.encoder(path) is first
    minhash.shingles(b"a b c d", 3)
    assert not tokens._encoders and minhash._hashes
    worker.claim("someone else")
    assert not minhash._hashes
