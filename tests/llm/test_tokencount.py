"""Token counts against the tokenizer's own encoding."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftlog.llm import tokencount
from siftlog.llm.sstable import default_tokenizer

SCHEMA = "doc_id long, text string, n_tokens string, n_bytes string"
PARTS = [*"aAbB \t\n\x0b\x0c\x1c\x85 　'12³½.,éÉ̸<>|KΩ日本語🙂İıßſǅ‍\u0000", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "don't", "DON'T", "the", "The", "Ünïcödé", "antidisestablishment", "é"]


def texts():
    r = random.Random(2)
    odd = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(400)]
    return [None, "", "  \n", "x" * 50_000, "the quick brown fox. " * 3000, "<|endoftext|><|startoftext|>", *odd, odd[3], odd[3]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_are_the_librarys(spark, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in tokencount.token_counts(spark.createDataFrame(rows, SCHEMA).repartition(4), path).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048), t
        assert got[i]["n_direct"] <= n
    assert sum(r["n_direct"] for r in got.values()) > 3000


def test_proof_holds_within_texts():
    path = default_tokenizer()
    proof, library = tokencount.proven(path), Tokenizer.from_file(path)
    vocabulary = library.get_vocab()
    plain = sorted(p for p in proof if p.isascii() and p.isalpha())
    assert len(plain) > 20_000 and all(f"{p}</w>" in vocabulary for p in proof)
    for p in random.Random(3).sample(plain, 500):
        assert library.encode(f"7 {p} 7", add_special_tokens=False).ids[1:-1] == [vocabulary[f"{p}</w>"]]


def test_whether_words_can_be_cut_is_read_from_the_file():
    import json

    spec = json.loads(Tokenizer.from_file(default_tokenizer()).to_str())
    assert tokencount._cuts_at_spaces(spec)
    for change in ({"normalized": True}, {"lstrip": True}):
        assert not tokencount._cuts_at_spaces({**spec, "added_tokens": [{**spec["added_tokens"][0], **change}]})
    assert not tokencount._cuts_at_spaces({**spec, "normalizer": {"type": "Prepend", "prepend": "_"}})
    assert not tokencount._cuts_at_spaces({**spec, "pre_tokenizer": None})


def test_a_full_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO_WORDS", 10)
    path = default_tokenizer()
    counter, library = tokencount.Counter(path, tokencount.proven(path)), Tokenizer.from_file(path)
    for i in range(50):
        t = " ".join(f"word{i}x{j}" for j in range(5))
        assert counter.count(t.encode()) % tokencount.DIRECT == len(library.encode(t, add_special_tokens=False).ids)
    assert len(counter.memo) <= 16


def test_edges(spark):
    assert tokencount.token_counts(spark.createDataFrame([], SCHEMA)).collect() == []
    same = tokencount.token_counts(spark.createDataFrame([(None, "a b", "", ""), (1, "a b", "", ""), (1, "a b", "", "")], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in same) == [("1", 2), ("1", 2), ("None", 2)]
    with pytest.raises(ValueError, match="json"):
        tokencount.proven("some.model")
