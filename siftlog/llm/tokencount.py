"""Token counts without tokens: whole-token shortcut.

A tokenizer of merges treats each pre-token by itself. Offline, ``proven`` tries every string of the vocabulary: those
that the tokenizer, given the string alone, returns as just this one token are proven to count one wherever they are a
pre-token. Texts are then cut into pre-tokens; a proven one counts one by looking it up, and only the others go through
the merges. The proof has at most one string for each entry of the vocabulary and is broadcast.

Where the tokenizer's own file says that it drops white space and joins nothing across it (``WORD_PATTERNS``), texts are
cut at ASCII white space first and a worker remembers the counts of words (at most ``MEMO_WORDS``, then afresh), as they
recur. Other tokenizers cut whole texts. A word or text that holds the string of an added token, as it is or once
normalised, is counted by the library itself, which finds such strings before anything else.

Edge cases: a null text is empty and has no tokens; texts are counted whole, without truncation, whatever the file asks
for; repeated rows are counted each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches
from siftlog.llm.sstable import BYTE_CHARACTERS, default_tokenizer

#: Patterns that match no white space, as the files of tokenizers have them.
WORD_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: Words whose counts a worker remembers.
MEMO_WORDS = 1_000_000
#: A count and, in the bits above, how much of it the shortcut gave.
DIRECT = 1 << 40

COLUMNS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_direct long"


@dataclass(frozen=True)
class CountParams:
    limit: int = 2048


def _load(path: str):
    from tokenizers import Tokenizer

    if not path.endswith(".json"):
        raise ValueError(f"{path}: a tokenizer's .json file is needed")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _cuts_at_spaces(spec: dict) -> bool:
    """Whether white space is dropped and no pre-token or normal form reaches across it."""
    cut = spec.get("pre_tokenizer") or {}
    cut = cut["pretokenizers"][0] if cut.get("type") == "Sequence" and cut["pretokenizers"] else cut
    known = cut.get("type") == "Split" and cut.get("invert") and cut.get("behavior") == "Removed" and cut.get("pattern", {}).get("Regex") in WORD_PATTERNS
    steps = spec.get("normalizer") or {}
    steps = steps["normalizers"] if steps.get("type") == "Sequence" else [steps] if steps else []
    harmless = all(s["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for s in steps)
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", []))
    return bool(known and harmless and plain)


def proven(path: str) -> frozenset[str]:
    """The pre-tokens, as the model sees them, that alone become one token: their own."""
    tokenizer = _load(path)
    spec = json.loads(tokenizer.to_str())
    suffix = spec["model"].get("end_of_word_suffix") or ""
    byte_of = {chr(c): b for b, c in BYTE_CHARACTERS.items()}
    byte_level = "ByteLevel" in json.dumps(spec.get("pre_tokenizer"))
    tried = []
    for entry, i in spec["model"]["vocab"].items():
        piece = entry.removesuffix(suffix)
        if not piece or not entry.endswith(suffix):
            continue
        try:
            tried.append((piece, i, bytes(byte_of[c] for c in piece).decode() if byte_level else piece))
        except (KeyError, UnicodeDecodeError):  # part of a letter: no text is this alone
            continue
    found = tokenizer.encode_batch([t for _, _, t in tried], add_special_tokens=False)
    return frozenset(p for (p, i, _), e in zip(tried, found, strict=True) if e.ids == [i])


class Counter:
    """Counts the tokens of UTF-8 texts; the shortcut's share lies in the bits from ``DIRECT`` on."""

    _shared: dict[str, "Counter"] = {}

    def __init__(self, path: str, proof: frozenset[str]):
        self.tokenizer, self.proof = _load(path), proof
        spec = json.loads(self.tokenizer.to_str())
        self.words = _cuts_at_spaces(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.normalizer, self.pre_tokenizer, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.memo: dict[bytes, int] = {}

    @classmethod
    def get(cls, path: str, proof: frozenset[str]) -> "Counter":
        if path not in cls._shared:
            cls._shared[path] = cls(path, proof)
        return cls._shared[path]

    def _whole(self, text: str) -> int:
        """The count of a word or text, cut by the tokenizer's own rules."""
        normal = self.normalizer.normalize_str(text) if self.normalizer else text
        if any(a in text or a in normal for a in self.added):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces: Iterable[str] = [p for p, _ in self.pre_tokenizer.pre_tokenize_str(normal)] if self.pre_tokenizer else [normal] if normal else []
        return sum(1 + DIRECT if p in self.proof else len(self.model.tokenize(p)) for p in pieces)

    def count(self, text: bytes) -> int:
        if not self.words:
            return self._whole(text.decode("utf-8", "replace"))
        parts = text.split()  # of bytes: at space and tab to carriage return only
        try:
            return sum(map(self.memo.__getitem__, parts))
        except KeyError:
            if len(self.memo) > MEMO_WORDS:
                self.memo = {}
            for w in dict.fromkeys(parts):
                if w not in self.memo:
                    self.memo[w] = self._whole(w.decode("utf-8", "replace"))
            return sum(map(self.memo.__getitem__, parts))


def token_counts(docs: DataFrame, tokenizer: str | None = None, params: CountParams = CountParams()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_direct (tokens that the shortcut counted) of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path, limit = tokenizer or default_tokenizer(), params.limit
    proof = spark.sparkContext.broadcast(proven(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.get(path, proof.value)
        for batch in batches:
            found = np.array([counter.count(t.as_py()) for t in batch.column(1)], np.int64)
            n = found & DIRECT - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit), pa.array(found >> 40)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_direct"])

    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).cast("long").alias("n_bytes")).mapInArrow(count, COLUMNS)
