"""Token ids in sorted-string-table shards.

Documents are range-partitioned by identifier, encoded where they lie, and each partition is written as one shard.
A shard holds blocks of entries in key order, then an index with one entry for each block, a Bloom filter of all keys
and a footer of fixed size::

    block   = entry*           entry = varint shared, varint rest, varint bytes, rest of the key, token ids
    index   = (varint key length, key, varint offset, varint length, varint documents, varint tokens)*
    bloom   = bit array
    footer  = offsets and lengths of index and bloom, number of keys, tokens, bytes of an id, hashes, magic

Within a block a key stores only what differs from the key before it; a block's first key is whole. Keys keep the
order of the identifiers as bytes (null first, then signed 64-bit). Ids are little-endian, 2 bytes if the vocabulary
allows, else 4. A lookup reads the footer, index and filter once, then a binary search finds the only block to read.

Only shards named in the manifest count, so a task that is run twice leaves at most an unused file.

Edge cases: a null text is encoded as an empty one; null identifiers come first; repeated identifiers are kept, in
order of a hash of their texts; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches, shared_dir, staged

MAGIC = b"SIFTSST1"
FOOTER = struct.Struct("<QQQQQQBB8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS = 10  # for each key
BLOOM_HASHES = 7
#: Words whose ids a worker remembers; beyond it starts afresh.
MEMO_WORDS = 1_000_000

#: How byte-level tokenizers write bytes: printable ones of Latin-1 as themselves, others in order from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}

MANIFEST = "part long, path string, documents long, tokens long, first_id long, last_id long"


# --- encoding ---------------------------------------------------------------------------------------------------


#: Texts on which a tokenizer shows whether it lowercases, joins words or adds anything.
PROBES = ("The Quick brown-fox, it's 12.5% & ÀÉÜ straße.\tNew\nline  two  spaces", " leading and trailing ", "UPPER CASE, of the of the in a 日本 語 Ünïcödé don't!", "a b c the the the 1 2 3 , . ; x\r\ny")


class WordEncoder:
    """Encodes texts word by word with a tokenizer that never joins what white space separates.

    Words recur, so their ids are remembered. The ids of a whole text are those of its words, one after another. A
    tokenizer that isn't so on the ``PROBES`` encodes whole texts.
    """

    _shared: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.type = np.dtype("<u4" if self.wide else "<u2")
        self.memo: dict[str, bytes] = {"": b""}
        # Letters whose normal form and lower case are one letter each, and perhaps a mark: such words need the merges only.
        self.plain = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.tokenize = self.tokenizer.model.tokenize  # asking the tokenizer for its model makes an object each time
        self.whole = False
        self.pack = {n: struct.Struct(f"<{n}{'I' if self.wide else 'H'}").pack for n in range(1, 65)}
        self.marks = {m: self._merged(m) for m in ".,;:!?"}
        plain = [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch(list(PROBES), add_special_tokens=False)]
        try:
            self.whole = self.encode(list(PROBES)) != plain
        except (AttributeError, ValueError):
            self.whole = True

    @classmethod
    def get(cls, path: str) -> "WordEncoder":
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _merged(self, part: str) -> bytes:
        """The ids of one run of letters or one mark."""
        part = part.lower()
        if not part.isascii():  # an ASCII letter or mark is written as itself
            part = part.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        ids = [t.id for t in self.tokenize(part)]
        return self.pack[len(ids)](*ids) if len(ids) in self.pack else np.array(ids, self.type).tobytes()

    def _learn(self, missing: list[str]) -> None:
        memo, marks, merged, other = self.memo, self.marks, self._merged, []
        for w in missing:
            mark = marks.get(w[-1])
            letters = w if mark is None else w[:-1]
            if not (letters.isalpha() if letters.isascii() else self.plain(letters)):
                other.append(w)
            elif mark is None:
                memo[w] = merged(w)
            else:
                known = memo.get(letters)
                if known is None:
                    known = memo[letters] = merged(letters)
                memo[w] = known + mark
        for w in other:  # a batch of so few words would cost more for the tokenizer's threads than for the words
            memo[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, self.type).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if self.whole:
            return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.memo) > MEMO_WORDS:
            self.memo = {"": b""}
        out = []
        for t in texts:
            parts = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            try:
                out.append(b"".join(map(self.memo.__getitem__, parts)))
            except KeyError:
                self._learn([w for w in dict.fromkeys(parts) if w not in self.memo])
                out.append(b"".join(map(self.memo.__getitem__, parts)))
        return out


# --- file format ------------------------------------------------------------------------------------------------


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """The bits of each key: two hashes, combined."""
    a = np.array([zlib.crc32(k) for k in keys], np.uint64)
    b = np.array([zlib.crc32(k, 0x9E3779B9) for k in keys], np.uint64) | np.uint64(1)
    return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class ShardWriter:
    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.tokens = self.documents = 0
        self.index, self.keys = [], []
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.first, self.last, self.n, self.ids = bytearray(), b"", b"", 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n, self.ids = key, self.n + 1, self.ids + len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.n:
            self.out.write(bytes(self.block))
            self.index.append(_varint(len(self.first)) + self.first + _varint(self.at) + _varint(len(self.block)) + _varint(self.n) + _varint(self.ids))
            self.at, self.tokens, self.documents = self.at + len(self.block), self.tokens + self.ids, self.documents + self.n
            self._fresh()

    def close(self) -> None:
        self.flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits // 8, np.uint8)
        for i in range(0, len(self.keys), 4096):
            probes = _probes(self.keys[i : i + 4096], bits).ravel()
            np.bitwise_or.at(bloom, probes >> np.uint64(3), np.left_shift(1, probes & np.uint64(7)).astype(np.uint8))
        self.out.write(index + bloom.tobytes())
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.documents, self.tokens, self.width, BLOOM_HASHES, MAGIC))


class ShardReader:
    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        at, length, bloom_at, bloom_length, self.documents, self.tokens, self.width, _, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard of this format")
        self.type = np.dtype("<u4" if self.width == 4 else "<u2")
        self.file.seek(at)
        data, i, self.firsts, self.blocks = self.file.read(length), 0, [], []
        while i < len(data):
            n, i = _read_varint(data, i)
            self.firsts.append(data[i : i + n])
            i += n
            row = []
            for _ in range(4):
                v, i = _read_varint(data, i)
                row.append(v)
            self.blocks.append(tuple(row))
        self.file.seek(bloom_at)
        self.bloom = np.frombuffer(self.file.read(bloom_length), np.uint8)

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        at, length, *_ = self.blocks[block]
        self.file.seek(at)
        data, i, key = self.file.read(length), 0, b""
        while i < length:
            shared, i = _read_varint(data, i)
            rest, i = _read_varint(data, i)
            n, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            i += rest
            yield key, data[i : i + n]
            i += n

    def may_hold(self, key: bytes) -> bool:
        probes = _probes([key], len(self.bloom) * 8)[0]
        return bool(np.all(self.bloom[probes >> np.uint64(3)] >> (probes & np.uint64(7)).astype(np.uint8) & 1))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of this identifier, from the blocks that can hold it."""
        key = key_of(doc_id)
        if not self.blocks or not self.may_hold(key):
            return []
        found, block = [], bisect_right(self.firsts, key) - 1
        while block > 0 and self.firsts[block] == key:  # a repeated key may begin in an earlier block
            block -= 1
        for b in range(max(block, 0), len(self.blocks)):
            if self.firsts[b] > key:
                break
            found += [np.frombuffer(v, self.type) for k, v in self.entries(b) if k == key]
        return found


# --- operators --------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards in ``folder``; returns the manifest, one row for each shard."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    ordered = columns.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, context = WordEncoder.get(tokenizer), TaskContext.get()
        end = np.array([end_id], encoder.type).tobytes()
        part, path, writer, out = context.partitionId(), "", None, None
        first = last = None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i in range(0, len(ids), 64):
                for doc_id, value in zip(ids[i : i + 64], encoder.encode(batch.column(1)[i : i + 64].to_pylist()), strict=True):
                    if writer is None:
                        path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
                        system, name = fs.FileSystem.from_uri(path)
                        system.create_dir(name.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(name)
                        writer, first = ShardWriter(out, encoder.type.itemsize), doc_id
                    writer.add(key_of(doc_id), value + end)
                    last = doc_id
        if writer is not None:
            writer.close()
            out.close()
            row = [[part], [path], [writer.documents], [writer.tokens], [first], [last]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "path", "documents", "tokens", "first_id", "last_id"])

    return staged(ordered.mapInArrow(write, MANIFEST), "sst-manifest")


def read_digests(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each shard, no more
    # A stated number of partitions, which isn't folded: each shard is read by a task of its own.
    shards = manifest.select("part", "path", F.coalesce(before, F.lit(0)).alias("start")).repartitionByRange(max(1, manifest.count()), "part").select("path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(path)
                for b in range(len(reader.blocks)):
                    rows: list[tuple] = []
                    for key, value in reader.entries(b):
                        n = len(value) // reader.width
                        rows.append((id_of(key), start, n, zlib.crc32(np.frombuffer(value, reader.type).astype("<u4").tobytes())))
                        start += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """The ids of some documents, by binary search: first among the shards' ranges, then in a shard's block index."""
    shards = manifest.select("path", "first_id", "last_id").collect()
    found: dict[int, list[list[int]]] = {}
    for path, first, last in shards:
        wanted = [i for i in doc_ids if last is not None and (first is None or first <= i) and i <= last]
        reader = ShardReader(path) if wanted else None
        for i in wanted:
            if got := reader.get(i):
                found.setdefault(i, []).extend(x.tolist() for x in got)
    return found


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    return read_digests(write_shards(docs, tokenizer, end_id))


def default_tokenizer(_: SparkSession | None = None) -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
