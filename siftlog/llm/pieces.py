"""SentencePiece encoding and decoding by a max-plus scan.

A text is cut into the pieces of a public vocabulary whose scores have the largest sum (Viterbi over the max-plus
semiring, with bytes for characters that the vocabulary lacks). The one public model at hand was trained for merges;
merging isn't a largest sum, so its pieces and scores are used, but not its merge order.

Texts longer than ``chunk`` characters are split into chunks. A state at a chunk's border is how far past the border
the first cut lies, 0 to 15, since no piece is longer than 16. Each chunk yields its transfer matrix, the best score
from every state at its start to every state at its end. Matrices are multiplied in blocks, then along the blocks, and
states are traced back first over blocks, then within them; each chunk is then encoded alone between its two cuts. A
best path must cut before a space that follows other characters and around characters without a piece, so most of a
chunk adds the same to all entries; a matrix holds differences only, which leaves every choice as it is.

Between two forced cuts a text is a word; words recur, so a worker remembers their ids, and all best paths of a word
that has a few.

Scores are whole numbers, so several paths often have the largest sum. Each place of a text has a tie number, and of
such paths that counts whose cuts have the largest sum of them. Scores and tie sums are the real and imaginary parts of
complex numbers, which numpy compares in this order, so a text has the same ids however it is split.

Edge cases: null and empty texts have no ids and decode to the empty text; a text of one endless word is scanned by
the full recurrence; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches, staged

CHUNK = 32_768
BLOCK = 64  # matrices multiplied by one group
LOW = complex(-np.inf, 0)
MEMO_WORDS = 1_000_000
MEMO_CHARS = 64  # longer words aren't remembered
MEMO_PATHS = 8  # equal paths of a word that are remembered; with more the recurrence runs again, at the word's place
TYPE = np.dtype("<u2")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tie(place: int) -> int:
    """The tie number of a cut at ``place``: 20 bits of a hash."""
    x = (place * 0x9E3779B1) & 0xFFFFFFFF
    x = ((x ^ x >> 15) * 0x85EBCA77) & 0xFFFFFFFF
    return ((x ^ x >> 13) * 0xC2B2AE3D & 0xFFFFFFFF) >> 12


NO_PIECE: tuple = (None, {})
#: The tie numbers of the places of most texts.
TIES = [tie(place) for place in range(2 * CHUNK)]


def tie_sum(at: int, cuts: list[int]) -> int:
    """The sum of the tie numbers of ``cuts``, which are ascending, from place ``at`` on."""
    return sum([TIES[at + c] for c in cuts] if at + cuts[-1] < len(TIES) else [tie(at + c) for c in cuts])


class Pieces:
    """The vocabulary with its scores, and the best segmentation of words."""

    _shared: dict[str, "Pieces"] = {}

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = pb.ModelProto.SentencePiece
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)]
        self.score = {p.replace("▁", " "): s for _, p, s in normal}
        self.known = frozenset(p for p in self.score if len(p) == 1)
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - 10
        self.ids = {p.replace("▁", " "): i for i, p, _ in normal}
        self.packed = {p: np.array([i], TYPE).tobytes() for p, i in self.ids.items()}
        self.begins = frozenset(p[:n] for p in self.score for n in range(1, len(p) + 1))
        self.tree = self._tree()
        self.bytes = [b""] * len(model.pieces)
        self.of_byte = [0] * 256
        for i, p, _ in normal:
            self.bytes[i] = p.replace("▁", " ").encode()
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.of_byte[int(p.piece[3:-1], 16)] = i
                self.bytes[i] = bytes([int(p.piece[3:-1], 16)])
        cut = "\n" if "\n" not in self.known else ""
        self.words = re.compile(rf" *[^ {cut}]+|{cut}| +" if cut else r" *[^ ]+| +").findall
        self.memo: dict[str, bytes | list[tuple[list[int], bytes]] | None] = {}  # list: equal paths, which the place decides; None: many

    def _tree(self) -> dict:
        """The pieces by their characters: each character's score, if a piece ends with it, and the characters after it."""
        made: dict = {}
        none: dict = {}  # most pieces aren't the beginning of another one
        for p in sorted(self.begins, key=len, reverse=True):
            made.setdefault(p[:-1], {})[p[-1]] = (self.score.get(p), made.pop(p, none))
        return made[""]

    @classmethod
    def get(cls, path: str) -> "Pieces":
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _pieces(self, word: str, cuts: list[int]) -> bytes:
        parts = [word[a:b] for a, b in zip([0, *cuts], cuts)]
        try:
            return b"".join([self.packed[x] for x in parts])
        except KeyError:  # bytes stand for a character without a piece
            pass
        return b"".join([self.packed[x] if x in self.packed else np.array([self.of_byte[b] for b in x.encode("utf-8", "replace")], TYPE).tobytes() for x in parts])

    def _paths(self, word: str) -> bytes | list[tuple[list[int], bytes]] | None:
        """The ids on the best path through a word; of a few equal paths each with its cuts; None of many."""
        n, begin, unknown = len(word), self.tree.get, self.unknown
        best, came, ways = [0.0, *[-np.inf] * n], [0] * (n + 1), [1] * (n + 1)
        for i in range(n):
            here, way, j = best[i], ways[i], i + 1
            s, after = begin(word[i], NO_PIECE)
            if s is None:
                s = unknown  # a character alone always has a path
            while True:
                if s is not None:
                    value, old = here + s, best[j]
                    if value > old:
                        best[j] = value
                        came[j] = i
                        ways[j] = way
                    elif value == old:
                        ways[j] += way
                if j == n or (found := after.get(word[j])) is None:
                    break
                s, after = found
                j += 1
        if ways[n] == 1:
            cuts, end = [], n
            while end:
                cuts.append(end)
                end = came[end]
            return self._pieces(word, cuts[::-1])
        if ways[n] > MEMO_PATHS:
            return None
        done, open_ = [], [[n]]
        while open_:
            cuts = open_.pop()
            j = cuts[0]
            if not j:
                done.append((cuts[1:], self._pieces(word, cuts[1:])))
                continue
            for i in range(max(0, j - self.longest), j):
                s = self.score.get(word[i:j], self.unknown if i == j - 1 else None)
                if s is not None and best[i] + s == best[j]:
                    open_.append([i, *cuts])
        return done

    def _placed(self, word: str, at: int) -> bytes:
        """The ids on the best path through a word at place ``at`` of its text."""
        n, score, begins = len(word), self.score, self.begins
        best: list[tuple[float, int] | None] = [(0.0, 0), *[None] * n]
        came = [0] * (n + 1)
        for i in range(n):
            here = best[i]
            for j in range(i + 1, n + 1):
                part = word[i:j]
                if j > i + 1 and part not in begins:
                    break
                s = score.get(part, self.unknown if j == i + 1 else None)
                if s is not None:
                    value = (here[0] + s, here[1] + tie(at + j))
                    if best[j] is None or value > best[j]:
                        best[j], came[j] = value, i
        cuts, end = [], n
        while end:
            cuts.append(end)
            end = came[end]
        return self._pieces(word, cuts[::-1])

    def _word(self, word: str, at: int) -> bytes:
        if len(word) > MEMO_CHARS:
            return self._placed(word, at)
        if word not in self.memo:
            self.memo[word] = self._paths(word)
        found = self.memo[word]
        if found is None:
            return self._placed(word, at)
        return found if isinstance(found, bytes) else max(found, key=lambda path: tie_sum(at, path[0]))[1]

    def encode(self, text: str, at: int = 0) -> bytes:
        """The ids of a text, or of its part at place ``at`` that begins and ends at cuts; a space stands for the word mark."""
        words = self.words(text)
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        found = list(map(self.memo.get, words))
        if open_ := [i for i, ids in enumerate(found) if type(ids) is not bytes]:
            places = list(accumulate(map(len, words), initial=at))
            for i in open_:
                found[i] = self._word(words[i], places[i])
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The text of all ids of a document; the space that encoding put before it goes."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, TYPE).tolist())).decode("utf-8", "replace")[1:]

    def forced(self, text: str, at: int) -> bool:
        """Whether every path has a cut at ``at``."""
        a, b = text[at - 1], text[at]
        return (b == " " and a != " ") or a not in self.known or b not in self.known

    def spread(self, text: str, start: np.ndarray, begin: int, end: int, stop: int, at: int) -> dict[int, np.ndarray]:
        """Best sums at each position from ``begin`` to ``stop``, by pieces that begin before ``end``.

        ``start``: a row for each of the first positions, holding the sums there for each start state; ``at``: the
        place of the text's first character.
        """
        best: dict[int, np.ndarray] = {begin + i: row.copy() for i, row in enumerate(start)}
        for p in range(begin, end):
            here = best.get(p)
            if here is None:
                continue
            single = False
            for n in range(1, min(self.longest, stop - p, len(text) - p) + 1):
                s = self.score.get(text[p : p + n])
                single |= n == 1 and s is not None
                if s is None and n == 1:
                    s = self.unknown
                if s is not None:
                    value, q = here + complex(s, tie(at + p + n)), best.get(p + n)
                    best[p + n] = value if q is None else np.maximum(q, value)
        return best

    def matrix(self, text: str, length: int, at: int) -> np.ndarray:
        """The transfer matrix of a chunk of ``length`` characters at place ``at``; ``text`` also has those after it."""
        n = self.longest
        out = np.full((n, n), LOW)
        for s in range(length, n):  # the first cut lies beyond this chunk
            out[s, s - length] = 0
        inside = min(n, length)
        start = np.full((inside, n), LOW)
        np.fill_diagonal(start, 0)
        head = next((p for p in range(inside, length) if self.forced(text, p)), None)
        tail = next((p for p in range(length - 1, (head or length) - 1, -1) if self.forced(text, p)), None) if head is not None else None
        if tail is None:
            best = self.spread(text, start, 0, length, length + n - 1, at)
            for e in range(n):
                if (v := best.get(length + e)) is not None and length + e <= len(text):
                    out[:inside, e] = np.maximum(out[:inside, e], v[:inside])
            return out
        first = self.spread(text, start, 0, head, head, at)[head]
        last = self.spread(text, np.zeros((1, 1), complex), tail, length, length + n - 1, at)
        for e in range(n):
            if (v := last.get(length + e)) is not None:
                out[:inside, e] = np.maximum(out[:inside, e], first[:inside] + v[0])
        return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, less its largest score: differences are all that counts."""
    out = (a[:, :, None] + b[None, :, :]).max(1)
    top = out.real.max()
    return out - top if np.isfinite(top) else out


def trace(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The states before, between and after ``matrices`` on the best path from ``first`` to ``last``."""
    ahead = np.full(len(matrices[0]), LOW)
    ahead[first] = 0
    seen = [ahead]
    for m in matrices:
        now = (seen[-1][:, None] + m).max(0)
        seen.append(now - now.real.max())
    states = [last]
    for m, v in zip(matrices[::-1], seen[-2::-1], strict=True):
        states.append(int((v + m[:, states[-1]]).argmax()))
    return states[::-1]


def _giants(docs: DataFrame, model: str, chunk: int) -> DataFrame:
    """The long texts' chunks with the states at their borders, each encoded: row, doc_id, chunk, ids."""
    ahead = 15  # characters past the border that a piece may reach into

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "chunk", "length", "part"]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            for row, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                t = " " + text
                rows = [(row, doc_id, i, min(chunk, len(t) - a), t[a : a + chunk + ahead]) for i, a in enumerate(range(0, len(t), chunk))]
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows[i : i + 256], strict=True), types, strict=True)], names=names)

    # The number of partitions is stated, as small tables of matrices would else be folded into one task.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = docs.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = staged(long.mapInArrow(cut, "row long, doc_id long, chunk int, length int, part string").repartition(parts, "row", "chunk"), "chunks")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.get(model)
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True)
            found = [pieces.matrix(t, n, i * chunk).view(float).ravel().tolist() for i, n, t in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["row", "chunk", "m"])

    moved = chunks.select("row", "chunk", "length", "part").mapInArrow(transfer, "row long, chunk int, m array<double>")
    matrices = staged(moved.withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int")).repartition(parts, "row", "block"), "matrices")

    def square(m: np.ndarray) -> np.ndarray:
        values = np.array(m, float).view(complex)
        return values.reshape(int(len(values) ** 0.5), -1)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in map(square, pdf.sort_values("chunk")["m"]):
            out = m if out is None else times(out, m)
        return pd.DataFrame({"row": pdf["row"][:1], "block": pdf["block"][:1], "m": [out.view(float).ravel().tolist()]})

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        states = trace([square(m) for m in pdf["m"]], 0, 0)
        return pd.DataFrame({"row": pdf["row"], "block": pdf["block"], "first": states[:-1], "last": states[1:]})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        states = trace([square(m) for m in pdf["m"]], int(pdf["first"].iloc[0]), int(pdf["last"].iloc[0]))
        return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "from": states[:-1], "to": states[1:]})

    spread = matrices.repartition(parts, "row", "block")
    blocks = spread.groupBy("row", "block").applyInPandas(multiply, "row long, block int, m array<double>")
    borders = blocks.repartition(parts, "row").groupBy("row").applyInPandas(along, "row long, block int, first int, last int")
    placed = matrices.join(borders, ["row", "block"]).repartition(parts, "row", "block")
    states = placed.groupBy("row", "block").applyInPandas(within, "row long, chunk int, from int, to int")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.get(model)
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6)], strict=True)
            ids = [pieces.encode(part[a : n + b], i * chunk + a) for i, n, part, a, b in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(ids, pa.binary())], names=["row", "doc_id", "chunk", "ids"])

    traced = chunks.join(states, ["row", "chunk"]).repartition(parts, "row", "chunk").select("row", "doc_id", "chunk", "length", "part", "from", "to")
    return traced.mapInArrow(encode, "row long, doc_id long, chunk int, ids binary")


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chunks and ids (binary, 2 bytes each) of every document."""
    model = model or default_model()
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.get(model)
        for batch in batches:
            ids = [pieces.encode(" " + t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "n_chunks", "ids"])

    short = docs.where(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, n_chunks int, ids binary")
    done = _giants(docs, model, chunk).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("c"))
    whole_ids = F.aggregate("c", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    giant = done.select("doc_id", F.size("c").alias("n_chunks"), whole_ids.alias("ids"))
    return short.unionByName(giant)


def digests(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chunks, n_tokens, ids_crc32 and, of the text decoded from the ids, n_chars and text_crc32."""
    path = model or default_model()
    ids = encode(docs, path, chunk).select("doc_id", "n_chunks", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.get(path)
        for batch in batches:
            n, sums, chars, texts = [], [], [], []
            for b in batch.column(2).to_pylist():
                n.append(len(b) // TYPE.itemsize)
                sums.append(zlib.crc32(np.frombuffer(b, TYPE).astype("<u4").tobytes()))
                text = pieces.decode(b)
                chars.append(len(text))
                texts.append(zlib.crc32(text.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (n, sums, chars, texts)]], names=["doc_id", "n_chunks", "n_tokens", "ids_crc32", "n_chars", "text_crc32"])

    return ids.mapInArrow(digest, "doc_id long, n_chunks int, n_tokens long, ids_crc32 long, n_chars long, text_crc32 long")
