"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by a pattern. The first tier is a minimal perfect hash over the
vocabulary: one probe and one comparison say whether a whole pre-token is a token. The second tier
merges the bytes of a miss: they form a linked list, and a heap hands out the pair of neighbours with
the lowest rank, leftmost first, until no pair is in the vocabulary. Results of pre-tokens are kept in a
cache of bounded size in each worker.

Texts never leave their task and nothing is shuffled. The vocabulary is read on the driver and sent to
the workers; it is as large as its file.
"""

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm import words

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that one half of a worker's cache holds.
CACHE = 50_000
#: Characters up to which a text's pre-tokens are listed at once; a longer text is cut as it is read.
LISTED = 1 << 20
GROUP = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class PerfectHash:
    """Minimal perfect hash by displacement: each bucket of keys has a pair (factor, shift) that sends
    its keys to free slots, of which there are as many as keys."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.size, self.buckets = max(len(keys), 1), max(len(keys) // 4, 1)
        groups: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            bucket, a, b = self._hashes(key)
            groups[bucket].append((a, b, key))
        self.factor, self.shift = [0] * self.buckets, [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.size
        free = set(range(self.size))
        for bucket in sorted(range(self.buckets), key=lambda x: -len(groups[x])):
            group = groups[bucket]
            if len(group) == 1:  # a lone key goes to any free slot
                slot = free.pop()
                self.shift[bucket] = (slot - group[0][0]) % self.size
                self.keys[slot] = group[0][2]
                continue
            trial = 0
            while group:
                factor, shift = divmod(trial, self.size)
                slots = [(a + factor * b + shift) % self.size for a, b, _ in group]
                if len(set(slots)) == len(slots) and free.issuperset(slots):
                    self.factor[bucket], self.shift[bucket] = factor, shift
                    for slot, (_, _, key) in zip(slots, group):
                        self.keys[slot] = key
                    free.difference_update(slots)
                    break
                trial += 1
        self.ids = [ranks[k] if k is not None else -1 for k in self.keys]

    def _hashes(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h % self.buckets, (h >> 64) % self.size, (h >> 96) % self.size + 1

    def get(self, key: bytes) -> int | None:
        bucket, a, b = self._hashes(key)
        slot = (a + self.factor[bucket] * b + self.shift[bucket]) % self.size
        return self.ids[slot] if self.keys[slot] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of a piece: merge the pair of neighbours of lowest rank, leftmost first, while there is one."""
    n = len(piece)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    current: list[int | None] = [None] * n  # rank of the pair that starts here
    heap: list[tuple[int, int]] = []
    for i in range(n - 1):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            current[i] = rank
            heap.append((rank, i))
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if current[i] != rank:
            continue
        joined = following[i]
        following[i] = end = following[joined]
        current[joined] = None
        if end < n:
            before[end] = i
        for start in (i, before[i]):
            if start < 0:
                continue
            middle = following[start]
            found = None
            if middle < n and following[middle] - start <= longest:
                found = ranks.get(piece[start:following[middle]])
            current[start] = found
            if found is not None:
                heapq.heappush(heap, (found, start))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:following[at]]])
        at = following[at]
    return ids


class Codec:
    """Encoder and decoder of one vocabulary; packs ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash(ranks)
        self.longest = max(map(len, ranks), default=0)

    def tokens(self) -> list[bytes]:
        """The tokens by id."""
        out = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out


class Task:
    """A codec at work in one task. The caches end with the task: the codec itself, a broadcast value,
    outlives it in its worker and so holds nothing that grows."""

    def __init__(self, codec: Codec):
        self.codec, self.cut, self.by_id = codec, regex.compile(codec.pattern), codec.tokens()
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _packed(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            key, codec = piece.encode(), self.codec
            rank = codec.whole.get(key)
            ids = [rank] if rank is not None else merge_bytes(key, codec.ranks, codec.longest)
            found = np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.recent) >= CACHE:
                self.older, self.recent = self.recent, {}
            self.recent[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        out = []
        for pieces in self._pieces(text):
            try:  # most groups of pre-tokens are known as a whole
                out.append(b"".join(map(self.recent.__getitem__, pieces)))
            except KeyError:
                get, packed = self.recent.get, self._packed
                parts = []
                for p in pieces:
                    known = get(p)
                    if known is None:
                        known = packed(p)
                        get = self.recent.get
                    parts.append(known)
                out.append(b"".join(parts))
        return b"".join(out)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LISTED:
            yield self.cut.findall(text)
            return
        found = (m.group() for m in self.cut.finditer(text))
        while group := list(islice(found, GROUP)):
            yield group

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode whole texts and decode the ids again, without special tokens.

    Returns one row per input row: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers)
    and decoded (bytes). ``path`` names a rank file, ``pattern`` the pre-token pattern; by default those of
    the public multilingual vocabulary. A null text counts as empty and has no ids. Text in which the
    pattern leaves a gap loses it, as the pattern's owner has it. Other columns are left out.
    """
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(path), pattern))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Task(codec.value)
        for batch in words.pieces(batches):
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
        own = ids = batch = None
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op6_bpe_codec(spark, sf_dir: str) -> DataFrame:
    out = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
