"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Texts are stored once as blocks of tokens. Each block sends its distinct one- and two-word sequences,
with their counts in the texts to learn from, to buckets by hash. A bucket sums the counts and builds its
segment of the filter: a sequence seen ``c`` times is entered with the levels 1 .. 1 + floor(log2 c), so
probing level after level until one is absent gives back the size class of its count. From the segment,
and from the exact one-word counts that the base score needs, the bucket answers each block in the order
in which it was asked; a block joins its answers to its tokens. So a sequence crosses the network once
for each block that has it, as steps of its hash, and only a size class comes back.

The filter has ``ENTRY_BITS`` bits for each entry, whatever the size of the input, so its rate of false
hits does not grow; the two-word estimate is discounted by that rate.

A caller may have a small filter, of ``filter_bytes`` at most, sent to all workers instead. Then each task
counts its own blocks and scores them by the whole filter; the words that make up at least one in
``FREQUENT`` tokens (so ``FREQUENT`` words at most) go to the workers with exact counts, all other tokens
go to the bucket that holds their count. Both ways read the same filter, as long as ``BUCKET`` adds no buckets.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm import words

#: Words of which exact counts may be sent to all workers.
FREQUENT = 1 << 18
#: Tokens that a task folds at once, and entries that it places at once.
BLOCK = 1 << 20
#: Tokens of the input for each bucket, if that takes more buckets than two for each shuffle partition.
BUCKET = 1 << 21
#: Blocks in one stored file, so that what a writer or reader holds does not grow with a task.
FILE = 8
#: Bits for each entry, and probes of a level.
ENTRY_BITS = 10
PROBES = 4
#: Weight, in tokens, of the one-word model beside a two-word count.
PRIOR = 5.0
ADDED = 0.1

END = np.uint64(0x5BD1E9955BD1E995)
_MASK48 = np.uint64((1 << 48) - 1)
_COUNTS = "bucket int, n int, grams binary"
_TOKENS = "bucket int, block long, entries binary, docs binary"
_BLOCKS = "block long, tokens long, own binary"
_ASKED = "bucket int, block long, asked binary"
_ANSWERS = ("bucket int, block long, words binary, pairs binary, "
            "total long, distinct long, bits long, filled long")
_DOC = np.dtype([("doc", "<i8"), ("no_id", "?"), ("held_out", "?"), ("tokens", "<i8"), ("known", "<i8"),
                 ("sum", "<f8"), ("score", "<f8")])


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the number of tokens of each text."""
    data, ends = words.flat(batch.column("text"))
    data = words.LOWER[data]
    starts, stops, before = words.spans(data, ends)
    hashes = words.word_hashes(data, starts, stops)
    return np.insert(hashes, before[1:], END), np.diff(before) + 1


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """48-bit hash of each token with the one before it; a text begins after an end."""
    before = np.concatenate([[END], tokens[:-1]]).astype(np.uint64)
    return words.mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens) & _MASK48


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
    return grams[head], np.add.reduceat(counts, head) if len(head) else counts


def _count_bytes(counts: np.ndarray) -> bytes:
    """Counts as 32-bit numbers; the few beyond that are listed behind them, place and high half."""
    counts = counts.astype(np.uint64)
    large = np.flatnonzero(counts >> np.uint64(32))
    return b"".join((np.array([len(counts), len(large)], "<u4").tobytes(), counts.astype("<u4").tobytes(),
                     large.astype("<u4").tobytes(), (counts[large] >> np.uint64(32)).astype("<u4").tobytes()))


def _counts(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Counts that begin at a byte, and where they end."""
    n, m = np.frombuffer(blob, "<u4", 2, at).tolist()
    low = np.frombuffer(blob, "<u4", n + 2 * m, at + 8)
    counts = low[:n].astype(np.int64)
    counts[low[n:n + m]] += low[n + m:].astype(np.int64) << 32
    return counts, at + 8 + 4 * n + 8 * m


def _pack(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes with counts; the high halves as steps, so that they compress well."""
    high = (grams >> np.uint64(32)).astype("<u4")
    steps = np.diff(high, prepend=np.uint32(0))
    return b"".join((np.array([len(grams)], "<u4").tobytes(), steps.astype("<u4").tobytes(),
                     grams.astype("<u4").tobytes(), _count_bytes(counts)))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    steps, low = np.frombuffer(blob, "<u4", 2 * n, 4).reshape(2, n)
    counts, _ = _counts(blob, 4 + 8 * n)
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(32) | low.astype(np.uint64), counts


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _whole(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on: the high ones are alike and compress well."""
    return values.view("u1").reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    """Values that begin at a byte, and where they end."""
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data, "u1", n * size, at).reshape(size, n).T.copy().view(kind).ravel()
    return values, at + n * size


def _steps(grams: np.ndarray) -> bytes:
    return _planes(np.diff(grams, prepend=np.uint64(0)).astype("<u8"))


def _from_steps(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    steps, end = _from_planes(data, "<u8", n, at)
    return np.cumsum(steps, dtype=np.uint64), end


def _bucket(grams: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Buckets are ranges of the 16 bits below the 48th (one word: 64th) bit."""
    top = (grams >> np.uint64(32 if n == 2 else 48)).astype(np.int64) & 0xFFFF
    return top * buckets >> 16


def _count(buckets: int):
    def run(batches):
        held: dict[int, list] = {1: [], 2: []}

        def emit():
            rows = []
            for n in (1, 2):
                grams, counts = np.unique(np.concatenate(held[n]), return_counts=True)
                bucket = _bucket(grams, n, buckets)  # grows with the hash
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                rows += [(b, n, _pack(grams[i:j], counts[i:j]))
                         for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
                held[n] = []
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))],
                ["bucket", "n", "grams"])

        size = 0
        for batch in words.pieces(batches):
            tokens, _ = _tokens(batch)
            held[1].append(tokens)
            held[2].append(_pairs(tokens))
            size += len(tokens)
            if size >= BLOCK:
                yield emit()
                size = 0
        if size:
            yield emit()
    return run


def _places(grams: np.ndarray, level: int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    return words.mixed(grams + np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 % 2**64)) % bits


def _levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


def _built(n: int, bucket: int, grams: np.ndarray, counts: np.ndarray, piece: int = BLOCK) -> dict:
    """The exact one-word counts of a bucket and its segment of the filter."""
    levels = _levels(counts)
    bits = max(64, ENTRY_BITS * int(levels.sum()))
    taken = np.zeros(bits, bool)
    for level in range(1, int(levels.max()) + 1):
        chosen = grams[levels >= level]
        for at in range(0, len(chosen), piece):
            for probe in range(PROBES):
                taken[_places(chosen[at:at + piece], level, probe, np.uint64(bits)).astype(np.int64)] = True
    return {"n": n, "bucket": bucket, "distinct": len(grams), "total": int(counts.sum()), "bits": bits,
            "filled": int(taken.sum()), "segment": np.packbits(taken, bitorder="little").tobytes(),
            "exact": _pack(grams, counts) if n == 1 else None}


def _segment(piece: int = BLOCK):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Sum the counts of a bucket; its exact one-word counts and its segment of the filter."""
        parts = [_unpack(x) for x in group["grams"]]
        grams, counts = _summed(*(np.concatenate(x) for x in zip(*parts)))
        return pd.DataFrame([_built(int(group["n"].iloc[0]), int(group["bucket"].iloc[0]), grams, counts, piece)])
    return run


class Filter:
    """All segments in one array, to be probed by many sequences at once."""

    def __init__(self, rows: list, buckets: int):
        rows = sorted(rows, key=lambda r: (r["n"], r["bucket"]))
        self.buckets = buckets
        self.data = np.frombuffer(b"".join(bytes(r["segment"]) for r in rows), np.uint8)
        self.bits = {n: np.ones(buckets, np.uint64) for n in (1, 2)}
        self.start = {n: np.zeros(buckets, np.int64) for n in (1, 2)}
        self.empty = {n: np.ones(buckets, bool) for n in (1, 2)}
        at, filled, held = 0, 0, 0
        for r in rows:
            n, b = r["n"], r["bucket"]
            self.bits[n][b], self.start[n][b], self.empty[n][b] = r["bits"], at, False
            at += len(r["segment"])
            if n == 2:
                filled, held = filled + r["filled"], held + r["bits"]
        self.false_rate = (filled / held) ** PROBES if held else 0.0

    def counts(self, grams: np.ndarray, n: int) -> np.ndarray:
        """The middle of the size class that probing level after level finds; 0 if absent."""
        grams, inverse = np.unique(grams, return_inverse=True)
        return _middle(self.levels(grams, n))[inverse]

    def levels(self, grams: np.ndarray, n: int) -> np.ndarray:
        """The highest level up to which all are found; 0 if absent."""
        bucket = _bucket(grams, n, self.buckets)
        level, alive = np.zeros(len(grams), np.int64), np.flatnonzero(~self.empty[n][bucket])
        while len(alive) and level.max() < 48:
            here, at = grams[alive], bucket[alive]
            hit = np.ones(len(alive), bool)
            step = int(level.max()) + 1
            for probe in range(PROBES):
                place = _places(here, step, probe, self.bits[n][at]).astype(np.int64)
                hit &= (self.data[self.start[n][at] + (place >> 3)] >> (place & 7) & 1).astype(bool)
            alive = alive[hit]
            level[alive] = step
        return level


def _middle(level: np.ndarray) -> np.ndarray:
    """A class [2^(l-1), 2^l) is read as its middle."""
    return np.where(level > 0, 1.5 * 2.0 ** (level.astype(np.int64) - 1) - 0.5, 0.0)


def _scores(one: np.ndarray, two: np.ndarray, begin: np.ndarray, lengths: np.ndarray, norm: float) -> np.ndarray:
    """Log probability of each text from the filter's counts of its words and pairs."""
    before = np.concatenate([[0.0], one[:-1]])
    before[begin] = one[begin + lengths - 1]  # a text begins after an end
    chance = (np.minimum(two, before) + PRIOR * (one + ADDED) / norm) / (before + PRIOR)
    return np.add.reduceat(np.log10(chance), begin)


def _table(batch: pa.RecordBatch, lengths: np.ndarray) -> np.ndarray:
    table = np.zeros(len(lengths), _DOC)
    ids = batch.column("doc_id")
    table["doc"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
    table["no_id"] = ids.is_null().to_numpy(zero_copy_only=False)
    table["held_out"] = batch.column("held_out").to_numpy(zero_copy_only=False)
    table["tokens"] = lengths
    return table


def _score(model, frequent, total: int, distinct: int, buckets: int):
    def run(batches):
        from pyspark import TaskContext

        filter_, (often, often_counts) = model.value, frequent.value
        norm = total + ADDED * (distinct + 1)
        number = TaskContext.get().partitionId() << 32
        docs: list[np.ndarray] = []
        rest: list[tuple[np.ndarray, np.ndarray]] = []
        size = rows_before = 0

        def emit(block):
            hashes, row = (np.concatenate(x) for x in zip(*rest))
            bucket = _bucket(hashes, 1, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, hashes[order[i:j]].astype("<u8").tobytes() + row[order[i:j]].astype("<u4").tobytes(), None)
                    for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
            rows.append((block % buckets, b"", np.concatenate(docs).tobytes()))
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
                pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                ["bucket", "block", "entries", "docs"])

        for batch in words.pieces(batches):
            tokens, lengths = _tokens(batch)
            row = np.repeat(np.arange(len(lengths)), lengths)
            begin = np.cumsum(lengths) - lengths
            at = np.minimum(np.searchsorted(often, tokens), max(len(often) - 1, 0))
            found = often[at] == tokens if len(often) else np.zeros(len(tokens), bool)
            table = _table(batch, lengths)
            table["known"] = np.add.reduceat(found.astype(np.int64), begin)
            exact = np.log10((often_counts[at] + ADDED) / norm) if len(often) else np.zeros(len(tokens))
            table["sum"] = np.add.reduceat(np.where(found, exact, 0.0), begin)
            one = filter_.counts(tokens, 1)
            two = filter_.counts(_pairs(tokens), 2) * (1 - filter_.false_rate)
            table["score"] = _scores(one, two, begin, lengths, norm)
            docs.append(table)
            rest.append((tokens[~found], row[~found] + rows_before))
            size, rows_before = size + len(tokens), rows_before + len(lengths)
            if size >= BLOCK:
                number += 1
                yield emit(number)
                docs, rest, size, rows_before = [], [], 0, 0
        if docs:
            yield emit(number + 1)
    return run


def _lookup(group: pd.DataFrame) -> pd.DataFrame:
    """In a bucket, the exact counts of the tokens that each block has sent."""
    exact = [x for x, b in zip(group["entries"], group["block"]) if b < 0]
    grams, counts = _unpack(exact[0]) if exact else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows = []
    for block, entries, docs in zip(group["block"], group["entries"], group["docs"]):
        if block < 0:
            continue
        n = len(entries) // 12
        hashes, row = np.frombuffer(entries, "<u8", n), np.frombuffer(entries, "<u4", n, 8 * n)
        found = np.zeros(n, np.int64)
        if n and len(grams):
            at = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
            found = np.where(grams[at] == hashes, counts[at], 0)
        rows.append((block, _count_bytes(found) + row.tobytes(), docs))
    return pd.DataFrame(rows, columns=["block", "found", "docs"])


_RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")


def _result(table: np.ndarray, total: int) -> pd.DataFrame:
    return pd.DataFrame({
        "doc_id": pd.array(table["doc"], "Int64"), "held_out": table["held_out"], "n_tokens": table["tokens"],
        "n_known": table["known"], "train_tokens": np.int64(total), "base_score": table["sum"],
        "score": table["score"]}).assign(doc_id=lambda d: d["doc_id"].mask(table["no_id"]))


def _finish(total: int, distinct: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        (docs,) = (x for x in group["docs"] if x is not None)
        table = np.frombuffer(docs, _DOC).copy()
        norm = total + ADDED * (distinct + 1)
        for blob in group["found"]:
            counts, end = _counts(blob)
            row = np.frombuffer(blob, "<u4", len(counts), end)
            table["sum"] += np.bincount(row, np.log10((counts + ADDED) / norm), len(table))
            table["known"] += np.bincount(row, counts > 0, len(table)).astype(np.int64)
        return _result(table, total)
    return run


def _tokenized(batches):
    """Blocks of tokens: distinct words, which of them each token is, and the documents."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    docs: list[np.ndarray] = []
    held: list[np.ndarray] = []
    size = 0

    def emit(block):
        tokens, table = np.concatenate(held), np.concatenate(docs)
        grams, place = np.unique(tokens, return_inverse=True)
        own = b"".join((np.array([len(grams), len(place)], "<u8").tobytes(), _steps(grams),
                        _planes(place.astype("<u4")), table.tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([len(place)], pa.int64()), pa.array([_squeezed(own)], pa.binary())],
            ["block", "tokens", "own"])

    for batch in words.pieces(batches):
        tokens, lengths = _tokens(batch)
        held.append(tokens)
        docs.append(_table(batch, lengths))
        size += len(tokens)
        if size >= BLOCK:
            number += 1
            yield emit(number)
            docs, held, size = [], [], 0
    if docs:
        yield emit(number + 1)


def _opened(own: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, which of them each token is, and the documents."""
    data = _whole(own)
    n, size = np.frombuffer(data, "<u8", 2).tolist()
    grams, at = _from_steps(data, n, 16)
    place, at = _from_planes(data, "<u4", size, at)
    return grams, place, np.frombuffer(data, _DOC, -1, at).copy()


def _packed(*parts: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Sorted sequences with counts, which a block's size bounds, of one and of two words."""
    return _squeezed(b"".join(x for grams, counts in parts for x in (
        len(grams).to_bytes(8, "little"), _steps(grams), _planes(counts.astype("<u4")))))


def _unpacked(blob: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    data, at, parts = _whole(blob), 0, []
    for _ in (1, 2):
        n = int.from_bytes(data[at:at + 8], "little")
        grams, at = _from_steps(data, n, at + 8)
        counts, at = _from_planes(data, "<u4", n, at)
        parts.append((grams, counts.astype(np.int64)))
    return parts


def _ask(buckets: int):
    """Distinct words and pairs of each block for the buckets, with counts in the texts to learn from."""
    def run(batches):
        for batch in batches:
            for block, own in zip(batch.column("block").to_pylist(), batch.column("own")):
                grams, place, table = _opened(own.as_py())
                learn = np.repeat(~table["held_out"], table["tokens"])
                counts = np.bincount(place[learn], minlength=len(grams))
                # a pair's 48 bits and whether it may be learned from
                pairs = np.sort(_pairs(grams[place]) << np.uint64(1) | learn.astype(np.uint64))
                head = np.flatnonzero(np.concatenate([[True], np.diff(pairs >> np.uint64(1)) > 0]))
                pair_counts = np.add.reduceat(pairs & np.uint64(1), head)
                pairs = pairs[head] >> np.uint64(1)
                one, two = (np.searchsorted(_bucket(x, n, buckets), np.arange(buckets + 1))  # grows with the hash
                            for n, x in ((1, grams), (2, pairs)))
                rows = [(b, _packed((grams[i:j], counts[i:j]), (pairs[k:m], pair_counts[k:m])))
                        for b, (i, j, k, m) in enumerate(zip(one, one[1:], two, two[1:])) if i < j or k < m]
                bucket, asked = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), pa.array([block] * len(rows), pa.int64()),
                     pa.array(asked, pa.binary())], ["bucket", "block", "asked"])
    return run


def _pairs_sent(blob: bytes) -> np.ndarray:
    """48-bit hashes: all low parts, then all high ones."""
    n = len(blob) // 6
    return np.frombuffer(blob, "<u4", n) | np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _answer(buckets: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """In a bucket, exact counts and levels of the words and levels of the pairs that each block has sent."""
        own = int(group["bucket"].iloc[0])
        model = group[group["block"] < 0]  # block -n has the segment of n words
        filter_ = Filter([{"n": -int(k), "bucket": own, "segment": x, "bits": int(bits), "filled": 0}
                          for k, x, bits in zip(model["block"], model["pairs"], model["bits"])], buckets)
        exact = [x for x, k in zip(model["words"], model["block"]) if k == -1]
        grams, counts = _unpack(exact[0]) if exact else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        asked = group[group["block"] >= 0]
        one = [np.frombuffer(x, "<u8") for x in asked["words"]]
        two = [_pairs_sent(x) for x in asked["pairs"]]
        hashes, pairs = (np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (one, two))  # all blocks at once
        found = np.zeros(len(hashes), np.int64)
        if len(grams):
            at = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
            found = np.where(grams[at] == hashes, counts[at], 0)
        level, levels = (filter_.levels(x, n).astype("u1") for n, x in ((1, hashes), (2, pairs)))
        rows, i, j = [], 0, 0
        for block, a, b in zip(asked["block"], one, two):
            k, m = i + len(a), j + len(b)
            rows.append((own, block, _count_bytes(found[i:k]) + level[i:k].tobytes(), levels[j:m].tobytes()))
            i, j = k, m
        return pd.DataFrame(rows, columns=["bucket", "block", "words", "pairs"])
    return run


def _learn_and_answer(buckets: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """A bucket's part of the model, its answers to all blocks, and a row with its sums."""
        own = int(group["bucket"].iloc[0])
        asked = [_unpacked(x) for x in group["asked"]]
        rows, sums = [], {"total": 0, "distinct": 0, "bits": 0, "filled": 0}
        for n in (1, 2):
            grams, counts = (np.concatenate(x) for x in zip(*(parts[n - 1] for parts in asked)))
            seen = counts > 0
            if not seen.any():
                continue
            made = _built(n, own, *_summed(grams[seen], counts[seen]))
            rows.append((own, -n, made["exact"], made["segment"], made["bits"]))
            sums |= {k: made[k] for k in (("total", "distinct") if n == 1 else ("bits", "filled"))}
        for block, ((one, _), (two, _)) in zip(group["block"], asked):
            high = (two >> np.uint64(32)).astype("<u2")
            rows.append((own, block, one.tobytes(), two.astype("<u4").tobytes() + high.tobytes(), 0))
        out = _answer(buckets)(pd.DataFrame(rows, columns=["bucket", "block", "words", "pairs", "bits"]))
        out = out.assign(words=out["words"].map(_squeezed), pairs=out["pairs"].map(_squeezed), **dict.fromkeys(sums, 0))
        return pd.concat([out, pd.DataFrame([{"bucket": own, "block": -1, "words": None, "pairs": None, **sums}])])
    return run


def _finish_asked(total: int, distinct: int, false_rate: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        (own,) = (x for x in group["own"] if x is not None)
        grams, place, table = _opened(own)
        group = group[group["own"].isna()].sort_values("bucket")  # so the answers are in the order of the hashes
        exact = [(x, *_counts(x)) for x in group["words"].map(_whole)]
        counts = np.concatenate([counts for _, counts, _ in exact])
        level = np.concatenate([np.frombuffer(x, "u1", -1, end) for x, _, end in exact])
        levels = np.concatenate([np.frombuffer(_whole(x), "u1") for x in group["pairs"]])
        _, pair = np.unique(_pairs(grams[place]), return_inverse=True)
        norm, lengths = total + ADDED * (distinct + 1), table["tokens"]
        begin = np.cumsum(lengths) - lengths
        table["known"] = np.add.reduceat((counts > 0)[place].astype(np.int64), begin)
        table["sum"] = np.add.reduceat(np.log10((counts + ADDED) / norm)[place], begin)
        two = _middle(levels)[pair] * (1 - false_rate)
        table["score"] = _scores(_middle(level)[place], two, begin, lengths, norm)
        return _result(table, total)
    return run


def _held_out(docs: DataFrame) -> DataFrame:
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       (F.crc32(number.cast("binary")) % 10 == 0).alias("held_out"))


def score_texts(docs: DataFrame, filter_bytes: int = 0, frequent: int = FREQUENT) -> DataFrame:
    """Score whole texts by a model learned from the documents that are not held out.

    Returns one row per input row: doc_id, held_out, n_tokens (words and one end), n_known, train_tokens,
    base_score (sum of add-0.1 one-word log10 probabilities, from exact counts) and score (log10
    probability of the text under the two-word model read from the filter). A null text counts as
    empty: its only token is the end. A null doc_id counts as the empty string, so it is held out.
    Repeated rows are learned from as often as they occur. With nothing to learn from, counts are 0.
    Other columns are left out. Words are told apart by 64-bit hashes, pairs by 48 bits.
    A filter of ``filter_bytes`` at most is sent to all workers, together with ``frequent`` exact counts.
    """
    texts = _held_out(docs)
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = _score_by_sent_filter(texts, buckets, filter_bytes, frequent) if filter_bytes else None
    if scored is not None:
        return scored
    blocks = words.stored(texts.mapInArrow(_tokenized, _BLOCKS), "lm-blocks", maxRecordsPerFile=FILE)
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(buckets, tokens // BUCKET)
    answers = words.stored(
        blocks.select("block", "own").mapInArrow(_ask(buckets), _ASKED)
        .groupBy("bucket").applyInPandas(_learn_and_answer(buckets), _ANSWERS), "lm-answers")
    sums = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "distinct", "bits", "filled"))).first()
    false_rate = (sums["filled"] / sums["bits"]) ** PROBES if sums["bits"] else 0.0
    return (answers.where("block >= 0").select("block", "bucket", "words", "pairs")
            .unionByName(blocks.select("block", "own"), allowMissingColumns=True)
            .groupBy("block").applyInPandas(_finish_asked(sums["total"], sums["distinct"], false_rate), _RESULT))


def _score_by_sent_filter(texts: DataFrame, buckets: int, filter_bytes: int, frequent: int) -> DataFrame | None:
    """Scores by a filter that all workers hold; none if it is larger than ``filter_bytes``."""
    spark = texts.sparkSession
    learned = words.stored(
        texts.where("NOT held_out").select("text").mapInArrow(_count(buckets), _COUNTS)
        .groupBy("n", "bucket").applyInPandas(
            _segment(),
            "n int, bucket int, distinct long, total long, bits long, filled long, segment binary, exact binary"), "lm")
    sums = learned.where("n = 1").agg(F.sum("total").alias("t"), F.sum("distinct").alias("d")).first()
    total, distinct = int(sums["t"] or 0), int(sums["d"] or 0)
    size = learned.agg(F.sum(F.length("segment"))).first()[0] or 0
    if size > filter_bytes:
        return None
    segments = learned.select("n", "bucket", "bits", "filled", "segment").collect()  # filter_bytes at most
    model = spark.sparkContext.broadcast(Filter(segments, buckets))

    def often(batches):
        for batch in batches:
            for blob in batch.column("exact").to_pylist():
                grams, counts = _unpack(blob)
                chosen = counts * frequent >= total  # so many words at most
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[chosen].view(np.int64)), pa.array(counts[chosen])], ["gram", "c"])

    top = learned.where("n = 1").select("exact").mapInArrow(often, "gram long, c long").toPandas()
    grams, order = np.unique(top["gram"].to_numpy(np.int64).view(np.uint64), return_index=True)
    known = spark.sparkContext.broadcast((grams, top["c"].to_numpy(np.int64)[order]))
    sent = texts.mapInArrow(_score(model, known, total, distinct, buckets), _TOKENS)
    exact = learned.where("n = 1").select(
        "bucket", F.lit(-1).cast("long").alias("block"), F.col("exact").alias("entries"),
        F.lit(None).cast("binary").alias("docs"))
    return (sent.unionByName(exact).groupBy("bucket").applyInPandas(_lookup, "block long, found binary, docs binary")
            .groupBy("block").applyInPandas(_finish(total, distinct), _RESULT))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
