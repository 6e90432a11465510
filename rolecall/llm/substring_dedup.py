"""Substring dedup by relative Lempel-Ziv parsing against an index of all texts.

Every block of texts is a reference block. Its windows of ``window`` words are indexed by hash over
buckets, where the first place of each window is found. A text is then parsed greedily: a factor
begins at a window that starts earlier elsewhere and goes on as long as the next window does; where it
stops, the boundary is the last word of the last such window. Factors of ``window`` words and more
are the duplicate spans.

Only distinct windows of a block are shuffled (7 bytes and a place each), so a passage that a third of
all texts share sends one entry per block. The texts are shuffled once, to meet their spans.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm import words

WINDOW = 20
#: Windows of one reference block: bounds the memory of a task.
BLOCK = 1 << 20

_ENTRY = np.dtype([("hash", "<u8"), ("window", "<u4")])
_DOC = np.dtype([("doc", "<i8"), ("text", "<i8"), ("windows", "<u4")])
_INDEX = "bucket int, block long, entries binary, docs binary"


def _blocks(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts gathered to blocks: (documents by id, hashes of their windows in that order)."""
    docs, hashes, held = [], [], 0

    def block():
        table, parts = np.concatenate(docs), [x for group in hashes for x in group]
        order = np.lexsort((table["text"], table["doc"]))
        ordered = table[order]
        same = (ordered["doc"][1:] == ordered["doc"][:-1]) & (ordered["text"][1:] == ordered["text"][:-1])
        order = order[np.append(True, ~same)]  # rows equal in id and text are one place
        return table[order], np.concatenate([parts[i] for i in order])

    for batch in words.pieces(batches):
        data, ends = words.flat(batch.column("text"))
        starts, stops, before = words.spans(data, ends)
        every = words.sequence_hashes(words.word_hashes(data, starts, stops), window)
        table = np.zeros(batch.num_rows, _DOC)
        table["doc"] = batch.column("doc_id").to_numpy(zero_copy_only=False)
        table["text"] = batch.column("text_hash").to_numpy(zero_copy_only=False)
        table["windows"] = np.maximum(np.diff(before) - window + 1, 0)
        docs.append(table)
        hashes.append([every[a:a + n] for a, n in zip(before[:-1], table["windows"])])
        held += int(table["windows"].sum())
        if held >= BLOCK:
            yield block()
            docs, hashes, held = [], [], 0
    if docs:
        yield block()


def _repeats(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the window also starts at an earlier place of the block: document and word, whatever the row."""
    begins = np.cumsum(docs["windows"], dtype=np.int64) - docs["windows"]
    place = np.arange(len(hashes)) - np.repeat(begins, docs["windows"])
    doc = np.repeat(docs["doc"], docs["windows"])
    order = np.lexsort((place, doc, hashes))
    h, d, p = hashes[order], doc[order], place[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    begin = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    out = np.zeros(len(h), bool)
    out[order] = (d != d[begin]) | (p != p[begin])
    return out


def _index(window: int, buckets: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for docs, hashes in _blocks(batches, window):
            number += 1
            repeats = _repeats(docs, hashes)
            first = np.flatnonzero(~repeats)
            entries = np.zeros(len(first), _ENTRY)
            entries["hash"], entries["window"] = hashes[first], first
            bucket = ((entries["hash"] >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            entries, cuts = entries[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, entries[cuts[b]:cuts[b + 1]], None) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            # repeats inside the block are known already and travel with its documents
            rows.append((number % buckets, entries[:0], np.array([len(docs)], "<u4").tobytes()
                         + docs.tobytes() + np.packbits(repeats).tobytes()))
            yield pa.RecordBatch.from_arrays([
                pa.array([b for b, _, _ in rows], pa.int32()),
                pa.array([number] * len(rows), pa.int64()),
                pa.array([_packed(e, docs) for _, e, _ in rows], pa.binary()),
                pa.array([d for _, _, d in rows], pa.binary())], ["bucket", "block", "entries", "docs"])
    return run


def _packed(entries: np.ndarray, docs: np.ndarray) -> bytes:
    """Hashes, steps from window to window, and id and first window of the documents.

    The bucket says what the highest byte of a hash is, so seven are kept; a step takes one byte, or
    four more if it is large.
    """
    stops = np.cumsum(docs["windows"], dtype=np.int64)
    used = np.unique(np.searchsorted(stops, entries["window"], "right"))
    steps = np.diff(entries["window"].astype(np.int64), prepend=0)
    large = steps[steps >= 0xFF].astype("<u4")
    ids, begins = docs["doc"][used], stops[used] - docs["windows"][used]
    id_steps, begin_steps = _narrow(np.diff(ids.view(np.uint64))), _narrow(np.diff(begins, prepend=0))
    head = np.array([len(entries), len(large), len(used), id_steps.itemsize, begin_steps.itemsize], "<u4")
    hashes = entries["hash"]
    return b"".join((
        head.tobytes(), hashes.astype("<u4").tobytes(), (hashes >> np.uint64(32)).astype("<u2").tobytes(),
        (hashes >> np.uint64(48)).astype("u1").tobytes(), np.minimum(steps, 0xFF).astype("u1").tobytes(),
        large.tobytes(), ids[:1].tobytes(), id_steps.tobytes(), begin_steps.tobytes()))


def _narrow(steps: np.ndarray) -> np.ndarray:
    """Steps upwards in the narrowest type that holds them."""
    return steps.astype(np.min_scalar_type(int(steps.max(initial=0))).newbyteorder("<"))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, window number in the block, document id and place in the document of each entry."""
    n, n_large, n_docs, id_size, begin_size = np.frombuffer(blob, "<u4", 5).tolist()
    at = 20
    parts = []
    for kind, count in (("<u4", n), ("<u2", n), ("u1", n), ("u1", n), ("<u4", n_large), ("<i8", min(n_docs, 1)),
                        (f"<u{id_size}", max(n_docs - 1, 0)), (f"<u{begin_size}", n_docs)):
        parts.append(np.frombuffer(blob, kind, count, at))
        at += parts[-1].nbytes
    low, middle, high, small, large, first, id_steps, begin_steps = parts
    # ids may lie anywhere in 64 bits, so their steps are added as they wrap
    ids = np.cumsum(np.concatenate([first.view("<u8"), id_steps.astype("<u8")]), dtype=np.uint64).view(np.int64)
    begins = np.cumsum(begin_steps, dtype=np.int64)
    hashes = (low.astype(np.uint64) | middle.astype(np.uint64) << np.uint64(32)
              | high.astype(np.uint64) << np.uint64(48))
    steps = small.astype(np.int64)
    steps[steps == 0xFF] = large
    window = np.cumsum(steps)
    doc = np.searchsorted(begins, window, "right") - 1
    return hashes, window, ids[doc] if n else ids[:0], window - begins[doc] if n else window


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """In a bucket, the windows of each block that also start at an earlier place."""
    blobs = [_unpacked(x) for x in group["entries"]]
    blocks = group["block"].to_numpy()
    sizes = [len(x[0]) for x in blobs]
    hashes = np.concatenate([x[0] for x in blobs])
    block = np.repeat(np.arange(len(blobs)), sizes)
    sort = np.sort(hashes)
    often = np.unique(sort[1:][sort[1:] == sort[:-1]])
    found = np.searchsorted(often, hashes)
    again = np.flatnonzero((found < len(often)) & (often[np.minimum(found, max(len(often) - 1, 0))] == hashes)
                           ) if len(often) else np.zeros(0, np.int64)
    window, doc, place = (np.concatenate([x[i] for x in blobs])[again] for i in (1, 2, 3))
    order = np.lexsort((place, doc, hashes[again]))
    h, d, p = hashes[again][order], doc[order], place[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    begin = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    later = (d != d[begin]) | (p != p[begin])  # the same place of a repeated row is not earlier
    hit = order[later]
    rows = []
    for i, docs in enumerate(group["docs"]):
        mine = np.sort(window[hit[block[again][hit] == i]]).astype("<u4") if sizes[i] else np.zeros(0, "<u4")
        if len(mine) or docs is not None:
            rows.append((blocks[i], mine.tobytes(), docs))
    return pd.DataFrame(rows, columns=["block", "later", "docs"])


def _spans(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The factors of each text of a block: first word and number of words."""
        (docs,) = (x for x in group["docs"] if x is not None)
        count = int(np.frombuffer(docs, "<u4", 1)[0])
        table = np.frombuffer(docs, _DOC, count, 4)
        repeats = np.frombuffer(docs, np.uint8, -1, 4 + count * _DOC.itemsize)
        later = np.unpackbits(repeats, count=int(table["windows"].sum())).astype(bool)
        later[np.concatenate([np.frombuffer(x, "<u4") for x in group["later"]])] = True
        row = np.repeat(np.arange(count), table["windows"])
        stops = np.cumsum(table["windows"], dtype=np.int64)
        at = np.flatnonzero(later)
        place = at - (stops[row[at]] - table["windows"][row[at]])
        if not len(at):
            return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "text_hash": np.zeros(0, np.int64),
                                 "starts": np.zeros(0, object), "lengths": np.zeros(0, object)})
        # a factor goes on while windows overlap or touch
        new = np.ones(len(at), bool)
        new[1:] = (row[at][1:] != row[at][:-1]) | (place[1:] - place[:-1] > window)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        out = pd.DataFrame({"row": row[at][begin], "start": place[begin],
                            "length": place[end] - place[begin] + window})
        lists = out.groupby("row").agg(start=("start", list), length=("length", list))
        chosen = table[lists.index.to_numpy(np.int64)]
        return pd.DataFrame({"doc_id": chosen["doc"], "text_hash": chosen["text"],
                             "starts": lists["start"].to_numpy(), "lengths": lists["length"].to_numpy()})
    return run


def _cut(batches):
    for batch in words.pieces(batches):
        data, ends = words.flat(batch.column("text"))
        starts, stops, before = words.spans(data, ends)
        raw = data.tobytes()
        kept, counts, removed = [], np.diff(before), []
        for i, (a, n, begins, lengths) in enumerate(zip(
                before, counts, batch.column("starts").to_pylist(), batch.column("lengths").to_pylist())):
            if begins:
                keep = np.ones(n, bool)
                for s, k in zip(begins, lengths):
                    keep[s:s + k] = False
                at = a + np.flatnonzero(keep)
                kept.append(b" ".join([raw[x:y] for x, y in zip(starts[at].tolist(), stops[at].tolist())]).decode())
                removed.append(int(n - len(at)))
            else:
                kept.append(b" ".join(raw[ends[i]:ends[i + 1]].split()).decode())
                removed.append(0)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(counts, pa.int64()),
            pa.array(removed, pa.int64()), batch.column("starts"), batch.column("lengths")],
            ["doc_id", "kept_text", "n_words", "n_removed", "span_starts", "span_lengths"])


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Cut every word covered by a window of words that also starts earlier.

    Returns one row per input row: doc_id, kept_text (kept words joined by one space), n_words,
    n_removed, span_starts and span_lengths (the factors, in words). Earlier is a smaller doc_id, or
    the same document and an earlier start. Null and empty texts have no words and give an empty
    text. Rows that are equal in id and text are one place and do not remove each other. A row
    without doc_id has no place in the order: it is neither cut nor a source. Other columns are left
    out. Windows are told apart by hashes of 62 bits and more.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                        F.xxhash64("text").alias("text_hash"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (texts.where("doc_id IS NOT NULL").mapInArrow(_index(window, buckets), _INDEX)
             .groupBy("bucket").applyInPandas(_meet, "block long, later binary, docs binary")
             .groupBy("block").applyInPandas(
                 _spans(window), "doc_id long, text_hash long, starts array<long>, lengths array<long>")
             .dropDuplicates(["doc_id", "text_hash"]))
    return (texts.join(found, ["doc_id", "text_hash"], "left")
            .select("doc_id", "text", "starts", "lengths")
            .mapInArrow(_cut, "doc_id long, kept_text string, n_words long, n_removed long, "
                              "span_starts array<long>, span_lengths array<long>"))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
