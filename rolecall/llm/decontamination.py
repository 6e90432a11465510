"""Benchmark decontamination by latent semantic retrieval.

Items are cut into passages, and term weights come from the document frequencies of the items' words over
all documents. A randomised SVD of the TF-IDF passages, with its products summed in Spark, gives a
latent space of the terms. Windows of every document that hold enough of the items' weight are put into
that space, and passages of high cosine are candidates. A longest common subsequence of words then says
how much of a passage, and of its item, a candidate's surroundings hold in order, and whether the
item's answer is there.

The items are a stated query set, worked on in blocks of bounded size; each block's tables go to the workers.
Documents are read once for the frequencies and once for the search, and are never shuffled.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm import words

#: Words of a passage of an item, and of the step to the next.
PASSAGE, PASSAGE_STEP = 16, 8
#: Words of a document's window, and of the step: any passage lies in one whole window.
WINDOW, STEP = 24, 8
#: Dimensions of the latent space, surplus ones while it is made, and rounds of power iteration.
RANK, SURPLUS, ROUNDS = 192, 16, 1
#: Cosine from which a window and a passage are candidates.
COSINE = 0.5
#: Share of a passage's squared weight that a window must hold before it is compared with it, share of
#: the passage's latent vector that it must contain, and share of the passage's words.
MASS, CONTAINED, SHARED = 0.5, 0.5, 0.5
#: Common subsequence, as a share of a passage, of an item, and of an item whose answer is found.
PASSAGE_SHARE, ITEM_SHARE, ANSWERED_SHARE, ANSWER_SHARE = 0.8, 0.6, 0.5, 0.8
#: Terms of which products are summed together.
TERMS = 512
#: Words of all items of a block, and of those that a task of the SVD takes.
BLOCK_WORDS, TASK_WORDS = 200_000, 25_000

#: Letters and digits stay, ASCII punctuation separates words like white space.
_WORDS = np.arange(256, dtype=np.uint8)
_WORDS[[i for i in range(128) if not chr(i).isalnum()]] = 32


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-case texts, and how many there are before each text."""
    data, ends = words.flat(column)
    data = _WORDS[data]
    starts, stops, before = words.spans(data, ends)
    return words.word_hashes(data, starts, stops), before


class Block:
    """Items of a block: their words, passages and answers."""

    def __init__(self, items: pd.DataFrame):
        hashes, before = _hashed(pa.array(items["text"], pa.string()))
        answers, answers_before = _hashed(pa.array(items["answer"], pa.string()))
        self.ids = items["item_id"].tolist()
        self.items = [hashes[a:b] for a, b in zip(before, before[1:])]
        self.answers = [answers[a:b] for a, b in zip(answers_before, answers_before[1:])]
        self.vocabulary = np.unique(hashes)
        self.passages: list[np.ndarray] = []
        self.owner: list[int] = []
        for i, item in enumerate(self.items):
            starts = [*range(0, max(len(item) - PASSAGE, 0), PASSAGE_STEP), max(len(item) - PASSAGE, 0)]
            for s in starts if len(item) else []:
                self.passages.append(item[s:s + PASSAGE])
                self.owner.append(i)

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words in the vocabulary; its size for any other."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))


def _frequencies(own):
    """Document frequencies of a block's terms, folded in each task."""
    def run(batches):
        size = len(own.vocabulary)
        found, total = np.zeros(size, np.int64), 0
        for batch in words.pieces(batches):
            hashes, before = _hashed(batch.column("text"))
            term = own.terms(hashes)
            row = np.repeat(np.arange(batch.num_rows), np.diff(before))
            known = term < size
            pairs = np.unique(row[known] * size + term[known])
            found += np.bincount(pairs % size, minlength=size)
            total += batch.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*at, -1], pa.int64()), pa.array([*found[at], total], pa.int64())], ["term", "n"])
    return run


def _weights(frequency: np.ndarray, total: int) -> np.ndarray:
    """Inverse document frequencies; words outside the items have none, as they match nothing."""
    weight = np.log((total + 1.0) / (frequency + 0.5)).clip(0.05)
    weight[-1] = 0
    return weight.astype(np.float32)


def _windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and stop of the windows of all texts.

    A window starts at every ``STEP`` words while a passage's words are left, once at least.
    """
    n = np.diff(before)
    count = np.where(n > 0, np.maximum(0, -(-(n - PASSAGE) // STEP)) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    start = before[row] + STEP * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    return start, np.minimum(start + WINDOW, before[row + 1])


def _start(size: int, width: int) -> np.ndarray:
    """The random start of the SVD, the same in every task."""
    basis = np.random.default_rng(7).standard_normal((size + 1, width)).astype(np.float32)
    basis[size] = 0
    return basis


def _products(own, weight, width, right):
    """A block of rows' share of A' A times ``right``, where A has the TF-IDF rows of windows."""
    def run(batches):
        basis = right.value.astype(np.float32) if right else _start(len(own.vocabulary), width)
        size = len(own.vocabulary)
        total = np.zeros((size + 1, basis.shape[1]))
        for batch in words.pieces(batches):
            hashes, before = _hashed(batch.column("text"))
            term = own.terms(hashes)
            start, stop = _windows(before)
            for at in range(0, len(start), 4096):
                s, e = start[at:at + 4096], stop[at:at + 4096]
                place = s[:, None] + np.arange(WINDOW)
                index = np.where(place < e[:, None], term[np.minimum(place, len(term) - 1)], size)
                rows = (basis[index] * weight[index][:, :, None]).sum(1)
                np.add.at(total, index.ravel(), (rows[:, None, :] * weight[index][:, :, None]).reshape(-1, basis.shape[1]))
        parts = [(at // TERMS, total[at:at + TERMS].tobytes()) for at in range(0, size, TERMS)
                 if total[at:at + TERMS].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], ["part", "rows"])
    return run


def _added(group: pd.DataFrame) -> pd.DataFrame:
    """The sum of what tasks send for some terms."""
    total = np.frombuffer(group["rows"].iloc[0]).copy()
    for rows in group["rows"].iloc[1:]:
        total += np.frombuffer(rows)
    return pd.DataFrame({"part": group["part"].iloc[:1], "rows": [total.tobytes()]})


def latent_terms(rows: DataFrame, block, idf, size: int) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF matrix of ``rows``, by terms.

    ``rows`` are the items' texts. A random start is multiplied by A'A, made orthonormal, and so on. Tasks fold their rows' products;
    sums over tasks are grouped by range of terms. What comes to the driver has the size of the block's vocabulary.
    """
    spark = rows.sparkSession
    width = min(RANK + SURPLUS, size)
    right = None
    for left in range(ROUNDS, -1, -1):
        sums = (rows.mapInArrow(_products(block, idf, width, right), "part long, rows binary")
                .groupBy("part").applyInPandas(_added, "part long, rows binary").collect())
        basis = np.zeros((size + 1, width))
        for part, found in sums:
            found = np.frombuffer(found).reshape(-1, width)
            basis[part * TERMS:part * TERMS + len(found)] = found
        basis[size] = 0
        basis[:size] = np.linalg.qr(basis[:size])[0]
        basis = basis.astype(np.float16)  # what goes to the workers need not be more exact
        right = spark.sparkContext.broadcast(basis) if left else None
    return np.ascontiguousarray(basis[:, :RANK])


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := masks.get(x):
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


class Passages:
    """Passages in the latent space, from light to heavy."""

    def __init__(self, block: Block, weight: np.ndarray, space: np.ndarray):
        self.block, self.size = block, len(block.vocabulary)
        self.space = space * weight[:, None]
        self.squares = (weight ** 2).astype(np.float64)
        terms = [block.terms(p) for p in block.passages]
        mass = np.array([self.squares[t].sum() for t in terms])
        self.order = np.argsort(mass, kind="stable")
        self.needs = MASS * mass[self.order]
        latent = np.stack([self.space[terms[i]].sum(0) for i in self.order])
        self.norm = np.linalg.norm(latent, axis=1)
        self.latent = np.ascontiguousarray(latent.T)
        self.terms = np.full((len(terms), PASSAGE), -1)
        for k, i in enumerate(self.order):
            self.terms[k, :len(terms[i])] = terms[i]
        self.length = (self.terms >= 0).sum(1)

    def _sums(self, term: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Latent vectors of windows; steps of words are added up once and shared by their windows."""
        parts = WINDOW // STEP
        begins = (start[:, None] + STEP * np.arange(parts)).ravel()
        limit = np.repeat(stop, parts)
        begins = np.where(begins < limit, begins, -1)  # beyond the text
        begins, index, where = np.unique(begins, return_index=True, return_inverse=True)
        ends = np.where(begins < 0, -1, np.minimum(begins + STEP, limit[index]))
        total = np.zeros((len(begins), self.space.shape[1]), np.float32)
        for j in range(STEP):
            place = begins + j
            total += self.space[np.where(place < ends, term[np.minimum(place, len(term) - 1)], self.size)]
        where = where.reshape(-1, parts)
        out = total[where[:, 0]]
        for j in range(1, parts):
            out += total[where[:, j]]
        return out

    def candidates(self, term: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple]:
        """First word, stop, passage number and cosine of the windows that may hold a passage."""
        held = np.concatenate([[0.0], np.cumsum(self.squares[term])])
        held = held[stop] - held[start]
        keep = held >= self.needs[0]
        start, stop, held = start[keep], stop[keep], held[keep]
        for at in range(0, len(start), 2048):
            s, e, h = (x[at:at + 2048] for x in (start, stop, held))
            windows = self._sums(term, s, e)
            order = np.argsort(h)
            for some in np.array_split(order, 8):  # lighter windows meet fewer passages
                if not len(some):
                    continue
                count = int(np.searchsorted(self.needs, h[some[-1]], "right"))
                dot = windows[some] @ self.latent[:, :count]
                size = np.linalg.norm(windows[some], axis=1)[:, None]
                norm = self.norm[:count]
                w, p = np.nonzero((dot >= CONTAINED * norm ** 2) & (dot >= COSINE * norm * size))
                cosine = dot[w, p] / np.maximum(norm[p] * size[w, 0], 1e-9)
                w = some[w]
                for k in range(0, len(w), 1 << 14):
                    a, b, q = s[w[k:k + (1 << 14)]], e[w[k:k + (1 << 14)]], p[k:k + (1 << 14)]
                    place = a[:, None] + np.arange(WINDOW)
                    words_ = np.where(place < b[:, None], term[np.minimum(place, len(term) - 1)], self.size)
                    shared = (self.terms[q][:, :, None] == words_[:, None, :]).any(2).sum(1)
                    good = shared >= SHARED * self.length[q]
                    yield from zip(a[good].tolist(), b[good].tolist(), self.order[q[good]].tolist(),
                                   cosine[k:k + (1 << 14)][good].tolist())


def _search(own, weight, latent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(own, weight, latent.value.astype(np.float32))
        for batch in words.pieces(batches):
            hashes, before = _hashed(batch.column("text"))
            best: dict[tuple[int, int], tuple] = {}
            for a, b, p, cosine in passages.candidates(own.terms(hashes), *_windows(before)):
                row = int(np.searchsorted(before, a, "right")) - 1
                low, high = int(before[row]), int(before[row + 1])
                passage, i = own.passages[p], own.owner[p]
                share = _lcs(passage, hashes[max(a - STEP, low):min(b + STEP, high)]) / len(passage)
                if share < ANSWERED_SHARE:
                    continue
                item, answer = own.items[i], own.answers[i]
                around = hashes[max(a - len(item), low):min(b + len(item), high)]
                item_share = _lcs(item, around) / len(item)
                answered = len(answer) > 0 and _lcs(answer, around) >= ANSWER_SHARE * len(answer)
                known = best.get((row, i), (0.0, 0.0, False, a - low, 0.0))
                best[row, i] = (max(share, known[0]), max(item_share, known[1]), answered or known[2],
                                min(a - low, known[3]), max(cosine, known[4]))
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[r], own.ids[i], *v) for (r, i), v in sorted(best.items())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.float64()))],
                ["doc_id", "item_id", "passage_share", "item_share", "answer_found", "first_word", "cosine"])
    return run


_MATCH = "doc_id long, item_id long, passage_share double, item_share double, answer_found boolean, first_word long, cosine double"


def _blocks(benchmark: DataFrame) -> Iterator[pd.DataFrame]:
    """The items, a block of bounded size at a time."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    last = F.regexp_extract(text, "(?s)([^\\n.!?]*[^\\s.!?][^\\n.!?]*)[\\s.!?]*$", 1)
    answer = F.lower(F.coalesce(F.col("answer").cast("string"), last)) if "answer" in benchmark.columns else last
    items = benchmark.select(F.col("item_id").cast("long"), text.alias("text"), answer.alias("answer"))
    held, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():  # one partition at a time
        held.append(row.asDict())
        size += len(row["text"].split())
        if size >= BLOCK_WORDS:
            yield pd.DataFrame(held)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item of which the document may hold a passage.

    Columns: doc_id, item_id, passage_share (of its best passage, in order), item_share, answer_found,
    first_word, cosine and contaminated: a passage nearly whole, or most of the item, or half of it with the
    answer. The answer is column ``answer`` of the benchmark where there is one, else the item's last
    sentence. Case and ASCII punctuation do not count. Null or empty texts and items match nothing;
    repeated documents and items give rows of their own; a null doc_id gives rows with a null doc_id. Other
    columns are left out.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"))
    # every item, however many blocks there are
    out = spark.createDataFrame([], _MATCH)
    for number, items in enumerate(_blocks(benchmark)):
        block = Block(items)
        size = len(block.vocabulary)
        if not size:
            continue
        counts = texts.select("text").mapInArrow(_frequencies(block), "term long, n long").groupBy("term").agg(
            F.sum("n").alias("n")).toPandas()
        total = int(counts.loc[counts["term"] < 0, "n"].sum())
        frequency = np.zeros(size + 1)
        known = counts[counts["term"] >= 0]
        frequency[known["term"]] = known["n"]
        weight = _weights(frequency, total)
        passages = spark.createDataFrame(pd.DataFrame({"text": items["text"]}))
        # Each task sends a table of all terms, so a task takes many words. Small tables travel with the
        # tasks: every broadcast costs space on the driver and on each executor.
        tasks = 1 + sum(map(len, block.items)) // TASK_WORDS
        rows = words.stored(passages.repartition(tasks), "passages")
        latent = spark.sparkContext.broadcast(latent_terms(rows, block, weight, size))
        found = words.stored(texts.mapInArrow(_search(block, weight, latent), _MATCH), "matches")
        out = found if not number else out.unionByName(found)
    return out.withColumn("contaminated", (F.col("passage_share") >= PASSAGE_SHARE) | (F.col("item_share") >= ITEM_SHARE)
                          | (F.col("answer_found") & (F.col("item_share") >= ANSWERED_SHARE)))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                              spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("contaminated").select("doc_id", "item_id", F.round("passage_share", 6).alias("passage_share"),
                                              F.round("item_share", 6).alias("item_share"), "answer_found")
