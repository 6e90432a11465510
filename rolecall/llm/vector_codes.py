"""Product codes of vectors, with LAESA pivots in place of full scans of the codebooks.

Vectors are cut into equal parts, and each part position has a codebook. Pivots are fixed entries of
the first codebook of a position, far from each other. The distance of every part to its pivots is
computed once and stored with the vector. In each round only the distances of entries to pivots are
new: by the triangle inequality the largest difference of two such distances is a lower bound of the
distance of part and entry. Entries are taken in the order of their bounds, and the exact integer
distance is computed until the next bound is above the best distance so far.

A task keeps one sum for each entry, so a round shuffles as many rows as entries for each task. The
codebooks are of fixed size (parts x entries) and go through the driver; the vectors never do.

Rows whose vector is null, holds a null or non-finite component, or has another length than ``dim``
take no part. Repeated rows are coded one by one and count each time; where ids are equal, the vectors
order the first codebook. A null id sorts last and is kept in the result; null labels form one group.
Fewer vectors than entries make a shorter codebook, and an empty table an empty result. Equal
distances go to the lower index. Integers are held at plus and minus 2^25. Other columns of the table,
whatever their names, are not read. There is no text here that could be long; long vectors are those
of another length.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import vectors, words

DIM, PARTS, ENTRIES, ROUNDS, SCALE = 64, 4, 256, 4, 1024
#: Fixed entries of each part position that distances are measured to.
PIVOTS = 12
#: Vectors compared at once, and entries evaluated in the first step.
ROWS, STEP = 2048, 16
HALF = 1 << 31


def _matrix(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    rows, starts, lengths, values = vectors.usable(batch.column("vector"))
    rows = rows[lengths[rows] == dim]
    return rows, vectors.integers(values, starts[rows], dim, scale)


def first_vectors(table: DataFrame, dim: int, scale: int, order: Column, count: int, id_column: str,
                  vector: str) -> np.ndarray:
    """The integer vectors of the first ``count`` rows by ``order``, then by components."""
    def run(batches):
        for batch in batches:
            rows, found = _matrix(batch, dim, scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), vectors.blobs((found + HALF).astype(">u4"))],
                ["vec_id", "v"])  # in this form, bytes have the order of the numbers
    rows = table.select(*vectors.columns(id_column, vector)).mapInArrow(run, "vec_id long, v binary")
    first = rows.orderBy(order, "v").limit(count).collect()
    return np.array([np.frombuffer(r.v, ">u4") for r in first], np.int64).reshape(-1, dim) - HALF


def choose_pivots(book: np.ndarray, count: int) -> np.ndarray:
    """Entries far apart: each next one has the largest summed distance to those before it."""
    chosen, total = [0] if len(book) else [], np.zeros(len(book))
    while chosen and len(chosen) < min(count, len(book)):
        total += distances(book, book[chosen[-1:]])[:, 0]
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return book[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, near enough for bounds with a margin."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    squares = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return np.sqrt(np.maximum(squares, 0))


def nearest(part: np.ndarray, to_pivots: np.ndarray, book: np.ndarray,
            book_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row (ties: lower index), its squared distance, and exact evaluations made."""
    n, size = len(part), len(book)
    kind = vectors.kind_for(vectors.top(part) + vectors.top(book), vectors.top(part) + vectors.top(book),
                            part.shape[1])
    part, book = part.astype(kind), book.astype(kind)
    low = np.zeros((n, size), np.float32)
    for p in range(to_pivots.shape[1]):
        np.maximum(low, np.abs(to_pivots[:, p, None] - book_to_pivots[None, :, p]), out=low)
    # the margin covers rounding: of stored distances to 24 bits, of their sums of squares to 53
    largest = max(float(to_pivots.max(initial=0)), float(book_to_pivots.max(initial=0)))
    low -= np.float32(largest * 1e-5 + 1e-3)
    order = np.argsort(low, axis=1)
    low = np.take_along_axis(low, order, 1)
    best = np.full(n, np.iinfo(np.int64).max)
    entry = np.full(n, size)
    rows, at, step, made = np.arange(n), 0, STEP, 0
    while len(rows):
        stop = min(at + step, size)
        tried = order[rows, at:stop]
        gaps = book[tried] - part[rows, None, :]
        found = np.einsum("rcw,rcw->rc", gaps, gaps).astype(np.int64)
        made += found.size
        least = found.min(1)
        first = np.where(found == least[:, None], tried, size).min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < entry[rows]))
        best[rows[better]], entry[rows[better]] = least[better], first[better]
        if stop == size:
            break
        rows = rows[low[rows, stop] <= np.sqrt(best[rows].astype(np.float64))]
        at, step = stop, step * 2
    return entry, best, made


class Books:
    """The codebooks of all part positions and their distances to the fixed pivots."""

    def __init__(self, books: list[np.ndarray], pivots: list[np.ndarray]):
        self.books, self.pivots = books, pivots
        self.near = [distances(b, p).astype(np.float32) for b, p in zip(books, pivots)]

    def codes(self, v: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every part of every row, and the squared distances summed over parts."""
        parts = len(self.books)
        width, near = v.shape[1] // parts, to_pivots.shape[1] // parts
        out, error = np.zeros((len(v), parts), np.int64), np.zeros(len(v), np.int64)
        for at in range(0, len(v), ROWS):
            some = slice(at, at + ROWS)
            for p in range(parts):
                entry, best, _ = nearest(v[some, p * width:(p + 1) * width],
                                         to_pivots[some, p * near:(p + 1) * near], self.books[p], self.near[p])
                out[some, p] = entry
                error[some] += best
        return out, error

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> "Books":
        """Every used entry replaced by the floor of its parts' mean."""
        books = [b.copy() for b in self.books]
        for (p, e), (count, totals) in sums.items():
            books[p][e] = vectors.floored(totals, count)
        return Books(books, self.pivots)

    def digest(self) -> str:
        text = ",".join(str(x) for b in self.books for x in b.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()


def _entry_sums(table: DataFrame, books: Books, dim: int, parts: int, near: int) -> dict:
    """Count and component sums of the parts nearest to each used entry."""
    width, size = dim // parts, max(map(len, books.books))

    def run(batches):
        counts, totals = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            v = vectors.unblob(batch.column("v"), "<i4", dim).astype(np.int64)
            codes, _ = books.codes(v, vectors.unblob(batch.column("near"), "<f4", near))
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=size)
                np.add.at(totals[p], codes[:, p], v[:, p * width:(p + 1) * width])
        p, e = np.nonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width),
                                         pa.array(totals[p, e].ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), lists],
            ["part", "entry", "n", "total"])

    found = table.select("v", "near").mapInArrow(run, "part int, entry int, n long, total array<long>")
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    return {(r.part, r.entry): (r.n, r.total) for r in found.collect()}  # one row an entry


def vector_codes(table: DataFrame, dim: int = DIM, parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS, id_column: str = "vec_id",
                 vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Books]:
    """vec_id, label, code (an array of entries) and error of every vector, and the final codebooks."""
    if dim % parts:
        raise ValueError("dim must be a multiple of parts")
    seeds = first_vectors(table, dim, scale, F.asc_nulls_last("vec_id"), entries, id_column, vector)
    start = [seeds[:, i:i + dim // parts] for i in range(0, dim, dim // parts)]
    books = Books(start, [choose_pivots(b, pivots) for b in start])
    near = sum(len(p) for p in books.pivots)
    kind = table.schema[label].dataType.simpleString()
    width = dim // parts

    def prepare(batches):
        for batch in batches:
            rows, v = _matrix(batch, dim, scale)
            to = np.concatenate([distances(v[:, p * width:(p + 1) * width], books.pivots[p])
                                 for p in range(parts)], axis=1)
            kept = batch.select(["vec_id", "label"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, vectors.blobs(v.astype("<i4")), vectors.blobs(to.astype("<f4"))],
                ["vec_id", "label", "v", "near"])

    source = table.select(*vectors.columns(id_column, vector), F.col(label).alias("label"))
    coded = words.stored(source.mapInArrow(prepare, f"vec_id long, label {kind}, v binary, near binary"),
                         "vector-parts")
    for _ in range(rounds):
        books = books.moved(_entry_sums(coded, books, dim, parts, near))

    def run(batches):
        for batch in batches:
            v = vectors.unblob(batch.column("v"), "<i4", dim).astype(np.int64)
            codes, error = books.codes(v, vectors.unblob(batch.column("near"), "<f4", near))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * parts),
                                             pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), lists, pa.array(error)],
                ["vec_id", "label", "code", "error"])
    return coded.mapInArrow(run, f"vec_id long, label {kind}, code array<int>, error long"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``label_error``: the error summed over equal labels. The sums are stored, so that a small table
    of them is sent to the rows and only a large one is joined by a shuffle."""
    sums = words.stored(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")),
                        "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector of ``embeddings``."""
    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = with_label_error(words.stored(codes, "vector-codes"))
    digits = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return codes.select("vec_id", digits.alias("code"), "error", "label_error",
                        F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    width = DIM // PARTS
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS n,
         [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {DIM}
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"""parts AS MATERIALIZED (
  SELECT n, p, v[p * {width} + 1:(p + 1) * {width}] AS x FROM kept, range({PARTS}) AS r(p))""",
             f"book0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS c FROM parts WHERE n <= {ENTRIES})"]
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT n, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT n, p, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d
    FROM parts JOIN book{r} USING (p)) GROUP BY n, p)""")
        if r < ROUNDS:
            steps.append(f"""mean{r} AS (
  SELECT p, e, list(m ORDER BY i) AS m FROM (
    SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS DOUBLE) AS m
    FROM near{r} JOIN parts USING (n, p), range(1, {width + 1}) AS t(i) GROUP BY p, e, i) GROUP BY p, e)""")
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM book{r} LEFT JOIN mean{r} USING (p, e))""")
    steps.append(f"""coded AS MATERIALIZED (
  SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY n)""")
    steps.append(f"""digest AS (
  SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) FOR x IN c], ','), ',' ORDER BY p, e)) AS s
  FROM book{ROUNDS})""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       s AS codebooks_sha256
FROM kept JOIN coded USING (n), digest"""


ORACLE = _oracle()
