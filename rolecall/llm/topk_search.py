"""Exact search of the largest inner products, pruned block at a time.

The components are terms. Vectors are filed in chunks, a chunk in blocks of a few vectors that lie close
together, and each block has the largest and smallest value of every term beside a forward index of its
vectors. A query's inner product with any vector of a block is at most the sum over terms of its weight
times the term's largest value (smallest, for a negative weight). Each query takes blocks in descending
order of that sum and scores whole blocks through the forward index, until the next sum is below its
k-th best score.

Queries are rows of the table, worked on in sets of bounded size; a set goes to all tasks, each of which
reads its chunks once. A query starts with the k-th best score of its own chunk as its threshold, so that
a task knows a bound before it has seen any vector; a task hands on at most k rows a query, and only those
not below that threshold.

Rows whose vector is null or holds a null or non-finite component take no part. An inner product needs
vectors of one length: a query meets the rows of its own length, empty vectors included (score 0).
Repeated rows are queries and candidates one by one: a row meets its copies, though not itself. Equal
scores go to the smaller id; a row without an id is a candidate that comes last among equals, never a
query. An empty table gives an empty result. Integers are held at plus and minus 2^25. Other columns,
whatever their names, are not read. There is no text here that could be long; vectors of any length are
searched, in chunks of fewer rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.llm import vectors, words

SCALE, K, EVERY = 256, 5, 50
#: Components in a chunk at most, vectors in a block, components in a set of queries, blocks a query takes
#: at a time.
CHUNK, BLOCK, SET, STEP = 1 << 18, 32, 1 << 20, 4
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


class Chunk:
    """Vectors of one length in blocks, with the bounds of each term in each block.

    ``rows`` tell rows of the table apart; the row of a null id has its complement."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray):
        self.rows, self.ids, self.v = rows, ids, v
        starts = np.arange(0, len(v), BLOCK)
        self.high = np.maximum.reduceat(v, starts, axis=0) if v.size else np.zeros((len(starts), v.shape[1]), np.int64)
        self.low = np.minimum.reduceat(v, starts, axis=0) if v.size else self.high

    @staticmethod
    def near_together(v: np.ndarray) -> np.ndarray:
        """An order in which each block's vectors are close: halves by the component of widest spread."""
        parts, done = [np.arange(len(v))], []
        while parts:
            part = parts.pop()
            if len(part) <= BLOCK or not v.shape[1]:
                done.append(part)
                continue
            some = v[part]
            widest = int((some.max(0) - some.min(0)).argmax())
            half = -(-len(part) // (2 * BLOCK)) * BLOCK  # whole blocks on the left
            cut = np.argpartition(some[:, widest], half - 1)
            parts += [part[cut[half:]], part[cut[:half]]]
        return np.concatenate(done) if done else np.zeros(0, np.int64)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For every query and block, the sum of weights times term bounds."""
        return vectors.products(np.maximum(queries, 0), self.high) + vectors.products(np.minimum(queries, 0), self.low)


class Best:
    """The k best rows of each query of a set so far, and thresholds that no result lies below."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int):
        self.queries, self.rows, self.floor, self.k = queries, rows, floor.copy(), k
        self.scores = np.full((len(rows), k), LEAST)
        self.ids = np.full((len(rows), k), NO_ID)
        self.found = np.zeros((len(rows), k), np.int64)  # rows of the table
        self.full = np.zeros(len(rows), np.int64)

    def search(self, chunk: Chunk) -> int:
        """Take in a chunk; the number of scores computed."""
        sums, made = chunk.bounds(self.queries), 0
        some = np.flatnonzero(sums.max(1, initial=LEAST) >= self.floor)
        for at in range(0, len(some), 2048):
            made += self._search(chunk, some[at:at + 2048], sums[some[at:at + 2048]])
        return made

    def _search(self, chunk: Chunk, some: np.ndarray, sums: np.ndarray) -> int:
        order = np.argsort(-sums, axis=1, kind="stable")
        sums = np.take_along_axis(sums, order, 1)
        made, at = 0, 0
        while at < sums.shape[1]:
            open_ = sums[:, at:at + STEP] >= self.floor[some, None]
            if not open_.any():
                break
            q, place = np.nonzero(open_)
            blocks = order[q, at + place]
            by_block = np.argsort(blocks, kind="stable")
            q, blocks = some[q[by_block]], blocks[by_block]
            cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
            hits = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(blocks)]):
                inside = slice(blocks[a] * BLOCK, (blocks[a] + 1) * BLOCK)
                scores = vectors.products(self.queries[q[a:b]], chunk.v[inside])
                made += scores.size
                i, j = np.nonzero(scores >= self.floor[q[a:b], None])
                hits.append((q[a:b][i], scores[i, j], j + inside.start))
            who, scores, places = (np.concatenate(x) for x in zip(*hits))
            self._take(who, scores, chunk.ids[places], chunk.rows[places])
            at += STEP
        return made

    def _take(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        keep = rows != self.rows[who]
        # among equals, an id above the k-th best one's changes nothing
        full = self.full[who] == self.k
        keep &= ~full | (scores > self.scores[who, -1]) | (ids < self.ids[who, -1])
        who, scores, ids, rows = who[keep], scores[keep], ids[keep], rows[keep]
        if not len(who):
            return
        touched = np.unique(who)
        old_q, old_k = np.nonzero(np.arange(self.k) < self.full[touched, None])
        old = touched[old_q]
        who = np.concatenate([old, who])
        scores = np.concatenate([self.scores[old, old_k], scores])
        ids = np.concatenate([self.ids[old, old_k], ids])
        rows = np.concatenate([self.found[old, old_k], rows])
        order = np.lexsort((rows, ids, -scores, who))
        who = who[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best = rank < self.k
        order, who, rank = order[best], who[best], rank[best]
        self.scores[who, rank], self.ids[who, rank], self.found[who, rank] = scores[order], ids[order], rows[order]
        self.full[touched] = np.bincount(np.searchsorted(touched, who), minlength=len(touched))
        done = touched[self.full[touched] == self.k]
        self.floor[done] = np.maximum(self.floor[done], self.scores[done, -1])


CHUNKS = "dim int, n_queries long, rows array<long>, ids array<long>, v binary"


def _chunks(table: DataFrame, scale: int, every: int, id_column: str, vector: str) -> DataFrame:
    """The table as chunks of rows in blocks."""
    def run(batches):
        for batch in batches:
            rows, starts, lengths, values = vectors.usable(batch.column("vector"))
            number = batch.column("row").to_numpy()
            named = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id").fill_null(0).to_numpy()
            for dim in np.unique(lengths[rows]).tolist():
                own = rows[lengths[rows] == dim]
                size = max(CHUNK // max(dim, 1), 1)
                for at in range(0, len(own), size):
                    some = own[at:at + size]
                    v = vectors.integers(values, starts[some], dim, scale)
                    order = Chunk.near_together(v)
                    some, v = some[order], v[order]
                    n = int((named[some] & (ids[some] % every == 0)).sum())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([dim], pa.int32()), pa.array([n]),
                        pa.array([np.where(named[some], number[some], ~number[some])]),
                        pa.array([np.where(named[some], ids[some], NO_ID)]),
                        pa.array([v.astype("<i4").tobytes()], pa.binary())], ["dim", "n_queries", "rows", "ids", "v"])
    return table.select(F.monotonically_increasing_id().alias("row"), *vectors.columns(id_column, vector)).mapInArrow(
        run, CHUNKS)


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            dim = batch.column("dim")[i].as_py()
            rows, ids = (batch.column(c)[i].values.to_numpy() for c in ("rows", "ids"))
            v = np.frombuffer(batch.column("v")[i].as_buffer(), "<i4").reshape(len(rows), dim).astype(np.int64)
            yield dim, Chunk(rows, ids, v)


def _queries(chunks: DataFrame, k: int, every: int) -> DataFrame:
    """Query rows with the k-th best score of their own chunk, where it has so many others."""
    def run(batches):
        for dim, chunk in _read(batches):
            own = np.flatnonzero((chunk.rows >= 0) & (chunk.ids % every == 0))
            best = Best(chunk.v[own], chunk.rows[own], np.full(len(own), LEAST), k)
            best.search(chunk)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(own), dim), pa.int32()), pa.array(chunk.rows[own]), pa.array(chunk.ids[own]),
                vectors.blobs(chunk.v[own].astype("<i4")) if dim else pa.array([b""] * len(own), pa.binary()),
                pa.array(best.floor)], ["dim", "row", "query_id", "v", "least"])
    return chunks.where("n_queries > 0").mapInArrow(run, "dim int, row long, query_id long, v binary, least long")


def _best_of(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best rows of one set of queries that each task finds in its chunks."""
    sets = {}
    for r in queries.orderBy("dim", "row").collect():  # one set, of bounded size
        sets.setdefault(r.dim, []).append(r)
    sets = {dim: (np.array([np.frombuffer(r.v, "<i4") for r in found], np.int64).reshape(len(found), dim),
                  np.array([r.row for r in found]), np.array([r.least for r in found]),
                  np.array([r.query_id for r in found])) for dim, found in sets.items()}

    def run(batches):
        best = {dim: Best(v, rows, least, k) for dim, (v, rows, least, _) in sets.items()}
        for dim, chunk in _read(batches):
            if dim in best:
                best[dim].search(chunk)
        for dim, found in best.items():
            _, rows, least, ids = sets[dim]
            q, place = np.nonzero((np.arange(k) < found.full[:, None]) & (found.scores >= least[:, None]))
            named = found.found[q, place] >= 0
            yield pa.RecordBatch.from_arrays([
                pa.array(rows[q]), pa.array(ids[q]), pa.array(found.ids[q, place], mask=~named),
                pa.array(found.scores[q, place]), pa.array(found.found[q, place])],
                ["row", "query_id", "vec_id", "score", "found"])
    return chunks.where(F.col("dim").isin(list(sets))).mapInArrow(
        run, "row long, query_id long, vec_id long, score long, found long")


def top_products(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, set_size: int = SET,
                 id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of every row whose id ``every`` divides."""
    chunks = words.stored(_chunks(table, scale, every, id_column, vector), "search-chunks")
    total = chunks.agg(F.sum(F.col("n_queries") * F.greatest("dim", F.lit(1))).alias("n")).first().n or 0
    sets = max(-(-total // set_size), 1)
    asked = words.stored_by(_queries(chunks, k, every).withColumn(
        "part", F.pmod(F.xxhash64("row"), F.lit(sets)).cast("int")), "search-queries", "part")
    found = None
    for part in range(sets):
        one = _best_of(chunks, asked.where(F.col("part") == part).drop("part"), k)
        if sets > 1:
            one = words.stored(one, "search-found")
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 5 best rows of every 50th row of ``embeddings``."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""WITH kept AS (
  SELECT vec_id, row_number() OVER () AS n, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, q.n, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM kept AS q JOIN kept AS c ON q.n <> c.n AND len(q.v) = len(c.v)
    WHERE q.vec_id % {EVERY} = 0))
WHERE rank <= {K}"""
