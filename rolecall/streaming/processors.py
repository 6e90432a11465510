"""Hosts and companies that a stream of attempts keeps the state of, one stateful processor for all.

``frontier_backoff``, ``host_cooldown`` and ``discovery_cooldown`` fold a log in the order of its id. A
stream brings the log out of order and some of it twice. So rows wait in state, filed by id, until the
watermark has passed them; a timer then folds them for good, in order. What a key's state is right now
is the fold of that settled part and of the rows that still wait, so each answer is what the batch
operator gives for all rows seen. A repeated row is known by its id, waiting or settled. Rows that wait
are filed many at a time, so a checkpoint of the form with single rows cannot be gone on from.

What a row does to a key is worked out in column expressions before the processor and what an answer
means after it; the processor only applies whole numbers in order. State is kept in RocksDB and survives
a restart from the checkpoint. A row later than the watermark is dropped, as Spark does in event time.
"""

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from rolecall.operators import state as S
from rolecall.operators.merges import NEW, merge_table
from rolecall.sources.keyed import KeyedTable

#: What the processor takes and gives: ``op`` is what a row does, ``note`` what is to be remembered of it.
LOG = "key string, id bigint, at timestamp, op bigint, note string"
ANSWER = "key string, value bigint, last_id bigint, last_at timestamp, note string"
SETTLED = "value bigint, last_id bigint, last_at timestamp, note string"
WAITING = "ids array<bigint>, ats array<timestamp>, ops array<bigint>, notes array<string>"
#: Rows that wait are filed together, as each call of the state store takes as long as folding many of them.
CHUNK = 1000

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def table_step(value: int, op: int) -> int:
    """``op`` is a packed table from the state before to the state after."""
    return op >> (S.STATE_BITS * value) & (1 << S.STATE_BITS) - 1


def count_step(value: int, op: int) -> int:
    """``op`` is 1 for a failure, -1 for a success, 0 for neither."""
    return 0 if op < 0 else value + op


class OrderedLog(StatefulProcessor):
    """Folds the rows of a key in the order of their id, however they arrive."""

    def __init__(self, step: Callable[[int, int], int]):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.waiting = handle.getMapState("waiting", "id bigint", WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        settled, new = self._settled(), {}
        waiting = {i: row for chunk in self._chunks().values() for i, row in chunk}
        for r in rows:
            if r.id > settled[1] and r.id not in waiting and r.id not in new:
                new[r.id] = r.at, r.op, r.note
        if new:  # by then all of them are behind the watermark
            self._file(sorted(new.items()))
            self.handle.registerTimer(int(max(at for at, _, _ in new.values()).timestamp() * 1000) + 1)
        waiting.update(new)
        yield self._answer(key, self._fold(settled, sorted(waiting.items())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Settle what the watermark has passed, as far as no earlier id still waits."""
        until = timerValues.getCurrentWatermarkInMs()
        chunks = self._chunks()
        rows = sorted(row for chunk in chunks.values() for row in chunk)
        ready = next((i for i, (_, r) in enumerate(rows) if r[0].timestamp() * 1000 >= until), len(rows))
        if ready:
            self.settled.update(self._fold(self._settled(), rows[:ready]))
            last = rows[ready - 1][0]
            for first, chunk in chunks.items():
                if first <= last:
                    self.waiting.removeKey((first,))
                    self._file([row for row in chunk if row[0] > last])
        return iter(())

    def _chunks(self) -> dict[int, list]:
        """Rows that wait as (id, (at, op, note)), by the smallest id of those filed together."""
        return {first: list(zip(ids, zip(ats, ops, notes)))
                for (first,), (ids, ats, ops, notes) in self.waiting.iterator()}

    def _file(self, rows: list) -> None:
        """File rows in the order of their ids; no id waits twice, so no smallest id does."""
        for i in range(0, len(rows), CHUNK):
            part = rows[i:i + CHUNK]
            self.waiting.updateValue((part[0][0],), (
                [i for i, _ in part], [at for _, (at, _, _) in part], [op for _, (_, op, _) in part],
                [note for _, (_, _, note) in part]))

    def close(self) -> None:
        pass

    def _settled(self) -> tuple:
        return tuple(self.settled.get()) if self.settled.exists() else (0, -1, None, None)

    def _fold(self, settled: tuple, rows: list) -> tuple:
        value, last_id, last_at, note = settled
        for i, (at, op, own) in rows:
            value, last_id, last_at = self.step(value, op), i, at
            note = note if own is None else own
        return value, last_id, last_at, note

    @staticmethod
    def _answer(key, folded: tuple) -> Row:
        return Row(key=key[0], value=folded[0], last_id=folded[1], last_at=folded[2], note=folded[3])


def ordered_states(log: DataFrame, step: Callable[[int, int], int], delay: str) -> DataFrame:
    """State of every key that a batch touches; ``log`` has the columns of ``LOG``."""
    log = log.where("key IS NOT NULL AND id IS NOT NULL AND at IS NOT NULL")
    return log.withWatermark("at", delay).groupBy("key").transformWithState(
        OrderedLog(step), ANSWER, "Update", "EventTime")


def backoff_states(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``frontier_backoff`` of a stream of attempts."""
    bucket = S.attempt_bucket()
    log = attempts.select(F.col("host").alias("key"), "id", F.col("fetched_at").alias("at"),
                          S.packed_step(bucket).alias("op"), bucket.alias("note"))
    return S.backoff_answer(ordered_states(log, table_step, delay).select(
        F.col("key").alias("host"), F.col("value").cast("int").alias("backoff_state"),
        F.col("note").alias("last_status_bucket"), F.col("last_at").alias("last_fetched_at"), "last_id"), "last_id")


def cooldown_states(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``host_cooldown`` of a stream of attempts."""
    log = S.cooldown_log(attempts).select(
        F.col("host").alias("key"), "id", F.col("fetched_at").alias("at"),
        F.when(F.col("good"), -1).otherwise(1).cast("bigint").alias("op"), F.col("category").alias("note"))
    return S.cooldown_answer(ordered_states(log, count_step, delay).where("note IS NOT NULL").select(
        F.col("key").alias("host"), F.col("value").alias("failures"), F.col("note").alias("last_error_category"),
        F.col("last_at").alias("last_attempt_at"), "last_id"), "last_id")


def discovery_states(outcomes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``discovery_cooldown`` of a stream of outcomes."""
    log = S.discovery_log(outcomes)
    kind = log.schema["company_id"].dataType
    log = log.select(
        F.col("company_id").cast("string").alias("key"), "id", F.col("observed_at").alias("at"),
        F.when(F.col("reason_code").isNull(), -1).otherwise(1).cast("bigint").alias("op"),
        F.to_json(F.struct("reason_code", "candidate_url", "detail")).alias("note"))
    note = F.from_json("note", "reason_code string, candidate_url string, detail string")
    return S.discovery_answer(ordered_states(log, count_step, delay).select(
        F.col("key").cast(kind).alias("company_id"), F.col("value").alias("failures"),
        F.col("last_at").alias("observed_at"), note.alias("x"), "last_id").select("*", "x.*"), "last_id")


def keep_states(states: DataFrame, table: KeyedTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep a table of states current; only the parts of touched keys are rewritten."""
    names = [n for n in table.schema.names if n not in table.keys]

    def fold(rows, batch):
        return merge_table(rows, batch.withColumnRenamed("last_id", "ord"), list(table.keys), {n: NEW for n in names})

    def step(batch, epoch):
        table.merge(batch, fold, epoch)

    with rocks_db(states.sparkSession):
        return states.writeStream.foreachBatch(step).outputMode("update").option(
            "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class rocks_db:
    """Streams started inside keep their state in RocksDB, which stateful processors need."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(PROVIDER)
        self.conf.set(PROVIDER, ROCKS_DB)

    def __exit__(self, *_):
        self.conf.set(PROVIDER, self.before)
