"""Streams over several micro-batches end where one batch over everything ends; merges touch their parts only."""

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from rolecall.operators import latest, merges, state
from rolecall.sources.keyed import KeyedTable
from rolecall.streaming import processors
from rolecall.streaming.tables import backoff_stream, posting_stream
from test_tables import BATCH, POSTING, fresh, stored, ts


def put(batches, folder, start=0):
    """Each batch as a file of its own, in order of time."""
    for i, batch in enumerate(batches, start):
        batch.coalesce(1).write.parquet(f"{folder}/b{i}")
        for path, _, names in os.walk(f"{folder}/b{i}"):
            for name in names:
                os.utime(f"{path}/{name}", (1e9 + i, 1e9 + i))


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def files(folder):
    """Every data file with its time of change."""
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
            for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def part_of(name):
    return int(name.split("_part=")[1].split("/")[0])


# ---- keyed tables

def keyed(rows, tmp_path, n=400, parts=16):
    start = rows("id bigint, k string, v int", *[(i, f"k{i}", i) for i in range(n)])
    return start, KeyedTable(f"{tmp_path}/table", ("k",), start.schema, parts).create(start)


def upsert(rows, batch):
    return merges.merge_table(rows, batch, ["k"], {"v": merges.NEW, "id": merges.KEEP})


def test_a_merge_rewrites_the_touched_parts_only(rows, spark, tmp_path):
    start, table = keyed(rows, tmp_path)
    batch = rows("ord int, id bigint, k string, v int", (1, 900, "k5", -1), (2, 901, "new", -2), (3, 902, "k5", -3))
    before = files(table.folder)
    parts = table.merge(batch, upsert)
    after = files(table.folder)
    assert 1 <= len(parts) <= 2
    assert {f for f in before if part_of(f) not in parts} == {f for f in after if part_of(f) not in parts}
    assert all(after[f] == before[f] for f in after if part_of(f) not in parts)
    assert not {f for f in before if part_of(f) in parts} & set(after)
    assert sorted(table.read(spark).collect()) == sorted(upsert(start, batch).collect())
    assert not os.path.exists(f"{table.folder}-pending/batch")


def test_a_merge_reads_the_touched_parts_only(rows, spark, tmp_path):
    _, table = keyed(rows, tmp_path)
    plan = table.read(spark, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part" in plan and "(3,5)" in plan.replace(" ", "")
    read = table.read(spark, [3, 5]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {part_of(r.f) for r in read} == {3, 5}


def test_a_part_left_empty_goes(rows, spark, tmp_path):
    _, table = keyed(rows, tmp_path, n=3)
    (part,) = table.merge(rows("k string", ("k1",)), lambda old, batch: old.join(batch, "k", "left_anti"))
    assert part not in {part_of(f) for f in files(table.folder)}
    assert sorted(r.k for r in table.read(spark).collect()) == ["k0", "k2"]


def test_empty_table_empty_batch_and_null_keys(rows, spark, tmp_path):
    empty = rows("id bigint, k string, v int", (1, "a", 1)).limit(0)
    table = KeyedTable(f"{tmp_path}/table", ("k",), empty.schema, 4).create(empty)
    batch = rows("ord int, id bigint, k string, v int", (1, 1, "a", 5), (2, 2, None, 6))
    assert table.merge(batch.limit(0), upsert) == [] and table.read(spark).count() == 0
    table.merge(batch, upsert)
    assert sorted(table.read(spark).collect(), key=str) == [(1, "a", 5), (2, None, 6)]
    with pytest.raises(FileExistsError):
        table.create(empty)


def test_an_epoch_counts_once_and_is_taken_up_again(rows, spark, tmp_path, monkeypatch):
    start, table = keyed(rows, tmp_path, n=40)
    add = lambda old, batch: old.join(batch.groupBy("k").count(), "k", "left").select(
        "id", "k", (F.col("v") + F.coalesce("count", F.lit(0)).cast("int")).alias("v"))
    batch = rows("k string", *[(f"k{i}",) for i in range(20)])
    publish = KeyedTable._publish

    def cut_off(self, spark, pending, parts):  # half of the parts get there before the run ends
        publish(self, spark, pending, parts)
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_publish", cut_off)
    with pytest.raises(RuntimeError):
        table.merge(batch, add, epoch=0)
    monkeypatch.setattr(KeyedTable, "_publish", publish)
    for _ in range(3):
        table.merge(batch, add, epoch=0)
    assert sorted(r.v - r.id for r in table.read(spark).collect()) == [0] * 20 + [1] * 20
    table.merge(batch, add, epoch=1)
    assert sorted(r.v - r.id for r in table.read(spark).collect()) == [0] * 20 + [2] * 20
    assert sorted(os.listdir(f"{table.folder}-done")) == ["1"]


def test_a_hot_key_is_written_by_several_tasks(rows, spark, tmp_path):
    start = spark.range(60000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
        F.col("id").cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        table = KeyedTable(f"{tmp_path}/table", ("k",), start.schema, 8).create(start)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    (hot,) = table.touched(rows("k string", ("hot",)))
    assert len([f for f in files(table.folder) if part_of(f) == hot]) > 1


# ---- tables kept current by a stream

def test_posting_stream_equals_merges_in_order(rows, spark, tmp_path):
    start = rows(POSTING, stored(1, "A", "h1"), stored(2, None, "h2"), stored(3, "C", "h3"), stored(4, "Z", "h1", company=9))
    first = rows(BATCH, fresh(1, "A", "h7"), fresh(2, "D", "h4"))
    second = rows(BATCH, fresh(3, "A", "h8"), fresh(4, None, "h4", run=3))
    put([first, second], f"{tmp_path}/in")
    safe = lambda batch: batch.groupBy("company_id").agg(F.max("crawl_run_id").alias("crawl_run_id"))
    table = KeyedTable(f"{tmp_path}/out", ("company_id",), start.schema, 4).create(start)
    posting_stream(stream(spark, first.schema, f"{tmp_path}/in"), table, f"{tmp_path}/offsets", safe).awaitTermination()
    one = merges.close_out_postings(merges.merge_postings(start, first), safe(first))
    want = merges.close_out_postings(merges.merge_postings(one, second), safe(second))
    got = table.read(spark)
    assert sorted(map(str, got.select(*start.columns).collect())) == sorted(map(str, want.collect()))
    assert {(r.company_id, r.content_hash): r.is_active for r in got.collect()} == {
        (1, "h8"): False, (1, "h2"): False, (1, "h3"): False, (1, "h4"): True, (9, "h1"): True}


ATTEMPT = "host string, id bigint, fetched_at timestamp, http_status int, error_bucket string"
ANSWERS = [429, 503, 404, 403, 429, 200, 503, 0, 429, 429, 404, 500]


def test_backoff_stream_equals_the_whole_fold(rows, spark, tmp_path):
    log = [("a" if i % 3 else "b", i, ts(i), s, None) for i, s in enumerate(ANSWERS * 2)]
    put([rows(ATTEMPT, *part) for part in (log[:9], log[9:15], log[15:])], f"{tmp_path}/in")
    hosts = rows("host string, backoff_state int, last_status_bucket string, next_allowed_at timestamp").limit(0)
    table = KeyedTable(f"{tmp_path}/out", ("host",), hosts.schema, 4).create(hosts)
    backoff_stream(stream(spark, ATTEMPT, f"{tmp_path}/in"), table, f"{tmp_path}/offsets").awaitTermination()
    want = state.frontier_backoff(rows(ATTEMPT, *log)).select(*hosts.columns)
    assert sorted(table.read(spark).collect()) == sorted(want.collect())


# ---- stateful processors

def shuffled(log, sizes, seed=1):
    """The log in batches, with rows up to 15 places early or late and some rows twice."""
    chance = random.Random(seed)
    order = sorted(log, key=lambda r: r[1] + chance.uniform(0, 15))
    out, at = [], 0
    for n in sizes:
        part = order[at:at + n]
        out.append(part + chance.sample(order[max(at - 12, 0):at + n], 4))
        at += n
    assert at >= len(log)
    return out


OUTCOME = "company_id bigint, id bigint, observed_at timestamp, reason_code string, candidate_url string, detail string"
REASONS = [None, "discovery_fetch_failed", "discovery_host_cooldown", "discovery_homepage_blocked_by_robots",
           "discovery_company_cooldown", "discovery_fetch_failed"]


def attempts_log(n=90):
    chance = random.Random(4)
    return [(chance.choice(["a", "a", "a", "b", None, " "]), i, ts(i), chance.choice(ANSWERS + [200, 429, 408]),
             chance.choice([None, None, "read_timeout", "io_error"])) for i in range(n)]


def outcomes_log(n=90):
    chance = random.Random(5)
    return [(chance.choice([1, 1, 2, 3]), i, ts(i), chance.choice(REASONS), f"u{i}", chance.choice(["http_503", None]))
            for i in range(n)]


@pytest.mark.parametrize("log, schema, key, states, whole", [
    (attempts_log, ATTEMPT, "host", processors.backoff_states, state.frontier_backoff),
    (attempts_log, ATTEMPT, "host", processors.cooldown_states, state.host_cooldown),
    (outcomes_log, OUTCOME, "company_id", processors.discovery_states, state.discovery_cooldown),
], ids=["backoff", "cooldown", "discovery"])
def test_processors_cope_with_disorder_repeats_and_restarts(rows, spark, tmp_path, log, schema, key, states, whole):
    log = log()
    batches = [rows(schema, *part) for part in shuffled(log, [30, 25, 35])]
    want = whole(rows(schema, *log))
    table = KeyedTable(f"{tmp_path}/out", (key,), want.schema, 4).create(want.limit(0))
    at = 0
    for some in (batches[:2], batches[2:]):  # the second run goes on from the checkpoint of the first
        put(some, f"{tmp_path}/in", at)
        at += len(some)
        answers = states(stream(spark, schema, f"{tmp_path}/in"), "20 minutes")
        processors.keep_states(answers, table, f"{tmp_path}/offsets").awaitTermination()
    assert sorted(map(str, table.read(spark).collect())) == sorted(map(str, want.collect()))


class Kept:
    """A value or map state in memory."""

    def __init__(self):
        self.value, self.map = None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def iterator(self):
        return iter(self.map.items())


def test_rows_are_settled_once_the_watermark_has_passed_them(rows):
    class Handle:
        timers = []
        getValueState = getMapState = staticmethod(lambda *_: Kept())
        registerTimer = timers.append

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    from pyspark.sql import Row
    one = processors.OrderedLog(processors.count_step)
    one.init(Handle)
    row = lambda i, op: Row(id=i, at=ts(i), op=op, note=f"n{i}")
    ms = lambda i: int(ts(i).timestamp() * 1000)
    (got,) = one.handleInputRows(("k",), iter([row(5, 1), row(2, 1), row(3, -1), row(2, 1)]), None)
    assert (got.value, got.last_id, got.note) == (1, 5, "n5") and Handle.timers == [ms(5) + 1]
    list(one.handleExpiredTimer(("k",), Times(ms(4)), None))
    assert one.settled.value[:2] == (0, 3) and list(one.waiting.map) == [(5,)]
    (got,) = one.handleInputRows(("k",), iter([row(4, 1), row(3, -1)]), None)  # a late row, and a settled one again
    assert (got.value, got.last_id) == (2, 5)


def test_large_cut_of_a_hot_key(rows):
    df = rows("k string, v int", *[("hot", i) for i in range(4000)], *[("cold", i) for i in range(10)])
    got = latest.top_per_group(df, ["k"], [F.desc("v")], 1500).collect()
    assert sorted(r.v for r in got if r.k == "hot") == list(range(2500, 4000))
    assert sorted(r.v for r in got if r.k == "cold") == list(range(10))


# ---- packed tables of the back-off

def after(answer, s):
    if answer in (429, 403):
        return min(s + 1, 6)
    if answer == 200:
        return 0
    return max(s - 1, 0) if 400 <= answer < 500 else min(s + 1, 4)


def test_packed_tables_equal_single_steps_over_many_blocks(rows, spark, monkeypatch):
    monkeypatch.setattr(state, "BLOCK_BITS", [3, 2, 58])
    chance = random.Random(8)
    log, want = [], {}
    for start in range(7):
        for host in ("busy", "rare", "fine"):
            want[f"{host}{start}"] = start
    for i in range(1500):
        host = chance.choice(["busy"] * 8 + ["rare", "fine"]) + str(chance.randrange(7))
        answer = 200 if host.startswith("fine") else chance.choice(ANSWERS + [403, 503])
        answer = chance.choice([429, 503, 404, 500]) if answer == 200 and host.startswith("rare") else answer
        log.append((host, i * 3, ts(i), answer, None))
        want[host] = after(answer, want[host])
    hosts = rows("host string, backoff_state int", *[(h, int(h[-1])) for h in want])
    got = {r.host: r.backoff_state for r in state.frontier_backoff(
        rows(ATTEMPT, *chance.sample(log, len(log))), hosts).collect()}
    assert got == {h: want[h] for h in {r[0] for r in log}}


def test_the_back_off_shuffles_whole_numbers(rows):
    plan = state.frontier_backoff(rows(ATTEMPT, ("a", 1, ts(1), 200, None)))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 3 and "Join" not in plan
    assert plan.count("collect_list") and "array<struct" not in plan


def test_rows_of_a_key_are_filed_in_few_calls(rows):
    calls = []

    class Counted(Kept):
        def updateValue(self, key, value):
            calls.append(key)
            super().updateValue(key, value)

        def containsKey(self, key):
            calls.append(key)
            return super().containsKey(key)

    class Handle:
        getValueState = staticmethod(lambda *_: Kept())
        getMapState = staticmethod(lambda *_: Counted())
        registerTimer = staticmethod(lambda _: None)

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: int(ts(4000).timestamp() * 1000))

    from pyspark.sql import Row
    one = processors.OrderedLog(processors.count_step)
    one.init(Handle)
    log = [Row(id=i, at=ts(i), op=1, note=None) for i in range(5000)]
    random.Random(3).shuffle(log)
    (got,) = one.handleInputRows(("k",), iter(log + log[:50]), None)
    assert got.value == 5000 and len(calls) < 20
    list(one.handleExpiredTimer(("k",), Times, None))
    assert one.settled.value[:2] == (4000, 3999)
    (got,) = one.handleInputRows(("k",), iter(log), None)
    assert (got.value, got.last_id) == (5000, 4999) and len(calls) < 30


def test_a_publication_that_ends_between_two_parts_is_taken_up_again(rows, spark, tmp_path):
    _, table = keyed(rows, tmp_path, n=40)
    start = {r.id: r for r in table.read(spark).collect()}
    pending, parts = f"{tmp_path}/pending", list(range(table.parts))
    new = table.read(spark).withColumn("v", F.col("v") + 1).where("id % 2 = 0").localCheckpoint()
    table._write(new, pending)
    written = {f.split("/")[-1] for f in files(pending)}
    table._publish(spark, pending, parts)
    # the files themselves are moved: no row is written a second time
    assert {f.split("/")[-1] for f in files(table.folder)} == written and not files(pending)
    table._publish(spark, pending, parts)  # as after a restart: parts that were moved are not taken for empty ones
    got = {r.id: r.v for r in table.read(spark).collect()}
    assert got == {i: r.v + 1 for i, r in start.items() if i % 2 == 0}


# ---- large parts one after another

def shuffle_files(spark):
    """Names of the shuffle files that lie on disk now."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}


def left_over(spark, before):
    """Shuffle files that came since and stay; they are deleted in the background."""
    for _ in range(50):
        new = shuffle_files(spark) - before
        if not new:
            break
        time.sleep(0.1)
    return new


def test_large_parts_are_merged_one_after_another(rows, spark, tmp_path, monkeypatch):
    start, table = keyed(rows, tmp_path, n=40, parts=4)
    batch = rows("ord int, id bigint, k string, v int", *[(i, 900 + i, f"k{i}", -i) for i in range(30, 60)]).withColumn(
        "none", F.lit(None))
    seen = []

    def fold(old, new):
        assert dict(new.dtypes)["none"] == "void"
        seen.append((table.touched(old), table.touched(new)))
        return upsert(old, new)

    monkeypatch.setattr("rolecall.sources.keyed.AT_ONCE", 0)
    assert table.merge(batch, fold) == [0, 1, 2, 3]
    assert [new for _, new in seen] == [[0], [1], [2], [3]] and all(old in ([], new) for old, new in seen)
    assert sorted(table.read(spark).collect()) == sorted(upsert(start, batch).collect())
    assert not [n for n in os.listdir(tmp_path) if os.path.exists(f"{tmp_path}/{n}/_SUCCESS") and n != "table"]


def test_a_table_made_of_large_parts_is_filed_without_a_shuffle(rows, spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rolecall.sources.keyed.AT_ONCE", 0)
    before = shuffle_files(spark)
    start, table = keyed(rows, tmp_path, parts=4)
    assert sorted(table.read(spark).collect()) == sorted(start.collect())
    assert {part_of(f) for f in files(table.folder)} == {0, 1, 2, 3}
    assert not left_over(spark, before)


def test_a_merge_leaves_no_shuffle_files(rows, spark, tmp_path):
    before = shuffle_files(spark)
    _, table = keyed(rows, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # what large inputs meet
    try:
        table.merge(rows("ord int, id bigint, k string, v int", *[(i, i, f"k{i}", -i) for i in range(50)]), upsert)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not left_over(spark, before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_posting_stream_closes_out_by_the_whole_batch(rows, spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rolecall.sources.keyed.AT_ONCE", 0)
    start = rows(POSTING, *[stored(i, None, f"h{i}", company=i) for i in range(1, 9)])
    batch = rows(BATCH, *[fresh(i, None, f"n{i}", run=i, company=i) for i in range(1, 9)])
    put([batch], f"{tmp_path}/in")
    # only the companies of the last run of the batch count, which a part may not hold
    safe = lambda b: b.select("company_id").distinct().crossJoin(b.agg(F.max("crawl_run_id").alias("crawl_run_id")))
    table = KeyedTable(f"{tmp_path}/out", ("company_id",), start.schema, 4).create(start)
    posting_stream(stream(spark, batch.schema, f"{tmp_path}/in"), table, f"{tmp_path}/offsets", safe).awaitTermination()
    want = merges.close_out_postings(merges.merge_postings(start, batch), safe(batch))
    got = table.read(spark).select(*start.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want.collect()))
    assert {r.content_hash for r in got if r.is_active} == {"n8"}


def test_a_posting_merge_in_parts_equals_one_plan(rows, spark, monkeypatch):
    monkeypatch.setattr("rolecall.sources.keyed.AT_ONCE", 0)
    draw = random.Random(3)
    target = rows(POSTING, *[stored(i, draw.choice(["A", "B", " ", None]), f"h{i}", company=draw.choice([1, 2, 3, 4, None]))
                             for i in range(60)])
    batch = rows(BATCH, *[fresh(i, draw.choice(["A", "B", " ", None]), f"h{draw.randrange(90)}",
                                company=draw.choice([1, 2, 3, 5, None])) for i in range(40)])
    before = shuffle_files(spark)
    got = merges.merge_postings(target, batch, parts=4)
    assert not left_over(spark, before)
    want = merges.merge_postings(target, batch)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    none = merges.merge_postings(target.limit(0), batch.limit(0), parts=4)
    assert none.columns == target.columns and none.count() == 0
