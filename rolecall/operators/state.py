"""State that a log of attempts leaves behind: back-off, cool-down, budgets, schedules.

The order of a log is its sequence column, a non-negative bigint unique within
the log. State is folded block by block (see ``ordered``), so a host or company
may hold any share of the log.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.functions import fixed_values as V
from rolecall.functions import reasons as R
from rolecall.functions.text import is_blank, record
from rolecall.operators.latest import top_per_group
from rolecall.operators.ordered import BLOCK_BITS as BLOCK
from rolecall.operators.ordered import ordered_fold, running

RATE_LIMITED = ["HTTP_429", "HTTP_403"]
TRANSIENT = ["HTTP_5XX", "ERROR_TIMEOUT"]
STATES = range(V.RATE_LIMIT_MAX_STATE + 1)

# what a stretch of the log does to the state: the states after each state before, three bits for each, in a bigint
STATE_BITS = 3
#: Bits of an id that its place in a block takes, then those of blocks in larger ones; 63 in all.
BLOCK_BITS = [20, 22, 21]
TABLE_BITS = STATE_BITS * len(STATES)


def _packed(after) -> int:
    return sum(after(s) << STATE_BITS * s for s in STATES)


SAME = _packed(lambda s: s)
#: Tables of single answers, by the code an answer goes by in a block.
STEPS = [
    _packed(lambda s: 0),
    _packed(lambda s: min(s + 1, V.RATE_LIMIT_MAX_STATE)),
    _packed(lambda s: max(s - 1, 0)),
    _packed(lambda s: min(s + 1, V.TRANSIENT_MAX_STATE)),
]
CODE_BITS = 2


def step_code(bucket: Column) -> Column:
    """Which of ``STEPS`` an answer is; 0 is success."""
    return (F.when(bucket == "HTTP_2XX", 0).when(bucket.isin(RATE_LIMITED), 1)
            .when(bucket == "HTTP_4XX", 2).otherwise(3))


def packed_step(bucket: Column) -> Column:
    """Table of one answer."""
    return F.get(F.array(*[F.lit(t).cast("bigint") for t in STEPS]), step_code(bucket))


def state_after(table: Column, state: Column) -> Column:
    """State that a table leads to from ``state``."""
    return F.call_function("shiftright", table, (state * STATE_BITS).cast("int")).bitwiseAND((1 << STATE_BITS) - 1)


def joined(left: Column, right: Column) -> Column:
    """Table of two stretches, one after the other."""
    low = (1 << STATE_BITS) - 1
    parts = [F.shiftleft(state_after(right, F.shiftright(left, STATE_BITS * s).bitwiseAND(low)), STATE_BITS * s)
             for s in STATES]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def attempt_bucket() -> Column:
    return R.status_bucket(F.col("http_status"), F.col("error_bucket"))


def delay_ms(bucket: Column, state: Column, per_host_ms: int = V.PER_HOST_DELAY_MS) -> Column:
    """Wait after an answer that led to ``state``."""
    doubled = F.pow(F.lit(2.0), F.greatest(state - 1, F.lit(0)))
    rate = F.least(doubled * V.RATE_LIMIT_BASE_SECONDS, F.lit(float(V.RATE_LIMIT_MAX_SECONDS)))
    transient = F.least(doubled * V.TRANSIENT_BASE_SECONDS, F.lit(float(V.TRANSIENT_MAX_SECONDS)))
    seconds = (
        F.when(bucket.isin(RATE_LIMITED), rate)
        .when(bucket.isin(TRANSIENT), transient)
        .when(bucket.isin("HTTP_2XX", "HTTP_4XX"), F.lit(per_host_ms / 1000.0))
        .otherwise(F.lit(float(V.OTHER_ERROR_SECONDS)))
    )
    return (seconds * 1000).cast("bigint")


def plus_ms(when: Column, ms: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(when) + ms * 1000)


def plus_minutes(when: Column, minutes: Column) -> Column:
    return plus_ms(when, minutes.cast("bigint") * 60000)


def frontier_backoff(attempts: DataFrame, hosts: DataFrame | None = None,
                     per_host_ms: int = V.PER_HOST_DELAY_MS) -> DataFrame:
    """Back-off state, last answer and next allowed time of every host in the log.

    What a stretch of the log does to a host is a table from the state before to
    the state after; such tables join associatively. ``hosts`` may give the state
    to start from, else it is 0. ``attempts`` has host, id, fetched_at,
    http_status and error_bucket; those without a host are left out.
    """
    rows = attempts.where("host IS NOT NULL").select("host", "id", "fetched_at", attempt_bucket().alias("bucket"))
    out = backoff_tables(rows)
    start = F.lit(0)
    if hosts is not None:
        out = out.join(hosts.select("host", F.col("backoff_state").alias("_start")), "host", "left")
        start = F.least(F.greatest(F.coalesce("_start", F.lit(0)), F.lit(0)), F.lit(max(STATES)))
    return backoff_answer(out.select(
        "host", state_after(F.col("table"), start).cast("int").alias("backoff_state"),
        F.col("last.bucket").alias("last_status_bucket"), F.col("last.fetched_at").alias("last_fetched_at")),
        per_host_ms=per_host_ms)


def backoff_tables(rows: DataFrame) -> DataFrame:
    """Packed table and last row of every host.

    Rows are folded in blocks of ids. A success makes all before it void, so it
    goes into its block as a place alone, and only the failures are listed, as
    whole numbers of place and code. Blocks are then joined, as whole numbers of
    place and table, in two more levels for all 63 bits of an id.
    """
    place = F.col("id").bitwiseAND((1 << BLOCK_BITS[0]) - 1)
    code = step_code(F.col("bucket"))
    listed = F.shiftleft(place, CODE_BITS).bitwiseOR(code.cast("bigint"))
    blocks = rows.groupBy("host", F.shiftright("id", BLOCK_BITS[0]).alias("block")).agg(
        F.collect_list(F.when(code != 0, listed)).alias("failures"),
        F.max(F.when(code == 0, F.shiftleft(place + 1, CODE_BITS))).alias("void"),
        F.max(F.struct("id", "bucket", "fetched_at")).alias("last"))
    steps = F.array(*[F.lit(t).cast("bigint") for t in STEPS])
    left = F.sort_array(F.filter("failures", lambda x: F.col("void").isNull() | (x >= F.col("void"))))
    start = F.when(F.col("void").isNull(), SAME).otherwise(STEPS[0]).cast("bigint")
    table = F.aggregate(left, start, lambda t, x: joined(t, F.get(steps, x.bitwiseAND((1 << CODE_BITS) - 1).cast("int"))))
    tables = blocks.select("host", "block", table.alias("table"), "last")
    for bits in BLOCK_BITS[1:]:
        place = F.col("block").bitwiseAND((1 << bits) - 1)
        uppers = tables.groupBy("host", F.shiftright("block", bits).alias("block")).agg(
            F.collect_list(F.shiftleft(place, TABLE_BITS).bitwiseOR(F.col("table"))).alias("tables"),
            F.max("last").alias("last"))
        table = F.aggregate(F.sort_array("tables"), F.lit(SAME).cast("bigint"),
                            lambda t, x: joined(t, x.bitwiseAND((1 << TABLE_BITS) - 1)))
        tables = uppers.select("host", "block", table.alias("table"), "last")
    return tables


def backoff_answer(states: DataFrame, *more: str, per_host_ms: int = V.PER_HOST_DELAY_MS) -> DataFrame:
    """When hosts may be asked again, from their state and last answer."""
    wait = delay_ms(F.col("last_status_bucket"), F.col("backoff_state"), per_host_ms)
    return states.select("host", "backoff_state", "last_status_bucket",
                         plus_ms(F.col("last_fetched_at"), wait).alias("next_allowed_at"), *more)


def trailing_failures(log: DataFrame, keys: list[str], seq: str, good: Column, bad: Column) -> DataFrame:
    """Per key: failures since the last success, and since the start without one."""
    unit = record(reset=good, n=F.when(good, 0).when(bad, 1).otherwise(0).cast("bigint"))

    def combine(left, right):
        return record(
            reset=left["reset"] | right["reset"],
            n=F.when(right["reset"], right["n"]).otherwise(left["n"] + right["n"]),
        )

    return ordered_fold(log, keys, seq, unit, combine).select(
        *keys, F.col("folded.reset").alias("had_success"), F.col("folded.n").alias("failures"))


def backoff_minutes(failures: Column, steps: list[int] = V.BACKOFF_MINUTES) -> Column:
    """Step for the n-th failure in a row; the last step repeats."""
    table = F.array(*[F.lit(m) for m in steps])
    return F.get(table, (F.least(F.greatest(failures, F.lit(1)), F.lit(len(steps))) - 1).cast("int"))


def cooldown_category(status: Column, error: Column) -> Column:
    """Why an answer counts towards a cool-down, null when it does not."""
    timeout = F.lower(error).contains("timeout")
    by_status = F.when(status == 429, F.lit("HTTP_429_RATE_LIMIT")).when(status == 408, F.lit("TIMEOUT"))
    return F.when(error.isNotNull(), F.when(timeout, F.lit("TIMEOUT"))).otherwise(by_status)


def cooldown_log(attempts: DataFrame) -> DataFrame:
    """Attempts that count for a cool-down: successes (``good``) and failures with their ``category``."""
    good = F.coalesce(F.col("error_bucket").isNull() & F.col("http_status").between(200, 299), F.lit(False))
    return attempts.withColumns({
        "host": F.lower(F.trim("host")), "good": good,
        "category": F.when(~good, cooldown_category(F.col("http_status"), F.col("error_bucket"))),
    }).where(~is_blank(F.col("host")) & (F.col("good") | F.col("category").isNotNull()))


def host_cooldown(attempts: DataFrame, steps: list[int] = V.BACKOFF_MINUTES) -> DataFrame:
    """Cool-down state of every host that has failed; a success clears the count.

    Only timeouts, 408 and 429 count as failures; other errors change nothing.
    """
    rows = cooldown_log(attempts)
    bad = F.col("category").isNotNull()
    counts = trailing_failures(rows, ["host"], "id", F.col("good"), bad)
    last = rows.groupBy("host").agg(
        F.max_by("category", F.when(bad, F.col("id"))).alias("last_error_category"),
        F.max_by("fetched_at", "id").alias("last_attempt_at"),
    ).where(F.col("last_error_category").isNotNull())
    return cooldown_answer(last.join(counts, "host"), steps=steps)


def cooldown_answer(states: DataFrame, *more: str, steps: list[int] = V.BACKOFF_MINUTES) -> DataFrame:
    """When hosts may be asked again, from their failures in a row."""
    wait = F.when(F.col("failures") > 0, backoff_minutes(F.col("failures"), steps))
    return states.select(
        "host", F.col("failures").cast("int").alias("consecutive_failures"), "last_error_category",
        "last_attempt_at", plus_minutes(F.col("last_attempt_at"), wait).alias("next_allowed_at"), *more)


def is_transient(reason: Column, detail: Column) -> Column:
    found = F.coalesce(F.lower(detail).rlike("timeout|http_5|http_429|io_error"), F.lit(False))
    return (reason == "discovery_host_cooldown") | ((reason == "discovery_fetch_failed") & found)


def discovery_log(outcomes: DataFrame) -> DataFrame:
    """Outcomes that count; company cool-down and missing domain leave the state as it is."""
    ignored = F.col("reason_code").isin("discovery_company_cooldown", "discovery_no_domain")
    return outcomes.where(~F.coalesce(ignored, F.lit(False)))


def discovery_cooldown(outcomes: DataFrame, steps: list[int] = V.BACKOFF_MINUTES,
                       robots_days: int = V.ROBOTS_COOLDOWN_DAYS) -> DataFrame:
    """State of every company after its discovery outcomes; a null reason is a success.

    ``outcomes`` has company_id, id, observed_at, reason_code, candidate_url and
    detail.
    """
    rows = discovery_log(outcomes)
    good = F.col("reason_code").isNull()
    counts = trailing_failures(rows, ["company_id"], "id", good, ~good)
    last = rows.groupBy("company_id").agg(F.max_by(
        F.struct("observed_at", "reason_code", "candidate_url", "detail"), "id").alias("x"))
    return discovery_answer(last.join(counts, "company_id").select("company_id", "failures", "x.*"),
                            steps=steps, robots_days=robots_days)


def discovery_answer(states: DataFrame, *more: str, steps: list[int] = V.BACKOFF_MINUTES,
                     robots_days: int = V.ROBOTS_COOLDOWN_DAYS) -> DataFrame:
    """When companies may be tried again, from their last outcome and failures in a row."""
    minutes = F.when(
        F.col("reason_code").isin(V.ROBOTS_DISCOVERY_REASONS), max(1, robots_days) * 1440
    ).when(
        is_transient(F.col("reason_code"), F.col("detail")),
        F.greatest(backoff_minutes(F.col("failures"), steps), F.lit(1)),
    )
    return states.select(
        "company_id", F.col("observed_at").alias("last_attempt_at"),
        F.col("reason_code").alias("last_reason_code"),
        F.col("candidate_url").alias("last_candidate_url"),
        F.col("failures").cast("int").alias("consecutive_failures"),
        plus_minutes(F.col("observed_at"), minutes).alias("next_attempt_at"), *more)


def queue_schedule(outcomes: DataFrame, success_minutes: int = V.SUCCESS_INTERVAL_MINUTES,
                   steps: list[int] = V.BACKOFF_MINUTES, jitter_seconds: int = 0) -> DataFrame:
    """Next run of every outcome: a fixed interval, or a step by the failures before it."""
    after_failure = backoff_minutes(F.col("failures_so_far") + 1, steps)
    minutes = F.when(F.col("succeeded"), max(1, success_minutes)).otherwise(
        F.greatest(after_failure, F.lit(1)))
    extra = F.when(F.col("succeeded"), 0).otherwise(jitter_seconds * 1000)
    due = plus_ms(F.col("finished_at"), minutes.cast("bigint") * 60000 + extra)
    return outcomes.withColumn("next_run_at", due)


def primary_failure(failures: DataFrame, keys: list[str] = ("company_id",)) -> DataFrame:
    """One failure per key: time budget, then robots, host cool-down, fetch, then the first.

    ``failures`` has ``ord``, the order in which they were met.
    """
    reason = F.col("reason_code")
    place = (
        F.when(reason == "discovery_time_budget_exceeded", 0)
        .when(reason.isin(V.ROBOTS_DISCOVERY_REASONS), 1)
        .when(reason.isin("discovery_host_cooldown", "discovery_host_failure_cutoff"), 2)
        .when(reason == "discovery_fetch_failed", 3)
        .otherwise(4)
    )
    names = [c for c in failures.columns if c not in keys]
    picked = failures.groupBy(*keys).agg(
        F.min_by(F.struct(*names), F.struct(place.alias("place"), F.col("ord").alias("ord"))).alias("x"))
    return picked.select(*keys, "x.*")


BREACHES = ["total_request_budget_exceeded", "per_host_request_budget_exceeded",
            "consecutive_error_threshold_exceeded", "rate_limit_threshold_exceeded"]


def budget_breach(attempts: DataFrame, keys: list[str], max_total: int = V.BUDGET_MAX_TOTAL,
                  max_per_host: int = V.BUDGET_MAX_PER_HOST,
                  max_429_rate: float = V.BUDGET_MAX_429_RATE,
                  min_requests: int = V.BUDGET_MIN_REQUESTS_FOR_429,
                  max_errors: int = V.BUDGET_MAX_CONSECUTIVE_ERRORS) -> DataFrame:
    """First attempt of each run at which a limit trips, and which one; 0 turns a limit off.

    ``attempts`` has id (its order), host, http_status and error_bucket. Total and
    per-host limits stop a request before it is made; the others look at its answer.
    """
    error = ~is_blank(F.col("error_bucket")) | (F.col("http_status") == 429) | (F.col("http_status") >= 500)
    # runs go by one column, which is never null, so that joins keep the partitioning of windows
    rows = attempts.select(F.struct(*keys).alias("run"), "id", "host", F.coalesce(error, F.lit(False)).alias("error"),
                           F.coalesce(F.col("http_status") == 429, F.lit(False)).cast("bigint").alias("limited"))
    made, streak = F.col("made"), F.col("made") - F.coalesce("good_at", F.lit(0))
    share = F.col("made_429") / F.greatest(made, F.lit(1))
    trips = {}
    if max_total > 0:
        trips[0] = made > max_total
    if max_errors > 0:
        trips[2] = streak >= max_errors
    if max_429_rate > 0:
        trips[3] = (made >= min_requests) & (share >= max_429_rate)
    hits = []
    if trips:
        kind = F.coalesce(*[F.when(test, place) for place, test in trips.items()])
        counted = running_requests(rows).select("run", "id", kind.alias("kind"))
        hits.append(counted.where("kind IS NOT NULL"))
    if max_per_host > 0:
        named = top_per_group(rows.where("host IS NOT NULL").select("run", "host", "id"), ["run", "host"],
                              [F.asc("id")], max_per_host + 1)
        hits.append(named.groupBy("run", "host").agg(F.max("id").alias("id"), F.count("*").alias("n"))
                    .where(F.col("n") > max_per_host).select("run", "id", F.lit(1).alias("kind")))
    hits = reduce(DataFrame.unionByName, hits) if hits else rows.where("false").select("run", "id", F.lit(0).alias("kind"))
    first = hits.groupBy("run").agg(F.min(F.struct("id", "kind")).alias("first"))
    names = F.array(*[F.lit(n) for n in BREACHES])
    return first.select("run.*", F.col("first.id").alias("attempt_id"), F.get(names, "first.kind").alias("reason"))


def running_requests(rows: DataFrame) -> DataFrame:
    """Rows with ``made`` and ``made_429``, the requests of their run so far, and ``good_at``, the number
    of requests at its last good answer.

    All three go through one scan of blocks: what a block amounts to is its counts and the number at its
    last good answer, counted from its own start; two such values in a row make one of the same kind.
    """
    def window(part, order, end):
        return Window.partitionBy("run", part).orderBy(order).rowsBetween(Window.unboundedPreceding, end)

    def before(table, part, order):
        w = window(part, order, -1) if part else Window.partitionBy("run").orderBy(order).rowsBetween(
            Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("bigint")
        table = table.withColumns({"made_before": F.coalesce(F.sum("made").over(w), zero),
                                   "limited_before": F.coalesce(F.sum("made_429").over(w), zero)})
        return table.withColumn("good_before", F.max(F.col("made_before") + F.col("good_at")).over(w))

    inside = window("block", "id", 0)
    rows = rows.withColumn("block", F.shiftright("id", BLOCK)).withColumns({
        "made": F.count("*").over(inside), "made_429": F.sum("limited").over(inside)})
    rows = rows.withColumn("good_at", F.max(F.when(~F.col("error"), F.col("made"))).over(inside))
    blocks = rows.groupBy("run", "block").agg(*[F.max(c).alias(c) for c in ("made", "made_429", "good_at")])
    blocks = before(blocks.withColumn("upper", F.shiftright("block", BLOCK)), "upper", "block")
    uppers = blocks.groupBy("run", "upper").agg(
        F.sum("made").alias("made"), F.sum("made_429").alias("made_429"),
        F.max(F.col("made_before") + F.col("good_at")).alias("good_at"))
    uppers = before(uppers, None, "upper").select(
        "run", "upper", F.col("made_before").alias("made_up"), F.col("limited_before").alias("limited_up"),
        F.col("good_before").alias("good_up"))
    offsets = blocks.join(uppers, ["run", "upper"]).select(
        "run", "block", (F.col("made_before") + F.col("made_up")).alias("made_before"),
        (F.col("limited_before") + F.col("limited_up")).alias("limited_before"),
        F.coalesce(F.col("good_before") + F.col("made_up"), "good_up").alias("good_before"))
    return rows.join(offsets, ["run", "block"]).select(
        "run", "id", (F.col("made") + F.col("made_before")).alias("made"),
        (F.col("made_429") + F.col("limited_before")).alias("made_429"),
        F.coalesce(F.col("good_at") + F.col("made_before"), "good_before").alias("good_at"))


def request_budget_cut(results: DataFrame, keys: list[str], seq: str, budget: int) -> DataFrame:
    """Each company result with the requests made up to it and whether it was still processed."""
    used = F.coalesce(F.col("request_count"), F.lit(0))
    rows = running(results, keys, seq, {"requests_so_far": used})
    before = F.col("requests_so_far") - used
    open_ = (before < budget) if budget > 0 else F.lit(True)
    return rows.withColumn("processed", open_)


def request_budget_summary(results: DataFrame, keys: list[str], seq: str, budget: int) -> DataFrame:
    """Per run: companies processed, requests made and the reason to stop, if any."""
    rows = request_budget_cut(results, keys, seq, budget).where(F.col("processed"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("processed_count"),
                                  F.max("requests_so_far").alias("request_count_total"))
    spent = (F.col("request_count_total") >= budget) if budget > 0 else F.lit(False)
    return out.withColumn("stop_reason", F.when(spent, F.lit("request_budget_exceeded")))
