"""Tables kept current by a stream: each micro-batch rewrites the parts its keys fall in.

The epoch of a micro-batch goes with its merge, so running an epoch again, as after
a restart, leaves the table as it is.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rolecall.operators.merges import NEW, close_out_postings, merge_postings, merge_table
from rolecall.operators.state import frontier_backoff
from rolecall.session import sized
from rolecall.sources.keyed import KeyedTable


def keep_current(stream: DataFrame, table: KeyedTable, fold, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Start a query that merges every micro-batch by ``fold(rows, batch)``."""
    return _started(stream, lambda batch, epoch: table.merge(batch, fold, epoch), checkpoint, trigger)


def _started(stream: DataFrame, step, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def posting_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, safe_crawls_of=None,
                   trigger: dict | None = None) -> StreamingQuery:
    """Merge batches of postings, then close out what their safe crawls did not see.

    The table is cut by company_id. ``safe_crawls_of(batch)`` gives company_id and
    crawl_run_id of the crawls of a batch that went through; without it nothing is
    closed out.
    """
    def step(batch, epoch):
        # of the whole batch, as a part of the table is merged with its own rows only
        safe = None if safe_crawls_of is None else sized(safe_crawls_of(batch))

        def fold(postings, rows):
            merged = merge_postings(postings, rows)
            return merged if safe is None else close_out_postings(merged, safe)

        table.merge(batch, fold, epoch)

    return _started(stream, step, checkpoint, trigger)


def backoff_stream(stream: DataFrame, table: KeyedTable, checkpoint: str,
                   trigger: dict | None = None) -> StreamingQuery:
    """Keep the back-off state of hosts; attempts arrive in the order of their id over batches.

    The state of a host is a column of the host table, and each batch is folded in
    blocks, so a host that fills a batch is not gathered. ``processors`` has the
    form for attempts that arrive in any order.
    """
    def fold(hosts, batch):
        new = frontier_backoff(batch, hosts).withColumn("ord", F.lit(0))
        return merge_table(hosts, new, ["host"], {
            "backoff_state": NEW, "last_status_bucket": NEW, "next_allowed_at": NEW})

    return keep_current(stream, table, fold, checkpoint, trigger)
