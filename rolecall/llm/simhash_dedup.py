"""SimHash near-duplicate classes by a self-join of binary tries.

A fingerprint has 64 bits. Two fingerprints that differ in at most ``max_bits`` bits agree in one of
``max_bits + 1`` blocks of bits, so each is filed once per block, rotated to begin with that block,
under the node of a binary trie that the block leads to. Below such a node the trie is joined with
itself: pairs of nodes go down together, count the bits in which their paths differ, and end where
the count passes the budget. A node with many members is split eight levels at a time into pairs of
its descendants before any task walks it, so no task holds a large node.

Equal fingerprints are folded first, and each task hands on only a spanning forest of the links it
finds, so neither a large group of copies nor one of near copies is written out as pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm import words

BITS = 64
SHINGLE = 3
MAX_BITS = 2
#: Members of a pair of nodes that one task walks at most, and pairs it holds at once.
NODE = 1 << 16
FRONTIER = 1 << 21
LEVELS = 8


def _fingerprint(text: bytes, size: int) -> int:
    """Majority of each bit over the hashes of all shingles."""
    parts = text.lower().split()  # bytes: A-Z only, and the contract's white space
    if not parts:
        return 0
    size = min(size, len(parts))
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(parts) - size + 1].tolist()
    stops = ends[size - 1:].tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        found = [digest(joined[a:b], 42) for a, b in zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)])]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every whole text; zero where there is no word."""
    def run(batches):
        for batch in batches:
            values = [_fingerprint((t or "").encode(), shingle) for t in
                      (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fingerprint"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fingerprint long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """First bit, from the top, and width of each block."""
    n = max_bits + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _node_pairs(prints: DataFrame, max_bits: int, node: int) -> DataFrame:
    """Members of the pairs of nodes to walk: pair (low, high), depth, differing bits, key, side."""
    blocks = _blocks(max_bits)
    turned = [F.struct(
        F.lit(i).alias("block"), F.lit(width).alias("depth"),
        F.expr(f"shiftleft(fingerprint, {start}) | shiftrightunsigned(fingerprint, {BITS - start})"
               if start else "fingerprint").alias("key"))
        for i, (start, width) in enumerate(blocks)]
    top = F.expr("shiftrightunsigned(key, 64 - depth)")
    members = (prints.select(F.explode(F.array(*turned)).alias("t")).select("t.*")
               .select("block", top.alias("low"), top.alias("high"), "depth",
                       F.lit(0).alias("bits"), "key", F.lit(0).alias("side")))
    masks = [m for m in range(1 << LEVELS) if m.bit_count() <= max_bits]
    done, pair = None, ["block", "low", "high"]
    while True:
        # nodes less than eight levels above the keys are small as they are
        sizes = members.where(F.col("depth") <= BITS - LEVELS).groupBy(*pair).count()
        large = words.stored(sizes.where(F.col("count") > node).select(*pair), "simhash-nodes")
        if large.isEmpty():
            return members if done is None else done.unionByName(members)
        members = words.stored(members, "simhash-members")
        small = members.join(large, pair, "left_anti")
        done = small if done is None else done.unionByName(small)
        child = F.expr(f"shiftrightunsigned(key, 64 - depth - {LEVELS}) & {(1 << LEVELS) - 1}")
        split = (members.join(large, pair).withColumn("own", child)
                 .withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
                 .withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
                 .withColumn("bits", F.col("bits") + F.bit_count("mask"))
                 .where(F.col("bits") <= max_bits))
        # below one node, the pair of two children is kept in order; between two nodes the sides stay
        same = F.col("low") == F.col("high")
        first = F.when(same, F.col("own") <= F.col("other")).otherwise(F.col("side") == 0)
        members = split.select(
            "block",
            (F.shiftleft("low", LEVELS) + F.when(first, F.col("own")).otherwise(F.col("other"))).alias("low"),
            (F.shiftleft("high", LEVELS) + F.when(first, F.col("other")).otherwise(F.col("own"))).alias("high"),
            (F.col("depth") + LEVELS).alias("depth"), "bits", "key",
            F.when(first, 0).otherwise(1).alias("side"))


def walk(keys: np.ndarray, left: np.ndarray, right: np.ndarray, depth: np.ndarray, bits: np.ndarray,
         max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Join tries: places in ``keys`` of all pairs of keys that differ in ``max_bits`` bits or fewer.

    A pair of nodes is two ranges of ``keys`` (rows of ``left`` and ``right``: first, stop), the depth
    of both and the bits in which their paths differ. Keys of a range are sorted and share its path.
    """
    todo = [(left, right, depth, bits)]
    ones: dict[int, np.ndarray] = {}
    while todo:
        left, right, depth, bits = todo.pop()
        if len(depth) > FRONTIER:
            half = len(depth) // 2
            todo += [tuple(x[half:] for x in (left, right, depth, bits)),
                     tuple(x[:half] for x in (left, right, depth, bits))]
            continue
        single = (left[:, 1] - left[:, 0] == 1) & (right[:, 1] - right[:, 0] == 1)
        a, b = left[single, 0], right[single, 0]
        near = (a != b) & (np.bitwise_count(keys[a] ^ keys[b]) <= max_bits)
        yield a[near], b[near]
        left, right, depth, bits = (x[~single] for x in (left, right, depth, bits))
        if not len(depth):
            continue
        level = int(depth.min())
        now = depth == level
        if not now.all():
            todo.append(tuple(x[~now] for x in (left, right, depth, bits)))
            left, right, depth, bits = (x[now] for x in (left, right, depth, bits))
        if level == BITS:  # all bits are used: keys are distinct, so these are two equal ones of a repeat
            continue
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)])
        count, same = ones[level], (left[:, 0] == right[:, 0])
        cut_left = left[:, 1] - (count[left[:, 1]] - count[left[:, 0]])
        cut_right = right[:, 1] - (count[right[:, 1]] - count[right[:, 0]])
        sides = lambda x, cut: (np.stack([x[:, 0], cut], 1), np.stack([cut, x[:, 1]], 1))
        (l0, l1), (r0, r1) = sides(left, cut_left), sides(right, cut_right)
        new = [(l0, r0, bits, None), (l1, r1, bits, None), (l0, r1, bits + 1, None), (l1, r0, bits + 1, ~same)]
        parts = []
        for x, y, used, only in new:
            keep = (x[:, 0] < x[:, 1]) & (y[:, 0] < y[:, 1]) & (used <= max_bits)
            keep &= True if only is None else only
            keep &= ~((x[:, 0] == y[:, 0]) & (x[:, 1] - x[:, 0] == 1))  # one key with itself
            parts.append((x[keep], y[keep], used[keep]))
        x, y, used = (np.concatenate(z) for z in zip(*parts))
        todo.append((x, y, np.full(len(used), level + 1), used))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least node it is connected with; the same components, fewer links."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == label).all():
            break
        label = new
    below = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[below], nodes[label[below]]


def _walks(max_bits: int, pairs: bool):
    blocks = _blocks(max_bits)

    def links(rows: dict[str, np.ndarray]):
        """Links between the fingerprints of whole pairs of nodes, sorted by pair, side and key."""
        key = rows["key"].view(np.uint64)
        change = np.zeros(len(key), bool)
        change[0] = True
        for name in ("block", "low", "high"):
            change[1:] |= rows[name][1:] != rows[name][:-1]
        begin = np.flatnonzero(change)
        stop = np.append(begin[1:], len(key))
        second = np.concatenate([[0], np.cumsum(rows["side"])])
        cut = stop - (second[stop] - second[begin])
        own = rows["low"][begin] == rows["high"][begin]
        left = np.stack([begin, np.where(own, stop, cut)], 1)
        right = np.stack([np.where(own, begin, cut), stop], 1)
        keep = np.where(own, stop - begin > 1, (cut > begin) & (stop > cut))
        depth, bits = rows["depth"][begin][keep].astype(np.int64), rows["bits"][begin][keep].astype(np.int64)
        for a, b in walk(key, left[keep], right[keep], depth, bits, max_bits):
            if not len(a):
                continue
            block = rows["block"][a]
            start = np.array([s for s, _ in blocks], np.uint64)[block]
            back = lambda k: np.where(start == 0, k, (k >> start) | (k << (np.uint64(BITS) - start)))
            x, y = back(key[a]), back(key[b])
            if pairs:  # a pair that agrees in several blocks is reported in the first of them
                first = np.ones(len(x), bool)
                for i, (s, w) in enumerate(blocks):
                    mask = np.uint64(((1 << w) - 1) << (BITS - s - w))
                    first &= (block <= i) | (((x ^ y) & mask) != 0)
                yield np.minimum(x[first], y[first]), np.maximum(x[first], y[first])
            else:
                yield x, y

    def run(batches):
        names = ("block", "low", "high", "depth", "bits", "key", "side")
        held: list[dict] = []
        count = 0

        def emit(rows):
            found = list(links(rows))
            if found:
                x, y = (np.concatenate(z) for z in zip(*found))
                x, y = (x, y) if pairs else forest(x, y)
                for at in range(0, len(x), 1 << 16):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(z[at:at + (1 << 16)].view(np.int64), pa.int64()) for z in (x, y)], ["a", "b"])

        def joined():
            return {n: np.concatenate([h[n] for h in held]) for n in names}

        for batch in batches:
            held.append({n: batch.column(n).to_numpy() for n in names})
            count += batch.num_rows
            if count >= NODE:
                rows = joined()
                last = len(rows["key"]) - 1  # the last pair may go on in the next batch
                begin = max((int(np.flatnonzero(rows[n] != rows[n][last])[-1]) + 1
                             if (rows[n] != rows[n][last]).any() else 0) for n in ("block", "low", "high"))
                if begin:
                    yield from emit({n: rows[n][:begin] for n in names})
                held, count = [{n: rows[n][begin:] for n in names}], last + 1 - begin
        if count:
            yield from emit(joined())
    return run


def _walked(prints: DataFrame, max_bits: int, pairs: bool, node: int) -> DataFrame:
    pair = ["block", "low", "high"]
    return (_node_pairs(prints, max_bits, node).repartition(*pair)
            .sortWithinPartitions(*pair, "side", "key").mapInArrow(_walks(max_bits, pairs), "a long, b long"))


def fingerprint_pairs(prints: DataFrame, max_bits: int = MAX_BITS, node: int = NODE) -> DataFrame:
    """All pairs (a < b as unsigned) of different fingerprints that differ in ``max_bits`` bits or fewer."""
    distinct = words.stored(prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct(), "simhash")
    return _walked(distinct, max_bits, True, node)


def components(links: DataFrame) -> DataFrame:
    """node, root: one node of each connected component, for every node of a link (a, b).

    Each round sends every node to that of its neighbours and itself whose hash is least, and keeps the
    links between their images. The order is as good as random, so each round takes away a share of the
    nodes whatever the shape of the graph, until no link is left.
    """
    def ranked(name):
        return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("node"))

    rounds, links = [], words.stored(links, "links")
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("next")))
        step = words.stored(both.groupBy("node").agg(F.min(ranked("next")).alias("next"))
                            .select("node", F.least("next", ranked("node"))["node"].alias("next")), "steps")
        rounds.append(step)
        links = words.stored(
            links.join(step.select(F.col("node").alias("a"), F.col("next").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("next").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds.pop().withColumnRenamed("next", "root")
    while rounds:
        later = found.select(F.col("node").alias("next"), "root")
        found = words.stored(rounds.pop().join(later, "next", "left")
                             .select("node", F.coalesce("root", "next").alias("root")), "roots")
    return found


def simhash_classes(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    node: int = NODE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links, the row's own included. Null and
    empty texts have fingerprint zero and are linked like any other. A row without doc_id gets its
    class; a class without any doc_id has a null component_id. Repeated rows stay. Other columns are
    left out.
    """
    prints = words.stored(fingerprints(docs, shingle), "fingerprints")
    firsts = words.stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash")
    roots = components(_walked(firsts.select("fingerprint"), max_bits, False, node))
    rooted = firsts.join(roots, firsts["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = words.stored(rooted.join(least, "root").select("fingerprint", "component_id"), "classes")
    return (prints.join(classes, "fingerprint")
            .select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"))


def op1_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
