"""Problem 1: items that appear together, by stripes and the log-likelihood ratio.

1. The input is read once; its distinct (basket, item) rows are checkpointed.
2. Items that cannot be part of a result are dropped exactly: a pair in ``min_count`` baskets needs both items in as
   many, and a lift of ``min_lift`` is out of reach for an item found in more than ``1 / min_lift`` of the baskets.
   Each remaining item gets an integer id (checkpointed, so that ids survive a lost executor).
3. Nearly all baskets are one list of at most ``BLOCK`` items. A larger one becomes blocks of about that size; every
   pair of blocks is a row of its own with its own key (basket, i, j), so its pairs are made by many tasks.
4. Every task builds stripes, item -> {neighbour: count}, in memory and emits them when ``FLUSH`` entries are reached.
   The stripe of a frequent item is split into shards by neighbour, so that no task gets an unbounded stripe.
5. Stripes of one item and shard meet in one task, which merges the arrays by key.
6. Counts turn into lift and log-likelihood ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.sizes import attach, small_side
from chronolith.operators.treeagg import tree_aggregate
from chronolith.session import cut

BLOCK = 256
FLUSH = 2_000_000
SHARD_BASKETS = 100_000
#: chi-squared, one degree of freedom, p = 0.001
SIGNIFICANT = 10.828

STRIPE = "item long, shard long, neighbours array<long>, counts array<long>"


def _portions(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows that make about ``FLUSH`` pairs, so that memory does not grow with the size of a batch."""
    made = np.cumsum(np.where(right == 0, left * (left - 1) // 2, left * right))
    group = made // max(FLUSH, 1)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    return [(int(a), int(b)) for a, b in zip(starts, np.r_[starts[1:], len(made)], strict=True)]


def _pairs(items: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i before j, of all pairs inside the slices of ``items``; slices lie ``steps`` apart, those of size 0 make none."""
    begins = np.cumsum(steps) - steps
    left, right = [], []
    for size in np.unique(sizes[sizes > 1]):
        starts = begins[sizes == size]
        i, j = np.triu_indices(size, 1)
        left.append((starts[:, None] + i).ravel())
        right.append((starts[:, None] + j).ravel())
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _across(a_off: np.ndarray, b_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all (i, j), i in the left block and j in the right block of the same row; none if it has no right block."""
    left, right = [], []
    for a0, a1, b0, b1 in zip(a_off[:-1], a_off[1:], b_off[:-1], b_off[1:], strict=True):
        if b0 == b1:
            continue
        left.append(np.repeat(np.arange(a0, a1), b1 - b0))
        right.append(np.tile(np.arange(b0, b1), a1 - a0))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _sum_by_key(first: np.ndarray, second: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((second, first))
    first, second, count = first[order], second[order], count[order]
    start = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    return first[start], second[start], np.add.reduceat(count, start)


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in, stripes out; combined in memory up to ``FLUSH`` entries."""
    held: list[tuple[np.ndarray, ...]] = []
    entries = 0

    def flush() -> Iterator[pa.RecordBatch]:
        a, b, shards = (np.concatenate(x) for x in zip(*held, strict=True))
        shard = b % shards
        key = np.lexsort((b, shard, a))
        a, b, shard = a[key], b[key], shard[key]
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        count = np.diff(np.r_[start, len(a)])
        a, b, shard = a[start], b[start], shard[start]
        stripe = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (shard[1:] != shard[:-1])])
        offsets = pa.array(np.r_[stripe, len(a)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (b, count)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[stripe]), pa.array(shard[stripe]), *lists], names=["item", "shard", "neighbours", "counts"]
        )

    for batch in batches:
        columns = []
        for name in ("left", "right"):
            lists = batch.column(name)
            flat = lists.flatten()
            offsets = np.r_[0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]
            columns.append((np.asarray(flat.field("id")), np.asarray(flat.field("shards")), offsets))
        (left, left_shards, left_off), (right, right_shards, right_off) = columns
        one = right_off[1:] == right_off[:-1]
        for begin, end in _portions(np.diff(left_off), np.diff(right_off)):
            mine = slice(left_off[begin], left_off[end])
            i, j = _pairs(left[mine], np.where(one, np.diff(left_off), 0)[begin:end], np.diff(left_off)[begin:end])
            x, y = _across(left_off[begin : end + 1], right_off[begin : end + 1])
            i, j = i + left_off[begin], j + left_off[begin]
            a, b = np.r_[left[i], left[x]], np.r_[left[j], right[y]]
            shards, other = np.r_[left_shards[i], left_shards[x]], np.r_[left_shards[j], right_shards[y]]
            swap = a > b
            held.append((np.where(swap, b, a), np.where(swap, a, b), np.where(swap, other, shards)))
            entries += len(a)
            if entries >= FLUSH:
                yield from flush()
                held, entries = [], 0
    if entries:
        yield from flush()


def _merge(min_count: int):
    """Stripes in, sorted by item and shard; counts of complete pairs with at least ``min_count`` out."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.empty(0, np.int64),) * 3

        def out(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            keep = n >= min_count
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, n)], names=["a", "b", "n_ab"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(batch.column("neighbours").value_lengths())
            a = np.repeat(np.asarray(batch.column("item")), sizes)
            b = np.asarray(batch.column("neighbours").flatten())
            n = np.asarray(batch.column("counts").flatten())
            a, b, n = _sum_by_key(*(np.concatenate(x) for x in zip(rest, (a, b, n), strict=True)))
            # the last item can go on in the next batch
            end = np.searchsorted(a, a[-1])
            yield out(a[:end], b[:end], n[:end])
            rest = (a[end:], b[end:], n[end:])
        if len(rest[0]):
            yield out(*rest)

    return merge


def log_likelihood(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of the two-by-two table; 0 for independent items."""

    def term(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen * n / (row * column))).otherwise(F.lit(0.0))

    return 2 * (
        term(n_ab, n_a, n_b)
        + term(n_a - n_ab, n_a, n - n_b)
        + term(n_b - n_ab, n - n_a, n_b)
        + term(n - n_a - n_b + n_ab, n - n_a, n - n_b)
    )


def _coded(seen: DataFrame, items: DataFrame) -> DataFrame:
    """``seen`` with the ids of its items; where these are too many to broadcast, only the hot ones are."""
    near = small_side(items)
    return seen.join(near, "item") if near is not items else attach(seen, items, "item", "n", seen.count())


def _block_pairs(coded: DataFrame) -> DataFrame:
    """``left, right`` lists of every two blocks of the large baskets; ``right`` is empty for a block by itself."""
    block = F.pmod(F.xxhash64("entry.id"), F.col("blocks")).cast("int")
    lists = cut(coded.groupBy("basket", block.alias("block"), "blocks").agg(F.collect_list("entry").alias("items")))
    first = lists.select("basket", F.col("items").alias("left"), F.col("block").alias("i"), F.explode(F.expr("sequence(block, cast(blocks as int) - 1)")).alias("j"))
    second = lists.select("basket", F.col("items").alias("right"), F.col("block").alias("j"), F.explode(F.expr("sequence(0, block)")).alias("i"))
    # a block without items has no row: its partner makes no pair with it
    met = first.join(second.hint("merge"), ["basket", "i", "j"])
    return met.select("left", F.when(F.col("i") < F.col("j"), F.col("right")).otherwise(F.array().cast(lists.schema["items"].dataType)).alias("right"))


def cooccurring(
    rows: DataFrame, basket: str, item: str, min_count: int = 10, min_lift: float = 4.0, llr: float = SIGNIFICANT
) -> DataFrame:
    """Pairs of items found together more often than by chance.

    Returns ``item_a, item_b, n_ab, n_a, n_b, n, lift, llr`` with ``item_a < item_b``, for pairs in at least
    ``min_count`` baskets, at ``n_ab * n >= min_lift * n_a * n_b`` and with a ratio of at least ``llr``. ``n`` counts
    the baskets that have an item. An item is counted once a basket, however often its row is repeated; rows with a
    null basket or item are left out; an empty string is an item; extra columns are not looked at. No pair is lost:
    all items, baskets and neighbours are counted.
    """
    raw = rows.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item")).dropna(how="any")
    seen = cut(raw.distinct())
    sizes = cut(seen.groupBy("basket").agg(F.count(F.lit(1)).alias("size")))
    total = sizes.count()
    counts = tree_aggregate(seen, ["item"], {"n": ("count", F.lit(1))})
    items = counts.where((F.col("n") >= min_count) & (F.col("n") * F.lit(min_lift) <= total))
    items = cut(
        items.select(
            "item", "n", F.monotonically_increasing_id().alias("id"), (1 + F.expr(f"n div {SHARD_BASKETS}")).alias("shards")
        )
    )
    coded = _coded(seen, items).select("basket", F.struct("id", "shards").alias("entry"))
    large = cut(sizes.where(F.col("size") > BLOCK).select("basket", (1 + F.expr(f"size div {BLOCK}")).alias("blocks")))
    some = not large.isEmpty()
    large = small_side(large)
    nothing = F.array().cast("array<struct<id:bigint,shards:bigint>>")
    plain = coded.join(large, "basket", "left_anti") if some else coded
    lists = plain.groupBy("basket").agg(F.collect_list("entry").alias("left")).where(F.size("left") > 1)
    stripes = lists.select("left", nothing.alias("right")).mapInArrow(_stripes, STRIPE)
    if some:
        stripes = stripes.unionByName(_block_pairs(coded.join(large, "basket")).mapInArrow(_stripes, STRIPE))
    merged = (
        stripes.repartition("item", "shard")
        .sortWithinPartitions("item", "shard")
        .mapInArrow(_merge(min_count), "a long, b long, n_ab long")
    )
    names = items.select("id", "item", "n")
    first, second = (small_side(names).toDF(*(f"{c}_{side}" for c in ("id", "item", "n"))) for side in "ab")
    pairs = merged.join(first, F.col("a") == F.col("id_a")).join(second, F.col("b") == F.col("id_b"))
    swap = F.col("item_a") > F.col("item_b")
    n = F.lit(float(total))
    return (
        pairs.select(
            F.when(swap, F.col("item_b")).otherwise(F.col("item_a")).alias("item_a"),
            F.when(swap, F.col("item_a")).otherwise(F.col("item_b")).alias("item_b"),
            "n_ab",
            F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
            F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
            F.lit(total).cast("long").alias("n"),
        )
        .where(F.col("n_ab").cast("double") * n >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
        .withColumn("lift", F.col("n_ab") * n / (F.col("n_a").cast("double") * F.col("n_b")))
        .withColumn("llr", log_likelihood(*(F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))))
        .where(F.col("llr") >= llr)
    )
