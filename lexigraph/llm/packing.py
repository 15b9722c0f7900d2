"""Filling containers of fixed capacity with items of varying length.

Only (item, length) rows travel. Items are dealt to shards of a bounded number
of items by a hash of their id; each shard is packed on its own, which costs a
few partly filled containers a shard. A shard keeps the available lengths as a
bit set, in which one shift-and-mask finds a pair of lengths with a given sum:
a container takes its largest possible items until its gap is exactly the
length of one item, or the sum of two or of three, and is then full. What no
combination completes goes best-fit into the smallest gap that holds it.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Stock:
    """Items by length, with bit sets of the lengths at hand."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        order = np.argsort(lengths, kind="stable")
        values, starts = np.unique(lengths[order], return_index=True)
        ends = [*starts.tolist(), len(order)][1:]
        self.items = {
            v: order[a:b].tolist()
            for v, a, b in zip(values.tolist(), starts.tolist(), ends, strict=True)
        }
        self.up = sum(1 << v for v in self.items)
        self.down = sum(1 << (capacity - v) for v in self.items)

    def take(self, length: int) -> int:
        items = self.items[length]
        item = items.pop()
        if not items:
            del self.items[length]
            self.up ^= 1 << length
            self.down ^= 1 << (self.capacity - length)
        return item

    def has(self, *lengths: int) -> bool:
        return all(len(self.items.get(x, ())) >= lengths.count(x) for x in set(lengths))

    def largest(self, at_most: int) -> int:
        """The largest length at hand up to a bound, 0 if there is none."""
        return max((self.up & ((2 << at_most) - 1)).bit_length() - 1, 0) if at_most > 0 else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths at hand with this sum, the larger one as large as possible."""
        if total < 2:
            return None
        both = self.up & (self.down >> (self.capacity - total))
        while both:
            a = both.bit_length() - 1
            if 2 * a < total:
                return None
            if self.has(a, total - a):
                return a, total - a
            both ^= 1 << a
        return None

    def combination(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths at hand that fill the gap exactly."""
        if gap in self.items:
            return (gap,)
        top = self.largest(gap)
        if top == 0 or 3 * top < gap:
            return None
        if found := self.pair(gap):
            return found
        a = top
        while a > 0 and 3 * a >= gap:
            if (rest := self.pair(gap - a)) and self.has(a, *rest):
                return (a, *rest)
            a = self.largest(a - 1)
        return None


def pack(lengths: np.ndarray, capacity: int, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item and its place in it; lengths are 1 to capacity.

    A container holds its items with `separator` between any two of them.
    """
    room = capacity + separator  # each item brings a separator, the last one's is free
    stock = _Stock(lengths.astype(np.int64) + separator, room)
    containers: list[list[int]] = []
    leftover: list[list[int]] = []
    gaps: list[int] = []
    while stock.items:
        gap, held = room, []
        while gap > 0:
            if combination := stock.combination(gap):
                held += [stock.take(x) for x in combination]
                gap = 0
            elif largest := stock.largest(gap):
                held.append(stock.take(largest))
                gap -= largest
            else:
                break
        if gap == 0:
            containers.append(held)
        else:
            leftover.append(held)
            gaps.append(gap)
    containers += _best_fit(leftover, gaps, lengths + separator, room)
    where, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int32)
    for c, held in enumerate(containers):
        where[held] = c
        place[held] = np.arange(len(held))
    return where, place


def _best_fit(
    leftover: list[list[int]], gaps: list[int], sizes: np.ndarray, room: int
) -> list[list[int]]:
    """Pack the items of containers that stayed open again, largest item first."""
    items = sorted((i for held in leftover for i in held), key=lambda i: (-sizes[i], i))
    before = len(leftover)
    held: list[list[int]] = []
    open_by_gap: dict[int, list[int]] = defaultdict(list)
    order: list[int] = []
    for i in items:
        size = int(sizes[i])
        at = bisect.bisect_left(order, size)
        if at < len(order):
            gap = order[at]
            c = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del order[at]
        else:
            gap, c = room, len(held)
            held.append([])
        held[c].append(i)
        if left := gap - size:
            if not open_by_gap[left]:
                bisect.insort(order, left)
            open_by_gap[left].append(c)
    return held if len(held) <= before else leftover


def packed(sized: DataFrame, budgets: DataFrame, shard_items: int = 20_000) -> DataFrame:
    """(budget_name, container_id, doc_id, piece_no, place, tokens): a place for every item.

    sized has (doc_id, n_tokens), doc_id unique; budgets (budget_name,
    capacity_tokens, separator_tokens), a few rows. A document longer than a
    capacity is cut into full pieces, which are containers of their own, and
    one last shorter piece, which is packed like any item. Items without tokens
    are in no container, budgets without a positive capacity give no rows, a
    null separator counts as 0.
    """
    shards = max(1, -(-sized.count() // shard_items))
    usable = budgets.where("capacity_tokens > 0").select(
        "budget_name",
        F.col("capacity_tokens").cast("bigint").alias("capacity"),
        F.coalesce(F.col("separator_tokens"), F.lit(0)).cast("bigint").alias("separator"),
    )
    # budgets is a parameter table of a few rows, repeated for every document
    settings = [tuple(r) for r in usable.collect()]
    if not settings:
        settings = [("", 0, 0)]
    each = F.array(
        *[
            F.struct(
                F.lit(n).alias("budget_name"), F.lit(c).alias("capacity"), F.lit(s).alias("separator")
            )
            for n, c, s in settings
        ]
    )
    items = (
        sized.where("n_tokens > 0")
        .select("doc_id", F.col("n_tokens").cast("bigint").alias("n"), F.explode(each).alias("b"))
        .select("doc_id", "n", "b.*")
        .where("capacity > 0")
        .withColumn("full", F.floor(F.col("n") / F.col("capacity")))
    )
    full = items.where("full > 0").select(
        "budget_name",
        "doc_id",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece_no"),
        F.col("capacity").alias("tokens"),
    )
    full = full.select(
        "budget_name",
        F.concat_ws(":", F.lit("full"), "doc_id", "piece_no").alias("container_id"),
        "doc_id",
        F.col("piece_no").cast("int"),
        F.lit(0).alias("place"),
        F.col("tokens").cast("int"),
    )
    rest = items.withColumn("tokens", F.col("n") % F.col("capacity")).where("tokens > 0").select(
        "budget_name",
        "capacity",
        "separator",
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"),
        "doc_id",
        F.col("full").cast("int").alias("piece_no"),
        F.col("tokens").cast("int"),
    )

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", ignore_index=True)
        first = rows.iloc[0]
        where, place = pack(
            rows["tokens"].to_numpy(), int(first["capacity"]), int(first["separator"])
        )
        rows["container_id"] = [f"{first['shard']}:{c}" for c in where]
        rows["place"] = place
        return rows[["budget_name", "container_id", "doc_id", "piece_no", "place", "tokens"]]

    filled = rest.groupBy("budget_name", "shard").applyInPandas(
        pack_shard,
        "budget_name string, container_id string, doc_id bigint, piece_no int, place int, tokens int",
    )
    return full.unionByName(filled)


def container_report(packed_items: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, containers, items, tokens, unused_tokens, unused_share).

    unused_tokens counts what neither items nor the separators between them
    fill. Budgets without items are missing.
    """
    per_container = packed_items.groupBy("budget_name", "container_id").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items")
    )
    named = budgets.select(
        "budget_name",
        F.col("capacity_tokens").cast("bigint").alias("capacity"),
        F.coalesce(F.col("separator_tokens"), F.lit(0)).alias("separator"),
    )
    unused = F.col("capacity") - F.col("tokens") - (F.col("items") - 1) * F.col("separator")
    return (
        per_container.join(named, "budget_name")
        .groupBy("budget_name")
        .agg(
            F.count(F.lit(1)).alias("containers"),
            F.sum("items").alias("items"),
            F.sum("tokens").alias("tokens"),
            F.sum(unused).alias("unused_tokens"),
            (F.sum(unused) / F.sum("capacity")).alias("unused_share"),
        )
    )
