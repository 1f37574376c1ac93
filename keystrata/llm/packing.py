"""Filling fixed-capacity containers: vector best-fit over tokens, items and attention cost.

An item longer than a container is cut into full containers and one remainder; nothing else is cut. The
remainders and the shorter items are packed in blocks: items are hashed to blocks of bounded size and a
block is packed by one task. What lies in containers that a block left loose is gathered from all blocks
and packed once more, so the loss does not grow with the number of blocks.

A container has three capacities: tokens, number of items, and attention cost (the sum of squared
lengths, the work of attention that stays within items). The limit of the attention cost is a share of
what one item of full length costs; an item that alone exceeds it gets a container to itself. Items are
taken longest first. Among the open containers that keep every constraint the one is chosen whose
residual vector, each part relative to its capacity, has the smallest weighted norm after the item
("norm"), or whose residuals have the largest weighted dot product with the item's demands ("dot"). Equal
scores go to the older container.

Items without length (null and empty texts) take no space: they get a row without container.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.sources.scratch import written

#: Expected items of a block; the only bound on a task's group.
BLOCK_ITEMS = 4096
#: Kinds of containers that are put on the items at a time.
KINDS_AT_A_TIME = 1000
#: Weights of tokens, item count and attention cost in the score.
WEIGHTS = (1.0, 0.02, 0.02)
#: Share of the attention cost of one item of full length that several items may cost together.
ATTENTION_SHARE = 0.95
#: Tokens of a container for every item it may hold, and items that it may hold in any case.
TOKENS_PER_ITEM, LEAST_ITEMS = 64, 4
#: Containers that a block leaves less full than this are packed again with those of the other blocks.
LOOSE = 0.95


def best_fit(sizes: np.ndarray, capacity: int, items: int, attention: float, weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Container number of each size; sizes are at most ``capacity`` and come longest first.

    The second array says, for each size, whether an open container with room for its tokens was refused for its
    items (1), for its attention cost (2) or both (3).
    """
    n = len(sizes)
    out, refused = np.empty(n, np.int64), np.zeros(n, np.int64)
    demand = np.stack([sizes, np.ones(n, np.int64), sizes * sizes], 1).astype(np.float64)
    cap = np.array([capacity, items, attention], np.float64)
    w = np.asarray(weights, np.float64)
    free = np.empty((max(1, n), 3))  # residuals of the open containers
    name = np.empty(max(1, n), np.int64)
    opened = used = 0
    for i in range(n):
        if used and i % 64 == 0:  # close what not even the shortest item fits into
            keep = (free[:used] >= demand[-1]).all(1)
            k = int(keep.sum())
            free[:k], name[:k] = free[:used][keep], name[:used][keep]
            used = k
        rest = free[:used] - demand[i]
        fit = rest >= 0
        fits = fit.all(1)
        if used:
            refused[i] = (fit[:, 0] & ~fit[:, 1]).any() + 2 * (fit[:, 0] & ~fit[:, 2]).any()
        if fits.any():
            score = ((rest / cap) ** 2) @ w if rule == "norm" else -((free[:used] / cap) @ (w * demand[i] / cap))
            j = int(np.argmin(np.where(fits, score, np.inf)))
            free[j] = rest[j]
            out[i] = name[j]
        else:
            free[used], name[used] = cap - demand[i], opened
            out[i] = opened
            used += 1
            opened += 1
    return out, refused


def pack(items: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "n_tokens", rule: str = "norm", block_items: int = BLOCK_ITEMS, attention_share: float = ATTENTION_SHARE, tokens_per_item: int = TOKENS_PER_ITEM) -> DataFrame:
    """Pack every item into containers of every capacity.

    ``items``: unique ``key`` and ``size`` in tokens; ``containers``: ``container_id, capacity_tokens``
    (rows without a positive capacity are skipped, repeated rows count once). A container of several items
    holds at most ``capacity / tokens_per_item`` (at least ``LEAST_ITEMS``) of them, at an attention cost
    of at most ``attention_share`` of its capacity squared. Returns, per container kind, ``container_id,
    capacity_tokens, bin_id, key, piece_no, token_start, n_tokens, refused``: one row per piece. ``bin_id``
    is unique per kind; it is null for items of size 0 or null. ``refused``: see ``best_fit``.
    """
    kinds = containers.select("container_id", "capacity_tokens").filter("capacity_tokens > 0 and container_id is not null").distinct()
    sized = items.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    each = _with_kinds(sized, kinds)
    zero = F.lit(0).cast("bigint")
    columns = ["container_id", "capacity_tokens", "bin_id", "key", "piece_no", "token_start", "n_tokens", "refused"]
    none = each.filter("size = 0").select("container_id", "capacity_tokens", F.lit(None).cast("string").alias("bin_id"), "key", zero.alias("piece_no"), zero.alias("token_start"), zero.alias("n_tokens"), zero.alias("refused"))
    over = each.filter("size >= capacity_tokens").withColumn("piece_no", F.explode(F.sequence(zero, F.floor(F.col("size") / F.col("capacity_tokens")) - 1)))
    full = over.select("container_id", "capacity_tokens", F.concat(F.lit("w"), F.col("key").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("bin_id"), "key", "piece_no", (F.col("piece_no") * F.col("capacity_tokens")).alias("token_start"), F.col("capacity_tokens").alias("n_tokens"), zero.alias("refused"))
    rest = each.withColumn("n_tokens", F.col("size") % F.col("capacity_tokens")).filter("n_tokens > 0").withColumn("piece_no", F.floor(F.col("size") / F.col("capacity_tokens")))
    rest = rest.select("container_id", "capacity_tokens", "key", "piece_no", (F.col("piece_no") * F.col("capacity_tokens")).alias("token_start"), "n_tokens", zero.alias("refused"))

    def blocks(rows: DataFrame, count: int) -> DataFrame:
        return rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, math.ceil(count / block_items)))))

    def filled(rows: DataFrame, label: str) -> DataFrame:
        kind_types = {f.name: f.dataType.simpleString() for f in rows.schema}
        schema = ", ".join(f"{c} {kind_types.get(c, 'string')}" for c in columns) + ", loose boolean"

        def fill(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["n_tokens", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
            capacity, sizes = int(group["capacity_tokens"].iat[0]), group["n_tokens"].to_numpy(np.int64)
            bins, refused = best_fit(sizes, capacity, max(LEAST_ITEMS, capacity // tokens_per_item), attention_share * capacity * capacity, rule=rule)
            loose = np.bincount(bins, sizes)[bins] < LOOSE * capacity
            names = [f"{label}{group['block'].iat[0]}-{b}" for b in bins.tolist()]
            return group.assign(bin_id=names, refused=group["refused"] | refused, loose=loose)[[*columns, "loose"]]

        return rows.groupBy("container_id", "block").applyInPandas(fill, schema)

    first = written(filled(blocks(rest, sized.count()), "b"), "packed")
    loose = first.filter("loose").drop("bin_id", "loose")
    most = loose.groupBy("container_id").count().agg(F.max("count")).first()[0] or 0
    again = filled(blocks(loose, most), "c")
    parts = [full, first.filter("not loose"), again, none]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).withColumnRenamed("key", key)


def _with_kinds(sized: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every item once per container kind; the kinds are put on each item as an array, so many at a time."""
    rows = kinds.orderBy("container_id", "capacity_tokens").collect()
    kind = kinds.schema["container_id"].dataType
    if not rows:
        return sized.limit(0).select(F.lit(None).cast(kind).alias("container_id"), F.lit(None).cast("bigint").alias("capacity_tokens"), "key", "size")
    parts = []
    for i in range(0, len(rows), KINDS_AT_A_TIME):
        some = F.array(*[F.struct(F.lit(r[0]).cast(kind).alias("container_id"), F.lit(r[1]).cast("bigint").alias("capacity_tokens")) for r in rows[i : i + KINDS_AT_A_TIME]])
        parts.append(sized.select("key", "size", F.explode(some).alias("k")).select("k.container_id", "k.capacity_tokens", "key", "size"))
    return reduce(DataFrame.unionByName, parts)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per container kind: containers used, tokens in them, share of the space that is filled.

    ``by_items`` and ``by_attention`` count the pieces for which a container with room for their tokens was
    refused for its number of items, or for its attention cost.
    """
    held = packed.filter("bin_id is not null")
    bins = held.groupBy("container_id", "capacity_tokens", "bin_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"), F.sum(F.col("refused").bitwiseAND(1)).alias("by_items"), F.sum(F.shiftright("refused", 1)).alias("by_attention"))
    filled = F.sum("tokens") / (F.count("*") * F.max("capacity_tokens"))
    return bins.groupBy("container_id", "capacity_tokens").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.max("items").alias("most_items"), filled.alias("filled"), F.sum("by_items").alias("by_items"), F.sum("by_attention").alias("by_attention"))
