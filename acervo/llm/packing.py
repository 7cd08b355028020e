"""Filling fixed-capacity containers: minimum bin slack over the histogram of lengths.

How items fill containers depends on their lengths only, and there are at most `capacity` of
those. The lengths are counted in Spark; the plan is made on that histogram: the largest length
left opens a container, a bitset subset-sum over the remaining multiset picks what fills it
closest to capacity, and the pattern is repeated as often as the counts allow. The items then
find their container by their rank among the items of equal length, computed without gathering
a length in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.tokens import VOCABULARY, token_counts
from acervo.operators.ranking import bucket_rank
from acervo.runtime import materialise

#: Items in one bucket of the distributed ranks.
BUCKET = 100_000


def closest(counts: dict[int, int], room: int) -> Counter:
    """The multiset of available lengths with the largest sum not above room. Larger lengths are
    preferred among equal sums."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left:
            take = min(take, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, Counter()
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[size] += take
            at -= size * take
    return chosen


def fill(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(lengths in a container, number of such containers), in the order they are filled."""
    left, plan = {s: n for s, n in histogram.items() if n > 0}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        pattern = closest({s: n for s, n in left.items() if n}, capacity - largest)
        left[largest] += 1
        pattern[largest] += 1
        times = min(left[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        plan.append((pattern, times))
    return plan


def _places(plan: list[tuple[Counter, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, items per container and first container of each run."""
    runs: dict[int, list] = {}
    used: Counter = Counter()
    container = 0
    for pattern, times in plan:
        for size, n in pattern.items():
            runs.setdefault(size, []).append((used[size], n, container))
            used[size] += n * times
        container += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for s, r in runs.items()}


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, path: str = VOCABULARY) -> DataFrame:
    """(key, doc_tokens, piece, piece_tokens, container): one row per item, that is a whole text, or
    the consecutive pieces of a text that alone exceeds the capacity (all but the last one full).

    Null and empty texts have one row with null container. Repeated rows are items of their own.
    Other columns are ignored; no rows give no containers.
    """
    sized = materialise(token_counts(df, text, (key,), path).withColumnRenamed("n_tokens", "doc_tokens"), "tokens")
    last = F.greatest(F.ceil(F.col("doc_tokens") / capacity) - 1, F.lit(0))
    pieces = sized.select(key, "doc_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.withColumn("piece_tokens", F.least(F.col("doc_tokens") - F.col("piece") * capacity, F.lit(capacity).cast("long")))
    histogram = {r[0]: r[1] for r in pieces.groupBy("piece_tokens").count().collect()}  # at most capacity + 1 rows
    places = _places(fill({s: n for s, n in histogram.items() if s}, capacity))
    buckets = max(1, -(-sum(histogram.values()) // BUCKET))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    ranked = bucket_rank(rows, ["piece_tokens"], "bucket", [F.col(key), F.col("piece")]).drop("bucket")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column(3).to_numpy(), batch.column(4).to_numpy() - 1
            found = np.full(len(sizes), -1, dtype=np.int64)
            for size in np.unique(sizes):
                if size:
                    at, (starts, each, first) = sizes == size, places[int(size)]
                    run = np.searchsorted(starts, ranks[at], "right") - 1
                    found[at] = first[run] + (ranks[at] - starts[run]) // each[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, mask=found < 0)], names=[key, "doc_tokens", "piece", "piece_tokens", "container"])

    kind = dict(sized.dtypes)[key]
    return ranked.select(key, "doc_tokens", "piece", "piece_tokens", F.col("rank").cast("long")).mapInArrow(place, f"`{key}` {kind}, doc_tokens long, piece long, piece_tokens long, container long")
