"""Filling fixed-capacity containers with items: best-fit decreasing, exact at any scale.

Best-fit decreasing treats items of one size alike, so its whole run is determined by
the histogram of sizes, which the capacity bounds.  The run is made once on that
histogram: a segment tree over the remaining capacities finds the tightest open class
of containers in logarithmic time, and a class is filled in bulk.  The result, a plan
of (size, ranks) -> (containers), is looked up by every item with its rank among the
items of its size; ranks are numbered without gathering a size in one task.

An item larger than the capacity is cut into full pieces, each in a container of its
own, and a rest that is packed like any other item.  Items of no size (null or empty
text) come out with a null container.  Repeated rows are items of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.sequence import rank_in_group
from lectern.session import cut

#: Where the public tokenizer files are; a parameter of :func:`count_tokens`.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Split pattern published for the byte-level BPE of the vocabulary above (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens of each document (doc_id, text); 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens long")


class Tightest:
    """Segment tree over 0..capacity that finds the smallest marked value from a given one up."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.marked = bytearray(2 * self.leaves)

    def mark(self, value: int, on: bool) -> None:
        i = value + self.leaves
        self.marked[i] = on
        while i > 1:
            i >>= 1
            self.marked[i] = self.marked[2 * i] or self.marked[2 * i + 1]

    def at_least(self, value: int) -> int:
        """The smallest marked value >= value, or -1."""
        i = value + self.leaves
        if self.marked[i]:
            return value
        while i > 1:  # up to the first subtree to the right that holds a mark
            if not i & 1 and self.marked[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.leaves:
            i = 2 * i if self.marked[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over {size: count}: rows (size, first rank, first container, items a container).

    A row covers the ranks up to the next row of its size.  Also the number of containers.
    """
    tree = Tightest(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs (first container, number)
    rows, opened = [], 0

    def put(remaining: int, run: tuple[int, int]) -> None:
        if remaining and run[1]:
            if not open_.get(remaining):
                open_[remaining] = []
                tree.mark(remaining, True)
            open_[remaining].append(run)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.at_least(size)
            if room < 0:
                room, run = capacity, (opened, -(-left // (capacity // size)))
                opened += run[1]
            else:
                run = open_[room].pop()
                if not open_[room]:
                    tree.mark(room, False)
            each = room // size
            rows.append((size, rank, run[0], each))
            filled = min(run[1], left // each)
            part = left - filled * each if filled < run[1] else 0
            put(room - each * size, (run[0], filled))
            used = filled
            if part:
                put(room - part * size, (run[0] + filled, 1))
                used += 1
            put(room, (run[0] + used, run[1] - used))
            rank += filled * each + part
            left -= filled * each + part
    return rows, opened


def pack(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, doc_id, piece, start_token, tokens, container: every item for every spec.

    ``sizes`` has doc_id and tokens, ``specs`` spec_id and capacity_tokens (a row per
    capacity; null and non-positive capacities are left out).
    """
    capacity = {r[0]: r[1] for r in specs.where("capacity_tokens > 0").select("spec_id", "capacity_tokens").collect()}
    spark = sizes.sparkSession
    schema = "spec_id long, doc_id long, piece int, start_token long, tokens long, container string"
    if not capacity:
        return spark.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in sorted(capacity.items())]))
    items = sizes.select("doc_id", "tokens", each.alias("s")).select("doc_id", "tokens", "s.*")
    # pieces that fill a container alone; an item of exactly the capacity is one of the plan's
    full = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("long")
    items = items.withColumn("full", full).withColumn("rest", F.col("tokens") - F.col("full") * F.col("capacity"))
    counts: dict[int, dict[int, int]] = {s: {} for s in capacity}
    for s, rest, n in items.where("rest > 0").groupBy("spec_id", "rest").agg(F.count("*")).collect():
        counts[s][rest] = n  # at most `capacity` rows a spec
    made = {s: plan(counts[s], c)[0] for s, c in capacity.items()}
    flat = sorted((s, *row) for s, rows in made.items() for row in rows)
    keys = {}
    for s, size, *_ in flat:
        keys.setdefault((s, size), len(keys))
    table = np.array([(keys[s, size] << 40 | rank, rank, first, n) for s, size, rank, first, n in flat], np.int64).reshape(-1, 4)
    sent = spark.sparkContext.broadcast((keys, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = sent.value
        for batch in batches:
            spec, rest = batch.column("spec_id").to_pylist(), batch.column("rest").to_pylist()
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            key = np.fromiter((keys[x] for x in zip(spec, rest)), np.int64, len(spec))
            row = table[np.searchsorted(table[:, 0], key << 40 | rank, "right") - 1] if len(spec) else table[:0]
            box = row[:, 2] + (rank - row[:, 1]) // np.maximum(row[:, 3], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("spec_id"), batch.column("doc_id"), batch.column("full").cast(pa.int32()), batch.column("start_token"), batch.column("rest"), pa.array([f"shared-{b}" for b in box], pa.string())],
                ["spec_id", "doc_id", "piece", "start_token", "tokens", "container"],
            )

    ranked = rank_in_group(items.where("rest > 0"), ["spec_id", "rest"], ["doc_id"], "rank")
    ranked = ranked.select("spec_id", "doc_id", "full", (F.col("full") * F.col("capacity")).alias("start_token"), "rest", "rank")
    rests = ranked.mapInArrow(place, schema)
    pieces = items.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)))
    pieces = pieces.select(
        "spec_id", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("tokens"),
        F.concat_ws("-", F.lit("own"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string")).alias("container"),
    )
    none = items.where("tokens = 0").select("spec_id", "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), "tokens", F.lit(None).cast("string").alias("container"))
    return rests.unionByName(pieces).unionByName(none)


def packed_documents(documents: DataFrame, specs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Count the tokens of all documents once, then pack them for every spec."""
    return pack(cut(count_tokens(documents, path)), specs)


def containers(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, container, items, used, unused of every container."""
    used = packed.where("container is not null").groupBy("spec_id", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("used"))
    cap = specs.select(F.col("spec_id").cast("long").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity"))
    return used.join(cap, "spec_id").select("spec_id", "container", "items", "used", (F.col("capacity") - F.col("used")).alias("unused"))
