"""Evaluation texts leaking into training text, found by spaced-seed hashing.

Fixed masks over SPAN consecutive word tokens ignore selected positions.  The masked
windows of the test texts are hashed into an index; every window of every document
is hashed with the same masks and looked up; around each hit the two texts are
compared token by token, which yields the exact run and the overlap that tolerates
substitutions.

The test side is processed in blocks of about BLOCK windows, one after the other, each
block against all documents, so what is held by the driver and the executors has a fixed
bound, whatever the number of test texts.

In a text that repeats itself an overlap is followed from the first places of the repeated
windows, where it is longest.

Null and empty texts on either side give no rows; repeated rows and items give their
own rows; a test text shorter than SPAN tokens cannot be found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import codes
from lectern.session import cut

#: Tokens a window spans.
SPAN = 12
#: Positions that count; the first needs every token but a few in the middle.
MASKS = ("111011011111", "110110110111", "101101111011")
#: All positions count: tells windows apart that a mask takes for one.
WHOLE = "1" * SPAN
#: Test windows in one index block (at 3 masks about 50 MB).
BLOCK = 1_000_000
#: A tolerant overlap ends before so many mismatches within SPAN tokens.
DROP = 4

_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("part", pa.string()), ("doc_token", pa.int32()), ("item_token", pa.int32()),
     ("exact_run", pa.int32()), ("overlap", pa.int32()), ("matched", pa.int32())]
)
_DDL = "doc_id long, item_id long, part string, doc_token int, item_token int, exact_run int, overlap int, matched int"


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of SPAN tokens under a mask."""
    n = len(hashes) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, on in enumerate(mask):
        if on == "1":
            out += hashes[i : i + n] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1)
    return codes.mix(out)


def first_of_each(owner: np.ndarray, window: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` whose window didn't occur at one of them before in the same text."""
    if not len(at):
        return at
    order = np.lexsort((at, window[at], owner[at]))
    o, w = owner[at][order], window[at][order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (w[1:] != w[:-1])))
    return np.sort(at[order[new]])


class Index:
    """The masked windows of one block of test texts; a window that a text repeats stands for its first place."""

    def __init__(self, items: list[tuple[int, str, str]]):
        self.items = [(i, part) for i, part, _ in items]
        flat, starts = codes.codepoints([t.lower() for _, _, t in items])
        at, self.hashes = codes.tokens(flat)
        owner = np.searchsorted(starts, at, "right") - 1
        self.first = np.searchsorted(owner, np.arange(len(items)))
        self.owner = owner
        self.seeds, self.places, self.maybe = [], [], []
        window = seeds(self.hashes, WHOLE)
        whole = np.flatnonzero(owner[: len(window)] == owner[SPAN - 1 :]) if len(window) else np.empty(0, np.int64)
        whole = first_of_each(owner, window, whole)
        for mask in MASKS:
            h = seeds(self.hashes, mask)
            order = whole[np.argsort(h[whole], kind="stable")]
            self.seeds.append(h[order])
            self.places.append(order)
            bits = np.zeros(1 << 20, bool)
            bits[h[whole] >> np.uint64(44)] = True
            self.maybe.append(bits)

    def hits(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (token of the document chunk, token of the index) where a masked window agrees.

        Windows that a document repeats are looked up at their first place only, so that
        repetitive texts on both sides don't meet in all pairs of places.
        """
        left, right, window = [], [], seeds(hashes, WHOLE)
        for mask, sorted_seeds, places, maybe in zip(MASKS, self.seeds, self.places, self.maybe):
            h = seeds(hashes, mask)
            pos = np.flatnonzero(maybe[h >> np.uint64(44)] & (owner[: len(h)] == owner[SPAN - 1 :])) if len(h) else np.empty(0, np.int64)
            pos = first_of_each(owner, window, pos)
            lo, hi = np.searchsorted(sorted_seeds, h[pos], "left"), np.searchsorted(sorted_seeds, h[pos], "right")
            n = hi - lo
            pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
            left.append(np.repeat(pos, n))
            right.append(places[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(n) else places[:0])
        return np.concatenate(left), np.concatenate(right)


def extend(a: np.ndarray, b: np.ndarray, at: int) -> tuple[int, int, int, int]:
    """(start, longest exact run, overlap, matches) of two aligned token rows around ``at``.

    The overlap grows from ``at`` both ways and stops before DROP mismatches fall
    within SPAN tokens; it begins and ends with a match.
    """
    same = a == b

    def reach(step: int) -> int:
        i, last, bad = at, at, []
        while 0 <= i < len(same):
            if same[i]:
                last = i
            else:
                bad = [x for x in bad if abs(x - i) < SPAN] + [i]
                if len(bad) >= DROP:
                    break
            i += step
        return last

    lo, hi = reach(-1), reach(1) + 1
    part = same[lo:hi].astype(np.int8)
    edge = np.diff(part, prepend=0, append=0)
    runs = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    return lo, int(runs.max(initial=0)), hi - lo, int(part.sum())


def search(index: Index, doc_ids: list, texts: list) -> Iterator[tuple]:
    """Leaks of the index into the given documents."""
    for group in codes.chunks(texts):
        flat, starts = codes.codepoints([texts[i].lower() for i in group])
        at, hashes = codes.tokens(flat)
        if len(hashes) < SPAN:
            continue
        owner = np.searchsorted(starts, at, "right") - 1
        left, right = index.hits(hashes, owner)
        begin = np.searchsorted(owner, np.arange(len(group)))
        end = np.searchsorted(owner, np.arange(len(group)), "right")
        done: dict[tuple[int, int, int], int] = {}
        for i in np.lexsort((left, right - left)):
            p, q = int(left[i]), int(right[i])
            doc, item = int(owner[p]), int(index.owner[q])
            if done.get((doc, item, p - q), -1) >= p + SPAN:
                continue  # inside an overlap that was followed already
            b0, b1 = int(begin[doc]), int(end[doc])
            q0, q1 = int(index.first[item]), int(index.first[item + 1]) if item + 1 < len(index.first) else len(index.hashes)
            back, ahead = min(p - b0, q - q0), min(b1 - p, q1 - q)
            lo, run, overlap, matched = extend(hashes[p - back : p + ahead], index.hashes[q - back : q + ahead], back)
            done[doc, item, p - q] = p - back + lo + overlap
            item_id, part = index.items[item]
            yield doc_ids[group[doc]], item_id, part, p - back + lo - b0, q - back + lo - q0, run, overlap, matched


def _blocks(parts: DataFrame) -> tuple[DataFrame, int]:
    """The test texts with the number of their block, and the number of blocks.

    A text goes to a block by the hash of its item; blocks hold about BLOCK windows.
    """
    total = parts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // (2 * BLOCK))
    return parts.withColumn("block", F.pmod(F.xxhash64("item_id", "part"), F.lit(max(blocks, 1)))), blocks


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per overlap of a document (doc_id, text) with a test text (item_id, prompt, solution).

    With more than one block, each block is searched for and written before the next
    index is made, so only one index is held at a time.
    """
    parts = items.select("item_id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("text")) for p in ("prompt", "solution")])).alias("p"))
    blocked, blocks = _blocks(parts.select("item_id", "p.*").where("length(text) >= 12"))
    texts = documents.select("doc_id", "text").where("length(text) >= 12")
    out = None
    for block in range(blocks):
        rows = blocked.where(F.col("block") == block).select("item_id", "part", "text").collect()
        if not rows:
            continue
        index = documents.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in sorted(rows, key=lambda r: (r[0], r[1], r[2]))]))

        def run(batches, index=index):
            for batch in batches:
                found = list(search(index.value, batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                columns = list(zip(*found)) or [[] for _ in _RESULT]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)

        part = texts.mapInArrow(run, _DDL)
        if blocks > 1:
            part = cut(part)
            index.destroy()
        out = part if out is None else out.unionAll(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], _DDL)
