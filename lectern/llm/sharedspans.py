"""Long exact spans shared between records.

1. *Anchors.*  Every text is winnowed so that any SPAN characters hold at least one
   anchor, chosen by content alone; equal spans have equal anchors.
2. *Shards.*  Anchors that occur in two or more different texts bring their context
   (all that a span of SPAN characters around them can touch) to the shard of the
   anchor's hash.  Only shared regions are moved, whatever the size of the corpus.
3. *FM-index.*  Each shard cuts its contexts into phrases by the same winnowing on a
   finer scale, builds an FM-index with a wavelet matrix over the phrase sequence and
   streams all contexts through it: backward search in lockstep yields for every
   phrase where a context ends a match, the range of contexts that match it too.
4. *Check.*  Matches are compared character by character around the anchor; spans
   of SPAN characters or more are reported.

Equal texts are one class from the start; classes are expanded at the end.  The contexts
of a hot anchor (more than BLOCK) are grouped by longer keys instead, so that only those
that share nearly a whole span meet; a key that is still hot is split into blocks of BLOCK
contexts, and every pair of blocks is a group of its own.

Null and empty texts and texts shorter than SPAN share nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import codes
from lectern.session import cut

#: Least length of a shared span, in characters.
SPAN = 400
#: Characters an anchor is made of.
GRAM = 64
#: Any so many neighbouring grams hold an anchor; GRAM + WINDOW - 1 = SPAN.
WINDOW = SPAN - GRAM + 1
#: Repeats up to this period carry an anchor at their start only.
PERIOD = 8
#: Context kept left of the anchor's start and right of it.
LEFT, RIGHT = WINDOW, SPAN + 2
#: The finer winnowing that cuts contexts into phrases.
PHRASE_GRAM, PHRASE_WINDOW = 8, 24
#: Characters of a phrase match that make a candidate; each end may lose a phrase.
SURE = SPAN - 2 * (PHRASE_GRAM + PHRASE_WINDOW)
#: Most different contexts of one anchor in one group.
BLOCK = 1500
#: Steps of the longer keys of hot anchors, in characters.
REFINE = 112
#: Contexts in a shard, on average.
SHARD = 6000

_ANCHORS = pa.schema([("th", pa.int64()), ("pos", pa.int32()), ("anchor", pa.int64())])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ths, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for group in codes.chunks(texts):
            flat, starts = codes.codepoints([texts[i] for i in group])
            h = codes.gram_hash(flat, GRAM, PERIOD)
            at = codes.winnow(h, WINDOW)
            owner = np.searchsorted(starts, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ths[np.asarray(group)[owner]]), pa.array((at - starts[owner]).astype(np.int32)), pa.array(h[at].view(np.int64))],
                schema=_ANCHORS,
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """th, text, places (pos, anchor) -> one row per place with its context."""
    for batch in batches:
        th, pos, anchor, n, left, text = [], [], [], [], [], []
        for t, body, places in zip(*(c.to_pylist() for c in batch.columns)):
            for p in places:
                at = p["pos"]
                lo = max(0, at - LEFT)
                th.append(t)
                pos.append(at)
                anchor.append(p["anchor"])
                n.append(p["n"])
                left.append(at - lo)
                text.append(body[lo : at + RIGHT])
        yield pa.RecordBatch.from_pydict(
            {"th": pa.array(th, pa.int64()), "pos": pa.array(pos, pa.int32()), "anchor": pa.array(anchor, pa.int64()), "n": pa.array(n, pa.int64()),
             "left": pa.array(left, pa.int32()), "ctx": pa.array(text, pa.string())}
        )


def _phrases(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut all contexts into phrases: owner, start and hash of each."""
    cuts = codes.winnow(codes.gram_hash(flat, PHRASE_GRAM), PHRASE_WINDOW)
    ends = np.append(starts[1:] - 1, len(flat) - 1)
    at = np.unique(np.concatenate((cuts, starts)))
    owner = np.searchsorted(starts, at, "right") - 1
    stop = np.minimum(np.append(at[1:], len(flat)), ends[owner])
    return owner, at, codes.span_hash(codes.prefix_hash(flat), at, stop)


def _candidates(flat: np.ndarray, starts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of contexts whose phrases agree over SURE characters around the anchor."""
    from lectern.llm.fmindex import FMIndex

    owner, at, h = _phrases(flat, starts)
    k = len(starts)
    ids = np.unique(h, return_inverse=True)[1]
    # one separator symbol per context, all smaller than any phrase; the last ends the sequence
    place = np.arange(len(at)) + owner
    seq = np.zeros(len(at) + k, np.int64)
    seq[place] = ids + k
    last = np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)
    seq[place[last] + 1] = np.arange(k - 1, -1, -1)
    index = FMIndex(seq)
    anchor_at = starts + left
    size = np.diff(np.append(at, len(flat)))
    # a pattern ends with any phrase that ends behind the anchor's gram
    stop = at + size
    whole = np.diff(owner, append=k) == 0
    e = np.flatnonzero(whole & (stop >= (anchor_at + GRAM)[owner] - PHRASE_WINDOW - PHRASE_GRAM))
    row, end = np.arange(len(e)), e.copy()
    lo, hi = np.zeros(len(e), np.int64), np.full(len(e), index.n)
    cur = e.copy()
    pairs_a, pairs_b = [], []
    while len(cur):
        lo, hi = index.extend(seq[place[cur]], lo, hi)
        # long enough and begun before the anchor: report; nothing else there: drop
        ready = (stop[end] - at[cur] >= SURE) & (at[cur] <= anchor_at[owner[cur]] + PHRASE_GRAM + PHRASE_WINDOW)
        many = hi - lo > 1
        out = np.flatnonzero(ready & many)
        if len(out):
            n = hi[out] - lo[out]
            sa = index.sa[np.repeat(lo[out] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            other = owner[np.searchsorted(place, sa)]
            mine = np.repeat(cur[out], n)
            # same place relative to the anchor, else it belongs to another anchor's group
            theirs = np.searchsorted(place, sa)
            aligned = (at[mine] - anchor_at[owner[mine]] == at[theirs] - anchor_at[other]) & (owner[mine] < other)
            code = np.unique(owner[mine][aligned] * k + other[aligned])
            pairs_a.append(code // k)
            pairs_b.append(code % k)
        go = ~ready & many & (at[cur] > starts[owner[cur]])
        cur, end, lo, hi = cur[go] - 1, end[go], lo[go], hi[go]
    if not pairs_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.unique(np.concatenate(pairs_a) * k + np.concatenate(pairs_b))
    return code // k, code % k


def _lengths(flat, anchor_at, starts, ends, a, b) -> tuple[np.ndarray, np.ndarray]:
    """Common characters left of and from the anchor on, for each pair."""
    lefts, rights = [], []
    for s in range(0, len(a), 4096):
        x, y = a[s : s + 4096], b[s : s + 4096]
        for step, out, width in ((-1, lefts, LEFT), (1, rights, RIGHT)):
            off = np.arange(1, width + 1) * -1 if step < 0 else np.arange(width)
            ia, ib = anchor_at[x][:, None] + off, anchor_at[y][:, None] + off
            ok = (ia >= starts[x][:, None]) & (ib >= starts[y][:, None]) & (ia < ends[x][:, None]) & (ib < ends[y][:, None])
            same = ok & (flat[np.clip(ia, 0, len(flat) - 1)] == flat[np.clip(ib, 0, len(flat) - 1)])
            out.append(np.where(same.all(axis=1), width, np.argmin(same, axis=1)))
    return np.concatenate(lefts), np.concatenate(rights)


def _spans(pdf: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """Pairs of contexts of a group with the lengths of their common span around the anchor.

    Equal contexts (same anchor, text and left part) form a class and are indexed once.
    Result: the class of each row, and pairs of classes (a, b) with the lengths (l, r)
    left of and from the anchor on.
    """
    cls = pdf.groupby(["anchor", "left", "ctx"], sort=False).ngroup().to_numpy()
    first = np.flatnonzero(~pd.Series(cls).duplicated().to_numpy())
    texts = pdf["ctx"].to_numpy()[first]
    flat, starts = codes.codepoints(list(texts))
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    left = pdf["left"].to_numpy()[first].astype(np.int64)
    a, b = _candidates(flat, starts, left)
    anchors = pdf["anchor"].to_numpy()[first]
    same = anchors[a] == anchors[b]
    a, b = a[same], b[same]
    if len(a):
        l, r = _lengths(flat, starts + left, starts, starts + lengths, a, b)
        long = l + r >= SPAN
        a, b, l, r = a[long], b[long], l[long], r[long]
    else:
        l = r = np.empty(0, np.int64)
    own = np.flatnonzero(lengths >= SPAN)  # equal contexts share all they have
    a, b = np.concatenate((a, own)), np.concatenate((b, own))
    l, r = np.concatenate((l, left[own])), np.concatenate((r, (lengths - left)[own]))
    return cls, pd.DataFrame({"a": a, "b": b, "l": l, "r": r, "left_a": left[a], "left_b": left[b]})


def _pair_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """th_a < th_b of every two texts of the group that share a span begun at this anchor."""
    cls, spans = _spans(pdf)
    # a span that fills the whole left context holds an earlier anchor and is reported there
    spans = spans[(spans["l"] < LEFT)]
    members = pd.DataFrame({"c": cls, "th": pdf["th"].to_numpy(), "blk": pdf["blk"].to_numpy()})
    members = members.drop_duplicates()
    m = spans[["a", "b"]].merge(members, left_on="a", right_on="c").merge(members, left_on="b", right_on="c", suffixes=("_x", "_y"))
    # two blocks in one group: only pairs across them; one block: all pairs
    two = pdf["blk_lo"].to_numpy()[0] != pdf["blk_hi"].to_numpy()[0] if len(pdf) else False
    if two:
        m = m[m["blk_x"] != m["blk_y"]]
    x, y = m["th_x"].to_numpy(), m["th_y"].to_numpy()
    out = pd.DataFrame({"th_a": np.minimum(x, y), "th_b": np.maximum(x, y)})
    return out[out["th_a"] != out["th_b"]].drop_duplicates()


def _cover_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """th, start, end of the parts of each text that another text of the group shares."""
    cls, spans = _spans(pdf)
    rows = pd.DataFrame({"c": cls, "th": pdf["th"].to_numpy(), "pos": pdf["pos"].to_numpy()})
    several = rows.groupby("c")["th"].nunique()
    spans = spans[(spans["a"] != spans["b"]) | spans["a"].map(several).gt(1)]
    both = pd.concat([spans[["a", "l", "r"]].rename(columns={"a": "c"}), spans[["b", "l", "r"]].rename(columns={"b": "c"})])
    best = both.groupby("c").max().reset_index()
    m = rows.merge(best, on="c")
    return pd.DataFrame({"th": m["th"], "start": (m["pos"] - m["l"]).astype("int32"), "end": (m["pos"] + m["r"]).astype("int32")})


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, th: the class of equal texts that each text of SPAN characters or more belongs to."""
    return documents.where(F.length("text") >= SPAN).select("doc_id", F.xxhash64("text").alias("th"))


def _groups(documents: DataFrame) -> DataFrame:
    """Contexts of all shared anchors with their shard and block."""
    texts = documents.where(F.length("text") >= SPAN).select(F.xxhash64("text").alias("th"), "text", "doc_id")
    anchors = texts.select("th", "text").mapInArrow(_anchors, "th long, pos int, anchor long").distinct()
    shared = anchors.groupBy("anchor").agg(F.count_distinct("th").alias("texts"), F.count("*").alias("n")).where("texts > 1")
    places = anchors.join(shared.select("anchor", "n"), "anchor").groupBy("th")
    places = cut(places.agg(F.collect_list(F.struct("pos", "anchor", "n")).alias("places")))
    one = texts.groupBy("th").agg(F.min("doc_id").alias("doc_id"))
    rep = texts.join(one, ["th", "doc_id"], "left_semi").select("th", "text")
    total, most = places.agg(F.sum(F.size("places")), F.max(F.array_max(F.transform("places", lambda p: p["n"])))).first()
    shards = max(1, (total or 0) // SHARD)
    whole = rep.join(places.hint("merge"), "th").select("th", "text", "places")
    ctx = whole.mapInArrow(_contexts, "th long, pos int, anchor long, n long, left int, ctx string")
    one = [F.lit(0).alias(c) for c in ("blk", "blk_lo", "blk_hi")]
    usual = ctx.where(F.col("n") <= BLOCK).select("th", "pos", "anchor", "left", "ctx", *one, F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return usual if (most or 0) <= BLOCK else usual.unionByName(_refined(whole, ctx.where(F.col("n") > BLOCK)))


def _hot_keys(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """th, pos, key: the longer keys of the places of hot anchors."""
    for batch in batches:
        rows = []
        for t, body, places in zip(*(c.to_pylist() for c in batch.columns)):
            for p in places:
                if p["n"] > block:
                    for i in range((SPAN - GRAM) // REFINE + 1):
                        lo, hi = p["pos"] - i * REFINE, p["pos"] + SPAN - (i + 1) * REFINE
                        if lo >= 0 and hi <= len(body):
                            rows.append((t, p["pos"], xxhash.xxh64_intdigest(f"{p['anchor']} {i} {body[lo:hi]}".encode("utf-8", "surrogatepass")) - (1 << 63)))
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["th", "pos", "key"])


def _refined(whole: DataFrame, ctx: DataFrame) -> DataFrame:
    """The contexts of hot anchors, grouped by more of the text around the anchor.

    A span of SPAN characters that holds the anchor begins between i and i + 1 steps of
    REFINE left of it for some i, so it holds the SPAN - REFINE characters from i steps left
    on: contexts that share a span meet under one of these longer keys, and those that share
    only the anchor don't.  A key that is still hot is shared in most of its length by all
    its contexts, so that its pairs are results; it is split into pairs of blocks.
    """
    keys = whole.mapInArrow(lambda batches, block=BLOCK: _hot_keys(batches, block), "th long, pos int, key long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(sizes.hint("merge"), "key").groupBy("th", "pos").agg(F.collect_list(F.struct("key", "n")).alias("keys"))
    d = ctx.drop("n").join(met.hint("merge"), ["th", "pos"]).select("th", "pos", "anchor", "left", "ctx", F.explode("keys").alias("k"))
    d = d.select("th", "pos", "anchor", "left", "ctx", "k.key", F.ceil(F.col("k.n") / BLOCK).cast("int").alias("blocks"))
    d = d.withColumn("blk", F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int"))
    # a context meets every other block once: its own block's group and one group per other block
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.withColumn("blk_lo", F.least("blk", "other")).withColumn("blk_hi", F.greatest("blk", "other"))
    return d.select("th", "pos", "anchor", "left", "ctx", "blk", "blk_lo", "blk_hi", F.xxhash64("key", "blk_lo", "blk_hi").alias("shard"))


def shared_pairs(documents: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b of all documents (doc_id, text) that share a span of SPAN characters or more."""
    classed = classes(documents)
    between = _groups(documents).groupBy("shard").applyInPandas(_pair_rows, "th_a long, th_b long").distinct()
    a = classed.select(F.col("th").alias("th_a"), F.col("doc_id").alias("x"))
    b = classed.select(F.col("th").alias("th_b"), F.col("doc_id").alias("y"))
    across = between.join(a, "th_a").join(b, "th_b").select("x", "y")
    within = a.join(b, (F.col("th_a") == F.col("th_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionAll(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_spans(documents: DataFrame) -> DataFrame:
    """doc_id, spans (start, end; merged and sorted): what each document shares with any other."""
    classed = classes(documents)
    cover = _groups(documents).groupBy("shard").applyInPandas(_cover_rows, "th long, start int, end int")
    copies = documents.where(F.length("text") >= SPAN).groupBy(F.xxhash64("text").alias("th")).agg(
        F.count("*").alias("n"), F.lit(0).alias("start"), F.max(F.length("text")).alias("end")
    )
    cover = cover.unionAll(copies.where("n > 1").select("th", "start", "end"))
    spans = cover.groupBy("th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("all"))
    # merge overlapping intervals of the sorted list
    merged = F.expr(
        """aggregate(all, cast(array() as array<struct<start:int,end:int>>),
           (acc, s) -> case when size(acc) > 0 and s.start <= element_at(acc, -1).end
             then concat(slice(acc, 1, size(acc) - 1),
                         array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end))))
             else concat(acc, array(named_struct('start', s.start, 'end', s.end))) end)"""
    )
    return classed.join(spans.select("th", merged.alias("spans")), "th").select("doc_id", "spans")


def shared_share(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, shared_chars, share: one row per document, also those that share nothing."""
    d = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    spans = shared_spans(documents).select("doc_id", F.expr("aggregate(spans, 0L, (a, s) -> a + (s.end - s.start))").alias("shared_chars"))
    d = d.join(spans, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return d.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))
