"""Schemas that drift between files: change reports and one consistent table.

1. *Shapes.*  Every file of JSON records is reduced to the tree of its fields with types
   and counts; no value leaves the task that read it.
2. *Pairs.*  Each file meets the file before it in its stream.  Equal names are matched;
   what is left is undecided only if something went and something came.
3. *Sketches.*  For undecided fields alone, a second pass keeps mergeable minima of the
   hashed values and words, and a third one finds out which short values the old fields
   show in KNOWN_FILES files or more anywhere.
4. *Script.*  A minimum-cost assignment over all fields that went and came gives renames
   and moves, the rest is deleted and added: the edit script of the two trees.

:func:`unified` composes the scripts along each stream and compiles each file's own
mapping into the projection that reads it into one table.

Nulls and odd input: a null or unparsable payload is ignored, a null field counts as
absent, an empty table gives empty results, repeated rows change nothing.  What is sent
to the driver is bounded by the number of field names.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.sequence import lag_in_order
from lectern.session import cut

#: Slots of the value sketch and of the word sketch of a field; longest value that is known again by itself.
SLOTS, SHORT = 48, 40
#: Files in which a field shows a value, to know the field again by it.
KNOWN_FILES = 3
#: Similarity from which two fields of one parent may be one field under two names, and fields of one name under two parents.
SAME_CONTENT, SAME_MOVED = 0.34, 0.5
#: Price of a move beside 1 - similarity.
MOVE = 0.2
#: Entries of a task's counters before they are handed on.
FLUSH = 300_000
#: File numbers of a stream that are composed in one task.
SPAN = 1024

_SCALAR = {str: "string", bool: "boolean", int: "number", float: "number"}
_EMPTY = ...  # a singleton also in other processes


def kind_of(value) -> str:
    """JSON type of a non-null value: string, number, boolean, array or object."""
    return _SCALAR.get(type(value)) or ("array" if isinstance(value, list) else "object")


def walk(value, path: str) -> Iterator[tuple[str, str, object]]:
    """All non-null fields below ``value`` as (path, type, scalar); arrays are no level.

    Elements of an array of scalars come as values of the array's own path.
    """
    for name, child in value.items():
        if child is None:
            continue
        at = f"{path}.{name}" if path else name
        kind = kind_of(child)
        yield at, kind, child if kind in ("string", "number", "boolean") else _EMPTY
        todo = [child] if kind in ("array", "object") else []
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                yield from walk(x, at)
            elif isinstance(x, list):
                todo.extend(reversed(x))
            elif x is not None and kind == "array":
                yield at, kind, x


def parse(payload) -> dict | None:
    """The record, or None where the line doesn't parse to an object."""
    if not isinstance(payload, str):
        return None
    try:
        record = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _frame(rows: list[tuple], types: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(types)).astype(types)


def _shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per file and field: how many values and how many characters."""
    types = {"file_id": "int64", "path": "object", "kind": "object", "n": "int64", "chars": "int64"}
    counts: dict[tuple, list[int]] = {}
    for batch in batches:
        for file_id, payload in zip(batch["file_id"], batch["payload"]):
            record = parse(payload)
            for path, kind, value in walk(record, "") if record else ():
                c = counts.setdefault((file_id, path, kind), [0, 0])
                c[0] += 1
                if value is not _EMPTY:
                    c[1] += len(_text(value))
        if len(counts) > FLUSH:
            yield _frame([(*k, *c) for k, c in counts.items()], types)
            counts.clear()
    yield _frame([(*k, *c) for k, c in counts.items()], types)


def profiles(records: DataFrame) -> DataFrame:
    """One row per file: file_id, stream_id, file_seq, fields (path, kind, n, chars).

    ``records`` needs file_id, stream_id, file_seq and payload.  Sums only, combined in
    the tasks, so a file of any size gives a few rows; the list per file is bounded by
    its number of fields.
    """
    records = records.where(F.col("file_id").isNotNull())
    parts = records.select("file_id", "payload").mapInPandas(_shape, "file_id long, path string, kind string, n long, chars long")
    cells = parts.groupBy("file_id", "path", "kind").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    fields = cells.groupBy("file_id").agg(F.collect_list(F.struct("path", "kind", "n", "chars")).alias("fields"))
    files = records.groupBy("file_id").agg(F.min("stream_id").alias("stream_id"), F.min("file_seq").cast("long").alias("file_seq"))
    return files.join(fields.hint("merge"), "file_id", "left")


class Node:
    """A field of one file's schema."""

    __slots__ = ("name", "path", "kind", "n", "chars", "values", "words", "shown", "children")

    def __init__(self, path: str, kind: str = "", n: int = 0, chars: int = 0):
        self.path, self.name = path, path.rpartition(".")[2]
        self.kind, self.n, self.chars = kind, n, chars
        self.values: dict[int, int] = {}
        self.words: dict[int, int] = {}
        self.shown: set[int] = set()
        self.children: dict[str, Node] = {}

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())

    def below(self) -> Iterator[Node]:
        """The node and all under it."""
        yield self
        for c in self.children.values():
            yield from c.below()


def tree(fields, cells=None) -> Node:
    """The schema tree of a profile, with the sketches of ``cells``; a field of several types gets its most frequent one."""
    best: dict[str, Node] = {}
    for f in sorted(fields if fields is not None else (), key=lambda f: (f["path"], -f["n"], f["kind"])):
        if f["path"] not in best:
            best[f["path"]] = Node(f["path"], f["kind"], f["n"], f["chars"])
    for c in cells if cells is not None else ():
        node = best.get(c["path"])
        if node is not None and node.kind == c["kind"]:
            (node.values if c["slot"] < SLOTS else node.words)[c["slot"]] = c["h"]
            if c["short"]:
                node.shown.add(c["h"])
    root = Node("", "object")
    for path in sorted(best):
        parent = best.get(path.rpartition(".")[0], root) if "." in path else root
        parent.children[best[path].name] = best[path]
    return root


def _words_of(name: str) -> set[str]:
    return {w.lower()[:6] for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)} - {"of", "the", "used"}


def _shared(a: dict[int, int], b: dict[int, int]) -> float:
    if not a or not b:
        return 0.0
    return sum(b.get(s) == h for s, h in a.items()) / min(len(a), len(b))


def same_content(old: Node, new: Node, known: dict[str, set[int]]) -> float:
    """How likely two fields of one type are the same content under two names, 0 to 1."""
    if old.kind != new.kind:
        return 0.0
    if old.kind == "object":
        names = old.children.keys() & new.children.keys()
        if not names:
            return 0.0
        inner = sum(same_content(old.children[n], new.children[n], known) for n in names) / len(names)
        return (len(names) / len(old.children.keys() | new.children.keys()) + inner) / 2
    values = _shared(old.values, new.values)
    if old.kind == "boolean":
        values = 0.0
    usual = known.get(old.path, set())
    seen = [v in usual or v in old.shown for v in new.shown]
    vocabulary = sum(seen) / len(seen) if seen and len(new.shown) >= len(new.values) * 0.9 else 0.0
    a, b = _words_of(old.name), _words_of(new.name)
    names = len(a & b) / len(a | b) if a | b else 0.0
    la, lb = old.chars / max(old.n, 1), new.chars / max(new.n, 1)
    shape = (min(la, lb) + 1) / (max(la, lb) + 1)
    words = _shared(old.words, new.words)
    content = max(values, 0.9 * vocabulary, 0.8 * words if shape > 0.4 else 0.0)
    return min(1.0, max(content, 0.6 * names * shape ** 0.5) + 0.2 * names)


def assign(cost: list[list[float]]) -> list[int]:
    """Minimum-cost assignment of rows to columns (at least as many columns as rows)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], col = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[col] = True
            row, step, nxt = match[col], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[row - 1][j - 1] - u[row] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, col
                    if least[j] < step:
                        step, nxt = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col], col = match[way[col]], way[col]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def unmatched(old: Node, new: Node) -> tuple[list[tuple[Node, Node]], list[tuple[str, Node]], list[tuple[str, Node]]]:
    """(retyped pairs, fields that went, fields that came) of two trees; both lists with the parent's path.

    A name on both sides is one field, whatever its type; objects on both sides are compared inside.
    """
    retyped, gone, came, todo = [], [], [], [(old, new)]
    while todo:
        a, b = todo.pop()
        for name in sorted(a.children.keys() & b.children.keys()):
            x, y = a.children[name], b.children[name]
            if x.kind == y.kind:
                todo.append((x, y))
            else:
                retyped.append((x, y))
        gone += [(a.path, a.children[n]) for n in sorted(a.children.keys() - b.children.keys())]
        came += [(a.path, b.children[n]) for n in sorted(b.children.keys() - a.children.keys())]
    return retyped, gone, came


def undecided(old: Node, new: Node) -> tuple[set[str], set[str]]:
    """Paths of both sides whose content decides between a rename or move and a removal with an addition."""
    _, gone, came = unmatched(old, new)
    olds, news = set(), set()
    for p, x in gone:
        for q, y in came:
            if x.kind == y.kind and (p == q or x.name == y.name):
                olds |= {n.path for n in x.below()}
                news |= {n.path for n in y.below()}
    return olds, news


def edit_script(old: Node, new: Node, known: dict[str, set[int]]) -> tuple[float, list[tuple[str, str, str]]]:
    """Cost and script of the cheapest edit between two schema trees.

    A field keeps its name for free and changes type for 1 plus what is inside.  All
    fields that went and came enter one minimum-cost assignment: a rename under the same
    parent costs 1 - similarity, a move of a name to another parent MOVE more, no
    counterpart the price of a deletion and an insertion.  Only the topmost changed
    object is reported; a move also shows as its removal and addition.
    """
    retyped, gone, came = unmatched(old, new)
    cost = float(sum(x.size() + y.size() - 1 for x, y in retyped))
    script = [("retyped", x.path, y.path) for x, y in retyped]
    close = [[same_content(x, y, known) if p == q or x.name == y.name else 0.0 for q, y in came] for p, x in gone]
    price = [
        [1 - s if p == q and s >= SAME_CONTENT else 1 - s + MOVE if p != q and s >= SAME_MOVED else 9.0 for (q, _), s in zip(came, row)] + [1.0] * len(gone)
        for (p, _), row in zip(gone, close)
    ]
    left, right = set(range(len(gone))), set(range(len(came)))
    for i, j in enumerate(assign(price) if gone and came else ()):
        if j < len(came) and price[i][j] < 9.0:
            cost += price[i][j]
            if gone[i][0] == came[j][0]:
                left.discard(i)
                right.discard(j)
                script.append(("renamed", gone[i][1].path, came[j][1].path))
            else:
                cost -= gone[i][1].size() + came[j][1].size()
                script.append(("moved", gone[i][1].path, came[j][1].path))
    cost += sum(gone[i][1].size() for i in left) + sum(came[j][1].size() for j in right)
    script += [("removed", gone[i][1].path, "") for i in sorted(left)] + [("added", "", came[j][1].path) for j in sorted(right)]
    return cost, script


def _wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """file_id, path, old: the undecided fields of each pair of files, under the file that holds them."""
    for batch in batches:
        rows = []
        for file_id, prev_id, new, old in zip(batch["file_id"], batch["prev_id"], batch["fields"], batch["old_fields"]):
            olds, news = undecided(tree(old), tree(new))
            rows += [(prev_id, p, True) for p in olds] + [(file_id, p, False) for p in news]
        yield _frame(rows, {"file_id": "int64", "path": "object", "old": "bool"})


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slot minima of the hashed values and words of the wanted fields of each file."""
    types = {"file_id": "int64", "path": "object", "kind": "object", "slot": "int32", "h": "int64", "short": "bool"}
    minima: dict[tuple, tuple[int, bool]] = {}
    for batch in batches:
        for file_id, payload, paths in zip(batch["file_id"], batch["payload"], batch["paths"]):
            record, wanted = parse(payload), set(paths)
            for path, kind, value in walk(record, "") if record else ():
                if value is _EMPTY or path not in wanted:
                    continue
                text = _text(value)
                items = [(0, text)]
                if kind == "string" and " " in text:
                    items += [(SLOTS, w) for w in set(text.split())]
                for base, item in items:
                    h = _hash(item)
                    key = (file_id, path, kind, base + h % SLOTS)
                    if key not in minima or h < minima[key][0]:
                        minima[key] = (h, base == 0 and len(text) <= SHORT)
        if len(minima) > FLUSH:
            yield _frame([(*k, *v) for k, v in minima.items()], types)
            minima.clear()
    yield _frame([(*k, *v) for k, v in minima.items()], types)


def known_values(records: DataFrame, paths: set[str]) -> DataFrame:
    """path, h: the short values that a field of ``paths`` shows in KNOWN_FILES files or more, over all files.

    A task hands on at most KNOWN_FILES files of a value, which is enough to count up to there.
    """
    types = {"path": "object", "h": "int64", "file_id": "int64"}

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], set[int]] = {}
        for batch in batches:
            for file_id, payload in zip(batch["file_id"], batch["payload"]):
                record = parse(payload)
                for path, _, value in walk(record, "") if record else ():
                    if value is _EMPTY or path not in paths:
                        continue
                    text = _text(value)
                    if len(text) <= SHORT:
                        files = seen.setdefault((path, _hash(text)), set())
                        if len(files) < KNOWN_FILES:
                            files.add(file_id)
            if len(seen) > FLUSH:
                yield _frame([(*k, f) for k, files in seen.items() for f in files], types)
                seen.clear()
        yield _frame([(*k, f) for k, files in seen.items() for f in files], types)

    found = records.where(F.col("file_id").isNotNull()).select("file_id", "payload").mapInPandas(met, "path string, h long, file_id long")
    return found.distinct().groupBy("path", "h").agg(F.count("*").alias("n")).where(F.col("n") >= KNOWN_FILES).select("path", "h")


def changes(records: DataFrame) -> DataFrame:
    """file_id, change, old_field, new_field, cost: the edit script of each file against its predecessor.

    The predecessor is the file with the preceding file_seq of the stream.  change is
    added, removed, renamed, retyped or moved (moved rows repeat a removed and an
    added one).  cost is the edit distance of the two files.
    """
    prof = cut(profiles(records))
    order = lag_in_order(prof.select("stream_id", "file_seq", "file_id"), "stream_id", "file_seq", "file_id", "prev_id")
    order = order.where("prev_id is not null").select("file_id", "prev_id")
    earlier = prof.select(F.col("file_id").alias("prev_id"), F.col("fields").alias("old_fields"))
    # the size of a checkpoint is not known to the planner, so no side is left to be broadcast
    pairs = prof.select("file_id", "fields").join(order.hint("merge"), "file_id")
    pairs = cut(pairs.join(earlier.hint("merge"), "prev_id").select("file_id", "prev_id", "fields", "old_fields"))
    wanted = cut(pairs.mapInPandas(_wanted, "file_id long, path string, old boolean").distinct())
    old_paths = {r["path"] for r in wanted.where("old").select("path").distinct().collect()}
    asked = wanted.groupBy("file_id").agg(F.collect_set("path").alias("paths"))
    sketched = records.select("file_id", "payload").join(asked.hint("merge"), "file_id")
    sketched = sketched.mapInPandas(_sketch, "file_id long, path string, kind string, slot int, h long, short boolean")
    sketched = sketched.groupBy("file_id", "path", "kind", "slot").agg(F.min(F.struct("h", "short")).alias("m"))
    cells = cut(sketched.groupBy("file_id").agg(F.collect_list(F.struct("path", "kind", "slot", "m.h", "m.short")).alias("cells")))
    # the short values under names that came, looked up among all values of the fields that went
    came = wanted.where("not old").groupBy("file_id").agg(F.collect_set("path").alias("news"))
    went = wanted.where("old").groupBy(F.col("file_id").alias("prev_id")).agg(F.collect_set("path").alias("olds"))
    shown = cells.join(came.hint("merge"), "file_id").select("file_id", "news", F.explode("cells").alias("c"))
    shown = shown.where(F.col("c.short") & F.array_contains("news", F.col("c.path"))).select("file_id", F.col("c.h").alias("h")).distinct()
    usual = shown.join(known_values(records, old_paths).hint("merge"), "h").join(order.hint("merge"), "file_id").join(went.hint("merge"), "prev_id")
    usual = usual.where(F.array_contains("olds", F.col("path"))).groupBy("file_id").agg(F.collect_list(F.struct("path", "h")).alias("usual"))
    full = pairs.join(cells.hint("merge"), "file_id", "left")
    full = full.join(cells.select(F.col("file_id").alias("prev_id"), F.col("cells").alias("old_cells")).hint("merge"), "prev_id", "left")
    full = full.join(usual.hint("merge"), "file_id", "left")

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, new, old, cells, old_cells, met in zip(*(batch[c] for c in ("file_id", "fields", "old_fields", "cells", "old_cells", "usual"))):
                known: dict[str, set[int]] = {}
                for x in met if met is not None else ():
                    known.setdefault(x["path"], set()).add(x["h"])
                cost, script = edit_script(tree(old, old_cells), tree(new, cells), known)
                rows += [(file_id, *s, cost) for s in script]
            yield pd.DataFrame(rows, columns=["file_id", "change", "old_field", "new_field", "cost"])

    return full.select("file_id", "fields", "old_fields", "cells", "old_cells", "usual").mapInPandas(
        diff, "file_id long, change string, old_field string, new_field string, cost double"
    )


def canonical_names(renames: list[tuple[str, str, int]]) -> dict[str, str]:
    """Field path -> one path for all streams, from (old, new, files) counts of first names and their renames.

    Names joined by renames form one component, the most frequent joins first; its
    canonical name is the one that is most often the older one, then the first by name.
    """
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    older: Counter = Counter()
    for old, new, n in sorted(renames, key=lambda r: (-r[2], r[0], r[1])):
        older[old] += n
        older[new] -= n
        a, b = find(old), find(new)
        if a != b:
            parent[b] = a
    groups: dict[str, list[str]] = defaultdict(list)
    for name in older:
        groups[find(name)].append(name)
    return {name: min(names, key=lambda x: (-older[x], x)) for names in groups.values() for name in names}


def canonical(path: str, names: dict[str, str]) -> str:
    """The path under which a first name goes in all streams, its parents' renames included."""
    parent, dot, leaf = names.get(path, path).rpartition(".")
    return f"{canonical(parent, names)}.{leaf}" if dot else leaf


def compose(memory: dict[str, str], paths: list[str], renames: dict[str, str]) -> dict[str, str]:
    """The first name of each path of a file; ``memory`` (path -> first name so far) is carried on.

    ``renames`` leads from the new to the old path.  What is inside a renamed object
    goes with it.  A path that comes back after a gap keeps what it was called before.
    """
    back: dict[str, str] = {}
    now: dict[str, str] = {}
    for p in sorted(paths):
        parent, dot, leaf = p.rpartition(".")
        old = renames.get(p)
        if old is None:
            old = f"{back.get(parent, parent)}.{leaf}" if dot else p
        back[p] = old
        now[p] = memory.get(old, old)
    memory.update(now)
    return now


def file_fields(records: DataFrame, script: DataFrame) -> DataFrame:
    """file_id, path, kind, n, first: every field of every file with its first name in the stream.

    Scripts compose, so each block of SPAN file numbers is composed by itself, then one
    row per block along the stream.
    """
    prof = profiles(records).select("file_id", "stream_id", "file_seq", F.floor(F.col("file_seq") / SPAN).cast("long").alias("block"), "fields")
    renamed = script.where("change in ('renamed', 'moved')").groupBy("file_id").agg(F.collect_list(F.struct("new_field", "old_field")).alias("renames"))
    files = cut(prof.where("fields is not null").join(renamed.hint("merge"), "file_id", "left"))

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        memory: dict[str, str] = {}
        rows = []
        for stream, block, file_id, fields, renames in zip(*(pdf.sort_values(["file_seq", "file_id"])[c] for c in ("stream_id", "block", "file_id", "fields", "renames"))):
            now = compose(memory, [f["path"] for f in fields], {r["new_field"]: r["old_field"] for r in renames} if renames is not None else {})
            rows += [(stream, block, file_id, f["path"], f["kind"], f["n"], now[f["path"]]) for f in fields]
        rows += [(stream, block, None, p, None, None, q) for p, q in memory.items()]
        return pd.DataFrame(rows, columns=["stream_id", "block", "file_id", "path", "kind", "n", "first"]).astype({"file_id": "Int64", "n": "Int64"})

    def of_stream(pdf: pd.DataFrame) -> pd.DataFrame:
        memory: dict[str, str] = {}
        rows = []
        for (stream, block), own in pdf.groupby(["stream_id", "block"], sort=True):
            rows += [(stream, block, q, memory.get(q, q)) for q in dict.fromkeys(own["first"])]
            memory.update({p: memory.get(q, q) for p, q in zip(own["path"], own["first"])})
        return pd.DataFrame(rows, columns=["stream_id", "block", "first", "origin"])

    within = cut(files.groupBy("stream_id", "block").applyInPandas(of_block, "stream_id long, block long, file_id long, path string, kind string, n long, first string"))
    ends = within.where("file_id is null").select("stream_id", "block", "path", "first")
    starts = ends.groupBy("stream_id").applyInPandas(of_stream, "stream_id long, block long, first string, origin string")
    out = within.where("file_id is not null").join(starts.hint("merge"), ["stream_id", "block", "first"])
    return out.select("file_id", "path", "kind", "n", F.col("origin").alias("first"))


def as_text(value) -> str | None:
    """A retyped value as text: an object with a text or name gives that, an array of strings is joined."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, dict) and set(value) & {"text", "name"}:
        return as_text(value.get("text", value.get("name")))
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return "\n".join(value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _number(value) -> float | None:
    try:
        return float(as_text(value))
    except (TypeError, ValueError, OverflowError):
        return None


def _truth(value) -> bool | None:
    return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(as_text(value)).strip().lower())


def column_names(paths: list[str], taken: set[str]) -> dict[str, str]:
    """A column name for each path: its last part, the whole path where that is not unique."""
    last = Counter(p.rpartition(".")[2].lower() for p in paths)
    out, used = {}, set(taken)
    for p in sorted(paths):
        leaf = p.rpartition(".")[2]
        name = leaf if last[leaf.lower()] == 1 and leaf.lower() not in taken else p.replace(".", "_")
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out[p] = name
    return out


def unified(records: DataFrame, script: DataFrame, rows_of: str = "response.results") -> DataFrame:
    """One row per record and element of the array ``rows_of``, whatever file it came from.

    ``records`` has record_id, file_id, stream_id, file_seq and payload; ``script`` is the
    output of :func:`changes`.  Every field of every file has a column, named and typed by
    its first name and its most frequent type over all files; arrays and retyped objects
    come as text.  A value that its column's type can't hold is kept in ``other_values``
    under the column's name.  Records without elements give one row with a null
    result_rank; unparsable lines give none.
    """
    fields = cut(file_fields(records, script))
    joined = fields.where("path <> first").groupBy(F.col("first").alias("old"), F.col("path").alias("new")).agg(F.count("*").alias("n"))
    names = canonical_names([(r["old"], r["new"], r["n"]) for r in joined.collect()])
    whole = canonical(rows_of, names)
    wide = fields.groupBy("file_id").agg(F.collect_list(F.struct("path", "first", "kind", "n")).alias("fields"))

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, own in zip(batch["file_id"], batch["fields"]):
                taken: dict[str, str] = {}  # column -> path; two fields of a file never share a column
                for f in sorted(own, key=lambda f: (canonical(f["first"], names) != f["path"], f["path"])):
                    to = canonical(f["first"], names)
                    if taken.setdefault(to, f["path"]) != f["path"]:
                        to = f["path"] if taken.setdefault(f["path"], f["path"]) == f["path"] else f"{f['path']}.again"
                        taken[to] = f["path"]
                    rows.append((file_id, f["path"], to, f["kind"], f["n"]))
            yield pd.DataFrame(rows, columns=["file_id", "path", "to", "kind", "n"])

    mapped = cut(wide.mapInPandas(resolve, "file_id long, path string, to string, kind string, n long"))
    kinds: dict[str, Counter] = defaultdict(Counter)
    for r in mapped.groupBy("to", "kind").agg(F.sum("n").alias("n")).collect():
        kinds[r["to"]][r["kind"]] += r["n"]
    rank = ["number", "boolean", "string", "array"]
    kind = {to: min((k for k in c if k != "object"), key=lambda k: (-c[k], rank.index(k))) for to, c in kinds.items() if set(c) != {"object"} and to != whole}
    column = column_names(list(kind), {"record_id", "file_id", "result_rank", "other_values"})
    order = sorted(kind, key=lambda p: column[p])
    sql = {"number": "double", "boolean": "boolean"}
    make = {to: {"number": _number, "boolean": _truth}.get(k, as_text) for to, k in kind.items()}

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record_id, file_id, payload, pairs in zip(batch["record_id"], batch["file_id"], batch["payload"], batch["mapping"]):
                record = parse(payload)
                if record is None:
                    continue
                to = {m["path"]: m["to"] for m in pairs} if pairs is not None else {}

                def fill(holder: dict, path: str, row: dict, rest: dict, to=to) -> list:
                    found = []
                    for name, child in holder.items():
                        if child is None:
                            continue
                        at = f"{path}.{name}" if path else name
                        place = to.get(at)
                        if place == whole:
                            found += [(at, x) for x in (child if isinstance(child, list) else [child]) if isinstance(x, dict)]
                            continue
                        if place in kind and not (isinstance(child, dict) and kind[place] in ("number", "boolean")):
                            value = make[place](child)
                            if value is None:
                                rest[column[place]] = as_text(child)
                            row[place] = value
                        if isinstance(child, dict):
                            found += fill(child, at, row, rest)
                    return found

                head: dict = {}
                rest: dict = {}
                elements = fill(record, "", head, rest)
                for i, (at, element) in enumerate(elements or [("", {})], 1):
                    row, other = dict(head), dict(rest)
                    fill(element, at, row, other)
                    rows.append([record_id, file_id, i if elements else None, *[row.get(p) for p in order], other or None])
            yield pd.DataFrame(rows, columns=["record_id", "file_id", "result_rank", *[column[p] for p in order], "other_values"], dtype=object)

    schema = "record_id long, file_id long, result_rank int, " + "".join(f"`{column[p]}` {sql.get(kind[p], 'string')}, " for p in order) + "other_values map<string,string>"
    mapping = mapped.groupBy("file_id").agg(F.collect_list(F.struct("path", "to")).alias("mapping"))
    return records.select("record_id", "file_id", "payload").join(mapping.hint("merge"), "file_id", "left").mapInPandas(project, schema)
