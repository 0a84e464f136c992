"""Long exact spans shared between records, by Relative Lempel-Ziv parsing against anchored references.

Index. Of every window of ``length`` characters the k-gram with the least hash is an anchor, so two
texts with a span of that length in common have an anchor at the same place of it. Anchors that stand
in one text only start no factor; one aggregation of (hash, least and largest text) drops them. All
others, with the text around them, fall into reference blocks by hash: a block holds every place of
the corpus that a text with its anchors must be factored against, one under the other, aligned at the
anchor, and is indexed by its windows.

Parsing. Each text is factored greedily against its block. At the cursor, the first window that the
index finds in another text, the block's rows are sorted by what follows; the longest match with
another text is that with a neighbour in this order, compared character by character up to the first
difference. That is a factor: start and stop, and the text and place it refers to. Factors of at least
``length`` are duplicate spans. At a factor's end the cursor goes back to the first window that the
factor doesn't hold whole, so a span across two factors is checked at their boundary and never split;
the factors of one text's anchors overlap and are merged when characters are counted. What no other text has is
literal and is never compared, so the work follows the shared text, not the pairs of documents.

The texts of one factored window are one set: those that refer to the same reference window. Its
members are compared with that window character by character; pairs are made from the sets in the
last join only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsieve.session import clustered

LENGTH = 200
GRAM = 100
#: An odd number with a spread of bits, the base of the rolling hash modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Characters hashed at once; longer texts are hashed by themselves. It bounds memory, not the result.
BLOCK_CHARS = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of all stretches of a given width: powers of the base are made once for the longest text."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            for name, b in (("power", BASE), ("inverse", pow(BASE, -1, 2**64))):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        self._grow(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes + np.uint64(1)) * self.power[: len(codes)], dtype=np.uint64, out=out[1:])
        return out

    def stretches(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        return mix((prefix[width:] - prefix[:-width]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """The least key of every ``width`` neighbours, by doubling."""
    have, least = 1, key
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def anchors_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash in every window; of equal hashes the first place of the window."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    # the upper half of the hash, then the place: one array of keys gives both
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    return np.unique(window_minima(key, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchors(length: int, gram: int):
    """(doc, anchor hash, place) of all texts of at least ``length`` characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1)
            i = 0
            while i < len(texts):
                # neighbouring texts are hashed as one; stretches over a boundary are left out below
                parts, where, size = [], [], 0
                while i < len(texts) and (not parts or size < BLOCK_CHARS):
                    c = code_points(texts[i].as_py())
                    if len(c) >= length:
                        parts.append(c)
                        where.append((size, len(c), ids[i]))
                        size += len(c)
                    i += 1
                if not parts:
                    continue
                hashes = roll.stretches(roll.prefix(np.concatenate(parts)), gram)
                doc, place, key = [], [], []
                for s, n, d in where:
                    own = hashes[s : s + n - gram + 1]
                    at = anchors_of(own, length - gram + 1)
                    doc.append(np.full(len(at), d, np.int64))
                    place.append(at)
                    key.append(own[at].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (doc, key, place)], names=["doc", "h", "place"])

    return run


CONTEXT = "h bigint, n bigint, doc bigint, place bigint, run bigint, lead int, context string"


def _contexts(length: int, gram: int):
    """The text around each wanted anchor: up to length - gram characters on both sides.

    Where an anchor comes again within ``length`` characters with the same text around it, as in texts that
    repeat a short pattern, it is no row of its own: ``run`` tells how far on the last such place is.
    """
    side = length - gram

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for r in range(batch.num_rows):
                doc, text, wanted = batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                before: dict[int, tuple[int, int]] = {}  # anchor -> its last row and place
                for w in sorted(wanted, key=lambda w: w["place"]):
                    h, p = w["h"], w["place"]
                    a = max(0, p - side)
                    context = text[a : p + gram + side]
                    at, last = before.get(h, (-1, 0))
                    if at >= 0 and p - last <= length and out[6][at] == context:
                        out[4][at] = p - out[3][at]
                    else:
                        at = len(out[0])
                        for column, value in zip(out, (h, w["n"], doc, p, 0, p - a, context)):
                            column.append(value)
                    before[h] = (at, p)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["h", "n", "doc", "place", "run", "lead", "context"])

    return run


class Block:
    """Occurrences of whole anchors: their contexts, and the windows of ``length`` characters around the anchors.

    ``group`` numbers the anchors; row r's context is ``text[start[r] : start[r] + size[r]]``, its
    anchor begins ``lead[r]`` characters in, and its windows begin at 0 .. ``windows[r]`` - 1.
    """

    def __init__(self, rows: list[pa.RecordBatch], length: int):
        get = lambda name: np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in rows])
        self.length = length
        self.doc, self.place, self.run, self.lead = get("doc"), get("place"), get("run"), get("lead").astype(np.int64)
        h = get("h") if "h" in rows[0].schema.names else np.zeros(len(self.doc), np.int64)
        self.group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
        texts = [t for b in rows for t in b.column("context").to_pylist()]
        self.text = code_points("".join(texts))
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.windows = np.maximum(0, np.minimum(self.lead + 1, self.size - length + 1))

    def hashed(self, roll: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, place in the context) of every window."""
        n = self.windows
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        hashes = roll.stretches(roll.prefix(self.text), self.length)
        return hashes[self.start[row] + at], row, at

    def characters(self, row: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """The characters from ``at`` on, one row each; 0 beyond the context, 1 and up within it."""
        place = at[:, None] + np.arange(width)[None, :]
        inside = place < self.size[row][:, None]
        flat = np.minimum(self.start[row][:, None] + place, max(0, len(self.text) - 1))
        return np.where(inside, self.text[flat] + np.uint64(1), np.uint64(0)).astype(np.uint32)

    def equal(self, row: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray, step: int = 20_000) -> np.ndarray:
        """Whether the windows at two places are the same, character by character."""
        out = np.zeros(len(row), bool)
        for b in range(0, len(row), step):
            e = b + step
            out[b:e] = (self.characters(row[b:e], at[b:e], self.length) == self.characters(other[b:e], other_at[b:e], self.length)).all(axis=1)
        return out

    def longest(self, row: np.ndarray, offset: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, row referred to) of the longest match of each asking row with a row of another text.

        The rows are all that have a window at ``offset`` characters before the anchor, of the groups and
        offsets that some cursor stands at. Sorted by group, offset and what follows, a row's longest
        match is with a neighbour; rows of its own text in between are stepped over.
        """
        width = int(self.size.max())
        chars = self.characters(row, self.lead[row] - offset, width)
        key = np.concatenate([np.stack([self.group[row], offset], axis=1).astype(">u4"), chars.astype(">u4")], axis=1)
        order = np.argsort(np.ascontiguousarray(key).view(f"S{4 * key.shape[1]}")[:, 0], kind="stable")
        key, own = key[order], self.doc[row[order]]
        differ = key[1:] != key[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), key.shape[1])
        # characters in common with the next row: none across groups or offsets, nor beyond either context
        common = np.minimum(np.maximum(0, same - 2), np.minimum(self._rest(row, offset)[order][1:], self._rest(row, offset)[order][:-1]))
        asked = np.flatnonzero(ask[order])
        best, refer = np.zeros(len(row), np.int64), np.full(len(row), -1)
        for side in (-1, 1):
            now, reach = asked.copy(), np.full(len(asked), 1 << 30)
            open_ = np.ones(len(asked), bool)
            while open_.any():
                now[open_] += side
                open_ &= (now >= 0) & (now < len(row))
                reach[open_] = np.minimum(reach[open_], common[np.minimum(now, now - side)[open_]])
                open_ &= reach >= self.length
                found = open_.copy()
                found[open_] = own[now[open_]] != own[asked[open_]]
                better = found.copy()
                better[found] = reach[found] > best[asked[found]]
                best[asked[better]], refer[asked[better]] = reach[better], now[better]
                open_ &= ~found
        back = np.empty(len(row), np.int64)
        back[order] = np.arange(len(row))
        got = np.where(refer >= 0, row[order][np.maximum(refer, 0)], -1)
        return best[back], got[back]

    def _rest(self, row: np.ndarray, offset: np.ndarray) -> np.ndarray:
        return self.size[row] - (self.lead[row] - offset)


FACTOR = "kind string, id bigint, doc bigint, start bigint, stop bigint, run bigint, ref_doc bigint, ref_start bigint"
_KINDS = pa.schema([("kind", pa.string()), *[(n, pa.int64()) for n in ("id", "doc", "start", "stop", "run", "ref_doc", "ref_start")]])


def _shared_windows(block: Block, roll: Rolling):
    """(class, row, place) of the windows that more than one text has, compared with the class's first window.

    A class is one window of one anchor's block; its first occurrence by (row) is the reference.
    """
    key, row, at = block.hashed(roll)
    off = block.lead[row] - at
    order = np.lexsort((row, key, off, block.group[row]))
    key, row, at, off = key[order], row[order], at[order], off[order]
    g = block.group[row]
    begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (g[1:] != g[:-1]) | (off[1:] != off[:-1])][: len(key)])
    of = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(key)]))
    d = block.doc[row]
    low, high = np.minimum.reduceat(d, begin), np.maximum.reduceat(d, begin)
    keep = (low != high)[of]
    return of[keep], row[keep], at[keep]


def parse(block: Block, roll: Rolling) -> pa.RecordBatch | None:
    """Factors of the occurrences of whole anchors: (kind, id, doc, start, stop, run, ref_doc, ref_start).

    ``span`` rows: the greedy factors with the place they refer to; the same factor comes again, without a gap,
    up to ``run`` characters further on. ``set`` rows: texts that refer to one
    reference window; equal sets have equal ids, whichever anchor they come from.
    """
    if not int(block.windows.sum()):
        return None
    of, row, at = _shared_windows(block, roll)
    if not len(of):
        return None
    d = block.doc[row]
    order = np.lexsort((row, d, of))
    of, row, at, d = of[order], row[order], at[order], d[order]
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[begin, len(of)])
    first = np.r_[True, (of[1:] != of[:-1]) | (d[1:] != d[:-1])]
    ids = np.add.reduceat(np.where(first, mix(d.astype(np.uint64)), np.uint64(0)), begin) ^ mix(np.add.reduceat(first, begin).astype(np.uint64))
    _, take = np.unique(ids, return_index=True)
    wanted = np.zeros(len(begin), bool)
    wanted[take] = True
    keep = np.repeat(wanted, size) & first
    refer = np.repeat(begin, size)
    keep_at = np.flatnonzero(keep)
    ok = block.equal(row[keep_at], at[keep_at], row[refer[keep_at]], at[refer[keep_at]])
    set_id, set_doc = np.repeat(ids, size)[keep_at], d[keep_at]
    ref_doc, ref_start = block.doc[row[refer[keep_at]]], (block.place - block.lead)[row[refer[keep_at]]] + at[refer[keep_at]]
    if not ok.all():
        # equal hashes of different windows: such members are sets of their own texts, told apart by the text itself
        bad = keep_at[~ok]
        chars = block.characters(row[bad], at[bad], block.length)
        own = {}
        renamed = np.array([own.setdefault((int(i), c.tobytes()), len(own)) for i, c in zip(set_id[~ok], chars)], np.uint64)
        set_id = set_id.copy()
        set_id[~ok] = mix(set_id[~ok] + renamed + np.uint64(1))

    # greedy factors: every row's cursor stands at its first shared window
    has = np.zeros((len(block.doc), int(block.windows.max()) + 1), bool)
    has[row, at] = True
    reach = np.where(has, np.arange(has.shape[1])[None, :], has.shape[1])
    ahead = np.minimum.accumulate(reach[:, ::-1], axis=1)[:, ::-1]  # the next shared window from each place on
    none = has.shape[1]
    cursor = ahead[:, 0].copy()
    parts = []
    while (open_ := np.flatnonzero(cursor < none)).size:
        # all rows of the groups and offsets that cursors stand at
        where = np.unique(np.stack([block.group[open_], block.lead[open_] - cursor[open_]], axis=1), axis=0)
        lo, hi = np.searchsorted(block.group, where[:, 0]), np.searchsorted(block.group, where[:, 0], side="right")
        n = hi - lo
        r = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        o = np.repeat(where[:, 1], n)
        in_row = (block.lead[r] >= o) & (block.lead[r] - o < block.windows[r])
        r, o = r[in_row], o[in_row]
        ask = (cursor[r] < none) & (cursor[r] == block.lead[r] - o)
        for b, e in _portions(block.group[r], o):
            length, to = block.longest(r[b:e], o[b:e], ask[b:e])
            asking = np.flatnonzero(ask[b:e]) + b
            found, t, x = length[asking - b], to[asking - b], r[asking]
            good = found >= block.length
            y = t[good]
            begin_at = (block.place - block.lead)[x[good]] + cursor[x[good]]
            parts.append(np.stack([block.doc[x[good]], begin_at, begin_at + found[good], block.run[x[good]], block.doc[y], (block.place - block.lead)[y] + block.lead[y] - o[asking][good]], axis=1))
            # on from the first window that isn't wholly inside the factor; a literal moves one place
            step = np.where(good, np.maximum(1, found - block.length + 1), 1)
            later = np.minimum(cursor[x] + step, none - 1)
            cursor[x] = np.where(cursor[x] + step < none, ahead[x, later], none)
    spans = np.concatenate(parts) if parts else np.zeros((0, 6), np.int64)
    zero = np.zeros(len(set_id), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["set"] * len(set_id) + ["span"] * len(spans)),
            pa.array(np.r_[set_id.view(np.int64), np.zeros(len(spans), np.int64)]),
            pa.array(np.r_[set_doc, spans[:, 0]]),
            pa.array(np.r_[zero, spans[:, 1]]),
            pa.array(np.r_[zero, spans[:, 2]]),
            pa.array(np.r_[zero, spans[:, 3]]),
            pa.array(np.r_[ref_doc, spans[:, 4]]),
            pa.array(np.r_[ref_start, spans[:, 5]]),
        ],
        schema=_KINDS,
    )


#: Rows sorted at once by what follows; whole groups and offsets only, so a larger one is sorted by itself.
SORTED_ROWS = 20_000


def _portions(group: np.ndarray, offset: np.ndarray):
    """(from, to) of stretches of whole (group, offset) runs of about SORTED_ROWS rows."""
    if not len(group):
        return
    cuts = np.r_[0, np.flatnonzero((group[1:] != group[:-1]) | (offset[1:] != offset[:-1])) + 1, len(group)]
    b = 0
    for c in cuts[1:]:
        if c - b >= SORTED_ROWS or c == len(group):
            yield int(b), int(c)
            b = c


#: Occurrences parsed at once; whole anchors only, so a larger anchor makes a larger batch.
PARSE_ROWS = 5_000


def _factors(length: int):
    """Factors of all anchors of a partition; an anchor's rows follow each other in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        held: list[pa.RecordBatch] = []
        rows = 0

        def finish(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts and (found := parse(Block(parts, length), roll)) is not None:
                yield found

        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            if rows >= PARSE_ROWS and held[-1].column("h")[-1].as_py() != h[0]:
                yield from finish(held)
                held, rows = [], 0
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            at = 0
            while at < batch.num_rows:
                later = cuts[cuts >= max(at + 1, at + PARSE_ROWS - rows)]
                end = int(later[0]) if len(later) else batch.num_rows
                held.append(batch.slice(at, end - at))
                rows += end - at
                if len(later):
                    yield from finish(held)
                    held, rows = [], 0
                at = end
        yield from finish(held)

    return run


def _windows(length: int):
    """(window, doc, place, run) rows of hot anchors, for the way without groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                block = Block([batch.slice(i, 2000)], length)
                key, row, at = block.hashed(roll)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(block.doc[row]), pa.array((block.place - block.lead)[row] + at), pa.array(block.run[row])], names=["id", "doc", "place", "run"])

    return run


def _classes(docs: DataFrame) -> DataFrame:
    """(fp, rep, n): groups of equal texts by their digest; combines before the shuffle."""
    return docs.groupBy(F.md5("text").alias("fp")).agg(F.min("doc").alias("rep"), F.countDistinct("doc").alias("n"))


def factors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_rows: int = 20_000) -> DataFrame:
    """set and span rows of texts ``docs`` (doc bigint, text), each different text once.

    An anchor hash with more than ``hot_rows`` occurrences is no group of any task: its windows are
    counted by their own hashes in a shuffle, with the same result.
    """
    reps = _classes(docs).select(F.col("rep").alias("doc"))
    # the texts move once, by doc; both uses below read the same exchange
    texts = docs.join(reps, "doc", "left_semi")
    anchors = texts.mapInArrow(_anchors(length, gram), "doc bigint, h bigint, place bigint")
    # the count combines before its shuffle: an anchor in a third of all texts is one row a task
    shared = anchors.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).where("least < most").select("h", "n")
    wanted = anchors.join(shared, "h").groupBy("doc").agg(F.collect_list(F.struct("h", "place", "n")).alias("wanted"))
    context = texts.join(wanted, "doc").mapInArrow(_contexts(length, gram), CONTEXT)
    cool = clustered(context.where(F.col("n") <= hot_rows).drop("n"), "h").mapInArrow(_factors(length), FACTOR)
    # a hot anchor is no group of any task: each of its windows refers to the least place that has it
    hot = context.where(F.col("n") > hot_rows).drop("n", "h").mapInArrow(_windows(length), "id bigint, doc bigint, place bigint, run bigint")
    both = hot.groupBy("id").agg(F.min(F.struct("doc", "place")).alias("least"), F.max(F.struct("doc", "place")).alias("most")).where("least.doc < most.doc")
    hot = hot.join(both, "id").withColumn("ref", F.when(F.col("least.doc") < F.col("doc"), F.col("least")).otherwise(F.col("most")))
    long = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else F.lit(c).cast("bigint")
    row = lambda kind, i, a, b: F.struct(F.lit(kind).alias("kind"), i.alias("id"), F.col("doc"), a.alias("start"), b.alias("stop"), F.col("run"), F.col("ref.doc").alias("ref_doc"), F.col("ref.place").alias("ref_start"))
    hot = hot.select(F.explode(F.array(row("set", F.col("id"), long(0), long(0)), row("span", long(0), F.col("place"), F.col("place") + length))).alias("x")).select("x.*")
    return cool.unionByName(hot)


def _documents(df: DataFrame, id_column: str, text_column: str, length: int) -> DataFrame:
    return df.select(F.col(f"`{id_column}`").cast("bigint").alias("doc"), F.col(f"`{text_column}`").cast("string").alias("text")).where((F.length("text") >= length) & F.col("doc").isNotNull())


def shared_pairs(df: DataFrame, id_column: str, text_column: str, length: int = LENGTH, gram: int = GRAM, hot_rows: int = 20_000) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: texts with at least ``length`` consecutive characters in common.

    Characters are code points, exactly as stored. Null, empty and shorter texts have no pairs;
    repeated rows of one document count once; copies of one text are pairs like any other. Other
    columns aren't read. The pairs themselves are the result asked for; up to the last join every
    table is linear in the documents.
    """
    docs = _documents(df, id_column, text_column, length)
    fp = docs.select("doc", F.md5("text").alias("fp")).distinct()
    copies = _classes(docs).where("n > 1").select("fp", "rep").join(fp, "fp").select("rep", "doc")
    sets = factors(docs, length, gram, hot_rows).where("kind = 'set'").select("id", F.col("doc").alias("rep")).distinct()
    members = sets.join(copies, "rep", "left").select(F.col("id"), F.coalesce("doc", "rep").alias("doc"))
    members = members.unionByName(copies.select(F.xxhash64(F.lit("copies"), "rep").alias("id"), "doc")).distinct()
    a, b = members.select("id", F.col("doc").alias("doc_a")), members.select("id", F.col("doc").alias("doc_b"))
    return a.join(b, "id").where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def coverage(df: DataFrame, id_column: str, text_column: str, length: int = LENGTH, gram: int = GRAM, hot_rows: int = 20_000) -> DataFrame:
    """(doc, n_chars, shared_chars, n_spans) of every document with a text shared elsewhere, and of all others with 0.

    ``shared_chars`` counts the characters inside passages of at least ``length`` that another
    document has too. A document whose whole text (of that length) is another's is shared entirely.
    Null and empty texts have 0 characters.
    """
    docs = _documents(df, id_column, text_column, length)
    fp = docs.select("doc", F.md5("text").alias("fp")).distinct()
    copies = _classes(docs).where("n > 1").select("fp").join(fp, "fp").select("doc").distinct().withColumn("whole", F.lit(True))
    spans = factors(docs, length, gram, hot_rows).where("kind = 'span'").select("doc", "start", (F.col("stop") + F.col("run")).alias("stop")).distinct()
    before = Window.partitionBy("doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(before), F.lit(0))
    spans = spans.withColumn("reach", reach)
    merged = spans.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach"))).alias("chars"), F.count_if((F.col("start") > F.col("reach")) | (F.col("reach") == 0)).alias("spans"))
    every = df.select(F.col(f"`{id_column}`").cast("bigint").alias("doc"), F.coalesce(F.length(F.col(f"`{text_column}`").cast("string")), F.lit(0)).alias("n_chars")).groupBy("doc").agg(F.max("n_chars").cast("bigint").alias("n_chars"))
    out = every.join(merged, "doc", "left").join(copies, "doc", "left")
    return out.select("doc", "n_chars", F.when(F.col("whole"), F.col("n_chars")).otherwise(F.coalesce("chars", F.lit(0))).cast("bigint").alias("shared_chars"), F.when(F.col("whole"), 1).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"))
