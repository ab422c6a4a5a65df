"""Ranked lexical search over a K2-treap of terms and documents.

The documents are dealt into ranges. Each range is a grid of its terms (rows, the most frequent first) and documents
(columns, by doc_id), cut into quarters again and again: a cell stores the largest impact below it, as the difference to
its parent's, and four bits for the quarters that hold anything; a cell with one posting is not cut further. Cells lie
breadth first, so a quarter is found by counting bits.

An item follows one path per term, all at once: a state is a block of neighbouring documents with the cell that each
term's row meets there, and its bound is the weighted sum of their maxima. The states with the highest bounds are cut
in half until the best documents are single columns that no bound can beat. A task carries the best documents of an
item from range to range, so later ranges are left early; the best of the tasks are ranked in the end.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import as_bytes, numbered, packed, stored, text_of, unpacked
from palisade.session import LARGE_ROWS, materialize

#: A range ends with the document that brings it to so many postings.
POSTINGS = 1_000_000
#: Items of one block; the driver holds the distinct terms of a block at a time.
ITEMS = 512
#: States that are halved in one step.
STEP = 64
_SLICE = 1 << 22
_KEPT = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))
_BITS = np.array([bin(i).count("1") for i in range(16)], np.int8)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of some megabytes, so that a long text is never held as terms whole."""
    text, begin = text.translate(_TERMS), 0
    while begin < len(text):
        end = text.find(b" ", begin + _SLICE)
        end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


# --- the treap of one range


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers moved to the even places."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def build(row: np.ndarray, col: np.ndarray, impact: np.ndarray) -> dict[str, np.ndarray]:
    """Cells breadth first: quarters, fall of the maximum below the parent's (the root: its maximum); postings of lone cells."""
    height = max(1, int(max(row.max(), col.max())).bit_length())
    code = _spread(row) << np.uint64(1) | _spread(col)
    order = np.argsort(code)
    code, impact = code[order], impact[order]
    begin, size, top = np.zeros(1, np.int64), np.array([len(code)]), np.array([impact.max()])
    masks, falls, lone = [], [top], []
    for depth in range(height + 1):
        cut = size > 1
        mask = np.zeros(len(size), np.int64)
        lone.append(begin[~cut])
        if cut.any():
            n, before = size[cut], np.cumsum(size[cut]) - size[cut]
            at = np.arange(n.sum()) + np.repeat(begin[cut] - before, n)
            quarter = code[at] >> np.uint64(2 * (height - depth - 1))
            new = np.flatnonzero(np.append(True, quarter[1:] != quarter[:-1]))
            parent = np.repeat(np.flatnonzero(cut), n)[new]
            np.bitwise_or.at(mask, parent, 1 << (quarter[new] & np.uint64(3)).astype(np.int64))
            below = np.maximum.reduceat(impact[at], new)
            falls.append(top[parent] - below)
            begin, size, top = at[new], np.diff(np.append(new, len(at))), below
        masks.append(mask)
        if not cut.any():
            break
    lone = order[np.concatenate(lone)]
    return {"height": np.array([height]), "masks": np.concatenate(masks), "falls": np.concatenate(falls), "rows": row[lone], "cols": col[lone]}


class Treap:
    """A stored treap with its bit counts, ready to be searched."""

    def __init__(self, height: np.ndarray, masks: np.ndarray, falls: np.ndarray, rows: np.ndarray, cols: np.ndarray):
        # a range has fewer than 2**31 cells and impacts below 1,000,000, so half the usual width holds them
        self.height, self.mask = int(height[0]), masks.astype(np.uint8)
        self.rows, self.cols = rows.astype(np.uint32), cols.astype(np.uint32)
        quarters = _BITS[self.mask]
        self.child = np.cumsum(quarters, dtype=np.int32)
        self.child -= quarters
        self.child += 1
        alone = self.mask == 0
        self.posting = np.cumsum(alone, dtype=np.int32)
        self.posting -= 1
        self.posting[~alone] = 0
        self.top = np.zeros(len(masks) + 1, np.int32)  # the last one stands for no cell
        self.top[0] = falls[0]
        begin, end = 0, 1
        while end < len(masks):
            above = self.top[begin:end].repeat(quarters[begin:end])
            begin, end = end, end + len(above)
            np.subtract(above, falls[begin:end], out=self.top[begin:end], casting="unsafe")

    def _below(self, cells: np.ndarray, rows: np.ndarray, depth: np.ndarray, block: np.ndarray, half: int) -> np.ndarray:
        """The cells that the rows meet in one half of each block; -1 where a row has no posting there."""
        shift = (self.height - 1 - depth)[:, None]
        quarter = ((rows[None, :] >> shift) & 1) * 2 + half
        mask = self.mask[cells].astype(np.int64)
        inner = np.where((mask >> quarter) & 1, self.child[cells] + _BITS[mask & ((1 << quarter) - 1)], -1)
        found = np.where((mask == 0) & (cells >= 0), cells, np.where(cells >= 0, inner, -1))
        single = (found >= 0) & (self.mask[found] == 0)
        at = self.posting[found]
        here = (self.rows[at] == rows[None, :]) & (self.cols[at] >> shift == (2 * block + half)[:, None])
        return np.where(single & ~here, -1, found)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, column) of the k best columns with a score of least or more, equal scores by column."""
        depth, block = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cells = np.zeros((1, len(rows)), np.int64)
        if self.mask[0] == 0:
            cells = np.where(self.rows[0] == rows, 0, -1)[None, :]
        bound = self.top[cells] @ weights
        found: list[tuple[int, int]] = []
        while True:
            first = block << (self.height - depth)
            alive = bound >= least
            if len(found) == k:
                alive &= (bound > -found[-1][0]) | ((bound == -found[-1][0]) & (first < found[-1][1]))
            if not alive.any():
                return [(-score, col) for score, col in found]
            bound, depth, block, cells, first = bound[alive], depth[alive], block[alive], cells[alive], first[alive]
            order = np.lexsort((first, -bound)) if len(bound) > STEP else np.arange(len(bound))
            now, later = order[:STEP], order[STEP:]
            done = now[depth[now] == self.height]
            now = now[depth[now] < self.height]
            if len(done):
                found = sorted(found + [(-int(b), int(c)) for b, c in zip(bound[done], block[done])])[:k]
            halves = [self._below(cells[now], rows, depth[now], block[now], half) for half in (0, 1)]
            below = np.concatenate(halves)
            score = self.top[below] @ weights
            some = score > 0
            bound = np.concatenate([bound[later], score[some]])
            block = np.concatenate([block[later], np.concatenate([2 * block[now], 2 * block[now] + 1])[some]])
            depth = np.concatenate([depth[later], np.concatenate([depth[now] + 1] * 2)[some]])
            cells = np.concatenate([cells[later], below[some]])


# --- the index


def postings(docs: DataFrame, limit: int = POSTINGS) -> DataFrame:
    """range, n_docs, n_terms, doc_ids, terms, and rows, cols, tf and lengths packed: each range's counts.

    Documents without terms are left out. Columns go by doc_id, null last.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, lengths, found, held = [], [], [], 0
        names: dict[bytes, int] = {}

        def emit() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            size = np.array([len(found[i][0]) for i in order])
            code, tf = (np.concatenate([found[i][x] for i in order]) for x in (0, 1))
            frequency = np.bincount(code, minlength=len(names))
            by = np.argsort(-frequency, kind="stable")
            row = np.empty(len(by), np.int64)
            row[by] = np.arange(len(by))
            row, col = row[code], np.repeat(np.arange(len(order)), size)
            sort = np.lexsort((col, row))
            words = list(names)
            return pa.record_batch(
                {
                    "range": pa.array([number], pa.int64()),
                    "n_docs": pa.array([len(ids)], pa.int64()),
                    "n_terms": pa.array([sum(lengths)], pa.int64()),
                    "doc_ids": pa.array([[ids[i] for i in order]], pa.list_(id_type)),
                    "terms": pa.array([[words[i] for i in by]], pa.list_(pa.binary())),
                    **{
                        name: pa.array([packed(x)], pa.binary())
                        for name, x in (("rows", row[sort]), ("cols", col[sort]), ("tf", tf[sort]), ("lengths", np.array([lengths[i] for i in order])))
                    },
                }
            )

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                counts: Counter = Counter()
                for part in terms(text):
                    counts.update(part)
                if counts:
                    ids.append(doc_id)
                    lengths.append(counts.total())
                    code = [names.setdefault(t, len(names)) for t in counts]
                    found.append((np.array(code), np.fromiter(counts.values(), np.int64, len(counts))))
                    held += len(code)
                if held >= limit:
                    number += 1
                    yield emit()
                    ids, lengths, found, held = [], [], [], 0
                    names = {}
        if ids:
            number += 1
            yield emit()

    schema = f"range long, n_docs long, n_terms long, doc_ids array<{kind}>, terms array<binary>, rows binary, cols binary, tf binary, lengths binary"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(ranges, schema)


_PARTS = ("height", "masks", "falls", "rows", "cols")


def index(docs: DataFrame, limit: int = POSTINGS) -> tuple[DataFrame, int, int]:
    """The treaps of all ranges as a written table, the number of documents with a term, and of all terms."""
    counts = materialize(postings(docs, limit), "postings", **LARGE_ROWS)
    n, total = counts.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, total = n or 0, total or 0

    def treaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows, cols, tf, lengths = (unpacked(one[c][0].as_py()) for c in ("rows", "cols", "tf", "lengths"))
                m = 75 + np.array([25 * x * n // total for x in lengths.tolist()])[cols]
                made = build(rows, cols, 1_000_000_000 * tf // (1000 * tf + 12 * m))
                parts = {c: one[c] for c in ("range", "doc_ids", "terms")}
                parts["df"] = pa.array([packed(np.bincount(rows))], pa.binary())
                yield pa.record_batch({**parts, **{c: pa.array([packed(made[c])], pa.binary()) for c in _PARTS}})

    kinds = dict(counts.dtypes)
    schema = f"range long, doc_ids {kinds['doc_ids']}, terms array<binary>, df binary, " + ", ".join(f"{c} binary" for c in _PARTS)
    columns = ["range", "doc_ids", "terms", "rows", "cols", "tf", "lengths"]
    return materialize(counts.select(*columns).mapInArrow(treaps, schema), "treaps", **LARGE_ROWS), n, total


# --- the search


def _item_terms(items: DataFrame) -> DataFrame:
    """_rank, item_id, and the distinct terms of each item with how often it holds them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(t for part in terms(text) for t in part) for text in as_bytes(batch.column(2))]
            yield pa.record_batch(
                {
                    "_rank": batch.column(0),
                    "item_id": batch.column(1),
                    "terms": pa.array([list(c) for c in found], pa.list_(pa.binary())),
                    "times": pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
                }
            )

    rows, _ = numbered(items.select("item_id", text_of().alias("text")), ["item_id", "text"])
    kind = dict(items.dtypes)["item_id"]
    schema = f"_rank long, item_id {kind}, terms array<binary>, times array<long>"
    return rows.select("_rank", "item_id", "text").mapInArrow(count, schema)


def _weights(treaps: DataFrame, wanted: list[bytes], n: int) -> dict[bytes, int]:
    """The weight of each wanted term that occurs."""
    names = pa.array(wanted, pa.binary())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(names), np.int64)
        for batch in batches:
            for own, counts in zip(batch.column(0), batch.column(1).to_pylist()):
                at = pc.index_in(own.values, names)
                some = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                df[at.drop_null().to_numpy()] += unpacked(counts)[some]
        at = np.flatnonzero(df)
        yield pa.record_batch({"at": pa.array(at, pa.int64()), "df": pa.array(df[at])})

    rows = treaps.select("terms", "df").mapInArrow(frequencies, "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))
    return {wanted[r["at"]]: math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in rows.collect()}


def _block_best(treaps: DataFrame, block: list, weights: dict[bytes, int], k: int) -> DataFrame:
    """_rank, doc_id, score of the best documents of every task for each item of a block."""
    wanted = sorted(weights)
    number = {t: i for i, t in enumerate(wanted)}
    names, weight = pa.array(wanted, pa.binary()), np.array([weights[t] for t in wanted], np.int64)
    asked = []
    for r in block:
        own = [(number[bytes(t)], n) for t, n in zip(r["terms"], r["times"]) if weights.get(bytes(t), 0) > 0]
        if own:
            at, times = (np.array(x, np.int64) for x in zip(*own))
            asked.append((r["_rank"], at, weight[at] * times))
    id_type = treaps.schema["doc_ids"].dataType.elementType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = defaultdict(list)
        kind = None
        for batch in batches:
            kind = batch["doc_ids"].type.value_type
            for i in range(batch.num_rows):
                ids = batch["doc_ids"][i].as_py()
                row = pc.index_in(names, batch["terms"][i].values).fill_null(-1).to_numpy().astype(np.int64)
                treap = Treap(*(stored(batch[c][i].as_py()) for c in _PARTS))
                for rank, at, weighed in asked:
                    here = row[at] >= 0
                    if here.any():
                        held = best[rank]
                        least = held[-1][0] if len(held) == k else 1
                        for score, col in treap.best(row[at[here]], weighed[here], k, max(1, least)):
                            held.append((score, ids[col]))
                        held.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                        del held[k:]
        if kind is not None:
            found = [(rank, doc_id, score) for rank, held in best.items() for score, doc_id in held]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), kind, pa.int64()))], names=["_rank", "doc_id", "score"])

    return treaps.select("doc_ids", "terms", *_PARTS).mapInArrow(search, f"_rank long, doc_id {id_type}, score long")


def search(treaps: DataFrame, n: int, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item, by the treaps and number of documents of index().

    Items are taken in blocks of ITEMS; every block is searched in all ranges. A null or empty item has no terms and no
    rows; rows of items with the same item_id are items of their own.
    """
    asked = materialize(_item_terms(items), "items")
    blocks = -(-asked.count() // ITEMS)
    found = None
    for number in range(blocks):
        block = asked.where(F.expr(f"_rank div {ITEMS} = {number}")).collect()
        wanted = sorted({bytes(t) for r in block for t in r["terms"]})
        rows = _block_best(treaps, block, _weights(treaps, wanted, n), k)
        rows = materialize(rows.withColumn("_salt", F.spark_partition_id() % 256), "found")
        found = rows if found is None else found.unionAll(rows)
    if found is None:
        id_type = treaps.schema["doc_ids"].dataType.elementType.simpleString()
        found = items.sparkSession.createDataFrame([], f"_rank long, doc_id {id_type}, score long, _salt int")
    for keys in (["_rank", "_salt"], ["_rank"]):  # an item has up to k rows per task
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.join(asked.select("_rank", "item_id"), "_rank").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, limit: int = POSTINGS) -> DataFrame:
    """search() over an index() of the documents.

    A null or empty text has no terms, is not counted and never found. Rows that share a doc_id are documents of their
    own; equal scores go by doc_id, null last. Empty tables give no rows; other columns are not read. A document's
    postings lie in one range, however many they are; its text is read in slices.
    """
    treaps, n, _ = index(docs, limit)
    return search(treaps, n, items, k)
