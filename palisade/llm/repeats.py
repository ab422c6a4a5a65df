"""Removing every byte or word that lies in a window which also starts elsewhere in the corpus.

Seeds: the smallest hash of all k-grams in a window is its anchor, so equal windows have equal anchors at equal places.
Neighbouring windows with the same anchor form a run. Runs whose anchor occurs once are done: nothing repeats there.
Runs that are alike as a whole repeat as a whole. Only different runs of one anchor are compared: those of an anchor
meet in one task, unless they are more than CROWD, in which case their windows are counted by hash over all tasks.

Two comparisons: suffix arrays (bytes), and extension of the anchor to both sides (words).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Rolling, Texts, as_bytes, chunks, mix, text_of
from palisade.llm.suffix import permuted_prefixes, suffix_array
from palisade.session import materialize

CROWD = 1500
# Keys with more than this share of all rows, fewer than its reciprocal, are looked up where the rows are.
HOT_SHARE = 1 / 1000
_LOWEST = -(2**63)
_A, _B, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)
_RUN = "array<struct<anchor:long,seg:long,first:int,last:int>>"
_HITS = "anchor long, seg long, hits array<struct<lo:int,hi:int>>"


class ByteUnits:
    """Texts as bytes."""

    @staticmethod
    def positions(texts: list[bytes]) -> tuple[Rolling, np.ndarray, np.ndarray, int]:
        t = Texts(texts)
        return t.rolling(), t.start, t.stop, len(t.data)

    @staticmethod
    def split(text: bytes) -> bytes:
        return text

    @staticmethod
    def join(parts: list[bytes]) -> bytes:
        return b"".join(parts)


class WordUnits:
    """Texts as words between white space; what is kept is joined by blanks."""

    @staticmethod
    def positions(texts: list[bytes]) -> tuple[Rolling, np.ndarray, np.ndarray, int]:
        words = Texts(texts).words()
        return Rolling(words.hash), words.first[:-1], words.first[1:], len(words.hash)

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        return text.split()

    @staticmethod
    def join(parts: list[list[bytes]]) -> bytes:
        return b" ".join(word for part in parts for word in part)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each width neighbouring values, by running minima to both sides of block borders."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _windows(start: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each window that lies inside a text, and its text."""
    number = np.maximum(0, stop - start - length + 1)
    doc = np.repeat(np.arange(len(start)), number)
    return start[doc] + np.arange(len(doc)) - (np.cumsum(number) - number)[doc], doc


def anchored_runs(units, texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """text, anchor, seg (hash of all the run covers), first and last window of every run."""
    rolling, start, stop, n = units.positions(texts)
    at, doc = _windows(start, stop, length)
    if not len(at):
        return (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 2)
    place = np.arange(n - gram + 1)
    value = rolling.of(place, place + gram)
    least = _smallest((value & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64), length - gram + 1)
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    first, last = at[new], at[np.append(new[1:], len(at)) - 1]
    anchor, doc = anchor[new], doc[new]
    shape = (anchor - first).astype(np.uint64) * _A + (last - first).astype(np.uint64) * _B
    seg = mix(rolling.of(first, last + length) + shape)
    return doc, value[anchor], seg, first - start[doc], last - start[doc]


def all_runs(rows: DataFrame, units, length: int, gram: int) -> DataFrame:
    """doc, hash and runs of every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            parts, number = [], np.zeros(len(texts) + 1, np.int32)
            for begin, end in chunks(texts):
                doc, *rest = anchored_runs(units, texts[begin:end], length, gram)
                number[begin + 1 : end + 1] = np.bincount(doc, minlength=end - begin)
                parts.append(rest)
            anchor, seg, first, last = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.uint64)] * 4
            values = [anchor.view(np.int64), seg.view(np.int64), first.astype(np.int32), last.astype(np.int32)]
            runs = pa.StructArray.from_arrays([pa.array(v) for v in values], ["anchor", "seg", "first", "last"])
            offsets = pa.array(np.cumsum(number, dtype=np.int32))
            yield pa.record_batch({"doc": batch.column(0), "hash": batch.column(1), "runs": pa.ListArray.from_arrays(offsets, runs)})

    return rows.select("doc", "hash", "text").mapInArrow(find, f"doc long, hash long, runs {_RUN}")


def _covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal covered stretches of windows that begin in the given ranges."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((low, high + length) for low, high in ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _result(units, text: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[int, int, int, str]:
    """Units in the text, removed, stretches removed, and the digest of what is left."""
    parts, at, gone = units.split(text), 0, _covered(ranges, length)
    kept = []
    for low, high in gone:
        kept.append(parts[at:low])
        at = high
    kept.append(parts[at:])
    return len(parts), sum(b - a for a, b in gone), len(gone), hashlib.sha256(units.join(kept)).hexdigest()


_RESULT = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string"
_RESULT_ARROW = pa.struct([("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _first_pass(rows: DataFrame, units, length: int) -> DataFrame:
    """Rows with their flagged runs: finished (result), or still open (text, open, sure); runs to compare (segs)."""
    seg = pa.struct([("anchor", pa.int64()), ("seg", pa.int64()), ("crowd", pa.bool_()), ("body", pa.binary())])
    open_run = pa.struct([("anchor", pa.int64()), ("seg", pa.int64()), ("first", pa.int32())])
    sure_run = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("result", "text", "open", "sure", "segs")}
            for text, flags in zip(as_bytes(batch.column(3)), batch.column(4).to_pylist()):
                flags = flags or []
                sure = [(f["first"], f["last"]) for f in flags if f["whole"]]
                opened = [f for f in flags if not f["whole"]]
                parts = units.split(text) if any(f["rep"] for f in flags) else []
                out["segs"].append(
                    [
                        {**{k: f[k] for k in ("anchor", "seg", "crowd")}, "body": units.join([parts[f["first"] : f["last"] + length]])}
                        for f in flags if f["rep"]
                    ]
                )
                out["open"].append([{k: f[k] for k in ("anchor", "seg", "first")} for f in opened])
                out["sure"].append([{"lo": a, "hi": b} for a, b in _covered_windows(sure)])
                out["text"].append(text if opened else None)
                out["result"].append(None if opened else dict(zip(_RESULT_ARROW.names, _result(units, text, sure, length))))
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0), "doc": batch.column(1), "hash": batch.column(2),
                    "result": pa.array(out["result"], _RESULT_ARROW), "text": pa.array(out["text"], pa.binary()),
                    "open": pa.array(out["open"], pa.list_(open_run)), "sure": pa.array(out["sure"], pa.list_(sure_run)),
                    "segs": pa.array(out["segs"], pa.list_(seg)),
                }
            )

    return rows.select("doc_id", "doc", "hash", "text", "flags").mapInArrow(
        look,
        "doc_id long, doc long, hash long, result struct<n_units:long,n_removed:long,n_spans:long,kept_sha256:string>,"
        "text binary, open array<struct<anchor:long,seg:long,first:int>>, sure array<struct<lo:int,hi:int>>,"
        "segs array<struct<anchor:long,seg:long,crowd:boolean,body:binary>>",
    )


def _covered_windows(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(a, b - 1) for a, b in _covered(ranges, 1)]


def _spans(doc: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """List of (lo, hi) per row from sorted window places."""
    new = np.append(True, (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])) if len(at) else np.zeros(0, bool)
    place = np.flatnonzero(new)
    low, high = at[place], at[np.append(place[1:], len(at)) - 1] if len(at) else at
    pairs = pa.StructArray.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["lo", "hi"])
    offsets = np.append(0, np.cumsum(np.bincount(doc[place], minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def repeated_by_extension(bodies: list[bytes], anchors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Body and place of each window found twice among the runs of an anchor.

    The anchor is extended by every number of words to the left and the rest of the length to the right; two runs match
    that far both ways when the extensions' hashes agree. Neighbouring places then make up the maximal repeats.
    """
    rolling, start, stop, _ = WordUnits.positions(bodies)
    at, doc = _windows(start, stop, length)
    value = mix(rolling.of(at, at + length) + anchors[doc] * _C)
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return doc[twice], (at - start[doc])[twice]


def repeated_by_suffixes(bodies: list[bytes], anchors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Body and place of each window found twice: those with so long a common prefix with a neighbour in suffix order."""
    del anchors  # equal windows have equal anchors
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    data = np.frombuffer(b"\0".join(bodies) + b"\0\0", np.uint8).astype(np.int16) + 2
    stop = np.cumsum(lengths + 1) - 1
    start = stop - lengths
    data[stop], data[-1] = 1, 0
    order = suffix_array(data, 258)
    before, common = permuted_prefixes(data, order, start, int(lengths.max(initial=1)))
    deep = np.flatnonzero(common >= length)
    twice = np.zeros(len(data), bool)
    twice[deep] = True
    twice[before[deep]] = True
    at, doc = _windows(start, stop, length)
    own = twice[at]
    return doc[own], (at - start[doc])[own]


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a written table of one row per key, whose `count` says how many of the `total` rows have the key.

    Counts of different keys add up to total at most, so fewer than 1 / HOT_SHARE keys are above the share: these are
    broadcast and their rows never meet in one task.
    """
    hot = F.col(count) > total * HOT_SHARE
    often = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(often, keys).unionByName(rest.join(table.where(~hot), keys, how))


def _compared(segs: DataFrame, compare: Callable, length: int) -> DataFrame:
    """Hits of the runs of anchors that are no crowd. Shards are about a megabyte, cut between anchors."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []

        def settle(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            anchors = np.array([r[0] for r in rows], np.int64)
            doc, at = compare([r[2] for r in rows], anchors.view(np.uint64), length)
            batch = pa.record_batch(
                {"anchor": pa.array(anchors), "seg": pa.array([r[1] for r in rows], pa.int64()), "hits": _spans(doc, at, len(rows))}
            )
            found = np.bincount(doc, minlength=len(rows)) > 0
            return batch.filter(pa.array(found))

        size = 0
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if size > 1 << 20 and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield settle(held)

    return segs.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shard, _HITS)


def _counted(segs: DataFrame, units, length: int) -> DataFrame:
    """Hits of the runs of crowded anchors: their windows' hashes, counted over all tasks."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = as_bytes(batch.column(2))
            rolling, start, stop, _ = units.positions(bodies)
            at, doc = _windows(start, stop, length)
            offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=len(bodies)))).astype(np.int32)
            values = pa.array(rolling.of(at, at + length).view(np.int64))
            yield pa.record_batch(
                {"anchor": batch.column(0), "seg": batch.column(1), "values": pa.ListArray.from_arrays(pa.array(offsets), values)}
            )

    stored = materialize(segs.mapInArrow(windows, "anchor long, seg long, values array<long>"), "crowd-windows")
    total = stored.agg(F.sum(F.size("values"))).first()[0] or 0
    rows = stored.select("anchor", "seg", F.posexplode("values").alias("at", "value"))
    twice = rows.groupBy("anchor", "value").agg(F.count("*").alias("n")).where("n > 1")
    twice = materialize(twice, "crowd-repeats")
    hit = looked_up(rows, twice, ["anchor", "value"], "n", total).groupBy("anchor", "seg")
    place = F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"))
    return hit.agg(F.collect_list(place).alias("hits"))


def without_repeats(docs: DataFrame, units, compare: Callable, length: int, gram: int) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 of every row.

    Null and short texts lose nothing. Rows alike in doc_id and text both count as places and get the same result; a
    null doc_id is a value of its own; an empty table gives an empty result; other columns are not read.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), own.alias("doc"), F.xxhash64(text_of()).alias("hash"), text_of().alias("text")
    )
    stored = materialize(all_runs(rows, units, length, gram), "runs")
    runs = stored.select("doc", "hash", F.explode("runs").alias("x")).select("doc", "hash", "x.*")
    common = runs.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("seg") < F.max("seg")).alias("several"))
    common = materialize(common.where("n > 1"), "anchors")
    total = stored.agg(F.sum(F.size("runs"))).first()[0] or 0
    runs = materialize(looked_up(runs, common, ["anchor"], "n", total).drop("n"), "seeded-runs")
    place = F.struct("doc", "hash", "first")
    segs = runs.groupBy("anchor", "seg").agg(
        F.count("*").alias("n"), F.min(place).alias("where"), F.first("several").alias("several")
    )
    segs = materialize(segs, "segs")
    crowds = segs.where("several").groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > CROWD)
    segs = materialize(looked_up(segs, materialize(crowds, "crowds"), ["anchor"], "m", segs.count(), "left"), "crowded-segs")
    known = looked_up(runs.drop("several"), segs, ["anchor", "seg"], "n", total)
    flag = F.struct(
        "first", "last", "anchor", "seg", (F.col("n") > 1).alias("whole"),
        (F.col("several") & (F.col("where") == place)).alias("rep"), F.col("m").isNotNull().alias("crowd"),
    )
    flags = known.where("several or n > 1").groupBy("doc", "hash").agg(F.collect_set(flag).alias("flags"))
    looked = materialize(_first_pass(rows.join(flags, ["doc", "hash"], "left"), units, length), "first-pass")
    bodies = looked.select(F.explode("segs").alias("x")).select("x.*")
    hits = _compared(bodies.where("not crowd").select("anchor", "seg", "body"), compare, length)
    hits = materialize(hits.unionByName(_counted(bodies.where("crowd").select("anchor", "seg", "body"), units, length)), "hits")
    opened = looked.select("doc", "hash", F.explode("open").alias("x")).select("doc", "hash", "x.*")
    opened = opened.join(hits, ["anchor", "seg"]).select("doc", "hash", "first", F.explode("hits").alias("h"))
    moved = F.struct((F.col("first") + F.col("h.lo")).alias("lo"), (F.col("first") + F.col("h.hi")).alias("hi"))
    found = opened.groupBy("doc", "hash").agg(F.collect_set(moved).alias("found"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            done = [_result(units, t, [(x["lo"], x["hi"]) for x in (a or []) + (b or [])], length) for t, a, b in rest]
            columns = {"doc_id": batch.column(0)}
            for i, name in enumerate(_RESULT_ARROW.names):
                columns[name] = pa.array([d[i] for d in done], _RESULT_ARROW.field(i).type)
            yield pa.record_batch(columns)

    pending = looked.where("text is not null").select("doc_id", "doc", "hash", "text", "sure")
    pending = pending.join(found, ["doc", "hash"], "left").select("doc_id", "text", "sure", "found")
    return looked.where("text is null").select("doc_id", "result.*").unionByName(pending.mapInArrow(finish, _RESULT))


def without_repeated_bytes(docs: DataFrame, length: int = 400, gram: int = 128) -> DataFrame:
    """without_repeats over bytes, runs compared in suffix arrays."""
    return without_repeats(docs, ByteUnits, repeated_by_suffixes, length, gram)


def without_repeated_words(docs: DataFrame, length: int = 35, gram: int = 10) -> DataFrame:
    """without_repeats over words, anchors extended to both sides."""
    return without_repeats(docs, WordUnits, repeated_by_extension, length, gram)
