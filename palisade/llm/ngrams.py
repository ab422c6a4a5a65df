"""A modified Kneser-Ney model of spelling, over 4-grams of UTF-16 units of every script, in written tables.

A code holds four units of 16 bits, so it is exact, and no vocabulary is chosen: the model has a row for each n-gram of
the corpus. A text counts its own rare n-grams, which would make gibberish predictable; so the texts of a language are
halved by their hash, and each half is scored by the model of the other one. Equal texts fall into one half.

Texts are scored in blocks. A block asks for its distinct n-grams, one packed row per range of codes; each range holds
its part of the model as sorted arrays and answers every block once; the block adds its texts up. So no text becomes a
row per n-gram, no model is held whole by any task, and a frequent n-gram is one entry per block. There is one path for
every size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import as_bytes, chunks, packed, unpacked
from palisade.session import checked_broadcast, materialize

ORDER, BITS = 4, 16
#: A task hands over its counts when it holds so many distinct n-grams.
HELD = 1 << 21
#: Bytes of texts of one block, and n-grams that a range of codes is asked for, on average.
BLOCK = 4 << 20
RANGE = 2_000_000
#: Units of a passage; a text's perplexity is the median over its passages.
PASSAGE = 64
_PAD = "\n" * (ORDER - 1)
#: Compression of blocks, which are written and shuffled once each.
LEVEL = 9


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram code that ends at each unit of the padded texts, and each text's bounds in units."""
    pad = _PAD.encode("utf-16-le")
    units = [t.decode("utf-8", "replace").encode("utf-16-le") for t in texts]
    data = np.frombuffer(pad + pad.join(units) + pad, "<u2").astype(np.uint64)
    lengths = np.fromiter(map(len, units), np.int64, len(units)) // 2
    start = np.cumsum(lengths + ORDER - 1) - lengths
    found = np.zeros(len(data), np.uint64)
    for back in range(ORDER):
        found[back:] |= data[: len(data) - back] << np.uint64(BITS * back)
    return found.view(np.int64), start, start + lengths


def _inside(found: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The codes that end inside a text."""
    edge = np.zeros(len(found) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    return found[np.cumsum(edge[:-1]) > 0]


def by_model(models: pa.Array, texts: list[bytes]) -> Iterator[tuple[str, np.ndarray]]:
    """Model name and row numbers of chunks of texts with that model."""
    rows = defaultdict(list)
    for i, name in enumerate(models.to_pylist()):
        rows[name].append(i)
    for name, at in rows.items():
        for begin, end in chunks([texts[i] for i in at]):
            yield name, np.array(at[begin:end])


def ngram_counts(rows: DataFrame) -> DataFrame:
    """model, code, n of all n-grams of all texts (columns model, text)."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(code)
        code, n = code[order], n[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        return code[first], np.add.reduceat(n, first) if len(first) else n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size = 0

        def compact() -> int:
            for name in held:
                held[name] = [merged(held[name])]
            return sum(len(parts[0][0]) for parts in held.values())

        def hand_over() -> Iterator[pa.RecordBatch]:
            compact()
            for name, [(code, n)] in held.items():
                yield pa.record_batch({"model": pa.array([name] * len(code), pa.string()), "code": pa.array(code), "n": pa.array(n)})
            held.clear()

        for batch in batches:
            texts = as_bytes(batch.column(1))
            for name, at in by_model(batch.column(0), texts):
                code, n = np.unique(_inside(*codes([texts[i] for i in at])), return_counts=True)
                held[name].append((code, n.astype(np.int64)))
                size += len(code)
                if size > 2 * HELD:
                    size = compact()
                    if size > HELD:
                        yield from hand_over()
                        size = 0
        yield from hand_over()

    found = rows.select("model", "text").mapInArrow(count, "model string, code long, n long")
    return found.groupBy("model", "code").agg(F.sum("n").alias("n"))


def _last(units: int) -> Column:
    return F.col("code").bitwiseAND(F.lit((1 << BITS * units) - 1))


def _discounted(table: DataFrame) -> DataFrame:
    """model, code, n, off: discounts of one, two, and three or more come from the counts of counts of the model.

    Where those are missing the discount is half, one and one and a half.
    """
    ones = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    cuts = []
    for k in (1, 2, 3):
        cut = F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        cuts.append(F.greatest(F.lit(0.1 * k), F.coalesce(cut, F.lit(0.5 * k))).alias(f"d{k}"))
    cuts = checked_broadcast(table.groupBy("model").agg(*ones).select("model", *cuts))
    off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return table.join(cuts, "model").select("model", "code", "n", F.least(off, F.col("n").cast("double")).alias("off"))


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """model, code, p of each wanted n-gram: its discounted share plus what its context passes to the next lower order.

    Below the highest order an n-gram counts its distinct predecessors; below the lowest all 2**16 units are alike.
    """
    asked, tables = [wanted.select("model", "code").distinct()], [counts]
    for order in range(ORDER - 1, 0, -1):
        tables.append(tables[-1].groupBy("model", _last(order).alias("code")).agg(F.count("*").alias("n")))
        asked.append(asked[-1].select("model", _last(order).alias("code")).distinct())
    lower = None
    for order in range(1, ORDER + 1):
        context = F.shiftrightunsigned("code", BITS).alias("context")
        table = materialize(_discounted(tables[ORDER - order]), "ngrams")
        passed = table.groupBy("model", context).agg(F.sum("n").alias("total"), F.sum("off").alias("passed"))
        rows = asked[ORDER - order].select("model", "code", context, _last(order - 1).alias("rest"))
        rows = rows.join(table, ["model", "code"], "left").join(passed, ["model", "context"], "left")
        if lower is None:
            rows = rows.withColumn("below", F.lit(2.0**-BITS))
        else:
            rows = rows.join(lower.select("model", F.col("code").alias("rest"), F.col("p").alias("below")), ["model", "rest"])
        share = F.coalesce((F.col("n") - F.col("off")) / F.col("total"), F.lit(0.0))
        p = share + F.coalesce(F.col("passed") / F.col("total"), F.lit(1.0)) * F.col("below")
        lower = materialize(rows.select("model", "code", p.alias("p")), "ngram-p")
    return lower


def half(text_hash: Column) -> Column:
    return F.pmod(text_hash, F.lit(2))


def model_name(lang: Column, part: Column) -> Column:
    """A language's model for the texts of one half; null is a language of its own."""
    return F.concat(part.cast("string"), F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("")))


def fitted(rows: DataFrame) -> DataFrame:
    """model, code, p of all n-grams of the texts (columns model_name() as model, text), by the other half's counts."""
    counts = materialize(ngram_counts(rows), "ngram-counts")
    other = F.concat(F.when(F.col("model").startswith("0"), "1").otherwise("0"), F.substring("model", 2, 2**31 - 1))
    return probabilities(counts.withColumn("model", other), counts)


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """chunk, model, lang, doc_ids, hashes, lengths, texts (joined, compressed), n_codes (distinct n-grams).

    Of rows with doc_id, text_hash, lang, model, text. A block holds texts of one model, and so of one language, and at
    most `block` bytes, or one longer text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        chunk, kind = TaskContext.get().partitionId() << 33, None

        def emit(name: str) -> pa.RecordBatch:
            nonlocal chunk
            chunk += 1
            ids, hashes, langs, texts = zip(*held.pop(name))
            sizes.pop(name)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            columns = [
                pa.array([chunk], pa.int64()), pa.array([name], pa.string()), pa.array([langs[0]], pa.string()),
                pa.array([list(ids)], pa.list_(kind)), pa.array([list(hashes)], pa.list_(pa.int64())),
                pa.array([packed(lengths)], pa.binary()), pa.array([_compressed(texts)], pa.binary()),
                pa.array([len(np.unique(_inside(*codes(list(texts)))))], pa.int64()),
            ]
            return pa.record_batch(columns, names=_BLOCK)

        for batch in batches:
            kind = batch.schema.field(0).type
            names = batch.column(3).to_pylist()
            for name, *row in zip(names, *(batch.column(i).to_pylist() for i in range(3)), as_bytes(batch.column(4))):
                if sizes[name] and sizes[name] + len(row[3]) > block:
                    yield emit(name)
                held[name].append(row)
                sizes[name] += len(row[3])
                if sum(sizes.values()) > 8 * block:  # many languages at once
                    yield emit(max(sizes, key=sizes.get))
        for name in list(held):
            yield emit(name)

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"chunk long, model string, lang string, doc_ids array<{kind}>, hashes array<long>, lengths binary, texts binary, n_codes long"
    return rows.select("doc_id", "text_hash", "lang", "model", "text").mapInArrow(cut, schema)


_BLOCK = ["chunk", "model", "lang", "doc_ids", "hashes", "lengths", "texts", "n_codes"]


def _compressed(texts: list[bytes]) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(b"".join(texts), asbytes=True)


def _texts(row: dict) -> list[bytes]:
    lengths = unpacked(row["lengths"])
    joined = pa.decompress(row["texts"], decompressed_size=int(lengths.sum()), codec="zstd", asbytes=True)
    ends = np.cumsum(lengths)
    return [joined[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def _asked(found: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes ordered by range and code, and their ranges."""
    own = np.unique(found)
    part = own % ranges
    order = np.lexsort((own, part))
    return own[order], part[order]


def passages(log: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of each text the median over its passages of the mean of -log, nan without units. log lists the units of all texts."""
    sizes = stop - start
    out = np.full(len(sizes), np.nan)
    sums = np.concatenate([[0.0], np.cumsum(log)])
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes):
        n, first = int(sizes[i]), int(ends[i] - sizes[i])
        cuts = first + np.linspace(0, n, max(1, n // PASSAGE) + 1).astype(np.int64)
        out[i] = np.median((sums[cuts[:-1]] - sums[cuts[1:]]) / np.diff(cuts))
    return out


def perplexities(
    rows: DataFrame, model: DataFrame, counts: Callable[[list[bytes]], dict], names: list[str], block: int = BLOCK, wanted: int = RANGE
) -> DataFrame:
    """doc_id, text_hash, lang, log_perplexity (null without units) of every row, and what counts() says of its text.

    rows has doc_id, text_hash, lang, model, text; names are those of the long columns that counts() gives.
    """
    table = materialize(blocks(rows, block), "ngram-blocks")
    total = table.agg(F.sum("n_codes")).first()[0] or 0
    ranges = 2 * (total // wanted) + 1  # an odd number, as the low bits of codes are units of 16 bits

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, part = _asked(_inside(*codes(_texts(row))), ranges)
                if len(own):
                    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                    pieces = [packed(x) for x in np.split(own, edges[1:])]
                    n = len(pieces)
                    yield pa.record_batch(
                        {"part": pa.array(part[edges]), "chunk": pa.array([row["chunk"]] * n, pa.int64()),
                         "model": pa.array([row["model"]] * n, pa.string()), "codes": pa.array(pieces, pa.binary())}
                    )

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        names = known["model"].combine_chunks().dictionary_encode()
        which, code, log = names.indices.to_numpy(), known["code"].to_numpy(), np.log(known["p"].to_numpy())
        order = np.lexsort((code, which))
        which, code, log = which[order], code[order], log[order].astype("<f4")
        arrays = {}
        for i, name in enumerate(names.dictionary.to_pylist()):
            a, b = np.searchsorted(which, [i, i + 1])
            arrays[name] = code[a:b], log[a:b]
        out = []
        for name, codes_ in zip(asked["model"].to_pylist(), asked["codes"].to_pylist()):
            own, values = arrays[name]
            out.append(values[np.searchsorted(own, unpacked(codes_))].tobytes())
        return pa.table({"chunk": asked["chunk"], "part": asked["part"], "logs": pa.array(out, pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        texts = _texts(rows[0]) if rows else []
        all_codes, start, stop = codes(texts)
        inside = _inside(all_codes, start, stop)
        own, _ = _asked(inside, ranges)
        logs = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(x, "<f4") for x in right.sort_by("part")["logs"].to_pylist())])
        order = np.argsort(own)
        log = logs[order][np.searchsorted(own[order], inside)].astype(float) if len(own) else np.zeros(0)
        doc_ids = left["doc_ids"].combine_chunks().flatten()
        return pa.table(
            {
                "doc_id": doc_ids,
                "text_hash": left["hashes"].combine_chunks().flatten(),
                "lang": pa.array([rows[0]["lang"] if rows else None] * len(doc_ids), pa.string()),
                **{name: pa.array(x.astype(np.int64)) for name, x in counts(texts).items()},
                "log_perplexity": pa.array(passages(log, start, stop), from_pandas=True),
            }
        )

    kinds = "part long, chunk long, model string, codes binary"
    asked = table.select("chunk", "model", "lengths", "texts").mapInArrow(ask, kinds).groupBy("part")
    parts = model.select(F.pmod("code", F.lit(ranges)).alias("part"), "model", "code", "p").groupBy("part")
    answers = asked.cogroup(parts).applyInArrow(lambda a, b: answer(a, b), "chunk long, part long, logs binary")
    joined = table.select("chunk", "lang", "doc_ids", "hashes", "lengths", "texts").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, lang string, " + "".join(f"{c} long, " for c in names)
    return joined.applyInArrow(lambda a, b: score(a, b), schema + "log_perplexity double")
