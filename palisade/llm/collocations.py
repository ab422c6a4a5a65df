"""Phrase collocations by set-oriented mining: occurrence relations are written, joined with themselves and cut back.

The occurrences of phrases of k words are a written table, sorted by place: a row holds the places of one block of
pieces, a number per place, 0 where no frequent phrase of k words begins. Places are numbered through a block and the
end of a piece takes one, so neighbours are always words of one piece. A round merge-joins the relation with itself at
adjacent places: phrases of k words at p and at p + 1 make the phrase of k + 1 words at p. The joined phrases are
counted per block, then per group: every block sends each key range one row with its sorted keys and counts, one task
sums a range, names the frequent keys and answers each block with the names of its own keys. The block drops the places
whose phrase was not named before the next round joins what is left. Keys are pairs of names, so counts are exact.

A block holds at most BLOCK bytes, or one piece that is longer; longer texts are cut between pieces. A key range is
sized by the number of words, and a block names a phrase once however often it holds it, so a phrase that fills a third
of the corpus is one entry per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import mix, packed, text_of, unpacked
from palisade.session import materialize

SUPPORT, LONGEST = 30, 4
#: A candidate gives way to a longer one with at least so many hundredths of its occurrences.
COVERED = 80
BLOCK = 16 << 20
#: Keys of one range, at most, on average.
RANGE = 2_000_000
_ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(_ENDS) + b" ")


def _cut(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of at most limit bytes that end with a piece; a longer piece is a part of its own."""
    begin = 0
    while len(text) - begin > limit:
        end = text.rfind(b"\n", begin, begin + limit)
        if end < 0 and (end := text.find(b"\n", begin + limit)) < 0:
            break
        yield text[begin:end]
        begin = end + 1
    yield text[begin:]


def occurrences(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """chunk, lang, n_words, words (distinct, most frequent first), of (place to 1 + number of its word, 0 at an end)."""

    def relation(chunk: int, lang: str, parts: list[bytes]) -> tuple[list[pa.Array], bool]:
        # arrays only: a Python object per word would take several times the block's bytes
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        parts.clear()
        inside, ends = (data != 0x20) & (data != 0x0A), np.flatnonzero(data == 0x0A).astype(np.int32)
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False)).astype(np.int32)
        start, n_places = edge[0::2], len(edge) // 2 + len(ends)
        place = np.searchsorted(ends, start).astype(np.int32) + np.arange(len(start), dtype=np.int32)
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(edge[1::2] - start, out=offsets[1:])
        letters = data[inside]
        del data, inside, ends, edge, start
        tokens = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        tokens = tokens.dictionary_encode()
        code, words = tokens.indices.to_numpy(), tokens.dictionary
        del tokens, offsets, letters
        order = np.argsort(-np.bincount(code, minlength=len(words)), kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(1, len(order) + 1)
        of = np.zeros(n_places, np.int64)
        of[place] = number[code]
        words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.take(pa.array(order)))
        few = [pa.array([v], f.type) for v, f in zip((chunk, lang, len(code)), layout)]
        return [*few, words, pa.array([packed(of)], pa.binary())], len(order) > 0

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        chunk = TaskContext.get().partitionId() << 33

        def emit(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            columns, some = relation(chunk, lang, held.pop(lang))
            sizes.pop(lang)
            if some:
                chunk += 1
                yield pa.record_batch(columns, schema=layout)

        for batch in batches:
            for lang, text in zip(*batch.columns):  # one text at a time, as a batch may hold many
                lang, text = lang.as_py(), text.cast(pa.binary()).as_py() or b""
                for part in _cut(text.translate(_LOWER), block):
                    if lang in held and sizes[lang] + len(part) > block:
                        yield from emit(lang)
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sum(sizes.values()) > 4 * block:  # many languages at once
                        yield from emit(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from emit(lang)

    layout = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.list_(pa.binary())), ("of", pa.binary())])
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    return docs.select(lang.alias("lang"), text_of().alias("text")).mapInArrow(
        blocks, "chunk long, lang string, n_words long, words array<binary>, of binary"
    )


def _ranges(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array with where it stands."""
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
    for begin, end in zip(edges, np.append(edges[1:], len(part))):
        yield int(part[begin]), slice(begin, end)


def _by_range(words: list[bytes], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers ordered by key range, and their ranges."""
    part = np.fromiter((zlib.crc32(w) % ranges for w in words), np.int64, len(words))
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _join(of: np.ndarray, names: np.ndarray, ranges: int) -> tuple:
    """Adjacent places joined: the places, the rank of each one's key, and per key range, prefix, rest and count."""
    at = np.flatnonzero((of[:-1] > 0) & (of[1:] > 0))
    key, rank, n = np.unique((of[at] - 1) * len(names) + of[at + 1] - 1, return_inverse=True, return_counts=True)
    prefix, rest = names[key // max(1, len(names))], names[key % max(1, len(names))]
    part = (mix(mix(prefix.astype(np.uint64)) + rest.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((rest, prefix, part))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return at, place[rank], part[order], prefix[order], rest[order], n[order]


_ANSWER = "chunk long, part long, names binary, name long, prefix long, rest long, lang string, word binary, a long"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
_FIELDS = pa.schema(list(zip((f.split()[0] for f in _ANSWER.split(", ")), _KINDS)))


def _answers(part: int, chunks: list[int], sizes: list[int], key: np.ndarray, sums: np.ndarray, support: int, columns: dict) -> pa.Table:
    """Of a key range: the frequent keys with new names and counts, and for each block the names of its keys (0: none).

    key numbers the distinct keys for every entry, block by block; columns hold the keys' own values.
    """
    frequent = sums >= support
    named = np.where(frequent, (part << 40) + np.cumsum(frequent), 0)
    own = named[key]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    answers = {
        "chunk": chunks,
        "part": [part] * len(chunks),
        "names": [packed(own[a:b]) for a, b in zip(edges[:-1], edges[1:])],
    }
    counts = {"name": named[frequent], "a": sums[frequent], **{c: v.filter(pa.array(frequent)) for c, v in columns.items()}}

    def table(found: dict, n: int) -> pa.Table:
        return pa.table([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(n, f.type) for f in _FIELDS], schema=_FIELDS)

    return pa.concat_tables([table(answers, len(chunks)), table(counts, int(frequent.sum()))])


def frequent_words(relation: DataFrame, ranges: int, support: int) -> DataFrame:
    """Answers and counts of the words of all blocks, per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, words, of in (tuple(x.as_py() for x in row) for row in zip(*batch.columns)):
                n = np.bincount(unpacked(of), minlength=len(words) + 1)[1:]
                order, part = _by_range(words, ranges)
                found = [
                    (p, chunk, lang, [words[i] for i in order[at]], packed(n[order[at]])) for p, at in _ranges(part)
                ]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary()), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["part", "chunk", "lang", "words", "n"])

    def sums(table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk").combine_chunks()
        sizes = np.diff(rows["words"].combine_chunks().offsets.to_numpy())
        words = rows["words"].combine_chunks().flatten()
        lang = rows["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        n = np.concatenate([unpacked(x) for x in rows["n"].to_pylist()])
        entries = pa.table({"lang": lang, "word": words, "n": n, "at": np.arange(len(n))})
        groups = entries.group_by(["lang", "word"]).aggregate([("n", "sum"), ("at", "list")])
        groups = groups.sort_by([("lang", "ascending"), ("word", "ascending")]).combine_chunks()
        at = groups["at_list"].combine_chunks()
        key = np.empty(len(n), np.int64)
        key[at.flatten().to_numpy()] = np.repeat(np.arange(len(groups)), np.diff(at.offsets.to_numpy()))
        columns = {"lang": groups["lang"].combine_chunks(), "word": groups["word"].combine_chunks()}
        part = rows["part"][0].as_py()
        return _answers(part, rows["chunk"].to_pylist(), list(sizes), key, groups["n_sum"].to_numpy(), support, columns)

    rows = relation.select("chunk", "lang", "words", "of").mapInArrow(
        count, "part long, chunk long, lang string, words array<binary>, n binary"
    )
    return rows.groupBy("part").applyInArrow(sums, _ANSWER)


def frequent_joins(relation: DataFrame, ranges: int, support: int) -> DataFrame:
    """Answers and counts of the phrases one word longer than those of the relation (columns chunk, of, names)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, of, names in (tuple(x.as_py() for x in row) for row in zip(*batch.columns)):
                _, _, part, prefix, rest, n = _join(unpacked(of), unpacked(names), ranges)
                found = [(p, chunk, *(packed(x[at]) for x in (prefix, rest, n))) for p, at in _ranges(part)]
                if found:
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["part", "chunk", "prefix", "rest", "n"])

    def sums(table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk").combine_chunks()
        parts = {c: [unpacked(x) for x in rows[c].to_pylist()] for c in ("prefix", "rest", "n")}
        sizes = [len(x) for x in parts["n"]]
        prefix, rest, n = (np.concatenate(parts[c]) for c in ("prefix", "rest", "n"))
        order = np.lexsort((rest, prefix))
        new = np.append(True, (np.diff(prefix[order]) != 0) | (np.diff(rest[order]) != 0))
        first = order[new]
        key = np.empty(len(n), np.int64)
        key[order] = np.cumsum(new) - 1
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        columns = {"prefix": pa.array(prefix[first]), "rest": pa.array(rest[first])}
        return _answers(rows["part"][0].as_py(), rows["chunk"].to_pylist(), sizes, key, total, support, columns)

    rows = relation.select("chunk", "of", "names").mapInArrow(count, "part long, chunk long, prefix binary, rest binary, n binary")
    return rows.groupBy("part").applyInArrow(sums, _ANSWER)


def kept_places(relation: DataFrame, answers: DataFrame, ranges: int, first: bool) -> DataFrame:
    """chunk, of, names: the joined places (of the first relation: all) whose phrase has a name. Blocks without any go."""

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if left.num_rows and right.num_rows:
            of = unpacked(left["of"][0].as_py())
            names = np.concatenate([unpacked(x) for x in right.sort_by("part")["names"].to_pylist()])
            if first:
                words = left["words"][0].as_py()
                order, _ = _by_range(words, ranges)
                at, rank = np.flatnonzero(of), np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                rank = rank[of[at] - 1]
            else:
                at, rank = _join(of, unpacked(left["names"][0].as_py()), ranges)[:2]
            number = np.where(names > 0, np.cumsum(names > 0), 0)
            found = np.zeros(len(of), np.int64)
            found[at] = number[rank]
            if found.any():
                out = [[left["chunk"][0].as_py()], [packed(found)], [packed(names[names > 0])]]
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["chunk", "of", "names"])

    answers = answers.where("chunk IS NOT NULL").select("chunk", "part", "names")
    columns = ["chunk", "of", "words"] if first else ["chunk", "of", "names"]
    joined = relation.select(*columns).groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return joined.applyInArrow(keep, "chunk long, of binary, names binary")


def phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, block: int = BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """Per length 1 to longest the frequent phrases, and the words of each language (lang, n).

    Phrases: name, lang, words, a; prefix and rest (names of the phrase without its last or first word); heads and tails
    (occurrences of its first and of its last 1, 2, ... words).
    """
    relation = materialize(occurrences(docs, block), "occurrences")
    sizes = relation.groupBy("lang").agg(F.sum("n_words").alias("n"))
    total = relation.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(1, -(-total // RANGE))
    found = []
    for length in range(1, longest + 1):
        mined = frequent_words if length == 1 else frequent_joins
        answers = materialize(mined(relation, ranges, support), "phrase-counts")
        counts = answers.where("name IS NOT NULL")
        if length == 1:
            one = F.array("a")
            level = counts.select("name", "lang", F.array(F.col("word").cast("string")).alias("words"), "a", one.alias("heads"), one.alias("tails"))
        else:
            shorter = found[-1]
            before = shorter.select(F.col("name").alias("prefix"), "lang", F.col("words").alias("_words"), F.col("heads").alias("_heads"))
            after = shorter.select(F.col("name").alias("rest"), F.element_at("words", -1).alias("_last"), F.col("tails").alias("_tails"))
            level = counts.select("name", "prefix", "rest", "a").join(before, "prefix").join(after, "rest").select(
                "name", "prefix", "rest", "lang", F.array_append("_words", F.col("_last")).alias("words"), "a",
                F.array_append("_heads", F.col("a")).alias("heads"), F.array_append("_tails", F.col("a")).alias("tails"),
            )
        found.append(materialize(level, "phrases"))
        if length < longest:
            relation = materialize(kept_places(relation, answers, ranges, length == 1), "occurrences")
    return found, sizes


def _weakest_cut(length: int) -> Column:
    """score, k, l, r of the cut with the lowest score, the first of equals. Decimals, as products may pass 64 bits."""
    cuts = [
        F.struct(
            F.expr(f"CAST(2000000 AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) div (CAST(heads[{k - 1}] AS DECIMAL(19, 0)) + tails[{length - k - 1}])").alias("score"),
            F.lit(k).alias("k"), F.col("heads")[k - 1].alias("l"), F.col("tails")[length - k - 1].alias("r"),
        )
        for k in range(1, length)
    ]
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, first: int = 2000, block: int = BLOCK) -> DataFrame:
    """lang, rank, words, phrase, a, l, r, n, score: each language's first collocations.

    A null lang counts as `und`, together with rows of that name; a null or empty text has no words; equal rows count as
    often as they occur; equal scores rank by occurrences, then by phrase in byte order; an empty table gives no rows;
    other columns are not read. A text is cut between pieces, so its length is no bound; a piece of words without any
    end is held by one task.
    """
    levels, sizes = phrases(docs, support, longest, block)
    scored = []
    for length in range(2, longest + 1):
        level = levels[length - 1].withColumn("cut", _weakest_cut(length))
        if length < longest:
            # whatever covers a phrase from further out covers it through one of the phrases one word longer
            longer = levels[length]
            inside = longer.select(F.col("prefix").alias("name"), "a").unionAll(longer.select("rest", "a"))
            inside = inside.groupBy("name").agg(F.max("a").alias("_longer"))
            level = level.join(inside, "name", "left")
        else:
            level = level.withColumn("_longer", F.lit(None).cast("long"))
        covered = F.expr(f"CAST(_longer AS DECIMAL(19, 0)) * 100 >= CAST(a AS DECIMAL(19, 0)) * {COVERED}")
        level = level.where(~F.coalesce(covered, F.lit(False)))
        scored.append(level.select("lang", "words", F.concat_ws(" ", "words").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    rows = scored[0]
    for more in scored[1:]:
        rows = rows.unionAll(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "words", "phrase", "a", "l", "r", "n", "score")
