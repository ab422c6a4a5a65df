"""Token counts of whole texts without moving a pre-token between machines.

Texts are cut into pre-tokens where they lie. A small table of frequent pre-tokens and their token counts is broadcast;
what it lacks is encoded by the library once per worker and kept in that worker's cache.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import as_bytes, chunks, text_of

#: The pre-token pattern of byte-level BPE, and the characters for which every Unicode version in use agrees.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = regex.compile("[\t-\r\x20-\x7e\xa1-ɏ]*+")
SAMPLE_DOCS, TASK_ENTRIES, TABLE_ENTRIES, CACHE_ENTRIES, PIECE_CHARS = 20_000, 4096, 32_768, 400_000, 64

_loaded: dict = {}


def library(path: str):
    """The tokenizer as the library reads it, once per worker; no truncation, no padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def special_strings(path: str) -> list[str]:
    return [t.content for t in library(path).get_added_tokens_decoder().values()]


def encoded_lengths(path: str, texts: list[str]) -> list[int]:
    return [len(e) for e in library(path).encode_batch(texts, add_special_tokens=False)]


def pieces_of(text: str, special: list[str]) -> list[str] | None:
    """Pre-tokens, or None where the library must see the whole text: special strings and rarer characters."""
    if not PLAIN.fullmatch(text) or any(s in text for s in special):
        return None
    return PIECE.findall(text)


def frequent(docs: DataFrame, path: str) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of about SAMPLE_DOCS documents; at most TABLE_ENTRIES entries.

    Tasks hand over their own TASK_ENTRIES most frequent ones, so what is shuffled does not grow with the texts. The
    table only saves time: every count is the library's, whatever it holds.
    """
    part = min(1.0, SAMPLE_DOCS / max(1, docs.count()))

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(PIECE.findall(text))
                if len(found) > 16 * TASK_ENTRIES:
                    found = Counter(dict(found.most_common(8 * TASK_ENTRIES)))
        top = [(p, n) for p, n in found.most_common(TASK_ENTRIES) if len(p) <= PIECE_CHARS]
        yield pa.record_batch({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    sample = docs.sample(part, seed=1).select(text_of().alias("text")) if part < 1 else docs.select(text_of().alias("text"))
    sums = sample.mapInArrow(most, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r["piece"] for r in sums.orderBy(F.desc("n"), "piece").limit(TABLE_ENTRIES).collect()]
    return dict(zip(top, encoded_lengths(path, top)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; a null text counts as empty, other columns are not read.

    Special strings inside a text become their own tokens, as the library does by default.
    """
    spark = docs.sparkSession
    table, mark = spark.sparkContext.broadcast(frequent(docs, path)), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, known = special_strings(path), _loaded.get("known")
        if known is None or _loaded.get("mark") != mark:
            known = dict(table.value)
            _loaded.update(known=known, mark=mark)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            raw = as_bytes(batch.column(1))
            lengths: list[int] = []
            for begin, end in chunks(raw):
                cut = [pieces_of(t, special) for t in texts[begin:end]]
                new = list(set().union(*[c for c in cut if c]) - known.keys())
                if len(known) + len(new) > CACHE_ENTRIES:
                    known.clear()
                    known.update(table.value)
                    new = list(set().union(*[c for c in cut if c]) - known.keys())
                known.update(zip(new, encoded_lengths(path, new)))
                for text, pieces in zip(texts[begin:end], cut):
                    if pieces is None:
                        lengths += encoded_lengths(path, [text])
                    else:
                        lengths.append(sum(map(known.__getitem__, pieces)))
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_bytes": pa.array(list(map(len, raw)), pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                }
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
