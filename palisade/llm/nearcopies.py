"""Near copies by BagMinHash signatures of word-shingle multisets, banding, and exact overlap of the multisets.

Signature: each shingle owns Poisson processes of points in time over unit cells of weight, joined in dyadic intervals
(0,1], (1,2], (2,4], ... A point falls on a random register and, by the bits of its hash, into a cell of its interval; it
counts when the text holds the shingle often enough to cover that cell. A register keeps its first point, so two texts
agree in it with the probability of their weighted Jaccard similarity. Points later than all registers are never drawn.

Banding: texts that agree in all registers of a band share a bucket. Members are compared with the bucket's hub. What is
in another component than the hub then becomes a hub itself, some members at a time, until no bucket has a pair of
different components of which neither was a hub: no link inside a bucket is lost. These hubs meet the members of their
buckets in streamed blocks, where whole multisets are compared and only links that join components are given out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Rolling, Texts, as_bytes, chunks, lists, mix, text_of, whole_rows
from palisade.session import materialize

#: 32 bands of 5 registers miss a pair of similarity 0.8 once in 300,000 times.
BANDS, ROWS = 32, 5
#: Bytes of hubs, and of members, that about make a block; a longer text makes a block longer.
LEAD_BYTES, BLOCK_BYTES = 1 << 20, 1 << 18
#: About so many nodes of a family become hubs in one round; a larger family takes several rounds.
HUBS = 2000
WORDS, SIMILARITY = 5, 0.8
_STEP, _PICK, _LEVEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[bytes], size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: text number, hash and count, ordered by (text, hash), then two hashes of each text's words.

    A text of fewer words than size has one shingle, all its words; one without words has none.
    """
    words = Texts(texts).words()
    rolling = Rolling(words.hash)
    many = np.diff(words.first)
    number = np.where(many >= size, many - size + 1, (many > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), number)
    at = words.first[doc] + np.arange(len(doc)) - (np.cumsum(number) - number)[doc]
    value = rolling.of(at, np.minimum(at + size, words.first[doc + 1]))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    place = np.flatnonzero(new)
    count = np.diff(np.append(place, len(doc)))
    other = Rolling(mix(words.hash + _STEP))
    whole = np.stack([r.of(words.first[:-1], words.first[1:]) for r in (rolling, other)])
    return doc[place], value[place], count, whole


def bag_minhash(doc: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """First point in time of every register of every text."""
    first = np.full(texts * registers, np.inf)
    low, width, level = 0, 1, 0
    while len(doc) and low < count.max():
        own = np.flatnonzero(count > low)
        state = mix(value[own] + np.uint64(int(_LEVEL) * (level + 1) % 2**64))
        time = np.zeros(len(own))
        latest = first.reshape(texts, registers).max(axis=1)
        while len(own):
            state = state + _STEP
            draw = mix(state)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * width)
            alive = time < latest[doc[own]]
            own, state, time, draw = own[alive], state[alive], time[alive], draw[alive]
            pick = mix(draw ^ _PICK)
            register = ((pick >> np.uint64(40)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
            cell = low + (pick & np.uint64(width - 1)).astype(np.int64)
            held = cell < count[own]
            np.minimum.at(first, doc[own][held] * registers + register[held], time[held])
            latest = first.reshape(texts, registers).max(axis=1)
        low, width, level = (1, 1, 1) if level == 0 else (low + width, low + width, level + 1)
    return first.reshape(texts, registers)


def band_keys(first: np.ndarray, bands: int) -> np.ndarray:
    bits = np.ascontiguousarray(first).view(np.uint64).reshape(len(first), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), bits.shape[:2])
    for row in range(bits.shape[2]):
        key = mix(key + mix(bits[:, :, row] ^ _PICK))
    return key


def signatures(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """_id, s1, s2 (hashes of the words), bands (empty without words), size (bytes) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            wholes, keys, full = [np.zeros((2, 0), np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for begin, end in chunks(texts):
                doc, value, count, whole = shingles(texts[begin:end], size)
                first = bag_minhash(doc, value, count, end - begin, bands * rows)
                some = np.isfinite(first[:, 0])
                wholes.append(whole)
                full.append(some)
                keys.append(band_keys(first[some], bands).reshape(-1))
            whole, some = np.concatenate(wholes, axis=1).view(np.int64), np.concatenate(full)
            yield pa.record_batch(
                {
                    "_id": batch.column(0), "s1": pa.array(whole[0]), "s2": pa.array(whole[1]),
                    "bands": lists(np.concatenate(keys).view(np.int64), some * bands, pa.int64()), "size": pa.array(list(map(len, texts)), pa.int64()),
                }
            )

    return docs.mapInArrow(sign, "_id long, s1 long, s2 long, bands array<long>, size long")


def overlaps(texts: list[bytes], size: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of texts 0 and 1, 2 and 3, and so on."""
    doc, value, count, _ = shingles(texts, size)
    pair = doc // 2
    total = np.bincount(pair, weights=count, minlength=len(texts) // 2)
    order = np.lexsort((value, pair))
    value, pair, count = value[order], pair[order], count[order]
    same = np.flatnonzero((value[1:] == value[:-1]) & (pair[1:] == pair[:-1]))
    shared = np.bincount(pair[same], weights=np.minimum(count[same], count[same + 1]), minlength=len(total))
    return shared / np.maximum(1, total - shared)


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole multisets overlap enough. texts: _id, text."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [x for pair in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3))) for x in pair]
            good = np.zeros(len(both) // 2, bool)
            for begin, end in chunks([both[i] + both[i + 1] for i in range(0, len(both), 2)]):
                good[begin:end] = overlaps(both[2 * begin : 2 * end], size) >= similarity - 1e-9
            yield pa.record_batch([batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["a", "b"])

    left = texts.select(F.col("_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(verify, "a long, b long").distinct()


def _to_the_end(moves: DataFrame) -> DataFrame:
    """Moves (old, to) followed to their ends by doubling: a way of n steps takes log2(n) written tables."""
    while True:
        onward = moves.select(F.col("old").alias("via"), F.col("to").alias("end"))
        further = moves.join(onward, moves["to"] == onward["via"])
        further = further.select("old", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("more"))
        moves = materialize(further, "moves")
        if moves.where("more").isEmpty():
            return moves.select("old", "to")


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of every node with a link. links: a, b.

    Every node points to its smallest neighbour, the way of these pointers is followed to its end at once, and the links
    move along; again until none is left. A long chain costs the logarithm of its length in written tables.
    """
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = nodes.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        moved = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        moved = _to_the_end(materialize(moved.select(F.col("a").alias("old"), "to"), "moves"))
        roots = roots.join(moved, roots["root"] == moved["old"], "left")
        roots = materialize(roots.select("node", F.coalesce("to", "root").alias("root")), "roots")
        for end in ("a", "b"):
            edges = edges.join(moved, edges[end] == moved["old"]).drop(end, "old").withColumnRenamed("to", end)
        edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    return roots


def _fresh(label: np.ndarray, moved: dict[int, int]) -> np.ndarray:
    """Component labels after the merges made so far; every entry of moved leads straight to its end."""
    return np.array([moved.get(x, x) for x in label.tolist()], np.int64) if moved else label.copy()


def hub_links(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) between the hubs and the members of each block: enough to join the components that any link joins.

    rows: family, lead_block, block, later (0: hub), node, root, text. A block's hubs are held, its members are read as a
    stream; whole multisets are compared through the members' sorted shingles, and no pair becomes a row unless it joins
    two components.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs, moved = None, [], {}
        for batch in batches:
            family, lead, block, later, node, root = (batch.column(i).to_numpy() for i in range(6))
            texts, found = as_bytes(batch.column(6)), []
            change = (family[1:] != family[:-1]) | (lead[1:] != lead[:-1]) | (block[1:] != block[:-1])
            cut = np.flatnonzero(change | (later[1:] != later[:-1])) + 1
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(node)]):
                if group != (family[low], lead[low], block[low]):
                    group, hubs, moved = (family[low], lead[low], block[low]), [], {}
                for begin, end in chunks(texts[low:high]):
                    begin, end = low + begin, low + end
                    doc, value, count, _ = shingles(texts[begin:end], size)
                    total = np.bincount(doc, weights=count, minlength=end - begin)
                    if later[low] == 0:
                        edge = np.searchsorted(doc, np.arange(end - begin + 1))
                        for i in range(end - begin):
                            own = slice(edge[i], edge[i + 1])
                            hubs.append((int(node[begin + i]), int(root[begin + i]), value[own], count[own], total[i]))
                        continue
                    order = np.argsort(value, kind="stable")
                    doc, value, count = doc[order], value[order], count[order]
                    label = _fresh(root[begin:end], moved)
                    for hub, hub_root, hub_value, hub_count, hub_total in hubs:
                        own = moved.get(hub_root, hub_root)
                        if (label == own).all():
                            continue
                        first, last = np.searchsorted(value, hub_value), np.searchsorted(value, hub_value, "right")
                        many = last - first
                        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                        both = np.minimum(count[at], np.repeat(hub_count, many))
                        shared = np.bincount(doc[at], weights=both, minlength=end - begin)
                        close = shared >= (similarity - 1e-9) * (hub_total + total - shared)
                        good = np.flatnonzero(close & (label != own))
                        for other, i in zip(*np.unique(label[good], return_index=True)):
                            found.append((hub, int(node[begin + good[i]])))
                            moved.update({x: own for x, y in moved.items() if y == other})
                            moved[int(other)] = own
                            label[label == other] = own
            ends = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
            yield pa.record_batch({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    rows = rows.select("family", "lead_block", "block", "later", "node", "root", "text")
    dealt = rows.repartition("family", "lead_block", "block").sortWithinPartitions("family", "lead_block", "block", "later")
    return dealt.mapInArrow(match, "a long, b long")


def _blocks(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The block of every row of a family, by its hash: as many blocks as the family's bytes ask for, and their number."""
    parts = rows.groupBy("family").agg(F.ceil(F.sum("size") / most).cast("int").alias(f"{name}s"))
    rows = rows.join(parts, "family")
    return rows.withColumn(name, F.pmod(F.xxhash64("node"), F.col(f"{name}s")).cast("int"))


def _linked(members: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links that join all components that any link inside a bucket joins.

    members: key, node, hub (the bucket's smallest node). Buckets whose hubs are in one component form a family: its
    nodes are compared together, so a pair in many common buckets is compared once.
    """
    pairs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(verified(pairs, texts, size, similarity), "links")
    used, turn = members.select("key", F.col("hub").alias("node")).distinct(), 0
    while True:
        placed = members.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        main = placed.where("node = hub").select("key", F.col("root").alias("family"))
        others = placed.join(main, "key").where("root <> family").join(used, ["key", "node"], "left_anti")
        others = materialize(others.select("family", "key", "node"), "others")
        if others.isEmpty():
            return links
        share = others.groupBy("family").agg(F.ceil(F.count_distinct("node") / HUBS).alias("share"))
        now = F.pmod(F.xxhash64("node"), F.col("share")) == F.pmod(F.lit(turn), F.col("share"))
        chosen = materialize(others.join(share, "family").where(now).select("family", "key", "node"), "hubs")
        sized = nodes.select("node", "size")
        lead = _blocks(chosen.select("family", "node").distinct().join(sized, "node"), "lead_block", LEAD_BYTES)
        # only the members of buckets in which a hub was chosen
        row = placed.join(chosen.select("family", "key").distinct(), "key").select("family", "node", "root").distinct()
        row = materialize(_blocks(row.join(sized, "node"), "block", BLOCK_BYTES), "members")
        shape = row.groupBy("family").agg(F.max("blocks").alias("n"))
        leads = lead.groupBy("family").agg(F.max("lead_blocks").alias("n"))
        every = F.sequence(F.lit(0), F.col("n") - 1)
        hubs = lead.join(row.select("family", "node", "root"), ["family", "node"]).join(shape, "family")
        hubs = hubs.select("family", "lead_block", F.explode(every).alias("block"), F.lit(0).alias("later"), "node", "root")
        rest = row.join(leads, "family")
        rest = rest.select("family", F.explode(every).alias("lead_block"), "block", F.lit(1).alias("later"), "node", "root")
        rows = hubs.unionByName(rest).join(texts.withColumnRenamed("_id", "node"), "node")
        links = materialize(links.union(hub_links(rows, size, similarity)).distinct(), "links")
        used = materialize(used.union(chosen.select("key", "node")), "used-hubs")
        turn += 1


def near_copies(
    docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """_id (the doc_id), class_id of every row: the smallest doc_id of its class.

    Texts with the same words are one node; nodes of a class are joined by links of at least the similarity. A row
    without doc_id goes by a negative number made of its text. Rows with one doc_id are one document and fall into one
    class. Null texts and texts without words are copies of nothing. An empty table gives an empty result; other columns
    are not read.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1) - F.xxhash64(text_of()).bitwiseAND(F.lit(2**63 - 1)))
    rows_in = docs.select(own.alias("_id"), text_of().alias("text"))
    signed = materialize(signatures(rows_in, bands, rows, size), "signatures")
    nodes = signed.where(F.size("bands") > 0).groupBy("s1", "s2").agg(F.min(F.struct("_id", "bands", "size")).alias("x"))
    nodes = materialize(nodes.select("s1", "s2", F.col("x._id").alias("node"), "x.bands", "x.size"), "nodes")
    cells = nodes.select(F.explode("bands").alias("key"), "node")
    shared = cells.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    shared = shared.where("hub < last").drop("last")
    members = materialize(cells.join(shared, "key"), "buckets")
    wanted = members.select("node").distinct()
    texts = materialize(rows_in.join(wanted, rows_in["_id"] == wanted["node"], "left_semi"), "texts")
    roots = components(_linked(members, texts, nodes, size, similarity))
    placed = nodes.select("s1", "s2", "node").join(roots, "node", "left")
    placed = placed.select("s1", "s2", F.coalesce("root", "node").alias("class_id"))
    found = signed.where(F.size("bands") > 0).select("_id", "s1", "s2").join(placed, ["s1", "s2"], "left")
    alone = signed.where(F.coalesce(F.size("bands"), F.lit(0)) <= 0).select("_id", F.col("_id").alias("class_id"))
    return found.select("_id", "class_id").unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of every class, with all columns of docs."""
    firsts = near_copies(docs).where("_id = class_id").select(F.col("class_id").alias("_keep")).distinct()
    own = F.coalesce(
        F.col("_row.doc_id").cast("long"), F.lit(-1) - F.xxhash64(text_of("_row.text")).bitwiseAND(F.lit(2**63 - 1))
    )
    rows = whole_rows(docs).withColumn("_id", own)
    return rows.join(firsts, rows["_id"] == firsts["_keep"], "left_semi").dropDuplicates(["_id"]).select("_row.*")
