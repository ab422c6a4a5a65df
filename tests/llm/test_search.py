"""Ranked search, collocations and toxicity against brute force, on small tables cut into many parts."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import collocations, queries, toxicity, treap
from palisade.llm.common import packed, unpacked

SOME = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


# --- ranked search


def grid_scores(row, col, impact, rows, weights):
    sums = Counter()
    for r, c, v in zip(row.tolist(), col.tolist(), impact.tolist()):
        for asked, w in zip(rows, weights):
            if r == asked:
                sums[c] += v * w
    return sorted((-s, c) for c, s in sums.items() if s > 0)


@pytest.mark.parametrize("n_rows, n_cols, density", [(1, 1, 1), (40, 5, 0.5), (3, 700, 0.3), (300, 40, 0.05), (64, 64, 1)])
def test_treap_finds_the_best_columns(n_rows, n_cols, density):
    rng = np.random.default_rng(n_rows)
    row, col = np.nonzero(rng.random((n_rows, n_cols)) <= density)
    impact = rng.integers(1, 6, len(row)) * 100
    made = {k: unpacked(packed(v)) for k, v in treap.build(row, col, impact).items()}
    tree = treap.Treap(**made)
    assert tree.top[0] == impact.max() and len(made["rows"]) == len(row)
    for asked in ([0], list(range(0, n_rows, 3)), [n_rows - 1] if n_rows == 1 else [n_rows - 1, 0, n_rows // 2]):
        rows, weights = np.unique(asked), np.arange(1, len(set(asked)) + 1)
        brute = grid_scores(row, col, impact, rows.tolist(), weights.tolist())
        for k in (1, 5, 20):
            assert [(-s, c) for s, c in tree.best(rows, weights, k, 1)] == brute[:k]
        if len(brute) > 3:  # a score to reach leaves out the rest
            least = -brute[2][0]
            assert [(-s, c) for s, c in tree.best(rows, weights, 20, least)] == [x for x in brute if -x[0] >= least][:20]


TERM = re.compile("[0-9a-z\x80-\U0010ffff]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_ranked(docs, items, k):
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total, n = sum(b.total() for _, b in bags), len(bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, found = Counter(TERM.findall(lower(text))), []
        for i, bag in bags:
            m = 75 + 25 * bag.total() * n // total
            score = sum(
                c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t, c in asked.items()
                if bag[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit, items_per_block", [(200, 2), (10**6, 512)])
def test_ranked_search(spark, monkeypatch, limit, items_per_block):
    monkeypatch.setattr(treap, "ITEMS", items_per_block)
    rng = np.random.default_rng(3)
    words = [f"W{i}ä" if i % 3 else f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 50), p=None)), "en") for i in range(80)]
    docs += [(1000 - i, "same w0 w3 text", "en") for i in range(45)]  # more ties than are asked for
    docs += [(5, "w0 w0", "en"), (5, "w0 w0", "en"), (None, "w0 rare\tw3-W3", "en"), (6, None, "en"), (7, "-- !", "en")]
    items = [(1, "w0, W3! w0"), (1, "rare"), (2, None), (3, "nowhere"), (None, "W4Ä w5ä same"), (4, docs[3][1])]
    table = spark.createDataFrame(docs, DOCS).repartition(3).withColumn("score", F.lit("x")).withColumn("_rank", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(0))
    got = treap.ranked(table, asked, limit=limit)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_ranked([d[:2] for d in docs], items, 20)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(treap, "_SLICE", 10)
    text = "Ab-cd É1 " * 50 + "x" * 40
    assert [t for part in treap.terms(text.encode()) for t in part] == [t.encode() for t in TERM.findall(lower(text))]


# --- collocations


def brute_collocations(rows, support, longest, first):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < support:
                continue
            longer = [b for q, b in f.items() if len(q) > len(p) and b >= support and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:first]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("block, keys", [(1 << 24, 2_000_000), (60, 50)])
def test_collocations(spark, monkeypatch, block, keys):
    monkeypatch.setattr(collocations, "RANGE", keys)
    rng = np.random.default_rng(5)
    words = ["the", "Of", "aä", "\x1cq", "new", "york", "city", "x-y"]
    rows = [("en" if i % 3 else None, " ".join(rng.choice(words, 30))) for i in range(12)]
    rows += [("und", "New York\tCity, new  york city;NEW york\x0bcity! the the the the the")] * 3
    rows += [("de", "a b c d. a b c d! a b c d"), ("fr", None), ("fr", ""), ("fr", " .,\t"), ("x", "one")]
    table = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], DOCS).repartition(3)
    table = table.withColumn("rank", F.lit("r")).withColumn("words", F.lit(1))
    got = collocations.collocations(table, support=2, first=15, block=block).drop("words")
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 2, 4, 15)


def test_collocations_without_lang(spark):
    table = spark.createDataFrame([(1, "a b. a b")], "doc_id long, text string")
    got = collocations.collocations(table, support=2).select("lang", "phrase", "a", "n").collect()
    assert [tuple(r) for r in got] == [("und", "a b", 2, 4)]


def test_a_block_takes_no_object_per_word(spark, monkeypatch):
    """Executors hold several blocks at once, so a block's peak must stay near its bytes."""
    table = spark.createDataFrame([], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(table), "mapInArrow", lambda self, function, schema: function)
    monkeypatch.setattr(collocations, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    blocks = collocations.occurrences(table)
    rng = np.random.default_rng(3)
    text = " ".join(f"w{i:04d}" for i in rng.integers(0, 3000, 500_000))
    batch = pa.record_batch([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    tracemalloc.start()
    rows = list(blocks(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r["n_words"][0].as_py() for r in rows) == 500_000
    assert peak < 8 * len(text)


# --- toxicity


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    words = [f"word{i}".encode() for i in range(20)]
    known = np.arange(20) % 7
    tri, first = toxicity.trigrams(words)
    net = {k: v.astype(np.float64) for k, v in toxicity.new_network(rng).items()}
    at = rng.integers(0, 21, (5, toxicity.WINDOW))
    at[:, 0] = 3  # a window has a word
    y = rng.integers(0, 2, 5)

    def loss():
        out = toxicity.forward(net, toxicity.projected(net, toxicity.inputs_of(net, known, tri, first)), at)[0]
        return (np.log1p(np.exp(out)) - y * out).sum()

    grad, _ = toxicity.gradients(net, known, tri, first, at, lambda out: toxicity.sigmoid(out) - y)
    for name, w in net.items():
        g, flat = grad[name].reshape(-1), w.reshape(-1)
        for i in np.argsort(-np.abs(g))[:4]:
            before, step = flat[i], 1e-2
            flat[i] = before + step
            up = loss()
            flat[i] = before - step
            down = loss()
            flat[i] = before
            assert math.isclose((up - down) / (2 * step), g[i], rel_tol=0.05, abs_tol=2e-3), name


def test_every_word_is_in_a_window():
    for n in (1, 2, 63, 64, 65, 112, 113, 500):
        ids = np.arange(n)
        seen = toxicity.windows(ids, toxicity.starts(n), n)
        assert set(seen.ravel().tolist()) - {n} == set(range(n))
    assert len(toxicity.starts(0)) == 0


def test_toxic_texts_are_found(spark):
    """Texts with the words that mark the label, against those without, among rows that the fit never saw."""
    place = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.QUERIES["op12_toxicity"](spark, place).collect()}
    docs = spark.read.parquet(place + "/documents.parquet").collect()
    assert len(rows) == len(docs)
    marks = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "loser", "scum", "moron"}
    bad, clean = [], []
    for d in docs:
        r = rows[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["held_out"]:
            (bad if marks & set(re.findall("[a-z]+", lower(d["text"]))) else clean).append(r["predicted"])
    assert len(bad) > 10 and np.mean(bad) >= 0.9 and np.mean(clean) <= 0.1


def test_texts_without_words_or_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, ""), (None, "..."), (4, "a b " * 400)], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("s")).withColumn("predicted", F.lit(None).cast("int"))
    marks = "doc_id long, quality int, toxic int"
    for found, share in (([], 0.0), ([(1, 1, 0)], 0.0), ([(1, 1, 1), (4, 1, 1)], 1.0), ([(1, 0, 7)], 0.0)):
        got = toxicity.toxicity(docs, spark.createDataFrame(found, marks)).collect()
        assert [r["score"] for r in got] == [share] * 5
    both = [(1, 1, 1), (4, 1, 0), (4, 1, 0)]
    got = toxicity.toxicity(docs, spark.createDataFrame(both, marks)).collect()
    assert math.isclose(got[1]["score"], 1 / 3) and got[1]["score"] == got[2]["score"] == got[3]["score"]
    assert got[0]["score"] > got[4]["score"]


def test_ranges_of_a_task_are_written_apart(spark, monkeypatch):
    """A task may make any number of ranges of megabytes each: the writer and later readers hold a few of them at a time."""
    import pyarrow.parquet as pq

    from palisade.llm.common import stored
    from palisade.session import LARGE_ROWS, materialize

    asked = {}
    monkeypatch.setattr(treap, "materialize", lambda df, name, **options: asked.update({name: options}) or materialize(df, name, **options))
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text")).coalesce(1)
    assert treap.index(docs, limit=3)[0].count() == 6
    assert asked == {"postings": LARGE_ROWS, "treaps": LARGE_ROWS}

    def blobs(batches):
        for batch in batches:
            for n in batch.column(0).to_pylist():
                yield pa.record_batch({"blob": pa.array([np.random.default_rng(n).bytes(5_000_000)], pa.binary())})

    table = materialize(spark.range(0, 12, 1, 1).mapInArrow(blobs, "blob binary"), "blobs", **LARGE_ROWS)
    file = pq.ParquetFile(table.inputFiles()[0].removeprefix("file:")).metadata
    assert file.num_rows == 12 and file.num_row_groups >= 3
    made = treap.build(np.array([0, 1]), np.array([0, 1]), np.array([5, 7]))
    tree = treap.Treap(**{k: stored(packed(v)) for k, v in made.items()})
    assert tree.top.itemsize == tree.child.itemsize == 4 and tree.mask.itemsize == 1
