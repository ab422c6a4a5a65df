"""The text operators against brute force, on whole small tables and on awkward ones."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import difference
from palisade.llm import common, contamination, hilbert, lines, mixing, nearcopies, ngrams, personal, quality, queries, repeats, suffix, tokens
from palisade.llm.suffix import permuted_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, hash string, key string, _id int"
LABELS = "doc_id long, quality int, toxic int"
#: (.)(.) many times over, so that several words repeat at long distances.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000)) + "\n" + "a" * 5000
COPY = " ".join(f"copy{i}" for i in range(130))
NEAR = COPY.replace("copy64", "other")
ROWS = [
    (1, None, None, None, None, 1, "x", "k", 1),
    (2, "", "en", "b", 0, 1, "x", "k", 1),
    (3, "   \n\t", "en", "b", 0, 1, "x", "k", 1),
    (4, "one two", "en", "a", 7, None, None, None, None),
    (5, COPY, "de", "a", 1, 1, "x", "k", 1),
    (6, COPY, "de", "a", 1, 1, "x", "k", 1),
    (6, COPY, "de", "a", 1, 1, "x", "k", 1),
    (7, NEAR, "xx", "a", 1, 1, "x", "k", 1),
    (8, LONG, "en", "ü", 1, 1, "x", "k", 1),
    (None, "Null id, mail me: jo.doe+x@mail.example.com or +49 (30) 1234-5678\nLine that is long enough to count\nb", "en", "ü", 1, 1, "x", "k", 1),
    (10, "  LINE that is long enough to count \nb\n", "fr", "b", 1, 1, "x", "k", 1),
    (11, "line that is long enough to count\n\nc <|endoftext|> 测试 \x1c x", "fr", "b", 1, 1, "x", "k", 1),
    (12, "ÄÖ line that is long enough to count", "es", "b", 1, 1, "x", "k", 1),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path + "/documents.parquet")
    items = [(1, "copy3 Copy4-copy5"), (2, " ".join(f"COPY{i}" for i in range(100, 125))), (3, None), (4, "..."), (None, "w1x1")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    marks = [(4, 1, 0), (5, 1, 1), (8, 0, 0), (8, 0, 1), (10, 1, None), (None, 1, 1), (99, 1, 1)]
    spark.createDataFrame(marks, LABELS).write.parquet(path + "/labels.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    spark.createDataFrame([], LABELS).write.parquet(path + "/labels.parquet")
    return path


@pytest.fixture(scope="module")
def some():
    return "/root/testdata/sf0.001"


@pytest.fixture(params=["odd", "some"])
def place(request):
    return request.getfixturevalue(request.param)


def texts(spark, place):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(place + "/documents.parquet").collect()]


def result(spark, place, name):
    return queries.QUERIES[name](spark, place)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert result(spark, empty, name).collect() == []


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, place, name, tmp_path):
    rows = result(spark, place, name)
    glob = place if place.startswith("/root") else None
    if glob is None:
        import duckdb

        for table in ("documents", "benchmark", "labels"):
            duckdb.sql(f"COPY (SELECT * FROM '{place}/{table}.parquet/*.parquet') TO '{tmp_path}/{table}.parquet'")
        for table in "region nation customer supplier part orders lineitem events embeddings pages conversations".split():
            (tmp_path / f"{table}.parquet").symlink_to(f"/root/testdata/sf0.001/{table}.parquet")
        glob = str(tmp_path)
    assert difference(rows, glob, queries.ORACLE[name]) is None


def test_mix_meets_targets(spark, some):
    rows = result(spark, some, "op1_mix_curriculum").collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(some + "/documents.parquet").collect()}
    taken = Counter()
    for r in rows:
        taken[source[r["doc_id"]], r["target"]] += r["taken"]
    assert all(abs(n - target) <= 1 for (_, target), n in taken.items())
    assert math.isclose(sum(t for _, t in taken), 1.5 * sum(r["size"] for r in rows))
    order = [r["position"] for r in rows if r["position"] is not None]
    assert order == sorted(order)


def test_training_order_repeats_whole_documents(spark, odd):
    docs = common.documents(spark, odd)
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    most = Counter(r["doc_id"] for r in out.collect())
    assert max(most.values()) <= 4 and 3 not in most  # doc 6 is there twice


def brute_times(rows, share=1.5, times=2):
    """(time, index of the row) of every copy in the mix, rows alike in source, hash and size by their other columns."""
    words = [len(WORD.findall(r["text"] or "")) for r in rows]
    by_source = defaultdict(list)
    for i, r in enumerate(rows):
        by_source[r["source"]].append(i)
    names = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [None] * (None in by_source)
    kind = {s: k % 3 for k, s in enumerate(names)}
    weight = {s: mixing.area(mixing.SCHEDULES[kind[s]]) for s in names}
    size = {s: sum(words[i] for i in by_source[s]) for s in names}
    target, left, free = {}, share * sum(size.values()), set(names)
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) >= times * size[s]]:
        for s in over:
            target[s] = times * size[s]
            left -= target[s]
            free.discard(s)
    for s in free:
        target[s] = left * weight[s] / sum(weight[x] for x in free)
    out = []
    for s in names:
        (_, w0), (_, w1) = mixing.SCHEDULES[kind[s]]
        own = sorted(by_source[s], key=lambda i: (hashlib.md5(f"{'' if rows[i]['doc_id'] is None else rows[i]['doc_id']}|0".encode()).hexdigest(), words[i], str(rows[i])))
        done = 0
        for i in own * times:
            if words[i] and done < math.floor(target[s]):
                x = done / target[s] * weight[s]
                out.append((2 * x / (w0 + math.sqrt(w0 * w0 + 2 * (w1 - w0) * x)), i))
            done += words[i]
    return sorted(out)


@pytest.mark.parametrize("per_range, per_slice", [(2_000, 20_000), (3, 20_000), (1, 5)])
def test_training_order_is_exact_across_ranges(spark, some, monkeypatch, per_range, per_slice):
    monkeypatch.setattr(mixing, "RANGE_ROWS", per_range)
    monkeypatch.setattr(mixing, "SLICE_ROWS", per_slice)
    base = [r.asDict() for r in common.documents(spark, some).collect()]
    for r in base:
        r["source"] = f"s{r['doc_id'] % 4}" if r["doc_id"] % 9 else None
    plain = [r | {"doc_id": None, "text": f"alike {r['doc_id'] % 5}"} for r in base[:60]]  # one hash and one size, few texts
    rows = base + base[:40] * 3 + plain + plain + [base[0] | {"text": None}, base[1] | {"text": " "}]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], common.documents(spark, some).schema).repartition(5)
    out = [r.asDict() for r in mixing.training_order(docs).collect()]
    want = brute_times(rows)
    alike = lambda r: (r["source"] or "", r["doc_id"] or 0, len((r["text"] or "").split()))
    assert Counter(map(alike, out)) == Counter(alike(rows[i]) for _, i in want)
    assert Counter(str(r) for r in out if r["doc_id"] is not None) == Counter(str(rows[i]) for _, i in want if rows[i]["doc_id"] is not None)
    for source in (None, "s0", "s1", "s2", "s3"):
        assert [alike(r) for r in out if r["source"] == source] == [alike(rows[i]) for _, i in want if rows[i]["source"] == source]
    cuts = [0, *(k for k in range(1, len(want)) if want[k][0] - want[k - 1][0] > 1e-9), len(want)]
    for low, high in zip(cuts, cuts[1:]):  # runs of one time
        assert Counter(map(alike, out[low:high])) == Counter(alike(rows[i]) for _, i in want[low:high])


def test_training_order_shuffles_whole_rows_once(spark, some):
    text = mixing.training_order(common.documents(spark, some))._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"\bExchange (\w+)", text) == ["rangepartitioning"]


def test_time_inverts_demand(spark):
    kinks = [[(0.0, 1.0), (0.5, 3.0), (1.0, 0.0)]]
    done = spark.range(0, 100).select(F.col("id").cast("double").alias("c"))
    time = mixing.training_time(F.col("c"), F.lit(100.0), F.lit(0), kinks)
    xs, ws = np.array([0, 0.5, 1.0]), np.array([1.0, 3.0, 0.0])
    for c, t in done.select("c", time).collect():
        at = np.linspace(0, t, 2001)
        assert abs(np.trapezoid(np.interp(at, xs, ws), at) / mixing.area(kinks[0]) - c / 100) < 1e-3


def test_curve_is_a_curve():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij")).reshape(3, -1)
    index = hilbert.curve_index(cells, 3)
    assert sorted(index) == list(range(side**3))
    path = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_shards(spark, place):
    rows = result(spark, place, "op2_hilbert_shards").collect()
    known = Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts(spark, place))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == known
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append((r["slot"], r["index"]))
    counts = [len(v) for v in slots.values()]
    assert max(counts) - min(counts) <= 1 and set(slots) == set(range(8))
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in slots.values())
    ends = [(min(i for _, i in slots[s]), max(i for _, i in slots[s])) for s in range(8)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def shingle_bag(text):
    words = WORD.findall(text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(rows):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(d, shingle_bag(t)) for d, t in rows]
    holders = defaultdict(set)
    for i, (d, bag) in enumerate(bags):
        root.setdefault(d, d)
        for g in bag:
            holders[g].add(i)
    tried = set()
    for i, (d, bag) in enumerate(bags):
        for j in {j for g in bag for j in holders[g]}:
            if j > i and (i, j) not in tried:
                tried.add((i, j))
                other = bags[j][1]
                if sum((bag & other).values()) >= 0.8 * sum((bag | other).values()):
                    a, b = sorted((find(d), find(bags[j][0])))
                    root[b] = a
    return {d: find(d) for d, _ in rows}


def test_near_copies(spark, place):
    rows = [(d, t) for d, t in texts(spark, place) if d is not None]
    got = {r["doc_id"]: r["class_id"] for r in result(spark, place, "op3_near_copies").collect() if r["doc_id"] >= 0}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_of_templates(spark, monkeypatch, small):
    """Buckets whose members are only partly alike: nothing alike may be missed, in one round or in many small ones."""
    if small:
        for name, value in (("HUBS", 40), ("LEAD_BYTES", 4000), ("BLOCK_BYTES", 9000)):
            monkeypatch.setattr(nearcopies, name, value)
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for d in range(160):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            words[at] = f"x{rng.integers(0, 6)}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["_id"]: r["class_id"] for r in nearcopies.near_copies(docs, bands=64, rows=2).collect()}
    assert got == brute_classes(rows)


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(2)
    value = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 12, 60), rng.integers(0, 12, 60)
    doc = np.repeat([0, 1], 60)
    count, both = np.append(a, b), np.append(value, value)
    held = count > 0
    first = nearcopies.bag_minhash(doc[held], both[held], count[held], 2, 8192)
    assert abs((first[0] == first[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def brute_repeats(rows, split, join, length):
    units = [(d, split(t.encode())) for d, t in rows]
    seen = Counter(bytes(u[i : i + length]) if isinstance(u, bytes) else tuple(u[i : i + length]) for _, u in units for i in range(len(u) - length + 1))
    out = []
    for d, u in units:
        gone = np.zeros(len(u) + 1, bool)
        for i in range(len(u) - length + 1):
            if seen[bytes(u[i : i + length]) if isinstance(u, bytes) else tuple(u[i : i + length])] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = join([u[i : i + 1] if isinstance(u, bytes) else u[i] for i in np.flatnonzero(~gone[:-1])])
        out.append((d, len(u), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd, share", [(False, 1e-3), (True, 1e-3), (True, 2)])
def test_repeated_bytes(spark, place, monkeypatch, crowd, share):
    monkeypatch.setattr(repeats, "HOT_SHARE", share)
    if crowd:
        monkeypatch.setattr(repeats, "CROWD", 1)
    got = sorted(map(tuple, result(spark, place, "op4_repeated_bytes").collect()), key=repr)
    assert got == brute_repeats(texts(spark, place), bytes, b"".join, 400)


@pytest.mark.parametrize("crowd, share", [(False, 1e-3), (True, 1e-3), (True, 2)])
def test_repeated_words(spark, place, monkeypatch, crowd, share):
    monkeypatch.setattr(repeats, "HOT_SHARE", share)
    if crowd:
        monkeypatch.setattr(repeats, "CROWD", 1)
    got = sorted(map(tuple, result(spark, place, "op6_repeated_words").collect()), key=repr)
    assert got == brute_repeats(texts(spark, place), bytes.split, b" ".join, 35)


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    s = np.append(rng.integers(1, letters + 1, 700), 0).astype(np.int16)
    s[300:600] = s[:300]
    order = suffix_array(s, 258)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    smaller = suffix.classify(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    assert (suffix.induce(s, smaller, lms, 258) == suffix.induce_each(s, smaller, lms, 258)).all()
    before, common_prefix = permuted_prefixes(s, order, np.array([5, 300]), 1 << 10)
    for i in np.flatnonzero(before >= 0):
        a, b, n = s[i:], s[before[i] :], 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert common_prefix[i] == n


def test_token_counts(spark, place):
    path = queries.tokenizer_path()
    got = Counter(map(tuple, result(spark, place, "op5_token_counts").collect()))
    want = Counter()
    for d, t in texts(spark, place):
        n = len(tokens.library(path).encode(t, add_special_tokens=False))
        want[d, len(t.encode()), n, n > 512] += 1
    assert got == want


def test_odd_characters_tokenise_as_the_library(spark):
    path = queries.tokenizer_path()
    rows = [(i, f"a {chr(c)}b{chr(c)} {chr(c)}{chr(c)} 'll  \n ") for i, c in enumerate([*range(1, 700), 0x2028, 0x3000, 0x1F600, 0xFEFF, 0x200B])]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got == {i: len(tokens.library(path).encode(t, add_special_tokens=False)) for i, t in rows}


def brute_base(text):
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    rows = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(rows) - len(set(rows)), len(again), failed


def test_quality_base(spark, place):
    rows = result(spark, place, "op7_quality").collect()
    got = Counter((r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in rows)
    assert got == Counter((d, *brute_base(t)) for d, t in texts(spark, place))
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def scripted(letters, seed, n):
    """Texts of words whose letters keep to a few combinations."""
    rng = np.random.default_rng(seed)
    parts = ["".join(rng.choice(list(letters), 3)) for _ in range(9)]
    return [" ".join("".join(rng.choice(parts, 3)) for _ in range(90)) for _ in range(n)]


CYRILLIC, HAN = "бвгдежзиклмнопрст", "的一是不了人我在有他这为之大来以个"


def plain_kneser_ney(texts):
    """Modified Kneser-Ney over 4-grams of the padded texts, by dictionaries: a function of four units."""
    levels, counts = {}, Counter(p[i : i + 4] for p in ("\n\n\n" + t for t in texts) for i in range(len(p) - 3))
    for order in (4, 3, 2, 1):
        of = Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else None
        cut = {k: max(0.1 * k, k - (k + 1) * y * of[k + 1] / of[k] if y is not None and of[k] else 0.5 * k) for k in (1, 2, 3)}
        total, passed = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            passed[g[:-1]] += min(cut[min(n, 3)], n)
        levels[order] = counts, cut, total, passed
        counts = Counter(g[1:] for g in counts)

    def p(gram):
        if not gram:
            return 2.0**-16
        counts, cut, total, passed = levels[len(gram)]
        context, n = gram[:-1], counts[gram]
        if not total[context]:
            return p(gram[1:])
        return max(0, n - min(cut[min(n, 3)], n) if n else 0) / total[context] + passed[context] / total[context] * p(gram[1:])

    return p


def test_perplexity_agrees_with_plain_kneser_ney(spark):
    rows = [(i, t, lang) for lang, letters in (("es", "abcde"), (None, CYRILLIC)) for i, t in enumerate(scripted(letters, 1, 12))]
    rows += [(100, "x", "es"), (101, "abc" * 300, "es"), (102, "", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {}
    for r in quality.scores(docs, block=3000, wanted=100).collect():
        got[r["lang"], r["doc_id"]] = r["log_perplexity"]
    halves = {(r["lang"], r["doc_id"]): r["h"] for r in docs.select("lang", "doc_id", ngrams.half(F.xxhash64("text")).alias("h")).collect()}
    models = {
        (lang, h): plain_kneser_ney([t for i, t, x in rows if x == lang and halves[x, i] != h])
        for lang in ("es", None)
        for h in (0, 1)
    }
    for i, text, lang in rows:
        if not text:
            assert got[lang, i] is None
            continue
        p, padded = models[lang, halves[lang, i]], "\n\n\n" + text
        logs = [-math.log(p(padded[k : k + 4])) for k in range(len(text))]
        cuts = np.linspace(0, len(text), max(1, len(text) // ngrams.PASSAGE) + 1).astype(int)
        want = np.median([np.mean(logs[a:b]) for a, b in zip(cuts, cuts[1:])])
        assert math.isclose(got[lang, i], want, rel_tol=1e-5), (lang, i)


def test_bands_reject_other_spelling(spark):
    rng = np.random.default_rng(4)
    parts = ["ri", "ver", "hill", "to", "sing", "ran", "the", "an", "met"]
    prose = [(i, " ".join("".join(rng.choice(parts, 3)) for _ in range(90)), "en") for i in range(200)]
    strange = [(1000, " ".join("#$%" + chr(33 + (i * 7) % 90) * 5 for i in range(80)), "en")]
    rows = spark.createDataFrame(prose + strange, "doc_id long, text string, lang string")
    scored = quality.judged(rows).collect()
    assert [r["kept"] for r in scored if r["doc_id"] == 1000] == [False]


def test_bands_reject_random_letters_of_any_script(spark):
    rng = np.random.default_rng(9)
    prose, gibberish = [], []
    for k, (lang, letters) in enumerate({"es": CYRILLIC, "fr": HAN}.items()):
        prose += [(1000 * k + i, text, lang) for i, text in enumerate(scripted(letters, k, 120))]
        gibberish.append((1000 * k + 999, re.sub(r"\S", lambda m: str(rng.choice(list(letters))), prose[-1][1]), lang))
    docs = spark.createDataFrame(prose + gibberish, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(docs).collect()}
    assert [kept[d] for d, _, _ in gibberish] == [False, False]
    assert sum(kept[d] for d, _, _ in prose) >= 0.95 * len(prose)


def test_every_language_of_the_data_has_a_band(spark):
    groups = [("it", "bcdefghilmnopqrst", 300), ("ru", CYRILLIC, 12), (None, HAN, 12)]
    rows = [(1000 * k + i, text, lang) for k, (lang, letters, n) in enumerate(groups) for i, text in enumerate(scripted(letters, k, n))]
    kept = Counter(r["lang"] for r in quality.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    assert all(kept[lang] >= 0.9 * n for lang, _, n in groups)


def test_model_over_units_sums_to_one(spark):
    rows = spark.createDataFrame([("0", "да нет да 😀 нет"), ("0", "abcabd"), ("0", None)], "model string, text string")
    counts = ngrams.ngram_counts(rows.withColumn("text", F.coalesce("text", F.lit(""))))
    assert counts.agg(F.sum("n")).first()[0] == len("да нет да 😀 нет") + 1 + 6
    context = sum(ord(c) << 16 * (2 - i) for i, c in enumerate("abc"))
    wanted = spark.range(0, 1 << 16).select(F.lit("0").alias("model"), (F.lit(context << 16) + F.col("id")).alias("code"))
    assert abs(ngrams.probabilities(counts, wanted).agg(F.sum("p")).first()[0] - 1) < 1e-9


def test_near_phrases(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox y"), (2, "fox the brown quick"), (3, "fox only")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the quick brown fox")], "item_id long, text string")
    found = contamination.matches(contamination.training_terms(docs), items, 10, near=True).collect()
    assert {(r["doc"], r["kind"]) for r in found} == {(1, "phrase"), (2, "near")}
    assert [(r["start"], r["n"]) for r in found if r["doc"] == 1] == [(1, 4)]


CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_personal(text):
    out = []
    for k, (kind, pattern) in enumerate(CONTRACT.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and personal.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c@d.e f@g @h.i x@y.", "..@a-.b.c %%@x.y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0300 0001.2.3.4", "4111 1111-1111 1111 x",
    "4111 1111 1111 1111 1", "+1 (017) 555-7713. +12345678 ++1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "1.1.1.1@2.2.2.2", "a@b..c a@b.c.", "٣.٣.٣.٣",
]


def test_personal_base(spark, place):
    rows = result(spark, place, "op9_personal_data").collect()
    want = Counter()
    for d, t in texts(spark, place):
        base = brute_personal(t)
        counts = Counter(k for _, k, _ in base)
        want[(d, *[counts[k] for k in range(4)], hashlib.sha256(personal.as_text(base).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in rows) == want
    for text in TRICKY:
        assert personal.base_spans(text) == brute_personal(text)


def test_field_adds_other_spellings_and_leaves_the_rest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = personal.train(docs)

    def find(text):
        return personal.added_spans(text, personal.base_spans(text), weights)

    assert find("call (017) 555-7713 now") == [(5, 3, 19)]
    assert [k for _, k, _ in find("call 017-555-7713 or 017 555 7713 x")] == [3, 3]
    for clean in ("token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x", "the Apache License, Version 2.0.", "in 2024 and 2025", "no 9807915762804491 x"):
        assert find(clean) == []
    rows = [(t or "") for (t,) in docs.select("text").collect()]
    more = sum(len(personal.added_spans(t, personal.base_spans(t), weights)) for t in rows)
    assert more <= 0.02 * sum(len(personal.base_spans(t)) for t in rows)


def test_marginals_are_probabilities():
    c = personal.candidates("at +1 (017) 555-7713 or a.b@c.de")
    scores = np.random.default_rng(3).normal(size=(len(c.end), 4))
    p = personal.marginals(c, scores)
    assert (p >= 0).all() and (p <= 1).all()
    points = range(40)
    assert max(sum(p[k].sum() for k in range(len(c.end)) if c.begin[k] <= x < c.end[k]) for x in points) <= 1 + 1e-9


def files_read(collected):
    """How many files the scans of a collected query opened."""
    plan = collected._jdf.queryExecution().executedPlan().executedPlan()
    leaves = (plan.plan() if plan.nodeName() == "ResultQueryStage" else plan).collectLeaves()
    metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("numFiles").value() for m in metrics if m.contains("numFiles"))


def test_shard_files_skip_what_two_ranges_exclude(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stored = hilbert.store_shards(docs, shards=4, runs=8)
    names = sorted(r[0] for r in docs.select("source").distinct().collect() if r[0] is not None)
    ranges = {"source": (names[0], names[0]), "size": (1, 400)}
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    want = docs.where((F.col("source") == names[0]) & (size <= 400)).select("doc_id", "text")
    got = stored.where(ranges).select("_row.doc_id", "_row.text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 0
    total, left = stored.bounds().count(), [stored.runs_for(x).count() for x in (ranges, {"size": (1, 400)})]
    assert total == 32 and left[0] < left[1] < total and left[0] <= total / 3
    assert files_read(got) == left[0]
    counts = [r["n_rows"] for r in stored.bounds().collect()]
    assert sum(counts) == docs.count() and max(counts) - min(counts) <= 1


def test_shard_files_of_awkward_rows(spark):
    schema = "doc_id long, text string, source string, size int, shard string"
    rows = [(1, None, None, 5, "x"), (1, None, None, 5, "x"), (None, "a", "s", None, None), (2, "b" * 300, "t", 1, "y")]
    stored = hilbert.store_shards(spark.createDataFrame(rows, schema), shards=2, runs=2)
    assert stored.rows().count() == 4 and stored.where({}).count() == 4
    assert [r["_row"]["shard"] for r in stored.where({"source": ("t", None)}).collect()] == ["y"]
    assert stored.where({"source": (None, "zz"), "size": (2, 2)}).count() == 1
    empty = hilbert.store_shards(spark.createDataFrame([], schema))
    assert empty.bounds().count() == empty.where({"size": (0, 9)}).count() == 0


def test_line_runs_batch_by_batch(spark):
    def batch(rows):
        return lines.line_hashes(spark.createDataFrame(rows, "doc_id long, text string"), 5)

    runs = lines.LineRuns(spark, fanout=2)
    third = batch([(4, "ALPHA alpha \ngamma gamma")])
    assert sorted((r["n_docs"], r["last_doc"]) for r in runs.add(batch([(6, "alpha alpha\nbeta beta"), (5, "alpha alpha")])).collect()) == [(1, 6), (2, 6)]
    assert [r["last_doc"] for r in runs.unseen(lines.as_run(third)).collect()] == [4]
    assert [r["last_doc"] for r in runs.add(third).collect()] == [4]
    for rows in ([(3, "delta delta")], [(2, "alpha alpha")]):
        runs.add(batch(rows))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert sorted((r["n_docs"], r["last_doc"]) for r in runs.counted().collect()) == [(1, 3), (1, 4), (1, 6), (4, 6)]
    runs.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (3, 5), (7, 2)])
def test_lines_are_the_same_for_any_batches(spark, place, batches, fanout):
    def rows(**options):
        found = lines.without_repeated_lines(common.documents(spark, place), **options)
        return sorted(map(tuple, found.collect()), key=repr)

    assert rows(batches=batches, fanout=fanout) == rows()


def test_run_joins_move_no_run(spark):
    rows = spark.createDataFrame([(i, f"line {i % 50}") for i in range(300)], "doc_id long, text string")
    runs = lines.LineRuns(spark, fanout=9)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for low in (200, 100, 0):
            runs.add(lines.line_hashes(rows.where(f"doc_id >= {low} and doc_id < {low + 100}"), 3))
        plan = runs.unseen(runs.runs()[0])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        runs.forget()


@pytest.mark.parametrize("shape", ["rising", "shuffled", "tree"])
def test_components_of_long_chains_in_few_rounds(spark, shape, monkeypatch):
    n, rng = 1000, np.random.default_rng(5)
    if shape == "tree":
        pairs = [(int(rng.integers(max(0, i - 4), i)), i) for i in range(1, n) if i % 97]
    else:
        order = list(range(n)) if shape == "rising" else rng.permutation(n).tolist()
        pairs = list(zip(order, order[1:]))
    names, real = [], nearcopies.materialize
    monkeypatch.setattr(nearcopies, "materialize", lambda df, name: (names.append(name), real(df, name))[1])
    found = {r["node"]: r["root"] for r in nearcopies.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    assert found == {x: top(x) for x in {y for pair in pairs for y in pair}}
    assert names.count("roots") <= 10 and (shape != "rising" or names.count("moves") <= 15)


def test_pipeline_stages(spark, some):
    import corpus_pipeline

    docs = common.documents(spark, some)
    names, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, some)
        docs.write.mode("overwrite").parquet(path := f"{common_path(spark)}/{len(seen)}")
        docs = spark.read.parquet(path)
        seen.append(docs)
    assert [d.columns for d in seen[:-1]] == [names] * 4
    quality_kept = [(r["doc_id"], r["text"]) for r in seen[0].collect()]
    classes = brute_classes(quality_kept)
    assert sorted(r["doc_id"] for r in seen[1].collect()) == sorted(set(classes.values()))
    assert seen[2].count() < seen[1].count()
    assert {r["doc_id"] for r in seen[3].collect()} <= {r["doc_id"] for r in seen[2].collect()}
    assert seen[4].count() == seen[3].count()


def common_path(spark):
    from palisade.session import new_path

    return new_path(spark, "test-stages")
