"""Toxicity: a bidirectional gated recurrent network with attention pooling, fitted in numpy, over all windows of a text.

A word enters as two vectors: its own, if it is one of the words known from the fit, and the mean of its character
trigrams' vectors. The network reads windows of WINDOW words that overlap; the highest window counts. Its output and the
number of windows make the score, by a logistic curve fitted on the texts of the sample.

The fit takes a bounded sample of labelled rows (SAMPLE rows without and half as many with the label, by a hash of their
ids) in one task; it may be repeated and gives the same network. Scoring reads every word of every text.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import as_bytes, chunks, text_of
from palisade.llm.treap import terms
from palisade.session import materialize

WINDOW, STEP = 64, 48
#: Labelled rows of the fit: at most so many with label 0, and half as many with label 1.
SAMPLE = 2000
#: Windows of one text that the fit looks at, evenly spaced.
PER_TEXT = 12
KNOWN, TRIGRAMS = 8192, 8192
WORD, CHARS, HIDDEN, ATTENTION = 8, 8, 12, 8
#: A word is known if it occurs in so large a share of the sample's texts; the vectors shrink by DECAY per step and rate,
#: so that what only a few texts show is not learnt by heart.
SHARE, DECAY = 0.005, 0.3
STEPS, BATCH, RATE = 160, 128, 0.01
LIMIT = 0.3


# --- texts as numbers


class Vocabulary:
    """Distinct words numbered as they come."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def ids(self, text: bytes) -> np.ndarray:
        number = self.number
        parts = [np.array([number.setdefault(w, len(number)) for w in part], np.int32) for part in terms(text)]
        return np.concatenate([np.zeros(0, np.int32), *parts])

    def words(self) -> list[bytes]:
        return list(self.number)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words, with their ends marked, and where each word's begin (one entry more)."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(sizes)])
    if not words:
        return np.zeros(0, np.int64), first
    at = np.arange(first[-1]) + 2 * np.repeat(np.arange(len(words)), sizes)
    code = data[at] << 16 | data[at + 1] << 8 | data[at + 2]
    return (code * np.uint32(0x9E3779B1) >> np.uint32(32 - 13)).astype(np.int64) % TRIGRAMS, first


def starts(n: int) -> np.ndarray:
    """Where the windows of n words begin: every STEP words, the last one at the end of the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW)


def windows(ids: np.ndarray, begin: np.ndarray, pad: int) -> np.ndarray:
    """One row of WINDOW word numbers per window."""
    at = begin[:, None] + np.arange(WINDOW)
    return np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], pad)


# --- the network


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_network(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def small(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    inputs = WORD + CHARS
    return {
        "word": small(KNOWN + 1, WORD, scale=0.02),  # the last one for unknown words
        "tri": small(TRIGRAMS, CHARS, scale=0.1),
        "wx": small(2, inputs, 3 * HIDDEN, scale=0.4),
        "bx": np.zeros((2, 3 * HIDDEN), np.float32),
        "u": small(2, HIDDEN, 3 * HIDDEN, scale=0.3),
        "bn": np.zeros((2, HIDDEN), np.float32),
        "wa": small(2 * HIDDEN, ATTENTION, scale=0.3),
        "ba": np.zeros(ATTENTION, np.float32),
        "va": small(ATTENTION, scale=0.3),
        "wo": small(2 * HIDDEN, scale=0.3),
        "bo": np.zeros(1, np.float32),
    }


def inputs_of(net: dict, known: np.ndarray, tri: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The input vector of each word: own vector and mean of its trigrams' vectors. A word has a trigram at least."""
    x = np.zeros((len(known), WORD + CHARS), np.float32)
    if len(known):
        x[:, :WORD] = net["word"][known]
        x[:, WORD:] = np.add.reduceat(net["tri"][tri], first[:-1], axis=0) / np.diff(first)[:, None]
    return x


def projected(net: dict, x: np.ndarray) -> np.ndarray:
    """What the words add to the gates, for both directions; the last row is for places behind a text's end.

    It keeps the update gate open, so that the state passes on unchanged.
    """
    table = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
    table[:, :-1] = x[None] @ net["wx"] + net["bx"][:, None]
    table[:, -1, :HIDDEN] = 40
    return table


def forward(net: dict, table: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """The output of each window (rows of at), and what backward() needs if keep."""
    n, pad = len(at), table.shape[1] - 1
    steps = at.T
    states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
    h = np.zeros((2, n, HIDDEN), np.float32)
    kept = []
    for t in range(WINDOW):
        x = np.stack([table[0, steps[t]], table[1, steps[WINDOW - 1 - t]]])
        hu = h @ net["u"]
        gates = sigmoid(x[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])
        z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
        inner = hu[..., 2 * HIDDEN :] + net["bn"][:, None]
        new = np.tanh(x[..., 2 * HIDDEN :] + r * inner)
        if keep:
            kept.append((h, z, r, inner, new))
        h = new + z * (h - new)
        states[t, :, :HIDDEN] = h[0]
        states[WINDOW - 1 - t, :, HIDDEN:] = h[1]
    look = np.tanh(states @ net["wa"] + net["ba"])
    score = np.where(steps == pad, np.float32(-1e9), look @ net["va"])
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return pooled @ net["wo"] + net["bo"][0], {"kept": kept, "states": states, "look": look, "weight": weight, "pooled": pooled}


def backward(net: dict, at: np.ndarray, seen: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the network, and of the words' additions at each place, from the slope of the loss at each output."""
    states, look, weight = seen["states"], seen["look"], seen["weight"]
    grad = {"wo": slope @ seen["pooled"], "bo": slope.sum(keepdims=True)}
    pooled = slope[:, None] * net["wo"]
    d_weight = np.einsum("nh,tnh->tn", pooled, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_look = d_score[..., None] * net["va"] * (1 - look * look)
    grad["va"] = np.einsum("tn,tna->a", d_score, look)
    grad["wa"] = np.einsum("tnh,tna->ha", states, d_look, optimize=True)
    grad["ba"] = d_look.sum(axis=(0, 1))
    d_states = weight[..., None] * pooled + d_look @ net["wa"].T
    grad["u"], grad["bn"] = np.zeros_like(net["u"]), np.zeros_like(net["bn"])
    d_x = np.empty((2, WINDOW, len(at), 3 * HIDDEN), np.float32)
    carry = np.zeros((2, len(at), HIDDEN), np.float32)
    for t in range(WINDOW - 1, -1, -1):
        h, z, r, inner, new = seen["kept"][t]
        dh = carry + np.stack([d_states[t, :, :HIDDEN], d_states[WINDOW - 1 - t, :, HIDDEN:]])
        dz = dh * (h - new) * z * (1 - z)
        dn = dh * (1 - z) * (1 - new * new)
        dr = dn * inner * r * (1 - r)
        gates = np.concatenate([dz, dr, dn * r], axis=-1)
        carry = dh * z + gates @ net["u"].transpose(0, 2, 1)
        grad["u"] += h.transpose(0, 2, 1) @ gates
        grad["bn"] += gates[..., 2 * HIDDEN :].sum(axis=1)
        added = np.concatenate([dz, dr, dn], axis=-1)
        d_x[0, t], d_x[1, WINDOW - 1 - t] = added[0], added[1]
    return grad, d_x


def gradients(net: dict, known: np.ndarray, tri: np.ndarray, first: np.ndarray, at: np.ndarray, slopes) -> tuple[dict, np.ndarray]:
    """Gradients of all weights for windows (rows of at) over some words; slopes(outputs) gives the loss's slope."""
    x = inputs_of(net, known, tri, first)
    out, seen = forward(net, projected(net, x), at, keep=True)
    grad, d_x = backward(net, at, seen, slopes(out).astype(np.float32))
    real = at.T.ravel() < len(known)
    place = at.T.ravel()[real]
    d_rows = d_x.reshape(2, -1, 3 * HIDDEN)[:, real]
    grad["wx"] = x[place].T[None] @ d_rows
    grad["bx"] = d_rows.sum(axis=1)
    per_word = np.zeros_like(x)
    np.add.at(per_word, place, (d_rows @ net["wx"].transpose(0, 2, 1)).sum(axis=0))
    grad["word"], grad["tri"] = np.zeros_like(net["word"]), np.zeros_like(net["tri"])
    np.add.at(grad["word"], known, per_word[:, :WORD])
    sizes = np.diff(first)
    np.add.at(grad["tri"], tri, np.repeat(per_word[:, WORD:] / sizes[:, None], sizes, axis=0))
    return grad, out


def outputs(net: dict, table: np.ndarray, at: np.ndarray, block: int = 1024) -> np.ndarray:
    parts = [forward(net, table, at[i : i + block])[0] for i in range(0, len(at), block)]
    return np.concatenate([np.zeros(0, np.float32), *parts])


# --- the fit


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's steps, with a little shrinkage."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(np.clip(x @ beta, -30, 30))
        slope = x.T @ (weight * (p - y)) + 1e-3 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def surprise(ids: list[np.ndarray], labels: np.ndarray, words: int) -> np.ndarray:
    """For each word the log ratio of its shares of the texts with and without the label, in its standard deviations."""
    seen = np.zeros((2, words))
    for one, y in zip(ids, labels):
        seen[y, np.unique(one)] += 1
    texts = np.bincount(labels, minlength=2)[:, None]
    odds = np.log((seen + 0.5) / (texts + 1))
    return (odds[1] - odds[0]) / np.sqrt((1 / (seen + 0.5)).sum(axis=0))


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """The network, its known words and the curve. weights say how many rows each text stands for.

    A text's window with the highest output stands for it, and of texts with label 0 one more, chosen by lot. Without
    texts of both labels there is no network: every score is the share of label 1 (0 without labels).
    """
    share = float((weights * labels).sum() / weights.sum()) if len(labels) else 0.0
    if not len(labels) or labels.min() == labels.max():
        return {"share": np.array([share])}
    rng = np.random.default_rng(seed)
    vocabulary = Vocabulary()
    ids = [vocabulary.ids(t) for t in texts]
    words = vocabulary.words()
    frequency = Counter(i for one in ids for i in np.unique(one).tolist())
    common = sorted((i for i, n in frequency.items() if n >= max(3, SHARE * len(texts))), key=lambda i: (-frequency[i], words[i]))[:KNOWN]
    known = np.full(len(words), KNOWN)
    known[common] = np.arange(len(common))
    tri, first = trigrams(words)
    begins = [starts(len(one)) for one in ids]
    begins = [b[np.unique(np.linspace(0, len(b) - 1, min(len(b), PER_TEXT)).astype(int))] for b in begins]
    text = np.repeat(np.arange(len(texts)), [len(b) for b in begins])
    filled = [windows(one, b, len(words)) for one, b in zip(ids, begins) if len(b)]
    if not filled:
        return {"share": np.array([share])}
    at = np.concatenate(filled)
    net = new_network(rng)
    net["bo"][:] = np.log(share / (1 - share))
    net["word"][: len(common), 0] = np.clip(surprise(ids, labels, len(words))[common] / 2, -2, 2)
    y, importance = labels[text].astype(np.float32), (weights / weights.mean())[text]
    done = 0
    moments = {name: (np.zeros_like(w), np.zeros_like(w)) for name, w in net.items()}
    step = turn = 0
    while step < STEPS:
        if turn == 0:
            out = rng.random(len(at))  # in the first turns any window may stand for its text
        elif step >= STEPS * (done + 1) / 5:
            done = 5 * step // STEPS
            out = outputs(net, projected(net, inputs_of(net, known, tri, first)), at)
        turn += 1
        order = np.lexsort((out, text))
        highest = order[np.append(text[order][1:] != text[order][:-1], True)]
        lot = rng.permutation(len(at))
        lot = lot[np.unique(text[lot], return_index=True)[1]]
        chosen = rng.permutation(np.concatenate([highest, lot[y[lot] == 0]]))
        for begin in range(0, len(chosen), BATCH):
            rows = chosen[begin : begin + BATCH]
            used, place = np.unique(at[rows], return_inverse=True)
            used = used[used < len(words)]
            place = np.where(at[rows] < len(words), place.reshape(len(rows), WINDOW), len(used))
            own = np.where(rng.random(len(used)) < 0.15, KNOWN, known[used])  # so that trigrams learn too
            sizes = np.diff(first)[used]
            own_first = np.concatenate([[0], np.cumsum(sizes)])
            own_tri = tri[np.repeat(first[used] - own_first[:-1], sizes) + np.arange(own_first[-1])]
            weight = importance[rows] / importance[rows].sum()
            grad, _ = gradients(net, own, own_tri, own_first, place, lambda out: weight * (sigmoid(out) - y[rows]))
            step += 1
            rate = RATE * max(0.1, 1 - 0.9 * step / STEPS)
            for name, w in net.items():
                g = grad[name].reshape(w.shape)
                mean, square = moments[name]
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                w -= (rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if name in ("word", "tri"):
                    w *= 1 - rate * DECAY
    out = outputs(net, projected(net, inputs_of(net, known, tri, first)), at)
    highest, n = np.full(len(texts), -np.inf), np.bincount(text, minlength=len(texts))
    np.maximum.at(highest, text, out)
    some = n > 0
    curve = _logistic(np.column_stack([highest, np.log(np.maximum(n, 1))])[some], labels[some], weights[some])
    names = np.array([words[i].hex() for i in common])
    return {**net, "names": names, "curve": curve, "share": np.array([share])}


# --- in Spark


def _stored(model: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def _loaded(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as parts:
        return {name: parts[name] for name in parts.files}


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The model of the documents with a label (0 or 1) that are not held out, fitted by one task; at most some megabytes."""
    named = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    named = named.where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    totals = {r["_y"]: r["n"] for r in named.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        own = named.where(F.col("_y") == y).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample >> y)
        picked = own if picked is None else picked.unionAll(own)
    picked = materialize(picked, "labelled")  # 1.5 x sample rows at most
    rows = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text")).join(F.broadcast(picked), "_id")
    # rows that share an id must not widen the sample
    rows = rows.withColumn("_h", F.xxhash64("text")).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_y", "_h").limit(2 * sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += as_bytes(batch.column(0))
            y += batch.column(1).to_pylist()
        y = np.array(y, np.int64)
        counts = np.bincount(y, minlength=2)
        weights = np.array([totals.get(0, 0), totals.get(1, 0)]) / np.maximum(counts, 1)
        yield pa.record_batch({"model": pa.array([_stored(fit(texts, y, weights[y] if len(y) else np.zeros(0)))], pa.binary())})

    model = materialize(rows.select("text", "_y").coalesce(1).mapInArrow(learn, "model binary"), "toxicity-model")
    found = model.first()
    return bytes(found["model"]) if found else _stored({"share": np.zeros(1)})


def scores_of(model: dict, texts: list[bytes]) -> np.ndarray:
    """A score from 0 to 1 for each text; texts without words get the share of label 1."""
    out = np.full(len(texts), float(model["share"][0]))
    if "curve" not in model:
        return out
    number = {bytes.fromhex(str(name)): i for i, name in enumerate(model["names"])}
    for begin, end in chunks(texts):
        vocabulary = Vocabulary()
        ids = [vocabulary.ids(t) for t in texts[begin:end]]
        words = vocabulary.words()
        known = np.fromiter((number.get(w, KNOWN) for w in words), np.int64, len(words))
        table = projected(model, inputs_of(model, known, *trigrams(words)))
        begins = [starts(len(one)) for one in ids]
        n = np.array([len(b) for b in begins])
        some = np.flatnonzero(n)
        if not len(some):
            continue
        # windows are filled a block of texts at a time, and of a long text a block of windows
        tops = np.full(len(ids), -np.inf)
        held: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if held:
                np.maximum.at(tops, np.repeat(owner, [len(h) for h in held]), outputs(model, table, np.concatenate(held)))
            held.clear()
            owner.clear()

        size = 0
        for i in some:
            for a in range(0, n[i], 1024):
                held.append(windows(ids[i], begins[i][a : a + 1024], len(words)))
                owner.append(i)
                size += len(held[-1])
                if size >= 1024:
                    flush()
                    size = 0
        flush()
        x = np.column_stack([tops[some], np.log(n[some]), np.ones(len(some))]) @ model["curve"]
        out[begin + some] = sigmoid(np.clip(x, -30, 30))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null or empty text, or one without letters and digits, has no words: its score is the share of label 1 among the
    labelled rows. Equal texts get equal scores. Labels other than 0 and 1 are not read; without labels, or with one
    kind only, every score is that share (0 without any). Empty tables give no rows; other columns are not read. A
    null doc_id is not held out and has no label. Of a long text the words are held as numbers, the windows in blocks.
    """
    data = fitted(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast(data)
    kind = dict(docs.dtypes)["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _loaded(model.value)
        for batch in batches:
            found = scores_of(net, as_bytes(batch.column(1)))
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(found, pa.float64())})

    scored = docs.select("doc_id", text_of().alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
