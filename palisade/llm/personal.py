"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans of other shapes.

The field scores whole candidate segments (their digits, groups, separators, checks and neighbours) in the surroundings
of digits and at-signs. A dynamic programme over segments of bounded length chooses boundaries and types together. It is
trained on a bounded sample whose labels are the patterns' spans, with their spelling varied.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
#: Training looks at the regions of about SAMPLE_DOCS documents and keeps at most SAMPLE_REGIONS of them.
SAMPLE_DOCS, SAMPLE_REGIONS, ROUNDS = 20_000, 400, 6
MOST_TOKENS, MOST_CHARS, FEATURES = 26, 72, 4096

#: What the patterns accept. The possessive forms find the same spans in linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")
_SPELT = re.compile(r"[\[(]at[\])]|\bdot\b", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at-sign with the longest local part that begins after the span before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() < 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def regions(text: str) -> list[tuple[int, int]]:
    """Surroundings of at-signs and of seven or more digits standing close together, inside one line."""
    groups: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        digits, sign = (m.end() - m.start(), 0) if "@" not in m.group() else (0, 7)
        if groups and m.start() - groups[-1][1] <= 14 and m.end() - groups[-1][0] <= 2000:
            groups[-1][1] = m.end()
            groups[-1][2] += digits + sign
        else:
            groups.append([m.start(), m.end(), digits + sign])
    groups += [[m.start(), m.end(), 7] for m in _SPELT.finditer(text)]
    out: list[tuple[int, int]] = []
    for start, end, weight in sorted(groups):
        if weight >= 7:
            low = max(text.rfind("\n", 0, start) + 1, start - 48)
            line_end = text.find("\n", end)
            high = min(len(text) if line_end < 0 else line_end, end + 48)
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
    return out


@dataclass
class Candidates:
    """Segments of one region by their end: begin and end offsets, and hashed features."""

    begin: list[int]
    end: list[int]
    features: list[np.ndarray]


def _number(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


_numbers: dict[str, int] = {}


def _features(region: str, a: int, b: int) -> np.ndarray:
    """Facts about the whole span and what stands beside it."""
    span = region[a:b]
    digits = re.sub("[^0-9]", "", span)
    groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", span)[:8])
    letters, sign = bool(re.search("[A-Za-z]", span)), span.count("@")
    seps = "".join(sorted(set(re.sub("[A-Za-z0-9]", "", span))))
    near = lambda c: "n" if not c else "d" if c.isdigit() else "l" if c.isalpha() else "s" if c.isspace() else c
    left, right = near(region[a - 1 : a]), near(region[b : b + 1])
    four = not letters and span.count(".") == 3 and len(groups.split("-")) == 4
    names = [
        f"digits {len(digits)} {letters}", f"groups {groups} {letters}", f"seps {seps} {letters}", f"left {left}", f"right {right}",
        f"left digits {left} {letters}", f"plus {span[0] == '+'} {len(digits)}", f"bracket {span[0] == '('} {len(digits)}",
        f"card {not letters and 12 <= len(digits) <= 19 and luhn(digits)}", f"ip {four and _octets(span)}",
        f"sign {sign} {bool(re.search('@[A-Za-z0-9-]+[.][A-Za-z]{2,}$', span))}",
        f"spelt {bool(re.search(r' at |[\[(]at[\])]', span))} {' dot ' in span}", "any",
        f"blanks {min(9, span.count(' '))} {letters} {sign}", f"before the sign {len(re.split(' at |[(]at[)]|@', span)[0].split(' dot ')[0].split())}",
    ]
    for name in names:
        if name not in _numbers:
            _numbers[name] = _number(name)
    return np.array([_numbers[n] for n in names])


def candidates(region: str) -> Candidates:
    """Segments that begin and end on tokens and hold 7 to 19 digits without letters, or an at-sign."""
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(region)]
    out = Candidates([], [], [])
    for i, (a, _, first) in enumerate(tokens):
        if not (first.isalnum() or first in "+("):
            continue
        digits, letters, signs, breaks = 0, False, 0, 0
        for start, b, token in tokens[i : i + MOST_TOKENS]:
            if b - a > MOST_CHARS or digits > 19:
                break
            digits += len(token) if token[0] in "0123456789" else 0
            letters |= token.isalpha()
            signs += token == "@" or (token.lower() == "at" and start > a)
            breaks = breaks + 1 if token.isspace() else 0
            if breaks > 1 or (letters and signs == 0 and start - a > 30):
                break
            if token.isalnum() and ((not letters and 7 <= digits <= 19) or (letters and signs == 1 and token.lower() not in ("at", "dot"))):
                out.begin.append(a)
                out.end.append(b)
                out.features.append(_features(region, a, b))
    order = sorted(range(len(out.end)), key=lambda k: (out.end[k], out.begin[k]))
    return Candidates(*[[part[k] for k in order] for part in (out.begin, out.end, out.features)])


def segment_scores(c: Candidates, weights: np.ndarray) -> np.ndarray:
    return np.array([weights[:, f].sum(axis=1) for f in c.features]).reshape(-1, len(KINDS))


def best_segments(c: Candidates, scores: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of the labelling with the highest score; text outside segments scores 0."""
    best, chosen, ends, at = [0.0], [None], [0], 0
    for k in range(len(c.end)):
        if c.end[k] != ends[-1]:
            ends.append(c.end[k])
            best.append(best[-1])
            chosen.append(None)
        at = np.searchsorted(ends, c.begin[k], "right") - 1
        kind = int(scores[k].argmax())
        total = best[at] + scores[k][kind]
        if total > best[-1]:
            best[-1], chosen[-1] = total, (c.begin[k], kind, c.end[k], at)
    out, place = [], len(best) - 1
    while place > 0:
        if chosen[place]:
            out.append(chosen[place][:3])
            place = int(chosen[place][3])
        else:
            place -= 1
    return out[::-1]


def marginals(c: Candidates, scores: np.ndarray) -> np.ndarray:
    """Probability of each (segment, kind): sums over all labellings, forward and backward."""
    points = sorted({0, *c.begin, *c.end})
    place = {p: i for i, p in enumerate(points)}
    whole = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    ahead, back = np.zeros(len(points)), np.zeros(len(points))
    by_end: dict[int, list[int]] = {}
    by_begin: dict[int, list[int]] = {}
    for k in range(len(c.end)):
        by_end.setdefault(place[c.end[k]], []).append(k)
        by_begin.setdefault(place[c.begin[k]], []).append(k)
    for i in range(1, len(points)):
        ahead[i] = np.logaddexp.reduce([ahead[i - 1], *[ahead[place[c.begin[k]]] + whole[k] for k in by_end.get(i, [])]])
    for i in range(len(points) - 2, -1, -1):
        back[i] = np.logaddexp.reduce([back[i + 1], *[back[place[c.end[k]]] + whole[k] for k in by_begin.get(i, [])]])
    out = np.empty_like(scores)
    for k in range(len(c.end)):
        out[k] = np.exp(ahead[place[c.begin[k]]] + scores[k] + back[place[c.end[k]]] - ahead[-1])
    return out


Example = tuple[str, list[tuple[int, int, int]]]


def varied(region: str, spans: list[tuple[int, int, int]], draw: random.Random) -> list[Example]:
    """The region as it is, and with one span spelt otherwise or spoilt."""
    out = [(region, spans)]
    for a, kind, b in spans[:2]:
        text = region[a:b]
        new = {0: [text.replace("@", " at ").replace(".", " dot "), text.replace("@", "(at)"), text.replace("@", "[at]")]}.get(kind, [])
        label = kind
        if kind == 3 and re.match(r"\+[0-9]{1,3}[ .-]", text):
            local = re.sub(r"^\+[0-9]{1,3}[ .-]", "", text)
            new = [local, local.replace(" ", "-").replace("(", "").replace(")", "")]
        if kind == 2:
            digits = re.sub("[^0-9]", "", text)
            spoilt = digits[:-1] + str((int(digits[-1]) + draw.randint(1, 9)) % 10)
            out.append((region[:a] + spoilt + region[b:], []))
            new = ["-".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
        if kind == 1:
            out.append((region[:a] + ".".join(str(draw.randint(256, 999)) for _ in range(4)) + region[b:], []))
        for other in new:
            out.append((region[:a] + other + region[b:], [(a, label, a + len(other))]))
    for _ in range(2 if not spans else 1):
        noise = "".join(draw.choice("0123456789abcdef") for _ in range(32)) if draw.random() < 0.5 else str(draw.randint(10**6, 10**15))
        if not any(k == 2 for _, k, _ in base_spans(noise)):
            out.append((f"no {noise} on", []))
    return out


def fitted(examples: list[Example], rounds: int = ROUNDS, rate: float = 0.2, decay: float = 1e-3) -> np.ndarray:
    """Weights by gradient ascent on the conditional likelihood (adaptive steps)."""
    weights, squares = np.zeros((len(KINDS), FEATURES)), np.full((len(KINDS), FEATURES), 1e-2)
    prepared = []
    for region, spans in examples:
        c = candidates(region)
        wanted = np.zeros((len(c.end), len(KINDS)))
        gold = {(a, b): kind for a, kind, b in spans}
        for k in range(len(c.end)):
            if (c.begin[k], c.end[k]) in gold:
                wanted[k, gold[c.begin[k], c.end[k]]] = 1
        if len(c.end):
            prepared.append((c, wanted))
    for _ in range(rounds):
        for c, wanted in prepared:
            push = wanted - marginals(c, segment_scores(c, weights))
            step = np.zeros_like(weights)
            for k in np.flatnonzero(np.abs(push).max(axis=1) > 1e-4):
                np.add.at(step, (slice(None), c.features[k]), push[k][:, None])
            hit = step != 0
            step[hit] -= decay * weights[hit]
            squares[hit] += step[hit] ** 2
            weights[hit] += rate * step[hit] / np.sqrt(squares[hit])
    return weights


def train(docs: DataFrame) -> np.ndarray:
    """Weights from at most SAMPLE_REGIONS regions of a sample of documents; zeros where nothing was found."""
    part = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    rows = docs.select(text_of().alias("text"))
    rows = rows.sample(part, seed=3) if part < 1 else rows

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t[a:b] for t in batch.column(0).to_pylist() for a, b in regions(t) if b - a <= 400]
            yield pa.record_batch({"region": pa.array(found, pa.string())})

    found = rows.mapInArrow(pick, "region string").distinct()
    kept = found.orderBy(F.xxhash64("region"), "region").limit(SAMPLE_REGIONS).collect()
    draw, examples = random.Random(5), []
    for r in kept:
        examples += varied(r["region"], base_spans(r["region"]), draw)
    draw.shuffle(examples)
    return fitted(examples)


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray, margin: float = 2.0) -> list[tuple[int, int, int]]:
    """The field's spans, at margin or more above no span, that touch no span of the patterns."""
    out = []
    for low, high in regions(text):
        region = text[low:high]
        c = candidates(region)
        if not len(c.end):
            continue
        for a, kind, b in best_segments(c, segment_scores(c, weights) - margin):
            if all(low + b <= start or low + a >= end for start, _, end in base):
                out.append((low + a, kind, low + b))
    return out


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, base (the patterns' spans), added (the field's), each as kind:start:end, and counts of the base spans.

    Null and empty texts have none; every row is judged by its own text; an empty table gives an empty result; other
    columns are not read.
    """
    weights = train(docs) if weights is None else weights
    shared, kind = docs.sparkSession.sparkContext.broadcast(weights), dict(docs.dtypes)["doc_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [base_spans(t) for t in batch.column(1).to_pylist()]
            more = [added_spans(t, b, shared.value) for t, b in zip(batch.column(1).to_pylist(), base)]
            columns = {"doc_id": batch.column(0)}
            for k, name in enumerate(KINDS):
                columns[f"n_{name}"] = pa.array([sum(s[1] == k for s in b) for b in base], pa.int64())
            columns["base"] = pa.array([as_text(b) for b in base], pa.string())
            columns["spans"] = pa.array([as_text(b + m) for b, m in zip(base, more)], pa.string())
            yield pa.record_batch(columns)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(find, f"doc_id {kind}, {counts}, base string, spans string")
