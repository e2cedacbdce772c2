"""Personal data by a semi-Markov conditional random field.

A text is searched for regions: runs of characters that an address or a number
can be made of, with an ``@`` or enough digits in them. Outside them nothing can
be an entity, so the dynamic programme runs inside regions only. There, segments
of up to ``MAX_TOKENS`` tokens are scored as wholes (digit groups, check digits,
octets, separators, what stands at the edges) for each kind, and the best path
over segments and single tokens chooses boundaries and kinds together. The work
per token is bound by ``MAX_TOKENS``, so a long table of numbers stays linear.

The field is fitted on the driver, on regions of at most ``SAMPLE_DOCS``
documents and at most ``SAMPLE_REGIONS`` of them, labelled by the base patterns
(phones also with their country code cut off, labelled all the same). Base spans
enter the programme as segments of fixed weight, so the path runs through them
and adds others beside them; of base spans that overlap all are returned.

Defined results: a null text is empty; a text without spans has zero counts and
empty strings; base spans of different kinds may overlap, added spans overlap
nothing; rows that repeat come out as often as they stand; other columns of the
table are not touched.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import slices, strings, texts

#: Score of a fixed segment.
FIXED = 1e6
KINDS = ("email", "ip", "card", "phone")
#: Most tokens, digits and digit groups of an added entity.
MAX_TOKENS, MAX_DIGITS, MAX_GROUPS = 24, 19, 6
#: Most documents and regions that fitting reads, longest region among them.
SAMPLE_DOCS, SAMPLE_REGIONS, SAMPLE_CHARS = 10_000, 3_000, 300
ROUNDS, RATE, SHRINK = 40, 0.15, 1e-3

Span = tuple[str, int, int]

# The base patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_ADDRESS = re.compile(r"[A-Za-z0-9._%+@-]*")
_ADDRESS_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@-")
_NUMBER = re.compile(r"[0-9][0-9\x20().+-]*")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_DIGITS = re.compile(r"[0-9]+")
#: Fewest digits of any number that is an entity (an address of four single digits).
LEAST_DIGITS = 4


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) << (place & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def octets(groups: list[str]) -> bool:
    return len(groups) == 4 and all(len(n := g.lstrip("0")) <= 3 and int(n or 0) <= 255 for g in groups)


# ---- regions and base spans ----------------------------------------------------------

def address_regions(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of address characters with an ``@`` in them."""
    at = text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] in _ADDRESS_CHARS:
            start -= 1
        end = _ADDRESS.match(text, at).end()
        yield start, end
        at = text.find("@", end)


def number_regions(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of number characters with enough digits, from a digit (or the ``+`` or ``(`` before it) to a digit."""
    for run in _NUMBER.finditer(text):
        start, end = run.span()
        body = run.group().rstrip(" ().+-")
        if len(body) < LEAST_DIGITS or sum(map(len, _DIGITS.findall(body))) < LEAST_DIGITS:
            continue
        while start and text[start - 1] in "+(":
            start -= 1
        yield start, run.start() + len(body)


def base_in_address(text: str, start: int, end: int) -> Iterator[Span]:
    """Base spans of an address region: what stands between two ``@`` is a name, so each ``@`` is looked at once."""
    at = text.find("@", start, end)
    while at >= 0:
        host = _HOST.match(text, at + 1, end)
        if host and start < at:
            yield "email", start, host.end()
        start = host.end() if host and start < at else at + 1
        at = text.find("@", max(start, at + 1), end)


def base_in_numbers(text: str, start: int, end: int) -> Iterator[Span]:
    """Base spans of a number region. No base match leaves its region, so each is searched alone."""
    for part in _DOTTED.finditer(text, start, end):
        groups = part.group().split(".")
        at = part.start()
        for k in range(0, len(groups) - 3, 4):  # four groups in a row, leftmost first
            size = sum(map(len, groups[k : k + 4])) + 3
            if octets(groups[k : k + 4]):
                yield "ip", at, at + size
            at += size + 1
    for m in CARD.finditer(text, start, end):
        digits = "".join(_DIGITS.findall(m.group()))
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text, start, end):
        if 10 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
            yield "phone", m.start(), m.end()


def regions(text: str) -> list[tuple[int, int, list[Span]]]:
    """Regions of a text and the base spans in each."""
    out = [(a, b, list(base_in_address(text, a, b))) for a, b in address_regions(text)]
    out += [(a, b, list(base_in_numbers(text, a, b))) for a, b in number_regions(text)]
    return out


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- the field -----------------------------------------------------------------------

def span_features(text: str, start: int, end: int) -> list[str]:
    """What a segment looks like as a whole."""
    body = text[start:end]
    groups = _DIGITS.findall(body)
    digits = sum(map(len, groups))
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    out = [
        f"digits {min(digits, 20)}", f"groups {min(len(groups), 6)}", "marks " + "".join(sorted(set(re.sub("[0-9A-Za-z]", "", body)))),
        f"first {'digit' if body[0].isdigit() else 'letter' if body[0].isalpha() else body[0]}", f"longest {min(max(map(len, groups), default=0), 8)}",
        f"letters {any(c.isalpha() for c in body)}", f"sides {_side(left)}{_side(right)}",
    ]
    if "@" in body:
        name, _, host = body.partition("@")
        out += [f"ats {min(body.count('@'), 2)}", f"name {bool(name)} host {min(host.count('.'), 3)}", f"top {bool(re.search(r'[.][A-Za-z]{2,}$', host))}"]
    elif digits >= 12 and not any(c.isalpha() for c in body):
        out.append(f"check digit {luhn(''.join(groups))} {14 <= digits <= 19}")
    if len(groups) == 4 and set(re.sub("[0-9]", "", body)) == {"."}:
        out.append(f"octets {octets(groups)}")
    if 3 <= len(groups) <= 5:
        out.append("sizes " + " ".join(str(min(len(g), 5)) for g in groups[-3:]))
    # The number goes on beyond the segment, after one separator at most.
    out.append(f"cut {bool(re.search('[0-9][^0-9A-Za-z]?$', text[max(0, start - 2) : start]))} {bool(re.match('[^0-9A-Za-z]?[0-9]', text[end : end + 2]))}")
    return out


def _side(char: str) -> str:
    return "w" if char.isalnum() else "@" if char == "@" else "-"


@dataclass
class Field:
    """Weights by (kind, feature); tokens outside segments weigh nothing."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)


@dataclass
class Lattice:
    """A region's token edges and its candidate segments (first token, end token, start, end)."""

    edges: list[int]
    segments: list[tuple[int, int, int, int]]


def lattice(text: str, start: int, end: int) -> Lattice:
    """Candidates begin and end with a letter or digit (or begin with ``+`` or ``(``) and could be an entity by their characters."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    edges = [a for a, _ in tokens] + [end]
    out = []
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        digits = groups = dots = 0
        at = letters = False
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            c, d = tokens[j]
            first = text[c]
            if first.isdigit():
                digits += d - c
                groups += 1
            elif first.isalpha():
                letters = True
            else:
                dots += first == "."
                at |= first == "@"
                continue
            if at or not letters and groups <= MAX_GROUPS and (7 <= digits <= MAX_DIGITS or digits >= LEAST_DIGITS and dots >= 3):
                out.append((i, j + 1, a, d))
    return Lattice(edges, out)


def best_path(text: str, found: Lattice, model: Field, fixed: list[Span]) -> list[Span]:
    """The entities of the highest path. ``fixed`` spans are segments that outweigh any other; none may cross them."""
    n = len(found.edges) - 1
    place = {edge: k for k, edge in enumerate(found.edges)}
    by_first: dict[int, list[tuple[int, float, Span]]] = {}
    closed = [0] * (n + 1)
    for kind, a, b in fixed:
        by_first.setdefault(place[a], []).append((place[b], FIXED, (kind, a, b)))
        for k in range(place[a], place[b]):
            closed[k + 1] = 1
    closed = list(itertools.accumulate(closed))  # tokens of fixed spans before each edge
    for i, j, a, b in found.segments if model.weights else ():
        if closed[i] == closed[j]:
            features = span_features(text, a, b)
            for kind in KINDS:
                value = sum(model.weights.get((kind, f), 0.0) for f in features)
                if value > 0:
                    by_first.setdefault(i, []).append((j, value, (kind, a, b)))
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    for i in range(n):
        if best[i] > best[i + 1]:
            best[i + 1], back[i + 1] = best[i], (i, None)
        for j, value, span in by_first.get(i, ()):
            if best[i] + value > best[j]:
                best[j], back[j] = best[i] + value, (i, span)
    out, at = [], n
    while at > 0:
        at, span = back[at]
        if span:
            out.append(span)
    return out


def fit_field(samples: list[tuple[str, int, int, list[Span]]]) -> Field:
    """Maximum likelihood (forward and backward over segments), a few rounds of Adagrad.

    ``samples``: texts with a region and its true spans; those of overlapping spans are left out.
    """
    ids: dict[tuple[str, str], int] = {}
    data = []
    for text, start, end, spans in samples:
        ordered = sorted(spans, key=lambda s: s[1])
        if any(a[2] > b[1] for a, b in zip(ordered, ordered[1:], strict=False)):
            continue
        found = lattice(text, start, end)
        true = set(spans)
        segments, flat, sizes, gold = [], [], [], []
        for i, j, a, b in found.segments:
            features = span_features(text, a, b)
            for kind in KINDS:
                segments.append((i, j))
                flat += [ids.setdefault((kind, f), len(ids)) for f in features]
                sizes.append(len(features))
                gold.append((kind, a, b) in true)
        if segments and sum(gold) == len(true):
            data.append((len(found.edges) - 1, segments, np.array(flat), np.repeat(np.arange(len(sizes)), sizes), np.array(gold, float)))
    weights, scale = np.zeros(len(ids)), np.full(len(ids), 1e-8)
    if not any(gold.any() for *_, gold in data):
        return Field()
    for _ in range(ROUNDS):
        grad = SHRINK * len(data) * weights
        for n, segments, flat, owner, gold in data:
            score = np.bincount(owner, weights[flat], len(segments))
            wrong = _marginals(n, segments, score) - gold
            grad += np.bincount(flat, wrong[owner], len(ids))
        scale += grad**2
        weights -= RATE * 4 * grad / np.sqrt(scale)
    return Field({key: float(weights[k]) for key, k in ids.items()})


def _marginals(n: int, segments: list[tuple[int, int]], score: np.ndarray) -> np.ndarray:
    """Probability of each segment under the field, by forward and backward sums in logarithms."""
    ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = behind[n] = 0.0
    by_first: dict[int, list[tuple[int, float]]] = {}
    for (i, j), s in zip(segments, score.tolist(), strict=True):
        by_first.setdefault(i, []).append((j, s))
    for i in range(n):
        ahead[i + 1] = _add(ahead[i + 1], ahead[i])
        for j, s in by_first.get(i, ()):
            ahead[j] = _add(ahead[j], ahead[i] + s)
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for j, s in by_first.get(i, ()):
            behind[i] = _add(behind[i], s + behind[j])
    return np.array([math.exp(ahead[i] + s + behind[j] - ahead[n]) for (i, j), s in zip(segments, score.tolist(), strict=True)])


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


# ---- documents ------------------------------------------------------------------------

def find(text: str, model: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, in order."""
    base, chosen = [], []
    for start, end, fixed in regions(text):
        base += fixed
        chosen += best_path(text, lattice(text, start, end), model, fixed)
    added = _apart(set(chosen) - set(base), base)
    return in_order(base), in_order(base + added)


def _apart(spans: set[Span], base: list[Span]) -> list[Span]:
    """Of regions that overlap (an address and a number in it) what touches neither a base span nor another: the first, then the longer."""
    out, end = [], -1
    fixed = {(a, b) for _, a, b in base}
    for s in sorted([*spans, *(("", a, b) for a, b in fixed)], key=lambda s: (s[1], s[0] != "", -s[2])):
        if s[1] >= end or not s[0]:
            out.append(s)
            end = max(end, s[2])
        # A span found before a base span that it touches gives way to it.
        if not s[0]:
            while len(out) > 1 and out[-2][0] and out[-2][2] > s[1]:
                del out[-2]
    return [s for s in out if s[0]]


def fit(docs: DataFrame) -> Field:
    """Fit on regions of a bounded sample (the smallest hashes of ids)."""
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = texts(docs).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in strings(batch).to_pylist():
                for start, end, spans in regions(text):
                    if end - start <= SAMPLE_CHARS:
                        low = max(0, start - 4)
                        moved = [(k, a - low, b - low) for k, a, b in spans]
                        rows.append((text[low : end + 4], start - low, end - low, encode(moved), bool(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            names = ("body", "start", "end", "spans", "some")
            yield pa.record_batch({n: pa.array(list(c), t) for n, c, t in zip(names, columns, types, strict=True)})

    found = sample.mapInArrow(run, "body string, start long, end long, spans string, some boolean")
    # With spans first, so that rare kinds are seen; the rest are what isn't personal data.
    half = SAMPLE_REGIONS // 2
    order = [F.xxhash64("body", "start"), "body", "start"]
    rows = [r for some in (True, False) for r in found.where(F.col("some") == some).distinct().orderBy(*order).limit(half).collect()]
    samples = [(r["body"], r["start"], r["end"], decode(r["spans"])) for r in rows]
    return fit_field(samples + [x for s in samples for x in without_country(*s)])


def without_country(text: str, start: int, end: int, spans: list[Span]) -> Iterator[tuple[str, int, int, list[Span]]]:
    """A phone's region with the country code cut off."""
    if len(spans) == 1 and spans[0][0] == "phone":
        _, a, b = spans[0]
        code = re.match(r"\+[0-9]{1,3}[\x20.-]+", text[a:b])
        if code and "(" in text[a:b]:
            cut = code.end()
            short = text[:a] + text[a + cut :]
            yield short, start, end - cut, [("phone", a, b - cut)]


def encode(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def decode(spans: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def scan(docs: DataFrame, model: Field) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_spans`` and ``spans`` (kind:start:end, comma-joined) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [find(t, shared.value) for t in strings(batch).to_numpy(zero_copy_only=False)]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), **counts, "base_spans": pa.array([encode(b) for b, _ in found], pa.string()),
                "spans": pa.array([encode(s) for _, s in found], pa.string()),
            })

    rows = texts(docs)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {counts}, base_spans string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced by their kind; of overlapping spans the first names the whole."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """``docs`` (all columns) with personal data replaced in ``text``, and ``n_chars``, if there, counted anew; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = strings(batch)
            new = [None if t is None else redacted(t, find(t, shared.value)[1]) for t in text.to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, text.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    done = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in names:
        return done
    kind = docs.schema["n_chars"].dataType
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
