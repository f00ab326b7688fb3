"""Personal data by exact patterns and a semi-Markov conditional random field.

Patterns give the base spans. The field scores segmentations of a region, the words around a digit, an at sign
or a spelled-out one: every candidate segment of at most `LONGEST` words has features of the whole span, with
weights of their own for each type; neighbouring segments have transition weights. Dynamic programming over
(end, type) sums over all segmentations in training and picks the best one in search, so boundaries and types
are chosen together. Spans found where no base span is are added.

It trains on regions of the corpus whose base spans are taken as truth, half of them with the span rewritten
in ways that the patterns miss (no plus sign, other separators, spelled-out signs). The sample is bounded:
`sample` regions at most, the first in hash order, fitted on the driver. Search reads every whole text, one at
a time.

Defined results: a null or empty text has no spans; offsets count code points; a text repeated gives the same
spans; without a region to train on nothing is added; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LONGEST = 8
#: Words on either side of a trigger that belong to its region.
AROUND = 4
SHAPES = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its start only: a later start could not match where the first does not.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _NO_DIGIT = re.compile(r"[0-9]"), re.compile(r"[^0-9]+")
_WORD = re.compile(r"\S+")
_AT = re.compile(r"[\[({]at[\])}]|@", re.I)
_DOT = re.compile(r"[\[({]dot[\])}]|(?<![A-Za-z])dot(?![A-Za-z])", re.I)
_SPELLED = ("(at)", "[at]", "{at}", " dot ")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ ends one run of local characters, so the leftmost match is the first @ with a run before and a domain after."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return out


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Words near triggers, as (start, end) in the text; regions that touch are one."""
    if not ("@" in text or _DIGIT.search(text) or any(x in text.lower() for x in _SPELLED)):
        return
    recent: list[tuple[int, int]] = []  # the last words without a trigger
    now: list[tuple[int, int]] = []
    quiet = 0
    for m in _WORD.finditer(text):
        word = m.group()
        if _DIGIT.search(word) or _AT.search(word) or word.lower().strip(".,;") == "dot":
            now += [*recent, m.span()]
            recent, quiet = [], 0
        elif now and quiet < AROUND:
            now.append(m.span())
            quiet += 1
        else:
            if now:
                yield now
                now, quiet = [], 0
            recent = [*recent[1 - AROUND :], m.span()]
    if now:
        yield now


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its edges; brackets that pair inside stay."""
    while start < end and (text[start] in "\"'<[{,;:!?.=" or text[start] == "(" and ")" not in text[start:end]):
        start += 1
    while start < end and (text[end - 1] in "\"'>]},;:!?.=" or text[end - 1] == ")" and "(" not in text[start:end]):
        end -= 1
    return start, end


def candidate(span: str) -> bool:
    """Whether a span may be an entity at all: an address with an at sign, or figures with separators."""
    if _AT.search(span):
        return len(span) < 200
    return bool(_DIGIT.search(span)) and (len(span) < 200) and not re.search(r"[^0-9\s().+/_-]", span)


def span_features(span: str) -> list[int]:
    """Indices of the features that hold for a whole span."""
    digits = _NO_DIGIT.sub("", span)
    n, words = len(digits), span.count(" ") + 1
    at, letters = bool(_AT.search(span)), bool(re.search("[A-Za-z]", span))
    parts = span.split(".")
    runs = [len(x) for x in re.findall("[0-9]+", span)]
    held = [
        True, at, letters, "@" in span, bool(_DOT.search(span)), bool(re.search(r"\.[A-Za-z]{2,}$", span)), bool(re.search(r"[A-Za-z]{2,}$", span)) and at,
        span[0] == "+", span[0] == "(", span[-1] in "()", n == 0, 1 <= n <= 4, 5 <= n <= 8, n == 9, n == 10, n == 11, 12 <= n <= 15, 16 <= n <= 19, n > 19,
        13 <= n <= 19 and luhn(digits), len(parts) == 4 and all(x.isascii() and x.isdigit() and _small(x) for x in parts), len(parts) == 4, "-" in span, "/" in span or "_" in span,
        words == 1, words == 2, words == 3, words == 4, words > 4, max(runs, default=0) > 6, runs[-2:] == [3, 4], at and words > 1 and not re.match(r"\S+\s?[\[({@]", span),
        len(span) > 2 * n + 8 and not at, span.count("(") != span.count(")"), len(set(runs)) == 1 and len(runs) > 1, bool(re.search(r"\s", span)) and "." in span and not at,
    ]
    return [k for k, x in enumerate(held) if x] + [len(held) + zlib.crc32(("-".join(map(str, runs[:8]))).encode()) % SHAPES]


FEATURES = 36 + SHAPES


@dataclass
class Field:
    """weights: (kinds, FEATURES). steps: transitions between segment types, 0 outside, then the kinds."""

    weights: np.ndarray
    steps: np.ndarray

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Best segmentation's entities of every region."""
        return [x for region in regions(text) for x in self._best(text, region)]

    def _best(self, text: str, words: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        types = len(KINDS) + 1
        score = np.full((len(words) + 1, types), -np.inf)
        score[0, 0] = 0.0
        back: list[list] = [[None] * types]
        for j in range(1, len(words) + 1):
            row: list = [None] * types
            arrive = score[j - 1] + self.steps[:, 0]
            score[j, 0], row[0] = arrive.max(), (j - 1, int(arrive.argmax()), None)
            for length in range(1, min(LONGEST, j) + 1):
                i = j - length
                span = trim(text, words[i][0], words[j - 1][1])
                if span[0] >= span[1] or not candidate(text[span[0] : span[1]]):
                    continue
                own = self.weights[:, span_features(text[span[0] : span[1]])].sum(1)
                arrive = score[i][:, None] + self.steps[:, 1:]
                totals = arrive.max(0) + own
                for k in range(types - 1):
                    if totals[k] > score[j, k + 1]:
                        score[j, k + 1], row[k + 1] = totals[k], (i, int(arrive[:, k].argmax()), (KINDS[k], *span))
            back.append(row)
        out, j, y = [], len(words), int(score[len(words)].argmax())
        while j > 0:
            i, before, found = back[j][y]
            if found:
                out.append(found)
            j, y = i, before
        return out[::-1]


@dataclass(frozen=True)
class Settings:
    sample: int = 1_500
    longest_region: int = 24
    steps: int = 80
    rate: float = 0.1
    penalty: float = 1e-3
    #: Added to the transitions into an entity in search.
    caution: float = -1.0


def rewritten(kind: str, span: str, draw: int) -> str:
    """The same datum as the patterns do not expect it; draw chooses among the ways."""
    if kind == "email":
        name, _, host = span.partition("@")
        ways = [(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" (at) ", "."), ("(at)", ".")]
        at, dot = ways[draw % len(ways)]
        return name + at + host.replace(".", dot)
    digits = _NO_DIGIT.sub("", span)
    if kind == "phone":
        own = digits[-10:]
        ways = [f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"{own[:3]}.{own[3:6]}.{own[6:]}", f"00{digits[:-10] or 1} {own[:3]} {own[3:6]} {own[6:]}"]
        return ways[draw % len(ways)] if len(own) == 10 else span
    if kind == "card":
        groups = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return (".", "/", "_", " - ")[draw % 4].join(groups)
    return span


def training_regions(docs: DataFrame, s: Settings, text: str = "text") -> DataFrame:
    """(draw, words, spans): regions as words joined by spaces, with (kind, start, end) of base spans in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0):
                whole = value.as_py() or ""
                base = base_spans(whole)
                for region in regions(whole):
                    if len(region) > s.longest_region:
                        continue
                    lo, hi = region[0][0], region[-1][1]
                    if hi - lo > 2000:
                        continue
                    piece = whole[lo:hi]
                    inside = [(k, a - lo, b - lo) for k, a, b in base if lo <= a and b <= hi]
                    draw = zlib.crc32(piece.encode())
                    out.append((draw, piece, ",".join(f"{k}:{a}:{b}" for k, a, b in inside)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["draw", "words", "spans"])

    rows = docs.select(F.col(text).alias("text"))
    made = rows.mapInArrow(run, "draw bigint, words string, spans string")
    return made.distinct().orderBy("draw", "words", "spans").limit(s.sample)


def _example(piece: str, spans: list[tuple[str, int, int]], draw: int) -> tuple[str, list[tuple[str, int, int]]]:
    """The region as it is for even draws, else with its spans rewritten."""
    if draw % 2 == 0:
        return piece, spans
    out, made, last = "", [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a < last:
            continue
        new = rewritten(kind, piece[a:b], draw // 2)
        out += piece[last:a]
        made.append((kind, len(out), len(out) + len(new)))
        out, last = out + new, b
    return out + piece[last:], made


def _logsum(x: np.ndarray, axis) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]], s: Settings) -> Field:
    """Maximum likelihood of the segmentations, all regions at once: forward and backward sums over word positions."""
    types = len(KINDS) + 1
    rows, gold, gold_steps, sizes = [], [], np.zeros((types, types)), []  # rows: (region, end, length, features)
    for text, spans in examples:
        words = [m.span() for m in _WORD.finditer(text)]
        truth, r = {(a, b): KINDS.index(k) for k, a, b in spans}, len(sizes)
        segments, own = [], {}
        for j in range(1, len(words) + 1):
            for length in range(1, min(LONGEST, j) + 1):
                a, b = trim(text, words[j - length][0], words[j - 1][1])
                if a < b and candidate(text[a:b]):
                    segments.append((r, j, length, span_features(text[a:b])))
                    if (a, b) in truth:
                        own[j] = (length, truth[(a, b)], len(rows) + len(segments) - 1)
        if len(own) != len(truth) or len(words) > s.longest_region + 8:
            continue  # a span that does not end where words do
        path, j = [], len(words)
        while j > 0:
            length, kind, at = own.get(j, (1, -1, -1))
            path.append(kind + 1)
            gold += [(at, kind)] if at >= 0 else []
            j -= length
        for a, b in zip([0, *path[::-1]], path[::-1], strict=False):
            gold_steps[a, b] += 1
        rows += segments
        sizes.append(len(words))
    field = Field(np.zeros((len(KINDS), FEATURES)), np.zeros((types, types)))
    if not gold:
        field.steps[:, 1:] = -1e9
        return field
    n, longest = len(sizes), max(sizes)
    matrix = np.zeros((len(rows), FEATURES))
    for k, row in enumerate(rows):
        matrix[k, row[3]] = 1
    region, end, length = (np.array([x[k] for x in rows]) for k in range(3))
    truth = np.zeros((len(rows), len(KINDS)))
    for at, kind in gold:
        truth[at, kind] = 1
    gold_weights, sizes = truth.T @ matrix, np.array(sizes)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.weights, field.steps)]
    for step in range(1, s.steps + 1):
        own = np.full((n, longest + 1, LONGEST + 1, types), -np.inf)
        own[:, 1:, 1, 0] = 0.0
        own[region, end, length, 1:] = matrix @ field.weights.T
        ahead = np.full((n, longest + 1, types), -np.inf)
        ahead[:, 0, 0] = 0.0
        for j in range(1, longest + 1):
            most = min(LONGEST, j)
            before = np.stack([ahead[:, j - x] for x in range(1, most + 1)], 1)  # region, length, type
            arrive = _logsum(before[:, :, :, None] + field.steps[None, None], 2)
            ahead[:, j] = _logsum(arrive + own[:, j, 1 : most + 1], 1)
        back = np.full((n, longest + 1, types), -np.inf)
        back[np.arange(n), sizes] = 0.0
        steps = np.zeros((types, types))
        total = _logsum(ahead[np.arange(n), sizes], 1)
        for j in range(longest - 1, -1, -1):
            most = min(LONGEST, longest - j)
            later = np.stack([own[:, j + x, x] + back[:, j + x] for x in range(1, most + 1)], 1)  # region, length, type
            later = _logsum(later, 1)
            joint = field.steps[None] + later[:, None, :]
            back[:, j] = np.where((sizes == j)[:, None], 0.0, _logsum(joint, 2))
            inside = (j < sizes)[:, None, None]
            steps += np.where(inside, np.exp(ahead[:, j][:, :, None] + joint - total[:, None, None]), 0.0).sum(0)
        came = _logsum(ahead[region, end - length][:, :, None] + field.steps[None], 1)[:, 1:]
        expected = np.exp(came + own[region, end, length, 1:] + back[region, end][:, 1:] - total[region][:, None])
        grads = ((gold_weights - expected.T @ matrix) / n - s.penalty * field.weights, (gold_steps - steps) / n - s.penalty * field.steps)
        for (mean, square), value, grad in zip(moments, (field.weights, field.steps), grads, strict=True):
            mean += 0.1 * (grad - mean)
            square += 0.001 * (grad**2 - square)
            value += s.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    field.steps[:, 1:] += s.caution
    return field


def train(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> Field:
    rows = training_regions(docs, s, text).toPandas()
    split = lambda x: [(k, int(a), int(b)) for k, a, b in (y.split(":") for y in x.split(",") if y)]
    return fit([_example(r.words, split(r.spans), int(r.draw)) for r in rows.itertuples()], s)


def find(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, base) by kind, then start."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value in batch.column(1):
                whole = value.as_py() or ""
                base = base_spans(whole)
                taken = sorted((a, b) for _, a, b in base)
                starts, ends = np.array([a for a, _ in taken], np.int64), np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else np.zeros(0, np.int64)

                def free(a: int, b: int) -> bool:
                    k = int(np.searchsorted(starts, b))  # base spans that start before b
                    return k == 0 or ends[k - 1] <= a

                added = [x for x in shared.value.spans(whole) if free(x[1], x[2])]
                every = [(*x, True) for x in base] + [(*x, False) for x in added]
                every.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                made.append([dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(span))], ["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")
