"""Translation edit rate: word edits after greedy shifts of blocks, over the mean reference length.

A shift moves a run of words that also stands in the reference to where it stands there, at the cost of one edit.
The best shift is taken until none helps; what is left is an edit distance. Costs are searched in a band around the
diagonal. All shifts of one step are tried together: each goes down the rows of the edit table between the first and
the last word that it moves, and from there on the costs of the rest are those of the text before the shift.
`edit_bits` does this for many pairs in step; `Table` states it for one pair and takes texts of unusual shapes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from parleyspark.functions.edit_bits import edits_of

#: Fixed values of the measure, which its scores depend on: longest run, farthest run, tried shifts, half width of the band.
RUN, REACH, TRIED, BAND = 10, 50, 1000, 25
FAR = 1 << 28
#: Words of the texts, and 64-bit numbers that say where words stand in references, that are held at once.
TOGETHER, MAPS = 1 << 18, 1 << 22


def _windows(n: int, m: int) -> list[tuple[int, int]]:
    """First and last reference length + 1 of each row of the edit table, rows 1 to n."""
    ratio = m / n
    half = math.ceil(ratio / 2 + BAND) if ratio / 2 > BAND else BAND
    out = []
    for i in range(1, n + 1):
        middle = math.floor(i * ratio)
        out.append((max(0, middle - half), m + 1 if i == n else min(m + 1, middle + half)))
    return out


def _next_row(before: np.ndarray, low: int, window: tuple[int, int], words: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, by replacing or keeping, by deleting) inside the window, for each column of candidates; `before` begins at low."""
    a, b = window
    held = np.full((b - a + 1, before.shape[1]), FAR, np.int32)  # the row before from a - 1 on
    first, last = max(a - 1, low), min(b, low + len(before))
    held[first - a + 1 : last - a + 1] = before[first - low : last - low]
    gone = held[1:] + 1
    keep, firsts = held[:-1], int(a == 0)  # nothing is replaced in the column of the empty reference
    keep[firsts:] += words != ref[a - 1 + firsts : b - 1, None]
    steps = np.arange(b - a, dtype=np.int32)[:, None]
    row = np.minimum.accumulate(np.minimum(keep, gone) - steps, axis=0) + steps
    return row, keep, gone


class Table:
    """The edit table of a text against a reference."""

    def __init__(self, words: np.ndarray, ref: np.ndarray):
        self.words, self.ref = words, ref
        self.windows = _windows(len(words), len(ref))
        self.rows, self.kinds = [(0, np.arange(len(ref) + 1, dtype=np.int32)[:, None])], []
        for i, window in enumerate(self.windows):
            low, before = self.rows[-1]
            row, keep, gone = _next_row(before, low, window, words[i : i + 1], ref)
            self.rows.append((window[0], row))
            # equal ways are taken in this order: keep or replace (0), delete (1), insert (2)
            self.kinds.append(np.where(keep == row, 0, np.where(gone == row, 1, 2))[:, 0])
        self.distance = int(self.rows[-1][1][-1, 0])
        self._rest = None

    def alignment(self) -> tuple[list[int], list[bool], list[bool]]:
        """Text position at each reference position, and which positions of reference and text are wrong."""
        i, j = len(self.words), len(self.ref)
        steps = []
        while i or j:
            kind = 2 if not i else int(self.kinds[i - 1][j - self.windows[i - 1][0]])
            steps.append(kind)
            i, j = i - (kind != 2), j - (kind != 1)
        at, wrong_ref, wrong = [], [], []
        for kind in reversed(steps):
            if kind != 2:
                wrong.append(kind == 1 or self.words[len(wrong)] != self.ref[len(wrong_ref)])
            if kind != 1:
                at.append(len(wrong) - 1)
                wrong_ref.append(kind == 2 or bool(wrong[-1]))
        return at, wrong_ref, wrong

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """(first reference length, cost of the rest) of each row from 1 on: what remains from there to the end of both."""
        if self._rest is None:
            n, m = len(self.words), len(self.ref)
            width = max(b - a for a, b in self.windows)
            lows, out = np.array([0, *(a for a, _ in self.windows)]), np.full((n + 1, width + 1), FAR, np.int32)
            for i in range(n, 0, -1):
                a, b = self.windows[i - 1]
                steps = np.arange(b - a, dtype=np.int32)
                if i == n:
                    row = m - a - steps
                else:
                    later, end = self.windows[i]
                    held = np.full(b - a + 1, FAR, np.int32)
                    held[later - a : min(end, b + 1) - a] = out[i + 1, : min(end, b + 1) - later]
                    keep, last = held[1:], min(b, m) - a
                    gone = held[:-1] + 1
                    keep[:last] += self.words[i] != self.ref[a : a + last]
                    row = np.minimum.accumulate((np.minimum(keep, gone) + steps)[::-1])[::-1] - steps
                out[i, : b - a] = row
            self._rest = lows, out
        return self._rest

    def distances(self, shifted: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """Distance of each (first changed position, position after the last one, words between them).

        All go down their own rows at once, from the one before the change to the one after it; the rest is that of this table.
        """
        lows, rest = self.rest()
        n, m, size = len(self.words), len(self.ref), rest.shape[1] - 1
        order = sorted(range(len(shifted)), key=lambda k: shifted[k][0] - shifted[k][1])  # the longest changes first
        begins, spans = (np.array([x(*shifted[k]) for k in order]) for x in (lambda s, e, w: s, lambda s, e, w: e - s))
        texts = np.zeros((len(order), int(spans[0])), np.int32)
        for at, k in enumerate(order):
            texts[at, : spans[at]] = shifted[k][2]
        wide = np.array([m + 1, *(b - a for a, b in self.windows)])
        steps, out = np.arange(size, dtype=np.int32)[:, None], np.zeros(len(order), np.int64)
        padded = np.concatenate([[-1], self.ref, np.full(size, -1, np.int32)])
        held = np.full((size, len(order)), FAR, np.int32)
        for at, i in enumerate(begins):
            row = self.rows[i][1][:size, 0]
            held[: len(row), at] = row
        lasts = np.searchsorted(-spans, -np.arange(int(spans[0]) + 1), side="left")  # changes longer than t
        for t in range(int(spans[0])):
            now, i = lasts[t], begins[: lasts[t]] + t
            a, away = lows[i + 1], lows[i + 1] - lows[i]
            most = int(away.max())
            before = np.full((size + 1 + most, now), FAR, np.int32)  # from the reference length before the first one
            before[1 : size + 1] = held[:, :now]
            if most == away.min():
                before = before[most:]
            else:
                before = np.take_along_axis(before, away + np.arange(size + 1)[:, None], axis=0)
            keep, gone = before[:-1], before[1:] + 1
            keep += texts[:now, t] != padded[a + steps]
            held = np.minimum(keep, gone) - steps
            np.minimum.accumulate(held, axis=0, out=held)
            held += steps
            if (wide[i + 1] < size).any():
                held[steps >= wide[i + 1]] = FAR
            if lasts[t + 1] < now:
                done = slice(lasts[t + 1], now)
                out[done] = (held[:, done].astype(np.int64) + rest[begins[done] + t + 1, :size].T).min(0)
        found = np.zeros(len(order), np.int64)
        found[order] = out
        return found


def _runs(words: np.ndarray, ref: np.ndarray):
    """(start, start in the reference, length) of equal runs, by start, then reference start, then length."""
    n, m = len(words), len(ref)
    for start in range(n):
        first = max(0, start - REACH)
        for there in np.flatnonzero(ref[first : start + REACH + 1] == words[start]) + first:
            for length in range(1, RUN + 1):
                yield start, int(there), length
                if start + length == n or there + length == m or words[start + length] != ref[there + length]:
                    break


def _moved(words: np.ndarray, start: int, length: int, to: int) -> tuple[int, int, np.ndarray]:
    """(first, end, words between them) after the run at start is put before position `to`; inside itself, so far to the right."""
    end = start + length
    if to < start:
        return to, end, np.concatenate([words[start:end], words[to:start]])
    last = to if to > end else min(to + length, len(words))
    return start, last, np.concatenate([words[end:last], words[start:end]])


def _best_shift(table: Table, tried: int) -> tuple[int, np.ndarray, int]:
    """(gain, shifted words, shifts tried so far); of equal gains the longest run, then the first, then the nearest to the front."""
    at, wrong_ref, wrong = table.alignment()
    errors, errors_ref = np.concatenate([[0], np.cumsum(wrong)]), np.concatenate([[0], np.cumsum(wrong_ref)])
    named, shifted = [], []
    for start, there, length in _runs(table.words, table.ref):
        if errors[start + length] == errors[start] or errors_ref[there + length] == errors_ref[there] or start <= at[there] < start + length:
            continue
        last = -1
        for place in range(there - 1, there + length):
            to = at[place] + 1 if place >= 0 else 0
            if to != last:
                named.append((length, -start, -to))
                shifted.append(_moved(table.words, start, length, to))
                last = to
        if tried + len(named) >= TRIED:
            break
    if not named:
        return 0, table.words, tried
    gains = table.distance - table.distances(shifted)
    best = max(range(len(named)), key=lambda k: (gains[k], named[k]))
    first, end, between = shifted[best]
    return int(gains[best]), np.concatenate([table.words[:first], between, table.words[end:]]), tried + len(named)


def _by_table(words: np.ndarray, ref: np.ndarray) -> int:
    """Shifts and edits of one pair, for shapes that `edit_bits` does not take."""
    table, tried, shifts = Table(words, ref), 0, 0
    while True:
        gain, moved, tried = _best_shift(table, tried)
        if tried >= TRIED or gain <= 0:
            return shifts + table.distance
        shifts, table = shifts + 1, Table(moved, ref)


def edits_of_pairs(pairs: list[tuple[list[str], list[str]]]) -> list[int]:
    """Shifts and word edits that turn the first text of each pair into the second one."""
    number: dict[str, int] = {}
    out, groups, held, room = [max(len(a), len(b)) for a, b in pairs], [[]], 0, 0
    for at in sorted((k for k, x in enumerate(pairs) if x[0] and x[1]), key=lambda k: len(pairs[k][0])):
        words, ref = (np.array([number.setdefault(w, len(number)) for w in x], np.int64) for x in pairs[at])
        bits = len(np.unique(ref)) * (len(ref) // 64 + 3)
        if len(ref) > 8 * len(words) or bits > MAPS:
            out[at] = _by_table(words.astype(np.int32), ref.astype(np.int32))
            continue
        held, room = held + len(words) + len(ref), room + bits
        if groups[-1] and (held > TOGETHER or room > MAPS):
            groups.append([])
            held, room = len(words) + len(ref), bits
        groups[-1].append((at, words, ref))
    for group in filter(None, groups):
        for (at, _, _), edits in zip(group, edits_of([x[1:] for x in group], RUN, REACH, TRIED, BAND), strict=True):
            out[at] = int(edits)
    return out


def translation_edits(hyp: list[str], ref: list[str]) -> int:
    """Shifts and word edits that turn hyp into ref."""
    return edits_of_pairs([(hyp, ref)])[0]


@F.pandas_udf(ST.StructType([ST.StructField("edits", ST.LongType()), ST.StructField("length", ST.DoubleType())]))
def _edit_counts(hyp: pd.Series, refs: pd.Series) -> pd.DataFrame:
    out, pairs, of = [], [], []
    for at, (text, others) in enumerate(zip(hyp, refs, strict=True)):
        words = (text or "").lower().split()
        found = {r: (r or "").lower().split() for r in others if r is not None} if others is not None else {}
        lengths = [len(found[r]) for r in others if r is not None] if found else [0]
        out.append((None if found else len(words), sum(lengths) / len(lengths)))
        pairs += [(words, r) for r in found.values()]
        of += [at] * len(found)
    least: dict[int, int] = {}
    for at, edits in zip(of, edits_of_pairs(pairs), strict=True):
        least[at] = min(edits, least.get(at, edits))
    return pd.DataFrame([(least.get(at, alone), length) for at, (alone, length) in enumerate(out)], columns=["edits", "length"])


def edit_counts(hyp: Column, refs: Column) -> Column:
    """struct(edits, length) of a text against an array of references: edits to the nearest one, mean length of all.

    Words are lower-cased and split at white space. Null texts are empty, null references left out; without any
    reference all words are edits.
    """
    return _edit_counts(hyp, refs)


def edit_rate(edits: Column, length: Column) -> Column:
    """Edits over length; against nothing 1, or 0 without edits."""
    return F.when(length > 0, edits / length).when(edits > 0, 1.0).otherwise(0.0)


def corpus_ter(df: DataFrame, hyp: str, refs: str) -> DataFrame:
    """(edits, ref_length, ter) of all rows together."""
    counted = df.select(edit_counts(F.col(hyp), F.col(refs)).alias("c")).agg(F.sum("c.edits").alias("edits"), F.sum("c.length").alias("ref_length"))
    none = F.coalesce("edits", F.lit(0)).alias("edits"), F.coalesce("ref_length", F.lit(0.0)).alias("ref_length")
    return counted.select(*none).withColumn("ter", edit_rate(F.col("edits"), F.col("ref_length")))
