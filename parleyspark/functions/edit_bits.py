"""Translation edits of many pairs of texts at once: rows of the edit tables as bits, in step over all pairs and shifts.

Neighbours in a row of the edit table differ by one at most, so a row inside the band is one number and two masks of
64 bits (steps up, steps down), and the next row follows by some bit operations (Hyyrö). Cells outside the band count
as unreachable: a cell that comes into the band on the right meets no equal word until its diagonal neighbour is in
it, and the cell left of the band takes a value that nothing inside gains from. Results are those of `edit_rate.Table`.
"""

from __future__ import annotations

import numpy as np

#: Shifts whose rows are taken at once.
BLOCK = 8192
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
_FLIPPED = np.array([int(f"{x:08b}"[::-1], 2) for x in range(256)], np.uint8)


def _low(n: np.ndarray) -> np.ndarray:
    """Masks of the n lowest bits."""
    n = np.clip(n, 0, 64)
    return np.where(n >= 64, ALL, (ONE << (n & 63).astype(np.uint64)) - ONE)


def _flip(x: np.ndarray) -> np.ndarray:
    """The bits of each number in reverse order."""
    return np.ascontiguousarray(_FLIPPED[x.view(np.uint8).reshape(-1, 8)[:, ::-1]]).view(np.uint64)[:, 0]


def _spans(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, element) of ranges of `counts` numbers from `first` on."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]


class Rows:
    """What a step to a row needs, for each row of all tables: from the window (a0, b0) before to the window (a, b)."""

    def __init__(self, a0: np.ndarray, b0: np.ndarray, a: np.ndarray, b: np.ndarray):
        odd = a > a0
        self.odd, self.at = odd.astype(np.uint64), a - odd
        self.drop = (a - a0 - odd).astype(np.uint64)
        self.equal = _low(np.minimum(b0, b - 1) - self.at)  # columns that have a diagonal neighbour in the band
        self.diagonal = _low(b0 - self.at)
        self.inside = _low(b - 1 - a)
        self.drops = bool(self.drop.any())
        self.word, self.bit = self.at >> 6, (self.at & 63).astype(np.uint64)

    def step(self, r: np.ndarray, base: np.ndarray, up: np.ndarray, down: np.ndarray, words: np.ndarray, maps: np.ndarray):
        """(base, up, down, kept, deleted) of rows r after the ones given; words: where the bits of each row's word begin in maps."""
        if self.drops:
            drop = self.drop[r]
            gone = (ONE << drop) - ONE
            base = base + np.bitwise_count(up & gone) - np.bitwise_count(down & gone)
            up, down = up >> drop, down >> drop
        at, bit, odd = words + self.word[r], self.bit[r], self.odd[r]
        equal = (maps[at] >> bit | maps[at + 1] << ONE << (np.uint64(63) - bit)) & self.equal[r]
        same = ((equal & up) + up ^ up) | equal | down  # as the diagonal neighbour
        more, less = down | ~(same | up), up & same  # one more or less than the cell above
        left = more << ONE | ONE
        up, down = less << ONE | ~(same | left), same & left
        base = base + 1 + (odd & up & ONE).astype(np.int64) - (odd & down & ONE).astype(np.int64)
        inside = self.inside[r]
        return base, up >> odd | ~inside, down >> odd & inside, equal | ~same, more


class Tables:
    """Edit tables of pairs (words, ref) of numbers, longest words first; a shift changes the words of a pair."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]], band: int):
        self.n, self.m = (np.array([len(x[k]) for x in pairs]) for k in (0, 1))
        self.t0, self.r0 = np.cumsum(self.n) - self.n, np.cumsum(self.m) - self.m
        self.row0 = np.cumsum(self.n + 1) - self.n - 1
        who_t, who_r = (np.repeat(np.arange(len(pairs)), x) for x in (self.n, self.m))
        text, ref = (np.concatenate([x[k] for x in pairs]).astype(np.int64) for k in (0, 1))
        size = int(max(text.max(), ref.max())) + 1
        keys, ids = np.unique(who_r * size + ref, return_inverse=True)
        own = who_t * size + text
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        self.ref, self.text = ids + 1, np.where(keys[at] == own, at + 1, 0)  # 0: not in the reference
        wide = np.concatenate([[int(self.m.max()) // 64 + 3], (self.m // 64 + 3)[keys // size]])
        self.begin = np.cumsum(wide) - wide
        place = np.arange(len(ref)) - self.r0[who_r]
        self.maps, self.turned = (np.zeros(int(wide.sum()), np.uint64) for _ in range(2))
        for bits, x in ((self.maps, place), (self.turned, self.m[who_r] - 1 - place)):
            np.bitwise_or.at(bits, self.begin[self.ref] + (x >> 6), ONE << (x & 63).astype(np.uint64))
        by = np.lexsort((place, self.ref))
        self.span = int(max(self.m.max(), self.n.max())) + 1
        self.sorted, self.places = self.ref[by] * self.span + place[by], place[by]
        who, i = _spans(np.zeros(len(pairs), np.int64), self.n + 1)
        n, m = self.n[who], self.m[who]
        middle = np.floor(i * (m / n)).astype(np.int64)
        self.a = np.where(i == 0, 0, np.maximum(0, middle - band))
        self.b = np.where((i == 0) | (i == n), m + 1, np.minimum(m + 1, middle + band))
        before, after = np.maximum(np.arange(len(i)) - 1, 0), np.minimum(np.arange(len(i)) + 1, len(i) - 1)
        self.down = Rows(np.where(i == 0, 0, self.a[before]), np.where(i == 0, m + 1, self.b[before]), self.a, self.b)
        a, b = m + 1 - self.b, m + 1 - self.a
        self.back = Rows(np.where(i == n, a, m + 1 - self.b[after]), np.where(i == n, b, m + 1 - self.a[after]), a, b)
        self.wide = self.b - self.a
        self.base, self.rest = (np.zeros(len(i), np.int64) for _ in range(2))
        self.up, self.fall, self.kept, self.deleted, self.rest_up, self.rest_fall = (np.zeros(len(i), np.uint64) for _ in range(6))

    def fill(self, who: np.ndarray) -> np.ndarray:
        """Rows of the tables of some pairs, from the top and from the end; their distances."""
        n, rows = self.n[who], self.row0[who]
        lasts = np.searchsorted(-n, -np.arange(int(n[0]) + 2), side="right")  # texts of k words or more
        self.base[rows], self.up[rows], self.fall[rows] = 0, ALL, 0
        self.rest[rows + n], self.rest_up[rows + n], self.rest_fall[rows + n] = 0, ALL, 0
        for back in (False, True):
            kind, maps = (self.back, self.turned) if back else (self.down, self.maps)
            words = self.begin[self.text]
            base, up, fall = np.zeros(len(who), np.int64), np.full(len(who), ALL), np.zeros(len(who), np.uint64)
            text, here = (self.t0[who] + n, rows + n) if back else (self.t0[who] - 1, rows)
            for k in range(1, int(n[0]) + 1 - back):
                now, i = lasts[k + back], -k if back else k
                r = here[:now] + i
                base, up, fall, kept, deleted = kind.step(r, base[:now], up[:now], fall[:now], words[text[:now] + i], maps)
                if back:
                    self.rest[r], self.rest_up[r], self.rest_fall[r] = base, up, fall
                else:
                    self.base[r], self.up[r], self.fall[r], self.kept[r], self.deleted[r] = base, up, fall, kept, deleted
        _, r = _spans(rows + 1, n)
        self.kept[r] &= self.down.diagonal[r]
        # rows that run from the end of the reference become rows from its front
        some, up, fall = _low(self.wide[r] - 1), self.rest_up[r], self.rest_fall[r]
        self.rest[r] += np.bitwise_count(up & some).astype(np.int64) - np.bitwise_count(fall & some)
        turn = np.clip(65 - self.wide[r], 0, 63).astype(np.uint64)
        self.rest_up[r], self.rest_fall[r] = (_flip(x & some) >> turn for x in (fall, up))
        r = rows + n
        some = _low(self.m[who] - self.a[r])
        return self.base[r] + np.bitwise_count(self.up[r] & some) - np.bitwise_count(self.fall[r] & some)

    def align(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position at each place of the references, and which places of references and texts are wrong."""
        at, wrong_ref, wrong = np.zeros(len(self.ref), np.int64), np.zeros(len(self.ref), bool), np.zeros(len(self.text), bool)
        t, r, row = self.t0[who], self.r0[who], self.row0[who]
        i, j = self.n[who], self.m[who]
        while len(i):
            here = row + i
            bit = j - self.down.at[here] - 1
            moved = np.maximum(bit, 0).astype(np.uint64)
            keep = (self.kept[here] >> moved & ONE).astype(bool) & (bit >= 0) & (i > 0)
            gone = ~keep & ((self.deleted[here] >> moved & ONE).astype(bool) | (bit < 0)) & (i > 0)
            ref, text = r + np.maximum(j - 1, 0), t + np.maximum(i - 1, 0)
            bad = ~keep | (self.text[text] != self.ref[ref])
            uses = keep | gone
            wrong[text[uses]] = bad[uses]
            takes = ~gone
            at[ref[takes]], wrong_ref[ref[takes]] = i[takes] - 1, bad[takes]
            i, j = i - uses, j - takes
            on = i + j > 0
            if not on.all():
                t, r, row, i, j = t[on], r[on], row[on], i[on], j[on]
        return at, wrong_ref, wrong

    def runs(self, who: np.ndarray, longest: int, reach: int) -> tuple[np.ndarray, ...]:
        """(pair, start, start in the reference, length) of equal runs, by pair, start, reference start, length."""
        p, s = _spans(np.zeros(len(who), np.int64), self.n[who])
        p = who[p]
        word = self.text[self.t0[p] + s]
        low = np.searchsorted(self.sorted, word * self.span + np.maximum(s - reach, 0))
        high = np.searchsorted(self.sorted, word * self.span + np.minimum(s + reach + 1, self.span), side="left")
        each, k = _spans(low, np.where(word > 0, high - low, 0))
        p, s, there = p[each], s[each], self.places[k]
        length, on = np.ones(len(p), np.int64), np.arange(len(p))
        for x in range(1, longest):
            on = on[(s[on] + x < self.n[p[on]]) & (there[on] + x < self.m[p[on]])]
            on = on[self.text[self.t0[p[on]] + s[on] + x] == self.ref[self.r0[p[on]] + there[on] + x]]
            length[on] += 1
        each, k = _spans(np.ones(len(p), np.int64), length)
        return p[each], s[each], there[each], k

    def shifts(self, who: np.ndarray, tried: np.ndarray, longest: int, reach: int, most: int) -> tuple[np.ndarray, ...]:
        """(pair, start, length, target) of the shifts to try, as many as `tried` (by pair, added to) leaves of `most`."""
        at, wrong_ref, wrong = self.align(who)
        bad, bad_ref = (np.concatenate([[0], np.cumsum(x)]) for x in (wrong, wrong_ref))
        p, s, there, k = self.runs(who, longest, reach)
        text, ref = self.t0[p] + s, self.r0[p] + there
        found = (bad[text + k] > bad[text]) & (bad_ref[ref + k] > bad_ref[ref]) & ~((s <= at[ref]) & (at[ref] < s + k))
        p, s, there, k = p[found], s[found], there[found], k[found]
        each, place = _spans(there - 1, k + 1)
        to = np.where(place >= 0, at[self.r0[p[each]] + np.maximum(place, 0)] + 1, 0)
        new = np.ones(len(each), bool)
        new[1:] = (each[1:] != each[:-1]) | (to[1:] != to[:-1])
        each, to = each[new], to[new]
        # a run is tried whole if those before it leave room
        first = np.searchsorted(each, np.arange(len(p)))
        start = np.searchsorted(p, p)  # the pair's first run; pairs stand in ascending order
        fits = tried[p] + first - first[start] < most
        each, to = each[fits[each]], to[fits[each]]
        np.add.at(tried, p[each], 1)
        return p[each], s[each], k[each], to

    def distances(self, p: np.ndarray, first: np.ndarray, end: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Distances after words first to end become `size` words from `one` on and then those from `two` on."""
        out = np.zeros(len(p), np.int64)
        by = np.argsort(first - end, kind="stable")  # the longest changes first
        for block in range(0, len(by), BLOCK):
            some = by[block : block + BLOCK]
            row, text, x, y, z = self.row0[p[some]] + first[some], self.t0[p[some]], one[some], two[some] - size[some], size[some]
            span = (end - first)[some]
            base, up, fall = self.base[row], self.up[row], self.fall[row]
            lasts = np.searchsorted(-span, -np.arange(int(span[0]) + 1), side="left")  # changes longer than t
            for t in range(int(span[0])):
                now = lasts[t]
                words = self.begin[self.text[text[:now] + t + np.where(t < z[:now], x[:now], y[:now])]]
                base, up, fall, _, _ = self.down.step(row[:now] + t + 1, base[:now], up[:now], fall[:now], words, self.maps)
                if lasts[t + 1] < now:
                    done = slice(lasts[t + 1], now)
                    r = row[done] + t + 1
                    inside = self.down.inside[r]
                    bits = [np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8) for v in (up[done] & inside, fall[done], self.rest_up[r], self.rest_fall[r])]
                    sums = np.cumsum(bits[0] + bits[2] - bits[1] - bits[3], axis=1, dtype=np.int8)
                    out[some[done]] = base[done] + self.rest[r] + np.minimum(sums.min(axis=1), 0)
        return out


def edits_of(pairs: list[tuple[np.ndarray, np.ndarray]], longest: int, reach: int, most: int, band: int) -> np.ndarray:
    """Shifts and edits of each pair; no text is empty, and references have at most 8 times the words of their text."""
    order = sorted(range(len(pairs)), key=lambda k: -len(pairs[k][0]))
    tables = Tables([pairs[k] for k in order], band)
    who, out = np.arange(len(pairs)), np.zeros(len(pairs), np.int64)
    tried, shifts = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    while len(who):
        distance = np.zeros(len(pairs), np.int64)
        distance[who] = tables.fill(who)
        out[who] = shifts[who] + distance[who]
        p, s, k, to = tables.shifts(who, tried, longest, reach, most)
        open_ = tried[p] < most
        p, s, k, to = p[open_], s[open_], k[open_], to[open_]
        right = to >= s
        last = np.where(to > s + k, to, np.minimum(to + k, tables.n[p]))  # inside itself, so far to the right
        first, end = np.where(right, s, to), np.where(right, last, s + k)
        # left: the run, then the words before it; right: the words after it, then the run
        one, two, size = np.where(right, s + k, s), np.where(right, s, to), np.where(right, last - s - k, k)
        real = (size > 0) & (end > first + np.where(right, k, 0))  # others change nothing
        kept = np.flatnonzero(real)
        # the same shift can come from several places of the reference
        kept = kept[np.lexsort((to[kept], k[kept], s[kept], p[kept]))]
        again = np.all([np.diff(x[kept]) == 0 for x in (p, s, k, to)], axis=0)
        kept = kept[np.concatenate([[True], ~again])[: len(kept)]]
        p, s, k, to, first, end, one, two, size = (x[kept] for x in (p, s, k, to, first, end, one, two, size))
        gain = distance[p] - tables.distances(p, first, end, one, two, size) if len(p) else np.zeros(0, np.int64)
        # of equal gains the longest run, then the first, then the nearest to the front
        by = np.lexsort((to, s, -k, -gain, p))
        best = by[np.concatenate([[True], np.diff(p[by]) > 0])[: len(by)]]
        best = best[gain[best] > 0]
        for b in best:
            at = tables.t0[p[b]]
            x, y, z, f, e = one[b], two[b], size[b], first[b], end[b]
            tables.text[at + f : at + e] = np.concatenate([tables.text[at + x : at + x + z], tables.text[at + y : at + y + e - f - z]])
        who = np.sort(p[best])
        shifts[who] += 1
    found = np.zeros(len(pairs), np.int64)
    found[order] = out
    return found
