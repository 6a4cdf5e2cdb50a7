"""Approximate occurrences of short strings in long ones: the q-gram lemma in diagonal bands, then banded alignment.

A string of n characters that occurs with at most k edits shares at least n + 1 - q(k + 1) q-grams with its occurrence,
on diagonals (place in the text minus place in the string) that differ by at most k. Shared grams are counted in bands
of 2k diagonals that overlap by k, so one band holds all those of an occurrence; a band is a candidate where that many
of its grams lie within n + k characters. Candidates are verified by alignment within a band of diagonals.

Windows of a long string are verified at every ``STRIDE``-th place first. Where none of them is found, a part of the string
may still be there: every window that can hold a candidate's first gram is verified then, at any place, and the one of
fewest edits is taken. A text that holds any window of a string within the budget is found. Before it is aligned, a
window has to meet the same bound for shorter grams, counted near its band: most candidates share one run of characters
and end there.
"""

from __future__ import annotations

import numpy as np

Q = 10
Q_FINE = 5
WINDOW = 100
STRIDE = 50
EDITS = 0.08
_SLICE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def folded(text: str) -> np.ndarray:
    """Code points of a text, lower case where that is one character, every white space a space: places stay."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points <= 32) | (points == 0xA0), np.uint32(32), points)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of every run of ``q`` points, by doubling."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    width, power, part = 1, _MULTIPLIER, points.astype(np.uint64) + np.uint64(1)
    out, out_width = None, 0
    rest = q
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:  # the part goes before what is there already
                out = part if out is None else part[:len(part) - out_width] * _power(out_width) + out[width:]
                out_width += width
            rest >>= 1
            if rest:
                part = part[:-width] * power + part[width:]
                power = power * power
                width *= 2
        n = len(points) - q + 1
        mixed = out[:n] * _MULTIPLIER
        return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MULTIPLIER), n, 1 << 64))


def alignments(windows: np.ndarray, regions: np.ndarray, fixed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each window against its region from any start (from place ``fixed`` if given) to any end, and
    that end. A region has len(window) + slack points; diagonals 0 to slack are looked at."""
    m, n = windows.shape
    slack = regions.shape[1] - n
    steps = np.arange(slack + 1)
    row = np.zeros((m, slack + 1), np.int64)
    if fixed is not None:
        row += np.where(steps < fixed, 1 << 20, steps - fixed)
    for i in range(n):
        new = row + (windows[:, i:i + 1] != regions[:, i:i + slack + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])  # a window character left out
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # a region character left out
    best = row.argmin(axis=1)
    return row[np.arange(m), best], best + n


class Index:
    """The q-grams of all windows of some items (id, text)."""

    def __init__(self, items, q: int = Q, window: int = WINDOW, stride: int = STRIDE, edits: float = EDITS):
        self.q, self.window, self.ids = q, window, []
        self.edits = int(window * edits)
        self.need = window + 1 - q * (self.edits + 1)
        if self.need < 1:
            raise ValueError("the edit budget leaves no shared gram")
        self.short: list[tuple[int, np.ndarray]] = []  # shorter than a window: a budget of their own
        self.points: list[np.ndarray] = []
        grams, owners, places = [], [], []
        for item, text in items:
            points = folded((text or "").strip())
            number = len(self.ids)
            self.ids.append(item)
            self.points.append(points)
            if len(points) < 2 * q:
                continue
            own = gram_hashes(points, q)
            grams.append(own)
            owners.append(np.full(len(own), number))
            places.append(np.arange(len(own)))
        self.starts = [self._starts(len(p), stride) for p in self.points]
        self.strided = [set(s) for s in self.starts]
        self.tiny = [n for n, p in enumerate(self.points) if 0 < len(p) < 2 * q]  # exact, see _exact
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.owner = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64)
        self.place = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, np.bool_)
        self.filter[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        sizes = [(len(p), *self._budget(len(p))) for p in self.points if len(p) >= 2 * q]
        self.least_need = min((need for _, _, need in sizes), default=1)
        self.reach = max((min(n, window) + k for n, k, _ in sizes), default=window)

    def _starts(self, n: int, stride: int) -> list[int]:
        if n <= self.window:
            return [0] if n else []
        return sorted({*range(0, n - self.window + 1, stride), n - self.window})

    def _budget(self, n: int) -> tuple[int, int]:
        """Edits allowed and grams needed for a window of an item of ``n`` characters."""
        if n >= self.window:
            return self.edits, self.need
        k = max(0, min(int(n * self.edits / self.window), (n + 1 - self.q) // self.q - 1))
        return k, n + 1 - self.q * (k + 1)

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, window start, start, end, edits) of every window that occurs within its budget; the best place
        in each band."""
        found: list[tuple[int, int, int, int, int, int]] = []
        waiting: list[tuple[int, int, np.ndarray]] = []
        held = 0
        lap = 2 * (self.window + 2 * self.edits)
        for n, text in enumerate(texts):
            points = folded(text)
            for at in range(0, max(1, len(points)), _SLICE):
                part = points[max(0, at - lap):at + _SLICE]
                waiting.append((n, max(0, at - lap), part))
                held += len(part)
                if held >= _SLICE:
                    found += self._search(waiting)
                    waiting, held = [], 0
        found += self._search(waiting)
        best: dict[tuple[int, int, int, int], tuple[int, ...]] = {}
        for f in found:  # bands and slices overlap
            key = (f[0], f[1], f[2], f[4])
            if key not in best or f[5] < best[key][5]:
                best[key] = f
        return sorted(best.values())

    def _search(self, waiting) -> list[tuple[int, int, int, int, int, int]]:
        if not waiting:
            return []
        out = []
        q = self.q
        sizes = np.array([len(p) for _, _, p in waiting])
        begins = np.cumsum(sizes) - sizes
        line = np.concatenate([p for _, _, p in waiting])
        for number in self.tiny:
            out += self._exact(number, waiting)
        hashes = gram_hashes(line, q)
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return out
        slot = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        text = np.searchsorted(begins, at, side="right") - 1
        good = (self.grams[slot] == hashes[at]) & (at + q <= begins[text] + sizes[text])
        at, slot, text = at[good], slot[good], text[good]
        if not len(at):
            return out
        # enough grams near, whatever their item and diagonal
        near = np.searchsorted(at, at + self.reach, side="right") - np.searchsorted(at, at - self.reach)
        good = near >= self.least_need
        at, slot, text = at[good], slot[good], text[good]
        if not len(at):
            return out
        times = self.count[slot]
        which = np.repeat(np.arange(len(at)), times)
        entry = np.repeat(self.first[slot], times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        owner, place, spot, text = self.owner[entry], self.place[entry], at[which], text[which]
        diagonal = spot - place
        length = np.array([len(p) for p in self.points])[owner]
        budget = {n: self._budget(n) for n in np.unique(length).tolist()}
        edits = np.array([budget[n][0] for n in length.tolist()])
        need = np.array([budget[n][1] for n in length.tolist()])
        width = np.maximum(edits, 1)
        candidates = []
        for shift in (0, 1):
            band = (diagonal + shift * width) // (2 * width)  # from low to low + 2 * width - 1
            low = band * 2 * width - shift * width
            order = np.lexsort((spot, band, owner, text))
            o, b, t, s = owner[order], band[order], text[order], spot[order]
            # the gram that completes the count, for each gram
            last = np.arange(len(order)) + need[order] - 1
            ok = last < len(order)
            last = np.minimum(last, len(order) - 1)
            ok &= (o[last] == o) & (b[last] == b) & (t[last] == t)
            ok &= s[last] - s <= np.minimum(length[order], self.window) + edits[order] - q
            i = np.flatnonzero(ok)
            if len(i):
                runs = np.stack([t[i], o[i], low[order][i], width[order][i], s[i] - diagonal[order][i],
                                 s[last[i]] - diagonal[order][last[i]]], axis=1)
                candidates += runs.tolist()
        hits = self._aligned(self._fine(self._strided(candidates), waiting, begins), waiting, begins)
        met = {h[:2] for h in hits}
        best: dict[tuple[int, int], tuple[int, ...]] = {}
        between = self._between([c for c in candidates if (c[0], c[1]) not in met])
        for h in self._aligned(self._fine(between, waiting, begins), waiting, begins):
            if h[:2] not in best or (h[5], h[2], h[3]) < (best[h[:2]][5], best[h[:2]][2], best[h[:2]][3]):
                best[h[:2]] = h
        return out + [(waiting[h[0]][0], *h[1:]) for h in [*hits, *best.values()]]

    def _strided(self, candidates) -> set[tuple[int, ...]]:
        """The windows at strides that a run of shared grams (between two places of an item) may belong to."""
        asked = set()
        for text, owner, low, width, one, two in candidates:
            size = min(self.window, len(self.points[owner]))
            one, two = min(one, two), max(one, two) + self.q
            for start in self.starts[owner]:
                if start < two + 3 * width and one - 3 * width < start + size:
                    asked.add((text, owner, low, width, start))
        return asked

    def _between(self, candidates) -> set[tuple[int, ...]]:
        """The other windows that hold the first gram of a run."""
        asked = set()
        for text, owner, low, width, one, _ in candidates:
            last = len(self.points[owner]) - self.window
            for start in range(max(0, one + self.q - self.window), min(one, last) + 1):
                asked.add((text, owner, low, width, start))
        return {a for a in asked if a[4] not in self.strided[a[1]]}

    def _fine(self, asked, waiting, begins) -> list[tuple[int, ...]]:
        """Those of the windows that share enough grams of ``Q_FINE`` with the text, on the diagonals looked at."""
        q, n = Q_FINE, self.window
        need = n + 1 - q * (self.edits + 1)
        groups: dict[tuple[int, ...], list[int]] = {}
        out = []
        for *key, start in asked:
            if len(self.points[key[1]]) < n or need < 1:
                out.append((*key, start))
            else:
                groups.setdefault(tuple(key), []).append(start)
        for (text, owner, low, width), starts in groups.items():
            first, last = min(starts), max(starts) + n
            own = gram_hashes(self.points[owner][first:last], q)
            region = np.zeros(last - first + 4 * width, np.uint32)  # 0 is in no text
            a = low - width + first - int(begins[text])
            part = waiting[text][2][max(0, a):max(0, a + len(region))]
            region[max(0, -a):max(0, -a) + len(part)] = part
            lines = np.lib.stride_tricks.sliding_window_view(gram_hashes(region, q), len(own))
            shared = np.concatenate([[0], np.cumsum((lines == own).any(axis=0))])
            at = np.array(starts) - first
            out += [(text, owner, low, width, starts[i]) for i in np.flatnonzero(shared[at + n - q + 1] - shared[at] >= need)]
        return out

    def _aligned(self, asked, waiting, begins) -> list[tuple[int, int, int, int, int, int]]:
        """The windows (place in ``waiting``, item, low diagonal, width, start) that are found, aligned."""
        out = []
        by_shape: dict[tuple[int, int], list[tuple[int, ...]]] = {}
        for a in asked:
            by_shape.setdefault((min(self.window, len(self.points[a[1]])), a[3]), []).append(a)
        for (size, width), some in by_shape.items():
            k = self._budget(size)[0] if size < self.window else self.edits
            slack = 4 * width
            for at in range(0, len(some), 2000):
                chunk = some[at:at + 2000]
                windows = np.stack([self.points[o][s:s + size] for _, o, _, _, s in chunk])
                regions = np.zeros((len(chunk), size + slack), np.uint32)  # 0 is in no text
                begin = []
                for n, (t, _, low, _, s) in enumerate(chunk):
                    points = waiting[t][2]
                    a = low - width + s - int(begins[t])
                    part = points[max(0, a):max(0, a + size + slack)]
                    regions[n, max(0, -a):max(0, -a) + len(part)] = part
                    begin.append(a)
                cost, end = alignments(windows, regions)
                hit = np.flatnonzero(cost <= k)
                if not len(hit):
                    continue
                back = np.zeros((len(hit), size + slack), np.uint32)
                for j, n in enumerate(hit):
                    part = regions[n, :end[n]][::-1][:size + slack - width]
                    back[j, width:width + len(part)] = part
                long = alignments(windows[hit][:, ::-1], back, fixed=width)[1] - width
                for j, n in enumerate(hit):
                    t, owner, _, _, start = chunk[n]
                    close = begin[n] + int(end[n]) + waiting[t][1]
                    out.append((t, owner, start, close - int(long[j]), close, int(cost[n])))
        return out

    def _exact(self, number: int, waiting) -> list[tuple[int, int, int, int, int, int]]:
        """Places of an item of under two grams, as whole words; an item of under one gram is no passage and has to be the
        whole text."""
        points = self.points[number]
        own = points.tobytes()
        out = []
        for text, offset, part in waiting:
            line, at = part.tobytes(), -1
            while (at := line.find(own, at + 1)) >= 0:
                start, end = at // 4, (at + len(own)) // 4
                around = [chr(int(part[i])) for i in (start - 1, end) if 0 <= i < len(part)]
                if at % 4 or any(map(str.isalnum, around)):
                    continue
                if len(points) < self.q and (offset or (part[:start] != 32).any() or (part[end:] != 32).any()):
                    continue
                out.append((text, number, 0, offset + start, offset + end, 0))
        return out
