"""Adaptive context-mixing range coder for token ids.

A block is cut into lanes of equal length that are coded in step, one symbol of every lane at a time, all against one
model that learns from every lane. The model starts empty in each block, so blocks stand alone. For a symbol,

- order 2 (the two ids before it, hashed) predicts one id, with a confidence, and names it once that was right before. How
  often it is right at its confidence, and at the probability that order 1 gives the same id, is counted, and an
  online-trained mixer turns both into the probability that it is right;
- otherwise order 1 (the id before it) gives a distribution over all ids seen after that id: their counts, mixed with
  those of order 0, without the id that order 2 has named, and with room for an id not seen there (half a count for each
  one seen);
- such an id is coded by order 0, the adaptive frequencies of such ids.

Order 2 and the mixer learn at every step, the distributions are made anew at steps that grow apart. All of it is integer
arithmetic or single float additions, products and quotients in fixed order, so that any machine decodes what another
has encoded.

A lane's range is a whole number of 36 to 52 bits and moves 16 at a time, by words; ranges, lower ends and codes are doubles,
which hold such numbers exactly and which processors divide many at a time. The lower end is never cut: what goes beyond a
word is added to the words before it at the end. The words of all lanes stand in the order in which decoding takes them.
"""

from __future__ import annotations

import numpy as np

FLAG_BITS = 14
ZERO_BITS = 18
_TWO_BITS = 18
_SLOT_BITS = 20
_COUNT = 32  # weight of one occurrence after the same id
_PRIOR = 512  # weight of order 0's distribution in that of order 1
_MOST = 1 << 15  # occurrences from which on an id's successors are scaled down
_START = float(1 << 48)
_BOT = float(1 << 36)
_WORD = float(1 << 16)
_LINE = float(1 << 32)
_STATES = np.arange(64)
_SURE, _NEAR = _STATES & 7, _STATES >> 3
# by 1/256 of probability: 0 for none, then a step up at each of these
_LEVEL = np.searchsorted(np.array([1, 3, 8, 20, 50, 110, 180]), np.arange(257), side="right")
_RATE = 0.5


def _stretch(p: np.ndarray) -> np.ndarray:
    y = 2 * p - 1
    return y / (1 - np.abs(y))


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * x / (1 + np.abs(x))


def _take(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table.take(at, mode="clip")  # no bounds check of its own; all places are in range


def _sum(x: np.ndarray) -> float:
    return float(np.cumsum(x)[-1])  # in order, whatever the machine's vector width


class Model:
    """Predictions of the three orders for one block."""

    def __init__(self, alphabet: int, steps: int):
        self.alphabet, self.steps = alphabet, steps
        # the narrowest kind that holds a pair of ids: half the memory to look through
        self.kind = np.uint32 if alphabet * (alphabet + 2) < 1 << 32 else np.uint64
        self.hash = self.kind(0x9E3779B1 if self.kind is np.uint32 else 0x9E3779B97F4A7C15)
        self.hash_shift = self.kind(8 * np.dtype(self.kind).itemsize - _SLOT_BITS)
        self.radix = self.kind(alphabet)
        self.two = np.full(1 << _TWO_BITS, alphabet << 3, np.int32)  # predicted id << 3 | confidence, 0 for nothing yet
        self.right = np.ones((2, 8), np.int64)  # by confidence, and by what order 1 says
        self.tried = np.full((2, 8), 2, np.int64)
        self.weights = np.array([0.0, 0.7, 0.3])
        self.seen = np.zeros(128, np.int64)
        self.keys = np.zeros(0, self.kind)  # id * alphabet + next id, ascending, with the times it was seen
        self.times = np.zeros(0, np.int64)
        self.table = np.zeros(1 << _SLOT_BITS, np.int32)  # place of a key among all, by its hash
        self.met: list[np.ndarray] = []  # places of what was seen since, and the keys that were not found
        self.fresh: list[np.ndarray] = []
        self.escaped: list[np.ndarray] = []
        self.counts = np.zeros(alphabet, np.int64)
        self.step = 0
        self._order0()
        self._order1()
        self._mix()

    def _order0(self) -> None:
        for ids in self.escaped:
            self.counts += np.bincount(ids, minlength=self.alphabet)
        self.escaped.clear()
        free = (1 << ZERO_BITS) - self.alphabet
        total = max(1, int(self.counts.sum()))
        freq = self.counts * free // total + 1
        freq[int(np.argmax(freq))] += (1 << ZERO_BITS) - int(freq.sum())
        self.freq0 = freq.astype(np.float64)
        self.cum0 = (np.cumsum(freq) - freq).astype(np.float64)
        self.slots: np.ndarray | None = None

    def symbol_of(self, slot: np.ndarray) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(self.alphabet), self.freq0.astype(np.int64))
        return _take(self.slots, slot)

    def _order1(self) -> None:
        if self.met:
            self.times += np.bincount(np.concatenate(self.met), minlength=len(self.keys) + 1)[:-1]
            keys, times = np.unique(np.concatenate(self.fresh), return_counts=True)
            self.met.clear()
            self.fresh.clear()
            at = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), np.bool_)
            if len(self.keys):
                known = _take(self.keys, at) == keys
            self.times[at[known]] += times[known]
            self.times = np.insert(self.times, at[~known], times[~known])
            self.keys = np.insert(self.keys, at[~known], keys[~known])
        keys, times, size = self.keys, self.times, len(self.keys)
        after = keys // self.radix
        self.symbols = (keys - after * self.radix).astype(np.int32)
        after = after.astype(np.int64)
        several = np.bincount(after, minlength=self.alphabet + 1)
        ends = np.concatenate([[0], np.cumsum(times)])
        first = np.cumsum(several) - several
        scale = np.maximum(ends[first + several] - ends[first], _MOST)
        alone = np.bincount(self.symbols, weights=times, minlength=self.alphabet).astype(np.int64)  # whole numbers
        freq = _COUNT * times - _COUNT // 2
        hot = scale > _MOST
        if hot.any():
            some = np.flatnonzero(hot[after])
            freq[some] = freq[some] * _MOST // scale[after[some]]
        freq += (_PRIOR * alone // max(1, int(ends[-1])) + 1)[self.symbols]
        cum = np.concatenate([[0], np.cumsum(freq)])
        narrow = np.int32 if cum[-1] < 1 << 30 else np.int64
        self.cum = cum.astype(narrow)
        self.freq = np.append(freq, 0).astype(narrow)
        base = cum[first]
        self.base = base.astype(narrow)
        self.shift, self.guide = max(0, (int(cum[-1]) // max(1, size)).bit_length() - 2), None
        unseen = np.maximum(several * (_COUNT // 2) * _MOST // scale, 1)
        self.unseen = unseen.astype(narrow)
        self.total = (cum[first + several] - base + unseen).astype(narrow)  # below 1 << 21
        self.known = np.append(keys, np.iinfo(self.kind).max).astype(self.kind)
        slot = self._slot(keys)  # those of earlier keys are among them, so nothing is left of earlier places
        self.table[slot] = np.arange(size, dtype=np.int32)
        for least in (4, 32):  # of keys that share a slot the frequent one is found; the other counts as not seen
            some = np.flatnonzero(times >= least)
            self.table[slot[some]] = some

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.hash >> self.hash_shift).astype(np.int64)

    def pairs(self, last: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return last.astype(self.kind) * self.radix + ids.astype(self.kind)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Where pairs of ids stand among all that were seen; the number of all for those that don't."""
        at = _take(self.table, self._slot(keys)).astype(np.int64)
        return np.where(_take(self.known, at) == keys, at, len(self.keys))

    def holding(self, sums: np.ndarray) -> np.ndarray:
        """The place whose part of all frequencies holds each of ``sums``."""
        if self.guide is None:
            # for every multiple of a power of two near the mean frequency, the number of sums up to it: where a search begins
            self.guide = np.cumsum(np.bincount((self.cum + ((1 << self.shift) - 1)) >> self.shift), dtype=np.int32)
        at = _take(self.guide, sums >> self.shift).astype(np.int64)
        left = np.flatnonzero(_take(self.cum, at) <= sums)
        for _ in range(3):  # nearly all are found here, the others among all sums
            at[left] += 1
            left = left[_take(self.cum, at[left]) <= sums[left]]
        if len(left):
            at[left] = np.searchsorted(self.cum, sums[left], side="right")
        return at - 1

    def _mix(self) -> None:
        known = _stretch(self.right / self.tried)
        self.in2, self.in1 = known[0][_SURE], known[1][_NEAR]
        a = self.weights
        self.p2 = _squash(a[0] + a[1] * self.in2 + a[2] * self.in1)
        top = 1 << FLAG_BITS
        f2 = np.where(_SURE > 0, np.clip((self.p2 * top).astype(np.int64), 1, top - 1), 0)
        self.flag = np.stack([f2, top - f2], axis=1).ravel().astype(np.float64)
        self.edge = f2.astype(np.float64)

    def _learn(self) -> None:
        n = self.seen.reshape(64, 2)
        total = n.sum(axis=1)
        cube = n.reshape(8, 8, 2)  # what order 1 says, confidence, outcome
        for row, axis in ((0, 0), (1, 1)):
            self.right[row] += cube[:, 1:, 0].sum(axis=1) if axis else cube[..., 0].sum(axis=0)
            self.tried[row] += cube[:, 1:].sum(axis=(1, 2)) if axis else cube.sum(axis=(0, 2))
        self.right[0, 0], self.tried[0, 0] = 1, 2
        if int(self.tried.max()) > 1 << 16:
            self.right, self.tried = self.right // 2 + 1, self.tried // 2 + 2
        off = np.where(_SURE > 0, n[:, 0] - total * self.p2, 0.0)
        rate = _RATE / max(1, int(total.sum()))
        for i, x in enumerate((1.0, self.in2, self.in1)):
            self.weights[i] += rate * _sum(off * x)
        self.seen[:] = 0
        self._mix()

    def look(self, before: np.ndarray, last: np.ndarray):
        """What order 2 says about the next symbol of every lane."""
        at = before.astype(np.uint32) * np.uint32(0x9E3779B1) + last.astype(np.uint32) * np.uint32(0x85EBCA6B)
        at = (at >> np.uint32(32 - _TWO_BITS)).astype(np.int64)
        e2 = _take(self.two, at)
        return at, e2, e2 >> 3, e2 & 7

    def named(self, last: np.ndarray, c2: np.ndarray, sure2: np.ndarray):
        """What order 1 says about the ids that order 2 names, and the mixer's state for both."""
        place2 = self.place(self.pairs(last, c2))
        freq2 = _take(self.freq, place2)
        state = _take(_LEVEL, (freq2 * 256.0 / _take(self.total, last)).astype(np.int64))
        state <<= 3
        state += sure2
        return place2, freq2, state

    def learn(self, last, at, e2, sure2, right, x, place, outcome_at) -> None:
        # up by one when right (7 at most), down by one when wrong, replaced when there was little trust
        self.two[at] = np.where(right, e2 + (sure2 < 7), np.where(sure2 > 1, e2 - 1, (x << 3) + 1))
        self.seen += np.bincount(outcome_at, minlength=128)
        new = np.flatnonzero(place == len(self.keys))
        self.met.append(place)
        self.fresh.append(self.pairs(last.take(new), x.take(new)))
        self.step += 1
        if self.step == self.steps:
            return  # nothing is left to predict
        if self.step < 8 or self.step % 8 == 0:
            self._learn()
        if self.step & (self.step - 1) == 0 or self.step % 64 == 0:
            self._order0()
            self._order1()


def _layout(n: int, lanes: int) -> tuple[int, int]:
    """Steps, and lanes with a symbol in the last step; the first lanes are the full ones."""
    steps = -(-n // lanes)
    return steps, n - (steps - 1) * lanes


def _others(k: int, named: np.ndarray, hit: np.ndarray, freq: np.ndarray, place: np.ndarray):
    """Of ``k`` lanes those without a hit, the frequency and place that order 1 gives to what order 2 has named there, and
    such places of all lanes."""
    missed = np.ones(k, np.bool_)
    missed[named] = ~hit
    gone, where = np.zeros(k, freq.dtype), np.zeros(k, place.dtype)
    gone[named], where[named] = freq, place
    i = np.flatnonzero(missed)
    return i, gone.take(i), where.take(i), where


def lanes_for(n: int, most: int = 8192) -> int:
    return max(1, min(most, n // 64))


def _stream(words: list[np.ndarray], owners: list[np.ndarray], lanes: int) -> np.ndarray:
    """The words as decoding takes them, from those that encoding has moved out (the last three of each lane at the end):
    three of each lane to begin with, then for every word moved out its lane's third next."""
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    sums = np.concatenate(words).take(order)  # lane after lane
    while (extra := sums >> 16).any():
        sums &= 0xFFFF
        sums[:-1] += extra[1:]  # a lane's first word never goes beyond
    ends = np.cumsum(np.bincount(owner, minlength=lanes))
    starts = np.concatenate([[0], ends[:-1]])
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(3, len(order) + 3)
    return sums.astype(np.uint16).take(np.concatenate([starts, starts + 1, starts + 2, at[:len(at) - 3 * lanes]]))


def encode(ids: np.ndarray, alphabet: int, lanes: int) -> tuple[np.ndarray, int]:
    """(16-bit words, lanes)."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint16), lanes
    steps, full = _layout(n, lanes)
    source = np.zeros((steps, lanes), np.int32)  # a row for each step
    whole, shorter = ids[:full * steps].reshape(full, steps), ids[full * steps:].reshape(lanes - full, steps - 1)
    for a in range(0, lanes, 64):  # few lanes at a time stay in the processor's cache
        some = whole[a:a + 64]
        source[:, a:a + len(some)] = some.T
        some = shorter[a:a + 64]
        source[:steps - 1, full + a:full + a + len(some)] = some.T
    model = Model(alphabet, steps)
    low, rng = np.zeros(lanes), np.full(lanes, _START)
    before, last = np.full(lanes, alphabet), np.full(lanes, alphabet)
    words: list[np.ndarray] = []
    owners: list[np.ndarray] = []

    def settle(i):
        """Moves a word out of the lanes ``i`` and of those that need it again."""
        while len(i):
            a, r = low.take(i), rng.take(i)
            word = np.floor(a * (1 / _LINE))
            words.append(word.astype(np.uint32))
            owners.append(i.astype(np.uint16))
            a -= word * _LINE
            a *= _WORD
            r *= _WORD
            low[i], rng[i] = a, r
            i = i[r < _BOT]

    for t in range(steps):
        k = lanes if t < steps - 1 else full
        x, now = source[t, :k], last[:k]
        at, e2, c2, sure2 = model.look(before[:k], now)
        right = c2 == x
        j = np.flatnonzero(sure2 > 1)
        place2, freq2, state = model.named(now.take(j), c2.take(j), sure2.take(j))
        hit2 = right.take(j)
        spot = state * 2 + ~hit2
        part = np.floor(rng.take(j) * (1 / (1 << FLAG_BITS)))
        low[j] += np.where(hit2, 0.0, part * _take(model.edge, state))
        rng[j] = part * _take(model.flag, spot)
        i, gone, place2, place = _others(k, j, hit2, freq2, place2)
        j = i[:0]
        if len(i):
            ctx = now.take(i)
            own = place[i] = model.place(model.pairs(ctx, x.take(i)))
            total = _take(model.total, ctx) - gone
            gone *= own > place2
            begin, size = _take(model.cum, own) - _take(model.base, ctx) - gone, _take(model.freq, own)
            new = np.flatnonzero(own == len(model.keys))
            size[new] = _take(model.unseen, ctx.take(new))
            begin[new] = total.take(new) - size.take(new)
            part = np.floor(rng.take(i) / total)
            low[i] += part * begin
            rng[i] = part * size
            j = i.take(new)
        settle(np.flatnonzero(rng[:k] < _BOT))
        if len(j):
            xs = x.take(j)
            part = np.floor(rng.take(j) * (1 / (1 << ZERO_BITS)))
            low[j] += part * _take(model.cum0, xs)
            rng[j] = part * _take(model.freq0, xs)
            settle(j[rng.take(j) < _BOT])
            model.escaped.append(xs)
        model.learn(now, at, e2, sure2, right, x, place, spot)
        before[:k] = now
        last[:k] = x
    every = np.arange(lanes, dtype=np.uint16)
    # one word names a number within what is left, zeros follow
    words += [np.ceil(low * (1 / _LINE)).astype(np.uint32), np.zeros(2 * lanes, np.uint32)]
    owners += [every, every, every]
    return _stream(words, owners, lanes), lanes


def decode(words: np.ndarray, lanes: int, n: int, alphabet: int) -> np.ndarray:
    """The ids that ``encode`` was given."""
    if n == 0:
        return np.zeros(0, np.int64)
    steps, full = _layout(n, lanes)
    model = Model(alphabet, steps)
    rng, code = np.full(lanes, _START), np.zeros(lanes)
    taken = 0

    def settle(i):
        nonlocal taken
        while len(i):
            r = rng.take(i)
            r *= _WORD
            rng[i] = r
            code[i] = code.take(i) * _WORD + words[taken:taken + len(i)]
            taken += len(i)
            i = i[r < _BOT]

    for _ in range(3):
        code = code * _WORD + words[taken:taken + lanes]
        taken += lanes
    before, last = np.full(lanes, alphabet), np.full(lanes, alphabet)
    out = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        k = lanes if t < steps - 1 else full
        now = last[:k]
        at, e2, c2, sure2 = model.look(before[:k], now)
        j = np.flatnonzero(sure2 > 1)
        place2, freq2, state = model.named(now.take(j), c2.take(j), sure2.take(j))
        part = np.floor(rng.take(j) * (1 / (1 << FLAG_BITS)))
        edge = part * _take(model.edge, state)
        c = code.take(j)
        hit2 = c < edge
        spot = state * 2 + ~hit2
        code[j] = c - np.where(hit2, 0.0, edge)
        rng[j] = part * _take(model.flag, spot)
        x = c2.copy()
        i, gone, place2, place = _others(k, j, hit2, freq2, place2)
        j = i[:0]
        if len(i):
            ctx = now.take(i)
            total, unseen, base = _take(model.total, ctx) - gone, _take(model.unseen, ctx), _take(model.base, ctx)
            part = np.floor(rng.take(i) / total)
            c = code.take(i)
            spent = np.floor(c / part)
            spent -= spent * part > c  # a quotient may be rounded up to a whole number
            spent = np.minimum(spent, total - 1).astype(total.dtype)
            new = np.flatnonzero(spent >= total - unseen)
            at_most = spent + base
            at_most += gone * (at_most >= _take(model.cum, place2))
            own = model.holding(at_most)
            own[new] = len(model.keys)
            place[i] = own
            gone *= own > place2
            begin, size = _take(model.cum, own) - base - gone, _take(model.freq, own)
            size[new] = unseen.take(new)
            begin[new] = total.take(new) - size.take(new)
            code[i] = c - part * begin
            rng[i] = part * size
            x[i] = _take(model.symbols, own) if len(model.symbols) else 0
            j = i.take(new)
        settle(np.flatnonzero(rng[:k] < _BOT))
        if len(j):
            part = np.floor(rng.take(j) * (1 / (1 << ZERO_BITS)))
            c = code.take(j)
            slot = np.floor(c / part)
            slot -= slot * part > c
            met = model.symbol_of(np.minimum(slot, (1 << ZERO_BITS) - 1).astype(np.int64))
            code[j] = c - part * _take(model.cum0, met)
            rng[j] = part * _take(model.freq0, met)
            settle(j[rng.take(j) < _BOT])
            x[j] = met
            model.escaped.append(met)
        model.learn(now, at, e2, sure2, c2 == x, x, place, spot)
        out[t, :k] = x
        before[:k] = now
        last[:k] = x
    ids = out.T.ravel()
    if full < lanes:  # the other lanes are one shorter
        ids = np.concatenate([ids[:full * steps], out[:steps - 1, full:].T.ravel()])
    return ids
