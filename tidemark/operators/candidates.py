"""The rows of a bank that can be among the k nearest of a state, whatever the portfolio's part of it is.

The last two dimensions of a state, side and unrealised gain, follow from the fold's own decisions; all others are known
beforehand. For each side the k-th distance is bounded from above, and every row that could be nearer for some gain within the clip is a
candidate. So the search over the whole bank needs no order of ticks and runs in parallel; the fold compares the candidates alone, exactly.

Successive ticks share most dimensions, as slow paces seldom change: the distance over those is made once for a run of ticks,
and only rows that it leaves in question are compared over the others.
"""

from __future__ import annotations

import numpy as np

TICKS = 512  # whose candidates are sought at once
RUNS = 96  # of ticks whose shared distances are held at once
LONGEST = 64  # ticks of a run
PILOT = 0.01  # share of the bank, the nearest over the shared dimensions, that gives the bounds
CELLS = 256  # of rows alike in the changing dimensions
SLACK = 1e-5  # of the norms: more than float32 can err


def _cells(x: np.ndarray, cells: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Centres, and the cell of each row: that of a centre near it."""
    rng = np.random.default_rng(0)
    sample = x[rng.choice(len(x), min(len(x), 32 * cells), replace=False)]
    c = sample[: min(len(sample), cells)].copy()
    near = lambda y: ((c**2).sum(1) - 2 * (y @ c.T)).argmin(1)
    for _ in range(rounds):
        at = near(sample)
        for j in np.unique(at):
            c[j] = sample[at == j].mean(0)
    return c, np.concatenate([near(y) for y in np.array_split(x, 1 + len(x) // 8192)])


def _where(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask whose length is a multiple of 8, by words of it, as few hold any."""
    words = np.flatnonzero(mask.view(np.uint64) != 0)
    at = np.flatnonzero(mask.reshape(-1, 8).take(words, axis=0))
    return (words.take(at >> 3) << 3) + (at & 7)


class _Part:
    """A bank apart by dimensions that change within a run and those that don't, ordered by cells of the changing ones.

    Either part of a row has its norm as a further dimension; rows without end fill up the last word.
    """

    def __init__(self, x: np.ndarray, changing: np.ndarray, least: np.ndarray, most: np.ndarray):
        own = x[:, changing]
        self.changing, fill = changing, -len(x) % 8
        self.centres, cell = _cells(own, CELLS) if changing.any() else (own[:1], np.zeros(len(x), dtype=np.int64))
        self.order = np.argsort(cell, kind="stable")
        self.counts = np.bincount(cell, minlength=len(self.centres))
        self.radius = np.zeros(len(self.centres))
        np.maximum.at(self.radius, cell, np.sqrt(((own.astype(np.float64) - self.centres[cell]) ** 2).sum(1)))
        self.counts[-1] += fill
        with_norm = lambda y, rest: np.concatenate([np.concatenate([y, (y**2).sum(1)[:, None]], axis=1), np.full((fill, y.shape[1] + 1), [*[0.0] * y.shape[1], rest], dtype=np.float32)])
        self.own = with_norm(own[self.order], 0.0)
        self.rest = np.ascontiguousarray(with_norm(x[self.order][:, ~changing], np.inf).T)
        self.least, self.most = (np.take(m, self.order, axis=1) for m in (least, most))

    def away(self, market: np.ndarray) -> np.ndarray:
        """Tick x cell: the least squared distance over the changing dimensions."""
        y, c = market[:, self.changing].astype(np.float64), self.centres.astype(np.float64)
        d = np.sqrt(np.maximum((y**2).sum(1)[:, None] + (c**2).sum(1) - 2 * (y @ c.T), 0))
        return np.maximum(d - self.radius - 1e-6 * (1 + d), 0) ** 2


class Candidates:
    def __init__(self, states: np.ndarray, k: int, clip: float):
        self.k, self.n, self.dims = k, len(states), states.shape[1] - 2
        self.x = states[:, :-2].astype(np.float32)
        side, gain = states[:, -2].astype(np.float64), np.abs(states[:, -1].astype(np.float64))
        clip *= 1 + 1e-6  # states are float32
        # what the portfolio adds to the squared distance, by side: at least and at most; a flat one has no gain
        self.least = np.stack([(side - s) ** 2 + (np.maximum(gain - clip, 0) ** 2 if s else gain**2) for s in (-1, 0, 1)]).astype(np.float32)
        self.most = np.stack([(side - s) ** 2 + ((gain + clip) ** 2 if s else gain**2) for s in (-1, 0, 1)]).astype(np.float32)
        self.top = float((states.astype(np.float64) ** 2).sum(1).max()) if self.n else 0.0
        self.room = np.empty((0, 0), dtype=np.float32)
        self.parts: list[_Part] = []

    def _part(self, changing: np.ndarray) -> _Part:
        """The bank apart by these dimensions; a known part with more changing ones also serves."""
        for p in self.parts:
            if not (changing & ~p.changing).any() and (changing.any() or not p.changing.any()):
                return p
        self.parts = [_Part(self.x, changing, self.least, self.most), *self.parts][:2]
        return self.parts[0]

    def runs(self, market: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """First and last tick of runs in which at most a third of the dimensions change, and which."""
        out, lo, mask = [], 0, np.zeros(self.dims, dtype=bool)
        for i in range(1, len(market) + 1):
            new = mask | (market[i] != market[lo]) if i < len(market) else None
            if new is None or i - lo >= LONGEST or 3 * new.sum() > self.dims:
                out.append((lo, i, mask))
                lo, mask = i, np.zeros(self.dims, dtype=bool)
            else:
                mask = new
        return out

    def of(self, market: np.ndarray) -> list[np.ndarray]:
        """For each row of ``market`` (all dimensions but the portfolio's, finite) the candidates, in order of the bank."""
        market = np.asarray(market, dtype=np.float32)
        if self.n <= 4 * self.k:
            return [np.arange(self.n)] * len(market)
        found: list = [np.arange(self.n)] * len(market)
        runs = self.runs(market)
        most = max((r[2] for r in runs), key=lambda m: m.sum())
        parts = [self._part(most if not (mask & ~most).any() else mask) for _, _, mask in runs]
        while runs:
            same = [i for i, p in enumerate(parts) if p is parts[0]][:RUNS]
            self._search([runs[i] for i in same], parts[0], market, found)
            left = sorted({*range(len(runs))} - {*same})
            runs, parts = [runs[i] for i in left], [parts[i] for i in left]
        return found

    def _search(self, runs: list, part: _Part, market: np.ndarray, found: list) -> None:
        one = lambda y: np.concatenate([-2 * y, np.ones((len(y), 1), dtype=np.float32)], axis=1)
        base = market[[lo for lo, _, _ in runs]][:, ~part.changing]
        if len(self.room) < len(runs):
            self.room = np.empty((len(runs), part.rest.shape[1]), dtype=np.float32)  # kept: fresh pages cost as much as the product
        # run x row: squared distance over the shared dimensions, less the run's own norm
        shared = np.matmul(one(base), part.rest, out=self.room[: len(runs)])
        few = max(self.k, int(PILOT * self.n))
        step = max(1, self.n // 4096)
        for (lo, hi, _), norm, s in zip(runs, (base**2).sum(1), shared):
            y = market[lo:hi][:, part.changing]
            square, to = (y**2).sum(1) + norm, one(y)
            slack = np.float32(SLACK * (self.top + float((market[lo:hi].astype(np.float64) ** 2).sum(1).max()) + 10))
            some = s[: self.n : step]
            at = min(len(some) - 1, few // step + 1)
            pilot = _where(s <= np.partition(some, at)[at])
            if len(pilot) < self.k:
                pilot = np.argpartition(s, few - 1)[:few]
            bound = self._bound(self._over(part, pilot, s, to), pilot, part) + slack  # side x tick
            limit = ((bound + square).max(0)[:, None] - part.away(market[lo:hi])).max(0) - norm + slack
            rows = _where(s <= np.repeat(limit.astype(np.float32), part.counts))
            e = self._over(part, rows, s, to)
            at, tick = np.divmod(np.flatnonzero(e <= bound.max(0) + slack), hi - lo)
            value, row = e[at, tick], rows[at]
            keep = np.zeros(len(at), dtype=bool)
            for least, b in zip(part.least, bound):
                keep |= value + least[row] <= b[tick] + slack
            row, tick = part.order[row[keep]], tick[keep]
            order = np.lexsort((row, tick))
            row, tick = row[order], tick[order]
            ends = [0, *np.searchsorted(tick, np.arange(1, hi - lo)).tolist(), len(row)]
            for i in range(hi - lo):
                found[lo + i] = row[ends[i] : ends[i + 1]]

    @staticmethod
    def _over(part: _Part, rows: np.ndarray, s: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Row x tick: the squared distance, less the tick's norm."""
        e = part.own.take(rows, axis=0) @ to.T
        e += s.take(rows)[:, None]
        return e

    def _bound(self, e: np.ndarray, rows: np.ndarray, part: _Part) -> np.ndarray:
        """Side x tick: what the k-th distance can't exceed, by some rows of the bank."""
        d = np.ascontiguousarray(e.T)
        rows = np.broadcast_to(rows, d.shape)
        if d.shape[1] > 16 * self.k:  # the nearest of these bound it about as well for each side
            first = np.argpartition(d, 8 * self.k - 1, axis=1)[:, : 8 * self.k]
            d, rows = np.take_along_axis(d, first, 1), np.take_along_axis(rows, first, 1)
        return np.stack([np.partition(d + m.take(rows), self.k - 1, axis=1)[:, self.k - 1] for m in part.most])
