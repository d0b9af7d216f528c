"""Pitman-Yor restaurants: exact draws of table counts, Gibbs sweeps over all restaurants of a level at once, and a small hierarchical model.

A dish with c customers at k tables enters the probability of a seating as
S(c, k) * z ** k, S being the generalised Stirling numbers of the discount.
The tables of one restaurant's dishes hang together by the factor
gamma(strength / discount + all tables) alone. A sweep therefore first draws
y, a gamma variable of that shape, for each restaurant; given y, z is
discount * y * (the dish's probability in the parent), dishes are independent,
and the tables of each are drawn exactly from their joint conditional (all
customers of the dish are taken out and seated again together). So a sweep is
a Gibbs sweep, its steps are array operations, and a dish's own old tables
have no part in its draw. The parent is held as a measure drawn from its own
seating, given which the restaurants below it are independent: they may be
seated anywhere, in any order.

Random numbers are hashes of a key (the context and dish) and the step, so a
seating does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .mph import mix

STRENGTH = 1.0
#: Sweeps before the kept ones, kept ones.
BURN_IN, SAMPLES = 3, 3
#: Customers up to which Stirling numbers are tabled; beyond, their saddle point is taken, with an error of a few hundredths in a weight.
TABLED = 1024


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) by the keys (unsigned 64-bit) and a salt."""
    return ((mix(key, salt) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def gamma(shape: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Gamma variables of unit scale by the keys and a salt (Marsaglia and Tsang's rejection)."""
    a = np.where(shape < 1, shape + 1, shape) - 1 / 3
    out, open_, step = a.copy(), np.arange(len(a)), 0
    while len(open_) and step < 64:
        at, k = a[open_], key[open_]
        x = np.sqrt(-2 * np.log(uniform(k, salt + 3 * step))) * np.cos(2 * np.pi * uniform(k, salt + 3 * step + 1))
        v = np.maximum(1 + x / np.sqrt(9 * at), 1e-12) ** 3
        good = (x > -np.sqrt(9 * at)) & (np.log(uniform(k, salt + 3 * step + 2)) < 0.5 * x * x + at - at * v + at * np.log(v))
        out[open_[good]] = (at * v)[good]
        open_, step = open_[~good], step + 1
    return np.where(shape < 1, out * uniform(key, salt + 499) ** (1 / np.minimum(shape, 1)), out)


@cache
def log_stirling(discount: float) -> np.ndarray:
    """log S(c, k) for c and k up to TABLED: S(c+1, k) = S(c, k-1) + (c - discount k) S(c, k)."""
    out = np.full((TABLED + 1, TABLED + 1), -np.inf)
    out[1, 1] = 0.0
    k = np.arange(1, TABLED + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, TABLED):
            stay = np.where(k <= c, np.log(np.maximum(c - discount * k, 1e-300)) + out[c, 1:], -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    shift = np.log(x * (x + 1) * (x + 2))
    x = x + 3
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) - shift


@cache
def _saddle_error(discount: float) -> np.ndarray:
    """What the saddle point misses at TABLED customers, for each k; it follows k / c ** discount."""
    k = np.arange(1.0, TABLED + 1)
    return _saddle(np.full(TABLED, float(TABLED)), k, discount) - log_stirling(discount)[TABLED, 1:]


def log_stirling_large(c: np.ndarray, k: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, k) up to a constant of c, for c beyond TABLED: the saddle point, corrected by its error in the table's last row."""
    error, at = _saddle_error(discount), np.log(k) - discount * (np.log(c) - np.log(TABLED))
    place = np.log(np.arange(1.0, TABLED + 1))
    slope = (error[1] - error[0]) / place[1]
    return _saddle(c, k, discount) - np.interp(at, place, error) - slope * np.minimum(at, 0.0)


def _saddle(c: np.ndarray, k: np.ndarray, discount: float) -> np.ndarray:
    """By the saddle point of (1 - (1-x)^discount)^k / x^(c+1)."""
    lo, hi = np.full(np.broadcast(c, k).shape, -740.0), np.full(np.broadcast(c, k).shape, -1e-12)  # log(1-x)
    for _ in range(52):
        at = (lo + hi) / 2
        slope = np.log(k * discount) + (discount - 1) * at + np.log(-np.expm1(at)) - np.log(-np.expm1(discount * at))
        more = slope > np.log(c)
        lo, hi = np.where(more, at, lo), np.where(more, hi, at)
    at = (lo + hi) / 2
    log_x, inner = np.log(-np.expm1(at)), np.log(-np.expm1(discount * at))
    # x times the derivative of the logarithm of c(x), on the way to the second derivative
    bend = 1 + (1 - discount) * np.exp(log_x - at) - discount * np.exp(log_x + (discount - 1) * at - inner)
    return -_log_factorial(k) - k * np.log(discount) + k * inner - c * log_x - 0.5 * np.log(np.maximum(bend, 1e-12))


def draw_tables(customers: np.ndarray, log_z: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """For each dish a number of tables k, drawn with weight z ** k * S(customers, k) by the uniform number u."""
    tables = np.minimum(customers, 1).astype(np.float64)
    known, low = log_stirling(discount), 1
    while low < TABLED:
        high = min(2 * low, TABLED)
        rows_of = np.nonzero((customers > low) & (customers <= high))[0]
        k = np.arange(1, high + 1)
        for lo in range(0, len(rows_of), max(1, (1 << 20) // high)):
            rows = rows_of[lo : lo + max(1, (1 << 20) // high)]
            w = known[customers[rows].astype(np.int64), 1 : high + 1] + log_z[rows, None] * k
            tables[rows] = _pick(w, u[rows]) + 1
        low = high
    rows_of = np.nonzero(customers > TABLED)[0]
    if len(rows_of):
        c, z = customers[rows_of].astype(np.float64), log_z[rows_of]
        lo, hi = np.full(len(c), -740.0), np.full(len(c), -1e-12)  # the mode: z x (1-x)^(discount-1) = c
        for _ in range(52):
            at = (lo + hi) / 2
            more = z + np.log(-np.expm1(at)) + (discount - 1) * at > np.log(c)
            lo, hi = np.where(more, at, lo), np.where(more, hi, at)
        mode = np.clip(np.exp(np.minimum(z, 700.0)) * -np.expm1(discount * (lo + hi) / 2) / discount, 1, c)
        wide = np.ceil(8 * np.sqrt(mode)).astype(np.int64) + 8
        order = np.argsort(wide, kind="stable")
        at = 0
        while at < len(order):
            n = max(1, (1 << 18) // (2 * int(wide[order[min(at + 255, len(order) - 1)]]) + 1))
            rows = order[at : at + min(n, 256)]
            span = np.arange(2 * int(wide[rows].max()) + 1)
            k = np.maximum(1, np.floor(mode[rows]) - wide[rows].max())[:, None] + span[None, :]
            inside = k <= c[rows][:, None]
            w = np.where(inside, log_stirling_large(c[rows][:, None], np.minimum(k, c[rows][:, None]), discount) + z[rows][:, None] * k, -np.inf)
            tables[rows_of[rows]] = np.take_along_axis(k, _pick(w, u[rows_of[rows]])[:, None], axis=1)[:, 0]
            at += len(rows)
    return tables


def _pick(log_weight: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The column of each row that the uniform number chooses."""
    total = np.cumsum(np.exp(log_weight - log_weight.max(axis=1, keepdims=True)), axis=1)
    return np.minimum((total < (u * total[:, -1])[:, None]).sum(axis=1), log_weight.shape[1] - 1)


def estimated_discount(ones: float, twos: float) -> float:
    """From the numbers of dishes with one and two customers."""
    return round(float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)), 3) if ones else 0.5


class Restaurants:
    """Many restaurants of one level: rows (restaurant, dish) with customers, in the order of their restaurant.

    `key` names each row and `name` each restaurant for random numbers.
    """

    def __init__(self, of: np.ndarray, customers: np.ndarray, key: np.ndarray, name: np.ndarray, discount: float) -> None:
        self.of, self.c, self.key, self.name, self.discount = of, customers.astype(np.float64), key, name, discount
        self.t = np.minimum(self.c, 1.0)
        self.all_c = np.bincount(of, self.c, len(name))
        self.many = np.nonzero(self.c > 1)[0]  # the others have one table each
        self.drawn = np.unique(of[self.many])

    @property
    def all_t(self) -> np.ndarray:
        return np.bincount(self.of, self.t, len(self.name))

    def sweep(self, above: np.ndarray, step: int) -> None:
        """Seats all dishes anew, given the parent's probability of each row's dish."""
        rows, y = self.many, np.ones(len(self.name))
        y[self.drawn] = gamma(STRENGTH / self.discount + self.all_t[self.drawn], self.name[self.drawn], 1000 * step)
        self.t[rows] = draw_tables(self.c[rows], np.log(self.discount * y[self.of[rows]] * above[rows]), self.discount, uniform(self.key[rows], 1000 * step + 999))

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the predictive probability: each row's own part, and what each restaurant leaves to its parent."""
        whole = STRENGTH + self.all_c
        return (self.c - self.discount * self.t) / whole[self.of], (STRENGTH + self.discount * self.all_t) / whole

    def measure(self, above: np.ndarray, step: int) -> np.ndarray:
        """Each row's probability in a measure drawn from the restaurant's seating; what lies beyond the seen dishes is taken at its mean."""
        own = gamma(self.c - self.discount * self.t, self.key, 1000 * step + 500)
        rest = gamma(STRENGTH + self.discount * self.all_t, self.name, 1000 * step + 500)
        whole = np.bincount(self.of, own, len(self.name)) + rest
        return (own + rest[self.of] * above) / whole[self.of]


class PitmanYor:
    """A hierarchical model fitted to keys context * size + symbol, the context being order-1 symbols, oldest first, in base size.

    Every context of every length below the order is a restaurant; each of its
    tables sends one customer to the restaurant of the context without its
    oldest symbol. Predictive probabilities are averaged over the kept sweeps.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, size: int, order: int) -> None:
        self.size, self.order = size, order
        sort = np.argsort(key, kind="stable")
        self.keys, self.parent = [key[sort].astype(np.int64)], []
        for k in range(order - 1, 0, -1):
            up, row = np.unique(self.keys[0] % size**k, return_inverse=True)
            self.keys.insert(0, up)
            self.parent.insert(0, row)
        self.contexts = [np.unique(x // size, return_inverse=True) for x in self.keys]
        self.samples: list[list[tuple[np.ndarray, np.ndarray]]] = []
        customers, levels = count[sort].astype(np.float64), []
        for k in range(order - 1, -1, -1):
            names, of = self.contexts[k]
            d = estimated_discount(float((customers == 1).sum()), float((customers == 2).sum()))
            levels.insert(0, Restaurants(of, customers, mix(self.keys[k], 7 * k + 1), mix(names, 7 * k + 2), d))
            if k:
                customers = np.bincount(self.parent[k - 1], levels[0].t, len(self.keys[k - 1]))
        for step in range(1, BURN_IN + SAMPLES + 1):
            above = [np.full(len(self.keys[0]), 1 / size)]
            for k in range(order - 1):
                above.append(levels[k].measure(above[k], step)[self.parent[k]])
            for k in range(order - 1, -1, -1):
                if k < order - 1:
                    x = levels[k]
                    c = np.bincount(self.parent[k], levels[k + 1].t, len(self.keys[k]))
                    t, levels[k] = np.minimum(x.t, c), Restaurants(x.of, c, x.key, x.name, x.discount)
                    levels[k].t = t
                levels[k].sweep(above[k], step)
            if step > BURN_IN:
                self.samples.append([x.weights() for x in levels])

    def probability(self, key: np.ndarray) -> np.ndarray:
        """Averaged predictive probabilities of keys as in the constructor."""
        out, found = np.zeros(len(key)), []
        for k, (rows, (contexts, _)) in enumerate(zip(self.keys, self.contexts, strict=True)):
            own = key % self.size ** (k + 1)
            row, at = np.searchsorted(rows, own), np.searchsorted(contexts, own // self.size)
            row, at = np.minimum(row, len(rows) - 1), np.minimum(at, len(contexts) - 1)
            found.append((row, rows[row] == own, at, contexts[at] == own // self.size))
        for sample in self.samples:
            p = np.full(len(key), 1 / self.size)
            for (own, left), (row, hit, at, open_) in zip(sample, found, strict=True):
                p = np.where(open_, left[at] * p + np.where(hit, own[row], 0.0), p)
            out += p
        return out / len(self.samples)
