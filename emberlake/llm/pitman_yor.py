"""A hierarchical Pitman-Yor language model: Chinese-restaurant seating by Gibbs sampling, predictive probabilities averaged over samples.

A word is a dish. Each preceding word is a context and has a restaurant of its own, however many there
are; all of them share a parent, the root, whose base is uniform. A cell is a dish in a restaurant. Its
customers are the training tokens; each of its tables is a customer of the dish in the root. A
customer sits at a table with odds of its size less the discount, at a new one with odds of strength
and discounted tables of the restaurant times the parent's probability of the dish. A Gibbs step takes
all customers of a cell from their tables and seats them again at once, given all other cells: only
how many tables they take matters to anything else, and that is one draw, whose odds have generalised
Stirling numbers in them. So a cell costs by its tables, not by its customers.

Cells are dealt to slices by dish, so a dish's root and all its cells are together; a restaurant's
tables are summed over slices after each sweep, and come back to the slices that serve in it. Within a
sweep a cell sees other cells as the sweep before left them. Draws are
hashes of dish and context, so results depend neither on slices nor on how often a task runs.
A cell with one customer has one table whatever is drawn, so sweeps visit only the others.
"""
from __future__ import annotations

import hashlib
from functools import cache, partial
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, chunks, column_of, dealt, grouped, lean, mix, pack, runs, squeezed, unpack, unsqueezed, words
from .workspace import Workspace, slices_by_size

DISCOUNT, STRENGTH = (0.6, 0.8), (20.0, 2.0)  # of the root and of the contexts
BURN_IN, SAMPLES = 2, 2
STEPPED = 1024  # customers up to which Stirling numbers come from their recurrence
LOSS = 20.0  # larger cells' come from a sum of alternating terms, where the log of what these lose to each other is bounded so, else from the recurrence too
AT_ONCE = 1 << 20  # numbers of tables whose odds are held at once
HELD_OUT_OF = 10
CHUNK = 1 << 20  # bytes of text that are tokenised at once
TOGETHER = 1 << 21  # tokens that a task gathers before it deals them out
END = U(0x454E44)  # the dish of a text's end
BEGIN = U(0)  # the context at a text's beginning
CONTEXT_BITS = 40  # of a preceding word's hash
FEWER = 8  # slices of dishes to one of contexts


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, dish and context of each token: every word, then one end for each text. The first token's context is that of a text's beginning."""
    _, _, doc, h = words(data, offs)
    rows = len(offs) - 1
    count = np.bincount(doc, minlength=rows)
    n = len(h) + rows
    word = np.ones(n, bool)
    word[np.cumsum(count + 1) - 1] = False  # where each text's end stands
    dish = np.full(n, END, U)
    dish[word] = h
    context = np.full(n, BEGIN, U)
    context[np.flatnonzero(word) + 1] = h >> U(64 - CONTEXT_BITS)  # a word is always followed by a token of its text
    return np.repeat(np.arange(rows), count + 1), dish, context


def _narrow(a: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _split(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return context.astype(np.uint32), (context >> U(32)).astype(np.uint8)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U) | (high.astype(U) << U(32))


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _order(dish: np.ndarray, context: np.ndarray) -> np.ndarray:
    """By dish, then by context: two sorts of one word each."""
    first = np.argsort(dish)
    rank = np.zeros(len(dish), U)
    rank[1:] = np.cumsum(dish[first][1:] != dish[first][:-1])
    if len(rank) and int(rank[-1]) >> (64 - CONTEXT_BITS):
        return np.lexsort((context, dish))
    return first[np.argsort((rank << U(CONTEXT_BITS)) | context[first])]


def _dealt_out(dish, context, third, p: int, extra=()):
    """Sorted tokens or cells by slice: runs of dishes, contexts, and a third column."""
    order, cuts = dealt((dish % U(p)).astype(np.int64), p)
    dish, context, third = dish[order], context[order], third[order]
    some = np.flatnonzero(np.diff(cuts))
    blobs = []
    for a, b in zip(cuts[some].tolist(), cuts[some + 1].tolist(), strict=True):
        r = runs(dish[a:b])
        blobs.append(pack(dish[a:b][r[:-1]], _narrow(np.diff(r)), *_split(context[a:b]), _narrow(third[a:b]), *extra))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], ["slice", "blob"])


def _by_cell(dish, context, of, p: int):
    """Tokens by slice and cell, so that a cell travels once: runs of dishes, their cells' contexts and numbers of tokens, and the tokens' texts in order."""
    order = _order(dish, context)
    dish, context, of = dish[order], context[order], of[order]
    order, cuts = dealt((dish % U(p)).astype(np.int64), p)
    dish, context, of = dish[order], context[order], of[order]
    some, blobs = np.flatnonzero(np.diff(cuts)), []
    for a, b in zip(cuts[some].tolist(), cuts[some + 1].tolist(), strict=True):
        at = _fresh(dish[a:b], context[a:b])
        r = runs(dish[a:b][at])
        blobs.append(squeezed(pack(dish[a:b][at][r[:-1]], _narrow(np.diff(r)), *_split(context[a:b][at]), _narrow(np.diff(at, append=b - a)), _narrow(of[a:b]))))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], ["slice", "blob"])


def _gathered(batches, *extra: str):
    """Tokens of many texts: text number, dish, context; and the texts' columns `extra`, a slice of each batch for each."""
    held, size, rows, columns = [], 0, 0, []
    for batch in batches:
        for at, n, data, offs in chunks(batch, most=CHUNK):
            of, dish, context = tokens(data, offs)
            held.append((of + rows, dish, context))
            columns.append([column_of(batch, c).slice(at, n) for c in extra])
            size, rows = size + len(dish), rows + n
            if size >= TOGETHER:
                yield (*map(np.concatenate, zip(*held, strict=True)), *map(pa.concat_arrays, zip(*columns, strict=True)))
                held, size, rows, columns = [], 0, 0, []
    if held:
        yield (*map(np.concatenate, zip(*held, strict=True)), *map(pa.concat_arrays, zip(*columns, strict=True)))


@lean
def _counts(batches, p: int):
    """Cells: each dish in each of its contexts, and how often in training texts; 0, where only others hold it."""
    for of, dish, context, held_out in _gathered(batches, "held_out"):
        order = _order(dish, context)
        dish, context, train = dish[order], context[order], ~held_out.to_numpy(zero_copy_only=False)[of][order]
        at = _fresh(dish, context)
        count = np.add.reduceat(train.astype(np.int64), at) if len(at) else at
        yield _dealt_out(dish[at], context[at], count, p)


ASKED = "slice int, batch binary, kind int, blob binary"


@lean
def _asked(batches, p: int):
    """Every token's dish, context and text, by batches of texts (kind 0); and the batch's texts (kind 1)."""
    for of, dish, context, ids, held_out, print_ in _gathered(batches, "doc_id", "held_out", "print"):
        texts = pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), held_out.to_numpy(zero_copy_only=False).astype(np.uint8))
        name = hashlib.blake2b(texts + print_.to_numpy().tobytes(), digest_size=16).digest()
        made = _by_cell(dish, context, of, p)
        n = made.num_rows
        yield pa.RecordBatch.from_arrays([made.column(0), pa.array([name] * n, pa.binary()), pa.array([0] * n, pa.int32()), made.column(1)], ["slice", "batch", "kind", "blob"])
        yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(name[:4], "little") % p], pa.int32()), pa.array([name], pa.binary()), pa.array([1], pa.int32()), pa.array([texts], pa.binary())], ["slice", "batch", "kind", "blob"])


def _cells(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All cells of a slice, each once, in order: dish, context, count."""
    parts = [unpack(b) for b in blobs]
    dish = np.concatenate([np.zeros(0, U), *[np.repeat(x[0], x[1]) for x in parts]])
    context = np.concatenate([np.zeros(0, U), *[_joined(x[2], x[3]) for x in parts]])
    count = np.concatenate([np.zeros(0, np.int64), *[x[4].astype(np.int64) for x in parts]])
    order = _order(dish, context)
    dish, context, count = dish[order], context[order], count[order]
    at = _fresh(dish, context)
    return dish[at], context[at], np.add.reduceat(count, at) if len(at) else count


def _unit(key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1), from keys and salts alone."""
    for x in salt:
        key = mix(key + U(0x9E3779B97F4A7C15 * (x + 1) % 2**64))
    return ((key >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


class Tables:
    """The tables of several cells: a matrix of their sizes, a row for each cell, with zeros where no table stands."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes

    @classmethod
    def of(cls, many: np.ndarray, flat: np.ndarray) -> Tables:
        sizes = np.zeros((len(many), int(many.max(initial=1))), np.int64)
        row = np.repeat(np.arange(len(many)), many)
        sizes[row, np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)] = flat
        return cls(sizes)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.sizes > 0).sum(1), self.sizes[self.sizes > 0]

    def leave(self, rows: np.ndarray, u: np.ndarray) -> None:
        """A customer of each row, drawn by u, leaves its table."""
        reach = np.cumsum(self.sizes[rows], 1)
        k = (reach <= np.floor(u * reach[:, -1])[:, None]).sum(1)
        self.sizes[rows, k] -= 1

    def enter(self, rows: np.ndarray, u: np.ndarray, new: np.ndarray, discount: float) -> None:
        """A customer for each row: at a new table with odds `new`, at one that stands with odds of its size less the discount."""
        sizes = self.sizes[rows]
        odds = np.where(sizes > 0, sizes - discount, 0.0)
        reach = np.cumsum(odds, 1)
        place = u * (reach[:, -1] + new)
        k = (reach <= place[:, None]).sum(1)
        opens = k == sizes.shape[1]
        if opens.any():
            empty = (sizes == 0) & opens[:, None]
            full = opens & ~empty.any(1)
            k[opens] = empty[opens].argmax(1)
            if full.any():
                k[full] = self.sizes.shape[1]
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes[:, : max(1, self.sizes.shape[1] // 2)])], 1)
        self.sizes[rows, k] += 1

    def count(self, rows: np.ndarray) -> np.ndarray:
        return (self.sizes[rows] > 0).sum(1)


def _classes(many: np.ndarray, cells: np.ndarray):
    """Cells of like numbers of tables, so that a matrix has few empty places."""
    size = np.int64(np.ceil(np.log2(many[cells])))
    for k in np.unique(size):
        yield cells[size == k]


def reseat(key: np.ndarray, customers: np.ndarray, many: np.ndarray, flat: np.ndarray, base: np.ndarray, strength: float, discount: float, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`seated` by single steps, which tests hold it against: of each cell as many customers as it has leave, one after another, and are seated again. Returns each cell's number of tables and their sizes.

    Where all customers share one table, one that leaves comes back to it or opens a new one, with the same odds each
    time until one does: how many come back first is one draw.
    """
    begin = np.cumsum(many) - many
    times = customers.copy()
    times[customers < 2] = 0  # a lone customer has a table whatever is drawn
    other = (strength + discount * (tables - many)) * base
    alone = np.flatnonzero((many == 1) & (times > 0))
    new = other[alone] + discount * base[alone]
    opens = new / (new + customers[alone] - 1 - discount)
    back = np.floor(np.log(_unit(key[alone], 5)) / np.log1p(-np.minimum(opens, 1 - 1e-12)))
    opened = back < times[alone]
    split = alone[opened]
    parts = [(split, np.stack([customers[split] - 1, np.ones(len(split), np.int64)], 1), times[split] - back[opened].astype(np.int64) - 1)]
    for cells in _classes(many, np.flatnonzero(many > 1)):
        index = np.repeat(begin[cells] - (np.cumsum(many[cells]) - many[cells]), many[cells]) + np.arange(int(many[cells].sum()))
        parts.append((cells, Tables.of(many[cells], flat[index]).sizes, times[cells]))
    new_many, where = many.copy(), []
    for cells, sizes, left in parts:
        order = np.argsort(-left, kind="stable")
        cells, left, t = cells[order], left[order], Tables(sizes[order])
        for step in range(int(left.max(initial=0))):
            rows = np.arange(int(np.searchsorted(-left, -step, side="left")))  # those with more than `step` to come
            t.leave(rows, _unit(key[cells[rows]], step, 0))
            t.enter(rows, _unit(key[cells[rows]], step, 1), other[cells[rows]] + discount * t.count(rows) * base[cells[rows]], discount)
        number, flat_ = t.flat()
        new_many[cells] = number
        where.append((cells, number, flat_))
    moved = np.zeros(len(many), bool)
    at = np.cumsum(new_many) - new_many
    merged = np.zeros(int(new_many.sum()), np.int64)
    for cells, number, sizes in where:
        moved[cells] = True
        merged[np.repeat(at[cells] - (np.cumsum(number) - number), number) + np.arange(len(sizes))] = sizes
    still = np.flatnonzero(~moved)  # one table, or none
    still = still[many[still] == 1]
    merged[at[still]] = flat[begin[still]]
    return new_many, merged


def _by_steps(discount: float, customers: np.ndarray, widest: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers of some numbers of customers (in order, each once), of 1 to `widest` tables."""
    out, row = np.full((len(customers), widest), -np.inf), np.full(widest, -np.inf)
    row[0], at = 0.0, 0
    left = -discount * np.arange(1, widest + 1)
    for n in range(1, int(customers[-1]) + 1 if len(customers) else 1):
        if n > 1:
            with np.errstate(divide="ignore"):
                stay = row + np.log(np.maximum(n - 1 + left, 0.0))
            row = np.logaddexp(stay, np.concatenate([[-np.inf], row[:-1]]))
        if n == customers[at]:
            out[at], at = row, at + 1
    return out


@cache
def _stepped(discount: float) -> np.ndarray:
    return _by_steps(discount, np.arange(1, STEPPED + 1), STEPPED)


def _widest(customers: np.ndarray, discount: float) -> np.ndarray:
    """Tables up to which the alternating sum holds: its terms reach exp(y) and it exp(-y), y = (1-d) x^(1/(1-d)), x = tables / customers^d."""
    return (LOSS / 2 / (1 - discount)) ** (1 - discount) * customers.astype(np.float64) ** discount


def _by_sum(discount: float, customers: np.ndarray, widest: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers of many customers, but for a factor for each number of customers: t! d^t S(c, t) / c! is the coefficient of z^c in (1 - (1-z)^d)^t, by the binomial theorem."""
    t, c = np.arange(1, widest + 1, dtype=np.float64), customers.astype(np.float64)
    total = np.zeros((len(c), widest))
    term = np.ones((len(c), 1)) * t  # of j: C(t, j) Gamma(c - dj) Gamma(1 + dj), by those of j = 1
    most, before = np.abs(term), np.zeros(len(c))
    fits = t <= _widest(customers, discount)[:, None]
    for j in range(1, widest + 1):
        if j > 1:
            x, y = discount * (j - 1), c - discount
            log = -x * np.log(y) + (y - x - 0.5) * np.log1p(-x / y) + x + (1 / (y - x) - 1 / y) / 12 - (1 / (y - x) ** 3 - 1 / y**3) / 360
            log += lgamma(1 + discount * j) - lgamma(1 + discount)
            term *= np.maximum(t - j + 1, 0) / j * np.exp(log - before)[:, None]
            before = log
        turn = discount * j
        if abs(turn - round(turn)) > 1e-9:
            total += term * ((-1) ** (j + 1) * np.sin(np.pi * turn) / np.pi)
        most = np.maximum(most, np.abs(total))
        if (np.abs(term) <= 1e-17 * np.exp(-LOSS / 2) * most)[fits].all():
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        ways = np.cumsum(np.log(t)) + t * np.log(discount)
        return np.where(fits & (total > 0), np.log(total) - ways, np.nan)


def _stirling(discount: float, customers: np.ndarray, widest: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t) of each cell, t from 1 to `widest`, but for a factor for each cell; -inf for more tables than customers."""
    out = np.full((len(customers), widest), -np.inf)
    few = customers <= STEPPED
    out[few, : min(widest, STEPPED)] = _stepped(discount)[customers[few] - 1, :widest]
    many, back = np.unique(customers[~few], return_inverse=True)
    if len(many):
        found = _by_sum(discount, many, widest)
        lost = np.flatnonzero(np.isnan(found).any(1))
        if len(lost):
            found[lost] = _by_steps(discount, many[lost], widest)
        out[~few] = found[back]
    return out


def seated(key: np.ndarray, customers: np.ndarray, base: np.ndarray, strength: float, discount: float, others: np.ndarray) -> np.ndarray:
    """A Gibbs step of whole cells: how many tables each cell's customers take when all are seated anew. others: the tables of other cells in its restaurant.

    The odds of t tables are S(c, t) times the product of base * (strength + discount * (others + i)), i < t.
    Ranges of t double until what is beyond weighs nothing.
    """
    out = np.minimum(customers, 1)
    first = (strength + discount * others) * base
    width = np.minimum(customers, np.exp2(np.ceil(np.log2(first * np.log1p(customers / np.maximum(first, 1e-300)) + 8 * np.sqrt(first) + 8))).astype(np.int64))
    left = np.flatnonzero(customers > 1)
    u = _unit(key, 0)
    while len(left):
        again = []
        for wide in np.unique(width[left]):
            cells = left[width[left] == wide]
            cells = cells[np.argsort(customers[cells], kind="stable")]
            for at in range(0, len(cells), step := max(1, AT_ONCE // int(wide))):
                some = cells[at : at + step]
                grow = np.log(base[some, None] * (strength + discount * (others[some, None] + np.arange(wide))))
                log = np.cumsum(grow, 1) + _stirling(discount, customers[some], int(wide))
                top = log.max(1, keepdims=True)
                short = (log[:, -1] > top[:, 0] - 40) & (customers[some] > wide)
                reach = np.cumsum(np.exp(log - top), 1)
                out[some] = 1 + (reach <= (u[some] * reach[:, -1])[:, None]).sum(1)
                again.append(some[short])
        left = np.concatenate(again)
        width[left] = np.minimum(2 * width[left], customers[left])
    return out


def _sizes(customers: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Every table has one customer, each cell's first all others."""
    out = np.ones(int(many.sum()), np.int64)
    has = many > 0
    out[(np.cumsum(many) - many)[has]] += (customers - many)[has]
    return out


class Slice:
    """Cells of a slice's dishes, how many tables those with several customers have, and the dishes' in the root."""

    def __init__(self, dish, context, count, many=None, root_many=None):
        at = _fresh(dish)
        self.dishes = dish[at]
        self.n = np.diff(np.concatenate([at, [len(dish)]]))
        self.of = np.repeat(np.arange(len(at)), self.n)
        self.context, self.count = context, count
        self.multi = np.flatnonzero(count > 1)
        self.total = np.bincount(self.of, count, len(at)).astype(np.int64)
        self.many, self.root_many = many, root_many

    @classmethod
    def load(cls, blob) -> Slice:
        dishes, n, low, high, count, many, root_many = unpack(unsqueezed(blob))
        wide = lambda a: a.astype(np.int64)
        return cls(np.repeat(dishes, n), _joined(low, high), wide(count), wide(many), wide(root_many))

    def save(self) -> bytes:
        return squeezed(pack(self.dishes, _narrow(self.n), *_split(self.context), *map(_narrow, (self.count, self.many, self.root_many))))

    def tables(self) -> np.ndarray:
        """Of each cell."""
        t = np.minimum(self.count, 1)
        t[self.multi] = self.many
        return t

    def key(self, cells: np.ndarray, *salt: int) -> np.ndarray:
        key = mix(self.dishes[self.of[cells]] ^ mix(self.context[cells] + U(1)))
        for x in salt:
            key = mix(key + U(x + 1))
        return key

    def start(self, seed: int) -> None:
        n = len(self.multi)
        self.many = seated(self.key(self.multi, seed), self.count[self.multi], np.full(n, 0.1), STRENGTH[1], DISCOUNT[1], np.zeros(n, np.int64))
        n = len(self.dishes)
        self.root_many = seated(mix(self.dishes + U(seed)), self.root_customers(), np.full(n, 0.05), STRENGTH[0], DISCOUNT[0], np.zeros(n, np.int64))

    @property
    def flat(self) -> np.ndarray:
        """Sizes of tables of a seating of these numbers; no draw depends on which."""
        return _sizes(self.count[self.multi], self.many)

    @property
    def root_flat(self) -> np.ndarray:
        return _sizes(self.root_customers(), self.root_many)

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.of, self.tables(), len(self.dishes)).astype(np.int64)

    def root(self, all_customers: int, all_tables: int, vocabulary: int) -> np.ndarray:
        """The root's probability of each dish; one more, of any word that no training text holds."""
        new = (STRENGTH[0] + DISCOUNT[0] * all_tables) / (vocabulary + 1)
        own = np.concatenate([self.root_customers() - DISCOUNT[0] * self.root_many, [0.0]])
        return (np.maximum(own, 0) + new) / (STRENGTH[0] + all_customers)

    def sweep(self, served: np.ndarray, all_customers: int, all_tables: int, vocabulary: int, seed: int, sweep: int) -> None:
        """Reseats customers of all cells, then of the root. served: the tables of each context in `contexts()`."""
        base = self.root(all_customers, all_tables, vocabulary)
        us, back = self.contexts()
        if len(self.multi):
            self.many = seated(self.key(self.multi, seed, sweep), self.count[self.multi], base[self.of[self.multi]], STRENGTH[1], DISCOUNT[1], served[back] - self.many)
        one = np.full(len(self.dishes), 1 / (vocabulary + 1))
        key = mix(mix(self.dishes + U(seed)) + U(sweep + 1))
        self.root_many = seated(key, self.root_customers(), one, STRENGTH[0], DISCOUNT[0], all_tables - self.root_many)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of cells with several customers, by their slices; and each such cell's among them."""
        return np.unique(self.context[self.multi], return_inverse=True)


def _grouped_contexts(us: np.ndarray, q: int, *columns: np.ndarray):
    """Columns of contexts by their slices, in order of context: slice and blob."""
    order, cuts = dealt((mix(us) % U(q)).astype(np.int64), q)
    some = np.flatnonzero(np.diff(cuts))
    return [(int(k), [c[order[cuts[k] : cuts[k + 1]]] for c in columns]) for k in some.tolist()]


TOTALS = ("tokens", "dishes", "customers", "tables")
MODEL = "slice int, kind int, other int, blob binary, " + ", ".join(f"{c} long" for c in TOTALS)


def _model_rows(slice_: int, s: Slice, q: int, us: np.ndarray, columns) -> pa.Table:
    """A slice's state (kind 0), and what it tells each slice of contexts (kind 1)."""
    told = [(k, squeezed(pack(*_split(x[0]), *map(_narrow, x[1:])))) for k, x in _grouped_contexts(us, q, us, *columns)]
    m = len(told)
    one = pa.table({"slice": pa.array([slice_] * (m + 1), pa.int32()), "kind": pa.array([0] + [1] * m, pa.int32()), "other": pa.array([None, *[k for k, _ in told]], pa.int32()), "blob": pa.array([s.save(), *[b for _, b in told]], pa.binary())})
    for c, x in zip(TOTALS, (s.total.sum(), (s.total > 0).sum(), s.root_customers().sum(), s.root_many.sum()), strict=True):
        one = one.append_column(c, pa.array([int(x)] + [0] * m, pa.int64()))
    return one


def _begun(table: pa.Table, q: int, seed: int) -> pa.Table:
    """A slice as its seating starts, and its contexts: customers and tables there, and whether the slice has cells of several customers in them."""
    s = Slice(*_cells(x.as_buffer() for c in table.column("blob").chunks for x in c))
    s.start(seed)
    us, back = np.unique(s.context, return_inverse=True)
    size = len(us)
    columns = [np.bincount(back, x, size).astype(np.int64) for x in (s.count, s.tables())]
    return _model_rows(table.column("slice")[0].as_py(), s, q, us, [*columns, np.isin(us, s.contexts()[0]).astype(np.uint8)])


def _told(table: pa.Table):
    """What slices told a slice of contexts: (slice, contexts, columns) of each."""
    for k, b in zip(table.column("slice").to_pylist(), (x for c in table.column("blob").chunks for x in c), strict=True):
        low, high, *rest = unpack(unsqueezed(b.as_buffer()))
        yield k, _joined(low, high), rest


def _opened(table: pa.Table) -> pa.Table:
    """Restaurants of a slice of contexts: all their customers and tables (kind 2), and the tables for each slice that needs them (kind 3)."""
    parts = list(_told(table))
    us, back = np.unique(np.concatenate([u for _, u, _ in parts]), return_inverse=True)
    customers, tables = (np.bincount(back, np.concatenate([r[i] for _, _, r in parts]), len(us)).astype(np.int64) for i in range(2))
    out = [(-1, 2, squeezed(pack(*_split(us), _narrow(customers), _narrow(tables))))]
    at = 0
    for k, u, rest in parts:
        mine, at = back[at : at + len(u)][rest[2].astype(bool)], at + len(u)
        if len(mine):
            out.append((k, 3, squeezed(pack(*_split(us[mine]), _narrow(tables[mine])))))
    return _answers(table.column("other")[0].as_py(), out)


def _answers(other: int, out: list[tuple]) -> pa.Table:
    return pa.table({"slice": pa.array([k for k, _, _ in out], pa.int32()), "kind": pa.array([k for _, k, _ in out], pa.int32()), "other": pa.array([other] * len(out), pa.int32()), "blob": pa.array([b for _, _, b in out], pa.binary())})


ANSWERS = "slice int, kind int, other int, blob binary"


def _tables_of(blobs, us: np.ndarray) -> np.ndarray:
    """The tables of each context of `us`, from what its slices answered."""
    parts = [unpack(unsqueezed(b)) for b in blobs]
    if not parts:
        return np.zeros(len(us), np.int64)
    found, tables = np.concatenate([_joined(x[0], x[1]) for x in parts]), np.concatenate([x[2].astype(np.int64) for x in parts])
    order = np.argsort(found)
    return tables[order][np.searchsorted(found[order], us)]


def _swept(left: pa.Table, right: pa.Table, q: int, totals: tuple, vocabulary: int, seed: int, sweep: int) -> pa.Table:
    """A slice after a sweep, given the tables of its restaurants; what has changed in them; and, of sweeps after the burn-in, the seating (kind 4)."""
    s = Slice.load(left.column("blob")[0].as_buffer())
    us, back = s.contexts()
    served = _tables_of((x.as_buffer() for c in right.column("blob").chunks for x in c), us)
    before = s.many
    s.sweep(served, *totals, vocabulary, seed, sweep)
    change = np.bincount(back, s.many - before, len(us)).astype(np.int64)
    rows = _model_rows(left.column("slice")[0].as_py(), s, q, us, [change + 2**31])  # as unsigned
    if sweep >= BURN_IN:
        kept = pa.table({"slice": left.column("slice").slice(0, 1), "kind": pa.array([4], pa.int32()), "other": pa.array([sweep], pa.int32()), "blob": pa.array([squeezed(pack(*map(_narrow, (s.many, s.root_customers(), s.root_many))))], pa.binary()), **{c: pa.array([0], pa.int64()) for c in TOTALS}})
        rows = pa.concat_tables([rows, kept])
    return rows


def _changed(left: pa.Table, right: pa.Table, keep: bool) -> pa.Table:
    """Restaurants of a slice of contexts after a sweep: all of them (kind 2; their tables in each sample that is kept, the last at the end), and the tables for each slice (kind 3)."""
    every = unpack(unsqueezed(left.column("blob")[0].as_buffer()))
    us, tables = _joined(every[0], every[1]), every[-1].astype(np.int64)
    parts = [(k, np.searchsorted(us, u), rest[0].astype(np.int64) - 2**31) for k, u, rest in _told(right)] if right.num_rows else []
    for _, at, change in parts:
        tables[at] += change  # a slice names a context once
    out = [(-1, 2, squeezed(pack(*(every if keep else every[:3]), _narrow(tables))))]
    out += [(k, 3, squeezed(pack(*_split(us[at]), _narrow(tables[at])))) for k, at, _ in parts]
    return _answers(left.column("other")[0].as_py(), out)


def _wanted(batches, q: int):
    """The contexts of a slice's cells, for each slice of contexts."""
    for batch in batches:
        for k in range(batch.num_rows):
            us = np.unique(Slice.load(column_of(batch, "blob")[k].as_buffer()).context)
            made = _grouped_contexts(us, q, us)
            yield pa.RecordBatch.from_arrays([pa.array([column_of(batch, "slice")[k].as_py()] * len(made), pa.int32()), pa.array([j for j, _ in made], pa.int32()), pa.array([squeezed(pack(*_split(x[0]))) for _, x in made], pa.binary())], ["slice", "other", "blob"])


def _shares(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each slice that asks, the customers of its contexts and their tables in each sample."""
    if not left.num_rows or not right.num_rows:
        return _answers(0, [])
    low, high, customers, *tables = unpack(unsqueezed(left.column("blob")[0].as_buffer()))
    us, tables = _joined(low, high), tables[-SAMPLES:]
    out = []
    for k, u, _ in _told(right):
        at = np.searchsorted(us, u)
        out.append((k, 5, squeezed(pack(*_split(u), customers[at], *[t[at] for t in tables]))))
    return _answers(left.column("other")[0].as_py(), out)


def _final(left: pa.Table, right: pa.Table, totals: list, vocabulary: int) -> pa.Table:
    """A slice's dishes and cells with the averaged probability of each: what scoring looks up."""
    kinds = left.column("kind").to_pylist()
    blobs = [x.as_buffer() for c in left.column("blob").chunks for x in c]
    s = Slice.load(blobs[kinds.index(0)])
    samples = [unpack(unsqueezed(b)) for _, b in sorted(((o, b) for k, o, b in zip(kinds, left.column("other").to_pylist(), blobs, strict=True) if k == 4), key=lambda x: x[0])]
    parts = [unpack(unsqueezed(x.as_buffer())) for c in right.column("blob").chunks for x in c]
    found = np.concatenate([_joined(x[0], x[1]) for x in parts])
    order = np.argsort(found)
    at = order[np.searchsorted(found[order], s.context)]
    all_, *tables = (np.concatenate([x[i] for x in parts]).astype(np.int64)[at] for i in range(2, 3 + SAMPLES))
    p = np.zeros(len(s.context))
    for (many, customers, root_many), t, (every, root_tables) in zip(samples, tables, totals, strict=True):
        new = (STRENGTH[0] + DISCOUNT[0] * root_tables) / (vocabulary + 1)
        base = (np.maximum(customers.astype(np.int64) - DISCOUNT[0] * root_many.astype(np.int64), 0) + new) / (STRENGTH[0] + every)
        own = np.minimum(s.count, 1)
        own[s.multi] = many
        p += (s.count - DISCOUNT[1] * own + (STRENGTH[1] + DISCOUNT[1] * t) * base[s.of]) / (STRENGTH[1] + all_)
    blob = squeezed(pack(s.dishes, _narrow(s.n), _narrow(s.total), *_split(s.context), (p / len(samples)).astype("<f4")))
    return pa.table({"slice": left.column("slice").slice(0, 1), "model": pa.array([blob], pa.binary())})


SUMS = "batch binary, kind int, blob binary"


def _scored(left: pa.Table, right: pa.Table, vocabulary: int, customers: int) -> pa.Table:
    """For each batch of texts, sums by text over the tokens whose dishes are in the slice."""
    names, kinds = right.column("batch").to_pylist(), right.column("kind").to_pylist()
    blobs = [x.as_buffer() for c in right.column("blob").chunks for x in c]
    out = [(n, k, bytes(b)) for n, k, b in zip(names, kinds, blobs, strict=True) if k]
    if left.num_rows and len(out) < len(blobs):
        dishes, n, total, low, high, p = unpack(unsqueezed(left.column("model")[0].as_buffer()))
        context, p = _joined(low, high), np.log10(p.astype(np.float64))
        base = np.log10((total.astype(np.int64) + 0.1) / (customers + 0.1 * (vocabulary + 1)))
        known = total > 0
        place = np.repeat(np.arange(len(dishes), dtype=U), n)
        for name, kind, blob in zip(names, kinds, blobs, strict=True):
            if kind:
                continue
            d, m, low, high, times, of = unpack(unsqueezed(blob))
            who = np.repeat(np.searchsorted(dishes, d), m)
            at = np.repeat(_places(place, context, who.astype(U), _joined(low, high)), times)
            who = np.repeat(who, times)
            number = np.bincount(of)
            has = np.flatnonzero(number)
            sums = (np.bincount(of, x)[has] for x in (known[who], base[who], p[at]))
            f, b, s = sums
            out.append((name, 0, pack(_narrow(has), _narrow(number[has]), _narrow(f.astype(np.int64)), b, s)))
    return pa.table({"batch": pa.array([x[0] for x in out], pa.binary()), "kind": pa.array([x[1] for x in out], pa.int32()), "blob": pa.array([x[2] for x in out], pa.binary())})


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _summed(table: pa.Table) -> pa.Table:
    """The scores of a batch's texts. Batches alike in every text share a name: each copy of the texts gets an equal part."""
    kinds = table.column("kind").to_pylist()
    blobs = [unpack(x.as_buffer()) for c in table.column("blob").chunks for x in c]
    texts = [b for k, b in zip(kinds, blobs, strict=True) if k]
    ids, null, held_out = texts[0]
    sums = np.zeros((4, len(ids)))
    for k, b in zip(kinds, blobs, strict=True):
        if not k:
            for row, x in zip(sums, b[1:], strict=True):
                row[b[0]] += x
    sums /= len(texts)
    times = lambda a: np.tile(a, len(texts))
    n, f, b, s = map(times, sums)
    return pa.table({"doc_id": pa.array(times(ids), mask=times(null).astype(bool)), "held_out": pa.array(times(held_out).astype(bool)), "n_tokens": pa.array(np.rint(n).astype(np.int64)), "n_known": pa.array(np.rint(f).astype(np.int64)), "base_score": pa.array(b), "score": pa.array(s)})


def _places(dish: np.ndarray, context: np.ndarray, d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where each (d, c) stands among sorted cells; all are there."""
    shift = U(CONTEXT_BITS)
    if len(dish) and int(dish[-1]) >> (64 - CONTEXT_BITS):  # too many dishes for one word
        cells = np.rec.fromarrays([dish, context])
        return np.searchsorted(cells, np.rec.fromarrays([d, c], dtype=cells.dtype))
    return np.searchsorted((dish << shift) | context, (d << shift) | c)


def cogrouped(f, **options):
    """f with its options set, with the type hints that applyInArrow looks for."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left, right, **options)

    return run


def pitman_yor(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Texts whose crc32(doc_id) mod HELD_OUT_OF isn't 0 are learned from; null ids are learned from, too.
    Null and empty texts have one token, their end. Rows that repeat teach as often and each get their
    score. Words that no training text holds share the root's base, uniform over the known words and one
    for all others. Without training texts every token has that base. An empty table gives no rows;
    extra columns play no part.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "pitman-yor")
    p = slices_by_size(docs, each=8 << 20)
    q = max(1, p // FEWER)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    counted = docs.select("text", "held_out").mapInArrow(partial(_counts, p=p), "slice int, blob binary")
    made = work.save(counted.groupBy("slice").applyInArrow(grouped(_begun, q=q, seed=seed), MODEL))

    def totals(made: DataFrame):
        return made.where("kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS]).first()

    def by_slice(df: DataFrame, kind: int):
        return df.where(F.col("kind") == kind).groupBy("slice")

    now = totals(made)
    every, words_ = now.dishes, now.tokens
    opened = work.save(made.where("kind = 1").groupBy("other").applyInArrow(grouped(_opened), ANSWERS))
    samples, kept = [], []
    for sweep in range(BURN_IN + SAMPLES):
        old, before = made, opened
        step = cogrouped(_swept, q=q, totals=(now.customers, now.tables), vocabulary=every, seed=seed, sweep=sweep)
        made = work.save(by_slice(old, 0).cogroup(by_slice(before, 3)).applyInArrow(step, MODEL))
        step = cogrouped(_changed, keep=sweep > BURN_IN)
        opened = work.save(before.where("kind = 2").groupBy("other").cogroup(made.where("kind = 1").groupBy("other")).applyInArrow(step, ANSWERS))
        now = totals(made)
        if sweep >= BURN_IN:
            samples.append((now.customers, now.tables))
            kept.append(made)
        if sweep <= BURN_IN:
            work.drop(old)
        work.drop(before)
    state = made.where("kind = 0").select("slice", "kind", "other", "blob")
    for x in kept:
        state = state.unionByName(x.where("kind = 4").select("slice", "kind", "other", "blob"))
    wanted = made.where("kind = 0").select("slice", "blob").mapInArrow(partial(_wanted, q=q), "slice int, other int, blob binary")
    shares = opened.where("kind = 2").groupBy("other").cogroup(wanted.groupBy("other")).applyInArrow(cogrouped(_shares), ANSWERS)
    final = cogrouped(_final, totals=samples, vocabulary=every)
    model = work.save(state.groupBy("slice").cogroup(shares.groupBy("slice")).applyInArrow(final, "slice int, model binary"))
    work.drop(*kept, opened)
    texts = docs.select("doc_id", "text", "held_out", F.xxhash64("text").alias("print"))
    asked = texts.mapInArrow(partial(_asked, p=p), ASKED)
    sums = model.groupBy("slice").cogroup(asked.groupBy("slice")).applyInArrow(cogrouped(_scored, vocabulary=every, customers=words_), SUMS)
    out = sums.groupBy("batch").applyInArrow(grouped(_summed), SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words_).cast("long").alias("train_tokens"), "base_score", "score")
