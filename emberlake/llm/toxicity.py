"""Toxicity by a factorization machine over hashed terms."""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import LOWER, U, chunks, column_of, lean, mix, pack, powers, runs, unpack, words

BITS = 18  # hashed terms: 2 ** 18
FACTORS = 8
EPOCHS = 8
CHUNK = 1 << 20  # bytes of text whose terms are found at once
START, FACTOR_RATE, DECAY = 0.1, 0.3, 1e-5  # of the factors: size at first, learning rate against the weights', decay
COMMON = 0.5  # the rarity of a common term, where a term of one text has 1
SEEN = 3  # texts that hold a term before its factors count
POWER = 0.25  # of a text's number of terms, by which each term's value falls
PRIOR = 3.0  # smoothing of a term's odds
#: The bound on labelled rows that the machine is fitted on; which rows, a hash of doc_id says.
SAMPLE = 20_000
TEST_FOLDS = 5


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its distinct hashed words and their values: row bounds, term ids, values. Values are binary, scaled to unit length."""
    start, end, doc, h = words(data, offs)
    # punctuation at a word's end is not part of the term
    stop = np.isin(data[end - 1], np.frombuffer(b".,;:!?\"')", np.uint8)) & (end - start > 1) if len(start) else np.zeros(0, bool)
    if stop.any():
        k = (end - start)[stop] - 1
        value = (LOWER[data[end[stop] - 1]].astype(U) + U(1)) * powers(int(k.max()) + 1)[k]
        # the polynomial of the word without its last byte, from the word's own bytes
        plain = _polynomials(data, start[stop], end[stop] - 1, value)
        h = h.copy()
        h[stop] = mix(plain ^ (k.astype(U) * U(0xD6E8FEB86659FD93)))
    term = (h >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(doc * (1 << BITS) + term)
    row, term = key >> BITS, key & ((1 << BITS) - 1)
    bounds = np.searchsorted(row, np.arange(len(offs)))
    return bounds, term, row


def _polynomials(data, start, end, last):
    length = end - start
    at = np.repeat(np.cumsum(length) - length, length)
    place = np.arange(int(length.sum())) - at
    v = (LOWER[data[np.repeat(start, length) + place]].astype(U) + U(1)) * powers(int(length.max()) + 1)[place]
    return np.add.reduceat(v, np.cumsum(length) - length)


def value(n: np.ndarray) -> np.ndarray:
    """The value of each of a text's n known terms. It falls slowly: one insult in a long text still counts."""
    return 1 / np.maximum(n, 1) ** POWER


class FactorizationMachine:
    """score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j): linear weights miss pairs of terms, the factors learn them."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def logits(self, bounds: np.ndarray, term: np.ndarray) -> np.ndarray:
        n = np.diff(bounds)
        x = np.repeat(value(n), n).astype(np.float32)
        out = np.full(len(n), self.bias, np.float64)
        has = n > 0
        if has.any():
            at = bounds[:-1][has]
            vx = self.v[term] * x[:, None]
            s = np.add.reduceat(vx, at)
            pair = (s * s - np.add.reduceat(vx * vx, at)).sum(1) / 2
            out[has] += np.add.reduceat(self.w[term] * x, at) + pair
        return out

    @classmethod
    def fit(cls, bounds: np.ndarray, term: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> FactorizationMachine:
        """Adagrad over mini-batches; classes weigh equally in the loss, so 0.5 is where both are equally likely for their numbers.

        Linear weights start at a term's smoothed log odds between the classes and learn in its scale, so the
        many terms that say nothing alone stay quiet. Factors see a term by its rarity only, whatever its odds:
        two terms that each say nothing may say much together.
        """
        rng = np.random.default_rng(seed)
        w, v = np.zeros(1 << BITS, np.float32), (rng.standard_normal((1 << BITS, FACTORS)) * START).astype(np.float32)
        gw, gv, bias, gb = np.full(1 << BITS, 1e-3, np.float32), np.full((1 << BITS, FACTORS), 1e-3, np.float32), 0.0, 1e-3
        positive = float(y.sum())
        if not len(y) or positive in (0.0, float(len(y))):
            p = (positive + 1) / (len(y) + 2)
            return cls(float(np.log(p / (1 - p))), w, np.zeros_like(v))
        weight = np.where(y > 0, len(y) / (2 * positive), len(y) / (2 * (len(y) - positive)))
        of = np.repeat(y > 0, np.diff(bounds))
        pos, neg = np.bincount(term[of], minlength=1 << BITS), np.bincount(term[~of], minlength=1 << BITS)
        ratio = np.log((pos + PRIOR) / (positive + 2 * PRIOR)) - np.log((neg + PRIOR * (len(y) - positive) / positive) / (len(y) - positive + 2 * PRIOR * (len(y) - positive) / positive))
        ratio = ratio.astype(np.float32)
        rarity = np.maximum(np.log((len(y) + 1) / (pos + neg + 0.5)) / np.log(len(y) + 1), COMMON).astype(np.float32)
        rarity *= pos + neg >= SEEN  # a term of one or two texts can't show a pair
        n = np.diff(bounds)
        for epoch in range(epochs):
            rate = 0.3 / (1 + 0.2 * epoch)
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                m = n[rows]
                t = term[np.repeat(bounds[:-1][rows], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)]
                scale = np.repeat(value(m), m).astype(np.float32)
                x, z = scale * ratio[t], scale * rarity[t]
                r = np.repeat(np.arange(len(rows)), m)
                vz = v[t] * z[:, None]
                s = np.zeros((len(rows), FACTORS), np.float32)
                q = np.zeros(len(rows))
                b = np.concatenate([[0], np.cumsum(m)])
                has = m > 0
                if has.any():
                    at = b[:-1][has]
                    s[has] = np.add.reduceat(vz, at)
                    q[has] = np.add.reduceat(w[t] * x, at) + (s[has] ** 2 - np.add.reduceat(vz * vz, at)).sum(1) / 2
                g = (1 / (1 + np.exp(-np.clip(bias + q, -30, 30))) - y[rows]) * weight[rows] / len(rows)
                gx, gz = (g[r] * x).astype(np.float32), (g[r] * z).astype(np.float32)
                ids, back = np.unique(t, return_inverse=True)
                dw = np.bincount(back, gx, len(ids)).astype(np.float32) + 1e-6 * w[ids]
                each = gz[:, None] * (s[r] - vz)
                order = np.argsort(back, kind="stable")
                dv = (np.add.reduceat(each[order], runs(back[order])[:-1]) if len(order) else each) + DECAY * v[ids]
                gw[ids] += dw * dw
                w[ids] -= rate * dw / np.sqrt(gw[ids])
                gv[ids] += dv * dv
                v[ids] -= rate * FACTOR_RATE * dv / np.sqrt(gv[ids])
                db = float(g.sum())
                gb += db * db
                bias -= rate * db / gb**0.5
        return cls(bias, w * ratio, v * rarity[:, None])

    def to_bytes(self) -> bytes:
        return pack(np.array([self.bias]), self.w, self.v.reshape(-1))

    @classmethod
    def from_bytes(cls, blob: bytes) -> FactorizationMachine:
        b, w, v = unpack(blob)
        return cls(float(b[0]), w, v.reshape(-1, FACTORS))


@lean
def _terms(batches):
    for batch in batches:
        for at, n, data, offs in chunks(batch, most=CHUNK):
            bounds, term, _ = terms(data, offs)
            rows = batch.slice(at, n)
            yield pa.RecordBatch.from_arrays([column_of(rows, "doc_id"), column_of(rows, "label"), pa.array([term[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["doc_id", "label", "terms"])


def fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """A machine learned from at most `sample` labelled documents outside the test fold.

    Rows without a label, and doc_ids whose labels differ, teach nothing; of rows that repeat a doc_id with
    other texts one teaches. A text has 2 ** BITS terms at most, so what comes to the driver is bounded.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), TEST_FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other")).where("label = other").drop("other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` ids: a bounded broadcast, so texts stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")
    rows = rows.mapInArrow(_terms, "doc_id long, label int, terms binary").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("terms").alias("terms"))
    table = rows.select("label", "terms").toArrow()
    blobs = [x.as_buffer().to_pybytes() for c in table.column("terms").chunks for x in c]
    y = (table.column("label").to_numpy() > 0).astype(np.float64)
    order = sorted(range(len(blobs)), key=lambda k: (blobs[k], y[k]))  # however Spark dealt the rows, the same machine
    each = [np.frombuffer(blobs[k], "<i4") for k in order]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return FactorizationMachine.fit(bounds, np.concatenate([*each, np.zeros(0, "<i4")]).astype(np.int64), y[order])


@lean
def _scores(batches, model, name: str):
    """The batch's columns and its scores."""
    machine = FactorizationMachine.from_bytes(model.value)
    for batch in batches:
        out = [np.zeros(0)]
        for _, _, data, offs in chunks(batch, most=CHUNK):
            bounds, term, _ = terms(data, offs)
            out.append(1 / (1 + np.exp(-np.clip(machine.logits(bounds, term), -30, 30))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, name])


def scored(docs: DataFrame, machine: FactorizationMachine, name: str = "score") -> DataFrame:
    """docs with each text's score; a column of that name is replaced. Null and empty texts get the score of no terms. Map-only: no shuffle."""
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(machine.to_bytes())  # of one size, whatever it learned from
    return docs.mapInArrow(partial(_scores, model=model, name=name), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Scores come from texts alone. Null and empty texts get the score of no terms; repeated rows each get
    theirs; rows with a null id are scored, teach nothing and are not held out. Without any label every
    score is even odds. An empty table gives no rows; extra columns play no part.
    """
    machine = fit(docs, labels)
    out = scored(docs.select("doc_id", "text"), machine)
    held = F.coalesce(fold(F.col("doc_id"), TEST_FOLDS) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows scored over `threshold`, with all their columns, whatever their names. Nulls, empty texts and repeated rows as in `toxicity`; even odds, as without any label, stay."""
    machine = fit(docs, labels)
    return scored(docs, machine, "__score").where(F.col("__score") <= threshold).drop("__score")
