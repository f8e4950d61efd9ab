"""Jaccard join of word n-gram sets: universe partitioning with one-deletion neighbourhoods, exact verification, components.

Two sets of sizes a and b with Jaccard similarity of at least P/100 differ in at most
(100-P)/(100+P) * (a+b) elements. A band of sizes has a bound H on that difference. The universe is
hashed into groups of segments. A set probes with the N = ceil((H+1)/2) groups that it fills best:
if it differed from its partner by two elements in each, that would be more than H (pigeonhole). So
in one of them the two differ by one element at most, which lies in one segment, and without that
segment the groups are equal. Each set indexes, for each group, all subsets of its segments that
leave one out. There are more groups than N, so a set need not probe with those that it hardly
fills, whose subsets many unlike sets share. How many segments a group has is chosen by cost: more
segments make longer, rarer subsets, but more of them. Where H is two at most, the whole set is one
group, and the subsets leave out up to H elements.
"""
from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import ROOT_2, U, chunks, column_of, dealt, grouped, lean, mix, pack, runs, squeezed, unpack, unsqueezed, words
from .quotient import bitmap, hit
from .workspace import Workspace, slices, slices_by_size

#: Cost of testing one pair of sketches, in index entries; and the share of all sets in one band.
PAIR_COST, BAND_SHARE = 0.02, 0.25
SEGMENTS = (3, 4, 6)
SPARE = 5  # one group more for each so many that a set must probe with
CHUNK = 1 << 19  # bytes of text whose sets are made at once
TOGETHER = 1 << 19  # index entries that a task gathers before it deals them out
FIRST_WIDTH, WIDER = 4, 8  # pairs that a set takes in the first round, and by how much they grow in each further one
SHARP = 16  # bits of a sketch for each element that two sets may differ in
FEW_LINKS = 1000  # new links that needn't change components before the next round
FEW = 100_000  # ids that may be broadcast: some megabytes
LEADERS = 1 << 16  # sets that a task remembers to tell copies by
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)


def _weights(n: int) -> np.ndarray:
    """An odd factor for each place in a shingle."""
    k = np.arange(n)
    return PLACE[k % len(PLACE)] ** (1 + k // len(PLACE)).astype(U)


def _shingles(h: np.ndarray, n: int) -> np.ndarray:
    many = max(0, len(h) - n + 1)
    s = np.zeros(many, U)
    for k, w in enumerate(_weights(n if many else 0)):
        s += h[k : k + many] * w
    return mix(s)


def sets_of(data: np.ndarray, offs: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the distinct n-word shingles, of all words as one if there are fewer: 128 bits each, as two arrays in order of the first."""
    _, _, doc, first = words(data, offs)
    second = words(data, offs, ROOT_2)[3]
    bounds = np.searchsorted(doc, np.arange(len(offs)))
    x, y = _shingles(first, n), _shingles(second, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            p, q = x[a : b - n + 1], y[a : b - n + 1]
            order = np.argsort(p)
            p, q = p[order], q[order]
            same = p[1:] == p[:-1]
            if (same & (q[1:] != q[:-1])).any():  # unlike shingles with one first hash
                order = np.lexsort((q, p))
                p, q = p[order], q[order]
                same = p[1:] == p[:-1]
            fresh = np.concatenate([[True], ~same | (q[1:] != q[:-1])])
            out.append((p[fresh], q[fresh]))
        elif b > a:
            out.append(tuple(mix((h[a:b] * _weights(b - a)).sum(keepdims=True) ^ U(b - a)) for h in (first, second)))
        else:
            out.append((x[:0], y[:0]))
    return out


def shared(p: tuple, q: tuple) -> int:
    """How many elements two sets share."""
    if len(p[0]) > len(q[0]):
        p, q = q, p
    if not len(p[0]):
        return 0
    at = np.searchsorted(q[0], p[0])
    at[at == len(q[0])] = 0
    both = q[0][at] == p[0]
    sure = q[1][at] == p[1]
    if (both & ~sure).any():
        return len(set(zip(*map(np.ndarray.tolist, p), strict=True)) & set(zip(*map(np.ndarray.tolist, q), strict=True)))
    return int(both.sum())


class Scheme:
    """Bands of set sizes, and each band's groups and segments."""

    def __init__(self, percent: int, n_sets: int, largest: int = 1 << 32):
        hi = [1]
        while hi[-1] < largest:
            hi.append(max(hi[-1] + 1, hi[-1] * 100 // percent))
        self.percent, self.hi = percent, np.array(hi, np.int64)
        self.differ = 2 * (100 - percent) * self.hi // (100 + percent)
        self.probes = (self.differ + 2) // 2
        self.groups = self.probes + -(-self.probes // SPARE)
        self.segments = np.ones(len(hi), np.int64)
        for k in np.flatnonzero(self.differ > 2):
            g = int(self.groups[k])
            cost = {s: g * s * (1 + PAIR_COST * n_sets * BAND_SHARE * np.exp(-2 * (s - 1) / s * 0.85 * self.hi[k] / g)) for s in SEGMENTS}
            self.segments[k] = min(cost, key=cost.get)

    def signatures(self, sets: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and ids: of each set's own band, and of the next, where its larger partners may be. A key's last bit says whether it probes: a pair is found by the probes of its larger set."""
        sizes = np.array([len(s) for s in sets])
        own = np.searchsorted(self.hi, sizes)
        keys, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for next_ in (0, 1):
            band = own + next_
            use = (sizes * 100 // self.percent > self.hi[own]) if next_ else np.ones(len(sets), bool)
            differ = self.differ[band]
            for k in np.flatnonzero(use & (differ > 0) & (differ <= 2)):
                found = _neighbourhood(sets[k], int(differ[k]), int(band[k]))
                keys.append(found & ~U(1) | U(1 - next_))
                owners.append(np.full(len(found), ids[k]))
            use &= differ > 2
            if use.any():
                found, of = self._subsets([sets[k] for k in np.flatnonzero(use)], band[use], not next_)
                keys.append(found)
                owners.append(ids[use][of])
        return np.concatenate(keys), np.concatenate(owners)

    def _subsets(self, sets: list[np.ndarray], band: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all groups' subsets that leave a segment out, and whose they are."""
        groups, segments = self.groups[band], self.segments[band]
        cells = groups * segments
        base = np.cumsum(cells) - cells
        t = np.concatenate(sets)
        o = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        x = mix(t ^ (band[o].astype(U) * PLACE[1]))
        cell = base[o] + (((x >> U(32)) * cells[o].astype(U)) >> U(32)).astype(np.int64)
        acc = np.zeros(int(cells.sum()), U)
        np.add.at(acc, cell, mix(t ^ U(0x2545F4914F6CDD1D)))
        many = np.bincount(cell, minlength=len(acc))
        width = np.repeat(segments, groups)  # of each group
        starts = np.cumsum(width) - width
        rest = np.repeat(np.add.reduceat(acc, starts), width) - acc
        local = np.arange(len(acc)) - np.repeat(base, cells)
        keys = mix(rest ^ mix((np.repeat(band, cells).astype(U) << U(40)) | local.astype(U))) & ~U(1)
        if probe:
            least = np.add.reduceat(many, starts) - np.maximum.reduceat(many, starts)  # elements of the group's poorest subset
            of = np.repeat(np.arange(len(sets)), groups)
            order = np.lexsort((-least, of))
            first = np.cumsum(groups) - groups
            use = np.zeros(len(width), bool)
            use[order] = np.arange(len(width)) - np.repeat(first, groups) < np.repeat(self.probes[band], groups)
            keys |= np.repeat(use, width).astype(U)
        return keys, np.repeat(np.arange(len(sets)), cells)


def _neighbourhood(s: np.ndarray, deletions: int, band: int) -> np.ndarray:
    """Keys of a small set without up to one or two of its elements."""
    v = mix(s ^ U(0x2545F4914F6CDD1D))
    whole = v.sum()
    found = [np.array([whole]), whole - v]
    if deletions > 1:
        i, j = np.triu_indices(len(v), 1)
        found.append(whole - v[i] - v[j])
    return mix(np.concatenate(found) ^ mix(np.array([band], U) << U(40)))


def differences(sizes, percent: int):
    """How many elements two sets of so many together may differ in."""
    return (100 - percent) * sizes // (100 + percent)


def sketch(s: np.ndarray, percent: int) -> np.ndarray:
    """The parity of how many elements fall on each of some bits: two sketches differ in no more bits than the sets in elements.

    A power of two of at least SHARP times the differences that partners of this size may have: elements seldom
    share a bit, so sets that differ in a tenth more than they may mostly show it; a few bits an element.
    """
    bits = max(64, 1 << (SHARP * differences(2 * len(s), percent)).bit_length())
    parity = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<u8")


def plausible_pairs(sketches: list[np.ndarray], i: np.ndarray, j: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches of each pair (i, j) differ in as few bits as sets of so many elements together may. The longer one is folded to the other's length."""
    length = np.array([len(s) for s in sketches], np.int64)
    short = np.minimum(length[i], length[j])
    most, out = differences(total, percent), np.zeros(len(i), bool)
    for size in np.unique(short):
        rows = np.flatnonzero(short == size)
        for at in range(0, len(rows), step := max(1, (1 << 20) // int(size))):
            part = rows[at : at + step]
            used, back = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
            folded = np.stack([np.bitwise_xor.reduce(sketches[k].reshape(-1, size), axis=0) for k in used.tolist()])
            x, y = back[: len(part)], back[len(part) :]
            out[part] = np.bitwise_count(folded[x] ^ folded[y]).sum(1, dtype=np.int64) <= most[part]
    return out


INDEXED = "slice int, blob binary, id long, n long, lead long, mark binary, sketch binary"


@lean
def _index(batches, scheme: Scheme, n: int, p: int):
    """Packed index entries by slice; and each row's size, and its leader: a row that this task met before with the same set. Leaders come with their set's digest and sketch."""
    leaders: dict[bytes, int] = {}
    held, size = [], 0

    def put():
        keys, owners = (np.concatenate(x) for x in zip(*held, strict=True))
        # the low half of a key says its slice; of the high half 31 bits tell keys of a slice apart, as clashes only cost a test
        order, cuts = dealt(((keys & U(0xFFFFFFFF)) // U(2) % U(p)).astype(np.int64), p)
        keys, owners = (keys >> U(32) & ~U(1) | keys & U(1)).astype(np.uint32)[order], owners[order]
        some = np.flatnonzero(np.diff(cuts))
        # owners stand in the order of rows: their steps compress well
        blobs = [squeezed(pack(keys[a:b], np.diff(owners[a:b], prepend=0))) for a, b in zip(cuts[some].tolist(), cuts[some + 1].tolist(), strict=True)]
        m = len(some)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary()), *[pa.nulls(m, pa.int64())] * 3, *[pa.nulls(m, pa.binary())] * 2], ["slice", "blob", "id", "n", "lead", "mark", "sketch"])

    for batch in batches:
        for at, rows, data, offs in chunks(batch, most=CHUNK):
            ids = column_of(batch, "doc_id").slice(at, rows).to_pylist()
            sets = sets_of(data, offs, n)
            lead, marks, sketches, new = list(ids), [None] * rows, [None] * rows, []
            for k, (s, t) in enumerate(sets):
                if len(s) and ids[k] is not None:
                    mark = hashlib.blake2b(s.tobytes() + t.tobytes(), digest_size=16).digest()
                    lead[k] = leaders.setdefault(mark, ids[k])
                    if lead[k] == ids[k]:
                        marks[k], sketches[k] = mark, sketch(s, scheme.percent).tobytes()
                        new.append(k)
                    if len(leaders) > LEADERS:
                        leaders.clear()
            yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), pa.array(ids, pa.int64()), pa.array([len(s) for s, _ in sets], pa.int64()), pa.array(lead, pa.int64()), pa.array(marks, pa.binary()), pa.array(sketches, pa.binary())], ["slice", "blob", "id", "n", "lead", "mark", "sketch"])
            if new:
                held.append(scheme.signatures([sets[k][0] for k in new], np.array([ids[k] for k in new], np.int64)))
                size += len(held[-1][0])
                if size >= TOGETHER:
                    yield put()
                    held, size = [], 0
    if size:
        yield put()


def _buckets(table: pa.Table) -> pa.Table:
    """Of the index the entries whose key several ids have, one of them with a probe; with the least of these ids."""
    parts = [unpack(unsqueezed(x.as_buffer())) for c in table.column("blob").chunks for x in c]
    key, id_ = np.concatenate([x[0] for x in parts]), np.concatenate([np.cumsum(x[1]) for x in parts])
    key = key.astype(np.int64) | table.column("slice")[0].as_py() << 32
    order = np.lexsort((~key & 1, id_, key >> 1))
    probe, key, id_ = (key[order] & 1).astype(bool), key[order] >> 1, id_[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])
    key, id_, probe = key[fresh], id_[fresh], probe[fresh]
    at = runs(key)
    size = np.diff(at)
    more = np.repeat((size > 1) & np.logical_or.reduceat(probe, at[:-1]), size)
    return pa.table({"key": pa.array(key[more]), "id": pa.array(id_[more]), "probe": pa.array(probe[more]), "lead": pa.array(np.repeat(id_[at[:-1]], size)[more])})


MEMBERS = "key long, id long, probe boolean, lead long"


OFFERED = "a long, b long, key long, id long, probe boolean, lead long, comp long, n long, sketch binary"


def _open_pairs(table: pa.Table, percent: int, width: int, rest: bool = False) -> pa.Table:
    """Pairs of a bucket to verify next: of different components so far, one of them a probe, with sizes and sketches that allow a link, beyond the `mark` of the lesser id: the greatest it has been verified with. Of each id the first `width` in all buckets of the slice, each once: whether more matter shows once these are verified.

    With `rest` also the rows that the further pairs need, each pair in one of its buckets; all other rows are done.
    """
    key, id_, comp, n, mark = (table.column(c).to_numpy() for c in ("key", "id", "comp", "n", "mark"))
    probe, lead = table.column("probe").to_numpy(), table.column("lead").to_numpy()
    sketches = [np.frombuffer(x.as_buffer(), U) for c in table.column("sketch").chunks for x in c]
    order = np.lexsort((id_, key))
    key, id_, comp, n, probe, lead, mark = key[order], id_[order], comp[order], n[order], probe[order].astype(bool), lead[order], mark[order]
    first = id_ == lead  # its pairs with all others have been tried: where these are of other components, none links
    at = runs(key)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(key))  # rows from here to the bucket's end
    row, step, pairs = np.arange(len(key)), 1, [np.zeros((2, 0), np.int64)]
    while len(row := row[left[row] > step]):
        other = row + step
        x, y = n[row], n[other]
        near = (comp[row] != comp[other]) & ~first[row] & ~first[other] & (id_[other] > np.maximum(id_[row], mark[row])) & (probe[row] | probe[other]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
        pairs.append(np.stack([row[near], other[near]]))
        step += 1
    i, j = np.concatenate(pairs, 1)
    allowed = plausible_pairs(sketches, order[i], order[j], n[i] + n[j], percent) if len(i) else np.zeros(0, bool)
    i, j = i[allowed], j[allowed]
    a, b = id_[i], id_[j]
    o = np.lexsort((b, a))
    a, b, i, j = a[o], b[o], i[o], j[o]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, i, j = a[fresh], b[fresh], i[fresh], j[fresh]
    at = runs(a)
    sooner = np.arange(len(a)) - np.repeat(at[:-1], np.diff(at)) < width
    pairs = pa.table({"a": pa.array(a[sooner]), "b": pa.array(b[sooner])})
    if not rest:
        return pairs
    later = order[np.unique(np.concatenate([i[~sooner], j[~sooner]]))]
    kept = table.select(["key", "id", "probe", "lead", "comp", "n", "sketch"]).take(pa.array(later))
    return pa.concat_tables([pairs, kept], promote_options="default")


@lean
def _plausible(batches, percent: int):
    """Pairs whose sketches allow a link."""
    for batch in batches:
        m = batch.num_rows
        sketches = [np.frombuffer(x.as_buffer(), U) for c in ("a_sketch", "b_sketch") for x in column_of(batch, c)]
        keep = plausible_pairs(sketches, np.arange(m), np.arange(m) + m, column_of(batch, "n").to_numpy(), percent)
        yield pa.RecordBatch.from_arrays([column_of(batch, "a"), column_of(batch, "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


@lean
def _linked(batches, n: int, percent: int):
    """Pairs whose whole sets link, made anew from both texts."""
    for batch in batches:
        right = column_of(batch, "b_text")
        for at, rows, data, offs in chunks(batch, "a_text", CHUNK):
            left = sets_of(data, offs, n)
            part = pa.RecordBatch.from_arrays([right.slice(at, rows)], ["b_text"])
            keep, k = [], 0
            for _, m, data_, offs_ in chunks(part, "b_text", CHUNK):
                for q in sets_of(data_, offs_, n):
                    p = left[k]
                    both = shared(p, q)
                    keep.append(both > 0 and 100 * both >= percent * (len(p[0]) + len(q[0]) - both))
                    k += 1
            yield pa.RecordBatch.from_arrays([column_of(batch, "a").slice(at, rows), column_of(batch, "b").slice(at, rows)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """id, comp: the least id of each linked id's component. Alternating large and small stars; each round is written, so lineage stays short and nothing comes to the driver but counts.

    Done when all are stars: each id points to one other, which points to none.
    """
    edges = work.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        ends = edges.select("u", F.lit(1).alias("out")).union(edges.select(F.col("v").alias("u"), F.lit(0).alias("out")))
        ends = ends.groupBy("u").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("all"))
        if ends.where("out > 1 OR (out = 1 AND all > 1)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = work.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        old, edges = edges, work.save(small)
        work.drop(old, large)


def only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose `column` (long) is in ids, a table of that one column without repeats. Only rows that may be are shuffled."""
    if ids.count() <= FEW:
        return df.join(F.broadcast(ids), column, "left_semi")
    return df.where(hit(F.xxhash64(column), bitmap(ids.select(F.xxhash64(column).alias("fp")), repeated=False))).join(ids, column, "left_semi")


def unsettled(placed: DataFrame) -> DataFrame:
    """key, id, probe, lead, comp: of the buckets' rows those whose pairs may still matter once each bucket's least id, its lead, has been tried with all others.

    The lead is left out, and so are buckets whose other ids are of one component, or none of them a probe: most buckets hold one id beside the lead.
    """
    placed = placed.where("id != lead")
    split = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("probe").alias("p")).where("x != y AND p").select("key")
    return placed.join(split, "key", "left_semi").groupBy("key", "id").agg(F.max("probe").alias("probe"), F.min("lead").alias("lead"), F.min("comp").alias("comp"))


def ngram_join(docs: DataFrame, n: int = 4, percent: int = 85, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    A document's set holds its distinct n-word shingles (hashed to 128 bits), or the whole word sequence
    if it has fewer words; documents without words have an empty set and no links, their component_id is
    their own id. Two documents link when their Jaccard similarity is at least percent/100. component_id
    is the least doc_id that links lead to. Null texts are empty. Rows with a null id link with nothing
    and have a null component_id. Rows that repeat a doc_id are one document: links of any of its texts
    are its own. Extra columns play no part; an empty table gives no rows. What it returns is read from
    `work`, which a caller may clear once that is written.
    """
    work = work or Workspace(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    p = max(slices(docs), slices_by_size(docs, each=32 << 20))
    scheme = Scheme(percent, docs.count())
    made = work.save(docs.mapInArrow(partial(_index, scheme=scheme, n=n, p=p), INDEXED))
    entries = work.save(made.where("blob IS NOT NULL").select("slice", "blob").groupBy("slice").applyInArrow(grouped(_buckets), MEMBERS))
    rows = work.save(made.where("blob IS NULL").select("id", "n", "lead", "mark", "sketch"))
    work.drop(made)
    # a set's label is the least id of all rows that hold it. Tasks have reduced copies to one leader each.
    lows = rows.where("lead IS NOT NULL").groupBy("lead").agg(F.min("id").alias("low")).withColumnRenamed("lead", "id")
    own = rows.where("mark IS NOT NULL").select("id", "n", "mark", "sketch").dropDuplicates(["id", "mark"]).join(lows, "id")
    own = own.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("id"))).withColumn("label", F.min("low").over(Window.partitionBy("mark")))
    own = work.save(own.select("id", "n", "sketch", "sets", "label"))
    moved = own.where("id != label AND sets = 1").select("id", "label")
    alone = own.where("id != label AND sets > 1")  # ids that lead several sets stay by themselves
    info = work.save(own.select(F.col("label").alias("id"), "n", "sketch").union(alone.select("id", "n", "sketch")).distinct())
    labels = rows.where("lead IS NOT NULL").select("id", "lead").join(moved.withColumnRenamed("id", "lead"), "lead", "left").select("id", "lead", F.coalesce("label", "lead").alias("label"))

    def plausible(edges: DataFrame) -> DataFrame:
        x, y = (info.select(F.col("id").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in info.columns[1:]]) for e in "ab")
        both = edges.join(x, "a").join(y, "b").where(F.lit(100) * F.least("a_n", "b_n") >= F.lit(percent) * F.greatest("a_n", "b_n"))
        both = both.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"), "a_sketch", "b_sketch")
        return both.mapInArrow(partial(_plausible, percent=percent), "a long, b long").distinct()

    def verified(edges: DataFrame) -> DataFrame:
        """The pairs that link, by their whole texts. Only texts that a candidate pair names are shuffled."""
        ids = work.save(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        texts = work.save(only(docs.select(F.col("doc_id").alias("id"), "text").where("id IS NOT NULL"), "id", ids))
        x, y = (texts.select(F.col("id").alias(e), F.col("text").alias(f"{e}_text")) for e in "ab")
        out = work.save(edges.join(x, "a").join(y, "b").select("a", "b", "a_text", "b_text").mapInArrow(partial(_linked, n=n, percent=percent), "a long, b long").distinct())
        work.drop(ids, texts)
        return out

    # first each bucket's least id with each other; most buckets are whole after that. Copies' leaders stand for their labels
    def labelled(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(moved.select(F.col("id").alias(c), F.col("label").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        return df

    pairs = labelled(entries.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "a", "b").where("a != b")
    stars = work.save(plausible(pairs))
    links = verified(stars)
    # an id with several texts leads several sets, or follows several leaders: it joins them
    twice = labels.groupBy("id").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("id")
    same = labels.join(twice, "id", "left_semi").select("id", "label").union(alone.select("id", "label"))
    links = work.save(links.union(same))
    found = components(links, work)
    # then pairs of buckets that still span components, until none is left to verify: no link is lost
    # each round may take WIDER times as many as the one before, so rounds grow as the logarithm of a bucket
    # a bucket without any such pair is done: components only grow
    place = found.withColumnRenamed("id", "node")
    placed = labelled(entries, "id", "lead").join(place, F.col("id") == F.col("node"), "left").select("key", "id", "probe", "lead", F.coalesce("comp", "id").alias("comp"))
    columns = ["key", "id", "probe", "lead", "comp", "n", "sketch", "mark"]
    open_ = work.save(unsettled(placed).join(info, "id").withColumn("mark", F.lit(-(2**63))).select(columns))
    work.drop(entries, stars)
    # each id goes through its partners in their order: the greatest that it has met, of all buckets, says which are left
    width, waiting, ranked = FIRST_WIDTH, links.limit(0), None
    late = waiting.select("a", "b")  # pairs that a slice has offered beyond an id's `width` in all
    while True:
        rows_ = open_.select(F.pmod("key", F.lit(p)).alias("slice"), *columns)
        made = work.save(rows_.groupBy("slice").applyInArrow(grouped(_open_pairs, percent=percent, width=width, rest=True), OFFERED))
        # a set may be in many buckets: in a round it takes `width` pairs of all, the least; the others' turn comes later
        turn = F.row_number().over(Window.partitionBy("a").orderBy("b"))
        old, ranked = ranked, work.save(made.where("a IS NOT NULL").select("a", "b").union(late).distinct().withColumn("turn", turn))
        work.drop(open_, *([old] if old else []))
        taken, late = ranked.where(F.col("turn") <= width).select("a", "b"), ranked.where(F.col("turn") > width).select("a", "b")
        if taken.isEmpty():
            break
        links = verified(taken)
        waiting, n_links = waiting.union(links), links.count()
        open_ = made.where("id IS NOT NULL").drop("a", "b")
        if n_links > FEW_LINKS:
            found = components(waiting.union(found.select(F.col("id").alias("a"), F.col("comp").alias("b"))), work)
            waiting = waiting.limit(0)
            open_ = open_.drop("comp").join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            x, y = (found.select(F.col("id").alias(e), F.col("comp").alias(f"{e}_comp")) for e in "ab")
            late = late.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b")
        # an id that took fewer than `width` has met all
        met = taken.groupBy("a").agg(F.when(F.count(F.lit(1)) == width, F.max("b")).alias("to")).withColumnRenamed("a", "id")
        open_ = work.save(open_.join(met, "id", "left").withColumn("mark", F.coalesce("to", F.lit(2**63 - 1))).select(columns))
        work.drop(made)
        if open_.isEmpty() and late.isEmpty():
            break
        width *= WIDER
    if not waiting.isEmpty():
        found = components(waiting.union(found.select(F.col("id").alias("a"), F.col("comp").alias("b"))), work)
    nodes = labels.select("lead", "label").distinct().join(found.withColumnRenamed("id", "label"), "label", "left").groupBy("lead").agg(F.min(F.coalesce("comp", "label")).alias("component_id"))
    return rows.select("id", "n", "lead").join(nodes, "lead", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; all columns stay. Rows with a null id, with no words, or that repeat the least id of their component all stay."""
    from .quotient import without

    work, own = Workspace(docs.sparkSession, "one-of-each"), Workspace(docs.sparkSession, "ngram-join")
    dropped = work.save(ngram_join(docs, n, percent, own).where("doc_id != component_id").select("doc_id"))
    own.clear()
    return without(docs, "doc_id", dropped)
