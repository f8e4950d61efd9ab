"""Removal of repeated substrings by prefix-free parsing: rolling-hash triggers, a dictionary of phrases, a parse, and the order of both.

A gram of GRAM bytes whose rolling hash is small is a trigger, and text is cut into phrases that reach
from one trigger to the next. A string of `length` bytes belongs to the first trigger in it (one that
holds none to its gram of least hash, so that long phrases have places to meet, too). Before its
trigger stands a suffix of a phrase, after it begins a suffix of the parse, the phrases that follow.
So a string is known by three things: its trigger, the place of the phrase's suffix in the order of
all such suffixes, and the place of the parse's suffix in theirs. Where whole phrases with what follows
them are equal, all places but the first repeat it, and only the first goes on: in highly repetitive
text little does. These first places make the dictionary: for each trigger with several of them, the
suffixes of phrases and of the parse are sorted once each (read away from the trigger, as far as a
string reaches), and both orders combined give each string's class, and the first of the class is the
one that stays.
"""
from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ROOT, ROOT_2, U, chunks, column_of, dealt, grouped, inverses, lean, longs, mix, pack, powers, runs, squeezed, unpack, unsqueezed
from .quotient import bitmap, bitmaps, bitmaps_of, build, in_bitmap, slice_bits
from .workspace import Workspace, slices, slices_by_size

GRAM = 32
EVERY = 32  # one gram in so many is a trigger
CHUNK = 1 << 20
TOGETHER = 1 << 23  # bytes of text whose phrases a task compares before it deals them out
COMMON = 4096  # phrases of a trigger from which on its strings are dealt by their neighbourhood
SORTED = 1 << 13  # phrases whose suffixes are sorted at once
FIRST = -(2**63)


class Parse:
    """Phrases of several texts. Each string of `length` bytes belongs to the first trigger it holds, or else to its gram of least hash, the last of equals. Neighbouring strings share one; together they are what a phrase and the text after it hold."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int):
        n, span = len(data), length - GRAM + 1
        self.data, self.offs, self.length = data, offs, length
        none = np.zeros(0, np.int64)
        self.at, self.low, self.high, self.doc, self.hash = none, none, none, none, np.zeros(0, U)
        if n < length:
            return
        self.sums = self._sums(ROOT)
        grams = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * inverses(n - GRAM + 1))
        # a trigger is known by its place, the first is least; others by their hash, then the last of equals
        bits = U(int(n).bit_length())
        mask, top = (U(1) << bits) - U(1), U(1 << 63)
        place = np.arange(len(grams), dtype=U)
        least = np.where(grams < U(2**64 // EVERY), place, top | (grams >> U(1) >> bits << bits) | (mask - place))
        have = 1
        while have * 2 <= span:  # the least of `span` grams, by doubling
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            many = len(grams) - span + 1
            least = np.minimum(least[:many], least[span - have : span - have + many])
        owner = np.where(least < top, least, mask - (least & mask)).astype(np.int64)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(owner)]
        inside = np.flatnonzero(np.arange(len(owner)) + length <= offs[doc + 1])  # strings that don't leave their text
        if not len(inside):
            return
        owner, doc = owner[inside], doc[inside]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])]))
        self.at, self.doc, self.low = owner[new], doc[new], inside[new]
        self.high = inside[np.concatenate([new[1:], [len(inside)]]) - 1]
        self.hash = grams[self.at]

    def _sums(self, root: int) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * powers(len(self.data), root), out=sums[1:])
        return sums

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each phrase's bytes and of where its trigger stands in it, in two halves."""
        if not len(self.at):
            return self.hash, self.hash
        out = []
        for root, sums in ((ROOT, self.sums), (ROOT_2, self._sums(ROOT_2))):
            whole = (sums[self.high + self.length] - sums[self.low]) * inverses(int(self.low.max()) + 1, root)[self.low]
            out.append(mix(whole ^ mix(((self.at - self.low).astype(U) << U(32)) | (self.high - self.low).astype(U) ^ U(root & 0xFF))))
        return out[0], out[1]

    def second(self) -> np.ndarray:
        """Another hash of each trigger's bytes."""
        sums = self._sums(ROOT_2)
        return mix((sums[self.at + GRAM] - sums[self.at]) * inverses(int(self.at.max(initial=0)) + 1, ROOT_2)[self.at])


TRIGGER_BITS = 40  # of a trigger's hash that travel with a phrase; a clash only sorts more than is needed


def _triggers(g: np.ndarray) -> np.ndarray:
    return g >> U(64 - TRIGGER_BITS)


def _phrase_keys(g: np.ndarray, d: np.ndarray, key_bits: int) -> np.ndarray:
    return mix(g ^ mix(d)) & U(2**key_bits - 1)


def _place_prints(key, doc, low) -> np.ndarray:
    """A fingerprint of a phrase at its place."""
    return mix(key ^ mix(doc.view(U) * U(ROOT) + low.astype(U)))


@lean
def _trigger_filters(batches, length: int, bits: int):
    """Counting quotient filters of all triggers of a partition."""
    found = []
    for batch in batches:
        for _, _, data, offs in chunks(batch, most=CHUNK):
            found.append(mix(Parse(data, offs, length).hash))  # triggers' own hashes are small: they would meet in a few ranges
    yield from build(found, bits)


def _text_mark(text: bytes) -> int:
    """What tells rows apart that repeat a doc_id with other texts."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _dealt(parts: list[tuple], slice_of, p: int, kind: int):
    """Rows (slice, kind, blob) of columns dealt by slice."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order, cuts = dealt(slice_of(*columns), p)
    return [(int(k), kind, squeezed(pack(*(x[order[cuts[k] : cuts[k + 1]]] for x in columns)))) for k in np.flatnonzero(np.diff(cuts))]


def _by_doc(p: int):
    return lambda doc, *_: (mix(doc.view(U)) % U(p)).astype(np.int64)


def _small(length: int):
    """The type of places within a phrase."""
    return np.uint8 if length - GRAM < 256 else np.uint32


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["slice", "kind", "blob"])


def _merged(doc, mark, a, b) -> tuple[np.ndarray, ...]:
    """Runs of each document, merged where they touch."""
    order = np.lexsort((a, mark, doc))
    doc, mark, a, b = doc[order], mark[order], a[order].astype(np.int64), b[order].astype(np.int64)
    if not len(doc):
        return doc, mark, a, b
    own = np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    group = (np.cumsum(own) - 1) << 40
    reach = np.maximum.accumulate(b + group)  # the furthest end so far in the document
    new = own.copy()
    new[1:] |= (a + group)[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(a)]]) - 1
    return doc[begin], mark[begin], a[begin], reach[end] - group[begin]


def _covered(again, doc, mark, low, high, length):
    doc, mark, a, b = _merged(doc[again], mark[again], low[again], high[again] + length)
    return doc, mark, a.astype(np.uint32), b.astype(np.uint32)


@lean
def _parse(batches, length: int, known, p: int, key_bits: int):
    """The parse: occurrences of phrases whose trigger isn't certainly unique. Of those that a task has met several times together, the first goes on (kind 0) and the others are covered already (kind 1)."""
    whole = np.frombuffer(known.value, np.uint8)
    held, size = [], 0

    def put():
        key, other, t, doc, mark, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((low, doc, other, key))
        key, other, t, doc, mark, low, high = (x[order] for x in (key, other, t, doc, mark, low, high))
        entry = np.concatenate([[True], (key[1:] != key[:-1]) | (other[1:] != other[:-1])])
        first = np.flatnonzero(entry)[np.cumsum(entry) - 1]
        again = (doc != doc[first]) | (low != low[first])
        t = t[~again]
        parts = (key[~again], other[~again], t.astype(np.uint32), (t >> U(32)).astype(np.uint8), doc[~again], mark[~again], low[~again].astype(np.uint32), (high - low)[~again].astype(_small(length)))
        out = _dealt([parts], lambda key, *_: (key % U(p)).astype(np.int64), p, 0)
        if again.any():
            out += _dealt([_covered(again, doc, mark, low, high, length)], _by_doc(p), p, 1)
        return _rows(out)

    for batch in batches:
        every = longs(batch, "doc_id")
        for at, rows, data, offs in chunks(batch, most=CHUNK):
            x = Parse(data, offs, length)
            keep = in_bitmap(mix(x.hash), whole)
            if not keep.any():
                continue
            doc, (one, other) = x.doc[keep], x.digests()
            held.append((_phrase_keys(x.hash[keep], one[keep], key_bits), other[keep], _triggers(x.hash[keep]), every[at : at + rows][doc], _marks(data, offs)[doc], x.low[keep] - offs[doc], x.high[keep] - offs[doc]))
            size += len(data)
            if size >= TOGETHER:
                yield put()
                held, size = [], 0
    if held:
        yield put()


def _marks(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.array([_text_mark(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)], np.int64)


FIRSTS = "slice int, kind int, blob binary, trigger long, fp long"


def _unpacked(table: pa.Table, kind: int, n: int) -> list[np.ndarray]:
    kinds = table.column("kind").to_numpy()
    blobs = [x.as_buffer() for c in table.column("blob").chunks for x in c]
    parts = [unpack(unsqueezed(b)) for k, b in zip(kinds, blobs, strict=True) if k == kind]
    return [np.concatenate([x[i] for x in parts]) for i in range(n)] if parts else []


def _repeated(table: pa.Table, length: int, p: int) -> pa.Table:
    """What later places of each phrase cover, by document, and the first place of each: its trigger and fingerprint."""
    out, fps, triggers = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob")
    if found := _unpacked(table, 0, 8):
        key, other, t, t_high, doc, mark, low, more = found
        t, low, more = t.astype(U) | (t_high.astype(U) << U(32)), low.astype(np.int64), more.astype(np.int64)
        order = np.lexsort((low, doc, other, key))
        key, other, t, doc, mark, low, more = (x[order] for x in (key, other, t, doc, mark, low, more))
        entry = np.concatenate([[True], (key[1:] != key[:-1]) | (other[1:] != other[:-1])])
        first = np.flatnonzero(entry)
        lead = first[np.cumsum(entry) - 1]
        again = (doc != doc[lead]) | (low != low[lead])
        if again.any():
            out = _dealt([_covered(again, doc, mark, low, low + more, length)], _by_doc(p), p, 1)
        fps, triggers = _place_prints(key[first], doc[first], low[first]).view(np.int64), mix(t[first]).view(np.int64)
    slices_ = table.column("slice").to_pylist()
    out += [(k, 1, blobs[i].as_py()) for i, k in enumerate(slices_) if kinds[i] == 1]
    n, m = len(out), len(fps)
    return pa.table({"slice": pa.array([x[0] for x in out] + [-1] * m, pa.int32()), "kind": pa.array([1] * n + [2] * m, pa.int32()), "blob": pa.concat_arrays([pa.array([x[2] for x in out], pa.binary()), pa.nulls(m, pa.binary())]), "trigger": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(triggers)]), "fp": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(fps)])})


@lean
def _dictionary(batches, length: int, firsts, several, common, p: int, key_bits: int):
    """The dictionary: the bytes of phrases at their first place, where a trigger has several phrases.

    A phrase goes to its trigger's slice. Where a trigger has very many phrases (a common line), its
    strings are dealt by what stands next to the trigger: those that reach HALF bytes to the right of
    it by these bytes, the others by the HALF bytes to its left, which they all hold.
    """
    a, b, c = (np.frombuffer(x.value, np.uint8) for x in (firsts, several, common))
    half = (length - GRAM) // 2
    for batch in batches:
        every = longs(batch, "doc_id")
        for at, rows, data, offs in chunks(batch, most=CHUNK):
            x = Parse(data, offs, length)
            keep = np.flatnonzero(in_bitmap(mix(_triggers(x.hash)), b))
            if not len(keep):
                continue
            doc = x.doc[keep]
            ids = every[at : at + rows][doc]
            low = x.low[keep] - offs[doc]
            keep = keep[in_bitmap(_place_prints(_phrase_keys(x.hash[keep], x.digests()[0][keep], key_bits), ids, low), a)]
            if not len(keep):
                continue
            doc, g, at_, lo, hi, second = x.doc[keep], x.hash[keep], x.at[keep], x.low[keep], x.high[keep], x.second()[keep]
            many = in_bitmap(mix(_triggers(g)), c)
            # strings that begin at most `cut` before the trigger hold HALF bytes after it
            cut = at_ - (length - GRAM - half)
            parts = [(g, lo, hi, np.flatnonzero(~many)), ]
            right = np.flatnonzero(many & (hi >= cut))
            left = np.flatnonzero(many & (lo < cut))
            span = lambda s, e: (x.sums[e] - x.sums[s]) * inverses(int(s.max(initial=0)) + 1)[s]
            if len(right):
                e = at_[right] + GRAM
                parts.append((mix(g[right] ^ mix(span(e, e + half))), np.maximum(lo, cut)[right], hi[right], right))
            if len(left):
                e = at_[left]
                parts.append((mix(g[left] ^ mix(span(e - half, e) + U(1))), lo[left], np.minimum(hi, cut - 1)[left], left))
            out, marks = [], _marks(data, offs)
            for key, s, e, who in parts:
                if not len(who):
                    continue
                if len(key) != len(who):
                    key, s, e = key[who], s[who], e[who]
                order, cuts = dealt((key % U(p)).astype(np.int64), p)
                for k in np.flatnonzero(np.diff(cuts)):
                    o = order[cuts[k] : cuts[k + 1]]
                    gram = at_[who[o]]  # its bytes stay behind: two hashes stand for them
                    texts = b"".join(data[s[i] : q].tobytes() + data[q + GRAM : e[i] + length].tobytes() for i, q in zip(o, gram, strict=True))
                    w = doc[who[o]]
                    columns = (key[o], second[who[o]], every[at : at + rows][w], marks[w], (s[o] - offs[w]).astype(np.uint32), (e[o] - s[o]).astype(_small(length)), (gram - s[o]).astype(_small(length)))
                    out.append((int(k), 0, squeezed(pack(*columns, np.frombuffer(texts, np.uint8)))))
            yield _rows(out)


def _sorted(table: pa.Table, length: int, p: int) -> pa.Table:
    """Sorts the dictionary's suffixes and those of the parse, and returns what each phrase's first place repeats of others that are earlier."""
    key, second, doc, mark, low, more, back, text = _unpacked(table, 0, 8)
    low, more, back, rest = low.astype(np.int64), more.astype(np.int64), back.astype(np.int64), length - GRAM
    begin = np.cumsum(more + rest) - (more + rest)  # in the text
    order = np.lexsort((low + back, doc, second, key))  # within a trigger, by where it stands
    key, second, doc, mark, low, more, back, begin = (x[order] for x in (key, second, doc, mark, low, more, back, begin))
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (second[1:] != second[:-1])])
    group = np.cumsum(fresh) - 1
    out = []
    for a, b in _blocks(np.flatnonzero(fresh), len(key), SORTED):
        if b - a < 2:
            continue
        x = slice(a, b)
        first, last = _repeats(text, begin[x], back[x], more[x], group[x], doc[x], low[x], rest)
        some = np.flatnonzero(first <= last)
        if len(some):
            # strings of a phrase begin within one another's reach, so what they cover is one run
            s = low[x][some]
            out.append((doc[x][some], mark[x][some], (s + first[some]).astype(np.uint32), (s + last[some] + length).astype(np.uint32)))
    return pa.Table.from_batches([_rows(_dealt(out, _by_doc(p), p, 1) if out else [])])


def _blocks(starts: np.ndarray, n: int, most: int):
    """Runs of whole groups, of about `most` members; a larger group is a run of its own."""
    a = 0
    bounds = [*starts.tolist(), n]
    for k in range(1, len(bounds)):
        if k == len(bounds) - 1 or bounds[k + 1] - a > most:
            yield a, bounds[k]
            a = bounds[k]


def _ordered(text: np.ndarray, begin: np.ndarray, step: int, size: np.ndarray, most: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings that are read from `begin` in steps of 1 or -1, within their groups. Returns the order, and how many bytes each shares with the one before it in that order (-1 in another group)."""
    width = -(-max(most, 1) // 8) * 8
    k = np.arange(width)
    held = np.minimum(size, most)
    index = begin[:, None] + step * k
    inside = k < held[:, None]
    bytes_ = np.where(inside, text[np.where(inside, index, 0)], 0).astype(np.uint8)
    columns = np.ascontiguousarray(bytes_).view(">u8").astype(U)
    order = np.lexsort((held, *columns.T[::-1], group))
    rows, held, group = bytes_[order], held[order], group[order]
    unlike = rows[1:] != rows[:-1]
    same = np.where(unlike.any(1), unlike.argmax(1), width)
    common = np.minimum(same, np.minimum(held[1:], held[:-1]))
    return order, np.concatenate([[-1], np.where(group[1:] == group[:-1], common, -1)])


def _repeats(text, begin, back, more, group, doc, low, rest) -> tuple[np.ndarray, np.ndarray]:
    """The first and last string of each phrase that another place holds earlier (first over last: none). Phrases stand in groups by trigger, within them by place.

    String k of a phrase has back - k bytes before the trigger and the others after it. Two strings of a group are equal if they have
    equally many before it, and the phrases' suffixes and the parse's suffixes agree that far: each is a run in its order.
    """
    n = len(begin)
    left, l_common = _ordered(text, begin + back - 1, -1, back, rest, group)
    right, r_common = _ordered(text, begin + back, 1, more + rest - back, rest, group)
    l_place, r_place = np.empty(n, np.int64), np.empty(n, np.int64)
    l_place[left], r_place[right] = np.arange(n), np.arange(n)
    l_next, r_next = np.append(l_common[1:], -1), np.append(r_common[1:], -1)
    # how far a phrase agrees with any other on either side
    l_most, r_most = np.maximum(l_common, l_next)[l_place], np.maximum(r_common, r_next)[r_place]
    first, last = np.full(n, 1 << 40), np.full(n, -1)
    at = np.arange(n)
    for before in range(rest + 1):
        use = np.flatnonzero((before <= back) & (before >= back - more) & (l_most >= before) & (r_most >= rest - before))
        if len(use) < 2:
            continue
        l_class = np.maximum.accumulate(np.where(l_common < before, at, 0))[l_place[use]]
        r_class = np.maximum.accumulate(np.where(r_common < rest - before, at, 0))[r_place[use]]
        pair = l_class * n + r_class
        o = np.argsort(pair, kind="stable")  # `use` is in order of place
        new = np.concatenate([[True], pair[o][1:] != pair[o][:-1]])
        lead = use[o][np.flatnonzero(new)[np.cumsum(new) - 1]]
        who = use[o]
        step = back - before
        later = (doc[who] != doc[lead]) | (low[who] + step[who] != low[lead] + step[lead])
        who = who[later]
        np.minimum.at(first, who, step[who])
        np.maximum.at(last, who, step[who])
    return first, last


def _by_document(table: pa.Table) -> pa.Table:
    """Each document's removed runs, merged where they touch."""
    doc, mark, lo, hi = _merged(*_unpacked(table, 1, 4))
    own = np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]) if len(doc) else np.zeros(0, bool)
    firsts = np.flatnonzero(own)
    pairs = np.stack([lo, hi], 1).astype("<u4")
    cuts = [*firsts.tolist(), len(doc)]
    return pa.table({"doc_id": pa.array(doc[firsts]), "mark": pa.array(mark[firsts]), "spans": pa.array([pairs[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _parts(batch: pa.RecordBatch, known, hits: bool):
    """Rows of a batch whose fp hits the bitmap, or the others, some megabytes at a time."""
    whole = np.frombuffer(known.value, np.uint8)
    for at, rows, _, _ in chunks(batch):
        part = batch.slice(at, rows)
        yield part.filter(pa.array(in_bitmap(longs(part, "fp").view(U), whole) == hits, pa.bool_()))


@lean
def _marked(batches, known):
    """doc_id, text, mark of rows that may lose bytes."""
    for batch in batches:
        for part in _parts(batch, known, True):
            marks = [m for _, _, data, offs in chunks(part) for m in _marks(data, offs).tolist()]
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), column_of(part, "text"), pa.array(marks, pa.int64())], ["doc_id", "text", "mark"])


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _without_spans(batch: pa.RecordBatch, spans: pa.Array):
    """doc_id, n_bytes, n_removed, n_spans, kept bytes, some megabytes of text at a time."""
    ids = column_of(batch, "doc_id")
    for at, rows, data, offs in chunks(batch):
        out: list[list] = [[], [], [], []]
        for k, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True), at):
            text = data[a:b].tobytes()
            cuts = np.frombuffer(spans[k].as_buffer(), "<u4").reshape(-1, 2).tolist() if spans[k].is_valid else []
            kept, end = [], 0
            for x, y in cuts:
                kept.append(text[end:x])
                end = y
            kept = b"".join([*kept, text[end:]])
            for column, x in zip(out, (len(text), len(text) - len(kept), len(cuts), kept), strict=True):
                column.append(x)
        n, removed, runs_, kept = out
        yield pa.RecordBatch.from_arrays([ids.slice(at, rows), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


@lean
def _whole(batches, known):
    """Rows that certainly lose nothing."""
    for batch in batches:
        for part in _parts(batch, known, False):
            yield from _without_spans(part, pa.nulls(part.num_rows, pa.binary()))


@lean
def _cut(batches):
    for batch in batches:
        yield from _without_spans(batch, column_of(batch, "spans"))


def _parted(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of docs that certainly lose nothing; and the other rows with their marks: only these meet their spans. A task has one worker, which tells them apart itself."""
    known = bitmap(spans.select(F.xxhash64("doc_id").alias("fp")), repeated=False)
    docs = docs.withColumn("fp", F.xxhash64(F.coalesce("doc_id", F.lit(FIRST))))
    return docs.mapInArrow(partial(_whole, known=known), CUT), docs.mapInArrow(partial(_marked, known=known), "doc_id long, text string, mark long")


def substring_dedup(docs: DataFrame, length: int = 100, key_bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for each row.

    Every byte goes that is covered by a string of `length` bytes which also starts earlier: in a
    smaller doc_id, or in the same document before. Texts are UTF-8; null is empty. Strings never
    cross documents, may overlap, and are judged on the input. Rows that repeat a doc_id with the same
    text are one document: neither starts earlier; rows that repeat it with other texts compare by
    where strings start. Null ids count as the smallest long. length must be over GRAM. key_bits: of a phrase's
    128 bits, how many of the first half deal it out; equal phrases agree in these and in the whole second half.
    An empty table gives no rows; extra columns play no part.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substring-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    p = max(slices(docs), slices_by_size(docs, each=16 << 20))
    bits = slice_bits(docs)
    made = docs.select("text").mapInArrow(partial(_trigger_filters, length=length, bits=bits), "slice int, filter binary")
    [known] = bitmaps_of(spark, made, bits, 2)
    packed = "slice int, kind int, blob binary"
    parsed = docs.mapInArrow(partial(_parse, length=length, known=known, p=p, key_bits=key_bits), packed)
    found = work.save(parsed.groupBy("slice").applyInArrow(grouped(_repeated, length=length, p=p), FIRSTS))
    known.unpersist()
    covered, first = found.where("kind = 1").select("slice", "kind", "blob"), found.where("kind = 2")
    of_trigger = first.select(F.col("trigger").alias("fp"))
    firsts, (several, common) = bitmap(first.select("fp"), repeated=False), bitmaps(of_trigger, 2, COMMON)
    dictionary = docs.mapInArrow(partial(_dictionary, length=length, firsts=firsts, several=several, common=common, p=p, key_bits=key_bits), packed)
    more = dictionary.groupBy("slice").applyInArrow(grouped(_sorted, length=length, p=p), packed)
    spans = work.save(covered.unionByName(more).groupBy("slice").applyInArrow(grouped(_by_document), "doc_id long, mark long, spans binary"))
    work.drop(found)
    for bits_ in (firsts, several, common):
        bits_.unpersist()
    whole, texts = _parted(docs, spans)
    spans = spans.select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), "spans")
    key = F.coalesce("doc_id", F.lit(FIRST))
    joined = texts.join(spans, (key == F.col("of")) & (F.col("mark") == F.col("of_mark")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, CUT).unionByName(whole)
