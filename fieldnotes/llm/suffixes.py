"""Exact substring dedup with suffix arrays built by two-stage sorting.

A byte goes if a run of LENGTH bytes that covers it also starts in a document with a smaller
key. Suffix arrays decide which runs are equal: in one, only suffixes smaller than their
successors are sorted directly, the others are induced by a scan over the buckets of first
bytes, and neighbours whose common prefix reaches LENGTH are one class, whose smallest key each
of its runs learns. No array holds more than a batch or a bucket's part. Equal runs have the
same smallest hashed K-gram (their anchor) at the same place, which tells where to look:

1. every batch of documents lists its anchors once, and learns which of them other batches have;
2. a suffix array of the batch, over the runs whose anchor several of its documents have, finds
   the repeats within it; around each anchor that others have too, the bytes of the runs it
   stands for (a context) are sent to the anchor's bucket, equal contexts of a batch once (they
   begin and end with runs of the same classes);
3. in a bucket, suffix arrays of contexts that share anchors find the repeats across batches;
4. the batches' documents learn which of their runs have a smaller key elsewhere.

A batch is a bounded number of bytes, so a passage that most documents hold is sent once per
batch, not once per document.

Defined cases: null counts as the empty text; texts shorter than LENGTH keep all; null keys are
larger than all others; rows that repeat a key don't remove each other; texts of any length are
taken whole; an empty table gives an empty one; columns of any name pass through `cut`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._shared import drop, packed, partitions, save, unpacked
from .bpe import gather, raw_bytes
from .minhash import mix

LENGTH = 50
K = 20
BATCH_BYTES = 1_000_000
#: Bytes of contexts in one suffix array (a single anchor's contexts may pass it).
SORT_BYTES = 1_500_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def anchors(raw: np.ndarray, sizes: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: where runs of one anchor begin, how many there are, the anchor's hash and its place.

    A run's anchor is its K-gram of the smallest hash, the first if several have it.
    """
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < length:
        return none, none, np.zeros(0, np.uint64), none
    w = raw.astype(np.uint64)
    w2 = w[:-1] | w[1:] << np.uint64(8)
    w4 = w2[:-2] | w2[2:] << np.uint64(16)
    w8 = w4[:-4] | w4[4:] << np.uint64(32)
    m = n - k + 1
    h = mix((w8[:m] * _C1) ^ (w8[8 : 8 + m] * _C2) + w4[16 : 16 + m] * _C1)
    value = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
    span, have = length - k + 1, 1
    while have * 2 <= span:
        value = np.minimum(value[:-have], value[have:])
        have *= 2
    if have < span:
        value = np.minimum(value[: n - length + 1], value[span - have : span - have + n - length + 1])
    at = (value & np.uint64(0xFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    inside = np.zeros(n + 1, np.int32)  # runs that begin in a text and end in it
    ok = sizes >= length
    np.add.at(inside, (ends - sizes)[ok], 1)
    np.add.at(inside, (ends - length + 1)[ok], -1)
    good = np.cumsum(inside)[: len(at)] > 0
    start = np.flatnonzero(good)
    if not len(start):
        return none, none, np.zeros(0, np.uint64), none
    p = at[start]
    new = np.append(True, (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return start[first], count, h[p[first]], p[first]


def _eights(text: np.ndarray, words: int) -> np.ndarray:
    """At each place the next eight bytes as one number, the first one highest; zeros follow the end."""
    w = np.concatenate([text, np.zeros(words * 8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] << np.uint64(8 * step) | w[step:]
    return w


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors (the end is smaller than all)."""
    n = len(text)
    place = np.arange(n, dtype=np.int32)
    different = np.append(text[:-1] != text[1:], True)
    nearest = np.minimum.accumulate(np.where(different, place, n)[::-1])[::-1]
    out = np.zeros(n, bool)
    inner = nearest < n - 1
    at = nearest[inner]
    out[inner] = text[at] < text[at + 1]
    return out


def _sorted(w: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Places sorted by the bytes that begin there, eight at a time; a later eight only sorts those that agree so far."""
    key = w[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = key[1:] != key[:-1]
    for i in range(1, words):
        tied = np.append(False, ~new) | np.append(~new, False)
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.append(0, np.cumsum(new))[where]
        key = w[at[where] + 8 * i]
        order = np.argsort(key)
        for low in (0, 16) if int(group[-1]) >> 16 else (0,):  # by group, stably
            order = order[np.argsort((group[order] >> low).astype(np.uint16), kind="stable")]
        at[where] = at[where[order]]
        key = key[order]
        same = (group[1:] == group[:-1]) & (key[1:] != key[:-1])
        new[where[1:][same] - 1] = True
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places that are wanted (a boolean per byte), their suffixes sorted by at least the first `depth` bytes, by two-stage sorting."""
    n = len(text)
    if not wanted.any():
        return np.zeros(0, np.int64)
    smaller = _smaller(text)
    # larger suffixes need their successors, up to the next smaller one
    place = np.arange(n, dtype=np.int32)
    last_wanted = np.maximum.accumulate(np.where(wanted, place, -1))
    last_smaller = np.append(-1, np.maximum.accumulate(np.where(smaller, place, -1))[:-1])
    need = last_wanted > last_smaller
    words = -(-depth // 8)
    direct = _sorted(_eights(text, words), np.flatnonzero(need & smaller), words)
    cuts = np.searchsorted(text[direct], np.arange(257))
    larger = need & ~smaller
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if larger[n - 1]:
        waiting[int(text[n - 1])].append(np.array([n - 1]))  # induced by the end
    out = []

    def induce(at: np.ndarray, c: int) -> np.ndarray:
        """List the larger suffixes that come before these under later buckets; those of this bucket are returned."""
        out.append(at)
        p = at[at > 0] - 1
        p = p[larger[p]]
        first = text[p]
        beyond = p[first > c]
        if len(beyond):
            byte = text[beyond]
            order = np.argsort(byte, kind="stable")
            beyond, byte = beyond[order], byte[order]
            for x in np.split(beyond, np.flatnonzero(byte[1:] != byte[:-1]) + 1):
                waiting[int(text[x[0]])].append(x)
        return p[first == c]

    for c in range(256):
        if waiting[c]:
            same = np.concatenate(waiting[c])
            waiting[c] = []
            while len(same):  # runs of one byte induce within the bucket
                same = induce(same, c)
        if cuts[c + 1] > cuts[c]:
            induce(direct[cuts[c] : cuts[c + 1]], c)
    order = np.concatenate(out)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each suffix in order has in common with the one before it, `depth` at most (0 for the first)."""
    words = -(-depth // 8)
    w = _eights(text, words)
    found = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for i in range(words):
        other = w[order[live] + 8 * i] ^ w[order[live - 1] + 8 * i]
        same = other == 0
        found[live[same]] += 8
        x = other[~same]
        # without the bit below each set one, no rounding reaches the next power of two
        found[live[~same]] += 8 - (np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1] + 7) // 8
        live = live[same]
    return np.minimum(found, depth)


def classes(text: np.ndarray, wanted: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """keys: one per wanted place, in order. For every wanted place, in order, the class of the run that begins there, and each class's smallest key."""
    order = suffix_order(text, wanted, length)
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = common_prefixes(text, order, length) < length
    rank = np.cumsum(wanted) - 1
    at = rank[order]
    label = np.empty(len(order), np.int64)
    label[at] = np.cumsum(new) - 1
    return label, np.minimum.reduceat(keys[at], np.flatnonzero(new))


def _bits(flags: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The flags of each context's runs as the bits of one number."""
    ends = np.cumsum(count)
    shift = np.arange(len(flags)) - np.repeat(ends - count, count)
    return np.add.reduceat(flags.astype(np.uint32) << shift.astype(np.uint32), ends - count, dtype=np.uint32) if len(count) else np.zeros(0, np.uint32)


def _joined(keys: list, texts: pa.Array) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """A batch's rows in an order that doesn't depend on how they arrived: row numbers, keys, bytes and sizes."""
    held = texts.to_pylist()
    rows = sorted(range(len(keys)), key=lambda i: (_key(keys[i]), held[i] or ""))
    raw, sizes = raw_bytes(pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(rows, pa.int64())))
    return rows, np.array([_key(keys[i]) for i in rows], np.int64), raw, sizes


def _key(k: int | None) -> int:
    return np.iinfo(np.int64).max if k is None else k


def _segments(raw: np.ndarray, sizes: np.ndarray, length: int, k: int):
    """anchors() of a batch by parts of bounded size; texts larger than a part are cut with an overlap, so that each run is in one part."""
    most = 8_000_000
    ends = np.cumsum(sizes)
    found = []
    i, n = 0, len(sizes)
    while i < n:
        start = int(ends[i] - sizes[i])
        if sizes[i] > most:
            for lo in range(0, int(sizes[i]) - length + 1, most - length + 1):
                part = raw[start + lo : start + min(int(sizes[i]), lo + most)]
                found.append((start + lo, anchors(part, np.array([len(part)]), length, k)))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, start + most, "right")))
        found.append((start, anchors(raw[start : int(ends[j - 1])], sizes[i:j], length, k)))
        i = j
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x[0] + lo for lo, x in found]), np.concatenate([x[1] for _, x in found]), np.concatenate([x[2] for _, x in found])


def _by_bucket(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    b = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    return [(int(b[x[0]]), x) for x in np.split(order, cuts) if len(x)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def _repeats(raw: np.ndarray, start: np.ndarray, count: np.ndarray, h: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's contexts: which have runs with a smaller key in the batch (bits), and an identity (two numbers) that equal contexts share."""
    n = len(start)
    order = np.lexsort((owner, h))
    new = np.append(True, h[order][1:] != h[order][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    several = np.zeros(n, bool)
    several[order] = (last > first)[np.cumsum(new) - 1]
    bits, begin, end = np.zeros(n, np.uint32), -1 - np.arange(n), np.zeros(n, np.int64)
    x = np.flatnonzero(several)
    if len(x):
        x = x[np.argsort(start[x])]
        # only the bytes of these runs, with a separator after each stretch
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, start[x], 1)
        np.add.at(edge, start[x] + count[x] + length - 1, -1)
        cover = np.cumsum(edge)[:-1] > 0
        ends = cover & ~np.append(cover[1:], False)
        to = np.cumsum(cover) + np.cumsum(ends) - ends - 1
        text = np.zeros(int(cover.sum() + ends.sum()), np.uint8)
        text[to[cover]] = raw[cover]
        wanted = np.zeros(len(text), bool)
        wanted[to[gather(start[x], count[x])]] = True
        label, least = classes(text, wanted, np.repeat(owner[x], count[x]), length)
        bits[x] = _bits(least[label] < np.repeat(owner[x], count[x]), count[x])
        ends = np.cumsum(count[x])
        begin[x], end[x] = label[ends - count[x]], label[ends - 1]
    return bits, begin, end


def _least_of_contexts(raw: np.ndarray, count: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """raw: contexts laid end to end, each of count + length - 1 bytes. Which of their runs have a smaller key in another context (bits)."""
    size = count + length - 1
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    text = np.zeros(int(ends[-1]), np.uint8)
    text[gather(starts, size)] = raw
    at = gather(starts, count)
    wanted = np.zeros(len(text), bool)
    wanted[at] = True
    own = np.repeat(keys, count)
    label, least = classes(text, wanted, own, length)
    return _bits(least[label] < own, count)


def spans(docs: DataFrame, make, fields: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, others: list[str] | None = None) -> DataFrame:
    """Find the removed bytes of every document and make columns of them.

    make(raw, gone, sizes): the bytes of some documents laid end to end, a boolean per byte and
    the documents' sizes; it returns an array per field of `fields`. Returns key, row (the
    columns of others, packed) and those fields.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    n_batches = total // BATCH_BYTES + 1
    buckets = max(partitions(spark), total // (4 * BATCH_BYTES) + 1)
    # by the text too, so that rows that repeat a key are not one batch
    dealt = docs.select(F.pmod(F.xxhash64(key, text), F.lit(n_batches)).alias("batch"), F.col(key).alias("key"), F.col(text).alias("text"), packed(others or []).alias("row"))
    bare = dealt.drop("row")
    lists = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("hashes", pa.binary())])

    def listed(group: pa.Table) -> pa.Table:
        batch = group.column("batch")[0].as_py()
        _, _, raw, sizes = _joined(group.column("key").to_pylist(), _flat(group.column("text")))
        h = np.unique(_segments(raw, sizes, length, k)[2])
        return _table([(b, batch, h[x].tobytes()) for b, x in _by_bucket(h, buckets)], lists)

    answers = pa.schema([("batch", pa.int64()), ("hashes", pa.binary())])

    def shared(group: pa.Table) -> pa.Table:
        held = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        every = np.concatenate(held)
        of = np.repeat(np.arange(len(held)), [len(h) for h in held])
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        hit = np.zeros(len(every), bool)
        hit[order] = np.append(False, same) | np.append(same, False)
        ids = group.column("batch").to_pylist()
        at = np.flatnonzero(hit)
        cuts = np.flatnonzero(np.diff(of[at])) + 1
        return _table([(ids[of[x[0]]], every[x].tobytes()) for x in np.split(at, cuts) if len(x)], answers)

    found = save(bare.groupBy("batch").applyInArrow(listed, "bucket long, batch long, hashes binary").groupBy("bucket").applyInArrow(shared, "batch long, hashes binary"))
    shape = "kind int, bucket long, batch long, a binary, b binary, c binary, d binary"
    sent = to_arrow_schema(StructType.fromDDL(shape))

    def contexts(docs_: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return sent.empty_table()
        batch = docs_.column("batch")[0].as_py()
        _, keys, raw, sizes = _joined(docs_.column("key").to_pylist(), _flat(docs_.column("text")))
        start, count, h = _segments(raw, sizes, length, k)
        if not len(start):
            return sent.empty_table()
        owner = keys[np.searchsorted(np.cumsum(sizes), start, "right")]
        bits, begin, end = _repeats(raw, start, count, h, owner, length)
        wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in hits.column("hashes").to_pylist())]))
        cross = np.zeros(len(h), bool)
        if len(wanted):
            i = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            cross = wanted[i] == h
        x = np.flatnonzero(cross)
        wide = 64 * (int(end.max()) + 1)  # of the second number and the count together
        _, rep, entry = np.unique((begin[x] + len(start)) * wide + end[x] * 64 + count[x], return_index=True, return_inverse=True)
        rep = x[rep]
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, entry, owner[x])
        place = np.zeros(len(rep), np.int64)  # of an entry among those sent
        rows, before = [], 0
        for b, e in _by_bucket(h[rep], buckets):
            place[e] = before + np.arange(len(e))
            before += len(e)
            r = rep[e]
            rows.append((0, b, batch, raw[gather(start[r], count[r] + length - 1)].tobytes(), count[r].astype(np.uint8).tobytes(), (h[r] >> np.uint64(32)).astype(np.uint32).tobytes(), least[e].tobytes()))
        order = np.array([b for _, b, *_ in rows], np.int64)
        to = np.full(len(start), -1)
        to[x] = place[entry]
        keep = cross | (bits > 0)
        rows.append((1, -1, batch, start[keep].tobytes(), count[keep].astype(np.uint8).tobytes(), to[keep].tobytes(), bits[keep].tobytes()))
        rows.append((2, -1, batch, order.tobytes(), b"", b"", b""))
        return _table(rows, sent)

    def compared(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        data, runs, h, least = ([x for x in group.column(c).to_pylist()] for c in "abcd")
        count = np.concatenate([np.frombuffer(x, np.uint8) for x in runs]).astype(np.int64)
        anchor = np.concatenate([np.frombuffer(x, np.uint32) for x in h])
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in least])
        raw = np.frombuffer(b"".join(data), np.uint8)
        size = count + length - 1
        begin = np.cumsum(size) - size
        order = np.argsort(anchor, kind="stable")
        new = np.append(True, anchor[order][1:] != anchor[order][:-1])
        # parts of about SORT_BYTES that begin with an anchor's first context
        upto = np.cumsum(size[order]) - size[order]
        part = upto // SORT_BYTES
        part = np.maximum.accumulate(np.where(new, part, 0))
        bits = np.zeros(len(count), np.uint32)
        for x in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            bits[x] = _least_of_contexts(raw[gather(begin[x], size[x])], count[x], keys[x], length)
        ends = np.cumsum([len(x) for x in runs])
        batches = group.column("batch").to_pylist()
        return _table([(3, bucket, b, bits[z - len(x) : z].tobytes(), b"", b"", b"") for b, x, z in zip(batches, runs, ends.tolist(), strict=True)], sent)

    by_batch = bare.groupBy("batch").cogroup(found.groupBy("batch"))
    second = save(by_batch.applyInArrow(contexts, shape))
    drop(found)
    third = save(second.filter("kind = 0").groupBy("bucket").applyInArrow(compared, shape))
    back = second.filter("kind > 0").unionByName(third)
    out = StructType([*dealt.select("key", "row").schema.fields, *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(out)

    def removed(docs_: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return arrow.empty_table()
        rows, _, raw, sizes = _joined(docs_.column("key").to_pylist(), _flat(docs_.column("text")))
        gone = np.zeros(len(raw) + 1, np.int32)
        kinds = notes.column("kind").to_pylist()
        if 1 in kinds:
            a, b, c, d = (notes.column(x)[kinds.index(1)].as_py() for x in "abcd")
            start, count, place, bits = np.frombuffer(a, np.int64), np.frombuffer(b, np.uint8).astype(np.int64), np.frombuffer(c, np.int64), np.frombuffer(d, np.uint32).copy()
            got = {notes.column("bucket")[i].as_py(): notes.column("a")[i].as_py() for i, x in enumerate(kinds) if x == 3}
            order = np.frombuffer(notes.column("a")[kinds.index(2)].as_py(), np.int64)
            answer = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(got[x], np.uint32) for x in order.tolist())])
            x = place >= 0
            bits[x] |= answer[place[x]]
            shift = gather(np.zeros(len(count), np.int64), count).astype(np.uint32)
            at = gather(start, count)[(np.repeat(bits, count) >> shift & np.uint32(1)).astype(bool)]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + length, -1)
        lost = np.cumsum(gone)[:-1] > 0
        held = docs_.select(["key", "row"]).take(pa.array(rows, pa.int64()))
        return pa.Table.from_arrays([*held.columns, *make(raw, lost, sizes)], names=arrow.names).cast(arrow)

    return dealt.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(removed, out)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _runs(gone: np.ndarray) -> int:
    return int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())


def _each(raw: np.ndarray, gone: np.ndarray, sizes: np.ndarray):
    for z, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
        yield raw[z - n : z], gone[z - n : z]


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256."""

    def make(raw: np.ndarray, gone: np.ndarray, sizes: np.ndarray) -> list:
        each = [(len(x), int(g.sum()), _runs(g), hashlib.sha256(x[~g].tobytes()).hexdigest()) for x, g in _each(raw, gone, sizes)]
        return [pa.array(c) for c in zip(*each, strict=True)]

    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return spans(docs, make, fields, key, text, length).drop("row").withColumnRenamed("key", key)


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with the repeated bytes cut out of their text; characters cut in part go whole. A null text becomes the empty one."""
    others = [c for c in docs.columns if c not in (key, text)]

    def make(raw: np.ndarray, gone: np.ndarray, sizes: np.ndarray) -> list:
        return [pa.array([x[~g].tobytes().decode("utf-8", "ignore") for x, g in _each(raw, gone, sizes)], pa.string())]

    out = spans(docs, make, "cut string", key, text, length, others=others)
    return out.select(F.col("key").alias(key), F.col("cut").alias(text), *unpacked("row", others)).select(*[F.col(f"`{c}`") for c in docs.columns])
