"""MinHash near-duplicates by fast similarity sketching.

A document's set holds the hashes of its distinct shingles. Its sketch has SKETCH coordinates
filled in rounds: in round r < SKETCH every element is thrown into one coordinate by that
round's hash, and a coordinate that is still empty keeps its smallest hash; in the rounds
after that, round SKETCH + i fills coordinate i with the smallest hash of all elements. So
every coordinate fills, and two sets agree in a coordinate with probability equal to their
Jaccard similarity, with strong concentration. Bands of ROWS coordinates make the candidates:
at similarity 0.75 a pair shares no band with probability (1 - 0.75^4)^32, about 5e-6.

Rows of equal words (by SHA-256 of the words in order) are one class. Links between classes are
confirmed on full texts, word for word. Every bucket (a
band's value) first compares its members with its pivot, the member that shares most buckets
with others. The buckets that still span components and whose pivots are in one component form
a family. Its open members, those outside that component, are compared with all its members on
their full sets, in blocks of bounded size; a block answers with links that join components,
never with all pairs. So every link a bucket offers is found in one more step, and the rows
grow with the members, at most BLOCKS times.

A family with more open members than that is dealt anew by its core C, the shingles that half
of its members have. Texts x and y can be linked only if both share with C what they have to
share with each other, or if they share enough shingles outside C. A member x that C alone
can't link (far) is therefore looked up by its rarest shingles outside C, enough of them that a
partner must have one: these become new buckets, of less than half the size each, which are
families of their own where their union is too large again. The others (near) are looked up by
all of theirs, and compared with the members nearest to C; where some stay open, their family is
compared in as many blocks as it takes.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing;
fewer words than a shingle has are one shingle; repeated rows have equal words, so one class;
texts of any length are taken whole; null and repeated keys, see groups and deduplicate; an
empty table gives an empty one; columns of any name pass through deduplicate unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import drop, packed, releasing, save, tasks, unpacked
from .bpe import batches, gather
from .graph import components

SHINGLE = 5
SKETCH = 128
ROWS = 4
#: A member near to the core of a family is compared with so many of those nearest to it.
SMALL = 16
#: Open members and members of a block, and shingles of either.
ASK_BLOCK, MEMBER_BLOCK, SHINGLE_BLOCK = 1024, 4096, 2_000_000
#: A family whose open members fill more blocks than this is dealt anew.
BLOCKS = 8
BATCH_BYTES = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
#: Seed of the hashes of words.
SEED = 0x5EED


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_lists(texts: pa.Array) -> pa.Array:
    """The words of each text; a blank one has a single empty word."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))


def word_hashes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes (XXH3) of all words (A-Z lower-cased), text after text, and how many each text has."""
    coded = lists.flatten().dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w.lower(), SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    code = coded.indices.to_numpy(zero_copy_only=False)
    count = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    empty = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) == 0)[code] if len(code) else np.zeros(0, bool)
    of = np.repeat(np.arange(len(count)), count)
    count = count - np.bincount(of[empty], minlength=len(count))
    return each[code[~empty]] if len(code) else np.zeros(0, np.uint64), count


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    return _sets_of(word_lists(texts), k)


def _sets_of(lists: pa.Array, k: int) -> list[np.ndarray]:
    h, count = word_hashes(lists)
    starts = np.cumsum(count) - count
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            s = mix(s * _P + h[i : len(h) - k + 1 + i])
    out = []
    for a, n in zip(starts.tolist(), count.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(s[a : a + n - k + 1]))
        elif n:
            x = np.array([n], np.uint64)
            for w in h[a : a + n]:
                x = mix(x * _P + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int = SKETCH) -> np.ndarray:
    """One row of t filled coordinates per set; zeros for an empty set."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum(size) - size
    empty = np.uint64(2**64 - 1)
    out = np.full((len(sets), t), empty, np.uint64)
    live = np.flatnonzero(size > 0)
    for r in range(2 * t):
        if not len(live):
            break
        of = np.repeat(live, size[live])
        h = mix(flat[gather(starts[live], size[live])] + np.uint64((r + 1) * int(_P) % 2**64))
        at = (h % np.uint64(t)).astype(np.int64) if r < t else np.full(len(h), r - t)
        if r:  # only coordinates that were empty before this round
            free = out[of, at] == empty
            of, at, h = of[free], at[free], h[free]
        np.minimum.at(out.reshape(-1), of * t + at, h)
        live = live[(out[live] == empty).any(1)]
    out[size == 0] = 0
    return out


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, t = sketch.shape
    x = np.zeros((n, t // rows), np.uint64) + np.arange(t // rows, dtype=np.uint64)
    for i in range(rows):
        x = mix(x * _P + sketch[:, i::rows])
    return x.view(np.int64)


def shingles(text: str | None, k: int = SHINGLE) -> set:
    """The full shingle set, of words themselves."""
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def signatures(rows: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Add to rows (text, ...) n_shingles, words_key (SHA-256 of the words in order, null without words), text_key (that of the text itself) and bands."""

    def run(it):
        for b in it:
            t = b.column(b.schema.get_field_index("text"))
            for s, z in batches(t, BATCH_BYTES):
                part = t.slice(s, z - s)
                lists = word_lists(part)
                sets = _sets_of(lists, k)
                marks = bands(sketches(sets))
                n = np.array([len(x) for x in sets], np.int64)
                held = part.cast(pa.binary()).to_pylist()
                # on bytes, lower() and split() know just A-Z and the white space between words
                words = [hashlib.sha256(b" ".join(w)).digest() if x and (w := x.lower().split()) else None for x in held]
                whole = [None if x is None else hashlib.sha256(x).digest() for x in held]
                col = pa.ListArray.from_arrays(pa.array(np.arange(0, marks.size + 1, marks.shape[1]), pa.int32()), pa.array(marks.reshape(-1)))
                more = [pa.array(n), pa.array(words, pa.binary()), pa.array(whole, pa.binary()), col]
                yield pa.RecordBatch.from_arrays([*b.slice(s, z - s).columns, *more], [*b.schema.names, "n_shingles", "words_key", "text_key", "bands"])

    more = StructType.fromDDL("n_shingles long, words_key binary, text_key binary, bands array<long>")
    return rows.mapInArrow(releasing(run), StructType([*rows.schema.fields, *more.fields]))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = 75, k: int = SHINGLE) -> DataFrame:
    """pairs: a, b; texts: id, text. The pairs whose full sets have 100 * shared >= percent * all."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(it):
        last, held = None, set()
        for batch in it:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i in range(len(a)):
                x = shingles(batch.column(2)[i].as_py(), k)
                if b[i] != last:
                    last, held = b[i], shingles(batch.column(3)[i].as_py(), k)
                shared = len(x & held)
                keep.append(bool(x) and 100 * shared >= percent * (len(x) + len(held) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return two.select("a", "b", "ta", "tb").mapInArrow(releasing(run), "a long, b long")


def _sets(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """members: f, id. Rows (f, id, s): the set of shingle hashes of each member."""

    def run(it):
        for batch in it:
            t = batch.column(2)
            for s, z in batches(t, BATCH_BYTES):
                sets = shingle_sets(t.slice(s, z - s), k)
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, z - s), batch.column(1).slice(s, z - s), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["f", "id", "s"])

    return members.join(texts, "id").select("f", "id", "text").mapInArrow(releasing(run), "f long, id long, s array<long>")


def _labelled(df: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Add comp, the component of id."""
    return df.withColumn("comp", F.col("id")) if comp is None else df.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _open_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs (a > b) of one family, in different components; y has a bounded number of rows a family."""
    other = y.select("f", *[F.col(c).alias(f"y_{c}") for c in y.columns if c != "f"])
    two = x.join(other, "f").filter(F.col("comp") != F.col("y_comp"))
    return two.select(F.greatest("id", "y_id").alias("a"), F.least("id", "y_id").alias("b")).distinct()


def _links_of_block(percent: int):
    """Of one block (rows f, qi, mj, id, comp, ask, s): links between open and other members that join the components in it."""

    def run(t: pa.Table) -> pa.Table:
        ask = t["ask"].to_numpy().astype(bool)
        ids, comps = t["id"].to_numpy(), t["comp"].to_numpy()
        sets = t["s"].combine_chunks()
        size = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, row = sets.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), size)
        q, m = np.flatnonzero(ask), np.flatnonzero(~ask)
        rank = np.cumsum(ask) - 1
        rank[m] = np.arange(len(m))
        asked = ask[row]
        vocabulary, qc = np.unique(flat[asked], return_inverse=True)
        qr, mr, mc = rank[row[asked]], rank[row[~asked]], np.searchsorted(vocabulary, flat[~asked])
        known = mc < len(vocabulary)
        known[known] = vocabulary[mc[known]] == flat[~asked][known]
        mr, mc = mr[known], mc[known]
        order = np.argsort(mc, kind="stable")
        mr, mc = mr[order], mc[order]
        nq, nm = np.bincount(qc, minlength=len(vocabulary)), np.bincount(mc, minlength=len(vocabulary))
        begin = np.cumsum(nm) - nm
        shared = np.zeros((len(q), len(m)), np.int64)
        # frequent shingles by a product of matrices, the others by their lists
        often = 64 * nq * nm >= max(4096, len(q) * len(m))
        for at in np.array_split(np.flatnonzero(often), -(-int(often.sum()) // 2048) or 1):
            to = np.full(len(vocabulary), -1)
            to[at] = np.arange(len(at))
            x, y = np.zeros((len(q), len(at)), np.float32), np.zeros((len(m), len(at)), np.float32)
            x[qr[to[qc] >= 0], to[qc[to[qc] >= 0]]] = 1
            y[mr[to[mc] >= 0], to[mc[to[mc] >= 0]]] = 1
            shared += (x @ y.T).astype(np.int64)
        seldom = ~often[qc]
        r, c = qr[seldom], qc[seldom]
        turn = np.cumsum(nm[c]) // 4_000_000
        for cut in np.split(np.arange(len(c)), np.flatnonzero(np.diff(turn)) + 1):
            at = np.repeat(r[cut], nm[c[cut]]) * len(m) + mr[gather(begin[c[cut]], nm[c[cut]])]
            shared += np.bincount(at, minlength=shared.size).reshape(shared.shape)
        linked = (100 + percent) * shared >= percent * (size[q][:, None] + size[m][None, :])
        linked &= comps[q][:, None] != comps[m][None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        out = []
        for i in np.flatnonzero(linked.any(1)).tolist():
            partners = m[np.flatnonzero(linked[i])]
            for j in partners[np.unique(comps[partners], return_index=True)[1]].tolist():
                x, y = find(int(comps[q[i]])), find(int(comps[j]))
                if x != y:
                    root[x] = y
                    out.append((max(ids[q[i]], ids[j]), min(ids[q[i]], ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _in_blocks(families: DataFrame, texts: DataFrame, percent: int, k: int, blocks: int | None, n: int, n_text: int) -> tuple[DataFrame, DataFrame]:
    """families: f, p, id, comp, size. Confirmed links that join the components of each family, and the families (f, p) that have open members for more blocks than `blocks` (None: none are too many)."""
    open_ = F.col("comp") != F.col("p")
    per = families.groupBy("f", "p").agg(
        F.count_if(open_).alias("q"), F.sum(F.when(open_, F.col("size")).otherwise(0)).alias("qs"), F.count(F.lit(1)).alias("m"), F.sum("size").alias("ms")
    )
    up = lambda rows, most, sizes: F.greatest(F.lit(1), F.ceil(F.col(rows) / F.lit(most)), F.ceil(F.col(sizes) / F.lit(SHINGLE_BLOCK))).cast("int")
    per = save(per.select("f", "p", up("q", ASK_BLOCK, "qs").alias("qb"), up("m", MEMBER_BLOCK, "ms").alias("mb")), n)
    fits = F.lit(True) if blocks is None else F.col("qb") <= blocks
    fit = save(families.join(per.filter(fits).select("f", "qb", "mb"), "f"), n)
    sets = save(_sets(fit.select(F.lit(0).cast("long").alias("f"), "id").distinct(), texts, k).select("id", "s"), n_text)
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = fit.select("f", every("qb").alias("qi"), own("mb").alias("mj"), "id", "comp", F.lit(False).alias("ask"))
    asking = fit.filter(open_).select("f", own("qb").alias("qi"), every("mb").alias("mj"), "id", "comp", F.lit(True).alias("ask"))
    rows = members.unionByName(asking).join(sets, "id").select("f", "qi", "mj", "id", "comp", "ask", "s")
    found = save(rows.groupBy("f", "qi", "mj").applyInArrow(_links_of_block(percent), "a long, b long"), n_text)
    links = save(confirm(found.distinct(), texts, percent, k), n_text)
    drop(fit, sets, found)
    return links, per.filter(~fits).select("f", "p")


def _deal_anew(families: DataFrame, texts: DataFrame, comp: DataFrame | None, percent: int, k: int, small: int, n: int) -> tuple[DataFrame, DataFrame | None]:
    """families: f, p, id; p is the component of the family's pivot. New buckets (id, f, s) of far members and those who share their shingles, and labels after the near ones' links."""
    each = save(_sets(families.select("f", "id"), texts, k).select("f", "id", F.explode("s").alias("s")), n)
    mains = save(families.select("f", "p").distinct(), n)
    n = tasks(each)
    size = save(families.groupBy("f").agg(F.count(F.lit(1)).alias("m")), n)
    counts = save(each.groupBy("f", "s").agg(F.count(F.lit(1)).alias("c")).join(size, "f").withColumn("core", 2 * F.col("c") >= F.col("m")).select("f", "s", "c", "core"), n)
    marked = save(each.join(counts, ["f", "s"]), n)
    per = save(marked.groupBy("f", "id").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("shared")), n)
    least = save(per.groupBy("f").agg(F.min("n").alias("least")), n)
    labelled = save(_labelled(per, comp).join(mains, "f"), n)
    # what a member has to share with the smallest partner, without what the core gives
    lack = F.ceil(F.lit(percent) * (F.col("n") + F.col("least")) / F.lit(100.0 + percent)) - F.col("shared")
    rest = save(labelled.filter("comp <> p").join(least, "f").withColumn("lack", lack), n)
    # near members too: with a larger partner they may need a shingle outside the core
    own, must = F.col("n") - F.col("shared"), F.greatest(F.col("lack"), F.lit(1))
    far = save(rest.filter(own >= must).select("f", "id", (own - must + 1).alias("first")), n)
    w = Window.partitionBy("f", "id").orderBy("c", "s")
    looked_up = marked.filter(~F.col("core")).join(far, ["f", "id"]).withColumn("i", F.row_number().over(w)).filter((F.col("i") <= F.col("first")) & (F.col("c") > 1))
    keys = save(looked_up.select("f", "s").distinct(), n)
    again = save(marked.filter(~F.col("core") & (F.col("c") > 1)).join(keys, ["f", "s"]).select("id", "f", "s"), n)
    near = save(rest.filter("lack <= 0").select("f", "p", "id", "n", "shared", "comp"), n)
    if not near.isEmpty():
        top = Window.partitionBy("f").orderBy(F.desc("shared"), "n", "id")
        best = save(labelled.withColumn("i", F.row_number().over(top)).filter(F.col("i") <= small).drop("i", "p"), n)
        links = save(confirm(save(_open_pairs(near, best), n), texts, percent, k), 3 * n)
        comp = _merge(comp, links, n) if not links.isEmpty() else comp
        left = save(_labelled(near.drop("comp"), comp).join(_labelled(near.select(F.col("p").alias("id")).distinct(), comp).select(F.col("id").alias("p"), F.col("comp").alias("main")), "p").filter("comp <> main").drop("main"), n)
        if not left.isEmpty():  # their families whole, in as many blocks as it takes
            main = _labelled(mains.select("f", F.col("p").alias("id")), comp).select("f", F.col("comp").alias("p"))
            whole = _labelled(per.join(left.select("f").distinct(), "f"), comp).join(main, "f").select("f", "p", "id", "comp", F.col("n").alias("size"))
            links, _ = _in_blocks(save(whole, n), texts, percent, k, None, n, 3 * n)
            comp = _merge(comp, links, n) if not links.isEmpty() else comp
    drop(each, counts, marked, labelled)
    return again, comp


def _merge(comp: DataFrame | None, links: DataFrame, n: int) -> DataFrame:
    """Labels (id, comp) after more links (a, b); an id without a row is its own component."""
    if comp is None:
        return components(links, n)
    label = lambda df, c: df.join(comp.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}")), c, "left")
    both = save(label(label(links, "a"), "b").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), n)
    step = components(both, n)
    moved = comp.join(step.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return save(moved.unionByName(step.join(comp.select("id"), "id", "left_anti")), n)


def _grouped(docs: DataFrame, row: Column, percent: int, key: str, text: str, k: int, small: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The rows (uid, row, key, text, n_shingles, words_key, text_key, bands), and the group of every class of rows with equal words: words_key, group.

    A row has an id of its own (uid), so rows without a key or with a repeated one are rows like
    any other. A class goes by its smallest uid.
    """
    spark = docs.sparkSession
    rows = signatures(docs.select(row.alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), k)
    signed = save(rows.withColumn("uid", F.monotonically_increasing_id()))  # ids are fixed once written
    first = F.min(F.struct("uid", "n_shingles", "bands")).alias("m")
    heads = save(signed.filter("words_key is not null").groupBy("words_key").agg(first).select("words_key", F.col("m.uid").alias("id"), F.col("m.n_shingles").alias("size"), "m.bands"))
    classes = heads.select("words_key", "id")
    buckets = save(heads.select("id", "size", F.explode("bands").alias("bucket")))
    shared = save(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    found = save(buckets.join(shared, "bucket"))
    weight = save(found.groupBy("id").agg(F.sum("n").alias("weight"), F.max("size").alias("size")))
    members = save(found.select("id", "bucket").join(weight, "id"))
    drop(buckets, shared, found)
    # the texts of classes that share a bucket, once each
    texts = save(signed.select(F.col("uid").alias("id"), "text").join(weight.select("id"), "id"))
    comp, turn = None, 0
    n_text = tasks(texts, each=2_000_000)
    while True:
        n = tasks(members)
        now = save(_labelled(members, comp), n)
        best = F.max(F.struct("weight", (-F.col("id")).alias("i"), "comp")).alias("p")
        open_ = now.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), best).filter("x < y")
        open_ = save(open_.select("bucket", (-F.col("p.i")).alias("pivot"), F.col("p.comp").alias("p")), n)
        if open_.isEmpty():
            break
        live = save(now.join(open_, "bucket"), n)
        if not turn:
            pairs = live.filter("id <> pivot and comp <> p").select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b"))
            links = save(confirm(save(pairs.distinct(), n), texts, percent, k), n_text)
            comp = _merge(comp, links, n) if not links.isEmpty() else comp
            # the pivot has met all the others
            rest = live.filter("id <> pivot").select("id", "bucket", "weight", "size")
        else:
            families = save(live.select(F.col("p").alias("f"), "p", "id", "comp", "size").distinct(), n)
            links, large = _in_blocks(families, texts, percent, k, blocks, n, n_text)
            if turn > 1 and not large.isEmpty():
                families = save(live.join(large.select("p"), "p").select(F.col("bucket").alias("f"), "p", "id", "comp", "size").distinct(), n)
                more, large = _in_blocks(families, texts, percent, k, blocks, n, n_text)
                links = links.unionByName(more)
            comp = _merge(comp, links, n) if not links.isEmpty() else comp
            if large.isEmpty():
                break
            named = _labelled(large.select("f", F.col("p").alias("id")), comp).select("f", F.col("comp").alias("p"))
            again, comp = _deal_anew(save(families.select("f", "id").join(named, "f"), n), texts, comp, percent, k, small, n_text)
            rest = again.select("id", F.xxhash64("f", "s", F.lit(turn)).alias("bucket")).join(weight, "id").select("id", "bucket", "weight", "size")
        old, members = members, save(rest, n)
        drop(old, now, open_, live)
        turn += 1
    if comp is None:
        comp = classes.select("id", F.col("id").alias("comp")).limit(0)
    return signed, save(classes.join(comp, "id", "left").select("words_key", F.coalesce("comp", "id").alias("group")))


def groups(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text", k: int = SHINGLE, small: int = SMALL, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the smallest key reachable by links), kept (key = component_id).

    Null keys are larger than all others: a row without a key has a component_id if it is
    linked with one that has, and is kept if there is none.
    """
    signed, named = _grouped(docs, F.lit(None).cast("int"), percent, key, text, k, small, blocks)
    per_class = signed.filter("words_key is not null").groupBy("words_key").agg(F.min("key").alias("least"))
    with_group = save(per_class.join(named, "words_key"))
    least = with_group.groupBy("group").agg(F.min("least").alias("component"))
    to = save(with_group.join(least, "group").select("words_key", "component"))
    out = signed.select("key", "n_shingles", "words_key").join(to, "words_key", "left")
    component = F.when(F.col("words_key").isNull(), F.col("key")).otherwise(F.col("component"))
    out = out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text", k: int = SHINGLE, small: int = SMALL, blocks: int = BLOCKS) -> DataFrame:
    """The documents that stay, with all their columns: of each group the row of the smallest key (nulls last), of those the one whose text has the smallest SHA-256.

    Rows without words are linked with nothing, so they stay; of rows that repeat both a key
    and a text, one does.
    """
    rest = [c for c in docs.columns if c != text]
    signed, named = _grouped(docs, packed(rest), percent, key, text, k, small, blocks)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_key", "uid")).alias("m")
    per_class = save(signed.filter("words_key is not null").groupBy("words_key").agg(first))
    best = F.min("m")["uid"].alias("uid")
    stay = per_class.join(named, "words_key").groupBy("group").agg(best).select("uid")
    wordless = signed.filter("words_key is null").select("uid", "key", "text_key")
    once = wordless.filter("key is not null").groupBy("key", "text_key").agg(F.min("uid").alias("uid")).select("uid")
    stay = save(stay.unionByName(once).unionByName(wordless.filter("key is null").select("uid")))
    kept = signed.join(stay, "uid", "left_semi")
    return kept.select(*unpacked("row", rest), F.col("text").alias(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
