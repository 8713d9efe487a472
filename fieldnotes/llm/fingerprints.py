"""Order MinHash document fingerprints, in DataFrame functions only.

Symbols are words, cut into pieces of at most PIECE characters so that texts without spaces
have symbols too. Each run of K symbols (a k-mer) is numbered by its occurrence in the text.
Every coordinate has a hash of its own and ranks all k-mers of the text by it; it takes the
two that are minimal, one in the hash's order and one in its reverse, puts them back into text
order and hashes the pair. First and last of a random order are as likely to be any two k-mers
as its first two are, so two texts agree in a coordinate with the probability that Order
MinHash with two picks gives: only if they share the same k-mers in the same order, as edit
distance asks. Both picks are plain minima, so they are aggregated before any shuffle and no
array of a text is sorted.

Likeness is the share of agreeing coordinates.

Defined cases: null counts as the empty text, whose fingerprint is empty; two empty texts have
likeness 1, an empty and another 0; texts of fewer than K symbols have one k-mer of all of
them, and a single k-mer is both picks; equal texts have equal fingerprints, whatever their
keys; of two picks the one at the smaller place (modulo 2^24) is first; rows without a key or
with a repeated one are rows of their own, null keys last; columns other than key and text are
not read, so none can clash; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WS_CLASS, drop, let, partitions, save

K = 3
COORDINATES = 32
PIECE = 64
DIGITS = 8
#: Low bits of a ranked number that hold the k-mer's place.
PLACE_BITS = 24
#: Bytes of text in a range of keys.
RANGE_BYTES = 64_000_000


#: Low bits of a number that hold a place, below the hash.
LOW = (1 << PLACE_BITS) - 1


def _with_place(h: Column, i: Column) -> Column:
    return h.bitwiseAND(F.lit(~LOW)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(LOW)))


def _hash_of(v: Column) -> Column:
    return F.shiftright(v, PLACE_BITS)


def kmers(rows: DataFrame, uid: str, text: str, k: int = K) -> DataFrame:
    """uid, v: a row per k-mer, v its hash with its place in the low bits; the hash of all but the first occurrence has the occurrence's number mixed in.

    Each step is a column of its own, so that sorting and set operations run on plain numbers
    in generated code.
    """
    w = rows.select(F.col(uid).alias("uid"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{WS_CLASS}]{{1,{PIECE}}}"), F.lit(0)).alias("w"))
    a = w.select("uid", F.transform("w", lambda x: F.xxhash64(x)).alias("a"))
    run = lambda x, i: _with_place(F.xxhash64(x, *[F.get("a", i + j) for j in range(1, k)]), i)
    s = a.select("uid", F.sort_array(F.transform(F.slice("a", F.lit(1), F.greatest(F.size("a") - (k - 1), F.lit(1))), run)).alias("s"))
    # sorted, so equal hashes are neighbours, in the order of their places
    later = s.select("uid", "s", F.filter("s", lambda x, j: (j > 0) & (_hash_of(x) == _hash_of(F.get("s", F.greatest(j - 1, F.lit(0)))))).alias("t"))

    def numbered(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda j: F.coalesce(_hash_of(F.get(t, j - 1)) != _hash_of(F.get(t, j)), F.lit(True)))
        again = lambda x, o: _with_place(F.xxhash64(x.bitwiseAND(F.lit(~LOW)), o.cast("long") + 1), x)
        of_run = lambda b, n, z: F.transform(F.slice(t, b + 1, F.coalesce(F.get(z, n + 1), F.size(t)) - b), again)
        return let(starts, lambda z: F.flatten(F.transform(z, lambda b, n: of_run(b, n, z))))

    every = F.when(F.size("t") == 0, F.col("s")).otherwise(F.concat(F.array_except("s", "t"), let(F.col("t"), numbered)))
    return later.select("uid", F.explode(every).alias("v"))


def sketch(rows: DataFrame, uid: str, text: str, k: int = K, coordinates: int = COORDINATES) -> DataFrame:
    """uid, fingerprint of every row (uid unique) whose text has symbols: fixed-width hex of the coordinates' pairs."""
    each = kmers(rows, uid, text, k)
    ranked = lambda c: _with_place(F.xxhash64(F.col("v").bitwiseAND(F.lit(~LOW)), F.lit(c).cast("long")), F.col("v"))
    picks = each.groupBy("uid").agg(*[x for c in range(coordinates) for x in (F.min(ranked(c)).alias(f"a{c}"), F.max(ranked(c)).alias(f"b{c}"))])

    def of_pair(c: int) -> Column:
        a, b = F.col(f"a{c}"), F.col(f"b{c}")
        first = a.bitwiseAND(F.lit(LOW)) <= b.bitwiseAND(F.lit(LOW))
        x, y = (_hash_of(F.when(first, p).otherwise(q)) for p, q in ((a, b), (b, a)))
        return F.substring(F.lower(F.lpad(F.hex(F.xxhash64(x, y)), 16, "0")), 1, DIGITS)

    return picks.select(F.col("uid").alias(uid), F.concat(*[of_pair(c) for c in range(coordinates)]).alias("fingerprint"))


def likeness(a: Column, b: Column, coordinates: int = COORDINATES) -> Column:
    """The share of coordinates that agree; 1 for two empty fingerprints, 0 for an empty and another."""
    at = lambda x, c: F.substring(x, c * DIGITS + 1, F.lit(DIGITS))
    same = F.aggregate(F.sequence(F.lit(0), F.lit(coordinates - 1)), F.lit(0), lambda s, c: s + F.when(at(a, c) == at(b, c), 1).otherwise(0))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same / F.lit(float(coordinates)))


def in_ranges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A saved table of the rows (key, text) with _uid, _tie and _bucket: ranges of falling keys (nulls last, ties by a hash of the text), whose bounds are sampled, so that an outlying key costs nothing."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(partitions(docs.sparkSession), total // RANGE_BYTES + 1)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"_tie": F.xxhash64("text"), "_uid": F.monotonically_increasing_id()})
    return save(rows.repartitionByRange(int(n), *_order()).withColumn("_bucket", F.spark_partition_id()))


def _order() -> list[Column]:
    return [F.desc_nulls_last("key"), F.asc("_tie"), F.asc("_uid")]


def with_next(ranged: DataFrame, columns: list[str]) -> DataFrame:
    """Add next_<column> of the next row in the order of in_ranges (after the last one: of the first).

    Each range gets a copy of the first row of the next range that has any, so a window per
    range finds every successor and no task sees all rows.
    """
    first = F.row_number().over(Window.partitionBy("_bucket").orderBy(*_order()))
    heads = save(ranged.select("_bucket", "_uid", "key", "_tie").withColumn("_first", first).filter("_first = 1").select("_bucket", "_uid"))  # a row per range
    by_range = Window.orderBy("_bucket")
    last = F.last("_bucket").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    to = heads.select("_uid", F.coalesce(F.lag("_bucket").over(by_range), last).alias("_to"))
    copies = ranged.join(F.broadcast(to), "_uid").withColumn("_bucket", F.col("_to")).drop("_to").withColumn("_copy", F.lit(1))
    both = ranged.withColumn("_copy", F.lit(0)).unionByName(copies)
    w = Window.partitionBy("_bucket").orderBy("_copy", *_order())
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).filter("_copy = 0").drop("_copy")


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (the last third replaced by the start of the next document's text), and their likeness."""
    ranged = in_ranges(docs, key, text)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    both = with_next(ranged, ["text", "_uid"]).withColumn("edited", edited)
    # two passes over the neighbours instead of a table of the edited texts: less disk
    rows = save(both.select("key", "_uid", F.col("next__uid").alias("_next"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")))
    changed = save(sketch(both.select("_uid", "edited"), "_uid", "edited"))
    own = save(sketch(ranged.select("_uid", "text"), "_uid", "text"))
    drop(ranged)
    named = lambda df, uid, name: df.select(F.col("_uid").alias(uid), F.col("fingerprint").alias(name))
    out = rows.join(named(own, "_uid", "fingerprint"), "_uid", "left").join(named(changed, "_uid", "edited_fingerprint"), "_uid", "left").join(named(own, "_next", "_next_fingerprint"), "_next", "left")
    out = out.na.fill("", ["fingerprint", "edited_fingerprint", "_next_fingerprint"])
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return out.select(F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("_next_fingerprint").alias("near_next"))
