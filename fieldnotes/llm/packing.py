"""Packing by cutting-stock column generation.

Documents become token ids with an end id; each is cut into full pieces of the capacity and a
rest. The rests' lengths are rounded up to classes; a linear program over patterns (how many
pieces of each class share a sequence) is solved by column generation, whose new columns come
from an integer knapsack by dynamic programming over the duals. Patterns are rounded down and
what is left is filled by first fit, largest first. Pieces are ranked within their class and
take the pattern instance that holds their rank. Class counts, patterns and rank ranges have
sizes bounded by the number of classes, whatever the input.

Defined cases: a null text counts as empty and still has its end id; rows that repeat a key
are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions, releasing, save
from .bpe import batches, encoder

CAPACITY = 2048
#: Lengths are rounded up to a multiple of this.
STEP = 8
#: Share of sequences that the linear program may use over its best value.
GAP = 0.001


@dataclass
class Plan:
    """ranges[c]: (first rank, pieces of c per instance, first sequence) of each pattern that holds class c, by rank."""

    step: int
    ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes within the capacity (unbounded knapsack). sizes: ascending."""
    useful = np.flatnonzero((values > 1e-12) & (sizes <= capacity))
    s, v = sizes[useful], values[useful]
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            got = best[room - s[:n]] + v[:n]
            j = got.argmax()
            if got[j] > best[room] + 1e-12:
                best[room], choice[room] = got[j], j
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[useful[choice[room]]] += 1
            room -= int(s[choice[room]])
    return float(best[capacity]), pattern


def solve(counts: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = 4000, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns over classes and how often to use each; together they hold exactly counts, within the capacity."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.linalg.inv(basis), counts / (capacity // sizes)
    for n in range(rounds):
        if n % 64 == 63:
            inverse = np.linalg.inv(basis)
            x = inverse @ counts
        value, pattern = knapsack(inverse.sum(0), sizes, capacity)
        if value <= 1 + gap:  # then the program's value is within this share of the best
            break
        move = inverse @ pattern
        up = move > 1e-9
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, move, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x -= step * move
        x[out] = step
        basis[:, out] = pattern
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    uses = np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)
    left = counts.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for p, u in zip(basis.T.round().astype(np.int64), uses, strict=True):
        own = p > 0
        u = min(int(u), int((left[own] // p[own]).min())) if own.any() else 0
        if u:
            left -= u * p
            plan.append((p, u))
    while left.any():  # what rounding left: a few instances per class at most
        p, room = np.zeros(m, np.int64), capacity
        for i in np.argsort(-sizes):
            take = min(int(left[i]), int(room // sizes[i]))
            p[i], room = take, room - take * int(sizes[i])
        own = p > 0
        u = int((left[own] // p[own]).min())
        left -= u * p
        plan.append((p, u))
    return plan


def planned(histogram: dict[int, int], capacity: int = CAPACITY, step: int = STEP) -> Plan:
    """histogram: pieces of each class; class c holds lengths up to c * step. capacity: a multiple of step."""
    classes = np.array(sorted(histogram), np.int64)
    sizes = np.minimum(classes, capacity // step)  # in steps
    counts = np.array([histogram[c] for c in classes.tolist()], float)
    plan = solve(counts, sizes, capacity // step)
    rows: dict[int, list[tuple[int, int, int]]] = {c: [] for c in classes.tolist()}
    rank, sequence = dict.fromkeys(rows, 0), 0
    for p, u in plan:
        for c, a in zip(classes.tolist(), p.tolist(), strict=True):
            if a:
                rows[c].append((rank[c], a, sequence))
                rank[c] += a * u
        sequence += u
    return Plan(step, {c: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for c, r in rows.items() if r}, sequence)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens of each piece, and its ids if asked for."""

    def run(it):
        e = encoder(tokenizer_path)
        for b in it:
            keys, t = b.column(0), b.column(1)
            for s, z in batches(t):
                ids, at = e.encode(t.slice(s, z - s))
                sizes = np.diff(at) + 1
                n = -(-sizes // capacity)
                of = np.repeat(np.arange(z - s), n)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, sizes[of] - start)
                end = np.array([end_id], "<u4").tobytes()
                raw = ids.astype("<u4")
                last = start + length == sizes[of]
                crc = np.empty(len(of), np.int64)
                parts = []
                for i, (d, a, k, z_) in enumerate(zip(of.tolist(), start.tolist(), length.tolist(), last.tolist(), strict=True)):
                    x = raw[at[d] + a : at[d] + a + k - z_]
                    c = zlib.crc32(x.tobytes())
                    crc[i] = zlib.crc32(end, c) if z_ else c
                    if with_ids:
                        parts.append([*x.tolist(), end_id] if z_ else x.tolist())
                cols = [keys.slice(s, z - s).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(crc), pa.array(sizes[of])]
                names = [key, "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(parts, pa.list_(pa.int32()))] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    schema = f"{key} {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return docs.select(key, text).mapInArrow(releasing(run), schema)


def assign(cut: DataFrame, capacity: int = CAPACITY, step: int = STEP, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to a saved table of pieces.

    Ranks within a class are counted per salt (a hash of the key) and carried over the salts,
    so that no task sees a whole class.
    """
    salts = 4 * partitions(cut.sparkSession)
    cut = cut.withColumns({"_class": F.ceil(F.col("length") / step).cast("int"), "_salt": F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")})
    counts = save(cut.groupBy("_class", "_salt").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}  # one row per class
    plan = planned(histogram, capacity, step)
    before = counts.select("_class", "_salt", (F.sum("_n").over(Window.partitionBy("_class").orderBy("_salt")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_class", "_salt").orderBy(key, "start", "ids_crc32"))
    ranked = cut.withColumn("_local", local).join(before, ["_class", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_local") - 1)

    def run(it):
        for b in it:
            c, r = b.column(b.schema.get_field_index("_class")).to_numpy(), b.column(b.schema.get_field_index("_rank")).to_numpy()
            sequence, slot = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
            for k in np.unique(c).tolist():
                first, per, base = plan.ranges[k]
                at = np.flatnonzero(c == k)
                i = np.searchsorted(first, r[at], "right") - 1
                sequence[at] = base[i] + (r[at] - first[i]) // per[i]
                slot[at] = (r[at] - first[i]) % per[i]
            keep = [i for i, n in enumerate(b.schema.names) if not n.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(sequence), pa.array(c.astype(np.int64)), pa.array(slot)], [*(b.schema.names[i] for i in keep), "sequence_id", "_c", "_slot"])

    own = [f for f in ranked.schema.fields if not f.name.startswith("_")]
    from pyspark.sql.types import LongType, StructField, StructType

    placed = ranked.mapInArrow(releasing(run), StructType([*own, *(StructField(n, LongType()) for n in ("sequence_id", "_c", "_slot"))]))
    w = Window.partitionBy("sequence_id").orderBy("_c", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")).drop("_c", "_slot")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, step: int = STEP, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents' pieces with their sequence_id and offset; sequences hold at most capacity tokens."""
    return assign(save(pieces(docs, tokenizer_path, end_id, capacity, key, text, with_ids)), capacity, step, key)
