"""Personal data by patterns, and information-theoretic sanitisation of the words around it.

The patterns find protected entities. Over the whole corpus, co-occurrence counts (documents in
which a term stands within WINDOW words of an entity) and document frequencies give each pair's
pointwise mutual information; a term discloses an entity if that reaches DISCLOSURE of the
entity's own information content. The share of a term's documents that have the entity near it
is smoothed by PRIOR documents without it, so entities of one or two documents count too, and
a rare term discloses only where chance explains it less than the entity's own content.
Disclosing terms become spans of kind `term` wherever they occur outside the patterns' spans,
and are generalised to a label or removed.

A term is any word without the marks around it, in lower case: letters, digits, hyphens and
apostrophes alike, of any length. Words that touch a pattern's span are no candidates; a term's
document frequency counts all documents that hold it as a word.

Counts are added up per batch before any shuffle. Terms are first looked up in a bitmap of
fixed size and then joined exactly, so nothing broadcast grows with the input. Pairs that the
documents near entities alone rule out are left before the frequencies are counted.

Frequencies are counted in portions of the documents, each STEP times as many as all before it
or so. A share only falls as a frequency rises, so a pair that the portions counted so far rule
out is out for good, and its term is not looked up in the next, larger portion. A common word
is thus counted in few documents, and the partial counts follow the number of candidates, not
candidates times batches. The pairs that stay have been counted over all documents.

Defined cases: null counts as the empty text; a failed check (range, Luhn, digits) drops a
match without another try; kinds may overlap each other; rows that repeat are documents each.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import packed, releasing, save, unpacked
from .bpe import batches

KINDS = ("email", "ip", "card", "phone")
WINDOW = 5
#: Documents without the entity that are added to those of a term.
PRIOR = 1
DISCLOSURE = 0.9
#: Bits of the bitmap, a power of two.
BITS = 1 << 24
#: Documents of the first portion at most, on average; how many times as many the portions up to the next one hold, a power of two.
FIRST = 4096
STEP = 16
#: Bytes of text that the last step holds as Python objects at a time.
HELD_BYTES = 4_000_000
EDGES = ".,;:!?()[]{}\"'|"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Checked matches per kind: leftmost, not overlapping, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found["email"].append((start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(int(x) <= 255 if len(x) < 20 else int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def term(word: str) -> str:
    return word.strip(EDGES).lower()


def _outside(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """start, end and text of the words that touch none of the spans."""
    words, spans, i, reach = [], sorted(spans), 0, 0
    for m in _WORD.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reach = max(reach, spans[i][1])
            i += 1
        if m.start() >= reach:
            words.append((m.start(), m.end(), m[0]))
    return words


def _near(text: str, found: dict[str, list[tuple[int, int]]], window: int) -> tuple[set[str], set[tuple[str, str]]]:
    """The entities of a text and (entity, term) pairs of terms near them."""
    every = [(s, e, k) for k, v in found.items() for s, e in v]
    if not every:
        return set(), set()
    own = {w[0] for w in _outside(text, [(s, e) for s, e, _ in every])}
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]
    entities, pairs = set(), set()
    for s, e, k in every:
        name = hashlib.sha256(f"{k}:{text[s:e].lower()}".encode()).hexdigest()[:32]
        entities.add(name)
        lo = int(np.searchsorted(starts, s, "right")) - 1
        hi = int(np.searchsorted(starts, e, "left"))
        for w in words[max(0, lo - window) : lo] + words[hi : hi + window]:
            if w[0] in own and (t := term(w[2])):
                pairs.add((name, t))
    return entities, pairs


def cooccurrence(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """entity, term, n: documents that hold the entity (term null), both near each other, or the term near any entity (entity null)."""

    def run(it):
        for b in it:
            t = b.column(0)
            for s, z in batches(t):
                n: Counter = Counter()
                for x in t.slice(s, z - s).to_pylist():
                    entities, pairs = _near(x, base_spans(x), window) if x else ((), ())
                    n.update((e, None) for e in entities)
                    n.update(pairs)
                    n.update((None, w) for w in {w for _, w in pairs})
                yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in n], pa.string()), pa.array([w for _, w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["entity", "term", "n"])

    return docs.select(text).mapInArrow(releasing(run), "entity string, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n"))


def _bitmap(terms: DataFrame) -> bytes:
    """Two bits a term, of fixed size: at most BITS / 32 numbers come to the driver."""
    h = F.xxhash64("term")
    bit = F.explode(F.array(h.bitwiseAND(F.lit(BITS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(BITS - 1)))).alias("b")
    part = terms.select(bit).groupBy(F.shiftright("b", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("v"))
    parts = np.zeros(BITS // 32, "<u4")
    got = part.toArrow()
    parts[got["at"].to_numpy()] = got["v"].to_numpy().astype("<u4")
    return parts.tobytes()


def _hits(texts: pa.Array, bits: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Terms of the texts that the bitmap knows, and (text, term) pairs, each once."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    index: dict[str, int] = {}
    of_word = np.fromiter((index.setdefault(term(w), len(index)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    names = list(index)
    known = np.fromiter((t != "" and _known(t, bits) for t in names), bool, len(names))
    if not known.any():
        return names, np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = of_word[coded.indices.to_numpy(zero_copy_only=False)]
    at = np.flatnonzero(known[code])
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.searchsorted(offsets - offsets[0], at, "right") - 1
    pairs = np.unique(of * len(names) + code[at])
    return names, pairs // len(names), pairs % len(names)


def _known(t: str, bits: np.ndarray) -> bool:
    h = xxhash.xxh64_intdigest(t.encode(), seed=42)  # as Spark's xxhash64
    return all(bits[b >> 3] >> (b & 7) & 1 for b in (h & (BITS - 1), h >> 32 & (BITS - 1)))


def frequencies(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """term, df: in how many documents each of the terms occurs."""
    packed = _bitmap(terms)

    def run(it):
        bits = np.frombuffer(packed, np.uint8)
        for b in it:
            t = b.column(0)
            for s, z in batches(t):
                names, _, code = _hits(t.slice(s, z - s), bits)
                found, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in found.tolist()], pa.string()), pa.array(n.astype(np.int64))], ["term", "df"])

    return docs.select(text).mapInArrow(releasing(run), "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).join(terms, "term")


def _portions(docs: DataFrame, n: int, text: str) -> list[DataFrame]:
    """The n documents in disjoint portions that grow by STEP, by a hash of the text; equal texts share one."""
    levels = 0
    while n > FIRST * STEP**levels:
        levels += 1
    within = lambda k: F.xxhash64(text).bitwiseAND(F.lit(STEP**k - 1)) == 0
    return [docs.filter(within(k) if k == levels else within(k) & ~within(k + 1)) for k in range(levels, -1, -1)]


def disclosing(docs: DataFrame, text: str = "text", window: int = WINDOW, prior: float = PRIOR, threshold: float = DISCLOSURE) -> DataFrame:
    """The terms that disclose an entity: term, disclosure (its largest share of an entity's information)."""
    counts = save(cooccurrence(docs, text, window))
    total = docs.count()
    content = F.log2(F.lit(float(total)) / F.col("ne"))
    # mutual information as the content less the bits that the term leaves open
    share = lambda df: F.when(content > 0, 1 + F.log2(F.col("n") / (df + F.lit(float(prior)))) / content)
    entities = counts.filter("term is null").select("entity", F.col("n").alias("ne"))
    near = counts.filter("entity is null").select("term", F.col("n").alias("near"))
    pairs = counts.filter("entity is not null and term is not null").join(entities, "entity").join(near, "term")
    pairs = save(pairs.filter(share(F.col("near")) >= threshold).withColumn("df", F.lit(0).cast("long")))
    for part in _portions(docs, total, text):
        more = frequencies(part, save(pairs.select("term").distinct()), text).withColumnRenamed("df", "more")
        so_far = pairs.join(more, "term", "left").withColumn("df", F.col("df") + F.coalesce("more", F.lit(0))).drop("more")
        pairs = save(so_far.filter(share(F.greatest("near", "df")) >= threshold))  # the whole df is neither less than near nor than df so far
    return save(pairs.select("term", share(F.col("df")).alias("disclosure")).groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= threshold))


def _found(docs: DataFrame, text: str, carry: list[str], **how) -> DataFrame:
    """row (the carried columns, packed) and spans array<struct<kind, start, end>> (base kinds in order, then terms)."""
    terms = disclosing(docs, text, **how)
    bits_ = _bitmap(terms)

    def run(it):
        bits = np.frombuffer(bits_, np.uint8)
        any_ = bool(bits.any())
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        hit = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in it:
            t = b.column(1)
            for s, z in batches(t, HELD_BYTES):
                part = t.slice(s, z - s)
                held = part.to_pylist()
                some: dict[int, set[str]] = {}
                if any_:
                    words, of, code = _hits(part, bits)
                    for i, c in zip(of.tolist(), code.tolist(), strict=True):
                        some.setdefault(i, set()).add(words[c])
                spans, hits = [], []
                for i, x in enumerate(held):
                    found = base_spans(x) if x else {}
                    spans.append([{"kind": k, "start": a, "end": e} for k, v in found.items() for a, e in v])
                    mine = some.get(i)
                    free = _outside(x, [p for v in found.values() for p in v]) if mine else []
                    hits.append([{"term": w, "start": a + m.find(m.strip(EDGES)), "end": a + m.find(m.strip(EDGES)) + len(m.strip(EDGES))} for a, _, m in free if (w := term(m)) in mine])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, z - s), pa.array(spans, span), pa.array(hits, hit)], ["row", "base", "terms"])

    rows = docs.select(packed(carry).alias("row"), F.col(text).alias("text"))
    extra = StructType.fromDDL("base array<struct<kind:string,start:int,end:int>>, terms array<struct<term:string,start:int,end:int>>")
    first = save(rows.mapInArrow(releasing(run), StructType([rows.schema["row"], *extra.fields])).withColumn("uid", F.monotonically_increasing_id()))
    exact = first.select("uid", F.inline("terms")).join(terms, "term")
    more = save(exact.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end"))).alias("more")))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return first.join(more, "uid", "left").select("row", F.concat("base", F.coalesce("more", none)).alias("spans"))


def find(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = (), **how) -> DataFrame:
    """Columns carry of each document, with spans array<struct<kind, start, end>> (base kinds in order, then terms); a carried column of that name is replaced."""
    held = [c for c in carry if c.lower() != "spans"]
    return _found(docs, text, held, **how).select(*unpacked("row", held), "spans")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined)."""
    found = find(docs, text, (key,), **how)
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "term")
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(key, *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", generalise: bool = True, **how) -> DataFrame:
    """The documents with every span replaced by its kind in brackets (or removed); overlapping spans are one, of the first's kind. Columns of any name stay as they are."""
    found = _found(docs, text, docs.columns, **how)
    spans = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
    t = F.col(f"row.c{docs.columns.index(text)}")
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc, x):
        label = F.concat(F.lit("["), F.upper(x["k"]), F.lit("]")) if generalise else F.lit("")
        gap = F.when(x["s"] >= acc["at"], F.concat(F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), label)).otherwise(F.lit(""))
        return F.struct(F.concat(acc["done"], gap).alias("done"), F.greatest(acc["at"], x["e"]).alias("at"))

    new = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(t, acc["at"] + 1, F.length(t))))
    clean = F.when(F.size("spans") == 0, t).otherwise(new).alias(text)
    return found.select(*[clean if c == text else x for c, x in zip(docs.columns, unpacked("row", docs.columns), strict=True)])
