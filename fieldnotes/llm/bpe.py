"""BPE encoding and decoding with a pair occurrence index.

A partition's texts are cut at ASCII white space, which no pre-token crosses. The distinct
pieces are normalised and pre-tokenised by the tokenizer's own rules; all distinct pre-tokens
of a batch are then merged together: an index maps each pair to its positions, the ranks that
occur are applied in ascending order, and each merge updates the lists of the neighbouring
pairs. Each text's ids are gathered from its pieces.

Defined cases: null counts as the empty text (no ids); texts of any length are taken whole;
strings of the tokenizer's added tokens inside texts become those tokens, as in the library;
repeated rows and rows without a key are encoded each; in `encode` a column named ids is
replaced, `digests` reads no column but key and text; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ._shared import releasing, without

#: Distinct pieces that a worker remembers between batches.
REMEMBERED = 500_000
#: UTF-8 bytes of text handled at once (a longer text is handled alone).
BATCH_BYTES = 12_000_000


def batches(texts: pa.Array, most: int = BATCH_BYTES):
    """Cut an array of strings into runs (start, stop) of about `most` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, len(sizes)
    while start < n:
        limit = (ends[start - 1] if start else 0) + most
        stop = max(start + 1, int(np.searchsorted(ends, limit, "right")))
        yield start, stop
        start = stop


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of many ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def byte_names() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself if printable in Latin-1, else 256 onwards in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Merges:
    """Applies BPE merges to many pre-tokens at once."""

    #: Ranks whose positions are collected together.
    BLOCK = 64

    def __init__(self, model: dict):
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        none = len(vocab)
        self.inner = np.array([vocab.get(c, none) for c in byte_names()], np.int32)
        self.last = np.array([vocab.get(c + suffix, none) for c in byte_names()], np.int32)
        self.n = none + 1
        pairs = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append((vocab[a], vocab[b], vocab[a + b]))
        self.pairs = pairs
        keys = np.array([a * self.n + b for a, b, _ in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 for none."""
        k = a.astype(np.int64) * self.n + b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.order[i], -1)

    def encode(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw: the bytes of pre-tokens in UTF-8, of the given sizes, none empty. All their ids, and how many each has."""
        n, ends = len(raw), np.cumsum(sizes)
        ids = np.append(self.inner[raw], np.int32(-2))
        ids[ends - 1] = self.last[raw[ends - 1]]
        # the places before and after; n stands for none
        after = np.arange(1, n + 2)
        after[ends - 1] = n
        before = np.arange(-1, n)
        before[ends - sizes] = n
        before[n] = after[n] = n
        blocks: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(self.pairs) // self.BLOCK + 1)]

        def file(rank: np.ndarray, at: np.ndarray) -> None:
            """List positions under the blocks of their ranks."""
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            block = rank // self.BLOCK
            cuts = np.flatnonzero(np.diff(block)) + 1
            for r, x in zip(np.split(rank, cuts), np.split(at, cuts), strict=True):
                if len(r):
                    blocks[int(r[0]) // self.BLOCK].append((r, x))

        at = np.flatnonzero(after[:n] < n)
        rank = self.ranks(ids[at], ids[after[at]])
        file(rank[rank >= 0], at[rank >= 0])
        for number in range(len(blocks)):
            if not blocks[number]:
                continue
            rank, at = (np.concatenate(x) for x in zip(*blocks[number], strict=True))
            blocks[number] = []
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            index = {int(rank[i]): [x] for i, x in zip([0, *cuts.tolist()], np.split(at, cuts), strict=True)}
            later: list[tuple[np.ndarray, np.ndarray]] = []
            top = (number + 1) * self.BLOCK
            active = sorted(index)
            while active:
                r = heapq.heappop(active)
                lists = index.pop(r)
                a, b, new = self.pairs[r]
                p = lists[0] if len(lists) == 1 else np.concatenate(lists)
                j = after[p]
                good = (ids[p] == a) & (ids[j] == b)
                p = p[good]
                if not len(p):
                    continue
                if len(lists) > 1 or a == b:
                    p = np.unique(p)
                if a == b and len(p) > 1:  # of touching pairs, each second one goes
                    touch = np.append(False, after[p[:-1]] == p[1:])
                    place = np.arange(len(p))
                    run = place - np.maximum.accumulate(np.where(touch, 0, place))
                    p = p[run % 2 == 0]
                j = after[p]
                k = after[j]
                ids[p], ids[j] = new, -1
                after[p] = k
                before[k] = p
                before[n] = n
                h = before[p]
                left, right = h[h < n], p[k < n]
                x = np.concatenate([left, right])
                if not len(x):
                    continue
                rank = self.ranks(ids[x], ids[after[x]])
                ok = rank >= 0
                rank, x = rank[ok], x[ok]
                soon = rank < top
                if soon.any():
                    for q, i in zip(rank[soon].tolist(), x[soon].tolist(), strict=True):
                        if q not in index:
                            index[q] = []
                            heapq.heappush(active, q)
                        index[q].append(np.array([i]))
                    rank, x = rank[~soon], x[~soon]
                if len(x):
                    later.append((rank, x))
            if later:
                file(*(np.concatenate(x) for x in zip(*later, strict=True)))
        live = ids[:n] >= 0
        kept = np.cumsum(live)
        return ids[:n][live].astype(np.uint32), np.diff(kept[ends - 1], prepend=0)


#: Pieces whose pre-tokens are plain: letters of Latin-1 (their own composed form), and a full stop or comma.
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$"


def raw_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array without nulls, and each string's size."""
    strings = pa.concat_arrays([strings])
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), np.diff(at)


class Encoder:
    """Encodes arrays of texts; equal to the library's encode without added special tokens."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        spec["truncation"] = spec["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.merges = Merges(spec["model"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)").search
        self.names = {i: t for t, i in self.tokenizer.get_vocab(True).items()}
        self.byte = {c: b for b, c in enumerate(byte_names())}
        # whether PLAIN pieces may skip the tokenizer's own rules
        probe = "Straße, ÀÉÿ."
        self.plain = self._rules(probe) == [x.encode() for x in ("straße", ",", "àéÿ", ".")]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _rules(self, piece: str) -> list[bytes]:
        cut = self.tokenizer.normalizer
        text = cut.normalize_str(piece) if cut else piece
        return [bytes(self.byte[c] for c in t) for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if t] if text else []

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and how many each has."""
        given = pa.array(pieces, pa.large_string())
        plain = pc.match_substring_regex(given, PLAIN).to_numpy(zero_copy_only=False) & self.plain
        word = pc.utf8_lower(pc.utf8_rtrim(given.filter(pa.array(plain)), ".,"))
        coded = word.dictionary_encode()
        tokens: dict[bytes, int] = {}
        special: dict[int, np.ndarray] = {}
        others: dict[int, list[int]] = {}
        base = len(coded.dictionary)
        for i in np.flatnonzero(~plain).tolist():
            p = pieces[i]
            if self.special(p):
                special[i] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32)
            else:
                others[i] = [base + tokens.setdefault(t, len(tokens)) for t in self._rules(p)]
        ends = {c: base + tokens.setdefault(c.encode(), len(tokens)) for c in ".,"}
        per = np.zeros(len(pieces), np.int64)
        stop, comma = (pc.ends_with(given, c).to_numpy(zero_copy_only=False) & plain for c in ".,")
        per[plain] = 1
        per += stop | comma
        for i, x in others.items():
            per[i] = len(x)
        stops = np.cumsum(per)
        to = np.zeros(int(per.sum()), np.int64)
        to[(stops - per)[plain]] = coded.indices.to_numpy(zero_copy_only=False)
        to[(stops - 1)[stop]], to[(stops - 1)[comma]] = ends["."], ends[","]
        for i, x in others.items():
            to[stops[i] - len(x) : stops[i]] = x
        raw, each = raw_bytes(coded.dictionary)
        more = list(tokens)
        ids, sizes = self.merges.encode(np.concatenate([raw, np.frombuffer(b"".join(more), np.uint8)]), np.concatenate([each, np.fromiter(map(len, more), np.int64, len(more))]))
        starts = np.cumsum(sizes) - sizes
        out = ids[gather(starts[to], sizes[to])]
        ends_ = np.concatenate([[0], np.cumsum(sizes[to])])
        counts = ends_[stops] - ends_[stops - per]
        if special:
            cut = np.split(out, np.cumsum(counts)[:-1])
            for i, x in special.items():
                cut[i], counts[i] = x, len(x)
            out = np.concatenate(cut)
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) + len(pieces) > REMEMBERED:
            self._forget()
        fresh = [p for p in pieces if p not in self.known]
        if fresh:
            flat, sizes = self._pieces(fresh)
            base = len(self.ids) + np.cumsum(sizes) - sizes
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.ids, self.start, self.length = np.concatenate([self.ids, flat]), np.concatenate([self.start, base]), np.concatenate([self.length, sizes])
        if len(pieces):
            to = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[coded.indices.to_numpy(zero_copy_only=False)]
        else:
            to = np.zeros(0, np.int64)
        sizes = self.length[to]
        ids = self.ids[gather(self.start[to], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, ends[offsets - offsets[0]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The library's decode(ids, skip_special_tokens=False), in UTF-8, by the tokenizer's decoder; without one, names joined by spaces."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        names = self.names
        return " ".join([names[i] for i in ids.tolist()]).encode()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Add ids array<int>."""
    kept = without(docs, "ids")

    def run(it):
        e = encoder(tokenizer_path)
        for b in it:
            t = b.column(text)
            for s, z in batches(t):
                ids, at = e.encode(t.slice(s, z - s))
                col = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                part = b.slice(s, z - s)
                yield pa.RecordBatch.from_arrays([*part.columns, col], [*part.schema.names, "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return kept.mapInArrow(releasing(run), StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType(), False))]))


def digests(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text: key, n_tokens, ids_sha256, decoded_sha256."""

    def run(it):
        e = encoder(tokenizer_path)
        for b in it:
            t, keys = b.column(1), b.column(0)
            for s, z in batches(t):
                ids, at = e.encode(t.slice(s, z - s))
                raw = ids.astype("<u4")
                both = [(hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(e.decode(x)).hexdigest()) for x in (raw[at[i] : at[i + 1]] for i in range(z - s))]
                yield pa.RecordBatch.from_arrays([keys.slice(s, z - s), pa.array(np.diff(at)), pa.array([x for x, _ in both], pa.string()), pa.array([x for _, x in both], pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(key, text)
    return rows.mapInArrow(releasing(run), f"{key} {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
