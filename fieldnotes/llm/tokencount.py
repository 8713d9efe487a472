"""Token counts without ids: count each distinct pre-token once, join to the documents' pre-token frequencies, sum.

For a sentencepiece model whose pieces never hold a space after another character, a run of
spaces with the characters behind it (a pre-token) is encoded on its own. The pre-tokens of a
batch are coded by a dictionary; its entries are counted once, and a worker remembers counts
between batches. The join is by dictionary code, so nothing is shuffled.

Defined cases: null counts as the empty text (no tokens); texts of any length are taken whole;
repeated rows and rows without a key are counted each; columns other than key and text are not
read, so none can clash; an empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from ._shared import releasing
from .bpe import batches

#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 400_000
UNITS = re.compile(" *[^ ]+| +")
SPACE = "▁"


class Counter:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))
        self.known: dict[str, int] = {}

    def _count(self, units: list[str]) -> list[int]:
        """units: pre-tokens without their first space, which the model itself puts before each text."""
        full = [u for u in units if u.strip(" ")]
        sizes = dict(zip(full, map(len, self.model.encode(full, num_threads=1)), strict=True))
        for u in units:
            if u not in sizes:  # u and the dropped space are spaces only: their model puts one more before, so leave one out
                sizes[u] = 1 if not u else len(self.model.encode(u[1:] or "", num_threads=1)) if len(u) > 1 else self._spaces(2)
        return [sizes[u] for u in units]

    def _spaces(self, n: int) -> int:
        return len(self.model.encode(" " * (n - 1), num_threads=1))

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.whole:
            return np.array([len(x) for x in self.model.encode(texts.to_pylist(), num_threads=1)], np.int64)
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))).to_numpy(zero_copy_only=False)
        if odd.any():  # the same units, found by a regular expression
            rows = [UNITS.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts.to_pylist()]
            flat = pa.array([u[1:] for r in rows for u in r], pa.large_string())
            per = np.array([len(r) for r in rows], np.int64)
        else:
            lists = pc.split_pattern(texts, " ")
            flat, per = lists.flatten(), np.diff(lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64))
        coded = flat.dictionary_encode()
        units = coded.dictionary.to_pylist()
        if len(self.known) + len(units) > REMEMBERED:
            self.known = {}
        fresh = [u for u in units if u not in self.known]
        self.known.update(zip(fresh, self._count(fresh), strict=True))
        each = np.fromiter((self.known[u] for u in units), np.int64, len(units))
        sums = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)] if len(units) else [])]).astype(np.int64)
        ends = np.cumsum(per)
        out = sums[ends] - sums[ends - per]
        out[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def run(it):
        c = counter(model_path)
        for b in it:
            t, keys = b.column(1), b.column(0)
            for s, z in batches(t):
                part = t.slice(s, z - s)
                n = c.count(part)
                size = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([keys.slice(s, z - s), size, pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(releasing(run), f"{key} {dict(docs.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean")
