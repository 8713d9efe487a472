"""Toxicity by a bag of subwords: fastText-style embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of itself (hashed into
BUCKETS rows), a text's is the mean over its words; a linear layer and softmax follow. Vectors
and layer are trained jointly in numpy by Adam with balanced classes. Misspelt words share
n-grams with those seen. The model has a fixed size, whatever the input.

Training uses at most TRAIN_ROWS labelled rows, those with the smallest hashes of their id.
Executors reduce their texts to distinct words and counts, which are all that the driver
gathers; everything else runs over all rows.

Defined cases: null and empty texts have the zero vector and so the layer's bias as score;
without labels of both classes every score is the share of label 1 (0 without labels); repeated
rows and rows without a key are scored each, the latter as not held out; rows that repeat a
labelled key are learnt from each, up to the bound; columns other than key and text are not
read, so none can clash; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import releasing, trim
from .bpe import batches, gather
from .minhash import mix

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5)
EPOCHS = 10
#: Updates that small training sets get at least.
UPDATES = 900
TRAIN_ROWS = 6000
THRESHOLD = 0.7
MINIBATCH = 64
#: Words whose n-grams are listed at a time.
NAMES = 10_000
RATE = 0.02
_P = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-grams of <word> and of the word itself, and how many each word has."""
    text = "".join(f"<{w}>" for w in words)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(cp)) - starts[of]
    ids, owner = [], []
    whole = np.zeros(len(words), np.uint64)
    power = np.cumprod(np.full(int(sizes.max(initial=1)), _P), dtype=np.uint64)
    if len(cp):
        whole = np.add.reduceat(mix(cp + np.uint64(7)) * power[place], starts)
    ids.append(mix(whole))
    owner.append(np.arange(len(words)))
    for n in GRAMS:
        at = np.flatnonzero(place <= sizes[of] - n)
        h = np.full(len(at), np.uint64(n))
        for j in range(n):
            h = mix(h * _P + cp[at + j])
        ids.append(h)
        owner.append(of[at])
    rows, who = np.concatenate(ids) % np.uint64(BUCKETS), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return rows[order].astype(np.int32), np.bincount(who, minlength=len(words))


def bags(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the word of each place, and where each text's places end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    word = pc.utf8_lower(pc.utf8_trim(coded.dictionary, ".,;:!?()[]\"'")).dictionary_encode()
    names = word.dictionary.to_pylist()
    code = word.indices.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = offsets[1:] - offsets[0]
    empty = np.array([not w for w in names], bool)
    if empty.any():
        keep = ~empty[code]
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        code = code[keep]
    return names, code, ends


def _mean(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Means of consecutive rows; zeros for none."""
    sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, 0, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)[:, None]


class Model:
    def __init__(self, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.vectors, self.layer, self.bias = vectors, layer, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        names, code, ends = bags(texts)
        if self.vectors is None:
            return np.full(len(ends), float(self.bias[0]))
        # the layer is linear, so means of its outputs are enough
        out = (self.vectors @ self.layer).astype(np.float32)
        gap = (out[:, 1] - out[:, 0])[:, None]
        word = np.zeros((len(names), 1))
        for lo in range(0, len(names), 100_000):
            rows, n = subwords(names[lo : lo + 100_000])
            word[lo : lo + 100_000] = _mean(gap[rows], n)
        sizes = np.diff(ends, prepend=0)
        z = _mean(word[code], sizes)[:, 0] + (self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def counted(texts: pa.Array) -> tuple[list[list[str]], list[list[int]]]:
    """Each text's distinct words and how often it has them."""
    names, code, ends = bags(texts)
    out, many = [], []
    for a, z in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        c, n = np.unique(code[a:z], return_counts=True)
        out.append([names[i] for i in c.tolist()])
        many.append(n.tolist())
    return out, many


def _flat(lists, kind: pa.DataType) -> tuple[pa.ChunkedArray, np.ndarray]:
    """The values of a column of lists, and how many each list has."""
    column = lists if isinstance(lists, pa.ChunkedArray) else pa.chunked_array([pa.array(lists, pa.list_(kind))])
    return pa.chunked_array([c.flatten() for c in column.chunks], kind), pc.list_value_length(column).to_numpy().astype(np.int64)


def fit(words, counts, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Learn from each text's distinct words and their counts, given as lists or as Arrow columns; a Python string is made per different word only."""
    labels = np.asarray(labels, np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(None, None, np.array([float(labels.mean()) if len(labels) else 0.0]))
    said, sizes = _flat(words, pa.string())
    many = _flat(counts, pa.int32())[0].to_numpy()
    coded = said.dictionary_encode()
    names = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.string())  # the last chunk's is whole
    code = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in coded.chunks)]).astype(np.int32)
    ends = np.cumsum(sizes)
    upto = np.append(0, np.cumsum(many, dtype=np.int64))
    share = many / np.repeat(np.maximum(1, upto[ends] - upto[ends - sizes]), sizes)
    parts = [subwords(names.slice(lo, NAMES).to_pylist()) for lo in range(0, len(names), NAMES)]
    rows, per = (np.concatenate([np.zeros(0, np.int64 if i else np.int32), *(x[i] for x in parts)]) for i in (0, 1))
    del said, coded, names, many, upto, parts
    first = np.cumsum(per) - per
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (vectors, layer, bias)]
    turn = 0
    epochs = max(epochs, -(-UPDATES // -(-len(labels) // MINIBATCH)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), MINIBATCH):
            d = order[lo : lo + MINIBATCH]
            at = gather(ends[d] - sizes[d], sizes[d])
            part = share[at]
            of = np.repeat(np.arange(len(d)), sizes[d])
            used, to = np.unique(code[at], return_inverse=True)
            sub, n = rows[gather(first[used], per[used])], per[used]
            word = _mean(vectors[sub], n)
            text = np.stack([np.bincount(of, word[to, j] * part, len(d)) for j in range(DIMENSIONS)], 1)
            z = text @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[d]
            p[np.arange(len(d)), y] -= 1
            g = p * weight[y][:, None] / len(d)
            to_text = g @ layer.T
            to_word = np.stack([np.bincount(to, to_text[of, j] * part, len(used)) for j in range(DIMENSIONS)], 1) / n[:, None]
            spread = np.repeat(np.arange(len(used)), n)
            to_vectors = np.stack([np.bincount(sub, to_word[spread, j], BUCKETS) for j in range(DIMENSIONS)], 1)
            turn += 1
            for x, grad, (m, v) in zip((vectors, layer, bias), (to_vectors, text.T @ g, g.sum(0)), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                x -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Model(vectors, layer, bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows that aren't held out; at most `most` of them."""
    own = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(key))).select(key, F.col(label).alias("_label"))
    few = own.orderBy(F.xxhash64(key), key, "_label").limit(most)
    rows = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(few), key).select(F.col(key).alias("key"), F.col("_label").cast("long").alias("label"), F.col("_text").alias("text"))

    def run(it):
        for b in it:
            for s, z in batches(b.column(2), 8_000_000):
                part = b.slice(s, z - s)
                words, counts = counted(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], ["key", "label", "words", "counts"])

    kind = dict(docs.dtypes)[key]
    found = rows.mapInArrow(releasing(run), f"key {kind}, label long, words array<string>, counts array<int>")
    got = found.orderBy("key", "label", F.xxhash64("words", "counts")).limit(most).toArrow()  # `most` rows of distinct words
    model = fit(got["words"], got["counts"], got["label"].to_numpy())
    del got
    trim()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.layer, model.bias))  # BUCKETS x DIMENSIONS floats

    def run(it):
        m = Model(*shared.value)
        for b in it:
            keys, t = b.column(0), b.column(1)
            for s, z in batches(t, 8_000_000):
                x = m.scores(t.slice(s, z - s))
                yield pa.RecordBatch.from_arrays([keys.slice(s, z - s), pa.array(x), pa.array((x >= threshold).astype(np.int32))], [key, "score", "predicted"])

    out = docs.select(key, text).mapInArrow(releasing(run), f"{key} {dict(docs.dtypes)[key]}, score double, predicted int")
    return out.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", "predicted")
