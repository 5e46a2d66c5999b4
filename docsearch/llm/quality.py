"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of every document is encoded from what its bytes look like
(shares of character classes, how classes follow each other, word lengths, repetition) and from its words (each adds the
learnt row of its hash bucket); a gated attention layer weights the encodings, and the weighted sum gives the score. Only
document labels are known in training; the attention weights and the word rows are learnt from them.

Training fits on a sample of labelled documents, half of each label, taken in the order of a hash of doc_id, with all their
passages: at most TRAIN_DOCS documents and TRAIN_PASSAGES passages. Only their passage features (not texts) come to the driver.
Scoring is one pass over the table without a shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.llm.common import buffer_of, cut, discard, ready, released, slices, text_or_empty, with_fields
from docsearch.llm.wordbytes import word_hashes, words

PASSAGE = 64
#: Bounds of the labelled sample that the classifier is fitted on: documents, and passages of these together. A document is in
#: the sample as a whole or not at all.
TRAIN_DOCS, TRAIN_PASSAGES = 3000, 60_000
#: Hash buckets of words.
BUCKETS = 4096

CLASSES = 14
_CLASS = np.full(256, 12, np.uint8)  # other marks
_CLASS[:33] = 13
_CLASS[[9, 10, 11, 12, 13]] = 1
_CLASS[32] = 0
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
for _k, _chars in ((5, "."), (6, ","), (7, "!?"), (8, "#*"), (9, "$%&@^~"), (10, "|<>{}[]\\/=_+`"), (11, "'\"()-:;")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 2
_GROUP = np.array([0, 0, 1, 2, 3, 4, 4, 5, 5, 5, 5, 4, 5, 5])
N_FEATURES = CLASSES + 36 + 9


def passage_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows) and the number of the first passage of each document (and of the end).
    A document without words has one passage of zeros."""
    return passages(buf, offs)[:2]


def passages(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``passage_features``, the number of words of each passage, and the hash bucket of every word (A-Z count as a-z)."""
    starts, ends, first = words(buf, offs)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    at = np.concatenate([[0], np.cumsum(n_pass)])
    x = np.zeros((int(at[-1]), N_FEATURES), np.float32)
    n_of = np.zeros(int(at[-1]), np.int64)
    if not len(starts):
        return x, at, n_of, np.zeros(0, np.uint16)
    hashes = word_hashes(buf, starts, ends, lower=True)
    doc_of = np.repeat(np.arange(len(n_words)), n_words)
    p_of = at[doc_of] + (np.arange(len(starts)) - first[doc_of]) // PASSAGE
    head = np.flatnonzero(np.concatenate([[True], p_of[1:] != p_of[:-1]]))
    row, count = p_of[head], np.diff(np.concatenate([head, [len(starts)]]))
    n_of[row] = count
    # from the first byte of a passage's first word to the first byte of the next passage, or the document's end
    lo, hi = starts[head], np.minimum(np.concatenate([starts[head[1:]], [len(buf)]]), offs[doc_of[head] + 1])
    kind = _CLASS[buf]
    size = (hi - lo).astype(np.float32)[:, None]
    edges = np.column_stack([lo, hi]).ravel()
    spans = np.diff(np.concatenate([[0], edges, [len(buf)]]))
    none = len(head)  # bytes between passages
    owner = np.repeat(np.concatenate([np.column_stack([np.full(none, none), np.arange(none)]).ravel(), [none]]), spans)
    x[row, :CLASSES] = np.bincount(owner * CLASSES + kind, minlength=(none + 1) * CLASSES).reshape(-1, CLASSES)[:none] / size
    group = _GROUP[kind]
    owner[hi - 1] = none  # the last byte of a passage has none after it
    pair = owner[:-1] * 36 + group[:-1] * 6 + group[1:]
    x[row, CLASSES : CLASSES + 36] = np.bincount(pair, minlength=(none + 1) * 36).reshape(-1, 36)[:none] / size
    lens = (ends - starts).astype(np.float32)
    mean = lambda v: np.add.reduceat(v.astype(np.float32), head) / count
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (p_of[1:] == p_of[:-1])
    order = np.lexsort((hashes, p_of))
    fresh = np.ones(len(starts), np.float32)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (p_of[order][1:] != p_of[order][:-1])
    last = kind[ends - 1]
    base = CLASSES + 36
    for j, v in enumerate((np.minimum(lens, 40) / 10, lens == 1, lens > 12, lens > 20, same, fresh, last >= 7, kind[starts] == 3, kind[ends - 1] == 3)):
        x[row, base + j] = mean(v)
    return x, at, n_of, (hashes % np.uint64(BUCKETS)).astype(np.uint16)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class Bags:
    """Passages (rows of x) of some documents (at: the first of each, and the end) and their words (n: words of each passage)."""

    x: np.ndarray
    at: np.ndarray
    n: np.ndarray
    words: np.ndarray

    def of(self, docs: np.ndarray, first: np.ndarray) -> Bags:
        """The bags of ``docs``; ``first``: the first word of each passage, and the end."""
        rows = np.concatenate([np.arange(self.at[d], self.at[d + 1]) for d in docs])
        words = np.concatenate([self.words[first[self.at[d]] : first[self.at[d + 1]]] for d in docs])
        return Bags(self.x[rows], np.concatenate([[0], np.cumsum(np.diff(self.at)[docs])]), self.n[rows], words)


@dataclass
class Model:
    """Encoder h = tanh([x, mean of E over the words]W + b); attention e = w'(tanh(hV) * sigmoid(hU)), softmax over a document;
    score = sigmoid(zc + d)."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def forward(self, bags: Bags) -> dict[str, np.ndarray]:
        p, at = self.params, bags.at
        f = np.zeros((len(bags.x), len(self.mean) + p["E"].shape[1]), p["E"].dtype)
        f[:, : len(self.mean)] = np.clip((bags.x - self.mean) / self.scale, -6, 6)
        some = np.flatnonzero(bags.n)
        if len(some):
            first = np.concatenate([[0], np.cumsum(bags.n[some])[:-1]])
            f[some, len(self.mean) :] = np.add.reduceat(p["E"][bags.words], first) / bags.n[some, None]
        h = np.tanh(f @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        n = np.diff(at)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, at[:-1]), n)
        z = np.add.reduceat(h * a[:, None], at[:-1], axis=0)
        return {"f": f, "h": h, "t": t, "g": g, "a": a, "z": z, "s": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, bags: Bags) -> np.ndarray:
        return self.forward(bags)["s"]


def gradient(model: Model, bags: Bags, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss, by parameter."""
    p, width = model.params, bags.x.shape[1]
    q = model.forward(bags)
    many, each = np.diff(bags.at), np.repeat(np.arange(len(y)), np.diff(bags.at))
    ds = (q["s"] - y) / len(y)
    dz = ds[:, None] * p["c"]
    da = (q["h"] * dz[each]).sum(1)
    de = q["a"] * (da - np.repeat(np.add.reduceat(q["a"] * da, bags.at[:-1]), many))
    dt, dg = de[:, None] * p["w"] * q["g"] * (1 - q["t"] ** 2), de[:, None] * p["w"] * q["t"] * q["g"] * (1 - q["g"])
    dh = (dz[each] * q["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - q["h"] ** 2)
    dx = (dh @ p["W"][width:].T) / np.maximum(1, bags.n)[:, None]
    owner = np.repeat(np.arange(len(bags.n)), bags.n)
    de_w = np.stack([np.bincount(bags.words, dx[owner, j], BUCKETS) for j in range(p["E"].shape[1])], 1)
    return {"E": de_w, "W": q["f"].T @ dh, "b": dh.sum(0), "V": q["h"].T @ dt, "U": q["h"].T @ dg, "w": (q["t"] * q["g"]).T @ de, "c": q["z"].T @ ds, "d": ds.sum(keepdims=True)}


def fit(bags: Bags, y: np.ndarray, epochs: int = 24, hidden: int = 24, gate: int = 12, per_word: int = 8, batch: int = 64, seed: int = 7) -> Model:
    """Minimises log loss by Adam. y: one label a document; with one label only, the scores lean to that label."""
    rng = np.random.default_rng(seed)
    mean, scale = bags.x.mean(0), bags.x.std(0) + 1e-3
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    width = bags.x.shape[1]
    p = {"E": rng.normal(0, 0.1, (BUCKETS, per_word)), "W": init(width + per_word, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "d": np.zeros(1)}
    model, m, v, step = Model(mean, scale, p), {}, {}, 0
    first = np.concatenate([[0], np.cumsum(bags.n)])
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            own = bags.of(docs, first)
            grads = gradient(model, own, y[docs])
            step += 1
            rate = 0.01 * (0.1 if epoch > 0.7 * epochs else 1)
            for key, g in grads.items():
                g = g + 1e-4 * p[key]
                m[key] = 0.9 * m.get(key, 0) + 0.1 * g
                v[key] = 0.999 * v.get(key, 0) + 0.001 * g * g
                p[key] -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 3 is 1 (a null doc_id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, y, text) -> (_id, y, passages, x, n, words), the arrays as bytes."""
    for b in batches:
        buf, offs = buffer_of(b.column(2))
        for i, j in slices(offs):
            x, at, n, w = passages(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            first = np.concatenate([[0], np.cumsum(n)])
            parts = [(x[p:q].tobytes(), n[p:q].astype(np.int32).tobytes(), w[first[p] : first[q]].tobytes()) for p, q in zip(at[:-1], at[1:], strict=True)]
            blobs = [pa.array(c, pa.binary()) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(at)), *blobs], ["_id", "y", "passages", "x", "n", "w"])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, most: int = TRAIN_PASSAGES) -> Model | None:
    """Fits on at most ``limit`` labelled documents outside the held-out third that ``docs`` has, and on at most ``most`` passages:
    of each label documents are taken in the order of a hash of doc_id; one that doesn't fit into what is left of half of ``most`` is left
    out, and the next is tried. None if there is no such document; a warning says so. Null labels and ids are left out; a
    document labelled more than once counts as 1 if most of its labels do; of several texts with one doc_id one is taken."""
    ready(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_q")).dropna()
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg((F.avg("_q") >= 0.5).cast("int").alias("y"))
    known = known.join(docs.select(F.col("doc_id").alias("_id")).dropna().distinct(), "_id", "left_semi")  # an earlier stage may have dropped some
    half = [known.filter(F.col("y") == v).orderBy(F.xxhash64("_id"), "_id").limit(limit // 2) for v in (0, 1)]
    sample = F.broadcast(half[0].unionByName(half[1]))  # at most ``limit`` rows
    rows = docs.select(F.col("doc_id").alias("_id"), text_or_empty().alias("_t")).join(sample, "_id").select(F.col("_id").cast("long").alias("_id"), "y", "_t")
    drawn = cut(rows.mapInArrow(released(_features), "_id long, y int, passages long, x binary, n binary, w binary").groupBy("_id").agg(F.min(F.struct("y", "passages", "x", "n", "w")).alias("r")).select("_id", "r.*"))
    each = most // 2
    sizes = drawn.filter(F.col("passages") <= each).groupBy("y").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("_id").alias("h"), "_id", "passages"))).alias("all"))  # at most ``limit`` in all
    taken = F.aggregate(
        "all",
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("ids")),
        lambda acc, r: F.when(acc["sum"] + r["passages"] > each, acc).otherwise(F.struct((acc["sum"] + r["passages"]).alias("sum"), F.array_append(acc["ids"], r["_id"]).alias("ids"))),
    )
    fits = sizes.select(F.explode(taken["ids"]).alias("_id"))
    got = drawn.join(F.broadcast(fits), "_id").select("y", "x", "n", "w").toArrow()
    discard(drawn)
    if not got.num_rows:
        warnings.warn("quality: no labelled document to learn from; every score is 0.5", stacklevel=2)
        return None
    parts = sorted(zip(*(got.column(c).to_pylist() for c in ("y", "x", "n", "w")), strict=True))
    read = lambda k, kind: [np.frombuffer(r[k], kind) for r in parts]
    x = [v.reshape(-1, N_FEATURES) for v in read(1, np.float32)]
    at = np.concatenate([[0], np.cumsum([len(v) for v in x])])
    bags = Bags(np.concatenate(x).astype(np.float64), at, np.concatenate(read(2, np.int32)).astype(np.int64), np.concatenate(read(3, np.uint16)))
    return fit(bags, np.array([r[0] for r in parts], float))


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score. Null and empty texts are scored as a passage without words;
    without a model every score is 0.5. Nothing but the text decides a score."""
    ready(docs.sparkSession)
    names = list(keep)
    if model is None:
        return docs.select(*names, F.lit(0.5).alias("score"))
    plain = Model(model.mean.astype(np.float32), model.scale.astype(np.float32), {k: v.astype(np.float32) for k, v in model.params.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffer_of(b.column(b.num_columns - 1))
            for i, j in slices(offs):
                s = plain.score(Bags(*passages(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(names))), pa.array(s)], [*names, "score"])

    source = docs.select(*names, text_or_empty().alias("_t"))
    return source.mapInArrow(released(run), with_fields(docs.select(*names).schema, "score double"))


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (columns doc_id, text; others are ignored).
    Repeated rows stay; a null doc_id is scored like any other row; an empty table gives an empty result."""
    out = score(docs, train(docs, labels, limit))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, limit: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, with the columns they had (also columns of other names than those of
    documents). Null and empty texts are scored as a passage without words; repeated rows go or stay together; an empty table gives an
    empty one; very long texts are scored by all their passages."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text")
    return score(packed, train(docs, labels, limit), ("_row",)).filter(F.col("score") >= least).select("_row.*")
