"""Mixing documents to target weights with soft domain membership.

A multinomial classifier, fitted on labelled documents, gives every document a posterior over domains. The document rates r >= 0
(how often a document is to be taken) minimise the weighted least squares of sum_i r_i * tokens_i * posterior_i against the
target token total of each domain, by projected gradient from r = 1. A step changes a rate by a product of the document's
posterior with one small vector, so nothing is stored for a document between steps: each step is one pass over the table of
(tokens, posterior), which replays the steps so far and sums one residual for each domain. Only these sums reach the driver.
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
from docsearch.llm.quality import N_FEATURES, passage_features
from docsearch.llm.wordbytes import word_hashes, words

#: Bound of the labelled sample that the classifier is fitted on, in all domains together.
TRAIN_DOCS = 3000
#: Words whose presence counts as a feature.
VOCABULARY = 512
#: Share of the tokens that the last step of the fit may still move.
STILL = 1e-5
#: Steps after which the rates are stored, so that a later step replays so many at most.
STORED = 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _letters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters, and the number of the first run of each document."""
    starts, ends, first = words(np.where(_LETTER[buf], buf, np.uint8(32)), offs)
    return word_hashes(buf, starts, ends), first


def _shape(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    x, at = passage_features(buf, offs)
    return np.add.reduceat(x, at[:-1]) / np.diff(at)[:, None]


@dataclass
class Classifier:
    """Softmax over domains of the mean passage features and the presence of some words."""

    domains: list[str]
    vocabulary: np.ndarray  # ascending hashes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        h, first = _letters(buf, offs)
        x = np.zeros((len(offs) - 1, len(self.mean)))
        x[:, :N_FEATURES] = np.clip((_shape(buf, offs) - self.mean[:N_FEATURES]) / self.scale[:N_FEATURES], -6, 6)
        if len(self.vocabulary) and len(h):
            k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            hit = np.flatnonzero(self.vocabulary[k] == h)
            x[np.searchsorted(first, hit, "right") - 1, N_FEATURES + k[hit]] = 1
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _softmax_fit(x: np.ndarray, y: np.ndarray, k: int, steps: int = 300, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    m, v = np.zeros((x.shape[1] + 1, k)), np.zeros((x.shape[1] + 1, k))
    one = np.eye(k)[y]
    for t in range(1, steps + 1):
        z = x @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        d = (z / z.sum(1, keepdims=True) - one) / len(y)
        g = np.vstack([x.T @ d + decay * w, d.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def label_domain() -> Column:
    """The default domains of a labels row: low (quality 0), toxic, clean; null where a label that decides is null."""
    return F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")


def _telling_words(drawn: DataFrame, domains: list[str]) -> np.ndarray:
    """Hashes of the VOCABULARY words, of those in three documents at least, whose share of documents differs most inside and outside
    of a domain. ``drawn``: d, h. Words are counted by Spark; only the chosen ones come to the driver."""
    size = {r["d"]: r["count"] for r in drawn.groupBy("d").count().collect()}  # one row for each domain
    n = max(1, sum(size.values()))
    inside = lambda d: F.count(F.when(F.col("d") == d, 1))
    counted = drawn.select("d", F.explode("h").alias("w")).groupBy("w").agg(F.count("*").alias("all"), *(inside(d).alias(f"in_{k}") for k, d in enumerate(domains)))
    share = F.col("all") / n
    gaps = [
        F.pow(F.col(f"in_{k}") / max(1, size.get(d, 0)) - (F.col("all") - F.col(f"in_{k}")) / max(1, n - size.get(d, 0)), F.lit(2)) / (share * (1 - share) + 1e-3)
        for k, d in enumerate(domains)
    ]
    best = counted.filter(F.col("all") >= 3).select("w", (F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("gap")).orderBy(F.desc("gap"), "w").limit(VOCABULARY)
    return np.sort(np.array([r["w"] for r in best.collect()], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column | None = None, limit: int = TRAIN_DOCS) -> Classifier | None:
    """Fits on at most ``limit`` documents, as many of each domain, in the order of a hash of doc_id. None without any.
    A document with several labels counts in the domain that is least by name."""
    ready(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), (label_domain() if domain is None else domain).alias("_d")).dropna()
    present = docs.select(F.col("doc_id").alias("_id")).dropna().distinct()  # an earlier stage may have dropped labelled documents
    known = known.filter(F.col("_d").isin(domains)).groupBy("_id").agg(F.min("_d").alias("_d")).join(present, "_id", "left_semi")
    counts = {r["_d"]: r["count"] for r in known.groupBy("_d").count().collect()}  # one row for each domain
    parts = [known.filter(F.col("_d") == d).orderBy(F.xxhash64("_id"), "_id").limit(limit // len(domains)) for d in domains]
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.unionByName(p)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffer_of(b.column(2))
            for i, j in slices(offs):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                h, first = _letters(part, o)
                x = pa.array([r.tobytes() for r in _shape(part, o).astype(np.float32)], pa.binary())
                sets = [np.unique(h[p:q]).view(np.int64) for p, q in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), x, pa.array(sets, pa.list_(pa.int64()))], ["_id", "d", "x", "h"])

    rows = docs.select(F.col("doc_id").alias("_id"), text_or_empty().alias("_t")).join(F.broadcast(sample), "_id")  # at most ``limit`` rows
    read = rows.select(F.col("_id").cast("long").alias("_id"), "_d", "_t").mapInArrow(released(features), "_id long, d string, x binary, h array<long>")
    drawn = cut(read.groupBy("_id").agg(F.min(F.struct("d", "x", "h")).alias("r")).select("_id", "r.*"))  # of several texts with one doc_id one is taken
    vocabulary = _telling_words(drawn, domains)
    known_words = F.array(*(F.lit(w) for w in vocabulary.view(np.int64).tolist())).cast("array<long>")
    got = drawn.select("d", "x", F.array_intersect("h", known_words).alias("h")).toArrow()  # at most ``limit`` rows of bounded size
    discard(drawn)
    if not got.num_rows:
        return None
    ordered = sorted(zip(*(got.column(c).to_pylist() for c in ("d", "x", "h")), strict=True))
    y = np.array([domains.index(d) for d, _, _ in ordered])
    x = np.array([np.frombuffer(v, np.float32) for _, v, _ in ordered], float)
    bags = [np.array(v, np.int64).view(np.uint64) for _, _, v in ordered]
    size = np.bincount(y, minlength=len(domains))
    mean, scale = np.zeros(N_FEATURES + len(vocabulary)), np.ones(N_FEATURES + len(vocabulary))
    mean[:N_FEATURES], scale[:N_FEATURES] = x.mean(0), x.std(0) + 1e-3
    full = np.hstack([np.clip((x - mean[:N_FEATURES]) / scale[:N_FEATURES], -6, 6), np.array([np.isin(vocabulary, b) for b in bags], float).reshape(len(y), -1)])
    w, b = _softmax_fit(full, y, len(domains))
    b = b + np.log([(counts.get(d, 0) + 1) / (size[k] + 1) for k, d in enumerate(domains)])  # the sample is even, the labels aren't
    return Classifier(domains, vocabulary, mean, scale, w, b)


def memberships(docs: DataFrame, model: Classifier | None, domains: list[str], keep: tuple[str, ...] = ("doc_id",), moves: np.ndarray | None = None, max_rate: float | None = None) -> DataFrame:
    """The columns ``keep``, n_tokens (words of the text) and posteriors (array of double, in the order of ``domains``) of every
    row of ``docs``, and with the ``moves`` of ``fit_rates`` its rate. Null and empty texts have no tokens. Without a model all
    posteriors are equal."""
    ready(docs.sparkSession)
    schema = with_fields(docs.select(*keep).schema, "n_tokens long, posteriors array<double>" + ", rate double" * (moves is not None))
    names = schema.names
    k = len(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffer_of(b.column(b.num_columns - 1))
            for i, j in slices(offs):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                n = np.diff(words(part, o)[2])
                p = np.full((j - i, k), 1 / k) if model is None else model.posteriors(part, o)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * k), pa.array(p.ravel()))
                rate = [] if moves is None else [pa.array(_replay(p, moves, max_rate))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(len(keep))), pa.array(n.astype(np.int64)), lists, *rate], names)

    return docs.select(*keep, text_or_empty().alias("_t")).mapInArrow(released(run), schema)


def _replay(p: np.ndarray, steps: np.ndarray, top: float | None, start: np.ndarray | None = None) -> np.ndarray:
    r = np.ones(len(p)) if start is None else start
    for s in steps:
        r = np.clip(r - p @ s, 0, top)
    return r


def fit_rates(members: DataFrame, weights: dict[str, float], budget: float | None = None, max_rate: float | None = None, steps: int = 300, tolerance: float = 1e-4) -> np.ndarray:
    """The steps (rows) of the projected gradient for a table with n_tokens and posteriors, whose order of domains is that of
    ``weights``. ``budget``: the token total to reach; by default as many as are there, or with a ``max_rate`` of R, the most
    that the domain of the largest weight allows: R times its expected tokens over its weight. Ends when every domain's
    total is within ``tolerance`` of its own target, or at the least loss that the bounds allow: a step moves less than a
    hundred-thousandth of the tokens. Targets that are missed then, or after ``steps``, are reported by a warning."""
    k = len(weights)
    share = np.array(list(weights.values()), float)
    share = share / share.sum()
    col = lambda d: F.element_at("posteriors", d + 1)
    n = F.col("n_tokens").cast("double")
    first = members.agg(F.sum(n), *(F.sum(n * col(d)) for d in range(k)), *(F.sum(n * col(d) * col(e)) for d in range(k) for e in range(k))).first()
    if not first[0]:
        return np.zeros((0, k))
    total, mass = first[0], np.array(first[1 : k + 1])
    gram = np.array(first[k + 1 :]).reshape(k, k) / total
    if budget is None:
        budget = total if max_rate is None else min(total * max_rate, float(max_rate * mass[share.argmax()] / share.max()))
    target = share * budget / total
    scale = 1 / np.maximum(mass / total, 1e-6)
    rate = 1 / max(1e-9, np.linalg.eigvalsh(np.sqrt(scale)[:, None] * gram * np.sqrt(scale)).max())
    done = np.zeros((0, k))
    kept = members.select("n_tokens", "posteriors", F.lit(1.0).alias("r"))  # with the rates after the first ``since`` steps
    since = 0

    def stored(moves: np.ndarray) -> DataFrame:
        """``kept`` with the rates after ``moves`` more steps, as a table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                r = _replay(p, moves, max_rate, b.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(r)], ["n_tokens", "posteriors", "r"])

        return cut(kept.mapInArrow(released(run), "n_tokens long, posteriors array<double>, r double"))

    def residual(moves: np.ndarray) -> tuple[np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k + 1)
            for b in batches:
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                n = b.column(0).to_numpy(zero_copy_only=False)
                r = _replay(p, moves[:-1], max_rate, b.column(2).to_numpy(zero_copy_only=False))
                last = _replay(p, moves[-1:], max_rate, r)
                out += [*((last * n) @ p), np.abs(last - r) @ n]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], [f"s{d}" for d in range(k + 1)])

        parts = kept.mapInArrow(released(run), ", ".join(f"s{d} double" for d in range(k + 1)))
        sums = np.array(parts.agg(*(F.sum(f"s{d}") for d in range(k + 1))).first(), float) / total
        return sums[:k] - target, float(sums[k])

    while True:
        e, moved = residual(done[since:])
        met = bool((np.abs(e) <= tolerance * target).all())
        if met or len(done) and moved <= STILL or len(done) >= steps:
            break
        if len(done) - since >= STORED:
            before, kept, since = kept, stored(done[since:]), len(done)
            discard(before)
        done = np.vstack([done, np.round(rate * scale * e, 12)])
    discard(kept)
    if not met:
        missed = ", ".join(f"{d} {100 * x / max(t, 1e-12):+.4f} %" for d, x, t in zip(weights, e, target, strict=True))
        warnings.warn(f"mixing: targets missed after {len(done)} steps (the last moved {moved:.1e} of the tokens): {missed}", stacklevel=2)
    return done


def with_rates(members: DataFrame, moves: np.ndarray, max_rate: float | None = None) -> DataFrame:
    """``members`` with rate (double)."""
    place = members.columns.index("posteriors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(place)
            width = len(p.flatten()) // max(1, len(p))
            r = _replay(p.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), moves, max_rate) if len(p) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], [*b.schema.names, "rate"])

    return members.mapInArrow(released(run), with_fields(members.schema, "rate double"))


def copies() -> Column:
    """How often a row with doc_id and rate is taken: the whole part of rate plus a share in [0, 1) that is fixed by a hash of
    doc_id, so that the expected number is the rate. A null doc_id counts as an id of its own."""
    u = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.round(F.col("rate"), 6) + u).cast("long")


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], max_rate: float | None = None, budget: float | None = None, domain: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate, copies for every row of ``docs`` (columns doc_id, text; others are ignored).
    Repeated rows have equal results; empty tables give an empty result; without labels all posteriors are equal."""
    domains = list(weights)
    members = cut(memberships(docs, train(docs, labels, domains, domain), domains))
    return with_rates(members, fit_rates(members, weights, budget, max_rate), max_rate).withColumn("copies", copies())


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float], max_rate: float | None = 1.0, budget: float | None = None, domain: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as ``copies`` says (with a max_rate of 1 once at most), with the columns they had.
    Null and empty texts have no tokens and are taken by the rate of their posteriors; repeated rows have equal rates and, with one doc_id,
    the same fate; an empty table gives an empty one; a very long text counts with all its words.
    The posteriors are computed a second time along the texts rather than joined to them, which would shuffle the texts."""
    domains, held = list(weights), "_held"
    model = train(docs, labels, domains, domain)
    moves = fit_rates(cut(memberships(docs, model, domains, ())), weights, budget, max_rate)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(held), "doc_id", "text")
    rated = memberships(packed, model, domains, (held, "doc_id"), moves, max_rate).withColumn("copies", copies())
    taken = rated.filter("copies > 0").select(held, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_n"))
    return taken.select(f"{held}.*")
