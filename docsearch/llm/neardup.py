"""Near-duplicate documents by MinHash with tensored banding.

Plain banding needs (tables x band width) minhash values for each document. Here a document has two small collections of
GROUPS bands each; a table key combines one band of the first collection with one of the second, so GROUPS x GROUPS tables
come from 2 x GROUPS bands: the number of minhash values is about the square root of what the tables would need.
Two documents meet in a table exactly if they share a band in both collections, which the plan uses: bands that one document
alone has are dropped before any table key is formed.

Documents with equal word sequences form a class, and only classes are compared. Pairs that set sizes and sketches don't rule
out are the candidates:

1. in a table bucket each class is tried with one root of the bucket; candidates join classes to areas;
2. in buckets that still hold classes of several areas, each class is tried with all those of other areas, block by block
   (``rest_of_buckets``): so every two classes that meet in a bucket are in one area, or are ruled out;
3. each class is confirmed on full shingle sets against its best candidate, and the links found are joined to components;
4. classes of one area, but of different components, are compared exactly, block by block (``confirm_blocks``).

So a group of copies costs about one comparison a copy; no step lists the pairs of a group, and no cap is set on a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.llm.common import buffer_of, cut, discard, ready, released, slices, small, text_or_empty, with_fields
from docsearch.llm.components import components
from docsearch.llm.wordbytes import constants, mix, shingles, word_hashes, words


@dataclass(frozen=True)
class Setting:
    """Links need ``100 * intersection >= percent * union`` on sets of ``words``-word shingles. ``agree``: the least number of
    equal minhash values, of 2 * groups * width, with which a candidate is confirmed on its sets (below: a similarity of
    ``percent`` has a chance under one in 100,000)."""

    words: int = 5
    percent: int = 80
    width: int = 3
    recall: float = 0.9995

    @property
    def groups(self) -> int:
        """Bands of each collection, so that a pair at the threshold meets with probability ``recall``."""
        p, g = (self.percent / 100) ** self.width, 2
        while (1 - (1 - p) ** g) ** 2 < self.recall:
            g += 1
        return g

    @property
    def hashes(self) -> int:
        return 2 * self.groups * self.width

    @property
    def agree(self) -> int:
        p = self.percent / 100
        return int(self.hashes * p - 4.4 * (self.hashes * p * (1 - p)) ** 0.5)


def _sets(buf: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    starts, ends, first = words(buf, offs)
    flat, at = shingles(word_hashes(buf, starts, ends), first, k)
    return [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _class(raw: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=16).digest()


def _minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minhash values (32 bits) of each non-empty set."""
    at = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    flat = np.concatenate(sets)
    out = np.empty((len(sets), n), np.uint64)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(zip(constants(n, 11), constants(n, 12), strict=True)):
            v = flat * a
            v ^= v >> np.uint64(31)
            v *= b
            out[:, i] = np.minimum.reduceat(v, at)
    return (out >> np.uint64(32)).astype(np.uint64)


def sketch(docs: DataFrame, setting: Setting, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, cls (16 bytes: equal for equal word sequences), n (size of the shingle set), bands (2 * groups hashes, null for an
    empty set) and mins (a short of each minhash value) of every row of ``docs``."""
    ready(docs.sparkSession)
    g, w = setting.groups, setting.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffer_of(b.column(1))
            for i, j in slices(offs):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                raw = part.tobytes()
                cls = [_class(raw[p:q]) for p, q in zip(o[:-1], o[1:], strict=True)]
                sets = _sets(part, o, setting.words)
                n = np.array([len(s) for s in sets], np.int64)
                bands: list = [None] * len(sets)
                mins: list = [None] * len(sets)
                full = np.flatnonzero(n)
                if len(full):
                    m = _minima([sets[d] for d in full], setting.hashes)
                    with np.errstate(over="ignore"):
                        keys = mix((m.reshape(len(full), 2 * g, w) * constants(w, 13)).sum(2) + np.arange(2 * g, dtype=np.uint64) * constants(1, 14))
                    keys, m = keys.astype(np.uint64).view(np.int64), m.astype(np.uint16).view(np.int16)
                    for r, d in enumerate(full):
                        bands[d], mins[d] = keys[r], m[r]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(cls, pa.binary()), pa.array(n), pa.array(bands, pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int16()))], ["doc_id", "cls", "n", "bands", "mins"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_t")).mapInArrow(released(run), "doc_id long, cls binary, n long, bands array<long>, mins array<smallint>")


def buckets(classes: DataFrame, setting: Setting) -> DataFrame:
    """(table_key, cls): the table buckets that hold two classes at least. ``classes``: cls, bands."""
    bands = classes.select("cls", F.posexplode("bands").alias("g", "band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band")
    live = bands.join(shared, "band", "left_semi")
    side = lambda first: F.collect_list(F.when(F.col("g") < setting.groups if first else F.col("g") >= setting.groups, F.col("band")))
    both = live.groupBy("cls").agg(side(True).alias("p"), side(False).alias("q")).filter("size(p) > 0 and size(q) > 0")  # at most 2 * groups entries
    keys = both.select("cls", F.explode("p").alias("x"), "q").select("cls", "x", F.explode("q").alias("y")).select(F.xxhash64("x", "y").alias("table_key"), "cls")
    many = keys.groupBy("table_key").agg(F.count("*").alias("c")).filter("c > 1").select("table_key")
    return keys.join(many, "table_key", "left_semi")


def _plausible(a: str, b: str, setting: Setting) -> Column:
    """Set sizes and minhash values (columns {a}n, {a}mins ...) leave room for a similarity of ``percent``."""
    sizes = 100 * F.least(f"{a}n", f"{b}n") >= setting.percent * F.greatest(f"{a}n", f"{b}n")
    return sizes & (F.col("agree") >= setting.agree)


def candidates(pairs: DataFrame, classes: DataFrame, setting: Setting) -> DataFrame:
    """Of the class pairs (a, b) those that sizes and minhash values don't rule out, with the number of equal values."""
    info = classes.select("cls", "n", "mins")
    one = info.select(F.col("cls").alias("a"), F.col("n").alias("a_n"), F.col("mins").alias("a_mins"))
    two = info.select(F.col("cls").alias("b"), F.col("n").alias("b_n"), F.col("mins").alias("b_mins"))
    equal = F.size(F.filter(F.zip_with("a_mins", "b_mins", lambda x, y: x == y), lambda same: same))
    return pairs.join(one, "a").join(two, "b").withColumn("agree", equal).filter(_plausible("a_", "b_", setting)).select("a", "b", "agree")


def shingle_sets(docs: DataFrame, wanted: DataFrame, setting: Setting) -> DataFrame:
    """(cls, grams) for the classes in ``wanted`` (cls, doc_id of one of its documents)."""
    ids = small(wanted.select(F.col("doc_id").alias("_id")).distinct())
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("_t")).join(ids, "_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffer_of(b.column(1))
            for i, j in slices(offs):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                raw = part.tobytes()
                sets = _sets(part, o, setting.words)
                grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(s) for s in sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_class(raw[p:q]) for p, q in zip(o[:-1], o[1:], strict=True)], pa.binary()), grams], ["cls", "grams"])

    return source.mapInArrow(released(run), "cls binary, grams array<long>")


def candidate_sets(pairs: DataFrame, docs: DataFrame, classes: DataFrame, setting: Setting) -> DataFrame:
    """(cls, grams) of every class in ``pairs``."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = cut(classes.select("cls", "doc_id").join(ends, "cls", "left_semi"))
    # a doc_id may stand for several texts: only the wanted classes stay
    return shingle_sets(docs, wanted, setting).join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def confirm(pairs: DataFrame, sets: DataFrame, setting: Setting) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough."""
    one = sets.select(F.col("cls").alias("a"), F.col("grams").alias("a_grams"))
    two = sets.select(F.col("cls").alias("b"), F.col("grams").alias("b_grams"))
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    union = F.size("a_grams") + F.size("b_grams") - common
    return pairs.join(one, "a").join(two, "b").filter(100 * common >= setting.percent * union).select("a", "b")


#: Classes of one block of ``rest_of_buckets`` and ``confirm_blocks``.
BLOCK = 512


def _block_pairs(members: DataFrame, group: str, part: str) -> DataFrame:
    """``members`` (cls, {group}, {part}, others) with block, lo and hi: a row for each pair of blocks (lo, hi) that its own block
    is in. A group is dealt into blocks of about BLOCK classes, those of its largest part apart from the others; blocks of the
    largest part meet the others only. Groups of one part have no rows."""
    counts = members.groupBy(group, part).agg(F.count("*").alias("n"))
    groups = counts.groupBy(group).agg(F.max_by(part, F.struct("n", part)).alias("main"), F.max("n").alias("most"), F.sum("n").alias("size"), F.count("*").alias("parts"))
    sizes = groups.filter("parts > 1").select(group, "main", F.ceil(F.col("most") / BLOCK).alias("p"), F.ceil((F.col("size") - F.col("most")) / BLOCK).alias("q"))
    hashed = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    main = F.col(part) == F.col("main")
    dealt = members.join(small(cut(sizes)), group).withColumn("block", F.when(main, hashed("p")).otherwise(F.col("p") + hashed("q")))
    first = F.when(main, F.col("p")).otherwise(F.lit(0).cast("long"))
    other = F.explode(F.sequence(first, F.col("p") + F.col("q") - 1)).alias("other")
    pairs = dealt.select(*members.columns, "block", other)
    return pairs.select(*members.columns, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def _labels(parts: list, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each part, and which pairs are to be compared: those of different parts, and where a task has two blocks, of
    different blocks (pairs inside a block have a task of their own)."""
    number = {c: k for k, c in enumerate(dict.fromkeys(parts))}
    label = np.array([number[c] for c in parts])
    open_ = label[:, None] != label[None, :]
    if block.min() != block.max():
        open_ &= block[:, None] != block[None, :]
    return label, open_


def _spanning(good: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs marked in ``good``, enough to join all parts that they join."""
    root = list(range(int(label.max()) + 1))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for x, y in zip(*np.nonzero(np.triu(good)), strict=True):
        p, q = top(label[x]), top(label[y])
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def rest_of_buckets(in_buckets: DataFrame, areas: DataFrame, classes: DataFrame, setting: Setting) -> DataFrame:
    """Candidates (a, b, agree) between classes of one table bucket but different areas, enough of them to join what such pairs
    join. ``in_buckets``: table_key, cls, root (the class that the others of its bucket were tried with); ``areas``: node, root."""
    left = _labelled(in_buckets.filter("cls <> root").select("table_key", "cls"), areas, "area")
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "cls")).alias(f"mark_{seed}") for seed in (1, 2)]
    held = left.groupBy("table_key").agg(F.min("area").alias("x"), F.max("area").alias("y"), F.count("*").alias("size"), *marks)
    # one of the buckets that hold the same classes is enough
    open_ = held.filter("x <> y").groupBy("size", "mark_1", "mark_2").agg(F.min("table_key").alias("table_key")).select("table_key")
    members = cut(left.join(open_, "table_key", "left_semi"))
    info = classes.select("cls", F.col("n").alias("n_grams"), "mins")
    pairs = _block_pairs(members, "table_key", "area").join(info, "cls")
    percent, least = setting.percent, setting.agree

    def compare(t: pa.Table) -> pa.Table:
        cls = t.column("cls").to_pylist()
        label, good = _labels(t.column("area").to_pylist(), t.column("block").to_numpy())
        n = t.column("n_grams").to_numpy()
        good &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        mins = t.column("mins").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
        agree = np.zeros(good.shape, np.int16)
        for column in np.ascontiguousarray(mins.T) if good.any() else ():
            agree += column[:, None] == column[None, :]
        found = [(*sorted((cls[x], cls[y])), int(agree[x, y])) for x, y in _spanning(good & (agree >= least), label)]
        a, b, same = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "agree": pa.array(same, pa.int32())})

    return pairs.groupBy("table_key", "lo", "hi").applyInArrow(compare, "a binary, b binary, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def confirm_blocks(members: DataFrame, setting: Setting) -> DataFrame:
    """Links (a, b) between classes of one ``area`` but different ``comp``, enough of them to join what is linked.
    ``members``: cls, grams, area, comp. A task compares two blocks (``_block_pairs``): intersections are products of incidence
    matrices, in steps of a bounded number of shingles."""
    pairs = _block_pairs(members.select("area", "cls", "comp", "grams"), "area", "comp")
    percent = setting.percent

    def compare(t: pa.Table) -> pa.Table:
        cls = t.column("cls").to_pylist()
        grams = t.column("grams").combine_chunks()
        lens = np.diff(grams.offsets.to_numpy())
        owner = np.repeat(np.arange(len(cls)), lens)
        values = grams.flatten().to_numpy()
        _, ids, counts = np.unique(values, return_inverse=True, return_counts=True)
        shared = counts[ids] > 1  # a shingle of one class alone is in no intersection
        owner, ids = owner[shared], np.unique(ids[shared], return_inverse=True)[1]
        order = np.argsort(ids, kind="stable")
        owner, ids = owner[order], ids[order]
        inter = np.zeros((len(cls), len(cls)), np.float32)
        step = max(1, (32 << 20) // (4 * max(1, len(cls))))
        for a in range(0, int(ids[-1]) + 1 if len(ids) else 0, step):
            i, j = np.searchsorted(ids, [a, a + step])
            m = np.zeros((len(cls), step), np.float32)
            m[owner[i:j], ids[i:j] - a] = 1
            inter += m @ m.T
        inter = inter.astype(np.int64)
        union = lens[:, None] + lens[None, :] - inter
        label, good = _labels(t.column("comp").to_pylist(), t.column("block").to_numpy())
        out = [(cls[x], cls[y]) for x, y in _spanning(good & (100 * inter >= percent * union), label)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return pairs.groupBy("area", "lo", "hi").applyInArrow(compare, "a binary, b binary")


def _labelled(frame: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """``frame`` with the root of cls in ``parts``; a class without links is its own root."""
    roots = parts.select(F.col("node").alias("cls"), F.col("root").alias(name))
    return frame.join(roots, "cls", "left").withColumn(name, F.coalesce(name, "cls"))


def class_links(docs: DataFrame, classes: DataFrame, setting: Setting) -> DataFrame:
    """(node, root) for the classes that have a confirmed link."""
    in_buckets = cut(buckets(classes, setting))
    roots = in_buckets.groupBy("table_key").agg(F.min("cls").alias("root"))
    rooted = cut(in_buckets.join(roots, "table_key"))
    tried = rooted.filter("root <> cls").select(F.col("root").alias("a"), F.col("cls").alias("b")).distinct()
    first = cut(candidates(tried, classes, setting))
    rest = cut(rest_of_buckets(rooted, components(first), classes, setting))
    likely = first.unionByName(rest)
    sets = cut(candidate_sets(likely, docs, classes, setting))
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a"))
    links = cut(confirm(best, sets, setting))
    parts = components(links)
    members = _labelled(_labelled(sets, parts, "comp"), components(likely), "area")
    more = cut(confirm_blocks(members, setting))
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    discard(in_buckets, rooted, first, rest, sets)
    return parts


def _members(docs: DataFrame, setting: Setting) -> DataFrame:
    """doc_id, cls, n (shingles) and component_id of every row of ``docs``; component_id is null for rows without words or doc_id."""
    drawn = cut(sketch(docs, setting))
    some = drawn.filter("doc_id is not null and n > 0")
    classes = cut(some.groupBy("cls").agg(F.min(F.struct("doc_id", "n", "bands", "mins")).alias("x")).select("cls", "x.*"))
    linked = _labelled(classes.select("cls", "doc_id"), class_links(docs, classes, setting), "root")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = cut(linked.join(least, "root").select("cls", "component_id"))
    discard(classes)
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id"))
    return drawn.select("doc_id", "cls", "n").join(of_class, "cls", "left").select("doc_id", "cls", "n", own.alias("component_id"))


def link(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (columns doc_id, text; others are ignored).

    component_id is the smallest doc_id that links reach, the own one included; kept: doc_id = component_id. Rows without words
    (null, empty or blank texts) have no shingles and no links. Rows with a null doc_id are linked with nothing: their
    component_id is null and they are kept. Repeated rows have equal results. An empty table gives an empty result."""
    out = _members(docs, setting).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_class(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column _row, with _id and cls."""
    ready(docs.sparkSession)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = pa.array([_class(t.encode()) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cls], ["_row", "_id", "cls"])

    return packed.mapInArrow(released(run), with_fields(packed.select("_row", "_id").schema, "cls binary"))


def drop_copies(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id (of several texts with that doc_id, one of them).
    Rows with a null doc_id and rows without words are in no group and stay. A doc_id may stand on several texts: each row is
    kept or dropped for its own text. Of rows that repeat both doc_id and words one stays; which of their other columns stay is
    open."""
    rows = cut(_members(docs, setting).filter("component_id is not null").select("doc_id", "cls", "component_id").distinct())
    again = cut(_repeated(docs))
    gone = small(cut(rows.filter("doc_id <> component_id").select("doc_id").distinct().join(again, "doc_id", "left_anti")).withColumnRenamed("doc_id", "_gone"))
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    if again.isEmpty():
        return left
    again = small(again.withColumnRenamed("doc_id", "_again"))
    on = F.col("doc_id").cast("long") == F.col("_again")
    first = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "cls")).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.cls").alias("cls"))
    several = _with_class(left.join(again, on, "left_semi"))
    blank = F.col("cls") == F.lit(_class(b""))
    kept = several.filter(~blank).join(first, ["_id", "cls"], "left_semi").dropDuplicates(["_id", "cls"]).unionByName(several.filter(blank), allowMissingColumns=True)
    return left.join(again, on, "left_anti").unionByName(kept.select("_row.*"))


def _repeated(docs: DataFrame) -> DataFrame:
    """The doc_ids that stand on more than one row."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna()
    return ids.groupBy("doc_id").count().filter("count > 1").select("doc_id")
