"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds the (blob, rule, rule version) triples
that were scanned before; a run scans a blob for the rules that the ledger lacks for it, each blob once however many paths and
versions have it, and joins findings (old and new) back to all of them by the blob's address.

A rule has a pattern and a least length; matches are the leftmost non-overlapping ones, those too short are dropped. Places are
code points, the end exclusive. Places come from cutting the text by the pattern: a match begins where the gaps and matches
before it end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.functions.arrays import let, running_sums
from docsearch.llm.common import cut, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``group``: the group of ``pattern`` whose length counts. ``probe``: a cheaper pattern that every good match contains;
    texts without it are not cut."""

    name: str
    version: int
    pattern: str
    least: int
    group: int = 0
    probe: str | None = None


#: The base rules, in the order in which spans at the same place are listed. A hex run is good from 16 digits on
#: and an access key from 18 characters on; runs are maximal, so asking for the length in the pattern finds the same matches.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 16),
)
SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """The places of the good matches of ``rule`` in ``text``: an array of (start, end), null if nothing matches."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    rows = F.zip_with(hits, sized, lambda m, g: F.struct(F.length(m).alias("n"), F.length(g).alias("size")))
    rows = F.zip_with(F.slice(gaps, 1, F.size(hits)), rows, lambda gap, r: F.struct(F.length(gap).alias("gap"), r["n"].alias("n"), r["size"].alias("size")))

    def placed(r: Column) -> Column:
        before = running_sums(F.transform(r, lambda x: x["gap"] + x["n"]))
        with_end = lambda b: F.transform(r, lambda x, i: F.struct((F.get(b, i) + x["gap"]).alias("start"), F.get(b, i + 1).alias("end"), x["size"].alias("size")))
        return F.transform(F.filter(let(before, with_end), lambda x: x["size"] >= rule.least), lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))

    return F.when(text.rlike(rule.probe or rule.pattern), let(rows, placed))


def blobs_of(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with blob, the lower-case hex SHA-256 of ``text`` (null counts as empty)."""
    return versions.withColumn("blob", F.sha2(text_or_empty(text), 256))


def _key(rule: Rule) -> str:
    return f"{rule.name}:{rule.version}"


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Scans distinct blobs (blob, text, missing: the rules to scan for, as name:version): (blob, rule, rule_version, spans), one row
    for each, found or not."""
    found = F.array(
        *(F.when(F.array_contains("missing", _key(r)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), spans(F.col("text"), r).alias("spans"))) for r in rules)
    )
    return blobs.select("blob", F.explode(found).alias("f")).filter("f is not null").select("blob", "f.*")


def current(ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The rows of ``ledger`` of present rule versions."""
    return ledger.select("blob", "rule", "rule_version", "spans").filter(F.concat_ws(":", "rule", F.col("rule_version").cast("string")).isin([_key(r) for r in rules]))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(blob, text, missing), one row for each blob for which the ledger lacks some present rule version. ``versions``: blob, text.
    The ledger is joined on the partitioning by which repeated blobs are dropped."""
    every = F.array(*(F.lit(_key(r)) for r in rules))
    todo = versions.select("blob", text_or_empty().alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return todo.withColumn("missing", every)
    key = F.concat_ws(":", "rule", F.col("rule_version").cast("string"))
    done = current(ledger, rules).groupBy("blob").agg(F.collect_set(key).alias("_done"))  # at most one entry a rule
    missing = F.array_except(every, F.coalesce("_done", F.array().cast("array<string>")))
    return todo.join(done, "blob", "left").select("blob", "text", missing.alias("missing")).filter(F.size("missing") > 0)


def fresh(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """What a load adds to the ledger: (blob, rule, rule_version, spans) of the blob and rule version pairs in ``versions`` (columns text
    and any others) that it lacks. A ledger is all that its loads have added; none of them is ever written again."""
    return scan(unseen(blobs_of(versions), ledger, rules), rules)


def update(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The ledger after scanning what is new in ``versions``, as one table: rows of older rule versions are left out, unseen
    pairs are scanned, all others are taken over."""
    new = fresh(versions, ledger, rules)
    return new if ledger is None else current(ledger, rules).unionByName(new)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``versions`` (repeated rows stay) with blob, and for each rule its spans (an empty array if none). The ledger's found rows
    are joined to all paths and versions of a blob; texts take no part in the join."""
    per_rule = [F.first(F.when(F.col("rule") == r.name, F.col("spans")), ignorenulls=True).alias(f"_{r.name}") for r in rules]
    hit = cut(ledger.filter(F.size("spans") > 0).groupBy("blob").agg(*per_rule))  # a table of its own: Spark can then split a blob with very many paths
    keyed = blobs_of(versions)
    out = keyed.drop("text").join(hit, "blob", "left")
    return out.withColumns({f"{r.name}_spans": F.coalesce(F.col(f"_{r.name}"), F.array().cast(SPAN)) for r in rules}).drop(*(f"_{r.name}" for r in rules))


def listed(rules: tuple[Rule, ...]) -> Column:
    """The spans of all ``rules`` (columns {name}_spans) as kind:start:end by start, then in the order of the rules, comma-joined."""
    every = F.concat(*(_tagged(r, k) for k, r in enumerate(rules)))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _tagged(rule: Rule, k: int) -> Column:
    return F.transform(f"{rule.name}_spans", lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(rule.name).alias("name")))


def report(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES, loads: int = 2) -> DataFrame:
    """doc_id, n_{rule} for each rule, base_sha256 and spans of every row of ``documents`` (doc_id, text; others are ignored).

    The documents come in as ``loads`` loads, by a hash of doc_id: each is scanned against what the ones before it have added to the
    ledger, so a blob that an earlier load has seen is not scanned again, and adds its own findings as a part of the ledger. The base rules are all rules here, so base_sha256 is the
    digest of spans."""
    versions = documents.select("doc_id", "text")
    for k in range(loads):
        load = versions.filter(F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(loads)) == k)
        added = cut(fresh(load, ledger, rules))
        ledger = added if ledger is None else ledger.unionByName(added)
    out = findings(versions, current(ledger, rules), rules)
    counts = [F.size(f"{r.name}_spans").cast("long").alias(f"n_{r.name}") for r in rules]
    return out.select("doc_id", *counts, listed(rules).alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))
