"""Quotation linking for conversations, with DataFrame functions only.

A message's lines have quote levels (leading > marks). Quoted passages (runs of lines of one level, their paragraphs and lines)
are normalised and hashed, and joined to the earliest message before it that has the same passage in its own words: one of the
same conversation where there is one, else one of another. Messages stand in the order of conversation and turn, so a link
always leads back. The passage of the lowest level, and of those the longest, names the message that is replied to. Messages
without their quotes, ordered by thread and turn, are the conversations: a thread that quotes from another conversation belongs
to the conversation of its root, and a reply comes after what it replies to.

A conversation of any length is never gathered: links, roots and depths come from joins, and the order is a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.functions.arrays import let
from docsearch.llm.common import cut, discard, small, text_or_empty

_QUOTE = r"^[ \t]*>(?:[ \t]*>)*[ \t]?"
_ATTRIBUTION = r"(?i)^.{0,200}\b(?:wrote|schrieb|escribi[oó]|a [eé]crit)\s*:\s*$"
#: White space, as in the patterns.
SPACE = " \t\n\x0b\f\r"
_LINES = "array<struct<level:int,body:string>>"


def normalised(passage: Column) -> Column:
    """Lower case, white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def quote_lines(text: Column) -> Column:
    """The lines of ``text`` with their quote level, 0 for the writer's own."""

    def line(raw: Column) -> Column:
        head = F.regexp_extract(raw, _QUOTE, 0)
        return F.struct((F.length(head) - F.length(F.replace(head, F.lit(">"), F.lit("")))).alias("level"), F.substring(raw, F.length(head) + 1, F.length(raw)).alias("body"))

    return F.transform(F.split(text, r"\r?\n"), line)


def own_text(lines: Column) -> Column:
    """The lines of level 0, without a line such as "... wrote:" right before a quote."""
    following = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    paired = F.zip_with(lines, following, lambda x, y: F.struct(x["level"].alias("level"), x["body"].alias("body"), F.coalesce(y["level"], F.lit(0)).alias("next")))
    kept = F.filter(paired, lambda x: (x["level"] == 0) & ~((x["next"] > 0) & x["body"].rlike(_ATTRIBUTION)))
    return trimmed(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"))


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def quoted_runs(lines: Column) -> Column:
    """Runs of lines of one level above 0, their lines joined by line ends. Each run is one slice of the lines, from where the level
    changes to where it does again."""

    def runs(starts: Column) -> Column:
        def run(s: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(lines) + 1)
            body = F.array_join(F.transform(F.slice(lines, s, end - s), lambda x: x["body"]), "\n")
            return F.struct(F.element_at(lines, s)["level"].alias("level"), body.alias("body"))

        return F.transform(starts, run)

    changes = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | (F.get(lines, i - 1)["level"] != F.get(lines, F.greatest(i - 2, F.lit(0)))["level"]))
    return F.filter(let(changes, runs), lambda r: r["level"] > 0).cast(_LINES)


def _passages(body: Column) -> Column:
    """The whole, its paragraphs and its lines, normalised, each once, without empty ones."""
    every = F.concat(F.array(body), F.split(body, r"\n\s*\n"), F.split(body, r"\n"))
    return F.array_distinct(F.filter(F.transform(every, normalised), lambda p: p != ""))


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), runs (quoted passages) and key (of the message's columns) of every row."""
    text = text_or_empty()
    # bound inside the expression: Spark copies what a column stands for into filters, and then into each step over its lines
    parts = let(quote_lines(text), lambda x: F.struct(own_text(x).alias("own"), quoted_runs(x).alias("runs")))
    plain = F.struct(trimmed(text).alias("own"), F.array().cast(_LINES).alias("runs"))
    base = conversations.select("conv_id", "turn", "role", text.alias("_t"), F.when(text.contains(">"), parts).otherwise(plain).alias("_p"))
    return base.select("conv_id", "turn", "role", "_p.own", "_p.runs", F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "_t")), 256).alias("key"))


def _at(conv: str, turn: str) -> Column:
    return F.struct(F.col(conv).alias("conv"), F.col(turn).alias("turn"))


def links(parsed: DataFrame) -> DataFrame:
    """(key, me, up): for each quoting message whose quotes have an original, its own place and that of the message it replies to
    (structs of conv and turn)."""
    placed = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).withColumn("me", _at("conv_id", "turn"))
    quoting = placed.select("key", "me", F.explode("runs").alias("r"))
    each = quoting.select("key", "me", F.col("r.level").alias("level"), F.explode(_passages(F.col("r.body"))).alias("p"))
    quoted = cut(each.select("key", "me", "level", F.length("p").alias("size"), F.md5("p").alias("hash")).distinct())
    if quoted.isEmpty():
        return quoted.select("key", "me", F.col("me").alias("up"))
    wanted = small(quoted.select("hash").distinct())
    own = placed.select("me", F.explode(_passages(F.col("own"))).alias("p")).select("me", F.md5("p").alias("hash")).join(wanted, "hash", "left_semi")
    inside = cut(own.groupBy("hash", F.col("me.conv").alias("conv")).agg(F.min("me").alias("origin")))
    first = cut(inside.groupBy("hash").agg(F.min("origin").alias("first")))
    near = quoted.withColumn("conv", F.col("me.conv")).join(small(inside), ["hash", "conv"], "left").join(small(first), "hash")
    origin = F.when(F.col("origin") < F.col("me"), F.col("origin")).when(F.col("first") < F.col("me"), F.col("first"))
    found = near.select("key", "me", "level", "size", origin.alias("up")).filter("up is not null")
    best = found.groupBy("key", "me").agg(F.min(F.struct("level", (-F.col("size")).alias("size"))).alias("b"))
    named = found.join(best, ["key", "me"]).filter((F.col("level") == F.col("b.level")) & (F.col("size") == -F.col("b.size")))
    return named.groupBy("key", "me").agg(F.max("up").alias("up"))


def roots(linked: DataFrame, rounds: int = 40) -> DataFrame:
    """(key, parent, root, depth) by pointer doubling: each round follows twice as many replies, so chains of 2**rounds replies are
    followed to their end. Links lead back, so there is no circle."""
    jumps = cut(linked.select("key", "me", F.col("up").alias("parent"), "up", F.lit(1).cast("long").alias("depth")))
    for _ in range(rounds):
        steps = small(cut(jumps.groupBy(F.col("me").alias("up")).agg(F.min(F.struct("up", "depth")).alias("s"))))
        further = cut(jumps.join(steps, "up", "left").select("key", "me", "parent", F.coalesce("s.up", "up").alias("up"), (F.col("depth") + F.coalesce("s.depth", F.lit(0))).alias("depth"), F.col("s").isNotNull().alias("moved")))
        moved = not further.filter("moved").isEmpty()
        discard(jumps)
        jumps = further
        if not moved:
            return jumps.select("key", "parent", F.col("up").alias("root"), "depth")
    raise RuntimeError("reply chains did not end; raise rounds")


def threads(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), parent_conv and parent_turn (null: no reply found), thread_conv and thread_root
    (place of the thread's first message), depth, n_quotes and formatted, sorted by thread and then by conv_id and turn, for every
    row of ``conversations`` (other columns are ignored).

    Null texts count as empty; white space around a message goes; rows with a null conv_id or turn are in no link. Repeated rows
    stay, with equal results. A very long message is one row, worked on in linear time. If several messages share a turn, a thread goes on through the earliest of their parents. An empty
    table gives an empty result."""
    parsed = messages(conversations)
    found = cut(links(parsed))
    out = parsed.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size("runs").cast("long").alias("n_quotes"), "key")
    if found.isEmpty():
        nothing = F.lit(None).cast("long")
        out = out.withColumns({"parent_conv": nothing, "parent_turn": nothing, "thread_conv": F.col("conv_id"), "thread_root": F.col("turn").cast("long"), "depth": F.lit(0).cast("long")})
    else:
        out = out.join(small(roots(found)), "key", "left").withColumns({
            "parent_conv": F.col("parent.conv"), "parent_turn": F.col("parent.turn"),
            "thread_conv": F.coalesce("root.conv", "conv_id"), "thread_root": F.coalesce("root.turn", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long"),
        })
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    columns = ["conv_id", "turn", "role", "text", "parent_conv", "parent_turn", "thread_conv", "thread_root", "depth", "n_quotes", formatted.alias("formatted")]
    return out.select(*columns).orderBy("thread_conv", "thread_root", "conv_id", "turn")
