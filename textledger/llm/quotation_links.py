"""Quotation linking: quoted passages are joined to the messages that wrote them, and messages become conversations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textledger.llm.components import components
from textledger.sources.shared import stored, stored_for_join

_MARKS = re.compile(r"(?:[ \t]*>)+")
_ATTRIBUTION = re.compile(r"^\s*(?:On\b.*\bwrote|.{1,200}\bwrote)\s*:\s*$", re.IGNORECASE)


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and its passages: (level, normalised text) of each run of lines of one quote level.

    The level is the number of > before a line. A blank line ends a passage, quoted or not. Passages are normalised to
    lower case with single spaces. A line like "... wrote:" right before a quote goes with it."""
    own: list[str] = []
    passages: list[tuple[int, str]] = []
    run: list[str] = []
    level = 0

    def close() -> None:
        if words := " ".join(" ".join(run).lower().split()):
            passages.append((level, words))
        run.clear()

    for line in text.split("\n"):
        marks = _MARKS.match(line)
        depth = marks[0].count(">") if marks else 0
        body = line[marks.end() :] if marks else line
        if depth != level or not body.strip():
            if depth > 0 and level == 0 and run and _ATTRIBUTION.match(run[-1]):
                run.pop()
                own.pop()
            close()
        level = depth
        if body.strip():
            run.append(body)
        if not depth:
            own.append(line)
    close()
    return "\n".join(own).strip(), passages


def _parsed(messages: DataFrame) -> DataFrame:
    """msg_id, sent, text (without quotes), passages (level, key, chars) of each message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("key", pa.int64()), ("chars", pa.int64())]))
        for batch in batches:
            found = [parse(text or "") for text in batch.column("text").to_pylist()]
            keyed = [
                [(level, xxhash.xxh3_64_intdigest(words.encode()) - (1 << 63), len(words)) for level, words in passages] for _, passages in found
            ]
            columns = [batch.column("msg_id"), batch.column("sent"), pa.array([own for own, _ in found], pa.string()), pa.array(keyed, kind)]
            yield pa.record_batch(columns, ["msg_id", "sent", "text", "passages"])

    rows = messages.select(F.col("msg_id").cast("long"), F.col("sent").cast("long"), "text")
    return rows.mapInArrow(run, "msg_id long, sent long, text string, passages array<struct<level: int, key: long, chars: long>>")


def _in_ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` stored in ranges of `keys`, with the range's number as `part`: a key with very many rows has several."""
    return stored(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranges")


def _sources(passages: DataFrame) -> DataFrame:
    """msg_id, level, chars, source: for each quoted passage the last message before that has it unquoted.

    A passage that any number of messages hold is dealt out by time; within a part a running value finds the source,
    and where a part begins amid a passage, the last one of the parts before comes from a row per part and passage."""
    rows = _in_ranges(passages, "key", "chars", "sent", "level")
    own = F.when(F.col("level") == 0, F.struct("sent", "msg_id"))
    # quotes come first among rows of the same time, so no message is its own source
    order = [F.col("sent"), F.when(F.col("level") == 0, 1).otherwise(0), F.col("msg_id")]
    within = Window.partitionBy("part", "key", "chars").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", own)
    ends = rows.groupBy("part").agg(F.min(F.struct("key", "chars")).alias("low"), F.max(F.struct("key", "chars")).alias("high"))
    sides = ends.select("part", F.explode(F.array("low", "high")).alias("side")).select("part", "side.*").distinct()
    edges = rows.join(F.broadcast(sides), ["part", "key", "chars"]).groupBy("part", "key", "chars").agg(F.max("own").alias("own"))
    before = Window.partitionBy("key", "chars").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = stored(edges.withColumn("before", F.max("own").over(before)).where("before IS NOT NULL").drop("own"), "edges")
    edges, _ = stored_for_join(edges, "edges")
    # the last row's struct, since times ascend; a source of the same time as the quote cannot come before it
    rows = rows.withColumn("source", F.last("own", ignorenulls=True).over(within)).where("level > 0")
    rows = rows.join(edges, ["part", "key", "chars"], "left")
    source = F.coalesce("source", F.when(F.col("before")["sent"] < F.col("sent"), F.col("before")))
    source = F.when(source["sent"] < F.col("sent"), source["msg_id"])
    return rows.select("msg_id", "level", "chars", source.alias("source"))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """msg_id, thread_id, position, parent_id, n_quotes, n_linked, text for each row of `messages` (msg_id, sent, text).

    A message's parent is the source of its least deeply quoted passage (the longest, then the smallest id) that has one;
    a source is the last earlier message with that passage as its own text. Messages that parents connect are a
    thread, named by its smallest id; positions follow `sent`, so that replies come after what they answer. `text`
    is the message without quotes.

    A NULL text is empty. A message with a NULL msg_id or sent is a thread of its own at position 1. Rows that share a
    msg_id are one message in links and stay rows of their own. Messages sent at the same time do not quote each other.
    An empty table gives no rows."""
    parsed = stored(_parsed(messages), "messages")
    parts = parsed.where("msg_id IS NOT NULL AND sent IS NOT NULL").select("msg_id", "sent", F.explode("passages").alias("passage"))
    found = stored(_sources(parts.select("msg_id", "sent", "passage.*").distinct()), "sources")
    best = F.min(F.when(F.col("source").isNotNull() & (F.col("source") != F.col("msg_id")), F.struct("level", -F.col("chars"), "source")))
    links = found.groupBy("msg_id").agg(best["source"].alias("parent_id"), F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"))
    links = stored(links, "links")
    joined = components(links.where("parent_id IS NOT NULL").select(F.col("msg_id").alias("a"), F.col("parent_id").alias("b")))
    rows = parsed.select("msg_id", "sent", "text").join(links, "msg_id", "left")
    rows = rows.join(joined.withColumnRenamed("node", "msg_id"), "msg_id", "left")
    rows = rows.select("msg_id", "sent", "text", "parent_id", "n_quotes", "n_linked", F.coalesce("component", "msg_id").alias("thread_id"))
    known = _in_ranges(rows.where("msg_id IS NOT NULL AND sent IS NOT NULL"), "thread_id", "sent", "msg_id")
    within = Window.partitionBy("part", "thread_id").orderBy("sent", "msg_id", "text")
    counts = known.groupBy("thread_id", "part").agg(F.count("*").alias("rows"))
    over = Window.partitionBy("thread_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("thread_id", "part", F.sum("rows").over(over).alias("before")).where("before IS NOT NULL")
    counts, _ = stored_for_join(counts, "counts")
    known = known.withColumn("at", F.row_number().over(within)).join(counts, ["thread_id", "part"], "left")
    known = known.withColumn("position", F.col("at") + F.coalesce("before", F.lit(0)))
    alone = rows.where("msg_id IS NULL OR sent IS NULL").withColumn("position", F.lit(1).cast("long"))
    columns = ["msg_id", "thread_id", F.col("position").cast("long"), "parent_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_quotes", "n_linked")), "text"]
    return known.select(*columns).union(alone.select(*columns))


def _quoted(text: Column, mark: str) -> Column:
    return F.regexp_replace(F.concat(F.lit(mark), F.regexp_replace(text, "\n", "\n" + mark), F.lit("\n")), "(?m)[ ]+$", "")


def quoting_messages(turns: DataFrame) -> DataFrame:
    """msg_id, sent, text: each turn (conv_id, turn, text) as a message that quotes the turn before it, and in there the
    one before that. Rows without conv_id or turn have no id; of rows that share both, the least text is quoted. Ids hold a turn
    below 2^24 and a conv_id below 2^39; larger ones fail the job, so that none are taken for others."""
    fits = F.col("turn").between(0, (1 << 24) - 1) & F.abs("conv_id").between(0, (1 << 39) - 1)
    number = F.when(~fits, F.raise_error(F.lit("conv_id or turn is too large")).cast("long")).otherwise(F.col("conv_id") * (1 << 24) + F.col("turn"))
    rows = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    one = rows.groupBy("conv_id", "turn").agg(F.min("text").alias("quoted"))
    for back, name in ((1, "last"), (2, "older")):
        rows = rows.join(one.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("quoted").alias(name)), ["conv_id", "turn"], "left")
    parts = (F.coalesce(_quoted(F.col("older"), ">> "), F.lit("")), F.coalesce(_quoted(F.col("last"), "> "), F.lit("")), F.col("text"))
    return rows.select(number.alias("msg_id"), number.alias("sent"), F.concat(*parts).alias("text"))
