"""Threads and chats: order, neighbours, sessions, window documents, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import int_or_zero, iso
from .cells import SPAN, cell_of, numbered


def topic_order() -> list[Column]:
    """Order of posts (post_number, posted_at, post_id) in a topic; a missing number is 0."""
    return [int_or_zero(F.col("post_number")), F.coalesce(F.col("posted_at").cast("string"), F.lit("")), F.col("post_id").cast("string")]


def with_previous(posts: DataFrame, *columns: str) -> DataFrame:
    """posts with `previous`, a struct of columns of the post before in the topic, null for the first, and `position` from 0."""
    by = Window.partitionBy("topic_id").orderBy(*topic_order())
    return posts.withColumn("previous", F.lag(F.struct(*columns)).over(by)).withColumn("position", F.row_number().over(by) - 1)


def sessions(rows: DataFrame, key: str, ts: str, order: str, gap: str = "10 minutes", cap: int = 20, span: float = SPAN) -> DataFrame:
    """rows with window_no, from 1 per key: a new window after a gap longer than `gap` or `cap` rows.

    Rows are taken in `order`, a number; a step back in time is no gap. Each key is cut in cells of that order, whose ends carry
    the last time, the last break and the count of windows on, so a key with many rows is not one task.
    """
    cell, inside = Window.partitionBy(key, "_cell").orderBy(order), Window.partitionBy(key, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("_cell")
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_cell", cell_of(order, span))
    ends = rows.groupBy(key, "_cell").agg(F.max_by(ts, order).alias("_last"), F.count("*").alias("_n"))
    ends = ends.select(key, "_cell", F.lag("_last").over(ahead).alias("_before"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    cut = rows.withColumn("_lag", F.lag(ts).over(cell)).withColumn("_at", F.row_number().over(cell)).join(ends, [key, "_cell"])
    late = (F.col(ts) - F.coalesce("_lag", "_before")) > F.expr(f"INTERVAL {gap}")
    cut = cut.withColumn("_at", F.col("_at") + F.col("_base")).withColumn("_break", F.when(F.coalesce(late, F.lit(False)) | (F.col("_at") == 1), F.col("_at")))
    starts = cut.groupBy(key, "_cell").agg(F.max("_break").alias("_m")).select(key, "_cell", F.max("_m").over(before).alias("_start"))
    placed = cut.join(starts, [key, "_cell"]).withColumn("_first", F.coalesce(F.max("_break").over(inside), "_start"))
    placed = placed.withColumn("_new", ((F.col("_at") - F.col("_first")) % cap == 0).cast("long"))
    counts = placed.groupBy(key, "_cell").agg(F.sum("_new").alias("_c")).select(key, "_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_done"))
    out = placed.join(counts, [key, "_cell"]).withColumn("window_no", (F.col("_done") + F.sum("_new").over(inside)).cast("int"))
    return out.drop("_cell", "_lag", "_at", "_before", "_base", "_break", "_start", "_first", "_new", "_done")


def window_documents(messages: DataFrame, chat: str = "chat") -> DataFrame:
    """One document per window of messages (chat, ordinal, id, timestamp, sender, text, window_no): text, name, start, end, participants, message_ids."""
    at = F.struct("ordinal", "id", iso(F.col("timestamp")).alias("at"), "sender", "text")
    docs = messages.groupBy(chat, "window_no").agg(F.sort_array(F.collect_list(at)).alias("m"), F.sort_array(F.collect_set("sender")).alias("participants"))
    line = lambda x: F.concat(F.lit("["), x["at"], F.lit("] "), x["sender"], F.lit(": "), x["text"])
    start, end = F.element_at("m", 1)["at"], F.element_at("m", -1)["at"]
    name = F.concat(F.col(chat).cast("string"), F.lit("/"), F.substring(start, 1, 10), F.lit("/window-"), F.format_string("%05d", "window_no"))
    return docs.select(chat, "window_no", name.alias("name"), start.alias("start_time"), end.alias("end_time"), "participants", F.transform("m", lambda x: x["id"]).alias("message_ids"), F.array_join(F.transform("m", line), "\n").alias("text"))


def expand(posts: DataFrame, seeds: DataFrame, previous: int = 1, following: int = 2, top_k: int | None = None) -> DataFrame:
    """(post_id, topic_id, position, rank) of the posts reached from seeds (post_id, seed_rank): the seed, then following, then previous posts.

    posts (topic_id, post_id, position) hold the place in the topic, gapless; a seed that is no post is skipped; the first
    reach of a post counts; rank is 1-based and at most top_k.
    """
    offsets = [0, *range(1, following + 1), *range(-1, -previous - 1, -1)]
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(o).alias("off")) for i, o in enumerate(offsets)])
    known = posts.select("topic_id", "post_id", "position")
    at = seeds.join(known, "post_id").select("topic_id", "seed_rank", "position", F.explode(slots).alias("s"))
    reach = at.select("topic_id", (F.col("position") + F.col("s.off")).alias("position"), "seed_rank", "s.slot")
    first = reach.join(known, ["topic_id", "position"]).groupBy("post_id", "topic_id", "position").agg(F.min(F.struct("seed_rank", "slot")).alias("f"))
    out = numbered(first.withColumn("_rank", F.col("f.seed_rank").cast("long")), "_rank", "rank", ["f.slot"]).drop("f", "_rank")
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def aliases(rows: DataFrame, sender: str, order: str) -> DataFrame:
    """(sender, alias) by first appearance."""
    first = rows.groupBy(sender).agg(F.min(order).alias("_first"))
    return numbered(first, "_first", "_no", [sender]).select(sender, F.format_string("participant_%04d", "_no").alias("alias"))


def anonymised(rows: DataFrame, sender: str, order: str) -> DataFrame:
    """rows with `alias` of their sender."""
    return rows.join(aliases(rows, sender, order), sender)


def continued(rows: DataFrame, stored: DataFrame, key: str, order: list[str], number: str = "post_number") -> DataFrame:
    """rows with running numbers per key that go on after the largest stored one."""
    most = stored.groupBy(key).agg(F.max(number).alias("_most"))
    by = Window.partitionBy(key).orderBy(*order)
    return rows.join(most, key, "left").withColumn(number, F.row_number().over(by) + F.coalesce("_most", F.lit(0))).drop("_most")
