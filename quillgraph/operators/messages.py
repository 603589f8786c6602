"""Who writes, who answers whom: operators over the message table.

A message has (id, sender, prev_thread, date, subject, ...); ``prev_thread`` is the id
of the message it answers, ``""`` or null if none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import scalars as sc
from quillgraph.operators.ids import dense_ids
from quillgraph.operators.skew import count_keys, salted_join
from quillgraph.session import durable


def top_senders(msg: DataFrame, k: int | None = None) -> DataFrame:
    """Messages per sender, most active first, ties by name."""
    counts = msg.groupBy("sender").agg(F.count(F.lit(1)).alias("num")).orderBy(F.desc("num"), "sender")
    return counts.limit(k) if k is not None else counts


def activity(rows: DataFrame, key: str, date: str, k: int | None = None) -> DataFrame:
    """(key, num, earliest, latest) per key, busiest first; all of them, or the top ``k``."""
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("num"), F.min(date).alias("earliest"), F.max(date).alias("latest")
    )
    return out.orderBy(F.desc("num"), key).limit(k) if k is not None else out


def engagement(rows: DataFrame, key: str, date: str, k: int | None = None) -> DataFrame:
    """Count against duration: (key, num, duration, duration_days).  ``date`` is a timestamp."""
    first, last = F.col("earliest"), F.col("latest")
    return activity(rows, key, date, k).select(
        key, "num", sc.mixed_duration(first, last).alias("duration"), sc.duration_days(first, last).alias("duration_days")
    )


def sender_ids(msg: DataFrame) -> DataFrame:
    """(id, sender, n): a dense id per sender, in name order."""
    return dense_ids(msg.select("sender"), "sender")


def _answers(msg: DataFrame, *columns: str) -> DataFrame:
    """Rows that answer something, keyed like the message they answer."""
    parent = F.col("prev_thread")
    return msg.filter(parent.isNotNull() & (parent != "")).select(parent.alias("id"), *columns)


def replies(msg: DataFrame) -> DataFrame:
    """Each message with each of its answers: (id, reply_id, subject, sender, receiver).

    ``receiver`` is who answered.  One message may draw a large share of all answers, so
    hot messages are split.
    """
    answers = _answers(msg, F.col("id").alias("reply_id"), F.col("sender").alias("receiver"))
    asked = msg.select("id", "subject", "sender")
    return salted_join(answers, asked, ["id"], by=["reply_id"]).select("id", "reply_id", "subject", "sender", "receiver")


def self_replies(msg: DataFrame) -> DataFrame:
    """Messages answered by their own sender: (id, reply_id, subject, sender)."""
    answers = _answers(msg, F.col("id").alias("reply_id"), "sender")
    asked = msg.select("id", "sender", "subject")
    return salted_join(answers, asked, ["id", "sender"], by=["reply_id"]).select("id", "reply_id", "subject", "sender")


def _self_reply_counts(msg: DataFrame) -> DataFrame:
    """(id, sender, subject, n): answers are counted before the join, one row per message and sender."""
    counts = _answers(msg, "sender").groupBy("id", "sender").agg(F.count(F.lit(1)).alias("n"))
    return msg.select("id", "sender", "subject").join(counts, ["id", "sender"])


def self_reply_count(msg: DataFrame) -> DataFrame:
    return _self_reply_counts(msg).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num"))


def self_repliers(msg: DataFrame) -> DataFrame:
    """Who answers themselves most: (num, sender); a null subject does not count."""
    n = F.when(F.col("subject").isNotNull(), F.col("n")).otherwise(F.lit(0))
    return _self_reply_counts(msg).groupBy("sender").agg(F.sum(n).alias("num")).orderBy(F.desc("num"), "sender")


def conversations(msg: DataFrame, *, dedup: bool = True) -> DataFrame:
    """(replier, sender, num): how often one person answered another, self-answers left out.

    With ``dedup`` a person counts once per answered message, else every answer counts.
    Answers are reduced to one row per message and replier before the join.
    """
    pairs = _answers(msg, F.col("sender").alias("replier")).groupBy("id", "replier").agg(F.count(F.lit(1)).alias("n"))
    asked = msg.select("id", "sender")
    if dedup:
        pairs, asked = pairs.withColumn("n", F.lit(1).cast("long")), asked.distinct()
    met = salted_join(pairs, asked, ["id"], by=["replier"], counts=count_keys(_answers(msg), ["id"])).filter(F.col("replier") != F.col("sender"))
    return met.groupBy("replier", "sender").agg(F.sum("n").alias("num"))


def top_conversations(msg: DataFrame, k: int | None = None, *, dedup: bool = True) -> DataFrame:
    out = conversations(msg, dedup=dedup).orderBy(F.desc("num"), "replier", "sender")
    return out.limit(k) if k is not None else out


def dead_ends(msg: DataFrame, *, dedup: bool = True) -> DataFrame:
    """Messages minus answers by others; a message with two repliers lowers it twice."""
    answered = conversations(msg, dedup=dedup).agg(F.coalesce(F.sum("num"), F.lit(0)).alias("n")).scalar()
    return msg.agg(F.count(F.lit(1)).alias("total")).select((F.col("total") - answered).alias("dead_ends"))


def dead_end_messages(msg: DataFrame) -> DataFrame:
    """Messages nobody else answered.

    The least and the greatest replier of a message say whether anyone but its sender
    answered, so answers shrink to one row per message before the join.
    """
    repliers = _answers(msg, "sender").groupBy("id").agg(F.min("sender").alias("_lo"), F.max("sender").alias("_hi"))
    joined = msg.join(repliers, "id", "left")
    alone = F.col("_lo").isNull() | ((F.col("_lo") == F.col("sender")) & (F.col("_hi") == F.col("sender")))
    return joined.filter(alone).drop("_lo", "_hi")


def reply_nodes(ids: DataFrame) -> DataFrame:
    return ids.select("id", "sender")


def reply_edges(msg: DataFrame, ids: DataFrame, *, dedup: bool = True) -> DataFrame:
    """(replier, sender, num) with ids in place of names."""
    pairs = durable(conversations(msg, dedup=dedup))
    names = ids.select("id", F.col("sender").alias("name"))
    as_replier = salted_join(
        pairs.withColumnRenamed("replier", "name"), names, ["name"], by=["sender"]
    ).select(F.col("id").alias("replier"), "sender", "num")
    return salted_join(
        as_replier.withColumnRenamed("sender", "name"),
        names,
        ["name"],
        by=["replier"],
        counts=count_keys(pairs.withColumnRenamed("sender", "name"), ["name"]),
    ).select("replier", F.col("id").alias("sender"), "num")


def names_for(rows: DataFrame, ids: DataFrame, id_column: str, name: str) -> DataFrame:
    """Inverse look-up: a name column for an id column, null where the id is unknown."""
    names = ids.select(F.col("id").alias(id_column), F.col("sender").alias(name))
    return salted_join(rows, names, [id_column], "left")
