"""Message, mail and listing tables derived from the given tables, row by row.

The given tables hold no mail archive and no event listing.  These views give them that
shape without a window or a global order, so they cost one scan (mails: one balanced join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOOTER_LINE = "-" * 69


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("long")


def messages(events: DataFrame) -> DataFrame:
    """An event is a message of its user; it answers the message ``k + 1`` before it.

    Where k ends in 0 it answers none.
    """
    k, parent = F.col("k"), F.col("event_id") - 1 - F.col("k")
    return events.withColumn("k", _k()).select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").alias("date"),
        F.concat(F.lit("user"), "user_id").alias("sender"),
        F.when((k % 10 != 0) & (parent >= 0), parent.cast("string")).otherwise(F.lit("")).alias("prev_thread"),
        F.concat_ws(" ", "event_type", k.cast("string")).alias("subject"),
    )


def topics(events: DataFrame) -> DataFrame:
    """(id, topic, parent): what a message is about (its user and k) and the message it answers.

    Where k is a multiple of 3 it answers none, so the topics form components of many sizes.
    """
    k, parent = F.col("k"), F.col("event_id") - 1 - F.col("k")
    rows = events.withColumn("k", _k())
    return rows.select(
        F.col("event_id").alias("id"), (F.col("user_id") * 1000 + k).alias("topic"), F.when((k % 10 != 0) & (k % 3 != 0) & (parent >= 0), parent).alias("parent")
    )


def listing_lines(events: DataFrame) -> DataFrame:
    """An event listing as tab-separated text lines."""
    u, k, e = F.col("user_id"), F.col("k"), F.col("event_id")
    group = F.concat(F.lit("www.meetup.com/group-"), (u % 120).cast("string"), F.lit("/events/"), e.cast("string"), F.lit("/"))
    url = (
        F.when(e % 5 == 0, F.concat(F.lit("https://"), group))
        .when(e % 5 <= 2, F.concat(F.lit("http://"), group))
        .when(e % 5 == 3, F.concat(F.lit("http://example.org/spark-users/"), e.cast("string")))
        .otherwise(F.lit(""))
    )
    reg = (
        F.when(k % 6 == 0, F.lit(""))
        .when(k % 6 == 2, F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
        .when(k % 6 == 3, F.concat(k.cast("string"), F.lit(".5")))
        .when(k % 6 == 4, F.lit("n/a"))
        .otherwise(k.cast("string"))
    )
    speaker = F.concat(F.lit("Speaker "), u.cast("string"))
    speakers = F.when(k % 7 == 0, speaker).otherwise(F.concat(speaker, F.lit(", Speaker "), ((u * 7 + k) % 200).cast("string")))
    return events.withColumn("k", _k()).select(
        F.concat_ws(
            "\t",
            F.date_format("ts", "yyyy-MM-dd"),
            F.date_format("ts", "HH:mm"),
            "event_type",
            speakers,
            F.concat(F.lit("Company "), (u % 40).cast("string")),
            F.concat(F.lit("Hall "), (k % 9).cast("string")),
            url,
            F.lit("-"),
            reg,
            F.concat(F.lit("City "), (u % 25).cast("string")),
        ).alias("value")
    )


def meta_lines(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Group metadata as tab-separated text lines, one per supplier."""
    s = F.col("s_suppkey").cast("string")
    who = F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))
    contact = (
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('"'), "s_name", F.lit('" <'), who, F.lit("@example.org>")))
        .when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(" <"), who, F.lit("@example.org>")))
        .otherwise(who)
    )
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws(
            "\t", "r_name", "n_name", "s_name", F.lit("-"), F.lit("-"),
            F.concat(F.lit("http://www.meetup.com/group-"), s, F.lit("/")), contact,
        ).alias("value")
    )


def mails(conversations: DataFrame) -> DataFrame:
    """Each turn as a mail: it quotes the turn before, forwards, or ends in a list footer."""
    before = conversations.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("to_role"), F.col("text").alias("to_text")
    )
    number = lambda turn: F.concat_ws(".", F.col("conv_id").cast("string"), turn.cast("string"))
    own = F.concat(F.lit("\n"), "text")
    forward = F.concat(own, F.lit("\n\n---------- Forwarded message ----------\n"), "text")
    reply = F.concat(
        own, F.lit("\n\nOn Jan 1, 2024, "), "to_role", F.lit(" wrote:\n\n> "),
        F.replace("to_text", F.lit("\n"), F.lit("\n> ")),
    )
    footer = F.concat(
        own, F.lit("\n\n> inline quote\n > kept\n\n" + FOOTER_LINE + "\nTo unsubscribe, e-mail: a@example.org\n"
                   "For additional commands, e-mail: b@example.org\n"),
    )
    turn = F.col("turn")
    return conversations.join(before, ["conv_id", "turn"], "left").select(
        number(turn).alias("id"),
        F.concat_ws(" ", F.lit("Talk"), F.col("conv_id").cast("string"), F.lit('& "more" <x>')).alias("subject"),
        F.concat(F.col("role"), F.lit(" <"), "role", F.lit("@example.org>")).alias("sender"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("conv_id").cast("int"), mins=turn.cast("int"))).alias("date"),
        F.when(turn > 0, number(turn - 1)).otherwise(F.lit("")).alias("prev_thread"),
        F.when(F.col("role") == "system", forward).when(F.col("to_text").isNotNull(), reply).otherwise(footer).alias("text"),
    )


def mail_page_rows(mail: DataFrame) -> DataFrame:
    """Each mail as an archive page."""
    def escaped(text):
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(char), F.lit(entity))
        return text

    raw = lambda c: F.concat(F.lit("/list/raw/%3c"), c, F.lit("@mail.example.org%3e"))
    nav = F.when(
        F.col("prev_thread") != "",
        F.concat(F.lit('<a title="Previous by thread" href="'), raw(F.col("prev_thread")), F.lit('">prev</a>')),
    ).otherwise(F.lit(""))
    return mail.select(
        F.concat(
            F.lit("<html><head><title>"), escaped(F.col("subject")), F.lit("</title></head><body><table><thead><tr><th class=\"nav\">"),
            nav, F.lit('<a title="Next by date" href="next-'), "id",
            F.lit('">next</a></th></tr></thead><tbody>\n<tr class="from"><td class="left">From</td><td class="right">'),
            escaped(F.col("sender")),
            F.lit('</td></tr>\n<tr class="date"><td class="left">Date</td><td class="right">'),
            F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</td></tr>\n<tr class=\"raw\"><td class=\"right\"><a href=\""),
            raw(F.col("id")), F.lit('">raw</a></td></tr>\n<tr class="contents"><td><pre>'), escaped(F.col("text")),
            F.lit("</pre></td></tr></tbody></table></body></html>"),
        ).alias("html")
    )


def _words(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


def word_tags(benchmark: DataFrame) -> DataFrame:
    """A lexicon with one row per word of ``benchmark``: (word, pos)."""
    n = F.length("word")
    pos = F.when(n % 11 == 0, "SYM").when(n % 3 == 0, "JJ").when(n % 3 == 1, "NNS").otherwise("RB")
    return _words(benchmark).select("word", pos.alias("pos"))


def word_scores(benchmark: DataFrame) -> DataFrame:
    """A scored word list with one row per word of ``benchmark``: (word, polr, subj)."""
    n = F.length("word")
    return _words(benchmark).select("word", ((n % 5 - 2) / F.lit(2.0)).alias("polr"), ((n % 4) / F.lit(4.0)).alias("subj"))


def registrations(events: DataFrame) -> DataFrame:
    """(uuid, date, n, lat, lon): each user's first sign-up."""
    first = events.filter(F.col("event_type") == "signup").groupBy(F.concat(F.lit("u"), "user_id").alias("uuid")).agg(
        F.min_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id")).alias("e")
    )
    return first.select(
        "uuid", F.date_format("e.ts", "yyyy-MM-dd").alias("date"), F.col("e.event_id").cast("int").alias("n"),
        (F.col("e.value") / 2).alias("lat"), (F.col("e.value") * 2).alias("lon"),
    )


def clicks(events: DataFrame) -> DataFrame:
    """(uuid, date, n): every click."""
    return events.filter(F.col("event_type") == "click").select(
        F.concat(F.lit("u"), "user_id").alias("uuid"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").cast("int").alias("n")
    )
