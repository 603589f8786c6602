"""Scalar and text functions against small plain-Python re-statements."""

import datetime as dt
import hashlib
import random
import re
import statistics
import string

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import scalars as sc
from quillgraph.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want", [("", 0), ("12", 12), (" 12 ", 12), ("1.5", 0), ("n/a", 0), ("-3", -3), ("99999999999", 0)]
)
def test_int_or_zero(spark, text, want):
    assert one(spark, sc.int_or_zero(F.col("s")), s=text) == want


@pytest.mark.parametrize(
    "url,plain,https",
    [
        ("http://www.meetup.com/spark-users/events/1/", "http://www.meetup.com/spark-users/", None),
        ("https://www.meetup.com/spark-users/events/1/", "", "https://www.meetup.com/spark-users/"),
        ("http://example.org/spark-users/", "", ""),
        ("", "", ""),
    ],
)
def test_base_url(spark, url, plain, https):
    assert one(spark, sc.base_url(F.col("u")), u=url) == plain
    assert one(spark, sc.base_url(F.col("u"), accept_https=True), u=url) == (plain if https is None else https)


@pytest.mark.parametrize(
    "contact,want",
    [
        ('"Ada Moss" <ada@example.org>', ("Ada Moss", "ada@example.org")),
        ("Ada <ada@example.org> (x)", ("Ada", "ada@example.org")),
        ("ada@example.org", ("", "")),
        ("", ("", "")),
    ],
)
def test_contact(spark, contact, want):
    got = (one(spark, sc.contact_name(F.col("c")), c=contact), one(spark, sc.contact_address(F.col("c")), c=contact))
    assert got == want


def test_mixed_duration(spark):
    rnd = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(50):
        a = base + dt.timedelta(seconds=rnd.randrange(10**6), microseconds=rnd.randrange(10**6))
        rows.append((i, a, a + dt.timedelta(seconds=rnd.randrange(10**7), microseconds=rnd.randrange(10**6))))
    got = spark.createDataFrame(rows, "i int, a timestamp, b timestamp").select(
        "i", sc.mixed_duration(F.col("a"), F.col("b")).alias("d"), sc.duration_days(F.col("a"), F.col("b")).alias("days")
    )
    for r in got.collect():
        span = rows[r.i][2] - rows[r.i][1]
        assert r.d == pytest.approx(span.days + span.seconds / 3600 + (span.seconds / 60) % 60, abs=1e-9)
        assert r.days == pytest.approx(span.total_seconds() / 86400, abs=1e-9)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Thu, 01 Jan 2015 10:20:30 +0000", "2015-01-01T10:20:30+00:00"),
        ("2015-01-01T10:20:30+02:00", "2015-01-01T08:20:30+00:00"),
        ("2015-01-01", "2015-01-01T00:00:00+00:00"),
        ("no date", None),
    ],
)
def test_iso_date(spark, text, want):
    assert one(spark, sc.iso_date(F.col("d")), d=text) == want


FOOTER = "\n" + "-" * 40 + "\nTo unsubscribe, e-mail: a@example.org\nFor additional commands, e-mail: b@example.org\n"
MAILS = {
    "simple": ("\nHi all,\n\nthe job is slow.\nAny ideas?\n\nThanks\n\nAda" + FOOTER, 4),
    "replied": ("\nHi\n\none\n\ntwo\n\nthree\n\nBo\n\nOn Mon, Jan 5, 2015 at 9:00 AM, Ada <a@example.org>\nwrote:\n\n> it’s\n> old\n", 5),
    "forward": ("\nSee below.\n\nBo\n\n---------- Forwarded message ----------\nFrom: x\n\nold text\n", 2),
    "inline": ("\nYes.\n\nSent from a tablet\n\n> On Jan 5, 2015, at 9:00, Ada wrote:\n> \n>> deep\n> quote wrapped\nhard here\n>> more\nleaks\n", 4),
    "spaced": ("a\n\n > kept\n\nb", 3),
    "quotes only": ("> a\n> b", 0),
    "empty": ("", 0),
    "carriage": ("a\r\nOn 1 x\ry wrote:\n> b", 1),
}


def plain_paragraphs(text):
    """Quoted lines blanked, every line trimmed, then whatever stands between blank lines."""
    text = re.sub(r"[^\x20-\x7E\t\n\r\x0B\x0C]", "", text)
    new = min((text[: m.start()] for m in (re.search(p, text) for p in (tx.FORWARD,)) if m), default=text)
    for pattern in (tx.REPLIED, tx.UNSUBSCRIBE):
        new = re.split(pattern, new, maxsplit=1)[0]
    unquoted = re.sub(r"(?m)^>[^\n]*$", "", new)
    trimmed = re.sub(r"(?m)^[ \t\r\x0B\x0C]+|[ \t\r\x0B\x0C]+$", "", unquoted)
    return re.findall(r"[^\n]+(?:\n[^\n]+)*", trimmed)


@pytest.mark.parametrize("name", list(MAILS))
def test_quote_filter(spark, name):
    text, count = MAILS[name]
    got = one(spark, tx.paragraphs(F.col("t")), t=text)
    assert got == plain_paragraphs(text)
    assert len(got) == count


def test_quote_filter_random(spark):
    rnd = random.Random(5)
    bits = ["\n", "\n\n", "> q", "text", " > x", "On 5 a wrote:\n>", "---- Forwarded message ----", "\r", "\x85", "é", "\t", "---\nTo unsubscribe, a\nFor additional commands, b"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", tx.paragraphs(F.col("t")).alias("p"))
    for r in got.collect():
        assert r.p == plain_paragraphs(rows[r.i][1])


@pytest.mark.parametrize("word,want", [("--", True), ("__", True), ("a", False), ("a-", False), ("_a", False), ("...", True)])
def test_is_not_word(spark, word, want):
    assert one(spark, tx.is_not_word(F.col("w")), w=word) is want


def test_sentence_starts_runs_and_median(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(100):
        n = rnd.randrange(12)
        rows.append((i, [rnd.randrange(4) for _ in range(n)], [rnd.random() < 0.6 for _ in range(n)], [rnd.random() for _ in range(n)]))
    df = spark.createDataFrame(rows, "i int, s array<int>, f array<boolean>, v array<double>")
    got = df.select("i", tx.sentence_starts(F.col("s")).alias("s"), tx.runs(F.col("f")).alias("f"), tx.median(F.col("v")).alias("v"))
    for r in got.collect():
        _, sizes, flags, values = rows[r.i]
        assert r.s == [sum(sizes[:k]) for k in range(len(sizes))]
        want, at = [], 0
        for m in re.finditer("1+|0+", "".join("1" if f else "0" for f in flags)):
            if m.group()[0] == "1":
                want.append((m.start(), len(m.group())))
        assert [tuple(x) for x in r.f] == want
        assert r.v == (pytest.approx(statistics.median(values)) if values else None)


def test_tokens_tags_and_lemmas(spark):
    text = "The quick boxes were running slowly to Berlin. A nation's 42 cities tested it!"
    toks = one(spark, tx.tokens(F.col("t")), t=text)
    assert [(t.raw, t.root, t.pos, t.keep) for t in toks] == [
        ("The", "the", "DT", 0),
        ("quick", "quick", "NN", 1),
        ("boxes", "box", "NNS", 1),
        ("were", "be", "VB", 1),
        ("running", "runn", "VBG", 1),
        ("slowly", "slowly", "RB", 0),
        ("to", "to", "TO", 0),
        ("Berlin", "berlin", "NNP", 1),
        ("A", "a", "DT", 0),
        ("nation's", "nation's", "NN", 1),
        ("42", "42", "CD", 0),
        ("cities", "city", "NNS", 1),
        ("tested", "test", "VBD", 1),
        ("it", "it", "PRP", 0),
    ]
    assert [t.num for t in toks] == list(range(14))
    assert [t.sent for t in toks] == [0] * 8 + [1] * 6


def test_content_sha1(spark):
    assert one(spark, tx.content_sha1(F.array(F.lit("ab"), F.lit("c")))) == hashlib.sha1(b"abc").hexdigest()
