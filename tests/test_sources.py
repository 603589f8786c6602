"""Sources and sinks on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import mail_pages, tsv
from quillgraph.sources import messages as src
from quillgraph.sources.tables import fill_slots, read_table, write_table


def test_message_files(spark, tmp_path):
    rows = [
        {"date": "2020-01-01T00:00:00+00:00", "id": f"a+={i}", "next_thread": "", "prev_thread": "" if i == 0 else "a+=0",
         "next_url": "", "sender": "Ada <a@example.org>", "subject": "s", "text": "\nhé\t"}
        for i in range(3)
    ]
    for i, row in enumerate(rows):
        (tmp_path / f"{i}.json").write_text(json.dumps(row))
    msg = src.read_messages(spark, str(tmp_path))
    assert msg.columns == ["date", "sender", "id", "next_thread", "prev_thread", "next_url", "subject", "text"]
    assert sorted(r.id for r in msg.collect()) == ["a+=0", "a+=1", "a+=2"] and msg.first().text == "\nhé\t"
    out = str(tmp_path / "out")
    src.write_json_lines(msg, out)
    src.write_json_lines(msg, out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert len(lines) == 3 and all(list(json.loads(x)) == sorted(msg.columns) for x in lines)
    assert src.decode_messages(spark.read.text(out)).exceptAll(msg).isEmpty()


def test_parsed_files(spark, tmp_path):
    sentence = {"id": "m", "size": 2, "sha1": "x", "polr": 0.5, "subj": 0.0,
                "graf": [[1, "Graphs", "graph", "NNS", 1, 0], [0, "the", "the", "DT", 0, 1]], "tile": [[1, 1], [1, 0], [2, 1]]}
    (tmp_path / "p.json").write_text(json.dumps(sentence) + "\n" + json.dumps({**sentence, "graf": [], "tile": []}) + "\n")
    parsed = src.read_parsed(spark, str(tmp_path))
    assert [tuple(r) for r in src.parsed_nodes(parsed).collect()] == [("m", 1, "Graphs", "graph", "NNS", 1, 0), ("m", 0, "the", "the", "DT", 0, 1)]
    assert sorted(tuple(r) for r in src.parsed_edges(parsed).collect()) == [("m", 1, 1), ("m", 1, 1), ("m", 1, 2), ("m", 2, 1)]
    again = src.decode_parsed(src.parsed_lines(parsed))
    assert again.exceptAll(parsed).isEmpty() and again.count() == 2


def test_tsv_files(spark, tmp_path):
    head = "date\ttime\ttitle\tspeakers\taffil\taddr\turl\tx\treg\tcity"
    row = '2015-01-02\t18:00\tTalk "one"\tAda, Bo\tAcme\tHall\thttp://www.meetup.com/g-1/events/5/\t-\t 12 \tOslo'
    short = "2015-01-03\t18:00\tTalk"
    (tmp_path / "e.tsv").write_text("\n".join([head, row, short]))
    got = {r.date: r for r in tsv.read_events(spark, str(tmp_path / "e.tsv")).collect()}
    assert len(got) == 2
    r = got["2015-01-02"]
    assert (r.title, r.base_url, r.reg, r.city) == ('Talk "one"', "http://www.meetup.com/g-1/", 12, "Oslo")
    assert got["2015-01-03"].reg == 0
    (tmp_path / "m.tsv").write_text('region\ta\tb\tc\td\te\tf\nEU\ta\tb\tc\td\thttp://www.meetup.com/g-1/\t"Ada" <a@example.org>')
    assert [tuple(r) for r in tsv.read_meta(spark, str(tmp_path / "m.tsv")).collect()] == [("http://www.meetup.com/g-1/", "EU", "Ada", "a@example.org")]


def test_register_and_click_files(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("2015-01-01\tu1\t1\t60.1\t10.2\n2015-01-02\tu2\t2\t61.0\t11.0\n")
    (tmp_path / "c.tsv").write_text("2015-01-03\tu2\t7\n2015-01-04\tu1\t8\n")
    from quillgraph.operators.meetups import clicks_of_registered

    joined = clicks_of_registered(tsv.read_register(spark, str(tmp_path / "r.tsv")), tsv.read_clicks(spark, str(tmp_path / "c.tsv")))
    assert sorted((r.uuid, r.clk_n, r.reg_n, r.lat) for r in joined.collect()) == [("u1", 8, 1, 60.1), ("u2", 7, 2, 61.0)]


def test_tables(spark, tmp_path):
    df = spark.range(10)
    path = str(tmp_path / "t.parquet")
    write_table(df, path)
    write_table(df.filter("id < 4"), path)
    back = read_table(spark, str(tmp_path), "t")
    assert back.count() == 4
    one = df.coalesce(1)
    assert fill_slots(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = df.repartition(20)
    assert fill_slots(many) is many


def test_pushdown_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    write_table(spark.range(100).select("id", F.lit("x").alias("a"), F.lit("y").alias("b")), path)
    plan = read_table(spark, str(tmp_path), "p").filter("id = 3").select("a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan and "struct<id:bigint,a:string>" in plan


PAGE = """<html><head><title>Re: a &amp; b &lt;x&gt;</title></head><body><table>
<thead><tr><th class="nav">{nav}</th></tr></thead><tbody>
<tr class="from"><td class="left">From</td><td class="right">Ada &lt;a@example.org&gt;</td></tr>
<tr class='date'><td class='right'>Thu, 1 Jan 2015 10:20:30 +0100</td></tr>
<tr class="raw"><td class="right"><a href="/raw/%3cab+c=1@mail.example.org%3e">raw</a></td></tr>
<tr class="contents"><td><pre>one &gt; two café
<a href="x">link</a> rest</pre></td></tr></tbody></table></body></html>"""
NAV = ('<a title="Next by date" href="n.html">n</a><a href="/raw/%3cp@h%3e" title="Previous by thread">p</a>'
       '<a title="Next by thread" href="/raw/%3cq@h%3e">q</a>')


def test_mail_pages(spark):
    pages = spark.createDataFrame([(1, PAGE.format(nav=NAV)), (2, PAGE.format(nav=""))], "page_id long, html string")
    full, bare = mail_pages.mail_messages(pages, "http://example.org/l/").collect()
    assert full.asDict() == {
        "date": "2015-01-01T09:20:30+00:00", "sender": "Ada <a@example.org>", "id": "ab+c=1", "next_thread": "q", "prev_thread": "p",
        "next_url": "http://example.org/l/n.html", "subject": "Re: a & b <x>", "text": "one > two caf\n",
    }
    assert (bare.next_url, bare.prev_thread, bare.next_thread) == ("", "", "")


def test_character_references(spark):
    from pyspark.sql import functions as F

    from quillgraph.sources.mail_pages import unescape

    cases = {
        "caf&eacute; &#60;b&#62; &#8217;s &apos;x&apos; &#x1F600;": "café <b> ’s 'x' 😀",
        "&amp;lt; &lt;&gt;&quot;&#39;&#x27;&nbsp;|": "&lt; <>\"''" + " |",
        "&unknown; &#0; &#xD800; &#9999999; & &; &#; plain": "&unknown; &#0; &#xD800; &#9999999; & &; &#; plain",
        "": "",
        "&copy;": "©",
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r.got for r in rows.select(unescape(F.col("t")).alias("got")).collect()] == list(cases.values())


@pytest.mark.parametrize("made", [src.parsed_nodes, src.parsed_edges])
def test_parsed_sentences_are_read_once(spark, made):
    """No filter below the rows of words or tiles writes and reads the JSON of a sentence again."""
    graf = "array<struct<node_id:long,raw:string,root:string,pos:string,keep:int,num:int>>"
    records = spark.createDataFrame(
        [("1", 2, "x", 0.0, 0.0, [(1, "Big", "big", "JJ", 1, 0), (2, "data", "data", "NN", 1, 1)], [(1, 2)]), ("2", 0, "y", 0.0, 0.0, [], [])],
        f"id string, size int, sha1 string, polr double, subj double, graf {graf}, tile array<struct<n0:long,n1:long>>",
    ).repartition(2)
    found = made(src.decode_parsed(src.parsed_lines(records)))
    assert found.count() == 2
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
