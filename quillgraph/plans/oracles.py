"""DuckDB SQL twins of the queries in ``catalog``, over the same given tables."""

from __future__ import annotations

from quillgraph.functions import stem
from quillgraph.functions import text as tx
from quillgraph.plans.views import FOOTER_LINE

ORACLES: dict[str, str] = {}


def _sql(*parts: str) -> str:
    """A query from its common table expressions and its final select."""
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1].strip()


# ---- messages -------------------------------------------------------------------------

KEYED = "keyed AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"
MSG = KEYED + """,
msg AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ts AS date, 'user' || user_id AS sender,
         CASE WHEN k % 10 <> 0 AND event_id - 1 - k >= 0 THEN CAST(event_id - 1 - k AS VARCHAR) ELSE '' END AS prev_thread,
         event_type || ' ' || k AS subject
  FROM keyed)"""
REPLY = """
reply AS (
  SELECT a.id, b.id AS reply_id, a.subject, a.sender, b.sender AS receiver
  FROM msg a JOIN msg b ON a.id = b.prev_thread)"""
CONV = """
conv AS (
  SELECT receiver AS replier, sender, CAST(count(DISTINCT id) AS BIGINT) AS num, count(*) AS with_repeats
  FROM reply WHERE receiver <> sender GROUP BY 1, 2)"""
IDS = """
ids AS (SELECT row_number() OVER (ORDER BY sender) - 1 AS id, sender FROM (SELECT DISTINCT sender FROM msg))"""
EDGES = """
edges AS (
  SELECT r.id AS replier, s.id AS sender, c.num
  FROM conv c JOIN ids r ON c.replier = r.sender JOIN ids s ON c.sender = s.sender)"""
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def _duration(first: str, last: str) -> str:
    s = f"(floor((epoch_us({last}) - epoch_us({first})) / 1000000.0)::BIGINT)"
    return (
        f"round(floor({s} / 86400.0) + ({s} % 86400) / 3600.0::DOUBLE + fmod(({s} % 86400) / 60.0::DOUBLE, 60.0), 6) AS duration,"
        f" round((epoch_us({last}) - epoch_us({first})) / 86400000000.0::DOUBLE, 6) AS duration_days"
    )


ORACLES["top_senders"] = _sql(MSG, "SELECT sender, count(*) AS num FROM msg GROUP BY sender ORDER BY num DESC, sender LIMIT 11")
ORACLES["senders"] = _sql(MSG, IDS, "SELECT id, sender FROM ids")
ORACLES["sender_activity"] = _sql(MSG, f"""
SELECT sender, count(*) AS num, strftime(min(date), {STAMP}) AS earliest, strftime(max(date), {STAMP}) AS latest
FROM msg GROUP BY sender ORDER BY num DESC, sender LIMIT 25""")
_SPANS = "spans AS (SELECT sender, count(*) AS num, min(date) AS a, max(date) AS b FROM msg GROUP BY sender)"
ORACLES["sender_duration"] = _sql(MSG, _SPANS, f"SELECT sender, num, {_duration('a', 'b')} FROM spans")
ORACLES["leaders"] = _sql(MSG, _SPANS, f"SELECT sender, num, {_duration('a', 'b')} FROM spans ORDER BY num DESC, sender LIMIT 30")
ORACLES["message_by_id"] = _sql(MSG, "SELECT id, sender, subject FROM msg WHERE id = '77' AND sender <> ''")
ORACLES["message_preview"] = _sql(MSG, "SELECT id, sender, subject FROM msg ORDER BY sender, subject, id LIMIT 10")
ORACLES["message_total"] = _sql(MSG, "SELECT count(*) AS num FROM msg")
ORACLES["message_lines"] = _sql(MSG, f"""
SELECT strftime(date, {STAMP}) AS date, sender, id, '' AS next_thread, prev_thread, '' AS next_url, subject, subject AS text FROM msg""")
ORACLES["replies"] = _sql(MSG, REPLY, "SELECT id, reply_id, subject, sender, receiver FROM reply")
ORACLES["replies_bucketed"] = ORACLES["replies"]
ORACLES["message_scan"] = _sql(MSG, f"SELECT id, strftime(date, {STAMP}) AS date, sender, prev_thread, subject FROM msg")
ORACLES["self_replies"] = _sql(MSG, REPLY, "SELECT id, reply_id, subject, sender FROM reply WHERE sender = receiver")
ORACLES["self_reply_count"] = _sql(MSG, REPLY, "SELECT count(*) AS num FROM reply WHERE sender = receiver")
ORACLES["self_repliers"] = _sql(MSG, REPLY, "SELECT count(subject) AS num, sender FROM reply WHERE sender = receiver GROUP BY sender")
ORACLES["conversations_all"] = _sql(MSG, REPLY, CONV, "SELECT replier, sender, num FROM conv")
ORACLES["conversations_top"] = _sql(MSG, REPLY, CONV, "SELECT replier, sender, num FROM conv ORDER BY num DESC, replier, sender LIMIT 10")
ORACLES["conversations_top_with_repeats"] = _sql(
    MSG, REPLY, CONV, "SELECT replier, sender, with_repeats AS num FROM conv ORDER BY with_repeats DESC, replier, sender LIMIT 10"
)
ORACLES["dead_ends"] = _sql(
    MSG, REPLY, CONV, "SELECT CAST((SELECT count(*) FROM msg) - (SELECT sum(num) FROM conv) AS BIGINT) AS dead_ends"
)
ORACLES["dead_end_messages"] = _sql(MSG, """
SELECT id, sender, subject FROM msg m
WHERE NOT EXISTS (SELECT 1 FROM msg r WHERE r.prev_thread = m.id AND r.sender <> m.sender)""")
ORACLES["reply_nodes"] = ORACLES["senders"]
ORACLES["reply_edges"] = _sql(MSG, REPLY, CONV, IDS, EDGES, "SELECT * FROM edges")
ORACLES["reply_edge_names"] = _sql(MSG, REPLY, CONV, "SELECT num, sender AS sender_name, replier AS replier_name FROM conv")

MAILS = f"""
mails AS (
  SELECT c.conv_id || '.' || c.turn AS id,
         'Talk ' || c.conv_id || ' & "more" <x>' AS subject,
         c.role || ' <' || c.role || '@example.org>' AS sender,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(c.conv_id) + to_minutes(c.turn) AS date,
         CASE WHEN c.turn > 0 THEN c.conv_id || '.' || (c.turn - 1) ELSE '' END AS prev_thread,
         CASE WHEN c.role = 'system' THEN chr(10) || c.text || chr(10) || chr(10) || '---------- Forwarded message ----------' || chr(10) || c.text
              WHEN p.text IS NOT NULL THEN chr(10) || c.text || chr(10) || chr(10) || 'On Jan 1, 2024, ' || p.role || ' wrote:'
                   || chr(10) || chr(10) || '> ' || replace(p.text, chr(10), chr(10) || '> ')
              ELSE chr(10) || c.text || chr(10) || chr(10) || '> inline quote' || chr(10) || ' > kept' || chr(10) || chr(10)
                   || '{FOOTER_LINE}' || chr(10) || 'To unsubscribe, e-mail: a@example.org' || chr(10)
                   || 'For additional commands, e-mail: b@example.org' || chr(10) END AS text
  FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)"""
PRINTABLE = r"'[^\x20-\x7E\t\n\r\x0B\x0C]'"
ORACLES["mail_pages_parsed"] = _sql(MAILS, f"""
SELECT strftime(date, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS date, sender, id, '' AS next_thread, prev_thread,
       'http://example.org/list/next-' || id AS next_url, subject, regexp_replace(text, {PRINTABLE}, '', 'g') AS text
FROM mails""")

# ---- event listing --------------------------------------------------------------------


def _listing(https: str = "") -> str:
    return KEYED + f""",
raw AS (
  SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time, event_type AS title,
         'Speaker ' || user_id || CASE WHEN k % 7 = 0 THEN '' ELSE ', Speaker ' || ((user_id * 7 + k) % 200) END AS speakers,
         'Company ' || (user_id % 40) AS affil, 'Hall ' || (k % 9) AS addr,
         CASE WHEN event_id % 5 = 0 THEN 'https://www.meetup.com/group-' || (user_id % 120) || '/events/' || event_id || '/'
              WHEN event_id % 5 <= 2 THEN 'http://www.meetup.com/group-' || (user_id % 120) || '/events/' || event_id || '/'
              WHEN event_id % 5 = 3 THEN 'http://example.org/spark-users/' || event_id ELSE '' END AS url,
         CASE WHEN k % 6 = 0 THEN '' WHEN k % 6 = 2 THEN ' ' || k || ' ' WHEN k % 6 = 3 THEN k || '.5'
              WHEN k % 6 = 4 THEN 'n/a' ELSE CAST(k AS VARCHAR) END AS reg_text,
         'City ' || (user_id % 25) AS city
  FROM keyed),
listing AS (
  SELECT date, time, title, speakers, affil, addr, url,
         regexp_extract(url, '^(http{https}?://.*\\.meetup\\.com/[\\w\\-]+/).*$', 1) AS base_url,
         CASE WHEN regexp_full_match(trim(reg_text), '[+-]?[0-9]+') THEN CAST(trim(reg_text) AS INTEGER) ELSE 0 END AS reg, city
  FROM raw)"""


LISTING = _listing()
META = """
meta AS (
  SELECT 'http://www.meetup.com/group-' || s_suppkey || '/' AS base_url, r_name AS region,
         CASE WHEN s_suppkey % 3 < 2 THEN s_name ELSE '' END AS contact,
         CASE WHEN s_suppkey % 3 < 2 THEN lower(replace(s_name, '#', '-')) || '@example.org' ELSE '' END AS email
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_GROUPS = "SELECT base_url, count(*) AS num FROM listing WHERE base_url <> '' GROUP BY base_url"

ORACLES["listing_rows"] = _sql(LISTING, "SELECT * FROM listing")
ORACLES["group_meta"] = _sql(META, "SELECT * FROM meta")
ORACLES["contact_split"] = _sql(META, "SELECT contact, email FROM meta WHERE contact <> ''")
ORACLES["url_position"] = _sql(LISTING, """
SELECT date, title, url, CAST(strpos(url, '/spark-users/') - 1 AS INTEGER) AS pos FROM listing WHERE strpos(url, '/spark-users/') > 0""")
ORACLES["listing_of_group"] = _sql(LISTING, "SELECT * FROM listing WHERE base_url = 'http://www.meetup.com/group-7/'")
ORACLES["listing_preview"] = _sql(
    LISTING, "SELECT date, city, title, speakers, affil FROM listing ORDER BY date, city, title, speakers, affil LIMIT 5"
)
ORACLES["base_url_counts"] = _sql(LISTING, _GROUPS)
ORACLES["base_url_counts_https"] = _sql(_listing("s"), _GROUPS)
ORACLES["page_host_counts"] = r"""
SELECT base_url, count(*) AS num
FROM (SELECT regexp_extract(url, '^(https?://[^/]*example\.[a-z]+/[\w\-]+/).*$', 1) AS base_url FROM pages)
WHERE base_url <> '' GROUP BY base_url"""
ORACLES["int_or_zero"] = _sql(LISTING, "SELECT reg, count(*) AS num FROM listing GROUP BY reg")
ORACLES["attendance"] = _sql(LISTING, META, """
SELECT l.base_url, m.region, l.city, m.contact, m.email, CAST(sum(l.reg) AS BIGINT) AS attendance, count(*) AS num
FROM listing l LEFT JOIN meta m ON l.base_url = m.base_url
WHERE l.base_url <> '' GROUP BY ALL""")
ORACLES["city_top"] = _sql(LISTING, "SELECT city, count(*) AS num FROM listing GROUP BY city ORDER BY num DESC, city LIMIT 30")
ORACLES["affil_top"] = _sql(LISTING, "SELECT affil, count(*) AS num FROM listing GROUP BY affil ORDER BY num DESC, affil LIMIT 10")
ORACLES["affil_duration"] = _sql(LISTING, f"""
spans AS (SELECT affil, count(*) AS num, min(CAST(date AS TIMESTAMP)) AS a, max(CAST(date AS TIMESTAMP)) AS b FROM listing GROUP BY affil)
""", f"SELECT affil, num, {_duration('a', 'b')} FROM spans ORDER BY num DESC, affil LIMIT 10")
_SPEAKERS = "SELECT speaker, count(*) AS num FROM (SELECT unnest(string_split(speakers, ', ')) AS speaker FROM listing) GROUP BY speaker"
ORACLES["speaker_top"] = _sql(LISTING, _SPEAKERS + " ORDER BY num DESC, speaker LIMIT 23")
ORACLES["list_explode_counts"] = _sql(LISTING, _SPEAKERS)
ORACLES["click_register"] = """
WITH reg AS (
  SELECT 'u' || user_id AS uuid, strftime(ts, '%Y-%m-%d') AS reg_date, CAST(event_id AS INTEGER) AS reg_n, value / 2 AS lat, value * 2 AS lon
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'signup')
  WHERE rn = 1)
SELECT uuid, strftime(ts, '%Y-%m-%d') AS clk_date, CAST(event_id AS INTEGER) AS clk_n, reg_date, reg_n, round(lat, 6) AS lat, round(lon, 6) AS lon
FROM events JOIN reg ON uuid = 'u' || user_id WHERE event_type = 'click'"""
ORACLES["click_register_files"] = ORACLES["click_register"]
ORACLES["value_spread"] = """
SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS spread FROM events GROUP BY event_type"""
ORACLES["stratum_fractions"] = _sql(LISTING, """
SELECT affil || '/' || title AS stratum, count(*) AS n,
       round(CASE WHEN count(*) < 50 THEN 1.0::DOUBLE ELSE 50.0::DOUBLE / count(*) END, 6) AS fraction
FROM listing GROUP BY 1""")

ORACLES["stratified_sample"] = """
WITH rows AS (SELECT event_id, CAST(user_id % 40 AS VARCHAR) || '/' || event_type AS stratum FROM events),
sizes AS (SELECT stratum, count(*) AS n FROM rows GROUP BY stratum)
SELECT event_id, stratum FROM rows JOIN sizes USING (stratum)
WHERE ('0x' || substr(md5('42:' || event_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
      < CASE WHEN n < 50 THEN 1.0::DOUBLE ELSE 50.0::DOUBLE / n END"""

# ---- text -----------------------------------------------------------------------------

_NL = "chr(10)"
_BLANKS = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"


def _paragraphs(table: str, key: str) -> str:
    return rf"""
cut0 AS (SELECT {key}, regexp_replace(text, {PRINTABLE}, '', 'g') AS t FROM {table}),
cut1 AS (SELECT {key}, string_split_regex(t, '{tx.FORWARD}')[1] AS t FROM cut0),
cut2 AS (SELECT {key}, string_split_regex(t, '{tx.REPLIED}')[1] AS t FROM cut1),
cut3 AS (SELECT {key}, string_split_regex(t, '{tx.UNSUBSCRIBE}')[1] AS t FROM cut2),
unquoted AS (
  SELECT {key}, trim(array_to_string(list_transform(string_split(t, {_NL}),
         lambda l: CASE WHEN starts_with(l, '>') THEN '' ELSE trim(l, {_BLANKS}) END), {_NL}), {_NL}) AS t FROM cut3),
paras AS (
  SELECT {key}, unnest(p) AS text, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS para
  FROM (SELECT {key}, list_filter(string_split_regex(t, '\n\n+'), lambda x: x <> '') AS p FROM unquoted))"""


PARAS = _paragraphs("documents", "doc_id")
BLOCKS = r"""
paras AS (
  SELECT doc_id, unnest(p) AS text, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS para
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '\n\n+'), lambda x: x <> '') AS p FROM documents))"""
SENTS = rf"""
pieces AS (
  SELECT doc_id, para, unnest(s) AS text, generate_subscripts(s, 1) AS i
  FROM (SELECT doc_id, para, string_split(regexp_replace(text, '{tx.SENTENCE_END}', '\1' || chr(1), 'g'), chr(1)) AS s FROM paras)),
sents AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, i) - 1 AS INTEGER) AS sent, text
  FROM pieces WHERE text <> '')"""
_WORD = tx.WORD.replace("'", "''")


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_TAG = " ".join(
    ["CASE WHEN regexp_matches(low, '^[0-9]') THEN 'CD'"]
    + [f"WHEN low IN ({_quoted(members)}) THEN '{name}'" for name, members in tx.CLOSED_CLASSES.items()]
    + [f"WHEN regexp_matches(low, '{'.' * before}({'|'.join(ends)})$') THEN '{name}'" for name, before, ends in tx.SUFFIXES]
    + [f"WHEN regexp_matches(low, '{tx.PLURAL}') THEN 'NNS'"]
    + ["WHEN i > 1 AND regexp_matches(raw, '^[A-Z]') THEN 'NNP' ELSE 'NN' END"]
)
_LEMMA = " ".join(
    ["CASE"]
    + [f"WHEN pos = 'VB' AND low IN ({_quoted(forms)}) THEN '{base}'" for base, forms in tx.IRREGULAR_VERBS.items()]
    + [
        "WHEN pos = 'NNS' AND regexp_matches(low, '..ies$') THEN regexp_replace(low, 'ies$', 'y')",
        "WHEN pos = 'NNS' AND regexp_matches(low, '(x|z|ch|sh)es$') THEN regexp_replace(low, 'es$', '')",
        "WHEN pos = 'NNS' THEN regexp_replace(low, 's$', '')",
        "WHEN pos = 'VBG' THEN regexp_replace(low, 'ing$', '')",
        "WHEN pos = 'VBD' THEN regexp_replace(low, 'ed$', '') ELSE low END",
    ]
)
TOKS = rf"""
found AS (
  SELECT doc_id, sent, unnest(w) AS raw, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, sent, regexp_extract_all(text, '{_WORD}') AS w FROM sents)),
tagged AS (SELECT doc_id, sent, i, raw, lower(raw) AS low, {_TAG} AS pos FROM (SELECT *, lower(raw) AS low FROM found)),
toks AS (
  SELECT doc_id, sent, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent, i) - 1 AS INTEGER) AS num, raw, {_LEMMA} AS root, pos,
         CAST(pos[1] IN ('V', 'N', 'J') AS INTEGER) AS keep FROM tagged)"""
TEXT = BLOCKS + "," + SENTS + "," + TOKS
VOCAB = """
vocab AS (
  SELECT row_number() OVER (ORDER BY root) AS node_id, root, n
  FROM (SELECT root, count(*) AS n FROM toks WHERE keep = 1 GROUP BY root))"""
NODES = VOCAB + """,
nodes AS (
  SELECT doc_id, sent, CASE WHEN keep = 1 THEN node_id ELSE 0 END AS node_id, raw, root, pos, keep, num
  FROM toks LEFT JOIN vocab USING (root))"""
TILES = """
tiles AS (
  SELECT doc_id, root AS root0, x.root AS root1, num AS num0, x.num AS num1
  FROM (SELECT doc_id, root, num, keep, unnest([lead(me, 1) OVER w, lead(me, 2) OVER w, lead(me, 3) OVER w]) AS x
        FROM (SELECT *, {'num': num, 'root': root, 'keep': keep} AS me FROM toks)
        WINDOW w AS (PARTITION BY doc_id, sent ORDER BY num))
  WHERE keep = 1 AND x.keep = 1)"""
_SMALL = f"({_quoted(tx.SMALL_KEEP_TAGS)})"
LINKS = f"""
ahead AS (
  SELECT doc_id, num, root, lower(raw) AS word, pos,
         lead({{'num': num, 'root': root, 'word': lower(raw), 'pos': pos}}, 1) OVER w AS b,
         lead({{'num': num, 'root': root, 'word': lower(raw), 'pos': pos}}, 2) OVER w AS c
  FROM toks WINDOW w AS (PARTITION BY doc_id, sent ORDER BY num)),
links AS (
  SELECT doc_id, root AS stem0, x.root AS stem1, num AS num0, x.num AS num1
  FROM (SELECT doc_id, root, num, word, unnest([b, c]) AS x FROM ahead WHERE c IS NOT NULL AND pos IN {_SMALL})
  WHERE x.pos IN {_SMALL} AND x.word <> word)"""
SCORES = """
scores AS (
  SELECT word, (len(word) % 5 - 2) / 2.0::DOUBLE AS polr, (len(word) % 4) / 4.0::DOUBLE AS subj
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)),
moods AS (
  SELECT doc_id, sent, avg(polr) AS polr, avg(subj) AS subj FROM toks JOIN scores ON lower(raw) = word GROUP BY 1, 2)"""

ORACLES["paragraphs"] = _sql(PARAS, "SELECT doc_id, para, text FROM paras")
ORACLES["mail_paragraphs"] = _sql(MAILS, _paragraphs("mails", "id"), "SELECT id, para, text FROM paras")
ORACLES["sentences"] = _sql(BLOCKS, SENTS, "SELECT doc_id, sent, text FROM sents")
ORACLES["sentence_offsets"] = _sql(BLOCKS, SENTS, f"""
sizes AS (SELECT doc_id, sent, CAST(len(regexp_extract_all(text, '{_WORD}')) AS INTEGER) AS n_words FROM sents)""", """
SELECT doc_id, sent, n_words,
       CAST(coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM sizes""")
ORACLES["tokens"] = _sql(TEXT, "SELECT doc_id, sent, num, raw, root, pos, keep FROM toks")
ORACLES["lexicon_tokens"] = _sql(TEXT, f"""
lexicon AS (
  SELECT word, CASE WHEN len(word) % 11 = 0 THEN 'SYM' WHEN len(word) % 3 = 0 THEN 'JJ' WHEN len(word) % 3 = 1 THEN 'NNS' ELSE 'RB' END AS tag
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)),
retag AS (
  SELECT doc_id, sent, num, raw, low, pos FROM (
    SELECT doc_id, sent, num, raw, lower(raw) AS low, coalesce(tag, pos) AS pos FROM toks LEFT JOIN lexicon ON word = lower(raw))
  WHERE pos <> 'SYM')""", f"""
SELECT doc_id, sent, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY num) - 1 AS INTEGER) AS num, raw, {_LEMMA} AS root, pos,
       CAST(pos[1] IN ('V', 'N', 'J') AS INTEGER) AS keep FROM retag""")
ORACLES["non_words"] = f"""
SELECT piece, count(*) AS num FROM (SELECT unnest(string_split(text, ' ')) AS piece FROM documents)
WHERE regexp_matches(piece, '{tx.NOT_WORD}') GROUP BY piece"""
ORACLES["term_counts"] = _sql(TEXT, "SELECT doc_id, lower(raw) AS word, count(*) AS num FROM toks GROUP BY 1, 2")
ORACLES["vocabulary"] = _sql(TEXT, VOCAB, "SELECT node_id, root, n FROM vocab")
ORACLES["graf_nodes"] = _sql(TEXT, NODES, "SELECT * FROM nodes")
_GRAF_EDGES = """
near AS (
  SELECT doc_id, node_id AS x, ahead AS y
  FROM (SELECT doc_id, node_id, unnest([lead(node_id, 1) OVER w, lead(node_id, 2) OVER w, lead(node_id, 3) OVER w]) AS ahead
        FROM nodes WINDOW w AS (PARTITION BY doc_id, sent ORDER BY num))
  WHERE node_id > 0 AND ahead > 0),
graf_edges AS (SELECT doc_id, x AS node0, y AS node1 FROM near UNION ALL SELECT doc_id, y, x FROM near)"""
ORACLES["graf_edges"] = _sql(TEXT, NODES, _GRAF_EDGES, "SELECT * FROM graf_edges")
ORACLES["graf_edges_distinct"] = _sql(TEXT, NODES, _GRAF_EDGES, "SELECT DISTINCT * FROM graf_edges")
ORACLES["tiles"] = _sql(TEXT, TILES, "SELECT * FROM tiles")
ORACLES["window_links"] = _sql(TEXT, LINKS, "SELECT * FROM links")
_STEMS = "stems AS (SELECT row_number() OVER (ORDER BY root) - 1 AS id, root FROM (SELECT DISTINCT root FROM toks))"
ORACLES["word_table"] = _sql(TEXT, _STEMS, """
SELECT doc_id, sent, id, num AS index, lower(raw) AS word, root AS stem, pos AS tag FROM toks JOIN stems USING (root)""")
ORACLES["link_edges"] = _sql(TEXT, _STEMS, LINKS, """
pairs AS (
  SELECT doc_id, a.id AS n0, b.id AS n1 FROM links JOIN stems a ON a.root = stem0 JOIN stems b ON b.root = stem1)""", """
SELECT doc_id, n0, n1 FROM pairs UNION ALL SELECT doc_id, n1, n0 FROM pairs""")
_SHAPE = "list_reduce(list_prepend('', string_split(w, '')), lambda s, c: s || CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND s LIKE '%c') THEN 'v' ELSE 'c' END)"


def _measure(form: str) -> str:
    return f"len(regexp_extract_all({form}, 'vc'))"


def _ending(rules: dict[str, str], least: int) -> str:
    """The branches of a stem step: the longest ending first, replaced if the measure before it is large enough."""
    order = sorted(rules, key=lambda x: (-len(x), x))
    good = lambda x: f"{_measure(f'left(f, length(f) - {len(x)})')} >= {least}"
    return " ".join(f"WHEN w LIKE '%{x}' THEN CASE WHEN {good(x)} THEN left(w, length(w) - {len(x)}) || '{rules[x]}' ELSE w END" for x in order)


def _stem_steps() -> str:
    """Common table expressions p0 to p9 (word, w, f): every word with its stem and the stem's shape after each step."""
    short = lambda w, f: f"({f} LIKE '%cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"
    lost = "(w LIKE '%ed' AND w NOT LIKE '%eed' AND left(f, length(f) - 2) LIKE '%v%') OR (w LIKE '%ing' AND left(f, length(f) - 3) LIKE '%v%')"
    twin = "f LIKE '%cc' AND right(w, 1) = left(right(w, 2), 1) AND right(w, 1) NOT IN ('l', 's', 'z')"
    last = _ending(dict.fromkeys(stem.LAST_ENDINGS, ""), 2)
    ion = f"WHEN w LIKE '%ion' THEN CASE WHEN {_measure('left(f, length(f) - 3)')} >= 2 AND (w LIKE '%sion' OR w LIKE '%tion') THEN left(w, length(w) - 3) ELSE w END"
    m = _measure("left(f, length(f) - 1)")
    steps = [
        f"CASE {_ending(stem.PLURALS, 0)} ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {_measure('left(f, length(f) - 3)')} > 0 THEN left(w, length(w) - 1) ELSE w END WHEN {lost} THEN left(w, length(w) - CASE WHEN w LIKE '%ed' THEN 2 ELSE 3 END) || '.' ELSE w END",
        f"CASE WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN w || 'e' WHEN {twin} THEN left(w, length(w) - 1) WHEN {_measure('f')} = 1 AND {short('w', 'f')} THEN w || 'e' ELSE w END",
        "CASE WHEN w LIKE '%y' AND left(f, length(f) - 1) LIKE '%v%' THEN left(w, length(w) - 1) || 'i' ELSE w END",
        f"CASE {_ending(stem.LONG_ENDINGS, 1)} ELSE w END",
        f"CASE {_ending(stem.MIDDLE_ENDINGS, 1)} ELSE w END",
        f"CASE {ion} {last} ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({m} > 1 OR ({m} = 1 AND NOT {short('left(w, length(w) - 1)', 'left(f, length(f) - 1)')})) THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {_measure('f')} > 1 THEN left(w, length(w) - 1) ELSE w END",
    ]
    plain = "regexp_full_match(word, '[a-z]{3,}')"
    out = [f"p0 AS (SELECT *, {_SHAPE} AS f FROM (SELECT DISTINCT lower(raw) AS word, lower(raw) AS w FROM toks) WHERE {plain})"]
    for k, step in enumerate(steps):
        made = f"SELECT word, {step} AS w FROM p{k}"
        if k == 1:  # a dot marks words that lost -ed or -ing, which the next step repairs
            made = f"SELECT word, replace(w, '.', '') AS w, w LIKE '%.' AS lost FROM ({made})"
        elif k == 2:
            made = f"SELECT word, CASE WHEN lost THEN {step} ELSE w END AS w FROM p{k}"
        out.append(f"p{k + 1} AS (SELECT *, {_SHAPE} AS f FROM ({made}))")
    return ",\n".join(out)


ORACLES["porter_words"] = _sql(TEXT, _stem_steps(), """
stemmed AS (SELECT lower(raw) AS word, count(*) AS num FROM toks GROUP BY 1),
named AS (SELECT s.word, num, coalesce(p.w, s.word) AS stem FROM stemmed s LEFT JOIN p9 p USING (word)),
ids AS (SELECT stem, row_number() OVER (ORDER BY stem) - 1 AS id FROM (SELECT DISTINCT stem FROM named))""", """
SELECT id, word, stem, num FROM named JOIN ids USING (stem)""")
ORACLES["sentiment"] = _sql(TEXT, SCORES, "SELECT doc_id, sent, round(polr, 6) AS polr, round(subj, 6) AS subj FROM moods")
ORACLES["sentence_record"] = _sql(TEXT, NODES, TILES, SCORES, """
grafs AS (
  SELECT doc_id, sent, CAST(count(*) AS INTEGER) AS size, sha1(string_agg(root, '' ORDER BY num)) AS sha1,
         string_agg(raw || '/' || root || '/' || pos || '/' || node_id || '/' || num, ' ' ORDER BY num) AS graf
  FROM nodes GROUP BY 1, 2),
counted AS (
  SELECT a.doc_id, a.sent, count(*) AS n, string_agg(a.node_id || '-' || b.node_id, ' ' ORDER BY num1 - num0, num0) AS tile
  FROM tiles t JOIN nodes a ON t.doc_id = a.doc_id AND t.num0 = a.num JOIN nodes b ON t.doc_id = b.doc_id AND t.num1 = b.num GROUP BY 1, 2)""", """
SELECT doc_id, sent, size, sha1, round(coalesce(polr, 0), 6) AS polr, round(coalesce(subj, 0), 6) AS subj, graf,
       CAST(coalesce(n, 0) AS INTEGER) AS n_tiles, coalesce(tile, '') AS tile
FROM grafs LEFT JOIN moods USING (doc_id, sent) LEFT JOIN counted USING (doc_id, sent)""")
ORACLES["parsed_graf_nodes"] = _sql(
    TEXT, NODES, "SELECT CAST(doc_id AS VARCHAR) AS id, node_id, raw, root, pos, keep, num FROM nodes"
)
ORACLES["parsed_graf_edges"] = _sql(TEXT, NODES, _GRAF_EDGES, "SELECT CAST(doc_id AS VARCHAR) AS id, node0, node1 FROM graf_edges")

# ---- graph ----------------------------------------------------------------------------

GRAPH = (MSG, REPLY, CONV, IDS, EDGES)
DEGREES = """
deg AS (
  SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree
  FROM (SELECT replier AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT sender, 1, 0 FROM edges) GROUP BY id)"""
ORACLES["degrees"] = _sql(*GRAPH, DEGREES, "SELECT * FROM deg")
ORACLES["max_degrees"] = _sql(*GRAPH, DEGREES, " UNION ALL ".join(
    f"(SELECT '{k}' AS kind, id, {k} AS value FROM deg ORDER BY {k} DESC, id LIMIT 1)" for k in ("in_degree", "out_degree", "degree")
))
RANK = """
outs AS (SELECT replier, 0.85::DOUBLE / count(*) AS w FROM edges GROUP BY replier),
links AS (SELECT e.replier AS src, e.sender AS dst, w FROM edges e JOIN outs USING (replier)),
steps AS (
  SELECT id, 1.0::DOUBLE AS rank, 1.0::DOUBLE AS delta, 0 AS n FROM ids
  UNION ALL
  SELECT id, rank, max(abs(rank - old)) OVER () AS delta, n FROM (
    SELECT v.id, 0.15 + coalesce(s.t, 0) AS rank, v.rank AS old, v.n + 1 AS n
    FROM steps v LEFT JOIN (SELECT dst, sum(rank * w) AS t FROM steps JOIN links ON id = src GROUP BY dst) s ON v.id = s.dst
    WHERE v.delta > 1e-4)),
ranks AS (SELECT id, arg_max(rank, n) AS rank FROM steps GROUP BY id)"""
ORACLES["pagerank"] = _sql(*GRAPH, RANK, "SELECT id, round(rank, 6) AS rank FROM ranks")
ORACLES["top_repliers"] = _sql(*GRAPH, RANK, """
SELECT sender, round(rank, 6) AS rank FROM ranks JOIN ids USING (id) ORDER BY round(rank, 6) DESC, sender LIMIT 20""")
ORACLES["shortest_paths"] = _sql(*GRAPH, """
walks AS (
  SELECT id, {'d': CASE WHEN id = 0 THEN 0.0::DOUBLE ELSE 1e300::DOUBLE END, 'h': 0, 'p': CASE WHEN id = 0 THEN [id] ELSE [] END} AS s, 0 AS n FROM ids
  UNION ALL
  SELECT id, min(s) AS s, n FROM (
    SELECT id, s, n + 1 AS n FROM walks WHERE n < 40
    UNION ALL
    SELECT e.sender, {'d': s.d + e.num, 'h': s.h + 1, 'p': list_prepend(e.sender, s.p)}, n + 1
    FROM walks JOIN edges e ON e.replier = id WHERE n < 40 AND s.d < 1e300) GROUP BY id, n)""", """
SELECT id, CASE WHEN s.d < 1e300 THEN s.d END AS dist, array_to_string(list_reverse(s.p), '>') AS path FROM walks WHERE n = 40""")
REACH = (
    *GRAPH,
    """
links AS (SELECT DISTINCT replier AS src, sender AS dst FROM edges),
reach AS (
  SELECT id AS a, id AS b FROM ids
  UNION
  SELECT a, dst FROM reach JOIN links ON b = src),
comp AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)""",
)
ORACLES["scc"] = _sql(*REACH, "SELECT sender AS name, component FROM comp JOIN ids USING (id)")
ORACLES["scc_sizes"] = _sql(*REACH, "SELECT component, count(*) AS num FROM comp GROUP BY component")

ORACLES["reply_graph_vertices"] = _sql(MSG, REPLY, CONV, IDS, EDGES, """
SELECT id, CASE WHEN id IN (SELECT replier FROM edges) THEN sender END AS sender
FROM ids WHERE id IN (SELECT replier FROM edges) OR id IN (SELECT sender FROM edges)""")
ORACLES["scc_topics"] = _sql(
    """topics AS (
  SELECT event_id, user_id * 1000 + k AS topic, CASE WHEN k % 10 <> 0 AND k % 3 <> 0 THEN event_id - 1 - k END AS parent
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)),
links AS (SELECT DISTINCT a.topic AS src, b.topic AS dst FROM topics a JOIN topics b ON a.parent = b.event_id),
reach AS (
  SELECT topic AS a, topic AS b FROM topics
  UNION
  SELECT a, dst FROM reach JOIN links ON b = src),
comp AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)""",
    "SELECT component, count(*) AS num FROM comp GROUP BY component",
)

# ---- key phrases ----------------------------------------------------------------------


def _word_ranks(pairs: str, kept: str) -> str:
    """Ranks of all documents; a document stops once none of its ranks moves any more."""
    return f"""
verts AS (
  SELECT row_number() OVER (ORDER BY doc_id, root) AS v, doc_id, root FROM (SELECT DISTINCT doc_id, root FROM toks WHERE {kept})),
wires AS ({pairs}),
joined AS (
  SELECT a.v AS src, b.v AS dst FROM wires w
  JOIN verts a ON a.doc_id = w.doc_id AND a.root = w.r0 JOIN verts b ON b.doc_id = w.doc_id AND b.root = w.r1),
shares AS (SELECT src, 0.85::DOUBLE / count(*) AS w FROM joined GROUP BY src),
arcs AS (SELECT src, dst, sum(w) AS w FROM joined JOIN shares USING (src) GROUP BY 1, 2),
steps AS (
  SELECT v, doc_id, 1.0::DOUBLE AS rank, 1.0::DOUBLE AS delta, 0 AS n FROM verts
  UNION ALL
  SELECT v, doc_id, rank, max(abs(rank - old)) OVER (PARTITION BY doc_id) AS delta, n FROM (
    SELECT p.v, p.doc_id, 0.15 + coalesce(s.t, 0) AS rank, p.rank AS old, p.n + 1 AS n
    FROM steps p LEFT JOIN (SELECT dst, sum(rank * w) AS t FROM steps JOIN arcs ON v = src WHERE delta > 1e-4 GROUP BY dst) s ON p.v = s.dst
    WHERE p.delta > 1e-4)),
last AS (SELECT v, arg_max(rank, n) AS rank FROM steps GROUP BY v),
word_rank AS (SELECT doc_id, root, rank, round(rank, 9) AS level FROM last JOIN verts USING (v))"""


_TILE_PAIRS = "SELECT doc_id, root0 AS r0, root1 AS r1 FROM tiles UNION SELECT doc_id, root1, root0 FROM tiles"
_LINK_PAIRS = "SELECT doc_id, stem0 AS r0, stem1 AS r1 FROM links UNION ALL SELECT doc_id, stem1, stem0 FROM links"
RANKED = (TEXT, TILES, _word_ranks(_TILE_PAIRS, "keep = 1"))
ORACLES["textrank_ranks"] = _sql(*RANKED, "SELECT doc_id, root, round(rank, 6) AS rank FROM word_rank")
ORACLES["textrank_ranks_window"] = _sql(
    TEXT, LINKS, _word_ranks(_LINK_PAIRS, f"pos IN {_SMALL}"), "SELECT doc_id, root, round(rank, 6) AS rank FROM word_rank"
)


def _phrases(flag: str, word: str, having: str, cut: str = "") -> str:
    return f"""
flagged AS (
  SELECT t.doc_id, t.sent, t.num, t.raw, t.pos, r.rank FROM toks t JOIN word_rank r ON t.doc_id = r.doc_id AND t.root = r.root AND t.keep = 1 {flag}),
islands AS (SELECT *, num - row_number() OVER (PARTITION BY doc_id ORDER BY num) AS island FROM flagged),
spans AS (
  SELECT doc_id, string_agg({word}, ' ' ORDER BY num) AS phrase, min(num) AS start, round(sum(rank), 9) AS rank
  FROM islands GROUP BY doc_id, island {cut} {having}),
phrases AS (SELECT doc_id, phrase, arg_max(rank, start) AS rank FROM spans GROUP BY 1, 2)"""


ORACLES["textrank_phrases"] = _sql(*RANKED, _phrases("", "lower(raw)", "HAVING bool_or(starts_with(pos, 'N'))"), """
SELECT doc_id, phrase, round(rank / sum(rank) OVER (PARTITION BY doc_id), 6) AS norm_rank FROM phrases""")
ORACLES["textrank_sentence_phrases"] = _sql(*RANKED, _phrases("", "lower(raw)", "HAVING bool_or(starts_with(pos, 'N'))", ", sent"), """
SELECT doc_id, phrase, round(rank / sum(rank) OVER (PARTITION BY doc_id), 6) AS norm_rank FROM phrases""")
ORACLES["phrase_walk"] = _sql(TEXT, """
islands AS (
  SELECT *, num - row_number() OVER (PARTITION BY doc_id ORDER BY num) AS island FROM toks WHERE keep = 1)""", """
SELECT doc_id, string_agg(raw, ' ' ORDER BY num) AS phrase, min(num) AS start, bool_or(starts_with(pos, 'N')) AS noun FROM islands GROUP BY doc_id, island""")
ORACLES["textrank_summary"] = _sql(
    *RANKED,
    "floors AS (SELECT doc_id, median(level) AS floor FROM word_rank GROUP BY doc_id)",
    _phrases("JOIN floors f ON f.doc_id = t.doc_id AND r.level >= f.floor", "raw", ""),
    "halves AS (SELECT doc_id, median(rank) AS half FROM phrases GROUP BY doc_id)",
    """
SELECT doc_id, phrase, round(rank / sum(rank) OVER (PARTITION BY doc_id), 6) AS norm_rank
FROM phrases JOIN halves USING (doc_id) WHERE rank >= half""",
)
ORACLES["textrank_vs_terms"] = _sql(*RANKED, """
SELECT doc_id, root, num, round(coalesce(rank, 0.0::DOUBLE), 6) AS rank
FROM (SELECT doc_id, root, count(*) AS num FROM toks GROUP BY 1, 2) LEFT JOIN word_rank USING (doc_id, root)""")

ORACLES["ranked_sequence"] = _sql(*RANKED, """
SELECT t.doc_id, t.num, t.raw, round(CASE WHEN t.keep = 1 THEN coalesce(r.rank, 0.0::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS rank
FROM toks t LEFT JOIN word_rank r ON t.doc_id = r.doc_id AND t.root = r.root""")
ORACLES["message_text"] = _sql(MAILS, "SELECT id, text FROM mails WHERE id = '7.1'")

# ---- streams --------------------------------------------------------------------------

ORACLES["stream_word_counts"] = """
SELECT word, count(*) AS num
FROM (SELECT unnest(string_split(line, ' ')) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
GROUP BY word"""
ORACLES["stream_running_counts"] = ORACLES["stream_word_counts"]
ORACLES["stream_changed_totals"] = ORACLES["stream_fold_counts"] = ORACLES["stream_word_counts"]
