"""Every registered query over the smallest tables: its contract's columns, rows and rules."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import pytest

from quillgraph.llm import queries

SF = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")

COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_decision_list": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_vector_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_pu_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_page_text": "page_id bigint, url string, text string, n_chars bigint",
    "op11_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op12_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13_benchmark_passages": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def found(spark):
    """The rows of a query, run once."""
    made = {}

    def rows(name):
        if name not in made:
            if name == "op8_token_counts":
                pytest.importorskip("public_tokenizers")
            frame = queries.QUERIES[name](spark, SF)
            made[name] = (dict(frame.dtypes), frame.columns, frame.collect())
        return made[name]

    return rows


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(name, found, duck):
    types, columns, rows = found(name)
    want = [c.split() for c in COLUMNS[name].split(", ")]
    assert columns[: len(want)] == [n for n, _ in want] and all(types[n] == t for n, t in want)
    table = {"vec_id": "embeddings", "page_id": "pages", "doc_id": "documents"}.get(want[0][0])
    if table:
        assert collections.Counter(r[0] for r in rows) == collections.Counter(r[0] for r in duck.execute(f"SELECT {want[0][0]} FROM {table}").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_the_sql(name, found, duck):
    _, columns, rows = found(name)
    answer = duck.execute(queries.ORACLES[name])
    at = [[d[0] for d in answer.description].index(c) for c in columns]
    assert collections.Counter(map(tuple, rows)) == collections.Counter(tuple(r[k] for k in at) for r in answer.fetchall())


@pytest.mark.parametrize(("name", "modulus", "held", "least"), [("op1_toxicity", 5, 0, 0.5), ("op7_pu_quality", 4, 2, 0.7)])
def test_scores(name, modulus, held, least, found):
    for r in found(name)[2]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)


def test_rule_counts(found, texts):
    for r in found("op3_decision_list")[2]:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["base_failed"] == (len(w) < 10 or 100 * r["n_repeat_words"] > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_mix_takes_near_the_target(found):
    taken, target, longest = collections.Counter(), {}, 0
    for r in found("op5_source_mix")[2]:
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        target[key], longest = r["target"], max(longest, r["size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
    assert all(abs(taken[k] - t) <= longest * len(target) for k, t in target.items())


def test_tokens(found, texts):
    from tokenizers import Tokenizer

    rows = found("op8_token_counts")[2]
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["n_bytes"] == len(text.encode()) and r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
        assert r["over_limit"] == (r["n_tokens"] > 1024)


def test_page_lengths(found):
    assert all(r["n_chars"] == len(r["text"]) for r in found("op9_page_text")[2])


def test_shards_split(found):
    rows = found("op10_hash_shards")[2]
    assert len({r["shard"] for r in rows}) > 4  # 64 KiB a shard, so that the rule shows on small tables
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["n_bytes"]
    assert all(r["shard_bytes"] == sizes[r["shard"]] for r in rows)


def test_item_digests(found):
    none = hashlib.sha256(b"").hexdigest()
    for r in found("op13_benchmark_passages")[2]:
        assert (r["n_items"] == 0) == (r["items_sha256"] == none) == (not r["contaminated"]) and r["n_hit"] <= r["n_words"]


def test_buckets_hold_their_rows(found):
    assert all(r["n_tokens"] <= r["padded_length"] for r in found("op2_length_buckets")[2])
