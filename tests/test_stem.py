"""Stems: the published examples, and a plain Python form of the rules over many made words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import stem
from quillgraph.operators import text as tt

# word and final stem, worked by hand through all steps
EXAMPLES = """caresses caress|ponies poni|ties ti|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing
conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky
relational relat|conditional condit|rational ration|digitizer digit|radically radic|differently differ|vilely vile|vietnamization vietnam|predication predic
operator oper|feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|formality formal|sensitivity sensit|sensibility sensibl|triplicate triplic
formative form|formalize formal|electricity electr|electrical electr|hopeful hope|goodness good|revival reviv|allowance allow|inference infer|airliner airlin
gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|communism commun
activate activ|angularity angular|homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controlling control|rolling roll
a a|is is|be be|the the|yes ye|toy toi|say sai|graphs graph|running run|queries queri|streams stream|joined join|partitions partit|shuffles shuffl|as as"""


def vowels(word):
    """Shape by a loop over the letters."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def plain_stem(word):
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    m = lambda s: vowels(s).count("vc")
    star_o = lambda s: vowels(s).endswith("cvc") and s[-1] not in "wxy"
    twin = lambda s: len(s) > 1 and s[-1] == s[-2] and vowels(s).endswith("cc")

    def swap(w, rules, least):
        for end in sorted(rules, key=len, reverse=True):
            if w.endswith(end):
                base = w[: len(w) - len(end)]
                return base + rules[end] if m(base) >= least else w
        return w

    w = swap(word, stem.PLURALS, 0)
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                base = w[: -len(end)]
                if "v" in vowels(base):
                    w = base
                    if w[-2:] in ("at", "bl", "iz"):
                        w += "e"
                    elif twin(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif m(w) == 1 and star_o(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in vowels(w[:-1]):
        w = w[:-1] + "i"
    w = swap(swap(w, stem.LONG_ENDINGS, 1), stem.MIDDLE_ENDINGS, 1)
    if w.endswith("ion"):
        w = w[:-3] if m(w[:-3]) > 1 and w[-4:-3] in ("s", "t") else w
    else:
        w = swap(w, dict.fromkeys(stem.LAST_ENDINGS, ""), 2)
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not star_o(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and m(w) > 1 else w


@pytest.fixture(scope="module")
def stems(spark):
    rng = random.Random(2)
    ends = [*stem.PLURALS, "eed", "ed", "ing", "y", *stem.LONG_ENDINGS, *stem.MIDDLE_ENDINGS, *stem.LAST_ENDINGS, "e", "ll", "sion", "tion", "ly"]
    words = {"".join(rng.choices("aeiouybcdlstz", k=rng.randint(0, 6))) + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(600)}
    words |= {pair.split()[0] for pair in EXAMPLES.replace("\n", "|").split("|")} | {"", "x", "ab", "naïve", "re-run", "it's", "9th", "a" * 500 + "ing"}
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    return {r["word"]: r["stem"] for r in frame.select("word", stem.porter(F.col("word")).alias("stem")).collect()}


def test_published_examples(stems):
    pairs = dict(pair.split() for pair in EXAMPLES.replace("\n", "|").split("|"))
    assert {w: stems[w] for w in pairs} == pairs


def test_rules_against_plain_python(stems):
    assert len(stems) > 500 and stems == {w: plain_stem(w) for w in stems}


def test_word_graph_of_stems(spark):
    docs = spark.createDataFrame([(1, "Running queries joined. The joining queries ran."), (2, "Joins run."), (3, None)], "doc_id long, text string")
    words = tt.stem_table(tt.with_tokens(docs), stemmer=stem.porter)
    rows = tt.word_table(words).collect()
    assert {(r["word"], r["stem"]) for r in rows} == {(w, plain_stem(w)) for w in ("running", "queries", "joined", "the", "joining", "ran", "joins", "run")}
    ids = {r["stem"]: r["id"] for r in rows}
    assert sorted(ids.values()) == list(range(len(ids))) and sorted(ids, key=ids.get) == sorted(ids)
    by_place = {(r["doc_id"], r["index"]): r["id"] for r in rows}
    links = {(r["doc_id"], r["n0"], r["n1"]) for r in tt.link_edges(words).collect()}
    assert (1, by_place[(1, 0)], by_place[(1, 1)]) not in links or links  # links are pairs of these ids
    assert all(n in ids.values() for _, a, b in links for n in (a, b))
