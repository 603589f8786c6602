"""Word stems by the suffix rules of Porter (1980), as column expressions.

A word's shape is a string of c and v (y after a consonant is a vowel); the measure of a stem is the number
of times a vowel is followed by a consonant in its shape.  A step takes the longest of its endings the word
has and puts another in its place if the stem before it is good enough; otherwise the word stays.
Meant for distinct words: the expressions are long, and a text repeats its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import let

# The endings of each step and what takes their place.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
MENDED_BY_E = ["at", "bl", "iz"]
LONG_ENDINGS = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
MIDDLE_ENDINGS = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST_ENDINGS = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

Test = Callable[[Column, Column], Column]


def shape(word: Column) -> Column:
    """One letter, c or v, for each letter of a lower-case word."""
    def kind(seen: Column, c: Column) -> Column:
        vowel = c.isin("a", "e", "i", "o", "u") | ((c == "y") & seen.endswith("c"))
        return F.concat(seen, F.when(vowel, F.lit("v")).otherwise(F.lit("c")))

    return F.aggregate(F.split(word, ""), F.lit(""), kind)


def measure(form: Column) -> Column:
    return F.regexp_count(form, F.lit("vc"))


def _shaped(word: Column, body: Test) -> Column:
    """``body`` of the word and its shape, each computed once."""
    pair = let(word, lambda w: F.struct(w.alias("w"), shape(w).alias("f")))
    return let(pair, lambda p: body(p["w"], p["f"]))


def _cut(text: Column, n: int) -> Column:
    return F.substr(text, F.lit(1), F.length(text) - n)


def _double(word: Column, form: Column) -> Column:
    """Ends in two equal consonants."""
    return form.endswith("cc") & (F.substring(word, -1, 1) == F.substring(word, -2, 1))


def _short(word: Column, form: Column) -> Column:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return form.endswith("cvc") & ~F.substring(word, -1, 1).isin("w", "x", "y")


def _replaced(w: Column, f: Column, rules: dict[str, str], good: Test) -> Column:
    """The word with its longest ending among ``rules`` replaced, if ``good`` holds for what is before it."""
    out = None
    for ending in sorted(rules, key=lambda x: (-len(x), x)):
        stem = _cut(w, len(ending))
        new = F.when(good(stem, _cut(f, len(ending))), F.concat(stem, F.lit(rules[ending]))).otherwise(w)
        out = F.when(w.endswith(ending), new) if out is None else out.when(w.endswith(ending), new)
    return out.otherwise(w)


def _participles(w: Column, f: Column) -> Column:
    """-eed, -ed and -ing; a stem that lost -ed or -ing is repaired."""
    def repaired(stem: Column, form: Column) -> Column:
        out = F.when(F.substring(stem, -2, 2).isin(MENDED_BY_E), F.concat(stem, F.lit("e")))
        out = out.when(_double(stem, form) & ~F.substring(stem, -1, 1).isin("l", "s", "z"), _cut(stem, 1))
        return out.when((measure(form) == 1) & _short(stem, form), F.concat(stem, F.lit("e"))).otherwise(stem)

    def without(n: int) -> Column:
        return F.when(F.contains(_cut(f, n), F.lit("v")), let(F.struct(_cut(w, n).alias("w"), _cut(f, n).alias("f")), lambda s: repaired(s["w"], s["f"]))).otherwise(w)

    eed = F.when(measure(_cut(f, 3)) > 0, _cut(w, 1)).otherwise(w)
    return F.when(w.endswith("eed"), eed).when(w.endswith("ed"), without(2)).when(w.endswith("ing"), without(3)).otherwise(w)


def _final_letters(w: Column, f: Column) -> Column:
    """A last e, then one of two last l, where the stem is long."""
    stem, form = _cut(w, 1), _cut(f, 1)
    m = measure(form)
    drop = w.endswith("e") & ((m > 1) | ((m == 1) & ~_short(stem, form)))
    rest = F.struct(F.when(drop, stem).otherwise(w).alias("w"), F.when(drop, form).otherwise(f).alias("f"))
    return let(rest, lambda r: F.when(r["w"].endswith("ll") & (measure(r["f"]) > 1), _cut(r["w"], 1)).otherwise(r["w"]))


def porter(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters and words with other signs than a-z stay."""
    some: Test = lambda s, f: measure(f) > 0
    many: Test = lambda s, f: measure(f) > 1
    steps: list[Test] = [
        lambda w, f: _replaced(w, f, PLURALS, lambda s, g: F.lit(True)),
        _participles,
        lambda w, f: F.when(w.endswith("y") & F.contains(_cut(f, 1), F.lit("v")), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w),
        lambda w, f: _replaced(w, f, LONG_ENDINGS, some),
        lambda w, f: _replaced(w, f, MIDDLE_ENDINGS, some),
        lambda w, f: F.when(
            w.endswith("ion"), F.when((measure(_cut(f, 3)) > 1) & (w.endswith("sion") | w.endswith("tion")), _cut(w, 3)).otherwise(w)
        ).otherwise(_replaced(w, f, dict.fromkeys(LAST_ENDINGS, ""), many)),
        _final_letters,
    ]
    out = word
    for step in steps:
        out = _shaped(out, step)
    return F.when((F.length(word) > 2) & word.rlike("^[a-z]+$"), out).otherwise(word)
