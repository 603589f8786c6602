"""Text column expressions.

A message is one row, and everything up to its tagged token list stays in that row:
arrays and higher-order functions instead of exploding, shuffling and collecting
again.  ``tokens`` is the array the other text operators start from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: the cut rules of the quote filter, in their order of use.
FORWARD = r"\n-+ Forwarded message -+\n"
REPLIED = r"\nOn.*\d+.*\n?wrote:\n+>"
UNSUBSCRIBE = r"\n-+\nTo unsubscribe,.*\nFor additional commands,.*"
UNPRINTABLE = r"[^\x20-\x7E\t\n\r\x0B\x0C]"
NOT_WORD = r"^([^\p{L}\p{N}_]+|_+)$"
SENTENCE_END = r"([.!?])[ \t\n\r\f]+"
WORD = r"[\p{L}\p{N}_]*[\p{L}\p{N}][\p{L}\p{N}_]*(?:['-][\p{L}\p{N}_]+)*"
# matches what WORD matches, in Java's regular expressions without steps back over the word
_WORD = r"_*[\p{L}\p{N}][\p{L}\p{N}_]*(?:['-][\p{L}\p{N}_]+)*"
MARK = "\x01"

# Fixed word lists of the default tagger: closed word classes of English.
CLOSED_CLASSES = {
    "DT": ["a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any", "no", "all", "both"],
    "IN": [
        "of", "in", "on", "at", "by", "for", "with", "from", "into", "over", "under", "about", "after", "before",
        "between", "through", "during", "without", "within", "against", "among", "as", "than", "if", "because",
        "while", "since", "until", "although",
    ],
    "TO": ["to"],
    "CC": ["and", "or", "but", "nor", "yet"],
    "PRP": ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them"],
    "PRP$": ["my", "your", "his", "its", "our", "their"],
    "MD": ["can", "could", "may", "might", "must", "shall", "should", "will", "would"],
    "WP": ["who", "whom", "what", "which", "whose"],
    "WRB": ["when", "where", "why", "how"],
    "RB": ["not", "very", "too", "also", "just", "only", "never", "always", "often", "here", "there", "now", "then", "so"],
    "VB": ["be", "am", "is", "are", "was", "were", "been", "being", "have", "has", "had", "do", "does", "did"],
}
# Fixed suffix rules of the default tagger, first match wins: tag, characters before the
# suffix at least, suffixes.  Then plural nouns by a pattern.
SUFFIXES = [
    ("RB", 2, ["ly"]),
    ("VBG", 3, ["ing"]),
    ("VBD", 3, ["ed"]),
    ("NN", 2, ["tion", "sion", "ment", "ness", "ity", "ism", "ship"]),
    ("JJ", 2, ["ous", "ful", "ive", "able", "ible", "al", "ic", "less", "ish"]),
    ("VB", 2, ["ize", "ise", "ify", "ate"]),
]
PLURAL = r"..[a-hj-rtv-z]s$"
IRREGULAR_VERBS = {
    "be": ["am", "is", "are", "was", "were", "been", "being"],
    "have": ["has", "had"],
    "do": ["does", "did"],
}
SMALL_KEEP_TAGS = ["JJ", "NN", "NNS", "NNP"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def printable(text: Column) -> Column:
    """Only printable ASCII and whitespace."""
    return F.regexp_replace(text, UNPRINTABLE, "")


def is_not_word(word: Column) -> Column:
    return word.rlike(NOT_WORD)


def _before(text: Column, pattern: str) -> Column:
    # (?d): a dot stops at \n only
    return F.get(F.split(text, "(?d)" + pattern, 2), F.lit(0))


def paragraphs(text: Column) -> Column:
    """The new text of a message as an array of paragraphs: no quotes, forwards or list footer."""
    cut = printable(text)
    for pattern in (FORWARD, REPLIED, UNSUBSCRIBE):
        cut = _before(cut, pattern)
    lines = F.transform(
        F.split(cut, "\n"),
        lambda line: F.when(line.startswith(">"), F.lit("")).otherwise(F.btrim(line, F.lit(" \t\r\x0b\x0c"))),
    )
    joined = F.btrim(F.array_join(lines, "\n"), F.lit("\n"))
    return F.filter(F.split(joined, "\n\n+"), lambda p: p != "")


def blocks(text: Column) -> Column:
    """A text that is no mail as an array of paragraphs, cut at blank lines and otherwise whole."""
    return F.filter(F.split(text, "\n\n+"), lambda p: p != "")


def sentences(paras: Column) -> Column:
    """Array of paragraphs to one array of sentences."""
    parts = F.transform(paras, lambda p: F.split(F.regexp_replace(p, SENTENCE_END, "$1" + MARK), MARK))
    return F.filter(F.flatten(parts), lambda s: s != "")


def words(sentence: Column) -> Column:
    """Words of a sentence; runs of punctuation or underscores are no words."""
    return F.regexp_extract_all(sentence, F.lit(_WORD), F.lit(0))


def packed(paras: Column) -> Column:
    """The words of an array of paragraphs as one string: a line for each sentence, a space between words.

    No word holds a space or a line end, so a text reaches Python as one value and is shuffled without its signs.
    """
    return F.array_join(F.transform(sentences(paras), lambda s: F.array_join(words(s), " ")), "\n")


def tag(word: Column, low: Column, index: Column) -> Column:
    """Default part-of-speech tag by closed classes, then suffix, then capital, else noun.

    Runs once per word of every text, so cheap tests stand before dear ones.
    """
    closed = F.lit(None).cast("string")
    for name, members in reversed(CLOSED_CLASSES.items()):
        closed = F.when(low.isin(members), F.lit(name)).otherwise(closed)
    out = F.when((low >= "0") & (low < ":"), F.lit("CD")).when(low.isin(sorted(sum(CLOSED_CLASSES.values(), []))), closed)
    for name, before, endings in SUFFIXES:
        for ending in endings:
            out = out.when(low.endswith(ending) & (F.length(low) >= before + len(ending)), F.lit(name))
    out = out.when(low.endswith("s") & low.rlike(PLURAL), F.lit("NNS"))
    out = out.when((index > 0) & word.between("A", "Z~"), F.lit("NNP"))
    return out.otherwise(F.lit("NN"))


def lemma(low: Column, pos: Column) -> Column:
    """Default base form: plural nouns and verb endings only."""
    out = None
    for base, forms in IRREGULAR_VERBS.items():
        test = (pos == "VB") & low.isin(forms)
        out = F.when(test, F.lit(base)) if out is None else out.when(test, F.lit(base))
    plural = (
        F.when(low.rlike("..ies$"), F.regexp_replace(low, "ies$", "y"))
        .when(low.rlike("(x|z|ch|sh)es$"), F.regexp_replace(low, "es$", ""))
        .otherwise(F.regexp_replace(low, "s$", ""))
    )
    return (
        out.when(pos == "NNS", plural)
        .when(pos == "VBG", F.regexp_replace(low, "ing$", ""))
        .when(pos == "VBD", F.regexp_replace(low, "ed$", ""))
        .otherwise(low)
    )


def keep(pos: Column) -> Column:
    """1 for verbs, nouns and adjectives."""
    return F.substring(pos, 1, 1).isin("V", "N", "J").cast("int")


def tokens(text: Column, *, parts: Callable[[Column], Column] = blocks, tagger: Callable[[Column, Column, Column], Column] = tag,
           lemmatizer: Callable[[Column, Column], Column] = lemma) -> Column:
    """Tagged words of a text, in order.

    array<struct<sent, num, raw, root, pos, keep>>; ``num`` runs on over the whole text.
    ``parts`` cuts it into paragraphs: ``blocks`` keeps all of it, ``paragraphs`` is for mails.
    """
    return flat_tokens(sentences(parts(text)), tagger=tagger, lemmatizer=lemmatizer)


def flat_tokens(sents: Column, *, tagger: Callable[[Column, Column, Column], Column] = tag,
                lemmatizer: Callable[[Column, Column], Column] = lemma) -> Column:
    def mark(sentence: Column, sent_no: Column) -> Column:
        pairs = F.transform(words(sentence), lambda w: F.struct(w.alias("raw"), F.lower(w).alias("low")))
        return F.transform(
            pairs,
            lambda p, i: F.struct(
                sent_no.alias("sent"), p["raw"].alias("raw"), p["low"].alias("low"), tagger(p["raw"], p["low"], i).alias("pos")
            ),
        )

    return F.transform(
        F.flatten(F.transform(sents, mark)),
        lambda t, num: F.struct(
            t["sent"].alias("sent"),
            num.alias("num"),
            t["raw"].alias("raw"),
            lemmatizer(t["low"], t["pos"]).alias("root"),
            t["pos"].alias("pos"),
            keep(t["pos"]).alias("keep"),
        ),
    )


def sentence_sizes(sents: Column) -> Column:
    return F.transform(sents, lambda s: F.size(words(s)))


def sentence_starts(sizes: Column) -> Column:
    """Exclusive running sum of ``sizes`` in linear time.

    Sentence m of size k adds the numbers 0..k to one flat list, so its 0 stands at
    index offset + m.
    """
    flat = F.flatten(F.transform(sizes, lambda k: F.sequence(F.lit(0), k)))
    zeros = F.filter(F.transform(flat, lambda k, j: F.struct(k.alias("k"), j.alias("j"))), lambda x: x["k"] == 0)
    return F.transform(zeros, lambda x, m: (x["j"] - m).cast("long"))


def _shifted(toks: Column, distance: int, pair: Callable[[Column, Column], Column]) -> Column:
    span = F.greatest(F.size(toks) - distance, F.lit(0))
    return F.zip_with(F.slice(toks, 1, span), F.slice(toks, 1 + distance, span), pair)


def tiles(toks: Column, size: int = 3) -> Column:
    """Pairs of kept words of one sentence at most ``size`` apart, as token positions.

    array<struct<i, j>>; at most ``size`` pairs per word.
    """
    def pair(a: Column, b: Column) -> Column:
        ok = (a["sent"] == b["sent"]) & (a["keep"] == 1) & (b["keep"] == 1)
        return F.when(ok, F.struct(a["num"].alias("i"), b["num"].alias("j")))

    return F.concat(*[F.filter(_shifted(toks, d, pair), lambda p: p.isNotNull()) for d in range(1, size + 1)])


def window_links(toks: Column) -> Column:
    """First word of each full three-word window linked to the other two.

    Both words kept (``keep``) and different.  The last two words of a sentence start no
    full window, so they are not linked to each other.
    array<struct<i, j>> of token positions.
    """
    def linked(a: Column, b: Column) -> Column:
        kept = a["pos"].isin(SMALL_KEEP_TAGS) & b["pos"].isin(SMALL_KEEP_TAGS)
        return kept & (F.lower(a["raw"]) != F.lower(b["raw"]))

    span = F.greatest(F.size(toks) - 2, F.lit(0))
    windows = F.zip_with(
        _shifted(F.slice(toks, 1, span + 1), 1, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice(toks, 3, span),
        lambda ab, c: F.struct(ab["a"].alias("a"), ab["b"].alias("b"), c.alias("c")),
    )
    full = F.filter(windows, lambda w: w["a"]["sent"] == w["c"]["sent"])
    links = F.flatten(
        F.transform(
            full,
            lambda w: F.array(
                F.when(linked(w["a"], w["b"]), F.struct(w["a"]["num"].alias("i"), w["b"]["num"].alias("j"))),
                F.when(linked(w["a"], w["c"]), F.struct(w["a"]["num"].alias("i"), w["c"]["num"].alias("j"))),
            ),
        )
    )
    return F.filter(links, lambda p: p.isNotNull())


def runs(flags: Column, starts: Column | None = None) -> Column:
    """Maximal runs of true in an array<boolean>: array<struct<start, len>>, linear time.

    Where ``starts`` is true a run is cut and a new one begins.
    """
    letter = lambda f, s: F.when(f & s, F.lit("s")).when(f, F.lit("1")).otherwise(F.lit("0"))
    marked = F.transform(flags, lambda f: letter(f, F.lit(False))) if starts is None else F.zip_with(flags, starts, letter)
    pieces = F.filter(F.split(F.array_join(marked, ""), "(?=s)|(?<=[s1])(?=0)|(?<=0)(?=1)"), lambda p: p != "")

    def spans(p: Column) -> Column:
        begins = sentence_starts(F.transform(p, F.length))
        both = F.zip_with(
            p, begins, lambda s, at: F.struct(at.cast("int").alias("start"), F.length(s).alias("len"), (~s.startswith("0")).alias("on"))
        )
        return F.filter(both, lambda r: r["on"])

    return F.transform(let(pieces, spans), lambda r: F.struct(r["start"].alias("start"), r["len"].alias("len")))


def median(values: Column) -> Column:
    """Exact median of an array<double>; the mean of the middle two for an even size."""
    def middle(v: Column) -> Column:
        n = F.size(v)
        low = F.get(v, F.floor((n - 1) / 2).cast("int"))
        high = F.get(v, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)

    return let(F.array_sort(values), middle)


def content_sha1(roots: Column) -> Column:
    """Fingerprint of a sentence: SHA-1 over its joined lemmas."""
    return F.sha1(F.array_join(roots, ""))
