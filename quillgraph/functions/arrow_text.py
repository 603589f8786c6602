"""Tagging and word graphs of whole Arrow batches.

Texts stay rows: a function here takes array columns of a batch, works on their flat values with numpy and
gives arrays back.  Words are dictionary-encoded first, so the rules of the tagger run once for each distinct
word of a batch.  Batches are gone through in pieces of about ``PIECE`` words, and what is made of a piece is
handed on before the next one, so memory follows the piece and not the batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions import text as tx

TOKENS = "array<struct<sent:int,num:int,raw:string,root:string,pos:string,keep:int>>"
GRAF = "array<struct<num:int,sent:int,node_id:long,raw:string,root:string,pos:string,keep:int>>"
PIECE = 1 << 17
_CLOSED = {word: name for name, members in reversed(tx.CLOSED_CLASSES.items()) for word in members}
_BASES = {form: base for base, forms in reversed(tx.IRREGULAR_VERBS.items()) for form in forms}
_SUFFIXES = [(name, before, tuple(endings)) for name, before, endings in tx.SUFFIXES]
_TAGS = list(dict.fromkeys(["CD", "NN", "NNP", "NNS", *_CLOSED.values(), *(name for name, _, _ in _SUFFIXES)]))
_KEPT = np.array([name[0] in "VNJ" for name in _TAGS], dtype=np.int32)
_PLURAL, _IES, _ES = re.compile(tx.PLURAL), re.compile("..ies$"), re.compile("(x|z|ch|sh)es$")


def tag_word(raw: str, low: str, first: bool) -> str:
    """``text.tag`` for one word."""
    if "0" <= low < ":":
        return "CD"
    if low in _CLOSED:
        return _CLOSED[low]
    for name, before, endings in _SUFFIXES:
        if low.endswith(endings) and any(low.endswith(x) and len(low) >= before + len(x) for x in endings):
            return name
    if low.endswith("s") and _PLURAL.search(low):
        return "NNS"
    return "NNP" if not first and "A" <= raw <= "Z~" else "NN"


def lemma_word(low: str, pos: str) -> str:
    """``text.lemma`` for one word."""
    if pos == "VB" and low in _BASES:
        return _BASES[low]
    if pos == "NNS":
        if _IES.search(low):
            return low[:-3] + "y"
        return low[:-2] if _ES.search(low) else low.removesuffix("s")
    if pos == "VBG":
        return low.removesuffix("ing")
    return low.removesuffix("ed") if pos == "VBD" else low


def tag_forms(raw: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of distinct words: the tags at the start of a sentence and later on, as places in ``_TAGS``, the lower-case forms and the lemmas.

    What ``tag_word`` and ``lemma_word`` give for one word, but each rule is asked of all words at once.  The
    two tags differ only between nouns and names, so a form has one lemma.
    """
    lows = [w.lower() for w in _strings(raw)]
    low = pa.array(lows, pa.string())
    size = _numbers(pc.utf8_length(low))
    true = lambda found: _numbers(found).astype(bool)
    tag = np.full(len(lows), -1)

    def give(name: str, fits: np.ndarray) -> None:
        tag[fits & (tag < 0)] = _TAGS.index(name)

    give("CD", true(pc.greater_equal(low, "0")) & true(pc.less(low, ":")))
    closed = _numbers(pc.fill_null(pc.index_in(low, value_set=pa.array(list(_CLOSED), pa.string())), -1))
    of_class = np.array([_TAGS.index(name) for name in _CLOSED.values()])
    tag = np.where((tag < 0) & (closed >= 0), of_class[closed], tag)
    for name, before, endings in _SUFFIXES:
        fits = np.zeros(len(lows), dtype=bool)
        for ending in endings:
            fits |= true(pc.ends_with(low, ending)) & (size >= before + len(ending))
        give(name, fits)
    give("NNS", true(pc.match_substring_regex(low, tx.PLURAL)))
    proper = true(pc.greater_equal(raw, "A")) & true(pc.less_equal(raw, "Z~"))
    later = np.where(tag < 0, _TAGS.index("NN"), tag)
    later[(tag < 0) & proper] = _TAGS.index("NNP")
    start = np.where(tag < 0, _TAGS.index("NN"), tag)
    for k in np.flatnonzero(np.isin(start, [_TAGS.index(name) for name in ("VB", "VBG", "VBD", "NNS") if name in _TAGS])):
        lows[k] = lemma_word(lows[k], _TAGS[start[k]])
    return start, later, low, pa.array(lows, pa.string())


def _ends(lists: pa.Array) -> np.ndarray:
    """Offsets of a list array's values from 0 on; null lists have none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _lists(ends: np.ndarray, values: pa.Array, like: pa.Array | None = None) -> pa.Array:
    mask = like.is_null() if like is not None and like.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values, mask=mask)


def _structs(**columns) -> pa.Array:
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _strings(values: pa.Array) -> list[str]:
    """As ``to_pylist``, without a scalar for each value on the way."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _cuts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) with about ``PIECE`` words, one row at least."""
    lo = 0
    while lo < len(ends) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, side="right")) - 1)
        yield lo, hi
        lo = hi


def word_ends(words: pa.Array, tag: bool) -> np.ndarray:
    """Where the words of each row end: of tagged words or, if they are still to ``tag``, of sentences of words.

    Of packed texts (see ``text.packed``) a sentence without words counts as one word.
    """
    if not tag:
        return _ends(words)
    if pa.types.is_list(words.type):
        return _ends(words.flatten())[_ends(words)]
    gaps = [pc.fill_null(pc.count_substring(words, mark), 0).to_numpy(zero_copy_only=False) for mark in (" ", "\n")]
    return np.concatenate(([0], np.cumsum(gaps[0] + gaps[1] + 1, dtype=np.int64)))


def _sentences_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts, the ends of the texts in sentences and those of the sentences in words."""
    if pa.types.is_list(texts.type):
        sents = texts.flatten()
        return sents.flatten(), _ends(texts), _ends(sents)
    lines = pc.split_pattern(texts, "\n")
    sents = lines.flatten()
    split = pc.split_pattern(sents, " ")
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    empty = _numbers(pc.equal(sents, "")).astype(bool)
    if empty.any():
        words, sizes = words.filter(pc.not_equal(words, "")), np.where(empty, 0, sizes)
    return words, _ends(lines), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


class Words:
    """The words of some texts in order: where each text ends, and of each word its sentence, number and entry (``at``).

    Entries hold what words have in common: raw, root, pos and keep.  Words that were tagged here share
    the entry of their form, so what is asked of an entry is found once for all its words.
    """

    def __init__(self, like: pa.Array, ends: np.ndarray, sent, num, at: np.ndarray | None, raw: pa.Array, root: pa.Array, pos: pa.Array, keep, low: pa.Array | None = None) -> None:
        self.like, self.ends, self.sent, self.num, self.at = like, ends, sent, num, at
        self.raw, self.root, self.pos, self.keep = raw, root, pos, keep
        self._low = low

    @property
    def low(self) -> pa.Array:
        """The forms as they stand in the text, in lower case."""
        if self._low is None:
            coded = self.raw.dictionary_encode()
            self._low = pa.array([w.lower() for w in _strings(coded.dictionary)], pa.string()).take(coded.indices)
        return self._low

    def spread(self, entries):
        """A value of each entry as the values of the words."""
        if self.at is None:
            return entries
        return entries[self.at] if isinstance(entries, np.ndarray) else entries.take(pa.array(self.at))

    def tagged(self) -> pa.Array:
        """Texts as arrays of tagged words (``TOKENS``)."""
        columns = {name: self.spread(getattr(self, name)) for name in ("raw", "root", "pos", "keep")}
        return _lists(self.ends, _structs(sent=self.sent, num=self.num, **columns), self.like)

    def counts(self, key: str) -> tuple[pa.Array, np.ndarray]:
        """What ``key`` names of the entries (see ``KEYS``), and of how many words; a value can come more than once."""
        values, kept = KEYS[key](self)
        if self.at is None:
            found = (values if kept is None else values.filter(pa.array(kept))).value_counts()
            return found.field("values").cast(pa.string()), _numbers(found.field("counts"))
        n = np.bincount(self.at, minlength=len(values))
        met = n > 0 if kept is None else (n > 0) & kept
        return values.filter(pa.array(met)).cast(pa.string()), n[met]

    def nodes(self, known: pa.Table, by: str) -> np.ndarray:
        """The id of each word in a dictionary (key, node_id, root), 0 without one."""
        values, kept = KEYS[by](self)
        entries = known.combine_chunks()
        ids = np.append(_numbers(pc.fill_null(_column(entries, "node_id", pa.int64()), 0)).astype(np.int64), 0)
        node = ids[_looked_up(values, _column(entries, "key", pa.string()))]
        return self.spread(node if kept is None else np.where(kept, node, 0))


#: the words of a text that a dictionary is asked for, by name: the values of the entries, and which of them count if not all do
KEYS: dict[str, Callable[[Words], tuple[pa.Array, np.ndarray | None]]] = {
    "kept": lambda words: (words.root, _numbers(words.keep) == 1 if isinstance(words.keep, pa.Array) else words.keep == 1),
    "root": lambda words: (words.root, None),
    "low": lambda words: (words.low, None),
}


def _column(table: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([*table.column(name).chunks, pa.array([], kind)])


def words_in(toks: pa.Array) -> Words:
    """Arrays of tagged words (``TOKENS`` or ``GRAF``) as words, each its own entry."""
    flat = toks.flatten()
    raw, root, pos = (flat.field(name) for name in ("raw", "root", "pos"))
    return Words(toks, _ends(toks), flat.field("sent"), flat.field("num"), None, raw, root, pos, flat.field("keep"))


def node_ids(graf: pa.Array) -> np.ndarray:
    """The ids of the words of texts that have them (``GRAF``)."""
    return _numbers(graf.flatten().field("node_id")).astype(np.int64)


def by_pieces(kind: str, step: Callable[..., pa.Array], tag: bool = False):
    """``step`` as an Arrow function of tagged words, or of sentences of words which it tags first."""
    tagged = tagger()

    @F.arrow_udf(kind)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            for lo, hi in _cuts(word_ends(words, tag)):
                part = words.slice(lo, hi - lo)
                yield step(tagged(part) if tag else part)

    return pieces


def coder(tag: bool) -> Callable[[pa.Array], Words]:
    """Texts as their words: tagged ones, or sentences of words that are tagged here."""
    if not tag:
        return words_in
    def coded(texts: pa.Array) -> Words:
        words, text_ends, sent_ends = _sentences_of(texts)
        ends = sent_ends[text_ends]
        sizes = np.diff(sent_ends)
        first = np.zeros(len(words), dtype=np.int64)
        first[sent_ends[:-1][sizes > 0]] = 1
        number = np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends))
        of_sent = np.arange(len(sizes)) - np.repeat(text_ends[:-1], np.diff(text_ends))
        forms = words.dictionary_encode()
        start, later, low, root = tag_forms(forms.dictionary)
        # entry 2 k is word k later in a sentence, 2 k + 1 at its start
        twice, tags = pa.array(np.repeat(np.arange(len(low)), 2)), np.column_stack((later, start)).ravel()
        pos, keep = pa.array(_TAGS, pa.string()).take(pa.array(tags)), _KEPT[tags]
        raw, root, low = (x.cast(pa.string()).take(twice) for x in (forms.dictionary, root, low))
        at = 2 * _numbers(forms.indices).astype(np.int64) + first
        return Words(texts, ends, np.repeat(of_sent, sizes).astype(np.int32), number.astype(np.int32), at, raw, root, pos, keep, low)

    return coded


def tagger() -> Callable[[pa.Array], pa.Array]:
    """Sentences of words to the tagged words of a text (``TOKENS``)."""
    coded = coder(True)
    return lambda texts: coded(texts).tagged()


def tag_udf():
    """Sentences as arrays of words to the tagged words of a text (``TOKENS``)."""
    return by_pieces(TOKENS, lambda toks: toks, tag=True)


def _looked_up(values: pa.Array, keys: pa.Array) -> np.ndarray:
    """For each value its place among the distinct ``keys``, -1 if it has none."""
    coded = values.cast(pa.string()).dictionary_encode()
    at = pc.fill_null(pc.index_in(coded.dictionary, value_set=keys.cast(pa.string())), -1)
    return _numbers(at.take(coded.indices)).astype(np.int64)


def number_words(words: Words, known: pa.Table, by: str) -> pa.Array:
    """Words and a dictionary (key, node_id, root) to texts as arrays of words with their ids (``GRAF``); 0 without one.

    ``by`` names what the keys are.  By ``low`` the words get the roots of the dictionary, too.
    """
    rest = {name: words.spread(getattr(words, name)) for name in ("raw", "root", "pos", "keep")}
    if by == "low":
        entries = known.combine_chunks()
        roots = pa.concat_arrays([_column(entries, "root", pa.string()), pa.array([None], pa.string())])
        at = _looked_up(words.low, _column(entries, "key", pa.string()))
        rest["root"] = words.spread(roots.take(pa.array(np.where(at < 0, len(roots) - 1, at))))
    return _lists(words.ends, _structs(num=words.num, sent=words.sent, node_id=words.nodes(known, by), **rest), words.like)


def _sentences(ends: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """A number for each word that is the same in one sentence of one row only."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    change = (np.diff(row, prepend=-1) != 0) | (np.diff(sent, prepend=-1) != 0)
    return np.cumsum(change) - 1


def _near(sentence: np.ndarray, good: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of good words of one sentence at most ``size`` apart, by distance."""
    found = []
    for d in range(1, size + 1):
        i = np.flatnonzero((sentence[:-d] == sentence[d:]) & good[:-d] & good[d:]) if len(sentence) > d else np.zeros(0, np.int64)
        found.append((i, i + d))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _windows(sentence: np.ndarray, good: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first word of each full window of three words and of the good, different words after it."""
    i = np.flatnonzero(sentence[:-2] == sentence[2:]) if len(sentence) > 2 else np.zeros(0, np.int64)
    a, b = np.concatenate((i, i)), np.concatenate((i + 1, i + 2))
    fits = good[a] & good[b] & (word[a] != word[b])
    return a[fits], b[fits]


def _by_row(ends: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings pairs of one row together, and the ends of the rows."""
    row = np.searchsorted(ends, i, side="right") - 1
    counts = np.bincount(row, minlength=len(ends) - 1)
    return np.argsort(row, kind="stable"), np.concatenate(([0], np.cumsum(counts)))


def _small_words(raw: pa.Array, pos: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word has a tag of the small word graph, and its lower-case form as a code."""
    good = _numbers(pc.is_in(pos.cast(pa.string()), pa.array(tx.SMALL_KEEP_TAGS)))
    coded = raw.dictionary_encode()
    lows = pa.array([w.lower() for w in _strings(coded.dictionary)], pa.string()).dictionary_encode()
    table = _numbers(lows.indices).astype(np.int64)
    return good, table[_numbers(coded.indices)] if len(raw) else np.zeros(0, np.int64)


def _pairs(flat: pa.Array, ends: np.ndarray, size: int | None, good: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of kept words up to ``size`` apart, or links of full windows if there is no size."""
    sentence = _sentences(ends, _numbers(flat.field("sent")).astype(np.int64))
    if size is None:
        return _windows(sentence, *_small_words(flat.field("raw"), flat.field("pos")))
    return _near(sentence, _numbers(flat.field("keep")) == 1 if good is None else good, size)


def linked_words(toks: pa.Array, size: int | None) -> tuple[pa.Array, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The flat words of texts, the ends of the texts, which words are kept, and their pairs as places, text by text."""
    flat, ends = toks.flatten(), _ends(toks)
    kept = _numbers(flat.field("keep")) == 1 if size is not None else _small_words(flat.field("raw"), flat.field("pos"))[0]
    i, j = _pairs(flat, ends, size)
    # the links of a window stand together, pairs of a distance do
    order = _by_row(ends, i)[0] if size is not None else np.argsort(i, kind="stable")
    return flat, ends, kept.astype(bool), (i[order], j[order])


def lists_of(ends: np.ndarray, columns: dict, like: pa.Array) -> pa.Array:
    return _lists(ends, _structs(**columns), like)


def place_pairs_udf(size: int | None = 3, tag: bool = False):
    """Tagged words, or sentences of words to ``tag``, to pairs of words (root0, root1, num0, num1)."""

    def pairs(toks: pa.Array) -> pa.Array:
        flat, ends = toks.flatten(), _ends(toks)
        i, j = _pairs(flat, ends, size)
        order, pair_ends = _by_row(ends, i)
        i, j = pa.array(i[order]), pa.array(j[order])
        root, num = flat.field("root"), flat.field("num")
        return _lists(pair_ends, _structs(root0=root.take(i), root1=root.take(j), num0=num.take(i), num1=num.take(j)), toks)

    return by_pieces("array<struct<root0:string,root1:string,num0:int,num1:int>>", pairs, tag)


EDGES = "array<struct<node0:long,node1:long>>"


def edge_udf(size: int | None = 3, distinct: bool = False):
    """Words with ids (``GRAF``) to the edges (node0, node1) of their pairs, both ways."""

    def edges(graf: pa.Array) -> pa.Array:
        flat, ends = graf.flatten(), _ends(graf)
        node = _numbers(flat.field("node_id")).astype(np.int64)
        return _edge_lists(graf, ends, node, _pairs(flat, ends, size, node > 0), distinct)

    return by_pieces(EDGES, edges)


def word_edges(words: Words, node: np.ndarray, size: int | None = 3, distinct: bool = False) -> pa.Array:
    """As ``edge_udf``, of words and their ids."""
    sentence = _sentences(words.ends, np.asarray(words.sent).astype(np.int64))
    if size is None:
        good, low = _small_words(words.raw, words.pos)
        pairs = _windows(sentence, words.spread(good), words.spread(low))
    else:
        pairs = _near(sentence, node > 0, size)
    return _edge_lists(words.like, words.ends, node, pairs, distinct)


def _edge_lists(like: pa.Array, ends: np.ndarray, node: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], distinct: bool) -> pa.Array:
    i, j = np.concatenate(pairs), np.concatenate(pairs[::-1])
    order, edge_ends = _by_row(ends, i)
    a, b = node[i[order]], node[j[order]]
    if distinct and len(a):
        row = np.repeat(np.arange(len(ends) - 1), np.diff(edge_ends))
        by = np.lexsort((b, a, row))
        row, a, b = row[by], a[by], b[by]
        new = (np.diff(row, prepend=-1) != 0) | (np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0)
        row, a, b = row[new], a[new], b[new]
        edge_ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(ends) - 1))))
    return _lists(edge_ends, _structs(node0=a, node1=b), like)


RECORDS = f"array<struct<sent:int,size:int,sha1:string,polr:double,subj:double,graf:{GRAF},tile:array<struct<n0:long,n1:long>>>>"


def sentence_records(words: Words, node: np.ndarray, scores: pa.Table, size: int = 3) -> pa.Array:
    """Words, their ids and a dictionary of scores (key, polr, subj) to one record a sentence (``RECORDS``)."""
    ends, entries = words.ends, scores.combine_chunks()
    sentence = _sentences(ends, np.asarray(words.sent).astype(np.int64))
    first = np.flatnonzero(np.diff(sentence, prepend=-1)) if len(sentence) else np.zeros(0, np.int64)
    sent_ends = np.concatenate((first, [len(sentence)]))
    at = words.spread(_looked_up(words.low, _column(entries, "key", pa.string())))
    scored = at >= 0
    count = np.bincount(sentence[scored], minlength=len(first))
    mean = {}
    for name in ("polr", "subj"):
        values = _numbers(entries.column(name)).astype(float)
        mean[name] = np.bincount(sentence[scored], values[at[scored]], minlength=len(first)) / np.maximum(count, 1)
    i, j = _near(sentence, np.asarray(words.spread(words.keep)) == 1, size)
    order, tile_ends = _by_row(sent_ends, i)
    rest = {name: words.spread(getattr(words, name)) for name in ("raw", "root", "pos", "keep")}
    joined = pc.binary_join(_lists(sent_ends, rest["root"].cast(pa.string())), "")
    sha = [hashlib.sha1(text.encode()).hexdigest() for text in _strings(joined)]
    made = _structs(
        sent=np.asarray(words.sent)[first], size=np.diff(sent_ends).astype(np.int32), sha1=pa.array(sha, pa.string()), **mean,
        graf=_lists(sent_ends, _structs(num=words.num, sent=words.sent, node_id=node, **rest)),
        tile=_lists(tile_ends, _structs(n0=node[i[order]], n1=node[j[order]])),
    )
    return _lists(np.searchsorted(first, ends), made, words.like)


def tagged_words(sents: Column) -> Column:
    """Array of sentences to tagged words, by the default tagger and lemmas."""
    return tag_udf()(F.transform(sents, tx.words))


def count_words(column: str, key: str, tag: bool):
    """Batches to (word, n): how often the words named by ``key`` occur in each batch."""
    coded = coder(tag)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, found = batch.column(column), []
            for lo, hi in _cuts(word_ends(words, tag)):
                values, n = coded(words.slice(lo, hi - lo)).counts(key)
                found.append(pa.table({"word": values, "n": n}))
            if found:
                total = pa.concat_tables(found).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                yield from total.to_batches(max_chunksize=PIECE)

    return counted


def count_in_rows(doc: str, column: str):
    """Batches of sentences of words to (doc, word, n): how often each word occurs in its row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _cuts(word_ends(batch.column(column), True)):
                part = batch.slice(lo, hi - lo)
                words = part.column(column)
                ends = word_ends(words, True)
                coded = words.flatten().flatten().dictionary_encode()
                width = max(1, len(coded.dictionary))
                row = np.repeat(np.arange(len(words)), np.diff(ends))
                both, n = np.unique(row * width + _numbers(coded.indices).astype(np.int64), return_counts=True)
                row, code = np.divmod(both, width)
                yield pa.record_batch(
                    [part.column(doc).take(pa.array(row)), coded.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(n, pa.int64())], [doc, "word", "n"]
                )

    return counted


def distinct_words(column: str, key: str, tag: bool):
    """Rows in the order of their block (``_rows``) to the distinct words of each block: (_rows, key)."""
    coded = coder(tag)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = None, set()

        def given() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for k in range(0, len(words), PIECE):
                part = pa.array(words[k : k + PIECE], pa.string())
                yield pa.record_batch([pa.array(np.full(len(part), block, np.int64)), part], ["_rows", "key"])

        for batch in batches:
            for lo, hi, number, _ in _segments(batch):
                if number != block:
                    yield from given()
                    block, seen = number, set()
                words = batch.column(column).slice(lo, hi - lo)
                for a, b in _cuts(word_ends(words, tag)):
                    seen.update(coded(words.slice(a, b - a)).counts(key)[0].unique().to_numpy(zero_copy_only=False))
        yield from given()

    return found


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """Runs of rows of one block and kind: (from, to, block, kind)."""
    block, kind = (_numbers(batch.column(name)).astype(np.int64) for name in ("_rows", "_kind"))
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(block) != 0) | (np.diff(kind) != 0)))) if len(block) else []
    for lo, hi in zip(starts, [*starts[1:], len(block)]):
        yield int(lo), int(hi), int(block[lo]), int(kind[lo])


#: what the words of a block find in the tables, as lists of entries in its first row
DICTIONARIES = {"_ids": {"key": "string", "node_id": "long", "root": "string"}, "_scores": {"key": "string", "polr": "double", "subj": "double"}}


def with_dictionaries(doc: str, column: str, tag: bool, made: str, step: Callable[[Words, pa.Table, pa.Table], pa.Array], held: dict | None = None):
    """Each block's ``DICTIONARIES`` (a row of ``_kind`` 0), then its texts (1), to (doc, made).

    ``step`` makes the column ``made`` of words and the two dictionaries.  Only the dictionaries of one
    block and one piece of its texts are held, and what is in ``held``: broadcast dictionaries that serve all blocks.
    """
    coded = coder(tag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for batch in batches:
            for lo, hi, _, kind in _segments(batch):
                if kind == 0:
                    lists = [batch.column(name).slice(lo, 1).flatten() for name in DICTIONARIES]
                    tables = [pa.table(dict(zip(c, entries.flatten()))) for c, entries in zip(DICTIONARIES.values(), lists)]
                    tables = [held[name].value if held and name in held else table for name, table in zip(DICTIONARIES, tables)]
                    continue
                words, docs = batch.column(column).slice(lo, hi - lo), batch.column(doc).slice(lo, hi - lo)
                for a, b in _cuts(word_ends(words, tag)):
                    yield pa.record_batch([docs.slice(a, b - a), step(coded(words.slice(a, b - a)), *tables)], [doc, made])

    return run
