"""Toxicity: a lexicon trie, Levenshtein automata for misspelt terms, context windows.

The lexicon is learned: words, and stems of word families, that mark toxic texts of the
labelled sample. A word that is no term is compiled into a Levenshtein automaton, whose
states are sets of its prefixes by number of edits, held as bits; it runs along the trie and
leaves every branch where no state is left. The words around each hit tell quotation and
report from abuse: their weights are log odds of standing near a term in toxic and in clean
texts of the sample. Counts so weighted go into a logistic regression fitted on the same
sample.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD, logistic_fit, sigmoid

#: Quotation marks, and letters that signs stand for.
QUOTES = "\"“”„«»‘’`"
_MARKS = frozenset(QUOTES)
LEET = str.maketrans("013457@$!|", "oieastasil")
#: Words to either side of a term that weigh its hit.
WINDOW = 4
#: A context word stands in so many windows at least, and as many give it its prior; the pull of one
#: word and of a whole window on a hit's weight is at most so strong (natural logarithms).
CONTEXT_LEAST, WORD_PULL, WINDOW_PULL = 30, 1.0, 1.5
#: Features end here: distinct terms, weighted hits, distinct misspelt terms, and hits per 50
#: words. More of them do not make a text more toxic, and the regression stays calibrated.
MOST = (3.0, 4.0, 3.0, 1.0)
#: A context's sign that its term stands in quotation marks.
QUOTED = "«»"
CACHED = 300_000


@dataclass(frozen=True)
class ToxicModel:
    terms: tuple[str, ...]
    stems: tuple[str, ...]
    #: Terms and words of stem families that may be misspelt: few clean texts of the sample hold a word near them.
    fuzzy: tuple[str, ...]
    #: (word, log odds) of words that stand near terms.
    context: tuple[tuple[str, float], ...] = ()
    weights: tuple[float, ...] = field(default=())


def bare(token: str) -> str:
    return token.casefold().strip(".,;:!?()[]{}<>#*%&$|_-+=/\\'…¡¿" + QUOTES)


class Trie:
    """Terms by letters; '' marks an end and '*' the end of a stem."""

    def __init__(self, terms: tuple[str, ...], stems: tuple[str, ...] = ()):
        self.root: dict = {}
        for words, mark in ((terms, ""), (stems, "*")):
            for w in words:
                node = self.root
                for c in w:
                    node = node.setdefault(c, {})
                node[mark] = w

    def exact(self, word: str) -> str | None:
        node = self.root
        for c in word:
            if "*" in node:
                return node["*"]
            node = node.get(c)
            if node is None:
                return None
        return node.get("") or node.get("*")

    def within(self, word: str, most: int) -> str | None:
        """A term at most ``most`` edits away (transpositions count one), or None."""
        return next(self.all_within(word, most), None)

    def all_within(self, word: str, most: int) -> Iterator[str]:
        automaton = LevenshteinAutomaton(word, most)
        stack = [(self.root, automaton.start)]
        while stack:
            node, state = stack.pop()
            if "" in node and automaton.accepts(state):
                yield node[""]
            for c, child in node.items():
                if c not in ("", "*") and (after := automaton.step(state, c)):
                    stack.append((child, after))


class LevenshteinAutomaton:
    """Accepts what is at most ``most`` edits from the word: one letter more, less or another,
    or two neighbours swapped.

    A state has, per number of edits, the set of prefixes of the word that can be read by
    then, bit i for i letters, and the set of those in the middle of a swap.
    """

    def __init__(self, word: str, most: int):
        self.most, self.end = most, 1 << len(word)
        self.all = 2 * self.end - 1
        self.after: dict[str, int] = {}
        for i, c in enumerate(word):
            self.after[c] = self.after.get(c, 0) | 2 << i
        # letters of the word may be missing before any is read
        self.start = tuple((sum(1 << i for i in range(e + 1)) & self.all, 0) for e in range(most + 1))

    def step(self, state: tuple, letter: str) -> tuple | None:
        """The state after one letter, or None where nothing more can be accepted."""
        hit = self.after.get(letter, 0)
        out, read_less, was = [], 0, 0
        for e, (read, swap) in enumerate(state):
            new = read << 1 & hit
            if e:
                # another letter, one letter too many, one letter missing, the end of a swap
                new |= was << 1 | was | read_less << 1 | state[e - 1][1] & hit << 1
            new &= self.all
            out.append((new, read << 2 & hit & self.all))
            read_less, was = new, read
        return tuple(out) if any(r or (w and e < self.most) for e, (r, w) in enumerate(out)) else None

    def accepts(self, state: tuple) -> bool:
        return any(read & self.end for read, _ in state)


def without_one(word: str) -> list[str]:
    """The word and what is left of it without one of its letters."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Matcher(dict):
    """raw token -> (strength, term), or 0 for most tokens. 1: exact, 2: misspelt."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.trie = Trie(model.terms, model.stems)
        self.near = Trie(model.fuzzy)
        self.context = dict(model.context)
        # a word one edit away, or the word without one letter, is a term or a term without one letter
        self.shorter = {v for t in model.fuzzy for v in without_one(t)}

    def look(self, token: str):
        word = bare(token)
        if len(word) < 3:
            return 0
        term = self.trie.exact(word)
        if term:
            return (1, term)
        plain = word.translate(LEET)
        if plain != word:
            term = self.trie.exact(plain)
            if term:
                return (2, term)
        if not self.shorter.isdisjoint(without_one(plain)):
            term = self.near.within(plain, 1)
            if term:
                return (2, term)
        return 0

    def __missing__(self, token: str):
        if len(self) > CACHED:
            self.clear()
        got = self[token] = self.look(token)
        return got


def window(words: list[str], i: int) -> set[str]:
    """The words around place i, and QUOTED where its own word stands in quotation marks."""
    around = {w for w in map(bare, words[max(0, i - WINDOW) : i] + words[i + 1 : i + WINDOW + 1]) if w}
    return around | {QUOTED} if quoted(words[i], words[i - 1] if i else "") else around


def quoted(token: str, before: str) -> bool:
    """Whether a quotation mark stands at the token, or alone before it."""
    return token[0] in _MARKS or token.rstrip(".,;:!?")[-1:] in _MARKS or before in _MARKS


def unquoted(text: str) -> list[str]:
    words = WORD.findall(text)
    return [w for before, w in zip(["", *words], words, strict=False) if not quoted(w, before)]


def features(text: str | None, match: Matcher) -> list[float]:
    """Distinct exact terms, hits weighted by their windows, distinct misspelt terms, hits per word."""
    words = WORD.findall(text or "")
    hits = [(i, h) for i, h in enumerate(map(match.__getitem__, words)) if h]
    if not hits:
        return [0.0] * 4
    exact, near, mass = set(), set(), 0.0
    for i, (kind, term) in hits:
        (exact if kind == 1 else near).add(term)
        pull = sum(match.context.get(w, 0.0) for w in window(words, i)) if match.context else 0.0
        mass += math.exp(max(-WINDOW_PULL, min(WINDOW_PULL, pull)))
    return [min(most, v) for most, v in zip(MOST, (len(exact), mass, len(near), 50.0 * len(hits) / len(words)), strict=True)]


def distinct_texts(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without near copies: a text that shares one of four least shingle hashes
    with an earlier one of its label goes, so that copied texts do not make terms."""
    seen: set = set()
    out = []
    mixers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    for text, y in sample:
        w = WORD.findall(text.lower())
        grams = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        h = np.fromiter((zlib.crc32(g.encode()) for g in grams), np.uint64, len(grams))
        least = ((h[:, None] + np.uint64(1)) * mixers).min(axis=0)
        marks = {(y, s, int(v)) for s, v in enumerate(least)}
        if marks & seen:
            continue
        seen |= marks
        out.append((text, y))
    return out


def learn_lexicon(sample: list[tuple[str, int]], least: int = 5, odds: float = 40.0) -> ToxicModel:
    """Terms are words in at least ``least`` toxic texts whose rate is ``odds`` times that in
    clean ones, what clean texts quote not counted; stems are beginnings of at least three
    words that do so together. Ties of stems go to the shorter, then to the lesser one."""
    texts = distinct_texts(sample)
    n = Counter(y for _, y in texts)
    df = {0: Counter(), 1: Counter()}
    sf = {0: Counter(), 1: Counter()}
    kinds: dict[str, set] = {}
    for text, y in texts:
        words = {w for w in map(bare, WORD.findall(text) if y else unquoted(text)) if len(w) >= 3}
        df[y].update(words)
        heads = {w[:k] for w in words for k in (4, 5, 6) if len(w) > k}
        sf[y].update(heads)
        if y:
            for w in words:
                for k in (4, 5, 6):
                    if len(w) > k:
                        kinds.setdefault(w[:k], set()).add(w)
    def marks(a: int, b: int) -> bool:
        return a >= least and (a / max(1, n[1])) >= odds * ((b + 0.25) / max(1, n[0]))

    stems: list[str] = []
    for s in sorted(sf[1], key=lambda s: (len(s), s)):
        if marks(sf[1][s] - least, sf[0][s]) and len(kinds[s]) >= 3 and not any(s.startswith(t) for t in stems):
            # a family, not one word with a few endings
            top = max(df[1][w] for w in kinds[s])
            if top < 0.7 * sf[1][s]:
                stems.append(s)
    terms = sorted(w for w in df[1] if marks(df[1][w], df[0][w]) and not any(w.startswith(s) for s in stems))
    families = {w for s in stems for w in kinds[s]}
    draft = ToxicModel(tuple(terms), tuple(stems), tuple(sorted(w for w in {*terms, *families} if len(w) >= 4)))
    match = Matcher(draft)
    noisy = Counter()
    blame: dict[str, set[str]] = {}
    for text, y in texts:
        if y == 0:
            tokens = set(unquoted(text))
            for w in tokens - blame.keys():
                h = match[w]
                # every term near the word, or another would take the place of the one left out
                blame[w] = {h[1], *match.near.all_within(bare(w).translate(LEET), 1)} if h and h[0] == 2 else set()
            noisy.update({t for w in tokens for t in blame[w]})
    fuzzy = tuple(t for t in draft.fuzzy if noisy[t] <= n[0] / 1000)
    return ToxicModel(draft.terms, draft.stems, fuzzy)


def learn_context(sample: list[tuple[str, int]], match: Matcher) -> tuple[tuple[str, float], ...]:
    """Log odds of the words around terms, in windows of toxic against windows of clean texts.

    Smoothed, so that a word seen alike in both, or seldom, weighs nothing.
    """
    seen = {0: Counter(), 1: Counter()}
    n = Counter()
    for text, y in distinct_texts(sample):
        words = WORD.findall(text)
        for i, h in enumerate(map(match.__getitem__, words)):
            if h:
                n[y] += 1
                seen[y].update(window(words, i))
    out = []
    for w in sorted(seen[0].keys() | seen[1].keys()):
        a, b = seen[1][w], seen[0][w]
        if a + b >= CONTEXT_LEAST and n[0] >= CONTEXT_LEAST and n[1] >= CONTEXT_LEAST:
            # both rates lean on the word's rate in all windows
            rate = (a + b) / (n[0] + n[1])
            odds = math.log((a + CONTEXT_LEAST * rate) / (n[1] + CONTEXT_LEAST)) - math.log((b + CONTEXT_LEAST * rate) / (n[0] + CONTEXT_LEAST))
            out.append((w, max(-WORD_PULL, min(WORD_PULL, odds))))
    return tuple(out)


def fit(sample: list[tuple[str, int]]) -> ToxicModel:
    """Lexicon, context weights and regression, all from the sample of (text, 0 or 1).

    Repeated and near-equal texts count once for the lexicon and the context. Without both
    labels there are no terms, and every text scores the smoothed base rate.
    """
    model = learn_lexicon(sample)
    model = replace(model, context=learn_context(sample, Matcher(model)))
    match = Matcher(model)
    x = np.array([features(t, match) for t, _ in sample]).reshape(len(sample), 4)
    y = np.array([v for _, v in sample], float)
    # a misspelt term is taken to weigh as a half exact one: rows that say so join the fit
    if len(y) and y.min() != y.max() and model.terms:
        rows = max(1, len(y) // 200)
        x = np.vstack([x, np.tile([0.0, 1.0, 1.0, 0.2], (rows, 1))])
        y = np.concatenate([y, np.ones(rows)])
    return replace(model, weights=tuple(map(float, logistic_fit(x, y, ridge=0.05))))


def score_text(text: str | None, model: ToxicModel, match: Matcher) -> float:
    f = features(text, match)
    return sigmoid(sum(a * b for a, b in zip(f, model.weights, strict=False)) + model.weights[-1])


def score(df: DataFrame, model: ToxicModel, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``: the probability that the text is toxic. Null and empty texts have no hits
    and get the base score; equal texts get equal scores. A column named ``out`` is replaced,
    others stay; an empty table gives an empty one. Narrow, whole texts; the model is bounded
    by its sample."""
    keep = df.drop(out)
    schema = T.StructType([*keep.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(model)
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            made = [score_text(v.as_py(), model, match) for v in col]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.float64())], names=[f.name for f in schema.fields])

    return keep.mapInArrow(run, schema)
