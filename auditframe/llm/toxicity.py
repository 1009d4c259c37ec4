"""Toxic documents: Levenshtein automata intersected with a lexicon trie, then context.

Every word of every text is lower-cased, cleared of letter-like digits and signs and
run against the lexicon: the word's Levenshtein automaton (one bit set of positions
for each number of errors) walks the trie of terms, and a branch ends as soon as no
state is left.  A term of five to seven letters may have one error, a longer one
two, a shorter one none.  An exact filter goes first: a word with e errors lacks at most e letters
of the term and 2 e pairs of neighbouring ones, and has no more others.  Words are hashed by the batch, a task looks each different one up once, and only texts with a hit are judged.

A hit counts 1, an everyday word (``EVERYDAY``: trash, clown ...) ``WEAK``, a misspelled
term 0.05 for each letter, less 0.1 for a second error.  Within its line: 0.6 is taken
off inside quotation marks, 0.3 for each reporting word (said, called, word ...) within
six words, up to two.  Outside quotation marks, an aimed hit (a second person within three
words; ``what a``, ``such an`` before it; ``he is a`` and the like) counts 0.4 more and
``TOXIC_AT`` at least.  A hit that keeps half of its count or more is abuse, another one
a quotation.  Ordinary
words that lie within an error of a term by chance are no hits: ``COMMON`` names English
ones, and :func:`ordinary_words` finds those of a corpus by their frequency in all its
documents.  A document's score is the sum over its abusive exact hits (everyday words if
aimed) and that of the passage whose other hits sum to most, less 0.1 for every two hundred
blanks between the first and the last of the passage, as chance hits lie far apart; a
line that stood before in the text adds no blanks.
Passages are the hits within ``PASSAGE`` blanks of each other and within twice, four
times ... as many (:func:`densest`), so clean text around one takes nothing off.  A
document is toxic from ``TOXIC_AT`` on.

The lexicon is given by language.  From at most ``TRAIN_BOUND`` labelled documents
:func:`learn` takes the everyday words that are toxic there (they then count 1), and stems
of other languages: beginnings of words that are far more common in toxic documents which
the given terms don't explain.  A word that begins with a learnt stem counts 0.4.

Repeated misspellings of one term, and repeats of one word with a stem, add up with a
weight that falls without an end: the n-th counts 1/n.  One with a stem in a line that
stood before in the text counts as a third of a repeat (``COPY``), as texts of repeated
lines are common.  An everyday word that isn't aimed counts once in a passage.

Defined results: null and empty texts have no hits.  Repeated rows are scored alike,
each on its own.  Texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_WORD, LOWER, as_table, materialize, release, runs_of, utf8
from .labelled import sample_labelled

TERMS = {
    "en": "arsehole asshole bastard bitch clown cretin cunt degenerate dickhead dimwit dipshit disgusting douchebag dumbass fucker fuckface fucking fuckwit halfwit idiot imbecile jackass loser moron motherfucker nitwit "
    "numbskull pathetic retard scum scumbag shithead slut stupid trash twat vermin wanker whore worthless",
    "de": "abschaum arschloch blödmann drecksack drecksau dummkopf fotze hurensohn idiot miststück missgeburt schlampe schwachkopf trottel versager vollidiot wichser",
    "fr": "abruti bâtard connard connasse crétin débile enculé enfoiré imbécile ordure pétasse salaud salope",
    "es": "basura cabrón estúpido gilipollas hijoputa idiota imbécil malparido payaso pendejo subnormal",
    "it": "bastardo coglione cretino deficiente idiota puttana stronzo",
    "pt": "babaca cuzão desgraçado estúpido idiota imbecil otário",
    "nl": "klootzak kutwijf sukkel",
}
LEXICON = tuple(sorted({t for terms in TERMS.values() for t in terms.split()}))
EVERYDAY = frozenset("abschaum basura clown deficiente degenerate disgusting jackass ordure pathetic payaso subnormal sukkel trash versager vermin".split())
TOXIC_AT, WEAK, MISSPELT, STEM = 0.7, 0.3, 0.05, 0.4
TRAIN_BOUND, STEM_SIZES, STEM_LIFT = 8000, range(4, 9), 8.0
CHANCE, PASSAGE, COPY, BY_STEM = 5e-4, 256, 1 / 3, -1
ORDINARY_DOCS, ORDINARY_SHARE = 3, 20
COMMON = frozenset(
    "batch botch butch birch ditch pitch hitch witch itch crown blown flown cretan generate regenerate regenerates regenerated degeneracy discussing disputing disrupting digesting disguising "
    "ducking tucking sucking bucking mucking idiom closer lower looser lose loses loner lover laser poser moon boron morn mormon apathetic athletic esthetic empathetic regard reward petard "
    "crash thrash brash rash where whole whose shore chore wore who're who’re wordless mirthless mouthless toothless termin verein "
    "ducker sucker tucker bucker pucker fumbling jackals custard mustard dastard bastion abrupt debit debris sallow salade salud sabre salope's salve stupide ordre ordures bordure verdure order pintado bandejo caso basta basuras cretins rabat".split()
)
_REPORTS = frozenset("said says say called calls call word words term terms wrote writes quote quoted quotes insult insults meaning means phrase slur mentioned".split())
_SECOND = frozenset("you your you're you’re youre yours ur u yourself".split())
_THIRD, _IS, _ARTICLES = frozenset("he she they".split()), frozenset("is are was were".split()), frozenset("a an the such so total complete utter absolute bloody damn real".split())
_HE_IS = frozenset("he's she's they're he’s she’s they’re".split())
_SUMS = [0.0]
_TOKEN = re.compile(r"[^\W_](?:[\w@$*'’]*[^\W_])?")
_INSIDE = IS_WORD | np.isin(np.arange(256), np.frombuffer(b"_@$*'", np.uint8))  # all bytes of a token
_LOOKALIKE = str.maketrans("013457@$", "oieastas")
_LOOKS = re.compile(r"[0-9@$*]")
_QUOTES = re.compile('["“”„«»]')


class Learnt(NamedTuple):
    """What labelled documents add to the lexicon."""

    stems: tuple[str, ...] = ()
    sure: frozenset[str] = frozenset()


def tolerance(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def build_trie(terms: tuple[str, ...]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term
    return root


def intersect(word: str, trie: dict, most: int = 2) -> tuple[str, int] | None:
    """The lexicon term the word's automaton accepts with the fewest errors (then the first by name), or None."""
    end = 1 << len(word)
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    states = [1]
    for _ in range(most):
        states.append(states[-1] | states[-1] << 1)
    stack, best = [(trie, tuple(states))], None
    full = (end << 1) - 1
    while stack:
        node, r = stack.pop()
        term = node.get("")
        if term is not None:
            errors = next((e for e in range(tolerance(term) + 1) if r[e] & end), None)
            if errors is not None and (best is None or (errors, term) < (best[1], best[0])):
                best = (term, errors)
        for c, child in node.items():
            if not c:
                continue
            m = masks.get(c, 0)
            new = [(r[0] & m) << 1]
            for e in range(1, most + 1):
                new.append(((r[e] & m) << 1 | r[e - 1] | r[e - 1] << 1 | new[e - 1] << 1) & full)
            if any(new):
                stack.append((child, tuple(new)))
    return best


def letters(code: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set of letters, set of pairs of neighbouring letters) of each word, as bits of a number; some share a bit."""
    if not len(code):
        return np.zeros(len(lens), np.uint64), np.zeros(len(lens), np.uint64)
    code, start = code.astype(np.uint32), np.cumsum(lens) - lens
    pair = np.uint64(1) << ((code * np.uint32(0x9E3779B1) + np.append(code[1:], code[:1]) * np.uint32(0x85EBCA6B)) >> np.uint32(26)).astype(np.uint64)
    pair[start + lens - 1] = 0
    return np.bitwise_or.reduceat(np.uint64(1) << (code & np.uint32(63)).astype(np.uint64), start), np.bitwise_or.reduceat(pair, start)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, length of each)."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(w) for w in words], np.int64)


def latin(buf: np.ndarray, start: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points in lower case, number of them in each run, whether the run holds letters of ASCII and Latin-1 only)."""
    first = np.cumsum(lens) - lens
    b = LOWER[buf[np.arange(int(lens.sum())) + np.repeat(start - first, lens)]]
    lead = b == 0xC3
    after = np.append(False, lead[:-1])
    code = b.astype(np.int64) + 0x40 * after
    code += 0x20 * (after & (code >= 0xC0) & (code <= 0xDE) & (code != 0xD7))
    letter = lead | (after & (code != 0xD7) & (code != 0xF7)) | (~after & (b >= 97) & (b <= 122))
    return code[~lead], lens - np.add.reduceat(lead, first), np.logical_and.reduceat(letter, first)


def heads(code: np.ndarray, lens: np.ndarray, n: int) -> np.ndarray:
    """The first n code points under 256 of each word as one number, 0 if it is shorter."""
    start, out = np.cumsum(lens) - lens, np.zeros(len(lens), np.uint64)
    long = np.flatnonzero(lens >= n)
    for i in range(n):
        out[long] |= code[start[long] + i].astype(np.uint64) << np.uint64(8 * i)
    return out


def plain(token: str) -> str:
    """The token with letter-like digits and signs read as letters, if it has letters too."""
    if _LOOKS.search(token) and any(c.isalpha() for c in token):
        return token.translate(_LOOKALIKE)
    return token


class Matcher:
    """Looks words up in the lexicon and remembers the answers for a bounded number of words."""

    def __init__(self, terms: tuple[str, ...] = LEXICON, stems: tuple[str, ...] = (), ordinary: frozenset[str] = COMMON, sure: frozenset[str] = frozenset(), remember: int = 300_000):
        self.stems, self.ordinary, self.weak = frozenset(stems), ordinary, EVERYDAY - sure
        self.sizes = sorted({len(s) for s in stems})
        self.remember = remember
        self.terms = [(t, tolerance(t), *of) for t, *of in zip(terms, codes(list(terms))[1], *letters(*codes(list(terms))))]
        self.tries: dict[tuple[str, ...], dict] = {}
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}
        self.known = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # hashes of runs without hits, and with some

    def term(self, token: str, likely: tuple[str, ...] | None = None) -> tuple[str, int] | None:
        """The term of a token (of those likely, if they are known) or its stem, with the number of errors."""
        word = plain(token)
        terms = tuple(t for t, *_ in self.terms) if likely is None else likely
        trie = self.tries.get(terms)
        if trie is None:
            trie = self.tries[terms] = build_trie(terms)
        got = intersect(word, trie, max(map(tolerance, terms), default=0))
        return self._stem(word) if got is None else got

    def _stem(self, word: str) -> tuple[str, int] | None:
        stem = next((word[:n] for n in self.sizes if word[:n] in self.stems and len(word) >= n), None)
        return (stem, BY_STEM) if stem else None

    def _likely(self, code: np.ndarray, lens: np.ndarray) -> dict[int, tuple[str, ...]]:
        """For the words that can be within a term's errors, these terms: each error changes a letter and two pairs of neighbours at most."""
        ones, pairs = letters(code, lens)
        out: dict[int, tuple[str, ...]] = {}
        for term, errors, n, one, pair in self.terms:
            at = np.flatnonzero(np.abs(lens - n) <= errors)
            at = at[(np.bitwise_count(pair & ~pairs[at]) <= 2 * errors) & (np.bitwise_count(pairs[at] & ~pair) <= 2 * errors)]
            for i in at[(np.bitwise_count(ones[at] & ~one) <= errors) & (np.bitwise_count(one & ~ones[at]) <= errors)].tolist():
                out[i] = (*out.get(i, ()), term)
        return out

    def _with_stem(self, code: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Which words of code points under 256 begin with a stem."""
        out = np.zeros(len(lens), bool)
        for n in self.sizes:
            known = [s for s in self.stems if len(s) == n and max(map(ord, s)) < 256]
            out |= np.isin(heads(code, lens, n), heads(*codes(known), n))
        return out

    def _look_up(self, tokens: set[str]) -> None:
        new = [t for t in tokens - self.clean if t not in self.hits]
        if not new:
            return
        likely = self._likely(*codes([plain(t) for t in new]))
        for i, token in enumerate(new):
            got = self.term(token, likely[i]) if i in likely else self._stem(plain(token)) if self.stems else None
            if got is not None and got[1] > 0 and plain(token) in self.ordinary:
                got = self._stem(plain(token))
            if got is None:
                self.clean.add(token)
            else:
                self.hits[token] = got

    def find(self, text: str, looked_up: bool = False) -> list[tuple[int, int, str, int]]:
        """(from, to, term, errors) of each hit in a lower-cased text; ``looked_up``: :meth:`rows` has just seen it."""
        if not looked_up:
            self._look_up(set(_TOKEN.findall(text)))
        return [(m.start(), m.end(), *self.hits[m[0]]) for m in _TOKEN.finditer(text) if m[0] in self.hits]

    def rows(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The texts of a batch in which :meth:`find` finds something.

        A token lies within a run of the bytes that tokens are made of, so each
        different run is looked up once; a run of plain letters is a token, and only one
        that can be near a term or has a stem becomes a string at all.
        """
        marked = np.zeros(len(off) - 1, bool)
        if max(len(self.clean), len(self.known[0])) > self.remember:
            self.clean.clear()
            self.hits.clear()
            self.tries.clear()
            self.known = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        for h, start, lens in runs_of(buf, off, inside=_INSIDE):
            h, first, of = np.unique(h, return_index=True, return_inverse=True)
            hit = np.zeros(len(h), bool)
            seen = np.zeros(len(h), bool)
            for is_hit, known in zip((False, True), self.known):
                if len(known):
                    there = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                    seen |= there
                    hit |= there & is_hit
            new = np.flatnonzero(~seen)
            if len(new):
                at, size = start[first[new]], lens[first[new]]
                code, n, simple = latin(buf, at, size)
                ask = ~simple | self._with_stem(code, n)
                ask[list(self._likely(code, n))] = True
                some = np.flatnonzero(ask)
                found = [set(_TOKEN.findall(bytes(buf[a : a + k]).decode("utf-8", "replace").lower())) for a, k in zip(at[some].tolist(), size[some].tolist())]
                self._look_up(set().union(*found))
                hit[new[some]] = [not self.hits.keys().isdisjoint(tokens) for tokens in found]
                self.known = [np.union1d(k, h[new[hit[new] == v]]) for k, v in zip(self.known, (False, True))]
            if hit.any():
                marked[np.searchsorted(off, start[hit[of]], "right") - 1] = True
        return np.flatnonzero(marked)


def base(term: str, errors: int, weak: frozenset[str] = EVERYDAY) -> float:
    if errors == BY_STEM:
        return STEM
    if errors:
        return MISSPELT * len(term) - 0.1 * (errors - 1)
    return WEAK if term in weak else 1.0


def aimed(before: list[str], after: list[str]) -> bool:
    """Whether the words around a hit aim it at somebody."""
    if any(w in _SECOND for w in before[-3:] + after[:3]):
        return True
    lead = list(before)
    while lead and lead[-1] in _ARTICLES:
        lead.pop()
    if len(lead) < len(before) and (lead[-1:] == ["what"] or before[len(lead)] == "such"):
        return True
    return bool(lead) and (lead[-1] in _HE_IS or len(lead) > 1 and lead[-1] in _IS and lead[-2] in _THIRD)


def words_before(text: str, low: int, at: int, n: int) -> list[str]:
    """The n last tokens of text[low:at]; looks back no further than needed."""
    width = 16 * n
    while True:
        a = max(low, at - width)
        found = _TOKEN.findall(text, a, at)
        if a == low:
            return found[-n:]
        if len(found) > n:  # the first may be cut
            return found[1:][-n:]
        width *= 2


def words_after(text: str, at: int, high: int, n: int) -> list[str]:
    out: list[str] = []
    for m in _TOKEN.finditer(text, at, high):
        out.append(m[0])
        if len(out) == n:
            break
    return out


class Line(NamedTuple):
    """The line low to high of a text, and where its quotation marks are."""

    text: str
    low: int
    high: int
    quotes: list[int]

    @classmethod
    def around(cls, text: str, at: int) -> Line:
        low, high = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        high = len(text) if high < 0 else high
        return cls(text, low, high, [m.start() for m in _QUOTES.finditer(text, low, high)])

    def score(self, a: int, b: int, count: float) -> tuple[float, bool]:
        """(what is left of the count of the hit text[a:b], whether it is aimed)."""
        n = bisect_left(self.quotes, a)
        quoted = n % 2 == 1 and n < len(self.quotes)
        before, after = words_before(self.text, self.low, a, 6), words_after(self.text, b, self.high, 6)
        left = count - 0.6 * quoted - 0.3 * min(2, sum(w in _REPORTS for w in before + after))
        at_one = not quoted and aimed(before, after)
        return left + (max(0.4, TOXIC_AT - count) if at_one else 0.0), at_one


def judge(text: str, matcher: Matcher, looked_up: bool = False) -> tuple[float, int, int, list[str]]:
    """(score, abusive hits, quotations, terms of the abusive hits)."""
    text = text.lower()
    score, inexact, abuse, quotes, terms = 0.0, [], 0, 0, set()
    blanks, counted, seen = 0, 0, set()
    at_line = -1
    line: Line | None = None
    for a, b, term, errors in matcher.find(text, looked_up):
        if line is None or a >= line.high:
            line = Line.around(text, a)
        count = base(term, errors, matcher.weak)
        one, at_one = line.score(a, b, count)
        if one < count / 2 - 1e-9:
            quotes += 1
            continue
        abuse += 1
        terms.add(term)
        everyday = not errors and term in matcher.weak
        if not errors and (at_one or not everyday):
            score += one
            continue
        while counted < line.low:  # the lines before that one
            end = text.find("\n", counted) + 1
            if (passed := text[counted:end]) not in seen:
                seen.add(passed)
                blanks += passed.count(" ") + 1
            counted = end
        if at_line != line.low:
            at_line, at, copied = line.low, a, text[line.low : line.high] + "\n" in seen
            within = text.count(" ", line.low, a)
        else:
            within, at = within + text.count(" ", at, a), a
        part = 0.0 if everyday else COPY if copied and errors == BY_STEM else 1.0
        inexact.append((blanks + (0 if copied else within), text[a:b] if errors == BY_STEM else (term, everyday), one, part))
    return round(score + densest(inexact), 6), abuse, quotes, sorted(terms)


def densest(hits: list[tuple[int, str, float, float]]) -> float:
    """The largest score of a passage of (blanks before, key, count, share of a repeat) in order."""
    best, width = 0.0, PASSAGE
    while hits:
        total, lo, held = 0.0, 0, {}
        for at, key, one, part in hits:
            total += _change(held, key, 1, one, part)
            while at - hits[lo][0] > width:
                total += _change(held, hits[lo][1], -1, -hits[lo][2], -hits[lo][3])
                lo += 1
            best = max(best, total - CHANCE * (at - hits[lo][0]))
        if hits[-1][0] - hits[0][0] <= width:
            break
        width *= 2
    return best


def _change(held: dict[str, tuple[int, float, float]], key: str, n: int, ones: float, parts: float) -> float:
    """What the passage's sum gains by these hits of the key: a key counts its hits' mean by the harmonic number of their parts."""
    before = held.get(key, (0, 0.0, 0.0))
    now = held[key] = (before[0] + n, before[1] + ones, before[2] + parts)
    return sum(sign * k[1] / k[0] * _harmonic(max(1.0, k[2])) for sign, k in ((1, now), (-1, before)) if k[0])


def _harmonic(x: float) -> float:
    """1 + 1/2 + ... + 1/x, with a share of the last step for what is over a whole number."""
    whole = int(x + 1e-9)
    while len(_SUMS) <= whole:
        _SUMS.append(_SUMS[-1] + 1 / len(_SUMS))
    return _SUMS[whole] + max(0.0, x - whole) / (whole + 1)


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, word, term, exact, abusive) of each word of a text within a term's tolerance.

    ``abusive``: an exact term stands in the text, or the word in direct address.
    """
    matcher = Matcher(ordinary=frozenset())
    for batch in as_table(batches):
        buf, off, _ = utf8(batch.column(1))
        at = pa.array(matcher.rows(buf, off))
        rows = []
        for mark, text in zip(batch.column(0).take(at).to_pylist(), batch.column(1).take(at).to_pylist()):
            text = text.lower()
            hits = matcher.find(text, True)
            company, found = any(not errors for *_, errors in hits), {}
            for a, b, term, errors in hits:
                word = plain(text[a:b])
                beside = company or any(w in _SECOND for w in words_before(text, 0, a, 3) + words_after(text, b, len(text), 3))
                found[word] = (term, not errors, beside or found.get(word, (0, 0, False))[2])
            rows += [(mark, word, *what) for word, what in found.items()]
        if rows:
            columns = zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], ["mark", "word", "term", "exact", "abusive"])


def ordinary_words(docs: DataFrame) -> frozenset[str]:
    """``COMMON`` and the words of docs that lie near a term by chance.

    Such a word is in ``ORDINARY_DOCS`` different texts or more and in more than one for
    ``ORDINARY_SHARE`` that hold the term itself, as a slip of the pen is rare beside
    the word meant; and fewer than half of its texts hold an exact term or the word in
    direct address.
    """
    base = docs.where("text is not null").select(F.xxhash64("text").alias("mark"), "text")
    near = base.mapInArrow(_near_words, "mark long, word string, term string, exact boolean, abusive boolean").distinct()
    words_ = near.groupBy("word", "term", "exact").agg(F.count(F.lit(1)).alias("n"), F.count_if("abusive").alias("abusive")).where(F.col("exact") | (F.col("n") >= ORDINARY_DOCS))
    counted = materialize(words_, "near")
    try:
        terms = counted.where("exact").groupBy("term").agg(F.sum("n").alias("of_term"))  # one row a term
        found = counted.where("not exact and 2 * abusive < n").join(F.broadcast(terms), "term", "left")
        return COMMON.union(found.where(F.col("n") * ORDINARY_SHARE > F.coalesce("of_term", F.lit(0))).select("word").toArrow().column("word").to_pylist())
    finally:
        release(counted)


def _stem_sets(batches: Iterator[pa.RecordBatch], ordinary: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """(y, everyday words, stems) of each document: the beginnings of its words, null for explained toxic documents."""
    matcher = Matcher(ordinary=ordinary)
    for batch in as_table(batches, rows=256):
        ys, plain_words, sets = [], [], []
        for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = text.lower()
            found = {plain(w) for w in set(_TOKEN.findall(text))}
            ys.append(y)
            plain_words.append(sorted(found & EVERYDAY))
            explained = y and judge(text, matcher)[0] >= TOXIC_AT
            sets.append(None if explained else sorted({w[:n] for w in found for n in STEM_SIZES if len(w) >= n}))
        many = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(plain_words, many), pa.array(sets, many)], ["y", "everyday", "stems"])


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_BOUND, ordinary: frozenset[str] = COMMON) -> Learnt:
    """Stems that explain labelled toxic documents without two hits on given terms, and everyday words that are toxic.

    Greedy cover: in each step the stem found in most documents that don't hold two
    chosen ones yet, among those ``STEM_LIFT`` times as common there as in clean
    documents; it ends when a stem would add fewer than 1 in 50 of those documents, or
    fewer than three.  A group of copies is covered by two stems at most.  An everyday word
    is toxic if three toxic documents hold it and it is ``STEM_LIFT`` times as common in
    toxic as in clean documents.
    """
    sets = sample_labelled(docs, labels, "toxic", bound).mapInArrow(lambda b: _stem_sets(b, ordinary), "y int, everyday array<string>, stems array<string>")
    sets = materialize(sets, "stems")
    try:
        n = {r.y: r["count"] for r in sets.groupBy("y").count().collect()}
        share = lambda k, y: (k + (y == 0)) / max(1, n.get(y, 0))
        words_ = sets.select("y", F.explode("everyday").alias("word")).groupBy("word").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c")).collect()
        sure = frozenset(r.word for r in words_ if n.get(0) and r.t >= 3 and share(r.t, 1) >= STEM_LIFT * share(r.c, 0))
        return Learnt(_choose(sets.where("stems is not null").select("y", "stems")), sure)
    finally:
        release(sets)


def _choose(sets: DataFrame) -> tuple[str, ...]:
    toxic = [frozenset(s) for s in sets.where("y = 1").toArrow().column("stems").to_pylist()]
    n_clean = sets.where("y = 0").count()
    least = max(3, len(toxic) // 50)
    holds: dict[str, set[int]] = {}
    for i, stems in enumerate(sorted(toxic, key=sorted)):
        for stem in stems:
            holds.setdefault(stem, set()).add(i)
    holds = {stem: where for stem, where in holds.items() if len(where) >= least}
    if not holds or not n_clean:
        return ()

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [s for stems in batch.column(0).to_pylist() for s in stems if s in holds]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.string())], ["stem"])

    clean = dict(sets.where("y = 0").select("stems").mapInArrow(common, "stem string").groupBy("stem").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas().itertuples(index=False, name=None))
    holds = {s: where for s, where in holds.items() if len(where) / len(toxic) >= STEM_LIFT * (clean.get(s, 0) + 1) / n_clean}
    times, chosen = [0] * len(toxic), []
    while holds:
        gain, _, _, stem = max((sum(times[i] < 2 for i in where), -clean.get(s, 0), -len(s), s) for s, where in holds.items())
        if gain < least:
            break
        chosen.append(stem)
        for i in holds.pop(stem):
            times[i] += 1
        holds = {s: w for s, w in holds.items() if not s.startswith(stem) and not stem.startswith(s)}
    return tuple(sorted(chosen))


def score_documents(docs: DataFrame, learnt: Learnt = Learnt(), terms: tuple[str, ...] = LEXICON, ordinary: frozenset[str] = COMMON) -> DataFrame:
    """(doc_id, score, abusive, quoted, terms) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, learnt.stems, ordinary, learnt.sure)
        for batch in as_table(batches):
            buf, off, _ = utf8(batch.column(1))
            at = matcher.rows(buf, off)
            got = [(0.0, 0, 0, [])] * batch.num_rows
            for i, text in zip(at.tolist(), batch.column(1).take(pa.array(at)).to_pylist()):
                got[i] = judge(text, matcher, True)
            score, abuse, quotes, names = zip(*got)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(abuse, pa.int32()), pa.array(quotes, pa.int32()), pa.array(names, pa.list_(pa.string()))], ["doc_id", "score", "abusive", "quoted", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, abusive int, quoted int, terms array<string>")


def toxic_documents(docs: DataFrame, learnt: Learnt = Learnt(), terms: tuple[str, ...] = LEXICON, toxic_at: float = TOXIC_AT, ordinary: frozenset[str] = COMMON) -> DataFrame:
    """(doc_id, score, abusive, quoted, terms) of the toxic documents."""
    return score_documents(docs, learnt, terms, ordinary).where(F.col("score") >= toxic_at - 1e-9)
