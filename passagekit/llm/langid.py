"""Language identification by unigrams of pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary (the pieces
of a sentencepiece model, lower-cased). A word may be cut into pieces in many ways; its
probability is the sum over all of them, by the forward algorithm. The probabilities are
learned by expectation-maximisation on a bounded sample of labelled texts, with the
backward algorithm for the expected number of uses of each piece. A text's words are
independent given its language, so a text's score is a sum over its words, and each
distinct word needs the forward algorithm once for all languages.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.llm.common import add_columns, small_batches

#: Labelled texts sampled per language to learn from (by a hash of their id), and their
#: characters: texts that would go beyond are left out of the sample, whole.
PER_LANGUAGE, CHARACTERS = 200, 4 << 20
#: Learning alone takes words of at most so many letters, and cuts longer ones.
LONGEST = 32
#: Characters of words whose pieces are found at once; longer words go in slabs of as many.
SLAB = 1 << 16
#: Probability of a character as a piece of its own where no piece explains it.
FLOOR = 1e-7
ROUNDS, PRIOR = 4, 0.01
#: Words a task remembers scores of, none of more than LONGEST letters.
MEMO = 200_000
MARK, UNKNOWN = "▁", "und"

_WORDS = re.compile(r"[^\W\d_]+").findall
#: As `_WORDS`, with the marks that combine with letters (the library's \w has them).
_MARKED_WORDS = regex.compile(r"[^\W\d_]+").findall
#: Finds a mark, or a character beyond the first plane that may be one.
_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c))[0] == "M") + chr(0x10000) + "-" + chr(sys.maxunicode) + "]").search


def words_of(text: str | None) -> list[str]:
    """Runs of letters and their marks in lower case; none where the text has no letter."""
    if not text:
        return []
    low = text.lower()
    found = _WORDS(low) if low.isascii() or not _MARKS(low) else _MARKED_WORDS(low)
    if not any(map(str.isalpha, found)) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


def public_pieces(path: str) -> list[str]:
    """The distinct lower-case pieces of letters of a sentencepiece model."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    lower = {p.piece.lower() for p in model.pieces if p.type == p.NORMAL}
    return sorted(p for p in lower if p.strip(MARK).isalpha() and p.lstrip(MARK).count(MARK) == 0 and p.count(MARK) < 2)


class Matcher:
    """Finds all pieces in many words at once."""

    def __init__(self, pieces: list[str]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(pieces):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()

    def find(self, found: list[str]):
        """``(lengths, word, end, piece)`` of every piece, ordered by its end in the word."""
        lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
        joined = MARK + f"\n{MARK}".join(found) if found else ""
        at, piece = self.ends(joined)
        starts = np.cumsum(lengths + 1) - lengths - 1
        word = np.repeat(np.arange(len(found)), lengths + 1)[at]
        end = at - starts[word] + 1
        # Pieces come word by word, which a stable sort by the end keeps (the narrow type has a faster one).
        order = np.argsort(end.astype(np.uint16) if lengths.max(initial=0) < 1 << 16 else end, kind="stable")
        return lengths, word[order], end[order], piece[order]

    def ends(self, chars: str) -> tuple[np.ndarray, np.ndarray]:
        """The place of the last character of every piece in ``chars``, and the piece."""
        found = self.automaton.iter(chars) if len(self.size) else ()
        return np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2).T


def forward(lengths, word, end, piece, size, p: np.ndarray) -> np.ndarray:
    """Per word and position the summed probability of all ways to cut what is before.

    ``p``: a column per language. Positions count characters from the word mark on.
    """
    most, langs = int(lengths.max(initial=0)), p.shape[1]
    a = np.zeros((len(lengths), most + 1, langs))
    a[:, 0] = 1.0
    cuts = np.searchsorted(end, np.arange(most + 2))
    for i in range(1, most + 1):
        a[:, i] = a[:, i - 1] * FLOOR
        here = slice(cuts[i], cuts[i + 1])
        w, k = word[here], piece[here]
        if len(w):
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            a[w[first], i] += np.add.reduceat(a[w, i - size[k]] * p[k], first, axis=0)
    return a


class Sums:
    """The forward algorithm for the whole of each of some words, of any length.

    Holds the sums of as many positions as the longest piece has characters, scaled by
    factors that are kept apart, so that neither memory grows with a word nor its
    probability runs out of range. ``lengths`` must fall.
    """

    def __init__(self, lengths: np.ndarray, size: np.ndarray, p: np.ndarray):
        self.lengths, self.size, self.p = lengths, size, p
        self.width = int(size.max(initial=1)) + 1
        self.held = np.zeros((len(lengths), self.width, p.shape[1]))
        self.held[:, 0] = 1.0
        self.log = np.zeros((len(lengths), p.shape[1]))
        self.out = np.zeros((len(lengths), p.shape[1]))
        self.at = 0

    def advance(self, stop: int, word: np.ndarray, end: np.ndarray, piece: np.ndarray) -> None:
        """On to position ``stop``; the pieces that end up to there, ordered by their ends."""
        start = self.at
        cuts = np.searchsorted(end, np.arange(start + 1, stop + 2))
        active = np.searchsorted(-self.lengths, -np.arange(start + 1, stop + 1), "right")
        for k in range(stop - start):
            i, n = start + k + 1, active[k]
            now = self.held[:n, (i - 1) % self.width] * FLOOR
            here = slice(cuts[k], cuts[k + 1])
            w, found = word[here], piece[here]
            if len(w):
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                now[w[first]] += np.add.reduceat(self.held[w, (i - self.size[found]) % self.width] * self.p[found], first, axis=0)
            self.held[:n, i % self.width] = now
            done = slice(np.searchsorted(-self.lengths, -i, "left"), n)
            self.out[done] = np.log(np.maximum(now[done], 1e-300)) + self.log[done]
            if i % 8 == 0:
                top = self.held[:n].max(axis=1)
                self.held[:n] /= top[:, None]
                self.log[:n] += np.log(top)
        self.at = stop


def log_sums(matcher: Matcher, found: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    order = np.argsort(-size, kind="stable")
    chars = np.concatenate(([0], np.cumsum(size[order])))
    out, at = np.zeros((len(found), p.shape[1])), 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(chars, chars[at] + SLAB, "right")) - 1)
        part = [found[i] for i in order[at:stop].tolist()]
        if len(part) == 1 and len(part[0]) > SLAB:
            whole = MARK + part[0]
            sums, back = Sums(np.array([len(whole)]), matcher.size, p), int(matcher.size.max(initial=1)) - 1
            for a in range(0, len(whole), SLAB):
                b, early = min(len(whole), a + SLAB), max(0, a - back)
                end, piece = matcher.ends(whole[early:b])
                new = early + end >= a
                sums.advance(b, np.zeros(int(new.sum()), np.int64), early + end[new] + 1, piece[new])
        else:
            lengths, word, end, piece = matcher.find(part)
            sums = Sums(lengths, matcher.size, p)
            sums.advance(int(lengths[0]), word, end, piece)
        out[order[at:stop]] = sums.out
        at = stop
    return out


def expectation(lengths, word, end, piece, size, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur ``n`` times; ``p`` of one language."""
    a = forward(lengths, word, end, piece, size, p[:, None])[:, :, 0]
    most = a.shape[1] - 1
    b = np.zeros_like(a)
    b[np.arange(len(lengths)), lengths] = 1.0
    cuts = np.searchsorted(end, np.arange(most + 2))
    for i in range(most, 0, -1):
        b[:, i - 1] += b[:, i] * FLOOR
        here = slice(cuts[i], cuts[i + 1])
        np.add.at(b, (word[here], end[here] - size[piece[here]]), b[word[here], i] * p[piece[here]])
    total = a[np.arange(len(lengths)), lengths]
    uses = n[word] * a[word, end - size[piece]] * p[piece] * b[word, end] / total[word]
    return np.bincount(piece, uses, len(p))


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    #: Probability of each piece (rows) in each language (columns); log prior of each.
    p: np.ndarray
    prior: np.ndarray


def fit(counts: dict[str, dict[str, int]], pieces: list[str], prior: dict[str, float], rounds: int = ROUNDS) -> Model:
    """Learn from word counts per language. Pieces no word holds are left out."""
    languages = sorted(counts)
    matcher = Matcher(pieces)
    columns, used = [], np.zeros(len(pieces), bool)
    for lang in languages:
        found = list(counts[lang])
        n = np.array([counts[lang][w] for w in found], float)
        match = matcher.find(found)
        used[match[3]] = True
        p = np.full(len(pieces), 1.0 / len(pieces))
        for _ in range(rounds):
            uses = expectation(*match, matcher.size, p, n) + PRIOR
            p = uses / uses.sum()
        columns.append(p)
    keep = np.flatnonzero(used)
    p = np.stack(columns, axis=1)[keep] if columns else np.zeros((0, 0))
    weights = np.array([prior.get(lang, 1.0) for lang in languages], float)
    return Model(languages, [pieces[i] for i in keep], p, np.log(weights / weights.sum()) if languages else weights)


class Scorer:
    """Log probabilities of words under every language, remembered within bounds."""

    def __init__(self, model: Model):
        self.model, self.matcher = model, Matcher(model.pieces)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)), np.float32)

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            logs = log_sums(self.matcher, part, self.model.p)
            n = len(self.at)
            if n + len(part) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros((max(len(self.rows), len(part)), self.rows.shape[1]), np.float32)))
            self.rows[n : n + len(part)] = logs
            self.at.update(zip(part, range(n, n + len(part)), strict=True))

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted languages and their posterior probabilities."""
        found = [words_of(t) for t in texts]
        flat = [w for ws in found for w in ws]
        if len(self.at) > MEMO:
            self._forget()
        distinct = dict.fromkeys(flat)
        self._learn([w for w in distinct if w not in self.at and len(w) <= LONGEST])
        long = [w for w in distinct if len(w) > LONGEST]  # not remembered, as they have no bound
        places = {w: -1 - i for i, w in enumerate(long)}
        sizes = np.array([len(ws) for ws in found], np.int64)
        total = np.repeat(self.model.prior[None], len(texts), 0)
        if flat and self.model.languages:
            place = self.at.__getitem__ if not long else lambda w: places[w] if len(w) > LONGEST else self.at[w]
            at = np.fromiter(map(place, flat), np.int64, len(flat))
            rows = self.rows[at]
            if long:
                rows[at < 0] = log_sums(self.matcher, long, self.model.p)[-1 - at[at < 0]]
            some = np.flatnonzero(sizes)
            total[some] += np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(1)
        score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        named = [self.model.languages[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)]
        return named, np.where(sizes > 0, score, 0.0)


@lru_cache(maxsize=4)
def _pieces(path: str) -> tuple[str, ...]:
    return tuple(public_pieces(path))


def learn(docs: DataFrame, path: str, learn_from: Column, per_language: int = PER_LANGUAGE, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """Fit on at most ``per_language`` texts of each language among rows ``learn_from``, in
    order of a hash of the id, and of at most `CHARACTERS` characters a language; the prior is
    each language's share of all those rows. Null ids, languages and texts teach nothing."""
    rows = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    prior = {r[0]: float(r[1]) for r in rows.groupBy(lang_col).agg(F.count("*")).collect()}
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), F.col(id_col), F.col("hash"))
    keys = rows.select(lang_col, id_col, F.xxhash64(text_col).alias("hash"), F.length(text_col).alias("chars"))
    chosen = keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    chosen = chosen.withColumn("sum", F.sum("chars").over(order)).where(F.col("sum") <= CHARACTERS)
    # At most per_language rows a language, also where an id stands on many rows.
    wanted = F.broadcast(chosen.select(lang_col, id_col, "hash").distinct())
    sample = rows.select(id_col, lang_col, text_col, F.xxhash64(text_col).alias("hash")).join(wanted, [lang_col, id_col, "hash"])
    sample = sample.dropDuplicates([lang_col, id_col, "hash"]).orderBy(lang_col, id_col, "hash").select(lang_col, text_col)
    counts: dict[str, dict[str, int]] = {}
    for lang, text in zip(*(c.to_pylist() for c in sample.toArrow().columns), strict=True):
        own = counts.setdefault(lang, {})
        for w in words_of(text):
            for i in range(0, len(w), LONGEST):
                part = w[i : i + LONGEST]
                own[part] = own.get(part, 0) + 1
    return fit({k: v for k, v in counts.items() if v}, list(_pieces(path)), prior)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the likeliest language of each whole text
    and its posterior probability. ``keep``: the columns to return beside them.

    Null texts and texts without a letter get ``und`` and 0; so does every text if the
    model has no language. Of equally likely languages the first by name is taken. Texts and
    runs of letters of any length are summed whole. Only the text is looked at. Repeated rows and null ids are
    answered row by row; columns named like the new ones are replaced; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)

        def step(texts):
            named, score = scorer.texts(texts)
            return [pa.array(named, pa.string()), pa.array(score, pa.float64())]

        return step

    return add_columns(docs, text_col, make, "lang_pred string, score double", keep)
