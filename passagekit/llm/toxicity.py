"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are small rules that fire or stay silent: lexicon voters (a word, or a word stem,
that a bounded labelled sample links to the label) and pattern voters (shouting, runs of
signs, repeated words), and one that fires where no lexicon voter does. A generative model
of two classes, fitted by expectation-maximisation on their votes alone, estimates how
often each voter fires in either class, and from what is left of their covariance within
the classes how strongly voters depend on each other; dependent voters share their vote.
Its posterior labels then train a logistic classifier over words and stems, which scores
every text by the set of features it holds, whatever its length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import add_columns, sample_texts, small_batches

#: Labelled texts sampled (by a hash of their id), lexicon voters, features of the classifier.
SAMPLE, VOTERS, FEATURES = 4500, 200, 1500
#: Lengths of word stems; least texts that hold a voter's term; least odds for the label.
STEMS, LEAST, ODDS = (4, 5, 6), 4, 4.0
#: Value of a stem as a feature; less than a whole word's, so that words explain first.
STEM = 0.5
#: Rounds of EM and of gradient steps; strength of the penalty on weights.
ROUNDS, STEPS, PENALTY = 60, 600, 3e-5

_WORDS = re.compile(r"[^\W\d_]+").findall
#: Pattern voters: name and rule over (text, words of the text).
PATTERNS = (
    ("shouting", lambda t, ws: sum(c.isupper() for c in t) > 0.3 * len(t) > 6),
    ("signs", lambda t, ws: re.search(r"[!?]{2}|[*$#%&]{3}", t) is not None),
    ("repeats", lambda t, ws: len(ws) > 20 and len(set(ws)) < 0.3 * len(ws)),
    ("few words", lambda t, ws: 0 < len(ws) < 6),
)


def terms(words: set[str]) -> set[str]:
    """Features of a set of words: each whole word (ended by $) and its stems."""
    out = {w + "$" for w in words}
    for n in STEMS:
        out |= {w[:n] for w in words if len(w) > n}
    return out


@dataclass
class LabelModel:
    """P(fires | class) per voter, shares of dependent votes, and the classes' prior."""

    rate: np.ndarray  # voters x 2
    share: np.ndarray  # voters
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rate[:, 1] / self.rate[:, 0]) * self.share
        off = np.log((1 - self.rate[:, 1]) / (1 - self.rate[:, 0])) * self.share
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (on - off) + off.sum()
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    @property
    def accuracy(self) -> np.ndarray:
        """How likely a vote is right: P(class 1 | fires)."""
        one = self.prior * self.rate[:, 1]
        return one / (one + (1 - self.prior) * self.rate[:, 0])


def label_model(votes: np.ndarray, starts: np.ndarray, prior: float, rounds: int = ROUNDS) -> LabelModel:
    """Fit to ``votes`` (texts x voters, 0 or 1). ``starts``: a first guess of each
    voter's P(fires | class), which says what class its firing speaks for."""
    votes = votes.astype(np.float32)
    m = LabelModel(starts.clip(1e-4, 1 - 1e-4), np.ones(votes.shape[1]), min(max(prior, 1e-3), 0.5))
    if not len(votes):
        return m
    for i in range(rounds):
        p = m.posterior(votes).astype(np.float32)
        weight = np.stack([1 - p, p])
        total = weight.sum(1)
        m.rate = ((weight @ votes + 0.02) / (total[:, None] + 1)).T.clip(1e-4, 1 - 1e-4)
        m.prior = float(np.clip(total[1] / total.sum(), 1e-3, 0.5))
        if i % 10 == 9:  # dependence: correlation of what the classes leave unexplained
            rest = votes - weight.T @ m.rate.T
            c = rest.T @ rest / len(votes)
            sd = np.sqrt(np.maximum(np.diag(c), 1e-9))
            r = c / sd[:, None] / sd[None]
            np.fill_diagonal(r, 0)
            m.share = 1 / (1 + np.where(r > 0.2, r, 0).sum(1))
    return m


@dataclass
class Model:
    """Weights of terms, of pattern voters and the bias of the linear classifier."""

    weights: dict[str, float]
    patterns: np.ndarray
    bias: float
    labels: LabelModel | None = None
    voters: list[str] = field(default_factory=list)

    def __post_init__(self):
        least = min(STEMS)
        self.heads = {t.rstrip("$")[:least] for t in self.weights}

    def score(self, text: str | None) -> float:
        text = text or ""
        ws = _WORDS(text.lower())
        heads, weights, least = self.heads, self.weights, min(STEMS)
        hit = terms({w for w in set(ws) if w[:least] in heads})
        x = self.bias + sum(weights[t] for t in hit if t in weights)
        x += sum(w for w, (_, rule) in zip(self.patterns, PATTERNS, strict=True) if rule(text, ws))
        return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def fit(texts: list[str | None], labels: list[int], share_of_ones: float | None = None) -> Model:
    """Mine voters, fit the label model on their votes, train on its posteriors.

    ``share_of_ones``: of all texts to be scored, where the sample has another share."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model({}, np.zeros(len(PATTERNS)), float(np.log(share / (1 - share))))
    words = lambda text: _WORDS((text or "").lower())
    ones, all_ = Counter(), Counter()
    for text in texts:
        all_.update(terms(set(words(text))))
    all_ = {t: n for t, n in all_.items() if n >= LEAST}
    shared = {t: t for t in all_}  # one string per term, whatever number of texts hold it
    held = [{shared[t] for t in terms(set(words(text))) if t in shared} for text in texts]
    for h, label in zip(held, labels, strict=True):
        if label:
            ones.update(h)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())

    def odds(t):  # lower end of the odds of a text that holds the term, as against any text
        a, b = ones[t], all_[t] - ones[t]
        return np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)) - (1 / (a + 0.5) + 1 / (b + 0.5)) ** 0.5 * 0.5

    strong = [t for t, a in ones.items() if a >= LEAST and odds(t) >= np.log(ODDS)]
    voters = sorted(strong, key=lambda t: (-odds(t) * ones[t] ** 0.5, t))[:VOTERS]
    place = {t: i for i, t in enumerate(voters)}
    votes = np.zeros((len(y), len(voters) + 1 + len(PATTERNS)), np.uint8)
    for i, h in enumerate(held):
        votes[i, [place[t] for t in h & place.keys()]] = 1
        votes[i, len(voters)] = not votes[i, : len(voters)].any()
        ws = words(texts[i])
        votes[i, len(voters) + 1 :] = [bool(rule(texts[i] or "", ws)) for _, rule in PATTERNS]
    rate = votes.mean(0)
    starts = np.stack([rate, rate], 1)
    starts[: len(voters)] = np.stack([rate[: len(voters)] * 0.2, (rate[: len(voters)] * 5).clip(0, 0.5)], 1)
    starts[len(voters)] = [0.95, 0.2]
    model = label_model(votes, starts, n1 / len(y))
    soft = model.posterior(votes)

    gain = Counter()
    for h, p in zip(held, soft, strict=True):
        for t in h:
            gain[t] += float(p)
    share = soft.mean()
    z = {t: (g - all_[t] * share) / (all_[t] * share * (1 - share) + 1e-9) ** 0.5 for t, g in gain.items()}
    chosen = sorted(z, key=lambda t: (-abs(z[t]), t))[:FEATURES]
    at = {t: i for i, t in enumerate(chosen)}
    x = np.zeros((len(y), len(chosen) + len(PATTERNS)), np.float32)
    for i, h in enumerate(held):
        for t in h & at.keys():
            x[i, at[t]] = 1 if t[-1] == "$" else STEM
    x[:, len(chosen) :] = votes[:, len(voters) + 1 :]
    w, bias = logistic(x, soft)
    weights = {t: float(v) * (1 if t[-1] == "$" else STEM) for t, v in zip(chosen, w, strict=False)}
    if share_of_ones:  # the sample's classes may be drawn in other shares than they have
        bias += np.log(share_of_ones / (1 - share_of_ones)) - np.log(n1 / n0)
    return Model(weights, w[len(chosen) :].astype(float), float(bias), model, voters)


def logistic(x: np.ndarray, target: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on cross-entropy with soft targets."""
    w, bias = np.zeros(x.shape[1] + 1, np.float32), float(np.log(target.mean() / (1 - target.mean())))
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = bias
    for i in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50)))
        d = ((p - target) / len(x)).astype(np.float32)
        g = np.concatenate((x.T @ d + penalty * w[:-1], [d.sum()]))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample`` labelled rows among those ``learn_from`` (a condition on
    the id), a third of them of label 1 where there are as many, and as many whole texts as
    keep within a bound of characters. Where an id has several labels the largest counts."""
    known = labels.where(learn_from & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(id_col, F.col(label_col).cast("int").alias("label")).groupBy(id_col).agg(F.max("label").alias("label"))
    draw = lambda part, n: part.orderBy(F.xxhash64(id_col), id_col).limit(n)
    ones = {r.one: r.n for r in known.groupBy((F.col("label") == 1).alias("one")).agg(F.count("*").alias("n")).collect()}
    share = ones[True] / sum(ones.values()) if len(ones) == 2 else None
    chosen = draw(known.where("label = 1"), sample // 3).unionByName(draw(known.where("label <> 1"), sample - sample // 3))
    rows = sample_texts(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col), sample, id_col, text_col)
    table = rows.select(text_col, "label").toArrow()
    return fit(table.column(0).to_pylist(), table.column(1).to_pylist(), share)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability that the whole text has label 1.
    ``keep``: the columns to return beside it.

    Whole texts count, however long. Null, empty and wordless texts have no features and are scored by the bias (and what
    patterns they show). Only the text is looked at. Repeated rows and null ids are
    answered row by row; a column named like the new one is replaced; an empty table gives
    an empty result.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        one = sent.value.score
        return lambda texts: [pa.array([one(t) for t in texts], pa.float64())]

    return add_columns(docs, text_col, make, "score double", keep)
