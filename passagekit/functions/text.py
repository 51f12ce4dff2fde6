"""Text of readings as column expressions: cleaning, layouts, distances, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit import constants as C

_DIGITS_OF = {d: sorted((letter for letter, x in C.CONFUSED.items() if x == d), key=list(C.CONFUSED).index) for d in dict.fromkeys(C.CONFUSED.values())}
_LETTERS, _DIGITS = [chr(c) for c in range(65, 91)], [str(d) for d in range(10)]


def clean(text: Column) -> Column:
    """Upper case, letters and digits only; null stays null."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def is_review_layout(text: Column) -> Column:
    return text.rlike(C.REVIEW_LAYOUT)


def is_plausible(text: Column) -> Column:
    """Two letters, three to twelve letters or digits, a digit among them."""
    return text.rlike(C.PLAUSIBLE) & text.rlike(C.DIGIT)


def portable_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its last extension (a leading dot is no extension)."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))


def sequence_of(name: Column) -> Column:
    """A frame's name without its number: what the frames of a video share."""
    return F.regexp_replace(name, "[_-][0-9]+$", "")


def missing(text: Column) -> Column:
    """Null where the text is null or empty, which both mean absent."""
    return F.nullif(text, F.lit(""))


def char_accuracy(truth: Column, read: Column) -> Column:
    """1 less the edit distance by the longer text's length, at least 0; 0 without truth."""
    longest = F.greatest(F.length(truth), F.length(read))
    close = 1 - F.levenshtein(truth, read) / F.when(longest > 0, longest)
    return F.when(F.length(truth) > 0, F.greatest(F.lit(0.0), close)).otherwise(F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two texts of one length; null if lengths differ."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    differ = F.zip_with(chars(a), chars(b), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda n, d: n + d))


def overlaps(a: Column, b: Column) -> Column:
    """Whether one text contains the other."""
    return F.contains(a, b) | F.contains(b, a)


def naive_join(regions: Column) -> Column:
    """Texts of regions end to end and their mean confidence, as a struct."""
    total = F.aggregate(regions, F.lit(0.0), lambda s, r: s + r["conf"])
    mean = F.when(F.size(regions) > 0, total / F.size(regions)).otherwise(F.lit(0.0))
    return F.struct(F.array_join(F.transform(regions, lambda r: r["text"]), "").alias("text"), mean.alias("conf"))


def _choices(expected: str) -> Column:
    """Map from a character to what it may stand for where a letter (L) or a digit (D) is due."""
    own, other = (_LETTERS, _DIGITS_OF) if expected == "L" else (_DIGITS, {k: [v] for k, v in C.CONFUSED.items()})
    table = {**{c: [c] for c in own}, **other}
    return F.create_map(*(x for c, to in table.items() for x in (F.lit(c), F.array(*map(F.lit, to)))))


def proposals(text: Column, template: Column) -> Column:
    """Array of all plates a cleaned text may stand for in a template; empty if none.

    A fold over the positions: what there is so far, times what the next character may be.
    """
    due = lambda i: F.substr(template, i, F.lit(1))
    char = lambda i: F.substr(text, i, F.lit(1))
    options = F.transform(
        F.sequence(F.lit(1), F.length(template)),
        lambda i: F.coalesce(F.element_at(F.when(due(i) == "L", _choices("L")).otherwise(_choices("D")), char(i)), F.expr("cast(array() as array<string>)")),
    )
    made = F.aggregate(options, F.array(F.lit("")), lambda acc, o: F.flatten(F.transform(acc, lambda p: F.transform(o, lambda x: F.concat(p, x)))))
    return F.when(F.length(text) == F.length(template), made).otherwise(F.expr("cast(array() as array<string>)"))


def substitutions(text: Column, template: Column) -> Column:
    """At how many places a letter stands where a digit is due, or the reverse."""
    kind = F.regexp_replace(F.regexp_replace(text, "[A-Z]", "L"), "[0-9]", "D")
    return hamming(kind, template)


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def fits(text: Column) -> Column:
    """Array of (proposal, score): each plate a cleaned text may stand for, once, with its
    score. Empty for a null text or one that fits nothing.

    Substitutions cost; a text that is a review layout as it stands is a fit itself, and no
    other reading may come closer to it than a margin.
    """
    none = F.expr("cast(array() as array<struct<proposal string, score double>>)")
    option = lambda proposal, score: F.struct(proposal.alias("proposal"), score.cast("double").alias("score"))

    def by_template(pattern):
        base = F.when(pattern == C.WEAK_TEMPLATE, C.WEAK_SCORE).otherwise(C.FULL_SCORE)
        score = F.greatest(F.lit(0.0), base - C.SUBSTITUTION_COST * substitutions(text, pattern))
        return _named(score, lambda s: F.transform(proposals(text, pattern), lambda p: option(p, s)))

    patterns = F.filter(F.array(*map(F.lit, C.TEMPLATES)), lambda p: F.length(p) == F.length(text))
    made = F.flatten(F.transform(patterns, by_template))

    def beside_itself(all_):
        scores = F.transform(F.filter(all_, lambda x: x["proposal"] == text), lambda x: x["score"])
        own = F.greatest(F.lit(C.WEAK_SCORE), F.array_max(scores))
        rest = F.filter(all_, lambda x: x["proposal"] != text)
        most = lambda o: F.greatest(F.lit(0.0), o - C.LITERAL_MARGIN)
        return _named(own, lambda o: F.concat(F.transform(rest, lambda x: option(x["proposal"], F.least(x["score"], most(o)))), F.array(option(text, o))))

    return _named(made, lambda all_: F.when(is_review_layout(text), beside_itself(all_)).otherwise(F.coalesce(all_, none)))


def best_fit(text: Column) -> Column:
    """The one fit with the best score, as (proposal, score); null without a fit or where two tie."""

    def only_best(all_):
        top = F.array_max(F.transform(all_, lambda x: x["score"]))
        return _named(top, lambda t: _named(F.filter(all_, lambda x: x["score"] == t), lambda best: F.when(F.size(best) == 1, F.get(best, F.lit(0)))))

    return _named(fits(text), only_best)


def template_fits(texts: DataFrame, column: str = "text") -> DataFrame:
    """``(column, proposal, score)`` of the distinct cleaned texts of a column, a row per fit."""
    each = texts.select(column).where(F.col(column).isNotNull()).distinct().select(column, F.explode(fits(F.col(column))).alias("f"))
    return each.select(column, "f.proposal", "f.score")
