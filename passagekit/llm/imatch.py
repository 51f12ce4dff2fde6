"""Document fingerprints by I-Match, with DataFrame functions only.

Of a text's distinct terms those are kept whose document frequency lies in a band of
inverse document frequency: neither everywhere nor too rare to survive an edit. Sorted,
they are hashed, as a whole and cut down to randomised subsets of the lexicon. Subsets come
at rates 1/4 to 1/4096 for each of eight seeds, so that whatever a text's length some of
them hold one or two of its terms; two texts' likeness is the share of equal subset
hashes among those that are not empty in both.

Each text is also compared with its edited form and with the next text in order of ids.
Rows are dealt to ranges of ids that hold a bounded number of characters each; a range
also gets the first row of the next one, so that "next" never needs one global order. All
that follows (window, explosion into terms, broadcast join with the lexicon, collection)
keeps that partitioning: texts are shuffled once.

The lexicon cannot outgrow its broadcast: a term in band is in at least ``LOW`` of the
distinct texts, so there are at most (mean distinct terms of a text) / ``LOW`` of them. Beyond
``BROADCAST`` terms, in corpora of very long texts, a shuffled join takes its place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.llm.common import stored

#: The band: shares of all distinct texts that hold a term.
LOW, HIGH = 0.001, 0.25
#: Lexicon terms that are broadcast at most; characters of text in a range of ids.
BROADCAST, RANGE_CHARS = 400_000, 2 << 20
#: Outer ranges of ids, whose bounds are literals in the plan; each is cut into as many inner
#: ranges as its share of the characters asks for, with bounds from a joined table.
OUTER = 1 << 10
#: Texts whose terms are collected in a map at once, beyond which they are sorted (and may spill).
GROUPS = 4096
#: Seeds; three hex digits of the term's MD5 each, and a subset holds those below a bound:
#: one in 4, 8, 16, ... 4096.
SEEDS, BOUNDS = 8, ("400", "200", "100", "080", "040", "020", "010", "008", "004", "002", "001")
#: Bytes that separate terms, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters, digits and non-ASCII characters, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), SEPARATORS)), "")


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """``(h)``: XXH64 of each term whose share of the distinct texts is in the band.

    Copies count once, so that a text that fills many rows does not push its terms out of
    the band. Only texts whose hash occurs again are shuffled to tell copies apart.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    counts = stored(texts.groupBy(F.xxhash64("t").alias("k")).agg(F.count("*").alias("m")))
    again = counts.where("m > 1").select("k")
    few = again.count() <= BROADCAST
    side = F.broadcast(again) if few else again
    keyed = texts.withColumn("k", F.xxhash64("t"))
    once = keyed.join(side, "k", "left_anti").select("t")
    copied = stored(keyed.join(side, "k", "left_semi").select("t").distinct())
    distinct = once.unionByName(copied)
    n = counts.where("m = 1").count() + copied.count()
    each = distinct.select(F.explode(terms(F.col("t"))).alias("t")).select(F.xxhash64("t").alias("h"))
    df = each.groupBy("h").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= low * n) & (F.col("df") <= high * n)).select("h")


def _short(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 6)


def hashed(kept: Column) -> Column:
    """Terms with their MD5; a column of its own, as all seeds use it."""
    return F.transform(F.sort_array(kept), lambda t: F.struct(t.alias("t"), F.md5(t.cast("binary")).alias("h")))


def subset_hashes(pairs: Column, instead: Column) -> Column:
    """Hashes of the whole of the sorted terms and of its subsets, ``-`` if empty.

    A text without any term in band has ``instead``, its own hash, for the whole.
    """
    joined = lambda part: F.array_join(F.transform(part, lambda x: x["t"]), " ")

    def of_seed(seed: int) -> Column:
        def step(acc, bound):
            rest = F.filter(acc["rest"], lambda x: F.substring(x["h"], 3 * seed + 1, 3) < bound)
            made = F.transform(
                F.array(rest),  # binds the subset to a name, so that it is built once
                lambda r: F.struct(r.alias("rest"), F.concat(acc["out"], F.array(F.when(F.size(r) > 0, _short(joined(r))).otherwise(F.lit("-")))).alias("out")),
            )
            return made[0]

        start = F.struct(pairs.alias("rest"), F.expr("cast(array() as array<string>)").alias("out"))
        return F.aggregate(F.array(*map(F.lit, BOUNDS)), start, step, lambda acc: acc["out"])

    whole = F.when(F.size(pairs) > 0, _short(joined(pairs))).otherwise(instead)
    return F.concat(F.array(whole), *(of_seed(s) for s in range(SEEDS)))


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes among those not empty in both, 0 to 1."""
    used = F.zip_with(a, b, lambda x, y: ((x != "-") | (y != "-")).cast("int"))
    same = F.zip_with(a, b, lambda x, y: ((x == y) & (x != "-")).cast("int"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return total(same).cast("double") / total(used)


def _ranges(docs: DataFrame, id_col: str, text_col: str, range_chars: int, most_outer: int = OUTER) -> DataFrame:
    """Rows with their range, and again (``guest``) in the range before whose rows they follow.

    Only the bounds and the first ids of outer ranges reach the driver, however many inner
    ranges there are.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    outer = min(most_outer, max(1, math.ceil(chars / range_chars)))
    inner = max(1, math.ceil(chars / range_chars / outer))
    shares = [i / outer for i in range(1, outer)]
    bounds = docs.agg(F.percentile_approx(id_col, shares, 100 * outer)).first()[0] if shares else []
    # Two steps of counting the bounds that are not above the id.
    side, place = math.isqrt(outer) + 1, F.lit(0)
    if bounds:
        groups = [bounds[i : i + side] for i in range(0, len(bounds), side)]
        text = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
        before = f"size(filter({text([g[-1] for g in groups])}, b -> b <= {id_col}))"
        rest = f"element_at(array({','.join(map(text, [*groups, [bounds[-1]]]))}), {before} + 1)"
        place = F.expr(f"{before} * {side} + if({before} < {len(groups)}, size(filter({rest}, b -> b <= {id_col})), 0)")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), place.cast("bigint").alias("outer"))
    at: Column = F.lit(0).cast("bigint")
    if inner > 1:
        cuts = rows.groupBy("outer").agg(F.percentile_approx(id_col, [i / inner for i in range(1, inner)], 100 * inner).alias("cuts"))
        cuts = stored(cuts)
        rows = rows.join(F.broadcast(cuts) if cuts.count() * inner <= BROADCAST else cuts, "outer", "left")
        at = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col(id_col))), F.lit(0)).cast("bigint")
    rows = rows.select(id_col, "text", "outer", at.alias("inner"))
    # The least id of each range and the range before it: inner ones by a window, from one
    # outer range to the next (and from the last to the first) by a row each on the driver.
    heads = stored(rows.groupBy("outer", "inner").agg(F.min(F.struct(id_col)).alias("head")))
    ends = sorted((r.outer, r.last) for r in heads.groupBy("outer").agg(F.max("inner").alias("last")).collect())
    links = [(ends[i][0], *ends[i - 1]) for i in range(len(ends))]
    previous = F.broadcast(spark.createDataFrame(links, "outer bigint, p_outer bigint, p_inner bigint"))
    prior = F.lag("inner").over(Window.partitionBy("outer").orderBy("inner"))
    guests = heads.withColumn("prior", prior).join(previous, "outer")
    first = F.col("prior").isNull()
    guests = guests.select(
        F.col(f"head.{id_col}").alias("head"), F.when(first, F.col("p_outer")).otherwise(F.col("outer")).alias("g_outer"), F.coalesce("prior", "p_inner").alias("g_inner")
    )
    guests = stored(guests)
    side_of = F.broadcast(guests) if guests.count() <= BROADCAST else guests
    placed = rows.join(side_of, F.col(id_col).eqNullSafe(F.col("head")), "left")
    range_of = lambda o, i, guest: F.struct((F.col(o) * inner + F.col(i)).alias("range"), F.lit(guest).alias("guest"))
    places = F.when(F.col("g_outer").isNull(), F.array(range_of("outer", "inner", False))).otherwise(F.array(range_of("outer", "inner", False), range_of("g_outer", "g_inner", True)))
    return placed.select(id_col, "text", F.explode(places).alias("p")).select(id_col, "text", "p.range", "p.guest")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH, range_chars: int = RANGE_CHARS, outer: int = OUTER
) -> DataFrame:
    """Per row: ``(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)``.

    ``edited`` is the text with its last floor(n_chars / 2) characters replaced by as many
    of the beginning of the next text (or all of it), in order of the numeric id; the last
    row is followed by the first. Rows of one id follow each other in order of their texts,
    null ids come first; null texts count as empty. Equal texts have equal fingerprints. An
    only row follows itself; an empty table gives an empty result; extra columns are ignored.
    Texts are whole however long; a longer one than a range is meant to hold is a range's own.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS))
    words = stored(lexicon(docs, text_col, low, high)).unionByName(spark.sql("SELECT xxhash64('') AS h"))
    if words.count() <= BROADCAST:
        words = F.broadcast(words)
    order = Window.partitionBy("range").orderBy("guest", id_col, "text")
    rows = _ranges(docs.select(id_col, text_col), id_col, text_col, range_chars, outer)
    rows = rows.withColumns({"pos": F.row_number().over(order), "next": F.lead("text").over(order)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    rows = rows.select("range", "pos", "guest", id_col, n.cast("bigint").alias("n_chars"), "text", F.when(~F.col("guest"), edited).alias("edited"))
    # A row per term of either form. What else a row holds goes with one empty term, so
    # that it is not copied for each, and rows without any other term stay.
    instead = lambda c: _short(F.concat(F.lit("="), F.col(c)))
    rest = F.struct(F.col(id_col), "guest", "n_chars", "edited", instead("text").alias("instead"), instead("edited").alias("edited_instead"))
    rows = rows.withColumns({"own_terms": terms(F.col("text")), "other_terms": F.coalesce(terms(F.col("edited")), F.array())})
    items = F.concat(F.array(F.lit("")), F.col("own_terms"), F.col("other_terms"))
    held = rows.select("*", F.posexplode(items).alias("i", "t"))
    held = held.select(
        "range", "pos", (F.col("i") > F.size("own_terms")).alias("other"), "t", F.when(F.col("i") == 0, rest).alias("rest"), F.xxhash64("t").alias("h")
    ).join(words, "h")
    of = lambda form: F.collect_list(F.when((F.col("t") != "") & (F.col("other") == form), F.col("t")))
    whole = held.groupBy("range", "pos").agg(of(False).alias("kept"), of(True).alias("edited_kept"), F.first("rest", ignorenulls=True).alias("rest"))
    whole = whole.select("range", "pos", "rest", hashed(F.col("kept")).alias("kept"), hashed(F.col("edited_kept")).alias("edited_kept"))
    signed = whole.select(
        "range",
        "pos",
        "rest.*",
        subset_hashes(F.col("kept"), F.col("rest.instead")).alias("own"),
        F.when(~F.col("rest.guest"), subset_hashes(F.col("edited_kept"), F.col("rest.edited_instead"))).alias("other"),
    )
    signed = signed.withColumn("next", F.lead("own").over(Window.partitionBy("range").orderBy("pos"))).where(~F.col("guest"))
    return signed.select(
        id_col,
        "n_chars",
        "edited",
        F.array_join("own", ":").alias("fingerprint"),
        F.array_join("other", ":").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
