"""Token counts without ids: pieces once per distinct pre-token, times frequencies.

A BPE merge can only make a piece of the vocabulary, so no merge crosses two adjacent
characters that no piece has side by side. Text is cut there (before a run of word
marks, and around line breaks and the like), which leaves pre-tokens that the model
encodes independently of each other.

Frequent pre-tokens are joined within the task, from a table of at most ``HEAD``
entries, so no key that many documents share is ever shuffled; the rest go through a
shuffled join on the pre-token. Both sides use the one table of counts.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import small_batches, stored

#: Entries of the table of frequent pre-tokens that tasks hold (a bound on the broadcast).
HEAD = 300_000
#: Distinct pre-tokens a task gathers before it hands on their frequencies.
GATHER = 400_000
MARK = "▁"


class Pieces:
    """A sentencepiece BPE model that counts the pieces of pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, train = model.normalizer_spec, model.trainer_spec
        plain = not spec.precompiled_charsmap and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        if train.model_type != train.BPE or not plain or train.treat_whitespace_as_suffix or not train.byte_fallback:
            raise ValueError("pre-tokens are exact for BPE models with byte fallback and no normalisation only")
        normal = [p.piece for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED)]
        if any(MARK in p.lstrip(MARK) for p in normal) or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("a piece has a word mark behind other characters")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        inner = {c for p in normal if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if c not in inner)
        spaces = f" {MARK}"
        self.split = re.compile(f"[{spaces}]+[^{spaces}{alone}]*|[^{spaces}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def pre_tokens(self, text: str | None) -> list[str]:
        return self.split(self.prefix + text) if text else []

    def counts(self, pre_tokens: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(pre_tokens, num_threads=1)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _frequencies(docs: DataFrame, path: str, text_col: str) -> DataFrame:
    """``(pre_token, n)``: sums over parts of a partition, to be summed up again."""

    def run(batches):
        model, gathered = pieces(path), Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(gathered.keys(), pa.string()), pa.array(gathered.values(), pa.int64())], names=["pre_token", "n"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                gathered.update(model.pre_tokens(text))
                if len(gathered) > GATHER:
                    yield out()
                    gathered.clear()
        yield out()

    return docs.select(text_col).mapInArrow(run, "pre_token string, n bigint")


def _counted(distinct: DataFrame, path: str) -> DataFrame:
    """Adds ``pieces``, counted once per row of distinct pre-tokens."""

    def run(batches):
        for batch in batches:
            n = pa.array(pieces(path).counts(batch.column(0).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=["pre_token", "n", "pieces"])

    return distinct.mapInArrow(run, "pre_token string, n bigint, pieces int")


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD
) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` per row: UTF-8 bytes and pieces of the text.

    Null and empty texts count zero; texts of any length are counted whole. Repeated rows, equal or null ids are counted row by
    row; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    vocabulary = stored(_counted(_frequencies(docs, path, text_col).groupBy("pre_token").agg(F.sum("n").alias("n")), path))

    # The least frequency that keeps the table within its bound, from a histogram of
    # frequencies by powers of two (a few rows on the driver).
    sizes = {
        r.power: r.types
        for r in vocabulary.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("types")).collect()
    }
    power, room = max(sizes, default=0) + 1, head
    while power > 0 and sizes.get(power - 1, 0) <= room:
        power -= 1
        room -= sizes.get(power, 0)
    frequent = vocabulary.where(F.col("n") >= F.lit(1 << power))
    rows = frequent.select("pre_token", "pieces").toArrow()
    table = spark.sparkContext.broadcast((rows.column(0).to_pylist(), rows.column(1).to_pylist()))

    def run(batches):
        model, known = pieces(path), dict(zip(*table.value, strict=True))
        for batch in batches:
            sizes, sums, rest = [], [], []
            for text in batch.column(1).to_pylist():
                total, rare = 0, []
                for pre, n in Counter(model.pre_tokens(text)).items():
                    size = known.get(pre)
                    if size is None:
                        rare.append({"pre_token": pre, "n": n})
                    else:
                        total += n * size
                sizes.append(len(text.encode("utf-8", "replace")) if text else 0)
                sums.append(total)
                rest.append(rare)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(rest, pa.list_(pa.struct([("pre_token", pa.string()), ("n", pa.int64())]))),
                ],
                names=[id_col, "n_bytes", "sum", "rest"],
            )

    schema = f"{id_col} {kind}, n_bytes bigint, sum bigint, rest array<struct<pre_token string, n bigint>>"
    counted = stored(
        docs.select(id_col, text_col).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    )
    rare = counted.select("row", F.explode("rest").alias("r")).select("row", "r.pre_token", "r.n")
    found = rare.join(vocabulary.where(F.col("n") < F.lit(1 << power)).select("pre_token", "pieces"), "pre_token")
    sums = found.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rare"))
    whole = counted.select("row", id_col, "n_bytes", "sum").join(sums, "row", "left")
    return whole.select(id_col, "n_bytes", (F.col("sum") + F.coalesce("rare", F.lit(0))).alias("n_tokens"))
