"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string that the merges see as a whole (a pre-token), the BPE
encoding of the prefix ends in one token. Storing only that token is enough to have all
encodings: walk back from the end by the length of the stored token. The token of a
prefix is the one token ``t`` that is a suffix of it and fits behind the last token
``s`` of what is left, where ``s, t`` fit if BPE encodes their bytes as just ``[s, t]``.
Tokens of a prefix never change when bytes are appended, so appends are exact and cost
only the new bytes, and after an edit only the prefixes from the edit on are computed,
up to where the stored tokens agree again over the length of the longest token.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from passagekit.llm.common import add_columns, small_batches

#: Entries of either half of a worker's memory of pre-tokens, and of its pairs that fit.
MEMO, PAIRS = 150_000, 400_000
#: Characters beyond which a text's pre-tokens are found one by one, and ids spelt at once.
LONG, SPELT = 1 << 18, 1 << 16


class Vocabulary:
    """Ranks of a ``.tiktoken`` file: a line per token, base64 and rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.rank.items()}
        self.size = {r: len(t) for r, t in self.token.items()}
        if not all(bytes([i]) in self.rank for i in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.longest = max(map(len, self.rank))
        self._fit: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        # Finds every token that ends at a byte; the library's keys are text, one character a byte.
        self._ends = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in self.rank.items():
            self._ends.add_word(t.decode("latin-1"), r << 8 | len(t))
        self._ends.make_automaton()

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """BPE by definition: the adjacent pair of least rank is merged, leftmost first, as
        long as more than ``until`` tokens are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            ranks = [self.rank.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == 1 << 62:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens that BPE merges last to get ``t``; none if it does not get ``t``
        from its bytes, or by way of tokens of higher rank."""
        if t not in self._halves:
            parts = self.merged(self.token[t], 2)
            usable = len(parts) == 2 and all(self.size[p] == 1 or p < t and self.halves(p) for p in parts)
            self._halves[t] = tuple(parts) if usable else None
        return self._halves[t]

    def fits(self, before: int, after: int) -> bool:
        """Whether BPE keeps ``before, after`` as they are; ``before`` -1: nothing before."""
        key = (before + 1) << 32 | after
        known = self._fit.get(key)
        if known is None:
            if len(self._fit) >= PAIRS:
                self._fit.clear()
            known = self._fit[key] = self._kept(before, after)
        return known

    def _kept(self, before: int, after: int) -> bool:
        """Undoes the merges of both tokens, the latest first: they stay apart if no two
        tokens that met at their border had a merge due earlier than the one undone there."""
        size, token, rank = self.size, self.token, self.rank
        if any(t >= 0 and size[t] > 1 and not self.halves(t) for t in (before, after)):
            data = (b"" if before < 0 else token[before]) + token[after]
            return self.merged(data) == ([after] if before < 0 else [before, after])
        due = 1 << 62
        while before >= 0:
            if rank.get(token[before] + token[after], due) < due:
                return False
            # Merges of one rank go from left to right: that of the left token is the earlier.
            left, right = before if size[before] > 1 else -1, after if size[after] > 1 else -1
            if left > right:
                due, before = left, self._halves[before][1]
            elif right >= 0:
                due, after = right + 1, self._halves[after][0]
            else:
                break
        return True

    def last_tokens(self, data: bytes, last: list[int], old: list[int] | None = None, stop: int = 0, shift: int = 0):
        """Appends to ``last`` the last token of each further prefix of ``data``.

        With ``old``, the tokens before an edit that ended at ``stop`` and moved what
        follows by ``shift``: ends once the tokens agree over the longest token's length.
        """
        fit, fits, n, agree = self._fit, self.fits, len(last), 0
        ends = self._ends.iter(data.decode("latin-1"), n - self.longest) if n > self.longest else self._ends.iter(data.decode("latin-1"))
        for end, found in ends:
            if end != n:
                continue
            start = end + 1 - (found & 255)
            t = found >> 8
            key = last[start - 1] + 1 << 32 | t if start else t
            known = fit.get(key)
            if known is None:
                known = fits(last[start - 1] if start else -1, t)
            if known:
                last.append(t)
                n += 1
                if old is not None and n - shift > stop:
                    agree = agree + 1 if old[n - shift - 1] == t else 0
                    if agree >= self.longest:
                        return
        if n != len(data):
            raise ValueError(f"no token of the vocabulary ends byte {n} of a pre-token")

    def encode(self, data: bytes) -> list[int]:
        last: list[int] = []
        self.last_tokens(data, last)
        return self.walk(last)

    def walk(self, last: list[int]) -> list[int]:
        """The encoding: from the end back by the length of each last token."""
        out, at, size = [], len(last), self.size
        while at:
            t = last[at - 1]
            out.append(t)
            at -= size[t]
        return out[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Prefixes:
    """A pre-token's bytes with the last token of each of their prefixes."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; no stored token changes."""
        self.data += data
        self.vocab.last_tokens(self.data, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``data[start:stop]``; returns how many prefixes were computed."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = self.last[:start]
        self.vocab.last_tokens(self.data, self.last, old, stop, shift)
        done = len(self.last) - start
        self.last += old[len(self.last) - shift :]
        return done

    def tokens(self) -> list[int]:
        return self.vocab.walk(self.last)


class Memory(dict):
    """Packed ids by pre-token. What is not in it is encoded when it is looked up; full, it
    starts anew and keeps its former half a while."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab, self.older = vocab, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "replace")
            whole = self.vocab.rank.get(data)
            ids = array("i", self.vocab.encode(data) if whole is None else [whole]).tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts: the pattern's matches, each by `Prefixes`, with a bounded memory."""

    def __init__(self, path: str, pattern: str):
        self.vocab, self.pattern = vocabulary(path), regex.compile(pattern)
        self.known = Memory(self.vocab)

    def packed(self, text: str | None) -> bytes:
        """The ids of ``text``, four bytes each in the machine's order."""
        text = text or ""
        found = self.pattern.findall(text) if len(text) <= LONG else (m.group() for m in self.pattern.finditer(text))
        return b"".join(map(self.known.__getitem__, found))

    def encode(self, text: str | None) -> array:
        return array("i", self.packed(text))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.token.__getitem__, ids))


class Document:
    """A text with its encoding that takes appends and edits.

    Only pre-tokens from a few characters before the change are split again (a match
    depends on at most three characters beyond its start and one beyond its end), up to
    where the old split is met again; a pre-token that merely grew goes on from its
    stored prefixes.
    """

    BACK = 4

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.pieces = encoder, "", []
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, stop: int, new: str) -> None:
        keep, at = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep][0]) + self.BACK <= start:
            at += len(self.pieces[keep][0])
            keep += 1
        old, was = {}, 0
        for i, (piece, _) in enumerate(self.pieces):
            old[was] = i
            was += len(piece)
        shift = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        out, grown = self.pieces[:keep], self.pieces[keep] if keep < len(self.pieces) else None
        for m in self.encoder.pattern.finditer(text, at):
            if m.start() - shift >= stop + 1 and (i := old.get(m.start() - shift)) is not None:
                out += self.pieces[i:]
                break
            piece = m.group()
            if grown and len(out) == keep and piece.startswith(grown[0]):
                prefixes = grown[1]
                prefixes.append(piece.encode("utf-8", "replace")[len(prefixes.data) :])
            else:
                prefixes = Prefixes(self.encoder.vocab, piece.encode("utf-8", "replace"))
            out.append((piece, prefixes))
        self.text, self.pieces = text, out

    def tokens(self) -> list[int]:
        return [t for _, p in self.pieces for t in p.tokens()]


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the token ids of the text, an empty list for a null.
    ``keep``: the columns to return beside them.

    ``path`` is a rank file that every executor has. Whole texts count, however long. Rows are independent: repeated rows,
    null ids and extra columns change nothing (a column named like the new one is
    replaced), an empty table gives an empty result. Text is never merged across matches
    of ``pattern``, nor are special tokens known.
    """
    small_batches(docs.sparkSession)

    def make():
        encoder = Encoder(path, pattern)

        def step(texts):
            ids = [encoder.packed(text) for text in texts]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]

        return step

    return add_columns(docs, text_col, make, "ids array<int>", keep)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``bytes``: what the ids of each row spell; null ids give null bytes."""

    def run(batches):
        vocab = vocabulary(path)
        known = sorted(vocab.token)
        size, at = np.zeros(known[-1] + 1, np.int32), np.zeros(known[-1] + 1, np.int64)
        size[known] = [len(vocab.token[r]) for r in known]
        at[known] = np.cumsum(size[known]) - size[known]
        pool = np.frombuffer(b"".join(vocab.token[r] for r in known), np.uint8)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            ids, rows = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(size[ids], dtype=np.int64)))
            spelt = np.empty(ends[-1], np.uint8)
            for a in range(0, len(ids), SPELT):  # places are eight times as wide as what they spell
                some, to = ids[a : a + SPELT], ends[a : a + SPELT + 1]
                spelt[to[0] : to[-1]] = pool[np.arange(to[0], to[-1]) + np.repeat(at[some] - to[:-1], size[some])]
            bounds = ends[np.concatenate(([0], np.cumsum(rows)))].astype(np.int32)
            valid = pa.array(column.is_valid()).buffers()[1] if column.null_count else None
            spelt = pa.Array.from_buffers(pa.binary(), len(batch), [valid, pa.py_buffer(bounds), pa.py_buffer(spelt)])
            yield pa.RecordBatch.from_arrays([*batch.columns, spelt], names=[*batch.schema.names, "bytes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, `bytes` binary")
