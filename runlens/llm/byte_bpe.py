"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last token of the prefix's encoding. ``last[i]``
stores that token for the prefix of i bytes. It is found from the tokens that end at byte i: a token t fits if
the encoding of the prefix before it ends in a token p, and p followed by t is what BPE makes of their bytes
(``follows``). The table thus grows byte by byte: appending is exact and costs the new bytes alone, and after
an edit the table is recomputed only until it meets the old one again. Encoding reads the table backwards.

Texts are cut by a pattern first, as usual for such vocabularies; a table covers one match of the pattern.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.memo import WordMemo
from runlens.llm.worker import held, tidy

#: Characters of the Unicode property White_Space besides space and line feed.
OTHER_SPACE = regex.compile(r"[^\P{White_Space} \n]")


class Vocabulary:
    """Ranks (bytes -> id) of a byte-level BPE; a pair of tokens merges if their bytes are a token, lowest id first."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.size = max(ranks.values()) + 1
        self.packed = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}  # by left * size + right
        self.ends = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.ends.add_word(token.decode("latin-1"), (i, len(token)))
        self.ends.make_automaton()

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for one that no merge makes."""
        if token not in self.halves:
            data, found = self.tokens[token], None
            if len(data) > 1:
                units = [self.ranks[data[i:i + 1]] for i in range(len(data))]
                while len(units) > 2:
                    best = min(((self.ranks.get(self.tokens[a] + self.tokens[b], token), i)
                                for i, (a, b) in enumerate(zip(units, units[1:]))))
                    if best[0] >= token:
                        break
                    units[best[1]:best[1] + 2] = [best[0]]
                found = (units[0], units[1]) if len(units) == 2 else None
            self.halves[token] = found
        return self.halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes is these two tokens (nothing merges across their border)."""
        pair = left * self.size + right
        known = self.pairs.get(pair)
        if known is None:
            known = self.pairs[pair] = self._follows(left, right)
        return known

    def _follows(self, left: int, right: int) -> bool:
        """Undo merges from the latest back; no pair that then meets at the border may merge before it was undone."""
        merged_at = len(self.tokens) + 1  # id of the merge undone last; a border merge below it would have come first
        on_left = True
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            # a tie goes to the merge further left
            if across is not None and (across < merged_at or across == merged_at and not on_left):
                return False
            left_parts, right_parts = self.parts(left), self.parts(right)
            if left_parts is None and right_parts is None:
                return True
            if right_parts is None or left_parts is not None and left > right:
                merged_at, on_left, left = left, True, left_parts[1]
            else:
                merged_at, on_left, right = right, False, right_parts[0]


class PrefixTable:
    """Encoding of one byte string that can be appended to and edited.

    ``last[i]`` is the last token of the encoding of the first i bytes.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        old, self.data = len(self.data), self.data + more
        self._grow(old, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start..end; returns how many prefixes were computed anew.

        A prefix's token depends on the tokens of the ``longest`` prefixes before it, so the old table holds
        again, shifted, from where that many prefixes in a row agree with it.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same, done = old[:start + 1], 0, 0
        at, stop = start, len(self.data)
        while at < stop:
            upto = min(stop, at + 64)
            self._grow(at, self.last, upto)
            for i in range(at + 1, upto + 1):
                done += 1
                same = same + 1 if i > start + len(new) and self.last[i] == old[i - shift] else 0
                if same >= self.vocabulary.longest:
                    self.last = self.last[:i + 1] + old[i + 1 - shift:]
                    return done
            at = upto
        return done

    def _grow(self, old: int, last: list[int], upto: int) -> None:
        """Fill ``last`` for the prefixes of old+1..upto bytes."""
        vocabulary = self.vocabulary
        known, size, follows = vocabulary.pairs.get, vocabulary.size, vocabulary.follows
        begin = max(0, old - vocabulary.longest)
        last.extend([-1] * (upto - old))
        first = begin + 1
        for end, (token, length) in vocabulary.ends.iter(self.data[begin:upto].decode("latin-1")):
            stop = first + end
            if last[stop] >= 0 or stop <= old:
                continue
            before = stop - length
            if before:
                left = last[before]
                if left < 0:
                    continue
                fits = known(left * size + token)
                if not (follows(left, token) if fits is None else fits):
                    continue
            last[stop] = token

    def tokens(self) -> list[int]:
        found, at, last, spelt = [], len(self.data), self.last, self.vocabulary.tokens
        while at:
            token = last[at]
            found.append(token)
            at -= len(spelt[token])
        return found[::-1]


def piece_pattern(pattern: str) -> regex.Pattern:
    r"""``pattern`` with \s and \S as the Unicode property White_Space, as the pattern's usual engine reads them."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}")
                         .replace(r"\s", r"\p{White_Space}"))


class TextCodec:
    """Whole texts to packed ids (little-endian 32-bit) and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, piece_pattern(pattern)
        self.pieces = WordMemo(lambda words: [self._piece(w) for w in words])
        self.words = WordMemo(lambda words: [self._word(w) for w in words])

    def _piece(self, piece: str) -> bytes:
        data, packed = piece.encode(), self.vocabulary.packed
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            return packed[whole]
        return b"".join([packed[i] for i in PrefixTable(self.vocabulary, data).tokens()])

    def _word(self, word: str) -> bytes | None:
        """Ids of a word with at most one space before it; None if it holds other white space.

        Words share pieces: what stands before a comma or a full stop is most often known.
        """
        if not word.isprintable() and OTHER_SPACE.search(word):  # no other white space is printable
            return None
        memo = self.pieces
        return b"".join([memo[p] for p in self.pattern.findall(word)])

    def encode(self, text: str) -> bytes:
        """Words that single spaces or line feeds part are cut alike whatever stands around them."""
        if not any(gap in text for gap in ("  ", "\n\n", " \n", "\n ", "\x00")):
            memo = self.words
            found = [memo[w] for w in text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")]
            if None not in found:
                return b"".join(found)
        memo = self.pieces
        return b"".join([memo[p] for p in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def trim(self) -> None:
        self.pieces.fill(())
        self.words.fill(())
        if len(self.vocabulary.pairs) > 2_000_000:
            self.vocabulary.pairs.clear()


def codec(path: str, pattern: str) -> TextCodec:
    """One, which the Python worker holds for its next tasks."""
    return held(f"bytes {path} {pattern}", lambda: TextCodec(Vocabulary.from_file(path), pattern))


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded)``: packed ids of each whole text, and the bytes that they decode to.

    Null text is empty text, which has no ids. Any id type; rows are independent of each other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own.trim()
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())],
                    names=["id", "ids", "decoded"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(
        tidy(run, f"bytes {path} {pattern}"), f"id {id_type}, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


__all__ = ["PrefixTable", "TextCodec", "Vocabulary", "codec", "digests", "encode_column"]
