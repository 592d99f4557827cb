"""Packing: documents into token windows by minimum bin slack.

1. Every document becomes token ids (the tokenizer's, then an end id). It is cut at whole windows: a document
   of n ids gives n // window full pieces and one remainder. Pieces with their checksums are staged; the ids
   themselves never leave the task.
2. Pieces are dealt to shards by document; the number of shards follows from the total of tokens, so a shard
   has a bounded number of rows whatever the size of the corpus.
3. Within a shard, window after window is filled by minimum bin slack: the longest remaining piece is set, and
   a subset-sum dynamic programme over the multiset of remaining lengths (a bit set of reachable sums, one
   state for each length used, backtracked to counts) picks the lengths that come closest to the capacity.

Defined cases: null text is empty text, which has the end id alone; a repeated row is packed again; an empty
table has no pieces; a document that is an exact multiple of the window has no remainder.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from string import punctuation
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged
from runlens.llm.memo import WordMemo
from runlens.llm.worker import held, sliced, tidy

if TYPE_CHECKING:
    from tokenizers import Tokenizer

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 4_000_000
#: texts by which a tokenizer is tried: what spaces and line feeds part must stay apart
GAPS = ("a b", " a", "a ", "a\nb", "ab  cd\n\nef", "don't 12\n3.5 x", "\n", "\u00e9 \u6f22\n\u5b57")
#: whether A-Z are lower-cased, and whether ASCII punctuation between a letter and a space is parted from the letter
CASES = ("Ab", "I\u0307X", "QUITE \u00c9A", "don'T")
STOPS = ("ab, cd. ef", "l\u00e9, x. ", "it's, we'll. y", "Ab. c, d", "ab!! cd?'\" \u6f22.%%% z", "\u0130. \u0958! \u05e9\u05c1, x",
         " ".join(f"ab{a}{b}" for a in ["", *punctuation] for b in punctuation) + " ")
#: not after letters of which normal form or lower case can leave a mark at the end: the mark and what follows are one piece
STOP = rf"([^\PL\x{{130}}\p{{Hebrew}}\p{{Devanagari}}\p{{Bengali}}\p{{Gurmukhi}}\p{{Oriya}}\p{{Tibetan}}])([{re.escape(punctuation)}]+) "
#: letters of the Latin scripts, and words by which their spelling is tried
LETTERS = "".join(c for c in map(chr, range(0x180)) if c.isalpha())
SPELLED = ("ab", "STRASSE", "Stra\u00dfe", "\u00e9l\u00e8ve", "\u0141\u00f3d\u017a", "\u0130zmir", "\u017fo\u00aa")


def words_of(texts: pa.Array, fold: bool, part: bool) -> pa.Array:
    """Lists of words; with ``fold`` in lower case, with ``part`` without punctuation at their end."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
    texts = pc.ascii_lower(texts) if fold else texts
    texts = pc.replace_substring_regex(texts, STOP, r"\1 \2 ") if part else texts
    return pc.split_pattern(texts, " ")


def spelling(model: Tokenizer) -> dict[int, str]:
    """How the tokenizer writes letters of ``LETTERS`` for its model, a table for ``str.translate``.

    Empty, unless a run of them stays in one piece, each written as if it stood alone: tried on all pairs of neighbours.
    """
    def written(text: str) -> list[str]:
        text = model.normalizer.normalize_str(text) if model.normalizer else text
        return [piece for piece, _ in model.pre_tokenizer.pre_tokenize_str(text)] if model.pre_tokenizer else [text]

    table = {ord(c): pieces[0] for c in LETTERS if len(pieces := written(c)) == 1}
    run = "".join(chr(a) + chr(b) for a in table for b in table)
    ordinary = all(token.special for token in model.get_added_tokens_decoder().values())
    return table if ordinary and written(run) == [run.translate(table)] else {}


def word_ids(path: str) -> tuple[WordMemo, bool, bool]:
    """Memo word -> packed ids of the tokenizer at ``path``, and how words may be cut for it (``words_of``).

    Fewer forms of a word are fewer words to encode, and a word of letters alone, as most are, goes straight to the
    tokenizer's model; what a tokenizer does not do is not assumed of it, but tried when it is loaded. The Python
    worker holds the memo for its next tasks.
    """
    def make() -> tuple[WordMemo, bool, bool]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own hold memory each
        from tokenizers import Tokenizer
        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True  # their strings in a text are ordinary text
        tokenize, spelled = model.model.tokenize, spelling(model)
        letters = re.compile(f"[{''.join(map(chr, spelled)) or LETTERS}]+").fullmatch

        def encode(words: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in model.encode_batch_fast(words, add_special_tokens=False)]

        def compute(words: list[str]) -> list[bytes]:
            found = [array("I", [t.id for t in tokenize(w.translate(spelled))]).tobytes() if letters(w) else None
                     for w in words]
            others = iter(encode([w for w, ids in zip(words, found) if ids is None]))
            return [next(others) if ids is None else ids for ids in found]

        def harmless(probes: tuple[str, ...], fold: bool, part: bool, ids: Callable = compute) -> bool:
            cut = words_of(pa.array(probes), fold, part).to_pylist()
            return all(b"".join(ids([w for w in words if w])) == encode([probe])[0] for probe, words in zip(probes, cut))

        if not harmless(GAPS, False, False, encode):
            raise ValueError(f"{path} joins what spaces or line feeds part; its words cannot be encoded one by one")
        if not spelled or not harmless(SPELLED, False, False):
            compute = encode
        return WordMemo(compute), harmless(CASES, True, False, encode), harmless(STOPS, False, True, encode)
    return held(f"words {path}", make)


def token_ids(texts: pa.Array, memo: WordMemo, fold: bool = False, part: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the number of them up to the end of each text.

    The tokenizer's normaliser and splitter never join what spaces or line feeds part (tried when it is loaded), so a
    text's ids are those of its words in a row. The words of a batch are dictionary-encoded: each distinct one is
    looked up or goes through the tokenizer once, and the ids are gathered by offsets.
    """
    words = words_of(texts, fold, part)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist goes through a scalar each
    memo.fill(distinct)
    found = list(map(memo.__getitem__, distinct))
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    ids, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(lengths) - lengths
    code = coded.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(lengths[code])])
    at = np.arange(ends[-1]) + np.repeat(first[code] - ends[:-1], lengths[code])
    return ids[at], ends[words.offsets.to_numpy()[1:]]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           end_id: int = END_ID) -> DataFrame:
    """``(doc_id, doc_tokens, lengths, crcs)``: a document's consecutive pieces."""
    id_type = docs.schema[id_col].dataType
    width = 4 * window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, fold, part_stops = word_ids(path)
        for part in sliced(batches):
            ids, ends = token_ids(part.column(1), memo, fold, part_stops)
            data = memoryview(np.insert(ids, ends, end_id).astype("<u4").tobytes())
            stops = (4 * (ends + np.arange(1, len(ends) + 1))).tolist()
            cuts = [range(a, b, width) for a, b in zip([0, *stops], stops)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([(c.stop - c.start) // 4 for c in cuts], pa.int64()),
                 pa.array([[min(width, c.stop - i) // 4 for i in c] for c in cuts], pa.list_(pa.int64())),
                 pa.array([[zlib.crc32(data[i:min(i + width, c.stop)]) for i in c] for c in cuts], pa.list_(pa.int64()))],
                names=["doc_id", "doc_tokens", "lengths", "crcs"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        tidy(cut, f"words {path}"), f"doc_id {id_type.simpleString()}, doc_tokens long, lengths array<long>, crcs array<long>")


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[int]:
    """Lengths of a sub-multiset of ``counts`` whose sum is the largest that is at most ``room``.

    ``order`` holds the lengths that are left, longest first. Bit s of ``reach`` says that the sum s can be
    made; a copy of a length shifts it. The states before each length are kept for the way back.
    """
    full, reach, goal, states = (1 << (room + 1)) - 1, 1, 1 << room, []
    for length in order:
        if length > room:
            continue
        before = reach
        for _ in range(min(counts[length], room // length)):
            grown = (reach | (reach << length)) & full
            if grown == reach:
                break
            reach = grown
        if reach != before:
            states.append((length, before))
        if reach & goal:
            break
    left, chosen = reach.bit_length() - 1, []
    for length, before in reversed(states):
        while not (before >> left) & 1:
            chosen.append(length)
            left -= length
    return chosen


def pack_lengths(lengths: np.ndarray, window: int = WINDOW) -> Iterator[list[int]]:
    """Yield windows as lists of positions in ``lengths`` until all are used; longest pieces are set first."""
    waiting = defaultdict(list)
    for position, length in enumerate(lengths.tolist()):
        waiting[length].append(position)
    counts = {length: len(rows) for length, rows in waiting.items()}
    order = sorted(counts, reverse=True)
    while order:
        first = order[0]
        counts[first] -= 1
        chosen = [first] + fullest(counts, order, window - first)
        for length in chosen[1:]:
            counts[length] -= 1
        if any(not counts[length] for length in set(chosen)):
            order = [length for length in order if counts[length]]
        yield [waiting[length].pop() for length in chosen]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    cut = staged(pieces(docs, path, id_col, text_col, window, end_id), "pieces")
    total = cut.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    id_type = cut.schema["doc_id"].dataType.simpleString()
    # repeated rows of a document are dealt by their place, too, so that no document is a hot key
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)))

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "doc_tokens"], kind="stable", ignore_index=True)
        per_doc = group["lengths"].map(len).to_numpy()
        row = np.repeat(np.arange(len(group)), per_doc)
        length = np.concatenate(group["lengths"].to_list()).astype("int64")
        crc = np.concatenate(group["crcs"].to_list()).astype("int64")
        first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
        before = np.cumsum(length) - length
        start = before - before[first][row]
        sequence, offset = np.zeros(len(length), "int64"), np.zeros(len(length), "int64")
        for number, window_rows in enumerate(pack_lengths(length, window)):
            at = 0
            for position in window_rows:
                sequence[position], offset[position] = number, at
                at += length[position]
        return pd.DataFrame({"doc_id": group["doc_id"].to_numpy()[row], "start": start, "length": length,
                             "ids_crc32": crc, "doc_tokens": group["doc_tokens"].to_numpy()[row],
                             "sequence_id": (int(key[0]) << 40) + sequence, "offset": offset})

    return dealt.groupBy("shard").applyInPandas(
        fill, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long")
