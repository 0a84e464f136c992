"""Byte-level BPE of whole corpora by corpus-level merge replay.

Words (the pieces the tokenizer's pattern cuts texts into) are laid out once each in one symbol array
per block of the corpus. An inverted index leads from each pair of neighbouring symbols to its
positions; the merges are replayed over all words at once in the order of their rank, and each merge
touches only the positions of its pair and their two neighbours. A pair made by a merge has a later
rank than that merge, so one pass over the ranks gives what merging each word by itself gives.
"""

from __future__ import annotations

import os
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pattern of the byte_bpe vocabularies, given with them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: A block of the corpus ends after this many words; it bounds memory, not the result.
BLOCK_WORDS = 2_000_000
#: Token ids in one batch sent to the JVM.
BATCH_IDS = 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the others for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    for n, b in enumerate(x for x in range(256) if x not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ids of single bytes, and the merges as (left id, right id, merged id) in the order of rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.bytes = [vocab[c] for c in byte_letters()]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        letter = {c: b for b, c in enumerate(byte_letters())}
        self.pieces = {i: bytes(letter[c] for c in t) for t, i in vocab.items() if all(c in letter for c in t)}

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(words: Sequence[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of word i are ids[offsets[i]:offsets[i + 1]].

    ``after`` and ``before`` link each living symbol to its neighbours in the word; -1 ends a word.
    """
    first = vocab.bytes
    symbol: list[int] = []
    after: list[int] = []
    starts: list[int] = []
    for w in words:
        starts.append(len(symbol))
        raw = w.encode("utf-8")
        n = len(symbol)
        symbol += [first[b] for b in raw]
        after += range(n + 1, n + len(raw) + 1)
        if raw:
            after[-1] = -1
    total = len(symbol)
    before = [-1] * total
    index: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, j in enumerate(after):
        if j >= 0:
            before[j] = i
            index[symbol[i], symbol[j]].append(i)
    pop = index.pop
    for a, b, merged in vocab.merges:
        at = pop((a, b), None)
        if at is None:
            continue
        if a == b:
            at.sort()  # of overlapping places the first one merges
        for i in at:
            if symbol[i] != a:
                continue
            j = after[i]
            if j < 0 or symbol[j] != b:
                continue
            symbol[i] = merged
            symbol[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                index[merged, symbol[k]].append(i)
            h = before[i]
            if h >= 0:
                index[symbol[h], merged].append(h)
    flat = np.array(symbol, np.int32)
    alive = flat >= 0
    ends = np.concatenate([np.array(starts, np.int64), [total]])
    count = np.concatenate([[0], np.cumsum(alive)])
    return flat[alive], count[ends]


class _Numbers(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def encode_block(texts: Sequence[np.ndarray], numbers: _Numbers, vocab: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, ids, lengths) of runs of a block's texts, each given by its words' numbers."""
    ids, offsets = replay(list(numbers), vocab)
    width = np.diff(offsets)
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (n < BATCH_IDS or j == i):
            n += len(texts[j])
            j += 1
        words = np.concatenate(texts[i:j]) if n else np.zeros(0, np.int32)
        w = width[words]
        ends = np.cumsum(w)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - w, w) + np.repeat(offsets[words], w)
        cut = np.cumsum([len(t) for t in texts[i:j]])
        upto = np.concatenate([[0], ends])[cut]
        yield i, j, ids[place], np.diff(np.concatenate([[0], upto]))
        i = j


def encode(df: DataFrame, id_column: str, text_column: str, path: str = VOCABULARY, pattern: str = PATTERN, counts_only: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """``id_column``, ``carry`` and ``ids`` array<int> (or ``n_tokens`` bigint) of every row.

    The vocabulary is byte-level, so every text has ids; none stands for a special token, whose
    spelling in a text is ordinary text. An empty and a null text give an empty list (0 tokens).
    Repeated rows come out as often as they are there. The file at ``path`` is sent to the executors with
    the job, unless they have it there themselves.
    One pass without a shuffle: each task encodes its own blocks of the corpus; a very long text is a
    block of its own. Other columns aren't read, so their names can't clash.
    """
    own = [id_column, *carry]
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    kept = source.schema.fields[:-1]
    last = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    schema = T.StructType([*kept, last])

    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from reelsieve.operators.nested import arrow_schema

        own_path = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        kinds, vocab, cut = arrow_schema(schema), vocabulary(own_path), regex.compile(pattern).findall
        numbers, texts, held, size = _Numbers(), [], [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            columns = [pa.concat_arrays([h.column(k) for h in held]) for k in range(len(kept))]
            for i, j, ids, lengths in encode_block(texts, numbers, vocab):
                if counts_only:
                    value = pa.array(lengths, pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids, pa.int32()), type=kinds.field(len(kept)).type)
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i).cast(kinds.field(k).type) for k, c in enumerate(columns)], value], schema=kinds)

        for batch in batches:
            at = 0
            column = batch.column(len(kept))
            for r in range(len(column)):
                words = np.fromiter(map(numbers.__getitem__, cut(column[r].as_py())), np.int32)
                texts.append(words)
                size += len(words)
                if size >= BLOCK_WORDS:
                    held.append(batch.slice(at, r + 1 - at))
                    yield from finish()
                    numbers, texts, held, size, at = _Numbers(), [], [], 0, r + 1
            if at < batch.num_rows:
                held.append(batch.slice(at).drop_columns(["text"]))
        if texts:
            yield from finish()

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], last.name)
