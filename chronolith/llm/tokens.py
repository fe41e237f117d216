"""Problem 8: the whole corpus in the ids of a public byte-level BPE tokenizer, by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be merged, so every such place in a text is a
certain cut: what lies on both sides can be encoded on its own and the ids put together. Three conditions keep the
tokenizer's splitting pattern out of the way, whatever the vocabulary: a cut lies between characters, never after
white space (a run of blanks is split by what follows it) and never before an apostrophe (a contraction could begin
there). The fragments are mostly single words with the blank before them, which recur all over the corpus, so each
task encodes a distinct fragment once and looks it up afterwards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: distinct fragments held by a task; the memory is bounded, texts are not
HELD = 400_000
#: longer fragments are rare and are not held
HELD_BYTES = 64


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY, folder: str = TOKENIZERS):
    """The tiktoken encoder of a vocabulary file, and a table of 65,536 flags: pair of bytes in no token."""
    import importlib.util

    import tiktoken

    spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(folder) / "__init__.py")
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    ranks = {}
    with (Path(folder) / f"{name}.tiktoken").open("rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    encoding = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    never = np.ones(65536, bool)
    inside = [np.frombuffer(token, np.uint8).astype(np.int32) for token in ranks if len(token) > 1]
    for token in inside:
        never[token[:-1] * 256 + token[1:]] = False
    return encoding, never


def _white_ends(data: np.ndarray) -> np.ndarray:
    """Flags of bytes that can end a white-space character (a few other characters are flagged too)."""
    white = (data >= 9) & (data <= 13) | (data >= 28) & (data <= 32)
    for last in (0x80, 0x85, 0xA0, 0x9A, 0x9F, 0xA8, 0xA9, 0xAF, *range(0x81, 0x8B)):
        white |= data == last
    if len(data) > 2:
        # only after C2, E1 9A, E2 80, E2 81 and E3 80 these bytes end white space
        before, first = np.r_[0, data[:-1]], np.r_[0, 0, data[:-2]]
        multi = (before == 0xC2) | (first == 0xE1) & (before == 0x9A)
        multi |= (first == 0xE2) & ((before == 0x80) | (before == 0x81)) | (first == 0xE3) & (before == 0x80)
        white &= (data < 128) | multi
    return white


def certain_cuts(data: np.ndarray, never: np.ndarray) -> np.ndarray:
    """Positions i > 0 at which the bytes may be cut without changing any id."""
    if len(data) < 2:
        return np.empty(0, np.int64)
    left, right = data[:-1], data[1:]
    cut = never[left.astype(np.int32) * 256 + right]
    cut &= (right & 0xC0) != 0x80
    cut &= right != 0x27
    cut &= ~_white_ends(data)[:-1]
    return np.flatnonzero(cut) + 1


class _Held(dict):
    """Fragment -> ids, filled on demand up to ``HELD`` entries."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, fragment: bytes) -> list[int]:
        ids = self.encoding.encode_ordinary(fragment.decode())
        if len(fragment) <= HELD_BYTES:
            if len(self) >= HELD:
                self.clear()
            self[fragment] = ids
        return ids


class FragmentEncoder:
    """Encodes UTF-8 buffers fragment by fragment."""

    def __init__(self, name: str = VOCABULARY, folder: str = TOKENIZERS):
        encoding, self.never = encoder(name, folder)
        self.held = _Held(encoding)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each; none for a null text."""
        texts = texts.cast(pa.large_binary())
        lengths = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
        joined = b"".join(x for x in texts.to_pylist() if x)
        ends = np.cumsum(lengths)
        data = np.frombuffer(joined, np.uint8)
        # a text's own ends are cuts as well
        bounds = np.unique(np.r_[0, certain_cuts(data, self.never), ends]).tolist()
        held = self.held
        pieces = [held[joined[begin:end]] for begin, end in pairwise(bounds)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = np.r_[0, np.cumsum(sizes)]
        upto = total[np.searchsorted(np.asarray(bounds), ends)] if len(ends) else np.empty(0, np.int64)
        ids = np.fromiter(chain.from_iterable(pieces), np.int32, int(total[-1]))
        return ids, np.diff(np.r_[0, upto])


def _encode(column: str, ids_out: str, keep: list[str], counts: bool, name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = FragmentEncoder(name, folder)
        for batch in batches:
            parts = []
            for begin, length in _slices(batch.column(column)):
                ids, sizes = encode.batch(batch.column(column).slice(begin, length))
                if counts:
                    parts.append(pa.array(sizes))
                else:
                    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                    parts.append(pa.ListArray.from_arrays(offsets, pa.array(ids)))
            made = pa.concat_arrays(parts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], names=[*keep, ids_out])

    return run


def _slices(texts: pa.Array, most: int = 8 << 20) -> list[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, so that a batch of very long texts is worked off in parts."""
    lengths = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
    group = np.cumsum(lengths) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.array([0])
    return [(int(a), int(b - a)) for a, b in zip(starts, np.r_[starts[1:], len(texts)], strict=True)]


def token_ids(
    df: DataFrame, key: str, text: str, ids: str = "ids", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS
) -> DataFrame:
    """``key`` and the token ids of ``text``, exactly as stored, without special tokens.

    A null or empty text has an empty list. Every row gives one row, repeated keys included; other columns are not
    read. Texts are worked through as a whole whatever their length.
    """
    run = _encode(text, ids, [key], False, vocabulary, folder)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def token_counts(
    df: DataFrame, keep: list[str], text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS
) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text``, 0 for a null or empty one; a row for every row."""
    run = _encode(text, out, keep, True, vocabulary, folder)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{kinds}, `{out}` long")
