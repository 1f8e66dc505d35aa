"""Packing by power-of-two decomposition.

A document's token ids (with a closing id 0) are cut into pieces of 1024 and, for the rest, the powers
of two of its binary form, largest first. Each piece is a sequence of its own, so that no sequence
crosses documents and none needs padding; sequences of equal length share a bucket, which the last four
bits of sequence_id name (log2 of the length). One scan, no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..shipping import ship
from . import _text

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pre-tokens whose ids a worker remembers, by a 64-bit hash; the memory is emptied when it is full.
REMEMBERED = 700_000
#: Classes of characters for the byte-level pre-tokenizer's split: letters, numbers, marks, the space, other white space.
_LETTER, _DIGIT, _MARK, _SPACE, _WHITE = range(5)
_CLASS = np.full(256, _MARK, np.int8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCB)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[32] = _SPACE
_CLASS[[9, 10, 13]] = _WHITE
#: Second bytes after 0xC2 that are letters and numbers, and after 0xC3 that are marks (fixed values of Latin-1).
_C2_LETTERS, _C2_DIGITS, _C3_MARKS = (0xAA, 0xB5, 0xBA), (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE), (0x97, 0xB7)
_C2 = np.full(256, _MARK, np.int8)
_C2[list(_C2_LETTERS)] = _LETTER
_C2[list(_C2_DIGITS)] = _DIGIT
#: Endings that a lone apostrophe takes along.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _foreign(data: np.ndarray) -> np.ndarray:
    """Places of bytes beyond white space, printable ASCII and U+00A1 to U+02AF: only there do Unicode versions split alike."""
    odd = (data < 32) & (_CLASS[data] != _WHITE) | (data == 127) | (data > 0xCA)
    odd[1:] |= (data[:-1] == 0xC2) & (data[1:] < 0xA1)
    odd[1:] |= (data[:-1] == 0xCA) & (data[1:] > 0xAF)
    return np.flatnonzero(odd)


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts without foreign bytes: runs of letters, numbers or marks, each with one space before it,
    an apostrophe with its ending, and the white space between; each text is tiled by them."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC2)
    kind[lead] = _C2[data[lead + 1]]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    kind[lead[np.isin(data[lead + 1], _C3_MARKS)]] = _MARK
    tail = np.flatnonzero((data & 0xC0) == 0x80)
    kind[tail] = kind[tail - 1]
    blank = kind >= _SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    merged = np.where(blank, _SPACE, kind)
    edge[1:-1] |= merged[1:] != merged[:-1]
    first = np.flatnonzero(edge[:-1])
    last = np.append(first[1:], len(data))  # ends of the runs
    closing = np.zeros(len(data) + 1, bool)
    closing[offsets] = True
    white = blank[first]
    start = np.zeros(len(data) + 1, bool)
    # a run of white space gives its last character away, to the next token if it is a space; not so at the end of a text
    inner = white & ~closing[last]
    start[last[inner] - 1] = True
    start[first[white & (closing[last] | (last - first > 1))]] = True
    opening = np.zeros(len(data) + 1, bool)
    opening[offsets] = True
    words = first[~white]
    start[words[opening[words] | (kind[words - 1] != _SPACE)]] = True
    # a lone apostrophe that begins a token, before letters
    alone = first[~white & (last - first == 1) & ~closing[last]]
    alone = alone[(data[alone] == 39) & start[alone] & (kind[np.minimum(alone + 1, len(data) - 1)] == _LETTER)]
    for p in alone.tolist():
        for ending in _ENDINGS:
            end = p + 1 + len(ending)
            if end <= len(data) and data[p + 1 : end].tobytes() == ending and not closing[p + 1 : end].any():
                start[p + 1] = False
                if not closing[end] and kind[end] == _LETTER:
                    start[end] = True
                break
    return np.flatnonzero(start[:-1])


class CachedTokenizer:
    """Token ids as little-endian uint32 bytes; each distinct pre-token is given to the tokenizer once while it is remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: strings that are tokens of their own wherever they stand: a text that holds one is not split here
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[int, bytes] = {}

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, keys: list[int], starts: np.ndarray, ends: np.ndarray, raw: bytes) -> list[bytes]:
        """Ids of distinct pre-tokens."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = list(map(self.known.get, keys))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            words = [raw[starts[i] : ends[i]].decode() for i in new]
            coded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(coded.word_ids), np.arange(len(new) + 1))).tolist()
            for k, i in enumerate(new):
                found[i] = self.known[keys[i]] = ids[cuts[k] : cuts[k + 1]]
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text of a buffer."""
        n = len(offsets) - 1
        raw = data.tobytes()
        at = np.concatenate([_foreign(data), np.array([m.start() for x in self.added for m in re.finditer(re.escape(x), raw)], np.int64)])
        whole = set((np.searchsorted(offsets, at, "right") - 1).tolist())
        if whole:
            keep = [r for r in range(n) if r not in whole]
            data = np.concatenate([np.zeros(0, np.uint8), *(data[offsets[r] : offsets[r + 1]] for r in keep)])
            plain, bounds = data.tobytes(), np.concatenate([[0], np.cumsum([offsets[r + 1] - offsets[r] for r in keep])]).astype(np.int64)
        else:
            plain, bounds = raw, offsets
        starts = pre_tokens(data, bounds)
        ends = np.append(starts[1:], len(data))
        hashes, place, back = np.unique(_text.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        parts = self._ids(hashes.tolist(), starts[place], ends[place], plain)
        table = np.frombuffer(b"".join(parts), "<u4")
        size = np.array([len(x) // 4 for x in parts], np.int64)
        begin = (np.cumsum(size) - size)[back]
        size = size[back]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = table[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        cut = upto[np.searchsorted(starts, bounds)].tolist()
        found = (ids[a:b].tobytes() for a, b in zip(cut, cut[1:]))
        return [self._whole(raw[offsets[r] : offsets[r + 1]]) if r in whole else next(found) for r in range(n)]


def piece_lengths(n: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the powers of two of the rest, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, longest: int, chunk: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    tokenizer = CachedTokenizer(path)
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    sequences = 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        data, offsets = _text.utf8(batch.column(1))
        for lo, hi in _text.blocks(offsets, chunk):
            texts = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            rows: list[tuple] = []
            for doc, raw in zip(ids[lo:hi], tokenizer.encode(*texts)):
                raw += b"\0\0\0\0"
                start, total = 0, len(raw) // 4
                for n in piece_lengths(total, longest):
                    sequence = task << 40 | sequences << 4 | n.bit_length() - 1
                    rows.append((doc, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total, sequence, 0))
                    sequences += 1
                    start += n
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    tokenizer.known.clear()
    _text.release()


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 1024) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs needs doc_id and text; other columns are ignored. A null or empty text is the closing id alone,
    one piece of length 1. A null doc_id stays null. Repeated rows are packed each for itself: sequence_id
    counts within the input partition (its number in the high bits), so it is unique whatever the ids are.
    ``longest`` must be a power of two up to 2**15. An empty table gives no pieces.
    """
    if longest & (longest - 1) or not 0 < longest <= 1 << 15:
        raise ValueError("longest must be a power of two")
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_pieces, path=tokenizer_path, longest=longest), SCHEMA)
