"""Pre-token splitting of whole texts, vectorised over Arrow buffers.

``split_batch`` cuts a string array at the matches of the published byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

with numpy masks over code points instead of a regex engine, and ``dictionary`` keeps the distinct
words of a chunk with the chunk's word codes, so that a tokenizer sees every distinct word once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
SLICE_BYTES = 1 << 19
PART_BYTES = 2 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, from the Unicode tables of the regex library."""
    import regex

    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            a, b = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            out[a : b + 1] = cls
    # Python's \s also takes the four information separators, which are not White_Space.
    out[0x1C:0x20] = OTHER
    out[0xD800:0xE000] = OTHER
    return out


def split_bytes(data: bytes, doc_starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which a word starts in ``data`` (valid UTF-8); no word crosses ``doc_starts``."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(at) == len(raw):
        points = raw
    else:
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    cls = _classes()[points]
    n = len(cls)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, doc_starts) if len(at) < len(raw) else doc_starts] = True
    first = first[:n]
    first[0] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start |= first
    cut = start.copy()
    space = cls == SPACE
    # the last blank before a word belongs to the word if it is U+0020, else stands alone
    led = np.flatnonzero(start[1:] & ~first[1:] & ~space[1:] & space[:-1]) + 1
    cut[led - 1] = True
    attached = led[points[led - 1] == 0x20]
    cut[attached] = False
    # contractions: a lone apostrophe that starts a word, followed by s t m d re ve ll
    apostrophe = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & cut[:-1] & start[1:] & ~first[1:] & (cls[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
    if len(apostrophe):
        one = points[apostrophe + 1]
        later = np.minimum(apostrophe + 2, n - 1)
        two = np.where((apostrophe + 2 < n) & ~first[later], points[later], 0)
        size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 3, size)
        hit = size > 0
        where, size = apostrophe[hit], size[hit]
        cut[where + 1] = False
        ends = where + size
        cut[ends[ends < n]] = True
    return at[cut]


def _added_spans(data: bytes, bounds: np.ndarray, added: re.Pattern[bytes]) -> np.ndarray:
    """(begin, end) rows of the added tokens in ``data``, none of them across ``bounds``."""
    if not added.search(data):
        return np.zeros((0, 2), np.int64)
    return np.array([m.span() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for m in added.finditer(data, a, b)], np.int64).reshape(-1, 2)


def split_batch(texts: pa.Array, added: re.Pattern[bytes] | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of a string array in order, as binary, and the number of words of each text (null: none).

    A match of ``added`` is one word, and the text before and after it is split by itself.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data is not None else b""
    offsets = offsets - offsets[0]
    pieces, doc = [], 0
    while doc < len(texts):  # about a megabyte at a time, so that the masks stay in cache
        stop = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + SLICE_BYTES, "right")) - 1)
        base = offsets[doc]
        piece, begins = data[base : offsets[stop]], np.unique(offsets[doc:stop]) - base
        spans = _added_spans(piece, offsets[doc : stop + 1] - base, added) if added else ()
        if len(spans):
            found = split_bytes(piece, np.union1d(begins, spans[spans < len(piece)]))
            inside = np.searchsorted(spans[:, 0], found) - 1  # the last token that begins before the word
            pieces.append(base + found[(inside < 0) | (found >= spans[inside, 1])])
        else:
            pieces.append(base + split_bytes(piece, begins))
        doc = stop
    begins = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(begins, offsets))
    ends = np.append(begins, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return words, counts


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array with about ``PART_BYTES`` of text each, one row at least."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
    ends = np.cumsum(sizes)
    row, done = 0, 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, done + PART_BYTES, "right")))
        yield row, stop
        row, done = stop, int(ends[stop - 1])


def chunks(batches: Iterable[pa.RecordBatch], id_col: str, text_col: str, chunk_bytes: int, added: re.Pattern[bytes] | None = None) -> Iterator[dict]:
    """Groups incoming batches up to ``chunk_bytes`` of text.

    Yields ids (Arrow), counts (words of each document), words (distinct, binary) and codes (one a word).
    Words are kept as codes part by part, so a chunk's memory is its codes and the parts' distinct words.
    """
    held: list[tuple[pa.Array, pa.DictionaryArray, np.ndarray]] = []
    size = 0

    def flush() -> dict:
        words = pa.chunked_array([w for _, w, _ in held]).unify_dictionaries()
        return {
            "ids": pa.concat_arrays([i for i, _, _ in held]),
            "counts": np.concatenate([c for _, _, c in held]),
            "words": words.chunk(0).dictionary,
            "codes": np.concatenate([c.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False) for c in words.chunks]),
        }

    for batch in batches:
        ids, texts = batch.column(batch.schema.get_field_index(id_col)), batch.column(batch.schema.get_field_index(text_col))
        for row, stop in _parts(texts):
            part = texts.slice(row, stop - row)
            words, counts = split_batch(part, added)
            held.append((ids.slice(row, stop - row), words.dictionary_encode(), counts))
            size += len(words.buffers()[2] or b"")
            if size >= chunk_bytes:
                yield flush()
                held, size = [], 0
                give_back()
    if held:
        yield flush()


def lay_out(counts: np.ndarray, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, flat: np.ndarray, words: int = 700_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word ids along the documents, ``words`` words at a time.

    Word w has the ids ``flat[starts[w] : starts[w] + lens[w]]``. Yields (first document, end document,
    ends of the documents within the values, values).
    """
    word_ends = np.cumsum(counts, dtype=np.int64)
    doc, word = 0, 0
    while doc < len(counts):
        stop = max(doc + 1, int(np.searchsorted(word_ends, word + words, "right")))
        part = codes[word : word_ends[stop - 1]]
        n = lens[part]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts[part] - (ends - n), n) + np.arange(total)
        yield doc, stop, np.concatenate([[0], ends])[word_ends[doc:stop] - word], flat[where]
        doc, word = stop, int(word_ends[stop - 1])
