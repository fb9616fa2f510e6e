"""Numpy helpers that run inside tasks: whitespace pieces of UTF-8 buffers, 64-bit hashes, memoised token encoding.

All work on one Arrow batch at a time, cut into slices of whole documents of about ``SLICE`` bytes, so that memory follows
the slice (or the longest single document), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TAIL = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], np.uint64)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive documents; null counts as empty. Bytes are followed by eight spare zeros."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        part = np.zeros(offsets[to] - offsets[at] + 8, np.uint8)
        part[:-8] = data[offsets[at]:offsets[to]]
        yield at, part, offsets[at:to + 1] - offsets[at]
        at = to


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every run of bytes other than ASCII white space."""
    n = int(offsets[-1])
    solid = ~WHITE[buf[:n]]
    if not n:
        return (np.zeros(0, np.int64),) * 3
    left, right = np.empty(n, bool), np.empty(n, bool)
    left[0] = right[-1] = True
    left[1:], right[:-1] = ~solid[:-1], ~solid[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    left[inner] = True
    right[inner - 1] = True
    starts, ends = np.flatnonzero(solid & left), np.flatnonzero(solid & right) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: ASCII letters 1, other ASCII 2, white space 0; the apostrophe and bytes beyond ASCII 3.
KIND = np.full(256, 3, np.uint8)
KIND[:128] = 2
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[WHITE] = 0
KIND[39] = 3


def chunks_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of chunks that cover all bytes; a chunk begins where white space begins after other bytes, or
    where an ASCII letter meets other ASCII that is neither white space nor an apostrophe."""
    n = int(offsets[-1])
    if not n:
        return (np.zeros(0, np.int64),) * 3
    kind = KIND[buf[:n]]
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = (kind[1:] == 0) & (kind[:-1] != 0) | (kind[1:] ^ kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0)
    begin[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n), np.searchsorted(offsets, starts, side="right") - 1


def solid_chunks_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As chunks_of, without the white space."""
    n = int(offsets[-1])
    if not n:
        return (np.zeros(0, np.int64),) * 3
    kind = KIND[buf[:n]]
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = (kind[1:] == 0) != (kind[:-1] == 0)
    begin[1:] |= (kind[1:] ^ kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0)
    begin[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    solid = kind[starts] != 0
    return starts[solid], ends[solid], np.searchsorted(offsets, starts[solid], side="right") - 1


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes a step. ``buf`` needs eight spare bytes at its end."""
    view = np.lib.stride_tricks.as_strided(buf.view(np.uint8), (len(buf) - 7, 8), (1, 1))
    left = ends - starts
    h = mix(left.astype(np.uint64) * _M3)
    at, rows = starts, None
    while True:
        take = np.minimum(left, 8)
        block = np.ascontiguousarray(view[at]).view(np.uint64).ravel() & _TAIL[take]
        if rows is None:
            h = mix((h ^ block) * _M3)
        else:
            h[rows] = mix((h[rows] ^ block) * _M3)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8


def shingle_hashes(word_hash: np.ndarray, docs: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every window of ``k`` words; a document of fewer words gives its whole sequence as one."""
    if not len(word_hash):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(docs, minlength=n_docs)
    n = len(word_hash)
    out = np.full(max(0, n - k + 1), np.uint64(k), np.uint64)
    for j in range(k):
        out = mix((out ^ word_hash[j:n - k + 1 + j]) * _M3)
    whole = docs[:n - k + 1] == docs[k - 1:] if n >= k else np.zeros(0, bool)
    hashes, owner = out[whole], docs[:max(0, n - k + 1)][whole]
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        first, extra = np.searchsorted(docs, few), np.empty(len(few), np.uint64)
        for i, (d, a) in enumerate(zip(few, first)):
            h = np.full(1, np.uint64(counts[d]), np.uint64)
            for j in range(counts[d]):
                h = mix((h ^ word_hash[a + j:a + j + 1]) * _M3)
            extra[i] = h[0]
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(shift, lengths) + np.arange(total)


class ChunkEncoder:
    """Token ids of whole texts by a public tokenizer file; every distinct chunk is encoded once and remembered.

    Chunks end at places that the pre-tokenizers of these files never bridge. Texts with white space outside ASCII or with
    special-token strings are encoded as a whole. ``joined``: white space counts, as for byte-level files; otherwise the file drops
    it and lowers case. Memory: ``LIMIT`` chunks, then it starts anew.
    """

    LIMIT = 1_500_000

    def __init__(self, name: str, joined: bool):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.joined = joined
        self.clear()

    def clear(self) -> None:
        self.runs: list = []  # sorted keys with places in ids; each run is at least four times as long as the next
        self.ids, self.used, self.known = np.zeros(1 << 16, np.uint16), 0, 0

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Encode new chunks; keys are sorted and not yet known."""
        found = [self.tok.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False) for i in range(0, len(texts), 4096)]
        ids = [e.ids for part in found for e in part]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(length.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(max(self.used, total), np.uint16)])
        self.ids[self.used:self.used + total] = np.fromiter((x for part in ids for x in part), np.uint16, total)
        run = (keys, self.used + np.cumsum(length) - length, length)
        self.used += total
        self.known += len(keys)
        while self.runs and len(self.runs[-1][0]) < 4 * len(run[0]):
            other = self.runs.pop()
            order = np.argsort(merged := np.concatenate([other[0], run[0]]), kind="stable")
            run = (merged[order], np.concatenate([other[1], run[1]])[order], np.concatenate([other[2], run[2]])[order])
        self.runs.append(run)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and length of each known key; which are not known."""
        start, length, lost = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        for k, s, n in self.runs:
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            hit = k[at] == keys
            start[hit], length[hit] = s[at[hit]], n[at[hit]]
            lost &= ~hit
        return start, length, lost

    def spans(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length in ``self.ids`` of every chunk, and the chunk's document."""
        if self.joined:
            starts, ends, docs = chunks_of(buf, offsets)
        else:
            buf = LOWER[buf]
            starts, ends, docs = solid_chunks_of(buf, offsets)
        distinct, first, back = np.unique(span_hash(buf, starts, ends), return_index=True, return_inverse=True)
        start, length, lost = self.look(distinct)
        if lost.any():
            if self.known + int(lost.sum()) > self.LIMIT:  # the old ones go; those of this slice are needed again
                self.clear()
                lost[:] = True
            new, raw = np.flatnonzero(lost), buf.tobytes()
            self.learn(distinct[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            start, length, _ = self.look(distinct)
        return start[back], length[back], docs

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of its documents, number of ids of each document) for slices of the column."""
        for row, buf, offsets in text_slices(column):
            n = len(offsets) - 1
            odd = odd_documents(buf, offsets)
            start, length, docs = self.spans(buf, offsets)
            if odd.any():
                keep = ~odd[docs]
                start, length, docs = start[keep], length[keep], docs[keep]
            counts = np.bincount(docs, length, minlength=n).astype(np.int64)
            ids = self.ids[ragged(start, length)]
            if odd.any():
                cuts = np.concatenate([[0], np.cumsum(counts)])
                parts = [ids[cuts[d]:cuts[d + 1]] for d in range(n)]
                for d in np.flatnonzero(odd):
                    text = buf[offsets[d]:offsets[d + 1]].tobytes().decode()
                    parts[d] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint16)
                    counts[d] = len(parts[d])
                ids = np.concatenate(parts)
            yield row, ids, counts


def odd_documents(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents with white space beyond ASCII (or its control characters 28 to 31, 133) or with "<|"."""
    n, bad = int(offsets[-1]), np.zeros(len(offsets) - 1, bool)
    b = buf[:n]
    c, d = buf[1:n + 1], buf[2:n + 2]
    hit = (b == 60) & (c == 124) | (b >= 28) & (b <= 31)
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(b == lead)
        if len(at):
            x, y = c[at], d[at]
            if lead == 0xC2:
                odd = (x == 0x85) | (x == 0xA0)
            elif lead == 0xE1:
                odd = (x == 0x9A) | (x == 0xA0)
            elif lead == 0xE2:
                odd = (x == 0x80) & ((y <= 0x8D) | (y == 0xA8) | (y == 0xA9) | (y == 0xAF)) | (x == 0x81)
            else:
                odd = x == 0x80
            hit[at[odd]] = True
    bad[np.searchsorted(offsets, np.flatnonzero(hit), side="right") - 1] = True
    return bad


def encoder(name: str, joined: bool) -> ChunkEncoder:
    """This worker's encoder for a file, kept from task to task (functions travel by value, so the library's module holds it)."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_siteloom_encoders", {})
    if name not in held:
        held[name] = ChunkEncoder(name, joined)
    return held[name]
