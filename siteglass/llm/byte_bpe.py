"""Byte-level BPE: encoding by padded numpy matrices, and decoding.

Text is cut by the tokenizer's pattern. The distinct pieces of a batch, less those a bounded cache knows, are put in
buckets by length; each bucket is a padded matrix of symbols in which every row merges its leftmost pair of least rank
in each round. Ranks of pairs come from an open-addressing hash table in numpy. Rows without a pair left are written out
and the matrix is compacted. A piece over ``LONG`` bytes is a matrix of one row, in which a round does at once all the
merges of the least rank, from left to right, that single merges would do one after the other: up to the first that makes
a pair of a lesser rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import BoundedCache, small_batches

LONG = 256
NONE = np.int64(1) << 40
CACHE = 150_000
OUT_BYTES = 8 << 20


class PairTable:
    """Rank of the merged token for a pair of ranks, by linear probing over whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (2 * len(pairs) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        todo = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self.slot(todo)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = todo[free]
            won = self.keys[at] == todo
            self.ranks[at[won]] = ranks[won]
            todo, ranks, at = todo[~won], ranks[~won], (at[~won] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE for those that don't merge; symbols below 0 are padding."""
        out = np.full(left.shape, NONE, np.int64)
        real = (left >= 0) & (right >= 0)
        keys = (left[real] << 32) | right[real]
        found, where, at = np.full(len(keys), NONE, np.int64), np.arange(len(keys)), self.slot(keys)
        while len(where):
            there = self.keys[at]
            hit = there == keys
            found[where[hit]] = self.ranks[at[hit]]
            on = ~hit & (there != -1)
            where, keys, at = where[on], keys[on], (at[on] + 1) & self.mask
        out[real] = found
        return out


class ByteBpe:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.table = PairTable(pairs)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.cache = BoundedCache(CACHE)

    def merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as packed little-endian unsigned 32-bit integers."""
        width = max(map(len, pieces))
        sizes = np.array([len(p) for p in pieces])
        inside = np.arange(width) < sizes[:, None]
        m = np.full(inside.shape, -1, np.int64)
        m[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[bytes] = [b""] * len(pieces)
        rows, ranks = np.arange(len(pieces)), self.table.find(m[:, :-1], m[:, 1:])
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = best >= NONE
            if done.any():
                ended, lens = m[done], (m[done] >= 0).sum(1)
                packed = ended[ended >= 0].astype("<u4").tobytes()
                ends = np.cumsum(lens) * 4
                for row, a, b in zip(rows[done].tolist(), (ends - lens * 4).tolist(), ends.tolist(), strict=True):
                    out[row] = packed[a:b]
                m, ranks, rows, at, best = m[~done], ranks[~done], rows[~done], at[~done], best[~done]
                if not len(rows):
                    break
            n, width = m.shape
            line = np.arange(n)
            m[line, at] = best
            take = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            m = np.take_along_axis(m, take, 1)
            if width > 2:
                take = np.arange(width - 2) + (np.arange(width - 2) >= at[:, None])
                ranks = np.take_along_axis(ranks, take, 1)
                inner = at < width - 2
                ranks[line[inner], at[inner]] = self.table.find(m[line[inner], at[inner]], m[line[inner], at[inner] + 1])
                inner = at > 0
                ranks[line[inner], at[inner] - 1] = self.table.find(m[line[inner], at[inner] - 1], m[line[inner], at[inner]])
            else:
                ranks = np.empty((n, 0), np.int64)
            used = int((m >= 0).sum(1).max())
            m, ranks = m[:, :used], ranks[:, : max(used - 1, 0)]
        return out

    def merge_row(self, piece: bytes) -> bytes:
        """The same for one long piece: a round does all merges of the least rank, of overlapping ones the left."""
        m = self.byte[np.frombuffer(piece, np.uint8)]
        ranks = self.table.find(m[:-1], m[1:])
        while len(ranks) and (best := ranks.min()) < NONE:
            at = np.flatnonzero(ranks == best)
            opens = np.concatenate([[True], np.diff(at) > 1])
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
            ends = np.concatenate([[-1], m, [-1]])
            left = np.where(np.diff(at, prepend=-3) == 2, best, ends[at])
            made = np.full(len(at), best)
            less = (self.table.find(left, made) < best) | (self.table.find(made, ends[at + 3]) < best)
            if less.any():
                at = at[: less.argmax() + 1]
            m[at] = best
            gone = np.zeros(len(m), bool)
            gone[at + 1] = True
            m, ranks = m[~gone], ranks[~gone[:-1]][: len(m) - len(at) - 1]
            at = at - np.arange(len(at))
            near = np.unique(np.concatenate([at - 1, at]))
            near = near[(near >= 0) & (near < len(m) - 1)]
            ranks[near] = self.table.find(m[near], m[near + 1])
        return m.astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        out, buckets = {}, {}
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                out[piece] = self.merge_row(raw)
            else:
                buckets.setdefault((len(raw) + 3) // 4, []).append((piece, raw))
        for rows in buckets.values():
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                out.update(zip((p for p, _ in part), self.merge_matrix([r for _, r in part]), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null counts as empty."""
        cut = [self.split(t) if t else [] for t in texts]
        self.cache.make_room()
        fresh = {p for pieces in cut for p in pieces if p not in self.cache}
        if fresh:
            found = self.encode_pieces(list(fresh))
            self.cache.keep(list(found), found.values())
        known = self.cache.__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def groups_by_bytes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes together, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Rows (id, n_tokens, ids) and, if asked, decoded: the bytes that the ids give back.

    ids is binary, little-endian unsigned 32-bit integers. Null and empty texts have no tokens. Every row gives one row,
    repeated rows too; other columns are not carried, so their names can't clash. ``path`` must exist on executors.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in groups_by_bytes(sizes, OUT_BYTES):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                packed = bpe.encode(texts)
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_tokens", "ids", *["decoded"] * decoded]
    schema = f"`{id_col}` {id_type}, n_tokens long, ids binary" + ", decoded binary" * decoded
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the ids and of the bytes decoded from them."""
    return encode(docs, path, pattern, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
