"""Byte-level BPE by ranks: encoding over padded numpy matrices, and decoding.

A text is cut by the tokenizer's pattern; the distinct pieces that a worker has not met yet are gathered, dealt into
buckets by byte length and laid out as the rows of a padded matrix. Each round finds the leftmost pair of lowest rank in
every row at once, merges it, and closes the gap; finished rows leave the matrix. Ranks of pairs come from an
open-addressing hash table in three numpy arrays, so a round looks up only the two pairs that a merge has changed.

Rows longer than ``LONG`` bytes would cost their length per merge. They go through rounds of their own that merge all
occurrences of the lowest-ranked pair, left to right, in one step. That is the same result where every token's bytes merge
into that token: a merge then never opens a pair of lower rank than its own. This is tested once per vocabulary; where it
does not hold, long rows take the rounds of the short ones.

Cases: null text is empty; an empty text has no tokens; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from .arrow import id_field, keyed_text, map_rows, vocabulary_path

NONE = np.uint32(0xFFFFFFFF)
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256, 1024)
LONG = BUCKETS[-1]
CELLS = 1 << 21
CACHED_PIECES = 400_000
PENDING_PIECES = 50_000
PENDING_BYTES = 8 << 20


class Ranks:
    """Tokens of a rank file, and the hash table from a pair of ids to the id of their merge."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary needs all 256 single bytes")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self._table(np.array(left, np.uint64), np.array(right, np.uint64), np.array(merged, np.uint32))

    def _table(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        keys = left << np.uint64(32) | right
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.uint32)
        self.probes, rest, values = 0, keys, merged
        while len(rest):  # linear probing, a step for all keys at a time
            slot = self._slot(rest, self.probes)
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            slots, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = rest[chosen], values[chosen]
            left_over = np.ones(len(rest), bool)
            left_over[chosen] = False
            rest, values = rest[left_over], values[left_over]
            self.probes += 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)) + np.uint64(step)).astype(np.int64) & ((1 << self.bits) - 1)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id (which is the rank) of the merge of each pair, or NONE; NONE on either side has no merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(keys.shape, NONE, np.uint32)
        open_ = np.arange(keys.size)
        flat_keys, flat_out = keys.ravel(), out.ravel()
        for step in range(self.probes):
            slot = self._slot(flat_keys[open_], step)
            there = self.keys[slot]
            hit = there == flat_keys[open_]
            flat_out[open_[hit]] = self.values[slot[hit]]
            open_ = open_[~hit & (there != np.uint64(0xFFFFFFFFFFFFFFFF))]
            if not len(open_):
                break
        return out

    @functools.cached_property
    def ordered(self) -> bool:
        """Whether every token's bytes merge into that token, so that no merge can open a pair of lower rank than its own."""
        several = [t for t in self.ranks if 1 < len(t) <= LONG]
        widest = max(map(len, several), default=2)
        return all(ids == self.ranks[t].to_bytes(4, "little")
                   for start in range(0, len(several), 10_000)
                   for t, ids in zip(several[start:start + 10_000], self._encode_rows(several[start:start + 10_000], widest)))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[i] = self._encode_long(piece)
            elif piece:
                buckets.setdefault(next(b for b in BUCKETS if len(piece) <= b), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for start in range(0, len(rows), step):
                part = rows[start:start + step]
                for i, ids in zip(part, self._encode_rows([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _encode_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        count = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        ids = self.of_byte[raw]
        columns = np.arange(width)
        ids[columns[None, :] >= lengths[:, None]] = NONE
        ranks = np.full((count, width), NONE, np.uint32)  # ranks[r, c]: of the pair at c and c + 1
        ranks[:, :-1] = self.merge_of(ids[:, :-1], ids[:, 1:])
        out, alive = [b""] * count, np.arange(count)
        while len(alive):
            at = ranks.argmin(axis=1)  # the first of equal ranks is the leftmost
            rows = np.arange(len(alive))
            best = ranks[rows, at]
            done = best == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[alive[r]] = ids[r, :lengths[r]].astype("<u4").tobytes()
                keep = ~done
                alive, ids, ranks, lengths, at, best = alive[keep], ids[keep], ranks[keep], lengths[keep], at[keep], best[keep]
                rows = np.arange(len(alive))
                if not len(alive):
                    break
            ids[rows, at] = best
            behind = columns[None, :-1] > at[:, None]  # close the gap behind the merged pair
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            ids[:, -1] = ranks[:, -1] = NONE
            lengths = lengths - 1
            following = ids[rows, np.minimum(at + 1, width - 1)]
            following[at + 1 >= width] = NONE
            ranks[rows, at] = self.merge_of(best, following)
            inner = at > 0
            ranks[rows[inner], at[inner] - 1] = self.merge_of(ids[rows[inner], at[inner] - 1], best[inner])
            widest = int(lengths.max())
            if widest * 2 <= width and width > 4:  # all rows have shrunk: narrow the matrix
                width = max(4, widest)
                ids, ranks, columns = ids[:, :width].copy(), ranks[:, :width].copy(), columns[:width]
        return out

    def _encode_long(self, piece: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        if not self.ordered:
            return b"".join(self._encode_rows([piece], len(piece)))
        ranks = self.merge_of(ids[:-1], ids[1:])
        while len(ids) > 1 and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # overlapping occurrences: in a run of neighbours the first, third, ... are merged
            new_run = np.concatenate(([True], np.diff(at) > 1))
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            ranks = self.merge_of(ids[:-1], ids[1:])
        return ids.astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=4)
def load(name: str) -> Ranks:
    return Ranks(vocabulary_path(name))


@functools.lru_cache(maxsize=4)
def cache_of(name: str, pattern: str) -> dict[str, bytes]:
    """Pieces that this worker has encoded; emptied when full, which costs time only."""
    return {}


def encode_rows(rows: Iterable[tuple], name: str, pattern: str) -> Iterator[tuple]:
    """(id, ids as little-endian uint32) for (id, UTF-8 text)."""
    import regex

    cut, vocabulary, cache = regex.compile(pattern).findall, load(name), cache_of(name, pattern)
    held: list[tuple] = []
    fresh: dict[str, None] = {}
    pending = 0

    def flush():
        new = list(fresh)
        cache.update(zip(new, vocabulary.encode_pieces([p.encode() for p in new])))
        for key, pieces in held:
            yield key, b"".join(map(cache.__getitem__, pieces))
        held.clear()
        fresh.clear()
        if len(cache) > CACHED_PIECES:
            cache.clear()

    for key, text in rows:
        pieces = cut(text.decode())
        held.append((key, pieces))
        fresh.update((p, None) for p in pieces if p not in cache)
        pending += len(text)
        if len(fresh) >= PENDING_PIECES or pending >= PENDING_BYTES:
            yield from flush()
            pending = 0
    yield from flush()


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str | None = None) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``token_ids`` (little-endian unsigned 32-bit) of every text. No special tokens."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    def run(rows):
        for key, ids in encode_rows(rows, vocabulary, pattern):
            yield key, len(ids) // 4, ids

    fields = [id_field(df, id_col), StructField("n_tokens", LongType()), StructField("token_ids", BinaryType())]
    return map_rows(keyed_text(df, id_col, text_col), fields, run, lambda row: len(row[2]))


def decode(df: DataFrame, id_col: str, ids_col: str, vocabulary: str) -> DataFrame:
    """``id_col`` and ``decoded``, the bytes that the ids stand for (null: empty)."""

    def run(rows):
        tokens = load(vocabulary)
        for key, ids in rows:
            yield key, tokens.decode(ids or b"")

    fields = [id_field(df, id_col), StructField("decoded", BinaryType())]
    return map_rows(df.select(id_col, ids_col), fields, run, lambda row: len(row[1]))


def round_trip(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str | None = None,
               ids: bool = False) -> DataFrame:
    """Encode, decode the ids again, and return digests: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (lower-case
    hex); with ``ids`` also ``token_ids``. Texts stay in the task: only digests leave it."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    def run(rows):
        tokens = load(vocabulary)
        for key, coded in encode_rows(rows, vocabulary, pattern):
            digests = hashlib.sha256(coded).hexdigest(), hashlib.sha256(tokens.decode(coded)).hexdigest()
            yield (key, len(coded) // 4, *digests, *([coded] if ids else []))

    fields = [id_field(df, id_col), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
              StructField("decoded_sha256", StringType())]
    fields += [StructField("token_ids", BinaryType())] if ids else []
    return map_rows(keyed_text(df, id_col, text_col), fields, run, lambda row: len(row[-1]))
