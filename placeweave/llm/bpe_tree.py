"""Byte-level BPE by monoid tree reduction.

A text is cut in halves down to leaves; a leaf is split by the pre-token pattern and
its pieces are merged lowest rank first. Two neighbours are joined by re-encoding a
window around the seam that grows until what lies outside it provably cannot change:

* pattern level: a match that ends two or more characters before its half's end never
  looks past that end (the pattern's longest look-ahead is two characters), and a scan
  that reaches a position where the right half also starts a match goes on as there;
* merge level: a sequence of tokens is the encoding of its bytes exactly when each
  adjacent pair is the encoding of that pair's bytes, so only the two pairs at the
  window's edges have to be tested.

Decoding maps ids to bytes and concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, with_key

#: Characters of a leaf of the text tree, and bytes of a leaf of the tree inside one piece.
LEAF_CHARS = 4096
LEAF_BYTES = 8
#: Entries of each of the two generations of a worker's piece cache.
CACHE_PIECES = 250_000
#: Longest piece or segment that is kept, in characters.
LONG = 40
#: Longest window whose encoding is kept.
MERGE_SCAN = 16
#: No match of the pre-token pattern depends on more characters than this after its end.
LOOK_AHEAD = 2

_DOUBLE_SPACE = re.compile(r" \s|\s ").search


class TreeBpe:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks = ranks
        self.leaf_chars, self.leaf_bytes = max(4, leaf_chars), max(2, leaf_bytes)
        # white space is the Unicode property, as in the library's own pattern engine
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        top = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(top)]
        self._new: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._windows: dict[bytes, tuple[int, ...]] = {}

    # -- merge level -----------------------------------------------------------
    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost at a tie. Leaves and windows are short and recur, so they are kept."""
        if (known := self._windows.get(piece)) is not None:
            return known
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 4 * MERGE_SCAN:
            return self._merge_long(piece)
        known = self._merge_short(piece)
        if len(piece) <= MERGE_SCAN:
            if len(self._windows) >= CACHE_PIECES:
                self._windows.clear()
            self._windows[piece] = known
        return known

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(piece) - 1)]
        while scores:
            low = min(scores)
            if low == 1 << 30:
                break
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap over a linked list, for windows beyond a leaf."""
        ranks, n = self.ranks, len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or end[i] != mid or j >= n or end[j] != stop:
                continue
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], i, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes."""
        if (known := self._pairs.get((a, b))) is None:
            if len(self._pairs) > CACHE_PIECES:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the concatenated bytes of two encodings."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j])))
            loose_left = i < len(left) and not self.fits(left[-i - 1], window[0])
            loose_right = j < len(right) and not self.fits(window[-1], right[j])
            if not (loose_left or loose_right):
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 + loose_left), j * (1 + loose_right)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) <= self.leaf_bytes:
            return self.merge(piece)
        half = -(-len(piece) // (2 * self.leaf_bytes)) * self.leaf_bytes  # whole leaves on the left: runs stay in step
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def code_piece(self, piece: str) -> tuple[int, ...]:
        """Code of one match of the pattern."""
        if (got := self._pieces.get(piece)) is None:
            got = self.encode_piece(piece.encode("utf-8", "replace"))
            if len(piece) <= LONG:
                if len(self._pieces) >= CACHE_PIECES:
                    self._pieces.clear()
                self._pieces[piece] = got
        return got

    def code(self, segment: str) -> tuple[int, ...]:
        """Code of one or more whole matches."""
        if (got := self._new.get(segment)) is None:
            got = self._old.get(segment) or tuple(chain.from_iterable(map(self.code_piece, self.find(segment))))
            if len(segment) <= LONG:
                if len(self._new) >= CACHE_PIECES:
                    self._old, self._new = self._new, {}
                self._new[segment] = got
        return got

    # -- pattern level ---------------------------------------------------------
    def split(self, text: str) -> list[str]:
        """Runs of whole matches. A match never goes on from a visible character to a space, so where
        each space stands alone between two visible characters the text is cut before each of them;
        elsewhere the pattern is run."""
        if _DOUBLE_SPACE(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def _tree(self, text: str) -> tuple[list[str], list[tuple[int, ...]]]:
        """Segments of a text and their codes."""
        if len(text) <= self.leaf_chars:
            segments = self.split(text)
            return segments, list(map(self.code, segments))
        half = len(text) // 2
        return self._join_texts(self._tree(text[:half]), self._tree(text[half:]))

    def _join_texts(self, left, right):
        pieces, codes = left
        others, their_codes = right
        tail, k = 0, len(pieces)
        while k and tail < LOOK_AHEAD:  # matches that may have looked past the seam
            k -= 1
            tail += len(pieces[k])
        seam = "".join(pieces[k:])
        taken = 2
        while True:
            taken = min(taken, len(others))
            window = seam + "".join(others[:taken])
            stable = len(window) - (0 if taken == len(others) else LOOK_AHEAD)
            starts, at = {}, len(seam)
            for m in range(taken + 1):
                starts[at] = m
                if m < taken:
                    at += len(others[m])
            fresh, at = [], 0
            for piece in self.split(window):
                if at in starts and at <= stable:
                    break
                fresh.append(piece)
                at += len(piece)
                if at > stable:
                    break
            if at in starts and at <= stable:
                m = starts[at]
                return pieces[:k] + fresh + others[m:], codes[:k] + list(map(self.code, fresh)) + their_codes[m:]
            taken *= 2

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._tree(text)[1]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def id_text(self, ids: list[int]) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> TreeBpe:
    return TreeBpe(load_ranks(path), pattern)


def _encoded(key: str, path: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        for pdf in batches:
            for at in range(0, len(pdf), 256):  # bounded output batches
                part = pdf.iloc[at : at + 256]
                yield pd.DataFrame({key: part[key], "ids": [bpe.encode(t) for t in part["text"]]})

    return run


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key, ids array<int>`` of each row's whole ``text``; null and empty texts give an
    empty array, repeated rows and null keys are kept, other columns are left out."""
    return with_key(keyed_texts(df, key).mapInPandas(_encoded(key, path, pattern), f"`{key}` string, ids array<int>"), df, key)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key, data binary`` of each row's ``ids``; a null array counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "data": [bpe.decode([] if x is None else [int(i) for i in x]) for x in pdf["ids"]]})

    own = df.select(F.col(key).cast("string").alias(key), "ids")
    return with_key(own.mapInPandas(run, f"`{key}` string, data binary"), df, key)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass: ``key, n_tokens, ids_sha256, decoded_sha256``. The ids
    never leave the task, so nothing but the digests is written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                ids = bpe.encode(text)
                rows.append((len(ids), hashlib.sha256(bpe.id_text(ids).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, key, pdf[key].array)
            yield out

    return with_key(keyed_texts(df, key).mapInPandas(run, f"`{key}` string, n_tokens long, ids_sha256 string, decoded_sha256 string"), df, key)


def op2_bpe_tree(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
