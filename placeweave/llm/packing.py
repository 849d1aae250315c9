"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, run
independently in randomised groups of documents."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, text_or_empty

#: Pieces that one group holds on average at most: the memory of a task, and with it the padding, follow from it.
GROUP_PIECES = 8_192
#: Pieces whose ids a task keeps.
CACHE_PIECES = 150_000
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Tournament tree: each inner node holds the larger capacity of its two children, so the
    leftmost bin that takes an item is found from the root in log(bins) steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.node = [capacity] * (2 * self.leaves)

    def place(self, item: int) -> int:
        node, i = self.node, 1
        while i < self.leaves:
            i *= 2
            if node[i] < item:
                i += 1
        node[i] -= item
        leaf = i - self.leaves
        i //= 2
        while i:
            node[i] = max(node[2 * i], node[2 * i + 1])
            i //= 2
        return leaf


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ties keep their order."""
    order = np.argsort(-lengths, kind="stable")
    tree = CapacityTree(max(1, len(lengths)), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    filled: dict[int, int] = {}
    for k in order.tolist():
        item = int(lengths[k])
        b = tree.place(item)
        bins[k], offsets[k] = b, filled.get(b, 0)
        filled[b] = filled.get(b, 0) + item
    return bins, offsets


def _gathered(flat: np.ndarray, stops: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat`` one after the other, and where each of them stops; ``stops`` are those of ``flat``."""
    starts = np.concatenate([[0], stops])[which]
    size = stops[which] - starts
    ends = np.cumsum(size)
    return flat[np.repeat(starts - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _flat(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(codes), "<u4"), np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes))) // 4


class WordCodes:
    """Ids of whole texts. The tokenizer's own rules never join anything across ASCII white space, so each distinct
    word of some texts is encoded once: one of plain Latin letters, digits and marks is the sequence of its pieces in
    lower case, of which each new one goes to the tokenizer's model; any other is encoded by the tokenizer as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}

    def _pieces(self, names: list[str]) -> list[bytes]:
        known, tokenize = self.pieces, self.model.tokenize
        for name in set(names).difference(known):
            known[name] = _packed([t.id for t in tokenize(name if name.isascii() else name.translate(_BYTES))])
        return list(map(known.__getitem__, names))

    def _word_codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's stop."""
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces = {}
        self.pieces["\n"] = b""
        latin = pc.and_(pc.match_substring_regex(words, _LATIN), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        found = _PIECES("\n".join(words.filter(pa.array(latin)).to_pylist()).lower())
        pieces = pa.array(found, pa.string()).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        which = pieces.indices.to_numpy()
        ids, stops = _gathered(*_flat(self._pieces(names)), which)
        ends = np.flatnonzero(which == names.index("\n")) if "\n" in names else np.zeros(0, np.int64)
        own = np.append(stops[ends], len(ids))[: latin.sum()]  # where each Latin word stops
        if latin.all():
            return ids, own
        other, other_stops = _flat([_packed(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in words.filter(pa.array(~latin)).to_pylist()])
        place = np.empty(len(words), np.int64)
        place[latin], place[~latin] = np.arange(latin.sum()), latin.sum() + np.arange((~latin).sum())
        return _gathered(np.concatenate([ids, other]), np.concatenate([own, len(ids) + other_stops]), place)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's stop."""
        own = pc.ascii_split_whitespace(texts)
        first = own.offsets.to_numpy()
        words = own.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        ids, stops = _gathered(*self._word_codes(words.dictionary), words.indices.to_numpy())
        return ids, np.concatenate([[0], stops])[first[1:] - first[0]]


#: Words of which the pieces are known; texts of so many bytes are encoded together.
_LATIN = r"^[\x21-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]*$"
_TOGETHER = 8_000_000
#: The tokenizer's own piece pattern, for such words in lower case; a line feed stands between words.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|\n|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\n]+").findall


def _byte_letters() -> dict[int, str]:
    """Letters beyond ASCII as the byte-level models write their UTF-8 bytes: a byte that is a printable Latin-1
    character stands for itself, the others are numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    sign = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


_BYTES = _byte_letters()


@lru_cache(maxsize=2)
def _codes(path: str) -> WordCodes:
    return WordCodes(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Each text's ids, closed by ``end_id``, cut into pieces of ``capacity`` and a rest:
    ``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids`` (binary, little-endian
    uint32). A null or empty text is the single end id. Cuts depend on the text alone, so the ids are
    made once and need not be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_batches(batches, tokenizer, capacity, end_id, with_ids)

    out = keyed_texts(docs).mapInArrow(run, PIECES + ", ids binary" * with_ids)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _cut_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's texts. Spark keeps its Python workers: the ids of known pieces go with the task, or each
    worker would hold them while it runs other stages."""
    coder = _codes(tokenizer)
    try:
        for batch in batches:
            together = np.cumsum(pc.binary_length(batch["text"]).to_numpy()) // _TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(together)) + 1).tolist(), len(batch)] if len(batch) else []
            for a, b in zip(cuts, cuts[1:]):
                yield _cut(batch["doc_id"].slice(a, b - a), *coder.encode(batch["text"].slice(a, b - a)), capacity, end_id, with_ids)
    finally:
        coder.pieces = {}
        pa.default_memory_pool().release_unused()


def _cut(keys: pa.Array, ids: np.ndarray, stops: np.ndarray, capacity: int, end_id: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces of some texts as rows; ``ids`` are those of all texts, without the closing ones."""
    size = np.diff(stops, prepend=0) + 1
    ids = np.insert(ids, stops, end_id).astype("<u4", copy=False)
    stops = np.cumsum(size)
    n = -(-size // capacity)
    doc = np.repeat(np.arange(len(size)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * capacity
    length = np.minimum(capacity, size[doc] - start)
    begin = (stops - size)[doc] + start
    data = memoryview(ids.tobytes())
    parts = [data[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
    columns = {"doc_id": keys.take(pa.array(doc)), "start": start, "length": length, "ids_crc32": [zlib.crc32(p) for p in parts], "doc_tokens": size[doc]}
    return pa.RecordBatch.from_pydict(columns | ({"ids": [bytes(p) for p in parts]} if with_ids else {}))


def pack(items: DataFrame, n_groups: int, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, start, length`` (1 to
    ``capacity``) and ``ids_crc32``. Rows are dealt by a hash into ``n_groups`` groups, packed apart from each
    other; the row's place in its partition is part of the hash, so that rows that are equal in everything are
    spread too. Repeated rows are separate items. A sequence's id holds the group in its high bits. No rows give no rows."""
    names = items.columns
    group = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.monotonically_increasing_id()), F.lit(n_groups)).cast("int")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        out = pdf[names].copy()
        out["sequence_id"], out["offset"] = (int(key[0]) << 32) + bins, offsets
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id long, offset long"
    dealt = items.withColumn("pack_group", group).withColumn("doc_id", F.col("doc_id").cast("string"))  # no floats beside a null
    return dealt.groupBy("pack_group").applyInPandas(run, schema.replace("`doc_id` bigint", "`doc_id` string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def group_count(docs: DataFrame, capacity: int = 2048, per_group: int = GROUP_PIECES) -> int:
    """Groups for a table of documents: a text has at most one id for each byte, and its end."""
    most = docs.agg(F.sum(1 + F.floor((F.octet_length(text_or_empty()) + 1) / capacity))).first()[0] or 0
    return max(1, -(-int(most) // per_group))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places. See ``pieces`` and ``pack``."""
    return pack(pieces(docs, tokenizer, capacity, with_ids=with_ids), group_count(docs, capacity), capacity)


def op6_ffd_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
