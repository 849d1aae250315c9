"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets are one class. A class keeps band keys of its minima
and the low bits of each minimum, packed into bit planes. Bands give candidates; the
similarity estimated from equal low bits, corrected for chance equality, drops those that
are far below the threshold; the rest are confirmed on the full shingle sets.

A bucket never lists all its pairs. Each document is first compared with the one that
shares most buckets among those it meets (of a group of copies, the middle one). Where a
bucket then still spans several components, packed signatures of members of different
components are compared block by block, and those whose low bits agree by parity maps of
the whole sets, which rule pairs out but never a link. First the best pair of each two
components is confirmed, in the end every pair between components that are still apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, text_or_empty, written
from .components import components

BANDS, ROWS = 32, 5
#: Low bits that are kept of each minimum.
BITS = 4
#: Standard deviations that an estimate may lie below the threshold before a candidate is dropped.
SLACK = 5.0
#: Rounds in which only the best pair of each two components of a block is confirmed, before all that is left.
BEST_ROUNDS = 2
#: Members of a block when a bucket's components are compared.
BLOCK = 512
#: Most bits of a set's parity map, about four for each shingle below that.
PARITY_BITS = 1 << 15
_K = BANDS * ROWS
_WORDS = -(-_K // 64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(1, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, _K, dtype=np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P
    x = (x ^ (x >> np.uint64(29))) * _Q
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles. Words are runs of bytes other than ASCII
    white space, with A-Z lowered; fewer words than a shingle has are one shingle, none are none."""
    own = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    size = min(words, len(own))
    x = np.full(len(own) - size + 1, size, np.uint64)
    for k in range(size):
        x = _mix(x * _P + h[k : len(own) - size + 1 + k])
    return np.unique(x)


def signature(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of a shingle set's minima."""
    low = np.full(_K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 2048):
        np.minimum(low, (_A[:, None] * x[None, at : at + 2048] + _B[:, None]).min(axis=1), out=low)
    low = _mix(low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        keys = _mix(keys * _P + row)
    planes = np.zeros((BITS, _WORDS * 64), np.uint8)
    for b in range(BITS):
        planes[b, :_K] = (low >> np.uint64(b)) & np.uint64(1)
    return keys.view(np.int64), np.packbits(planes, axis=1, bitorder="little").view("<i8").reshape(-1)


def _signed(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                rows = []
                for text in part["text"]:
                    x = shingle_set(text, words)
                    if not len(x):
                        rows.append((0, None, None, None, None))
                        continue
                    data = x.tobytes()
                    rows.append((len(x), xxhash.xxh64_intdigest(data) - (1 << 63), xxhash.xxh64_intdigest(data, 7) - (1 << 63), *signature(x)))
                size, node, proof, bands, bits = zip(*rows)
                whole = [pd.array(x, dtype="Int64") for x in (size, node, proof)]  # never by way of floats
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "row_key": part["row_key"].array, "n_shingles": whole[0], "node": whole[1], "proof": whole[2], "bands": bands, "bits": bits})

    return run


def equal_share(a: str, b: str) -> Column:
    """Share of minima whose kept bits agree, from two arrays of bit planes."""
    apart = F.lit(0)
    for w in range(_WORDS):
        differ = None
        for p in range(BITS):
            x = F.col(a)[p * _WORDS + w].bitwiseXOR(F.col(b)[p * _WORDS + w])
            differ = x if differ is None else differ.bitwiseOR(x)
        apart = apart + F.bit_count(differ)
    return 1 - apart / F.lit(float(_K))


def estimate(share):
    """Similarity from the share of equal low bits, corrected for bits that agree by chance."""
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    s, chance = percent / 100, 2.0**-BITS
    p = s + (1 - s) * chance
    return s - SLACK * math.sqrt(p * (1 - p) / _K) / (1 - chance)


def _parity(x: np.ndarray) -> bytes:
    """Bitmap of a set in which each element turns one bit over: the bits in which two such maps differ are never
    more than the elements in which the sets differ. It has a power of two of bits, so a larger one folds to a smaller."""
    size = min(PARITY_BITS, max(512, 1 << (4 * len(x) - 1).bit_length()))
    bits = np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & np.uint8(1)
    return np.packbits(bits, bitorder="little").tobytes()


def _class_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, size, shingles, parity`` of the classes in ``wanted`` (row_key, node), from one text of each."""
    texts = _rows(docs).select("row_key", "text").join(wanted, "row_key").select("node", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                sets = [shingle_set(t, words) for t in part["text"]]
                same = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) == n for x, n in zip(sets, part["node"])]  # two rows may share a key
                out = pd.DataFrame({"node": part["node"], "size": [len(x) for x in sets], "shingles": [x.view(np.int64) for x in sets], "parity": list(map(_parity, sets))})
                yield out[same]

    return texts.mapInPandas(run, "node long, size int, shingles array<long>, parity binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs ``a, b`` (nodes) whose full sets are similar enough. Many pairs may share ``b``."""
    hubs = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")).join(pairs.select("b").distinct(), "b", "left_semi")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = salted_join(both, hubs, ["b"], F.col("a"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _unlike(parity: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the parity maps of each pair i, j differ: at most the elements in which the sets differ."""
    size = np.array([len(p) for p in parity]) // 8
    out = np.zeros(len(i), np.int64)
    low = np.minimum(size[i], size[j])
    for words in np.unique(low).tolist():
        at = np.flatnonzero(low == words)
        own, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        maps = np.stack([np.bitwise_xor.reduce(np.frombuffer(parity[k], "<u8").reshape(-1, words), axis=0) for k in own.tolist()])
        step = max(1, (1 << 19) // words)
        for s in range(0, len(at), step):
            part = maps[place[s : min(s + step, len(at))]] ^ maps[place[len(at) + s : len(at) + min(s + step, len(at))]]
            out[at[s : s + step]] = np.bitwise_count(part).sum(axis=1, dtype=np.int64)
    return out


def _block_pairs(at: int, one_block: bool, g: dict, least: float, percent: int, best: bool) -> np.ndarray:
    """Candidates of one block pair as rows of ``node, node``. ``g`` holds the arrays of its members."""
    own, other = np.flatnonzero(g["left"]), np.arange(len(g["node"])) if one_block else np.flatnonzero(~g["left"])
    bits, comp, node, bands, size = g["bits"], g["component"], g["node"], g["bands"], g["size"]
    pairs = [np.zeros((0, 3), np.int64)]
    for s in range(0, len(own), 32):
        rows = own[s : s + 32]
        apart = np.bitwise_count(np.bitwise_or.reduce(bits[rows][:, None] ^ bits[other][None], axis=2)).sum(axis=2, dtype=np.int64)
        near = (comp[rows][:, None] != comp[other][None]) & (estimate(1 - apart / _K) >= least)
        if one_block:
            near &= rows[:, None] < other[None]
        x, y = np.nonzero(near)
        i, j, apart = rows[x], other[y], apart[x, y]
        keep = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j, apart = i[keep], j[keep], apart[keep]
        keep = bands[i, (bands[i] == bands[j]).argmax(axis=1)] == at  # a pair comes from the first band it shares
        i, j, apart = i[keep], j[keep], apart[keep]
        keep = (100 + percent) * _unlike(g["parity"], i, j) <= (100 - percent) * (size[i] + size[j])
        pairs.append(np.column_stack([i[keep], j[keep], apart[keep]]))
    i, j, apart = np.concatenate(pairs).T
    if best and len(i):
        c, d = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
        order = np.lexsort((node[j], node[i], apart, d, c))
        first = np.concatenate([[True], (np.diff(c[order]) != 0) | (np.diff(d[order]) != 0)])
        i, j = i[order[first]], j[order[first]]
    return np.column_stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])])


def _across(rows: DataFrame, sizes: DataFrame, percent: int, best: bool) -> DataFrame:
    """Candidate pairs between different components of the buckets in ``sizes`` (key, n), compared in
    blocks: ``rows`` has key, node, component, bits, bands, size, parity. With ``best``, only the pair of
    highest estimate for each two components of a block."""
    least = least_estimate(percent)
    own = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.select("key", "low", "high", (F.col("block") == F.col("low")).alias("left"), "node", "component", "bits", "bands", "size", "parity")

    def cut(pdf: pd.DataFrame, groups: np.ndarray) -> pd.DataFrame:
        """The pairs of whole groups, which begin at ``groups``."""
        own = {k: pdf[k].to_numpy() for k in ("left", "node", "component", "size")}
        own["bits"] = np.stack(pdf["bits"].to_numpy()).view(np.uint64).reshape(len(pdf), BITS, _WORDS)
        own["bands"] = np.stack(pdf["bands"].to_numpy())
        key, low, high, parity = pdf["key"].to_numpy(), pdf["low"].to_numpy(), pdf["high"].to_numpy(), pdf["parity"].tolist()
        out = []
        for a, b in zip(groups.tolist(), [*groups[1:].tolist(), len(pdf)]):
            g = {k: v[a:b] for k, v in own.items()} | {"parity": parity[a:b]}
            if (g["component"] != g["component"][0]).any():
                out.append(_block_pairs(key[a], low[a] == high[a], g, least, percent, best))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            k = pdf[["key", "low", "high"]].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
            if first[-1]:
                yield cut(pdf.iloc[: first[-1]], first[:-1])
            rest = pdf.iloc[first[-1] :].reset_index(drop=True)  # goes on in the next batch, at most two blocks of rows
        if rest is not None:
            yield cut(rest, np.zeros(1, np.int64))

    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInPandas(run, "a long, b long").distinct()


def _placed(members: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return members.withColumn("component", F.col("node"))
    return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _split_buckets(placed: DataFrame) -> DataFrame:
    """Buckets that span several components: their heaviest member (the one that shares most buckets)."""
    heavy = F.max(F.struct("weight", "node", "component")).alias("top")
    per = placed.groupBy("key").agg(heavy, F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("n").alias("n"))
    return per.filter("c0 <> c1").select("key", "n", F.col("top.node").alias("top"), F.col("top.weight").alias("top_weight"), F.col("top.component").alias("top_component"))


def _star_pairs(placed: DataFrame, tops: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket with one other (``b``): the heaviest of the heaviest members of its buckets, and in
    a bucket of two the other one, if their low bits agree well enough."""
    own = salted_join(placed, tops.drop("n"), ["key"], F.col("node")).filter("component <> top_component")
    picked = own.groupBy("node").agg(F.max(F.struct("top_weight", "top")).alias("p"))
    twos = placed.filter("n = 2").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    pairs = picked.select(F.col("node").alias("a"), F.col("p.top").alias("b")).union(twos.select("a", "b")).distinct()
    pairs = pairs.join(bits.toDF("a", "bits_a"), "a")
    pairs = salted_join(pairs, bits.toDF("b", "bits_b"), ["b"], F.col("a"))
    return pairs.filter(estimate(equal_share("bits_a", "bits_b")) >= least_estimate(percent)).select("a", "b")


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` as a string (pandas never turns it into a float), ``text``, and a key that tells rows of one id or of none apart."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"), row_key().alias("row_key"))


def row_key() -> Column:
    """A key of a row's id and text."""
    return F.xxhash64(F.col("doc_id").cast("string"), text_or_empty())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if 100 * intersection >= percent * union of their distinct shingle sets; a
    component's id is the smallest ``doc_id`` reachable. Null, empty and blank texts have no shingles and
    are linked with nothing; rows with equal sets are linked whatever their number; a row whose id is
    null gets the component of its class, or null where no row of it has an id, and is kept. Only ``doc_id`` and
    ``text`` are read, so other columns may have any name; an empty table gives no rows."""
    out = _linked(docs, words, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def kept_keys(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``row_key`` (see ``row_key()``) of the rows with an id that stay: of each group of near-duplicates the one with the
    smallest id (of several texts of that id, one), and all rows without shingles."""
    rows = _linked(docs, words, percent).filter("doc_id is not null")
    first = rows.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct("doc_id", "row_key")).alias("m")).select("m.row_key")
    return first.union(rows.filter("n_shingles = 0").select("row_key")).distinct()


def _linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, row_key, n_shingles, component_id, group`` of each row; ``group`` tells components apart whatever ids they have."""
    schema = "doc_id string, row_key long, n_shingles long, node long, proof long, bands array<long>, bits array<long>"
    signed = _rows(docs).mapInPandas(_signed(words), schema)
    signed = written(signed.withColumn("doc_id", F.col("doc_id").cast("long")), "signed")
    per = signed.filter("node is not null").groupBy("node", "proof")
    classes = per.agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("one"), F.min("bands").alias("bands"), F.min("bits").alias("bits"), F.count("*").alias("n_docs"))
    classes = written(classes.withColumn("row_key", F.col("one.row_key")).drop("one"), "classes")

    rows = classes.select(F.explode("bands").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(salted_join(rows, shared, ["key"], F.col("node")), "members")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    sets = written(_class_sets(docs, classes.join(weight, "node", "left_semi").select("row_key", "node"), words), "sets")
    members = written(members.join(weight, "node"), "members")

    placed = _placed(members, None)
    star = written(_star_pairs(placed, _split_buckets(placed), classes.join(weight, "node", "left_semi").select("node", "bits"), percent), "candidates")
    links = written(_confirmed(star, sets, percent), "links")
    found = components(links)
    traits = classes.select("node", "bits", "bands").join(sets.drop("shingles"), "node")
    members = members.filter("n > 2")  # the two of a bucket of two have been compared
    for best in [True] * BEST_ROUNDS + [False]:
        placed = _placed(members, found)
        split = written(_split_buckets(placed).select("key", "n"), "split")
        own = placed.select("key", "node", "component").join(traits, "node")
        fresh = written(_across(own, split, percent, best), "candidates")
        fresh = written(_confirmed(fresh, sets, percent), "links")
        if fresh.limit(1).count():
            links = links.union(fresh)
            found = components(links)

    reach = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = reach.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("n_docs").alias("n"))
    named = reach.select("node", "proof", "component").join(first.filter("n > 1"), "component").select("node", "proof", "component", "component_id")
    out = salted_join(signed.select("doc_id", "row_key", "n_shingles", "node", "proof"), named, ["node", "proof"], F.col("doc_id"), "left")
    return out.select("doc_id", "row_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "node").alias("group"))


def op5_bbit_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
