import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from placeweave.llm import bpe_tree, packing, telephony

PATH = P.path("byte_bpe_50k.tiktoken")
ATOMS = ["a", "b", " ", "  ", "'", "'re", "'s", "\n", "\t", "é", "1", "!", "...", "re", "　", "ing", " the", "aaaa", "\x1c", "\xa0", "😀", "ll"]
ROWS = [(1, "Hello  world's\n\nend "), (1, "Hello  world's\n\nend "), (2, ""), (3, None), (None, "x" * 5000), ((1 << 60) + 1, "ab " * 3000)]


def test_tree_equals_library():
    ranks = bpe_tree.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for chars, size in ((4, 2), (5, 3), (40, 8)):
        tree = bpe_tree.TreeBpe(ranks, P.PATTERN, leaf_chars=chars, leaf_bytes=size)
        for _ in range(1500):
            text = "".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 50)))
            ids = tree.encode(text)
            assert ids == library.encode_ordinary(text)
            assert tree.decode(ids) == text.encode()


def test_encode_decode_tables(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in ROWS], "doc_id long, text string, ids string")
    coded = bpe_tree.encode(df, PATH, P.PATTERN)
    back = sorted((str(r.doc_id), bytes(r.data)) for r in bpe_tree.decode(coded, PATH, P.PATTERN).collect())
    assert back == sorted((str(i), (t or "").encode()) for i, t in ROWS)
    got = {r.doc_id: r for r in bpe_tree.digests(df, PATH, P.PATTERN).collect()}
    assert got[2].n_tokens == 0 and got[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[(1 << 60) + 1].decoded_sha256 == hashlib.sha256(("ab " * 3000).encode()).hexdigest()
    assert bpe_tree.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_word_codes_equal_tokenizer():
    path = P.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(5)
    texts = ["".join(rng.choice([*ATOMS, "ΑΣ ", "<|endoftext|>", "ß", "É", "İ", "²", "\x01", "I'M"]) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    coder = packing.WordCodes(path)
    for some in (texts, texts[:1], ["", " "], ["北京"], []):
        ids, stops = coder.encode(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, stops)][: len(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_packing_keeps_no_pieces_after_a_task():
    path = P.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_pydict({"doc_id": ["1", "2", None], "text": ["some words and words", "others", ""]})
    out = list(packing._cut_batches(iter([batch]), path, 2048, 1, False))
    assert [r["doc_tokens"] for b in out for r in b.to_pylist()] == [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for t in batch["text"].to_pylist()]
    assert not packing._codes(path).pieces


def test_packing_is_gapless_and_tight(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 9000), (None, "a b")], "doc_id long, text string")
    rows = packing.pack_documents(docs.union(odd), P.path("word_bpe_49k.json"), with_ids=True).collect()
    seq, doc = {}, {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, bytes(r.ids)))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    used = 0
    for pieces in seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        used += at
    assert used / (2048 * len(seq)) > 0.97
    for pieces in doc.values():
        at = 0
        for start, length, total, _ in sorted(pieces):
            assert start == at
            at += length
        assert at == total
    assert doc[10**6][0][:3] == (0, 1, 1) and len(doc[10**6 + 2]) == 5


def test_first_fit_decreasing_equals_scan():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 300)
    bins, _ = packing.first_fit_decreasing(lengths, 100)
    space, want = [], np.zeros(300, int)
    for k in np.argsort(-lengths, kind="stable"):
        b = next((b for b, s in enumerate(space) if s >= lengths[k]), len(space))
        if b == len(space):
            space.append(100)
        space[b] -= lengths[k]
        want[k] = b
    assert (bins == want).all()


def test_law_tables_and_adpcm():
    assert telephony.MU_LAW_TABLE[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.A_LAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, 40), dtype=np.uint8)

    def scalar(block):
        value, index, out = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), min(int(block[2]), 88), []
        out.append(value)
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                size = (step >> 3) + (step if code & 4 else 0) + ((step >> 1) if code & 2 else 0) + ((step >> 2) if code & 1 else 0)
                value = max(-32768, min(32767, value - size if code & 8 else value + size))
                index = max(0, min(88, index + int(telephony.INDEX_SHIFT[code])))
                out.append(value)
        return out

    assert telephony.decode_adpcm(blocks).tolist() == [scalar(b) for b in blocks]


def test_stored_texts_read_back(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = telephony.store_texts(df).collect()
    alone = telephony.store_texts(df.filter("doc_id = 1").limit(1)).first()
    for r in rows:
        text = next(t or "" for i, t in ROWS if i == r.doc_id).encode()
        payload = telephony.padded(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(telephony.wrap(payload)).hexdigest()
        if r.doc_id == 1:
            assert r.feature == alone.feature


def test_decode_audio_column(spark):
    files = [(1, telephony.wrap(bytes(range(100)))), (2, None), (3, b"junk"), (4, telephony.wrap(b"\x01\x00\x02\x00", telephony.PCM))]
    got = {r.k: r for r in telephony.decode_audio(spark.createDataFrame(files, "k long, media binary")).collect()}
    assert len(got[1].pcm) == 400 and got[1].pcm_rate == 16000 and len(got[2].pcm) == len(got[3].pcm) == 0
    assert np.frombuffer(bytes(got[4].pcm), "<i2").tolist() == [1, 1, 2, 2]


def test_decode_audio_keeps_ids_and_own_columns(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, telephony.wrap(b"\xff\x00"), "own", "h"), (None, None, None, None), (big, telephony.wrap(b"\xff\x00"), "own", "h")], "id long, media binary, pcm string, heard string")
    out = telephony.decode_audio(df)
    rows = out.collect()
    assert out.columns == ["id", "media", "heard", "pcm", "pcm_rate"] and [r.id for r in rows] == [big, None, big]
    assert len(rows[0].pcm) == 8 and rows[1].pcm == b"" and rows[0].heard == "h"
    assert telephony.decode_audio(df.limit(0)).count() == 0 and telephony.store_texts(df.selectExpr("id as doc_id", "pcm as text").limit(0)).count() == 0


def test_stored_pcm_is_the_resampled_audio(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "x" * 2000)], "doc_id long, text string")
    for r in telephony.store_texts(docs).collect():
        text = {1: b"abc", 2: b"", 3: b"x" * 2000}[r.doc_id]
        (pcm,) = telephony.decode_many([telephony.wrap(telephony.padded(text))])
        media = telephony.wrap(pcm.astype("<i2").tobytes(), telephony.PCM, rate=2 * telephony.RATE)
        assert (r.pcm_bytes, r.pcm_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature.split("|")[0] == telephony.features(pcm)
