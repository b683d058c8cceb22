import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tableprep.llm import token_blocks as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 49_408, 1 << 32])
def test_blocks_round_trip(n, high):
    rng = np.random.default_rng(n + high % 97)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.random(n) < 0.05] = high - 1
    blocks = T.pack_blocks(ids)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1])).astype(np.int64)[:len(blocks)]
    assert T.unpack_blocks(memoryview(b"".join(blocks)), starts).tolist() == ids.tolist()


def test_outliers_do_not_widen_a_block():
    ids = np.full(512, 7, np.uint32)
    ids[::100] = 1 << 31
    assert len(T.pack_blocks(ids)[0]) < 100


def test_piecewise_encoding_equals_whole_text_encoding():
    rng = random.Random(4)
    letters = "aAbzéÉßİıſǅñΣσς名字ا́ 　 \t\n\x0b\x1c\x85\xa0.,!?'’sdt<|>_-0٣½😀#$%&*"
    texts = [None, "", "the cat's <|endoftext|> <|ENDOFTEXT|> it's. don't,x.'s a.b. ab.,! café. É."]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    ids, n = T.ChunkEncoder(PATH, limit=500).encode(pa.array(texts), 2)
    whole = Tokenizer.from_file(PATH)
    at = 0
    for text, size in zip(texts, n):
        assert ids[at:at + size].tolist() == whole.encode(text or "", add_special_tokens=False).ids + [2], repr(text)
        at += size


def _want(rows):
    whole, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_documents_round_trip(small_docs, odd_docs, no_docs):
    for docs in (small_docs, odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = T.encode_documents(docs, PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
        assert sorted(map(tuple, got), key=str) == _want(rows)
    assert T.encode_documents(no_docs, PATH).count() == 0


def test_ids_and_manifest(spark, small_docs, tmp_path):
    path = str(tmp_path / "shards")
    T.write_shards(small_docs, path, PATH, n_shards=3)
    shards = sorted(T.manifest(spark, path).collect(), key=lambda r: r["shard"])
    assert sum(r["n_docs"] for r in shards) == small_docs.count()
    assert [r["first_id"] for r in shards] == np.cumsum([0, *[r["n_ids"] for r in shards]])[:-1].tolist()
    one = T.read_shards(spark, path).where("doc_id = 3").first()
    text = small_docs.where("doc_id = 3").first()["text"]
    assert np.frombuffer(one["ids"], "<u4").tolist() == Tokenizer.from_file(PATH).encode(
        text, add_special_tokens=False).ids + [2]


def test_every_letter_before_every_cut_sign():
    """Composing and lower-casing may end a letter in a mark, which the tokenizer joins with the punctuation."""
    import unicodedata
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
    dense = [c for c in letters if "\u3400" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" or c >= "\U00017000"]
    texts = [" ".join(f"a{c}{s}" for s in ".,;:!?*%&#$|") for c in sorted({*letters} - {*dense}) + dense[::16]]
    texts += ["AD\u0130. x\u0130, y \u0958. \ufb2a. I\u0307. e\u0301."]
    whole, encoder = Tokenizer.from_file(PATH), T.ChunkEncoder(PATH)
    for i in range(0, len(texts), 2000):
        ids, n = encoder.encode(pa.array(texts[i:i + 2000]), 2)
        want = [e.ids + [2] for e in whole.encode_batch(texts[i:i + 2000], add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]
