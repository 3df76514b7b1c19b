import hashlib
import random

import pytest
from tokenizers import Tokenizer

from halyard.llm import bpe

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = ["", "  ", "a<|endoftext|>b <|startoftext|> A<|ENDOFTEXT|>.", "I'LL don't ΣΑΣ İstanbul x y é ́a 12345 ½ 漢字", "a" * 3000, "ab" * 2000, "'S it'S", "😀👨‍👩‍👧 \x00 \x7f", "a.. b., c.\x1c d. e f,\x0b. .' x.'s", "x\xa0y z  \x85q"]


def test_equals_the_library(codec, library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab'sSt Σσς́̈e  \n\t\x0b\x1c\x85<|endoftext|>12½ßİıǅ漢가.,") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text, ids in zip(texts, codec.all([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)
        assert codec.encode(text) == want


def test_store_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 50)
    texts = [f"word{i} other{i * 7}".encode() for i in range(200)]
    out = [i for k in range(0, 200, 20) for i in codec.all(texts[k : k + 20])]
    assert [list(memoryview(x).cast("I")) for x in out] == [codec.encode(t.decode()) for t in texts]
    assert len(codec.chunks) <= 60


def test_query(spark, library):
    rows = [(1, "Hello, world.", 1), (2, None, 2), (2, None, 2), (None, "", 3), (4, "x " * 5000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encoded(docs).collect()
    assert len(got) == 5
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r["doc_id"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.decoded(bpe.encoded(docs.where("doc_id = 1"))).first()["text"] == library.decode(library.encode("Hello, world.", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encoded(docs.limit(0)).count() == 0


def test_store_is_bounded_by_bytes(monkeypatch):
    import random

    from halyard.llm import bpe as B

    monkeypatch.setattr(B, "KEPT_BYTES", 2 << 20)
    codec = B.Codec(B.vocabulary_path())
    rng = random.Random(5)
    for _ in range(12):
        texts = [" ".join("".join(rng.choice("abcdé漢字") for _ in range(1500)) for _ in range(4)).encode() for _ in range(20)]
        got = list(codec.all(texts))
        assert got[0] == b"".join(int(i).to_bytes(4, "little") for i in codec.encode(texts[0].decode()))
        assert codec.held <= 2 << 20 and sum(len(c) + len(v) for c, v in codec.chunks.items()) <= 2 << 20


def test_other_vocabularies_are_refused(spark):
    import pytest

    from halyard.llm import bpe as B

    with pytest.raises(ValueError, match="byte_bpe_50k"):
        B.encoded(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "byte_bpe_50k.json")
