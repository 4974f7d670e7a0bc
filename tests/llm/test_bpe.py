import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tagbill.llm import bpe, queries
from tagbill.llm.common import load

PATH = queries.tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))


def test_every_text_as_the_library_does(spark, sf, tok):
    texts = {r.doc_id: r.text for r in load(spark, sf, "documents").collect()}
    rows = queries.op1_bpe_chunk_reuse(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(tok, texts[r.doc_id]) for r in rows)


def test_odd_rows(odd, none, tok):
    rows = bpe.encode(odd, PATH, bpe.Chunking(least=32, most=256, mask_bits=5, words=4)).collect()
    want = sorted((str(r.doc_id), *expected(tok, r.text)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    for r in rows:
        assert len(r.ids) == r.n_tokens and sha(r.decoded) == r.decoded_sha256
    assert bpe.encode(none, PATH).count() == 0


def test_shared_chunks_are_found_and_reused(spark, tok):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=900))
    docs = [(i, " ".join(rng.choices(words, k=60)) + " " + passage + " " + " ".join(rng.choices(words, k=40)))
            for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    uses = bpe.shared_chunks(df.selectExpr("doc_id", "cast(text as binary) text"), bpe.Chunking(least=64, mask_bits=7))
    per_doc = {r.doc_id: r["count"] for r in uses.groupBy("doc_id").count().collect()}
    assert set(per_doc) == set(range(12)) and min(per_doc.values()) >= 5
    assert uses.filter("doc_id = owner").select("h").distinct().count() == uses.select("h").distinct().count()
    got = {r.doc_id: r.ids_sha256 for r in bpe.encode(df, PATH, bpe.Chunking(least=64, mask_bits=7)).collect()}
    assert all(got[i] == expected(tok, t)[1] for i, t in docs)


def test_joins_are_repaired_at_any_cut(tok):
    rng = random.Random(2)
    enc = bpe.Encoder.of(PATH)
    alphabet = ["the", "don't", "Übergröße", "éa", "123", "***", "<|endoftext|>", "ΑΣ", "İ", "'ll", "a b", "\U0001F600"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) + rng.choice([" ", "\n", "  ", "", "-"]) for _ in range(60)).encode()
        at = sorted(rng.sample(range(1, len(text)), 2))
        at = [a for a in at if text[a] & 0xC0 != 0x80]
        pieces = [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]
        if not all(bpe._has_words(p, 8) for p in pieces):
            continue
        whole = tok.encode(text.decode(), add_special_tokens=False).ids
        assert enc.joined([(pieces, enc.plain(pieces))]) == [whole]


def test_chunks_follow_content():
    rng = random.Random(3)
    body = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)).encode()
    rule = bpe.Chunking()
    a, b = bpe.chunks(body, rule), bpe.chunks(b"some words put in front of it " + body, rule)
    assert b"".join(a) == body and len(set(a) & set(b)) >= len(a) - 2
    assert all(bpe._has_words(c, rule.words) for c in a)
    assert bpe._unpack(bpe._pack([1, 70000, 3])) == [1, 70000, 3] and bpe._unpack(bpe._pack([])) == []


def test_only_joins_with_shared_chunks_are_repaired(tok, monkeypatch):
    """A text without a shared chunk is one piece; around a shared one the chunks of its own are one piece on each side."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(400)).encode()
    rule = bpe.Chunking(least=64, mask_bits=6)
    enc, split = bpe.Encoder.of(PATH), bpe.chunks(text, rule)
    assert len(split) >= 7
    whole = tok.encode(text.decode(), add_special_tokens=False).ids
    seen = []
    joined = enc.joined
    monkeypatch.setattr(enc, "joined", lambda docs: seen.extend(p for p, _ in docs) or joined(docs))
    shared = split[3]
    known = {bpe.chunk_hash(shared): enc.plain([shared])[0]}
    assert enc.encode([text, b"", text], [{}, {}, known], rule) == [whole, [], whole]
    assert seen == [[text], [b""], [b"".join(split[:3]), shared, b"".join(split[4:])]]


def test_slices_end_before_white_space(tok):
    rng = random.Random(8)
    alphabet = ["don't", "Übergröße", "123", "***", "<|endoftext|>", "\u0301x", "İ", "\x0b", "\U0001F600" * 300]
    for _ in range(20):
        text = "".join(rng.choice(alphabet) + rng.choice([" ", "\n", "\r\n", "\t ", "-"]) for _ in range(300))
        parts = bpe._slices(text.encode(), 100)
        assert b"".join(parts) == text.encode() and len(parts) > 10 and all(p[:1] in (b" ", b"\n", b"\r", b"\t") for p in parts[1:])
        assert bpe.Encoder.of(PATH).plain([text.encode(), b""]) == [tok.encode(text, add_special_tokens=False).ids, []]


def test_the_library_gets_each_different_word_once():
    """And ids are the library's, wherever marks, contractions, added tokens or the parting mark itself stand."""
    class Counting:
        def __init__(self, tok):
            self.tok, self.chars = tok, 0

        def encode_batch_fast(self, texts, **options):
            self.chars += sum(map(len, texts))
            return self.tok.encode_batch_fast(texts, **options)

    enc = bpe.Encoder(PATH)
    library, enc.tok = enc.tok, Counting(enc.tok)
    text = "it's (one) \"two\", three's... $7.50 <|endoftext|>x|y \x01 a\x01b ≠ ,́e é! ́a\n" * 2000
    assert enc.plain([text.encode(), b"", b" \n"]) == [library.encode(text, add_special_tokens=False).ids, [], []]
    assert enc.tok.chars < 1000
