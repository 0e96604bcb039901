import struct
import zlib

import pytest

from heddle.llm import packing

SCHEMA = "doc_id long, text string, start string, tier int"


def check(docs, got, tiers=(512, 1024, 2048, 4096)):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer_path())
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in docs}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for d, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            part = ids[d][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids[d])
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rows[0].sequence_length <= max(tiers) and at & (at - 1) == 0


def test_every_id_in_one_piece(spark):
    words = ["alpha", "Éclair", "it's", "x1y2", "<|endoftext|>", "naïve wide", "a\x1cb", "é"]
    docs = [(i, " ".join(words[(i * j) % len(words)] for j in range((i * i * 37) % 3000))) for i in range(60)]
    docs += [(1000, None), (1001, ""), (1002, "word " * 20000), (1003, " \n\t "), (1004, "q" * 30000)]
    df = spark.createDataFrame([(d, x, "s", 1) for d, x in docs], SCHEMA).repartition(3)
    check(docs, packing.pack(df, buffer_tokens=5000).collect())


def test_windows_of_tiers_hold_steps(spark):
    docs = [(i, "word " * (i % 700)) for i in range(900)]
    df = spark.createDataFrame([(d, x, "s", 1) for d, x in docs], SCHEMA).coalesce(1)
    got = packing.pack(df, step_tokens=8192).collect()
    check(docs, got)
    steps = {}
    for s, g, n in {(r.sequence_id, r.step_group, r.sequence_length) for r in got}:
        steps[g] = steps.get(g, 0) + n
    full = [n for g, n in sorted(steps.items())][:-1]
    assert all(abs(n - 8192) < 4096 for n in full)


def test_empty_null_and_repeated_rows(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "one two", None, None), (5, "one two", None, None), (5, "one two", None, None)], SCHEMA)
    got = packing.pack(df).collect()
    assert sum(r.length for r in got) == 9
    with pytest.raises(ValueError):
        packing.pack(df, tiers=(100,))


def test_ids_of_odd_words_are_the_tokenizer_s():
    import random

    from tokenizers import Tokenizer

    rng, path = random.Random(5), packing.default_tokenizer_path()
    letters = "abzABZİıéÉßΣσẞñŉǅक़שׁKÅ中あ가กำم"
    others = ".,!?;:|*&#'\"()<>=-_/@09²½̸́̇ͅ‍  ᲀ\u001c  \n"
    texts = ["BELGESİ.", "RESMİ!", "Eİ,", "İ.", "ΟΔΟΣ. ΟΔΟΣ", "क़."]
    texts += ["".join(rng.choice(letters if rng.random() < 0.7 else others) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    t = Tokenizer.from_file(path)
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    got = packing.encode_texts(texts, path)
    assert [x for x, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_new_chunks_share_texts_and_keep_their_ids(monkeypatch):
    """1,000 chunks that a worker hasn't seen take a few texts through the tokenizer, and each has the ids that it has alone."""
    path = packing.default_tokenizer_path()
    plain, texts = packing._tokenizer(path), []

    class Counted:
        def encode(self, text, **kw):
            texts.append(text)
            return plain.encode(text, **kw)

        def encode_batch_fast(self, part, **kw):
            texts.extend(part)
            return plain.encode_batch_fast(part, **kw)

    odd = ["<|endoftext|>x", "'s", "a's'", "́x", "é", "İstanbul", "Å", "가", "​", "‍’s", "\U0001f600\U0001f600", "12½", "﻿x", "กำ", "xͅ", "\x00", "\x7f"]
    chunks = [f"zq{i}w-{i}" for i in range(1_000)] + [x for w in odd for x in (w, f"q{w}", f"{w}9{w}")]
    monkeypatch.setattr(packing, "_cache", {})
    monkeypatch.setattr(packing, "_tokenizer", lambda path: Counted())
    got = packing.encode_texts([" ".join(chunks), *chunks], path)
    assert len(texts) < 100
    alone = [packing._pack(plain.encode(w, add_special_tokens=False).ids) for w in chunks]
    assert got == [packing._pack(plain.encode(" ".join(chunks), add_special_tokens=False).ids), *alone]
