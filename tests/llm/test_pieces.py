"""Merge-type encoding against the library, text by text."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece

from docquarry.llm import sentencepieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.MergePieces(sentencepieces.default_model())


def encoded(library, text):
    return np.array(library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()


def test_every_document(spark, small, library):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = sentencepieces.query(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = encoded(library, texts[r["doc_id"]])
        decoded = library.decode(np.frombuffer(ids, "<u4").tolist())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_made_up_texts(library, pieces, monkeypatch):
    monkeypatch.setattr(sentencepieces, "SLICE", 200)
    draw = random.Random(5)
    own = [library.id_to_piece(k).replace("▁", " ") for k in range(259, 32000)]
    odd = [" ", "  ", "\n", "▁", "e", "the", "\x00", "\r", "é", "梦", "🤗", "﻿", "​", "0", "--", "    ", "aaaa", "<s>", "<0x41>", "\t", "　", "²", ".", ",", "n't"]
    for _ in range(6000):
        kind = draw.random()
        if kind < 0.3:
            text = "".join(draw.choice(odd) for _ in range(draw.randint(0, 40)))
        elif kind < 0.6:
            text = "".join(draw.choice(own) for _ in range(draw.randint(1, 40)))
        elif kind < 0.8:
            text = "".join(draw.choice("abcdefgh est.,") for _ in range(draw.randint(1, 400)))
        elif kind < 0.9:
            text = "".join(chr(draw.choice([draw.randint(1, 0x2FF), draw.randint(0x300, 0xD7FF), draw.randint(0xE000, 0x10FFFF)])) for _ in range(draw.randint(1, 12)))
        else:
            text = " " * draw.randint(0, 70) + draw.choice(own) + " " * draw.randint(0, 70)
        ids = encoded(library, text)
        assert pieces.encode(text) == ids, text
        assert pieces.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist()), text


def test_any_ids_are_decoded(library, pieces):
    draw = random.Random(6)
    for _ in range(4000):
        ids = [draw.choice([draw.randint(0, 31999), draw.randint(3, 258), 28705, 1, 2, 0, 259]) for _ in range(draw.randint(0, 12))]
        assert pieces.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_places_fail_once(pieces):
    """A stretch without spaces is encoded in linear time, as it would be by merging."""
    draw = random.Random(7)
    for n in (1, 2, 30, 200):
        part = "".join(draw.choice("aenrstx") for _ in range(n))
        assert [pieces.text[k] for k in pieces.backtrack(part)] == pieces.merge(part)
    long = "".join(draw.choice("abcdest") for _ in range(200_000))
    ids = np.frombuffer(pieces.encode(long), "<u4").tolist()
    assert pieces.decode(pieces.encode(long)) == long and len(ids) < len(long)


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 20)
    monkeypatch.setattr(sentencepieces, "PAIRS", 5)
    own = sentencepieces.MergePieces(sentencepieces.default_model())
    draw = random.Random(8)
    for _ in range(200):
        text = " ".join("".join(draw.choice("aeinrst") for _ in range(draw.randint(1, 9))) + draw.choice(["", ".", ","]) for _ in range(40))
        assert own.encode(text) == encoded(library, text)


def test_tables_of_ids(spark, library):
    df = spark.createDataFrame([(1, "Hello  World\n"), (1, None), (None, ""), (2, "🤗▁x")], "doc_id long, text string")
    coded = sentencepieces.encode(df, sentencepieces.default_model())
    back = sentencepieces.decode(coded, sentencepieces.default_model())
    assert sorted((r["doc"] or 0, r["text"]) for r in back.collect()) == [(0, ""), (1, ""), (1, "Hello  World\n"), (2, "🤗 x")]
    assert sorted(r["ids"] for r in coded.collect()) == sorted(encoded(library, t) for t in ("Hello  World\n", "", "", "🤗▁x"))


def test_other_models_are_refused(tmp_path):
    with open(sentencepieces.default_model(), "rb") as f:
        data = f.read()
    at = data.rindex(b"\x0a\x08identity\x12\x00\x18\x01\x20\x00")
    (tmp_path / "m").write_bytes(data[: at + 12] + b"\x18\x00\x20\x00" + data[at + 16 :])
    with pytest.raises(ValueError):
        sentencepieces.MergePieces(str(tmp_path / "m"))
