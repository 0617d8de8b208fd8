import os
import random

import pytest

from corpusloom.llm.piece_fst import BYTE, NORMAL, UNKNOWN, PieceFst, load, token_count, tokenise

from .helpers import empty, odd_documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file here")


@needs_model
def test_same_ids_as_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), load(MODEL), random.Random(1)
    alphabet = "abcdefghij  \n\t.,!?é中\U0001f600́▁ABC<>0123{}()[]\"'\\/-_=+" + "therinonationing" * 2
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert m.encode_ids(s) == sp.encode(s)
        if "▁" not in s:
            assert m.decode_ids(m.encode_ids(s)) == s
    for s in ("", " ", "  ", "a" * 300, " " * 50, "\n\n", " lead", "x\n y\n  z "):
        assert m.encode_ids(s) == sp.encode(s)


def test_unigram_takes_the_cheapest_path():
    pieces = [("<unk>", 0.0, UNKNOWN), ("▁", -3.0, NORMAL), ("a", -2.0, NORMAL), ("b", -2.5, NORMAL), ("ab", -4.6, NORMAL), ("▁a", -3.5, NORMAL)]
    m = PieceFst(pieces, bpe=False, byte_fallback=False)
    assert m.encode_ids("ab") == [5, 3] and m.encode_ids("zz") == [1, 0]
    assert PieceFst(pieces, bpe=False, byte_fallback=False, squeeze=True).encode_ids("  a  b ") == [5, 1, 3]


def test_rules_and_bytes():
    pieces = [("<unk>", 0.0, UNKNOWN), *((f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)), ("▁", -1.0, NORMAL), ("a", -2.0, NORMAL)]
    m = PieceFst(pieces, bpe=True, rules={"À".encode(): b"a", b"xy": b""})
    assert m.normalise("Àxyz") == "▁az"
    assert m.decode_ids(m.encode_ids("À中")) == "a中"


@needs_model
def test_odd_rows(spark):
    fst, docs = load(MODEL), odd_documents(spark)
    out = tokenise(docs, fst, decoded="back").withColumn("n", token_count("tokens", fst))
    for r in out.collect():
        assert r.back == (r.text or "") and (r.n == 0) == (not r.text)
    assert tokenise(empty(docs), fst).count() == 0


def segmentations(text, pieces):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if n == 1 or text[:n] in pieces:
            for rest in segmentations(text[n:], pieces):
                yield [text[:n], *rest]


def test_shortest_path_against_all_segmentations():
    rng = random.Random(6)
    for _ in range(60):
        found = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(7)}
        m = PieceFst([("<unk>", 0.0, UNKNOWN), *((p, -rng.uniform(1, 6), NORMAL) for p in sorted(found))], bpe=False, byte_fallback=False)
        text = "".join(rng.choice("abc") for _ in range(8))
        cost = lambda path: sum(-m.scores[m.ids[p]] if p in m.ids else m.fallback for p in path)
        assert abs(cost(m._path(text)) - min(map(cost, segmentations(text, found)))) < 1e-9


def test_bpe_path_against_merging():
    """Pieces that merges make, as a trained model has them; ranks in any order that makes parts before wholes."""
    rng = random.Random(7)
    for _ in range(60):
        parts = list("abc")
        for _ in range(10):
            p = rng.choice(parts) + rng.choice(parts)
            if p not in parts and len(p) < 7:
                parts.append(p)
        m = PieceFst([("<unk>", 0.0, UNKNOWN), *((p, -float(i), NORMAL) for i, p in enumerate(parts))], bpe=True, byte_fallback=False)
        for _ in range(20):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert m._path(text) == m._merged(text)
