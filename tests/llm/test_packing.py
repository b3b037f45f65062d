import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavemill.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, got):
    t = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == {i for i, *_ in rows}
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda r: r["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 1024 or at & (at - 1) == 0 and at <= 1024  # nothing to pad


def test_round_trip(docs):
    rows = [(i, f"word{i % 7} " * (1 + i * 13 % 400) + "é\n", "en", "s") for i in range(60)]
    rows += [(100, None, None, None), (101, "", None, None), (102, "a  b\t\n c <|endoftext|> d 日本語 " + " " * 900, None, None), (103, "same", None, None), (104, "same", None, None), (105, "x" * 30_000, None, None)]
    check(rows, packing.pack_documents(docs(rows), PATH).collect())


def test_ties_repeats_and_nulls(docs):
    rows = [(7, "same text", "en", "s")] * 3 + [(None, "other", None, None)]
    got = packing.pack_documents(docs(rows), PATH).collect()
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert packing.pack_documents(docs([]), PATH).count() == 0


def test_hot_bucket_is_dealt_into_cells(docs, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 64)
    rows = [(i, "all the same words", "en", "s") for i in range(200)]
    check(rows, packing.pack_documents(docs(rows), PATH).collect())


def test_tokenizer_gives_the_ids_of_the_file():
    t, inner = packing.TextTokenizer(PATH), Tokenizer.from_file(PATH)
    for text in ["", " ", "don't 's we 'LL", "a  b\x85c\xa0d", "ŉǅ ß²½", "é 日本", "x y", "\x00\x1f", "<|endoftext|>", "a" * 3000, " \n" * 700 + "b", "1234567 ٣٤٥"]:
        assert t.encode(text) == np.array(inner.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), text


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("cell", [64, 1000])
def test_crowded_buckets_keep_the_order_of_keys(docs, monkeypatch, cell):
    monkeypatch.setattr(packing, "CELL", cell)
    rows = [(i, "all the same words " * 40 + f"and {i}", "en", "s") for i in range(150)]
    rows += [(1000 + i, "copies of one text", "en", "s") for i in range(60)] + [(2000 + i, f"word{i} other{i % 9} " * (1 + i % 30), "en", "s") for i in range(100)]
    got = packing.pack_documents(docs(rows), PATH).collect()
    check(rows, got)
    laid = sorted((r for r in got if r["start"] == 0), key=lambda r: (r["sequence_id"], r["offset"]))
    keys = [r["hilbert_key"] for r in laid]
    assert len(set(keys)) > 100 and keys == sorted(keys)
    # Some bucket of the leading bits was crowded by documents with keys of their own.
    held = defaultdict(lambda: [0, set()])
    for r in laid:
        b = held[r["hilbert_key"] >> 34]
        b[0] += r["doc_tokens"]
        b[1].add(r["hilbert_key"])
    assert any(n > cell and len(own) > 5 for n, own in held.values())
