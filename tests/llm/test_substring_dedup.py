import hashlib
from collections import Counter

import numpy as np
import pytest

from wavemill.llm import substring_dedup as S


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(t[a : a + 200] for _, t in texts for a in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 199):
            if count[t[a : a + 200]] > 1:
                gone[a : a + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh é")) for _ in range(rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long = text(60), text(400)
    rows = [(i, text(20) + passage + text(30), "en", "s") for i in range(12)]
    rows += [(20 + i, long[: 150 * i + 100] + "#" + long[150 * i + 100 :], "en", "s") for i in range(8)]
    rows += [(40 + i, long, "en", "s") for i in range(4)] + [(50, text(500), "en", "s"), (51, passage[:199], "en", "s"), (52, passage[:200], "en", "s"), (53, passage[1:], "en", "s")]
    rows += [(60, "a" * 199, "en", "s"), (61, "a" * 200 + "b", "en", "s"), (62, "c" * 201, "en", "s"), (63, "ab" * 300, "en", "s"), (64, None, None, None), (65, "", "en", "s"), (None, text(50), "en", "s"), (66, "x" + long[300:900] + long[300:800], "en", "s")]
    return rows + [(50, rows[-11][1], "en", "s")]


@pytest.mark.parametrize("hot,piece", [(4096, 1 << 20), (2, 1 << 20), (4096, 300)])
def test_equals_brute_force(docs, monkeypatch, hot, piece):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "PIECE", piece)
    S._powers.cache_clear()
    rows = corpus()
    got = [tuple(r) for r in S.remove_repeated_strings(docs(rows)).collect()]
    S._powers.cache_clear()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_phrases_cover_every_string_once():
    for text in (b"x" * 777, b"ab" * 400, bytes(np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8))):
        starts = []
        for trigger, first, last in S.phrases(text):
            assert last <= trigger and trigger + S.BLOCK <= first + S.WIDTH
            starts += range(first, last + 1)
        assert starts == list(range(len(text) - S.WIDTH + 1))


def test_suffix_order():
    w = np.random.default_rng(2).integers(0, 3, (500, 12)).astype(np.uint8)
    assert [bytes(w[i]) for i in S.suffix_order(w)] == sorted(map(bytes, w))


def test_empty_and_text(docs):
    assert S.remove_repeated_strings(docs([])).count() == 0
    got = S.remove_repeated_strings(docs([(1, "é" * 150 + "tail", None, None), (2, "é" * 150, None, None)]), with_text=True).orderBy("doc_id").collect()
    assert [bytes(r["kept"]) for r in got] == [b"tail", b""]
