"""Tokenizer, leak search and splitting against public libraries and brute force."""

import base64
import os
import random

import pytest

from motionq.llm import bpe, splitter, wumanber

needs = pytest.mark.skipif(not os.path.exists(bpe.RANK_FILE), reason="no vocabulary here")
TEXTS = [
    "", None, " ", "\n\n", "Hello  world", "it's I'LL we've", "naïve café 東京タワー 👩‍👩‍👧 ​﻿", "<|endoftext|> <s> [PAD]", "a" * 3000, "\x00\x1c\x85 x", "1234567 ½ ²",
    "Ｆｕｌｌ　ｗｉｄｔｈ", "tab\tand  \n  spaces   ", "עברית العربية हिन्दी", "x" * 50 + " " * 900 + "y",
]


def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks().splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def long_texts():
    r = random.Random(7)
    words = ["motion", "capture", "Handschuh", "手袋", "réglage", "😀", "x" * 30]
    out = []
    for joint in (" ", "\n", ". ", "", "\n\n"):
        out.append(joint.join(r.choice(words) for _ in range(1500)))
    return out + ["😀" * 700, "z" * 5000]


@needs
def test_ids_match_the_public_library(spark):
    t = reference()
    texts = TEXTS + long_texts()
    df = spark.createDataFrame([(i, x, "e") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.token_ids(df).collect()}
    assert got == {i: t.encode_ordinary(x) if x else [] for i, x in enumerate(texts)}
    assert bpe.token_ids(df.limit(0)).count() == 0


@needs
def test_every_token_is_its_own_merge():
    enc = bpe.Encoder(bpe.read_ranks())
    assert all(enc.merge(b) == [i] for b, i in list(enc.ranks.items())[::37])


def test_segment_tree_equals_plain_merging():
    r = random.Random(1)
    ranks = {bytes([i]): i for i in range(256)}
    known = [b"ab", b"bc", b"abc", b"aa", b"aaaa", b"ca", b"abca", b"bb"]
    ranks |= {p: 256 + i for i, p in enumerate(known)}
    lines = b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items())
    enc = bpe.Encoder(lines)

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 60):
        piece = bytes(r.choice(b"abc") for _ in range(n))
        assert enc.merge(piece) == plain(piece)


@needs
@pytest.mark.parametrize(("limit", "overlap"), [(512, 64), (40, 0), (40, 19)])
def test_pieces(spark, limit, overlap):
    t = reference()
    texts = TEXTS + long_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got: dict = {}
    for r in splitter.split(df, limit, overlap).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, x in enumerate(texts):
        n = len(t.encode_ordinary(x)) if x else 0
        mine = sorted(got.get(i, []), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        if not x:
            assert not mine
            continue
        assert (len(mine) > 1) == (n > limit) and mine[0].first_token == 0 and mine[-1].last_token == n
        assert all(0 < r.last_token - r.first_token <= limit for r in mine)
        assert all(overlap <= a.last_token - b.first_token <= overlap + 8 and a.last_token < b.last_token for a, b in zip(mine, mine[1:], strict=False))
        ids = t.encode_ordinary(x)
        assert [r.text for r in mine] == [t.decode_bytes(ids[r.first_token : r.last_token]).decode() for r in mine]


def test_cuts_prefer_natural_ends():
    import numpy as np

    kind = np.zeros(1001, int)
    kind[[0, 1000]] = 4
    kind[::10] = np.maximum(kind[::10], 1)
    kind[300] = kind[330] = 4
    first, last = splitter.cuts(kind, 512, 64)
    assert last[0] == 330 and first[1] == 266 and last[-1] == 1000
    hard = np.zeros(1001, int)
    first, last = splitter.cuts(hard, 512, 64)
    assert last.tolist() == [512, 960, 1000] and first.tolist() == [0, 448, 896]


def test_words():
    w = wumanber.words
    assert w("Caf&eacute; CAFÉ <b>be­nch</b>_mark Ｆｕｌｌ x&nbsp;y 3.5") == ["cafe", "cafe", "bench", "mark", "full", "x", "y", "3", "5"]
    assert w("Straße STRASSE") == ["strasse", "strasse"] and w(None) == [] and w("<br/>") == [] and w("a < b > c") == ["a", "b", "c"]


def test_leaks(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 14)))) for i in range(25)] + [(90, None), (91, ""), (None, "w1 " * 9), (92, "q " * 8), (3, "z1 z2 z3 z4 z5 z6 z7 z8")]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(200))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "Q, q-q <i>q</i>; Q q q q!"), (103, "q q q x q q q q q"), (104, "z1 z2 z3 z4 z5 z6 z7 z8"), (104, "z1")]
    for i, text in list(items)[:6]:
        docs.append((200 + i, f"start {text.upper().replace(' ', '&nbsp;')} end"))
    want = set()
    for d, text in docs:
        s = f" {' '.join(wumanber.words(text))} "
        for i, item in items:
            w = wumanber.words(item)
            if i is not None and any(f" {' '.join(w[k : k + 8])} " in s for k in range(len(w) - 7)):
                want.add((d, i))
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*i, "t") for i in items], "item_id long, text string, doc_id string")
    for size in (10**9, 100):
        got = [(x.doc_id, x.item_id) for x in wumanber.leaks(a, b, pass_characters=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert wumanber.leaks(a, b.limit(0)).count() == 0 and wumanber.leaks(a.limit(0), b).count() == 0
