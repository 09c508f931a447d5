"""Alignment and counts against a plain loop over tokens."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lociflow.llm import alignment

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """Digest of each row, and the pairs, by the definition."""
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = alignment._byte_letters()
    found = []
    for doc, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in second.encode(text):
                p = second.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()))
            raw = b" " + text.encode()
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a = b = []
        ends = []
        for side in (a, b):
            at, mine = 0, []
            for _, x in side:
                at += len(x)
                mine.append(at)
            ends.append(mine)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0].index(e)][0], b[ends[1].index(e)][0]) for e in shared]
        groups, ka, kb = [], 0, 0
        for e in shared:
            na, nb = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(str(i) for i, _ in a[ka:na]) + "|" + ",".join(str(i) for i, _ in b[kb:nb]))
            ka, kb = na, nb
        found.append((doc, len(a), len(b), links, ";".join(groups)))
    count = Counter(link for f in found for link in f[3])
    most = Counter()
    for (i, j), n in count.items():
        most[j] = max(most[j], n)
    return [(doc, na, nb, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for doc, na, nb, links, g in found], {(i, j, n, n == most[j]) for (i, j), n in count.items()}


ODD = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> and <s> </s> <unk>"), (5, "a ▁ b"), (6, "x\n\n\ty  z\r\n"), (7, "日本語 ñandú ﬁ İ 😀 ́"), (None, "no number"),
       (8, "\x00\x7f"), (8, "\x00\x7f"), (9, "<0x0A> 0x0A"), (10, "naïve"), (11, "﻿mark"), (12, "it's we'll  don't")]


@pytest.mark.parametrize("radix,fan_in,chunk_rows", [(1, 2, 3), (5, 256, 4096), (32, 4, 1)])
def test_against_the_definition(spark, radix, fan_in, chunk_rows):
    r = random.Random(4)
    words = ["the", "of", "then", "straße", "Alpha", "beta9", "12", ",", ".", "日本", "un", "able"]
    rows = ODD + [(100 + i, r.choice(["", " "]) + r.choice([" ", "  ", "\n"]).join(r.choice(words) for _ in range(r.choice([1, 5, 60])))) for i in range(25)]
    rows += [(7, "the same text of a third")] * 20 + [(400, " ".join(r.choice(words) for _ in range(9000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 AS chunk", "2 AS part", "3 AS idx")
    got = alignment.align_tokenizers(df, *FILES, radix=radix, fan_in=fan_in, chunk_rows=chunk_rows)
    want, pairs = plain(rows)
    assert sorted(map(str, (tuple(x) for x in got.documents.collect()))) == sorted(map(str, want))
    assert {tuple(x) for x in got.pairs.collect()} == pairs


def test_empty(spark):
    none = alignment.align_tokenizers(spark.createDataFrame([], "doc_id string, text string"), *FILES)
    assert none.documents.collect() == [] and none.pairs.collect() == []
    without = alignment.align_tokenizers(spark.createDataFrame([("a", None), ("a", "")], "doc_id string, text string"), *FILES)
    assert [tuple(r) for r in without.documents.collect()] == [("a", 0, 0, 0, 0, 0, 0, "")] * 2 and without.pairs.collect() == []


def test_merge_of_runs():
    r = np.random.RandomState(1)
    runs = [(np.unique(r.randint(0, 500, r.randint(0, 300))).astype(np.int64), None) for _ in range(9)]
    runs = [(k, r.randint(1, 9, len(k)).astype(np.int64)) for k, _ in runs]
    want = Counter()
    for k, c in runs:
        want.update(dict(zip(k.tolist(), c.tolist())))
    for block in (1, 7, 1000):
        parts = list(alignment.merged(runs, block))
        keys = np.concatenate([k for k, _ in parts])
        assert (np.diff(keys) > 0).all() and dict(zip(keys.tolist(), np.concatenate([c for _, c in parts]).tolist())) == want
        best = {int(k): bool(m) for k, _, m in (x for p in alignment.with_maxima(iter(parts), 10) for x in zip(*p))}
        assert best == {k: n == max(want[j] for j in want if j // 10 == k // 10) for k, n in want.items()}
