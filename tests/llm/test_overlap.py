"""The pipeline's near-copy stage against all pairs of 5-word shingle sets."""
import random

import pytest

import corpus_pipeline
from lociflow.llm import overlap


def grams(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def survivors(rows, similarity=0.8):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similarity:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {min(g) for g in groups.values()}


def prose(r, n):
    return ["w%d" % r.randrange(5000) for _ in range(n)]


def changed(words, places):
    out = list(words)
    for p in places:
        out[p] = "other%d" % p
    return out


def test_stage_finds_pairs_of_similarity_80_to_95(spark, documents, tmp_path):
    r, rows, alike = random.Random(3), [], {}
    for k in range(240):
        n, changes = r.choice([(200, 1), (200, 2), (200, 3), (200, 4), (60, 1), (1000, 5), (200, 5), (200, 7), (54, 1)])
        one = prose(r, n)
        two = changed(one, [n * (2 * i + 1) // (2 * changes) for i in range(changes)])
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
        alike[2 * k + 1] = jaccard(grams(rows[-2][1]), grams(rows[-1][1]))
    left = {x.doc_id for x in corpus_pipeline.without_near_copies(spark, documents(rows), str(tmp_path)).collect()}
    for least in (0.8, 0.85, 0.9):
        near = {i for i, s in alike.items() if least <= s}
        assert len(near) > 20 and len(near & left) == 0
    far = {i for i, s in alike.items() if s < 0.8}
    assert len(far) > 20 and far <= left


@pytest.mark.parametrize("block", [1024, 3])
def test_near_copies_are_those_of_all_pairs(documents, block):
    r = random.Random(4)
    base = prose(r, 80)
    rows = [(i, " ".join(prose(r, r.choice([1, 4, 5, 6, 30])))) for i in range(40)]
    at = 100
    for step in range(30):                                 # a chain: neighbours alike, ends not
        base = changed(base, [(step * 7) % 80])
        base[(step * 7) % 80] += "x%d" % step
        rows.append((at + step, " ".join(base)))
    wide = prose(r, 90)
    for k in range(40):                                    # a crowd around the limit
        rows.append((200 + k, " ".join(changed(wide, r.sample(range(90), r.choice([1, 2, 3]))))))
    rows += [(300, ""), (301, None), (302, " \n"), (303, rows[0][1].upper()), (304, rows[0][1])]
    got = overlap.drop_near_copies(documents(rows, 5), block=block)
    assert {x.doc_id for x in got.collect()} == survivors(rows)
    assert got.columns == documents(rows).columns
    assert overlap.drop_near_copies(documents([]), block=block).count() == 0
