"""Each operator against a plain version of its definition on odd documents."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from lociflow.llm import (bytesplit, credentials, decontaminate, exact_dedup, licenses, packing, pii, quality, simhash, tokens, toxicity, urls)
from lociflow.llm.queries import vocabulary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


# --- exact dedup

def test_duplicate_groups(documents, odd_rows):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[plain(t)].append(i)
    want = []
    for i, t in odd_rows:
        g = groups[plain(t)]
        named = [x for x in g if x is not None]
        want.append((i, min(named) if named else None, len(g), hashlib.sha256(plain(t).encode()).hexdigest()))
    for fan_in in (2, 16):
        got = exact_dedup.duplicate_groups(documents(odd_rows, 7), fan_in=fan_in)
        assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
        kept = [(r.text_sha256, r.doc_id, r.keep_id) for r in got.where("kept").collect()]
        assert len(kept) == len({k[0] for k in kept}) == len(groups) and all(a == b for _, a, b in kept)


def test_rows_that_stay(documents, odd_rows):
    docs = documents(odd_rows)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in odd_rows})
    assert exact_dedup.exact_dedup(documents([])).count() == 0


# --- pseudonyms

PII = ["mail me: und.34@mail7.example.com now", "call +1 (017) 555-7713 or 555-123-4567", "card 4111 1111 1111 1111, not 4111 1111 1111 1112",
       "from 97.51.17.173 not 300.1.1.1", "born 2024-02-29, not 2023-02-30, or 31/12/1999 or 24.12.2001", "GB82 WEST 1234 5698 7654 32 is an account",
       "078-05-1120 but 000-12-3456", "again und.34@mail7.example.com", "4845168114407329", "nothing here", "", None]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_format_and_links(documents):
    got = {r.doc_id: r for r in pii.pseudonymise(documents(list(enumerate(PII))), "k").collect()}
    text = {i: r.text for i, r in got.items()}
    mail = re.search(r"\S+@\S+", text[0])[0]
    assert mail in text[7] and mail != "und.34@mail7.example.com" and re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mail)
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}", text[1]) and "555-7713" not in text[1]
    card = re.fullmatch(r"card ((?:\d{4} ){3}\d{4}), not 4111 1111 1111 1112", text[2])[1]
    assert luhn(card) and card != "4111 1111 1111 1111"
    assert "300.1.1.1" in text[3] and "97.51.17.173" not in text[3]
    assert all(int(o) < 256 for o in re.search(r"from ([\d.]+) ", text[3])[1].split("."))
    assert "2023-02-30" in text[4] and got[4].n_date == 3
    iban = re.match(r"(.*) is an account", text[5])[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "GB82WEST12345698765432"
    assert "000-12-3456" in text[6] and "078-05-1120" not in text[6]
    assert text[9] == PII[9] and text[10] == "" and text[11] is None
    assert {r.text for r in pii.pseudonymise(documents(list(enumerate(PII))), "other").collect()} != set(text.values())


def test_pseudonyms_are_a_permutation(spark):
    from pyspark.sql import functions as F
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert d.select(pii._permuted_digits(F.col("d"), "k", "t").alias("p")).distinct().count() == 1000
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    moved = days.select(pii._date(F.col("d"), "k").alias("p"))
    assert moved.distinct().count() == 3000 and moved.where("p IS NULL OR length(p) <> 10").count() == 0


# --- classifiers

@pytest.mark.parametrize("module,label,bad,good", [(toxicity, "toxic", "you utter moron and scum", "a calm and friendly remark"),
                                                     (quality, "quality", "readable prose about rivers", "### $$$ %%% click ###")])
def test_classifier_on_held_out_rows(spark, documents, module, label, bad, good):
    rng = np.random.RandomState(3)
    filler = ["river", "stone", "walks", "under", "green", "light", "seven", "often", "paper", "music"]
    rows, labels = [], []
    for i in range(400):
        y = int(rng.rand() < 0.4)
        w = list(rng.choice(filler, 30))
        w.insert(int(rng.randint(30)), bad if y else good)
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    rows += [(1000, None), (1001, ""), (None, "text"), (1002, "x " * 200000), rows[0]]
    labels += [(None, 1), (3, None), (9999, 1)]
    docs, marks = documents(rows), spark.createDataFrame(labels, f"doc_id long, {label} int")
    model = module.train(docs, marks)
    assert np.array_equal(model, module.train(docs.repartition(2), marks))
    score = module.score_toxicity if label == "toxic" else module.score_quality
    got = score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = dict(x for x in labels if x[1] is not None)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    empty = module.train(documents([]), marks)
    assert {r.score for r in score(docs, empty).collect()} == {0.5}
    assert score(documents([]), empty).count() == 0
    if label == "toxic":
        kept = toxicity.drop_toxic(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


# --- decontamination

def brute_contamination(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(size, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b:b + n] == v[a:a + n]:
                        hit.update(range(b, b + n))
                        if item is not None:
                            found.add(item)
        names = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [22, 15])
def test_contamination(spark, documents, odd_rows, bits):
    long = odd_rows[64][1].split()
    items = [(1, " ".join(long[50:80])), (2, " ".join(long[70:95]).upper()), (3, odd_rows[10][1]), (4, "the of"), (5, ""), (6, None),
             (7, "İ k"), (1, " ".join(long[50:80])), (None, " ".join(long[500:512])), (10, " ".join(long[90:130])), (8, "日本"), (9, "never; occurs - anywhere. at all, I hope so there")]
    docs = [r for r in odd_rows if r[0] != 104] + [(104, " , ".join(long[40:140]) + " the " + " ".join(long[495:520]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(docs), bench, filter_bits=bits)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute_contamination(docs, items)
    assert rows_of(got, *names) == want and any(r[5] for r in want) and not all(r[5] for r in want)
    kept = decontaminate.drop_contaminated(documents(docs), bench)
    assert kept.count() == sum(not r[5] for r in want) and kept.columns == documents(docs).columns
    assert decontaminate.contamination(documents([]), bench).count() == 0
    assert decontaminate.contamination(documents(docs), bench.limit(0)).where("contaminated").count() == 0


# --- credentials

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def brute_secrets(text):
    spans = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        spans += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]


def test_secrets(documents, odd_rows):
    hexa = "0123456789abcdef" * 3
    texts = [f'𝔸é token = "{hexa}" tail', "token = secret : abcdefghij", "API_KEY='short' password:longenough1", "AKIA" + "A1" * 6 + " AKIA123",
             f"AKIAAKIA{'Z' * 12} user: bob {hexa[:31]} {hexa}{hexa}", "Secret=abc.def-ghi_jkl== passwd:12345678 x " * 50,
             "no secret here: user=alice at https://db.example.com/x", "user=alice " + "y" * 900 + " token=abcdefgh12", "host 10.0.0.1 " + "z1Z" * 13 + "q",
             "z1Z" * 13 + "q alone", "login: carol password = hunter2hunter2 https://x.example.org"]
    rows = [(1000 + i, t) for i, t in enumerate(texts)] + odd_rows
    got = credentials.find_secrets(documents(rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, ",".join(brute_secrets(t))) for i, t in rows)
    base = Counter((r.doc_id, ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))) for r in got)
    assert base == want
    for r in got:
        of = [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(of).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in of) for k in ("assign", "access", "hex"))
    spans = {r.doc_id: r.spans for r in got}
    assert "endpoint" not in spans[1006] and "identifier" not in spans[1006]           # nothing completes them
    assert "identifier" not in spans[1007]                                             # the token is too far
    assert "key:14:54" in spans[1008] and "endpoint:5:13" in spans[1008] and spans[1009] == ""
    assert "identifier:0:12" in spans[1010] and "endpoint" in spans[1010]
    assert credentials.find_secrets(documents([])).count() == 0


# --- addresses

def test_url_rules_and_reputation(spark):
    pages = [(1, "http://A.Example.COM/en/1?x"), (2, "https://example.com/en/7/9"), (3, "notexample.com/en/7"), (4, None), (5, "x://host.net/de/8"),
             (6, "x://EXAMPLE.net/de/8#a"), (7, "://?q"), (8, "http://é.org/es/"), (8, "http://é.org/es/")]
    pages += [(100 + i, f"http://bad.spam.com/p{i}") for i in range(60)] + [(200 + i, f"http://good.fine.com/p{i}") for i in range(60)]
    pages += [(300, "http://new.spam.com/x"), (None, "http://bad.spam.com/y")]
    outcomes = [(100 + i, True) for i in range(40)] + [(200 + i, False) for i in range(40)] + [(100, False), (None, True), (250, None)]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad boolean"),
                           ("com/en/", "example.net/de/8", "org/es/"), ("example.com/en/7", "net/de/")).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    assert [(by[i].host, by[i].path, by[i].rule) for i in range(1, 9)] == [
        ("a.example.com", "/en/1", "com/en/"), ("example.com", "/en/7/9", "example.com/en/7"), ("", "", None), ("", "", None),
        ("host.net", "/de/8", "net/de/"), ("example.net", "/de/8", "example.net/de/8"), ("", "", None), ("é.org", "/es/", "org/es/")]
    assert by[1].verdict == "block" and by[2].verdict == "allow" and by[6].verdict == "block"
    assert by[159].verdict == "block" and by[None].verdict == "block" and by[259].verdict == "allow" and by[3].verdict == "allow"
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), none).count() == 0


# --- packing

def library_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_packing_round_trip(documents, odd_rows):
    rows = [(i, r[1]) for i, r in enumerate(odd_rows * 3)]
    ids = dict(zip([i for i, _ in rows], library_ids([t for _, t in rows])))
    for group_rows in (10, 4096):
        got = packing.pack(documents(rows), vocabulary(), capacity=512, group_rows=group_rows, fan_in=4).collect()
        of_doc, of_bin = defaultdict(list), defaultdict(list)
        for r in got:
            of_doc[r.doc_id].append(r)
            of_bin[r.sequence_id].append(r)
        assert set(of_doc) == set(ids)
        for i, parts in of_doc.items():
            whole, at = ids[i] + [0], 0
            for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
                assert (r.piece, r.start) == (k, at) and 0 < r.length <= 512 and (k == 0 or r.length == 512)
                assert r.ids_crc32 == zlib.crc32(np.array(whole[at:at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(whole)
        for parts in of_bin.values():
            at = 0
            for r in sorted(parts, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 512
        bound = packing.lower_bound(np.array([r.length for r in got]), 512)
        assert bound <= len(of_bin) <= bound * 1.06 + 2
    assert packing.pack(documents([]), vocabulary()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=9))
def test_bound_and_best_fit(lengths):
    x = np.array(lengths, np.int64)
    bins = packing.best_fit_decreasing(x, 60)
    n = int(bins.max()) + 1 if len(x) else 0
    assert all(x[bins == b].sum() <= 60 for b in range(n))

    def optimum(left, open_bins):
        if not left:
            return len(open_bins)
        best = optimum(left[1:], [*open_bins, left[0]])
        for i in {v: i for i, v in enumerate(open_bins)}.values():
            if open_bins[i] + left[0] <= 60 and best > 1:
                best = min(best, optimum(left[1:], [*open_bins[:i], open_bins[i] + left[0], *open_bins[i + 1:]]))
        return best
    best = optimum(sorted(lengths, reverse=True)[:7], [])
    assert packing.lower_bound(np.array(sorted(lengths, reverse=True)[:7], np.int64), 60) <= best


TOKENISER = tokens.Tokeniser(vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'Zstredlvm09²½ \n\t\xa0\x85.,-é×Ʃ日\x1c\U0001F600", max_size=30), max_size=5))
def test_ids_are_those_of_the_library(texts):
    assert [x.tolist() for x in TOKENISER.encode(pa.array(texts, pa.string()))] == library_ids(texts)


def test_special_string_is_the_librarys():
    texts = ["a <|endoftext|> b", None, "x" * 5000, "it's we'll 'tis don't 's"]
    assert [x.tolist() for x in TOKENISER.encode(pa.array(texts, pa.string()))] == library_ids(texts)


# --- fingerprints

def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), seed=42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    best = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        best[find(i)].append(d)
    least = {g: min((x for x in ds if x is not None), default=None) for g, ds in best.items()}
    return sorted([(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)], key=repr), len(best)


@pytest.mark.parametrize("cell_rows", [8192, 2])
def test_near_duplicates(documents, odd_rows, cell_rows):
    rows = [r for r in odd_rows if r[0] != 104]
    got = simhash.near_duplicates(documents(rows), cell_rows=cell_rows)
    want, n = brute_components(rows)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == want
    kept = simhash.drop_near_duplicates(documents(rows), cell_rows=cell_rows)
    assert kept.count() == n and kept.columns == documents(rows).columns
    assert simhash.near_duplicates(documents([])).count() == 0


def test_planted_fingerprints_share_a_cell():
    rng = np.random.RandomState(1)
    x = rng.randint(0, 1 << 62, 3000).astype(np.uint64) << np.uint64(2)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.randint(0, 64, 3000).astype(np.uint64)
    code, sub = simhash.PerfectCode(*simhash.GOLAY), simhash.PerfectCode(*simhash.HAMMING)

    def places(fp):
        out = [set() for _ in fp]
        for half in (0, 1):
            i, c = code.anchors(simhash._window(fp, 32 * half, 23))
            for a, b in zip(i.tolist(), c.tolist()):
                out[a].add((half, b))
        return out

    def below(fp, half):
        out = [set() for _ in fp]
        for quarter in (0, 1):
            i, c = sub.anchors(simhash._window(fp, 32 * (1 - half) + 16 * quarter, 15))
            for a, b in zip(i.tolist(), c.tolist()):
                out[a].add((quarter, b))
        return out
    a, b = places(x), places(y)
    assert all(p & q for p, q in zip(a, b)) and max(map(len, a)) <= 12
    for half in (0, 1):
        assert all(p & q for p, q in zip(below(x, half), below(y, half)))


def test_local_links_of_crowded_cells():
    rng = np.random.RandomState(2)
    fp = np.unique(rng.randint(0, 1 << 62, 1500).astype(np.uint64))
    chain = [int(fp[0])]
    for k in range(20):
        chain.append(chain[-1] ^ (0b101 << (3 * k)))
    fp = np.unique(np.concatenate([fp, np.array(chain, np.uint64)]))
    member, root = simhash.local_links(fp, 3)
    assert set(member.tolist()) >= set(chain) and len({r for m, r in zip(member.tolist(), root.tolist()) if m in chain}) == 1
    assert len(member) == len(chain)


# --- licences

def test_licenses(documents, odd_rows):
    texts = ["Text. Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
             "All rights reserved; ALL RIGHTS -- reserved", "Copyright (c) 2020 Some Body. All rights reserved.", "Released under the terms of the MIT License.",
             "licensed under the apache licence version 2.0", "cc  by", "general public", "Licensed under CC BY 4.0"]
    rows = [(1000 + i, t) for i, t in enumerate(texts)] + odd_rows
    got = licenses.scan_licenses(documents(rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        w, at = words(t), []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at += [(k, label) for k in range(len(w)) if w[k:k + len(p)] == p]
        want[i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    labels = {r.doc_id: r.labels for r in got}
    assert [labels[1000 + i] for i in range(10)] == [
        "apache-2.0", "cc-by,cc-by-nc", "gpl,gpl-3.0", "all-rights-reserved,reserved", "all-rights-reserved,reserved", "mit", "", "cc-by", "", "cc-by,cc-by-4.0"]
    scores = {r.doc_id: r.score for r in got}
    assert scores[1000] == 1 and 0 < scores[1006] < 1 and scores[101] == 0
    assert licenses.scan_licenses(documents([])).count() == 0


# --- words

@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ09 é日\n-\x7f\x00'", max_size=20), max_size=6))
def test_words_and_grams(texts):
    for first, data, at in bytesplit.chunks(pa.array(texts, pa.string())):
        w = bytesplit.Words(data, at)
        assert first == 0
        want = [words(t) for t in texts]
        assert [[w.word(i).decode() for i in range(w.of[d], w.of[d + 1])] for d in range(len(texts))] == want
        h, start = w.grams(3)
        grams = [(int(w.of[d]) + i, tuple(x[i:i + 3])) for d, x in enumerate(want) for i in range(len(x) - 2)]
        assert start.tolist() == [i for i, _ in grams]
        assert len(set(zip(h.tolist(), [g for _, g in grams]))) == len({g for _, g in grams}) == len(set(h.tolist()))


def test_ids_survive_forgetting(monkeypatch, odd_rows):
    monkeypatch.setattr(tokens, "MAX_KNOWN", 30)
    monkeypatch.setattr(tokens, "CHUNK", 200)
    texts = [t for _, t in odd_rows]
    assert [x.tolist() for x in tokens.Tokeniser(vocabulary()).encode(pa.array(texts, pa.string()))] == library_ids(texts)


def test_pieces_that_share_a_hash_keep_their_own_ids():
    """Two words of 2,048 letters that any polynomial modulo 2**64 takes for one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lociflow.llm import tokens
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"{other} {word}", word[:256] + " " + other[:256], "a b", None, ""]
    own = tokens.Tokeniser(path)
    original, tokens.LONGEST = tokens.LONGEST, 4096        # as remembered pieces, so that only the comparison tells them apart
    try:
        for _ in range(2):
            got = [x.tolist() for x in own.encode(pa.array(texts, pa.string()))]
            assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    finally:
        tokens.LONGEST = original
    assert [x.tolist() for x in tokens.Tokeniser(path).encode(pa.array(texts, pa.string()))] == got
