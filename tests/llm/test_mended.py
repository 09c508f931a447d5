"""Cases around a value, beside it and before it that once changed what was found."""
import itertools
import random
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import credentials, decontaminate, licenses, pii, quality, toxicity
from lociflow.llm.licenses import TEMPLATES


@pytest.mark.parametrize("marks", [[], [(i, None) for i in range(8)], [(i, 1) for i in range(8)], [(i, 0) for i in range(8)]])
def test_no_usable_labels_keep_every_document(spark, documents, marks):
    docs = documents([(i, f"text number {i}") for i in range(8)] + [(None, None)])
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    with warnings.catch_warnings(record=True) as met:
        warnings.simplefilter("always")
        assert toxicity.drop_toxic(docs, model).count() == 9
    assert any("no labels of both classes" in str(w.message) for w in met)
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.5}


def test_columns_of_any_name_pass_the_toxicity_stage(spark, documents):
    docs = documents([(i, "calm words here" if i % 2 else "you utter scum") for i in range(40)])
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int")
    odd = docs.select("*", F.lit(1).alias("__text"), F.lit(2).alias("toxicity__score"), F.lit(3).alias("a.b"), F.lit(4).alias("score"), F.lit(5).alias("row"), F.lit(6).alias("hash"))
    model = toxicity.train(odd, labels)
    out = toxicity.drop_toxic(odd, model)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == set(range(1, 40, 2))
    assert out.first()["a.b"] == 3 and toxicity.drop_toxic(odd.limit(0), model).count() == 0


def test_one_identifier_repeated_is_one_row_of_training(spark, documents):
    from lociflow.llm.model import training_rows
    docs = documents([(1, "one")] * 300 + [(1, "uno"), (2, "two"), (3, None), (4, "")])
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id long, toxic int")
    assert training_rows(docs, labels, "toxic", 10).count() == len([i for i in (1, 2, 3, 4) if __import__("zlib").crc32(str(i).encode()) % 5])


def plain_bayes_weights(rows, y):
    """Naive Bayes ratios and AdaGrad steps of the toxicity model, written out with dictionaries."""
    n = 1 << toxicity.BITS
    count = {0: {}, 1: {}}
    for (i, _), label in zip(rows, y):
        for b in i.tolist():
            count[int(label)][b] = count[int(label)].get(b, 0) + 1
    total = {c: n + sum(count[c].values()) for c in (0, 1)}
    ratio = {}
    for b in {*count[0], *count[1]}:
        a1, a0 = count[1].get(b, 0), count[0].get(b, 0)
        ratio[b] = (np.log((a1 + 1) / total[1]) - np.log((a0 + 1) / total[0])) * (a0 + a1) / (a0 + a1 + 5)
    w, seen, bias, bias2 = {}, {}, 0.0, 1e-8
    order = np.random.RandomState(7)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            i = rows[k][0].tolist()
            norm = 1 / np.sqrt(max(1.0, sum(ratio[b] ** 2 for b in i)))
            z = sum(w.get(b, 0.0) * ratio[b] for b in i) * norm + bias
            g = 1 / (1 + np.exp(-z)) - y[k]
            for b in i:
                d = g * norm * ratio[b] + toxicity.L2 * w.get(b, 0.0)
                seen[b] = seen.get(b, 1e-8) + d * d
                w[b] = w.get(b, 0.0) - toxicity.RATE * d / np.sqrt(seen[b])
            bias2 += g * g
            bias -= toxicity.RATE * g / np.sqrt(bias2)
    return w, ratio, bias


def test_toxicity_weights_by_plain_steps():
    r = np.random.RandomState(1)
    rows = [(np.unique(r.randint(0, 60, 12)), None) for _ in range(30)]
    y = np.array([k % 2 for k in range(30)], np.float32)
    model, n = toxicity.fit(rows, y), 1 << toxicity.BITS
    w, ratio, bias = plain_bayes_weights(rows, y)
    for b in w:
        assert model[b] == pytest.approx(w[b], rel=1e-6, abs=1e-9) and model[n + b] == pytest.approx(ratio[b], rel=1e-6, abs=1e-9)
    assert model[2 * n] == pytest.approx(bias, rel=1e-6) and model[-1] == 1


@pytest.mark.parametrize("text,kind", [("DE12 4111 1111 1111 1111", "card"), ("card ID42 4111 1111 1111 1111 end", "card"),
                                       ("DE12 4111 1111 1111 1111 11", "card"), ("FR12 bob@x.org", "email")])
def test_nothing_valid_stays_behind_what_is_no_iban(documents, text, kind):
    row = pii.pseudonymise(documents([(1, text)]), "k").first()
    assert "4111 1111 1111 1111" not in row.text and "bob@x.org" not in row.text and row[f"n_{kind}"] == 1 and row.n_iban == 0
    assert len(row.text) == len(text) and row.text[:4] == text[:4]


def test_one_pseudonym_for_one_number(documents):
    texts = ["+49 151 12345678", "+4915112345678", "+49-151-12345678", "+1 202 555 0143", "+12025550143", "(202) 555-0143", "202-555-0143", "+420 601 123 456", "+420601123456"]
    got = {r.doc_id: re.sub("[^+0-9]", "", r.text) for r in pii.pseudonymise(documents(list(enumerate(texts))), "k").collect()}
    assert got[0] == got[1] == got[2] and got[0].startswith("+49") and got[0] != "+4915112345678"
    assert got[3] == got[4] == "+1" + got[5] and got[5] == got[6] and got[7] == got[8] and got[7].startswith("+420")


def test_values_are_found_in_any_surroundings(documents):
    values = ["bob@x.org", "GB82 WEST 1234 5698 7654 32", "2023-02-28", "97.51.17.173", "078-05-1120", "+49 151 12345678", "4111 1111 1111 1111"]
    around = [("", ""), ("x ", " y"), ("(", ")"), ("AB12 ", " CD"), ("\n", "\n"), (": ", ","), ("no ", " page 17")]
    rows = [(k, a + v + b) for k, (v, (a, b)) in enumerate(itertools.product(values, around))]
    got = {r.doc_id: r.text for r in pii.pseudonymise(documents(rows), "k").collect()}
    for k, (v, (a, b)) in enumerate(itertools.product(values, around)):
        assert got[k].startswith(a) and got[k].endswith(b) and v not in got[k], (rows[k], got[k])


def test_spans_move_with_the_text(documents):
    pair = "user=alice" + " " * 230 + "token=abcdefgh12"
    rows = [(k, "." * k + pair) for k in range(0, 1000, 7)] + [(10000 + d, "user=alice" + " " * d + "token=abcdefgh12") for d in (389, 390, 391, 900)]
    got = {r.doc_id: r.spans for r in credentials.find_secrets(documents(rows)).collect()}
    for k in range(0, 1000, 7):
        assert got[k] == f"identifier:{k}:{k + 10},assign:{k + 240}:{k + 256}"
    assert [got[10000 + d].count("identifier") for d in (389, 390, 391, 900)] == [1, 1, 0, 0]


def brute_weak(text, scope=400):
    """Weak parts with a complement that starts at most ``scope`` away."""
    parts = []
    for i, (kind, pattern, group, least, role, _) in enumerate(credentials.KINDS):
        parts += [(m.start(), i, m.end(), role) for m in re.finditer(pattern.replace("\\x20", " "), text) if len(m[group]) >= least]
    return sorted((s, i, e) for s, i, e, role in parts if i < credentials.N_BASE or any(
        o in credentials.COMPLETED_BY[role] and abs(s - t) <= scope for t, _, _, o in parts))


def test_parts_by_distance(documents):
    r = random.Random(9)
    bits = ["user=alice", "token=abcdefgh12", "https://db.example.com", "AKIA" + "A1" * 8, "z1Z" * 13 + "q", "login: carol"]
    rows = [(k, "".join(r.choice(bits) + " " * r.choice([1, 30, 200, 380, 500]) for _ in range(8))) for k in range(60)]
    for row in credentials.find_secrets(documents(rows)).collect():
        want = ",".join(f"{credentials.KINDS[i][0]}:{s}:{e}" for s, i, e in brute_weak(rows[row.doc_id][1]))
        assert row.spans == want


def expanded(template, r):
    """A random plain wording that the template allows."""
    template = re.sub(r"^<![^>]*>\s*", "", template)
    parts = re.findall(r"\[|\]|\||\{\d+-\d+(?::[^}]*)?\}|[^\s\[\]|{}]+", template)

    def walk(i):
        options, words = [], []
        while i < len(parts):
            p = parts[i]
            if p == "[":
                inner, i = walk(i + 1)
                words += r.choice([inner, []])
            elif p == "]":
                break
            elif p == "|":
                options.append(words)
                words = []
            elif p[0] == "{":
                low, high, of = re.fullmatch(r"\{(\d+)-(\d+)(?::([^}]*))?\}", p).groups()
                words += [r.choice(of.split("|") if of else ["some", "body", "2020"]) for _ in range(r.randint(int(low), int(high)))]
            else:
                words.append(p)
            i += 1
        return r.choice([*options, words]), i
    return walk(0)[0]


def test_every_template_accepts_its_wordings_and_no_other(documents):
    r, rows, want = random.Random(2), [], {}
    for label, templates in TEMPLATES.items():
        for template in templates:
            for _ in range(4):
                words = expanded(template, r)
                rows.append((len(rows), "before it. " + " ".join(words).capitalize() + ", behind it"))
                want[len(rows) - 1] = (label, True)
                if len(words) > 20:                        # a word of the wording replaced
                    k = r.randint(10, len(words) - 10)
                    rows.append((len(rows), " ".join([*words[:k], "otherwise", "so", "what", *words[k + 1:]])))
                    want[len(rows) - 1] = (label, None)
    got = {row.doc_id: row for row in licenses.scan_licenses(documents(rows)).collect()}
    for k, (label, accepted) in want.items():
        if accepted:
            assert label in got[k].labels.split(",") and got[k].score == 1, (rows[k], label)
    changed = [k for k, (label, accepted) in want.items() if accepted is None]
    assert sum(want[k][0] not in got[k].labels.split(",") for k in changed) > 0.8 * len(changed)


def test_lesser_and_affero_are_not_the_plain_licence(documents):
    texts = ["GNU Lesser General Public License, version 2.1", "GNU Affero General Public License version 3", "GNU Library General Public License version 2",
             "the GNU General Public License, version 2", "General Public License version 3"]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(documents(list(enumerate(texts)))).collect()}
    assert [("gpl-2.0" in got[k], "gpl-3.0" in got[k]) for k in range(5)] == [(False, False), (False, False), (False, False), (True, False), (False, True)]
    assert "lgpl" in got[0] and "agpl-3.0" in got[1]


def test_quality_needs_no_labels(spark, documents):
    docs = documents([(1, "a text"), (None, None), (2, "")])
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, model).collect())


def test_shingles_that_share_a_hash_are_told_apart(spark, documents):
    """Words that any polynomial modulo 2**64 takes for one, as benchmark items and in documents."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    bench = spark.createDataFrame([(1, f"{one} and more of it here"), (2, f"{other} and more of it here"), (3, f"{one} {other}")], "item_id long, text string")
    docs = documents([(1, f"see {one} and more of it here."), (2, f"see {other} and more of it here."), (3, f"{one} x {other}"), (4, f"{other} {one}")])
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (6, ["1"]), 2: (6, ["2"]), 3: (0, []), 4: (0, [])}


def test_prefix_is_the_rarest_shingle(spark, documents):
    common, rare = "the of and in to", "quartz of nine old brown boxes"
    bench = spark.createDataFrame([(1, f"{common} {rare}")], "item_id long, text string")
    docs = documents([(k, f"{common} and so on {k}") for k in range(200)] + [(500, f"well {common} {rare} then"), (501, f"{common} {rare[:-6]}")])
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
    assert got == {500: 11, 501: 10} or got == {500: 11}


def test_packing_feeds_python_few_texts_at_once(spark, monkeypatch):
    """A batch of 10 000 texts lay in each executor and again in its worker, and all its new pieces in the library."""
    from lociflow.llm import packing, tokens
    from lociflow.llm.queries import vocabulary
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(key), packing.Scratch.write

    def noted(self, df, name):
        seen.append((name, int(spark.conf.get(key))))
        return write(self, df, name)
    monkeypatch.setattr(packing.Scratch, "write", noted)
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(3000)], "doc_id long, text string")
    assert packing.pack(docs, vocabulary()).count() == 3000
    assert dict(seen)["pieces"] <= 1024 and spark.conf.get(key) == before

    learned, learn = [], tokens.Tokeniser._learn
    monkeypatch.setattr(tokens.Tokeniser, "_learn", lambda self, keys, pieces: (learned.append(len(keys)), learn(self, keys, pieces)))
    import pyarrow as pa
    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(40)]
    own = tokens.Tokeniser(vocabulary())
    got = [x.tolist() for x in own.encode(pa.array(texts))]
    assert got == [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(learned) <= 4096
