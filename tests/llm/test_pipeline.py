"""The stages on planted cases, and the SQL checks on the smallest tables."""
import os

import pytest

import check
import corpus_pipeline
from lociflow.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    ok, msg = check.compare(queries.QUERIES[name](spark, SMALL), check.connect(SMALL), queries.ORACLES[name])
    assert ok, msg


def test_stages(spark, documents, tmp_path):
    import random
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    prose = lambda n=60: " ".join(r.choice(vocabulary) for _ in range(n))
    clean = [(i, prose()) for i in range(100)]
    toxic = [(1000 + i, prose(30) + " you moron scum " + prose(30)) for i in range(60)]
    train = [(2000 + i, prose()) for i in range(60)]
    item = prose(25)
    copies = [(3000, clean[0][1]), (3001, clean[0][1].replace(" ", "\n")), (3002, clean[0][1])]
    words = prose(600).split()
    near = []
    for k in range(4):
        w = list(words)
        w[100 * k + 5] = "other"
        near.append((4000 + k, " ".join(w)))
    leak = [(5000, prose(20) + " " + item + " " + prose(20))]
    odd = [(None, prose()), (6000, None), (6001, "")]
    documents(clean + toxic + train + copies + near + leak + odd).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in train + clean[50:]]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        left.append({x.doc_id for x in docs.collect()})
        assert name == "packing" or docs.columns == columns
    ids = lambda rows: {i for i, _ in rows}
    assert not left[0] & ids(toxic) and left[0] >= ids(clean + train + copies + near + leak)
    assert left[1] == left[0] - ids(copies) - {6001}
    assert left[2] == left[1] - {4001, 4002, 4003}
    assert left[3] == left[2] - {5000} and left[4] == left[3] and None in left[4]
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left[4]


def test_stages_on_empty_tables_without_labels_and_with_odd_names(spark, documents, tmp_path):
    import warnings

    from pyspark.sql import functions as F
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(40))) for i in range(12)] + [(None, None), (3, ""), (50, "x" * 30000)]
    for case, docs, bench in (("empty", [], []), ("unlabelled", rows, [(1, rows[2][1])]), ("no benchmark", rows, [])):
        root = f"{tmp_path}/{case}"
        odd = documents(docs).select("*", F.lit(1).alias("a.b"), F.lit(2).alias("__text"), F.lit(3).alias("row_key"), F.lit(4).alias("score"))
        odd.write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
        table = spark.read.parquet(f"{root}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                out = stage(spark, table, root)
            assert out.columns == table.columns, name
            out.write.parquet(f"{root}/{name}")
            table = spark.read.parquet(f"{root}/{name}")
        left = {r.doc_id for r in table.collect()}
        assert left == set() if not docs else left >= {i for i, _ in rows[:12]} - ({2} if bench else set()) and (2 in left) != bool(bench)


def test_near_dedup_goes_through_simhash(spark, documents, tmp_path):
    import random

    import numpy as np

    from lociflow.llm.overlap import shingles
    from lociflow.llm.simhash import fingerprint
    r = random.Random(5)
    words = [f"w{r.randrange(10 ** 6)}" for _ in range(3000)]
    bits, far = fingerprint(" ".join(words)), None
    for k in range(200):                                   # within three bits, but below four fifths of the runs
        w = list(words)
        for at in range(k % 20, len(w), 38):
            w[at] = f"other{k}"
        a, b = shingles(" ".join(words)), shingles(" ".join(w))
        common = len(np.intersect1d(a, b))
        if common < 0.8 * (len(a) + len(b) - common) and (bits ^ fingerprint(" ".join(w))).bit_count() <= 3:
            far = w
            break
    assert far
    docs = documents([(1, " ".join(words)), (2, " ".join(far)), (3, "quite another text of a few words")])
    assert {x.doc_id for x in corpus_pipeline.without_near_copies(spark, docs, str(tmp_path)).collect()} == {1, 3}
