import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from ``(doc_id, text)`` pairs, in the columns of the table, with a column of a clashing name."""
    def make(rows, partitions=3):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(rows, SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
        return df.repartition(partitions)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, copies, near copies, characters beyond ASCII."""
    r = random.Random(5)
    vocabulary = ["the", "of", "and", "straße", "naïve", "İ", "k", "ñandú", "Alpha", "beta9", "x'll", "don't", "12", "日本", "Ünï", "to", "in"]
    vocabulary += ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(300)]
    text = lambda n: r.choice([" ", " ", "\n", "  ", "\t"]).join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, text(r.choice([1, 2, 3, 9, 10, 11, 40, 120]))) for i in range(60)]
    long = " ".join(r.choice(vocabulary) for _ in range(30000))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, ""), (104, long), (None, "a row without number"), (None, rows[3][1]), (None, None)]
    rows += [rows[5], rows[5], (105, rows[7][1]), (106, rows[7][1].replace(" ", "\n ")), (6, "another text of number six")]
    words = rows[59][1].split() + long.split()[:200]
    for k in range(12):                                    # near copies of one text
        w = list(words)
        w[10 * k] = "changed"
        rows.append((200 + k, " ".join(w)))
    return rows
