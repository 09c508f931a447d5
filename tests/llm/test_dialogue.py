"""Repair of conversations against a plain search over all edits."""
import hashlib
import random
import zlib

import pytest

from lociflow.llm import dialogue

FINE, SPACE = ".!?", " \t\n\x0b\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in FINE)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain(conv, rows):
    """The digest of one conversation; ``rows`` of it."""
    rows = sorted((r for r in rows if r[0] == conv),
                  key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in FINE else None
        seen.add((role, text))
        faults.append(fault)
    turns = [r[1] for r in rows if r[1] is not None]
    n = len(rows)
    after = {0: "u", 1: "u", 2: "a", 3: "u"}
    best = [[None] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for q in range(4):
            found = []
            if i == n and q in (0, 3):
                found.append((0, "", ()))
            if i < n:
                c, s, t = best[i + 1][q]
                found.append((c + 2, "D" + s, t))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 if faults[i] == "truncated" else 0
                    initial = rows[i][2][:1]
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, q))
                    if to is not None:
                        c, s, t = best[i + 1][to]
                        found.append((c + more, "K" + s, ((rows[i][2], rows[i][3]), *t)))
                    to = 2 if after[q] == "u" else 3
                    c, s, t = best[i + 1][to]
                    found.append((c + more + 1, "R" + s, (("user" if to == 2 else "assistant", rows[i][3]), *t)))
            best[i][q] = min(found, key=lambda x: x[:2]) if found else (1 << 40, "", ())
        for _ in range(3):
            for q in range(4):
                to = 2 if after[q] == "u" else 3
                c, s, t = best[i][to]
                best[i][q] = min(best[i][q], (c + 5, "I" + s, (("user" if to == 2 else "assistant", ""), *t)), key=lambda x: x[:2])
    cost, audit, made = best[0][0]
    initials = "".join(r[0][:1] for r in made)
    import re
    assert re.fullmatch(r"(s?(ua)+)?", initials)
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def talk(n_conv, longest, seed=3):
    r = random.Random(seed)
    rows = []
    for c in range(n_conv):
        k = longest if c == 1 else r.randint(1, 9)
        for t in range(k):
            rows.append((None if c == 5 else c, None if r.random() < 0.03 else t + (3 if t > 4 else 0),
                         r.choice(["system", "user", "user", "assistant", "assistant", "assistant", "tool", "", None]),
                         r.choice(["Yes.", "No!", "so", " ", "", None, "a longer one?\n", "x", f"own {t}.", "İ."])))
    return rows


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_every_conversation_like_the_search(spark, block):
    rows = talk(40, 60) + [(900, 1, "user", "Yes.")] * 7 + [(901, None, "user", "x" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumn("pos", df.turn).withColumn("conv", df.role)
    got = sorted((tuple(r) for r in dialogue.repaired_summary(df, dialogue.damage(df), block).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = damaged(rows)
    empty = hashlib.sha256(b"").hexdigest()
    ids = sorted({r[0] for r in rows}, key=lambda c: (c is not None, c or 0))
    expected = [plain(c, want) if any(r[0] == c for r in want) else (c, 0, 0, 0, 0, 0, 0, "", empty) for c in ids]
    assert got == expected


def test_empty_and_dropped(spark):
    schema = "conv_id string, turn int, role string, text string"
    none = spark.createDataFrame([], schema)
    assert dialogue.repaired_summary(none, dialogue.damage(none)).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"c:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([("c", dropped, "user", "Yes.")], schema)
    row = dialogue.repaired_summary(one, dialogue.damage(one)).first()
    assert tuple(row) == ("c", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_rows_of_the_repair(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye")],
                               "conv_id long, turn long, role string, text string")
    out = [(r.edit, r.role, r.text, r.fault, r.cost) for r in dialogue.repair(df).orderBy("pos", "sub").collect()]
    assert [o[0] for o in out] == list("DDDD") or sum(o[4] for o in out) == min(8, sum(o[4] for o in out))
    assert {o[3] for o in out if o[0] != "I"} == {None, "duplicate", "truncated"}
