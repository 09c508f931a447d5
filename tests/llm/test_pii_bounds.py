"""Personal data beside words, numbers and marks that a pattern could take along."""
import re

from lociflow.llm import pii

IBANS = ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00",
         "NO93 8601 1117 947", "SE45 5000 0000 0583 9825 7466", "GB82WEST12345698765432"]


def test_ibans_end_where_their_country_says(documents):
    texts = [f"pay {x}{after}" for x in IBANS for after in (" BIC code", " AND", " 2024", " A1 B", ".", "")]
    got = {r.doc_id: r for r in pii.pseudonymise(documents(list(enumerate(texts))), "k").collect()}
    for i, text in enumerate(texts):
        x = IBANS[i // 6]
        new = got[i].text[4:4 + len(x)]
        assert got[i].n_iban == 1 and new != x and got[i].text == text.replace(x, new)
        s = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_telephone_numbers_end_at_fifteen_digits(documents):
    texts = ["+49 151 12345678 20240115", "+49 151 12345678", "+44 (020) 7946 0958 20240115 now", "1234567890 +49 151 12345678 20240115"]
    got = {r.doc_id: r for r in pii.pseudonymise(documents(list(enumerate(texts))), "k").collect()}
    assert all(got[i].n_phone == 1 for i in range(4))
    assert got[0].text == got[1].text + " 20240115" and "12345678" not in got[0].text and "7946 0958" not in got[2].text
    assert got[3].text == "1234567890 " + got[0].text


def test_addresses_start_after_marks(documents):
    texts = ["bob@x.org", "_bob@x.org", "-bob@x.org", "...bob@x.org", "%+bob@x.org", "bob.smith_1@x.org"]
    got = {r.doc_id: r for r in pii.pseudonymise(documents(list(enumerate(texts))), "k").collect()}
    assert all(r.n_email == 1 for r in got.values())
    for i, t in enumerate(texts[:5]):
        assert got[i].text == t.replace("bob@x.org", got[0].text)
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{5}_\d@[a-z]\.org", got[5].text)
