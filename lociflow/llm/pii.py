"""Keyed pseudonyms that keep the format of personal data."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
# Characters of an IBAN by country, and the country codes of telephone numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
COUNTRY_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"


def _iban_body(length: int) -> str:
    last = f" ?[A-Z0-9]{{{length % 4}}}" if length % 4 else ""
    return f"[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{length // 4 - 1}}}{last}(?![A-Za-z0-9])"


OF_COUNTRY = "|".join(f"(?:{names.replace(' ', '|')}){_iban_body(n)}" for n, names in IBAN_LENGTHS.items())
OVER_15 = "[0-9][ .()-]{0,2}" * 16
# Candidates, tried in this order at each place of a text.
PATTERNS = {
    "email": "(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\\.){1,8}[A-Za-z]{2,24}",
    "iban": f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{OF_COUNTRY})",
    "date": "(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\\.[0-9]{2}\\.[0-9]{4})(?![0-9/-])",
    "ip": "(?<![0-9.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![0-9]|\\.[0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": "(?:\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}" + f"(?<!{OVER_15})" +
             "|\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": "(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
WITHIN_IBAN = "|".join(p for kind, p in PATTERNS.items() if kind != "iban")       # what a candidate that is no IBAN may hold
CYCLE = 146097          # days after which the Gregorian calendar repeats, 189 * 773


def _shift(key: str, tweak: str, round_no: Column, value: Column) -> Column:
    """A number below 2**60 that depends on the key, the format, the round and the other half."""
    seed = F.concat_ws("|", F.lit(key), F.lit(tweak), round_no.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long")


def _feistel(u: Column, v: Column, a: Column, b: Column, key: str, tweak: str) -> Column:
    """Permutes the pairs (u below a, v below b): the halves shift each other in turn."""
    def turn(s, i):
        return F.struct(F.when(i % 2 == 0, F.pmod(s["u"] + _shift(key, tweak, i, s["v"]), a)).otherwise(s["u"]).alias("u"),
                        F.when(i % 2 == 1, F.pmod(s["v"] + _shift(key, tweak, i, s["u"]), b)).otherwise(s["v"]).alias("v"))
    start = F.struct(u.cast("long").alias("u"), v.cast("long").alias("v"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn)


def _with(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _refilled(t: Column, digits: Column, cls: str = "[0-9]") -> Column:
    """The characters of class ``cls`` in ``t`` replaced in order; null where ``digits`` is."""
    gaps = F.split(t, cls, -1)
    filled = F.transform(F.sequence(F.lit(1), F.size(gaps) - 1), lambda i: F.concat(F.element_at(gaps, i), F.substr(digits, i, F.lit(1))))
    return F.when(digits.isNotNull(), F.concat(F.array_join(filled, ""), F.element_at(gaps, -1)))


def _permuted_digits(d: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 18 digits permuted among those of its length."""
    n = F.length(d)
    left = F.floor((n + 1) / 2).cast("int")
    p = _feistel(F.substr(d, F.lit(1), left), F.substr(d, left + 1), F.pow(F.lit(10), left).cast("long"),
                 F.pow(F.lit(10), n - left).cast("long"), key, tweak)
    return _with(p, lambda x: F.concat(F.lpad(x["u"].cast("string"), left, "0"), F.lpad(x["v"].cast("string"), n - left, "0")))


def _permuted_characters(s: Column, key: str, tweak: str) -> Column:
    """Letters and digits permuted within their own class, everything else in place."""
    left = F.floor((F.length(s) + 1) / 2).cast("int")

    def moved(half, other, i):
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), F.length(half).cast("string"), other), 256)

        def one(j):
            c = F.substr(half, j, F.lit(1))
            by = F.conv(F.substr(stream, F.pmod(j * 3, F.lit(59)) + 1, F.lit(6)), 16, 10).cast("long")

            def turned(first: str, n: int):
                return F.chr(F.pmod(F.ascii(c) - ord(first) + by, F.lit(n)) + ord(first))
            return (F.when(c.between("0", "9"), turned("0", 10)).when(c.between("a", "z"), turned("a", 26))
                    .when(c.between("A", "Z"), turned("A", 26)).otherwise(c))
        return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), "")).otherwise("")

    def turn(x, i):
        return F.struct(F.when(i % 2 == 0, moved(x["u"], x["v"], i)).otherwise(x["u"]).alias("u"),
                        F.when(i % 2 == 1, moved(x["v"], x["u"], i)).otherwise(x["v"]).alias("v"))
    start = F.struct(F.substr(s, F.lit(1), left).alias("u"), F.substr(s, left + 1).alias("v"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn, lambda x: F.concat(x["u"], x["v"]))


def _luhn_sum(d: Column, doubled: int) -> Column:
    """Luhn sum of digits; ``doubled`` is the parity, counted from the right, of doubled places."""
    def add(s, i):
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        y = F.when(i % 2 == doubled, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return s + y
    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)


def _card(t: Column, key: str) -> Column:
    def new(d):
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        moved = _with(_permuted_digits(body, key, "card"), lambda b: F.concat(b, F.pmod(-_luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.when(F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0), moved)
    return _refilled(t, _with(_digits(t), new))


def _mod97(s: Column) -> Column:
    def add(m, i):
        c = F.substr(s, i, F.lit(1))
        return F.when(c.between("A", "Z"), (m * 100 + F.ascii(c) - 55) % 97).otherwise((m * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _iban(t: Column, key: str) -> Column:
    def new(s):
        country, body = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5))
        moved = _with(_permuted_characters(body, key, "iban"), lambda b: F.concat(
            country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(_mod97(F.concat(body, F.substr(s, F.lit(1), F.lit(4)))) == 1, moved)
    return _refilled(t, _with(F.regexp_replace(t, " ", ""), new), "[A-Z0-9]")


def _date(t: Column, key: str) -> Column:
    def moved(form: str):
        def new(day):
            at = F.datediff(day, F.lit("1600-01-01").cast("date")).cast("long")
            inside = F.pmod(at, F.lit(CYCLE))
            p = _feistel(F.floor(inside / 773), inside % 773, F.lit(189), F.lit(773), key, "date")
            return F.date_format(_with(p, lambda x: F.date_add(day, (x["u"] * 773 + x["v"] - inside).cast("int"))), form)
        return _with(F.try_to_date(t, form), new)
    return (F.when(t.contains("-"), moved("yyyy-MM-dd")).when(t.contains("."), moved("dd.MM.yyyy"))
            .otherwise(F.coalesce(moved("dd/MM/yyyy"), moved("MM/dd/yyyy"))))


def _ip(t: Column, key: str) -> Column:
    def new(o):
        at = [F.element_at(o, i).cast("long") for i in (1, 2, 3, 4)]
        p = _feistel(at[0] * 256 + at[1], at[2] * 256 + at[3], F.lit(65536), F.lit(65536), key, "ip")
        split = _with(p, lambda x: F.concat_ws(".", *(y.cast("string") for y in (
            F.floor(x["u"] / 256), x["u"] % 256, F.floor(x["v"] / 256), x["v"] % 256))))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), split)
    return _with(F.split(t, "\\."), new)


def _ssn(t: Column, key: str) -> Column:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""
    def new(d):
        area, rest = F.substr(d, F.lit(1), F.lit(3)).cast("long"), F.substr(d, F.lit(4)).cast("long")
        group, serial = F.floor(rest / 10000), rest % 10000
        p = _feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
        out = _with(p, lambda x: F.concat(
            F.lpad((x["u"] + 1 + (x["u"] > 664).cast("int")).cast("string"), 3, "0"),
            F.lpad((F.floor(x["v"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["v"] % 9999 + 1).cast("string"), 4, "0")))
        return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), out)
    return _refilled(t, _with(_digits(t), new))


def _phone(t: Column, key: str) -> Column:
    """The country code stays, whether a separator follows it or not; the digits behind it are the number."""
    def new(d):
        code = F.when(t.startswith("+"), F.regexp_extract(d, f"^(?:{COUNTRY_CODE})", 0)).otherwise("")
        rest = F.substr(d, F.length(code) + 1)
        return F.when(F.length(rest).between(4, 15) & F.length(d).between(7, 15), F.concat(code, _permuted_digits(rest, key, "phone")))
    return _refilled(t, _with(_digits(t), new))


def _email(t: Column, key: str) -> Column:
    """The last label of the domain stays."""
    last = F.concat(F.lit("."), F.substring_index(t, ".", -1))
    return F.concat(_permuted_characters(F.substr(t, F.lit(1), F.length(t) - F.length(last)), key, "email"), last)


NEW = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_email, n_iban, n_date, n_ip, n_ssn, n_phone, n_card`` of every row.

    Candidates are found by pattern and validated: Luhn for cards, modulo 97 for
    IBAN, the calendar for dates, octets for addresses, issued ranges for social
    security numbers, length for telephone numbers. A valid value is permuted
    under ``key`` by an eight-round Feistel network over the valid values of its
    format, so the result is valid again, equal values become equal pseudonyms in
    every document, and different ones stay different (e-mail and IBAN letters
    and digits move within their class). What fails validation is left alone.
    An IBAN has the length of its country and a telephone number at most 15 digits already in
    the pattern, so a word or number after one is not taken with it; what looks like an IBAN and is none is searched
    for the other kinds. A telephone number is its country code, by the public table of codes, and the digits behind it, however
    they are separated; a trunk zero in brackets counts as a digit. IPv6 addresses and e-mail addresses beyond ASCII are not looked for.
    Nothing is shuffled: equality comes from the key, not from a table.

    Null text stays null with zero counts; empty text stays empty; very long texts are read whole; an empty table gives none; repeated rows
    each get a row; null identifiers stay. Only the two named columns are read. ``key`` should come
    from a secret store; whoever has it can link guesses to pseudonyms.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = F.when(F.col("text").rlike(ANY), F.struct(
        F.split("text", ANY, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("hits")))

    def kind_of(t, kinds):
        out = F.lit(None).cast("string")
        for kind in reversed(kinds):
            out = F.when(t.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
        return out

    def pieces(gap, old, kinds):
        """One hit as ``gap, kind, old, new``; one that is no IBAN as the hits within it."""
        def by_kind(kind):
            new = F.lit(None).cast("string")
            for name in kinds:
                new = F.when(kind == name, NEW[name](old, key)).otherwise(new)
            return F.struct(gap.alias("gap"), kind.alias("kind"), old.alias("old"), new.alias("new"))
        one = _with(kind_of(old, kinds), by_kind)
        if "iban" not in kinds:
            return one
        rest = [k for k in kinds if k != "iban"]

        def inside(hit):
            gaps, hits = F.split(old, WITHIN_IBAN, -1), F.regexp_extract_all(old, F.lit(WITHIN_IBAN), F.lit(0))
            none = F.lit(None).cast("string")
            found = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("old")), lambda x: pieces(x["gap"], x["old"], rest))
            nested = F.concat(F.array(F.struct(gap.alias("gap"), none.alias("kind"), F.lit("").alias("old"), none.alias("new"))), found,
                              F.array(F.struct(F.element_at(gaps, -1).alias("gap"), none.alias("kind"), F.lit("").alias("old"), none.alias("new"))))
            return F.when((hit["kind"] == "iban") & hit["new"].isNull(), nested).otherwise(F.array(hit))
        return _with(one, inside)
    hits = base.withColumn("found", found)
    zipped = F.arrays_zip(F.slice("found.gaps", F.lit(1), F.size("found.hits")).alias("gap"), F.col("found.hits").alias("old"))
    hits = hits.withColumn("new", F.flatten(F.transform(zipped, lambda x: pieces(x["gap"], x["old"], list(PATTERNS)))))
    text = F.concat(F.array_join(F.transform("new", lambda x: F.concat(x["gap"], F.coalesce(x["new"], x["old"]))), ""), F.element_at("found.gaps", -1))

    def count(kind):
        n = F.size(F.filter("new", lambda x: (x["kind"] == kind) & x["new"].isNotNull()))
        return F.when(F.col("found").isNull(), 0).otherwise(n).cast("long").alias(f"n_{kind}")
    return hits.select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(text).alias("text"),
                       *(count(kind) for kind in PATTERNS))
