import hashlib
import random
import re
from datetime import date, timedelta

from edge_rows import SMALL, edge  # noqa: F401
from pyspark.sql import functions as F

from corpusprep.llm import queries as Q
from corpusprep.llm.pii import KEY, ROUNDS, permute_number, pseudonymise


def f(kind, i, x):
    return int(hashlib.sha256(f"{KEY}|{kind}|{i}|{x}".encode()).hexdigest()[:15], 16)


def network(x, y, a, b, kind, tweak=None, back=False):
    t = "" if tweak is None else f"{tweak}|"
    for i in (reversed if back else iter)(range(ROUNDS)):
        sign = -1 if back else 1
        if i % 2 == 0:
            x = (x + sign * f(kind, i, f"{t}{y}")) % a
        else:
            y = (y + sign * f(kind, i, f"{t}{x}")) % b
    return x, y


def number(n, a, b, kind, back=False):
    x, y = network(n // b, n % b, a, b, kind, back=back)
    return x * b + y


def digits(d, kind, back=False):
    u, n = len(d) // 2, len(d)
    x, y = network(int("0" + d[:u]), int("0" + d[u:]), 10**u, 10**(n - u), kind, n, back)
    return (str(x).zfill(u) if u else "") + str(y).zfill(n - u)


def luhn(d):
    return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(int(c) for c in reversed(d))) % 10 == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def card(rng, n=16):
    d = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def iban(rng):
    b = "".join(rng.choice("0123456789") for _ in range(18))
    return f"DE{98 - mod97('DE00' + b):02d}{b}"


def found(spark, texts):
    rows = pseudonymise(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")).orderBy("id").collect()
    return rows


def test_against_python_and_inverse(spark):
    rng = random.Random(3)
    cards = [card(rng, n) for n in (13, 15, 16, 16, 16, 19)]
    days = [date(1800, 1, 1), date(2199, 12, 31), date(2000, 2, 29)] + [date(1950, 1, 1) + timedelta(rng.randrange(40000)) for _ in range(10)]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(10)] + ["0.0.0.0", "255.255.255.255"]
    phones = ["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824", "+49 30 901820", "+4915112345678"]
    ssns = ["001-01-0001", "899-99-9999", "665-12-3456", "667-12-3456"]
    ibans = [iban(rng) for _ in range(5)]
    texts = cards + [d.isoformat() for d in days] + [d.strftime("%d.%m.%Y") for d in days] + [d.strftime("%m/%d/%Y") for d in days] + ips + phones + ssns + ibans
    rows = found(spark, [f"see {t} there" for t in texts])
    kinds = ["card"] * len(cards) + ["date"] * 3 * len(days) + ["ip"] * len(ips) + ["phone"] * len(phones) + ["ssn"] * len(ssns) + ["iban"] * len(ibans)
    start = date(1800, 1, 1)
    for t, k, r in zip(texts, kinds, rows):
        assert [x["kind"] for x in r["found"]] == [k] and r[f"n_{k}"] == 1, (t, r)
        new = r["found"][0]["pseudonym"]
        assert r["text"] == f"see {new} there" and new != t
        if k == "card":
            assert luhn(new) and digits(t[:-1], "card") == new[:-1] and digits(new[:-1], "card", True) == t[:-1]
        if k == "ip":
            v = int.from_bytes(bytes(map(int, t.split("."))))
            assert number(v, 65536, 65536, "ip") == int.from_bytes(bytes(map(int, new.split("."))))
        if k == "iban":
            assert mod97(new) == 1 and new[:2] == "DE" and new[4:] == digits(t[4:], "iban")
        if k == "ssn":
            assert re.match(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}$", new)
        if k == "phone":
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", t)
    for k, d in enumerate(days):  # one permutation of days, whatever the way of writing
        new = start + timedelta(number((d - start).days, 189, 773, "date"))
        got = [rows[len(cards) + k + j * len(days)]["found"][0]["pseudonym"] for j in range(3)]
        assert got == [new.isoformat(), new.strftime("%d.%m.%Y"), new.strftime("%m/%d/%Y")]
        assert number((new - start).days, 189, 773, "date", back=True) == (d - start).days


def test_iban_before_an_upper_case_word(spark):
    def made(code, n):
        b = "".join(random.Random(code).choice("0123456789") for _ in range(n - 4))
        b = f"{code}{98 - mod97(code + '00' + b):02d}{b}"
        return " ".join(b[k:k + 4] for k in range(0, n, 4))
    ibans = ["ES91 2100 0418 4502 0005 1332", made("PL", 28), made("SE", 24), made("AT", 20), made("DE", 22), made("NO", 15)]
    ibans += [x.replace(" ", "") for x in ibans]
    words = ("BIC CAIXESBBXXX", "SWIFT CAIXESBB", "EUR", "A", "BANK 12 AG")
    texts = [f"IBAN {x} {w}" for x in ibans for w in words]
    for t, r in zip(texts, found(spark, texts)):
        x, w = next((x, w) for x in ibans for w in words if t == f"IBAN {x} {w}")
        assert [(v["kind"], v["value"]) for v in r["found"]] == [("iban", x)], (t, r)
        new = r["found"][0]["pseudonym"]
        assert r["text"] == f"IBAN {new} {w}" and mod97(new) == 1 and new != x


def test_permutation(spark):
    got = [r[0] for r in spark.range(7 * 11).select(permute_number(F.col("id"), 7, 11, "k", "x")).collect()]
    assert sorted(got) == list(range(77)) and got != list(range(77))
    mails = [f"{a}{b}@example.org" for a in "abcdefghij" for b in "klmnopqrst"]
    new = {r["found"][0]["pseudonym"] for r in found(spark, mails)}
    assert len(new) == 100 and all(re.fullmatch(r"[a-z]{2}@example\.org", x) for x in new)


def test_invalid_values_stay(spark):
    rng = random.Random(4)
    bad = card(rng)
    bad = bad[:-1] + str((int(bad[-1]) + 1) % 10)
    texts = [bad, "2021-02-30", "31.04.2020", "13/13/2020", "256.1.1.1", "01.2.3.4", "000-12-3456", "666-12-3456", "DE00123456781234567812",
             "x@y", "1.2.3", "version 1.2.3.4.5", "2300-01-01", "no digits at all", "12", "+1", None, ""]
    for t, r in zip(texts, found(spark, texts)):
        assert r["text"] == t and r["found"] == [], (t, r)


def test_links_across_documents(spark):
    a, b = found(spark, ["call +1 (743) 555-3824 or mail joe.d@example.com now", "joe.d@example.com, +1-743-555-3824; 227.5.221.1"])
    x, y = {v["kind"]: v["pseudonym"] for v in a["found"]}, {v["kind"]: v["pseudonym"] for v in b["found"]}
    assert x["email"] == y["email"] and re.sub(r"\D", "", x["phone"]) == re.sub(r"\D", "", y["phone"]) and len(b["found"]) == 3


def test_query_leaves_the_rest(spark):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = Q.op3_pii_feistel(spark, SMALL).collect()
    assert len(rows) == len(before)
    hits = 0
    for r in rows:
        t = before[r["doc_id"]]
        own = [m for m in re.findall(r"[a-z.]+[0-9]*@[a-z0-9]+\.example\.com|\+1 \(\d{3}\) 555-\d{4}", t)]
        hits += len(own)
        assert not [m for m in own if m in r["text"]]
        if not re.search(r"[0-9@]", t):
            assert r["text"] == t
    assert hits


def test_edge_rows(spark, edge):
    out = pseudonymise(edge)
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in edge.collect())
    assert pseudonymise(edge.limit(0)).count() == 0


def test_addresses_with_very_many_labels(spark):
    """No recursion per label: a domain of over 127 labels is none; ordinary ones are found as before."""
    rows = [(1, "x@" + "a." * 100_000 + "com"), (2, "to a@b.com.1x now"), (3, "a@b.c.d.example.org, a@b..com a@b"), (4, "x@" + "ab." * 120 + "com")]
    got = {r.k: r.n_email for r in pseudonymise(spark.createDataFrame(rows, "k int, text string")).select("k", "n_email").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1}
