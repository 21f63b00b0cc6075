"""Format-preserving pseudonyms for personal data (DataFrame functions only).

Validated values are replaced by a keyed permutation of their own format, so equal values get equal
pseudonyms in all documents and a pseudonym is as valid as the value: card numbers keep a right
check digit, IBANs their country and check digits, dates stay dates, addresses stay addresses.

The permutation is a Feistel network of ``ROUNDS`` rounds over Z_a x Z_b: the halves take turns to be
shifted by a SHA-256 value of key, kind, round and the other half. For any a and b this is a
permutation of all a * b values, so there is no cycle walking. Dates are permuted within the
Gregorian cycle of 400 years (146,097 = 189 * 773 days), IPv4 addresses within 2**16 * 2**16, digit
strings of n digits within 10**(n // 2) * 10**(n - n // 2), social security numbers within the valid
areas, groups and serials. The local part of an e-mail address is permuted letter by letter within
its character classes, by the same network.

Everything happens inside the row: matches are taken out by one pattern, replaced by a function of
the value, and put back between the parts around them. No join, no table of pseudonyms, no Python.

Edge cases: NULL texts stay NULL with no findings; values that fail validation (a wrong check digit,
the 30th of February) stay as they are; ids are not read, so NULL ids and repeated rows stay; extra
columns pass through (output columns replace columns of the same name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import text_of

ROUNDS = 10
KEY = "corpus pseudonyms, first key"

# The formats that are looked for, in the order in which they are tried.
#: A domain has at most 127 labels (255 octets), which bounds the recursion of Java's matcher.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"
#: Length of an IBAN by country: it ends there, whatever upper-case word follows.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "HR LV LI CH",
    22: "BH BG CR GE DE IE ME RS GB VA", 23: "GI IQ IL OM SO AE TL", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MR MC SM", 28: "AL AZ BY CY DO SV GT HN HU LB NI PL", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """By length where the country has one; else, and where that does not fit, the general form."""
    def of(n: int, codes: str) -> str:
        groups, rest = divmod(n - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        return rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}(?![A-Za-z0-9])"
    known = "|".join(of(n, codes) for n, codes in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"


IBAN = _iban()
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"
PHONE = (r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9])"
         r"|(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
KINDS = {"email": EMAIL, "iban": IBAN, "ssn": SSN, "date": DATE, "ip": IP, "card": CARD, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

#: The same formats for a whole match, without what stands around it.
WHOLE = {
    "email": r"^[^@]+@", "iban": r"^[A-Z]{2}[0-9]{2}", "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "date": r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})$", "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "card": r"^(?:[0-9]{4}[\x20-]){3}[0-9]{4}$|^[0-9]{13,19}$", "phone": r"^[+(0-9]",
}
CYCLE_START, CYCLE_DAYS = "1800-01-01", 146_097


def _f(key: str, kind: str, i: Column, x: Column) -> Column:
    """60 keyed bits of a round number and a half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i, x), 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, kind: str, tweak: Column | None = None) -> Column:
    """The permuted pair of ``x`` in 0 to a - 1 and ``y`` in 0 to b - 1, as struct<x,y>."""
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    half = lambda v: v if tweak is None else F.concat_ws("|", tweak, v)
    pair = lambda u, v: F.struct(u.cast("long").alias("x"), v.cast("long").alias("y"))
    return F.aggregate(rounds, pair(x, y), lambda s, i: F.when(i % 2 == 0, pair((s["x"] + _f(key, kind, i, half(s["y"]))) % a, s["y"]))
                       .otherwise(pair(s["x"], (s["y"] + _f(key, kind, i, half(s["x"]))) % b)))


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def permute_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A permutation of 0 to a * b - 1."""
    return _bind(feistel(F.floor(x / b), x % b, F.lit(a), F.lit(b), key, kind), lambda s: s["x"] * b + s["y"])


def permute_digits(d: Column, key: str, kind: str) -> Column:
    """A permutation of the digit strings of each length (up to 34 digits)."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    long = lambda s: F.concat(F.lit("0"), s).cast("long")
    ten = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
    s = feistel(long(F.substr(d, F.lit(1), u)), long(F.substr(d, u + 1)), ten(u), ten(n - u), key, kind, n)
    return _bind(s, lambda s: F.concat(F.lpad(s["x"].cast("string"), u, F.lit("0")), F.lpad(s["y"].cast("string"), n - u, F.lit("0"))))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def put_digits(m: Column, d: Column) -> Column:
    """``m`` with its digits replaced in order by those of ``d``."""
    chars = F.split(m, "")
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["t"], F.substr(d, s["n"] + 1, F.lit(1))).alias("t"), (s["n"] + 1).alias("n"))) \
        .otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["n"].alias("n")))
    return F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), step, lambda s: s["t"])


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    n = F.length(d)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    digit = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    return F.aggregate(at, F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(digit(i))).otherwise(digit(i)))


def mod97(iban: Column) -> Column:
    """An IBAN's number modulo 97, with its first four characters moved to the end."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97))


def _date(m: Column) -> Column:
    """The date that ``m`` names (day first with dots, month first with slashes), or NULL."""
    part = lambda k: F.lpad(F.get(F.split(m, "[./]"), F.lit(k)), 2, "0")
    iso = F.when(m.contains("-"), m).when(m.contains("."), F.concat_ws("-", F.get(F.split(m, r"\."), F.lit(2)), part(1), part(0))) \
        .otherwise(F.concat_ws("-", F.get(F.split(m, "/"), F.lit(2)), part(0), part(1)))
    return iso.try_cast("date")


def _new_date(m: Column, key: str) -> Column:
    start = F.lit(CYCLE_START).cast("date")
    new = F.date_add(start, permute_number(F.datediff(_date(m), start), 189, 773, key, "date").cast("int"))
    padded = m.rlike(r"^[0-9]{2}[./][0-9]{2}[./]")
    return _bind(new, lambda d: F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd"))
                 .when(m.contains("."), F.when(padded, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "d.M.yyyy")))
                 .otherwise(F.when(padded, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "M/d/yyyy"))))


def _new_card(m: Column, key: str) -> Column:
    def with_check(d):
        return F.concat(d, F.pmod(10 - luhn_sum(F.concat(d, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    d = digits_of(m)
    new = _bind(permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), with_check)
    return _bind(new, lambda v: put_digits(m, v))


def _new_iban(m: Column, key: str) -> Column:
    """Country and letters stay, the digits of the account part are permuted, the check digits follow."""
    account = F.substr(m, F.lit(5))
    new = _bind(permute_digits(digits_of(account), key, "iban"), lambda v: put_digits(account, v))

    def with_check(x):
        flat = F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lit("00"), F.regexp_replace(x, " ", ""))
        return F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lpad((98 - mod97(flat)).cast("string"), 2, "0"), x)
    return _bind(new, with_check)


def _new_ip(m: Column, key: str) -> Column:
    p = F.split(m, r"\.")
    v = F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    return _bind(permute_number(v, 65536, 65536, key, "ip"),
                 lambda n: F.concat_ws(".", *[(F.shiftright(n, k) % 256).cast("string") for k in (24, 16, 8, 0)]))


def _new_ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), F.lit(k)).cast("long") for k in range(3))
    x = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    pad = lambda v, k: F.lpad(v.cast("string"), k, "0")

    def write(n):
        a = F.floor(n / (99 * 9999)) + 1
        return F.concat_ws("-", pad(F.when(a >= 666, a + 1).otherwise(a), 3), pad(F.floor(n / 9999) % 99 + 1, 2), pad(n % 9999 + 1, 4))
    return _bind(permute_number(x, 898 * 99, 9999, key, "ssn"), write)


def _new_phone(m: Column, key: str) -> Column:
    """The country code after + stays (two digits of it where nothing sets it off)."""
    d = digits_of(m)
    k = F.when(m.rlike(r"^\+[0-9]{1,3}[\x20.(-]"), F.length(F.regexp_extract(m, r"^\+([0-9]+)", 1))).when(m.startswith("+"), 2).otherwise(0)
    new = permute_digits(F.substr(d, k + 1), key, "phone")
    return _bind(F.concat(F.substr(d, F.lit(1), k), new), lambda v: put_digits(m, v))


def _new_email(m: Column, key: str) -> Column:
    """The local part, permuted within its character classes; the domain stays."""
    local, domain = F.regexp_extract(m, "^[^@]+", 0), F.regexp_extract(m, "@.*$", 0)
    chars = F.split(local, "")
    u = F.floor(F.size(chars) / 2).cast("int")

    def shifted(half, other, i):
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i, F.array_join(other, "")), 256)

        def one(c, at):
            s = F.conv(F.substr(h, at % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(at / 32).cast("int")
            turn = lambda low, n: F.char((F.ascii(c) - low + s) % n + low)
            return F.when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).when(c.rlike("^[0-9]$"), turn(48, 10)).otherwise(c)
        return F.transform(half, one)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    first = pair(F.slice(chars, F.lit(1), u), F.slice(chars, u + 1, F.size(chars)))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, lambda s, i: F.when(i % 2 == 0, pair(shifted(s["a"], s["b"], i), s["b"]))
                      .otherwise(pair(s["a"], shifted(s["b"], s["a"], i))),
                      lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))
    return F.concat(out, domain)


def kind_of(m: Column) -> Column:
    """The kind of a match that passes validation, else NULL."""
    d = digits_of(m)
    date = _date(m)
    flat = F.regexp_replace(m, " ", "")
    octets = F.split(m, r"\.")
    is_ = lambda k: m.rlike(WHOLE[k])
    ssn = ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return (F.when(is_("email") & m.contains("@"), "email")
            .when(is_("iban"), F.when((F.length(flat) >= 15) & (mod97(flat) == 1), "iban"))
            .when(is_("ssn"), F.when(ssn, "ssn"))
            .when(is_("date"), F.when((date >= F.lit(CYCLE_START).cast("date")) & (F.year(date) < 2200), "date"))
            .when(is_("ip"), F.when(F.forall(octets, lambda o: (o.cast("int") <= 255) & ~o.rlike("^0[0-9]")), "ip"))
            .when(is_("card"), F.when(luhn_sum(d) % 10 == 0, "card"))
            .when(is_("phone"), F.when(F.length(d).between(8, 15), "phone")))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    new = {"email": _new_email, "iban": _new_iban, "ssn": _new_ssn, "date": _new_date, "ip": _new_ip, "card": _new_card, "phone": _new_phone}
    out = None
    for k, fn in new.items():
        out = F.when(kind == k, fn(m, key)) if out is None else out.when(kind == k, fn(m, key))
    return out.otherwise(m)


def pseudonymise(df: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``df`` with the values in ``text`` replaced, plus ``found``: an array of kind, value and
    pseudonym in the order of the text, and ``n_<kind>``."""
    d = df.withColumn("__m", F.when(text_of(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))))
    d = d.withColumn("__k", F.transform("__m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))))
    d = d.withColumn("__n", F.transform("__k", lambda x: pseudonym(x["m"], x["k"], key)))
    parts = F.split(F.col(text), ANY)
    new = F.array_join(F.zip_with(parts, "__n", lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    found = F.filter(F.zip_with("__k", "__n", lambda x, n: F.struct(x["k"].alias("kind"), x["m"].alias("value"), n.alias("pseudonym"))),
                     lambda x: x["kind"].isNotNull())
    empty = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    d = d.withColumns({text: F.when(F.exists("__k", lambda x: x["k"].isNotNull()), new).otherwise(F.col(text)), "found": F.coalesce(found, empty)})
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return d.withColumns({f"n_{k}": count(k) for k in KINDS}).drop("__m", "__k", "__n")
