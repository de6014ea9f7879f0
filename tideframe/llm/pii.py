"""Personal data replaced by format-preserving pseudonyms.

Validated numbers (payment cards with a right check digit, telephone numbers, social security numbers, IPv4
addresses, IBANs of any country, with or without spaces) and dates (yyyy-MM-dd, and day, month and year with points or
slashes) are permuted within their own format by a keyed, mixed-radix Feistel network: the result is
valid in the same format, no two values share a pseudonym, and equal values stay linked across documents.
E-mail addresses, which have no fixed domain to permute, get a keyed hash as their local part. Everything is DataFrame
functions: no Python runs on the executors. The key is a parameter and belongs in a secret store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "card", "phone", "ssn", "ip", "iban", "date")

# No group is repeated without a small bound, and unbounded texts meet runs of one class only: the matcher never recurses deeply.
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}"
_CARD = r"(?<![0-9A-Za-z.])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9](?:[ -]?[0-9]){12,18})(?![0-9A-Za-z]|\.[0-9])"
_PHONE = r"(?<![0-9A-Za-z.+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|\.[0-9])"
_ABROAD = r"(?<![0-9A-Za-z.+])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9A-Za-z]|\.[0-9])"
_SSN = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]|\.[0-9])"
_IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
_DATE = r"(?<![0-9A-Za-z.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])"
_DAY = r"(?<![0-9A-Za-z./-])[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4}(?![0-9A-Za-z/]|\.[0-9])"
PATTERN = "|".join((_EMAIL, _IBAN, _DATE, _DAY, _SSN, _PHONE, _ABROAD, _IP, _CARD))
# fixed values: calling codes of one and two digits; all others have three
_CODE = r"^(7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

#: Days of 400 years from FIRST_DAY on; 146,097 = 189 * 773 gives the two halves of a date.
FIRST_DAY, DAYS_L, DAYS_R = "1800-01-01", 189, 773


def _long(c: Column) -> Column:
    return c.try_cast("long")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, tag: Column, key: str) -> Column:
    """Keyed permutation of pairs (left < a, right < b): a struct (l, r). A bijection for every key, tag and pair of moduli."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def f(value: Column, i: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tag, i.cast("string"), value.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, (s.l + f(s.r, i)) % a).otherwise(s.l).alias("l"), F.when(even, s.r).otherwise((s.r + f(s.l, i)) % b).alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _pad(x: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.lpad(x.cast("string"), n, F.lit("0"))


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def permute_digits(d: Column, tag: Column, key: str) -> Column:
    """Keyed permutation of the strings of as many digits as ``d`` (2 to 36)."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    s = feistel(_long(F.substring(d, F.lit(1), h)), _long(F.substring(d, h + 1, n - h)), _power(h), _power(n - h), F.concat_ws("|", tag, n.cast("string")), key)
    # the struct is made once: both halves are read from it inside one lambda
    return F.element_at(F.transform(F.array(s), lambda x: F.concat(_pad(x.l, h), _pad(x.r, n - h))), 1)


def luhn_sum(d: Column, double_last: bool) -> Column:
    """Sum of the check-digit rule over a digit string; ``double_last`` says whether the last digit counts twice."""
    n = F.length(d)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((n - i).alias("back"), F.substring(d, i, F.lit(1)).cast("int").alias("x")))

    def worth(e: Column) -> Column:
        twice = (e.back % 2 == 0) if double_last else (e.back % 2 == 1)
        return F.when(twice, e.x * 2 - F.when(e.x > 4, 9).otherwise(0)).otherwise(e.x)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda s, v: s + v)


def _refill(m: Column, digits: Column) -> Column:
    """The text with its digits replaced, in order, by the given ones."""
    first = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9")
        return F.struct((a.i + is_digit.cast("int")).alias("i"), F.concat(a.out, F.when(is_digit, F.substring(digits, a.i, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(m, ""), first, step, lambda a: a.out)


def kind_of(m: Column) -> Column:
    """Kind of a match of PATTERN, or null if the value is not valid in its format."""
    d = _digits(m)
    octets = F.transform(F.split(m, r"\."), lambda x: _long(x))
    day = _day(m)
    ordinal = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    area, group, serial = (_long(F.substring(d, *x)) for x in ((1, 3), (4, 2), (6, 4)))
    return (
        F.when(m.contains("@"), F.when(~m.rlike("@[.-]") & ~F.substring_index(m, "@", -1).contains(".."), "email"))
        .when(m.rlike("^[A-Z]"), F.when((_mod97(F.concat(F.substring(F.regexp_replace(m, " ", ""), 5, 30), F.substring(m, 1, 4))) == 1) & (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 4), "iban"))
        .when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), F.when((ordinal >= 0) & (ordinal < DAYS_L * DAYS_R), "date"))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), "ssn"))
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(F.forall(octets, lambda x: x < 256) & ~m.rlike(r"(^|\.)0[0-9]"), "ip"))
        .when(m.rlike(r"^\+[2-9]"), F.when(F.length(d).between(8, 15), "phone"))
        .when(F.length(d) >= 13, F.when(luhn_sum(d, False) % 10 == 0, "card"))
        .when(F.length(d).isin(10, 11), "phone")
    )


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a text of digits and capitals, which count as 10 to 35."""

    def step(s: Column, c: Column) -> Column:
        digit = (c >= "0") & (c <= "9")
        return F.when(c == "", s).when(digit, (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step)


def _day(m: Column) -> Column:
    """The date that a text says as year, month and day, or as day, month and year; null if it says none."""
    iso = F.when(m.rlike(r"^[0-9]{2}[./]"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(m)
    return F.try_to_date(iso, "yyyy-MM-dd")


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """Pseudonym of a validated value in its own format; null for a null kind."""
    d = _digits(m)
    one = lambda s, f: F.element_at(F.transform(F.array(s), f), 1)

    payload = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), F.lit("card"), key)
    card = one(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, True) % 10) % 10).cast("string")))

    skip = F.when(F.length(d) == 11, 1).otherwise(0)
    ten = F.substring(d, skip + 1, F.lit(10))
    code = F.when(F.regexp_extract(d, _CODE, 1) != "", F.length(F.regexp_extract(d, _CODE, 1))).otherwise(3)
    abroad = F.concat(F.substring(d, F.lit(1), code), permute_digits(F.substring(d, code + 1, F.lit(15)), F.concat(F.lit("phone|"), F.substring(d, F.lit(1), code)), key))
    phone = F.when(m.rlike(r"^\+[2-9]"), abroad).otherwise(F.concat(F.substring(d, F.lit(1), skip), permute_digits(ten, F.lit("phone"), key)))

    area = _long(F.substring(d, 1, 3))
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    right = (_long(F.substring(d, 4, 2)) - 1) * 9999 + _long(F.substring(d, 6, 4)) - 1
    ssn = one(feistel(left, right, 898, 99 * 9999, F.lit("ssn"), key), lambda s: F.concat(_pad(s.l + 1 + F.when(s.l >= 665, 1).otherwise(0), 3), F.lit("-"), _pad(F.floor(s.r / 9999) + 1, 2), F.lit("-"), _pad(s.r % 9999 + 1, 4)))

    o = F.transform(F.split(m, r"\."), lambda x: _long(x))
    at = lambda i: F.try_element_at(o, F.lit(i))
    ip = one(feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), 65536, 65536, F.lit("ip"), key), lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s.l / 256), s.l % 256, F.floor(s.r / 256), s.r % 256)]))

    ordinal = F.datediff(_day(m), F.lit(FIRST_DAY).cast("date"))
    form = F.when(m.rlike(r"^[0-9]{2}\."), "dd.MM.yyyy").when(m.rlike("^[0-9]{2}/"), "dd/MM/yyyy").otherwise("yyyy-MM-dd")
    date = one(feistel(F.floor(ordinal / DAYS_R), ordinal % DAYS_R, DAYS_L, DAYS_R, F.lit("date"), key), lambda s: F.call_function("date_format", F.date_add(F.lit(FIRST_DAY).cast("date"), (s.l * DAYS_R + s.r).cast("int")), form))

    tight = F.regexp_replace(m, " ", "")
    own = F.substring(tight, 5, 30)
    layout = F.concat_ws("|", F.lit("iban"), F.substring(m, 1, 2), F.regexp_replace(own, "[0-9]", "0"))
    made = permute_digits(_digits(own), layout, key)
    check = lambda p: _pad(98 - _mod97(F.concat(_refill(own, p), F.substring(m, 1, 2), F.lit("00"))), 2)
    iban = one(made, lambda p: _refill(m, F.concat(check(p), p)))

    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@pseudonym.invalid"))
    return F.when(kind == "email", email).when(kind == "card", _refill(m, card)).when(kind == "phone", _refill(m, phone)).when(kind == "ssn", ssn).when(kind == "ip", ip).when(kind == "date", date).when(kind == "iban", iban)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """Every row with the personal data in ``text_col`` replaced, and (with ``counts``) a column ``n_<kind>`` for each kind.

    All rows and other columns stay; columns named like a new one are replaced. A null text stays null with counts
    of 0; an empty text stays empty. Equal values get equal pseudonyms in every row and document. A number that is
    not valid in its format (a wrong check digit, a month 13) is left alone, as is all text outside the matches. A text of
    any length is handled whole; the key is the caller's, from a secret store.
    """
    new = {f"n_{k}" for k in KINDS} if counts else set()
    kept = [c for c in docs.columns if c not in new or c == text_col]
    text, none = F.col(f"`{text_col}`"), F.array().cast("array<string>")
    maybe = text.rlike("[0-9@]")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.when(maybe, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none).alias("__m"))
    found = F.transform("__m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    rows = rows.withColumns({"__f": found, "__p": F.when(F.size("__m") > 0, F.split(text, PATTERN, -1)).otherwise(none)})
    given = F.transform("__f", lambda x: F.coalesce(pseudonym(x.m, x.kind, key), x.m))
    whole = F.array_join(F.flatten(F.zip_with("__p", given, lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    replaced = F.when(F.exists("__f", lambda x: x.kind.isNotNull()), whole).otherwise(text)
    out = [replaced.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept]
    if counts:
        out += [F.size(F.filter("__f", lambda x: x.kind == k)).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return rows.select(*out)
