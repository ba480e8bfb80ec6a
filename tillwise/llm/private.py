"""Format-preserving pseudonyms for personal data.

Numbers and dates that are valid as what they look like (Luhn digit, dialling
rules, octets, calendar) are replaced by others of the same format that are
just as valid. A keyed Feistel network permutes each format's values: the
value is split in two halves (a, b) with sizes (M, N), and each round adds a
keyed hash of one half to the other, modulo its size. That is a permutation of
exactly M * N values, so equal values get equal pseudonyms in every document,
different values different ones, and ``reveal`` runs the rounds backwards.

Format     Permuted                                       Kept
card       13 to 19 digits, all but the last, Luhn valid  grouping; the last digit becomes the new Luhn digit
phone      area, exchange and line (NANP, with +1)         prefix, punctuation
ssn        area, group, serial in their legal ranges       hyphens
ipv4       all 32 bits                                     dotted form (octets without leading zeros)
date       the day, 1800-01-01 to 2199-12-31 (Gregorian)   year-month-day with - or / between
email      local part: letters and digits one by one       domain, punctuation, character classes

A match that is not valid stays as it is. Null texts stay null and count no
findings; empty and very long texts are like any other; only ``key`` and
``text`` are read, whatever other columns are there; repeated rows get the same
result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
SECRET = "tillwise-demo-key"  # a deployment passes its own

# The patterns of each kind, most specific first. Look-arounds keep a match from starting inside a longer one.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "date": r"(?<![\d/-])\d{4}(?:-\d{2}-|/\d{2}/)\d{2}(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
KINDS = tuple(PATTERNS)
# The number patterns are tried only where one can start.
ANY = f"{PATTERNS['email']}|(?=[0-9+(])(?:{'|'.join(p for k, p in PATTERNS.items() if k != 'email')})"




def _bits(secret: str, kind: str, step: Column, value: Column) -> Column:
    """52 keyed bits for one round."""
    text = F.concat_ws("|", F.lit(secret), F.lit(kind), step.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def _rounds(back: bool) -> Column:
    return F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if back else range(ROUNDS))])


def permute(secret: str, kind: str, a: Column, b: Column, m: Column | int, n: Column | int, back: bool = False) -> Column:
    """Struct (a, b): the Feistel permutation of the pairs with 0 <= a < m, 0 <= b < n; ``back`` inverts it."""
    m, n = (F.lit(x).cast("bigint") if isinstance(x, int) else x for x in (m, n))
    sign = F.lit(-1 if back else 1)

    def step(s: Column, r: Column) -> Column:
        return F.when(
            r % 2 == 0,
            F.struct(F.pmod(s["a"] + sign * (_bits(secret, kind, r, s["b"]) % m), m).alias("a"), s["b"].alias("b")),
        ).otherwise(
            F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * (_bits(secret, kind, r, s["a"]) % n), n).alias("b"))
        )

    return F.aggregate(_rounds(back), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def permute_characters(secret: str, kind: str, value: Column, back: bool = False) -> Column:
    """A Feistel permutation of strings: letters and digits move inside their class, other characters stay."""
    half = F.floor(F.length(value) / 2).cast("int")
    sign = -1 if back else 1

    def moved(part: Column, other: Column, r: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(secret), F.lit(kind), r.cast("string"), other), 256)

        def one(c: Column, i: Column) -> Column:
            by = F.lit(sign) * F.conv(F.substring(stream, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            turned = lambda first, size: F.char(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(size)))
            return (
                F.when(c.between("0", "9"), turned(48, 10))
                .when(c.between("A", "Z"), turned(65, 26))
                .when(c.between("a", "z"), turned(97, 26))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def step(s: Column, r: Column) -> Column:
        return F.when(
            r % 2 == 0, F.struct(moved(s["a"], s["b"], r).alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(s["a"].alias("a"), moved(s["b"], s["a"], r).alias("b")))

    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    done = F.aggregate(_rounds(back), start, step)
    return F.concat(done["a"], done["b"])


def _number(text: Column, start, length) -> Column:
    return F.substring(text, start if isinstance(start, Column) else F.lit(start),
                       length if isinstance(length, Column) else F.lit(length)).cast("bigint")


def _padded(value: Column, width) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    done = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda s, c: F.when(
            c.between("0", "9"),
            F.struct(F.concat(s["s"], F.substring(digits, s["i"], F.lit(1))).alias("s"), (s["i"] + 1).alias("i")),
        ).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["i"].alias("i"))),
    )
    return done["s"]


def _email(found, secret, back):
    local = F.substring_index(found, "@", 1)
    return F.concat(permute_characters(secret, "email", local, back), F.substring(found, F.length(local) + 1, F.length(found)))


def _ipv4(found, secret, back):
    octets = F.transform(F.split(found, r"\."), lambda o: o.cast("bigint"))
    p = permute(secret, "ipv4", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 1 << 16, 1 << 16, back)
    parts = [F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256]
    plain = F.array_join(F.transform(octets, lambda o: o.cast("string")), ".") == found
    return F.when(~F.exists(octets, lambda o: o > 255) & plain, F.concat_ws(".", *[x.cast("string") for x in parts]))


def _date(found, secret, back):
    year, month, day = _number(found, 1, 4), _number(found, 6, 2), _number(found, 9, 2)
    first = F.make_date(year.cast("int"), F.greatest(F.least(month, F.lit(12)), F.lit(1)).cast("int"), F.lit(1))
    origin = F.lit("1800-01-01").cast("date")
    number = F.date_diff(first, origin) + day - 1
    # 400 Gregorian years have 146,097 = 189 * 773 days.
    p = permute(secret, "date", F.floor(number / 773), number % 773, 189, 773, back)
    new = F.date_format(F.date_add(origin, (p["a"] * 773 + p["b"]).cast("int")), "yyyyMMdd")
    valid = year.between(1800, 2199) & month.between(1, 12) & day.between(1, F.dayofmonth(F.last_day(first)))
    return F.when(valid, _refill(found, new))


def _ssn(found, secret, back):
    area, group, serial = _number(found, 1, 3), _number(found, 5, 2), _number(found, 8, 4)
    # 001 to 899 without 666, groups from 01, serials from 0001
    p = permute(secret, "ssn", F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1,
                898, 99 * 9999, back)
    new = F.concat(
        _padded(F.when(p["a"] < 665, p["a"] + 1).otherwise(p["a"] + 2), 3),
        _padded(F.floor(p["b"] / 9999) + 1, 2),
        _padded(p["b"] % 9999 + 1, 4),
    )
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, _refill(found, new))


def _phone(found, secret, back):
    digits = F.regexp_replace(found, r"\D", "")
    lead = F.length(digits) - 10
    ten = F.substring(digits, lead + 1, F.lit(10))
    # Area and exchange start with 2 to 9: 800 values each.
    p = permute(secret, "phone", _number(ten, 1, 3) - 200, (_number(ten, 4, 3) - 200) * 10_000 + _number(ten, 7, 4),
                800, 8_000_000, back)
    new = F.concat(
        F.substring(digits, F.lit(1), lead),
        (p["a"] + 200).cast("string"),
        (F.floor(p["b"] / 10_000) + 200).cast("string"),
        _padded(p["b"] % 10_000, 4),
    )
    return _refill(found, new)


def _card(found, secret, back):
    digits = F.regexp_replace(found, r"\D", "")
    size = F.length(digits) - 1
    left = F.floor(size / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    kind = "card"
    p = permute(secret, kind, _number(digits, 1, left), _number(digits, left + 1, size - left),
                power(left), power(size - left), back)
    payload = F.concat(_padded(p["a"], left), _padded(p["b"], size - left))
    check = F.filter(
        F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(payload, d))
    )
    return F.when(F.call_function("luhn_check", digits), _refill(found, F.concat(payload, check[0])))


MAKERS = {"email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(found: Column) -> Column:
    digits = F.length(F.regexp_replace(found, r"\D", ""))
    return (
        F.when(F.contains(found, F.lit("@")), "email")
        .when(found.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ipv4")
        .when(digits >= 13, "card")
        .when(digits >= 10, "phone")
        .when(digits == 9, "ssn")
        .otherwise("date")
    )


def pseudonym(found: Column, secret: str = SECRET, back: bool = False) -> Column:
    """Struct (kind, new) for one match; ``new`` is null if the match is not a valid value."""
    kind = kind_of(found)
    new = F.lit(None).cast("string")
    for name, maker in MAKERS.items():
        new = F.when(kind == name, maker(found, secret, back)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymise(df: DataFrame, key: str = "doc_id", text: str = "text", secret: str = SECRET, back: bool = False) -> DataFrame:
    """``key``, ``text`` with pseudonyms, and the number replaced of each kind (``n_email``, …).

    No shuffle: a pseudonym follows from the value alone. ``back`` reveals.
    """
    found = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"),
        # A text without any digit and without @ holds nothing to find.
        F.when(F.col(f"`{text}`").rlike("[0-9@]"), F.regexp_extract_all(f"`{text}`", F.lit(ANY), F.lit(0))).alias("found"),
    )
    some = F.size("found") > 0
    new = found.withColumn(
        "changed", F.when(some, F.transform("found", lambda m: pseudonym(m, secret, back)))
    )
    pieces = F.zip_with(
        F.split("text", ANY, -1),
        F.zip_with("changed", "found", lambda c, m: F.coalesce(c["new"], m)),
        lambda between, m: F.concat(between, F.coalesce(m, F.lit(""))),
    )
    def count(kind: str) -> Column:
        replaced = F.filter("changed", lambda c: (c["kind"] == kind) & c["new"].isNotNull())
        return F.when(some, F.size(replaced)).otherwise(0).cast("int").alias(f"n_{kind}")

    return new.select(
        F.col("key").alias(key),
        F.when(some, F.array_join(pieces, "")).otherwise(F.col("text")).alias(text),
        *[count(k) for k in KINDS],
    )
