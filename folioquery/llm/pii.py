"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Found values are read as a sequence of symbols, each with a radix that its place
in the format allows (a digit 10, an octet 256, a lower-case letter 26, ...). A
balanced Feistel network over the two halves of the sequence adds keyed hashes
of one half to the other, symbol by symbol modulo its radix. It is a permutation
of all values of a format: the pseudonym has the same format, different values
get different pseudonyms, and equal values get equal ones in every document.

Values are validated before: card numbers by their check digit (which is
computed anew), octets, dates and social-security numbers by their ranges.
Everything is Spark SQL: arrays and higher-order functions on rows that have a
digit or an at sign; nothing is exploded or shuffled.
"""

from __future__ import annotations

import calendar
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import fresh, table

#: Key of the registered query alone, so that its results can be compared; the operator requires one of its own.
QUERY_KEY = "folioquery-example-key"
ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31; 17 * 4297.
FIRST_DAY, DAY_RADICES = "1900-01-01", (17, 4297)
#: Day and month of dates that only day-first order can mean, in a common year; the leap days of these 200 years are 49.
DAY_FIRST = tuple(f"{d:02d}/{m:02d}" for m in range(1, 13) for d in range(13, calendar.monthrange(2001, m)[1] + 1))
_ALNUM = "0-9A-Za-z"

#: Patterns by kind, in order of precedence at one place.
PATTERNS = {
    "email": rf"(?<![{_ALNUM}._%+-])[{_ALNUM}._%+-]++@[{_ALNUM}-]+(?:\.[{_ALNUM}-]+)*\.[A-Za-z]{{2,}}",
    "ip": rf"(?<![{_ALNUM}.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![{_ALNUM}]|\.[0-9])",
    "date": rf"(?<![{_ALNUM}./-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})(?:(?![{_ALNUM}/-])|(?=[Tt][0-9]{{2}}:?[0-9]{{2}}))",
    "ssn": rf"(?<![{_ALNUM}-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![{_ALNUM}-])",
    "card": rf"(?<![{_ALNUM}.])(?:[0-9]{{13,19}}|[0-9]{{4}} [0-9]{{4}} [0-9]{{4}} [0-9]{{1,7}}|[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{1,7}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})(?![{_ALNUM}])",
    "phone": (
        r"(?:(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
        rf"|(?<![{_ALNUM}.-])[2-9][0-9]{{2}}[.-][2-9][0-9]{{2}}[.-][0-9]{{4}}|(?<![0-9+])\+[2-9][0-9]{{0,2}}(?:[ .-]?\(?[0-9]{{2,4}}\)?){{2,4}})(?![0-9])"
    ),
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = tuple(PATTERNS)


def hmac(key: str, message: Column) -> Column:
    """Hexadecimal HMAC-SHA-256 (RFC 2104) of a message."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def feistel(symbols: Column, radices: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of symbol sequences: symbol i stays below radix i. ``rounds`` must be even."""
    n = F.size(symbols)
    half = F.floor(n / 2).cast("int")

    def halves(x: Column) -> tuple[Column, Column]:
        return F.slice(x, F.lit(1), half), F.slice(x, half + 1, n - half)

    (left, right), (left_radix, right_radix) = halves(symbols), halves(radices)
    start = F.struct(left.alias("l"), right.alias("r"), left_radix.alias("lx"), right_radix.alias("rx"))

    def mix(s: Column, turn: Column) -> Column:
        other = F.array_join(F.transform(s["r"], lambda x: x.cast("string")), ",")

        def shifted(x: Column, i: Column) -> Column:
            digest = hmac(key, F.concat_ws("|", F.lit(kind), turn.cast("string"), i.cast("string"), other))
            return F.pmod(x + F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.element_at(s["lx"], i + 1))

        return F.struct(s["r"].alias("l"), F.transform(s["l"], shifted).alias("r"), s["rx"].alias("lx"), s["lx"].alias("rx"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, mix, lambda s: F.concat(s["l"], s["r"]))


def _longs(*values) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("long") for v in values])


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _text(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda x: x.cast("string")), "")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _refill(match: Column, digits: Column) -> Column:
    """The match with its digits replaced in order."""

    def at(char: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(char.rlike("[0-9]"), F.substring(digits, place, F.lit(1))).otherwise(char)

    return F.array_join(F.transform(_chars(match), at), "")


def _email(match: Column, key: str) -> Column:
    local = F.substring_index(match, "@", 1)
    chars = _chars(local)

    def offset(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).when(c.rlike("[a-z]"), 97)

    radix = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1).cast("long"))
    symbols = F.transform(chars, lambda c: F.coalesce(F.ascii(c) - offset(c), F.lit(0)).cast("long"))
    new = F.zip_with(feistel(symbols, radix, key, "email"), chars, lambda x, c: F.coalesce(F.char(x + offset(c)), c))
    return F.concat(F.array_join(new, ""), F.substring(match, F.length(local) + 1, F.length(match)))


def _ip(match: Column, key: str) -> Column:
    octets = F.transform(F.split(match, r"\."), lambda x: x.cast("long"))
    new = feistel(octets, _longs(256, 256, 256, 256), key, "ip")
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(F.transform(new, lambda x: x.cast("string")), "."))


def _day_first(match: Column, key: str) -> Column:
    """A dd/MM/yyyy with a day over 12 as another such date, so that none meets the pseudonym of an MM/dd/yyyy; leap days stay leap days."""
    days = F.array(*map(F.lit, DAY_FIRST))
    year, at = F.substring(match, 7, 4).try_cast("long"), F.array_position(days, F.substring(match, 1, 5)) - 1
    leap = F.floor((year - 1904) / 4).cast("long")
    common = feistel(_longs(year - 1900, at), _longs(200, len(DAY_FIRST)), key, "day-first")
    leaps = feistel(_longs(F.floor(leap / 7), F.pmod(leap, F.lit(7))), _longs(7, 7), key, "leap-day")
    is_leap = match.startswith("29/02/") & year.between(1904, 2096) & (F.pmod(year, F.lit(4)) == 0)
    return F.when(year.between(1900, 2099) & (at >= 0), _let(common, lambda x: F.concat(F.element_at(days, (x[1] + 1).cast("int")), F.lit("/"), (x[0] + 1900).cast("string")))).when(
        is_leap, _let(leaps, lambda x: F.concat(F.lit("29/02/"), (1904 + 4 * (7 * x[0] + x[1])).cast("string")))
    )


def _date(match: Column, key: str) -> Column:
    day = F.coalesce(*[F.to_date(F.try_to_timestamp(match, F.lit(f))) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")])
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    a, b = DAY_RADICES
    new = feistel(F.array(F.floor(number / F.lit(b)).cast("long"), F.pmod(number, F.lit(b)).cast("long")), _longs(a, b), key, "date")
    moved = _let(new, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x[0] * b + x[1]).cast("int")))
    shape = F.when(match.contains("-"), F.date_format(moved, "yyyy-MM-dd")).when(match.contains("."), F.date_format(moved, "dd.MM.yyyy"))
    moved_text = F.when((number >= 0) & (number < a * b), shape.otherwise(F.date_format(moved, "MM/dd/yyyy")))
    return F.coalesce(moved_text, F.when(match.contains("/") & day.isNull(), _day_first(match, key)))


def _ssn(match: Column, key: str) -> Column:
    area, group, serial = (F.substring(match, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    index = area - 1 - (area > 666).cast("long")
    new = feistel(F.array(index, group - 1, serial - 1), _longs(898, 99, 9999), key, "ssn")

    def shown(x: Column) -> Column:
        back = x[0] + 1 + (x[0] >= 665).cast("long")
        return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in ((back, 3), (x[1] + 1, 2), (x[2] + 1, 4))])

    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, _let(new, shown))


def _card(match: Column, key: str) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    body = F.transform(_chars(F.substring(digits, F.lit(2), n - 2)), lambda c: c.cast("long"))
    new = F.concat(F.substring(digits, 1, 1), _text(feistel(body, F.transform(body, lambda _: F.lit(10).cast("long")), key, "card")))

    def checked(start: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(start, c.cast("string"))))
        return _refill(match, F.concat(start, fits[0].cast("string")))

    return F.when(F.call_function("luhn_check", digits) & n.between(13, 19), _let(new, checked))


def _phone(match: Column, key: str) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    kept = F.when(match.startswith("+1"), 1).when(match.startswith("+"), 2).otherwise(0)
    national = F.transform(_chars(F.substring(digits, kept + 1, F.length(digits))), lambda c: c.cast("long"))

    def leads(i: Column) -> Column:
        return (i == 0) | ((i == 3) & (kept < 2))

    low = F.transform(national, lambda d, i: F.when(leads(i) & (d >= 2), 2).otherwise(0).cast("long"))
    radix = F.transform(national, lambda d, i: F.when(~leads(i), 10).when(d >= 2, 8).otherwise(2).cast("long"))
    new = F.zip_with(feistel(F.zip_with(national, low, lambda d, o: d - o), radix, key, "phone"), low, lambda x, o: x + o)
    return _let(F.concat(F.substring(digits, F.lit(1), kept), _text(new)), lambda all_digits: _refill(match, all_digits))


_MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def found(text: Column, key: str) -> Column:
    """Array of (kind, value, pseudonym) of a text's values in order; those that fail validation have a null kind and keep their value."""

    def one(match: Column) -> Column:
        kind, new = F.lit(None).cast("string"), match
        for name in reversed(KINDS):
            made = _MAKERS[name](match, key)
            fits = match.rlike(f"^(?:{PATTERNS[name]})$")
            kind = F.when(fits, F.when(made.isNotNull(), F.lit(name))).otherwise(kind)
            new = F.when(fits, F.coalesce(made, match)).otherwise(new)
        return F.struct(kind.alias("kind"), match.alias("value"), new.alias("pseudonym"))

    matches = F.regexp_extract_all(text, F.lit(ANY), 0)
    return F.when(text.rlike("[0-9@]"), F.transform(matches, one)).otherwise(F.expr("cast(array() as array<struct<kind:string,value:string,pseudonym:string>>)"))


def replaced(text: Column, values: Column) -> Column:
    """The text with its found values replaced."""
    gaps = F.split(text, ANY, -1)
    joined = F.zip_with(gaps, values, lambda gap, v: F.concat(gap, F.coalesce(v["pseudonym"], F.lit(""))))
    return F.when(F.size(values) > 0, F.array_join(joined, "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", values_col: str = "_pii") -> DataFrame:
    """The rows with their personal data replaced, in the text column alone, and an array of what was replaced.

    The last column holds (kind, value, pseudonym); its name gets an underscore
    more where a column has it already. Null and empty texts stay as they are,
    with an empty array. Whole texts are searched. Other columns, of whatever
    names, are carried along; rows may repeat.
    """
    (values_col,) = fresh(docs.columns, values_col)
    text = F.col(text_col)
    with_values = docs.withColumn(values_col, F.coalesce(found(text, key), F.expr("cast(array() as array<struct<kind:string,value:string,pseudonym:string>>)")))
    return with_values.withColumn(text_col, replaced(text, F.col(values_col)))


def _count(kinds: Column, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == kind)).cast("long")


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced, and how many values of each kind."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    kinds = F.transform("_pii", lambda v: F.coalesce(v["kind"], F.lit("")))
    counts = [_count(kinds, k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, "text")
