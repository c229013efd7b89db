"""Format-preserving pseudonyms for personal data by keyed Feistel permutations, in DataFrame functions alone.

Numbers, dates and mail addresses are found by pattern and validated (check digits, ranges, calendar). Their digits, and the
letters of addresses, are permuted by an alternating Feistel network with a keyed hash as its round function, within the format: a card number stays
a card number with a right check digit, a date a date. Equal values get equal pseudonyms in every document, and
distinct ones of a format distinct pseudonyms. A row is changed where it stands; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: The key of the query; a caller passes its own.
KEY, ROUNDS = "pseudonyms-1", 8


def _round(key: str, tweak: str | Column, half: Column, i: Column) -> Column:
    """A non-negative keyed pseudo-random number."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak) if isinstance(tweak, str) else tweak, i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def feistel(x: Column, left: int, right: int, key: str, tweak: str) -> Column:
    """A keyed permutation of 0..left*right-1: halves modulo left and right, changed in turn."""
    start = F.struct(F.floor(x / right).cast("long").alias("a"), F.pmod(x, F.lit(right)).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, F.pmod(s["a"] + _round(key, tweak, s["b"], i), F.lit(left))).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _round(key, tweak, s["a"], i), F.lit(right)))
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return (done["a"] * right + done["b"]).cast("long")


def _halves(n: int) -> tuple[int, int]:
    return 10 ** (n // 2), 10 ** (n - n // 2)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _into(text: Column, digits: Column) -> Column:
    """The text with its digits replaced, in order, all else as it is."""
    chars = F.split(text, "")
    state = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))

    def put(s: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9") & (F.length(c) == 1)
        return F.struct((s["k"] + is_digit.cast("int")).alias("k"), F.concat(s["out"], F.when(is_digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(chars, state, put)["out"]


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _luhn_sum(digits: Column) -> Column:
    """The weighted digit sum in which the last digit counts once and every second one before it double."""
    marks = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), c.cast("int") + 1)))
    return F.aggregate(marks, F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str) -> Column:
    """16 digits with a right check digit: the first digit stays, the next 14 are permuted, the last is made right."""
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 1), _pad(feistel(F.substring(d, 2, 14).cast("long"), 10**7, 10**7, key, "card"), 14))
    check = F.pmod(F.lit(0) - _luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    return F.when(_luhn_sum(d) % 10 == 0, _into(m, F.concat(body, check.cast("string"))))


def _phone(m: Column, key: str) -> Column:
    """All ten digits after a country code: area code and last four together, then the middle ones by a key of those."""
    d = F.substring(_digits(m), -10, 10)
    new = feistel(F.substring(d, 1, 3).cast("long") * 10_000 + F.substring(d, 7, 4).cast("long"), 1000, 10_000, key, "phone")
    # the new outer digits say how far the middle ones are moved, so distinct numbers stay distinct
    shift = F.pmod(_round(key, "phone-middle", new, F.lit(0)), F.lit(1000))
    middle = F.pmod(F.substring(d, 4, 3).cast("long") + shift, F.lit(1000))
    code = F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 10)
    return _into(m, F.concat(code, _pad(F.floor(new / 10_000), 3), _pad(middle, 3), _pad(new % 10_000, 4)))


def _ip(m: Column, key: str) -> Column:
    """Four numbers up to 255: all 32 bits are permuted."""
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    x = feistel(((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3], 65_536, 65_536, key, "ip")
    part = lambda k: F.pmod(F.floor(x / 256**k), F.lit(256)).cast("string")
    return F.when(F.forall(p, lambda v: v <= 255), F.concat_ws(".", part(3), part(2), part(1), part(0)))


#: Dates are permuted among 11 * 6641 days from here, to 2100-01-02.
_DAY0, _DAYS = "1900-01-01", (11, 6641)


def _date_as(order: str) -> Callable[[Column, str], Column]:
    def date(m: Column, key: str) -> Column:
        """A date of the calendar from 1900-01-01 to 2100-01-02; others are left alone."""
        parts = F.split(m, r"[-/.]")
        at = {c: k for k, c in enumerate(order)}
        y, mo, d = (parts[at[c]] for c in "ymd")
        day = F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        n = F.date_diff(day, F.lit(_DAY0).cast("date")).cast("long")
        new = F.date_add(F.lit(_DAY0).cast("date"), feistel(n, *_DAYS, key, "date").cast("int"))
        sep = F.substring(F.regexp_replace(m, r"[0-9]", ""), 1, 1)
        text = {"y": F.date_format(new, "yyyy"), "m": F.date_format(new, "MM"), "d": F.date_format(new, "dd")}
        return F.when(day.isNotNull() & (n >= 0) & (n < _DAYS[0] * _DAYS[1]), F.concat_ws("", text[order[0]], sep, text[order[1]], sep, text[order[2]]))

    return date


def _ssn(m: Column, key: str) -> Column:
    """Nine digits in groups of 3, 2 and 4 whose area is neither 000 nor 666 nor over 899; permuted among valid numbers."""
    p = F.transform(F.split(m, "-"), lambda x: x.cast("long"))
    area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
    ok = (p[0] > 0) & (p[0] != 666) & (p[0] < 900) & (p[1] > 0) & (p[2] > 0)
    x = feistel((area * 99 + p[1] - 1) * 9999 + p[2] - 1, 898 * 99, 9999, key, "ssn")
    new = F.floor(x / (99 * 9999)) + 1
    new = new + F.when(new >= 666, 1).otherwise(0)
    return F.when(ok, F.concat_ws("-", _pad(new, 3), _pad(F.pmod(F.floor(x / 9999), F.lit(99)) + 1, 2), _pad(x % 9999 + 1, 4)))


#: Letters and digits of a local part that are permuted together: their number stays below 2**63.
_TOGETHER = 12
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(26)).cast("long")


def _number(cs: Column) -> Column:
    """Lower-case letters and digits as one number, each place with its own radix."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 97)
    return F.aggregate(cs, F.lit(0).cast("long"), lambda n, c: n * _radix(c) + value(c))


def _numbers(cs: Column) -> Column:
    """How many numbers such places make."""
    return F.aggregate(cs, F.lit(1).cast("long"), lambda n, c: n * _radix(c))


def _spelled(x: Column, cs: Column) -> Column:
    """The number in letters and digits, at the places of cs."""
    def put(s: Column, c: Column) -> Column:
        d = F.pmod(s["n"], _radix(c))
        sign = F.when(c.between("0", "9"), d.cast("string")).otherwise(F.substr(F.lit(_LETTERS), d.cast("int") + 1, F.lit(1)))
        return F.struct(F.floor((s["n"] - d) / _radix(c)).cast("long").alias("n"), F.concat(sign, s["out"]).alias("out"))

    return F.aggregate(F.reverse(cs), F.struct(x.alias("n"), F.lit("").alias("out")), put)["out"]


def _email(m: Column, key: str) -> Column:
    """The local part's letters and digits are permuted among those of its form (where it has letters, digits and signs) and domain.

    Twelve at a time are one number, permuted by a network that is keyed by form, domain and what came before. Case stays
    where it is and makes no difference: equal addresses get equal pseudonyms.
    """
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    signs = F.filter(F.split(F.lower(local), ""), lambda c: c.rlike("^[a-z0-9]$"))
    form = F.concat(F.regexp_replace(F.regexp_replace(F.lower(local), "[a-z]", "a"), "[0-9]", "0"), F.lit("@"), F.lower(domain))

    def part(done: Column, k: Column) -> Column:
        cs = F.slice(signs, k * _TOGETHER + 1, F.lit(_TOGETHER))
        half = F.floor(F.size(cs) / 2).cast("int")
        left, right = F.slice(cs, F.lit(1), half), F.slice(cs, half + 1, F.lit(_TOGETHER))
        tweak = F.concat_ws("|", F.lit("email"), form, done)

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            a = F.when(even, F.pmod(s["a"] + _round(key, tweak, s["b"], i), _numbers(left))).otherwise(s["a"])
            b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _round(key, tweak, s["a"], i), _numbers(right)))
            return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

        new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_number(left).alias("a"), _number(right).alias("b")), step)
        return F.concat(done, _spelled(new["a"], left), _spelled(new["b"], right))

    n = F.size(signs)
    out = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / _TOGETHER).cast("int")), F.lit(""), part)
    state = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))

    def put(s: Column, c: Column) -> Column:
        new = F.substr(out, s["k"], F.lit(1))
        sign = F.when(c.rlike("^[A-Z]$"), F.upper(new)).when(c.rlike("^[a-z0-9]$"), new).otherwise(c)
        return F.struct((s["k"] + c.rlike("^[A-Za-z0-9]$").cast("int")).alias("k"), F.concat(s["out"], sign).alias("out"))

    return F.when(n > 0, F.concat(F.aggregate(F.split(local, ""), state, put)["out"], F.lit("@"), domain))


@dataclass(frozen=True)
class Kind:
    """A pattern, what tells cheaply that a text may hold it, and its pseudonym: null for values that aren't valid."""

    name: str
    pattern: str
    pseudonym: Callable[[Column, str], Column]


KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+", _email),
    Kind("card", r"(?<![0-9A-Za-z])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])", _card),
    Kind("phone", r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ -]\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}(?![0-9A-Za-z])", _phone),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", _ssn),
    Kind("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])", _ip),
    Kind("date_ymd", r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])", _date_as("ymd")),
    Kind("date_dmy", r"(?<![0-9A-Za-z./])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9A-Za-z]|\.[0-9])", _date_as("dmy")),
    Kind("date_mdy", r"(?<![0-9A-Za-z./])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z/])", _date_as("mdy")),
)


def _replaced(text: Column, kind: Kind, key: str) -> Column:
    """A struct of the text with this kind's valid values replaced, and their number."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    new = F.transform(found, lambda m: kind.pseudonym(m, key))
    between = F.split(text, kind.pattern, -1)
    put = F.zip_with(between, F.zip_with(found, new, lambda m, p: F.coalesce(p, m)), lambda t, m: F.concat(t, F.coalesce(m, F.lit(""))))
    return F.struct(F.array_join(put, "").alias("text"), F.size(F.filter(new, lambda p: p.isNotNull())).alias("n"))


def pseudonymise(docs: DataFrame, key: str = KEY, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The documents with their personal data replaced, and n_<kind> for each kind: how many values were.

    Null and empty texts stay as they are with zeros. Values that fail validation stay. Every row is changed by
    itself, so repeated rows get equal results; columns of docs named n_<kind> are replaced; an empty table
    gives an empty one. Texts without digits, and those without a kind's pattern, are passed over.
    """
    out = docs
    for kind in kinds:
        has = F.rlike("text", F.lit(kind.pattern))
        out = out.withColumn("__r", F.when(has, _replaced(F.col("text"), kind, key)))
        out = out.withColumns({"text": F.coalesce("__r.text", "text"), f"n_{kind.name}": F.coalesce("__r.n", F.lit(0))}).drop("__r")
    return out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))
