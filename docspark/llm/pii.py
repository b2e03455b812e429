"""PII pseudonyms by format-preserving Feistel permutations (operator 7).

Mail addresses, phone, card and social security numbers, IPv4 addresses and dates are found by one
pattern, validated (octets, calendar, digit counts, Luhn test, number areas), and permuted under a key within their own
format: digits stay digits in the same layout, octets stay octets, dates stay dates of their notation (MM/dd where that parses,
else dd/MM), cards keep passing the Luhn test, social security numbers stay valid, letters keep their case. The permutation depends
on the key, the kind and the value alone, so equal values get equal pseudonyms in every document, and different values of a
format different ones; addresses that differ in case alone share theirs. A value is moved one step inside the order that a Feistel network deals
(deal, step, deal back), so no value is its own pseudonym.

Null and empty texts come back as they are; text without findings is unchanged; texts may have any length. Every input row gives
one row, repeated ones too, whatever its id. Matches that fail validation stay. Other columns are kept as they are; of a table
without text all texts are null. No rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

_NO, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Kinds and their patterns, in order of preference.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ip", _NO + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}" + r"(?![\p{L}\p{N}_]|\.\d)"),
    ("date", _NO + r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})" + _END),
    ("ssn", _NO + r"\d{3}-\d{2}-\d{4}" + _END),
    ("phone", r"(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}" + _END + r"|(?:\(\d{3}\) ?|" + _NO + r"\d{3}[ .-])\d{3}[ .-]\d{4}" + _END),
    ("card", _NO + r"\d(?:[ -]?\d){12,18}" + _END),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
ROUNDS = 8
DATE_FORMATS = (("\\d{4}-.*", "yyyy-MM-dd"), ("\\d{4}/.*", "yyyy/MM/dd"), (".*\\..*", "dd.MM.yyyy"))
#: Steps of a walk to the next valid value; a third or more of all values are valid.
WALK = 64
#: Dates are permuted within blocks of this square of days.
_DAYS = 200


def _feistel(key: str, kind: str, left: Column, right: Column, m_left: Column, m_right: Column) -> tuple[Column, Column]:
    """Permute pairs below (m_left, m_right): halves take turns in adding a keyed hash of the other."""

    def turn(i: Column, other: Column, modulus: Column) -> Column:
        digest = F.sha2(F.concat_ws("/", F.lit(key), F.lit(kind), m_left.cast("string"), m_right.cast("string"), i.cast("string"), other.cast("string")), 256)
        return F.pmod(F.conv(digest.substr(1, 14), 16, 10).cast("long"), modulus)

    def rounds(order: Column, sign: int, state: Column) -> Column:
        return F.aggregate(
            order,
            state,
            lambda s, i: F.when(i % 2 == 1, F.struct(F.pmod(s["l"] + sign * turn(i, s["r"], m_left), m_left).alias("l"), s["r"].alias("r"))).otherwise(
                F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * turn(i, s["l"], m_right), m_right).alias("r"))
            ),
        )

    there = rounds(F.sequence(F.lit(1), F.lit(ROUNDS)), 1, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")))
    moved = _let(there, lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + 1, m_right).cast("long").alias("r")))
    back = rounds(F.sequence(F.lit(ROUNDS), F.lit(1)), -1, moved)
    return back["l"], back["r"]


def _walk(value: Column, step, valid) -> Column:
    """The first valid value that steps from a valid one reach: a permutation of the valid values."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))

    def on(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(_let(step(s["v"]), lambda v: F.struct(v.alias("v"), valid(v).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, on)["v"]


def _power(base: int, n: Column) -> Column:
    return F.aggregate(F.array_repeat(F.lit(base).cast("long"), n), F.lit(1).cast("long"), lambda a, b: a * b)


def _in_base(s: Column, base: int) -> Column:
    return F.coalesce(F.conv(s, base, 10).cast("long"), F.lit(0).cast("long"))


def _string(s: Column, base: int, kind: str, key: str) -> Column:
    """Permute strings of 1 to 24 digits of a base among those of the same length."""
    n = F.length(s)
    a, b = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
    left, right = _feistel(key, kind, _in_base(F.substring(s, F.lit(1), a), base), _in_base(F.substring(s, a + 1, b), base), _power(base, a), _power(base, b))
    back = lambda x, w: F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), w, "0")
    return F.concat(back(left, a), back(right, b))


def _refill(shape: Column, keep: str, filling: Column) -> Column:
    """Put the characters of `filling` into the places of `shape` that are in the class `keep`."""
    places = F.split(shape, "")
    return F.array_join(
        F.transform(places, lambda c, i: F.when(c.rlike(f"^[{keep}]$"), F.substring(filling, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{keep}]", "")), F.lit(1))).otherwise(c)), ""
    )


def _luhn(body: Column) -> Column:
    """The check digit of a string of digits."""
    add = F.aggregate(
        F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, b: a + b,
    )
    return F.pmod(10 - add % 10, F.lit(10))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _card(m: Column, key: str) -> Column:
    def use(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        passes = F.substring(d, F.length(d), F.lit(1)).cast("int") == _luhn(body)
        return F.when(passes, _let(_string(body, 10, "card", key), lambda p: F.concat(p, _luhn(p).cast("string")))).otherwise(d)

    return _refill(m, "0-9", _let(_digits(m), use))


def _ssn(m: Column, key: str) -> Column:
    valid = lambda d: ~d.rlike(r"^(000|666|9\d\d)|^\d{3}00|0000$")
    return _let(_digits(m), lambda d: F.when(valid(d), _refill(m, "0-9", _walk(d, lambda x: _string(x, 10, "ssn", key), valid))).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, _refill(rest, "0-9", _string(_digits(rest), 10, "phone", key)))


def _runs(s: Column, base: int, kind: str, key: str) -> Column:
    """Permute a string of any length in runs of 24 digits of the base."""
    each = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(s), F.lit(1)) - 1) / 24).cast("int")), lambda i: F.substring(s, i * 24 + 1, F.lit(24)))
    return F.array_join(F.transform(each, lambda r: F.when(F.length(r) > 0, _string(r, base, kind, key)).otherwise("")), "")


_AZ, _BASE26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the local part are permuted each on their own; case and host stay."""
    local = F.substring_index(m, "@", 1)
    letters = F.translate(F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), _AZ, _BASE26)
    moved = _refill(local, "A-Za-z", F.translate(_runs(letters, 26, "email", key), _BASE26, _AZ))
    cased = F.array_join(F.zip_with(F.split(local, ""), F.split(moved, ""), lambda was, now: F.when(was.rlike("^[A-Z]$"), F.upper(now)).otherwise(now)), "")
    return F.concat(_refill(cased, "0-9", _runs(_digits(local), 10, "email", key)), F.lit("@"), F.substring_index(m, "@", -1))


def _ip(m: Column, key: str) -> Column:
    def use(o: Column) -> Column:
        n = lambda i: F.get(o, F.lit(i)).cast("int")
        left, right = _feistel(key, "ip", n(0) * 256 + n(1), n(2) * 256 + n(3), F.lit(65536), F.lit(65536))
        two = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), F.concat_ws(".", two(left), two(right))).otherwise(m)

    return _let(F.split(m, "\\."), use)


def _parsed(m: Column, form: str) -> Column:
    """The date, or null; dates after the last whole block of days are left out."""
    d = F.to_date(F.try_to_timestamp(m, F.lit(form)))
    return F.when(F.datediff(d, F.lit("0001-01-01").cast("date")).between(0, 91 * _DAYS * _DAYS - 1), d)


def _moved_date(d: Column, key: str) -> Column:
    n = F.datediff(d, F.lit("0001-01-01").cast("date"))
    block = F.floor(n / (_DAYS * _DAYS)).cast("int") * (_DAYS * _DAYS)
    left, right = _feistel(key, "date", F.floor((n - block) / _DAYS), F.pmod(n, F.lit(_DAYS)), F.lit(_DAYS), F.lit(_DAYS))
    return F.date_add(F.lit("0001-01-01").cast("date"), (block + left * _DAYS + right).cast("int"))


def _date_in(m: Column, form: str, key: str, otherwise: Column, valid=None) -> Column:
    """valid: which dates may come out, if not all."""
    moved = lambda d: F.date_format(_moved_date(d, key) if valid is None else _walk(d, lambda x: _moved_date(x, key), valid), form)
    return _let(_parsed(m, form), lambda d: F.when(d.isNotNull(), moved(d)).otherwise(otherwise))


def _date(m: Column, key: str) -> Column:
    # A day-first date stays one that no month-first date looks like.
    day_first = _date_in(m, "dd/MM/yyyy", key, m, lambda d: F.dayofmonth(d) > 12)
    out = F.when(m.rlike("^../../"), _date_in(m, "MM/dd/yyyy", key, day_first)).otherwise(m)
    for shape, form in reversed(DATE_FORMATS):
        out = F.when(m.rlike(f"^{shape}$"), _date_in(m, form, key, m)).otherwise(out)
    return out


def kind_of(m: Column) -> Column:
    """Which kind a match is: the first whose pattern matches it whole."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(m, key))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "phone", F.when(F.length(_digits(m)).between(7, 20), _phone(m, key)).otherwise(m))
        .when(kind == "card", _card(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, counts: str | None = None) -> DataFrame:
    """docs with its text replaced; `counts` names a column to add: how many findings of each of KINDS were replaced.

    A name that docs already has is refused, so no column is lost.
    """
    if counts in docs.columns:
        raise ValueError(f"docs already has a column {counts}")
    text = column(docs, "text", "string")
    some = text.rlike("[0-9@]") & text.rlike(PATTERN)
    found = F.when(some, F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: _let(kind_of(m), lambda k: F.struct(k.alias("kind"), m.alias("was"), pseudonym(m, k, key).alias("now")))))
    own = "found_" + uuid.uuid4().hex
    d = docs.withColumn(own, found)
    merged = F.array_join(F.zip_with(F.split(text, PATTERN, -1), F.col(own), lambda gap, hit: F.concat(gap, F.coalesce(hit["now"], F.lit("")))), "")
    if counts is not None:
        changed = lambda k: F.size(F.filter(own, lambda x: (x["kind"] == k) & (x["was"] != x["now"])))
        d = d.withColumn(counts, F.when(F.col(own).isNull(), F.array_repeat(F.lit(0), len(KINDS))).otherwise(F.array(*(changed(k) for k, _ in KINDS))))
    return d.withColumn("text", F.when(F.col(own).isNull(), text).otherwise(merged)).drop(own)
