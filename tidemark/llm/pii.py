"""Format-preserving pseudonyms for validated numbers and dates. Built-in functions only.

A value is found by its format, validated (check digit, number plan, ranges,
calendar) and read as a pair (left, right) in a product of two ranges. Rounds
of a keyed Feistel network add a digest of one half to the other, modulo its
range, which permutes the format's valid values; the result is written back in
the value's own layout. So equal values stay equal across documents, different
values stay different, and every pseudonym is valid in its format again.

Defined cases: null text stays null and has no values; invalid look-alikes stay
as they are; repeated values, rows and ties get the same pseudonym each time; a
null doc_id passes through; an empty table gives no rows; other columns pass
through, but for one named found, which the findings replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import once

ROUNDS = 10

#: Formats, as Java patterns.
CARD = r"(?:\d{4}[ -]){3}\d{4}|\d{16}"
PHONE = r"\+1 ?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
DATE = r"\d{4}-\d{2}-\d{2}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
EMAIL = r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ANY = rf"(?<![\w.@+-])(?:{EMAIL}|{PHONE}|{CARD}|{SSN}|{DATE}|{IPV4})(?![\w@])"
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31
DATE_RANGES = (271, 270)  # the least product of near ranges at or above DAYS
WALKS = 24  # a date out of range is permuted again until it is in range


def _digest(key: Column, kind: str, i: Column, half: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), half.cast("string")), 256), 1, 14), 16, 10).cast("long")


def feistel(left: Column, right: Column, ranges: tuple[int, int], key: Column, kind: str, then) -> Column:
    """then(left, right) of a keyed permutation of range(a) x range(b)."""
    a, b = ranges
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        turn_l = F.struct(F.pmod(s["l"] + _digest(key, kind, i, s["r"]), F.lit(a)).alias("l"), s["r"].alias("r"))
        turn_r = F.struct(s["l"].alias("l"), F.pmod(s["r"] + _digest(key, kind, i, s["l"]), F.lit(b)).alias("r"))
        return F.when(i % 2 == 0, turn_l).otherwise(turn_r)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: then(s["l"], s["r"]))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of a digit string's Luhn weights; doubled: parity of the places, from the left at 0, that count twice."""
    def weight(i: Column) -> Column:
        d = F.substr(digits, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), weight), F.lit(0), lambda s, x: s + x)


def _fill(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced in order."""
    chars = F.split(layout, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9") & (F.length(c) == 1)
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(chars, start, step, lambda s: s["out"])


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _card(v: Column, key: Column) -> Column:
    def swap(d: Column) -> Column:
        body = feistel(F.substr(d, F.lit(1), F.lit(8)), F.substr(d, F.lit(9), F.lit(7)), (10**8, 10**7), key, "card", lambda x, y: F.concat(_pad(x, 8), _pad(y, 7)))
        full = once(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.when(F.pmod(luhn_sum(d, 0), F.lit(10)) == 0, _fill(v, full))

    return once(_digits(v), swap)


def _phone(v: Column, key: Column) -> Column:
    def swap(d: Column) -> Column:
        area, office, line = F.substr(d, F.lit(2), F.lit(3)).cast("int"), F.substr(d, F.lit(5), F.lit(3)).cast("int"), F.substr(d, F.lit(8), F.lit(4)).cast("int")
        left, right = (area - 200) * 100 + F.floor(line / 100), (office - 200) * 100 + line % 100

        def build(x: Column, y: Column) -> Column:
            return F.concat(F.lit("1"), (F.floor(x / 100) + 200).cast("string"), (F.floor(y / 100) + 200).cast("string"), _pad(x % 100, 2), _pad(y % 100, 2))

        return F.when((area >= 200) & (office >= 200), _fill(v, feistel(left, right, (80_000, 80_000), key, "phone", build)))

    return once(_digits(v), swap)


def _ssn(v: Column, key: Column) -> Column:
    def swap(d: Column) -> Column:
        area, group, serial = F.substr(d, F.lit(1), F.lit(3)).cast("int"), F.substr(d, F.lit(4), F.lit(2)).cast("int"), F.substr(d, F.lit(6), F.lit(4)).cast("int")
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1  # areas 1..899 but 666

        def build(x: Column, y: Column) -> Column:
            a = F.floor(x / 99) + 1
            return F.concat(_pad(a + F.when(a >= 666, 1).otherwise(0), 3), _pad(x % 99 + 1, 2), _pad(y + 1, 4))

        return F.when(valid, _fill(v, feistel(left, serial - 1, (898 * 99, 9999), key, "ssn", build)))

    return once(_digits(v), swap)


def _ipv4(v: Column, key: Column) -> Column:
    def swap(o: Column) -> Column:
        valid = F.forall(o, lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~F.startswith(x, F.lit("0"))))
        n = [F.get(o, F.lit(k)).cast("int") for k in range(4)]

        def build(x: Column, y: Column) -> Column:
            return F.concat_ws(".", *[c.cast("string") for c in (F.floor(x / 256), x % 256, F.floor(y / 256), y % 256)])

        return F.when(valid, feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], (65_536, 65_536), key, "ipv4", build))

    return once(F.split(v, r"\."), swap)


def _date(v: Column, key: Column) -> Column:
    a, b = DATE_RANGES

    def walk(n: Column, i: Column) -> Column:
        again = feistel(F.floor(n / b), n % b, (a, b), key, "date", lambda x, y: x * b + y)
        return F.when((i == 0) | (n >= DAYS), again).otherwise(n)

    def swap(n: Column) -> Column:
        moved = F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), n.cast("long"), walk)
        return F.when(n.between(0, DAYS - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), "yyyy-MM-dd"))

    return once(F.datediff(F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date")), swap)


def _email(v: Column, key: Column) -> Column:
    """The local part, character by character within letters and digits, by a keystream bound to its class layout and length.

    Two halves of the local part turn in the same kind of network, each
    character within its own class, so the layout is kept.
    """
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def shifted(half: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", key, F.lit("email"), i.cast("string"), other), 512)

        def turn(c: Column, j: Column) -> Column:
            n = F.conv(F.substr(stream, 1 + (j % 42) * 3, F.lit(3)), 16, 10).cast("int")
            out = c
            for letters in (lower, upper, digit):
                at = F.position(c, F.lit(letters))
                out = F.when(at > 0, F.substr(F.lit(letters), 1 + F.pmod(at - 1 + n, F.lit(len(letters))), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(half, ""), turn), "")

    def swap(local: Column) -> Column:
        k = F.greatest(F.floor(F.length(local) / 2), F.lit(1)).cast("int")
        start = F.struct(F.substr(local, F.lit(1), k).alias("l"), F.substr(local, k + 1, F.lit(64)).alias("r"))

        def step(s: Column, i: Column) -> Column:
            l, r = F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r")), F.struct(s["l"].alias("l"), F.when(F.length(s["r"]) > 0, shifted(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"))
            return F.when(i % 2 == 0, l).otherwise(r)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))

    return F.concat(once(F.substring_index(v, "@", 1), swap), F.lit("@"), F.substring_index(v, "@", -1))


KINDS = (("email", EMAIL, _email), ("phone", PHONE, _phone), ("card", CARD, _card), ("ssn", SSN, _ssn), ("date", DATE, _date), ("ipv4", IPV4, _ipv4))


def pseudonym(value: Column, key: Column) -> Column:
    """struct(kind, new): new is null where the value is not valid."""
    out = F.lit(None)
    kind = F.lit(None).cast("string")
    for name, pattern, f in reversed(KINDS):
        here = value.rlike(f"^(?:{pattern})$")
        out = F.when(here, f(value, key)).otherwise(out)
        kind = F.when(here, name).otherwise(kind)
    return F.struct(value.alias("old"), kind.alias("kind"), out.cast("string").alias("new"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with values in the text column replaced, and found: the values' kinds and pseudonyms, in order."""
    k = F.lit(key)
    has = F.col(text).rlike(ANY)
    found = F.when(has, F.transform(F.regexp_extract_all(F.col(text), F.lit(ANY), 0), lambda v: pseudonym(v, k)))
    # found is the input of a second projection that names it several times: filter() keeps it evaluated once
    found = once(found, lambda f: f)
    staged = docs.withColumn("_pii_all", found)

    def rebuilt(f: Column) -> Column:
        pieces = F.split(F.col(text), ANY, -1)
        new = F.transform(f, lambda x: F.coalesce(x["new"], x["old"]))
        return F.array_join(F.flatten(F.zip_with(pieces, new, lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")

    both = once(F.col("_pii_all"), lambda f: F.struct(F.filter(f, lambda x: x["new"].isNotNull()).alias("found"), F.when(f.isNotNull(), rebuilt(f)).otherwise(F.col(text)).alias("text")))
    return staged.withColumn("_pii_both", both).withColumn(text, F.col("_pii_both.text")).withColumn("found", F.coalesce(F.col("_pii_both.found"), F.array().cast("array<struct<old:string,kind:string,new:string>>"))).drop("_pii_both", "_pii_all")
