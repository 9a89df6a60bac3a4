"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network within their format.

DataFrame functions only. Candidates are found by one pattern, then validated: payment cards by their Luhn digit,
account numbers (IBAN) by their remainder modulo 97, North American telephone and social security numbers by
the ranges of their parts, IPv4 addresses by their octets, dates by the calendar. What fails stays as it is. Each
format is a pair of residues (left, right) that cover its valid values exactly, and each round adds to one a keyed hash of
the other; so a pseudonym is again a valid value of the format, different values keep different pseudonyms, and
equal values have equal ones in all documents. Dates are equal as days, whether written year, day or month first; a
pseudonym is written so that the same reading gives its day. E-mail addresses have the letters and digits before the @
permuted likewise, alike in either case. Telephone numbers of other countries keep their country code and the digit
after it. The key is a parameter; whoever holds it can undo the permutation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled

ROUNDS = 8
KINDS = ["email", "date", "ip", "iban", "ssn", "phone", "card"]

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}._%+-]{0,62}[\p{L}\p{M}\p{N}])?@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
ISO_DATE, DMY_DATE = r"\d{4}-\d{2}-\d{2}", r"\d{1,2}([./])\d{1,2}\1\d{4}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
SSN = r"\d{3}-\d{2}-\d{4}"
#: A number that a word for a version stands before is no address.
VERSION = r"(?<!(?i:\bversion|\bver|\bver\.|\brelease|\bbuild)[ :])"
ABROAD = r"\+(?!1[ .(-])[1-9]\d{0,2}(?:[ .-]?\(?\d{1,5}\)?){2,6}"
PHONE = r"(?:\+?1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:\+?1[ .-]?)?\d{3}[ .-]\d{3}[ .-]\d{4}"
#: A whole run of digit groups, up to where another kind of value begins; which of its groups are a card is judged after.
OTHER = rf"(?:{ISO_DATE}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|{IPV4}|{SSN}|{PHONE}){_E}"
CARD = rf"(?=\d(?:[ -]?\d){{12}})\d++(?![A-Za-z_])(?:[ -](?!{OTHER})\d++(?![A-Za-z_]))*+"
FINDER = rf"{_B}(?:{EMAIL}|{ISO_DATE}(?!-)|{DMY_DATE}|{VERSION}(?<!\d\.){IPV4}(?!\.\d)|{IBAN}|{SSN}(?!-)){_E}|(?<![A-Za-z0-9_+])(?:{PHONE}|{ABROAD}){_E}|{_B}{CARD}{_E}"

#: 400 years have 146,097 days, 27 times 5,411.
FIRST_DAY, DAYS, DAY_L, DAY_R = "1800-01-01", 146_097, 27, 5_411
#: Latin letters with marks that have both cases, in the same order.
SMALL = "".join(c for c in map(chr, range(0xDF, 0x180)) if c.islower() and len(c.upper()) == 1 and c.upper().lower() == c and 0xC0 <= ord(c.upper()) < 0x180)
LARGE = SMALL.upper()


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def prf(key: str, tag: str, i: Column, value: Column) -> Column:
    """60 bits of a keyed hash, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tag: str, left: Column, right: Column, n_left, n_right, rounds: int = ROUNDS) -> Column:
    """struct(l, r): a permutation of the pairs (left modulo n_left, right modulo n_right)."""
    n_left, n_right = _long(n_left), _long(n_right)

    def step(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]  # noqa: E741
        odd = i % 2 == 1
        return F.struct(F.when(odd, F.pmod(l + F.pmod(prf(key, tag, i, r), n_left), n_left)).otherwise(l).alias("l"), F.when(odd, r).otherwise(F.pmod(r + F.pmod(prf(key, tag, i, l), n_right), n_right)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(_long(left).alias("l"), _long(right).alias("r")), step)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def permuted_digits(key: str, tag: str, d: Column) -> Column:
    """A digit string of 2 to 30 digits, permuted among those of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    v = n - u
    left, right = F.substring(d, F.lit(1), u), F.substring(d, u + 1, v)
    return let(feistel(key, tag, F.concat(F.lit("0"), left).cast("long"), F.concat(F.lit("0"), right).cast("long"), F.pow(F.lit(10.0), u), F.pow(F.lit(10.0), v)), lambda s: F.concat(F.lpad(s["l"].cast("string"), u, "0"), F.lpad(s["r"].cast("string"), v, "0")))


def poured(form: Column, pattern: str, new: Column) -> Column:
    """form with its characters of a class replaced, one by one, by those of new."""
    gaps = F.split(form, pattern)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.substring(new, i + 1, F.lit(1)))), "")


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""

    def term(c: Column, i: Column) -> Column:
        x = F.ascii(c) - 48
        return F.when((F.length(d) - i) % 2 == 0, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)

    return F.aggregate(F.transform(F.split(d, ""), term), F.lit(0), lambda a, x: a + x)


def card(key: str, m: Column) -> Column:
    """Keeps the first digit and the length; the check digit follows from the others."""

    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permuted_digits(key, "card", F.substring(d, F.lit(2), F.length(d) - 2)))
        return let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return let(digits_of(m), lambda d: F.when(F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0), poured(m, "[0-9]", new(d))))


def cards(key: str, m: Column) -> Column:
    """struct(new, n): the run with its cards replaced, and how many; new is null without any.

    The run as a whole first; else its stretches of groups with 13 to 19 digits, the longest first, then from the left,
    none overlapping another.
    """
    signs = F.regexp_extract_all(m, F.lit("[ -]"), F.lit(0))

    def parts(g: Column) -> Column:
        n = F.size(g)
        text = lambda i, k: F.aggregate(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), F.get(g, i), lambda a, j: F.concat(a, F.coalesce(F.get(signs, i + j - 1), F.lit("")), F.coalesce(F.get(g, i + j), F.lit(""))))
        one = lambda i, k: F.struct(i.alias("i"), k.alias("k"), F.when(k == 1, F.get(g, i)).otherwise(text(i, k)).alias("m"))
        spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), lambda k: one(i, k))))
        sized = F.filter(spans, lambda x: F.length(digits_of(x["m"])).between(13, 19))
        good = F.filter(sized, lambda x: luhn_sum(digits_of(x["m"])) % 10 == 0)
        order = F.transform(good, lambda x: F.struct((-F.length(digits_of(x["m"]))).alias("d"), x["i"].alias("i"), x["k"].alias("k"), x["m"].alias("m")))
        none = F.filter(order, lambda x: F.lit(False))
        taken = F.aggregate(F.array_sort(order), none, lambda a, x: F.when(F.exists(a, lambda y: (x["i"] < y["i"] + y["k"]) & (y["i"] < x["i"] + x["k"])), a).otherwise(F.concat(a, F.array(x))))

        def rebuilt(t: Column) -> Column:
            def group(i: Column) -> Column:
                before = F.when(i > 0, F.get(signs, i - 1)).otherwise("")
                inside = F.filter(t, lambda x: (x["i"] <= i) & (i < x["i"] + x["k"]))
                return F.when(F.size(inside) == 0, F.concat(before, F.get(g, i))).when(F.get(inside, F.lit(0))["i"] == i, F.concat(before, card(key, F.get(inside, F.lit(0))["m"]))).otherwise("")

            return F.struct(F.when(F.size(t) > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), group), "")).alias("new"), F.size(t).alias("n"))

        return let(taken, rebuilt)

    return let(F.split(m, "[ -]"), parts)


def ibans(key: str, m: Column) -> Column:
    """The longest run of groups from the left that is a valid account number replaced, the rest as it is."""
    groups = F.split(m, " ")
    cut = lambda k: F.array_join(F.slice(groups, F.lit(1), k), " ")
    tried = F.transform(F.reverse(F.sequence(F.lit(1), F.size(groups))), lambda k: let(cut(k), lambda c: F.concat(iban(key, c), F.substring(m, F.length(c) + 1, F.length(m)))))
    return F.get(F.filter(tried, lambda x: x.isNotNull()), F.lit(0))


def remainder97(iban: Column) -> Column:
    """The remainder of an account number without spaces, its first four characters moved to the end."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def iban(key: str, m: Column) -> Column:
    """Keeps country, letters and length; the check digits follow from the rest."""

    def new(a: Column) -> Column:
        rest = F.substring(a, F.lit(5), F.length(a))
        body = let(digits_of(rest), lambda d: poured(rest, "[0-9]", permuted_digits(key, "iban", d)))
        country = F.substring(a, 1, 2)
        return let(body, lambda b: F.concat(country, F.lpad((F.lit(98) - remainder97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b))

    return let(F.replace(m, F.lit(" "), F.lit("")), lambda a: F.when(F.length(a).between(15, 34) & (F.length(digits_of(a)) >= 4) & (remainder97(a) == 1), poured(m, "[A-Z0-9]", new(a))))


def phone(key: str, m: Column) -> Column:
    """Keeps a leading 1; area and exchange begin with 2 to 9."""

    def new(d: Column) -> Column:
        own = F.right(d, F.lit(10))
        area, rest = F.substring(own, 1, 3).cast("long") - 200, F.substring(own, 4, 7).cast("long") - 2_000_000
        return let(feistel(key, "phone", area, rest, 800, 8_000_000), lambda s: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), (s["l"] + 200).cast("string"), (s["r"] + 2_000_000).cast("string")))

    def abroad(d: Column) -> Column:
        code = F.regexp_extract(m, r"^\+(\d{1,3})(?=[ .(-])", 1)
        keep = F.when(F.length(code) > 0, F.length(code)).otherwise(2) + 1
        return F.concat(F.substring(d, F.lit(1), keep), permuted_digits(key, "abroad", F.substring(d, keep + 1, F.length(d))))

    other = m.startswith("+") & ~m.rlike("^\\+1[ .(-]")
    return let(digits_of(m), lambda d: F.when(other, F.when(F.length(d).between(9, 15), poured(m, "[0-9]", abroad(d)))).when(d.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$"), poured(m, "[0-9]", new(d))))


def ssn(key: str, m: Column) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    new = let(feistel(key, "ssn", index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999), lambda s: F.concat_ws("-", pad(s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0), 3), pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4)))
    return F.when(valid, new)


def ip(key: str, m: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    part = lambda k: F.split(m, "[.]")[k].cast("long")
    new = let(feistel(key, "ip", part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536), lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))
    return F.when(m.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), new)


def moved_day(key: str, day: Column) -> Column:
    """A date of 1800 to 2199 permuted among them."""
    index = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return let(feistel(key, "date", F.floor(index / DAY_R), index % DAY_R, DAY_L, DAY_R), lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAY_R + s["r"]).cast("int")))


def date(key: str, m: Column) -> Column:
    """ISO dates, and dates with the day first, or else with the month first; parts keep their leading zeros.

    A date with the month first stays so where its new day is above 12; else it is written with the day first, as it
    would be read.
    """
    part = lambda k: F.regexp_extract(m, r"^(\d{1,2})([./])(\d{1,2})[./](\d{4})$", k)
    a, b, year, sign = part(1), part(3), part(4), part(2)
    real = lambda y, mo, d: F.when((y.try_cast("int").between(1800, 2199)), F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))
    like = lambda old, new: F.lpad(new.cast("string"), F.greatest(F.length(old), F.length(new.cast("string"))), "0")
    whole = F.when(m.rlike(r"^\d{4}-"), real(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2)))
    day_first, month_first = real(year, b, a), real(year, a, b)
    iso = let(whole, lambda d: F.when(d.isNotNull(), F.date_format(moved_day(key, d), "yyyy-MM-dd")))
    first = let(day_first, lambda d: F.when(d.isNotNull(), let(moved_day(key, d), lambda n: F.concat(like(a, F.day(n)), sign, like(b, F.month(n)), sign, F.year(n).cast("string")))))
    written = lambda x, y, n: F.concat(like(a, x), sign, like(b, y), sign, F.year(n).cast("string"))
    second = let(month_first, lambda d: F.when(d.isNotNull(), let(moved_day(key, d), lambda n: F.when(F.day(n) > 12, written(F.month(n), F.day(n), n)).otherwise(written(F.day(n), F.month(n), n)))))
    return F.when(m.rlike(r"^\d{4}-"), iso).otherwise(F.coalesce(first, second))


def email(key: str, m: Column) -> Column:
    """Letters and digits before the @ are shifted within their class, halves in turn; signs, case and the domain stay.

    Latin letters with marks are shifted among such; letters of other scripts become plain ones, by which alone two
    addresses might meet.
    """
    local = F.substring_index(m, "@", 1)

    def shifted(half: Column, other: Column, i: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            add = prf(key, "email", F.concat_ws(",", i.cast("string"), at.cast("string")), F.lower(other))
            among = lambda letters: F.substring(F.lit(letters), F.pmod(F.instr(F.lit(letters), c) - 1 + F.pmod(add, F.lit(len(letters))), F.lit(len(letters))).cast("int") + 1, F.lit(1))
            move = lambda base, n: F.char(F.pmod(F.ascii(c) - base + F.pmod(add, F.lit(n)), F.lit(n)) + base)
            return F.when(c.rlike("[0-9]"), move(48, 10)).when(c.rlike("[a-z]"), move(97, 26)).when(c.rlike("[A-Z]"), move(65, 26)).when(F.instr(F.lit(SMALL), c) > 0, among(SMALL)).when(F.instr(F.lit(LARGE), c) > 0, among(LARGE)).when(c.rlike(r"[\p{L}\p{M}\p{N}]"), F.char(F.pmod(add + F.ascii(c), F.lit(26)) + 97)).otherwise(c)

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))

    n = F.floor(F.length(local) / 2).cast("int")
    step = lambda s, i: F.when(i % 2 == 1, F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i).alias("r"))).otherwise(F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r")))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.struct(F.substring(local, F.lit(1), n).alias("l"), F.substring(local, n + 1, F.length(local)).alias("r")), step)
    return let(done, lambda s: F.concat(s["l"], s["r"], F.substring(m, F.length(local) + 1, F.length(m))))


def replacement(key: str, m: Column) -> Column:
    """struct(kind, new, n) of a candidate, n the values replaced in it; kind is null and new the candidate itself where no format validates it."""
    full = lambda p: m.rlike(rf"^(?:{p})$")
    kind = F.when(F.instr(m, "@") > 0, "email").when(full(ISO_DATE) | full(r"\d{1,2}[./]\d{1,2}[./]\d{4}"), "date").when(full(IPV4), "ip").when(m.rlike("^[A-Z]"), "iban").when(full(SSN), "ssn").when(full(f"{PHONE}|{ABROAD}"), "phone").otherwise("card")
    makers = {"email": email, "date": date, "ip": ip, "iban": ibans, "ssn": ssn, "phone": phone}

    def chosen(k: Column) -> Column:
        new = F.when(F.lit(False), F.lit(""))
        for name, f in makers.items():
            new = new.when(k == name, f(key, m))
        both = F.when(k == "card", cards(key, m)).otherwise(F.struct(new.alias("new"), F.lit(1).alias("n")))
        return let(both, lambda b: F.struct(F.when(b["new"].isNotNull(), k).alias("kind"), F.coalesce(b["new"], m).alias("new"), b["n"].alias("n")))

    return let(kind, chosen)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in the text, and a column n_<kind> for each of KINDS: how many values were replaced.

    Null text stays null with counts of 0; a text without candidates stays as it is. Equal values have equal
    pseudonyms in all rows. Columns of docs named like the counts are replaced, all others stay; an empty table gives no rows.
    """
    text = filled(F.col(text_col))
    found = F.when(text.rlike("[0-9@]"), F.transform(F.regexp_extract_all(text, F.lit(FINDER), F.lit(0)), lambda m: replacement(key, m)))
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), found.alias("_found"))
    gaps = F.split(F.col("_text"), FINDER)
    new = F.array_join(F.zip_with(gaps, F.concat(F.col("_found.new"), F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    text = F.when(F.size("_found") > 0, new).otherwise(F.col("_text"))
    count = lambda k: F.coalesce(F.aggregate(F.filter("_found", lambda x: x["kind"] == k), F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long")
    same = [text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    return rows.select(*same, *[F.when(F.col("_found").isNull(), F.lit(0)).otherwise(count(k)).cast("long").alias(f"n_{k}") for k in KINDS])
