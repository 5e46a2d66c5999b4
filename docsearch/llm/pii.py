"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated numbers and dates are permuted within their own format by a keyed Feistel network: a payment card becomes another
number that passes the Luhn check, an IPv4 address another address, a date another date of 1800 to 2199 in the same notation.
The permutation depends on the key, the kind and the value alone, so equal values stay linked across documents, and different
values stay different. Letters and digits of an e-mail's local part and of an IBAN are permuted the same way, each within its
alphabet, upper case staying upper case (addresses that differ in case only are linked); domains and country codes stay.
What looks like such data but fails its check (a wrong Luhn or IBAN digit, the 31st of February) stays as it is.

A text is cut twice. First e-mails, IBANs and runs of digits are matched; in a run every valid card between its separators that is
grouped as cards are is found, from the left, the longest first, and of an IBAN's match only what its country's length covers is taken. What is left
between these is cut for dates, IPv4 addresses, social security and phone numbers. Texts without a digit or an @ are not cut.
"""

from __future__ import annotations

import calendar
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.functions.arrays import let
from docsearch.llm.common import text_or_empty

ROUNDS = 10

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LOCAL = r"[\p{L}\p{M}0-9._%+-]"
_ALNUM = r"[\p{L}\p{M}0-9]"
#: Signs that a local part may have between letters or digits; those that part words, cells or fields of an address line are left out.
_MARK = r"['’!#$*^{}~`]"
_LABEL = r"[\p{L}0-9](?:[\p{L}\p{M}0-9-]*[\p{L}\p{M}0-9])?"
#: Stands for what the first cut has replaced; where a text has this character itself, it is put back the same way.
_HOLE = "\ue000"
#: kind: (what must not stand before, the pattern, what must not follow). Earlier kinds win at the same place.
_FIRST: dict[str, tuple[str, str, str]] = {
    "hole": ("", _HOLE, ""),
    "email": (rf"{_LOCAL}|{_ALNUM}{_MARK}", rf"(?:{_LOCAL}|(?<={_ALNUM}){_MARK}(?={_ALNUM}))++@{_LABEL}(?:\.{_LABEL})++", ""),
    "iban": (r"[\p{L}0-9]", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"[\p{L}0-9]"),
    "card": (r"[0-9]|[0-9][ -]", r"[0-9](?:[ -]?[0-9]){12,}+", ""),
}
#: Numbers without a calling code that no list of plain numbers holds: three, three and four digits with single spaces and no other number
#: beside them (but a 1 before them), and numbers with a trunk zero, in one piece or with one or two separators.
_NATIONAL = (
    r"(?<![0-9][ ,]|[\p{L}_])(?:1[ -])?[2-9][0-9]{2} [0-9]{3} [0-9]{4}(?![ ,][0-9]|[0-9\p{L}_]|[.,-][0-9])"
    r"|(?<![0-9][ .,/-]|[.,/\p{L}_-])0[1-9](?:[0-9]{8,9}|[0-9]{1,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,4})(?![ .,/-]?[0-9]|[\p{L}_])"
)
_SECOND: dict[str, tuple[str, str, str]] = {
    "date": (r"[0-9/.-]", r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})", r"[0-9/-]|\.[0-9]"),
    "ipv4": (r"[0-9.]", rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"[0-9]|\.[0-9]"),
    "ssn": (r"[0-9-]", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]|-[0-9]"),
    "phone": (r"[0-9+]", r"(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|" + _NATIONAL + ")", r"[0-9]"),
}
KINDS = ("email", "iban", "card", *_SECOND)


def _any_of(kinds: dict[str, tuple[str, str, str]]) -> str:
    return "|".join((f"(?<!{before})" if before else "") + body + (f"(?!{after})" if after else "") for before, body, after in kinds.values())


#: Characters of an IBAN by country.
IBAN_LENGTH = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27, DK=18, DO=28,
    EE=20, EG=29, ES=24, FI=18, FK=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27,
    JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MN=20, MR=27, MT=31, MU=30, NI=28, NL=18,
    NO=15, OM=23, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SO=23, ST=25, SV=28,
    TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
#: Groups of digits in which cards are written; lists of dates and phone numbers have others.
CARD_GROUPS = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,4}){1,2}|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{4,5})$"
#: Calling codes of one and two digits; all others have three.
CALLING_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Alphabets of lower-case or caseless letters: (first code point, letters, distance of one letter to the next).
ALPHABETS = (
    (0x61, 26, 1), (0x30, 10, 1), (0xDF, 24, 1), (0xF8, 8, 1), (0x101, 28, 2), (0x13A, 8, 2), (0x14B, 23, 2), (0x17A, 3, 2), (0x3B1, 25, 1), (0x3AC, 4, 1), (0x430, 48, 1),
    (0x461, 17, 2), (0x561, 38, 1), (0x5D0, 27, 1), (0x621, 26, 1), (0x641, 10, 1), (0x904, 54, 1), (0xE01, 48, 1), (0x10D0, 43, 1), (0x3041, 86, 1), (0x30A1, 90, 1),
    (0x4E00, 20992, 1), (0xAC00, 11172, 1),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"


def _big(v: Column | int) -> Column:
    return (F.lit(v) if isinstance(v, int) else v).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, tag: Column, key: str) -> Column:
    """A keyed permutation of the pairs (a, b), 0 <= a < size_a, 0 <= b < size_b: rounds add a keyed hash of one half to the
    other half, modulo its size. A struct of a and b."""

    def noise(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + noise(i, s["b"])) % size_a).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + noise(i, s["a"])) % size_b).alias("b"),
        )

    start = F.struct(_big(a).alias("a"), _big(b).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(base: int, n: Column) -> Column:
    return F.round(F.pow(F.lit(float(base)), n.cast("double"))).cast("long")


def _permute_chunk(chars: Column, alphabet: str, tag: Column, key: str) -> Column:
    """A string over ``alphabet``, of a length whose values fit 63 bits, permuted among those of its length."""
    base = len(alphabet)

    def of_length(n: Column) -> Column:
        value = F.aggregate(
            F.sequence(F.lit(1), n), _big(0), lambda v, i: v * base + F.instr(F.lit(alphabet), F.substring(chars, i, F.lit(1))).cast("long") - 1
        )
        low = _power(base, F.ceil(n / 2))
        mixed = let(value, lambda v: feistel(_div(v, low), v % low, _power(base, F.floor(n / 2)), low, F.concat_ws("|", tag, n.cast("string")), key))
        digit = lambda v: F.transform(
            F.sequence(F.lit(1), n), lambda i: F.substring(F.lit(alphabet), (_div(v, _power(base, n - i)) % base + 1).cast("int"), F.lit(1))
        )
        return F.array_join(let(mixed, lambda s: let(s["a"] * low + s["b"], digit)), "")

    return F.when(F.length(chars) == 0, F.lit("")).otherwise(let(F.length(chars), of_length))


def _permute(chars: Column, alphabet: str, step: int, tag: Column, key: str) -> Column:
    """As ``_permute_chunk``, for any length: pieces of ``step`` characters, each with its place in the tag."""
    pieces = F.sequence(F.lit(0), F.greatest(F.length(chars) - 1, F.lit(0)).cast("int"), F.lit(step))
    one = lambda at: let(
        F.substring(chars, at + 1, F.lit(step)), lambda c: _permute_chunk(c, alphabet, F.concat_ws("|", tag, at.cast("string")), key)
    )
    return F.array_join(F.transform(pieces, one), "")


def _refill(shape: Column, chars: Column, wanted: str) -> Column:
    """``shape`` with its characters that match the class ``wanted`` replaced by ``chars`` in order."""

    def at(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        k = F.length(_only(F.substring(shape, F.lit(1), i), wanted))
        return F.when(c.rlike(f"[{wanted}]"), F.substring(chars, k, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")


def _only(v: Column, pattern: str) -> Column:
    return F.regexp_replace(v, f"[^{pattern}]", "")


def _luhn(digits: Column, first_double: int) -> Column:
    """Luhn sum from the right; ``first_double``: 0 if the last digit counts twice, 1 if the one before it."""

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == first_double, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _mod97(chars: Column) -> Column:
    def add(v: Column, i: Column) -> Column:
        c = F.substring(chars, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (v * 10 + F.ascii(c) - 48) % 97).otherwise((v * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(chars)), F.lit(0), add)


# --- the first cut: a match becomes pieces (text, kind, new), kind and new null where nothing is replaced -------------------------

_PIECE = "struct<text:string,kind:string,new:string>"
_SPAN = "struct<i:int,n:int>"


def _piece(text: Column, kind: str | None = None, new: Column | None = None) -> Column:
    return F.struct(text.alias("text"), F.lit(kind).cast("string").alias("kind"), (F.lit(None).cast("string") if new is None else new).alias("new")).cast(_PIECE)


def _card(m: Column, key: str) -> Column:
    """The pseudonym of a valid card number."""

    def of(d: Column) -> Column:
        body = _permute_chunk(F.substring(d, F.lit(2), F.length(d) - 2), _DIGITS, F.lit("card"), key)
        full = let(F.concat(F.substring(d, 1, 1), body), lambda p: F.concat(p, ((10 - _luhn(p, 0) % 10) % 10).cast("string")))
        return let(full, lambda f: _refill(m, f, "0-9"))

    return let(_only(m, "0-9"), of)


def _valid_card(d: Column) -> Column:
    return (F.length(d) >= 13) & (F.length(d) <= 19) & ~d.rlike("^0+$") & (_luhn(d, 1) % 10 == 0)


def _cards(m: Column, key: str) -> Column:
    """The pieces of a run of digits. A part is digits with the separator before them."""
    parts = F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0))

    def of(part: Column) -> Column:
        text = lambda i, n: F.array_join(F.slice(part, i, n), "")

        def longest(i: Column) -> Column:
            """The number of parts from i on that are a card, 0 if there is none."""
            most = F.least(F.size(part) - i + 1, F.lit(19))
            lengths = F.sequence(most, F.lit(1), F.lit(-1))
            alone = (i == 1) & ~m.rlike(_any_of(_SECOND))  # the whole run, if it holds no date or phone number, may be grouped in any way
            usual = lambda n: F.regexp_replace(text(i, n), "^[ -]", "").rlike(CARD_GROUPS) | (alone & (n == F.size(part)))
            good = F.filter(lengths, lambda n: usual(n) & let(_only(text(i, n), "0-9"), _valid_card))
            return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(0))

        def step(s: Column, i: Column) -> Column:
            plain = F.struct(s["free"].alias("free"), s["found"].alias("found"))
            taken = lambda n: F.struct((i + n).alias("free"), F.concat(s["found"], F.array(F.struct(i.alias("i"), n.alias("n")).cast(_SPAN))).alias("found"))
            return F.when(i < s["free"], plain).otherwise(let(longest(i), lambda n: F.when(n > 0, taken(n)).otherwise(plain)))

        start = F.struct(F.lit(1).alias("free"), F.array().cast(f"array<{_SPAN}>").alias("found"))
        found = F.aggregate(F.sequence(F.lit(1), F.size(part)), start, step, lambda s: s["found"])

        def pieces(f: Column) -> Column:
            def one(x: Column, k: Column) -> Column:
                before = F.when(k == 0, F.lit(1)).otherwise(F.element_at(f, F.greatest(k, F.lit(1)))["i"] + F.element_at(f, F.greatest(k, F.lit(1)))["n"])
                card = text(x["i"], x["n"])
                sep = F.regexp_extract(card, "^[ -]?", 0)
                number = F.regexp_replace(card, "^[ -]", "")
                return F.array(_piece(F.concat(text(before, x["i"] - before), sep)), _piece(number, "card", _card(number, key)))

            last = F.element_at(f, -1)
            end = last["i"] + last["n"]
            whole = F.concat(F.flatten(F.transform(f, one)), F.array(_piece(text(end, F.greatest(F.size(part) - end + 1, F.lit(0))))))
            return F.when(F.size(f) == 0, F.array(_piece(m))).otherwise(whole)

        return let(found, pieces)

    return let(parts, of)


def _iban(m: Column, key: str) -> Column:
    """The pieces of an IBAN's match: as many characters as its country has, if they pass the check, and the rest."""
    length = F.expr("map(" + ", ".join(f"'{land}', {n}" for land, n in IBAN_LENGTH.items()) + ")")

    def of(c: Column) -> Column:
        n = F.coalesce(F.element_at(length, F.substring(c, 1, 2)), F.length(c))
        good = lambda k: (F.length(c) >= k) & (_mod97(F.concat(F.substring(c, F.lit(5), k - 4), F.substring(c, 1, 4))) == 1)

        def split(k: Column) -> Column:
            """The k characters that count, with the blanks among them, and what follows."""
            ends = F.filter(F.sequence(F.lit(1), F.length(m)), lambda i: F.length(_only(F.substring(m, F.lit(1), i), "A-Z0-9")) == k)
            return let(F.element_at(ends, 1), lambda e: F.array(
                _piece(F.substring(m, F.lit(1), e), "iban", _new_iban(F.substring(m, F.lit(1), e), key)), _piece(F.substring(m, e + 1, F.length(m)))
            ))

        return let(n, lambda k: F.when(good(k), split(k)).otherwise(F.array(_piece(m))))

    return let(_only(m, "A-Z0-9"), of)


def _new_iban(m: Column, key: str) -> Column:
    def of(c: Column) -> Column:
        land, body = F.substring(c, 1, 2), F.substring(c, F.lit(5), F.length(c))
        digits = _permute(_only(body, "0-9"), _DIGITS, 16, F.lit("iban"), key)
        letters = _permute(_only(body, "A-Z"), _UPPER, 12, F.lit("iban"), key)
        # the letters go in first, as marks of their places: a letter of one alphabet never meets the other
        new = let(digits, lambda d: let(letters, lambda x: _refill(_refill(body, d, "0-9"), x, "A-Z")))
        check = lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b)
        return let(new, lambda b: let(check(b), lambda f: _refill(m, f, "A-Z0-9")))

    return let(_only(m, "A-Z0-9"), of)


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _alphabet(c: Column) -> Column:
    """Of a lower-case character (lo, n, step, at): its alphabet and its place there; letters of no alphabet in ALPHABETS have the
    128 code points around them; what is no letter or digit has an alphabet of its own (n = 1)."""

    def of(code: Column) -> Column:
        entry = lambda lo, n, by: F.struct(lo.cast("long").alias("lo"), n.cast("long").alias("n"), by.cast("long").alias("by"))
        other = F.when(c.rlike(r"\p{L}"), entry(code - code % 128, F.lit(128), F.lit(1))).otherwise(entry(code, F.lit(1), F.lit(1)))
        table = F.expr("array(" + ", ".join(f"named_struct('lo', {lo}L, 'n', {n}L, 'by', {by}L)" for lo, n, by in ALPHABETS) + ")")
        holds = F.filter(table, lambda a: (code >= a["lo"]) & (code < a["lo"] + a["n"] * a["by"]) & ((code - a["lo"]) % a["by"] == 0))
        return let(F.coalesce(F.try_element_at(holds, F.lit(1)), other), lambda a: F.struct(a["lo"].alias("lo"), a["n"].alias("n"), a["by"].alias("by"), _div(code - a["lo"], a["by"]).alias("at")))

    return let(F.ascii(c).cast("long"), of)


def _email(m: Column, key: str) -> Column:
    """The local part as numbers of mixed radix, eight characters at once, permuted within their alphabets."""

    def eight(chars: Column, at: Column) -> Column:
        def of(a: Column) -> Column:
            half = F.ceil(F.size(a) / 2).cast("int")
            left, right = F.slice(a, F.lit(1), half), F.slice(a, half + 1, F.size(a) - half)
            value = lambda x: F.aggregate(x, _big(0), lambda v, c: v * c["n"] + c["at"])
            size = lambda x: F.aggregate(x, _big(1), lambda v, c: v * c["n"])
            shape = F.array_join(F.transform(a, lambda c: c["lo"].cast("string")), ".")

            def back(x: Column, v: Column) -> Column:
                digit = lambda c, k: _div(v, size(F.slice(x, k + 2, F.size(x)))) % c["n"]
                return F.transform(x, lambda c, k: _character(c["lo"] + c["by"] * digit(c, k)))

            mixed = feistel(value(left), value(right), size(left), size(right), F.concat_ws("|", F.lit("email"), at.cast("string"), shape), key)
            return let(mixed, lambda s: F.array_join(F.concat(back(left, s["a"]), back(right, s["b"])), ""))

        return let(F.transform(F.sequence(F.lit(1), F.length(chars)), lambda i: _alphabet(F.substring(chars, i, F.lit(1)))), of)

    def of(local: Column) -> Column:
        low = F.lower(local)
        plain = F.when(F.length(low) == F.length(local), low).otherwise(local)  # a letter whose lower case is two characters
        parts = F.transform(F.sequence(F.lit(0), F.length(local) - 1, F.lit(8)), lambda k: eight(F.substring(plain, k + 1, F.lit(8)), k))

        def cased(new: Column) -> Column:
            def one(i: Column) -> Column:
                old, c = F.substring(local, i, F.lit(1)), F.substring(new, i, F.lit(1))
                return F.when((old != F.lower(old)) & (F.length(F.upper(c)) == 1), F.upper(c)).otherwise(c)

            return F.when(local == low, new).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), one), ""))

        return let(F.array_join(parts, ""), cased)

    new = F.concat(let(F.substring_index(m, "@", 1), of), F.lit("@"), F.substring_index(m, "@", -1))
    return F.array(_piece(m, "email", new))


# --- the second cut: a match becomes its pseudonym, or null ------------------------------------------------------------------------


def _phone(m: Column, key: str) -> Column:
    """A calling code after +, or a trunk zero, stays; the digits behind it are permuted among those of their number."""

    def of(d: Column) -> Column:
        trunk = F.when(d.startswith("0"), 1).otherwise(F.greatest(F.length(d) - 10, F.lit(0)))
        head = F.when(m.startswith("+"), F.length(F.regexp_extract(d, CALLING_CODE, 0))).otherwise(trunk)
        tail = lambda h: _permute_chunk(F.substring(d, h + 1, F.length(d)), _DIGITS, F.lit("phone"), key)
        return let(head, lambda h: let(F.concat(F.substring(d, F.lit(1), h), tail(h)), lambda f: _refill(m, f, "0-9")))

    return let(_only(m, "0-9"), of)


def _ipv4(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        half = lambda i: o[i].cast("long") * 256 + o[i + 1].cast("long")
        mixed = feistel(half(0), half(2), _big(65536), _big(65536), F.lit("ipv4"), key)
        return let(mixed, lambda s: F.concat_ws(".", *(f.cast("string") for h in (s["a"], s["b"]) for f in (_div(h, _big(256)), h % 256))))

    return let(F.split(m, r"\."), of)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    mixed = feistel(place, (group - 1) * 9999 + serial - 1, _big(898), _big(99 * 9999), F.lit("ssn"), key)
    text = lambda s: F.concat_ws(
        "-",
        F.lpad((s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad((_div(s["b"], _big(9999)) + 1).cast("string"), 2, "0"),
        F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0"),
    )
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), let(mixed, text))


#: Month and day of the dates whose day is over 12, the 29th of February left out, and the leap years: five characters each.
_LATE = "".join(f"{m:02}/{d:02}" for m in range(1, 13) for d in range(13, calendar.monthrange(1801, m)[1] + 1))
_LEAP = "".join(f"{y} " for y in range(1800, 2200) if calendar.isleap(y))


def _date(m: Column, key: str) -> Column:
    """As ``_padded_date``; days and months of one digit count as with a zero before them, and the pseudonym has no such zeros either."""
    digit = r"(?<![0-9])([0-9])(?=[/.])"
    return F.when(F.length(m) == 10, _padded_date(m, key)).otherwise(F.regexp_replace(let(F.regexp_replace(m, digit, "0$1"), lambda p: _padded_date(p, key)), r"(?<![0-9])0(?=[0-9][/.])", ""))


def _padded_date(m: Column, key: str) -> Column:
    """Dates of the 400 years from 1800 on. With / the day comes first; where only the month can, the date becomes another one that
    can be read in no other way, so no two dates have one pseudonym."""
    first = F.lit("1800-01-01").cast("date")

    def moved(fmt: str) -> Callable[[Column], Column]:
        def of(day: Column) -> Column:
            v = F.datediff(day, first).cast("long")
            mixed = feistel(_div(v, _big(773)), v % 773, _big(189), _big(773), F.lit("date"), key)
            new = let(mixed, lambda s: F.date_format(F.date_add(first, (s["a"] * 773 + s["b"]).cast("int")), fmt))
            return F.when((v >= 0) & (v < 146097), new)

        return of

    late, leap = len(_LATE) // 5, len(_LEAP) // 5
    n = 400 * late + leap  # 9 * 9833

    def month_first(year: Column) -> Column:
        slot = F.floor((F.instr(F.lit(_LATE), F.substring(m, 1, 5)) - 1) / 5)
        place = F.floor((F.instr(F.lit(_LEAP), year.cast("string")) - 1) / 5)
        value = F.when(m.startswith("02/29"), F.lit(400 * late) + place).otherwise((year - 1800) * late + slot).cast("long")

        def text(v: Column) -> Column:
            usual = F.concat(F.substring(F.lit(_LATE), (v % late * 5 + 1).cast("int"), F.lit(5)), F.lit("/"), (_div(v, _big(late)) + 1800).cast("string"))
            extra = F.concat(F.lit("02/29/"), F.substring(F.lit(_LEAP), ((v - 400 * late) * 5 + 1).cast("int"), F.lit(4)))
            return F.when(v < 400 * late, usual).otherwise(extra)

        mixed = let(value, lambda v: feistel(_div(v, _big(9833)), v % 9833, _big(n // 9833), _big(9833), F.lit("date, month first"), key))
        return F.when((year >= 1800) & (year < 2200), let(mixed, lambda s: let(s["a"] * 9833 + s["b"], text)))

    out = F.lit(None).cast("string")
    for fmt, shape in (("dd.MM.yyyy", r"^[0-9]{2}\."), ("MM/dd/yyyy", r"^[0-9]{2}/"), ("dd/MM/yyyy", r"^[0-9]{2}/"), ("yyyy-MM-dd", r"^[0-9]{4}-")):
        day = F.try_to_timestamp(m, F.lit(fmt)).cast("date")
        new = let(F.substring(m, 7, 4).cast("int"), month_first) if fmt == "MM/dd/yyyy" else let(day, moved(fmt))
        out = F.when(m.rlike(shape) & day.isNotNull(), new).otherwise(out)
    return out


_PIECES = {"email": _email, "iban": _iban, "card": _cards, "hole": lambda m, key: F.array(_piece(m, None, m))}
_MAKE = {"date": _date, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone}


def _first_cut(text: Column, key: str) -> Column:
    """``text`` as pieces."""

    def of(m: Column) -> Column:
        out = F.array(_piece(m))
        for k in reversed(_FIRST):
            out = F.when(m.rlike(f"^(?:{_FIRST[k][1]})$"), _PIECES[k](m, key)).otherwise(out)
        return out

    pattern = _any_of(_FIRST)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.array(_piece(g)))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)
    return F.flatten(F.flatten(F.zip_with(gaps, hits, lambda g, h: F.array(g, F.coalesce(h, F.array().cast(f"array<{_PIECE}>"))))))


def _second_cut(text: Column, key: str) -> Column:
    """``text`` as pieces."""

    def of(m: Column) -> Column:
        kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
        for k in reversed(_SECOND):
            hit = m.rlike(f"^(?:{_SECOND[k][1]})$")
            kind = F.when(hit, F.lit(k)).otherwise(kind)
            new = F.when(hit, _MAKE[k](m, key)).otherwise(new)
        return F.struct(m.alias("text"), kind.alias("kind"), new.alias("new")).cast(_PIECE)

    pattern = _any_of(_SECOND)
    gaps = F.split(text, pattern, -1)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)
    return F.flatten(F.zip_with(gaps, hits, lambda g, h: F.when(h.isNull(), F.array(_piece(g))).otherwise(F.array(_piece(g), h))))


@lru_cache(maxsize=8)
def _steps(application: str, key: str) -> tuple[Column, Column]:
    """The two cuts as columns over _text and over _left; built once in an application, which takes some thousand calls to the JVM."""
    first = F.when(F.col("_text").rlike("[0-9@]"), _first_cut(F.col("_text"), key))
    second = F.transform("_left", lambda t: F.when(t.rlike("[0-9]"), _second_cut(t, key)).otherwise(F.array(_piece(t))))
    return first, second


def pseudonyms(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` (null counts as empty) pseudonymised, and two more columns, which replace any of that name:
    pii_kinds (array of the kind of each replaced value, in order) and pii_values (array of the pseudonyms).
    One pass without a shuffle; rows keep their other columns; repeated rows have equal results; an empty table gives an empty one; a
    very long text is one row, cut in linear time."""
    text = F.col("_text")
    none = F.array().cast(f"array<{_PIECE}>")
    first, second = _steps(docs.sparkSession.sparkContext.applicationId, key)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text_or_empty(f"`{column}`").alias("_text"))
    packed = packed.withColumn("_first", first)
    holes = F.filter("_first", lambda x: x["new"].isNotNull())
    left = F.array_join(F.transform("_first", lambda x: F.when(x["new"].isNotNull(), F.lit(_HOLE)).otherwise(x["text"])), "")
    packed = packed.select("_row", "_text", holes.alias("_holes"), F.split(left, _HOLE, -1).alias("_left"))
    both = F.zip_with(second, "_holes", lambda b, h: F.when(h.isNull(), b).otherwise(F.concat(b, F.array(h))))
    packed = packed.select("_row", "_text", F.flatten(both).alias("_pieces"))
    good = F.filter(F.coalesce(F.col("_pieces"), none), lambda x: x["kind"].isNotNull() & x["new"].isNotNull())
    filled = F.array_join(F.transform("_pieces", lambda x: F.coalesce(x["new"], x["text"])), "")
    made = {
        column: F.when(F.col("_pieces").isNotNull(), filled).otherwise(text),
        "pii_kinds": F.transform(good, lambda x: x["kind"]),
        "pii_values": F.transform(good, lambda x: x["new"]),
    }
    old = {c: F.col("_row").getField(c) for c in docs.columns}
    return packed.select(*(value.alias(name) for name, value in (old | made).items()))


def mask(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (columns of documents, and any others, which stay) with pseudonyms in text and the matching n_chars."""
    hidden = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    out = pseudonyms(hidden, key)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
