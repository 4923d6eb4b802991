"""Format-preserving pseudonyms by a keyed Feistel permutation, in DataFrame functions only.

Personal numbers are found by one pattern, validated, and permuted within their own format: payment cards (13 to 19
digits, Luhn; the result passes Luhn too), US phone numbers and numbers with a country code (code kept), IBANs (mod 97; so
does the result, country and places of letters kept), US social security numbers (only assignable ones, before and
after), IPv4 addresses (octets of at most 255), IPv6 addresses (their hexadecimal digits), dates of 1800 to 2199
(yyyy-MM-dd, yyyy/MM/dd, dd.MM.yyyy; the result is a date in the same format), and the letters and the digits of an e-mail
address's local part, whose case stays where it is. Cards are looked for in whole runs of numbers between single spaces or
dashes, at any of these as borders, so that a card beside a short number is found. What fails validation stays as it is.
The map is one-to-one for each format and depends on the key alone, so equal values stay equal in every document. A part of
one letter or digit has so few values that its permutation is a shift by a keyed number.

The key reaches the expressions as a column, a scalar subquery of a one-row table, so no plan or event log spells it. Every
match costs a few hashes; the rest of a text is copied. No shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.spark_names import Renamed

ROUNDS = 8
#: The 146,097 days of the Gregorian cycle of 400 years are 189 times 773.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1800-01-01", 189, 773

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
PHONE = r"(?<![\w.-])(?:\+\d{1,3}[ -])?(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?![\w-])"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4})(?!\w|[./-]\d)"
INTERNATIONAL = r"(?<![\w.+-])\+\d{1,3}(?:[ -]\(?\d{1,5}\)?){2,5}(?![\w-])"
SSN = r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}|(?=[0-9A-Fa-f:]{2,39}(?![\w:.]))(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}::?){2,6})[0-9A-Fa-f]{1,4}(?![\w:.])"
#: A run of numbers of 13 digits or more in all; the dash at its end is kept if the next number is no part of the run.
CARD = r"(?<![\w.-])(?=\d(?:[ -]?\d){12})\d++(?!\w|\.\d)(?:[ -](?!" + "|".join([EMAIL, PHONE, IPV4, DATE, SSN]) + r")\d++(?!\w|\.\d))*+(?:-(?=\d))?+"
#: Lengths of the numbers that a card is printed in.
PRINTED = "^(?:1[3-9]|4-4-4-4|4-6-5|4-6-4|4-4-4-4-3)$"
ANY = "|".join([EMAIL, PHONE, INTERNATIONAL, IPV4, IPV6, DATE, SSN, IBAN, CARD])


def _keyed(key: Column, tweak: str, i: Column, value: Column) -> Column:
    """A pseudo-random number below 2^60 of the round and the other half."""
    text = F.concat(key, F.lit(f"\x1f{tweak}\x1f"), i.cast("string"), F.lit("\x1f"), value)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permute_string(s: Column, radix: int, key: Column, tweak: str) -> Column:
    """A permutation of the strings of s's length over the first ``radix`` of 0-9a-z, at most 24 long.

    Two halves in turn add a keyed function of the other, modulo the powers of the radix.
    """
    u = F.floor(F.length(s) / 2).cast("int")
    v = F.length(s) - u
    label = F.concat(F.lit(f"{tweak}/{radix}/"), F.length(s).cast("string"), F.lit("/"))

    def number(x: Column) -> Column:
        return F.when(x == "", F.lit(0).cast("long")).otherwise(F.conv(x, radix, 10).cast("long"))

    def spell(n: Column, width: Column) -> Column:
        return F.when(width == 0, "").otherwise(F.lpad(F.lower(F.conv(n.cast("string"), 10, radix)), width, "0"))

    def turn(state: Column, i: Column) -> Column:
        width = F.when(i % 2 == 0, u).otherwise(v)
        size = F.pow(F.lit(float(radix)), width).cast("decimal(38,0)")
        moved = F.pmod(number(state["a"]).cast("decimal(38,0)") + _keyed(key, tweak, i, F.concat(label, state["b"])).cast("decimal(38,0)"), size)
        return F.struct(state["b"].alias("a"), spell(moved, width).alias("b"))

    start = F.struct(F.substr(s, F.lit(1), u).alias("a"), F.substr(s, u + 1, v).alias("b"))
    # the last round but none: after an even number of rounds the halves are back at their lengths
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda r: F.concat(r["a"], r["b"]))


def _permute_pair(high: Column, low: Column, n_high: int, n_low: int, key: Column, tweak: str) -> Column:
    """A permutation of [0, n_high) x [0, n_low) as struct<a, b>: each part in turn adds a keyed function of the other."""

    def turn(state: Column, i: Column) -> Column:
        a = F.pmod(state["a"] + _keyed(key, tweak, i * 2, state["b"].cast("string")), F.lit(n_high))
        b = F.pmod(state["b"] + _keyed(key, tweak, i * 2 + 1, a.cast("string")), F.lit(n_low))
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), F.struct(high.cast("long").alias("a"), low.cast("long").alias("b")), turn)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; from the right, digits at even places (from 0) are doubled if ``doubled`` is 0, else those at odd."""
    chars = F.split(F.reverse(digits), "")
    worth = F.transform(chars, lambda c, i: F.when(i % 2 == doubled, F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") >= 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def _refill(shape: Column, digits: Column, letters: Column | None = None) -> Column:
    """``shape`` with its digits replaced by ``digits``, in order, and its letters by lower-case ``letters``, case kept."""
    letters = F.lit("") if letters is None else letters

    def step(s: Column, c: Column) -> Column:
        digit = F.substr(digits, s["at"], F.lit(1))
        letter = F.substr(letters, s["next"], F.lit(1))
        made = F.when(c.between("0", "9"), digit).when(letters == "", c).when(c.between("a", "z"), letter).when(c.between("A", "Z"), F.upper(letter)).otherwise(c)
        is_letter = c.between("a", "z") | c.between("A", "Z")
        return F.struct(F.concat(s["out"], made).alias("out"), (s["at"] + c.between("0", "9").cast("int")).alias("at"), (s["next"] + is_letter.cast("int")).alias("next"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), F.lit(1).alias("next"))
    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _in_chunks(x: Column, radix: int, key: Column, tweak: str) -> Column:
    """A permutation of strings of any length: stretches of 20 by themselves, with a tweak of their place."""
    parts = F.regexp_extract_all(x, F.lit("(?s).{1,20}"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p, i: permute_string(p, radix, F.concat(key, F.lit("\x1f"), i.cast("string")), tweak)), "")


_ALPHABET, _AS_DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _letters_and_digits(m: Column, key: Column, tweak: str) -> Column:
    """``m`` with its letters permuted among letters and its digits among digits."""
    spelled = F.translate(F.regexp_replace(F.lower(m), "[^a-z]", ""), _ALPHABET, _AS_DIGITS)
    letters = F.translate(_in_chunks(spelled, 26, key, tweak), _AS_DIGITS, _ALPHABET)
    return _let(F.struct(letters.alias("l"), _in_chunks(_digits(m), 10, key, tweak).alias("d")), lambda p: _refill(m, p["d"], p["l"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(items: Column, i: Column, n: Column) -> Column:
    """``n`` items from place ``i``; slice() copies the whole array for it."""
    return F.transform(F.sequence(i, i + n - 1), lambda j: F.get(items, j))


def _card(m: Column, key: Column) -> Column:
    def refilled(body: Column) -> Column:
        return _refill(m, F.concat(body, F.pmod(-_luhn_sum(body, 0), F.lit(10)).cast("string")))

    digits = _digits(m)
    return _let(F.substr(digits, F.lit(1), F.length(digits) - 1), lambda d: _let(permute_string(d, 10, key, "card"), refilled))


def _cards(m: Column, key: Column) -> Column:
    """struct<now, n> of a run of numbers: from left to right, the longest sub-run that is a card, one that overlaps a
    card in its printed groups only if it is one itself."""

    def places(tokens: Column) -> Column:
        n = F.size(tokens)
        shut = F.when(m.endswith("-"), n).otherwise(-1)

        def valid(i: Column, w: Column) -> Column:
            return (i + w != shut) & _let(F.array_join(_part(tokens, i, w), ""), lambda d: F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0))

        def printed(i: Column, w: Column) -> Column:
            return F.array_join(F.transform(_part(tokens, i, w), lambda t: F.length(t).cast("string")), "-").rlike(PRINTED)

        def chosen(widths: Column, best: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                free = F.filter(F.get(widths, i), lambda w: F.forall(_part(best, i, w), lambda x: x == 0))
                width = F.when(i < s["next"], 0).when(F.get(best, i) > 0, F.get(best, i)).otherwise(F.coalesce(F.array_max(free), F.lit(0)))
                return _let(
                    width,
                    lambda w: F.struct(
                        (s["at"] + F.length(F.get(tokens, i)) + 1).alias("at"),
                        F.when(w > 0, i + w).otherwise(s["next"]).alias("next"),
                        F.when(w > 0, F.array_append(s["picks"], F.struct(s["at"].alias("at"), F.length(F.array_join(_part(tokens, i, w), " ")).alias("len")))).otherwise(s["picks"]).alias("picks"),
                    ),
                )

            start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("next"), F.array().cast("array<struct<at:int,len:int>>").alias("picks"))
            return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["picks"])

        every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), lambda w: valid(i, w)))
        return _let(every, lambda widths: _let(F.transform(widths, lambda ws, i: F.coalesce(F.array_max(F.filter(ws, lambda w: printed(i, w))), F.lit(0))), lambda best: chosen(widths, best)))

    def replaced(s: Column, p: Column) -> Column:
        before = F.substr(m, s["next"], p["at"] - s["next"])
        return _let(F.substr(m, p["at"], p["len"]), lambda was: _let(_card(was, key), lambda now: F.struct(F.concat(s["now"], before, now).alias("now"), (s["n"] + (now != was).cast("int")).alias("n"), (p["at"] + p["len"]).alias("next"))))

    picks = _let(F.split(F.regexp_replace(m, "-$", ""), "[ -]"), places)
    start = F.struct(F.lit("").alias("now"), F.lit(0).alias("n"), F.lit(1).alias("next"))
    return F.aggregate(picks, start, replaced, lambda s: F.struct(F.concat(s["now"], F.substr(m, s["next"], F.length(m))).alias("now"), s["n"].alias("n")))


def _phone(m: Column, key: Column) -> Column:
    code = F.regexp_extract(m, r"^(\+\d{1,3}[ -])?", 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _refill(rest, permute_string(_digits(rest), 10, key, "phone")))


def _ipv4(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    moved = _permute_pair(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 1 << 16, 1 << 16, key, "ipv4")
    out = F.transform(F.array(moved), lambda p: F.concat_ws(".", F.shiftright(p["a"], 8).cast("string"), (p["a"] % 256).cast("string"), F.shiftright(p["b"], 8).cast("string"), (p["b"] % 256).cast("string")))
    return F.when(F.forall(octets, lambda x: x <= 255), out[0]).otherwise(m)


def _date(m: Column, key: Column) -> Column:
    def of(fmt: str) -> Column:
        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(fmt))), F.lit(FIRST_DAY).cast("date"))
        moved = _permute_pair(F.floor(day / DAYS_LOW), F.pmod(day, F.lit(DAYS_LOW)), DAYS_HIGH, DAYS_LOW, key, "date")
        out = F.transform(F.array(moved), lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS_LOW + p["b"]).cast("int")), fmt))
        return F.when(day.between(0, DAYS_HIGH * DAYS_LOW - 1), out[0]).otherwise(m)

    return F.when(m.contains("."), of("dd.MM.yyyy")).when(m.contains("/"), of("yyyy/MM/dd")).otherwise(of("yyyy-MM-dd"))


def _email(m: Column, key: Column) -> Column:
    return F.concat(_letters_and_digits(F.substring_index(m, "@", 1), key, "mail"), F.lit("@"), F.substring_index(m, "@", -1))


def _international(m: Column, key: Column) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    valid = F.length(_digits(m)).between(8, 15)
    return F.when(valid, F.concat(code, _refill(rest, _in_chunks(_digits(rest), 10, key, "international")))).otherwise(m)


def _ssn(m: Column, key: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99 and serials 0001 to 9999, as 898 * 99 times 9,999."""
    parts = F.transform(F.split(m, "-"), lambda x: x.cast("long"))
    area = parts[0] - F.when(parts[0] > 666, 2).otherwise(1)
    moved = _permute_pair(area * 99 + parts[1] - 1, parts[2] - 1, 898 * 99, 9999, key, "ssn")

    def spell(p: Column) -> Column:
        of_area = F.floor(p["a"] / 99)
        shown = of_area + F.when(of_area >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(shown.cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    return _let(moved, spell)


def _mod97(x: Column) -> Column:
    """The remainder by 97 of digits and capital letters, a letter standing for 10 to 35."""
    places = F.transform(F.split(x, ""), lambda c: (F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1))
    return F.aggregate(places, F.lit(0), lambda r, v: F.pmod(r * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _iban(m: Column, key: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(F.substr(plain, F.lit(5), F.lit(34)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)

    def made(account: Column) -> Column:
        check = 98 - _mod97(F.concat(F.regexp_replace(account, " ", ""), F.substr(m, F.lit(1), F.lit(2)), F.lit("00")))
        return F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), account)

    return F.when(valid, _let(_letters_and_digits(F.substr(m, F.lit(5), F.length(m)), key, "iban"), made)).otherwise(m)


def _ipv6(m: Column, key: Column) -> Column:
    """Its hexadecimal digits as one number, back in their places; the result is in lower case."""
    hexes = _in_chunks(F.regexp_replace(F.lower(m), ":", ""), 16, key, "ipv6")

    def step(s: Column, c: Column) -> Column:
        return F.struct(F.concat(s["out"], F.when(c == ":", c).otherwise(F.substr(s["left"], F.lit(1), F.lit(1)))).alias("out"), F.when(c == ":", s["left"]).otherwise(F.substr(s["left"], F.lit(2), F.length(m))).alias("left"))

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), hexes.alias("left")), step, lambda s: s["out"])


KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, str], Column]]] = {
    "email": (lambda m: m.contains("@"), _email),
    "ssn": (lambda m: m.rlike(f"^(?:{SSN})$"), _ssn),
    "iban": (lambda m: m.rlike(f"^(?:{IBAN})$"), _iban),
    "ipv6": (lambda m: m.rlike(f"^(?:{IPV6})$"), _ipv6),
    "phone": (lambda m: m.rlike(f"^(?:{PHONE})$"), _phone),
    "international": (lambda m: m.startswith("+"), _international),
    "ipv4": (lambda m: m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _ipv4),
    "date": (lambda m: m.rlike(f"^(?:{DATE})$"), _date),
}


def pseudonym(match: Column, key: Column) -> Column:
    """struct<now, n>: a match with its numbers replaced, and in a run of numbers how many were."""
    out = None
    for test, made in KINDS.values():
        one = F.struct(made(match, key).alias("now"), F.lit(None).cast("int").alias("n"))
        out = F.when(test(match), one) if out is None else out.when(test(match), one)
    return out.otherwise(_cards(match, key))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count_name: str = "n_pseudonyms") -> DataFrame:
    """``docs`` with the personal numbers of ``text`` replaced, and how many were after its columns.

    A null text stays null (0 replaced), as does an empty one. A column named as the count is replaced; others pass
    through. Rows do not meet: repeated rows give repeated results, an empty table none.
    """
    own = Renamed(docs, (count_name,))
    t = own[text]
    keys = docs.sparkSession.createDataFrame([(key,)], "key string")
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    a = own.df.withColumn("found", found).withColumn("key", F.when(F.size("found") > 0, keys.scalar()))
    b = a.select("*", F.transform("found", lambda m: F.struct(m.alias("was"), pseudonym(m, F.col("key")).alias("made"))).alias("made"), F.when(F.size("found") > 0, F.split(t, ANY, -1)).alias("rest"))
    joined = F.array_join(F.zip_with("rest", "made", lambda r, m: F.concat(r, F.coalesce(m["made"]["now"], F.lit("")))), "")
    changed = F.aggregate("made", F.lit(0), lambda n, m: n + F.coalesce(m["made"]["n"], (m["was"] != m["made"]["now"]).cast("int")))
    return b.select(*own.back(**{text: F.when(F.size("found") > 0, joined).otherwise(t)}), F.greatest(F.coalesce(changed, F.lit(0)), F.lit(0)).cast("long").alias(count_name))
