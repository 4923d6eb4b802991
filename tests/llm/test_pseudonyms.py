"""Feistel pseudonyms against a plain Python version of the permutations, format by format."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from sextant.llm import pseudonyms

KEY = "k1"
HALVES = pseudonyms.ROUNDS


def keyed(key, tweak, i, value):
    return int(hashlib.sha256(f"{key}\x1f{tweak}\x1f{i}\x1f{value}".encode()).hexdigest()[:15], 16)


def spelled(n, radix, width):
    out = ""
    for _ in range(width):
        n, d = divmod(n, radix)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def permuted(s, radix, key, tweak):
    u = len(s) // 2
    a, b = s[:u], s[u:]
    for i in range(HALVES):
        width = u if i % 2 == 0 else len(s) - u
        moved = ((int(a, radix) if a else 0) + keyed(key, tweak, i, f"{tweak}/{radix}/{len(s)}/{b}")) % radix**width
        a, b = b, spelled(moved, radix, width) if width else ""
    return a + b


def chunks(s, radix, tweak):
    return "".join(permuted(s[k : k + 20], radix, f"{KEY}\x1f{k // 20}", tweak) for k in range(0, len(s), 20))


def pair(a, b, n, m, tweak):
    for i in range(HALVES // 2):
        a = (a + keyed(KEY, tweak, 2 * i, b)) % n
        b = (b + keyed(KEY, tweak, 2 * i + 1, a)) % m
    return a, b


def refilled(shape, digits="", letters=""):
    digits, letters = iter(digits), iter(letters)
    return "".join(next(digits) if c.isdigit() else (next(letters).upper() if c.isupper() else next(letters)) if c.isalpha() else c for c in shape)


def both(shape, tweak):
    low = re.sub("[^a-z]", "", shape.lower())
    turned = chunks("".join(spelled(ord(c) - 97, 26, 1) for c in low), 26, tweak)
    return refilled(shape, chunks(re.sub("[^0-9]", "", shape), 10, tweak), "".join(chr(97 + int(c, 26)) for c in turned))


def luhn_digit(body):
    total = sum(x if k % 2 else 2 * x - 9 * (x > 4) for k, x in enumerate(int(c) for c in reversed(body)))
    return str(-total % 10)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def card(m):
    body = permuted(re.sub("[^0-9]", "", m)[:-1], 10, KEY, "card")
    return refilled(m, body + luhn_digit(body))


def phone(m):
    code = re.match(r"(\+\d{1,3}[ -])?", m)[0]
    return code + refilled(m[len(code) :], permuted(re.sub("[^0-9]", "", m[len(code) :]), 10, KEY, "phone"))


def international(m):
    code = re.match(r"\+\d{1,3}", m)[0]
    return code + refilled(m[len(code) :], chunks(re.sub("[^0-9]", "", m[len(code) :]), 10, "international"))


def ipv4(m):
    o = [int(x) for x in m.split(".")]
    a, b = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16, "ipv4")
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def ssn(m):
    areas = [x for x in range(1, 900) if x != 666]
    area, group, serial = map(int, m.split("-"))
    a, b = pair(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    return f"{areas[a // 99]:03}-{a % 99 + 1:02}-{b + 1:04}"


def iban(m):
    account = both(m[4:], "iban")
    return m[:2] + f"{98 - mod97(account.replace(' ', '') + m[:2] + '00'):02}" + account


def ipv6(m):
    hexes = iter(chunks(m.lower().replace(":", ""), 16, "ipv6"))
    return "".join(c if c == ":" else next(hexes) for c in m)


def email(m):
    local, domain = m.split("@")
    return both(local, "mail") + "@" + domain


def _samples():
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for _ in range(25):
        body = "4" + number(14)
        yield body + luhn_digit(body), card
        yield f"({number(3)}) {number(3)}-{number(4)}", phone
        yield f"+44 20 {number(4)} {number(4)}", international
        yield ".".join(str(rng.randrange(256)) for _ in range(4)), ipv4
        yield f"{rng.choice([x for x in range(1, 900) if x != 666]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}", ssn
        account = rng.choice(["WEST", "NWBK", ""]) + number(14)
        yield f"GB{98 - mod97(account + 'GB00'):02}{account}", iban
        yield ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)), ipv6
        yield "2001:db8::" + f"{rng.randrange(1 << 16):x}", ipv6
        yield rng.choice(["Ann.Lee", "bob_", "X", "very-long-" * 4]) + number(rng.randrange(4)) + "@Mail.example.com", email
    yield "GB82 WEST 1234 5698 7654 32", iban
    yield "666-12-1234", lambda m: m
    yield "GB83 WEST 1234 5698 7654 32", lambda m: m
    yield "12:30:45", lambda m: m
    yield "std::vector", lambda m: m


def test_every_format_equals_plain_feistel(spark):
    samples = list(_samples())
    df = spark.createDataFrame([(i, f"x {m} y") for i, (m, _) in enumerate(samples)], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(df, KEY).collect()}
    for i, (m, expected) in enumerate(samples):
        assert got[i].text == f"x {expected(m)} y", m
        assert got[i].n_pseudonyms == (expected(m) != m)


def test_case_is_kept_and_values_stay_apart(spark):
    df = spark.createDataFrame([(0, "Ann.Lee7@x.com"), (1, "ann.lee7@x.com"), (2, "ANN.lee7@x.com")], "doc_id long, text string")
    got = [r.text for r in pseudonyms.pseudonymise(df, KEY).orderBy("doc_id").collect()]
    assert len(set(got)) == 3 and len({x.lower() for x in got}) == 1 and [c.isupper() for c in got[0][:8]] == [c.isupper() for c in "Ann.Lee7"]


def test_the_plan_does_not_spell_the_key(spark):
    df = spark.createDataFrame([(0, "a b@x.com"), (0, "a b@x.com"), (1, None)], "doc_id long, text string").withColumn("N_Pseudonyms", F.lit("mine"))
    out = pseudonyms.pseudonymise(df, "very-hidden-key")
    rows = out.collect()
    assert "very-hidden-key" not in out._jdf.queryExecution().toString()
    assert len(rows) == 3 and rows[0].text == rows[1].text != "a b@x.com" and rows[2].text is None
