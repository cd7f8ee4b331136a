"""The whole operator against a plain Python version of it, over texts in which it is known where values stand."""

import random
from datetime import date, timedelta
from hashlib import sha256

import pytest

from tests.llm.test_topk_licenses_pii import replaced

KEY = "another key"


def permuted(values, radices, kind):
    half = len(values) // 2
    a, ra, b, rb = values[:half], radices[:half], values[half:], radices[half:]
    for i in range(1, 11):
        other = ",".join(map(str, b))
        other = sha256(other.encode()).hexdigest() if len(other) > 1024 else other
        moved = [(x + int(sha256(f"{KEY}|{kind}|{i}|{k}|{other}".encode()).hexdigest()[:12], 16)) % r for k, (x, r) in enumerate(zip(a, ra))]
        a, ra, b, rb = b, rb, moved, ra
    return a + b


def new_symbols(symbols, kind):
    base = [48 if c.isdigit() else 97 if c.islower() else 65 for c in symbols]
    moved = permuted([ord(c) - b for c, b in zip(symbols, base)], [10 if b == 48 else 26 for b in base], kind)
    return [chr(b + v) for b, v in zip(base, moved)]


def refilled(value, symbols):
    left = iter(symbols)
    return "".join(next(left) if c.isascii() and c.isalnum() else c for c in value)


def symbols_of(value):
    return [c for c in value if c.isascii() and c.isalnum()]


def general(value, kind):
    return refilled(value, new_symbols(symbols_of(value), kind))


def luhn_digit(body):
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(body)))
    return str(-total % 10)


def card(value):
    body = new_symbols(symbols_of(value)[:-1], "card")
    return refilled(value, [*body, luhn_digit(body)])


def remainder(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(value):
    symbols = symbols_of(value)
    account = "".join(new_symbols(symbols[4:], "iban"))
    country = "".join(symbols[:2])
    return refilled(value, country + f"{98 - remainder(account + country + '00'):02d}" + account)


def day(value, shape):
    order = {"-": (0, 1, 2), "/": (2, 1, 0), ".": (2, 1, 0)}[shape]
    parts = [int(x) for x in value.split(shape)]
    number = (date(*(parts[i] for i in order)) - date(1900, 1, 1)).days
    high, low = permuted([number // 4297, number % 4297], [17, 4297], "date")
    new = date(1900, 1, 1) + timedelta(days=high * 4297 + low)
    return new.strftime({"-": "%Y-%m-%d", "/": "%d/%m/%Y", ".": "%d.%m.%Y"}[shape])


def values(rng):
    """(value, its pseudonym) of every kind."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijkXYZ") for _ in range(n))
    body = "4" + digits(14)
    number = body + luhn_digit(body)
    spaced = " ".join(number[i : i + 4] for i in range(0, 16, 4))
    account = digits(18)
    code = "DE" + f"{98 - remainder(account + 'DE00'):02d}" + account
    mail = f"{letters(5)}.{digits(2)}-{letters(3)}"
    born = date(1900, 1, 1) + timedelta(days=rng.randrange(73_000))
    octets = [rng.randrange(256) for _ in range(4)]
    secret, access, phone, abroad, french, national = letters(12) + digits(5), "".join(rng.choice("ABCXYZ0189") for _ in range(16)), f"{digits(3)}-{digits(3)}-{digits(4)}", f" {digits(2)} {digits(4)} {digits(4)}", f"06 {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"{digits(3)}-{digits(2)}-{digits(4)}"
    yield from ((x, card(x)) for x in (number, spaced))
    yield from ((x, iban(x)) for x in (code, " ".join(code[i : i + 4] for i in range(0, 22, 4))))
    yield f"{mail}@mail.example.org", general(mail, "email") + "@mail.example.org"
    for shape, text in (("-", born.isoformat()), ("/", born.strftime("%d/%m/%Y")), (".", born.strftime("%d.%m.%Y"))):
        yield text, day(text, shape)
    yield ".".join(map(str, octets)), ".".join(map(str, permuted(octets, [256] * 4, "ipv4")))
    yield f"password: {secret}", "password: " + general(secret, "secret")
    yield "AKIA" + access, "AKIA" + general(access, "access_key")
    yield phone, general(phone, "phone")
    yield "+49" + abroad, "+49" + general(abroad, "phone")
    yield french, general(french, "phone")
    yield national, general(national, "national_id")
    yield "+33 6 12 34 56 78", "+33" + general(" 6 12 34 56 78", "phone")


@pytest.mark.parametrize("seed", [1, 2])
def test_texts_match_a_plain_version(spark, seed):
    rng = random.Random(seed)
    texts, want = [], []
    for _ in range(25):
        pairs = list(values(rng))
        rng.shuffle(pairs)
        between = [rng.choice([" and ", "\n(", " ; see ", ", then: ", " – "]) for _ in pairs]
        texts.append("".join(b + v for b, (v, _) in zip(between, pairs)) + " end")
        want.append(("".join(b + p for b, (_, p) in zip(between, pairs)) + " end", sum(v != p for v, p in pairs)))
    found = replaced(spark, texts, KEY)
    for i, expected in enumerate(want):
        assert found[i] == expected


def test_a_very_long_text(spark):
    rng = random.Random(4)
    pairs = [p for _ in range(300) for p in values(rng)]
    filler = " plain words without any value " * 20
    found = replaced(spark, [filler.join(v for v, _ in pairs)], KEY)[0]
    assert found[0] == filler.join(p for _, p in pairs)
