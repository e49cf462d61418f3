"""Labelled examples for the candidates of ``pii``: real formats and decoys, made from templates.

Corpora hold few spans of some formats, and none of them is labelled.  Each example is a short text
with one span of one generator; its label is the template's and does not look at a feature.
"""

from __future__ import annotations

import random

# Words before a span, by what they confirm; neutral ones confirm nothing.
NEUTRAL = ["the house and river", "el mar y la casa", "und der alte Baum", "le petit jardin", "then we saw", "as before,", "it was", "see also", "-", ""]
MAIL = ["e-mail me:", "contact", "please write to", "mail", "my address is", "send mail to", "Kontakt E-Mail"]
PHONE = ["call", "tel.", "phone:", "fax", "my number is", "Telefon", "mobile", "please call me on", "phone number"]
NET = ["server", "host", "IP", "login from", "the ip is", "addr", "client ip"]
CARD = ["card", "visa", "credit card no.", "payment with", "account", "charged to card"]
CODE = ["order", "version", "isbn", "token", "license key", "sha", "order no.", "key"]
NUMBER = ["invoice", "serial", "tracking", "ref", "total of", "population", "pages", "id", "years"]
NAMES = ["anna", "j.smith", "maria_lopez", "kim77", "info", "sales", "paul.b", "kfslg.71", "o-neil", "t.meyer", "support", "lee"]
HOSTS = ["example", "mail7", "acme", "uni-koeln", "lab", "post", "webmail", "firma", "correo", "fastnet"]
ENDINGS = ["com", "org", "net", "edu", "de", "fr", "es", "io", "info", "co dot uk"]
PLAIN = ["look", "visit", "available", "hosted", "found", "arrived", "shop", "posted", "read", "online"]
ORDINARY = ["noon", "home", "top", "work", "school", "last", "once", "night"]


def _check_digit(head: str) -> str:
    total = sum((d := int(c) * 2) - 9 * (d > 9) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(head)))
    return str(-total % 10)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _grouped(r: random.Random, s: str, sign: str) -> str:
    return sign.join(s[i : i + 4] for i in range(0, len(s), 4))


def _hex(r: random.Random, most: int = 4) -> str:
    return "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, most)))


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a[:2]} {c} {b}{c[0]}", f"0{a}-{b}-{c}"])


def _real(r: random.Random, by: str) -> tuple[str, list[str], bool]:
    """A span, words that confirm it, and whether it is certain without them."""
    name, host, ending = r.choice(NAMES), r.choice(HOSTS), r.choice(ENDINGS)
    if by == "spelled":
        at, dot = r.choice([(" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]")])
        return name + at + host + dot + ending.replace(" dot ", dot), MAIL, at != " at "
    if by == "email":
        if r.random() < 0.5:
            return f"{name}ñ@{host}.ü{ending.split(' ')[0]}", MAIL, True
        return f"{name}@{host}", MAIL, False
    if by == "ip":
        if r.random() < 0.5:
            return ":".join(_hex(r) for _ in range(8)), NET, True
        left = r.randint(1, 3)
        return ":".join(_hex(r) for _ in range(left)) + "::" + ":".join(_hex(r) for _ in range(r.randint(1, 4) + (left == 1))), NET, True
    if by == "card":
        n = r.choice([13, 14, 15, 16, 16, 16])
        head = {13: "4", 14: "36", 15: "37", 16: r.choice(["4", "51", "55", "6011"])}[n]
        head += _digits(r, n - 1 - len(head))
        s = head + _check_digit(head)
        return (_grouped(r, s, r.choice(". -") if n < 16 else "."), CARD, False) if r.random() < 0.7 or n == 16 else (s, CARD, False)
    s = _phone(r)
    return s, PHONE, s.startswith("(")


def _decoy(r: random.Random, by: str) -> tuple[str, list[str]]:
    """A span that only looks like one, and words that stand before such."""
    if by == "spelled":
        if r.random() < 0.5:
            return f"{r.choice(PLAIN)} at {r.choice(HOSTS)} dot {r.choice(ENDINGS)}", NEUTRAL
        return f"{r.choice(ORDINARY)} at {r.choice(ORDINARY)} dot {r.choice(ORDINARY)}", NEUTRAL
    if by == "email":
        return r.choice([f"{r.choice(HOSTS)}@{r.randint(1, 30)}", f"icon@{r.randint(2, 4)}x", f"{r.choice(HOSTS)}@latest", f"{_hex(r)}@{_hex(r)}", f"f@{r.choice(HOSTS)}"]), CODE + NEUTRAL
    if by == "ip":
        two = lambda n: ":".join(f"{r.randint(0, 255):02x}" for _ in range(n))
        clock = f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}"
        return r.choice([two(6), two(4), two(5), clock, f"{clock}:{r.randint(0, 999):03d}", f"{r.randint(1, 9)}:{r.randint(1, 9)}:{r.randint(1, 9)}:{r.randint(1, 9)}"]), CODE + NUMBER + NEUTRAL + NET
    if by == "card":
        n, s = r.choice([13, 14, 15, 16, 17]), ""
        while not s or s[-1] == _check_digit(s[:-1]):
            s = _digits(r, n)
        if r.random() < 0.3:
            body = "978" + _digits(r, 9)
            s = body + str(-sum(int(c) * (1 + 2 * (i % 2)) for i, c in enumerate(body)) % 10)
            return r.choice([s, f"{s[:3]}-{s[3]}-{s[4:8]}-{s[8:12]}-{s[12]}"]), CODE
        return r.choice([s, _grouped(r, s, "."), _grouped(r, s, "-")]), CODE + NUMBER + NEUTRAL + CARD
    n = _digits(r, 12)
    years = " ".join(str(r.randint(1900, 2030)) for _ in range(3))
    shape = r.choice([years, f"{n[:2]} {n[2:5]} {n[5:8]}", f"{n[:3]} {n[3:6]} {n[6:9]}", f"{n[:2]}.{n[2:5]}.{n[5:9]}", f"{n[:4]}-{n[4:7]}-{n[7:12]}", f"{n[:3]}-{n[3:6]}-{n[6:10]}", f"{n[:3]} {n[3:6]} {n[6:10]}"])
    coded = shape[:3] == n[:3] and len(shape) == 12
    if r.random() < 0.2:
        return f"{n[:4]} {n[4:8]} {n[8:]} {_digits(r, 4)}", CODE + NUMBER + NEUTRAL
    return shape, CODE + NUMBER if coded else CODE + NUMBER + NEUTRAL


def examples(generators: tuple[str, ...], each: int = 400, seed: int = 7) -> list[tuple[str, str, float]]:
    """(text, generator, label): ``each`` real spans and as many decoys for every generator."""
    r, out = random.Random(seed), []
    for by in generators:
        for i in range(2 * each):
            if i % 2:
                span, words, certain = _real(r, by)
                words = words + NEUTRAL if certain else words
            else:
                span, words = _decoy(r, by)
            lead = " ".join(x for x in (r.choice(NEUTRAL), r.choice(words)) if x)
            tail = " ".join(x for x in (r.choice([",", ".", ";", "", ""]), r.choice(NEUTRAL)) if x)
            out.append((f"{lead} {span}{'' if tail[:1] in ',.;' else ' '}{tail}", by, float(i % 2)))
    return out
