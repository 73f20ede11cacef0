"""Made-up personal data, and what looks like it, set between words of real documents: labelled examples.

Each kind has makers of right spans and of look-alikes; formats are public ones. A maker returns what
stands before the span beside the host's words, the span, and what stands after it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_BASE32, _BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _ALNUM + "+/"
_HEX, _DIGITS = "0123456789abcdef", "0123456789"
_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "key", "access_key", "auth", "bearer", "credential", "passphrase")
_ASSIGN = ("=", ": ", " = ", "=\"", " = \"", ": \"", "='", " ")
_TOPS = ("com", "org", "net", "de", "fr", "io", "co.uk", "edu", "info", "es")

Made = tuple[str, str, str]


def _some(r: random.Random, letters: str, least: int, most: int) -> str:
    return "".join(r.choices(letters, k=r.randint(least, most)))


def _luhn_digit(digits: str) -> str:
    total = sum(d - 9 if (d := int(c) * (2 - i % 2)) > 9 else d for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _grouped(r: random.Random, digits: str, signs: str) -> str:
    sign = r.choice(signs)
    return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _closed(before: str, span: str, r: random.Random) -> Made:
    return before, span, before[-1] if before[-1:] in ("\"", "'") else r.choice(("", "", ".", ","))


def _email(r: random.Random, word: str) -> Made:
    local = r.choice((f"{word}.{_some(r, _DIGITS, 1, 3)}", f"{word}_{word[:3]}", word, f"{word[:1]}.{word}", f"{word}+{word[-3:]}"))
    domain = r.choice((f"mail{r.randint(1, 99)}.example", word[::-1], f"{word}-{r.randint(1, 9)}"))
    return r.choice(("", "mail: ", "contact ", "e-mail ", "<")), f"{local}@{domain}.{r.choice(_TOPS)}", ""


def _no_email(r: random.Random, word: str) -> Made:
    return "", r.choice((f"{word}@{word[::-1]}", f"{r.randint(1, 99)}@{r.randint(1, 999)}", f"{word}@{r.randint(2, 4)}x", f"git@{word}:{word}/{word[:3]}", f"{word}@{word}@")), ""


def _ip(r: random.Random, word: str) -> Made:
    return r.choice(("", "", "host ", "server ", "ip ", "from ")), ".".join(str(r.randint(0, 255)) for _ in range(4)), r.choice(("", ":8080", ""))


def _no_ip(r: random.Random, word: str) -> Made:
    made = (
        ".".join(str(r.randint(0, 40)) for _ in range(r.choice((3, 3, 5, 6)))),
        f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2040)}",
        ".".join(str(r.randint(256, 9999)) for _ in range(4)),
    )
    return r.choice(("", "version ", "v", "section ", "on ")), r.choice(made), ""


def _card(r: random.Random, word: str) -> Made:
    body = r.choice(("4", "51", "55", "37", "6011", "35")) + _some(r, _DIGITS, 18, 18)
    body = body[: r.choice((15, 15, 15, 14, 18))]
    digits = body + _luhn_digit(body)
    return r.choice(("", "", "card ", "visa ", "account ")), digits if r.random() < 0.4 else _grouped(r, digits, " -./"), ""


def _no_card(r: random.Random, word: str) -> Made:
    digits = _some(r, _DIGITS, 12, 24)
    if len(digits) <= 19 and _luhn_digit(digits[:-1]) == digits[-1]:
        digits = digits[:-1] + str((int(digits[-1]) + 1) % 10)
    return r.choice(("", "order ", "serial ", "invoice ", "id ")), digits if r.random() < 0.6 else _grouped(r, digits, " -./"), ""


def _phone(r: random.Random, word: str) -> Made:
    area, first, last = _some(r, "23456789", 3, 3), _some(r, _DIGITS, 3, 3), _some(r, _DIGITS, 4, 4)
    bare = r.choice((f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"0{area[:2]} {first}{last[0]} {last}", f"{area}.{first}.{last}"))
    if r.random() < 0.5:
        return r.choice(("", "phone ", "tel ", "call ")), r.choice(("+1 ", "+49 ", "+33 ", "0044 ", "+34-")) + bare, ""
    return r.choice(("phone ", "tel. ", "call ", "fax: ", "mobile ")), bare, ""


def _no_phone(r: random.Random, word: str) -> Made:
    y = r.randint(1900, 2040)
    made = (
        f"{y}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{y}-{y + 4}", f"978-{r.randint(0, 9)}-{_some(r, _DIGITS, 2, 2)}-{_some(r, _DIGITS, 6, 6)}-{r.randint(0, 9)}",
        _some(r, _DIGITS, 8, 16), f"{r.randint(0, 9)}.{_some(r, _DIGITS, 7, 12)}", " ".join(_some(r, _DIGITS, 2, 4) for _ in range(r.randint(4, 6))), f"{y}.{r.randint(10, 12)}.{r.randint(10, 28)}",
    )
    return r.choice(("", "", "isbn ", "order ", "on ", "pages ")), r.choice(made), ""


def _secret(r: random.Random, word: str) -> Made:
    if r.random() < 0.4:
        made = (
            r.choice(("AKIA", "ASIA")) + _some(r, _BASE32 + "0189", 16, 16), r.choice(("ghp_", "gho_")) + _some(r, _ALNUM, 36, 36), "sk-" + _some(r, _ALNUM, 20, 48),
            f"xoxb-{_some(r, _DIGITS, 10, 12)}-{_some(r, _ALNUM, 24, 24)}", "eyJ" + _some(r, _ALNUM + "-_", 40, 200), "AIza" + _some(r, _ALNUM + "-_", 35, 35),
        )
        return _closed(r.choice(("", "", "", r.choice(_NAMES) + r.choice(_ASSIGN))), r.choice(made) + "7", r)
    made = (_some(r, _HEX, 12, 64) + "7", _some(r, _ALNUM, 10, 48) + "3", _some(r, _BASE64, 20, 400) + "9", f"{word}{r.choice('!#%$_-')}{r.randint(10, 9999)}", _some(r, _ALNUM + "!#%$*", 8, 24) + "2")
    name = r.choice(_NAMES)
    return _closed((name.upper() if r.random() < 0.2 else name) + r.choice(_ASSIGN[:-1]), r.choice(made), r)


def _no_secret(r: random.Random, word: str) -> Made:
    kind = r.random()
    if kind < 0.35:  # prose beside a naming word
        return _closed(r.choice(_NAMES) + r.choice(_ASSIGN[1:3] + (" ", " ", " is ")), r.choice((word, word + word[::-1], f"{word}-{word}", word.capitalize())), r)
    if kind < 0.6:
        return r.choice(("commit ", "sha256:", "md5 ", "digest ", "checksum ", "uuid ")), r.choice((_some(r, _HEX, 32, 64) + "7", f"{_some(r, _HEX, 8, 8)}-{_some(r, _HEX, 4, 4)}-4{_some(r, _HEX, 3, 3)}-a{_some(r, _HEX, 3, 3)}-{_some(r, _HEX, 12, 12)}")), ""
    made = (
        f"{word}-{word[::-1]}-{r.randint(1, 2030)}-{word}", f"{word}_{r.randint(1, 99)}_{word}_{word}", f"IMG_{r.randint(2000, 2030)}{_some(r, _DIGITS, 4, 4)}_{_some(r, _DIGITS, 6, 6)}",
        f"{word}{word}{word}{r.randint(1, 9)}", f"/{word}/{word[::-1]}/{word}{r.randint(1, 9)}/{word}", _some(r, _DIGITS, 16, 30), f"{word}/{r.randint(2000, 2030)}/{word}-{word}",
    )
    return r.choice(("", "", "https://", "see ")), r.choice(made), ""


_MAKERS = ((_email, _no_email), (_ip, _no_ip), (_card, _no_card), (_phone, _no_phone), (_secret, _no_secret))


def plant(hosts: list[list[str]], n: int, kinds: int, seed: int = 7) -> Iterator[tuple[str, str, str, int, bool]]:
    """n examples (before, span, after, kind, right); kinds and labels take turns, hosts lend the words around."""
    r = random.Random(seed)
    lent = [h for h in hosts if any(h)] or [["here", "and", "there"]]
    for i in range(n):
        words = r.choice(lent)
        at = r.randrange(len(words))
        word = "".join(c for c in r.choice(words).lower() if c.isascii() and c.isalpha())[:16] or "name"
        kind, right = i % kinds, i // kinds % 2 == 0
        before, span, after = _MAKERS[kind][0 if right else 1](r, word)
        left, rest = " ".join(words[max(0, at - 6) : at]), " ".join(words[at : at + 6])
        yield f"{left} {before}" if left else before, span, f"{after} {rest}", kind, right
