"""Proposals of keys, tokens, passwords, account numbers and identity numbers with letters."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

Span = tuple[str, int, int]

#: Published formats of access keys and tokens.
KNOWN = re.compile(
    r"(?<![A-Za-z0-9_-])(?:"
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|gh[opsu]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"
    r"|glpat-[A-Za-z0-9_-]{20}(?![A-Za-z0-9_-])"
    r"|xox[abps]-[A-Za-z0-9-]{10,200}+"
    r"|AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"
    r"|[rs]k_live_[0-9A-Za-z]{16,99}+"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
)
#: Each of those formats holds one of these.
FRONTS = ("AKIA", "ASIA", "gho_", "ghp_", "ghs_", "ghu_", "glpat-", "xox", "AIza", "k_live_", "eyJ")
#: A name of a secret, a sign, and the value.
ASSIGNED = re.compile(
    r"(?i)(?:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|secret|auth)[_ -]?key|credential)s?"
    r"[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?(?P<value>[^\s\"',;<>]{4,}+)"
)
#: Runs that may be a key without a name: long, of letters and digits.
TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=~-])[A-Za-z0-9_+/=~-]{16,512}+(?![A-Za-z0-9_+/=~-])")
#: What stands in front of the sign of a named value, at most 24 characters, and the sign.
NAME = re.compile(
    r"(?i)(?:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|secret|auth)[_ -]?key|credential)s?"
    r"[\"']?\s{0,3}\Z"
)
SIGN = re.compile("[:=]+")
DIGIT = re.compile("[0-9]")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
PEM_END = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IDENTITY = re.compile(
    r"(?<![A-Za-z0-9-])(?:[A-Z]{1,3}[ -]?[0-9]{2}(?:[ -]?[0-9]{2}){2,3}[0-9]?[ -]?[A-Z]?"
    r"|[0-9]{7,9}[ -]?[A-Z]|[A-Z][0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{2})(?![A-Za-z0-9-])"
)
IDENTITY_CUE = re.compile(
    r"(?i)(?:passport|identity|national|insurance|licen[cs]e|nino|dni|nif|iban|account|ausweis|id)"
    r"(?:\W{0,3}(?:no|nr|num|number|card|is))?\W{0,3}$"
)
#: Fixed value: the control letters of a Spanish identity number, by its remainder.
CONTROL_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
SECRET_CUE = re.compile(
    r"(?i)(?:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|secret|auth)[_ -]?key|credential)s?"
    r"[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?$"
)


def account_is_valid(body: str) -> bool:
    """The remainder by 97 of an international account number is one."""
    plain = body.replace(" ", "")
    if not 15 <= len(plain) <= 34 or not plain.isalnum() or not plain.isascii():
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def letter_is_valid(body: str) -> bool:
    plain = body.replace(" ", "").replace("-", "")
    return bool(re.fullmatch(r"[0-9]{8}[A-Z]", plain)) and CONTROL_LETTERS[int(plain[:8]) % 23] == plain[8]


def proposals(text: str) -> list[Span]:
    """High-recall spans of kinds ``secret`` and ``document``; they may overlap.

    An account number is proposed up to each of its groups, as a word in capitals may follow.
    A run without a name is proposed at 16 to 512 characters with letters and digits, a named
    value at any length. The time is linear in the text.
    """
    found: list[Span] = []
    if any(front in text for front in FRONTS):
        found += (("secret", *m.span()) for m in KNOWN.finditer(text))
    if any(NAME.search(text, max(0, m.start() - 24), m.start()) for m in SIGN.finditer(text)):
        found += (("secret", *m.span("value")) for m in ASSIGNED.finditer(text))
    at = text.find("-----BEGIN")
    while at >= 0 and (begin := PEM.search(text, at)):
        end = PEM_END.search(text, begin.end())
        if not end:
            break
        found.append(("secret", begin.start(), at := end.end()))
    if not DIGIT.search(text):
        return list(dict.fromkeys(found))
    for m in TOKEN.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            found.append(("secret", *m.span()))
    for m in ACCOUNT.finditer(text):
        for size in range(15, m.end() - m.start() + 1):
            stop = m.start() + size
            if (stop == m.end() or not text[stop].isalnum()) and text[stop - 1].isalnum():
                found.append(("document", m.start(), stop))
    for m in IDENTITY.finditer(text):
        found.append(("document", *m.span()))
    return list(dict.fromkeys(found))


def features(text: str, span: Span) -> list[float]:
    """What is written and what stands in front, for spans of any kind."""
    kind, a, b = span
    body, before = text[a:b], text[max(0, a - 40) : a]
    n = max(len(body), 1)
    counts = Counter(body)
    classes = [sum(c.isupper() for c in body), sum(c.islower() for c in body), sum(c.isdigit() for c in body)]
    return [
        float(kind == "secret"), float(kind == "document"),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        *(c / n for c in classes), 1 - sum(classes) / n,
        sum(x.isdigit() != y.isdigit() for x, y in zip(body, body[1:])) / n,
        float(KNOWN.fullmatch(body) is not None or body.startswith("-----BEGIN")),
        float(SECRET_CUE.search(before) is not None), float(IDENTITY_CUE.search(before) is not None),
        float(account_is_valid(body)), float(letter_is_valid(body)),
        body.count("/"), float(set(body) <= set("0123456789abcdef")),
    ]


def weak_label(text: str, span: Span) -> bool | None:
    """What the form alone says of a proposal; None where it says nothing.

    A published format, a named value with digits, a valid account number or control letter
    are personal; an identity number behind its name too. A named value of letters only,
    and other runs without a name, are not.
    """
    kind, a, b = span
    body, before = text[a:b], text[max(0, a - 40) : a]
    if kind == "document":
        return account_is_valid(body) or letter_is_valid(body) or IDENTITY_CUE.search(before) is not None
    if KNOWN.fullmatch(body) or body.startswith("-----BEGIN"):
        return True
    if SECRET_CUE.search(before):
        return None if len(body) < 6 else any(c.isdigit() for c in body)
    # a run that holds a named value is neither: the value is a proposal of its own
    return None if KNOWN.search(body) or ASSIGNED.search(body) else False


def _account(rng: random.Random) -> str:
    country, body = rng.choice(["GB", "DE", "FR", "NL"]), "".join(rng.choices("0123456789ABCDEFGH", k=rng.randint(14, 20)))
    rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    whole = f"{country}{98 - rest:02d}{body}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.5 else whole


def made_examples(text: str, seed: int) -> list[tuple[str, Span, bool]]:
    """Made-up values put into a place of the text: personal ones and look-alikes.

    The corpus may hold few such values, so every sampled text lends its words as context.
    """
    rng = random.Random(seed)
    at = text.find(" ", rng.randrange(len(text) + 1))
    left, right = (text[max(0, at - 40) : at], text[at : at + 40]) if at >= 0 else (text[-40:], "")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = "".join(rng.choices(letters + letters.lower() + "0123456789", k=rng.randint(12, 44))) + str(rng.randint(0, 9))
    hexed = "".join(rng.choices("0123456789abcdef", k=rng.choice([16, 18, 32, 40]))) + "7"
    eight = rng.randrange(10**8)
    passport = rng.choice(letters) + f"{rng.randrange(10**8):08d}"
    name = rng.choice(["password=", "pwd: ", "secret = ", "api_key=", "access key: ", "token='", "auth-key="])
    word = rng.choice(["must", "required", "expired", "changed", "please"])
    key = "AKIA" + "".join(rng.choices(letters + "234567", k=16))
    account = _account(rng)
    broken = account[:-1] + ("0" if account[-1] != "0" else "1")
    cue = rng.choice(["passport ", "Passport no. ", "identity card: ", "national id ", "insurance number "])
    made = [
        ("secret", name, mixed, True), ("secret", name, hexed, True), ("secret", "", key, True),
        ("secret", name, word, False), ("secret", "", hexed, False), ("secret", "", mixed, False),
        ("document", "", account, True), ("document", "", broken, False),
        ("document", cue, passport, True), ("document", "", passport, False),
        ("document", "", f"{eight:08d}{CONTROL_LETTERS[eight % 23]}", True),
        ("document", "", f"{eight:08d}{CONTROL_LETTERS[(eight + 1) % 23]}", False),
    ]
    out = []
    for kind, front, body, truth in made:
        front = f"{left} {front}"
        out.append((front + body + right, (kind, len(front), len(front) + len(body)), truth))
    return out
