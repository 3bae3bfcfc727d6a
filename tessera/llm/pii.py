"""Personal data by anchors: an automaton finds cues, local parsers expand and check what is around them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_columns

#: The kinds in their listed order; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "card_part", "phone_part", "url_login", "iban", "account", "secret")
BASE = KINDS[:4]
#: Words that announce an account number.
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "customer id", "ssn")
#: Words before which a key or password is given, and what some keys begin with.
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "api key", "apikey", "access_key", "access key", "private_key")
SECRET_STARTS = ("AKIA", "ghp_", "sk_live_", "xoxb-", "eyJ", "-----BEGIN ")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBER = frozenset("0123456789 ().+-")
#: An address can only start where a run of digits does, so runs of any length are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a card looks like inside a longer run of numbers, and a phone number before further digits.
_CARD_PART = re.compile(r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])")
_PHONE_PART = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){2,4}?(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(:[0-9]+)?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|num|#))?\x20?[:=#]?\x20?([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])", re.I)
_SECRET = re.compile(r"""["']?\x20{0,2}(?:=>|[=:])\x20{0,2}["']?([^\s"'<>]{8,512})""")
_SECRET_BODY = re.compile(r"[A-Za-z0-9._/+=-]{12,512}")
_PEM = re.compile(r"[A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{1,8192}-----END [A-Z ]{0,20}PRIVATE KEY-----")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("number", 1))
    a.add_word("@", ("email", 1))
    a.add_word("://", ("scheme", 3))
    for cue, what in [*((c, "account") for c in ACCOUNT_CUES), *((c, "secret") for c in SECRET_CUES), ("iban", "iban")]:
        for form in {cue, cue.title(), cue.upper(), cue.capitalize()}:
            a.add_word(form, (what, len(form)))
    for start in SECRET_STARTS:
        a.add_word(start, ("key", len(start)))
    a.make_automaton()
    return a


def find_spans(text: str, cues) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = number_end = 0
    for last, (what, size) in cues.iter(text):
        if what == "number":
            if last < number_end:
                continue
            start, number_end = last, last + 1
            while start > 0 and text[start - 1] in _NUMBER:
                start -= 1
            while number_end < len(text) and text[number_end] in _NUMBER:
                number_end += 1
            if number_end - start < 7:
                continue
            for m in _IP.finditer(text, start, number_end):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found["ip"].append(m.span())
            for m in _CARD.finditer(text, start, number_end):
                if 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                    found["card"].append(m.span())
                else:
                    found["card_part"] += [p.span() for p in _CARD_PART.finditer(text, *m.span()) if luhn(_NOT_DIGIT.sub("", p[0]))]
            for m in _PHONE.finditer(text, start, number_end):
                if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found["phone"].append(m.span())
                else:
                    found["phone_part"] += [p.span() for p in _PHONE_PART.finditer(text, *m.span()) if 8 <= len(_NOT_DIGIT.sub("", p[0])) <= 15]
        elif what == "email":
            start = last
            while start > mail_end and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                found["email"].append((start, mail_end := m.end()))
        elif what == "scheme":
            if m := _LOGIN.match(text, last + 1):
                found["url_login"].append(m.span())
        elif what == "iban":
            at = last + 1
            while at < len(text) and at < last + 4 and text[at] in " :=#":
                at += 1
            if (m := _IBAN.match(text, at)) and iban_valid(m[0]):
                found["iban"].append(m.span())
        elif what == "secret":
            if (m := _SECRET.match(text, last + 1)) and any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                found["secret"].append(m.span(1))
        elif what == "key":
            if m := (_PEM if text[last] == " " else _SECRET_BODY).match(text, last + 1):
                found["secret"].append((last + 1 - size, m.end()))
        elif (m := _ACCOUNT.match(text, last + 1)) and m.span(1) not in found["account"][-3:]:
            found["account"].append(m.span(1))
    return [(k, s, e) for k in KINDS for s, e in sorted(set(found[k]))]


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii, an array of (kind, start, end) in code points, end exclusive; no shuffle.

    Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns
    that pass the check of the kind; url_login, iban, account and secret are added by their cues,
    card_part and phone_part where a failed base match holds a number of the usual form, as numbers
    that stand side by side match as one. They never change base spans. Null and empty texts have no spans; repeated rows each get theirs; an
    input column named pii is replaced.
    """
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        cues = automaton()
        return lambda texts: [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "", cues)] for t in texts.to_pylist()], arrow)]

    return arrow_columns(docs, [text], [T.StructField("pii", kind)], make)


def mask_text(text: str | None, spans: list[dict]) -> str | None:
    """text with each span replaced by its kind in angle brackets; nested or overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs whose texts have their personal data replaced by <kind>.

    Overlapping spans become one; null and empty texts stay as they are, repeated rows each get theirs, an empty table
    gives no rows.
    """
    order = docs.columns
    found = find_pii(docs, text)
    made = arrow_columns(found, [text, "pii"], [T.StructField(text, T.StringType())], lambda: lambda texts, spans: [pa.array([mask_text(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())])
    return made.select(*order)
