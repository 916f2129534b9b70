"""Surrogates for personal data.

Detected entities (e-mail addresses, phone numbers, IP addresses of both versions, payment cards with a
valid check digit, bank accounts, social security numbers, credentials, names) get keyed replacements of
their own kind: letters stay letters of the same case and script, digits digits, separators stay; a card
keeps its issuer digit and a valid check digit, a bank account its country and, if it had them, valid
check digits; IP octets stay octets; a name keeps its script and the gender its title tells. Of e-mail
domains only the last label stays (of the mail hosts in ``HOSTS`` all), and equal domains stay equal.
The replacement depends on the key and the entity's normal form alone, so all mentions of an entity,
in any document and any notation, get the same one (coreference). A phone number's normal form is its
last ten digits, so it is one entity with and without its country code, which stays as written.

Names are found after a title (``TITLES``); their words are replaced at every other place of the same text as
well if they have a capital letter there (scripts without capitals: wherever the word stands alone). Not
detected: names that no title precedes anywhere in their text, names written small, inflected forms,
postal addresses and dates of birth. A capitalised ordinary word that equals a name of its text is replaced too.

Distinctness is checked over the whole corpus: where two entities would get equal replacements, or a
replacement equals some entity of the corpus, all but the least of them try their next replacement,
until none collide. From turn to turn replacements have more characters (fixed formats: from the turn
``WIDER`` on), so they outgrow all originals and the rounds end whatever the corpus holds. Only these
exceptions are joined back to documents; all else is computed in place, so texts aren't shuffled
(unless there are more exceptions than may be broadcast).

Edge cases: null text stays null, empty text empty, both with 0 entities; texts without entities are
returned unchanged; repeated rows get equal results; an empty table gives an empty result; other columns pass through,
and private_text, n_private must not be among them.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, giving_back, materialize, release, small

#: Titles before names, as written and in capitals; and those that tell a woman, in small letters.
TITLES = tuple(
    "Mr Mrs Ms Miss Mister Sir Madam Dr Prof Professor Herr Herrn Frau Se\u00f1or Se\u00f1ora Se\u00f1orita Sr Sra Srta Don Do\u00f1a Monsieur Madame Mademoiselle Mme Mlle "
    "\u0433-\u043d \u0433-\u0436\u0430 \u0433\u043e\u0441\u043f\u043e\u0434\u0438\u043d \u0433\u043e\u0441\u043f\u043e\u0436\u0430".split()
)
FEMALE = frozenset("mrs ms miss madam frau se\u00f1ora se\u00f1orita sra srta do\u00f1a madame mademoiselle mme mlle \u0433-\u0436\u0430 \u0433\u043e\u0441\u043f\u043e\u0436\u0430".split())
#: Capital titles that are also other words or products count before a dot or a word in capitals only.
_STRICT = {"MS": r"MS(?=\.)", "DON": r"DON(?=[ ][^\W\d_a-z]{2})"}
_TITLE = "(?:" + "|".join(_STRICT.get(x) or re.escape(x) for x in sorted({x for t in TITLES for x in (t, t.upper(), t.capitalize())}, key=lambda x: (-len(x), x))) + ")"
_FIRST = "".join(sorted({x[0] for t in TITLES for x in (t, t.upper())}))
_WORD = r"[^\W\d_a-z\u00df-\u00f6\u00f8-\u00ff\u0430-\u044f][^\W\d_]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is detected, the first that matches at a place holds. Fixed patterns.
PATTERNS = (
    ("email", r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+"),
    ("key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9_-]{20,}"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)[A-Za-z0-9+/=_.~-]{6,}"),
    ("ip", rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"),
    ("ipv6", r"(?=[0-9A-Fa-f]{0,4}:)(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{3}|[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("name", rf"(?=[{_FIRST}])(?<!\w){_TITLE}\b\.?[ ]+{_WORD}(?:[ ]{_WORD}){{0,2}}"),
)
_FIND = re.compile("|".join(f"(?P<{n}>{p})" for n, p in PATTERNS))
#: Public mail hosts, whose names say nothing about a person, and reserved example names: fixed values.
HOSTS = frozenset("gmail.com googlemail.com outlook.com hotmail.com live.com yahoo.com icloud.com aol.com gmx.de web.de mail.ru yandex.ru qq.com 163.com proton.me protonmail.com example.com example.org example.net".split())
#: Digits that tell a phone number, and the turn from which fixed formats grow.
NATIONAL, WIDER = 10, 8
#: A text without any of these holds no entity.
_HINT = re.compile(rf"[@\d]|(?i:password|passwd|pwd|secret|token|key)|sk-|gh[pousr]_|::|[0-9A-Fa-f]:[0-9A-Fa-f]{{1,4}}:|(?=[{_FIRST}])(?<!\w){_TITLE}\b")
_CAPITAL = re.compile(rf"(?<![^\W_]){_WORD}(?![^\W_])")
_ASSIGNED = re.compile(r"(?i)\A[a-z_-]+[\"']?\s*[:=]\s*[\"']?")
#: Syllables of surrogate names by script, and endings by kind.
SYLLABLES = {
    "latin": "ba be bo da de di do el fa fe ga ha jo ka ke la le li lo ma me mi na ne ni no pa ra re ri ro sa se si ta te ti va ve vi".split(),
    "cyrillic": "\u0431\u0430 \u0432\u0435 \u0433\u043e \u0434\u0430 \u0434\u0438 \u0437\u043e \u043a\u0430 \u043b\u0430 \u043b\u0435 \u043c\u0430 \u043c\u0438 \u043d\u0430 \u043d\u0438 \u043f\u0430 \u0440\u043e \u0440\u0430 \u0441\u0435 \u0442\u0430 \u0442\u0438 \u0444\u0435".split(),
}
ENDINGS = {
    "latin": {"given_m": ("n", "s", "rd", "k"), "given_f": ("na", "lia", "ra", "sa"), "surname": ("son", "ner", "mann", "well", "ton")},
    "cyrillic": {"given_m": ("\u043d", "\u0440", "\u043c"), "given_f": ("\u043d\u0430", "\u043b\u0438\u044f", "\u0440\u0430"), "surname": ("\u0435\u043d\u043a\u043e", "\u0438\u0447", "\u0430\u0434\u0437\u0435")},
}
Span = tuple[int, int, str, str]  # begin, end, kind, normal form


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find(text: str) -> list[Span]:
    """Entities of a text, in order. The words of a name are entities of their own."""
    if not _HINT.search(text):
        return []
    out: list[Span] = []
    named: dict[str, str] = {}
    for m in _FIND.finditer(text):
        kind, raw, at = m.lastgroup, m.group(), m.start()
        if kind == "secret":
            skip = _ASSIGNED.match(raw).end()
            out.append((at + skip, m.end(), "secret", raw[skip:]))
        elif kind == "name":
            title, *words = re.finditer(r"[^\s]+", raw)
            gender = "f" if title.group().rstrip(".").lower() in FEMALE else "m"
            for i, w in enumerate(words):
                part = "surname" if i == len(words) - 1 else f"given_{gender}"
                first = w.group()[0]
                script = "latin" if first < "\u0250" else "cyrillic" if "\u0400" <= first <= "\u04ff" else "other"
                out.append((at + w.start(), at + w.end(), f"{part}:{script}", w.group().casefold()))
                named.setdefault(w.group().casefold(), f"{part}:{script}")
        elif kind == "email":
            out.append((at, m.end(), kind, raw.lower()))
        elif kind in ("phone", "card", "ssn"):
            digits = "".join(c for c in raw if c.isdigit())
            if kind == "card" and not _luhn(digits):
                continue
            digits = digits[-NATIONAL:] if kind == "phone" else digits
            out.append((at, m.end(), f"{kind}{len(digits)}", digits))
        elif kind == "iban":
            out.append((at, m.end(), kind, raw.replace(" ", "")))
        elif kind == "ipv6":
            try:
                out.append((at, m.end(), kind, ipaddress.IPv6Address(raw).exploded))
            except ValueError:
                continue
        else:
            out.append((at, m.end(), kind, raw))
    return _again(text, out, named) if named else out


def _again(text: str, found: list[Span], named: dict[str, str]) -> list[Span]:
    """The entities with all other mentions of the names among them: the same words, capitalised, without a title."""
    ends, out = [s[1] for s in found], list(found)
    for m in _CAPITAL.finditer(text):
        norm = m.group().casefold()
        if norm in named:
            i = bisect_right(ends, m.start())
            if i == len(found) or found[i][0] >= m.end():
                out.append((m.start(), m.end(), named[norm], norm))
    return sorted(out)


def _stream(key: bytes, kind: str, norm: str, turn: int) -> Callable[[int], int]:
    """Keyed draws below a given number."""
    state = {"n": 0, "pool": b""}

    def draw(below: int) -> int:
        if len(state["pool"]) < 4:
            state["pool"] += hmac.new(key, f"{kind}\0{norm}\0{turn}\0{state['n']}".encode(), hashlib.sha256).digest()
            state["n"] += 1
        raw, state["pool"] = state["pool"][:4], state["pool"][4:]
        return int.from_bytes(raw, "big") % below

    return draw


@lru_cache(4096)
def _likes(c: str) -> str:
    """The characters of a letter's or digit's own kind, of the same block and case."""
    for lo, n in (("0", 10), ("a", 26), ("A", 26)):
        if lo <= c < chr(ord(lo) + n):
            return "".join(chr(ord(lo) + i) for i in range(n))
    block = range(ord(c) & ~0x7F, (ord(c) | 0x7F) + 1)
    return "".join(chr(x) for x in block if unicodedata.category(chr(x)) == unicodedata.category(c))


def _alike(text: str, draw: Callable[[int], int]) -> str:
    """Other letters and digits of the same kinds; hexadecimal strings (with a letter) stay so."""
    is_hex = re.fullmatch(r"[0-9a-f]{8,}", text) is not None and not text.isdigit()
    out = []
    for c in text:
        like = "0123456789abcdef" if is_hex else _likes(c) if c.isalnum() else c
        out.append(like[draw(len(like))])
    return "".join(out)


def iban_check(country: str, account: str) -> str:
    """The two check digits of a bank account number."""
    digits = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(digits) % 97:02d}"


def _other_domain(key: bytes, domain: str) -> str:
    labels = domain.split(".")
    if domain in HOSTS:
        return domain
    draw = _stream(key, "domain", domain, 0)
    return ".".join([_alike(x, draw) for x in labels[:-1]] + labels[-1:])


def surrogate(key: bytes, kind: str, norm: str, turn: int = 0) -> str:
    """The ``turn``-th replacement of an entity, in normal form."""
    draw = _stream(key, kind, norm, turn)
    base = kind.rstrip("0123456789")
    digits = lambda n: "".join(str(draw(10)) for _ in range(n))
    letters = lambda n: "".join(chr(97 + draw(26)) for _ in range(n))
    wider = max(0, turn - WIDER + 1)
    if base == "email":
        local, _, domain = norm.partition("@")
        return _alike(local, draw) + letters(turn) + "@" + _other_domain(key, domain)
    if base == "ip":
        return ".".join(str(1 + draw(254)) for _ in range(4 + wider))
    if kind == "ipv6":
        return ":".join(["2001", "0db8", *(f"{draw(65536):04x}" for _ in range(6 + wider))])
    if base == "key":
        head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", norm).group()
        return head + _alike(norm[len(head) :], draw) + letters(wider)
    if base == "iban":
        account = _alike(norm[4:], draw) + digits(wider)
        return norm[:2] + (iban_check(norm[:2], account) if iban_check(norm[:2], norm[4:]) == norm[2:4] else digits(2)) + account
    if base == "phone":
        return str(2 + draw(8)) + digits(len(norm) - 1 + wider)
    if base == "card":
        body = norm[0] + digits(len(norm) - 2 + wider)
        return next(body + str(d) for d in range(10) if _luhn(body + str(d)))
    if ":" in kind:
        part, script = kind.split(":")
        if script == "other":
            return _alike(norm + norm[-1] * turn, draw)
        parts, ends = SYLLABLES[script], ENDINGS[script][part]
        return "".join(parts[draw(len(parts))] for _ in range(2 + turn)) + ends[draw(len(ends))]
    return _alike(norm, draw) + (digits(wider) if norm.isdigit() else letters(wider))


def render(mention: str, kind: str, core: str) -> str:
    """A replacement in the mention's notation. What a phone number has before its normal form stays, and
    characters of a longer replacement follow."""
    base = kind.rstrip("0123456789")
    if base in ("phone", "card", "ssn", "iban"):
        keep = max(0, sum(c.isdigit() for c in mention) - NATIONAL) if base == "phone" else 0
        out, it = [], iter(core)
        for c in mention:
            if not c.isalnum() or keep:
                keep -= keep > 0 and c.isdigit()
                out.append(c)
            else:
                out.append(next(it))
        return "".join(out) + "".join(it)
    if ":" in kind:
        return core.upper() if mention.isupper() and len(mention) > 1 else core.capitalize()
    if base == "email" and len(core) == len(mention):
        return "".join(c.upper() if m.isupper() else c for c, m in zip(core, mention, strict=True))
    return core


def replace(text: str, key: bytes, turns: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with replacements, and the number of entities."""
    out, at, n = [], 0, 0
    for begin, end, kind, norm in find(text):
        core = surrogate(key, kind, norm, turns.get((kind, norm), 0))
        out += [text[at:begin], render(text[begin:end], kind, core)]
        at, n = end, n + 1
    return "".join(out) + text[at:], n


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (th, kind, norm), th the text's hash; an entity once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for th, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(th, k, n) for k, n in dict.fromkeys((s[2], s[3]) for s in find(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["th", "kind", "norm"])

    return docs.select(F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text")).mapInArrow(giving_back(run), "th long, kind string, norm string")


def exceptions(entities: DataFrame, key: bytes, surrogate_of: Callable = surrogate) -> DataFrame | None:
    """Rows (kind, norm, turn) of the entities whose first replacement collides, or None.

    Kinds with notations in common (``phone10``, ``phone9``) are told apart, so their replacements
    can't be equal. A turn draws for the entities that collided in the one before; a draw fails if an
    entity or an earlier draw has its value, or the draw of a lesser entity. Draws grow with the turn (see
    ``surrogate``), so that in the end no original is as long and the values suffice: the rounds end. A
    round writes only the entities that are still open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n, t = (c.to_pylist() for c in batch.columns)
            core = [surrogate_of(key, *x) for x in zip(k, n, t, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(core, pa.string())], ["kind", "norm", "turn", "core"])

    def drawn(x: DataFrame, turn: int) -> DataFrame:
        return materialize(x.select("kind", "norm", F.lit(turn).alias("turn")).mapInArrow(giving_back(run), "kind string, norm string, turn int, core string"), "pii-surrogates")

    taken = entities.select("kind", F.col("norm").alias("core"))
    new, moved, turn = drawn(entities, 0), None, 0
    while True:
        first = new.groupBy("kind", "core").agg(F.count("*").alias("n"), F.min("norm").alias("first")).where("n > 1")
        twice = new.join(first, ["kind", "core"]).where("norm <> first").select("kind", "norm")
        failed = materialize(twice.union(new.join(taken, ["kind", "core"], "left_semi").select("kind", "norm")).distinct(), "pii-again")
        if failed.isEmpty():
            release(failed)
            kept = new
        else:
            kept = new.join(failed, ["kind", "norm"], "left_anti")
        if turn:
            moved = kept.select("kind", "norm", "turn") if moved is None else moved.unionByName(kept.select("kind", "norm", "turn"))
        if kept is new:
            return moved
        taken = taken.unionByName(kept.select("kind", "core"))
        turn += 1
        new = drawn(failed, turn)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with private_text and n_private."""
    if clash := {"private_text", "n_private"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    secret = key.encode()
    found = materialize(mentions(docs, text), "pii-mentions")
    moved = exceptions(found.select("kind", "norm").distinct(), secret)
    th, turns = fresh(docs, "th", "turns")
    if moved is None:
        rows = docs.withColumn(turns, F.lit(None).cast("array<struct<kind:string,norm:string,turn:int>>"))
    else:
        own = found.join(moved, ["kind", "norm"]).distinct().groupBy(F.col("th").alias(th)).agg(F.collect_list(F.struct("kind", "norm", "turn")).alias(turns))
        rows = docs.withColumn(th, F.xxhash64(F.col(f"`{text}`"))).join(small(materialize(own, "pii-turns")), th, "left").drop(th)
    at, last = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for t, x in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                new, n = (None, 0) if t is None else replace(t, secret, {(m["kind"], m["norm"]): m["turn"] for m in x or ()})
                out.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(out, pa.string()), pa.array(counts, pa.int64())], [*batch.schema.names[:last], "private_text", "n_private"])

    return rows.mapInArrow(giving_back(run), T.StructType([*docs.schema.fields, T.StructField("private_text", T.StringType()), T.StructField("n_private", T.LongType())]))
