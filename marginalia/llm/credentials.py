"""Credentials in comments and configuration text: found by entropy and place, masked without touching the rest.

Candidates are all quoted strings and all long tokens, and the pieces of a token between the marks that join names and
values; nothing else can be found. The Shannon entropy of a candidate is compared with what a random string of its length
over its alphabet is expected to have. Where the place announces a credential (an assignment, a header, a URL, a sentence,
a known prefix), a smaller share of that is enough; a candidate that nothing announces must look random by itself.
Digests, ids, public keys, references, names and placeholders are excluded. Keys in armour or broken over lines are
joined before they are judged. A text is read whole, in one task, so the job is one scan without a shuffle.

Defined results: null and empty texts hold nothing; a row keeps its id, and rows without id give none; repeated
rows with the same id come out once; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "*****"
#: Share of a random string's entropy that a candidate must reach: where its place announces it, and where nothing does.
ANNOUNCED_SHARE, PLAIN_SHARE = 0.75, 0.92
#: Characters that a candidate must have.
LEAST_NAMED, LEAST_PLAIN = 6, 12
FOUND = "id BIGINT, redacted STRING, spans ARRAY<STRUCT<start: INT, end: INT, rule: STRING>>"

# Names that announce a credential, in identifiers and in sentences.
_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|priv(?:ate)?[_-]?key|signing[_-]?key|auth|credentials?|creds?|clave|contraseña|passwort|kennwort)"
_SENTENCE = r"(?:passwords?|passphrase|passcode|secret(?:\s+key)?|token|api\s+key|credentials?|login|mot\s+de\s+passe|clé|clave|contraseña|Passwort|Kennwort|Zugangsdaten|Schlüssel)"
_IS = r"(?:is|are|was|lautet|ist|est|es|son|sind|sont|=|:|->)"
# Formats of issued tokens.
_ISSUED = r"(?:gh[pousr]_|github_pat_|glpat-|npm_|pypi-|xox[abeoprs]-|sk_live_|rk_live_|sk_test_|pk_priv_|sk-|hf_|dop_v1_|SG\.|AIza|ya29\.|shpat_|lin_api_|dckr_pat_)"

#: How far, in characters of one sentence, an announcing word may stand before the verb.
REACH = 60
#: (name, pattern of what stands before a credential): whatever candidate begins where a match ends is announced.
PLACES: list[tuple[str, re.Pattern]] = [
    ("url-userinfo", re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'<>]*:(?=[^\s@/\"']+@)")),
    ("url-parameter", re.compile(rf"(?i)[?&;][\w.-]*(?:{_NAME}|key|sig|signature)[\w.-]*=")),
    ("url-webhook", re.compile(r"(?i)https?://(?:hooks?|webhooks?)\.[^\s/]+/\S*/(?=[A-Za-z0-9_-]{16,})")),
    ("command-user", re.compile(r"(?:\s-u|--user)[ =]+[\"']?[^\s:\"']+:")),
    ("header", re.compile(r"(?i)\b(?:basic(?:\s+auth)?|bearer)[:\s]+[\"']?")),
    ("assignment", re.compile(rf"(?i)[\"'`]?[\w.-]*{_NAME}[\w-]*[\"'`]?\]?\s*(?::=|=>|==?|:)\s*(?:[bru]?[\"'`])?")),
    ("sentence", re.compile(rf"(?i)\b{_SENTENCE}\b[^\n.;]{{0,{REACH}}}?\s{_IS}\s+(?:[\w.-]+\s*/\s*)?[\"'`]?")),
    ("use-as", re.compile(rf"(?i)\b(?:use|try|enter|type|with)\s+[\"'`]?(?=[^\s\"'`,;]+[\"'`]?\s+as\s+(?:the\s+)?{_SENTENCE})")),
    ("phrase", re.compile(rf"(?i)\b(?:phrase|unlock|{_SENTENCE})\b[^\n.;]{{0,{REACH}}}?\s?{_IS}\s*[\"'`]")),
    ("login-pair", re.compile(rf"(?i)\b(?:login|credentials?|account)\b[^\n]{{0,{REACH}}}?\s[\w.@-]+\s*/\s*[\"'`]?")),
    ("issued-token", re.compile(rf"(?<![\w-])(?={_ISSUED}[A-Za-z0-9_\-]{{16,}})")),
    ("access-key-id", re.compile(r"(?<![A-Za-z0-9])(?=(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))")),
    ("signed-token", re.compile(r"(?=eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})")),
]
#: Where an announced value ends before its token does.
_CUT = {"url-userinfo": re.compile("@"), "url-parameter": re.compile("[&#]"), "issued-token": re.compile(r"[^\w-]"), "access-key-id": re.compile("[^A-Z0-9]"), "signed-token": re.compile(r"[^\w.=-]"), "url-webhook": re.compile(r"[^\w-]")}
_BLANK = re.compile(r"\s")
#: Quoted strings, tokens without blanks, and the pieces of a token between the marks that join names and values.
_QUOTED = re.compile(r"(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\n])+)(?P=q)")
_LONG = re.compile(r"[^\s\"'`,;)\]}]{6,}")
_PIECES = re.compile(r"[^=:@?&<>(\[{]+=*")
_ARMOUR = re.compile(r"-----BEGIN (?P<what>[A-Z0-9 ]+)-----(?P<v>.*?)(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
#: A key or password that is broken over the lines after its announcement.
_WRAPPED = re.compile(
    r"(?i)\b(?:secret|private|access|api|signing)\s+(?:key|token|secret)\b[^\n]*:(?:(?:[ \t]*\r?\n[ \t#/*]*|[ \t]+)(?P<v>[A-Za-z0-9+/_=-]{8,})[ \t\\]*)+"
)
_WRAPPED_PART = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

#: Whatever stands here is public or a fingerprint, not a credential.
_PUBLIC = re.compile(
    r"""(?ix) \bsha(?:1|224|256|384|512)[-:=][A-Za-z0-9+/=_-]+ | \bdata:[\w/+.-]+;base64,\S+
      | \b(?:sha-?\d+|md5|digest|checksum|hash|fingerprint|etag|integrity|commit|revision|reverts?|trace|span|request\s+id|uuid|guid)\b [^\n]{0,40}?[0-9a-f-]{8,}
      | \bssh-(?:rsa|ed25519|dss)\s+\S+"""
)
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Names of variables, functions, paths and calls.
_IDENTIFIER = re.compile(
    r"[a-z]+\d{0,3}(?:[A-Z][a-z]+\d{0,2})*|[A-Z][a-z]+\d{0,3}(?:[A-Z][a-z]+\d{0,2})*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*|[a-z]+(?:[_.-][a-z]+)+|[a-z]+(?:[/.:][a-z]+)+|\d+"
)
_REFERENCE = re.compile(
    r"\$|%[({]?\w+[)}]?%|\{\{|\{\w*\}|<[^>]*>|\b(?:os\.environ|process\.env|getenv|env|environ|vault|secrets?|config|settings|ssm|keyring|credentials?)\s*[.(\[]|^[\w.]+\(|^self\."
)
#: Date formats and regular expressions; and the pieces of paths, URLs and dotted names.
_FORMAT = re.compile(r"%[A-Za-z].*%[A-Za-z]|\\[wdsbnt]|\[\^?\w-\w|\(\?")
_PART = re.compile(r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+)?\d*")
#: A $ inside a random string: no variable's name follows.
_NO_VARIABLE = re.compile(r"(?<=.)\$(?![{(]|(?:[a-z_]+|[A-Z_]+|[a-z]+(?:[A-Z][a-z]+)+)\b)")
# Stand-ins for a credential.
_PLACEHOLDER = re.compile(
    r"(?i)[x*.#_?-]+|\W*|(?=[a-z_ <>\[\]./*-]+\d{0,3}$)(?:.*(?:your|insert|enter|change|replace)[-_ ]?\w*.*"
    r"|.*(?:placeholder|redacted|example|dummy|fake|omitted|here|goes).*|pass(?:word|wd)?\d{0,3}|pw|pwd|secret|token|key|user|none|null|true|false|undefined|test|foo|bar)"
)
#: Places whose form alone tells: only the entropy is asked.
_BY_FORM = {"issued-token", "access-key-id"}
#: Places that hold even next to a digest or inside a block.
_ANYWHERE = {"private-key", "wrapped-key", "url-userinfo", "command-user", "issued-token"}
#: Texts without any of these, in lower case, have no such place; the rest is announced by a name.
_ANNOUNCED = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "clave", "contrase", "kennwort", "login", "clé", "zugang", "schlüssel", "account", "unlock", "phrase")
_HINTS = {
    "issued-token": ("gh", "glpat-", "npm_", "pypi-", "xox", "sk_", "sk-", "rk_live", "pk_priv", "hf_", "dop_v1", "sg.", "aiza", "ya29.", "shpat_", "lin_api", "dckr_pat"),
    "access-key-id": ("akia", "asia"), "signed-token": ("eyj",), "url-userinfo": ("://",), "url-parameter": ("?", "&", ";"),
    "url-webhook": ("://hook", "://webhook"), "command-user": ("-u", "--user"), "header": ("basic", "bearer"),
}
_TRAIL = ".,;:!?)]}'\"`"


def entropy(text: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


@lru_cache(maxsize=4096)
def expected_entropy(length: int, size: int) -> float:
    """The mean Shannon entropy, in bits per character, of random strings of a length over an alphabet of a size."""
    if length <= 1:
        return 0.0
    if length > 512:
        return math.log2(size) - (size - 1) / (2 * length * math.log(2))
    k = np.arange(1, length + 1)
    ways = np.array([math.lgamma(length + 1) - math.lgamma(i + 1) - math.lgamma(length - i + 1) for i in k])
    rest = (length - k) * math.log1p(-1 / size)
    return float(-size * (np.exp(ways - k * math.log(size) + rest) * (k / length) * np.log2(k / length)).sum())


def alphabet(text: str) -> int:
    """The size of the smallest alphabet that a text is written in."""
    if _HEX.fullmatch(text):
        return 16
    if _BASE64.fullmatch(text):
        return 64 if any(c.isupper() for c in text) else 36
    return 94 if " " not in text else 27


def threshold(text: str, named: bool) -> float:
    """The entropy that a string of this length and alphabet must reach: a share of what a random one has."""
    return (ANNOUNCED_SHARE if named else PLAIN_SHARE) * expected_entropy(len(text), alphabet(text))


def credible(value: str, named: bool) -> bool:
    """Whether a candidate can be a credential; named: its place announces one."""
    if entropy(value) < threshold(value, named):
        return False
    if named and " " in value:
        # A phrase: several words, not a sentence that ends like one.
        words = value.split()
        return len(words) >= 4 and len(set(words)) >= 4 and not _REFERENCE.search(value) and value[-1] not in ".:!?"
    if len(value) < (LEAST_NAMED if named else LEAST_PLAIN) or _PLACEHOLDER.fullmatch(value) or _REFERENCE.search(value if named else _NO_VARIABLE.sub("", value)):
        return False
    if _IDENTIFIER.fullmatch(value) or _UUID.fullmatch(value):
        return False
    if _HEX.fullmatch(value):
        # Without a name a hex string is a digest.
        return named and len(value) >= 16
    # Names, paths, formats and dates are made of words and numbers; so is much that has a name before it.
    return named or not (_FORMAT.search(value) or " " in value or all(_PART.fullmatch(x) for x in re.split(r"[\W_]+", value)))


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in _TRAIL and not (text[end - 1] == "!" and end - start <= 12):
        end -= 1
    return start, end


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each quoted string, each long token, and each piece of one."""
    for m in _QUOTED.finditer(text):
        yield m.span("v")
    for m in _LONG.finditer(text):
        yield m.span()
        for piece in _PIECES.finditer(text, *m.span()):
            if piece.span() != m.span():
                yield piece.span()


def announced(text: str) -> dict[int, list[str]]:
    """The names of the places that announce what begins at an offset."""
    low = text.lower()
    named = any(h in low for h in _ANNOUNCED)
    out: dict[int, list[str]] = {}
    for name, pattern in PLACES:
        if any(h in low for h in _HINTS[name]) if name in _HINTS else named:
            for m in pattern.finditer(text):
                out.setdefault(m.end(), []).append(name)
    return out


def _joined(text: str) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """The parts of keys that are written over several lines, and what announces them."""
    low = text.lower()
    if "-----begin" in low:
        for m in _ARMOUR.finditer(text):
            if "PRIVATE" in m["what"]:
                yield [m.span("v")], "private-key"
    if "key" in low or "token" in low or "secret" in low:
        for m in _WRAPPED.finditer(text):
            parts = [p.span() for p in _WRAPPED_PART.finditer(text, text.index(":", m.start()), m.end())]
            if parts:
                yield parts, "wrapped-key"


def credentials(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the credentials in a text, in order and without overlap."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    for parts, name in _joined(text):
        whole = "".join("".join(_WRAPPED_PART.findall(text, a, b)) for a, b in parts)
        if len(whole) >= LEAST_NAMED and entropy(whole) >= threshold(whole, True) and (name == "private-key" or credible(whole, True)):
            found += [(a, b, name) for a, b in parts]
    places = announced(text)
    ends: dict[int, int] = {}
    for a, b in candidates(text):
        ends[a] = max(b, ends.get(a, b))
        x, y = _trim(text, a, b)
        if y - x >= LEAST_PLAIN and credible(text[x:y], False):
            found.append((x, y, "plain"))
    # A value that is announced inside a token ends with the token.
    spans = sorted((a, b) for a, b in ends.items())
    for at, names in places.items():
        i = bisect.bisect_right(spans, (at, len(text))) - 1
        quoted = text[at - 1 : at] in ("\"", "'", "`")
        end = ends.get(at) or max((b for a, b in spans[max(0, i - 8) : i + 1] if b > at), default=at)
        for name in names:
            # Only a quoted value may hold blanks.
            m = _CUT[name].search(text, at, end) if name in _CUT else None if quoted else _BLANK.search(text, at, end)
            x, y = _trim(text, at, m.start() if m else end)
            value = text[x:y]
            if credible(value, True) or name in _BY_FORM and entropy(value) >= threshold(value, True):
                found.append((x, y, name))
    if not found:
        return []
    public = [m.span() for m in _PUBLIC.finditer(text)] + [m.span() for m in _ARMOUR.finditer(text)]
    kept: list[tuple[int, int, str]] = []
    for a, b, name in sorted(found, key=lambda x: (x[2] == "plain", x[0], -x[1])):
        if name not in _ANYWHERE and any(x < b and a < y for x, y in public):
            continue
        if all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, name))
    return sorted(kept)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with the credentials masked; line breaks and comment marks inside a key block stay."""
    out, last = [], 0
    for a, b, _ in spans:
        out += [text[last:a], re.sub(r"[A-Za-z0-9+/=]{4,}", MASK, text[a:b]) if "\n" in text[a:b] else MASK]
        last = b
    return "".join([*out, text[last:]])


def find_credentials(df: DataFrame, row_id: str = "id", text: str = "raw_text") -> DataFrame:
    """FOUND: the rows whose text holds a credential, with its places and the masked text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch["id"], batch["text"], strict=True):
                if spans := credentials(raw):
                    rows.append((key, redact(raw, spans), spans))
            yield pd.DataFrame(rows, columns=["id", "redacted", "spans"])

    rows = df.where(F.col(row_id).isNotNull() & (F.length(text) >= 8))
    return rows.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInPandas(run, FOUND)


def found_ids(df: DataFrame, row_id: str = "id", text: str = "raw_text") -> DataFrame:
    """id of every row that holds a credential, once."""
    return find_credentials(df, row_id, text).select("id").distinct()
