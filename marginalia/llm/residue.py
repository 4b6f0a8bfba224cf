"""Template residue, filler and error-page text, found by a positive-unlabelled naive Bayes model.

A document is a row of passages (sentences and lines). Records that are, passage for passage, mostly a known notice, an
error line or an unfilled placeholder are trusted: their known passages are the positives, all other passages are
unlabelled. Naive Bayes over words, pairs of neighbouring words, shapes of placeholders, and a passage's place (its length,
its share of the record, the passages beside it, whether it goes on from the line before, capitals, quotes) is fitted by
expectation-maximization: posteriors of all passages, then weighted counts over all passages, both on the executors; only
tables of SIZE numbers travel. Text in back ticks or long quotes is one neutral token, so that documents which quote or
explain a notice give no evidence. No passage is positive by its pattern at the end: the model scores all of them alike,
and a record counts if a passage that stands as text itself reaches THRESHOLD.

Texts are read once: their tokens are kept as numbers in the checkpoint folder, the rounds read those.

Defined results: null and empty texts have no passages; rows without id give none; repeated ids come out once;
without any trusted record nothing is found; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import bisect
import http
import re
from collections.abc import Iterator, Mapping
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.words import MEMORY, slices
from marginalia.plans.lineage import cut

BUCKETS = 1 << 17
#: Numbers of a passage's place follow those of words and pairs.
PLACES = 64
SIZE = BUCKETS + PLACES
ROUNDS = 4
#: Share of a passage's posterior that counts for unlabelled passages, against 1 for trusted ones.
UNLABELLED_WEIGHT = 0.5
#: Weight, in tokens, of what is taken to be known beforehand: of the positive class that each word seen is as likely as
#: any other, so that only words which the corpus uses much count against it.
SMOOTHING = 300.0
THRESHOLD = 0.5
PRIOR = 0.001
#: Share of a record's passages that must be known forms for it to be trusted.
TRUSTED_SHARE = 0.5

# The words of the standard filler paragraph that no other language here has, and what HTTP calls its errors.
FILLER = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim
    veniam quis nostrud ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum
    fugiat nulla pariatur excepteur sint occaecat cupidatat proident officia deserunt mollit anim laborum""".split()
)
_REASON = "|".join(re.escape(s.phrase.lower()) for s in http.HTTPStatus if s >= 400)
_ERROR = r"(?:error|erreur|fehler|fout|errore|erro)"
_THING = r"(?:page|file|site|service|server|repository|resource|seite|dienst|página|servicio|serveur)"
_FIELD = r"(?:\{\{\s*[\w.]+\s*\}\}|\$\{[\w.]+\}|%%[\w.]+%%|<%=?\s*[\w.]+\s*%>|<insert\ [\w.]+\ here>|\[[a-z]+[_.][a-z_.]+\])"
# Forms of a passage that nobody writes as content: name, pieces of which a passage has one (in lower case), pattern.
SEEDS: dict[str, tuple[tuple[str, ...], str]] = {
    # errors and refusals
    "status line": (("40", "41", "42", "45", "50", "51"), rf"(?:http/?[\d.]*\s*)?(?:{_ERROR}\s+)?[45]\d\d\s*[-–:]?\s*(?:{_REASON})[.!]?"),
    "numbered error": (("err", "fehler", "fout"), rf"{_ERROR}\s+[45]\d\d\s?[:.-].+"),
    "error object": (("error", "message", "status"), r"\{\s*\"(?:status|code|error|message)\"\s*:.*\"(?:error|message|status)\"\s*:.*\}"),
    "error markup": (("<error", "<html"), r"<error>.*</error>|<html>.*<title>[45]\d\d\b.*"),
    "refusal": (("denied", "forbidden", "unauthor", "blocked", "verweigert", "denegado", "refus"), r"(?:access\ denied|permission\ denied|forbidden|unauthorized|(?:your\ )?request\ (?:was\ )?blocked|zugriff\ verweigert|acceso\ denegado|accès\ refusé)[.!]?"),
    "application error": (("err", "fehler", "fout"), rf"(?:an?\ |the\ )?(?:unexpected\ |internal\ |application\ |unhandled\ )*{_ERROR}(?:\ occurred|\s?:.*exception.*|\ establishing\ an?\ .*connection)[.!]?"),
    "not served": (("found", "available", "served", "reached", "disponible", "verfügbar", "erreichbar"), rf"(?=.*\b{_THING}\b)(?=.*\b(?:not|n'?t|no|nicht|temporarily|pas|could)\b)(?:the|this|that|la|le|el|der|die|diese)\b.*\b(?:found|available|unavailable|served|reached|disponible|verfügbar|erreichbar)\b[^\"`]*"),
    "server trouble": (("le serveur a", "went wrong", "oops"), r"le\ serveur\ a\ rencontré.*|something\ went\ wrong[.!]?|oops\b.*"),
    "cannot find": (("find",), r"(?:sorry,?\ )?we\ (?:can(?:no|['’])t|could\ ?n['o’]t)\ find\ (?:the\ |that\ |this\ )?page\b.*"),
    "session": (("expired", "to continue"), r"your\ session\ (?:has\ )?expired[.!]?|(?:please\ )?(?:sign|log)\ in\ (?:again\ )?to\ continue[.!]?"),
    "overload": (("many requests", "slow down", "try again"), r"too\ many\ requests[.!]?|please\ (?:slow\ down|try\ again\ later)\b.*"),
    "human check": (("moment,", "checking", "human"), r"(?:one\ moment,?\ )?checking\ (?:your\ browser|if\ the\ site)\b.*|one\ moment,.*|(?:please\ )?(?:verify|confirm)\ (?:that\ )?you\ are\ (?:a\ )?human\b.*"),
    "traceback": (("traceback", "line ", "error:", "exception:"), r"traceback\ \(most\ recent\ call\ last\):|file\ \"[^\"]+\",\ line\ \d+.*|\w+(?:error|exception):.*"),
    # notices that scripts are required
    "scripts needed": (("script",), r"(?=.*\b(?:you|please|sorry|this|the|your|allow|enable|needs?|requires?)\b)(?=.*\b(?:javascript|scripts?)\b)[^`\"]*"),
    "scripts needed elsewhere": (("script", "skript"), r"(?=.*\b(?:bitte|veuillez|activ\w+|est[ea]|cet(?:te)?|ce|diese[rs]?|aktiv\w+|habilit\w+|requiere|nécessite)\b)(?=.*\b(?:javascript|scripts?|skripten?)\b)[^`\"]*"),
    # filler
    "one word": ((), r"(\w{2,})(?:\s+\1){4,}[.!]?"),
    "keys tried": (("test", "abc def"), r"(?:test(?:ing)?\b[\s\d,.]*){2,}|abc\ def(?:\ \w{3})*"),
    "copy to come": (("text", "copy", "content"), r"(?:this\ is\ )?(?:placeholder|dummy|sample|filler)\ (?:copy|text|content)[.!]?|(?:the\ )?real\ content\ (?:will\ follow|goes\ here)[.!]?"),
    "text here": (("here",), r"(?:your|add|insert|put|enter)\ (?:\w+\ )*(?:text|content|title|name|description)\ (?:goes\ )?here[.!]?"),
    "copy to come elsewhere": (("text",), r"(?:beispiel|platzhalter|blind)text\b.*|texte\ (?:provisoire|à\ remplacer|de\ remplissage)\b.*|texto\ (?:de\ (?:relleno|ejemplo)|provisional)\b.*"),
    "first page": (("this is your first", "edit or delete"), r"this\ is\ your\ first\ (?:page|post)[.!]?|edit\ or\ delete\ it,\ then\ start\ writing[.!]?"),
    # placeholders
    "to replace": (("todo",), r"todo:?\ (?:replace|describe|write|fill|add)\b[^`\"]*"),
    "bracket": (("[",), r"\[(?:insert|your|add|enter|title|titel|titre|título|name|nom|nombre|beschreibung|description|version|author)\b[^\]]*\](?:[\w\s]*\[[^\]]+\])*[.!]?"),
    "angle": (("<",), r"<[^<>]+\ (?:à\ compléter|à\ remplir|einfügen|eintragen|aquí|here)>"),
    "date form": (("dd", "tt", "jj"), r"(?:\w+:\s*)?(?:dd|tt|jj)[/.](?:mm)[/.](?:yyyy|jjjj|aaaa)"),
    "to nobody": (("name",), r"(?:dear|hello|hi|bonjour|hola|hallo)\ (?:first\ ?name|last\ ?name|customer\ ?name|user\ ?name)\b.*"),
    "no value": (("undefined", "null", "nan"), r"(?=.*\b(?:undefined|null|nan)\b\W+(?:\w+\W+)?(?:undefined|null|nan)\b)[^`\"]*"),
    "field": (("{", "%%", "<", "["), rf"(?=[^`\"=;]*{_FIELD})[^`\"=;]*"),
}

# Tokens leave nothing of a text out, so that their lengths give their places: words, ends, quotes and placeholders, numbers and
# signs, each but an end with a blank after it; and gaps, which say nothing. Words are tried first, and by their ASCII letters, as
# most tokens are such words. A stop is an end if a blank follows, else a gap: _gaps.
_TOKEN = re.compile(
    r"""[A-Za-z]+[^\W\d_]*\ ? | \n | [.!?]+(?=\s|$)
      | (?: `[^`\n]+` | "[^"\n]*" | «[^»\n]*» | „[^“\n]*“ | “[^”\n]*”
          | \$\{[^}\n]{1,40}\} | \{\{[^}\n]{1,40}\}\} | \{%[^%\n]{1,40}%\} | %%[\w.]{1,40}%% | <%[^%\n]{1,40}%> | <[A-Za-z/!][^<>\n]{0,60}> | \[[^\]\n]{1,60}\]
          | [^\W\d_]+ | \d+ | [^\w\s.!?] )\ ?
      | [^\S\n]+ | [.!?]+ | _+""",
    re.X,
)
_SPACES = re.compile("[\u00a0\u2000-\u200a\u202f\u205f\u3000]")
#: A passage without any of these characters, and without these words at its start, stands as text; the others are asked one by one.
_SUSPECT = re.compile(r"[`\"“«„;{=(]")
_CODE = ("def", "const", "let", "var", "function", "return", "if", "for", "export", "import", "echo")
_QUOTATION = re.compile(r"[\"“«„][^\"”»“\n]*\s[^\"”»“\n]*\s[^\"”»“\n]*[\"”»“]")
_STATEMENT = re.compile(rf"(?:{'|'.join(_CODE)})\b")
_ASSIGNS = re.compile(r"\w\s*\+?=\s*\S")
_CALLS = re.compile(r"\w\(\w*\)")
_END, _STOP, _QUOTED, _NUMBER = 0, 1, 2, 3
#: Numbers of placeholder shapes, and the first number of words.
_SHAPES, _WORDS = 4, 1028
#: Added to the number of a word in capitals.
_CAPITALS = 1 << 24
#: Added to the numbers of tokens with a suspect character, of words that tell code, of tokens with a piece of a known form, of gaps,
#: and of gaps that are blanks. Only marks are made of them; what is kept of a number is below _CAPITALS.
_HAS_SUSPECT, _IS_CODE, _HAS_CUE, _GAP, _BLANK = 1 << 25, 1 << 26, 1 << 27, 1 << 28, 1 << 29
#: Characters that are tokenized and marked together, and tokens whose passages are.
_TOGETHER, _TOKENS_TOGETHER = 1_000_000, 300_000
_TOKENS = "doc_id BIGINT, tokens BINARY, trusted BINARY, standing BINARY, places BINARY"
# Numbers of a passage's place: by length, passages of the record, share of the record; then single traits.
_BY_LENGTH, _BY_COUNT, _BY_SHARE, _HOLDS_FIELD, _HOLDS_QUOTE, _HOLDS_CAPITALS, _GOES_ON, _NO_TEXT, _NONE = 0, 8, 16, 24, 25, 26, 27, 28, 63
_TRAITS = 8


def _cues(seeds: Mapping[str, tuple[tuple[str, ...], str]]) -> dict[str, set[int]]:
    """The forms that each piece of text may belong to; -1 is the filler paragraph."""
    of: dict[str, set[int]] = {}
    for i, (cues, _) in enumerate(seeds.values()):
        for cue in cues:
            of.setdefault(cue, set()).add(i)
    for word in FILLER:
        if len(word) >= 5:
            of.setdefault(word, set()).add(-1)
    return of


class TokenIds(dict):
    """token -> number; the shape decides for quotes, numbers and placeholders."""

    def __init__(self, seeds: Mapping[str, tuple[tuple[str, ...], str]] = SEEDS) -> None:
        super().__init__()
        # Letters in a row, and digits, stand in one token, which so tells of a cue. Not so if a cue is all gaps, or may go over the end of
        # a passage: then any token may belong to it.
        pieces = [[] if re.search(r"[\n.!?]", cue) else re.findall(r"[^\W\d_]+|\d+|[^\w\s]", cue) for cue in _cues(seeds)]
        self.anywhere = not all(pieces)
        self.pieces = ahocorasick.Automaton()
        for piece in filter(None, pieces):
            self.pieces.add_word(max(piece, key=len), True)
        self.pieces.make_automaton()

    def __missing__(self, token: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        value = self[token] = self[token[:-1]] if token[-1] == " " and not token.isspace() else self._number(token)
        return value

    def _number(self, token: str) -> int:
        first = token[0]
        if first == "\n":
            return _END
        if first in ".!?":
            return _STOP
        if first == "_" or first.isspace():
            return _GAP + _NUMBER + (0 if first == "_" else _BLANK)
        if first in "`«„“" or first == '"' and token.count(" ") >= 2:
            value = _QUOTED
        elif first.isdigit():
            value = _NUMBER if not (len(token) == 3 and first in "45") else self._bucket("4xx")
        elif len(token) > 2 and first in "${%<[":
            value = _SHAPES + xxhash.xxh64_intdigest(re.sub(r"\w+", "w", token).encode("utf-8", "surrogatepass")) % (_WORDS - _SHAPES)
        else:
            value = self._bucket(token.lower()) + (_CAPITALS if len(token) > 3 and token.isupper() else 0)
        value += _HAS_SUSPECT if _SUSPECT.search(token) else 0
        value += _IS_CODE if token in _CODE else 0
        return value + (_HAS_CUE if self.anywhere or next(self.pieces.iter(token.lower()), False) else 0)

    @staticmethod
    def _bucket(text: str) -> int:
        return _WORDS + xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) % (BUCKETS - _WORDS)


def _standing(passage: str) -> bool:
    """Whether a passage can stand as text itself: not code, not a quotation or explanation of something else."""
    text = passage.strip()
    marked = text.startswith(("{", "<"))
    if "`" in text or not marked and _QUOTATION.search(text):
        return False
    return bool(marked or not (text.endswith((";", "{")) or _STATEMENT.match(text) or "=" in text and _ASSIGNS.search(text) or "(" in text and _CALLS.search(text)))


def _bounds(raw: str, words: list[str], ends: np.ndarray) -> list[int]:
    """Where the passages of a text end: after its tokens number `ends`, and at its end."""
    return [*np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))[ends].tolist(), len(raw)]


class Known:
    """The known forms, found by their pieces with one automaton."""

    def __init__(self, seeds: Mapping[str, tuple[tuple[str, ...], str]] = SEEDS) -> None:
        self.forms = [re.compile(form, re.I | re.S | re.X) for _, form in seeds.values()]
        of = _cues(seeds)
        self.everywhere = {i for i, (cues, _) in enumerate(seeds.values()) if not cues}
        self.automaton = ahocorasick.Automaton()
        for cue, forms in of.items():
            self.automaton.add_word(cue, forms)
        self.automaton.make_automaton()

    def suspects(self, raw: str, bounds: list[int], repeats: set[int]) -> dict[int, set[int]]:
        """The forms that each passage may have. repeats: passages in which a word repeats."""
        low = raw.lower()
        if len(low) != len(raw):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in raw)
        out = {i: set(self.everywhere) for i in repeats}
        for end, forms in self.automaton.iter(low):
            i = bisect.bisect_right(bounds, end)
            if i in out:
                out[i] |= forms
            else:
                out[i] = set(forms)
        return out

    def is_known(self, passage: str, forms: set[int]) -> bool:
        """Whether a passage has a form that nobody writes as content."""
        text = passage.strip().lstrip("#>*- \t")
        if -1 in forms:
            words = re.findall(r"[^\W\d_]+", text.lower())
            if len(words) >= 3 and 3 * sum(w in FILLER for w in words) > len(words):
                return True
        return any(self.forms[i].fullmatch(text) for i in forms if i >= 0)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)


def _passage_of(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The passage of each token of a batch; lengths: tokens of each text. A text has a passage more than ends."""
    ends = tokens <= _STOP
    return np.cumsum(ends) - ends + np.repeat(np.arange(len(lengths)), lengths)


def _gaps(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The tokens that say nothing: blanks, underscores, and stops inside of something. lengths: tokens of each text."""
    plain, blank = numbers & (_CAPITALS - 1), (numbers & _BLANK) > 0
    before_blank = np.zeros(len(numbers), bool)
    before_blank[:-1] = blank[1:] | (plain[1:] == _END)
    before_blank[np.cumsum(lengths)[lengths > 0] - 1] = True
    return (numbers & _GAP > 0) | (plain == _STOP) & ~before_blank


def _repeats(numbers: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Passages in which a word stands five times in a row."""
    same = (numbers[1:] == numbers[:-1]) & (numbers[1:] & (_CAPITALS - 1) >= _WORDS)
    return passage[np.flatnonzero(same[3:] & same[2:-1] & same[1:-2] & same[:-3])]


def _marks(raw: str, words: list[str], numbers: np.ndarray, known: Known, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each passage of texts: whether it is trusted, and whether it stands as text.

    raw, words, numbers: of one text, or of texts one after the other, with lengths the tokens of each.
    """
    lengths = np.array([len(words)]) if lengths is None else lengths
    kept = np.flatnonzero(~_gaps(numbers, lengths))
    ends = kept[numbers[kept] & (_CAPITALS - 1) <= _STOP]
    lasts = np.cumsum(lengths)
    counts = np.bincount(np.searchsorted(lasts, ends, "right"), minlength=len(lengths)) + 1
    text, first = np.repeat(np.arange(len(counts)), counts), _starts(counts)
    # Passage i holds the tokens, and the characters, from borders i to i + 1.
    borders = np.concatenate([[0], np.sort(np.concatenate([ends + 1, lasts]))])
    bounds = [0, *_bounds(raw, words, borders[1:-1] - 1)]
    passage = lambda i: raw[bounds[i] : bounds[i + 1]]
    trusted, stands = np.zeros(len(text), np.uint8), np.ones(len(text), np.uint8)
    own, numbers = np.searchsorted(borders[1:], kept, "right"), numbers[kept]
    flags = lambda flag: own[numbers & flag > 0]

    filled = np.bincount(own[numbers & (_CAPITALS - 1) > _STOP], minlength=len(text)) > 0
    least = TRUSTED_SHARE * np.bincount(text[filled], minlength=len(counts))
    maybe, repeats = np.zeros(len(text), bool), np.zeros(len(text), bool)
    repeats[_repeats(numbers, own)] = True
    maybe[flags(_HAS_CUE)] = True
    number = np.bincount(text[(maybe | repeats) & filled], minlength=len(counts))
    # A record is trusted if most of its passages are known forms.
    for t in np.flatnonzero((number > 0) & (number >= least)).tolist():
        a, b = first[t], first[t] + counts[t]
        start = bounds[a]
        inside = known.suspects(raw[start : bounds[b]], [x - start for x in bounds[a + 1 : b + 1]], set(np.flatnonzero(repeats[a:b]).tolist()))
        suspects = {a + i: forms for i, forms in inside.items() if filled[a + i]}
        if len(suspects) >= least[t]:
            found = [i for i, forms in suspects.items() if known.is_known(passage(i), forms)]
            if len(found) >= least[t]:
                trusted[found] = 1

    ask = np.zeros(len(text), bool)
    ask[flags(_HAS_SUSPECT)] = True
    # Of these words only a passage's first tells code.
    begins = np.flatnonzero(np.diff(own, prepend=-1))
    ask[own[begins[numbers[begins] & _IS_CODE > 0]]] = True
    for i in np.flatnonzero(ask).tolist():
        stands[i] = _standing(passage(i))
    return trusted, stands


def _places(tokens: np.ndarray, capitals: np.ndarray, lengths: np.ndarray, counts: np.ndarray, stands: np.ndarray) -> np.ndarray:
    """_TRAITS numbers for each passage of a batch."""
    n = int(counts.sum())
    passage = _passage_of(tokens, lengths)
    text = np.repeat(np.arange(len(counts)), counts)
    word = tokens > _STOP
    size = np.bincount(passage[word], minlength=n)
    has = lambda which: np.bincount(passage[which], minlength=n) > 0
    filled = np.bincount(text[size > 0], minlength=len(counts))
    share = size / np.maximum(np.bincount(text, weights=size, minlength=len(counts)), 1)[text]
    # A line without an end goes on in the next, unless that leaves its heading, list item or quotation.
    begins = np.zeros(n, np.int64)
    at = np.flatnonzero(word)[::-1]
    begins[passage[at]] = tokens[at]
    broken = np.zeros(n, bool)
    line = np.flatnonzero((tokens == _END)[1:] & (tokens[:-1] >= _WORDS)) + 1
    broken[passage[line]] = True
    marked = np.isin(begins, [TokenIds._bucket(x) for x in "#-*>|"])
    same = np.concatenate([[False], (begins[1:] == begins[:-1]) | ~marked[:-1]])[:n]
    goes_on = np.concatenate([[False], broken[:-1]])[:n] & same & np.concatenate([[False], text[1:] == text[:-1]])[:n]
    flag = lambda on, number: np.where(on, number, _NONE)
    return np.stack(
        [
            _BY_LENGTH + np.searchsorted([1, 3, 6, 10, 16], size, "right"),
            _BY_COUNT + np.searchsorted([2, 3, 5, 9], filled, "right")[text],
            _BY_SHARE + np.minimum((share * 5).astype(np.int64), 4),
            flag(has((tokens >= _SHAPES) & (tokens < _WORDS)), _HOLDS_FIELD),
            flag(has(tokens == _QUOTED), _HOLDS_QUOTE),
            flag(has(capitals), _HOLDS_CAPITALS),
            flag(goes_on, _GOES_ON),
            flag(~stands, _NO_TEXT),
        ],
        axis=1,
    ).astype(np.uint8)


def tokenize(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", seeds: Mapping[str, tuple[tuple[str, ...], str]] = SEEDS) -> DataFrame:
    """doc_id, tokens (4-byte numbers), trusted and standing (one byte for each passage), places (_TRAITS bytes for each)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, known = TokenIds(seeds), Known(seeds)
        for batch in batches:
            for start, stop in slices(batch["text"].str.len().tolist(), _TOGETHER):
                part = batch.iloc[start:stop]
                raws = [raw if raw.isascii() else _SPACES.sub(" ", raw) for raw in part["text"]]
                found = [_TOKEN.findall(raw) for raw in raws]
                lengths = np.array([len(x) for x in found], np.int64)
                words = list(chain.from_iterable(found))
                numbers = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
                trusted, stands = _marks("".join(raws), words, numbers, known, lengths)
                kept = ~_gaps(numbers, lengths)
                lengths = np.bincount(np.repeat(np.arange(len(raws)), lengths)[kept], minlength=len(raws))
                numbers = numbers[kept]
                tokens = numbers & (_CAPITALS - 1)
                counts = np.bincount(np.repeat(np.arange(len(raws)), lengths)[tokens <= _STOP], minlength=len(raws)) + 1
                places = _places(tokens, numbers & _CAPITALS > 0, lengths, counts, stands > 0)
                by_text, by_passage = _starts(lengths)[1:], _starts(counts)[1:]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "tokens": [x.tobytes() for x in np.split(tokens, by_text)],
                        "trusted": [x.tobytes() for x in np.split(trusted, by_passage)],
                        "standing": [x.tobytes() for x in np.split(stands, by_passage)],
                        "places": [x.tobytes() for x in np.split(places, by_passage)],
                    }
                )

    rows = documents.where(F.col(doc_id).isNotNull() & (F.length(text) > 0))
    return rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, _TOKENS)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in parts of some texts, whose arrays are small enough to be made again in the same memory."""
    for batch in batches:
        for start, stop in slices([len(x) // 4 for x in batch["tokens"]], _TOKENS_TOGETHER):
            yield batch.iloc[start:stop]


def _passages(batch: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Of a batch: the number of each word, pair and trait, the passage of each, marks of the passages, and their documents."""
    tokens = np.frombuffer(b"".join(batch["tokens"]), np.int32)
    lengths = np.array([len(x) // 4 for x in batch["tokens"]], np.int64)
    marks = np.frombuffer(b"".join(batch["trusted"]), np.uint8).astype(bool)
    stands = np.frombuffer(b"".join(batch["standing"]), np.uint8).astype(bool)
    traits = np.frombuffer(b"".join(batch["places"]), np.uint8).reshape(-1, _TRAITS)
    counts = np.array([len(x) for x in batch["trusted"]], np.int64)
    passage = _passage_of(tokens, lengths)
    word = tokens > _STOP
    pair = np.flatnonzero(word[:-1] & word[1:] & (passage[:-1] == passage[1:]))
    word = np.flatnonzero(word)
    # BUCKETS is a power of two, so that what runs over 32 bits changes nothing.
    low = tokens.astype(np.uint32)
    pairs = (low[:-1] * np.uint32(0x9E3779B1) + low[1:] * np.uint32(0x85EBCA6B)) & np.uint32(BUCKETS - 1)
    in_words = passage[word]
    some = np.zeros(len(traits), bool)
    some[in_words] = True
    at = np.flatnonzero((traits != _NONE) & some[:, None])
    buckets = np.concatenate([tokens[word], pairs[pair], BUCKETS + traits.ravel()[at].astype(np.int64)], dtype=np.int64)
    return buckets, np.concatenate([in_words, passage[pair], at // _TRAITS]), marks, stands, np.repeat(np.arange(len(batch)), counts)


def _posterior(buckets: np.ndarray, passage: np.ndarray, n: int, model: np.ndarray) -> np.ndarray:
    """The posterior of each of n passages."""
    score = np.bincount(passage, weights=model[buckets], minlength=n) + np.log(PRIOR / (1 - PRIOR))
    # A passage without words says nothing.
    score[np.bincount(passage, minlength=n) == 0] = -50
    return 1 / (1 + np.exp(-np.clip(score, -50, 50)))


def _totals(tokens: DataFrame) -> pd.DataFrame:
    """bucket, n, trusted: how often each word, pair or trait occurs, in all passages and in trusted ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, trusted = np.zeros(SIZE), np.zeros(SIZE)
        for batch in _parts(batches):
            buckets, passage, marks, _, _ = _passages(batch)
            n += np.bincount(buckets, minlength=SIZE)
            trusted += np.bincount(buckets[marks[passage]], minlength=SIZE)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": n[some], "trusted": trusted[some]})

    return tokens.mapInPandas(run, "bucket INT, n DOUBLE, trusted DOUBLE").groupBy("bucket").sum("n", "trusted").toPandas()


def _expected(tokens: DataFrame, model: object) -> pd.DataFrame:
    """bucket, n: how often each occurs in positive passages, by their posteriors under the broadcast model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SIZE)
        for batch in _parts(batches):
            buckets, passage, marks, stands, _ = _passages(batch)
            p = _posterior(buckets, passage, len(marks), model.value)
            p = np.where(marks, 1.0, np.where((p > 1e-3) & stands, p * UNLABELLED_WEIGHT, 0))
            n += np.bincount(buckets, weights=p[passage], minlength=SIZE)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": n[some]})

    return tokens.mapInPandas(run, "bucket INT, n DOUBLE").groupBy("bucket").sum("n").toPandas()


def log_odds(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What each word, pair or trait says for the positive class; nothing if it never occurs."""
    seen = total > 0
    share, even = total / max(total.sum(), 1), seen / SIZE
    negative = np.maximum(total - positive, 0)
    ratio = (positive + SMOOTHING * even) / (positive.sum() + SMOOTHING) / np.where(seen, (negative + SMOOTHING * share) / (negative.sum() + SMOOTHING), 1)
    return np.where(seen, np.log(np.where(seen, ratio, 1)), 0.0)


def fit(tokens: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The log odds of SIZE words, pairs and traits, by expectation-maximization over all passages."""
    spark = tokens.sparkSession
    found = _totals(tokens)
    total, positive = np.zeros(SIZE), np.zeros(SIZE)
    total[found["bucket"]] = found["sum(n)"]
    positive[found["bucket"]] = found["sum(trusted)"]
    if not positive.any():
        return np.full(SIZE, -50.0)
    model = log_odds(positive, total)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        found = _expected(tokens, sent)
        positive = np.zeros(SIZE)
        positive[found["bucket"]] = found["sum(n)"]
        model = log_odds(positive, total)
        sent.unpersist()
    return model


def score(tokens: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, passage, p of the passages that are residue: likely under the model, and standing as text."""
    sent = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            buckets, passage, marks, stands, owner = _passages(batch)
            p = _posterior(buckets, passage, len(marks), sent.value)
            first = np.searchsorted(owner, owner)
            hit = np.flatnonzero((p >= THRESHOLD) & stands)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[owner[hit]], "passage": (hit - first[hit]).astype(np.int32), "p": p[hit]})

    return tokens.mapInPandas(run, "doc_id BIGINT, passage INT, p DOUBLE")


def residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, seeds: Mapping[str, tuple[tuple[str, ...], str]] = SEEDS) -> DataFrame:
    """doc_id, passages: the documents that hold residue, and how many passages of it."""
    tokens = cut(tokenize(documents, doc_id, text, seeds))
    return score(tokens, fit(tokens, rounds)).groupBy("doc_id").agg(F.countDistinct("passage").alias("passages"))
