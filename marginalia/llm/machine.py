"""Files that nobody wrote by hand: generated, minified, data saved as code, and copies of third-party code.

Each file's tokens become a sequence of shapes (keywords, punctuation, line ends; identifiers, numbers and strings as
one shape each) over which a Re-Pair grammar is inferred. Hand-written code keeps a long grammar; code written by a
program or a minifier shrinks to a few rules that are used again and again; data is mostly literals. Over the tokens
themselves a second grammar is inferred from the reference collection of third-party files; the share of a file that
its long rules cover tells copies, also slightly changed ones. A header in the leading comments, and the folder, are
taken as evidence as well.

One scan: every file is judged in its task. Only the rules of the reference travel: they are inferred once, per piece of
the collection, of bounded size (PIECE_BYTES of text each), and kept in the checkpoint folder; AT_ONCE pieces are
broadcast together, and only for a larger collection are the files read again, once for each further AT_ONCE pieces.

Defined results: null paths are ignored; a null or empty text is judged by its path alone; a path walked twice comes
out once; texts are read whole; a null reference text is ignored; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.grammar import Rules, grammars, parse, shared_rules
from marginalia.llm.words import MEMORY, WordHashes, slices
from marginalia.plans.lineage import cut

#: Grammar length per token, and share of tokens under long rules, from which a file counts as written by a program.
#: Any text's grammar gets shorter per token as the text gets longer; the bound falls with the length beyond LONG_FILE tokens.
MOST_GRAMMAR = 0.36
LONG_FILE = 800
LEAST_REUSE = 0.60
#: Share of a file's characters in literals from which it counts as data, if its grammar per token is no longer than
#: MOST_FRAME or it has only FEW_WORDS names and keywords: code with one long literal is none.
LEAST_LITERAL = 0.60
MOST_FRAME = 0.42
FEW_WORDS = 12
#: Where most of these characters are strings, and at least BLOB of them, their own grammar decides: they are data if it has
#: at least DENSE symbols a character, or takes DENSE_BITS times the bits of the plain characters; prose has less of both.
BLOB = 400
DENSE = 0.93
DENSE_BITS = 1.1
#: Share of a file's tokens under shared rules of at least SHARED_RULE tokens from which it counts as a copy.
LEAST_SHARED = 0.50
SHARED_RULE = 16
#: Mean line length from which reuse counts as minified rather than generated.
LONG_LINES = 200
LEAST_TOKENS = 40
PIECE_BYTES = 8 << 20
AT_ONCE = 4
TOKENS_AT_ONCE = 400_000

JUDGED = "path STRING, generated BOOLEAN, minified BOOLEAN, data BOOLEAN, vendored BOOLEAN, grammar DOUBLE, reuse DOUBLE, literal DOUBLE, shared DOUBLE"

# Folders for foreign code, folders and suffixes of generated and bundled files.
FOREIGN = re.compile(
    r"(?:^|/)(?:node_modules|bower_components|jspm_packages|third[_-]?party|_?vendor|vendored|externals?|extern|site-packages|dist-packages|carthage/checkouts|pods|godeps)/",
    re.I,
)
WRITTEN = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.(?:generated|gen|g|auto|designer)\.\w+|[._](?:generated)\.\w+)$|(?:^|/)(?:__generated__|generated)/", re.I)
BUNDLED = re.compile(r"[.-](?:min|bundle|packed)\.\w+$", re.I)
# What generators say in the leading comments of their files.
HEADER = re.compile(
    r"""(?ix) @generated\b | <auto-?generated\b | \bauto-?generated\s*(?:file|code|by|from|:|$) | \b(?:code|file|source|this\ file\ (?:is|was)(?:\ automatically)?)\s+generated\b
      | ^\W*(?:automatically\ )?generated\s+(?:by|from|with)\b | \bmachine[- ](?:made|generated|written)\b | \bproduced\ by\s+\S+.*\bchanges\ will\ be\ lost | \bcreated\ by\s+\S.*\bon\s+\d{4}-\d\d-\d\d
      | \bdo\ not\ (?:edit|modify|change)\b(?!.*\bby\ hand,?\ (?:run|use)) | \b(?:manual\ )?changes?\s+(?:is|are|will\ be)\s+(?:overwritten|lost)
      | \bgénéré\s+(?:automatiquement|par)\b | \bne\ pas\ (?:le\ )?modifier\b | \b(?:automatisch|maschinell)\s+(?:erzeugt|erstellt|generiert)\b | \bnicht\ von\ hand\ (?:ändern|bearbeiten)
      | \bgenerado\s+(?:automáticamente|por)\b | \bno\ (?:editar|modificar)\b""",
    re.M,
)
_HAND = re.compile(r"(?i)maintained by hand|was (?:auto-?)?generated until|hand-?written|no longer generated")
_LEADING = re.compile(
    r"""(?x) \A (?: \s+ | \#[^\n]*(?:\n|\Z) | //[^\n]*(?:\n|\Z) | /\*.*?\*/ | [rRuU]?\"\"\".*?\"\"\" | [rRuU]?'''.*?''' | ["']use\ strict["'];? )*""", re.S
)
_PIECE = r"""
    \"{3}(?:\\.|[^\\])*?\"{3} | '{3}(?:\\.|[^\\])*?'{3} |
    "(?:\\.|[^"\\\n])*" | '(?:\\.|[^'\\\n])*' | `(?:\\.|[^`\\])*` | [^\W\d]\w* | \d[\w.]* | \n | [^\w\s]
"""
_PLAIN = re.compile(_PIECE, re.X | re.S)
#: A here-document is one literal.
_WITH_HERE = re.compile(r"""<<-?[ ]*['"]?(?P<tag>\w+)['"]?[^\n]*\n(?:[^\n]*\n)*?[ \t]*(?P=tag)(?=\s|\Z) |""" + _PIECE, re.X | re.S)
# Words that keep their own shape.
_KEYWORDS = frozenset(
    "def class return if else elif for while function const let var export import from async await static new echo local set then fi do done case esac in of try except catch throw raise with pass lambda module exports prototype this self".split()
)
_LITERAL_S, _LITERAL_N = 1, 2


class _Shapes(dict):
    """token -> number of its shape, the same in every process."""

    def __missing__(self, token: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        first = token[0]
        if len(token) > 1 and first in "\"'`<":
            value = _LITERAL_S
        elif first.isdigit():
            value = _LITERAL_N
        else:
            shape = "I" if (first.isalpha() or first == "_") and token not in _KEYWORDS else token
            value = xxhash.xxh64_intdigest(shape.encode("utf-8", "surrogatepass")) >> 2 | 4
        self[token] = value
        return value


def _is_word(token: str) -> bool:
    return token[0].isalpha() or token[0] == "_"


def tokens_of(text: str) -> list[str]:
    if "<<" in text:
        return [m[0] for m in _WITH_HERE.finditer(text)]
    return _PLAIN.findall(text)


def dense(texts: list[str]) -> np.ndarray:
    """Whether the Re-Pair grammar of each text's characters is hardly shorter than the text."""
    length = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 0xFFFFF
    owner = np.repeat(np.arange(len(texts)), length)
    g = grammars(symbols, owner, len(texts))
    letters = np.array([max(2, len(set(t))) for t in texts])
    enough = np.maximum(length, 1)
    return (g.size >= DENSE * enough) | (g.size * np.log2(letters + g.rules) >= DENSE_BITS * enough * np.log2(letters))


def has_header(text: str) -> bool:
    """Whether the comments before the first code say that a tool wrote the file."""
    head = _LEADING.match(text)[0]
    return any(HEADER.search(line) and not _HAND.search(line) for line in head.split("\n"))


def _judge(batch: pd.DataFrame, shapes: _Shapes, hashes: WordHashes, rules: list[list[Rules]], only_shared: bool) -> pd.DataFrame:
    """JUDGED for a batch of files. rules: of some pieces of the reference. only_shared: judge by the shared rules alone."""
    texts = [t or "" for t in batch["text"]]
    paths = batch["path"].tolist()
    tokens = [tokens_of(t) for t in texts]
    n = len(texts)
    length = np.array([len(x) for x in tokens], np.int64)
    owner = np.repeat(np.arange(n), length)
    flat = [t for x in tokens for t in x]
    chars = np.bincount(owner, weights=np.fromiter(map(len, flat), np.int64, len(flat)), minlength=n)
    shape = np.fromiter(map(shapes.__getitem__, flat), np.int64, len(flat))
    enough = np.maximum(length, 1)
    out = pd.DataFrame({"path": paths})
    if only_shared:
        out[["generated", "minified", "data", "vendored"]] = False
        out[["grammar", "reuse", "literal"]] = np.nan
    else:
        g = grammars(shape, owner, n)
        out["grammar"], out["reuse"] = g.size / enough, g.covered / enough
        literal = np.isin(shape, (_LITERAL_S, _LITERAL_N))
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        out["literal"] = np.bincount(owner, weights=size * literal, minlength=n) / np.maximum(chars, 1)
        lines = np.array([len(t) / (t.count("\n") + 1) for t in texts])
        repeats = (length >= LEAST_TOKENS) & (out["grammar"] <= MOST_GRAMMAR * np.minimum(1.0, (LONG_FILE / enough) ** 0.25)) & (out["reuse"] >= LEAST_REUSE)
        # Data is literals in a regular frame, or a literal with next to no words of code around it.
        words = np.bincount(owner, weights=~literal & (shape != shapes["\n"]) & np.fromiter(map(_is_word, flat), bool, len(flat)), minlength=n)
        out["data"] = (out["literal"] >= LEAST_LITERAL) & (out["grammar"] <= MOST_FRAME) | (out["literal"] >= 0.9) & (words <= FEW_WORDS) & (chars > 400)
        string = (shape == _LITERAL_S) & (out["literal"].to_numpy() >= LEAST_LITERAL)[owner]
        strings = [""] * n
        for i in np.unique(owner[string]).tolist():
            strings[i] = "".join(flat[j].strip("\"'`") for j in np.flatnonzero(string & (owner == i)))
        in_strings = np.array([len(t) for t in strings])
        asked = np.flatnonzero((in_strings >= BLOB) & (2 * in_strings > out["literal"] * chars))
        if len(asked):
            # Prose in a regular frame is a catalogue that somebody wrote; what can't be compressed is data in any frame.
            out.loc[asked, "data"] = dense([strings[i] for i in asked])
        out["minified"] = np.array([bool(BUNDLED.search(p)) for p in paths], bool) | (repeats & (lines >= LONG_LINES))
        header = np.array([bool(WRITTEN.search(p)) or has_header(t) for p, t in zip(paths, texts, strict=True)], bool)
        out["generated"] = header | (repeats & (lines < LONG_LINES) & ~out["data"])
        out["vendored"] = [bool(FOREIGN.search(p)) for p in paths]
    open_ = ~(out[["generated", "minified", "data", "vendored"]].any(axis=1).to_numpy())
    out["shared"] = 0.0
    if rules and open_.any():
        words = open_[owner] & (shape != shapes["\n"])
        at = np.flatnonzero(words)
        symbols = np.fromiter((hashes[flat[i]] for i in at), np.int64, len(at))
        covered = np.max([parse(symbols, owner[at], n, piece, SHARED_RULE) for piece in rules], axis=0)
        out["shared"] = covered / np.maximum(np.bincount(owner[at], minlength=n), 1)
        out["vendored"] |= (out["shared"] >= LEAST_SHARED) & (length >= LEAST_TOKENS)
    return out


_RULES = "round INT, pair BIGINT, symbol BIGINT, priority BIGINT, length BIGINT"


def reference_rules(reference: DataFrame, pieces: int) -> DataFrame:
    """The shared grammar of each piece of the reference collection (texts of a column `text`)."""

    def run(piece: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        words = [[t for t in tokens_of(x) if t != "\n"] for x in sorted(rows["text"])]
        symbols = np.fromiter((hashes[t] for x in words for t in x), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(x) for x in words])
        parts = [
            pd.DataFrame({"round": i, "pair": r.pairs.view(np.int64), "symbol": r.symbols, "priority": r.priority.view(np.int64), "length": r.lengths})
            for i, r in enumerate(shared_rules(symbols, owner))
        ]
        found = pd.concat(parts) if parts else pd.DataFrame(columns=["round", "pair", "symbol", "priority", "length"])
        return found.assign(piece=piece[0])

    texts = reference.where(F.length("text") > 0).select("text").distinct()
    placed = texts.withColumn("piece", F.pmod(F.xxhash64("text"), F.lit(pieces)).cast("int"))
    return placed.groupBy("piece").applyInPandas(run, _RULES + ", piece INT")


def _as_rules(rows: pd.DataFrame) -> list[Rules]:
    out = []
    for _, r in rows.groupby("round", sort=True):
        pairs = r["pair"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(pairs)
        out.append(Rules(pairs[order], r["symbol"].to_numpy(np.int64)[order], r["priority"].to_numpy(np.int64).view(np.uint64)[order], r["length"].to_numpy(np.int64)[order]))
    return out


def judge(files: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """JUDGED: the files that nobody wrote by hand, and why. Paths come out as often as they were judged so."""
    spark = files.sparkSession
    rows = files.where(F.col("path").isNotNull()).select("path", "text")
    pieces = 0
    if reference is not None:
        size = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        pieces = math.ceil(size / PIECE_BYTES)

    def one(first: int) -> DataFrame:
        pieces_now = range(first, min(first + AT_ONCE, pieces))
        sent = spark.sparkContext.broadcast([_as_rules(grammar.where(F.col("piece") == i).toPandas()) for i in pieces_now])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shapes, hashes = _Shapes(), WordHashes()
            for batch in batches:
                for a, b in slices([len(t or "") // 4 + 1 for t in batch["text"]], TOKENS_AT_ONCE):
                    found = _judge(batch.iloc[a:b].reset_index(drop=True), shapes, hashes, sent.value, first > 0)
                    flags = found[["generated", "minified", "data", "vendored"]].any(axis=1)
                    yield found[flags][[c.split()[0] for c in JUDGED.split(", ")]]

        return rows.mapInPandas(run, JUDGED)

    grammar = cut(reference_rules(reference, pieces)) if pieces else None
    return reduce(DataFrame.union, [one(i) for i in range(0, max(1, pieces), AT_ONCE)])


def machine_paths(files: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """path of every file that nobody wrote by hand, once."""
    return judge(files, reference).select("path").distinct()


def hand_written(files: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The rows of `files` that remain: hand-written source."""
    return files.join(machine_paths(files, reference), "path", "left_anti")
