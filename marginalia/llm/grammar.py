"""Re-Pair grammars of many token sequences at once, for use inside tasks.

In each round every sequence replaces pairs of neighbouring symbols that occur at least twice by a new symbol, most
frequent pairs first: a pair is replaced where it is more frequent than the pairs that overlap it (equal ones are
settled by a hash, runs of one pair from the left), until no pair is left that occurs twice. All sequences of a batch take
their rounds together, as arrays. A symbol's value is made from its pair alone, so a grammar depends on nothing but its
own sequence, however sequences are dealt out to batches.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from marginalia.llm.words import mix


class Grammars(NamedTuple):
    """Of each sequence: its length, the length of its grammar, rules, and tokens that long, often used rules cover."""

    length: np.ndarray
    size: np.ndarray
    rules: np.ndarray
    covered: np.ndarray


class Rules(NamedTuple):
    """One round of a shared grammar: sorted pairs with the symbol, priority and expanded length of each."""

    pairs: np.ndarray
    symbols: np.ndarray
    priority: np.ndarray
    lengths: np.ndarray


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64)) * np.uint64(3) + b.view(np.uint64))


def choose(priority: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which pairs to replace (0: none): those above both neighbours; in a run of one pair every second one."""
    n = len(priority)
    if not n:
        return np.zeros(0, bool)
    # Places in a run of equal pairs, counted from its left end.
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    odd = (np.arange(n) - start) % 2 == 1
    value = np.where(odd, 0, priority)
    left = np.concatenate([[0], value[:-1]])
    right = np.concatenate([value[1:], [0]])
    return (value > 0) & (value > left) & (value >= right) & ~((value == right) & (np.concatenate([keys[1:], [0]]) != keys))


def replace(symbols: np.ndarray, owner: np.ndarray, at: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and owners with each pair that begins in `at` replaced by one symbol."""
    out = symbols.copy()
    out[at] = by
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return out[keep], owner[keep]


def grammars(symbols: np.ndarray, owner: np.ndarray, count: int, least: int = 8, uses: int = 4) -> Grammars:
    """The Re-Pair grammar of each of `count` sequences: symbols with the sequence each belongs to.

    covered: tokens under rules of at least `least` tokens that their sequence uses at least `uses` times.
    """
    length = np.bincount(owner, minlength=count)
    rules = np.zeros(count, np.int64)
    covered = np.zeros(count, np.int64)
    expanded = np.ones(len(symbols), np.int64)
    done = np.zeros(len(symbols), bool)
    s, f = symbols.astype(np.int64), owner.astype(np.int64)
    while len(s) > 1:
        valid = f[:-1] == f[1:]
        pairs = pair_keys(s[:-1], s[1:])
        # Pairs are counted in each sequence by itself.
        keys = mix((f[:-1].astype(np.uint64) << np.uint64(1)) + np.uint64(1)) ^ pairs
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        n = counts[inverse]
        priority = np.where(valid & (n >= 2), (n.astype(np.uint64) << np.uint64(40)) + (pairs >> np.uint64(24)), np.uint64(0))
        taken = np.flatnonzero(choose(priority, keys))
        if not len(taken):
            break
        used = np.bincount(inverse[taken], minlength=len(counts))
        taken = taken[used[inverse[taken]] >= 2]
        if not len(taken):
            break
        made, at_rule = np.unique(inverse[taken], return_inverse=True)
        np.add.at(rules, f[taken[np.unique(at_rule, return_index=True)[1]]], 1)
        size = expanded[taken] + expanded[taken + 1]
        often = (used[inverse[taken]] >= uses) & (size >= least)
        inner = np.where(done[taken], expanded[taken], 0) + np.where(done[taken + 1], expanded[taken + 1], 0)
        np.add.at(covered, f[taken[often]], (size - inner)[often])
        new = pairs[taken].view(np.int64)
        keep = np.ones(len(s), bool)
        keep[taken + 1] = False
        s[taken] = new
        expanded[taken] = size
        done[taken] = often | (done[taken] & done[taken + 1])
        s, f, expanded, done = s[keep], f[keep], expanded[keep], done[keep]
    rest = np.bincount(f, minlength=count)
    return Grammars(length, rest + 2 * rules, rules, covered)


def shared_rules(symbols: np.ndarray, owner: np.ndarray) -> list[Rules]:
    """The grammar of a reference collection in which every sequence counts as seen twice, so that each of its phrases
    becomes a rule. A symbol's value is made from its pair, so that it means the same phrase everywhere."""
    s, f = symbols.astype(np.int64), owner.astype(np.int64)
    expanded = np.ones(len(s), np.int64)
    out: list[Rules] = []
    while len(s) > 1:
        keys = pair_keys(s[:-1], s[1:])
        keys = np.where(f[:-1] == f[1:], keys, np.uint64(0))
        pairs, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        priority = (np.minimum(counts, 1 << 20).astype(np.uint64) << np.uint64(40)) + (mix(pairs) >> np.uint64(24))
        priority = np.where(pairs == 0, np.uint64(0), priority)
        taken = np.flatnonzero(choose(priority[inverse], keys))
        if not len(taken):
            break
        made = np.zeros(len(pairs), bool)
        made[inverse[taken]] = True
        lengths = expanded[first] + expanded[np.minimum(first + 1, len(s) - 1)]
        out.append(Rules(pairs, np.where(made, pairs.view(np.int64), 0), priority, lengths))
        keep = np.ones(len(s), bool)
        keep[taken + 1] = False
        expanded[taken] += expanded[taken + 1]
        s[taken] = keys[taken].view(np.int64)
        s, f, expanded = s[keep], f[keep], expanded[keep]
    return out


def parse(symbols: np.ndarray, owner: np.ndarray, count: int, rules: list[Rules], least: int) -> np.ndarray:
    """Tokens of each of `count` sequences that shared rules of at least `least` tokens cover."""
    s, f = symbols.astype(np.int64), owner.astype(np.int64)
    expanded = np.ones(len(s), np.int64)
    for r in rules:
        if len(s) < 2:
            break
        keys = np.where(f[:-1] == f[1:], pair_keys(s[:-1], s[1:]), np.uint64(0))
        at = np.minimum(np.searchsorted(r.pairs, keys), len(r.pairs) - 1)
        known = (r.pairs[at] == keys) & (keys != 0)
        priority = np.where(known, r.priority[at], np.uint64(0))
        taken = np.flatnonzero(choose(priority, keys))
        taken = taken[r.symbols[at[taken]] != 0]
        if len(taken):
            keep = np.ones(len(s), bool)
            keep[taken + 1] = False
            expanded[taken] += expanded[taken + 1]
            s[taken] = keys[taken].view(np.int64)
            s, f, expanded = s[keep], f[keep], expanded[keep]
    return np.bincount(f, weights=np.where(expanded >= least, expanded, 0), minlength=count).astype(np.int64)
