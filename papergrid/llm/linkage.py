"""Matching citation texts with bibliographic rows that share no dependable key, by soft logic.

Rows with one title form a family. Blocking keys are three words of the title in a row, or with a
word left out, and volume with first page and year. A text gives all its keys; a family gives all keys of numbers
and those ``RAREST`` keys of its title that the fewest families have, by an exact count, so every title
with three words has keys whatever its words, and a phrase that many titles share stands for none that
has anything rarer. Keys travel as packed arrays in buckets whose number follows the number of rows.

Each text and row of a candidate family get the truth values of a few predicates: how much of the
title stands in the text, whether pages, volume, year, first author and journal agree or
contradict, and whether the text names a part, reply or correction that the row isn't. Weighted
hinge rules turn these into support for and against a match. That two rows are of one publication is a
variable of its own, shared by all texts that meet both rows: evidence in their fields bears on it, exclusivity
(a text cites one publication, and the one it shows best) and transitivity (rows of one publication match together) tie it to
the texts' pairs. The convex problem is solved by alternating directions (ADMM): a task minimises the blocks
of the texts it holds, until the residuals vanish; identities that stand in several tasks get their copies
agreed on by consensus rounds. Values give the confidence; a match has 0.5 or more, rounded to two places.
A small quadratic term makes the minimum unique, so ties are settled towards no match.

Defined results: a null or blank text, and a row without title and numbers, match nothing;
repeated rows are scored once each; a null id gives no row. A title of less than three words that are
neither light, numbers nor shorter than three letters has no key of its own: its rows are met by volume and page.
"""

from __future__ import annotations

import gc
import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papergrid.workspace import stage, tasks

#: Words without weight in titles and in blocking keys.
LIGHT = frozenset("a an and as at by does during for from in into is its of on or s the to versus via with vs".split())
#: Words that say that a text is about another publication.
MARKERS = ("editorial", "erratum", "corrigendum", "correction", "retraction", "reply", "response", "comments", "results", "update")
#: Places of the words of a title key, from its first word; number of a family's title keys.
PATTERNS, RAREST = ((0, 1, 2), (0, 1, 3)), 3
#: Rows of either table for a bucket of keys; most rows of a family's chunk; texts of a solving group.
BUCKET_ROWS, FAMILY_MOST, GROUP_TEXTS = 10_000, 64, 2_000
#: Texts and families in the samples that show which keys are hot, and the share of a sample from which on they are. Hot keys of texts are spread over all buckets.
SAMPLE, HOT = 5_000, 0.005
#: Rule weights: support by title and by numbers; against by missing title words, contradictions and markers; prior; ties; identity of rows.
WEIGHTS = {
    "title": 3.0, "numbers": 3.0, "missing": 2.0, "page": 6.0, "marker": 6.0, "volume": 2.0, "year": 1.0, "author": 1.5, "journal": 1.0,
    "extra": 1.6, "prior": 0.6, "exclusive": 4.0, "together": 4.0, "cited": 12.0, "outdone": 3.0, "same": 6.0, "differ": 12.0, "own": 0.2,
}
#: Weight of the quadratic term, and what the residuals of a task's problem and of the consensus must fall below.
CONVEX, TOLERANCE, AGREED = 0.02, 2e-6, 0.05
#: Strength with which a copy of an identity is drawn to the mean.
DRAW = 12.0
#: Rows of a text's block that every other row of it has rules with; all rows have rules with each other up to this number.
ANCHORS = 64
MATCH = 0.5

_SPLIT = re.compile(r"[^0-9a-zα-ω]+")
_TAG = re.compile(r"</?[a-zA-Z]{1,6}>")
_TAIL_WORDS = ("google scholar", "crossref", "pubmed", "view in article")
_PLAIN_WORD, _CAPITAL_WORD = re.compile(r"(?<![A-Za-z])[a-z]{4,}(?![A-Za-z])"), re.compile(r"(?<![A-Za-z])[A-Z]{4,}(?![A-Za-z])")
_HEAD = re.compile(r"^\s*(?:[*•-]\s*)?(?:[\[(]?\d{1,3}[\]).]\s*)+")
_LINK, _FREE = re.compile(r"\bdoi:?\s*\S+|https?://\S+"), re.compile(r"\[?free full text\]?")


#: Frequent signs that only part words, so that most texts have no other than ASCII left.
_SIGNS = "–“”‐‑‘—"


def _parted(text: str) -> str:
    """Without accents, soft hyphens, apostrophes and tags, in the case given."""
    if not text.isascii():
        text = text.replace("\xad", "").replace("’", "")
    text = text.replace("'", "")
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        for sign in _SIGNS:
            text = text.replace(sign, " ")
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        for c in set(text):
            if c > "\x7f" and unicodedata.combining(c):
                text = text.replace(c, "")
    return text


def fold(text: str) -> str:
    """Lower case without accents, soft hyphens and apostrophes."""
    return _parted(text).lower()


_forms: dict[str, str] = {}
#: Bytes of ASCII in lower case, blanks where words are parted.
_ASCII = bytes(ord(c.lower()) if (c := chr(b)).isascii() and c.isalnum() else 32 for b in range(256))


def words(text: str) -> list[str]:
    """Words in one form for both sides: misread 1 and 0 inside words are l and o."""
    text = _parted(text)
    raw = text.encode().translate(_ASCII).decode().split() if text.isascii() else [w for w in _SPLIT.split(text.lower()) if w]
    try:
        return [_forms[w] for w in raw]
    except KeyError:
        if len(_forms) > 500_000:
            _forms.clear()
        for w in raw:
            _forms[w] = w if w.isalpha() or w.isdigit() else w.replace("1", "l").replace("0", "o")
        return [_forms[w] for w in raw]


_known: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _known.get(word)
    if h is None:
        import xxhash

        if len(_known) > 500_000:
            _known.clear()
        h = _known[word] = xxhash.xxh3_64_intdigest(word)
    return h


_in_key: dict[str, int] = {}


def _in_keys(tokens: list[str]) -> list[int]:
    """Hashes of the words that stand in title keys."""
    try:
        return [h for t in tokens if (h := _in_key[t])]
    except KeyError:
        if len(_in_key) > 500_000:
            _in_key.clear()
        for t in tokens:
            _in_key[t] = _hash(t) if len(t) > 2 and t not in LIGHT and not t.isdigit() else 0
        return [h for t in tokens if (h := _in_key[t])]


def _mix(*parts: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys of parts in order."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = h * np.uint64(0x9E3779B97F4A7C15) + p
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _surname(author: str | None) -> str:
    """The last part of the family name in 'Family, Given' and 'Family AB'."""
    if not author or not author.strip():
        return ""
    name = author.split(",")[0].strip()
    parts = name.split()
    if "," not in author and len(parts) > 1 and parts[-1].isupper():
        parts = parts[:-1]
    own = words(parts[-1]) if parts else []
    return "".join(own)


def _shown(text: str) -> tuple[list[str], list[str], list[str]]:
    """Words, years and other numbers that a citation text shows."""
    text = text.lower()
    if "doi" in text or "http" in text:
        text = _LINK.sub(" ", text)
    if "free full text" in text:
        text = _FREE.sub(" ", text)
    for tail in _TAIL_WORDS:
        if tail in text:
            text = text.replace(tail, " ")
    if head := _HEAD.match(text):
        text = text[head.end() :]
    tokens = words(text)
    numbers = [t for t in tokens if t.isdigit()]
    years = list(dict.fromkeys([t for t in numbers if len(t) == 4 and t[:2] in ("19", "20")]))
    return tokens, years, numbers


#: Stand-ins for a year in keys: the row has none; the text has none.
_NO_YEAR, _ANY_YEAR = 1, 2


def _word_keys(runs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the item, key), each once, of the words in PATTERNS."""
    flat, owner = np.fromiter(chain.from_iterable(runs), np.uint64), np.repeat(np.arange(len(runs)), [len(w) for w in runs])
    items, keys = [], []
    for pattern in PATTERNS:
        reach = pattern[-1]
        at = np.flatnonzero(owner[: max(len(owner) - reach, 0)] == owner[reach:])
        items.append(owner[at])
        keys.append(_mix(*(flat[at + k] for k in pattern)))
    item, key = np.concatenate(items), np.concatenate(keys)
    # Only words that come again can make a key twice.
    again = np.fromiter((len(set(w)) < len(w) for w in runs), bool, len(runs))[item]
    if not again.any():
        return item, key
    some, of = item[again], key[again]
    order = np.lexsort((of, some))
    some, of = some[order], of[order]
    new = np.ones(len(some), bool)
    new[1:] = (some[1:] != some[:-1]) | (of[1:] != of[:-1])
    return np.concatenate([item[~again], some[new]]), np.concatenate([key[~again], of[new]])


def _number_keys(triples: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the item, key) of (place, volume, page, year)."""
    at = np.array([t[0] for t in triples], np.int64)
    return at, _mix(*(np.array([t[k] for t in triples], np.uint64) for k in (1, 2, 3))) if triples else np.zeros(0, np.uint64)


def text_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of citation texts: of words, and of each two numbers up to two places apart with the years shown and with that of rows without one."""
    runs, pairs, years, n_pairs, n_years = [], [], [], [], []
    for text in texts:
        tokens, shown, every = _shown(text)
        runs.append(_in_keys(tokens))
        plain = [_hash(n) for n in every if n not in shown or every.count(n) > 1]
        own = {*zip(plain, plain[1:]), *zip(plain, plain[2:])}
        dates = [*map(_hash, shown), _NO_YEAR] if shown else [_ANY_YEAR]
        pairs += own
        years += dates
        n_pairs.append(len(own))
        n_years.append(len(dates))
    a, b = _word_keys(runs)
    if not pairs:
        return a, b
    # Each pair with each year of its text.
    place, times = np.repeat(np.arange(len(texts)), n_pairs), np.repeat(n_years, n_pairs)
    two, date = np.fromiter(chain.from_iterable(pairs), np.uint64).reshape(-1, 2), np.fromiter(years, np.uint64)
    first = np.repeat((np.cumsum(n_years) - n_years)[place], times)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    d = _mix(np.repeat(two[:, 0], times), np.repeat(two[:, 1], times), date[first + nth])
    return np.concatenate([a, np.repeat(place, times)]), np.concatenate([b, d])


def row_number_keys(rows: list[tuple[int, str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of (place, year, volume, page): the year may differ by one where volume and page agree."""
    out = []
    for place, year, volume, page in rows:
        if volume and page:
            years = [*([_hash(str(int(year) + d)) for d in (-1, 0, 1)] if year.isdecimal() else [_NO_YEAR]), _ANY_YEAR]
            out += [(place, _hash(volume), _hash(page), y) for y in years]
    return _number_keys(sorted(set(out)))


def _near(a: str, b: str) -> bool:
    """One edit or one swap apart."""
    if abs(len(a) - len(b)) > 1 or len(a) < 3:
        return False
    n, m = min(len(a), len(b)), max(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    left = m - i - j
    return left <= 1 or (left == 2 and len(a) == len(b) and a[i] == b[i + 1] and a[i + 1] == b[i])


_LONG_MARKERS = [m for m in MARKERS if len(m) > 6]
_MARKER_ENDS = {m[:2] for m in _LONG_MARKERS} | {m[-2:] for m in _LONG_MARKERS}


@lru_cache(maxsize=200_000)
def _marker(token: str) -> tuple[str, ...]:
    """The markers that a token is, or is a misspelling of."""
    if token in MARKERS:
        return (token,)
    if len(token) > 5 and (token[:2] in _MARKER_ENDS or token[-2:] in _MARKER_ENDS):
        return tuple(m for m in _LONG_MARKERS if _near(token, m))
    return ()


#: Tokens known to be no marker.
_unmarked: set[str] = set()


def _markers(tokens: list[str], different: set[str] | None = None) -> set[str]:
    out: set[str] = set()
    for t in (different or set(tokens)) - _unmarked:
        if own := _marker(t):
            out.update(own)
        else:
            if len(_unmarked) > 500_000:
                _unmarked.clear()
            _unmarked.add(t)
    return out | {f"part {b}" for a, b in zip(tokens, tokens[1:]) if a == "part" and b.isdigit()} if "part" in tokens else out


#: Predicates of a pair, in the order of the columns of truths().
SUPPORT = ("title", "numbers")
AGAINST = ("missing", "page", "marker", "volume", "year", "author", "journal", "extra")


def _by_ends(tokens: set[str]) -> list[str]:
    """The tokens that another word can be close to. Few words are looked for in a text, so a pass over them is cheaper than an index of their ends."""
    return [t for t in tokens if len(t) > 2]


def _close(word: str, ends: list[str]) -> bool:
    """Whether a token is one edit apart; with two letters or more it then has the first or the last one in common."""
    if len(word) < 2:
        return False
    n, first, last = len(word), word[0], word[-1]
    for t in ends:
        if (t[0] == first or t[-1] == last) and -2 < len(t) - n < 2 and _near(t, word):
            return True
    return False


def _found(word: str, have: set[str], squashed: str, ends: list[str]) -> bool:
    return word in have or (len(word) > 3 and word in squashed) or _close(word, ends)


def title_form(own: list[str]) -> tuple[set[str], list[str], set[str], list[str]]:
    """A title's words, those of weight as they stand and each once, and the light ones."""
    known = set(own)
    heavy, light = [w for w in own if w not in LIGHT], [w for w in own if w in LIGHT]
    return known, heavy, known.difference(light), light


def title_truth(shown: tuple, own: list[str], whole: str, form: tuple | None = None) -> tuple:
    """whole: the title's words without blanks; form: as title_form() gives it. (cover, titled, whether missing words stand between, the title begins the
    text): how a title stands in a text. A light word weighs a tenth of another."""
    tokens, years, numbers, squashed, have, marks, cut, shows_title, ends = shown
    known, heavy, once, light = form or title_form(own)
    most = 10 * len(heavy) + len(light)
    if len(own) > 2 and whole in squashed and have >= known:
        return 1.0, most >= 30, False, not once.isdisjoint(tokens[:2])
    lost = [w for w in once - have if len(w) < 4 or w not in squashed]
    # Misspelt words are looked for as long as enough of the title can still be there.
    times = heavy.count if len(heavy) > len(once) else lambda w: 1
    left = 10 * sum(map(times, lost))
    room = max(most / 2, 30) - (most - left)
    if lost and not ends:
        ends += _by_ends(have)
    absent = set()
    for w in lost:
        if room > left and not cut:
            return 0.0, False, False, False
        left -= 10 * times(w)
        if _close(w, ends):
            room -= 10 * times(w)
        else:
            absent.add(w)
    if cut:
        hit = [w in have if w in LIGHT else w not in absent for w in own]
        last = len(hit) - hit[::-1].index(True) if any(hit) else len(hit)
        weight = [1 if w in LIGHT else 10 for w in own[:last]]
        matched, most = sum([w for w, h in zip(weight, hit) if h]), sum(weight)
    else:
        matched = 10 * (len(heavy) - (sum(map(times, absent)))) + sum([w in have for w in light])
    cover = matched / most if most else 0.0
    if matched < 30 or cover < 0.5:
        return cover, False, False, False
    extra = False
    if cover < 0.995 and (at := [i for i, t in enumerate(tokens) if t in once]):
        near = None
        for t in tokens[at[0] : at[-1] + 1]:
            if t not in known and t not in LIGHT and not t.isdigit() and t not in whole:
                near = _by_ends(known) if near is None else near
                if not _close(t, near):
                    extra = True
                    break
    return cover, True, extra, not once.isdisjoint(tokens[:2])


def truths(shown: tuple, title: tuple, known: set[str], marks_: set[str], journals: tuple[str, ...], name: str, year: str, volume: str, page: str) -> list[float]:
    """Truth values of the predicates, from 0 to 1. shown: of the text, as seen() gives it; title: as title_truth() gives it, with its words, markers and
    the journal's forms; then fields of the bibliographic row."""
    tokens, years, numbers, squashed, have, own_marks, cut, own_words, ends = shown
    cover, titled, extra, unnamed = title
    page_in, volume_in, year_in = bool(page) and page in numbers, bool(volume) and volume in numbers, bool(year) and year in years
    by_numbers = 0.0
    if not titled and not page_in:
        return []
    if name and not ends:
        ends += _by_ends(have)
    places = [n for n in numbers if n not in known and n not in years] if (page and not page_in) or (volume and not volume_in) else ()
    name_in = bool(name) and _found(name, have, squashed, ends)
    journal_in = _one_in(journals, squashed)
    if page_in:
        by_numbers = min(1.0, 0.35 + 0.35 * volume_in + 0.15 * year_in + 0.1 * name_in + 0.1 * journal_in)
        shows_title = not titled and _has_words(own_words)
        if not titled and (shows_title or not (volume_in and (name_in or journal_in))):
            by_numbers = min(by_numbers, 0.2 if shows_title and known else 0.4)  # it shows another title, or too little
    doubt = 1 - 0.75 * by_numbers
    if titled and not own_marks:
        own_marks.append(_markers(tokens, have))
    marks = own_marks[0] if titled else set()
    wrong_marks = titled and bool(marks_ - marks if cut else marks ^ marks_)
    return [
        min(1.0, max(0.0, (cover - 0.6) / 0.35)) if titled else 0.0, by_numbers,
        doubt * min(1.0, (1 - cover) / 0.25) if titled else 0.0, float(bool(page) and not page_in and len(places) > 1), float(wrong_marks),
        float(bool(volume) and not volume_in and len(places) > 1), float(bool(year) and bool(years) and not year_in),
        float(bool(name) and not name_in and not unnamed), float(bool(journals) and not journal_in), doubt * min(1.0, extra),
    ]


def _one_in(journals: tuple[str, ...], squashed: str) -> bool:
    for j in journals:
        if j in squashed:
            return True
    return False


def _has_words(text: str) -> bool:
    """Whether a text shows several words in small letters, or in capitals, as titles have."""
    return len(_PLAIN_WORD.findall(text)) > 3 or len(_CAPITAL_WORD.findall(text)) > 3


def seen(text: str) -> tuple:
    """What is known of a text; its markers and the words that others may be close to are looked at when a rule first asks for them."""
    tokens, years, numbers = _shown(text)
    have = set(tokens)
    return tokens, years, numbers, "".join(tokens), have, [], "..." in text or "…" in text, text, []


def minimise(
    size: int, rule: np.ndarray, at: np.ndarray, coef: np.ndarray, bound: np.ndarray, weight: np.ndarray, block: np.ndarray,
    pull: tuple[np.ndarray, np.ndarray] | None = None, tolerance: float = TOLERANCE, most: int = 20_000, rho: float = 2.0,
) -> np.ndarray:
    """Values in [0, 1] of size variables with the least sum of weight max(0, sum of coef x[at] - bound), plus CONVEX / 2 x^2 each.

    rule, at, coef: the terms of the hinges, ascending by rule. block: of each variable; blocks share no hinge, and leave when their residuals fall
    below the tolerance, that of the values over 30 rounds. pull: (strength, target) of each variable, for strength / 2 (x - target)^2."""
    strength, target = pull or (np.zeros(size), np.zeros(size))
    result, names = np.full(size, 0.5), np.arange(size)
    z, u = result.copy(), np.zeros(len(at))
    rounds = 0
    while len(names):
        norm = np.bincount(rule, weights=coef**2, minlength=len(bound))
        copies = np.bincount(at, minlength=len(names)) * rho + CONVEX + strength
        pulled = strength * target
        before = z
        for _ in range(30):
            v = z[at] - u
            over = np.bincount(rule, weights=coef * v, minlength=len(bound)) - bound
            step = np.where(over > 0, np.minimum(weight / rho, over / norm), 0.0)
            y = v - step[rule] * coef
            z = np.minimum(np.maximum((rho * np.bincount(at, weights=y + u, minlength=len(names)) + pulled) / copies, 0.0), 1.0)
            gap = y - z[at]
            u += gap
        rounds += 30
        open_ = np.zeros(block.max(initial=0) + 1, bool)
        open_[block[np.abs(z - before) > tolerance]] = True
        open_[block[at[np.abs(gap) > 10 * tolerance]]] = True
        result[names] = z
        live = open_[block]
        if rounds >= most or not live.any():
            break
        if live.mean() < 0.8:
            terms = live[at]
            kept = np.zeros(len(bound), bool)
            kept[rule[terms]] = True
            rule, at, coef, u = (np.cumsum(kept) - 1)[rule[terms]], (np.cumsum(live) - 1)[at[terms]], coef[terms], u[terms]
            bound, weight = bound[kept], weight[kept]
            names, z, block, strength, target = names[live], z[live], block[live], strength[live], target[live]
    return result


def _blocks(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place that each of size places is connected with by the links a - b."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = new


@lru_cache(maxsize=ANCHORS)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _pairs_of(sizes: np.ndarray, support: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows that have rules with each other, block by block: all, or those with one of the best-supported ANCHORS."""
    left, right, start = [], [], 0
    for n in sizes:
        if n > 1:
            a, b = _triangle(min(int(n), ANCHORS))
            if n > ANCHORS:
                order = np.argsort(-support[start : start + n], kind="stable")
                c, d = np.repeat(np.arange(ANCHORS), n - ANCHORS), np.tile(np.arange(ANCHORS, n), ANCHORS)
                a, b = order[np.concatenate([a, c])], order[np.concatenate([b, d])]
            left.append(a + start)
            right.append(b + start)
        start += n
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def identity(i: np.ndarray, j: np.ndarray, words_: np.ndarray, year: np.ndarray, volume: np.ndarray, page: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Truth that the rows i and j agree, and that they differ; both 0 where nothing speaks for one publication. Fields are numbers, 0 is unknown."""
    known = lambda f: (f[i] != 0) & (f[j] != 0)
    equal = lambda f: known(f) & (f[i] == f[j])
    other = lambda f: known(f) & (f[i] != f[j])
    apart = np.where(other(year), np.where(np.abs(year[i].astype(np.int64) - year[j]) == 1, 0.5, 1.0), 0.0)
    differ = np.maximum(apart, (other(volume) | other(page) | other(name)).astype(float))
    agree = np.where(words_[i] == words_[j], 1.0, np.where(equal(volume) & equal(page) & equal(year) & ~other(name), 0.8, 0.0))
    return agree * (1 - differ), np.where(agree > 0, differ, 0.0)


def problem(sizes: np.ndarray, truth: np.ndarray, ids: np.ndarray, fields: tuple[np.ndarray, ...], copies: dict[int, int] | None = None) -> dict:
    """The hinges of the blocks of texts: sizes of the blocks, truth and ids of their rows, fields as identity() takes them. The variables are the
    matches, the identities, and, where the rows of a text may be of several publications, one for each of these; copies: in how many tasks an identity
    stands, which share its own rules."""
    n = len(truth)
    text = np.repeat(np.arange(len(sizes)), sizes)
    i, j = _pairs_of(sizes, truth[:, : len(SUPPORT)].max(1) if n else np.zeros(0))
    agree, differ = identity(i, j, *fields)
    open_ = (agree > 0) | (differ > 0)
    i, j, agree, differ = i[open_], j[open_], agree[open_], differ[open_]
    lo, hi = np.minimum(ids[i], ids[j]).view(np.uint64), np.maximum(ids[i], ids[j]).view(np.uint64)
    pids, first, which = np.unique(_mix(lo, hi).view(np.int64), return_index=True, return_inverse=True)
    s = n + which
    cited = _blocks(n, i[agree > 0], j[agree > 0])
    of_text = np.zeros(cited.max(initial=-1) + 1, np.int64)
    of_text[cited] = text
    several = np.bincount(of_text, minlength=len(sizes))[of_text] > 1
    y = n + len(pids) + np.cumsum(several) - 1
    # How much a row falls short of the best-supported other publication of its text.
    strength = truth[:, : len(SUPPORT)].sum(1)
    best = np.zeros(len(of_text))
    np.maximum.at(best, cited, strength)
    order = np.lexsort((best, of_text))
    rank = np.zeros((2, len(sizes)))
    second = np.ones(len(order), bool)
    second[-1:] = False
    second[:-1] = of_text[order][:-1] == of_text[order][1:]
    rank[0][of_text[order][~second]] = best[order][~second]
    np.maximum.at(rank[1], of_text[order][second], best[order][second])
    top = np.zeros(len(of_text), bool)
    top[order[~second]] = True
    outdone = np.clip((np.where(top[cited], rank[1][text], rank[0][text]) - strength) / 0.2, 0, 1) if n else strength
    rules, at, coef, bound, weight, count = [], [], [], [], [], 0

    def hinges(vs: tuple[np.ndarray, ...], cs: tuple[float, ...], b: np.ndarray | float, w: np.ndarray | float) -> None:
        nonlocal count
        w = np.broadcast_to(w, vs[0].shape)
        keep = w > 0
        m = int(keep.sum())
        rules.append(np.repeat(np.arange(count, count + m), len(vs)))
        at.append(np.stack(vs, 1)[keep].ravel())
        coef.append(np.tile(np.array(cs), m))
        bound.append(np.broadcast_to(b, vs[0].shape)[keep])
        weight.append(w[keep])
        count += m

    every = np.arange(n)
    for k, name in enumerate(SUPPORT):
        hinges((every,), (-1.0,), -truth[:, k], np.where(truth[:, k] > 0, WEIGHTS[name], 0.0))
    for k, name in enumerate(AGAINST, len(SUPPORT)):
        hinges((every,), (1.0,), 1 - truth[:, k], np.where(truth[:, k] > 0, WEIGHTS[name], 0.0))
    hinges((every,), (1.0,), 1 - outdone, np.where(outdone > 0, WEIGHTS["outdone"], 0.0))
    hinges((every,), (1.0,), 0.0, WEIGHTS["prior"])
    hinges((i, j, s), (1.0, 1.0, -1.0), 1.0, WEIGHTS["exclusive"])
    hinges((i, s, j), (1.0, 1.0, -1.0), 1.0, WEIGHTS["together"])
    hinges((j, s, i), (1.0, 1.0, -1.0), 1.0, WEIGHTS["together"])
    own = n + np.arange(len(pids))
    share = 1 / np.array([(copies or {}).get(p, 1) for p in pids.tolist()], float)
    hinges((own,), (-1.0,), -agree[first], np.where(agree[first] > 0, WEIGHTS["same"], 0.0) * share)
    hinges((own,), (1.0,), 1 - differ[first], np.where(differ[first] > 0, WEIGHTS["differ"], 0.0) * share)
    hinges((own,), (1.0,), 0.0, WEIGHTS["own"] * share)
    among = np.flatnonzero(several[cited]) if n else every
    hinges((among, y[cited[among]]), (1.0, -1.0), 0.0, WEIGHTS["cited"])
    # One publication for each text: a hinge over all that its rows may be of.
    who, which_text = np.unique(of_text[several], return_inverse=True)
    order = np.argsort(which_text, kind="stable")
    rules.append(count + which_text[order])
    at.append(y[several][order])
    coef.append(np.ones(len(order)))
    bound.append(np.ones(len(who)))
    weight.append(np.full(len(who), WEIGHTS["exclusive"]))
    # Texts are tied to each other by identities only.
    label = _blocks(len(sizes) + len(pids), text[i], len(sizes) + which)
    block = np.concatenate([label[text], label[len(sizes) :], label[of_text[several]]])
    flat = np.concatenate
    size = n + len(pids) + int(several.sum())
    return {"n": n, "size": size, "pids": pids, "rule": flat(rules), "at": flat(at), "coef": flat(coef), "bound": flat(bound), "weight": flat(weight), "block": block, "text": text}


def _least(p: dict, pull: tuple[np.ndarray, np.ndarray] | None = None, **options: float) -> np.ndarray:
    return minimise(p["size"], *(p[k] for k in ("rule", "at", "coef", "bound", "weight", "block")), pull, **options)


def solve(sizes: np.ndarray, truth: np.ndarray, ids: np.ndarray, fields: tuple[np.ndarray, ...], **options: float) -> np.ndarray:
    """Values of the matches of the blocks, as problem() takes them."""
    p = problem(sizes, truth, ids, fields)
    return _least(p, **options)[: p["n"]]


_ROW, _FIELD = "\x1e", "\x1f"
_ROW_COLUMNS = ("w1", "w2", "author", "journal", "year", "volume", "page")


@lru_cache(maxsize=100_000)
def _squashed(name: str) -> str:
    return "".join(words(name))


def packed_row(w1: int, w2: int, author: str, journal: str, year: str, volume: str, page: str) -> str:
    """A row as text: its hashes, the first author's name, the journal's squashed name, year, volume and page."""
    rest = [f if f.isalnum() else f.translate({0x1E: " ", 0x1F: " "}).strip() for f in (year, volume, page)]
    return _FIELD.join((str(w1), str(w2), _surname(author), _squashed(journal), *rest))


def journal_forms(full: list[str | None], short: list[str | None]) -> dict[str, tuple[str, ...]]:
    """From either form of a journal's name, squashed, to all its forms."""
    out: dict[str, tuple[str, ...]] = {}
    for pair in zip(full, short):
        forms = tuple(dict.fromkeys("".join(words(x)) for x in pair if x))
        for f in forms:
            out[f] = tuple(dict.fromkeys((*out.get(f, ()), *forms)))
    return out


# Keys on their way: (32 bits of the key, 48 bits of the text's or family's hash), in buckets by the key's other bits.
_ENTRY = np.dtype([("key", "<u4"), ("low", "<u4"), ("high", "<u2")])
_COUNTED = np.dtype([("key", "<u4"), ("low", "<u4"), ("high", "<u2"), ("n", "<u2")])
_ID = (1 << 48) - 1


def _entries(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.empty(len(key), _ENTRY)
    out["key"], out["low"], out["high"] = key & np.uint64(0xFFFFFFFF), ids & 0xFFFFFFFF, ids >> 32
    return out


def _ids(e: np.ndarray) -> np.ndarray:
    return e["low"].astype(np.int64) | e["high"].astype(np.int64) << 32


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(32)).astype(np.int64) % buckets


def _packed(bucket: np.ndarray, data: np.ndarray, **more: int) -> pd.DataFrame:
    """One row for each bucket with its entries."""
    # Numbers of 16 bits are sorted by their digits.
    bucket = bucket.astype(np.uint16 if bucket.max(initial=0) < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, data = bucket[order], data[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    which, stops = bucket[start], np.append(start[1:], len(order))
    return pd.DataFrame({"bucket": which.astype(np.int32), **{k: np.int32(v) for k, v in more.items()}, "data": [data[a:b].tobytes() for a, b in zip(start, stops)]})


def _unpacked(blobs: pd.Series, kind: np.dtype = _ENTRY) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _among(key: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Whether each key is one of a few sorted ones."""
    return few[np.minimum(np.searchsorted(few, key), len(few) - 1)] == key if len(few) else np.zeros(len(key), bool)


def _salted(key: np.ndarray, bucket: np.ndarray, salt: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Hot keys of texts go to one of as many further buckets."""
    return np.where(_among(key, np.sort(hot)), buckets + salt % buckets, bucket)


_TEXT_BUCKETS, _SIDES, _COUNTS = "bucket int, side int, data binary", (0, 1), "bucket int, source int, data binary"


def _key_texts(buckets: int, hot: np.ndarray, needless: np.ndarray):
    """Keys of texts but for those known to stand in no title."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            item, key = text_keys(list(pdf["text"]))
            asked = ~_among(key, needless)
            item, key = item[asked], key[asked]
            ids = pdf["h"].to_numpy(np.int64)[item]
            yield _packed(_salted(key, _bucket(key, buckets), ids, hot, buckets), _entries(key, ids), side=0)

    return run


def _those_of(hot: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": np.intersect1d(_word_keys([_in_keys(t.split()) for t in pdf["title"]])[1], hot).view(np.int64)})

    return run


def _key_titles(buckets: int, hot: np.ndarray):
    """Title keys of families to be counted; source -1 and the family's bucket where a key is hot and not worth it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            item, key = _word_keys([_in_keys(t.split()) for t in pdf["title"]])
            ids = pdf["f"].to_numpy(np.int64)[item]
            often = np.isin(key, hot)
            yield _packed(_bucket(key[~often], buckets), _entries(key[~often], ids[~often]), source=-1)
            # Their place among a family's keys is by hash; the bucket goes along.
            rest = np.empty(often.sum(), _COUNTED)
            e = _entries(key[often], ids[often])
            rest["key"], rest["low"], rest["high"], rest["n"] = e["key"], e["low"], e["high"], 65535
            if len(rest):
                bucket = _bucket(key[often], buckets)
                for b in np.unique(bucket):
                    yield _packed(ids[often][bucket == b] % buckets, rest[bucket == b], source=int(b))

    return run


def _count(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Number of families of each key of a bucket, on the way to the families' buckets."""
    e = _unpacked(pdf["data"])
    _, which, n = np.unique(e["key"], return_inverse=True, return_counts=True)
    out = np.empty(len(e), _COUNTED)
    out["key"], out["low"], out["high"], out["n"] = e["key"], e["low"], e["high"], np.minimum(n[which], 65534)
    return _packed(_ids(e) % buckets, out, source=int(pdf["bucket"].iloc[0]))


def _choose(pdf: pd.DataFrame, buckets: int, hot: np.ndarray) -> pd.DataFrame:
    """The rarest keys of the families of a bucket."""
    e = _unpacked(pdf["data"], _COUNTED)
    source = np.repeat(pdf["source"].to_numpy(np.int64), [len(d) // _COUNTED.itemsize for d in pdf["data"]])
    ids = _ids(e)
    order = np.lexsort((e["key"], e["n"], ids))
    e, ids, source = e[order], ids[order], source[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    rank = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    keep = rank < RAREST
    return _to_join(e[keep], ids[keep], source[keep], buckets, hot)


def _to_join(e: np.ndarray, ids: np.ndarray, bucket: np.ndarray, buckets: int, hot: np.ndarray) -> pd.DataFrame:
    """Entries of families for the join; those of hot keys of texts to every further bucket."""
    out = np.empty(len(e), _ENTRY)
    out["key"], out["low"], out["high"] = e["key"], e["low"], e["high"]
    hot_local, hot_bucket = (hot & np.uint64(0xFFFFFFFF)).astype(np.int64), _bucket(hot, buckets)
    often = np.isin(bucket << 32 | out["key"].astype(np.int64), hot_bucket << 32 | hot_local)
    every = np.repeat(np.arange(buckets, 2 * buckets), often.sum())
    return _packed(np.concatenate([bucket[~often], every]), np.concatenate([out[~often], np.tile(out[often], buckets)]), side=1)


def _key_numbers(buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *r.split(_FIELD)[4:]) for i, rs in enumerate(pdf["rows"]) for r in rs.split(_ROW)]
            item, key = row_number_keys(rows)
            ids = pdf["f"].to_numpy(np.int64)[item]
            yield _to_join(_entries(key, ids), ids, _bucket(key, buckets), buckets, hot)

    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """(h, f): texts and families with a key in common, each once in a bucket."""
    side = pdf["side"].to_numpy()
    texts, families = (_unpacked(pdf["data"][side == s]) for s in _SIDES)
    families = families[np.argsort(families["key"], kind="stable")]
    low, high = (np.searchsorted(families["key"], texts["key"], way) for way in ("left", "right"))
    n = high - low
    hit = np.flatnonzero(n)
    n, low = n[hit], low[hit]
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return pd.DataFrame({"h": np.repeat(_ids(texts[hit]), n), "f": _ids(families[at])}).drop_duplicates()


def hot_keys(keys: tuple[np.ndarray, np.ndarray], items: int) -> np.ndarray:
    """Keys of at least HOT of the items of a sample; at most the mean number of keys of an item divided by HOT."""
    key, n = np.unique(keys[1], return_counts=True)
    return key[n >= max(2, HOT * items)] if items >= 1 / HOT else key[:0]


def _plain(title: Column) -> Column:
    low = F.lower(title)
    return F.regexp_replace(F.when(low.contains("<"), F.regexp_replace(low, r"</?[a-z]{1,6}>", "")).otherwise(low), r"[^0-9a-zα-ω]+", "")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = b.column("rows")
        packed = [packed_row(*r) for r in zip(*(c.to_pylist() for c in held.flatten().flatten()))]
        ends = held.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
        rows = [packed[i] if j == i + 1 else _ROW.join(sorted(packed[i:j])) for i, j in zip([0, *ends], ends)]
        titles = [" ".join(words(t)) for t in b.column("title").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("f"), pa.array(titles, pa.string()), pa.array(rows, pa.string())], names=["f", "title", "rows"])


_BLOCK = "home bigint, h1 bigint, h2 bigint, w1 array<bigint>, w2 array<bigint>, truth array<float>, words array<int>, year array<int>, volume array<int>, page array<int>, name array<int>"
_COLUMNS = [c.split()[0] for c in _BLOCK.split(", ")]


_numbers: dict[str, int] = {"": 0}


def _number(word: str) -> int:
    """A field as a number for comparison; 0 is unknown."""
    n = _numbers.get(word)
    if n is None:
        if len(_numbers) > 500_000:
            _numbers.clear()
        n = _numbers[word] = (_hash(word) & 0x7FFFFFFF) + 1 & 0x7FFFFFFF if word else 0
    return n


_UP = np.array([WEIGHTS[name] for name in AGAINST])
_DOWN = np.array([WEIGHTS[name] for name in SUPPORT])
_UP_LIST, _DOWN_LIST = _UP.tolist(), _DOWN.tolist()


#: From here on a truth value is 1 as a float of 32 bits.
_ONE = 1 - 2.0**-25


def _rises(t: list[float], one: float = 1.0) -> bool:
    """Whether a row's own rules put its value above 0: the slope at 0 is negative."""
    up, against = 0.0, WEIGHTS["prior"]
    for w, x in zip(_DOWN_LIST, t):
        if x > 0:
            up += w
    for w, x in zip(_UP_LIST, t[len(SUPPORT) :]):
        if x >= one:
            against += w
    return up > against


def _agree(a: tuple, b: tuple) -> bool:
    """Whether identity() finds that two rows agree at all. Fields are words, year, volume, page and name, 0 is unknown."""
    for x, y in zip(a[2:], b[2:]):
        if x and y and x != y:
            return False
    if a[1] and b[1] and abs(a[1] - b[1]) > 1:
        return False
    return a[0] == b[0] or (a[1:4] == b[1:4] and 0 not in a[1:4])


#: Rows that wait for one to agree with before they are scored in any case.
WAITING_MOST = 4_000


def _place(x: tuple) -> int:
    return x[5]


def _title_number(entry: list) -> int:
    """A title's number for comparison, of its words that are not light."""
    if entry[4] is None:
        entry[4] = _number(" ".join([w for w in entry[1] if w not in LIGHT]))
    return entry[4]


def _score(forms: dict[str, tuple[str, ...]]):
    """One row for each text with the rows that something supports; texts come sorted, and none is divided among tasks.

    Left out is only what ends at 0 in any case: rows that neither rise alone nor may be of one publication with one that does,
    as 0 is then the least of every rule they stand in. So a row whose numbers, year and journal contradict the text beyond what any title
    supports waits until one it agrees with has risen, and its title is looked at only then."""

    def fields_of(entry: list, row: list[str]) -> tuple:
        name, _, year, volume, page = row[2:]
        date = int(year) if year.isdecimal() and len(year) < 9 else _number(year)
        return _title_number(entry), date, _number(volume), _number(page), _number(name)

    def scored(shown: tuple, place: int, f: int, entry: list, row: list[str]) -> tuple | None:
        """The row as it stands in a block, if something supports it."""
        known, own, form, marks, _ = entry
        if form is None:
            form = entry[2] = "".join(own), title_form(own)
        stands = title_truth(shown, own, *form)
        w1, w2, name, journal, year, volume, page = row
        if not stands[1] and page not in shown[2]:
            return None
        if marks is None:
            marks = entry[3] = _markers(own, known)
        truth = truths(shown, stands, known, marks, forms.get(journal) or ((journal,) if journal else ()), name, year, volume, page)
        if not truth or (truth[0] <= 0 and truth[1] <= 0):
            return None
        return f, int(w1), int(w2), truth, fields_of(entry, row), place

    def cannot_rise(shown: tuple, places: int, journal: str, year: str, volume: str, page: str) -> bool:
        """Whether numbers, year and journal of a row whose page the text does not show outweigh any title."""
        against = WEIGHTS["prior"]
        if places > 1:
            against += (WEIGHTS["page"] if page else 0.0) + (WEIGHTS["volume"] if volume and volume not in shown[2] else 0.0)
        if year and shown[1] and year not in shown[1]:
            against += WEIGHTS["year"]
        if against < WEIGHTS["title"] <= against + WEIGHTS["journal"] and journal and not _one_in(forms.get(journal, (journal,)), shown[3]):
            against += WEIGHTS["journal"]
        return against >= WEIGHTS["title"]

    def block(shown: tuple, found: list[tuple], waiting: list[tuple]) -> tuple[int, list[tuple]] | None:
        """The home of a text's block, and its rows: those that rise alone, and of the others those that agree with one of them."""
        alone = [x for x in found if _rises(x[3], _ONE)]
        if not alone:
            return None
        if len(alone) < len(found):
            ids = {id(x) for x in alone}
            found = [x for x in found if id(x) in ids or any(_agree(x[4], y[4]) for y in alone)]
        if waiting:
            titles, pages = {x[4][0] for x in alone}, {x[4][3] for x in alone}
            for place, f, entry, row in waiting:
                if _title_number(entry) in titles or (row[6] and _number(row[6]) in pages):
                    own = fields_of(entry, row)
                    if any(_agree(own, y[4]) for y in alone) and (x := scored(shown, place, f, entry, row)):
                        found.append(x)
            found.sort(key=_place)
        if len(found) == 1:
            return found[0][0], found
        support = np.array([x[3][: len(SUPPORT)] for x in found], np.float32)
        return found[int((support[:, 0] + support[:, 1]).argmax())][0], found

    def batch(blocks: list[tuple]) -> pa.RecordBatch:
        rows = [x for *_, found in blocks for x in found]
        offsets = np.cumsum([0, *(len(found) for *_, found in blocks)], dtype=np.int32)
        of_rows = lambda values, k=1: pa.ListArray.from_arrays(pa.array(k * offsets, pa.int32()), pa.array(values))
        fields = np.array([x[4] for x in rows], np.int32).T
        columns = [pa.array([b[k] for b in blocks], pa.int64()) for k in range(3)] + [of_rows(np.array([x[k] for x in rows], np.int64)) for k in (1, 2)]
        columns += [of_rows(np.array([x[3] for x in rows], np.float32).ravel(), len(SUPPORT) + len(AGAINST)), *(of_rows(np.ascontiguousarray(f)) for f in fields)]
        return pa.RecordBatch.from_arrays(columns, names=_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shown, found, waiting, out, place = None, None, [], [], [], 0
        titles: dict[str, list] = {}
        for b in batches:
            h1s, h2s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            starts = np.flatnonzero(np.append(True, (h1s[1:] != h1s[:-1]) | (h2s[1:] != h2s[:-1]))[: len(h1s)])
            texts = zip(h1s[starts].tolist(), h2s[starts].tolist(), b.column("text").take(pa.array(starts)).to_pylist(), np.append(starts[1:], len(h1s)).tolist())
            until = 0
            for i, (f, title, rows) in enumerate(zip(*(b.column(c).to_pylist() for c in ("f", "title", "rows")))):
                if i == until:
                    h1, h2, text, until = next(texts)
                    if (h1, h2) != last:
                        if found and (own := block(shown, found, waiting)):
                            out.append((own[0], *last, own[1]))
                        last, shown, found, waiting = (h1, h2), seen(text), [], []
                        years, numbers = shown[1], shown[2]
                        counted = [n for n in numbers if n not in years]
                if len(titles) > 50_000:
                    titles.clear()
                entry = titles.get(title)
                if entry is None:
                    words_ = title.split()
                    # Looked at when a rule first asks for them: the title's words by weight, its markers and its number.
                    entry = titles[title] = [set(words_), words_, None, None, None]
                known = entry[0]
                places = len(counted) if known.isdisjoint(counted) else sum([n not in known for n in counted])
                for r in rows.split(_ROW):
                    row = r.split(_FIELD)
                    place += 1
                    if row[6] in numbers or not cannot_rise(shown, places, *row[3:]):
                        if x := scored(shown, place, f, entry, row):
                            found.append(x)
                    else:
                        waiting.append((place, f, entry, row))
                if len(waiting) > WAITING_MOST:
                    found += [x for w in waiting if (x := scored(shown, *w))]
                    found.sort(key=_place)
                    waiting = []
            if out:
                yield batch(out)
                out = []
        if found and (own := block(shown, found, waiting)):
            yield batch([(own[0], *last, own[1])])

    def without_gc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """No object made here refers to itself, so a search for cycles among the many tuples finds nothing."""
        on = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if on:
                gc.enable()

    return without_gc


def _single(truth: np.ndarray) -> np.ndarray:
    """Values of rows that are alone in their text: where the slope of their own rules changes its sign."""
    down, up = truth[:, : len(SUPPORT)], 1 - truth[:, len(SUPPORT) :]
    w_up = np.where(truth[:, len(SUPPORT) :] > 0, _UP, 0.0)
    low, high = np.zeros(len(truth)), np.ones(len(truth))
    for _ in range(30):
        x = (low + high) / 2
        slope = WEIGHTS["prior"] + CONVEX * x + (w_up * (x[:, None] > up)).sum(1) - (_DOWN * (x[:, None] < down)).sum(1)
        low, high = np.where(slope < 0, x, low), np.where(slope < 0, high, x)
    return (low + high) / 2


_SETTLED = "bucket int, chunk int, pid bigint, agreed double, h1 bigint, h2 bigint, w1 bigint, w2 bigint, confidence double"


def _settle(pdf: pd.DataFrame, state: pd.DataFrame | None = None) -> pd.DataFrame:
    """Values of the rows of a group of texts. Without a state: matches and all identities. With one (pid, agreed, dual, copies of shared identities):
    all rows, and the shared identities, their copies drawn to what is agreed less their duals."""
    sizes = np.array([len(x) for x in pdf["w1"]], np.int64)
    flat = lambda name, kind: np.concatenate(list(pdf[name])).astype(kind) if len(pdf) else np.zeros(0, kind)
    w1, w2, truth = flat("w1", np.int64), flat("w2", np.int64), flat("truth", np.float64).reshape(-1, len(SUPPORT) + len(AGAINST))
    text, value = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(w1))
    alone = sizes[text] == 1
    value[alone] = _single(truth[alone])
    rest = ~alone
    p = problem(sizes[sizes > 1], truth[rest], w1[rest], _fields(pdf, rest), dict(zip(state["pid"], state["copies"])) if state is not None else None)
    pull, at = None, np.zeros(0, int)
    if state is not None:
        at = p["n"] + np.searchsorted(p["pids"], state["pid"].to_numpy())
        strength, target = np.zeros(p["size"]), np.zeros(p["size"])
        strength[at], target[at] = DRAW, state["agreed"].to_numpy() - state["dual"].to_numpy()
        pull = strength, target
    # Copies need be no nearer to the minimum than they must be to the mean.
    found = _least(p, pull, tolerance=TOLERANCE if state is None else AGREED / 100)
    value[rest] = found[: p["n"]]
    x = np.round(value, 2)
    give = np.flatnonzero(x >= MATCH) if state is None else np.arange(len(x))
    out = pd.DataFrame({"h1": pdf["h1"].to_numpy(np.int64)[text[give]], "h2": pdf["h2"].to_numpy(np.int64)[text[give]], "w1": w1[give], "w2": w2[give], "confidence": x[give]})
    shown = p["n"] + np.arange(len(p["pids"])) if state is None else at
    ids = pd.DataFrame({"pid": p["pids"][shown - p["n"]], "agreed": found[shown]})
    whole = lambda df: df.astype({c: "Int64" for c in df.columns if c not in ("agreed", "confidence")})
    out = pd.concat([whole(out), whole(ids)], ignore_index=True)
    return out.assign(bucket=pdf["bucket"].iloc[0], chunk=pdf["chunk"].iloc[0])[[c.split()[0] for c in _SETTLED.split(", ")]]


def _fields(pdf: pd.DataFrame, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(list(pdf[name])).astype(np.int32)[rows] for name in ("words", "year", "volume", "page", "name"))


def _touched(pdf: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """The texts of a group that shared identities bear on, directly or by others; home becomes the least shared identity that does."""
    if not len(pdf) or not len(shared):
        return pdf.iloc[:0]
    sizes = np.array([len(x) for x in pdf["w1"]], np.int64)
    w1 = np.concatenate(list(pdf["w1"])).astype(np.int64)
    truth = np.concatenate(list(pdf["truth"])).astype(np.float64).reshape(len(w1), -1)
    p = problem(sizes, truth, w1, _fields(pdf, np.ones(len(w1), bool)))
    pids = np.sort(shared["pid"].to_numpy(np.int64))
    least = np.full(p["block"].max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, p["block"][p["n"] + np.searchsorted(p["pids"], pids)], pids)
    own = least[p["block"][np.cumsum(sizes) - sizes]]
    return pdf.assign(home=own)[own < np.iinfo(np.int64).max]


def _grouped(blocks: DataFrame) -> DataFrame:
    """The staged blocks with a bucket and a chunk of about GROUP_TEXTS texts, those of one home together as far as they fit."""
    buckets = max(1, math.ceil(blocks.count() / GROUP_TEXTS))
    bucket = F.pmod(F.xxhash64("home"), F.lit(buckets)).cast("int")
    load = blocks.groupBy(bucket.alias("bucket")).count().where(F.col("count") > 2 * GROUP_TEXTS)
    chunks = F.coalesce(F.ceil(F.col("count") / GROUP_TEXTS), F.lit(1))
    return blocks.withColumn("bucket", bucket).join(load, "bucket", "left").withColumn("chunk", F.pmod(F.col("h1"), chunks).cast("int")).drop("count")


def _settled(blocks: DataFrame, regroupings: int = 2, most_rounds: int = 50) -> DataFrame:
    """(h1, h2, w1, w2, confidence): the matches of the staged blocks.

    Each group of texts is minimised by itself. Texts that identities of several groups bear on are grouped anew, by these identities, and
    minimised again. Identities that still stand in several groups are agreed on by consensus: each group minimises its own problem with its copies drawn
    to the mean less their duals, until copies and mean, and mean and last mean, lie within AGREED."""
    group, match = ["bucket", "chunk"], ["h1", "h2", "w1", "w2", "confidence"]
    grouped, found = _grouped(blocks), None
    for turn in range(regroupings + 1):
        done = stage(grouped.groupBy(*group).applyInPandas(lambda pdf: _settle(pdf), _SETTLED))
        matches = done.where("pid IS NULL").select(*match)
        found = matches if found is None else found.join(grouped.select("h1", "h2"), ["h1", "h2"], "left_anti").unionByName(matches)
        shared = done.where("pid IS NOT NULL").groupBy("pid").agg(F.avg("agreed").alias("mean"), F.count("*").alias("copies")).where("copies > 1")
        state = stage(done.where("pid IS NOT NULL").select(*group, "pid", "agreed").join(shared, "pid"))
        if state.isEmpty():
            return found
        active = stage(grouped.where(F.size("w1") > 1).groupBy(*group).cogroup(state.groupBy(*group)).applyInPandas(lambda pdf, ids: _touched(pdf, ids), grouped.schema))
        if turn < regroupings:
            grouped = _grouped(active.drop(*group))
    state = state.select(*group, "pid", "copies", F.col("mean").alias("z"), (F.col("agreed") - F.col("mean")).alias("dual"))
    for _ in range(most_rounds):
        now = state.select(*group, "pid", F.col("z").alias("agreed"), "dual", "copies")
        step = stage(active.groupBy(*group).cogroup(now.groupBy(*group)).applyInPandas(_settle, _SETTLED))
        own = step.where("pid IS NOT NULL").select(*group, "pid", F.col("agreed").alias("own")).join(state, [*group, "pid"])
        mean = own.groupBy("pid").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(F.col("own") + F.col("dual")))).alias("new"))
        state = stage(own.join(mean, "pid").select(*group, "pid", "copies", "z", "own", "new", (F.col("dual") + F.col("own") - F.col("new")).alias("dual")))
        far = state.agg(F.max(F.greatest(F.abs(F.col("own") - F.col("new")), F.abs(F.col("new") - F.col("z")))).alias("x")).first().x
        state = state.select(*group, "pid", "copies", F.col("new").alias("z"), "dual")
        if far <= AGREED:
            break
    again = step.where("pid IS NULL").select(*match)
    return found.join(again.select("h1", "h2").distinct(), ["h1", "h2"], "left_anti").unionByName(again.where(F.col("confidence") >= MATCH))


def families(works: DataFrame) -> DataFrame:
    """(f, title, rows): the distinct rows of each title, in chunks of about FAMILY_MOST by hash; title as words with blanks, rows as packed_row() gives them.
    A row without a title is its own."""
    # The plain title is computed once a row.
    keyed = works.drop("work_id").withColumn("k", F.xxhash64(_plain(F.col("title"))))
    keyed = keyed.withColumn("t", F.when(F.col("k") == F.xxhash64(F.lit("")), F.col("w1")).otherwise(F.col("k"))).drop("k")
    many = keyed.groupBy("t").agg(F.approx_count_distinct("w1").alias("n")).where(F.col("n") > FAMILY_MOST)
    chunk = F.pmod(F.col("w1"), F.coalesce(F.ceil(F.col("n") / FAMILY_MOST), F.lit(1)))
    f = F.xxhash64("t", chunk).bitwiseAND(_ID).alias("f")
    rows = keyed.join(many, "t", "left").select(f, "title", F.struct(*_ROW_COLUMNS).alias("row"))
    return rows.groupBy("f").agg(F.min("title").alias("title"), F.collect_set("row").alias("rows")).mapInArrow(
        _tokens, "f bigint, title string, rows string"
    )


def candidates(texts: DataFrame, held: DataFrame, buckets: int, hot_words: np.ndarray, hot_numbers: np.ndarray, hot_titles: np.ndarray) -> DataFrame:
    """(h, f), each once: texts (h, text) and families (f, title, rows) that share a key."""
    by_bucket = lambda df, run, schema: df.groupBy("bucket").applyInPandas(run, schema)
    # At most as many rows as there are hot keys.
    there = np.array([r.key for r in held.select("title").mapInPandas(_those_of(hot_words), "key bigint").distinct().collect()], np.int64).view(np.uint64)
    hot_texts = np.concatenate([there, hot_numbers])
    titles = held.select("f", "title").mapInPandas(_key_titles(buckets, hot_titles), _COUNTS)
    counted = by_bucket(titles.where("source < 0"), lambda pdf: _count(pdf, buckets), _COUNTS)
    chosen = by_bucket(counted.unionByName(titles.where("source >= 0")), lambda pdf: _choose(pdf, buckets, hot_texts), _TEXT_BUCKETS)
    numbers = held.select("f", "rows").mapInPandas(_key_numbers(buckets, hot_texts), _TEXT_BUCKETS)
    asked = texts.mapInPandas(_key_texts(buckets, hot_texts, np.setdiff1d(hot_words, there)), _TEXT_BUCKETS)
    return by_bucket(asked.unionByName(chosen).unionByName(numbers), _meet, "h bigint, f bigint").distinct()


def link(records: DataFrame, rows: DataFrame, journals: DataFrame) -> DataFrame:
    """(ref_id, work_id, confidence): the rows that describe the publication each record's text cites.

    records: ref_id, text; rows: work_id, title, authors, journal, pub_year, volume, first_page; journals: full_name, short_name, a fixed
    table of at most 100,000 rows. Equal texts and equal rows are worked on once, under two hashes; candidates are found by 48 bits of
    the first one, and what shares these by chance is scored apart."""
    spark = records.sparkSession
    names = journals.select("full_name", "short_name").limit(100_001).toPandas()
    if len(names) > 100_000:
        raise ValueError("journals has more than 100,000 rows")
    forms = journal_forms(list(names["full_name"]), list(names["short_name"]))
    two = lambda *cols: (F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols))
    h1, h2 = two(F.col("text"))
    texts = records.select(F.col("ref_id").cast("bigint").alias("ref_id"), "text", h1.alias("h1"), h2.alias("h2")).where(
        F.col("ref_id").isNotNull() & F.col("text").rlike(r"\S")
    )
    fields = [F.coalesce(c, F.lit("")) for c in (F.col("title"), F.try_element_at("authors", F.lit(1)), *map(F.col, ("journal", "pub_year", "volume", "first_page")))]
    w1, w2 = two(*fields)
    works = rows.select(
        F.col("work_id").cast("bigint").alias("work_id"), *(f.alias(n) for f, n in zip(fields, ("title", "author", "journal", "year", "volume", "page"))), w1.alias("w1"), w2.alias("w2")
    ).where(F.col("work_id").isNotNull())

    held = stage(families(works))
    n_families, n_texts = held.count(), records.count()
    buckets = max(tasks(spark), math.ceil(max(n_families, n_texts) / BUCKET_ROWS))
    drawn = lambda df, by, n: df.where(F.pmod(F.xxhash64(by, F.lit(5)), F.lit(1 << 20)) <= int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20)))
    sample = list(drawn(texts, "text", n_texts).select("text").distinct().limit(2 * SAMPLE).toPandas()["text"])
    hot_words = hot_keys(_word_keys([_in_keys(_shown(t)[0]) for t in sample]), len(sample))
    hot_numbers = np.setdiff1d(hot_keys(text_keys(sample), len(sample)), hot_words)
    sample = list(drawn(held, "f", n_families).select("title").limit(2 * SAMPLE).toPandas()["title"])
    hot_titles = hot_keys(_word_keys([_in_keys(t.split()) for t in sample]), len(sample))

    # Sets of one, but for chance: what shares the 48 bits.
    h = F.col("h1").bitwiseAND(_ID).alias("h")
    one_text = texts.select(h, "h1", "h2", "text").groupBy("h").agg(F.collect_set(F.struct("h1", "h2", "text")).alias("s")).select("h", F.inline("s"))
    near = candidates(one_text.select("h", "text"), held, buckets, hot_words, hot_numbers, hot_titles)
    both = near.join(held, "f").join(one_text, "h")
    # The window keeps a text's rows together and in order.
    both = both.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("h1", "h2"))).drop("h")
    matched = _settled(stage(both.select("h1", "h2", "text", "f", "title", "rows", "place").mapInArrow(_score(forms), _BLOCK)))
    found = matched.join(works.select("work_id", "w1", "w2"), ["w1", "w2"]).select("h1", "h2", "work_id", "confidence")
    return texts.select("ref_id", "h1", "h2").join(found, ["h1", "h2"]).select("ref_id", "work_id", "confidence").distinct()
