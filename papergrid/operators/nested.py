"""Nested JSON bodies into linked rows, by a structural index over whole batches of bodies.

The bytes of many bodies lie in one array. Bitmaps of quotes (after the parity of backslash runs),
brackets and delimiters, prefix sums for inside-string and nesting depth, and one sort by depth
give every value its parent, key and place, without a parser's recursion. The same arrays check
the grammar, so a truncated or garbled body gives no rows.

Defined results: a null, unreadable or scalar body has no nodes; a leading byte order mark and
JSON text inside a JSON string are read; of a key that stands twice in an object the last counts;
places count nulls; nulls and empty objects are no nodes; a lone object where a list may stand
has place 1; records keyed by number take their order in the object.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that lead to nodes.
KEYS = ("articles", "sections", "subsections", "set", "records", "pubmed", "authors")
#: Most bytes indexed at once, unless one body has more.
BLOCK = 1_000_000
_OBJ, _ARR, _STR, _SCALAR, _NULL = 1, 2, 3, 4, 5
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")


def unwrapped(body: str | None) -> bytes | None:
    """The JSON text itself, out of marks and strings; None if there is none."""
    while body is not None:
        body = body.lstrip("﻿").strip(" \t\r\n")
        if body[:1] != '"':
            return body.encode("utf-8", "replace") if body[:1] in ("{", "[") else None
        try:
            body = json.loads(body)
        except ValueError:
            return None
    return None


class Index:
    """Values of a block of JSON texts: body, parent (-1 at the top), place (from 1), key number (-1 none, -2 another), kind, size, start, stop."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        n = len(data)
        sizes = np.array([len(t) + 1 for t in texts])
        begin = np.cumsum(sizes) - sizes
        bad = np.zeros(len(texts), bool)
        body_of = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(n)

        slash = data == 92
        escaped = np.zeros(n, bool)
        if slash.any():
            last = np.maximum.accumulate(np.where(slash, -1, at))
            escaped[1:] = ((at[:-1] - last[:-1]) & 1).astype(bool) & slash[:-1]
        quote = (data == 34) & ~escaped
        count = np.cumsum(quote)
        base = np.concatenate([[0], count])[begin]
        inside = ((count - base[body_of]) & 1).astype(bool)  # from an opening quote up to the closing one, that excluded
        ends = count[begin + sizes - 1] - base
        bad |= (ends & 1).astype(bool)
        text = inside & ~quote
        bad[body_of[text & (data < 32)]] = True
        # Escapes: only those of JSON, and four hexadecimal digits after u.
        after = escaped & text
        table = np.zeros(256, bool)
        table[list(b'"\\/bfnrtu')] = True
        bad[body_of[after & ~table[data]]] = True
        bad[body_of[escaped & ~inside & ~quote]] = True
        u = np.flatnonzero(after & (data == 117))
        if len(u):
            hexa = np.zeros(256, bool)
            hexa[list(b"0123456789abcdefABCDEF")] = True
            ok = np.all([hexa[data[np.minimum(u + i, n - 1)]] for i in range(1, 5)], axis=0)
            bad[body_of[u[~ok]]] = True

        out = ~inside & ~quote
        open_, close = out & ((data == 123) | (data == 91)), out & ((data == 125) | (data == 93))
        comma, colon = out & (data == 44), out & (data == 58)
        blank = (data == 32) | (data == 10) | (data == 13) | (data == 9)
        other = out & ~(open_ | close | comma | colon | blank)
        scalar = other.copy()
        scalar[1:] &= ~(other[:-1] & (body_of[1:] == body_of[:-1]))
        opening = quote & inside
        token = np.flatnonzero(open_ | close | comma | colon | opening | scalar)
        ch = data[token]
        tbody = body_of[token]
        step = open_[token].astype(np.int64) - close[token]
        depth = np.cumsum(step)
        tbase = np.concatenate([[0], depth])[np.searchsorted(token, begin)]
        depth -= tbase[tbody]
        bad[tbody[depth < 0]] = True
        final = np.concatenate([[0], np.cumsum(step)])[np.searchsorted(token, begin + sizes)] - tbase
        bad |= final != 0

        # The container of a token: the last opening bracket one level up, found in the order of body, level and place.
        is_open, is_close = open_[token], close[token]
        m = len(token)
        number, opens = np.arange(m), np.flatnonzero(is_open)
        both = np.concatenate([number, opens])
        level = np.concatenate([depth - is_open, depth[opens]])  # of what a token stands in; of what an opening bracket holds
        heads = np.arange(len(both)) >= m
        order = np.lexsort((both, level, tbody[both]))
        both, level, heads = both[order], level[order], heads[order]
        up = np.maximum.accumulate(np.where(heads, np.arange(len(both)), -1)) if m else np.zeros(0, np.int64)
        same = (up >= 0) & (level[up] == level) & (tbody[both[up]] == tbody[both])
        inside_of = np.full(m, -1)
        inside_of[both[~heads]] = np.where(same, both[up], -1)[~heads]
        # A closing bracket's partner is the last opening one whose content it ends.
        closes = np.flatnonzero(is_close)
        partner = np.full(m, -1)
        if len(opens) and len(closes):
            both = np.concatenate([opens, closes])
            lev = np.concatenate([depth[opens], depth[closes] + 1])
            order = np.lexsort((both, lev, tbody[both]))
            s = both[order]
            good = np.concatenate([[False], is_open[s[:-1]] & is_close[s[1:]] & (lev[order][:-1] == lev[order][1:]) & (tbody[s[:-1]] == tbody[s[1:]])])
            shut = s[good]
            partner[shut] = s[np.flatnonzero(good) - 1]
            bad[tbody[closes[partner[closes] < 0]]] = True
            bad[tbody[shut[ch[shut] - ch[partner[shut]] != 2]]] = True

        # Grammar by neighbouring tokens.
        kind = np.select([ch == 123, ch == 91, is_close, comma[token], colon[token], ch == 34], [0, 1, 2, 3, 4, 5], 6)
        before = np.concatenate([[-1], kind[:-1]])
        before[np.concatenate([[True], tbody[1:] != tbody[:-1]])] = -1
        follow = np.concatenate([kind[1:], [-1]])
        follow[np.concatenate([tbody[1:] != tbody[:-1], [True]])] = -1
        in_object = (inside_of >= 0) & (ch[np.maximum(inside_of, 0)] == 123)
        is_key = (kind == 5) & in_object & np.isin(before, (0, 3))
        value = np.isin(kind, (0, 1, 5, 6)) & ~is_key
        wrong = is_key & (follow != 4)
        wrong |= (kind == 4) & ~(np.concatenate([[False], is_key[:-1]]))
        wrong |= value & in_object & (before != 4)
        wrong |= value & (inside_of >= 0) & ~in_object & ~np.isin(before, (1, 3))
        wrong |= value & (inside_of < 0) & (before != -1)
        wrong |= (kind == 3) & ((inside_of < 0) | ~np.isin(before, (2, 5, 6)) | np.isin(follow, (2, 3, 4, -1)))
        wrong |= (kind == 2) & np.isin(before, (3, 4))
        wrong |= (kind == 4) & ~np.isin(follow, (0, 1, 5, 6))
        bad[tbody[wrong]] = True
        started = np.zeros(len(texts), bool)
        started[tbody] = True
        bad |= ~started

        stop = np.zeros(m, np.int64)
        marks = np.flatnonzero(quote & ~inside)
        strings = np.flatnonzero(kind == 5)
        nearest = np.searchsorted(marks, token[strings])
        stop[strings] = np.where(nearest < len(marks), marks[np.minimum(nearest, max(len(marks) - 1, 0))] if len(marks) else 0, n - 1) + 1
        stop[partner[closes][partner[closes] >= 0]] = token[closes[partner[closes] >= 0]] + 1
        plain = np.flatnonzero(kind == 6)
        finish = other & ~np.concatenate([other[1:] & (body_of[1:] == body_of[:-1]), [False]])
        where_ends = np.flatnonzero(finish)
        stop[plain] = where_ends[np.searchsorted(where_ends, token[plain])] + 1
        raw = data.tobytes()
        vkind = np.select([ch == 123, ch == 91, ch == 34], [_OBJ, _ARR, _STR], _SCALAR)
        # Literals and plain whole numbers are told by their bytes, all at once; only other numbers are looked at one by one.
        size = stop[plain] - token[plain]
        head = data[np.minimum(token[plain, None] + np.arange(16), n - 1)] if len(plain) else np.zeros((0, 16), np.uint8)
        spells = lambda word: (size == len(word)) & (head[:, : len(word)] == np.frombuffer(word, np.uint8)).all(1)
        null = spells(b"null")
        digits = ((head >= 48) & (head <= 57)) | (np.arange(16) >= size[:, None])
        whole = (size <= 16) & digits.all(1) & ((size == 1) | (head[:, 0] != 48))
        vkind[plain[null]] = _NULL
        for i in plain[~(null | spells(b"true") | spells(b"false") | whole)]:
            if not _NUMBER.match(raw[token[i] : stop[i]]):
                bad[tbody[i]] = True

        # Values only, in the order of the texts.
        v = np.flatnonzero(value & ~bad[tbody])
        new = np.full(m + 1, -1)
        new[v] = np.arange(len(v))
        self.raw, self.bad, self.body, self.start, self.stop = raw, bad, tbody[v], token[v], stop[v]
        self.parent, self.kind = new[inside_of[v]], vkind[v]
        by = np.argsort(self.parent, kind="stable")
        p = self.parent[by]
        first = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.zeros(0, bool)
        place = np.arange(len(p)) - np.maximum.accumulate(np.where(first, np.arange(len(p)), 0)) + 1
        self.place = np.empty(len(v), np.int64)
        self.place[by] = place
        self.size = np.bincount(self.parent[self.parent >= 0], minlength=len(v)) if len(v) else np.zeros(0, np.int64)
        self.key, self.digits = self._keys(data, token, stop, v, in_object)

    def _keys(self, data: np.ndarray, token: np.ndarray, stop: np.ndarray, v: np.ndarray, in_object: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keyed = in_object[v]
        name = np.where(keyed, v - 2, 0)  # key and colon stand before the value
        a, b = token[name] + 1, stop[name] - 1
        key = np.where(keyed, -2, -1)
        digits = np.zeros(len(v), bool)
        for number, word in enumerate(KEYS):
            want = np.frombuffer(word.encode(), np.uint8)
            cand = np.flatnonzero(keyed & (b - a == len(word)))
            if len(cand):
                key[cand[(data[a[cand, None] + np.arange(len(word))] == want).all(1)]] = number
        odd = np.flatnonzero(keyed & (data[np.minimum(a, len(data) - 1)] == 92))
        for i in odd:
            text = json.loads(b'"' + self.raw[a[i] : b[i]] + b'"')
            key[i] = KEYS.index(text) if text in KEYS else -2
        some = np.flatnonzero(keyed & (b > a) & (b - a <= 18))
        if len(some):
            longest = int((b - a)[some].max())
            at = a[some, None] + np.arange(longest)
            ch = data[np.minimum(at, len(data) - 1)]
            digits[some] = (((ch >= 48) & (ch <= 57)) | (at >= b[some, None])).all(1)
        return key, digits

    def child(self, key: str) -> np.ndarray:
        """For each value, its value under the key; -1 if none."""
        out = np.full(len(self.parent) + 1, -1)
        hit = np.flatnonzero(self.key == KEYS.index(key))
        out[self.parent[hit]] = hit  # the last of equal keys stays
        return out

    def elements(self, holders: np.ndarray, keyed: bool = False, texts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes in lists: (number in holders, place, value). holders: values that are lists, or lone ones where a list may stand."""
        holders = np.where(holders >= 0, holders, len(self.parent))
        kind = np.concatenate([self.kind, [0]])[holders]
        listed = kind == _ARR
        lone = kind == _OBJ
        if keyed and len(self.parent):
            inner = self.parent[self.parent >= 0]
            plain = np.bincount(inner, weights=~self.digits[self.parent >= 0], minlength=len(self.parent) + 1)
            by_number = lone & (plain[holders] == 0)
            listed, lone = listed | by_number, lone & ~by_number
        if texts:
            lone |= kind == _STR
        owner = np.full(len(self.parent) + 1, -1)
        owner[holders[listed]] = np.flatnonzero(listed)
        inside = np.flatnonzero(owner[self.parent] >= 0) if len(self.parent) else np.zeros(0, np.int64)
        inside = inside[self.parent[inside] >= 0]
        alone = np.flatnonzero(lone)
        number = np.concatenate([owner[self.parent[inside]], alone])
        place = np.concatenate([self.place[inside], np.ones(len(alone), np.int64)])
        value = np.concatenate([inside, holders[alone]])
        real = (self.kind[value] == _OBJ) & (self.size[value] > 0)
        if texts:
            real |= self.kind[value] == _STR
        return number[real], place[real], value[real]


def nodes_of(texts: list[bytes], is_set: np.ndarray) -> pd.DataFrame:
    """(text, node_kind, node_path, parent_path, place, start, stop) of a block; is_set: the text is a set of references, else of articles."""
    ix = Index(texts)
    top = np.flatnonzero(ix.parent < 0)
    wants = is_set[ix.body[top]] if len(top) else np.zeros(0, bool)
    frames = []

    def emit(kind: str, body: np.ndarray, path: np.ndarray, parent: np.ndarray | None, place: np.ndarray, value: np.ndarray) -> None:
        frames.append(pd.DataFrame({
            "text": body, "node_kind": np.full(len(body), kind, object), "node_path": path, "parent_path": np.full(len(body), None, object) if parent is None else parent,
            "place": place, "value": value,
        }))

    def below(kind: str, parents: tuple, holder: np.ndarray, **how) -> tuple:
        body, path, _ = parents
        number, place, value = ix.elements(holder, **how)
        own = np.char.add(np.char.add(path[number], "/"), place.astype(str)) if len(number) else np.zeros(0, "U1")
        emit(kind, body[number], own.astype(object), path[number].astype(object), place, value)
        return body[number], own, value

    def first(kind: str, holder: np.ndarray, bodies: np.ndarray, **how) -> tuple:
        number, place, value = ix.elements(holder, **how)
        own = place.astype(str)
        emit(kind, bodies[number], own.astype(object), None, place, value)
        return bodies[number], own, value

    roots = top[~wants]
    listed = ix.child("articles")[roots]
    articles = first("article", np.where(listed >= 0, listed, roots), ix.body[roots])
    sections = below("section", articles, ix.child("sections")[articles[2]])
    below("subsection", sections, ix.child("subsections")[sections[2]])
    roots = top[wants]
    inner = ix.child("set")[roots]
    sets = np.where(inner >= 0, inner, roots)
    held = np.where((ix.kind[sets] == _ARR), sets, ix.child("records")[sets])
    records = first("record", held, ix.body[roots], keyed=True)
    pubmed = below("pubmed", records, ix.child("pubmed")[records[2]])
    below("author", pubmed, ix.child("authors")[pubmed[2]], texts=True)
    out = pd.concat(frames, ignore_index=True)
    value = out.pop("value").to_numpy(np.int64)
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    base = offset[out["text"].to_numpy(np.int64)] if len(out) else 0
    out["start"], out["stop"] = ix.start[value] - base, ix.stop[value] - base
    return out


def _linked(with_json: bool):
    columns = ["payload_id", "node_kind", "node_path", "parent_path", "place"] + ["node_json"] * with_json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [unwrapped(b) for b in pdf["body"]]
            ids, sets = pdf["payload_id"].to_numpy(), (pdf["payload_kind"] == "reference_set").to_numpy()
            rows: list[int] = []
            size = 0
            for i in [*range(len(texts)), None]:
                if i is not None and texts[i] is None:
                    continue
                if rows and (i is None or size + len(texts[i]) > BLOCK):
                    own = [texts[r] for r in rows]
                    nodes = nodes_of(own, sets[rows])
                    nodes["payload_id"] = ids[rows][nodes["text"].to_numpy(np.int64)]
                    if with_json:
                        nodes["node_json"] = [own[t][a:b].decode("utf-8", "replace") for t, a, b in zip(nodes["text"], nodes["start"], nodes["stop"])]
                    yield nodes[columns].astype({c: object for c in columns if c not in ("payload_id", "place")})  # concatenated text columns may be in chunks
                    rows, size = [], 0
                if i is not None:
                    rows.append(i)
                    size += len(texts[i])

    return run


def payload_nodes(payloads: DataFrame, with_json: bool = False) -> DataFrame:
    """(payload_id, node_kind, node_path, parent_path, place): each node of each readable body, with its parent. with_json: also node_json, its text."""
    schema = "payload_id bigint, node_kind string, node_path string, parent_path string, place bigint" + ", node_json string" * with_json
    kept = payloads.select(F.col("payload_id").cast("bigint").alias("payload_id"), "payload_kind", "body").where(F.col("body").isNotNull())
    return kept.mapInPandas(_linked(with_json), schema)


#: Columns of the flat tables, by node kind.
FLAT = {
    "article": "citekey string, title string, authors array<string>, published string, source string, volume string, issue string, doi string",
    "section": "title string, type string, content string, paragraphs array<string>",
    "subsection": "title string, content string",
    "record": "index int, text string, doi string, pmid string, pubmedFound boolean, pubmed_found boolean, error string",
    "pubmed": "pmid string, doi string, title string, abstract string, journal string, year string, meshTerms array<string>, mesh_terms array<string>",
    "author": "family string, given string",
}


def flat_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The nodes of a kind as a flat table: payload_id, node_path, parent_path, place and the kind's fields; fields of the wrong type are null.

    An author given as a string has it as name; one given in parts has 'given family'."""
    own = nodes.where(F.col("node_kind") == kind)
    link = ["payload_id", "node_path", "parent_path", "place"]
    schema = T.StructType.fromDDL(FLAT[kind])
    parsed = own.select(*link, "node_json", F.from_json("node_json", schema).alias("f"))
    if kind == "author":
        text = F.get_json_object(F.concat(F.lit('{"v":'), "node_json", F.lit("}")), "$.v")
        parts = F.trim(F.concat_ws(" ", "f.given", "f.family"))
        return parsed.select(*link, F.when(F.col("node_json").startswith('"'), text).otherwise(parts).alias("name"))
    out = parsed.select(*link, "f.*")
    if kind == "record":
        out = out.withColumn("pubmed_found", F.coalesce("pubmed_found", "pubmedFound")).drop("pubmedFound")
    if kind == "pubmed":
        out = out.withColumn("mesh_terms", F.coalesce("mesh_terms", "meshTerms")).drop("meshTerms")
    return out
