import json
import random

import pandas as pd

from papergrid.operators import nested


def by_parser(kind, body):
    """Nodes by a recursive parser."""
    value = body
    try:
        while isinstance(value, str):
            value = json.loads(value.lstrip("﻿"))
    except ValueError:
        return set()
    out = set()

    def each(x, keyed=False, texts=False):
        if isinstance(x, dict):
            x = list(x.values()) if keyed and all(k.isdigit() for k in x) else [x]
        elif isinstance(x, str) and texts:
            x = [x]
        return [(i, e) for i, e in enumerate(x if isinstance(x, list) else (), 1) if (isinstance(e, dict) and e) or (texts and isinstance(e, str))]

    get = lambda x, k: x.get(k) if isinstance(x, dict) else None
    if kind == "article":
        for a, x in each(value.get("articles", value) if isinstance(value, dict) else value):
            out.add(("article", f"{a}"))
            for s, y in each(get(x, "sections")):
                out.add(("section", f"{a}/{s}"))
                out |= {("subsection", f"{a}/{s}/{u}") for u, _ in each(get(y, "subsections"))}
    else:
        value = value.get("set", value) if isinstance(value, dict) else value
        for r, x in each(value.get("records") if isinstance(value, dict) else value, keyed=True):
            out.add(("record", f"{r}"))
            for p, y in each(get(x, "pubmed")):
                out.add(("pubmed", f"{r}/{p}"))
                out |= {("author", f"{r}/{p}/{n}") for n, _ in each(get(y, "authors"), texts=True)}
    return out


def found(bodies):
    pdf = pd.DataFrame({"payload_id": range(len(bodies)), "payload_kind": [k for k, _ in bodies], "body": [b for _, b in bodies]})
    parts = list(nested._linked(True)(iter([pdf])))
    out = pd.concat(parts) if parts else pd.DataFrame(columns=["payload_id", "node_kind", "node_path"])
    return {i: set(zip(g.node_kind, g.node_path)) for i, g in out.groupby("payload_id")}


CASES = [
    ("article", '{"sections": [null, {}, {"title": "x", "subsections": {"title": "lone"}}], "title": "a\\"}{[\\\\"}'),
    ("article", '﻿{"articles": [{"sections": {"title": "lone"}}, null, {"k": 1}]}'),
    ("article", json.dumps(json.dumps({"citekey": "k", "sections": [{"subsections": [{"t": 1}, None, {"u": []}]}]}))),
    ("reference_set", '{"set": {"records": {"3": {"text": "a"}, "1": null, "2": {"pubmed": [{"authors": ["A", {"family": "B"}, null]}, {}]}}}}'),
    ("reference_set", '{"records": {"text": "lone", "pubmed": {"authors": "Single"}}}'),
    ("reference_set", '{"records": [{"a": 1}], "records": [{"b": 1}, {"c": 2}]}'),
    ("reference_set", '[{"x": 1}]'),
    ("article", "[]"), ("article", "{}"), ("article", "null"), ("article", "12"), ("article", ""), ("article", None), ("article", '{"a": '), ("article", '{"a": 01}'),
    ("article", "{'a': 1}"), ("article", '{"a": "\x01"}'), ("article", '{"\\u0073ections": [{"t": 1}]}'),
]


def test_cases():
    got = found(CASES)
    for i, (kind, body) in enumerate(CASES):
        assert got.get(i, set()) == (by_parser(kind, body) if body else set()), body


def test_grammar_by_fuzz():
    rng = random.Random(5)
    seeds = ['{"a":1,"b":[true,null,-2.5e3]}', '[{"x":"q\\"\\\\"},[],{}]', '{"a":{"b":{"c":[[1],{"d":"\\u00e9"}]}}}', '"x"']
    for _ in range(1500):
        s = rng.choice(seeds)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(s) + 1)
            s = rng.choice((s[:i] + s[i + 1 :], s[:i] + rng.choice('{}[]:,"\\ 1nu') + s[i:], s[:i]))
        if s[:1] not in ("{", "["):
            continue
        try:
            json.loads(s)
            good = True
        except ValueError:
            good = False
        bad = nested.Index([b"[1]", s.encode(), b'{"z":2}']).bad
        assert (bad[0], bad[1], bad[2]) == (False, not good, False), s


def test_flat_tables(spark):
    df = spark.createDataFrame([(i, k, b, "x") for i, (k, b) in enumerate(CASES)], "payload_id bigint, payload_kind string, body string, node_path string")
    nodes = nested.payload_nodes(df, with_json=True)
    authors = {(r.payload_id, r.node_path): r.name for r in nested.flat_table(nodes, "author").collect()}
    assert authors == {(3, "3/1/1"): "A", (3, "3/1/2"): "B", (4, "1/1/1"): "Single"}
    assert [r.text for r in nested.flat_table(nodes, "record").where("payload_id = 3 AND node_path = '1'").collect()] == ["a"]
    assert nested.payload_nodes(df.limit(0)).count() == 0
