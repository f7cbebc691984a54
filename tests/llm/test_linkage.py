import numpy as np

from papergrid.llm import linkage as L

WORKS = [
    (1, "Loss of XVL24A leads to diffuse innervation in the muscle of controls", ["Barek, Drali"], "Acta Experimental Marrow Biology", "2010", "58", "877"),
    (2, "LOSS OF <i>XVL24</i>A LEADS TO DIFFUSE INNERVATION IN THE MUSCLE OF CONTROLS.", ["Barek DK"], "Acta Exp Marrow Biol", "2010", None, None),
    (3, "Loss of XVL24A leads to diffuse innervation in the muscle of controls: two-year results", ["Barek, Drali"], "Acta Experimental Marrow Biology", "2012", "60", "12"),
    (4, "Erratum to: Loss of XVL24A leads to diffuse innervation in the muscle of controls", ["Barek, Drali"], "Acta Experimental Marrow Biology", "2010", "58", "1877"),
    (5, "BQL19 and CTX9R in limited remodelling of bronchus. Part 1", ["Gatum, Joel"], "Archives of Clinical Cortex Research", "2004", "39", "820"),
    (6, "BQL19 and CTX9R in limited remodelling of bronchus. Part 2", ["Gatum, Joel"], "Archives of Clinical Cortex Research", "2004", "39", "1085"),
    (7, None, None, None, None, None, None),
    (8, "Role of KDL22 during enamel inflammation measured by interviews", None, "Acta Experimental Marrow Biology", None, None, None),
]
RECORDS = [
    (10, "Barek DK. Loss of XVL24A leads to difuse innervation in hte muscle of controls. Acta Exp Marrow Biol. 2010;58(3):877-880. Crossref PubMed"),
    (11, "20. Loss of XVL24A leads to diffuse innervation in the muscle of controls. Acta Experimental Marrow Biology (2010)"),
    (12, "Gatum, J. M. (2004). BQL19 and CTX9R in limited remode11ing of bronchus. Part 2. Arch Clin Cortex Res, 39, 1085–1090."),
    (13, "D. K. Barek, “Erratum to: Loss of XVL24A leads to diffuse innervation in the muscle of controls,” Acta Exp Marrow Biol, vol. 58, pp. 1877, 2010"),
    (14, "Barek DK. Something else entirely about another matter. Acta Exp Marrow Biol. 1999;1(1):1-2."),
    (15, None), (16, ""), (17, "   "), (18, "Barek DK Acta Exp Marrow Biol 58, 877 (2010)"), (None, "x"),
]
WANT = {(10, 1), (10, 2), (11, 1), (11, 2), (12, 6), (13, 4), (18, 1)}


def test_linkage(spark):
    works = spark.createDataFrame(WORKS, "work_id bigint, title string, authors array<string>, journal string, pub_year string, volume string, first_page string")
    records = spark.createDataFrame(RECORDS + RECORDS[:1], "ref_id bigint, text string").selectExpr("*", "'clash' AS title", "1 AS h1")
    journals = spark.createDataFrame([("Acta Experimental Marrow Biology", "Acta Exp Marrow Biol"), ("Archives of Clinical Cortex Research", "Arch Clin Cortex Res")], "full_name string, short_name string")
    rows = L.link(records, works, journals).collect()
    assert L.link(records.limit(0), works.limit(0), journals.limit(0)).count() == 0
    got = {(r.ref_id, r.work_id) for r in rows}
    assert len(rows) == len(got)
    assert got == WANT
    assert all(0.5 <= r.confidence <= 1 for r in rows)


def _random_blocks(rng, count, most=6):
    sizes = rng.integers(1, most + 1, count)
    n = int(sizes.sum())
    truth = np.zeros((n, len(L.SUPPORT + L.AGAINST)))
    truth[:, :2] = rng.random((n, 2)) * rng.integers(0, 2, (n, 2))
    truth[:, 2:] = rng.integers(0, 2, (n, truth.shape[1] - 2)) * (rng.random((n, truth.shape[1] - 2)) < 0.3)
    fields = [rng.integers(1, 3, n), *(rng.integers(0, 3, n) for _ in range(4))]
    return sizes, truth, rng.integers(0, n, n), tuple(f.astype(np.int32) for f in fields)


def _loss(p, x):
    over = np.bincount(p["rule"], weights=p["coef"] * x[p["at"]], minlength=len(p["bound"])) - p["bound"]
    return float((p["weight"] * np.maximum(over, 0)).sum() + L.CONVEX / 2 * (x**2).sum())


def test_solver_against_grid():
    """The minimum, as shipped, is not above any point of a grid."""
    rng = np.random.default_rng(0)
    for _ in range(12):
        sizes, truth, _, fields = _random_blocks(rng, 1, 2)
        p = L.problem(sizes, truth, np.arange(len(truth)), fields)
        size, x = p["size"], L._least(p)
        grid = np.linspace(0, 1, 11)
        best = min(_loss(p, np.array(v)) for v in np.stack(np.meshgrid(*[grid] * size), -1).reshape(-1, size))
        assert _loss(p, x) <= best + 0.002
    assert len(L.solve(np.zeros(0, int), np.zeros((0, truth.shape[1])), np.zeros(0, int), tuple(np.zeros(0, np.int32) for _ in range(5)))) == 0


def test_solver_runs_to_the_end():
    """No decision of the shipped setting is another one after a far longer run."""
    sizes, truth, ids, fields = _random_blocks(np.random.default_rng(1), 400)
    short, long = (L.solve(sizes, truth, ids, fields, tolerance=t, most=m) for t, m in ((L.TOLERANCE, 20_000), (1e-9, 60_000)))
    assert np.abs(short - long).max() <= 0.002
    assert ((np.round(short, 2) >= L.MATCH) == (np.round(long, 2) >= L.MATCH)).all()


def test_consensus(spark, monkeypatch):
    """Texts in groups of their own, which share identities, come to the decisions of one problem over all texts."""
    import pandas as pd

    rng = np.random.default_rng(4)
    rows = [(["w1", "w2"], rng.random()) for _ in range(12)]
    truth = np.zeros((24, len(L.SUPPORT + L.AGAINST)), np.float32)
    truth[0::2, 0] = [0.4 + 0.6 * r for _, r in rows]
    truth[1::2, 0] = 0.1
    sizes, ids = np.full(12, 2), np.tile([7, 8], 12)
    fields = (np.full(24, 5, np.int32), np.tile(np.array([2001, 2002], np.int32), 12), *(np.zeros(24, np.int32) for _ in range(3)))
    want = L.solve(sizes, truth, ids, fields)
    data = [
        (i, i, i, [7, 8], [7, 8], truth[2 * i : 2 * i + 2].ravel().tolist(), *([int(x) for x in f[2 * i : 2 * i + 2]] for f in fields)) for i in range(12)
    ]
    blocks = spark.createDataFrame(data, L._BLOCK)
    one = {(r.h1, r.w1): r.confidence for r in L._settled(blocks).collect()}
    monkeypatch.setattr(L, "GROUP_TEXTS", 1)
    many = {(r.h1, r.w1): r.confidence for r in L._settled(blocks, 0).collect()}
    assert {(r.h1, r.w1) for r in L._settled(blocks, 1).collect()} == set(many)
    assert set(one) == {(i // 2, int(ids[i])) for i in range(24) if round(want[i], 2) >= L.MATCH}
    assert set(many) == set(one) and pd.Series(many).sub(pd.Series(one)).abs().max() <= 0.06


def test_scoring_is_quick():
    """No index of a text's words is made for the few words that a title lacks there: the calls a pair takes are bounded."""
    import cProfile
    import pstats

    texts = [f"{i}. Barek DK, Mön E. Loss of XVL{i}A leads to difuse innervation in the muscle. Acta Exp Marrow Biol. 2010;58(3):{i}-880. doi: 10.1/x{i}" for i in range(300)]
    titles = [f"loss of xvl{i}a leads to diffuse innervation in the muscle of controls" for i in range(300)]
    run = lambda: [L.title_truth(L.seen(text), title.split(), title.replace(" ", "")) for text, title in zip(texts, titles)]
    run()
    profile = cProfile.Profile()
    profile.runcall(run)
    assert pstats.Stats(profile).total_calls < 250 * len(texts)


def test_agreement_is_that_of_identity():
    """The rule for two rows and the one for arrays of rows are the same, and so are those for rising rows."""
    rng = np.random.default_rng(2)
    for _ in range(2000):
        rows = np.stack([rng.integers(0, 3, 2), rng.choice([0, 2001, 2002, 2003], 2), *(rng.integers(0, 3, 2) for _ in range(3))]).astype(np.int32)
        assert L._agree(*map(tuple, rows.T.tolist())) == bool(L.identity(np.array([0]), np.array([1]), *rows)[0][0] > 0)
    against = [0.0] * len(L.AGAINST)
    assert L._rises([0.2, 0.0, *against]) and not L._rises([0.0, 0.0, *against]) and not L._rises([0.2, 0.0, 0.0, 1.0, *against[2:]])
    assert L._rises([0.2, 0.0, 0.0, 1 - 1e-9, *against[2:]]) and not L._rises([0.2, 0.0, 0.0, 1 - 1e-9, *against[2:]], L._ONE)


def test_words_and_edits():
    assert L.words("Ro1e of ENAME1, β-x") == ["role", "of", "enamel", "β", "x"]
    assert L._near("fibrosis", "firbosis") and L._near("fibrosis", "fibrosi") and not L._near("fibrosis", "necrosis")
    for a, b in (("ahead", "haead"), ("tissue", "issue"), ("tissue", "tissuex"), ("bone", "cone"), ("bone", "bony")):
        assert L._close(a, L._by_ends({b})) and L._near(a, b)
    assert L._surname("van Joson, Joro") == "joson" and L._surname("van Joson JJ") == "joson" and L._surname(None) == ""
    item, key = L.text_keys(["", "one two"])
    assert len(item) == 0 and key.dtype == np.uint64


WORK = "work_id bigint, title string, authors array<string>, journal string, pub_year string, volume string, first_page string"
JOURNAL = "full_name string, short_name string"
NOUNS = "enamel bronchus marrow cortex retina tendon kidney spleen uterus larynx".split()
VERBS = "swelling scarring repair atrophy perfusion drainage necrosis growth ageing loss".split()
SIGHTS = "interviews biopsy autopsy imaging sequencing staining palpation dialysis culture microscopy".split()


def _other(i):
    a, b, c = i % 10, i // 10 % 10, (i + i // 10) % 10
    return f"{VERBS[b].title()} of {NOUNS[a]} measured through {SIGHTS[c]} of {NOUNS[(a + b + 1) % 10]} donors {chr(97 + a)}{chr(97 + b)}qx"


def _linked(spark, titles, texts):
    """Titles of works 0, 1, ... and texts of records 0, 1, ... without volume and page."""
    works = spark.createDataFrame([(i, t, ["Barek, Drali"], "Acta Experimental Marrow Biology", "2010", None, None) for i, t in enumerate(titles)], WORK)
    records = spark.createDataFrame(list(enumerate(texts)), "ref_id bigint, text string")
    journals = spark.createDataFrame([("Acta Experimental Marrow Biology", "Acta Exp Marrow Biol")], JOURNAL)
    return {(r.ref_id, r.work_id) for r in L.link(records, works, journals).collect()}


def test_hot_publication(spark):
    """A third of the rows are copies of one publication: its words stay in keys."""
    hot = "Diffuse innervation of thymus in obese lactating rodents"
    titles = [hot if i % 2 else hot.upper() + "." for i in range(50)] + [_other(i) for i in range(100)]
    got = _linked(spark, titles, [f"Barek DK. {hot}. Acta Exp Marrow Biol. 2010.", f"Barek DK. {hot.replace('Diffuse', 'Difuse')}. Acta Exp Marrow Biol. 2010."])
    assert got == {(r, w) for r in range(2) for w in range(50)}


def test_near_equal_titles(spark):
    """A third of the titles differ in one word or two: their common words stand in keys beside these."""
    hot = [f"Diffuse innervation of thymus in lactating rodents given {a}{b}zolamide" for a in ("bar", "kem", "tof", "vul", "wix") for b in ("dra", "gol", "nup", "sem", "tri", "pex")]
    titles = hot + [_other(i) for i in range(60)]
    texts = [f"Barek DK. {t}. Acta Exp Marrow Biol. 2010." for t in hot] + [f"Barek DK. {hot[7].replace('thymus', 'tyhmus')}. Acta Exp Marrow Biol."]
    assert _linked(spark, titles, texts) == {(i, i) for i in range(30)} | {(30, 7)}


def test_titles_of_common_words(spark):
    """All words stand in very many titles, or in no key at all: the whole title is one."""
    titles = ["Loss of bronchus measured through biopsy of tendon donors", "Randomized controlled trial", "Atrophy of retina: 12 cases"] + [_other(i) for i in range(100)]
    texts = [f"{t}. Acta Exp Marrow Biol. 2010." for t in titles[:3]] + ["Loss of bronchus measured through biopsy of tendon donors. Acta Exp Marrow Biol."]
    assert {(i, i) for i in range(3)} | {(3, 0)} <= _linked(spark, titles, texts)


def test_one_title_of_many_rows(spark):
    """10,000 rows of one title, each another publication: a text meets its own, and rows of the title stay in chunks."""
    n = 10_000
    works = [(i, "Notes from the editorial office", ["Barek, Drali"], "Acta Experimental Marrow Biology", str(1990 + i % 30), str(i % 97 + 1), str(3000 + i)) for i in range(n)]
    df = spark.createDataFrame(works, WORK)
    keyed = df.selectExpr("work_id", "title", "authors[0] AS author", "journal", "pub_year AS year", "volume", "first_page AS page", "work_id AS w1", "work_id AS w2")
    chunks = L.families(keyed).selectExpr("size(split(rows, chr(30))) AS n").collect()
    assert sum(r.n for r in chunks) == n and max(r.n for r in chunks) < 3 * L.FAMILY_MOST
    texts = [f"Barek D. Notes from the editorial office. Acta Exp Marrow Biol. {1990 + i % 30};{i % 97 + 1}(2):{3000 + i}-{3009 + i}." for i in (5, 4321, 9999)]
    journals = spark.createDataFrame([("Acta Experimental Marrow Biology", "Acta Exp Marrow Biol")], JOURNAL)
    got = {(r.ref_id, r.work_id) for r in L.link(spark.createDataFrame(list(enumerate(texts)), "ref_id bigint, text string"), df, journals).collect()}
    assert got == {(0, 5), (1, 4321), (2, 9999)}


def test_hot_text_and_hot_key(spark):
    """A third of the records are one text, and a phrase stands in most texts: hot keys go to buckets of their own, with the same links."""
    titles = [_other(i) + " in the hospitals of the northern coast" for i in range(90)]
    texts = [f"Barek DK. {titles[i % 90]}. Acta Exp Marrow Biol. 2010." if i % 3 else f"Barek DK. {titles[7]}. Acta Exp Marrow Biol. 2010." for i in range(600)]
    got = _linked(spark, titles, texts)
    assert len(L.hot_keys(L.text_keys(sorted(set(texts))), len(set(texts)))) == 0  # too few texts for a sample
    keys = L.text_keys(texts)
    assert len(L.hot_keys(keys, len(texts))) > 0
    assert got == {(i, i % 90 if i % 3 else 7) for i in range(600)}


def _pairs(rng, texts=60):
    """A batch of texts, each with rows of its own title, of near titles and of others, whose fields agree with it or contradict it."""
    import pyarrow as pa

    near = [f"diffuse innervation of thymus in lactating rodents given {a}zolamide" for a in ("bar", "kem", "tof", "vul")]
    out = []
    for h in range(texts):
        year, volume, page = (int(x) for x in rng.integers((1990, 1, 100), (2020, 99, 999)))
        title = str(rng.choice(near)) if h % 3 else _other(h)
        out_of = [title, title, *near, _other(h + 1)]
        date, sign = ("", "") if h % 7 == 0 else (f" {year}", ";")
        text = f"Barek DK. {title}. Acta Exp Marrow Biol.{date}{sign}{volume}(3):{page}-{page + 5}."
        for f, t in enumerate(out_of):
            rows = []
            for k in range(int(rng.integers(1, 4))):
                own = lambda x: "" if (r := rng.integers(0, 4)) == 0 else str(x + (r == 1) * int(rng.integers(1, 9)))
                w = 100 * (100 * h + f) + k
                rows.append(L.packed_row(w, w, str(rng.choice(["Barek, D.", "Gatum, J."])), "Acta Exp Marrow Biol" if k else "Archives of Cortex", own(year), own(volume), own(page)))
            out.append((h, h, text, 100 * h + f, " ".join(L.words(t)), "\x1e".join(rows)))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["h1", "h2", "text", "f", "title", "rows"])


def test_contradicted_rows_wait(monkeypatch):
    """A row that can't rise has its title looked at only where it agrees with one that rises; the blocks are those of scoring every row."""
    batch = _pairs(np.random.default_rng(5))
    calls, real = [], L.title_truth
    monkeypatch.setattr(L, "title_truth", lambda *a: calls.append(1) or real(*a))
    run = lambda: [r for b in L._score({})(iter([batch.slice(0, 150), batch.slice(150)])) for r in b.to_pylist()]
    got, waited = run(), len(calls)
    calls.clear()
    monkeypatch.setattr(L, "WAITING_MOST", -1)
    assert got == run() and len(got) > 30 and max(len(r["w1"]) for r in got) > 2
    assert waited < 0.8 * len(calls)
