import datetime as dt
import itertools
import random

import duckdb
from pyspark.sql import functions as F

from edumill.llm import golden as G
from edumill.llm import queries as Q


def brute_force(rows, trust):
    """Groups by repeated merging and the best intact value per field, in plain Python."""
    import re

    skip = set(G.PLACEHOLDERS)
    plain = lambda s: " ".join(s.lower().split())

    def doi(s):
        m = re.search(r"10\.[0-9]{4,9}/.*[a-z0-9]", "".join((s or "").lower().split()))
        return m and m[0]

    def title(s):
        if s is None or plain(s) in skip or re.search(r"(…|\.\.\.|\[\.\.\.\])\s*$", s) or s.lower().startswith(("microsoft word", "untitled")):
            return None
        return re.sub(r"[\W_]", "", s.lower().replace("ß", "ss").replace("ı", "i").replace("̇", "")) or None

    def name(s):
        if s is None or plain(s) in skip:
            return None
        return re.sub(r"(^copy of\s+|\s*\(\d+\)(?=\.[a-z0-9]+$)|[\s_-]+copy(?=\.[a-z0-9]+$))", "", plain(s))

    by_name = {}
    for r in rows:
        if name(r["file_name"]):
            by_name.setdefault(name(r["file_name"]), set()).add(doi(r["doi"]))
    shared = {k for k, v in by_name.items() if len(v - {None}) > 1}
    label = {r["row_id"]: r["row_id"] for r in rows}
    keys = {}
    for r in rows:
        for k in (("d", doi(r["doi"])), ("t", title(r["title"])), ("f", None if name(r["file_name"]) in shared else name(r["file_name"]))):
            if k[1]:
                keys.setdefault(k, []).append(r["row_id"])
    changed = True
    while changed:
        changed = False
        for ids in keys.values():
            low = min(label[i] for i in ids)
            for i in ids:
                if label[i] != low:
                    label[i], changed = low, True
    groups = {}
    for r in rows:
        groups.setdefault(label[r["row_id"]], []).append(r)
    out = set()
    for first, g in groups.items():
        if len(g) < 2:
            continue
        g = sorted(g, key=lambda r: (trust.get(r["corpus"], 2**31), -r["extraction_timestamp"].timestamp(), r["row_id"]))
        pick = lambda f, ok: next((r[f] for r in g if r[f] is not None and ok(r[f])), None)
        d = pick("doi", lambda v: re.fullmatch(r"10\.[0-9]{4,9}/\S*[A-Za-z0-9]", v))
        whole = {title(r["title"]) for r in g} - {None}
        t = pick("title", lambda v: title(v) and not any(w != title(v) and w.startswith(title(v)) for w in whole) and v.upper() != v and not re.search(r"^\s|\s$|\s\s|[\n\t\r\xa0 ]", v))
        f = pick("file_name", lambda v: name(v) and name(v) not in shared and name(v) == v.lower().strip())
        out.add((first, f, d and d.lower(), t))
    return out


def test_equals_brute_force(spark, sf):
    cur = duckdb.sql(f"select row_id, corpus, file_name, title, doi, extraction_timestamp from '{sf}/metadata.parquet'")
    names = [x[0] for x in cur.description]
    rows = [dict(zip(names, r)) for r in cur.fetchall()]
    trust = dict(duckdb.sql(f"select corpus, trust_rank from '{sf}/corpus_trust.parquet'").fetchall())
    assert {tuple(r) for r in Q.p1_found(spark, sf).collect()} == brute_force(rows, trust)


def test_branch_and_bound_equals_trying_all():
    rng = random.Random(1)
    for _ in range(60):
        order = ["doi", "people", "imprint"]
        pools = {b: [((f"{b}{k}",), True if b == "doi" else None, rng.choice([True, None])) for k in range(rng.randrange(0, 4))] for b in order}
        depends = {"people": "doi", "imprint": "doi"}
        got = G.choose(pools, depends, order)
        widest = max([len(v) for v in pools.values()] + [1]) + 1
        best = None
        for combo in itertools.product(*[list(range(len(pools[b]))) or [None] for b in order]):
            chosen = {b: None if k is None else pools[b][k] for b, k in zip(order, combo)}
            lead = chosen["doi"]
            if lead and any(chosen[b] and any(c[-1] == lead[-2] for c in pools[b]) and chosen[b][-1] != lead[-2] for b in depends):
                continue
            cost = sum(widest ** (3 - i) * (k or 0) for i, k in enumerate(combo))
            if best is None or cost < best[0]:
                best = (cost, chosen)
        assert got == best[1]


def test_edge_cases(spark):
    t = dt.datetime(2021, 1, 1)
    rows = [
        (1, "x", "a.pdf", None, "10.1234/ab", t, "k"), (2, None, "a (1).pdf", "A Real Title", "DOI: 10.1234/AB.", None, "k"), (3, "y", "fulltext.pdf", "A REAL TITLE", None, t, "k"),
        (4, "y", "fulltext.pdf", "N/A", "10.1234/cd", t, "k"), (5, "y", "fulltext.pdf", "N/A", "10.1234/ef", t, "k"), (6, None, None, None, None, None, None), (7, "x", "b.pdf", "Long " * 20000, "10.", t, "k"), (7, "x", "b.pdf", "Long " * 20000, "10.", t, "k"),
    ]
    df = spark.createDataFrame(rows, "row_id long, corpus string, file_name string, title string, doi string, extraction_timestamp timestamp_ntz, component string")
    trust = spark.createDataFrame([("x", 0), ("y", 1)], "corpus string, trust_rank int")
    intact = {"file_name": Q._file_intact(), "doi": Q._doi_intact(), "title": G.title_intact(F.col("title"))}
    run = lambda d: {r["first_row_id"]: (r["n_rows"], r["file_name"], r["doi"], r["title"]) for r in G.survivors(d, trust, {b: [b] for b in intact}, intact, {}).collect()}
    got = run(df)
    assert got[1] == (3, "a.pdf", "10.1234/ab", "A Real Title") and set(got) == {1} or got.get(7, (None,))[1] == "b.pdf"
    assert run(df.limit(0)) == {}


def test_a_title_cut_without_a_mark_is_not_intact(spark):
    rows = [(1, "A", "x.pdf", "10.1234/a", "Reading in Zor: a stu", None), (2, "B", "y.pdf", "10.1234/a", "Reading in Zor: a study", None), (3, "A", "z.pdf", "10.1234/b", "Reading in Zor", None), (4, "B", "z.pdf", "10.1234/b", None, None)]
    df = spark.createDataFrame(rows, "row_id long, corpus string, file_name string, doi string, title string, extraction_timestamp timestamp_ntz")
    trust = spark.createDataFrame([("A", 1), ("B", 2)], "corpus string, trust_rank int")
    got = {r["first_row_id"]: r["title"] for r in G.survivors(df, trust, {"title": ["title"]}, {"title": Q._title_intact()}, {}).collect()}
    assert got == {1: "Reading in Zor: a study", 3: "Reading in Zor"}
