import random

from edumill.llm import leak as L

NAMES, NOUNS = ["Orvik", "Cobri", "Wexa", "Dastin"], ["baskets of plums", "glass beads", "tin whistles", "paper kites"]


def items(n=12, seed=1):
    rng = random.Random(seed)
    make = lambda: rng.choice(["{0} sells {2} {3} at {4} coins each near the old mill.", "Only {2} of the {3} survive the journey that {0} makes with {1}.", "Show how many {3} {0} still needs to fill {2} crates before {1} returns home."]).format(rng.choice(NAMES), rng.choice(NAMES), rng.randrange(100), rng.choice(NOUNS), rng.randrange(100))
    return [(k, " ".join(make() for _ in range(4))) for k in range(n)]


def brute(doc, item):
    """Is any run of LEAST item words within EDITS word edits of some part of the document?"""
    d, ws = L.tokens(doc), L.tokens(item)
    for i in range(len(ws) - L.LEAST + 1):
        pattern = ws[i : i + L.LEAST]
        col = list(range(L.LEAST + 1))
        best = col[-1]
        for w in d:
            new = [0]
            for k in range(1, L.LEAST + 1):
                new.append(min(col[k - 1] + (pattern[k - 1] != w), col[k] + 1, new[-1] + 1))
            col = new
            best = min(best, col[-1])
        if best <= L.EDITS:
            return True
    return False


def test_equals_brute_force():
    rng = random.Random(7)
    pool = items()
    table = L.Templates(pool)
    hits = 0
    for case in range(150):
        _, text = rng.choice(pool)
        ws = L.tokens(text)
        n = rng.randrange(12, 32)
        at = rng.randrange(0, max(1, len(ws) - n))
        part = ws[at : at + n]
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], ["zebra"], [part[k], "zebra"]])
        doc = "Results were weak but stable. " + " ".join(part).upper() + ", the report says."
        got = {i for i, kind, _ in table.leaks(doc) if kind == "literal"}
        want = {i for i, t in pool if brute(doc, t)}
        assert got == want, (case, doc)
        hits += len(want)
    assert hits > 30


def test_filled_anew_is_a_template_leak_only():
    pool = items()
    table = L.Templates(pool)
    text = pool[0][1]
    for a, b in (("Orvik", "@1"), ("Cobri", "@2"), ("Wexa", "@3"), ("Dastin", "@4"), ("@1", "Cobri"), ("@2", "Wexa"), ("@3", "Dastin"), ("@4", "Orvik")):
        text = text.replace(a, b)
    text = "".join("7" if c.isdigit() else c for c in text)
    kinds = {i: k for i, k, _ in table.leaks(text)}
    assert kinds.get(0) in ("template", "literal") and table.leaks(pool[0][1])[0][:2] in ((0, "literal"),)


def test_edge_cases(spark):
    pool = items()
    docs = spark.createDataFrame([(1, "x. " + pool[3][1].replace(" ", "\n")), (2, None), (3, ""), (4, "short"), (1, pool[3][1]), (None, pool[3][1]), (5, "word " * 50000 + pool[2][1].replace("and", "&amp;"))], "doc_id long, text string")
    ev = spark.createDataFrame(pool + [(99, None), (98, "too short"), (None, "x")], "item_id long, text string")
    got = L.leaks(docs, ev).where("kind = 'literal'").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got if r["item_id"] in (2, 3))[:3] == [(1, 3), (1, 3), (5, 2)]
    assert L.leaks(docs.limit(0), ev).count() == 0 and L.leaks(docs, ev.limit(0)).count() == 0


ITEM = "Orvik sells 12 baskets of plums and 30 paper kites to Cobri near the old mill, then Orvik counts 12 coins before Cobri walks 30 miles home."


def filled(names, numbers, unit="miles"):
    a, b = names
    x, y, z, w = numbers
    return f"{a} sells {x} baskets of plums and {y} paper kites to {b} near the old mill, then {a} counts {z} coins before {b} walks {w} {unit} home."


def test_fresh_names_numbers_and_units():
    more = [(7, "Near the mill Orvik met Cobri after 40 miles and 9 coins were enough for Orvik, said Cobri quietly to the old man there.")]
    kinds = lambda doc: {i: k for i, k, _ in L.Templates([(1, ITEM), *more]).leaks(doc)}.get(1)
    assert kinds(ITEM) == "literal"
    assert kinds(filled(("Maria", "Peter"), (40, 77, 40, 77))) == "template"  # names that no item has
    assert kinds("As asked before: " + filled(("Nina", "Paul"), (5, 6, 5, 6), "furlongs").upper()) == "template"
    assert kinds(filled(("Maria", "Peter"), (40, 77, 41, 77))) is None  # the item's two equal numbers became two
    assert kinds(filled(("Maria", "Maria"), (40, 77, 40, 77))) is None  # two names became one
    assert kinds(filled(("Maria", "Peter"), (40, 77, 40, 77)).replace("counts", "hides").replace("kites", "boats")) is None


def test_many_items_by_join_give_the_same(spark, monkeypatch):
    pool = items(40) + [(77, ITEM)]
    docs = [(k, "Before. " + t + " After.") for k, t in pool] + [(5, filled(("Maria", "Peter"), (40, 77, 40, 77))), (5, "nothing to see here"), (6, None)]
    docs, ev = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(pool, "item_id long, text string")
    one = sorted(map(tuple, L.leaks(docs, ev).collect()))
    monkeypatch.setattr(L, "BLOCK", 5)
    monkeypatch.setattr(L, "FILTER_BITS", 1 << 14)
    assert sorted(map(tuple, L.leaks(docs, ev).collect())) == one and {r[2] for r in one} == {"literal", "template"}
