import random
from itertools import permutations

from scenekiln.llm.filter_audit import audit, steps

DOCS, LABELS = "doc_id long, text string, lang string, good string, `a.b` map<string,int>", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """(part, order, step) to the seven counts, by following every document through every order."""
    text = lambda d: d[1] or ""
    least = {}
    for d in docs:
        if d[0] is not None:
            least[text(d)] = min(d[0], least.get(text(d), d[0]))
    rows = []
    for d in docs:
        t = text(d)
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        w = [x for x in t.split(" ") if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= x <= "Z" for x in t) > 10 * len(t), "D": any(x in t for x in "#$%&*|"), "E": d[0] is not None and d[0] > least[text(d)]}
        own = [x for x in labels if x[0] is not None and x[0] == d[0]]
        rows.append((d[2] or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, worth = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                out[part, "".join(order), i + 1] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                worth[part, f] = worth.get((part, f), 0) + len(gone)
    return {k: (*v, worth[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def listed(df):
    rows = [(r.part, r.filter_order, r.step, (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)) for r in df.collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3] for r in rows}


def test_against_following_every_document(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "cd", "É", "e#", "x"]) + str(rng.randrange(rng.choice([3, 900])))
    texts = [rng.choice([" ", "\t", "\n ", "\x0b"]).join(word() for _ in range(rng.choice([0, 1, 30, 99, 100, 101, 300]))) for _ in range(60)] + [None, "", " \n", "A" * 5000]
    docs = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["en", "de", "", None]), "x", None) for _ in range(150)]
    docs += [(3, texts[0], "en", "x", None)] * 50  # one row in a quarter of all
    labels = [(rng.choice([*range(45), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    found = listed(audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    assert {k: v for k, v in found.items() if k[0] is not None} == brute(docs, labels)
    whole = [(*d[:2], "", *d[3:]) for d in docs]  # all parts as one
    assert {k[1:]: v for k, v in found.items() if k[0] is None} == {k[1:]: v for k, v in brute(whole, labels).items()}


def test_empty_tables_and_plan(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit(docs, labels).filter("part IS NOT NULL").count() == 0
    one = listed(audit(spark.createDataFrame([(1, None, None, "", None)], DOCS), labels))
    assert len(one) == 1200 and {v[4:6] for v in one.values()} == {(0, 0)}
    assert len(steps()) == 600 and {s[4] for s in steps() if s[1] == 5} == {31}
