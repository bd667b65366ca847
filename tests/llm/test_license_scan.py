import random
import re

from scenekiln.llm import license_scan
from scenekiln.llm.license_scan import BASE, NOTICES, THRESHOLD, scan


def brute(text, templates=BASE + NOTICES):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, base, labels, score = [], set(), set(), 0.0
    stride = max(len(t.words) for t in templates)
    blocks = [set(words[i : i + 2 * stride]) for i in range(0, len(words), stride)]
    for t in templates:
        own = t.words
        need = t.needed(THRESHOLD)
        shares = [len(b & set(own)) / len(set(own)) for b in blocks if len(b & set(own)) >= need]
        score = max([score, *shares])
        if t.exact:
            at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            starts += at
            base |= {t.label} if at else set()
        elif shares:
            labels.add(t.label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def test_against_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "!!", "MIT License", "the mit-license; MIT  LICENSE mit", "license mit", "É mit license", "mit\x00license", "mit license mit license"] * 2
    vocabulary = sorted({w for t in BASE + NOTICES for w in t.words}) + ["foo", "bär", "x1"]
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            t = list(rng.choice(BASE + NOTICES).words)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = "foo"
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        texts.append(rng.choice([" ", "-", ", "]).join(words).title())
    texts.append("word " * 30_000 + "Released under the MIT License.")
    docs = spark.createDataFrame([(i if i else None, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    rows = {r.doc_id or 0: r for r in scan(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(t), t
        assert all(m.containment >= THRESHOLD - 1e-9 and m.first < m.end for m in r.matches)
    assert len(rows) == len(texts) and scan(docs.limit(0)).count() == 0


def test_templates_in_passes(spark, monkeypatch):
    """More templates than stand in one plan are scanned for in passes, with the results of one."""
    texts = [None, "MIT License and " + NOTICES[1].text, " ".join(t.text for t in NOTICES), "general public license " * 3 + NOTICES[4].text, "none"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(license_scan, "MAX_TEMPLATES", 5)
    for r in scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(texts[r.doc_id])
        assert len(r.matches) >= len(set(r.labels.split(",")) - {""})
