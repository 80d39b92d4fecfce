import random
import re

from tabprep.llm import licenses


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(text, templates):
    found, w = {}, words(text)
    for name, template in templates.items():
        own = words(template)
        if len(own) < 5:
            continue
        width = licenses.window_words(len(own))
        for at in range(0, max(1, len(w)), width // 2):
            part = len(shingles(own) & shingles(w[at : at + width])) / len(shingles(own))
            if part >= 0.8:
                found[name] = max(found.get(name, 0), part)
    return found


def test_bands_meet_almost_surely():
    assert min(licenses.collision_probability(len(words(t))) for t in licenses.TEMPLATES.values()) > 0.9999


def test_matches_brute_force(spark):
    filler = [f"word{i}" for i in range(400)]
    texts = [None, "", "a b", "Released under the MIT License.", "released UNDER the mit licence", " ".join(filler)]
    for k, template in enumerate(licenses.TEMPLATES.values()):
        for at in (0, 7, 61, 133, 399):
            texts.append(" ".join([*filler[:at], template, *filler[at:]]))
        own = template.split()
        texts.append(" ".join([*filler[:20], *own[:-1], *filler[20 + k :]]))
        texts.append(" ".join([*filler[:20], *own[: len(own) // 2], "x", *own[len(own) // 2 :]]))
    texts.append(" ".join(licenses.TEMPLATES.values()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    found = {}
    for r in licenses.scan(docs).collect():
        found.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
    for i, text in enumerate(texts):
        assert found.get(i, {}) == brute(text, licenses.TEMPLATES), text


def test_whole_license_texts_at_the_border(spark):
    """Each whole text inside filler, with so many words changed that its containment lies above and below 0.8."""
    rng, known = random.Random(1), licenses.TEMPLATES | licenses.whole_texts()
    filler, texts = [f"word{i}" for i in range(300)], []
    for text in licenses.whole_texts().values():
        for changed in (0, 0.02, 0.04, 0.06):
            own = [f"other{i}" if rng.random() < changed else w for i, w in enumerate(text.split())]
            texts.append(" ".join([*filler[: rng.randint(0, 300)], *own, *filler]))
    found = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect():
        found.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
    due = {i: brute(t, known) for i, t in enumerate(texts)}
    assert {i: found.get(i, {}) for i in due} == due
    assert 12 < sum(bool(d) for d in due.values()) and any(0.8 <= p < 0.85 for d in due.values() for p in d.values())
    assert any(not d for d in due.values())


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0."), (None, "Licensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["license"]) for r in licenses.scan(docs).collect()) == [(0, "cc-by-nc-4.0-line")] + 2 * [(1, "cc-by-nc-4.0-line")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
