import random
import re
from collections import Counter

from parcelgrid.llm.quality_rules import judge, keep_good
from parcelgrid.llm.rule_ensemble import (Bound, RuleModel, fit_rules, is_held_out, keep_predicted_good, score,
                                          training_rows)
from pyspark.sql import functions as F


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def made_texts():
    rng = random.Random(2)
    texts = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "x\n\nx\r\nx\n", "é é # $|<>&%*", "a " * 3000,
             "the of and " * 40, "\x0b\x0c\r"]
    for _ in range(200):
        texts.append("".join(rng.choice(["a", "b", "the", " ", " ", "\n", "\t", "\x0b", "#", "ü", " ", "\x1c"])
                             for _ in range(rng.randint(0, 120))))
    texts += [" ".join(f"{rng.choice(['the', 'of'])} w{rng.randint(0, 500)}" for _ in range(60)) for _ in range(5)]
    return texts


def test_counts_and_base(spark, docs_of):
    rows = list(enumerate(made_texts())) + [(0, "the a"), (None, "x")]
    got = judge(docs_of(rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                    for r in got), key=key)
    want = []
    for i, t in rows:
        c = plain_counts(t)
        want.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert found == sorted(want, key=key)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_keep_good_keeps_whole_rows(docs_of):
    rows = list(enumerate(made_texts()))
    docs = docs_of(rows + [(0, "again")])
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    verdicts = sorted(r.doc_id for r in judge(docs).where("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == verdicts and verdicts
    assert keep_good(docs.limit(0)).count() == 0


def test_stop_word_ratio_by_language(spark):
    rng = random.Random(6)
    prose = ("the old house on the hill was sold to a family from the north and it is said that they moved in with "
             "their dogs at night").split()
    english = " ".join(rng.choice(prose) + (" " + str(k)) * (k % 3 == 0) for k in range(160))
    italian = " ".join(rng.choice("casa collina famiglia nord cani notte grande molto sempre anche dove quando".split()) + str(k)
                       for k in range(120))
    russian = " ".join(rng.choice("дом холм семья север собаки ночь большой очень всегда также где когда".split()) + str(k)
                       for k in range(120))
    invented = " ".join(f"qz{rng.randrange(10 ** 6)}" for _ in range(5000)) + " the of"
    filler = " ".join(rng.choice(["the", "of", "and", "to", "in", "a", "is", "it", "on"]) for _ in range(80))
    rows = [(1, english, "en", True), (2, english.upper(), "en", True), (3, english, "en-GB", True), (4, italian, "it", True),
            (5, russian, "ru", True), (6, russian, None, True), (7, invented, "en", False), (8, invented, "DE", False),
            (9, invented, "xx", True), (10, italian, "es", False), (11, filler, "en", False), (12, filler, None, False)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    verdicts = {r.doc_id: (r.kept, r.base_failed) for r in judge(docs).collect()}
    assert {i: v[0] for i, v in verdicts.items()} == {r[0]: r[3] for r in rows}
    assert not any(v[1] for i, v in verdicts.items() if i < 11)
    assert sorted(r.doc_id for r in keep_good(docs).collect()) == [r[0] for r in rows if r[3]]
    assert judge(docs.drop("lang")).where("kept").count() == 10  # no languages known: only the filler goes


def test_no_python_in_native_plans(docs_of):
    for frame in (judge(docs_of([(1, "a")])), keep_good(docs_of([(1, "a")]))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_counts_are_computed_once_below_a_filter(docs_of):
    """A caller's filter stays above the counts: the windows are hashed in one place of the plan."""
    plan = keep_good(docs_of([(1, "a")])).where("doc_id > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1 and plan.count("regexp_replace(") == 1


def test_compiled_rules_equal_python_rules(spark):
    model = RuleModel(-0.5, [((Bound("x", True, 1.5),), 2.0), ((Bound("x", False, 0.5), Bound("y", True, 3.0)), -1e-3)])
    rows = [(x / 4, float(y)) for x in range(9) for y in range(6)]
    got = spark.createDataFrame(rows, "x double, y double").select("x", "y", model.compile().alias("s")).collect()
    from math import exp
    for r in got:
        z = -0.5 + sum(w for bounds, w in model.rules if all(b.holds({"x": r.x, "y": r.y}) for b in bounds))
        assert abs(r.s - 1 / (1 + exp(-z))) < 1e-12


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = training_rows(docs, labels)
    model = fit_rules(spark, rows)
    assert model.rules
    found = score(docs, model).join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    assert sum(r.quality == r.predicted for r in found) / len(found) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    trained = spark.createDataFrame([(r["doc_id"],) for r in labels.collect()], "doc_id long")
    assert len(rows) == trained.where(~is_held_out(F.col("doc_id"))).count()
    assert keep_predicted_good(docs, model).columns == docs.columns


def test_odd_labels(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score(docs, fit_rules(spark, training_rows(docs, none))).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(1, 4)] + [(None, 1), (2, None)], "doc_id long, quality int")
    found = score(docs, fit_rules(spark, training_rows(docs, one))).collect()
    assert len(found) == 5 and all(0.5 < r.score < 1 for r in found)
    assert score(docs.limit(0), fit_rules(spark, [])).count() == 0
