"""The pattern grammar against a plain reading of its rules; learning, held-out rows, copies and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("shotframe.llm")
from shotframe.llm import toxicity as tox  # noqa: E402

SF = "/root/testdata/sf0.01"


def read_plainly(kinds):
    """Factors by looking back from each insult and threat, without states."""
    out = []
    for i, kind in enumerate(kinds):
        if kind not in (tox.INSULT, tox.THREAT):
            out.append(0.0)
            continue
        clause = i
        while clause and kinds[clause - 1] not in (tox.COMMA, tox.END):
            clause -= 1
        near = kinds[max(clause, i - tox.NEAR) : i]
        mark = tox.NEGATED * (tox.NEGATION in near) + tox.TARGETED * (tox.TARGET in near)
        quoted, told = False, False
        for k in kinds[:i]:
            if k == tox.QUOTE:
                quoted, told = not quoted, False
            elif k == tox.END and not quoted:
                told = False
            elif k == tox.REPORT and not quoted:
                told = True
        mark += tox.REPORTED * (quoted or told)
        out.append(tox.FACTOR[mark] if kind == tox.INSULT or mark & tox.TARGETED else 0.0)
    return out


def test_the_composed_machine_reads_as_its_rules_say():
    r, (then, factors, _) = random.Random(3), tox.machine()
    for _ in range(2000):
        kinds = [r.choice(range(tox.END + 1)) for _ in range(r.randrange(30))]
        state, got = 0, []
        for k in kinds:
            got.append(factors[state][k])
            state = then[state][k]
        assert got == read_plainly(kinds), kinds
    assert len(then) <= (tox.NEAR + 1) ** 2 * 3


def clause_scores(text, learned=None):
    words, ends, found = tox.clauses(text, tox.Lexicon(learned or {}), tox.machine())
    return words, ends, [round(x, 2) for x, _ in found]


def test_clauses():
    assert clause_scores(None) == clause_scores("") == (0, 0, []) and clause_scores(" .,! ") == (0, 0, [])
    assert clause_scores("You are an idiot, friend.") == (5, 2, [5.0])
    assert clause_scores("An IDIOT. He is not a clown! She said he was trash.") == (12, 3, [4.0, 2.0, 2.0])
    assert clause_scores("I will hurt you. You I will hurt.") == (8, 2, [1.25])  # a threat needs its target before it, within reach
    assert clause_scores('"scum, scum" scum') == (3, 2, [2.0, 6.0])
    assert clause_scores("rotten rottenness rot", {"rotten": 3.0, "rot$": 1.0}) == (3, 1, [7.0])
    assert len(clause_scores("word " * 200_000 + "idiot")[2]) == 1


def test_patterns_give_way_to_the_most_specific():
    got = tox.chosen({"tra": (100, 5), "tras": (100, 0), "trash": (100, 0), "trash$": (99, 0), "réeu": (90, 60), "réeux": (89, 60), "réeuxa": (30, 1), "rare": (3, 0), "the$": (500, 9000)}, 5000.0, 50000.0)
    assert set(got) == {"trash$", "réeux", "réeuxa"} and got["réeuxa"] > got["réeux"]


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = tox.classify(docs, labels, lambda i: F.crc32(i.cast("string").cast("binary")) % 5 != 0)
    return out.join(labels, "doc_id").where(held).select("score", "toxic").toPandas()


def test_held_out_rows(scored):
    assert scored["score"].between(0, 1).all()
    said = scored["score"] >= tox.THRESHOLD
    assert (said == (scored["toxic"] == 1)).mean() >= 0.95 and said[scored["toxic"] == 1].mean() >= 0.8


def test_newton_against_gradient_descent(spark):
    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(300), r.normal(size=(300, len(tox.FEATURES) - 1))])
    y = (r.random(300) < 1 / (1 + np.exp(-x @ np.linspace(-1, 1, x.shape[1])))).astype(int)
    got = tox.fit(spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label int"))
    w = np.zeros(x.shape[1])
    for _ in range(20_000):
        w += 0.01 * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) - tox.RIDGE * w)
    assert np.allclose(got, w, atol=1e-3)


def test_copies_teach_once_and_odd_rows(spark):
    """A text copied a thousand times has one set of surroundings, so its words are no insults."""
    r = random.Random(5)
    plain = lambda n: " ".join(r.choice(["lom", "nal", "pir", "sut", "vek", "zab"]) + str(r.randrange(30)) for _ in range(n))
    copied = plain(60) + " innocentword " + plain(60)
    rows = [(i, copied, 1) for i in range(1000)]
    rows += [(2000 + i, plain(20) + f" grelk{i % 7} " + plain(20) + f" grelk{i % 5}.", 1) for i in range(60)] + [(3000 + i, plain(60), 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 1, "l", 2.0, "p") for i, t, _ in rows] + [(None, "grelk1 grelk2 grelk3", 1, "l", 2.0, "p"), (9000, None, 1, "l", 2.0, "p"), (9001, "", 1, "l", 2.0, "p"), (9001, "", 1, "l", 2.0, "p")],
                                 "doc_id long, text string, label int, word string, x double, pattern string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9000, None)], "doc_id long, toxic int")
    learned, w = tox.train(docs, labels, lambda i: F.lit(True))
    assert any(p.startswith("grelk") for p in learned) and not any(p.startswith("inno") for p in learned)
    out = [(x.doc_id, x.score) for x in tox.score(docs, learned, w).collect()]
    assert len(out) == len(rows) + 4 and all(0 <= s <= 1 for _, s in out)
    assert next(s for i, s in out if i is None) > 0.5 and len({s for i, s in out if i in (9000, 9001)}) == 1
    assert tox.classify(docs.limit(0), labels, lambda i: F.lit(True)).count() == 0
    alone = {x.doc_id: x.score for x in tox.classify(spark.createDataFrame([(1, "You idiot, you scum!"), (2, "A good day.")], "doc_id long, text string"), labels.limit(0), lambda i: F.lit(True)).collect()}
    assert alone[1] > 0.5 > alone[2]
