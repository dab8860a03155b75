"""Extents of long overlaps with long changed stretches, against the query's SQL."""

import random

import pytest

pytest.importorskip("shotframe.llm")
duckdb = pytest.importorskip("duckdb")
from shotframe.llm import decontaminate, queries  # noqa: E402


def test_extents_equal_the_sql(spark):
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    items = [(1, words(640)), (2, words(300)), (3, words(2000)), (4, words(40)), (5, words(9))]
    docs = [(1, items[0][1][:500] + words(110) + items[0][1][610:])]  # 530 of 640 words agree
    for k in range(2, 60):
        _, item = r.choice(items)
        text = list(item)
        for _ in range(r.randrange(4)):
            n = r.randrange(1, max(2, len(item) // 6))
            at = r.randrange(len(item))
            text[at : at + n] = words(len(text[at : at + n]))
        docs.append((k, words(r.randrange(200)) + text[r.randrange(len(text) // 4 + 1) :] + words(r.randrange(100)) + r.choice(items)[1][: r.randrange(300)]))
    docs, items = [(i, " ".join(w)) for i, w in docs], [(i, " ".join(w)) for i, w in items]
    c = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        c.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = sorted(c.sql(f"SELECT doc_id, item_id, start, n_words, n_agree, n_item FROM ({queries.OP5_SQL})").fetchall())
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(map(tuple, found.select("doc_id", "item_id", "start", "n_words", "n_agree", "n_item").collect()))
    assert got == want and (1, 1, 0, 640, 530, 640) in got and len(got) > 60
