"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("shotframe.llm")
from shotframe.llm import chat, classifier, decontaminate, mixing, neardup, pieces, quality, sharding, suffixes, urls  # noqa: E402
from shotframe.llm.words import WordHashes  # noqa: E402

WORDS = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "été", "naïve", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu", "xi", "pi"]
SCHEMA = "doc_id long, text string, node string, digest int, key string, label string, chunk int, bucket int, id string, runs int, depth string, n_chars long, h int, `row` int, cut int, __node int, __digest int, __coded int, __verdict int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(2, 60)
    texts = [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (None, base), (None, None), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"), (8, "one two"),
        (9, prose(3, 50) + " " + passage + " " + prose(4, 50)), (10, prose(5, 30) + " " + passage + " " + prose(6, 40)), (11, prose(7, 30_000)), (12, "aaaa" * 400), (13, "x" * 5000),
        (14, "日本語のテキスト " * 30), (15, "|& # | $ % " * 30), (16, "line\n" * 50), (17, prose(8, 80)), (17, prose(9, 80)), (18, "<s>[INST]\\ \0 tail")]
    return spark.createDataFrame([(i, t, "n", 1, "k", "l", 2, 3, "i", 4, "d", 5, *[9] * 7) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def rows(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1
def test_chat_layouts_and_round_trip(spark):
    schema = "id long, prompt string, response string, instruction string, input string, output string, messages array<struct<role: string, content: string>>, conversations array<struct<from: string, value: string>>, source string"
    said = "</s>[INST] \\ \\\\ <|im_end|> <<SYS>> ok [/INST]\n<"
    data = [
        (1, said, said, None, None, None, None, None, "a"),
        (2, None, None, "do", "this", "done", None, None, "a"),
        (3, None, None, "do", None, "done", None, None, None),
        (4, None, None, None, None, None, [("user", "hi"), ("assistant", None)], None, "a"),
        (5, None, None, None, None, None, None, [("human", "hi"), ("gpt", "yes")], "a"),
        (6, None, None, None, None, None, None, None, "a"),
        (None, "p", "r", None, None, None, None, None, "a")]
    df = spark.createDataFrame(data, schema)
    turns = chat.canonical_turns(df, "id", keep_unmapped=True)
    by = defaultdict(list)
    for r in turns.orderBy("conv_id", "part").collect():
        by[r.conv_id].append((r.layout, r.role, r.text))
    assert by[1] == [("prompt_response", "user", said), ("prompt_response", "assistant", said)]
    assert by[2] == [("instruction", "user", "do\n\nthis"), ("instruction", "assistant", "done")]
    assert by[3][0][2] == "do" and by[4] == [("messages_content", "user", "hi"), ("messages_content", "assistant", "")]
    assert by[5] == [("messages_value", "user", "hi"), ("messages_value", "assistant", "yes")] and by[6] == [(None, None, None)]
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.canonical_turns(df, "id"))).collect()}
    assert set(out) == {1, 2, 3, 4, 5, None}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", said), ("assistant", said)] and out[1].loss_texts == [said]
    assert not any(c in out[1].formatted.replace(chat.OPEN, "").replace(chat.CLOSE + "\n", "") for c in chat.CONTROLS)


def test_chat_turn_rows(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, None, None, "z"), (2, 0, "a b\n", "é")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.canonical_turns(df, "conv_id", "turn"))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("", "z"), ("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert out[1].loss_texts == ["b", "b"] and out[2].turns[0].role == "a b\n"
    assert chat.format_chats(chat.canonical_turns(df.limit(0), "conv_id", "turn")).count() == 0


def test_chat_turn_rows_without_role_and_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, None), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.canonical_turns(df, "conv_id", "turn"))).collect()}
    assert {i: [(t.role, t.text) for t in r.turns] for i, r in out.items()} == {1: [("user", "a"), ("", "")], 2: [("", "")]}


# 2
def test_dart_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    off = []
    for _ in range(30):
        e = r.integers(0, 2**63, 80).astype(np.uint64)
        a, b = r.uniform(0.2, 9, 80), r.uniform(0.2, 9, 80)
        s = neardup.dart_signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 80), 2)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.03


def classes_of(rows):
    hashes, sets, root = WordHashes(), {}, {}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = {t or "" for _, t in rows}
    for t in texts:
        sets[t], root[t] = set(neardup.weighted_shingles(t, hashes)[0].tolist()), t
    for a in texts:
        for b in texts:
            if sets[a] and a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    ids = defaultdict(list)
    for i, t in rows:
        ids[top(t or "")].append(i)
    return {t: min((i for i in ids[top(t)] if i is not None), default=None) for t in texts}


def test_near_classes(odd, rows, empty):
    want = classes_of(rows)
    got = Counter((r.doc_id, r.class_id) for r in neardup.near_classes(odd).collect())
    assert got == Counter((i, want[t or ""]) for i, t in rows)
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(classes_of(rows)[r.text or ""] for r in kept.collect()) == Counter(set(want.values()))
    assert neardup.near_classes(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_hot_group_of_near_copies(spark):
    base = prose(20, 150).split()
    r = random.Random(5)
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[r.randrange(150)] = f"new{r.randrange(1000)}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame([(1000, " ".join(base)), *texts], "doc_id long, text string")
    assert {x.class_id for x in neardup.near_classes(df).collect()} == {0}


def pairs_near_the_threshold(spark, n=30):
    """Texts 2i and 2i + 1 have a similarity of 0.806, all others 0.790: estimates don't tell them apart."""
    base = prose(21, 357)
    texts = [(i, f"{base} {' '.join(f'p{i // 2}x{j}' for j in range(4))} {' '.join(f'o{i}x{j}' for j in range(43))}") for i in range(2 * n)]
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_rejected_links_hide_no_others(spark):
    got = {r.doc_id: r.class_id for r in neardup.near_classes(pairs_near_the_threshold(spark)).collect()}
    assert got == {i: i - i % 2 for i in got} and len(got) == 60


def test_all_members_of_large_buckets_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = {r.doc_id: r.class_id for r in neardup.near_classes(pairs_near_the_threshold(spark)).collect()}
    assert got == {i: i - i % 2 for i in got} and len(got) == 60


def test_chain_in_a_bucket_of_thousands(spark):
    """A chain of texts: each is within 0.8 of the next one only, beside hundreds of copies of the middle that fill its buckets."""
    base = prose(22, 500).split()
    chain = [" ".join(f"c{j}" if j < 25 * i else w for j, w in enumerate(base)) for i in range(8)]
    r = random.Random(6)
    crowd = [" ".join(base[:i] + [f"n{i}"] + base[i + 1 :]) + f" z{k}" for k, i in enumerate(r.randrange(250, 500) for _ in range(1500))]
    df = spark.createDataFrame(list(enumerate(chain + crowd)), "doc_id long, text string")
    assert {x.class_id for x in neardup.near_classes(df).collect()} == {0}


# 3
def test_urls(spark):
    pages = [(1, "http://A.Example.ORG/es/x?q"), (2, None), (3, "no scheme"), (4, "https://example.org"), (5, "x://fr.com/de/1#z"), (6, "http://org/"), (6, "http://org/"), (7, "http://notexample.org/en/12"), (None, "http://example.org/en/1"), (8, "http://com/fr/é")]
    df = spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id long, url string, host string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect())
    assert got == Counter([
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.org", "", None, "allow"), (5, "fr.com", "/de/1", "com/de/", "block"),
        (6, "org", "/", "org/", "allow"), (6, "org", "/", "org/", "allow"), (7, "notexample.org", "/en/12", "org/", "allow"), (None, "example.org", "/en/1", "example.org/en/1", "block"), (8, "com", "/fr/é", None, "allow")])
    assert urls.judge_urls(df, rules.limit(0)).where("rule IS NOT NULL").count() == 0 and urls.judge_urls(df.limit(0), rules).count() == 0


# 4
def test_quality_against_brute_force(odd, rows, empty):
    import re

    def base(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(words)
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n

    got = odd.select("doc_id", "text", quality.compression_bands(F.col("text")).alias("v")).collect()
    assert len(got) == len(rows)
    for r in got:
        v = r.v
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == base(r.text)
        assert v.kept == (v.reason is None) and not (v.base_failed and v.kept)
    assert {r.doc_id for r in got if r.v.kept} >= {1, 2, 9, 10, 11, 17}
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.v.kept for r in got)
    assert quality.keep_good(empty).count() == 0
    r = random.Random(1)
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(9000))
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    assert quality.judge(noise, z)[-1] is None or quality.judge(noise, z)[-1] == "incompressible"
    assert quality.judge(" ".join(f"w{i % 12} v{i % 13}" for i in range(2000)), z)[-2] is False


# 5
def test_overlaps(spark, odd, empty):
    item = prose(40, 30).split()
    changed = list(item)
    changed[7], changed[19] = "other", "words"
    part = item[5:19]
    short = ["s1", "s2", "s3", "s4", "s5", "s6"]
    docs = [(1, prose(41, 50) + " " + " ".join(changed) + " " + prose(42, 20)), (2, prose(43, 40)), (3, prose(44, 10) + " " + " ".join(part)), (None, " ".join(item)), (4, " ".join(short)), (5, None), (6, " ".join(item[:9])), (1, prose(45, 30))]
    items = [(1, " ".join(item)), (2, None), (3, "a b"), (4, " ".join(short)), (1, " ".join(item))]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, digest string")
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_agree) for r in decontaminate.overlaps(d, b).collect()}
    assert got == {(1, 1): (30, 28), (3, 1): (14, 14), (None, 1): (30, 30), (4, 4): (6, 6)}
    kept = decontaminate.keep_clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    assert decontaminate.overlaps(odd, b.limit(0)).count() == 0 and decontaminate.overlaps(empty, b).count() == 0 and decontaminate.keep_clean(odd, b.limit(0)).count() == odd.count()


def test_masks_hit_every_overlap_with_two_substitutions():
    from itertools import combinations

    shapes = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    for gone in combinations(range(decontaminate.MIN_OVERLAP), 2):
        assert any(all(p + i not in gone for i in s) for s in shapes for p in range(decontaminate.MIN_OVERLAP - s[-1]))

def test_masks_hit_every_overlap_of_any_length():
    from itertools import combinations

    def missed(masks, n, gone, inner):
        ones = [sum(1 << i for i, c in enumerate(m) if c == "1") << p for m in masks for p in range(n - len(m) + 1)]
        lost = (sum(1 << i for i in x) for x in combinations(range(1, n - 1) if inner else range(n), gone))
        return [x for x in lost if all(x & o for o in ones)]

    for n in range(decontaminate.MIN_ITEM, 13):
        assert not missed(decontaminate.SHORT_MASKS.get(n, decontaminate.MASKS), n, n // 5, True)
    # The lengths between have as many substitutions and more places; longer ones part into these.
    for n in (13, 15, 20, 25):
        assert not missed(decontaminate.MASKS, n, n // 5, False)


def test_items_with_substitutions(spark):
    lost = {5: [2], 6: [3], 7: [1], 8: [6], 9: [4], 10: [3, 6], 11: [2, 7], 12: [4, 9], 15: [2, 7, 9]}
    items = {n: [f"i{n}w{j}" for j in range(n)] for n in lost}
    docs = {n: [f"d{n}" if j in lost[n] else w for j, w in enumerate(x)] for n, x in items.items()}
    worse = {100 + n: [*x[:-2], "worse", x[-1]] if n != 10 else [x[0], "worse", *x[2:]] for n, x in docs.items() if n != 8}
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join([prose(i, 9), *x, prose(i + 50, 9)] if name == "doc_id" else x)) for i, x in rows.items()], f"{name} long, text string")
    got = {(r.doc_id, r.item_id, r.n_words, r.n_agree) for r in decontaminate.overlaps(frame(docs | worse, "doc_id"), frame(items, "item_id")).collect()}
    assert {x for x in got if x[0] < 100} == {(n, n, n, n - len(lost[n])) for n in items}
    assert not {x for x in got if x[0] in range(105, 113)}


# 6
def brute_cut(rows):
    docs = sorted({((i is not None, i or 0), suffix_key(t), t or "") for i, t in rows})
    seen, out = set(), {}
    for i, _, t in docs:
        raw = t.encode()
        mask = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                mask[p : p + 100] = True
            seen.add(w)
        left = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
        out[(i, t)] = (len(raw), int(mask.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


_DIGESTS: dict = {}


def suffix_key(text):
    return _DIGESTS[text or ""]


def test_suffixes_against_brute_force(spark, odd, rows, empty):
    for r in odd.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect():
        _DIGESTS[r.t] = r.h
    want = brute_cut(rows)
    got = suffixes.remove_repeats(odd).select("doc_id", "text", "cut.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[((r.doc_id is not None, r.doc_id or 0), r.text or "")]
    out = suffixes.clean(odd)
    assert out.columns == odd.columns and out.count() == len(rows)
    assert suffixes.remove_repeats(empty).count() == 0


def test_repeated_windows_and_cover():
    assert {(a - b) % suffixes.V for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.V))
    r = np.random.default_rng(3)
    t = r.integers(97, 99, 400).astype(np.uint8)
    rank = suffixes.cover_ranks(t)
    at = [i for i in range(400) if i % suffixes.V in suffixes.COVER]
    depth = 16 * suffixes.V
    assert sorted(at, key=lambda i: (rank[i], i)) == sorted(at, key=lambda i: (t[i : i + depth].tobytes(), i))


# 7
def test_pieces_equal_the_library_and_round_trip(odd, empty):
    import sentencepiece

    model = pieces.model_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = pieces.encode_documents(odd)
    assert out.columns == [*odd.columns, "n_tokens", "ids", "round_trip"]
    for r in out.withColumn("back", pieces.decoded(F.col("ids"))).collect():
        assert list(r.ids) == sp.encode(r.text or "") and r.round_trip and r.n_tokens == len(r.ids) and r.back == (r.text or "")
    assert pieces.encode_documents(empty).count() == 0
    r = random.Random(1)
    p = pieces.Pieces(model)
    texts = ["".join(r.choice("abcdeABC 012 \n.,▁éüß漢😀 \ttheinğ") for _ in range(r.randrange(0, 90))) for _ in range(1500)] + ["=" * 3000, "ab" * 5000, " " * 100, "▁▁ x"]
    assert [list(x) for x in p.encode(texts)] == [sp.encode(x) for x in texts]


# 8
def test_shards(spark, odd, rows, empty):
    placed = sharding.shards(odd, limit=1500, shard_col="s", bytes_col="b", depth_col="dd")
    assert placed.columns == [*odd.columns, "b", "dd", "s"] and placed.count() == len(rows)
    found = sharding.directory(placed, "b", "dd", "s").collect()
    assert all(x.n_bytes <= 1500 or x.n_rows == 1 for x in found)
    names = [x.s for x in found if "-" not in x.s]
    assert all(len(x.s.split("-")[0]) == x.dd for x in found) and not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.shards(empty).count() == 0
    same = spark.range(50).select(F.lit(1).alias("doc_id"), F.lit("y" * 84).alias("text"))
    pages = sharding.directory(sharding.shards(same, limit=1000)).collect()
    assert sum(x.n_rows for x in pages) == 50 and max(x.n_bytes for x in pages) <= 1000


def test_shards_of_many_equal_rows(spark):
    """A third of the rows are equal: their pages are full but for the last, and no page is too large."""
    rows = spark.range(0, 150_000, 1, 11).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("z" * 20)).cast("string").alias("text"))
    pages = sharding.directory(sharding.shards(rows, limit=16_000)).collect()
    assert sum(x.n_rows for x in pages) == 150_000 and max(x.n_bytes for x in pages) <= 16_000
    equal = sorted(x.n_rows for x in pages if "-" in x.shard)
    assert sum(equal) == 50_000 and equal == [1000] * 50


# 9
def test_mixing(spark, odd, rows, empty):
    import math
    import zlib

    from shotframe.llm.common import doc_fold

    docs = odd.unionByName(spark.createDataFrame([(100 + i, prose(100 + i, 60), "n", 1, "k", "l", 2, 3, "i", 4, "d", 5, *[9] * 7) for i in range(40)], SCHEMA))
    got = mixing.score_documents(docs, doc_fold(F.col("doc_id"), 7) != 2).collect()
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts: Counter = Counter()
    data = [(r.doc_id, r.text) for r in docs.collect()]
    for i, t in data:
        if not held(i):
            counts.update([*low(t), b""])
    n, v = sum(counts.values()), len(counts)

    def base(i, t):
        w = [*low(t), b""]
        return i, held(i), len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)

    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == Counter(base(i, t) for i, t in data)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert mixing.score_documents(empty, F.lit(True)).count() == 0
    assert all(r.n_known == 0 for r in mixing.score_documents(odd, F.lit(False)).collect())


def small_model(texts, depth=3, bits=12):
    """A tree over four tokens, and the model that a learner makes of texts."""
    cells = {b"ab": 0, b"ba": 2, mixing.END_TOKEN: 5, b"c": 6}
    tree = mixing.Tree(depth, {0: 9, 2: 4, 5: 3, 6: 2}, 2, {97: 50, 98: 30, 32: 40})
    coded = lambda words: mixing.symbols_of([*words, b""], np.array([cells.get(w, 0) for w in [*words, b""]], np.int32), np.array([w in cells for w in [*words, b""]]), tree)[0]
    learner = mixing.Learner(tree, bits)
    found = [coded(t.split()) for t in texts]
    learner.learn(np.concatenate(found), np.cumsum([0, *map(len, found[:-1])]))
    model = mixing.Model(tree, [mixing.packed_odds(t.reshape(-1, 2)) for t in learner.tables], learner.sums())
    return tree, coded, learner, model


def test_bit_probabilities_sum_to_one():
    tree, coded, _, model = small_model([b"ab ba ab", b"ab", b"zz c"] * 20)
    known = sum(10 ** model.log10([coded([w])[:1]])[0][0] for w in (b"ab", b"ba", b"c", b""))
    unknown = 10 ** model.log10([np.array([tree.unknown], np.int32)])[0][0]
    assert abs(known + unknown - 1) < 1e-4
    one = np.array([[tree.unknown, tree.byte + b] for b in range(256)], np.int32)
    assert abs(sum(10 ** model.log10(list(one))[0]) - unknown) < 1e-4
    assert model.log10([coded([b"ab", b"ba"])])[0][0] > model.log10([coded([b"zq", b"xv"])])[0][0]


def test_mixing_against_plain_python():
    import math

    tree, coded, learner, model = small_model([b"ab ba ab", b"ab", b"zz c ab", b"ba ba"] * 30)
    texts = [coded(x.split()) for x in (b"ab ab", b"", b"zz yx ab", b"c c ba")]
    for text, got, got_alone in zip(texts, *model.log10(texts), strict=True):
        context = tree.contexts(text, np.array([0]))
        total = alone = 0.0
        for i, s in enumerate(text):
            for j in range(tree.first[s], tree.first[s] + tree.length[s]):
                node, bit = int(tree.node[j]), int(tree.bit[j])
                x, gate = [float(tree.odds[node])], 16 * (s >= tree.byte)
                for k in range(mixing.CONTEXTS):
                    slot = (int(context[k][i]) + node * 0x9E3779B1) % 2**12
                    zero, one = learner.tables[k][2 * slot : 2 * slot + 2]
                    x.append(math.log((one + mixing.PRIOR) / (zero + mixing.PRIOR)))
                    gate += 4**k * sum(zero + one > limit for limit in (0, 2, 15))
                odds = sum(float(w) * v for w, v in zip(model.weights[gate], x, strict=True))
                p = 1 / (1 + math.exp(-odds))
                at = int((min(8, max(-8, odds)) + 8) / 16 * (mixing.BUCKETS - 1) + 0.5)
                p = (p + float(model.refine[gate * mixing.BUCKETS + at])) / 2
                total += math.log10(p if bit else 1 - p)
                exact = 1 / (1 + math.exp(-x[0]))
                alone += math.log10(p if bit else 1 - p) if s >= tree.byte else math.log10(exact if bit else 1 - exact)
        total = math.log10((10**total + 10**alone) / 2)
        assert abs(total - got) < 0.02 * max(1, abs(total)) and abs(alone - got_alone) < 0.02 * max(1, abs(alone))


def test_scores_do_not_follow_partitions(spark, odd):
    from shotframe.llm.common import doc_fold

    train = doc_fold(F.col("doc_id"), 7) != 2
    few = mixing.score_documents(odd.coalesce(1), train).orderBy("doc_id", "score").collect()
    assert few == mixing.score_documents(odd.repartition(7, "text"), train).orderBy("doc_id", "score").collect()


def test_context_beats_counts():
    """Words in a fixed order are foretold by their contexts, which the counts alone don't know."""
    tree, coded, _, model = small_model([b"ab ba c ab ba c"] * 200)
    bits, alone = model.log10([coded([b"ab", b"ba", b"c"] * 20)])
    assert bits[0] > 3 * 20 * -0.2 > alone[0]


def test_contexts_gain_on_held_out_known_words(spark):
    """At sf0.01, over the held-out texts without unknown words, the mix is better than the exact counts alone."""
    from shotframe.llm.common import doc_fold

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.score_documents(docs, doc_fold(F.col("doc_id"), 7) != 2).where("held_out AND n_known = n_tokens")
    total = out.agg(F.sum("score").alias("score"), F.sum("counts_score").alias("alone"), F.count("*").alias("n")).first()
    assert total.n > 10 and total.score > total.alone
    assert out.where("score < counts_score - 0.31").count() == 0  # a text of one segment pays half its belief at most


def test_long_text_gives_up_contexts_that_mislead():
    """Words in another order than was learned: by and by the counts alone are believed."""
    tree, coded, _, model = small_model([b"ab ba c ab ba c"] * 200)
    r = random.Random(1)
    text = coded([r.choice([b"ab", b"ba", b"c"]) for _ in range(6000)])
    score, alone = model.log10([text])
    assert score[0] > alone[0] - 12


# 10
def test_classifier(spark, odd, empty):
    from shotframe.llm.common import doc_fold

    good = [(i, prose(i, 60 + i % 50), 1) for i in range(200, 320)]
    bad = [(i, ("BUY!! " + prose(i, 3).upper() + " $$$ ### ") * 6, 0) for i in range(400, 480)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    labels = spark.createDataFrame([(i, q, None) for i, _, q in good + bad] + [(None, 1, None), (3, None, None), (999, 1, None)], "doc_id long, quality int, text string")
    got = classifier.classify(docs, labels, lambda c: doc_fold(c, 5) != 0).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    truth = {i: q for i, _, q in good + bad}
    right = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in got if r.doc_id in truth]
    assert np.mean(right) > 0.95
    assert {r.score for r in classifier.classify(docs, labels.limit(0), lambda c: F.lit(True)).collect()} == {0.5}
    assert classifier.classify(empty, labels, lambda c: F.lit(True)).count() == 0
