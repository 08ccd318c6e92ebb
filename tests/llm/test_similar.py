"""The near_dedup stage against Jaccard similarities of all pairs; what the language stage keeps."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import similar
from tracewright.llm.similar import similar_texts

SF = "/root/testdata/sf0.01"


def brute_force(rows):
    """Least id of each row's component, by comparing the shingle sets of all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if min(len(sets[a]), len(sets[b])) < 0.8 * max(len(sets[a]), len(sets[b])) or sets[a].isdisjoint(sets[b]):
                continue
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_stage_keeps_one_of_each_jaccard_group(spark):
    docs = corpus_pipeline.exact(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).cache()
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert len(set(want.values())) < len(want)
    got = corpus_pipeline.near(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))


def test_chains_hot_groups_and_blanks(spark):
    rnd = random.Random(7)
    line = " ".join(f"common{i}" for i in range(60))
    rows = [(0, None), (1, ""), (2, " \t"), (3, "two words"), (4, "Two  Words"), (5, "two word")]
    text = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    for i in range(60):  # a chain whose ends differ
        text = list(text)
        text[rnd.randrange(200)] = f"n{i}"
        rows.append((100 + i, " ".join(text)))
    # Many texts around the border of similarity, which share a line.
    rows += [(1000 + i, line + " " + " ".join(f"x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(3, 30)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component_id for r in similar_texts(df).collect()} == brute_force(rows)
    assert similar_texts(df.limit(0)).count() == 0


def test_large_blocks_are_dealt_into_cells(spark, monkeypatch):
    rnd = random.Random(5)
    text, rows = [f"w{rnd.randrange(10**6)}" for _ in range(120)], []
    for i in range(80):  # near copies of one text, many of them not alike
        copy = list(text)
        for at in rnd.sample(range(120), rnd.randrange(1, 6)):
            copy[at] = f"n{i} {at}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(text[i:] + [f"z{i}"])) for i in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert len(set(want.values())) > 1
    for nodes in (9, 1_000):
        monkeypatch.setattr(similar, "BLOCK_NODES", nodes)
        assert {r.id: r.component_id for r in similar_texts(df).collect()} == want


def test_anchors_and_min_hashes_propose(spark):
    rows = [(b"a", 5, 1, [1, 2]), (b"b", 5, 1, [3, 4]), (b"c", 5, 2, [5, 6]), (b"d", 5, 3, [7, 6]), (b"e", 5, 4, [6, 7])]
    nodes = spark.createDataFrame(rows, "node binary, size long, class long, keys array<long>")
    blocks = {}
    for r in similar._blocks(nodes).collect():
        blocks.setdefault(r.block, set()).add(bytes(r.node))
    # One class of anchors, and one key of the same band; a key of another band is another key.
    assert sorted(map(sorted, blocks.values())) == [[b"a", b"b"], [b"c", b"d"]]


def test_links_of_a_group_are_fewer_than_its_members():
    sets = [np.unique(np.array([*range(100), 1_000 + i], np.uint64)) for i in range(300)]
    assert len(similar.close_links(sets, [None] * 300)) == 299
    assert all((a < 150) != (b < 150) for a, b in similar.close_links(sets, [int(i < 150) for i in range(300)]))


def test_similarity():
    a, b = (similar.shingles(" ".join(map(str, range(n)))) for n in (104, 84))
    assert similar.similarity(a, b) == 0.8 and len(similar.shingles("")) == 1


def test_language_stage_keeps_mixed_texts_and_unlabelled_corpora(spark):
    say = {"en": "the cat {0} sat on the mat and saw a bird ", "de": "der Hund {0} lief schnell durch den alten Wald ",
           "fr": "le chat {0} dort sous une vieille table "}
    rows = [(f"{k}{i}", (s.format(i)) * 20, k) for i in range(60) for k, s in say.items()]
    rows += [("mixed", "".join(s.format(3) * 60 for s in say.values()), None), ("none", "123 !!", None), ("null", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, df, SF).collect()}
    assert kept == {r[0] for r in rows} - {"none", "null"}
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, bare, SF).collect()} == kept


def test_bound_never_rules_out_close_texts():
    rnd = random.Random(2)
    ruled = 0
    for n in (1, 3, 40, 400, 90_000):
        for share in (0.0, 0.3, 0.7, 0.8, 0.85, 1.0):
            words = [f"w{rnd.randrange(10**7)}" for _ in range(n)]
            kept = int(n * share)
            a, b = (similar.shingles(" ".join(w)) for w in (words, words[:kept] + [f"x{rnd.randrange(10**7)}" for _ in range(n - kept)]))
            rows = [np.frombuffer(similar._counts(x), np.uint8)[None] for x in (a, b)]
            open_ = similar.may_be_close(*rows, np.array([len(a)]), np.array([len(b)]))[0]
            assert open_ or similar.similarity(a, b) < similar.LEAST
            ruled += not open_
    assert ruled >= 9
