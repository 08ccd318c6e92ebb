"""The prefix trie against a trie built in plain Python."""

import math
import random
import re
import sys
from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from tracewright.llm import trie
from tracewright.llm.queries import QUERIES
from tracewright.llm.trie import cells, lengths, prefix_trie, with_openings

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        if c is not None:
            convs.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))  # as in SQL, the remainder of a negative number is not positive
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute_force(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = []

    def below(node):
        words = len([w for w in re.split("[\x20\x09-\x0d]+", node[-1][1]) if w]) if node else 0
        saved, leaves = (len(members[node]) - 1) * words, 0 if node in kids else 1
        for k in kids.get(node, []):
            s, n = below(k)
            saved, leaves = saved + s, leaves + n
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), up, len(members[node]), len(kids.get(node, [])), leaves, saved, sha256(ends.encode()).hexdigest()))
        return saved, leaves

    if convs:
        below(())
    return sorted(out, key=repr)


def run(df):
    opening = F.crc32(F.col("conv").cast("string")) % 4
    return sorted(map(tuple, prefix_trie(*with_openings(cells(df), 20, opening, 3)).collect()), key=repr)


def conversations(n, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 13 == 5:
            continue  # some bases are absent
        for t in range(rnd.choice((1, 2, 3, 4, 9))):
            text = rnd.choice(("ok", "a hot  first turn", "", None, f"turn {rnd.randrange(6)} of some words\n"))
            rows.append((c * (1 if c % 2 else 10), t if t else None, rnd.choice(("user", None)) if t else "user", text if t else "hot"))
    return rows


def test_brute_force_over_many_shards(spark, monkeypatch):
    rows = conversations(300, 1)
    for c in range(5_000, 5_060):  # one conversation, many times; longer than a window of positions
        rows += [(c, t, "user", f"same {t}") for t in range(40)]
    rows += [(9_001, t, "user", f"long {t % 7}") for t in range(900)]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None), (-7, 1, None, None), (7_000, 3, "user", "x"), (7_000, 3, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.withColumns({c: F.lit(1) for c in ("conv", "pos", "n", "cell", "words", "shard", "label")})
    sys.setrecursionlimit(10_000)
    want = brute_force(rebuilt(rows))
    monkeypatch.setattr(trie, "SHARD", 32)
    monkeypatch.setattr(trie, "WINDOW", 8)
    assert run(df) == want


def test_plain_trie_and_small_tables(spark):
    rows = conversations(40, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    turns = cells(df)
    plain = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        plain.setdefault(c, []).append((role or "", text or ""))
    assert sorted(map(tuple, prefix_trie(turns, lengths(turns)).collect()), key=repr) == brute_force(plain)
    assert run(df.limit(0)) == []
    assert run(spark.createDataFrame([(3, 1, "user", "alone")], SCHEMA)) == brute_force(rebuilt([(3, 1, "user", "alone")]))


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_prefix_trie"](spark, path).collect()), key=repr) == brute_force(rebuilt(rows))
