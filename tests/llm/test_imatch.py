"""I-Match fingerprints: edges, ties and blocks against plain Python."""

import random
import re
from hashlib import md5, sha256

from pyspark.sql import functions as F

from tracewright.llm import imatch
from tracewright.llm.imatch import NONE, RATES, fingerprints

SCHEMA = "doc_id long, text string"


def distinct(text):
    return set(re.split(r"[^\w]+", text.lower().replace("_", " "))) - {""}


def brute_force(rows):
    """Rows in order of (id, text); equal ids may follow each other in any order, so ids here differ or texts agree."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    df = {}
    for _, t in rows:
        for w in distinct(t):
            df[w] = df.get(w, 0) + 1
    band = {w for w, n in df.items() if n * imatch.RAREST >= len(rows) and n * imatch.COMMONEST <= len(rows)}

    def taken(w, j):
        return int(md5(f"{j}:{w}".encode()).hexdigest()[:8], 16) < 2**32 // RATES[j]

    def told(t):
        parts = [sorted((w for w in distinct(t) & band if taken(w, j)), key=str.encode) for j in range(len(RATES))]
        if not any(parts):
            return (md5(b"whole " + t.encode()).hexdigest()[:8] if t else NONE) * len(RATES)
        return "".join(md5(" ".join(p).encode()).hexdigest()[:8] if p else NONE for p in parts)

    def like(a, b):
        a, b = ([x[i: i + 8] for i in range(0, len(x), 8)] for x in (a, b))
        seen = [x == y for x, y in zip(a, b) if (x, y) != (NONE, NONE)]
        return 1.0 if a == b else sum(seen) / len(seen)

    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b = told(t), told(e)
        out.append((i, len(t), sha256(e.encode()).hexdigest(), a, b, like(a, b), like(a, told(after))))
    return sorted(out, key=repr)


def run(df):
    return sorted(map(tuple, fingerprints(df).collect()), key=repr)


def corpus(n, seed=3):
    rnd = random.Random(seed)
    words = [f"wörd{i}" for i in range(400)] + ["Ünter", "x_y", "ΑΒΓ", "日本"]
    return [(i * 7 - 20, rnd.choice((" ", ", ", "\n")).join(rnd.choices(words, k=rnd.randrange(60)))) for i in range(n)]


def test_brute_force_with_many_blocks(spark, monkeypatch):
    rows = [*corpus(300), (None, "null id wörd1 wörd2"), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "wörd3 " * 5_000), (10**9 + 3, "a lone text 😀😀😀")]
    rows += [(10**9 + 4, "copies wörd5 wörd9 of one row")] * 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    df = df.withColumns({c: F.lit("clash") for c in ("block", "row", "term", "h", "id", "side")})
    want = brute_force(rows)
    assert run(df) == want
    monkeypatch.setattr(imatch, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(imatch, "FAN", 4)
    assert run(df) == want


def test_small_tables(spark):
    one = [(5, "only one text")]
    df = spark.createDataFrame(one, SCHEMA)
    assert run(df) == brute_force(one)
    assert run(df.limit(0)) == []


def test_likeness_falls_with_the_change(spark):
    rnd = random.Random(5)
    words = [f"term{i}" for i in range(3_000)]
    rows = [(i, " ".join(rnd.sample(words, 150))) for i in range(400)]
    near = [(1_000 + i, " ".join(t.split()[:145])) for i, t in rows[:40]]
    told = fingerprints(spark.createDataFrame(rows + near, SCHEMA)).collect()
    prints = {r.id: r.fingerprint for r in told}
    close = [sum(a == b for a, b in zip(*(re.findall(".{8}", prints[i]) for i in (k, 1_000 + k)))) for k in range(40)]
    half = [r.near_edited for r in told]
    apart = [r.near_next for r in told]
    assert min(close) >= 16 and 0.05 < sum(half) / len(half) < 0.5 and sum(apart) / len(apart) < 0.03
