"""The manifest against a tree built in plain Python."""

from hashlib import sha256

from pyspark.sql import functions as F

from tracewright.llm.merkle import backward, fold, forward, leaves_of, manifest
from tracewright.llm.places import placed

SCHEMA = "doc_id long, source string, text string"


def digest(s):
    return sha256(s.encode()).hexdigest()


def tree(nodes):
    """Root of a list of digests, and each one's steps (place in its run, run)."""
    steps = [[] for _ in nodes]
    at, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i: i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            steps[k].append((i % 16, runs[i // 16]))
        at, level = [i // 16 for i in at], [digest("".join(r)) for r in runs]
    return level[0], steps


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_force(rows, low):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    root, up = tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, up):
        for r, steps in zip(groups[g], trees[g][1]):
            proof = "".join("".join(run[:i] + run[i + 1:]) for i, run in steps + above)
            now = leaf((*r[:2], r[2].lower())) if low(r) else leaf(r)
            for i, run in steps + above:
                now = digest("".join(run[:i] + [now] + run[i + 1:]))
            out.append((r[0], leaf(r), trees[g][0], root, digest(proof), now, now == root))
    return sorted(out, key=repr)


def run(df):
    found = [F.col("doc_id"), F.col("source"), F.lower("text")]
    rows = manifest(leaves_of(df, ["doc_id", "source", "text"], found=found, changed=F.col("text").startswith("T")))
    return sorted((tuple(r) for r in rows.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_trees_of_many_sizes(spark):
    rows = []
    for name, n in (("one", 1), ("b16", 16), ("b17", 17), ("é", 255), ("hot", 4_500), (None, 40), ("", 2)):
        rows += [(7 * i, name, f"T{i}" if i % 9 == 0 else f"text {i}") for i in range(n)]
    rows += [(None, "null id", "T"), (None, "null id", "u"), (3, "null id", None), (3, "null id", "x"), (3, "null id", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = run(df.withColumns({c: F.lit("clash") for c in ("grp", "pos", "label", "n", "digest", "chunk")}).repartition(5))
    assert got == brute_force(rows, lambda r: (r[2] or "").startswith("T"))
    assert {r[6] for r in got} == {True, False}


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "a", None)], SCHEMA)
    assert run(df) == brute_force([(1, "a", None)], lambda r: False)
    assert run(df.limit(0)) == []
    many = [(i, f"s{i}", "x") for i in range(300)]
    assert run(spark.createDataFrame(many, SCHEMA)) == brute_force(many, lambda r: False)


def test_sweeps():
    leaves = [digest(str(i)).encode() for i in range(100)]
    nodes = forward(leaves, 3)
    assert [len(x) for x in nodes] == [100, 7, 1, 1]
    assert {fold(x, p) for x, p in zip(leaves, backward(nodes, []))} == {nodes[-1][0]}


def test_places_of_a_hot_group(spark):
    df = spark.range(20_000).select((F.col("id") * 37 % 20_000).alias("v"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"))
    rows = placed(df, ["g"], ["v"]).collect()
    want = {}
    for r in sorted(rows, key=lambda r: r.v):
        want.setdefault(r.g, []).append(r.v)
    assert all(want[r.g][r.pos] == r.v and r.n == len(want[r.g]) for r in rows) and len(rows) == 20_000
