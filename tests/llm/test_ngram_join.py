import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark import scratch
from tidemark.llm import ngram_join as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(s), least.get(find(a), i) if s and i is not None else i) for a, (i, s) in enumerate(sets)), key=repr)


def corpus():
    random.seed(11)
    word = lambda: random.choice("abcdefghij") + str(random.randint(0, 400))
    rows, i = [], 0
    passage = " ".join(word() for _ in range(60))
    for size, copies, share in [(40, 30, 0.02), (80, 25, 0.03), (200, 12, 0.01), (12, 10, 0.05), (6, 6, 0.1), (300, 8, 0.04)]:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            rows.append((i, " ".join(word() if random.random() < share else w for w in base)))
            i += 1
    for _ in range(60):
        rows.append((i, passage + " " + " ".join(word() for _ in range(random.randint(5, 40)))))
        i += 1
    rows += [(1000, "A b  C"), (1001, "a B c\n"), (1002, "a b"), (1003, ""), (1004, None), (1005, " \t "), (1006, None), (1007, rows[0][1].upper()), (1007, rows[0][1]), (1008, "x y z q w"), (1009, "x y z q w"), (1010, "x y z q w v"), (None, "n n n n n n"), (2000, "w " * 5000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"rare": 1}, {"rare": 3, "chunk_text": 4000, "bucket_keys": 300}])
def test_components(spark, options):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, c int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df, **options).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (102, 101)], "u long, v long")
    got = {r.node: r.root for r in J.components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def test_few_links_are_joined_in_two_tables(spark, monkeypatch):
    """Rounds are plans that the driver keeps: a chain took as many as its length needs."""
    rows = [(k, k + 1) for k in range(200)] + [(300, 300), (402, 401), (401, 402)]
    links = spark.createDataFrame(random.sample(rows, len(rows)), "u long, v long")
    made = []
    monkeypatch.setattr(J, "cut", lambda df: made.append(df) or scratch.cut(df))
    got = {r.node: r.root for r in J.components(links).collect()}
    assert got == {**{k: 0 for k in range(201)}, 401: 401, 402: 401}
    assert len(made) == 2
    assert {r.node: r.root for r in J.components(links, at_once=10).collect()} == got
    assert J.components(links.where("u > 1000")).count() == 0


def test_a_large_cluster_meets_in_many_small_blocks(spark, monkeypatch):
    """Askers met all members of their cluster, of any size, under one key."""
    random.seed(5)
    base = [int(x) for x in random.sample(range(1 << 40), 900)]
    sets = {c: sorted(base[: (8, 30, 200, 800)[c % 4] + c % 3]) for c in range(60)}
    monkeypatch.setattr(J, "MEMBERS", 4)
    monkeypatch.setattr(J, "ASKERS", 2)
    monkeypatch.setattr(J, "_block_links", lambda batches: (pa.RecordBatch.from_pydict({"u": [len(b["members"][k])], "v": [100 * min(x["n"] for x in b["members"][k].as_py()) // max(x["n"] for x in b["members"][k].as_py())]}, schema=pa.schema({"u": pa.int64(), "v": pa.int64()})) for b in batches for k in range(b.num_rows)))
    item = lambda c: (c, len(sets[c]), len(sets[c]))
    kind = "struct<c:long,n:long,m:long>"
    asked = spark.createDataFrame([(item(c), c, 0) for c in sets], f"v {kind}, rv long, cluster long")
    members = spark.createDataFrame([(item(c), c, 0, len(sets)) for c in sets], f"x {kind}, root long, cluster long, size long")
    tokens = spark.createDataFrame([(c, len(t), J.pack_tokens(np.array(t))) for c, t in sets.items()], "c long, n long, tokens binary")
    met = J._within_clusters(asked, members, tokens).collect()
    assert max(r.u for r in met) <= 15 and min(r.v for r in met) >= 74
    monkeypatch.undo()
    got = {(r.u, r.v) for r in J._within_clusters(asked, members, tokens).collect()}
    links = {(u, v) for u in sets for v in sets if u != v and 100 * len({*sets[u]} & {*sets[v]}) >= 75 * len({*sets[u]} | {*sets[v]})}
    assert got == links


def test_prefixes_share_an_entry():
    import numpy as np

    random.seed(4)
    for rare in (1, 5, 64):
        for n in (2, 3, 7, 20, 60, 200):
            base = random.sample(range(10_000), n)
            other = [t if random.random() > 0.1 else 20_000 + t for t in base] + random.sample(range(30_000, 40_000), n // 12)
            shared = len(set(base) & set(other))
            if 100 * shared < 75 * (len(base) + len(other) - shared):
                continue
            df = {t: 1 + (t % 100) for t in {*base, *other}}
            df.update({t: max(2, df[t]) for t in set(base) & set(other)})
            entries = []
            for x in (base, other):
                own = sorted((df[t], t) for t in x if df[t] > 1)
                entries.append(J.prefix_entries(len(x), sum(df[t] == 1 for t in x), np.array([a for a, _ in own]), np.array([b for _, b in own]), rare))
            assert len(np.intersect1d(*entries)) > 0
