import math
import random
import re
from collections import Counter

from tidemark.llm import licenses as L

IDF, UNKNOWN, VECTORS = L.idf_of(L.TEMPLATES), L.unknown(L.TEMPLATES), L.vectors_of(L.TEMPLATES)


def cosine(text):
    """The best cosine of a stretch to any template."""
    q = {k: n * IDF.get(k, UNKNOWN) for k, n in Counter(L.tokens(text)).items()}
    norm = math.sqrt(sum(x * x for x in q.values()))
    shared = [(n, v) for n, v in VECTORS if len((q.keys() & v.keys()) - L.COMMON) >= L.least_shared(len(v.keys() - L.COMMON))]
    return min(((-round(sum(x * v.get(k, 0) for k, x in q.items()) / norm, 9), n) for n, v in shared), default=(0, None)) if q else (0, None)


def own(text):
    """The licence of a text by comparing all its stretches with all templates; no gate."""
    plain = re.sub(L._COMMENT, " ", text or "")
    parts = [plain, *re.split(r"\r?\n", plain), *re.split(r"(?<=[.!?;])\s+|\r?\n", plain), *re.split(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+", plain)]
    found = [cosine(p) for p in parts]
    s, n = min(found, key=lambda x: (x[0], x[1] or ""))
    return (n, -s) if -s >= L.THRESHOLD else (None, None)


def test_statements_and_inheritance(spark):
    prose = "Some words of a long text that says nothing. " * 20
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"), (2, "a/b/c/x.txt", prose),
        (3, "a/b/y.txt", prose + "\nLicensed under the Apache License, Version 2.0."), (4, "a/d/note.txt", "Licensed under CC BY-NC 4.0."), (5, "a/d/e/z.txt", prose), (6, "q/r.txt", prose),
        (7, "q/s.txt", prose + "\nYou need a licence to drive a car in most of the countries of the world."), (8, None, prose), (9, "a/t.txt", None), (10, "a/t.txt", ""), (10, "a/t.txt", ""),
        (11, "top.txt", prose), (12, "g/v.txt", "x " * 30000 + "This work is licensed under the GNU General Public License, version 3. " + "y " * 30000),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, dir int")
    got = {}
    for r in L.scan(df).collect():
        got[r.doc_id] = (r.own_license, r.inherited_license, r.inherited_from, r.license)
    assert got[1][0] == "MIT" and got[2] == (None, "MIT", "a", "MIT") and got[3][0] == "Apache-2.0" and got[4][0] == "CC-BY-NC-4.0"
    assert got[5] == (None, "CC-BY-NC-4.0", "a/d", "CC-BY-NC-4.0") and got[6] == got[7] == got[8] == got[11] == (None, None, None, None)
    assert got[9] == got[10] == (None, "MIT", "a", "MIT")
    assert L.scan(df).count() == len(rows) and L.scan(df.limit(0)).count() == 0


def test_texts_against_all_templates(spark):
    random.seed(4)
    filler = lambda n: " ".join(random.choice("alpha beta gamma the of public version software license file work".split()) for _ in range(n))
    wrapped = lambda t, mark: "\n".join(f"{mark} {' '.join(w)}" for w in (lambda ws: [ws[i : i + 9] for i in range(0, len(ws), 9)])(t.split()))
    texts = [t for _, t in L.TEMPLATES]
    texts += [wrapped(t, "#") + "\n\n" + filler(40) for _, t in L.TEMPLATES] + [filler(30) + "\n * " + t for _, t in L.TEMPLATES[::2]] + [filler(n) for n in (3, 20, 200)]
    texts += [" ".join(w for w in t.split() if random.random() < 0.7) for _, t in L.TEMPLATES] + ["", "the", "public domain", "MIT", "mit mit", "Mit der Zeit.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "cast(null as string) as path")
    got = {r.doc_id: (r.own_license, r.own_score) for r in L.scan(df).collect()}
    for i, t in enumerate(texts):
        name, score = own(t)
        assert (got[i][0], got[i][1]) == (name, None if score is None else round(score, 6)), (t, got[i], name, score)
    for i, (name, _) in enumerate(L.TEMPLATES):
        assert got[i][0] == name


def test_identifiers(spark):
    lines = {"// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "/* spdx-license-identifier: bsd-3-clause */": "BSD-3-Clause", "SPDX-License-Identifier: Zlib": "Zlib", "SPDX-License-Identifier:": None}
    df = spark.createDataFrame([(i, f"{k}\nint main;") for i, k in enumerate(lines)], "doc_id long, text string").selectExpr("*", "'a.c' as path")
    assert {r.doc_id: r.own_license for r in L.scan(df).collect()} == dict(enumerate(lines.values()))


def test_inheritance_against_a_walk(spark):
    random.seed(6)
    names = ["MIT", "ISC", "Zlib", None]
    parts = lambda: "/".join(random.choice("abc") for _ in range(random.randrange(0, 4)))
    rows = []
    for i in range(300):
        d, lead = parts(), random.choice(["", "/"])
        path = f"{lead}{d}/{random.choice(['LICENSE', 'x.py', 'y.txt'])}".replace("//", "/") if d or lead else random.choice(["LICENSE", "x.py"])
        rows.append((i, path, random.choices(names, [1, 1, 1, 20])[0]))
    text = lambda n: f"SPDX-License-Identifier: {n}" if n else "no words"
    df = spark.createDataFrame([(i, p, text(n)) for i, p, n in rows], "doc_id long, path string, text string")
    folder = lambda p: re.sub("/?[^/]*$", "", p)
    dirs = {}
    for _, p, n in rows:
        if n and re.search(L.LICENCE_FILE, p):
            dirs[folder(p)] = min(dirs.get(folder(p), "~"), n)
    got = {r.doc_id: (r.license, r.inherited_from) for r in L.scan(df).collect()}
    for i, p, n in rows:
        at, want = folder(p), (n, None)
        while not n:
            if at in dirs:
                want = (dirs[at], at)
                break
            if not at:
                break
            at = folder(at)
        assert got[i] == want, (p, n)
