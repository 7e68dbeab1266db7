import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tidemark.llm.common import pick
from tidemark.llm.queries import ORACLE, QUERIES


def test_each_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "secrets", "mixing", "bpe"]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if k < 4:
            assert docs.columns == columns
        if name in ("secrets", "bpe"):
            assert set(ids) == before
        if name == "mixing":
            assert all(i in ids for i in before if i in labels and labels[i].quality == 1)
        before = set(ids)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(whole.select("doc_id", "ids_sha256").collect()) == sorted(docs.select("doc_id", "ids_sha256").collect())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    want = c.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()


def test_columns_by_exact_name(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1, "a", "A")], "doc_id long, text string, TEXT string")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert pick(df, id="doc_id", text="text").first() == (1, "a")


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    import numpy as np
    import tokenizers
    from pyspark.sql import functions as F

    from tidemark.llm import bpe, mixing, secrets, toxicity

    base = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"_row": F.lit("r"), "hits": F.col("doc_id") % 3})
    more = [(100_001, None), (100_002, ""), (100_003, "one two three four five six seven eight"), (100_004, "One two three four five six seven eight"), (100_004, "One two three four five six seven eight"), (None, "no id at all")]
    more.append((100_005, 'a line of words token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and more of them'))
    extra = spark.createDataFrame(more, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long"), "_row": F.lit("x"), "hits": F.lit(1).cast("long")})
    docs = base.unionByName(extra.select(base.columns))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.text or "", r._row)
    rows = lambda df: sorted(map(key, df.collect()))

    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert rows(kept) == sorted(key(r) for r in docs.collect() if r.doc_id is None or r.doc_id not in bad)

    shingles = {}
    for r in docs.collect():
        w = (r.text or "").lower().split()
        shingles.setdefault(r.doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    ids = sorted(i for i in shingles if i is not None)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            x, y = shingles[a], shingles[b]
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root[a], root[b]
                root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert rows(kept) == sorted(key(r) for r in docs.collect() if r.doc_id is None or root[r.doc_id] == r.doc_id)

    forest = secrets.trained(docs, None, "text")
    text = {}
    for r in secrets.scan(docs.where("doc_id < 100000 or doc_id > 100004"), path_col="source", forest=forest).where("is_secret").orderBy(F.desc("start")).collect():
        text.setdefault(r.doc_id, []).append((r.start, r.length))
    hidden = {r.doc_id: r for r in corpus_pipeline.hide_secrets(spark, docs, sf_dir).collect()}
    for r in docs.where("doc_id < 100000 or doc_id > 100004").collect():
        want = r.text
        for start, length in text.get(r.doc_id, []):
            want = want[:start] + secrets.MARK + want[start + length :]
        assert hidden[r.doc_id].text == want and hidden[r.doc_id].n_chars == len(want)
    assert text and hidden[100_001].text is None

    _, fit = mixing.thin_to_shares(docs, labels, corpus_pipeline.domain_of_labels(), list(corpus_pipeline.DOMAINS), list(corpus_pipeline.DOMAINS.values()))
    mixed = corpus_pipeline.mix_domains(spark, docs, sf_dir)
    assert fit.converged and mixed.columns == docs.columns and mixed.count() <= docs.count()
    assert np.isclose(fit.expected[1] / fit.expected.sum(), min(corpus_pipeline.DOMAINS["noisy"], fit.totals[1] / (fit.expected[0] + fit.totals[1])), atol=1e-3)

    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path(None))
    library.no_truncation()
    library.no_padding()
    texts = dict((r.doc_id, r.text) for r in docs.collect())
    for r in corpus_pipeline.encode(spark, docs, sf_dir).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_a_long_text_is_walked_in_pieces(monkeypatch):
    import numpy as np

    from tidemark.llm import common

    rng = np.random.default_rng(0)
    data = np.frombuffer(bytes(rng.choice(list(b"abcdefgh  \n"), 20_000)) + b"x" * 3000 + b" end", np.uint8)
    cuts = np.sort(rng.choice(len(data), 30, replace=False))
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(data)]])
    whole = common.word_hashes(data, starts, ends)
    monkeypatch.setattr(common, "CHUNK_BYTES", 512)
    for a, b in zip(whole, common.word_hashes(data, starts, ends), strict=True):
        assert (a == b).all()
