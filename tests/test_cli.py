import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.sources.readers import HttpJson


@pytest.fixture
def store(spark, tmp_path):
    s = cli.Store(spark, str(tmp_path / "store"))
    base = 1_700_000_000
    raw = [(f"t{i % 40}", f"w{i % 5}", f"m{i % 4}", f"a{i % 4}", "BUY", f"{0.1 + i % 8 / 10:.2f}", "2000", str(base + 700 * i)) for i in range(60)] + [("x", "w", "gone", "a", "BUY", "0.5", "9000", str(base))]
    s.put("raw_trades", spark.createDataFrame(raw, "id string, proxy_wallet string, condition_id string, asset_id string, side string, price string, size string, timestamp string").withColumn("outcome_index", F.lit("0")))
    s.put("market_exclusions", spark.createDataFrame([("gone", "test")], "condition_id string, reason string"))
    markets = [(f"m{i}", ["finance", "sports", "politics", "crypto"][i], f"e{i}", f"title {i}", base - 86400, base + 86400 * 9) for i in range(4)]
    s.put("markets", spark.createDataFrame(markets, "condition_id string, category string, event_slug string, title string, start_ts long, end_ts long"))
    s.put("resolutions", spark.createDataFrame([(f"m{i}", True, "authority", i % 2, base + 86400 * (i + 1)) for i in range(4)], "condition_id string, terminal boolean, source string, winner int, resolved_at long"))
    s.put("outcomes", spark.createDataFrame([(f"a{i}", f"m{i}", 0) for i in range(4)], "asset_id string, condition_id string, outcome_index int"))
    s.put("prices", spark.createDataFrame([(f"a{i % 4}", base + 60 * i, 400_000 + i) for i in range(800)], "asset_id string, t long, price_ppm long"))
    s.put("candidates", spark.createDataFrame([(f"m{i}", "c", f"e{i}", [float(i == k) for k in range(4)]) for i in range(4)], "condition_id string, category string, event_id string, embedding array<double>"))
    return s


def test_verbs_from_raw_trades_to_a_dataset(store, tmp_path, capsys):
    do = lambda *words: (lambda a: a.run(store, a))(cli.parser().parse_args(["--store", store.path, *words]))
    do("backfill")
    trades = store["trades"]
    assert trades.count() == 40 and trades.where("condition_id = 'gone'").count() == 0
    store.put("wallet_history", trades)
    do("enrich")
    do("rescore")
    do("label")
    do("sampled-backfill", "--admission-rate", "1")
    assert store["cohort_markets"].where("selection_status = 'selected'").count() == 4
    with pytest.raises(ValueError, match="seed"):
        do("sampled-backfill", "--admission-rate", "1", "--seed", "5")
    do("finish-existing", "--cohort", "main")
    assert store["cohorts"].count() == 1 and store["features"].count() == 40
    do("backfill")
    assert store["trades"].count() == 40
    assert store["labels"].count() == 120 and store["labels"].where("status = 'complete'").count() > 0
    do("report")
    assert "| bucket |" in capsys.readouterr().out
    do("export", "--output", str(tmp_path / "exports"), "--cohort", "main")
    assert store.spark.read.option("header", True).csv(f"{tmp_path}/exports/cohort_labels").count() == 120
    do("build-dataset", "--output", str(tmp_path / "data"), "--test-start", str(1_700_000_000 + 15_000))
    manifest = json.loads(store.spark.read.text(f"{tmp_path}/data/manifest").first()[0])
    assert manifest["dropped"] == [{"reason": "other_category", "n": 10}]
    features = store.spark.read.option("header", True).csv(f"{tmp_path}/data/features")
    parts = [store.spark.read.option("header", True).csv(f"{tmp_path}/data/labels_{p}") for p in ("train", "test")]
    assert features.count() == sum(p.count() for p in parts) == 30
    assert "## Split x category" in "\n".join(r[0] for r in store.spark.read.text(f"{tmp_path}/data/report").collect())
    store.put("jobs", store.spark.createDataFrame([("j", 1, "main", "scan", "m0", "dead", "x", 1, 0)], "job_key string, job_id int, cohort_name string, job_kind string, entity_id string, status string, last_error string, attempts int, updated_at int"))
    with pytest.raises(SystemExit):
        do("audit", "--output", str(tmp_path / "audit"), "--cohort", "main", "--categories", "c")
    do("retry-jobs", "--kind", "scan")
    assert store["jobs"].first().status == "pending"
    store.next("jobs", store["jobs"].withColumn("status", F.lit("succeeded")))
    do("audit", "--output", str(tmp_path / "audit2"), "--cohort", "main", "--categories", "c")
    assert json.loads("\n".join(r[0] for r in store.spark.read.text(f"{tmp_path}/audit2/main_audit_json").collect()))["passed"]
    grid = ("--c-grid", "1", "--l1-ratios", "0", "--weightings", "none", "--filters", "all", "--feature-sets", "price_only,price_category")
    with pytest.raises(ValueError, match="two folds"):
        do("train-baseline", "--dataset", str(tmp_path / "data"), "--output", str(tmp_path / "none"), *grid)
    do("build-dataset", "--output", str(tmp_path / "all"), "--cohort", "main", "--categories", "c", "--test-start", "1900000000")
    do("train-baseline", "--dataset", str(tmp_path / "all"), "--output", str(tmp_path / "model"), *grid)
    oof = store.spark.read.option("header", True).csv(f"{tmp_path}/model/oof_predictions")
    assert oof.count() == 40 and "p_price_only" in oof.columns
    with pytest.raises(Exception, match="(?i)exist"):
        do("build-dataset", "--output", str(tmp_path / "data"))


def test_data_source_is_registered(spark):
    spark.dataSource.register(HttpJson)
    assert spark.read.format("http_json").options(base="http://127.0.0.1:9", path="/x").load().columns == ["body"]
