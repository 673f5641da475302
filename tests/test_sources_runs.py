"""Sources, declared tables, generated worlds, whole runs, streams and the entry point."""

from __future__ import annotations

import datetime as dt
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.functions.schema import TABLES, TableSpec, visible
from tidemark.operators import quality, synth
from tidemark.operators.folds import FoldRule
from tidemark.plans import experiment
from tidemark.sources import config, provider, remote

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_specs(spark):
    t = TABLES["fx_rates"]
    good = spark.createDataFrame([("EUR", "USD", dt.date(2020, 1, 1), 1.1, dt.datetime(2020, 1, 1, 21))], "base_ccy string, quote_ccy string, event_date date, rate double, knowledge_time timestamp_ntz")
    assert t.problems(good) == []
    bad = good.unionByName(good).withColumn("rate", F.lit(-1.0)).withColumn("knowledge_time", F.lit("2019-12-31").cast("timestamp_ntz"))
    assert t.problems(bad) == ["rate_positive: 2 rows", "known_before_event: 2 rows", "1 duplicate keys"]
    assert visible(good, t, ["rate"]).columns == ["base_ccy", "quote_ccy", "event_date", "knowledge_time", "rate"]
    with pytest.raises(ValueError):
        TableSpec("x", {"a": "int"}, ("b",))


def test_config(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": {"p": 1, "q": 2}, "l": [1]}))
    (tmp_path / "b.json").write_text(json.dumps({"inherits": "a.json", "x": {"q": 3}, "l": [2]}))
    assert config.load(str(tmp_path / "b.json")) == {"x": {"p": 1, "q": 3}, "l": [2]}
    (tmp_path / "a.json").write_text(json.dumps({"inherits": "b.json"}))
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "b.json"))


def test_remote(tmp_path):
    calls = []

    def send(endpoint, params):
        calls.append(params)
        if len(calls) == 1:
            raise OSError
        return {"rows": [params["page"]], "next": params["page"] + 1 if params["page"] < 2 else None}

    clock = iter(range(1000))
    make = lambda replay: remote.Client(send, remote.Cache(str(tmp_path / "c")), remote.Limiter(1000, 2, lambda: next(clock), lambda s: None), remote.Budget(str(tmp_path / "b"), 10), replay)
    assert list(make(False).pages("e", {"a": 1})) == [[0], [1], [2]] and len(calls) == 4
    assert list(make(True).pages("e", {"a": 1})) == [[0], [1], [2]] and len(calls) == 4
    with pytest.raises(remote.RemoteError):
        list(make(True).pages("e", {"a": 2}))
    assert remote.request_hash("e", {"a": 1, "b": 2}) == remote.request_hash("e", {"b": 2, "a": 1})
    assert remote.id_chunks(["c", "a", "b", "a"], 2) == [["a", "b"], ["c"]]
    budget = remote.Budget(str(tmp_path / "b2"), 1)
    budget.spend("x")
    with pytest.raises(remote.RemoteError):
        budget.spend("y")


def test_provider(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0), ("A", dt.date(2020, 2, 1), 2.0), ("B", dt.date(2020, 1, 1), 3.0)], "security_id string, event_date date, close double")
    p = provider.TableProvider({"prices": df}, {"prices": provider.Capability("prices", ("close",), "all", dt.date(2020, 1, 1), dt.date(2020, 12, 31))}, {"A", "B"})
    assert p.fetch("prices", ["A"], ["close"], dt.date(2020, 1, 15), dt.date(2020, 12, 31)).count() == 1
    for args in (("fx", ["A"], []), ("prices", ["A", "A"], ["close"]), ("prices", ["Z"], ["close"]), ("prices", ["A"], ["open"]), ("prices", ["A"], ["close"], dt.date(2019, 1, 1))):
        with pytest.raises(provider.ProviderError):
            p.fetch(*args)
    assert provider.grade(p.capabilities()["prices"]) == "FULL_VINTAGES"
    d = tmp_path / "SYNA__XNAS"
    d.mkdir()
    (d / "financial_statements.csv").write_text("excel_code,label,unit,FY-1,FY0,FY1\n,,,2019-12-31,2020-12-31,2021-12-31\nREV,Revenue,USD,10,,12.5\n")
    got = {(r.security, r.excel_code, r.column, r.period_end.isoformat(), r.value) for r in provider.read_template(spark, str(tmp_path), "financial_statements.csv").collect()}
    assert got == {("SYNA__XNAS", "REV", "FY-1", "2019-12-31", 10.0), ("SYNA__XNAS", "REV", "FY1", "2021-12-31", 12.5)}
    (d / "trading_multiples.csv").write_text("PE__date,PE__value,PB__date,PB__value\n2020-01-01,5,2020-01-02,1\n2020-02-01,6,,\n")
    assert provider.read_multiples(spark, str(tmp_path), "trading_multiples.csv").count() == 3


def test_world_is_the_same_however_it_is_cut(spark):
    w = synth.World(securities=6, months=30, split_share=1.0, delist_share=0.5)
    a = synth.generate(spark, w)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, synth.generate(spark, w).repartition(5).collect()))
    assert rows != sorted(map(tuple, synth.generate(spark, synth.ablated(w, seed=2)).collect()))
    assert synth.price_identity(a).count() == 0


def test_seeded_errors_are_found_and_clean_data_passes(spark):
    clean = synth.bars(synth.generate(spark, synth.World(securities=20, months=60)))
    assert quality.bad_prices(clean, ["close"]).count() == 0 and quality.duplicates(clean, ["security_id", "event_date"], ["close"]).count() == 0
    bad, truth = synth.seed_errors(clean)
    want = {r.error: r.n for r in truth.groupBy("error").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert quality.bad_prices(bad, ["close"]).count() == want["negative_price"]
    assert quality.duplicates(bad, ["security_id", "event_date"], ["close"]).count() == want["duplicate_bar"]
    assert quality.negative_volume(bad, "volume").count() == want["impossible_volume"]
    assert quality.known_before_event(bad, "knowledge_time", "event_date").count() == want["inverted_timestamp"]


def test_every_seeded_error_class_is_found(spark):
    from tidemark.plans.run_queries import seeded_errors_found

    got = {r.error: r for r in seeded_errors_found(spark, "").collect()}
    assert set(got) == set(synth.ERRORS) and all(r.seeded == r.found == r.both > 0 for r in got.values())
    clean = synth.bars(synth.generate(spark, synth.World(securities=20, months=60)))
    bad, truth = synth.seed_errors(clean, ("stale_price",), 31)
    key = ["security_id", "event_date"]
    changed = bad.join(clean.withColumnRenamed("close", "was").select(*key, "was"), key).where("close <> was")
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    assert rows(changed) == rows(truth) and truth.count() > 0
    assert quality.stale_runs(clean, ["security_id"], ["event_date"], "close", 2).count() == 0
    runs = quality.stale_runs(bad, ["security_id"], ["event_date"], "close", 2).collect()
    assert {r.run_length for r in runs} == {synth.FROZEN + 1} and synth.FROZEN * len(runs) == truth.count()


def test_a_planted_signal_is_learnt_and_a_run_verifies(spark, tmp_path):
    panel = synth.generate(spark, synth.World(securities=30, months=48, signal=0.9, persistence=0.3, delist_share=0.0))
    e = experiment.Experiment(features=("exposure",), rounds=2, rule=FoldRule(train_steps=24, test_steps=20))
    from pyspark.sql import Window

    w = Window.partitionBy("security_id").orderBy("m")
    raw = panel.select("security_id", "m", "exposure", (F.lead("close").over(w) * F.lead("split").over(w) / F.col("close") - 1).alias("fwd"))
    from tidemark.functions import xsec

    frame = xsec.quantile_labels(raw.where("fwd is not null"), ["m"], "fwd", "security_id", 0.3, 0.3)
    scores, skipped = experiment.walk_forward(frame, e)
    assert skipped.count() == 0
    out = experiment.report(scores, e)
    assert out["ic"].agg(F.avg("ic")).first()[0] > 0.3
    path = experiment.write_run({"ic": out["ic"], "ledger": out["ledger"]}, str(tmp_path), e)
    assert experiment.write_run({"ic": out["ic"], "ledger": out["ledger"]}, str(tmp_path), e) == path
    assert experiment.verify_run(spark, path) == []
    assert experiment.acceptance(0.08, 0.0864, 0.02) and not experiment.acceptance(None, 0, 1)


def test_entry_without_the_training_data_subpackage(tmp_path):
    """The rest of the library stands on its own."""
    code = "import sys\nclass No:\n  def find_spec(self, n, *a):\n    if n.startswith('tidemark.llm') or n == 'corpus_pipeline': raise ImportError(n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq=e.queries(); assert q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_oracle_keys_are_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
