import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import mldiag
from mldiag.operators import annotate
from mldiag.sources import catalog, readers, sinks


@pytest.fixture(scope="module")
def rows(spark):
    p = [[0.5, 0.5], [1.0, 0.0], [0.9, 0.1], [0.6, 0.4]]
    return spark.createDataFrame([(i, float(i), -float(i), "a", v) for i, v in enumerate(p)],
                                 "id bigint, x double, y double, label string, probability array<double>")


def pick(rows, *ids):
    return rows.where(F.col("id").isin(list(ids)))


def test_last_label_wins_and_undo_forgets(rows):
    log = annotate.assign_events(pick(rows, 0, 1), "id", " one ", 1)
    log = log.unionByName(annotate.assign_events(pick(rows, 1, 2), "id", "two", 2))
    state = lambda l: {r["row_id"]: r["label"] for r in annotate.current_labels(l).collect()}
    assert state(log) == {0: "one", 1: "two", 2: "two"}
    log = log.unionByName(annotate.undo_event(log, 3))
    assert state(log) == {0: "one"}
    log = log.unionByName(annotate.assign_events(pick(rows, 2), "id", "new", 4))
    assert state(log) == {0: "one", 2: "new"}
    assert [(r["number"], r["first_ids"], r["n"]) for r in annotate.history(log).orderBy("number").collect()] == [(1, "0,1", 2), (2, "2", 1)]
    log = log.unionByName(annotate.undo_event(log, 5))
    log = log.unionByName(annotate.undo_event(log, 6))
    assert state(log) == {} and annotate.undo_event(log, 7).count() == 0
    with pytest.raises(ValueError):
        annotate.assign_events(rows, "id", "  ", 8)


def test_uncertainty_queue_and_progress(rows):
    labels = annotate.current_labels(annotate.assign_events(pick(rows, 0, 1), "id", "z", 1))
    table = {r["id"]: (r["entropy"], r["annotated"]) for r in annotate.uncertainty(rows, "id", labels).collect()}
    assert table[0] == (1.0, "z") and table[1][0] == pytest.approx(0, abs=1e-6) and table[3][1] == ""
    queue = annotate.suggest(rows, "id", labels, 1).collect()
    assert [(r["rank"], r["id"], r["true_label"]) for r in queue] == [(1, 3, "a")]
    row = annotate.progress(rows, "id", labels).first()
    assert (row["labeled"], row["total"], row["uncertain"], row["labeled_uncertain"]) == (2, 4, 2, 1)
    assert (row["est_gain_pct"], row["progress_pct"]) == (2.5, 50)
    plain = annotate.progress(rows.drop("probability"), "id", labels).first()
    assert plain["est_gain_pct"] == 0


def test_export(rows, tmp_path):
    labels = annotate.current_labels(annotate.assign_events(pick(rows, 1, 3), "id", "z", 1))
    got = annotate.export_labels(labels, rows, "id", "label").collect()
    assert [(r["index"], r["emb_x"], r["original_label"]) for r in got] == [(1, 1.0, "a"), (3, 3.0, "a")]
    outside = labels.unionByName(labels.limit(1).withColumn("row_id", F.lit(99).cast("bigint")))
    assert annotate.export_labels(outside, rows, "id", "label").collect()[-1]["emb_x"] is None
    sinks.write_labels_csv(annotate.export_labels(labels), str(tmp_path / "l.csv"))
    assert (tmp_path / "l.csv").is_dir()


@pytest.mark.parametrize("probabilities, bits", [([0.5, 0.5], 1.0), ([1.0, 0.0], 0.0), ([1 / 3] * 3, np.log2(3)), ([1.0], 0.0)])
def test_entropy(spark, probabilities, bits):
    df = spark.createDataFrame([(probabilities,)], "p array<double>")
    from mldiag.functions.columns import entropy_bits, max_entropy

    row = df.select(entropy_bits(F.col("p")).alias("e"), max_entropy(F.size("p")).alias("m")).first()
    assert row["e"] == pytest.approx(bits, abs=1e-9)
    assert row["m"] == pytest.approx(np.log2(len(probabilities)) if len(probabilities) > 1 else 1.0)


def test_formats(spark, tmp_path):
    pdf = pd.DataFrame({"a": [1, 2], "b": [0.5, 1.5]})
    pdf.to_csv(tmp_path / "t.csv", index=False)
    pdf.to_csv(tmp_path / "t.TSV", index=False, sep="\t")
    pdf.to_json(tmp_path / "t.json", orient="records")
    pdf.to_json(tmp_path / "t.jsonl", orient="records", lines=True)
    pdf.to_parquet(tmp_path / "t.parquet")
    pdf.to_csv(tmp_path / "t.data", index=False)
    for name in ("t.csv", "t.TSV", "t.json", "t.jsonl", "t.parquet", "t.data"):
        got = mldiag.read_table(spark, f"{tmp_path}/{name}?x=1").orderBy("a").collect()
        assert [(r["a"], r["b"]) for r in got] == [(1, 0.5), (2, 1.5)], name
    assert mldiag.read_table(spark, f"{tmp_path}/t.parquet", columns=["b"]).columns == ["b"]


def test_images(spark, tmp_path):
    for name in ("one.png", "cats/two.JPG", "dogs/deep/three.webp", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = [(r["filename"], r["label"]) for r in mldiag.load_images(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("one.png", "unknown"), ("three.webp", "deep"), ("two.JPG", "cats")]
    with pytest.raises(ValueError):
        mldiag.load_images(spark, str(tmp_path), [".gif"])


def test_catalog(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [3.0, 4.0])], "k int, s string, v array<double>")
    named = mldiag.TableCatalog(spark, {"t": df, "lazy": lambda s: s.range(3).toDF("k")})
    assert named.tables() == ["t", "lazy"] and named.table("lazy") is named.table("lazy")
    assert named.get("t", k=[1], nothing=3).count() == 1 and named.get("t", s="b").first()["k"] == 2
    assert named.get("t", k=[]).count() == 0
    assert [tuple(r) for r in named.schema("lazy").collect()] == [("lazy", "k", "bigint")]
    cached = named.cache("t")
    assert cached.is_cached and named.table("t") is cached
    cached.unpersist()
    emb = catalog.embedding_catalog(spark, df, "v", 2)
    assert emb.tables() == ["data", "embeddings"] and emb.get("embeddings").columns == ["dim_0", "dim_1"]
    assert catalog.embedding_catalog(spark, df).tables() == ["data"]


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).withColumn("s", F.lit("a")).write.parquet(str(tmp_path / "t.parquet"))
    named = mldiag.TableCatalog(spark, {"t": str(tmp_path / "t.parquet")})
    plan = named.get("t", id=3, s=["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan and "In(s, [a,b])" in plan


def test_snapshot_and_summary(spark, rows, tmp_path):
    scored = rows.withColumn("prediction", F.lit("a"))
    row = sinks.snapshot(scored, "demo", ["x"], "label", "prediction", models_trained=["m"])
    sinks.write_snapshot(row, str(tmp_path / "s"))
    part = next((tmp_path / "s").glob("*.json"))
    assert json.loads(part.read_text())["accuracy"] == 1.0
    got = {(r["section"], r["key"]): r["value"] for r in sinks.analysis_summary(scored, ["x"], "label", "prediction", scored.where("id > 1")).collect()}
    assert got[("dataset", "samples")] == 4 and got[("selection", "x.mean")] == 2.5
    assert readers.reader_for("/a/B.NDJSON?v=2") is readers.read_json_lines
