"""Adapters, text sources, sinks, pipelines, registry, command line and streams."""

import json

import pytest
from pyspark.sql import functions as F

from abundera import schema
from abundera.plans import cli, pipeline, registry
from abundera.sources import features, sinks, tables
from abundera.streaming import rollups

NEW = "feature_id long, sequence string, peptidoform string, charge smallint, run_file_name string, is_decoy boolean, unique boolean, intensities array<struct<label:string,intensity:float>>, pg_accessions array<struct<accession:string>>, imputed_labels array<string>, identification_type string, id_run_file_name string"
OLD = "feature_id long, sequence string, peptidoform string, precursor_charge int, reference_file_name string, unique int, intensities array<struct<sample_accession:string,channel:string,intensity:float>>, pg_accessions array<string>"


def test_layouts_become_one(spark, tmp_path):
    a = spark.createDataFrame([(1, "AK", "AK", 2, "r1.raw", False, True, [("r1", 5.0)], [("P",)], None, "identified", None), (2, "AK", "AK", 2, "r1.raw", None, None, [("126", 1.0), ("127N", 0.0), ("127C", float("nan")), None], [("P",), ("Q",)], ["127N"], "transferred", "r2.raw")], NEW)
    b = spark.createDataFrame([(3, "AK", "AK", 3, "r2.mzML", 1, [("s", "LFQ", 7.0)], ["P"])], OLD)
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    both = features.read_features(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert not schema.schema_errors(both, "features")
    long = {(r["feature_id"], r["label"]): r for r in features.explode_intensities(both).collect()}
    assert set(long) == {(1, "r1"), (2, "126"), (3, "LFQ")}
    assert long[1, "r1"]["is_label_free"] and not long[2, "126"]["is_label_free"] and long[3, "LFQ"]["label_key"] == "label free sample"
    assert {r["feature_id"] for r in both.where("is_transferred").collect()} == {2}
    with pytest.raises(ValueError, match="charge"):
        features.adapt_features(a.drop("charge"))


def test_strict_metadata(spark):
    long = spark.createDataFrame([("r1", "126", 1.0)], "run_key string, label_key string, intensity double")
    meta = spark.createDataFrame([("r1", "126", "s")], "run_key string, label_key string, sample string")
    assert features.attach_metadata(long, meta).first()["sample"] == "s"
    with pytest.raises(ValueError, match="no metadata"):
        features.attach_metadata(long, meta.withColumn("label_key", F.lit("127")))
    with pytest.raises(ValueError, match="more than one"):
        features.attach_metadata(long, meta.union(meta))


def test_msstats(spark):
    d = spark.createDataFrame([("P", "AK(ox)", "2", "r", "126", "5"), ("P", "AK(ox)", "2", "r", "127", "7"), ("Q", "AK", "2", "r", "126", "x"), ("Q", "CK", "2", "r", "126", "0")], "ProteinName string, PeptideSequence string, PrecursorCharge string, Run string, Channel string, Intensity string")
    r = tables.from_msstats(d).collect()
    assert len(r) == 1 and [tuple(x) for x in r[0]["intensities"]] == [("126", 5.0), ("127", 7.0)] and r[0]["is_unique"]
    with pytest.raises(ValueError):
        tables.from_msstats(d.drop("Run"))
    assert tables.infer_kit({"126", "127N"}) == "TMT10plex" and tables.infer_kit({"raw"}) is None and tables.channel_map(["1", "x"], "TMT6plex") == {"1": "126", "x": "x"}


def test_text_sources(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">sp|P1|A_X some text\nMKAA\nBZR\n>P2\nGGG\n")
    assert sorted(tuple(r) for r in tables.read_fasta(spark, str(tmp_path / "x.fasta")).collect()) == [("P1", "MKAAR"), ("P2", "GGG")]
    (tmp_path / "p.csv").write_text("ProteinName,PeptideCanonical,SampleID,NormIntensity\nP,A,s,5\nP,B,s,bad\nP,C,s,-1\n")
    assert tables.read_peptides(spark, str(tmp_path / "p.csv")).count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"quant": "top3"}))
    assert tables.read_config(str(tmp_path / "c.json")) == {"quant": "top3"}
    (tmp_path / "k.tsv").write_text("# x\na\tb\n")
    assert tables.read_contrasts(str(tmp_path / "k.tsv")) == [("a", "b")]
    (tmp_path / "r1.tsv").write_text("#note\nprotein\tvalue\nP\t1\n")
    assert tables.read_result_folder(spark, str(tmp_path / "r*.tsv")).select("protein", "value").collect()[0]["value"] == "1"
    tables.csv_to_parquet(spark, str(tmp_path / "p.csv"), str(tmp_path / "p.parquet"))
    assert spark.read.parquet(str(tmp_path / "p.parquet")).count() == 3


def test_matrix_sinks(spark, tmp_path):
    long = spark.createDataFrame([("P", "a", 1.0), ("Q", "b", 2.0)], "protein string, sample string, value double")
    assert [tuple(r) for r in sinks.wide_matrix(long).collect()] == [("P", 1.0, 0.0), ("Q", 0.0, 2.0)]
    wide = sinks.wide_matrix(long, method="median")
    assert [tuple(r) for r in wide.collect()] == [("P", 1.0, None), ("Q", None, 2.0)]
    assert sinks.long_from_wide(wide).count() == 2
    sinks.write_matrix_csv(wide, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).columns == ["protein", "a", "b"]
    tables.save_dataset({"proteins": long}, str(tmp_path / "ds"), ["made"])
    assert list(tables.load_dataset(spark, str(tmp_path / "ds"))) == ["proteins"]
    sinks.write_annotated(sinks.annotated_tables(long, layers={"raw": long}), str(tmp_path / "ann"))
    assert spark.read.parquet(str(tmp_path / "ann/X.parquet")).columns == ["sample", "protein", "X", "raw"]


def test_configuration_is_validated():
    for bad in ({"quant": "nope"}, {"coverage": 2}, {"quant": "ratio", "irs": True}, {"imputation": "x"}, {"de_method": "x"}, {"filters": {"x": {}}}):
        with pytest.raises(ValueError):
            pipeline.PipelineConfig(**bad)
    with pytest.raises(ValueError, match="unknown options"):
        pipeline.PipelineConfig.from_dict({"quantt": "sum"})
    assert pipeline.PipelineConfig(quant="maxlfq").normalization == "hierarchical" and pipeline.PipelineConfig().normalization == "global-median"
    assert registry.parse_quant("Top5") == ("topn", 5) and "knn" in registry.REGISTRY.names("imputation")


def test_pipeline_end_to_end_and_cli(spark, tmp_path, monkeypatch):
    data = [(p, f"K{p}{k}A", 2, s, c, 1, "r" + s, 1, float(100 * (k + 1) * (2 if c == "B" else 1) * (1 + 0.01 * j))) for p in ("P", "Q", "R") for k in range(3) for j, (s, c) in enumerate((("a", "A"), ("b", "A"), ("c", "B"), ("d", "B")))]
    ions = spark.createDataFrame(data, "protein string, peptide string, charge int, sample string, condition string, biorep int, run string, techrep int, intensity double").withColumn("peptidoform", F.col("peptide"))
    design = ions.select("sample", "condition").distinct()
    config = pipeline.PipelineConfig(quant="maxlfq", sample_normalization="none", coverage=1.0, imputation="mindet", contrasts=(("A", "B"),), de_method="limma")
    out = pipeline.features_to_proteins(ions, config, design)
    assert out.count() == 12
    tests = pipeline.differential_expression(out, design, config).collect()
    assert len(tests) == 3 and all(abs(t["log2FC"] - 1) < 0.1 for t in tests)
    with pytest.raises(ValueError, match="design"):
        pipeline.features_to_proteins(ions, config)
    names = {"protein": "ProteinName", "peptide": "PeptideCanonical", "charge": "PrecursorCharge", "sample": "SampleID", "condition": "Condition", "biorep": "BioReplicate", "run": "Run", "techrep": "TechReplicate", "intensity": "NormIntensity"}
    ions.drop("peptidoform").withColumnsRenamed(names).write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    assert cli.main(["proteins", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--method", "sum"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    assert cli.main(["schema"]) == 0


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1, i // 3, (i * 7) % 60), i % 5, "click" if i % 2 else "view", float(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([(99, datetime(2024, 2, 1), 1, "end", 0.0)], d.schema)  # moves the watermark past everything
    stream = rollups.read_events(spark, str(tmp_path / "in"), d.schema)
    rollups.run_once(rollups.windowed_rollup(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    last.write.mode("append").parquet(str(tmp_path / "in"))
    rollups.run_once(rollups.windowed_rollup(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("event_type <> 'end'").collect())
    assert got == sorted(tuple(r) for r in rollups.windowed_rollup(d).collect())
