"""Command line over the pipeline functions: ``python -m abundera.plans.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json

from abundera.operators import pibaq
from abundera.plans import pipeline
from abundera.session import build_session
from abundera.sources import features, sinks, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="abundera")
    sub = p.add_subparsers(dest="command", required=True)
    extra = {
        "correct-batches": ("correct batches in a long table of log values", {"--batches": "parquet of sample and batch"}),
        "differential": ("test a long protein table", {"--design": "parquet of sample and condition", "--contrast": "two conditions, as A:B", "--counts": "parquet of protein and count"}),
        "pibaq": ("peptide table to shared-signal abundances", {"--fasta": "sequences to digest", "--mode": "proportional, unique or stable-ratio"}),
        "spectral-count": ("PSM table to counts", {"--features": "feature table"}),
    }
    for name, (text, options) in extra.items():
        c = sub.add_parser(name, help=text)
        for option, help_ in {"--input": "table", "--output": "folder", "--config": "JSON configuration", "--method": "method", **options}.items():
            c.add_argument(option, help=help_, required=option in ("--input", "--output", "--batches", "--design", "--contrast", "--features"))
        c.add_argument("--wide", action="store_true")
    for name, text in (("proteins", "peptide table to protein matrix"), ("peptides", "ion table to peptide table"), ("impute", "fill a long protein table"), ("normalize", "normalise a long protein table")):
        c = sub.add_parser(name, help=text)
        c.add_argument("--input", required=True)
        c.add_argument("--output", required=True)
        c.add_argument("--config", help="JSON configuration")
        c.add_argument("--method")
        c.add_argument("--wide", action="store_true", help="write entities by samples as CSV")
    sub.add_parser("schema", help="options as JSON")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "schema":
        print(json.dumps(pipeline.config_schema(), default=str, indent=1))
        return 0
    spark = build_session()
    options = tables.read_config(args.config) if args.config else {}
    if args.command in ("proteins", "peptides"):
        config = pipeline.PipelineConfig.from_dict(options | ({"quant": args.method} if args.method else {}))
        ions = tables.read_peptides(spark, args.input)
        if "peptidoform" not in ions.columns:
            ions = ions.withColumn("peptidoform", ions["peptide"])
        out = pipeline.features_to_proteins(ions, config) if args.command == "proteins" else pipeline.features_to_peptides(ions, config)
    elif args.command == "correct-batches":
        out = pipeline.REGISTRY.get("batch", args.method or "combat")(spark.read.parquet(args.input), spark.read.parquet(args.batches), **options)
    elif args.command == "differential":
        a, b = args.contrast.split(":")
        config = pipeline.PipelineConfig.from_dict(options | {"contrasts": [(a, b)]} | ({"de_method": args.method} if args.method else {}))
        counts = spark.read.parquet(args.counts) if args.counts else None
        out = pipeline.differential_expression(spark.read.parquet(args.input), spark.read.parquet(args.design), config, counts)
    elif args.command == "pibaq":
        config = pipeline.PipelineConfig.from_dict(options | {"quant": "pibaq"} | ({"pibaq_mode": args.mode} if args.mode else {}))
        edges = pibaq.digest(tables.read_fasta(spark, args.fasta)) if args.fasta else None
        out = pipeline.pibaq_values(tables.read_peptides(spark, args.input), config, edges)
    elif args.command == "spectral-count":
        config = pipeline.PipelineConfig.from_dict(options | {"quant": "spectral_count"})
        out = pipeline.spectral_counts(features.read_psms(spark, args.input), features.feature_groups(features.read_features(spark, args.features)), config)
    else:
        long = spark.read.parquet(args.input)
        group = "imputation" if args.command == "impute" else "normalization.sample"
        out = pipeline.REGISTRY.get(group, args.method or "none")(long, **options)
    if args.wide:
        sinks.write_matrix_csv(sinks.wide_matrix(out), args.output)
    else:
        sinks.write_peptides(out, args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
