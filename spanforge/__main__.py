"""Command line: extract entities from notes, write a submission, check it.

    python -m spanforge extract --notes DIR --out DIR [--seeds DIR] [--index FILE --ontology ICD10] [--variant broad]
    python -m spanforge pack --notes DIR --entities DIR --folder DIR/output --archive FILE --expected N
    python -m spanforge check --archive FILE
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lexicon, proposals, resolver
from .plans import pipeline
from .sources import readers, sinks


def extract(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Entities of all notes, written to --out and returned."""
    phrases = None
    if a.index:
        concepts, _, _ = readers.inverted_index(spark, a.index, a.ontology)
        kind = "CHẨN_ĐOÁN" if a.ontology == "ICD10" else "THUỐC"
        phrases = lexicon.build_lexicon(concepts.withColumn("entity_type", F.lit(kind)))
    given = readers.seeds(spark, a.seeds).select("doc_id", "start", "end", "type") if a.seeds else None
    found = pipeline.extract(readers.notes(spark, a.notes), given, phrases)
    resolver.variant(found, a.variant).write.mode("overwrite").parquet(a.out)
    return spark.read.parquet(a.out)


def pack(spark: SparkSession, a: argparse.Namespace) -> None:
    payloads = sinks.organizer_documents(spark.read.parquet(a.entities), readers.notes(spark, a.notes))
    sinks.archive(sinks.export_folder(payloads, a.folder), a.archive, a.expected)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    for name in ("notes", "out"):
        e.add_argument(f"--{name}", required=True)
    e.add_argument("--seeds")
    e.add_argument("--index")
    e.add_argument("--ontology", default="ICD10", choices=["ICD10", "RXNORM"])
    e.add_argument("--variant", default="broad", choices=["control", "high", "broad"])
    k = sub.add_parser("pack")
    for name in ("notes", "entities", "folder", "archive"):
        k.add_argument(f"--{name}", required=True)
    k.add_argument("--expected", type=int, required=True)
    sub.add_parser("check").add_argument("--archive", required=True)
    a = p.parse_args(args)
    if a.command == "check":
        unsafe = sinks.unsafe_entries(a.archive)
        print("\n".join(unsafe) or "no unsafe entry")
        return int(bool(unsafe))
    spark = SparkSession.builder.getOrCreate()
    if a.command == "extract":
        extract(spark, a).groupBy("type").count().show(len(proposals.TYPES), truncate=False)
    else:
        pack(spark, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
