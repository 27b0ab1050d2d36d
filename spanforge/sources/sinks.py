"""Writers: organizer documents, record logs, variants, reproducible archives."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolver import organizer_json

ZIP_TIME = (1980, 1, 1, 0, 0, 0)


def organizer_documents(entities: DataFrame, docs: DataFrame, candidates: bool = False) -> DataFrame:
    """doc_id, payload: the JSON list of each document's entities in order of place; documents without any have []."""
    row = organizer_json(F.col("assertions"), F.col("candidates") if candidates else None)
    item = F.struct("start", "end", "type", row.alias("json"))
    lists = entities.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["json"]), ",").alias("body"))
    return docs.select("doc_id").join(lists, "doc_id", "left").select("doc_id", F.concat(F.lit("["), F.coalesce("body", F.lit("")), F.lit("]")).alias("payload"))


def write_documents(payloads: DataFrame, path: str) -> None:
    """One row a document; a task writes whole partitions by the commit protocol, so retries are safe."""
    payloads.write.mode("overwrite").json(path)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_variants(rows: DataFrame, path: str) -> None:
    """rows with a column variant, one folder each."""
    rows.write.mode("overwrite").partitionBy("variant").json(path)


def safe_output(path: str | Path, name: str = "output") -> Path:
    """The folder if it may be replaced: its name fits, it is no link, no root or home, and holds nothing but numbered JSON."""
    p = Path(path)
    if p.is_symlink() or p.name != name or p.resolve() in {Path("/"), Path.home().resolve(), Path.cwd().resolve()}:
        raise ValueError(f"not a safe output folder: {p}")
    if p.exists() and any(not (f.is_file() and f.suffix == ".json" and f.stem.isdigit()) for f in p.iterdir()):
        raise ValueError(f"other files are in {p}")
    return p


def export_folder(payloads: DataFrame, path: str | Path) -> Path:
    """Numbered files of a submission on the driver. A submission is small; rows come one at a time."""
    root = safe_output(path)
    root.mkdir(parents=True, exist_ok=True)
    for old in root.iterdir():
        old.unlink()
    for row in payloads.toLocalIterator():
        (root / f"{row['doc_id']}.json").write_text(row["payload"], encoding="utf-8")
    return root


def archive(folder: str | Path, target: str | Path, expected: int) -> Path:
    """A ZIP whose bytes depend on the files alone: fixed times and modes, numeric order."""
    files = sorted(Path(folder).glob("*.json"), key=lambda p: int(p.stem))
    if [int(p.stem) for p in files] != list(range(1, expected + 1)):
        raise ValueError(f"expected files 1 to {expected}")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            if not isinstance(json.loads(p.read_text(encoding="utf-8")), list):
                raise ValueError(f"{p.name} holds no list")
            info = zipfile.ZipInfo(f"output/{p.name}", ZIP_TIME)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, p.read_bytes())
    return Path(target)


def unsafe_entries(target: str | Path) -> list[str]:
    """Entries of a ZIP that leave the folder or nest too deep."""
    with zipfile.ZipFile(target) as z:
        return [n for n in z.namelist() if n.startswith(("/", "\\")) or ".." in n.split("/") or ":" in n or not n.startswith("output/") or n.count("/") != 1]


def same_style(sample: str, entities: list) -> str:
    """JSON in the style of a sample: indented or compact."""
    if sample.lstrip().startswith("[\n"):
        return json.dumps(entities, ensure_ascii=False, indent=2) + "\n"
    return json.dumps(entities, ensure_ascii=False, separators=(",", ":")) + "\n"
