"""Strict CSV scans, CSV and JSON sinks, staged publication and receipts."""

from __future__ import annotations

import atexit
from collections.abc import Callable, Collection
import hashlib
import json
from pathlib import Path
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideclock.plans.policy import ReplayError

_CORRUPT = "corrupt_record"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared scratch space, or in a temporary one of a local session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ReplayError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tideclock-")
        atexit.register(shutil.rmtree, named, True)
    return f"{named.rstrip('/')}/tideclock/{name}-{uuid.uuid4().hex}"


def materialize(table: DataFrame, name: str) -> DataFrame:
    """The table written to the scratch space and read back, without its lineage."""
    folder = scratch_folder(table.sparkSession, name)
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | list[str], multiline: bool = True) -> DataFrame:
    """String rows of a CSV file or folder whose header must be the given columns, in any order.

    A blank cell is an empty string and a missing one breaks the contract, as
    do repeated columns and rows of another width. The header is the first line
    of the first file, which the driver reads through Spark; Spark holds every
    file to it. Cells may hold line breaks unless ``multiline`` is false, which
    lets large files be split among tasks.
    """
    head = spark.read.text(str(path)).limit(1).collect()
    names = [c.strip('"') for c in head[0][0].lstrip("﻿").split(",")] if head else []
    if sorted(names) != sorted(columns):
        raise ReplayError(f"{path}: the header is not the declared one: {names}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in names), T.StructField(_CORRUPT, T.StringType())])
    options = {"header": True, "enforceSchema": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "multiLine": multiline, "emptyValue": "", "nullValue": "\x00", "escape": '"'}
    rows = spark.read.schema(schema).options(**options).csv(str(path))
    # One more pass; Spark wants a real column read along with the corrupt one.
    if rows.agg(F.count(_CORRUPT), F.count(F.lit(1)), F.max(F.length(names[0]))).first()[0]:
        raise ReplayError(f"{path}: rows of another width than the header")
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def keyed(table: DataFrame, key: str = "case_id") -> DataFrame:
    """The table, if it has rows and its key is neither blank nor repeated."""
    bad = table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("keys"), F.count_if((F.col("n") > 1) | F.col(key).isNull() | (F.trim(F.col(key)) == "")).alias("bad")).first()
    if not bad["keys"] or bad["bad"]:
        raise ReplayError(f"empty table, or a blank or repeated {key}")
    return table


def write_csv(table: DataFrame, path: str, order: list[str]) -> None:
    """A CSV folder with a header, nulls blank, rows in order over its files."""
    flat = table.select(*(F.to_json(c).alias(c) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(c) for c, f in ((f.name, f) for f in table.schema.fields)))
    flat.orderBy(*order).write.mode("overwrite").options(header=True, emptyValue="", nullValue="", lineSep="\n").csv(str(path))


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def write_json(path: str | Path, value: object) -> None:
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n", encoding="utf-8")


def digest_of(value: object) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def fingerprint(table: DataFrame) -> DataFrame:
    """One row (rows, digest) that depends on the rows, their number included, and not on their order.

    Rows are digested, and the four 60-bit pieces of their digests are summed:
    sums commute, so that partial ones come from every task and nothing is
    shuffled but one row of each.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    pieces = [F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    sums = table.select(row.alias("d")).agg(F.count(F.lit(1)).alias("rows"), *pieces)
    return sums.select("rows", F.sha2(F.concat_ws(",", *(F.col(c).cast("string") for c in sums.columns)), 256).alias("digest"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


#: Names the version of a publication that counts.
POINTER = "CURRENT"
#: There while somebody publishes.
CLAIM = "PUBLISHING"
#: Versions that stay beside the one that counts, for those who are still reading them.
KEEP = 1


def current(destination: str | Path) -> Path:
    """The folder of the version that counts."""
    try:
        return Path(destination) / (Path(destination) / POINTER).read_text().strip()
    except OSError as error:
        raise ReplayError(f"{destination} is not a publication") from error


def publish(destination: str | Path, build: Callable[[Path], None]) -> Path:
    """Build a new version in the destination, then let its pointer name it; the version's folder.

    Versions lie beside each other and a pointer file tells the one that counts,
    so that readers see the old or the new one and a failure changes nothing. A
    claim file keeps other publishers away; who finds one of a process that died
    may delete it. Only a new or empty folder, or a former publication, is taken.
    """
    home = Path(destination)
    if home.is_symlink() or (home.exists() and not (home / POINTER).is_file() and (not home.is_dir() or any(home.iterdir()))):
        raise RuntimeError(f"{home} is not a publication, and neither new nor empty")
    home.mkdir(parents=True, exist_ok=True)
    try:
        (home / CLAIM).touch(exist_ok=False)
    except FileExistsError as error:
        raise RuntimeError(f"another publisher holds {home}") from error
    version = home / f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    try:
        build(version)
        pointer = home / f"{POINTER}.{version.name}"
        pointer.write_text(version.name)
        pointer.replace(home / POINTER)
        for old in sorted(p for p in home.glob("v-*") if p != version)[: -KEEP or None]:
            shutil.rmtree(old, ignore_errors=True)
    except BaseException:
        shutil.rmtree(version, ignore_errors=True)
        raise
    finally:
        (home / CLAIM).unlink()
    return version


#: What a receipt must claim, and no more.
CLAIMS = {"establishes_legal_breach": False, "establishes_wrongdoing": False, "synthetic_only": True}
RECEIPT = "receipt.json"


def _digest(path: Path) -> str:
    with path.open("rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def file_digests(folder: Path) -> dict[str, str]:
    """Digests of the files of a publication, without Spark's markers and the receipt."""
    found = (p for p in sorted(folder.rglob("*")) if p.is_file() and p.name != RECEIPT and not p.name.startswith((".", "_")))
    return {p.relative_to(folder).as_posix(): _digest(p) for p in found}


def software() -> dict[str, str]:
    """Digests of the modules that make a publication."""
    home = Path(__file__).resolve().parents[1]
    return {p.relative_to(home).as_posix(): _digest(p) for part in ("functions", "operators", "plans", "sources") for p in sorted((home / part).glob("*.py"))}


def seal(folder: Path, inventory: Collection[str], facts: dict) -> None:
    """Write the receipt of a folder that has just the files and tables of ``inventory``."""
    _check_inventory(folder, inventory)
    write_json(folder / RECEIPT, {"artifacts": file_digests(folder), "inventory": sorted(inventory), "software": software(), "claims": CLAIMS, **facts})


def _check_inventory(folder: Path, inventory: Collection[str]) -> None:
    there = {p.name for p in folder.iterdir()} - {RECEIPT}
    if there != set(inventory):
        raise ReplayError(f"the inventory is not the declared one: {sorted(there ^ set(inventory))}")


def check_receipt(folder: Path, inventory: Collection[str]) -> dict:
    """The receipt of a publication whose files are those that were sealed, by the software that is running."""
    try:
        receipt = json.loads((folder / RECEIPT).read_text())
    except (OSError, ValueError) as error:
        raise ReplayError(f"{folder} has no readable receipt") from error
    _check_inventory(folder, inventory)
    expected = {"claims": CLAIMS, "inventory": sorted(inventory), "software": software(), "artifacts": file_digests(folder)}
    for part, value in expected.items():
        if receipt.get(part) != value:
            raise ReplayError(f"the receipt's {part} are not those found")
    return receipt
