"""The block catalog: immutable ``name@version`` entries over content-addressed blobs.

The index is one JSON file, replaced as a whole under a lock; readers need no lock. Queries over
entries are DataFrames.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import re
import tempfile
from datetime import UTC, datetime

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.plans.blocks import check_sql, python_block, sql_block
from sluiceway.plans.types import TypeSyntaxError

VERSION = 1
NEAR, SUGGESTIONS = 2, 5
SCHEMA = "name_version string, name string, version string, hash string, kind string, signature string, created_at string"
_NAME = re.compile(r"[A-Za-z0-9._-]+@[A-Za-z0-9._-]+\Z")
_HASH = re.compile(r"[0-9a-f]{64}\Z")


class CatalogError(ValueError):
    """A catalog that can't be read, or a change that it refuses."""


def block_of(content: bytes, kind: str, name: str):
    """The block of a catalogued text."""
    return sql_block(content.decode()) if kind == "sql" else python_block(content.decode(), name)


class Catalog:
    def __init__(self, path: str):
        self.path = path
        os.makedirs(f"{path}/blobs", exist_ok=True)

    def index(self) -> dict:
        try:
            with open(f"{self.path}/index.json", encoding="utf-8") as f:
                index = json.load(f)
        except FileNotFoundError:
            return {"version": VERSION, "entries": {}, "retired": {}}
        except ValueError as e:
            raise CatalogError(f"{self.path}/index.json is corrupt: {e}") from None
        if not isinstance(index, dict) or index.get("version") != VERSION:
            raise CatalogError(f"{self.path}/index.json has version {index.get('version') if isinstance(index, dict) else None}, not {VERSION}")
        return index

    @contextlib.contextmanager
    def changing(self):
        """The index under the lock; it replaces the old one if the body ends well."""
        with open(f"{self.path}/lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            index = self.index()
            yield index
            self._replace(f"{self.path}/index.json", json.dumps(index, indent=1, sort_keys=True).encode())

    def _replace(self, path: str, content: bytes) -> None:
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)

    def add(self, name_version: str, content: bytes, kind: str = "sql", spark: SparkSession | None = None) -> dict:
        """Add a block, which must compile; a SQL body is analysed where a session is given or active."""
        if not _NAME.match(name_version):
            raise CatalogError(f"{name_version!r} is not name@version")
        try:
            block = block_of(content, kind, name_version)
            spark = spark or SparkSession.getActiveSession()
            if kind == "sql" and spark is not None:
                check_sql(spark, block)
        except (TypeSyntaxError, UnicodeDecodeError, AnalysisException, ParseException) as e:
            raise CatalogError(f"{name_version}: {str(e)[:300]}") from None
        signature = block.signature.describe()
        digest = hashlib.sha256(content).hexdigest()
        with self.changing() as index:
            if name_version in index["entries"]:
                raise CatalogError(f"{name_version} exists; versions don't change")
            gone = index["retired"].get(name_version)
            if gone is not None and gone != digest:
                raise CatalogError(f"{name_version} was removed and can only come back with the same content")
            blob = f"{self.path}/blobs/{digest}"
            if not os.path.exists(blob):
                self._replace(blob, content)
            now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            entry = {"hash": digest, "kind": kind, "signature": signature, "created_at": now}
            index["entries"][name_version] = entry
            index["retired"].pop(name_version, None)
        return entry

    def remove(self, name_version: str) -> None:
        with self.changing() as index:
            if name_version not in index["entries"]:
                raise CatalogError(f"no {name_version}")
            index["retired"][name_version] = index["entries"].pop(name_version)["hash"]

    def show(self, name_version: str) -> dict:
        entry = self.index()["entries"].get(name_version)
        if entry is None:
            raise CatalogError(f"no {name_version}")
        return entry

    def blob(self, entry: dict) -> bytes:
        if not _HASH.match(entry["hash"]):
            raise CatalogError("a blob's name is 64 lower-case hex digits")
        with open(f"{self.path}/blobs/{entry['hash']}", "rb") as f:
            return f.read()

    def block(self, name_version: str):
        entry = self.show(name_version)
        return block_of(self.blob(entry), entry["kind"], name_version)

    def entries(self, spark: SparkSession) -> DataFrame:
        """SCHEMA rows, ordered by key."""
        rows = [(k, *k.split("@"), e["hash"], e["kind"], e["signature"], e["created_at"]) for k, e in self.index()["entries"].items()]
        return spark.createDataFrame(rows, SCHEMA).orderBy("name_version")

    def resolve(self, name: str, durable: bool = False) -> str:
        """Exact for name@version; the newest version for a bare name, which durable use doesn't allow."""
        entries = self.index()["entries"]
        if "@" in name:
            if name in entries:
                return name
        elif durable:
            raise CatalogError(f"{name!r} needs a version here")
        else:
            found = sorted((e["created_at"], k) for k, e in entries.items() if k.partition("@")[0] == name)
            if found:
                return found[-1][1]
        hint = [k for _, k in suggest_rows(name, entries)]
        raise CatalogError(f"no {name!r} in the catalog" + (f"; did you mean {', '.join(hint)}?" if hint else ""))


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggest_rows(name: str, entries: dict[str, dict]) -> list[tuple[int, str]]:
    newest: dict[str, tuple[str, str]] = {}
    for key in sorted(entries):
        bare, at = key.partition("@")[0], entries[key]["created_at"]
        if bare not in newest or at > newest[bare][0]:
            newest[bare] = (at, key)
    wanted = name.partition("@")[0]
    near = [(d, at, key) for bare, (at, key) in newest.items() if (d := _distance(wanted, bare)) <= NEAR]
    return [(d, key) for d, _, key in sorted(near)[:SUGGESTIONS]]


def newest_versions(entries: DataFrame) -> DataFrame:
    """(name, name_version) of each name's newest version; of equal times the later key in order."""
    return entries.groupBy("name").agg(F.max_by("name_version", F.struct("created_at", "name_version")).alias("name_version"))


def did_you_mean(entries: DataFrame, name: str, near: int = NEAR, most: int = SUGGESTIONS) -> DataFrame:
    """(name_version, distance) of the nearest names' newest versions; of equal times the smaller key here."""
    first = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("created_at"), "name_version"))
    each = entries.withColumn("r", first).where("r = 1").withColumn("distance", F.levenshtein(F.col("name"), F.lit(name), near))
    return each.where("distance >= 0").orderBy("distance", "created_at", "name").limit(most).select("name_version", "distance")


def dedup_by_hash(blobs: DataFrame, content: str = "content") -> DataFrame:
    """(hash, n): equal contents once."""
    return blobs.groupBy(F.sha2(content, 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


def addable(wanted: DataFrame, retired: DataFrame) -> DataFrame:
    """Entries that may be added again: never removed, or removed with the same hash."""
    other = retired.select("name_version", F.col("hash").alias("old"))
    return wanted.join(other, (wanted["name_version"] == other["name_version"]) & (wanted["hash"] != other["old"]), "left_anti")
