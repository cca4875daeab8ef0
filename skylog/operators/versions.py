"""Tables by version and year: written aside, published together, read as one version.

A root folder holds ``data/<table>/v=<version>/year=<year>`` and one manifest a version, ``_versions/<version>.json``. A
manifest names, for every table and year, the folders that make it up, so it stays small: years times
a few folders. A writer puts new folders aside and then publishes them with one rename; until
then, and after any failure, readers see the version before. Folders that only superseded versions name are removed
when ``retain`` newer versions exist. One writer at a time is assumed; a second one is refused when it publishes.

Only years that a change touches are written. An append adds a folder to its years and takes in
those of the folders before that are not larger than twice the new one, so a year has logarithmically many folders however small
the appends are, and a row is rewritten logarithmically often.

With each folder goes a sketch of its keys: Bloom filters of ``BLOCK_KEYS`` keys each, as bitmaps. Whether keys are stored is asked
of the sketches of their own years first; key columns are read only of the folders whose sketch answers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BLOCK_KEYS = 2048  # keys of one filter, 16 bits a key
BLOCK_BITS = 32768  # bits of a bitmap
PROBES = 5
FEW_YEARS = 4  # years that are written without a shuffle of their rows: so many files a task at most
KEY = "dedup_key"
_KEY_YEAR = r"\|([0-9]{4})[0-9]{8}\|[^|]*\|[^|]*\z"


class VersionConflict(RuntimeError):
    """Another writer has published since this one began."""


def year_of_key(key: Column | str = KEY) -> Column:
    """The year partition of a key, 0 for a key without a time. The key alone decides, so equal keys share a year."""
    return F.coalesce(F.regexp_extract(key, _KEY_YEAR, 1).try_cast("int"), F.lit(0))


def _bit(key: Column | str, probe: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(BLOCK_BITS))


def _block(key: Column | str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


@dataclass
class Change:
    """Rows to publish in one table. With ``replace`` they take the place of the years in it, else they are appended.

    ``sizes`` has a row with ``dedup_key`` for each row or more, where counting ``rows`` itself would compute them twice.
    ``merge`` makes fewer rows of those that meet in one folder.
    """

    rows: DataFrame
    replace: Iterable[int] | None = None
    sizes: DataFrame | None = None
    merge: Callable[[DataFrame], DataFrame] | None = None


class Versions:
    """The versions of the tables under one root."""

    def __init__(self, spark: SparkSession, root: str, retain: int = 1):
        self.spark, self.root, self.retain = spark, root.rstrip("/"), retain

    # --- files ---

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def remove(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def _versions(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._names(f"{self.root}/_versions") if x.endswith(".json")]

    def _manifest(self, version: int) -> dict:
        fs, at = self._fs(f"{self.root}/_versions/{version:09d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict:
        """The newest manifest: version, meta, and by table its schema and the folders of each year."""
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else {"version": 0, "meta": {}, "tables": {}}

    # --- reading ---

    def read(self, name: str, years: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """A table with the columns ``v`` and ``year`` besides its own, None where there is none."""
        table = (manifest or self.current())["tables"].get(name)
        if table is None:
            return None
        wanted = None if years is None else set(years)
        folders = [
            f"{self.root}/data/{name}/v={p['v']}/year={year}"
            for year, parts in table["years"].items() if wanted is None or int(year) in wanted for p in parts
        ]
        schema = StructType.fromJson(table["schema"])
        schema.add("v", IntegerType()).add("year", IntegerType())
        if not folders:
            return self.spark.createDataFrame([], schema)
        # the columns are known, so no footer is read to plan
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{name}").parquet(*folders)

    def known(self, name: str, keys: DataFrame, years: Iterable[int] | None = None) -> DataFrame:
        """Which of ``keys`` (dedup_key) a table holds; ``years`` of the keys, where the caller knows them."""
        manifest = self.current()
        table = manifest["tables"].get(name, {"years": {}})
        wanted = keys.select(KEY).where(f"{KEY} IS NOT NULL").distinct().withColumn("year", year_of_key())
        if years is None:
            years = [r["year"] for r in wanted.select("year").distinct().collect()]
        years = sorted(set(years))
        parts = [(int(y), p["v"], -(-p["rows"] // BLOCK_KEYS)) for y in map(str, years) for p in table["years"].get(y, []) if p["rows"]]
        if not parts:
            return wanted.where("false").select(KEY)
        folders = self.spark.createDataFrame(parts, "year int, v int, blocks long")
        asked = wanted.join(F.broadcast(folders), "year").withColumn("block", _block(KEY, F.col("blocks")))
        sketch = self._sketch(name, manifest, parts).where(F.col("year").isin(years))
        hits = []
        for probe in range(PROBES):
            at = _bit(KEY, probe)
            byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            hits.append(F.getbit(byte, (at % 8).cast("int")) == 1)
        maybe = asked.join(sketch, ["year", "v", "block"]).where(reduce(and_, hits)).select(KEY, "year", "v")
        answering = maybe.select("year", "v").distinct().collect()  # at most the folders of the years
        if not answering:
            return wanted.where("false").select(KEY)
        pairs = {(r["year"], r["v"]) for r in answering}
        chosen = {"tables": {name: {**table, "years": {
            str(y): [p for p in table["years"].get(str(y), []) if (y, p["v"]) in pairs] for y in {y for y, _ in pairs}
        }}}}
        stored = self.read(name, None, chosen).where(F.col("year").isin(sorted({y for y, _ in pairs}))).select(KEY)
        return stored.join(maybe.select(KEY).distinct(), KEY, "left_semi").distinct()

    def _sketch(self, name: str, manifest: dict, parts: list[tuple]) -> DataFrame:
        base = f"{self.root}/data/{name}-keys"
        schema = "block long, bits binary, v int, year int"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/v={v}/year={y}" for y, v, _ in parts])

    # --- writing ---

    def publish(self, changes: dict[str, Change | None], base: dict | None = None, meta: dict[str, str] | None = None) -> int:
        """Writes the changes of all tables (None: the table goes) and makes them the next version, at once; returns its number."""
        base = base or self.current()
        version = base["version"] + 1
        tables = dict(base["tables"])
        for name, change in changes.items():
            if change is None:
                tables.pop(name, None)
            else:
                tables[name] = self._write(name, change, base, version)
        self._commit({"version": version, "meta": {**base["meta"], **(meta or {})}, "tables": tables})
        self._vacuum(version)
        return version

    def _write(self, name: str, change: Change, base: dict, version: int) -> dict:
        old = base["tables"].get(name, {"schema": StructType().jsonValue(), "years": {}})
        folder = f"{self.root}/data/{name}/v={version}"
        self.remove(folder)  # of a writer that failed
        self.remove(f"{self.root}/data/{name}-keys/v={version}")
        rows = change.rows.withColumn("year", year_of_key())
        sizes = rows if change.sizes is None else change.sizes.select(year_of_key().alias("year"))
        fresh = {r["year"]: r["n"] for r in sizes.groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}
        years = {y: list(parts) for y, parts in old["years"].items()}
        if change.replace is not None:
            for year in change.replace:
                years.pop(str(year), None)
        taken: dict[str, list[dict]] = {}
        for year, count in fresh.items():
            parts = years.setdefault(str(year), [])
            merged: list[dict] = []
            while parts and parts[-1]["rows"] <= 2 * count:
                merged.append(parts.pop())
                count += merged[-1]["rows"]
            parts.append({"v": version, "rows": count})
            if merged:
                taken[str(year)] = merged
        if taken:
            small = self.read(name, None, {"tables": {name: {**old, "years": taken}}}).drop("v")
            rows = rows.unionByName(small, allowMissingColumns=True)
            if change.merge is not None:
                # rows of one key share a year, so merging per key keeps the years
                rows = change.merge(rows.drop("year")).withColumn("year", year_of_key())
        schema = StructType.fromJson(old["schema"])
        for field in rows.drop("year").schema:
            if field.name not in schema.names:
                schema.add(field.name, field.dataType)
        if fresh:
            # even files: small years share tasks, a large one is split; a few years are written by the tasks that hold them
            dealt = rows if len(fresh) <= FEW_YEARS else rows.hint("rebalance", F.col("year"))
            dealt.write.partitionBy("year").parquet(folder)
            written = {y: p[-1]["rows"] for y, p in years.items() if p and p[-1]["v"] == version}
            self._ensure(folder, written)
            self._write_sketch(name, version, written)
        return {"schema": schema.jsonValue(), "years": {y: p for y, p in years.items() if p}}

    def _ensure(self, folder: str, years: Iterable[str]) -> None:
        """Named folders exist, also where no row was written."""
        for year in years:
            fs, at = self._fs(f"{folder}/year={year}")
            fs.mkdirs(at)

    def _write_sketch(self, name: str, version: int, rows: dict[str, int]) -> None:
        folder = f"{self.root}/data/{name}/v={version}"
        keys = self.spark.read.schema(f"{KEY} string, year int").parquet(folder)
        sizes = self.spark.createDataFrame([(int(y), -(-n // BLOCK_KEYS)) for y, n in rows.items()], "year int, blocks long")
        keys = keys.where(f"{KEY} IS NOT NULL").join(F.broadcast(sizes), "year")
        bits = keys.select("year", _block(KEY, F.col("blocks")).alias("block"), F.explode(F.array(*[_bit(KEY, i) for i in range(PROBES)])).alias("at"))
        maps = bits.groupBy("year", "block").agg(F.bitmap_construct_agg("at").alias("bits"))
        maps.write.partitionBy("year").parquet(f"{self.root}/data/{name}-keys/v={version}")
        self._ensure(f"{self.root}/data/{name}-keys/v={version}", rows)

    def _commit(self, manifest: dict) -> None:
        final = f"{self.root}/_versions/{manifest['version']:09d}.json"
        aside = f"{self.root}/_versions/.{uuid.uuid4().hex}"
        fs, at = self._fs(aside)
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        target = self._fs(final)[1]
        if fs.exists(target) or not fs.rename(at, target):
            fs.delete(at, False)
            raise VersionConflict(f"version {manifest['version']} of {self.root} exists")

    def _vacuum(self, version: int) -> None:
        versions = self._versions()
        kept = versions[-(self.retain + 1) :]
        live = {
            (name, f"v={p['v']}", f"year={year}")
            for k in kept for name, t in self._manifest(k)["tables"].items() for year, parts in t["years"].items() for p in parts
        }
        for k in versions[: -len(kept)]:
            self.remove(f"{self.root}/_versions/{k:09d}.json")
        for name in self._names(f"{self.root}/data"):
            owner = name.removesuffix("-keys")
            for v in self._names(f"{self.root}/data/{name}"):
                if not v.startswith("v=") or int(v[2:]) > version:
                    continue
                years = [y for y in self._names(f"{self.root}/data/{name}/{v}") if y.startswith("year=")]
                gone = [y for y in years if (owner, v, y) not in live]
                if len(gone) == len(years):
                    self.remove(f"{self.root}/data/{name}/{v}")
                else:
                    for y in gone:
                        self.remove(f"{self.root}/data/{name}/{v}/{y}")
