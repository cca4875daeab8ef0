"""Contact and path tables: duplicate-free merge, typed check, deletes, schema evolution.

A stored contact is keyed by ``dedup_key``. Both tables are partitioned by the year of the key and published
together as one version (:mod:`.versions`), so an insert or a rewrite is seen as a whole or not at all. One writer per table is
assumed, and every step can be repeated after a failure: keys that are already stored are left out again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import fields, geo
from ..schema import ENDS, KEPT_PATH_COLUMNS, PATH_COLUMNS, SCHEMA_VERSION, STORED_COLUMNS, ddl
from ..session import scratch_dir
from . import figures
from .paths import contact_paths, drawn
from .versions import Change, VersionConflict, Versions, year_of_key

TABLES = {"qso": STORED_COLUMNS, "qso_path": PATH_COLUMNS}
STEP_CODEC = "zstd"  # of stored steps, which are read once or twice and then go


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in ingest order.

    An aggregate rather than a ranking window: copies of a hot key collapse inside each map
    task, so no task ever receives more than one row per key and map task.
    """
    others = [c for c in rows.columns if c != key]
    best = F.min_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(key).agg(best.alias("_r")).select(key, "_r.*").select(*rows.columns)


def union_logs(*logs: DataFrame) -> DataFrame:
    merged = logs[0]
    for log in logs[1:]:
        merged = merged.unionByName(log, allowMissingColumns=True)
    return merged


def new_only(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select("dedup_key"), "dedup_key", "left_anti").select(*rows.columns)


def known_keys(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """Which of the requested keys are stored."""
    wanted = keys.select("dedup_key").where("dedup_key IS NOT NULL").distinct()
    return wanted.join(stored.select("dedup_key"), "dedup_key", "left_semi")


def without_orphans(paths: DataFrame, contacts: DataFrame, keep_unlinked: bool = False) -> DataFrame:
    """Paths whose contact exists; hand-drawn lines (NULL key) stay on a migration only."""
    linked = paths.join(contacts.select("dedup_key"), "dedup_key", "left_semi").select(*paths.columns)
    return linked.unionByName(paths.where("dedup_key IS NULL")) if keep_unlinked else linked


def delete_contacts(
    contacts: DataFrame, paths: DataFrame, keys: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given keys (paths follow their contact)."""
    gone = keys.select("dedup_key").where("dedup_key IS NOT NULL").distinct()
    return tuple(
        t.join(gone, "dedup_key", "left_anti").select(*t.columns) for t in (contacts, paths)
    )


def duplicate_report(rows: DataFrame) -> DataFrame:
    """Keys that occur more than once."""
    counted = rows.where("dedup_key IS NOT NULL").groupBy("dedup_key").agg(F.count("*").alias("n"))
    return counted.where("n > 1")


# --- typed check ---------------------------------------------------------------------------------


def _typed(name: str, kind: str, have: str) -> tuple[Column, Column]:
    """(typed value, whether the stored value is bad) of one column."""
    value = F.col(name)
    if have != "string" or kind == "string":
        if kind == "double":
            return geo.clean_real(value.cast("double")), F.lit(False)
        if kind == "int" and have in ("double", "float"):
            whole = (value == F.floor(value)) & value.between(-(2.0**31), 2.0**31 - 1)
            return F.when(whole, value.cast("int")), value.isNotNull() & ~F.coalesce(whole, F.lit(False))
        if kind == "int" and have == "bigint":
            fits = value.between(-(2**31), 2**31 - 1)
            return value.try_cast("int"), ~fits
        return value.cast(kind), F.lit(False)
    if kind == "int":
        typed = fields.coerce_int32(name)
        return typed, value.isNotNull() & typed.isNull()
    if kind == "double":
        number = value.try_cast("double")
        return geo.clean_real(number), value.isNotNull() & number.isNull()
    typed = fields.parse_iso(name)
    return typed, value.isNotNull() & typed.isNull()


def coerce(rows: DataFrame, columns: dict[str, str] = STORED_COLUMNS) -> DataFrame:
    """Columns in their stored type plus ``reject_reason`` (first bad column), NULL when clean.

    A row without ``dedup_key`` is rejected too. Split with :func:`valid` and :func:`rejected`.
    """
    types = dict(rows.dtypes)
    checks, typed = [], []
    for name, kind in columns.items():
        if name not in types:
            typed.append(F.lit(None).cast(kind).alias(name))
            continue
        value, bad = _typed(name, kind, types[name])
        typed.append(value.alias(name))
        checks.append(F.when(bad, F.lit(name)))
    if "dedup_key" in types:
        checks.append(F.when(F.col("dedup_key").isNull(), F.lit("dedup_key")))
    passing = [c for c in rows.columns if c not in columns]
    return rows.select(*passing, *typed, F.coalesce(*checks).alias("reject_reason"))


def valid(coerced: DataFrame) -> DataFrame:
    return coerced.where("reject_reason IS NULL").drop("reject_reason")


def rejected(coerced: DataFrame) -> DataFrame:
    return coerced.where("reject_reason IS NOT NULL")


# --- tables --------------------------------------------------------------------------------------


@dataclass
class LogTable:
    """A folder with the ``qso`` and ``qso_path`` tables and the ``meta`` values, in versions.

    Plain Parquet folders ``qso``, ``qso_path`` and ``meta`` of an earlier layout are read while there is no
    version yet; the first change takes them over. ``retain`` versions stay behind the newest for running readers.
    """

    spark: SparkSession
    root: str
    retain: int = 1

    @property
    def versions(self) -> Versions:
        return Versions(self.spark, self.root, self.retain)

    def _plain(self, name: str) -> DataFrame | None:
        """A folder of the earlier layout, None where there is none; other errors stay errors."""
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root.rstrip('/')}/{name}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _stored(self, name: str, years: Iterable[int] | None = None) -> DataFrame | None:
        """A table with all its columns, of some years only if given."""
        manifest = self.versions.current()
        if manifest["version"]:
            stored = self.versions.read(name, years, manifest)
            if stored is not None and years is not None:
                stored = stored.where(F.col("year").isin(list(years)))
            return None if stored is None else stored.drop("v", "year")
        stored = self._plain(name)
        if stored is None:
            return None
        stored = stored.drop("year")
        return stored if years is None else stored.where(year_of_key().isin(list(years)))

    def _read(self, name: str, columns: dict[str, str], years: Iterable[int] | None = None) -> DataFrame:
        stored = self._stored(name, years)
        return self.spark.createDataFrame([], ddl(columns)) if stored is None else project(stored, columns)

    def _whole(self, name: str, columns: dict[str, str], years: Iterable[int] | None = None) -> DataFrame:
        stored = self._stored(name, years)
        if stored is None:
            return self._read(name, columns)
        return project(stored, columns, [c for c in stored.columns if c.lower() not in columns])

    def contacts(self, years: Iterable[int] | None = None) -> DataFrame:
        return self._read("qso", STORED_COLUMNS, years)

    def paths(self, years: Iterable[int] | None = None) -> DataFrame:
        return drawn(self._read("qso_path", KEPT_PATH_COLUMNS, years))

    def all_contacts(self, years: Iterable[int] | None = None) -> DataFrame:
        """Contacts with the columns that others added."""
        return self._whole("qso", STORED_COLUMNS, years)

    def all_paths(self, years: Iterable[int] | None = None) -> DataFrame:
        """Paths with the columns that others added."""
        return drawn(self.kept_paths(years))

    def kept_paths(self, years: Iterable[int] | None = None) -> DataFrame:
        """Paths as they are stored, with the columns that others added."""
        return self._whole("qso_path", KEPT_PATH_COLUMNS, years)

    def known(self, name: str, keys: DataFrame) -> DataFrame:
        """Which of the keys are stored, by the sketches of their years."""
        if self.versions.current()["version"]:
            return self.versions.known(name, keys)
        stored = self._plain(name)
        wanted = keys.select("dedup_key").where("dedup_key IS NOT NULL").distinct()
        return wanted.where("false") if stored is None else wanted.join(stored, "dedup_key", "left_semi")

    def meta(self) -> dict[str, str]:
        manifest = self.versions.current()
        if manifest["version"]:
            return manifest["meta"]
        stored = self._plain("meta")
        return {} if stored is None else {r["key"]: r["value"] for r in stored.collect()}

    def set_meta(self, **values: str) -> None:
        self.publish({}, values)

    def version(self) -> int:
        return self.versions.current()["version"]

    def publish(
        self, changes: dict[str, Change], meta: dict[str, str] | None = None, whole: bool = False, seen: int | None = None
    ) -> None:
        """Makes the changes a version; ``whole`` if they replace everything that was stored.

        ``seen`` is the version that the changes were worked out from: if another writer has published since, they are refused.
        """
        versions = self.versions
        base = versions.current()
        if seen is not None and base["version"] != seen:
            raise VersionConflict(f"version {base['version']} was published while a change of version {seen} was made")
        if not base["version"]:
            base = {**base, "meta": self.meta()}
            if not whole:
                old = {n: self._whole(n, k) for n, k in TABLES.items() if self._plain(n) is not None}
                if old:
                    versions.publish({n: Change(rows) for n, rows in old.items()}, base)
                    base = versions.current()
        kept = "figures" in base["tables"]
        if kept and "qso" in changes and changes["qso"].replace is not None:
            changes = {**changes, "figures": None}  # rows were taken back: the figures are counted anew
        elif kept and "qso" in changes:
            changes = {**changes, "figures": Change(figures.of_contacts(changes["qso"].rows), merge=figures.collapse)}
        versions.publish(changes, base, meta)
        if kept and changes.get("figures", 0) is None:
            self.keep_figures()

    def keep_figures(self) -> None:
        """From now on the table's statistics are kept; counts what is stored once."""
        if not self.versions.current()["version"]:
            self.publish({})
        self.versions.publish({"figures": Change(figures.of_contacts(self.contacts()))})

    def figures(self) -> DataFrame:
        """The kept statistics, else those of a pass over the contacts."""
        kept = self.versions.read("figures")
        return figures.of_contacts(self.contacts()) if kept is None else kept.drop("v", "year")

    def append(self, contacts: DataFrame, paths: DataFrame, meta: dict[str, str] | None = None, seen: int | None = None) -> None:
        """Both as one version. ``contacts`` should be stored rows, as they are read more than once."""
        self.publish({
            "qso": Change(contacts.select(*STORED_COLUMNS)),
            "qso_path": Change(paths.select(*[c for c in KEPT_PATH_COLUMNS if c in paths.columns]), sizes=contacts),
        }, meta, seen=seen)

    def replace(self, contacts: DataFrame, paths: DataFrame) -> None:
        """Both tables anew, as one version.

        Columns that others added stay: those missing in ``contacts`` or ``paths`` are taken from the stored rows.
        """
        staged = {}
        for name, frame in (("qso", contacts), ("qso_path", paths)):
            path = scratch_dir(self.spark, f"replace-{name}")
            self._with_foreign(name, frame, TABLES[name]).write.parquet(path)
            staged[name] = self.spark.read.parquet(path)
        tables = self.versions.current()["tables"]
        self.publish({n: Change(rows, tables.get(n, {"years": {}})["years"]) for n, rows in staged.items()}, whole=True)
        removed(self, *staged.values())

    def _with_foreign(self, name: str, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        rows = rows.select(*columns, *[c for c in rows.columns if c.lower() not in columns and c != "year"])
        stored = self._stored(name)
        have = [] if stored is None else stored.columns
        missing = [c for c in have if c.lower() not in columns and c not in rows.columns and c != ENDS]
        if not missing:
            return rows
        kept = stored.select("dedup_key", *missing).dropDuplicates(["dedup_key"])
        return rows.join(kept, "dedup_key", "left")

def project(stored: DataFrame, columns: dict[str, str], foreign: list[str] = ()) -> DataFrame:
    """Column projection with missing columns as NULL; of others only ``foreign`` are read."""
    have = {c.lower(): c for c in stored.columns}
    return stored.select(
        *[
            (F.col(have[n]).cast(k) if n in have else F.lit(None).cast(k)).alias(n)
            for n, k in columns.items()
        ],
        *foreign,
    )


def evolve(stored: DataFrame, columns: dict[str, str] = STORED_COLUMNS) -> DataFrame:
    """Missing columns added as NULL, foreign columns kept."""
    have = {c.lower() for c in stored.columns}
    missing = [F.lit(None).cast(k).alias(n) for n, k in columns.items() if n not in have]
    return stored.select("*", *missing)


def ensure_schema(table: LogTable) -> list[str]:
    """Creates the version row and migrates an older table; returns what was noticed.

    From version 1 to 2 paths of deleted contacts are removed; unlinked lines stay.
    """
    text = (table.meta().get("schema_version") or "0").strip()
    found = int(text) if text.isdigit() else 0
    if found > SCHEMA_VERSION:
        return [f"written by a newer version (schema {found})"]
    if found < SCHEMA_VERSION:
        contacts, paths = table.contacts(), table.paths()
        if not paths.isEmpty():
            table.replace(contacts, without_orphans(paths, contacts, keep_unlinked=True))
        table.set_meta(schema_version=str(SCHEMA_VERSION))
        return [f"migrated from schema {found}"]
    return []


def _outcomes(rows: DataFrame, stored: DataFrame, *order: str) -> DataFrame:
    """One row per key: the first good row (NULL when the key is stored) and its counters."""
    if "skip_reason" not in rows.columns:
        rows = rows.withColumn("skip_reason", F.lit(None).cast("string"))
    checked = coerce(rows)
    skipped, failed = F.col("skip_reason").isNotNull(), F.col("reject_reason").isNotNull()
    good = ~skipped & ~failed
    others = [c for c in STORED_COLUMNS if c != "dedup_key"]
    grouped = checked.groupBy("dedup_key").agg(
        F.min_by(F.struct(*others), F.when(good, F.struct(*order))).alias("row"),
        F.count_if(good).alias("good"),
        F.count_if(~skipped & failed).alias("failed"),
        F.count_if(skipped).alias("skipped"),
    )
    known = stored.select("dedup_key", F.lit(True).alias("known"))
    joined = grouped.join(known, "dedup_key", "left")
    return joined.select(
        "dedup_key", F.when(F.col("known").isNull(), F.col("row")).alias("row"),
        "good", "failed", "skipped",
    )


def stage_batch(table: LogTable, rows: DataFrame, *keep: str) -> DataFrame:
    """The normalised rows as a stored table, so that parsing and lookups never run twice, whatever is lost later."""
    path = scratch_dir(table.spark, "batch")
    kept = [c for c in (*STORED_COLUMNS, "skip_reason") if c in rows.columns]
    rows.select(*kept, *[c for c in keep if c not in kept]).write.parquet(path, compression=STEP_CODEC)
    return table.spark.read.parquet(path)


def insert_contacts(table: LogTable, rows: DataFrame, *order: str) -> DataFrame:
    """Insert-only merge of normalised rows; returns one row of counters. See :func:`merge_batch`."""
    return merge_batch(table, stage_batch(table, rows, *order), *order, spent=True)


def removed(table: LogTable, *staged: DataFrame) -> None:
    """Takes stored steps away that nothing reads any more, and the shuffle files of the jobs that wrote them."""
    for folder in {path.rsplit("/", 1)[0] for step in staged for path in step.inputFiles()}:
        table.versions.remove(folder)
    table.spark._jvm.System.gc()  # shuffle files of finished jobs go when the driver forgets them


def merge_batch(
    table: LogTable, batch: DataFrame, *order: str, meta: dict[str, str] | None = None, spent: bool = False
) -> DataFrame:
    """Insert-only merge of a stored batch; returns one row of counters.

    The batch shuffles once by key; first-wins and the counters come from the same aggregate, and the join with the stored
    keys reuses that partitioning. Stored keys are asked of the sketches of the batch's own years; key columns are read only
    where a sketch answers. Paths are computed for new contacts only, and both tables are published as one version, with
    ``meta``. Rows with a ``skip_reason`` or a value that does not fit its column are counted, not fatal.
    A ``spent`` batch is taken away once its outcome is stored, before the tables are written.
    """
    staging, seen = scratch_dir(table.spark, "insert"), table.version()
    _outcomes(batch, table.known("qso", batch), *order).write.parquet(staging, compression=STEP_CODEC)
    outcome = table.spark.read.parquet(staging)
    if spent:
        removed(table, batch)
    staged = outcome.where("row IS NOT NULL").select("dedup_key", "row.*")
    if not staged.isEmpty():
        lined = table.known("qso_path", staged)
        table.append(staged, contact_paths(staged.join(lined, "dedup_key", "left_anti")), meta, seen)
    elif meta:
        table.set_meta(**meta)
    counters = outcome.agg(
        F.count("row").alias("inserted"),
        F.coalesce(F.sum("good") - F.count("row"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
    )
    told = table.spark.createDataFrame([counters.first()], counters.schema)
    removed(table, outcome)
    return told


def merged_contacts(rows: DataFrame, stored: DataFrame, *order: str) -> DataFrame:
    """What the table holds after the insert: stored contacts and the new ones."""
    fresh = _outcomes(rows, stored, *order).where("row IS NOT NULL").select("dedup_key", "row.*")
    return stored.select(*STORED_COLUMNS).unionByName(fresh.select(*STORED_COLUMNS))
