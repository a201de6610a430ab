"""Stored sun events with versions: a refresh computes only what no version has yet, and readers see one version or the next."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..sources.folders import Folder
from ..sources.spines import Window
from . import feeds, sun
from .refresh import differing

#: Number of the formulas that made an event; raise it when they change, and the next refresh computes all cells anew.
FORMULA = 1
#: A store has so many buckets, or more where its first version would have more than CELLS_A_BUCKET cells in each, of about 730 events a cell.
BUCKETS, CELLS_A_BUCKET = 64, 1500
CELL = ("place", "location_id", "year", "first", "last", "formula")
_EVENTS = "place STRING, location_id BIGINT, lat DOUBLE, lon DOUBLE, day DATE, kind_rank INT, kind STRING, event_ms BIGINT, made INT, year INT"
_CELLS = "place STRING, location_id BIGINT, lat DOUBLE, lon DOUBLE, year INT, first DATE, last DATE, formula INT, made INT, version INT"


def cells(places: DataFrame, window: Window, formula: int = FORMULA) -> DataFrame:
    """(place, location_id, lat, lon, year, first, last, formula): one row per place and calendar year of the window, with its days, both ends included.

    place is the text of the coordinates. Places without id or coordinates are left out, repeated rows stand once.
    """
    known = places.select("location_id", "lat", "lon").dropna().withColumn("place", sun.place_text())
    once = known.groupBy("place", "location_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    if window.days <= 0:
        once, years = once.limit(0), range(window.start.year, window.start.year + 1)
    else:
        years = range(window.start.year, (window.end.year if window.end.timetuple().tm_yday > 1 else window.end.year - 1) + 1)
    rows = once.withColumn("year", F.explode(F.array(*(F.lit(y) for y in years))))
    first, beyond = F.make_date("year", F.lit(1), F.lit(1)), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))
    return rows.select(
        "place", "location_id", "lat", "lon", "year",
        F.greatest(first, F.lit(window.start)).alias("first"),
        F.date_sub(F.least(beyond, F.lit(window.end)), 1).alias("last"),
        F.lit(formula).alias("formula"),
    )


class Store:
    """A folder with the sun events of many places.

    events/: rows by made (the version that computed them) and year, bucketed by place, only added to. cells/: for each version its cells, a place and
    year each, and what made them. live/: an empty file per finished version, whose creation is the swap; claims/ likewise numbers the attempts, so a
    writer that dies leaves nothing that is read and two writers never share a number. The one with the higher number is read.

    Buckets are by place, so whatever groups by place (feeds, collisions, identifiers, differences) needs no exchange, and a task has one bucket. The
    first refresh fixes their number: `buckets`, or more as CELLS_A_BUCKET tells. Later values are ignored. A store's first refresh runs alone.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, Folder(spark, path)
        self.buckets, self.tables = buckets, False
        name = hashlib.md5(self.folder.path.encode()).hexdigest()
        self.events, self.cell_table = f"sun_events_{name}", f"sun_cells_{name}"
        self._laid_out()

    def _laid_out(self) -> bool:
        """Whether the store has its tables, as it has from its first refresh on."""
        layout = [] if self.tables else self.folder.names("layout")
        if layout:
            self.buckets, self.tables = min(map(int, layout)), True
            self._make_tables()
        return self.tables

    def _lay_out(self, first: DataFrame) -> None:
        """Makes the tables, sized for the cells of the first version."""
        if not self._laid_out():
            self.folder.create(f"layout/{max(self.buckets, -(-first.count() // CELLS_A_BUCKET))}")
            self._laid_out()

    def _make_tables(self) -> None:
        for table, name, columns, parts, order in ((self.events, "events", _EVENTS, "made, year", "place, location_id, day, kind_rank"), (self.cell_table, "cells", _CELLS, "version", "place, location_id, year")):
            self.folder.make(name)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({parts}) CLUSTERED BY (place) SORTED BY ({order}) INTO {self.buckets} BUCKETS LOCATION '{self.folder.path}/{name}'")
            self.spark.catalog.recoverPartitions(table)

    # --- versions -------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The version that readers see; 0 before the first."""
        return max(map(int, self.folder.names("live")), default=0)

    def _claim(self) -> int:
        number = max(map(int, self.folder.names("claims")), default=0) + 1
        while not self.folder.create(f"claims/{number}"):
            number += 1
        return number

    def cells(self, version: int | None = None) -> DataFrame:
        """(place, location_id, lat, lon, year, first, last, formula, made) of a version, the present one if not given."""
        return self._cells_of([self.version() if version is None else version]).drop("version")

    def _cells_of(self, versions: list[int]) -> DataFrame:
        if not self._laid_out():
            return self.spark.createDataFrame([], _CELLS)
        self.spark.catalog.recoverPartitions(self.cell_table)
        return self.spark.table(self.cell_table).where(F.col("version").isin(versions))

    def refresh(self, places: DataFrame, window: Window, formula: int = FORMULA, rebuild: bool = False) -> int:
        """Makes the version that has these places and this window, and nothing else; returns its number, the present one if that is it already.

        Cells that the present version has are taken over by reference; only the others are computed, dealt by place before their days multiply, so
        events are not shuffled. Years and places that left are not in the new version; their rows stay stored until vacuum(). rebuild: computes
        all cells, so that one number has them all.
        """
        base, number = self.version(), self._claim()
        wanted = cells(places, window, formula)
        self._lay_out(wanted)
        known = self.cells(base)
        if rebuild:
            known = known.limit(0)
        joined = wanted.join(known.select(*CELL, F.col("made").alias("_made")), list(CELL), "left")
        told = joined.withColumns({"made": F.coalesce("_made", F.lit(number)), "version": F.lit(number)}).select(*(c.split()[0] for c in _CELLS.split(", ")))
        told.repartition(self.buckets, "place").write.insertInto(self.cell_table)
        mine = self.cells(number)
        fresh = mine.where(F.col("made") == number)
        sizes = mine.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("made") == number, 1)).alias("fresh")).first()
        if base and not sizes["fresh"] and sizes["n"] == self.cells(base).count():
            self._forget(self.cell_table, f"version={number}")
            return base
        if sizes["fresh"]:
            # Half a bucket a task. Dealt by the buckets' own number there would be no exchange, and then cells' small files are packed by cores.
            dealt = fresh.repartition(2 * self.buckets, "place")
            found = sun.own_sun_events(dealt, "first", "last", ("place", "year"))
            rows = found.withColumn("made", F.lit(number)).select(*(c.split()[0] for c in _EVENTS.split(", ")))
            rows.write.insertInto(self.events)
        self.folder.create(f"live/{number}")
        return number

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what only versions before the last `keep` read, and leftovers of attempts that failed; returns how many partitions. No refresh may run."""
        live = sorted(map(int, self.folder.names("live")))[-keep:] if keep else []
        needed = {(r["made"], r["year"]) for v in live for r in self.cells(v).select("made", "year").distinct().collect()}
        gone = 0
        for made in self.folder.names("events"):
            for year in self.folder.names(f"events/{made}") if made.startswith("made=") else ():
                if year.startswith("year=") and (int(made[5:]), int(year[5:])) not in needed:
                    self._forget(self.events, f"{made}/{year}")
                    gone += 1
        for version in map(int, self.folder.names("live")):
            if version not in live:
                self.folder.delete(f"live/{version}")
        kept = {*live, *(made for made, _ in needed)}  # the cells of what made rows tell whether all of them are still read
        for name in self.folder.names("cells"):
            if name.startswith("version=") and int(name[8:]) not in kept:
                self._forget(self.cell_table, name)
                gone += 1
        return gone

    def _forget(self, table: str, partition: str) -> None:
        spec = ", ".join(partition.split("/"))
        self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
        self.folder.delete(f"{'events' if table == self.events else 'cells'}/{partition}")

    # --- reading --------------------------------------------------------------------------------------------

    def _rows(self, versions: Iterable[int]) -> DataFrame:
        """Events of any of the versions, read once, with a boolean in<k> for each of them.

        Partitions whose cells a version has all, or none, need no look at cells. Where there are others, since a place moved or left, events meet the
        cells of their place within their bucket: no exchange.
        """
        versions = list(versions)
        if not self._laid_out():
            return self.spark.createDataFrame([], _EVENTS).withColumns({f"in{k}": F.lit(False) for k in range(len(versions))})
        self.spark.catalog.recoverPartitions(self.events)
        counts = lambda df: {(r["made"], r["year"]): r["count"] for r in df.groupBy("made", "year").count().collect()}  # noqa: E731  versions x years
        has = [counts(self.cells(v)) for v in versions]
        every = sorted(set().union(*has))
        made = sorted({m for m, _ in every})
        written = counts(self.spark.table(self.cell_table).where(F.col("version").isin(made) & (F.col("version") == F.col("made")))) if made else {}
        partial = [p for p in every if any(p in h and h[p] != written[p] for h in has)]
        whole = [p for p in every if p not in partial]
        rows = self.spark.table(self.events).where(_in(every))
        within = [_in([p for p in whole if p in h]) for h in has]
        if partial:
            cell = F.struct("location_id", "year", "made")
            of = lambda k, v: F.collect_set(F.when(F.col("version") == v, cell)).alias(f"cells{k}")
            live = self._cells_of(versions).where(_in(partial)).groupBy("place").agg(*(of(k, v) for k, v in enumerate(versions)))
            rows = rows.join(live.hint("shuffle_hash"), "place", "left")
            within = [F.when(_in(partial), F.coalesce(F.array_contains(f"cells{k}", cell), F.lit(False))).otherwise(at) for k, at in enumerate(within)]
        return rows.withColumns({f"in{k}": at for k, at in enumerate(within)}).drop(*(f"cells{k}" for k in range(len(versions))))

    def read(self, version: int | None = None) -> DataFrame:
        """(place, location_id, lat, lon, day, kind_rank, kind, event_ms) of a version, the present one if not given; it stays what it is meanwhile."""
        return self._rows([self.version() if version is None else version]).where("in0").drop("in0", "made", "year")

    def changed(self, old: int, new: int) -> DataFrame:
        """(place, action): insert, update or delete for every place whose cells differ; only cells are read, without an exchange."""
        rows = self._cells_of([old, new])
        of = lambda v: F.sort_array(F.collect_set(F.when(F.col("version") == v, F.struct("location_id", "year", "made"))))  # noqa: E731  a place's years
        told = rows.groupBy("place").agg(of(old).alias("a"), of(new).alias("b"))
        action = F.when(F.size("a") == 0, "insert").when(F.size("b") == 0, "delete").otherwise("update")
        return told.where(F.col("a") != F.col("b")).select("place", action.alias("action"))

    def write_changed_feeds(self, old: int, new: int, directory: str, style: feeds.Style = feeds.SUN, packed: bool = False) -> None:
        """Brings a folder of feed files from one version to another: files of places that changed are written, those of places that are gone deleted.

        Other files are not touched, and other places' events not read beyond the partitions that the changed ones lie in. packed: as in
        feeds.write_feed_files().
        """
        changed = self.changed(old, new)
        rows = self.read(new).join(changed.where("action <> 'delete'").select("place").hint("shuffle_hash"), "place", "left_semi")
        gone = changed.where("action = 'delete'").select(F.concat(F.lit("sunrise-"), F.replace("place", F.lit(","), F.lit("-")), F.lit(".ics")).alias("filename"))
        feeds.write_feed_files(feeds.sun_feed_years(rows, "place", style), directory, gone=gone, ordered=True, packed=packed)

    def diff(self, old: int, new: int, domain: str = labels.DOMAIN) -> DataFrame:
        """(uid, action, old_ms, new_ms): insert, update or delete for every identifier whose event differs; of several events of one the first, as one_per_uid().

        One pass over what either version has, grouped by what an identifier is made of within the buckets; text is made for what differs.
        """
        rows = self._rows([old, new]).withColumn("local_date", labels.local_date(F.col("event_ms"), labels.offset_hours(F.col("lon"))))
        first = lambda k: F.min(F.when(F.col(f"in{k}"), F.struct("day", "event_ms", "location_id")))["event_ms"]
        told = rows.groupBy("place", "kind", "local_date").agg(first(0).alias("old_ms"), first(1).alias("new_ms"))
        lat, lon = F.substring_index("place", ",", 1), F.substring_index("place", ",", -1)
        return differing(told).select(labels.sun_uid(F.col("kind"), F.col("local_date"), lat, lon, domain).alias("uid"), "action", "old_ms", "new_ms")


def _in(pairs: list[tuple[int, int]]) -> Column:
    """Whether (made, year) is one of the pairs; on partition columns, so files are left out before they are opened."""
    years: dict[int, list[int]] = {}
    for made, year in pairs:
        years.setdefault(made, []).append(year)
    out = F.lit(False)
    for made, of in years.items():
        out = out | ((F.col("made") == made) & F.col("year").isin(of))
    return out
