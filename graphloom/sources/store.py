"""The model's tables as parts in a folder, changed by commits: what a reader has opened stays as it is.

A state names, for each table, the folders that hold its parts. A commit writes new folders for the parts it touches,
carries the others over, and puts the next state into the log; where another writer came first, it is worked out again on
the newer state. So a change is seen whole or not at all, a writer that is killed leaves nothing to be seen, and what is
rewritten is the parts that hold touched keys. Parts are ranges of ids, hashes of a column, or, for the tables of an
analysis, the repository. The driver holds a state, which grows with the parts and not with the rows.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjacency, index, lifecycle, mutations
from ..schemas import TABLES
from .commits import Log, Taken
from .staged import staged

#: Ids of a part, parts by hash, and how often a commit is worked out again before it gives up.
WIDTH, HASHED, TRIES = 1 << 16, 256, 50
#: Segments of a repository's search index from which they are merged.
SEGMENTS = 8
#: What an analysis replaces, by repository.
ANALYSIS = ("symbols", "call_edges", "source_files", "diagnostics")


def _by_id(width: int) -> str:
    return f"cast(id div {width} as string)"


def _by_repository() -> str:
    return f"cast(pmod(xxhash64(repository_id), {HASHED}) as string)"


class State:
    """What one entry of the log says; reading it never depends on later entries."""

    def __init__(self, spark: SparkSession, number: int, entry: dict) -> None:
        self.spark, self.number, self.entry = spark, number, entry

    def table(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """The rows of a table, or of some of its parts."""
        about = self.entry["tables"][name]
        folders = [f for p, f in sorted(about["parts"].items()) if parts is None or p in parts]
        return self.spark.read.schema(about["schema"]).parquet(*folders) if folders else self.spark.createDataFrame([], about["schema"])

    def of_repository(self, name: str, repository_id: str) -> DataFrame:
        """A table of the repository's analysis; empty before the first."""
        if name not in self.entry["tables"]:
            return self.spark.createDataFrame([], TABLES[name])
        return self.table(name, [repository_id])

    def top(self, name: str) -> int:
        """The largest id that was ever dealt."""
        return self.entry["tables"][name]["top"]

    def search(self, repository_id: str, query: str, limit: int | None = None) -> DataFrame:
        """As operators.search.search, out of the kept index: reads the buckets of the query's tokens alone."""
        n, length = self.entry["stats"].get(repository_id, (0, 0))
        segments = self.entry["index"].get(repository_id, [])
        return index.search(self.spark, segments, n, length, self.of_repository("symbols", repository_id), query, limit)

    def neighbourhood(self, repository_id: str, root: str, depth: int) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) as operators.graph.neighbourhood, out of the kept adjacency: a hop reads its frontier's buckets."""
        symbols = self.of_repository("symbols", repository_id)
        kept = self.entry.get("adjacency", {}).get(repository_id)
        if kept is None:
            edges = self.of_repository("call_edges", repository_id)
            return symbols.where(F.col("symbol_id") == root).withColumn("distance", F.lit(0)), edges.limit(0)
        return adjacency.neighbourhood(self.spark, kept, symbols, root, depth)


class Store:
    def __init__(self, spark: SparkSession, root: str, width: int = WIDTH) -> None:
        self.spark, self.root, self.width = spark, root.rstrip("/"), width
        self.log = Log(spark, f"{self.root}/_log")

    def state(self, number: int | None = None) -> State:
        number = self.log.last() if number is None else number
        return State(self.spark, number, self.log.read(number) if number else {"tables": {}, "index": {}, "stats": {}})

    def commit(self, change: Callable[[State, dict], None]) -> State:
        """change gets the present state and a copy of its entry to alter; what it raises leaves the log as it is."""
        for _ in range(TRIES):
            before = self.state()
            entry = copy.deepcopy(before.entry)
            change(before, entry)
            try:
                self.log.put(before.number + 1, entry)
            except Taken:
                continue
            return State(self.spark, before.number + 1, entry)
        raise Taken(f"{TRIES} other commits came first")

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}/{uuid.uuid4().hex}"

    def _written(self, name: str, rows: DataFrame, part: str) -> dict[str, str]:
        """Write rows, a folder for each part: {part: folder}. A part is one task's."""
        folder = self._folder(name)
        rows.withColumn("_part", F.expr(part)).repartition("_part").write.partitionBy("_part").parquet(folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = [s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names if n.startswith("_part=")}

    def create(self, name: str, rows: DataFrame, part: str | None = None) -> State:
        """A new table of rows that have an id."""
        part = _by_id(self.width) if part is None else part
        parts = self._written(name, rows, part)
        top = _largest(rows)

        def change(before: State, entry: dict) -> None:
            if name in entry["tables"]:
                raise ValueError(f"{name} is there")
            entry["tables"][name] = {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "part": part, "parts": parts, "top": top}

        return self.commit(change)

    def _merged(self, before: State, entry: dict, name: str, changes: DataFrame, gone: DataFrame | None = None) -> None:
        """Alter the entry: rows of `changes` replace those of their id or are new, ids in `gone` go.

        Only the parts that hold one of these are read and written."""
        about = entry["tables"][name]
        part = F.expr(about["part"])
        changes = staged(changes.select(*before.table(name).columns), name)
        keyed = changes.select(part.alias("p"), "id")
        if gone is not None:
            keyed = keyed.union(gone.select(part.alias("p"), "id"))
        keyed = staged(keyed, name)
        touched = [r.p for r in keyed.select("p").distinct().collect()]  # parts, not rows
        if not touched:
            return
        left = before.table(name, touched).join(keyed.select("id"), "id", "left_anti").select(*changes.columns)
        fresh = self._written(name, left.unionByName(changes), about["part"])
        about["parts"] = {p: f for p, f in about["parts"].items() if p not in touched} | fresh
        about["top"] = max(about["top"], _largest(changes))

    def merge(self, name: str, changed: Callable[[State], DataFrame], gone: Callable[[State], DataFrame] | None = None) -> State:
        """Commit rows worked out from the present state: whole rows, by id; gone: the rows that go."""
        return self.commit(lambda before, entry: self._merged(before, entry, name, changed(before), gone(before) if gone else None))

    # notes, collections and items

    def _symbols(self, state: State) -> DataFrame:
        return state.table("symbols") if "symbols" in state.entry["tables"] else self.spark.createDataFrame([], TABLES["symbols"])

    def create_notes(self, asked: DataFrame, now: Column | None = None) -> State:
        return self.merge("notes", lambda s: mutations.new_notes(s.table("notes"), self._symbols(s), asked, now, s.top("notes")))

    def update_notes(self, asked: DataFrame, now: Column | None = None) -> State:
        def changed(s: State) -> DataFrame:
            named = s.table("notes").join(asked.select("id").distinct(), "id", "left_semi")
            return mutations.update_notes(named, self._symbols(s), asked, now)

        return self.merge("notes", changed)

    def save_notes(self, asked: DataFrame, now: Column | None = None) -> State:
        return self.merge("notes", lambda s: mutations.saved_notes(s.table("notes"), self._symbols(s), asked, now, s.top("notes")))

    def create_collections(self, asked: DataFrame, now: Column | None = None) -> State:
        return self.merge("collections", lambda s: mutations.new_collections(s.table("collections"), s.table("repositories"), s.table("analysis_runs"), asked, now, s.top("collections")))

    def add_items(self, new: DataFrame, now: Column | None = None) -> State:
        """New items (see lifecycle.add_items), and their collections touched, in one commit."""

        def change(before: State, entry: dict) -> None:
            rows = staged(lifecycle.new_items(before.table("collection_items"), new, before.top("collection_items")), "items")
            self._merged(before, entry, "collection_items", rows)
            ids = rows.select(F.col("collection_id").alias("id")).distinct()
            named = before.table("collections").join(ids, "id", "left_semi")
            self._merged(before, entry, "collections", mutations.touch_collections(named, ids, now))

        return self.commit(change)

    def delete_collections(self, ids: DataFrame) -> State:
        """The collections and all their items, in one commit."""

        def change(before: State, entry: dict) -> None:
            own, items = before.table("collections"), before.table("collection_items")
            self._merged(before, entry, "collections", own.limit(0), own.join(ids.select("id"), "id", "left_semi"))
            cascade = items.join(ids.select(F.col("id").alias("collection_id")), "collection_id", "left_semi").select(*items.columns)
            self._merged(before, entry, "collection_items", items.limit(0), cascade)

        return self.commit(change)

    # analyses

    def publish(self, repository_id: str, revision: str, tables: dict[str, DataFrame]) -> State:
        """Replace a repository's analysis: `symbols`, and any of call_edges, source_files and diagnostics.

        One commit enters a running run. Another takes over the tables, the search index and the adjacency, re-links the repository's
        notes and items, and completes the run (partial if there are diagnostics). Between them readers see the old
        analysis; a publish that is killed leaves a running run and the old analysis."""

        def begin(before: State, entry: dict) -> None:
            row = self.spark.range(1).select((F.lit(before.top("analysis_runs")) + 1).cast("bigint").alias("id"), F.lit(repository_id).alias("repository_id"), F.lit(revision).alias("revision"), F.lit("running").alias("status"), F.current_timestamp().alias("started_at"))
            self._merged(before, entry, "analysis_runs", _filled(row, before.table("analysis_runs")))

        if "analysis_runs" not in self.state().entry["tables"]:
            self.create("analysis_runs", self.spark.createDataFrame([], TABLES["analysis_runs"]))
        run = self.commit(begin).top("analysis_runs")
        folders = {}
        for name, rows in tables.items():
            folders[name] = self._folder(name)
            rows.write.parquet(folders[name])
        schemas = {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) for name, rows in tables.items()}
        now = self.spark.read.schema(schemas["symbols"]).parquet(folders["symbols"])
        broken = "diagnostics" in tables and bool(self.spark.read.schema(schemas["diagnostics"]).parquet(folders["diagnostics"]).take(1))

        links = None
        if "call_edges" in tables:
            links = adjacency.write(self._folder("adjacency"), self.spark.read.schema(schemas["call_edges"]).parquet(folders["call_edges"]))

        def complete(before: State, entry: dict) -> None:
            old = before.of_repository("symbols", repository_id)
            for name in ANALYSIS:
                about = entry["tables"].setdefault(name, {"schema": schemas.get(name), "part": "", "parts": {}, "top": 0}) if name in tables else entry["tables"].get(name)
                if about is not None:
                    about["parts"].pop(repository_id, None)
                if name in tables:
                    about["parts"][repository_id] = folders[name]
            self._indexed(entry, repository_id, old, now)
            entry.setdefault("adjacency", {}).pop(repository_id, None)
            if links is not None:
                entry["adjacency"][repository_id] = links
            for name, relink in (("notes", lifecycle.relink_notes), ("collection_items", lifecycle.relink_items)):
                if name in entry["tables"]:
                    rows = before.table(name).where(F.col("repository_id") == repository_id)
                    self._merged(before, entry, name, _changed(rows, relink(rows, now)))
            row = before.table("analysis_runs").where(F.col("id") == run)
            done = {"status": F.lit("partial" if broken else "completed"), "completed_at": F.current_timestamp()}
            self._merged(before, entry, "analysis_runs", row.withColumns({c: v for c, v in done.items() if c in row.columns}))

        return self.commit(complete)

    def _indexed(self, entry: dict, repository_id: str, old: DataFrame, now: DataFrame) -> None:
        """Alter the entry: a segment of what the analysis changes, or all of it in one where segments are many."""
        segments = entry["index"].get(repository_id, [])
        whole = len(segments) + 1 >= SEGMENTS
        folder = self._folder("index")
        n, length = index.write_segment(folder, old.limit(0) if whole else old, now)
        known = (0, 0) if whole else entry["stats"].get(repository_id, (0, 0))
        entry["index"][repository_id] = [*([] if whole else segments), folder]
        entry["stats"][repository_id] = [known[0] + n, known[1] + length]

    # snapshots

    def save_snapshots(self, requests: DataFrame, version: int = 1) -> State:
        """Requests (repository_id, schema_version, app_version, database_format_version, state_json, place) become the
        current snapshots of their repositories, in order of place; the ones before are previous_valid, older ones go.

        Requests are staged as pending, validated, and promoted by one commit. Any that isn't valid, or whose repository
        isn't known, refuses all of them, and nothing changes."""
        pending = staged(requests, "pending")

        def change(before: State, entry: dict) -> None:
            known = before.table("repositories").select(F.col("id").alias("repository_id")).distinct()
            bad = pending.where(~lifecycle.valid_snapshot(version)).select("repository_id").union(pending.join(known, "repository_id", "left_anti").select("repository_id"))
            refused = bad.first()
            if refused is not None:
                raise ValueError(f"no valid snapshot of {refused.repository_id!r}")
            table = before.table("workspace_snapshots")
            new = mutations._placed(pending, before.top("workspace_snapshots"), ["place", "repository_id"]).withColumn("snapshot_id", F.col("id"))
            new = staged(_filled(new.withColumn("created_at", F.current_timestamp()), table), "snapshots")
            held = table.join(new.select("repository_id").distinct(), "repository_id", "left_semi").select(*table.columns)
            ranked = lifecycle.snapshot_statuses(held.unionByName(new)).select(*table.columns)
            self._merged(before, entry, "workspace_snapshots", ranked, held)

        if "workspace_snapshots" not in self.state().entry["tables"]:
            self.create("workspace_snapshots", self.spark.createDataFrame([], "id bigint, " + TABLES["workspace_snapshots"]), _by_repository())
        return self.commit(change)


def _largest(rows: DataFrame) -> int:
    """The largest id; 0 without rows, or where ids are no numbers."""
    if dict(rows.dtypes).get("id") != "bigint":
        return 0
    return rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def _filled(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows with the columns of another table; those it lacks are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` that differ from the one with their id in `old`."""
    digest = lambda rows, name: rows.select("id", F.xxhash64(*[x for c in old.columns for x in (F.col(c).isNull(), F.col(c))]).alias(name))
    same = digest(old, "a").join(digest(new, "b"), "id").where("a = b").select("id")
    return new.join(same, "id", "left_anti").select(*old.columns)
