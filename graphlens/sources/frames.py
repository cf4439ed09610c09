"""Timelines of frames as tables in a folder: full versions of a keyed table, changes between them, gaps and errors.

Frames (timeline_id, graph_id, ts, frame_type, base_timeline, base_id, expires_at, errors) and their rows (timeline_id, graph_id, op, key..., value)
stand in Parquet folders, one for each write and timeline. What is there is said by commits: small numbered files that name the folders of each
timeline. A commit is made by one create that fails if its number is taken, and readers follow the greatest number, so that a write is seen whole or not at all: a
writer that dies leaves folders that nobody names, and of two writers one finds its number taken and starts anew from what the other left (and fails if
its frame is there by then). Folders that are no longer named stay for readers until ``clean``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators import versions
from graphlens.operators.fixpoint import saved

FRAME = "timeline_id string, graph_id long, ts timestamp_ntz, frame_type string, base_timeline string, base_id long, expires_at timestamp_ntz, errors array<string>"
#: How often a write starts anew when others commit before it, and the seconds after which a commit that was begun and not ended is given up.
TRIES, PATIENCE = 20, 5.0

Names = dict[str, dict[str, list[str]]]


class FrameStore:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], value: str, row: str):
        """``row`` is the schema of keys and value."""
        self.spark, self.folder, self.keys, self.value = spark, folder.rstrip("/"), keys, value
        self.data_schema = f"timeline_id string, graph_id long, op string, {row}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def latest_commit(self) -> tuple[int, Names]:
        """The greatest number and the folders that it names. One that was begun and is not ended is waited for, then taken away."""
        start = time.monotonic()
        while True:
            numbers = sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._path(f"{self.folder}/commits")) if f.getPath().getName().isdigit())
            if not numbers:
                return 0, {"frames": {}, "data": {}, "timelines": {}}
            path = self._path(f"{self.folder}/commits/{numbers[-1]:012d}")
            try:
                return numbers[-1], json.loads(self._text(path))["folders"]
            except ValueError:
                if time.monotonic() - start > PATIENCE:
                    self._fs.delete(path, False)
                time.sleep(0.05)

    def _publish(self, number: int, folders: Names) -> bool:
        """Whether the commit of that number is this one."""
        path, text = self._path(f"{self.folder}/commits/{number:012d}"), json.dumps({"by": uuid.uuid4().hex, "folders": folders})
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            return False
        out.write(text.encode())
        out.close()
        return self._fs.exists(path) and self._text(path) == text

    def _change(self, make: Callable[[Names], Names | None]) -> None:
        """Commit what ``make`` makes of the folders that are named now; it is called again if another commit comes first. None: nothing is to be done."""
        for _ in range(TRIES):
            number, now = self.latest_commit()
            after = make({name: {t: list(f) for t, f in of.items()} for name, of in now.items()})
            if after is None or self._publish(number + 1, after):
                return
        raise RuntimeError("other writers kept coming first")

    def _write(self, name: str, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows into a folder of their own for each timeline; they are seen once a commit names them."""
        at = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows.withColumn("_of", F.hex(F.col("timeline_id").cast("binary"))).write.partitionBy("_of").parquet(at)
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(at)) if f.isDirectory()]
        return {bytes.fromhex(d.removeprefix("_of=")).decode(): [f"{at}/{d}"] for d in found}

    def _read(self, name: str, schema: str, folders: Names | None = None, timeline: str | None = None) -> DataFrame:
        of = (self.latest_commit()[1] if folders is None else folders)[name]
        paths = [p for t, each in of.items() if timeline is None or t == timeline for p in each]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def frames(self) -> DataFrame:
        return self._read("frames", FRAME)

    @property
    def data(self) -> DataFrame:
        return self._read("data", self.data_schema)

    def _both(self, folders: Names, timeline: str) -> tuple[DataFrame, DataFrame]:
        return self._read("frames", FRAME, folders, timeline), self._read("data", self.data_schema, folders, timeline)

    def check(self, new: DataFrame, folders: Names | None = None) -> None:
        """Raise unless ids rise, times do not fall, and each base that is named is a version that is there or comes along."""
        if "base_id" in new.columns:
            every = self._read("frames", FRAME, folders).select("timeline_id", "graph_id", "frame_type").unionByName(new.select("timeline_id", "graph_id", "frame_type")).where("frame_type IN ('full', 'delta')")
            named = new.where("base_id IS NOT NULL").select(F.coalesce("base_timeline", "timeline_id").alias("timeline_id"), F.col("base_id").alias("graph_id"))
            lost = named.join(every, ["timeline_id", "graph_id"], "left_anti").first()
            if lost:
                raise ValueError(f"the base {lost['graph_id']} of {lost['timeline_id']} is no version")
        bad = versions.append_violations(self._read("frames", FRAME, folders).select("timeline_id", "graph_id", "ts"), new.select("timeline_id", "graph_id", "ts")).limit(1).collect()
        if bad:
            raise ValueError(f"frame {bad[0]['graph_id']} of {bad[0]['timeline_id']} does not come after what is there")

    def add(self, frames: DataFrame, data: DataFrame | None = None, checked: bool = True) -> None:
        """Add frames (columns of FRAME; missing ones are null) with their data (timeline_id, graph_id, op, keys, value): op is ``full`` for rows of a full frame, else add, remove or change."""
        kinds = self.spark.createDataFrame([], FRAME).schema
        frames = saved(frames.select(*[(F.col(f.name) if f.name in frames.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]))
        if checked:
            self.check(frames)
        new = {"data": self._write("data", data.select("timeline_id", "graph_id", "op", *self.keys, self.value)) if data is not None else {}, "frames": self._write("frames", frames)}

        def make(folders: Names) -> Names:
            if checked:
                self.check(frames, folders)
            for name, of in new.items():
                for timeline, paths in of.items():
                    folders[name].setdefault(timeline, []).extend(paths)
            return folders

        self._change(make)

    def store(self, timeline: str, graph_id: int, ts: str, rows: DataFrame, base_id: int | None = None) -> None:
        """Add a version: in full, or as its changes against ``base_id`` of the same timeline."""
        of = rows.select(*self.keys, self.value)
        data = of.withColumn("op", F.lit("full")) if base_id is None else versions.derive(self.fetch(timeline, base_id), of, self.keys, self.value)
        head = [F.lit(timeline).alias("timeline_id"), F.lit(graph_id).cast("long").alias("graph_id")]
        frame = self.spark.range(1).select(*head, F.lit(ts).cast("timestamp_ntz").alias("ts"), F.lit("full" if base_id is None else "delta").alias("frame_type"), F.lit(base_id).cast("long").alias("base_id"))
        self.add(frame, data.select(*head, "op", *self.keys, self.value))

    def store_error(self, timeline: str, graph_id: int, ts: str, errors: list[str]) -> None:
        frame = self.spark.createDataFrame([(timeline, graph_id, "error", errors)], "timeline_id string, graph_id long, frame_type string, errors array<string>")
        self.add(frame.withColumn("ts", F.lit(ts).cast("timestamp_ntz")))

    def errors(self, timeline: str, graph_id: int) -> list[str]:
        row = self.frames.where((F.col("timeline_id") == timeline) & (F.col("graph_id") == graph_id)).select("errors").first()
        return list(row["errors"] or []) if row else []

    def chain(self, timeline: str, graph_id: int) -> list[tuple[str, int]]:
        """The frames from the full one on that make a version: along bases where they are named (which may lie in other timelines), else back through adjacent changes.

        Only names of frames pass the driver, as many as the chain has.
        """
        out: list[tuple[str, int]] = []
        at: tuple[str, int] | None = (timeline, graph_id)
        while at is not None:
            of = self.frames.where((F.col("timeline_id") == at[0]) & (F.col("graph_id") <= at[1])).orderBy(F.desc("graph_id"))
            row = of.first()
            if row is None or row["graph_id"] != at[1]:
                raise ValueError(f"no frame {at[1]} in {at[0]}")
            if row["frame_type"] == "full":
                return [at, *reversed(out)]
            if row["frame_type"] != "delta":
                raise ValueError(f"frame {at[1]} of {at[0]} is {row['frame_type']}")
            if row["base_id"] is not None:
                out.append(at)
                at = (row["base_timeline"] or at[0], row["base_id"])
                continue
            # adjacent changes: all frames back to the last full one at once
            run = of.select("graph_id", "frame_type", F.sum(F.when(F.col("frame_type") == "full", 1).otherwise(0)).over(versions.Window.orderBy(F.desc("graph_id"))).alias("fulls"))
            rows = run.where("fulls = 0 OR (fulls = 1 AND frame_type = 'full')").orderBy(F.desc("graph_id")).collect()
            if rows[-1]["frame_type"] != "full" or any(r["frame_type"] in ("empty", "error") for r in rows):
                raise ValueError(f"frame {graph_id} of {timeline} has no full frame before it")
            return [(at[0], rows[-1]["graph_id"]), *[(at[0], r["graph_id"]) for r in reversed(rows[:-1])], *reversed(out)]
        raise AssertionError

    def fetch(self, timeline: str, graph_id: int) -> DataFrame:
        """The rows (keys, value) of a version: its full frame with the changes after it, in one pass over the data of the chain."""
        chain = self.chain(timeline, graph_id)
        steps = self.spark.createDataFrame([(t, g, k) for k, (t, g) in enumerate(chain)], "timeline_id string, graph_id long, _turn int")
        rows = self.data.join(F.broadcast(steps), ["timeline_id", "graph_id"])  # as many names as the chain has
        base = rows.where("_turn = 0").select(*self.keys, self.value)
        return versions.apply(base, rows.where("_turn > 0"), self.keys, self.value, "_turn")

    def latest(self, timeline: str) -> int | None:
        """The newest frame that holds a version."""
        row = self.frames.where((F.col("timeline_id") == timeline) & F.col("frame_type").isin("full", "delta")).agg(F.max("graph_id").alias("id")).first()
        return row["id"]

    def fetch_latest(self, timeline: str) -> tuple[int, DataFrame]:
        at = self.latest(timeline)
        if at is None:
            raise ValueError(f"{timeline} has no version")
        return at, self.fetch(timeline, at)

    def load_range(self, timeline: str, first: int, last: int) -> DataFrame:
        """(graph_id, keys, value): every version of adjacent frames in a range, each key's value carried on from frame to frame.

        A key's changes are laid out over the frames until the next one, so nothing is replayed on the driver.
        """
        return self.load_versions(timeline, self.spark.range(first, last + 1).select(F.col("id").alias("graph_id")))

    def load_versions(self, timeline: str, ids: DataFrame, folders: Names | None = None) -> DataFrame:
        """(graph_id, keys, value) of some frames (graph_id)."""
        folders = self.latest_commit()[1] if folders is None else folders
        mine, data = self._both(folders, timeline)
        frames = versions.nearest_full(mine.select("timeline_id", "graph_id", "ts", "frame_type")).where("full_id IS NOT NULL")
        frames = saved(frames.select("graph_id", "full_id"))
        wanted = saved(frames.join(ids, "graph_id", "left_semi"))
        # of chains that hold no wanted frame nothing is read
        chains = wanted.groupBy("full_id").agg(F.max("graph_id").alias("_last"))
        rows = data.join(frames.join(chains, "full_id").where(F.col("graph_id") <= F.col("_last")).drop("_last"), "graph_id")
        w = versions.Window.partitionBy("full_id", *self.keys).orderBy("graph_id")
        spans = rows.withColumn("_until", F.lead("graph_id").over(w)).where("op <> 'remove'")
        at = wanted.select(F.col("graph_id").alias("_at"), "full_id")
        hit = (F.col("_at") >= F.col("graph_id")) & (F.col("_until").isNull() | (F.col("_at") < F.col("_until")))
        return spans.join(at, "full_id").where(hit).select(F.col("_at").alias("graph_id"), *self.keys, self.value)

    def register_empty(self, frames: DataFrame, overlap: bool = False) -> int:
        """Add empty frames (timeline_id, graph_id, ts) that are not there yet; known ones must be the same, and with ``overlap`` there must be some. Returns how many were added."""
        known = self.frames.select("timeline_id", "graph_id", F.col("ts").alias("_ts"))
        rows = saved(frames.select("timeline_id", "graph_id", F.col("ts").cast("timestamp_ntz").alias("ts")).join(known, ["timeline_id", "graph_id"], "left"))
        met, other = rows.agg(F.count("_ts"), F.count_if(F.col("_ts") != F.col("ts"))).first()
        if other or (overlap and not met):
            raise ValueError("frames differ from those that are there" if other else "no frame overlaps those that are there")
        new = rows.where("_ts IS NULL").drop("_ts").withColumn("frame_type", F.lit("empty"))
        self.add(new)
        return new.count()

    def store_range(self, timeline: str, data: DataFrame) -> None:
        """Fill empty or error frames (graph_id) with versions: rows (graph_id, keys, value). The first is held in full, the others as changes; any other frame among them is an error."""
        ids = saved(data.select("graph_id").distinct())
        mine = self.frames.where(F.col("timeline_id") == timeline)
        there = saved(ids.join(mine, "graph_id", "left"))
        if not there.where("frame_type IS NULL OR frame_type NOT IN ('empty', 'error')").isEmpty():
            raise ValueError("a frame of the range is not there, or is not empty")
        first = ids.agg(F.min("graph_id")).first()[0]
        order = versions.Window.orderBy("graph_id")  # one row for each frame
        turns = saved(ids.select("graph_id", F.lag("graph_id").over(order).alias("_before"), F.lead("graph_id").over(order).alias("_after")))
        rows = data.join(turns, "graph_id")
        old = rows.where("_after IS NOT NULL").select(F.col("_after").alias("graph_id"), *self.keys, self.value)
        new = rows.where("_before IS NOT NULL").select("graph_id", *self.keys, self.value)
        changes = versions.derive(old, new, ["graph_id", *self.keys], self.value)
        full = data.where(F.col("graph_id") == first).select(F.lit("full").alias("op"), "graph_id", *self.keys, self.value)
        self._replace(timeline, there.drop("frame_type", "errors").withColumn("frame_type", F.when(F.col("graph_id") == first, "full").otherwise("delta")).withColumn("errors", F.lit(None).cast("array<string>")), full.unionByName(changes))

    def _replace(self, timeline: str, frames: DataFrame, data: DataFrame) -> None:
        """Put frames that are empty or errors in place of themselves, with their data."""
        new = saved(frames.withColumn("timeline_id", F.lit(timeline)))
        rows = self._write("data", data.select(F.lit(timeline).alias("timeline_id"), "graph_id", "op", *self.keys, self.value))

        def make(folders: Names) -> Names:
            mine, _ = self._both(folders, timeline)
            if new.join(mine.where("frame_type IN ('empty', 'error')"), "graph_id", "left_anti").limit(1).count():
                raise ValueError("a frame of the range is no longer empty")
            rest = mine.join(new.select("graph_id"), "graph_id", "left_anti").select(*mine.columns)
            folders["frames"][timeline] = self._write("frames", rest.unionByName(new.select(*mine.columns)))[timeline]
            folders["data"].setdefault(timeline, []).extend(rows.get(timeline, []))
            return folders

        self._change(make)

    def delete(self, timeline: str, graph_id: int | None = None) -> None:
        """Delete a frame, or all of a timeline, with its data. A frame that another version is made of is an error."""

        def make(folders: Names) -> Names:
            if graph_id is None:
                for of in folders.values():
                    of.pop(timeline, None)
                return folders
            every = self._read("frames", FRAME, folders)
            here = (F.col("timeline_id") == timeline) & (F.col("graph_id") == graph_id)
            if not versions.needed(every, every.where(~here)).where(here).isEmpty():
                raise ValueError(f"another version is made of frame {graph_id} of {timeline}")
            return self._without(folders, timeline, every.where(here).select("graph_id"))

        self._change(make)

    def _without(self, folders: Names, timeline: str, gone: DataFrame) -> Names:
        """The folders once frames (graph_id) of a timeline and their data are left out."""
        for name, table in zip(("frames", "data"), self._both(folders, timeline), strict=True):
            rest = self._write(name, table.join(gone.select("graph_id"), "graph_id", "left_anti").select(*table.columns))
            folders[name].pop(timeline, None)
            folders[name] |= rest
        return folders

    def compact(self, timeline: str) -> int:
        """Rewrite full frames that follow another version as changes against it; returns how many. Only these versions and those just before them are laid out."""
        done = 0

        def make(folders: Names) -> Names | None:
            nonlocal done
            mine, data = self._both(folders, timeline)
            turns = versions.compaction(mine.select("timeline_id", "graph_id", "frame_type")).where("frame_type <> becomes")
            held = versions.nearest_full(mine.select("timeline_id", "graph_id", "ts", "frame_type"))  # what stands before must be a version
            order = versions.Window.orderBy("graph_id")  # a row for each frame of the timeline
            held = held.select("graph_id", F.lag("full_id").over(order).alias("_full"), F.lag("graph_id").over(order).alias("_before")).where("_full IS NOT NULL")
            todo = saved(turns.join(held, "graph_id").select("graph_id", "_before"))
            done = todo.count()
            if not done:
                return None
            ids = todo.select("graph_id").unionByName(todo.select(F.col("_before").alias("graph_id"))).distinct()
            laid = saved(self.load_versions(timeline, ids, folders))
            old = laid.join(todo.select(F.col("_before").alias("graph_id"), F.col("graph_id").alias("_to")), "graph_id").select(F.col("_to").alias("graph_id"), *self.keys, self.value)
            new = laid.join(todo.select("graph_id"), "graph_id", "left_semi")
            changes = versions.derive(old, new, ["graph_id", *self.keys], self.value).withColumn("timeline_id", F.lit(timeline))
            rest = data.join(todo.select("graph_id"), "graph_id", "left_anti").select(*data.columns)
            frames = mine.join(todo.select("graph_id", F.lit("delta").alias("_type")), "graph_id", "left").withColumn("frame_type", F.coalesce("_type", "frame_type")).select(*mine.columns)
            folders["data"][timeline] = self._write("data", rest.unionByName(changes.select(*rest.columns))).get(timeline, [])
            folders["frames"][timeline] = self._write("frames", frames)[timeline]
            return folders

        self._change(make)
        return done

    def expire(self, now: str) -> int:
        """Remove frames that have expired by then, but for those that a version which stays is made of. Returns how many."""
        gone = 0

        def make(folders: Names) -> Names | None:
            nonlocal gone
            every = saved(self._read("frames", FRAME, folders))
            old = versions.expired(every, now)
            kept = every.join(old.select("timeline_id", "graph_id"), ["timeline_id", "graph_id"], "left_anti")
            drop = saved(old.select("timeline_id", "graph_id").join(versions.needed(every, kept), ["timeline_id", "graph_id"], "left_anti"))
            gone = drop.count()
            for (timeline,) in drop.select("timeline_id").distinct().toLocalIterator():
                folders = self._without(folders, timeline, drop.where(F.col("timeline_id") == timeline))
            return folders if gone else None

        self._change(make)
        return gone

    def clean(self, older_than: float = 86_400.0) -> int:
        """Delete folders and commits that the last commit does not name and that are older than so many seconds (longer than any reader or writer runs). Returns how many folders went."""
        number, folders = self.latest_commit()
        named = {p for of in folders.values() for paths in of.values() for p in paths}
        before, count = (time.time() - older_than) * 1000, 0
        for name in ("frames", "data"):
            top = self._path(f"{self.folder}/{name}")
            for write in self._fs.listStatus(top) if self._fs.exists(top) else []:
                for f in self._fs.listStatus(write.getPath()):
                    own = f"{self.folder}/{name}/{write.getPath().getName()}/{f.getPath().getName()}"
                    if f.isDirectory() and own not in named and write.getModificationTime() <= before:
                        count += bool(self._fs.delete(f.getPath(), True))
        for f in self._fs.listStatus(self._path(f"{self.folder}/commits")):
            if f.getPath().getName().isdigit() and int(f.getPath().getName()) < number and f.getModificationTime() <= before:
                self._fs.delete(f.getPath(), False)
        return count

    def create_timeline(self, timeline: str, config: dict) -> None:
        """Make a timeline without frames, with its configuration; one that is there is an error."""

        def make(folders: Names) -> Names:
            if any(timeline in of for of in folders.values()):
                raise ValueError(f"{timeline} is there already")
            folders["timelines"][timeline] = [json.dumps(config, sort_keys=True)]
            return folders

        self._change(make)

    def timeline_config(self, timeline: str) -> dict:
        """The configuration of a timeline; none is an empty one, an unknown timeline an error."""
        folders = self.latest_commit()[1]
        if not any(timeline in of for of in folders.values()):
            raise ValueError(f"no timeline {timeline}")
        return json.loads(folders["timelines"].get(timeline, ["{}"])[0])

    def timelines(self) -> DataFrame:
        """(timeline_id, frames, first_id, last_id, last_ts) of all timelines, those without frames included."""
        made = self.spark.createDataFrame([(t,) for t in sorted(self.latest_commit()[1]["timelines"])], "timeline_id string")
        every = self.frames.select("timeline_id", "graph_id", "ts").unionByName(made, allowMissingColumns=True)
        return every.groupBy("timeline_id").agg(F.count("graph_id").alias("frames"), F.min("graph_id").alias("first_id"), F.max("graph_id").alias("last_id"), F.max("ts").alias("last_ts"))
