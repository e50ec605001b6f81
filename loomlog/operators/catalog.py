"""Archives, files and indexed events as Parquet tables under one folder.

All tables are partitioned by archive, so deleting an archive drops folders and rewrites nothing.

Indexing is one commit: the marks of the files that it takes are staged first, which fixes the set; their events are written to a
folder of the commit's own, which no reader looks at yet; then one rename puts the marks into the manifest. Readers follow the
manifest, so a crash at any point leaves nothing half indexed, and no events that are held already are read. ``vacuum`` removes
what broken commits have left. The parse of a file that is kept with it is replaced in the same way.

Single files are stored in pieces of some MiB of whole chunks, in a table of their own, and their row has no blob; so neither storing nor
indexing a large log holds it in a row. Members of zip files are stored as blobs.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import container, files

TABLES = {
    "archives": "id string, name string, uploaded_at timestamp, total_size bigint, file_count int, files array<string>, archive_id string",
    "files": "id string, name string, type string, size bigint, blob binary, archive_id string",
    "pieces": "id string, name string, type string, size bigint, start bigint, skip int, content binary, archive_id string",
    "marks": "file_id string, indexed_at timestamp, commit string, archive_id string",
    "events": "id string, archive_name string, file_id string, file_name string, record_id bigint, event_id string, provider string, level int, level_text string, computer string, channel string, timestamp string, event_data string, task string, opcode string, keywords string, xml string, archive_id string",
}


def archive_key(name: str, at: datetime) -> str:
    return f"{name}_{int(at.timestamp() * 1000)}"


_PLACE = ("chunk_index", "record_seq")


def index_rows(events: DataFrame, stored: DataFrame, archives: DataFrame) -> DataFrame:
    """The 18 stored columns of ``events`` (with ``file_id``) and their place in the log, names of file and archive joined in.

    Both sides are catalog tables that Spark broadcasts by their measured size where they are small.
    """
    named = stored.select(F.col("id").alias("file_id"), F.col("name").alias("file_name"), "archive_id").join(archives.select("archive_id", F.col("name").alias("archive_name")), "archive_id")
    rows = events.join(named, "file_id").withColumn("id", F.concat_ws("::", "file_id", F.col("record_id").cast("string")))
    return rows.select(*(x.strip().split(" ")[0] for x in TABLES["events"].split(", ")), *_PLACE)


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(id, first): ids that come more than once in ``rows``, with the place of their first row. Only ids and places are read."""
    place = F.struct(*_PLACE)
    return rows.select("id", *_PLACE).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")


def first_rows(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` without all but the first row of each repeated id; where there are none, Spark drops the join."""
    return rows.join(repeated, "id", "left").filter(F.col("first").isNull() | (F.struct(*_PLACE) == F.col("first"))).select(*rows.columns)


def index_projection(events: DataFrame, stored: DataFrame, archives: DataFrame) -> DataFrame:
    """The 18 stored columns of ``events``; a record id that comes again in a file keeps its first row."""
    rows = index_rows(events, stored, archives)
    return first_rows(rows, repeated_ids(rows)).drop(*_PLACE)


def not_indexed(new: DataFrame, held: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new``, one for each key, whose key ``held`` has not."""
    return new.dropDuplicates([key]).join(held.select(key), key, "left_anti")


def without_archive(table: DataFrame, archive_id: str) -> DataFrame:
    return table.filter(F.col("archive_id") != archive_id)


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        hadoop, fs = self._fs(path)
        return fs.exists(hadoop)

    def _remove(self, pattern: str) -> None:
        hadoop, fs = self._fs(pattern)
        for found in fs.globStatus(hadoop) or ():
            fs.delete(found.getPath(), True)

    def _rename(self, source: str, target: str) -> None:
        """The one step that makes a staged folder count."""
        old, fs = self._fs(source)
        new, _ = self._fs(target)
        fs.mkdirs(new.getParent())
        if not fs.rename(old, new):
            raise OSError(f"cannot rename {source} to {target}")

    def _children(self, path: str) -> list[str]:
        hadoop, fs = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(hadoop)] if fs.exists(hadoop) else []

    def commits(self) -> list[str]:
        """Ids of the commits in the manifest."""
        return sorted(n.removeprefix("commit=") for n in self._children(self._path("marks")) if n.startswith("commit="))

    def table(self, name: str) -> DataFrame:
        if name == "events":
            paths = [p for c in self.commits() if self._exists(p := f"{self._path('events')}/commit={c}")]
        else:
            paths = [self._path(name)] if self._exists(self._path(name)) else []
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        columns = [x.strip().split(" ")[0] for x in TABLES[name].split(", ")]
        return self.spark.read.schema(TABLES[name]).option("basePath", self._path(name)).parquet(*paths).select(*columns)

    def _append(self, df: DataFrame, name: str, archive_id: str) -> None:
        """Rows of one archive into its folder, without the sort of a partitioned write."""
        w = df.drop("archive_id").write.mode("append")
        if name in ("files", "pieces"):  # else a hundred blobs are buffered before their size is looked at
            w = w.options(**{"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
        w.parquet(f"{self._path(name)}/archive_id={self._escaped(archive_id)}")

    def archives(self) -> DataFrame:
        return self.table("archives").orderBy(F.desc("uploaded_at"))

    def archive(self, archive_id: str) -> DataFrame:
        return self.table("archives").filter(F.col("archive_id") == archive_id)

    def files(self, archive_id: str | None = None) -> DataFrame:
        found = self.table("files") if archive_id is None else self.table("files").filter(F.col("archive_id") == archive_id)
        return found.join(self.table("marks").groupBy("file_id").agg(F.max("indexed_at").alias("indexed_at")), found["id"] == F.col("file_id"), "left").drop("file_id")

    def file(self, file_id: str) -> DataFrame:
        return self.table("files").filter(F.col("id") == file_id)

    def blob(self, file_id: str) -> DataFrame:
        """The bytes of a file: one row, or its pieces in order."""
        pieces = self.table("pieces").filter(F.col("id") == file_id).select("start", F.col("content").alias("blob"))
        return pieces.unionByName(self.file(file_id).filter("blob is not null").select(F.lit(0).cast("bigint").alias("start"), "blob")).orderBy("start").select("blob")

    def events(self) -> DataFrame:
        return self.table("events")

    def ingest(self, path: str, at: datetime | None = None) -> str:
        """Store a zip, or a single log, text, JSON or XML file, as an archive; its id."""
        members = files.read_zip(self.spark, path) if path.lower().endswith("zip") else files.read_pieces(self.spark, path)
        return self.store(files.check_viewable(members), path.rstrip("/").rsplit("/", 1)[-1], at)

    def store(self, members: DataFrame, name: str, at: datetime | None = None) -> str:
        """Store ``members`` (name, type, size, content), or pieces of them (start and skip besides), as an archive; its id."""
        at = at or datetime.now(UTC)
        key = archive_key(name, at)
        own = F.concat_ws("::", F.lit(key), "name").alias("id")
        if "start" in members.columns:
            self._append(members.select(own, "name", "type", "size", "start", "skip", "content", F.lit(key).alias("archive_id")), "pieces", key)
            told = self.table("pieces").filter((F.col("archive_id") == key) & (F.col("start") == 0))
            stored = told.select("id", "name", "type", "size", F.lit(None).cast("binary").alias("blob"), "archive_id")
        else:
            stored = members.filter("content is not null").select(own, "name", "type", "size", F.col("content").alias("blob"), F.lit(key).alias("archive_id"))
        self._append(stored, "files", key)
        own = self.table("files").filter(F.col("archive_id") == key)
        told = own.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size"), F.count(F.lit(1)).cast("int").alias("file_count"), F.sort_array(F.collect_list("id")).alias("files"))
        self._append(told.select(F.lit(key).alias("id"), F.lit(name).alias("name"), F.lit(at).cast("timestamp").alias("uploaded_at"), "total_size", "file_count", "files", F.lit(key).alias("archive_id")), "archives", key)
        return key

    def unindexed(self, archive_id: str | None = None) -> DataFrame:
        return self.files(archive_id).filter("type = 'evtx' and indexed_at is null")

    def index(self, archive_id: str | None = None) -> int:
        """Index the logs that are not indexed yet, as one commit; the number of files."""
        commit = uuid.uuid4().hex
        staged, target = f"{self.root}/_staging/{commit}", f"{self._path('events')}/commit={commit}"
        self.unindexed(archive_id).select(F.col("id").alias("file_id"), F.current_timestamp().alias("indexed_at"), "archive_id").write.partitionBy("archive_id").parquet(f"{staged}/marks")
        marks = self.spark.read.schema("file_id string, indexed_at timestamp, archive_id string").parquet(f"{staged}/marks")
        n = marks.count()
        if n:
            taken = self.table("files").join(marks.select(F.col("file_id").alias("id"), "archive_id"), ["id", "archive_id"], "left_semi")
            pieces = self.table("pieces").join(marks.select(F.col("file_id").alias("id"), "archive_id"), ["id", "archive_id"], "left_semi")
            copies = self._copies(taken, pieces, staged)
            own = copies.filter("file_id = file").select(F.col("file_id").alias("id"))
            whole = taken.filter("blob is not null").join(own, "id", "left_semi").select(F.col("id").alias("file"), F.col("blob").alias("content"))
            cut = pieces.join(own, "id", "left_semi").select(F.col("id").alias("file"), "start", "skip", "content")
            cut = container.chunks(whole).unionByName(container.piece_chunks(cut))
            parsed = container.events(container.decode(cut, parts=["events"]))
            rows = index_rows(parsed.join(copies, "file").drop("file"), taken, self.table("archives"))
            self._write_events(rows, staged, target)
            if not self.table("marks").join(marks, "file_id", "left_semi").isEmpty():
                raise RuntimeError("another commit has indexed some of these files")
            self._rename(f"{staged}/marks", f"{self._path('marks')}/commit={commit}")
        self._remove(staged)
        return n

    def _copies(self, taken: DataFrame, pieces: DataFrame, staged: str) -> DataFrame:
        """(file_id, file): of each file that is taken the first of those with the same content, which is decoded for all of them."""
        told = taken.filter("blob is not null").select(F.col("id").alias("file_id"), F.sha2("blob", 256).alias("content"))
        hashes = F.sort_array(F.collect_list(F.struct("start", F.sha2("content", 256).alias("hash"))))  # a row of some bytes for each piece
        told = told.unionByName(pieces.groupBy(F.col("id").alias("file_id")).agg(F.to_json(hashes).alias("content")))
        first = F.min("file_id").over(Window.partitionBy("content"))  # ids and hashes only
        told.select("file_id", first.alias("file")).write.parquet(f"{staged}/copies")
        return self.spark.read.schema("file_id string, file string").parquet(f"{staged}/copies")

    def _write_events(self, rows: DataFrame, staged: str, target: str) -> None:
        """Events are decoded once; a second pass over ids and places alone tells whether any come again."""
        rows.write.partitionBy("archive_id").parquet(f"{staged}/events")
        held = self.spark.read.schema(TABLES["events"].replace(", archive_id string", ", chunk_index int, record_seq int, archive_id string")).parquet(f"{staged}/events")
        repeated = repeated_ids(held)
        if repeated.isEmpty():
            self._rename(f"{staged}/events", target)
        else:
            first_rows(held, repeated).drop(*_PLACE).write.partitionBy("archive_id").parquet(target)

    def vacuum(self) -> None:
        """Remove what broken commits have left; not while another is under way."""
        kept = set(self.commits())
        for name in self._children(self._path("events")):
            if name.removeprefix("commit=") not in kept:
                self._remove(f"{self._path('events')}/{name}")
        self._remove(f"{self.root}/_staging")

    def _parsed_path(self, file_id: str) -> str:
        archive = self._escaped(file_id.split("::", 1)[0])
        return f"{self._path('parsed')}/archive_id={archive}/{hashlib.sha256(file_id.encode()).hexdigest()}"

    def update_parsed(self, file_id: str, parsed: DataFrame) -> None:
        """Keep ``parsed`` with a stored file in place of an earlier parse; readers see the old one or the new one."""
        path, staged = self._parsed_path(file_id), f"{self.root}/_staging/{uuid.uuid4().hex}"
        held = sorted(self._children(path))
        parsed.write.parquet(staged)
        self._rename(staged, f"{path}/v{int(held[-1][1:]) + 1 if held else 1:012d}")
        for old in held:
            self._remove(f"{path}/{old}")

    def parsed(self, file_id: str) -> DataFrame | None:
        """The parse that is kept with a file; None where there is none."""
        path = self._parsed_path(file_id)
        held = self._children(path)
        return self.spark.read.parquet(f"{path}/{max(held)}") if held else None

    def _escaped(self, archive_id: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(archive_id)

    def delete_archive(self, archive_id: str) -> None:
        """Events, marks, parses, files and the archive itself; nothing where there is none."""
        own = f"archive_id={self._escaped(archive_id)}"
        own = "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in own)  # a name, not a pattern
        for place in ("events/commit=*", "marks/commit=*", "parsed", "files", "pieces", "archives"):
            self._remove(f"{self.root}/{place}/{own}")

    def clear(self) -> None:
        for name in (*TABLES, "parsed", "_staging"):
            path, fs = self._fs(self._path(name))
            fs.delete(path, True)


class ParseCache:
    """The last few parsed logs stay persisted; text and JSON results stay until cleared."""

    def __init__(self, logs: int = 3) -> None:
        self.limit = logs
        self.logs: dict[str, DataFrame] = {}
        self.others: dict[str, DataFrame] = {}

    def get(self, key: str, build, is_log: bool = True) -> DataFrame:
        held = self.logs if is_log else self.others
        if key in held:
            held[key] = held.pop(key)
        else:
            held[key] = build().persist()
        while is_log and len(self.logs) > self.limit:
            self.logs.pop(next(iter(self.logs))).unpersist()
        return held[key]

    def update(self, key: str, parsed: DataFrame, is_log: bool = True) -> DataFrame:
        """``parsed`` in place of what is held under the key."""
        for held in (self.logs, self.others):
            if key in held:
                held.pop(key).unpersist()
        return self.get(key, lambda: parsed, is_log)

    def clear(self) -> None:
        for df in (*self.logs.values(), *self.others.values()):
            df.unpersist()
        self.logs.clear()
        self.others.clear()

    def stats(self) -> dict[str, int]:
        return {"logs": len(self.logs), "others": len(self.others)}
