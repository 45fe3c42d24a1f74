"""A library in immutable segments: batches are added, replaced and removed without rewriting what is stored.

Every batch is a segment: for each table the folder ``table/segment=N``, cut into ``bucket=B`` by the hash of the slug, as
many as its size asks for. Replacing or deleting documents writes their slugs as a delete file; rows of a slug in segments
older than the last delete of it are dead. Which segments and delete files count is said by a small manifest file per
version, so a reader sees one version from beginning to end, and old versions can be opened.

Statistics merge: a segment has its terms with document frequencies; a delete file has those that it takes from each older
segment; numbers of chunks and tokens are in the manifest. So scores are those of an index built anew, and no query counts
the corpus. Segments of like size are merged into one, which leaves out dead rows and lets delete files go.
"""

from __future__ import annotations

import json
import math
import secrets
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmine.operators.lexical import LexicalIndex, build_index, document_frequency, idf_of
from shelfmine.operators.rows import unfolded
from shelfmine.operators.skew import BROADCAST_ROWS, join_small
from shelfmine.session import RELEASED, cut_lineage, drop_steps, settings

BUCKET_BYTES = 64 * 1024 * 1024
POSTING_BYTES = 32
MOST_BUCKETS = 4_096
# rows of one bucket go to several files from this size of a segment on, so that a document with most rows is no one task
SPREAD = 8
CHANGES = 1_000_000
FAN_OUT = 4
INDEX = ("lengths", "postings")
TERMS = "term string, df bigint"
# stored texts, vectors and postings are about a third smaller than in the default codec
CODEC = "zstd"
# A task that makes tables of a segment from stored rows reads about one file of these, which bounds what it sorts.
PLACED = {"spark.sql.files.maxPartitionBytes": str(8 * 1024 * 1024)}
# the last sort column puts rows that are asked for together into the same pages of a file
ORDER = {"postings": "term"}


class ConcurrentChange(RuntimeError):
    """Another writer has made, or is making, the next version."""


class NoLibrary(FileNotFoundError):
    """No library, or no such version, at the given place."""


@dataclass(frozen=True)
class Folded:
    """A table that is dealt to its buckets as ``rows`` with an array of structs each, and unfolded there. The other columns of
    ``rows`` that are named in ``keep`` come before the fields of the structs, of which ``field`` is never null."""

    rows: DataFrame
    structs: str
    field: str
    keep: tuple[str, ...]

    def unfolded(self, rows: DataFrame | None = None, *more: str) -> DataFrame:
        return unfolded(self.rows if rows is None else rows, F.col(self.structs), self.field, *self.keep, *more)

    @property
    def columns(self) -> list[str]:
        return self.unfolded().columns

    @property
    def schema(self) -> T.StructType:
        return self.unfolded().schema


class _Files:
    """The few file operations that a manifest needs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path("").getFileSystem(conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def claim(self, name: str) -> bool:
        """Create an empty file; false if it is there already."""
        self.fs.mkdirs(self._path(name).getParent())
        return self.fs.createNewFile(self._path(name))

    def publish(self, name: str, text: str) -> None:
        """The file appears with all its text."""
        draft = self._path(f"{name}.draft")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if not self.fs.rename(draft, self._path(name)):
            raise OSError(f"cannot publish {name}")


def tier(size: int, fan_out: int) -> int:
    return int(math.log(max(size, 1), fan_out))


class SegmentedLibrary:
    """One version of a library. Changes return the next version; this one stays readable.

    ``append`` takes any tables that have a slug; with ``lengths`` and ``postings`` among them the library has a keyword
    index. Rows that repeat stay repeated; rows of a null slug are kept and can never be replaced. A table without rows in
    any segment reads as an empty table of its columns.
    """

    def __init__(self, spark: SparkSession, root: str, manifest: dict) -> None:
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), manifest

    # ---------------------------------------------------------------- versions

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> SegmentedLibrary:
        empty = cls(spark, root, {"version": 0, "segments": [], "deletes": [], "schemas": {}, "notes": {}})
        return empty._commit(empty.manifest)

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> SegmentedLibrary:
        files = _Files(spark, root.rstrip("/"))
        known = sorted(n for n in files.names("versions") if n.endswith(".json"))
        name = known[-1] if known and version is None else f"{version or 0:010d}.json"
        if name not in known:
            raise NoLibrary(f"no version {version} at {root}" if known else f"no library at {root}")
        return cls(spark, root, json.loads(files.read(f"versions/{name}")))

    def _commit(self, manifest: dict) -> SegmentedLibrary:
        files = _Files(self.spark, self.root)
        name = f"versions/{manifest['version']:010d}"
        # all files are written by now, so the exclusive claim is held for a moment only
        if not files.claim(f"{name}.claim"):
            raise ConcurrentChange(f"{name} at {self.root} is taken")
        files.publish(f"{name}.json", json.dumps(manifest))
        return SegmentedLibrary(self.spark, self.root, manifest)

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def segments(self) -> list[dict]:
        return self.manifest["segments"]

    # ---------------------------------------------------------------- reading

    def table(self, name: str) -> DataFrame:
        """The live rows of a table."""
        columns = [f.name for f in self._schema(name)]
        return self._live(name, self.segments).select(*columns)

    def _schema(self, name: str) -> T.StructType:
        if name not in self.manifest["schemas"]:
            raise KeyError(f"no table {name}")
        return T.StructType.fromJson(self.manifest["schemas"][name])

    def _stored(self, name: str, segments: list[dict], schema: T.StructType | None = None) -> DataFrame:
        """Rows as written, with ``segment`` and ``bucket``."""
        schema = T.StructType(list((schema or self._schema(name)).fields)).add("segment", T.LongType()).add("bucket", T.IntegerType())
        paths = [f"{self.root}/{name}/segment={s['id']}" for s in segments if s["rows"].get(name)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _deleted(self, since: int) -> tuple[DataFrame | None, int]:
        """``(slug, _dead_before)`` of the delete files after a segment, and how many rows these have."""
        wanted = [d for d in self.manifest["deletes"] if d["id"] > since]
        if not wanted:
            return None, 0
        paths = [f"{self.root}/deletes/id={d['id']}" for d in wanted]
        rows = self.spark.read.schema("slug string, id long").option("basePath", f"{self.root}/deletes").parquet(*paths)
        return rows.groupBy("slug").agg(F.max("id").alias("_dead_before")), sum(d["slugs"] for d in wanted)

    def _live(self, name: str, segments: list[dict]) -> DataFrame:
        return self._alive(self._stored(name, segments), segments)

    def _alive(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """Rows with ``slug`` and ``segment`` that no later delete file takes."""
        deleted, n = self._deleted(min((s["id"] for s in segments), default=0))
        if deleted is None:
            return rows
        # slugs are short, so counted rows bound the broadcast
        marked = join_small(rows, deleted, ["slug"], rows.columns[0], "left", fits=n <= BROADCAST_ROWS)
        return marked.where(F.col("_dead_before").isNull() | (F.col("segment") >= F.col("_dead_before"))).drop("_dead_before")

    def index(self) -> LexicalIndex:
        """The keyword index; a search reads no more than the postings of its terms."""
        n = sum(s["chunks"] for s in self.segments)
        tokens = sum(s["tokens"] for s in self.segments)
        stats = self._term_counts(self.segments).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return LexicalIndex(
            lengths=self.table("lengths"),
            postings=self.table("postings"),
            term_stats=stats.select("term", "df", idf_of(F.lit(n), F.col("df")).alias("idf")),
            totals=(n, tokens),
        )

    def _term_counts(self, segments: list[dict]) -> DataFrame:
        """Document frequencies of segments, and with a minus those that delete files took from them."""
        kept = [s["id"] for s in segments if s["rows"].get("postings")]
        counts = self.spark.createDataFrame([], TERMS)
        if kept:
            read = self.spark.read.schema(f"{TERMS}, segment long, id long")
            paths = [f"{self.root}/terms/segment={s}" for s in kept]
            counts = read.option("basePath", f"{self.root}/terms").parquet(*paths).select("term", "df")
            gone = [f"{self.root}/removed/id={d['id']}/segment={s}" for d in self.manifest["deletes"] for s in kept if s in d["hit"]]
            if gone:
                counts = counts.unionByName(read.option("basePath", f"{self.root}/removed").parquet(*gone).select("term", (-F.col("df")).alias("df")))
        return counts

    # ---------------------------------------------------------------- writing

    def append(
        self, tables: Mapping[str, DataFrame | Folded], replaced: DataFrame | None = None, notes: Mapping[str, int] | None = None
    ) -> SegmentedLibrary:
        """The library with one more segment. Documents of ``replaced(slug)`` lose all their earlier rows."""
        segment = self.begin(replaced)
        segment.write(tables)
        return segment.commit(notes)

    def begin(self, replaced: DataFrame | None = None) -> SegmentWriter:
        """A segment that is written table by table; documents of ``replaced(slug)`` lose all their earlier rows by it."""
        return SegmentWriter(self, self._after_delete(replaced) if replaced is not None else self._next())

    def delete(self, slugs: DataFrame) -> SegmentedLibrary:
        """The library without the documents of ``slugs(slug)``; unknown slugs change nothing."""
        with settings(self.spark, RELEASED):
            return self._commit(self._after_delete(slugs))

    def merged(self, fan_out: int = FAN_OUT) -> SegmentedLibrary:
        """Segments of like size as one, as long as ``fan_out`` of them are found; the library itself if there are none."""
        library = self
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in library.segments:
                tiers.setdefault(tier(s["chunks"], fan_out), []).append(s)
            group = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan_out), None)
            if group is None:
                return library
            library = library._merge(group)

    def _merge(self, group: list[dict]) -> SegmentedLibrary:
        manifest = self._next()
        ids = {s["id"] for s in group}
        names = sorted({n for s in group for n, rows in s["rows"].items() if rows})
        tables = {n: self._live(n, group).select(*self._schema(n).names) for n in names}
        # dead rows are counted as well here, which can only make more buckets
        postings = sum(s["rows"].get("postings", 0) for s in group)
        size = None if "chunks" in names else postings * POSTING_BYTES
        counts = self._term_counts(group).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0") if postings else None
        manifest["segments"] = [s for s in self.segments if s["id"] not in ids]
        manifest["segments"].append(self._write_segment(manifest["change"], tables, size, counts))
        oldest = min(s["id"] for s in manifest["segments"])
        manifest["deletes"] = [d for d in manifest["deletes"] if d["id"] > oldest]
        return self._commit(manifest)

    def _next(self) -> dict:
        """A copy of the manifest for the next version, with the number under which this change writes its files. Numbers
        grow with the version; their end is random, so writers that meet at one version never share a folder."""
        version = self.version + 1
        change = version * CHANGES + secrets.randbelow(CHANGES)
        return {**json.loads(json.dumps(self.manifest)), "version": version, "change": change}

    @staticmethod
    def _size(table: DataFrame | Folded | None) -> int:
        """Bytes of the texts, or an estimate from the number of postings."""
        if table is None:
            return 0
        if isinstance(table, Folded):
            heavy, rows = F.sum(F.greatest(F.size(table.structs), F.lit(0))) * POSTING_BYTES, table.rows
        else:
            heavy, rows = F.sum(F.length("text")) if "text" in table.columns else F.count(F.lit(1)) * POSTING_BYTES, table
        return rows.agg(heavy).first()[0] or 0

    def _write_segment(
        self, segment: int, tables: Mapping[str, DataFrame | Folded], size: int | None = None, counts: DataFrame | None = None
    ) -> dict:
        """Tables of one segment. A merge knows about their ``size`` and the document frequencies ``counts(term, df)`` already."""
        if size is None:
            size = self._size(tables.get("chunks", tables.get("postings")))
        made = {"id": segment, "buckets": max(1, min(MOST_BUCKETS, -(-size // BUCKET_BYTES))), "rows": {}, "chunks": 0, "tokens": 0}
        self._add(made, tables, counts)
        return made

    def _add(self, made: dict, tables: Mapping[str, DataFrame | Folded], counts: DataFrame | None = None) -> None:
        """More tables of a segment."""
        for name, table in tables.items():
            folded = table if isinstance(table, Folded) else None
            made["rows"][name] = self._write(name, folded.rows if folded else table, made["id"], made["buckets"], folded)
        if "lengths" in tables and made["rows"]["lengths"]:
            lengths = self._stored("lengths", [made], _own(tables["lengths"]))
            made["chunks"], made["tokens"] = lengths.agg(F.count(F.lit(1)), F.sum("dl")).first()
        if "postings" in tables and made["rows"]["postings"]:
            if counts is None:
                counts = document_frequency(self._stored("postings", [made], _own(tables["postings"])))
            self._write_terms(counts.withColumn("segment", F.lit(made["id"]).cast("long")), "terms", "segment")

    def _dealt(self, name: str, rows: DataFrame, segment: int, buckets: int, folded: Folded | None) -> DataFrame:
        """Rows with ``segment`` and ``bucket`` in the tasks that write them. Rows that follow from stored ones of the segment
        bring their bucket and are not exchanged again."""
        number = F.lit(segment).cast("long")
        if "bucket" in rows.columns:
            dealt = rows.withColumn("segment", number)
        else:
            spread = SPREAD if buckets > 1 else 1
            placed = rows.withColumns(
                {
                    "segment": number,
                    "bucket": F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int"),
                    "_spread": F.pmod(F.xxhash64(rows.columns[0]), F.lit(spread)),
                }
            )
            dealt = placed.repartition(buckets * spread, "bucket", "_spread").drop("_spread")
        if folded is not None:
            dealt = folded.unfolded(dealt, "segment", "bucket")
        return dealt.sortWithinPartitions("segment", "bucket", ORDER.get(name, "slug"))

    def _write(self, name: str, rows: DataFrame, segment: int, buckets: int, folded: Folded | None = None) -> int:
        """Rows written. Only this segment's partitions are overwritten, so a batch that failed can be written again."""
        with settings(self.spark, PLACED if "bucket" in rows.columns else {}):
            _save(self._dealt(name, rows, segment, buckets, folded), f"{self.root}/{name}", "segment", "bucket")
        made = {"id": segment, "rows": {name: 1}}
        if f"segment={segment}" not in _Files(self.spark, self.root).names(name):
            return 0
        return self._stored(name, [made], _own(rows if folded is None else folded)).count()

    def _write_terms(self, counts: DataFrame, name: str, *by: str, mode: str = "overwrite") -> None:
        ordered = counts.repartitionByRange("term").sortWithinPartitions(*by, "term")
        _save(ordered, f"{self.root}/{name}", *by, mode=mode)

    def _after_delete(self, slugs: DataFrame) -> dict:
        manifest = self._next()
        now = manifest["change"]
        slugs = cut_lineage(slugs.select("slug").where(F.col("slug").isNotNull()).distinct(), "slugs")
        n = slugs.count()
        if n == 0 or not self.segments:
            drop_steps(slugs)
            return manifest
        _save(slugs.withColumn("id", F.lit(now).cast("long")), f"{self.root}/deletes", "id")
        hit: dict[int, tuple[int, int]] = {}
        if "lengths" in self.manifest["schemas"]:
            hurt = cut_lineage(self._hurt(slugs, n), "hurt")
            hit = {r.segment: (r.n, r.dl) for r in hurt.groupBy("segment").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).collect()}
            if hit and "postings" in self.manifest["schemas"]:
                self._write_removed(hurt, now)
            drop_steps(hurt)
        written = [int(x.split("=")[1]) for x in _Files(self.spark, self.root).names(f"removed/id={now}") if "=" in x]
        for s in manifest["segments"]:
            chunks, tokens = hit.get(s["id"], (0, 0))
            s["chunks"], s["tokens"] = s["chunks"] - chunks, s["tokens"] - tokens
        manifest["deletes"].append({"id": now, "slugs": n, "hit": sorted(written)})
        drop_steps(slugs)
        return manifest

    def _hurt(self, slugs: DataFrame, n: int) -> DataFrame:
        """``(slug, segment, bucket, n, dl)``: live chunks and tokens of some documents in each segment. Only the buckets that
        these fall into are read, and documents are summed up before they are joined."""
        rows = None
        for buckets in sorted({s["buckets"] for s in self.segments}):
            group = [s for s in self.segments if s["buckets"] == buckets]
            asked = slugs.select(F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int").alias("b")).distinct()
            wanted = [r.b for r in asked.collect()]  # at most MOST_BUCKETS numbers
            part = self._stored("lengths", group).where(F.col("bucket").isin(wanted))
            rows = part if rows is None else rows.unionByName(part)
        documents = rows.groupBy("slug", "segment", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"))
        return self._alive(join_small(documents, slugs, ["slug"], "segment", "left_semi", fits=n <= BROADCAST_ROWS), self.segments)

    def _write_removed(self, hurt: DataFrame, now: int) -> None:
        """What the documents of ``hurt`` take from the document frequencies. Postings are far more than documents, so they are
        not exchanged: as many buckets are read at a time as have documents for one broadcast, so a term may have several rows."""
        shares: list[tuple[int, dict[int, list[int]]]] = []
        for r in hurt.groupBy("segment", "bucket").count().orderBy("segment", "bucket").collect():  # at most MOST_BUCKETS a segment
            if not shares or shares[-1][0] + r["count"] > BROADCAST_ROWS:
                shares.append((0, {}))
            size, places = shares.pop()
            places.setdefault(r.segment, []).append(r.bucket)
            shares.append((size + r["count"], places))
        for i, (size, places) in enumerate(shares):
            here = F.lit(False)
            for segment, numbers in places.items():
                here = here | ((F.col("segment") == segment) & F.col("bucket").isin(numbers))
            rows = self._stored("postings", [s for s in self.segments if s["id"] in places]).where(here)
            own = hurt.where(here).select("segment", "slug")
            lost = join_small(rows, own, ["segment", "slug"], "chunk_id", "left_semi", fits=size <= BROADCAST_ROWS)
            lost = lost.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("df")).withColumn("id", F.lit(now).cast("long"))
            self._write_terms(lost, "removed", "id", "segment", mode="append" if i else "overwrite")


class SegmentWriter:
    """The next segment of a library, table by table, so that tables can follow from those that are stored already. No version
    has it before ``commit``."""

    def __init__(self, library: SegmentedLibrary, manifest: dict) -> None:
        self.library, self.manifest, self.made = library, manifest, None

    def write(self, tables: Mapping[str, DataFrame | Folded]) -> None:
        """More tables. The first ones say by the size of ``chunks``, else of ``postings``, how many buckets there are."""
        for name, rows in tables.items():
            if reserved := {"segment", "bucket"} & set(rows.columns):
                raise ValueError(f"table {name} has columns that the layout uses: {sorted(reserved)}")
        self._add(tables)

    def follow(self, tables: Mapping[str, DataFrame | Folded]) -> None:
        """More tables, whose rows are made row by row from ``stored`` ones and have kept their ``bucket``."""
        for name, table in tables.items():
            if "bucket" not in (table.rows if isinstance(table, Folded) else table).columns:
                raise ValueError(f"rows of table {name} have no bucket")
        self._add(tables)

    def _add(self, tables: Mapping[str, DataFrame | Folded]) -> None:
        for name, table in tables.items():
            self.manifest["schemas"].setdefault(name, json.loads(_own(table).json()))
        if self.made is None:
            self.made = self.library._write_segment(self.manifest["change"], tables)
        else:
            self.library._add(self.made, tables)

    def stored(self, name: str) -> DataFrame:
        """Rows of a written table, with their ``bucket``."""
        return self.library._stored(name, [self.made], T.StructType.fromJson(self.manifest["schemas"][name])).drop("segment")

    def commit(self, notes: Mapping[str, int] | None = None) -> SegmentedLibrary:
        self.manifest["notes"] = {**self.manifest["notes"], **(notes or {})}
        self.manifest["segments"].append(self.made)
        return self.library._commit(self.manifest)


def _own(table: DataFrame | Folded) -> T.StructType:
    """The columns of a table without its place."""
    return T.StructType([f for f in table.schema.fields if f.name != "bucket"])


def _save(rows: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", CODEC)
    writer.partitionBy(*by).parquet(path)


def written_tokens(chunks: DataFrame, *keep: str) -> DataFrame:
    """``(chunk_id, slug, dl, runs)`` of ``(chunk_id, slug, text)`` as a table, and the columns of ``keep``."""
    with settings(chunks.sparkSession, PLACED if "bucket" in keep else {}):
        return cut_lineage(build_index(chunks, keep=keep).tokens, "tokens", CODEC)


def index_tables(chunks: DataFrame, tokens: DataFrame | None = None) -> dict[str, DataFrame | Folded]:
    """``lengths`` and ``postings`` of ``(chunk_id, slug, text)``; the texts are tokenised once, or not at all where their
    written tokens are given. Chunks become postings in the tasks that write these."""
    tokens = written_tokens(chunks) if tokens is None else tokens
    columns = ("chunk_id", "slug", "dl")
    places = [c for c in ("bucket",) if c in tokens.columns]
    return {"lengths": tokens.select(*columns, *places), "postings": Folded(tokens, "runs", "term", columns)}
