"""The index service: indexing, searching and reporting over a stored index."""

from __future__ import annotations

import datetime as dt
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold import params
from tarnfold.config import Config
from tarnfold.errors import FileNotIndexed, PathNotFound, UnsupportedFileType, classify_error
from tarnfold.functions.paths import file_type
from tarnfold.functions.text import windows
from tarnfold.operators import catalog, fulltext, hybrid, sync
from tarnfold.sources import scan as source
from tarnfold.sources.embed import Embedder, embed, embedder
from tarnfold.storage import materialise, numbered, removing_scratch
from tarnfold.store import Store


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(microsecond=0, tzinfo=None)


class Index:
    """One index in a folder. Every method reads the current snapshot; changes commit a new one."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.store = spark, config, Store(spark, config.root)
        self._embedder: Embedder | None = None

    @property
    def embedder(self) -> Embedder:
        if self._embedder is None:
            self._embedder = embedder(self.config.embedding_model)
        return self._embedder

    # Changes

    def index(self, path: str, batch_limit: int | None = None) -> dict[str, Any]:
        """Indexes a file or directory; unchanged files are skipped. ``batch_limit``: only so many files, the first by path."""
        params.OnePath(path)
        if batch_limit is not None:
            params.whole("batch_limit", batch_limit, 0)
        if not os.path.exists(path):
            raise PathNotFound(path)
        with removing_scratch(self.spark):
            return self._run(path, False, self._listing(path, batch_limit))

    def reindex(self, path: str | None = None) -> dict[str, Any]:
        """Indexes again whatever its state; without a path all known files, removing those that are gone, in one commit."""
        params.Reindex(path)
        if path is not None:
            if not os.path.exists(path):
                raise PathNotFound(path)
            with removing_scratch(self.spark):
                return self._run(path, True, self._listing(path))
        with removing_scratch(self.spark):
            return self._reindex_known()

    def _reindex_known(self) -> dict[str, Any]:
        files = self.store.read("files")
        here = materialise(source.stated(files.select("path").repartition(max(1, self.config.workers))), "here")
        gone = materialise(files.join(here.select("path"), "path", "left_anti").select("path", F.col("id").alias("file_id")), "gone")
        return self._run(None, True, here, gone)

    def remove(self, path: str, prefix: bool = False) -> dict[str, Any]:
        """Removes a file, or what lies below an existing directory (``prefix``: whether it exists or not)."""
        params.OnePath(path)
        at = os.path.realpath(path)
        with removing_scratch(self.spark):
            return {"path": at, "files_removed": self._remove(at, prefix)}

    def _remove(self, at: str, prefix: bool) -> int:
        ids = materialise(sync.under(self.store.read("files"), at, prefix or os.path.isdir(at)).select(F.col("id").alias("file_id")), "removed")
        count = ids.count()
        if count:
            add, tables = self._without(ids)
            self.store.commit(add, **tables)
        return count

    def _without(self, ids: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """Rows to add and tables to replace so that the files ``ids`` are gone: postings stay equal to chunks."""
        chunks = self.store.read("chunks")
        f, c, v = sync.delete_files(ids, self.store.read("files"), chunks, self.store.read("vectors"))
        dead = chunks.join(ids.select("file_id").distinct(), "file_id", "left_semi")
        p = self.store.read("postings").join(dead.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
        less = fulltext.corpus(dead, "content").select((-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens"))
        return {"corpus": less}, {"files": f, "chunks": c, "vectors": v, "postings": p}

    def _listing(self, path: str, limit: int | None = None) -> DataFrame:
        listing = source.listing(self.spark, path)
        if not os.path.isfile(path):
            return materialise(source.scan(listing, self.config, path, limit=limit), "listing")
        bad = listing.where(file_type(F.col("path")).isNull()).head()
        if bad:
            raise UnsupportedFileType(path=bad[0], suffix=os.path.splitext(bad[0])[1].lower())
        return listing

    def _runs(self) -> DataFrame:
        """The latest state of every run."""
        return sync.latest_runs(self.store.read("runs")).select(*[c for c in self.store.read("runs").columns if c != "seq"])

    def _note(self, run: dict[str, Any], **changes: Any) -> dict[str, Any]:
        """Writes the next state of a run."""
        run = {**run, **changes, "seq": run.get("seq", 0) + 1}
        kind = self.store.read("runs").schema
        self.store.commit({"runs": self.spark.createDataFrame([tuple(run[f.name] for f in kind)], kind)})
        return run

    def _run(self, path: str | None, force: bool, listing: DataFrame, gone: DataFrame | None = None) -> dict[str, Any]:
        found = listing.count()
        if not found and (gone is None or not gone.head(1)):
            return self._answer([], None)
        run_id = (self.store.read("runs").agg(F.max("id")).head()[0] or 0) + 1
        counters = dict.fromkeys(("files_indexed", "files_skipped", "files_errored", "total_chunks"), 0)
        run = self._note({"id": run_id, "started_at": _now(), "finished_at": None, "path": os.path.realpath(path) if path else "*", "status": "running", "files_found": found, **counters, "error_message": None})
        try:
            return self._indexed(run, force, listing, gone)
        except Exception as e:
            last = self._runs().where(F.col("id") == run_id).drop("seq").head().asDict()
            self._note({**run, **last, "seq": 1 << 20}, status="failed", finished_at=_now(), error_message=str(e)[:2000])
            raise

    def _indexed(self, run: dict[str, Any], force: bool, listing: DataFrame, gone: DataFrame | None) -> dict[str, Any]:
        found, began = run["files_found"], run["started_at"]
        files = self.store.read("files")
        known = files.select("path", F.col("file_size").alias("_s"), F.col("mtime").alias("_m"))
        scan = listing.join(known, "path", "left")
        slow = scan.where(~F.coalesce((F.col("_s") == F.col("file_size")) & (F.col("_m") == F.col("mtime")), F.lit(False)))
        sums = source.checksums(slow.select("path").repartition(max(1, self.config.workers)))
        plan = sync.plan(listing.join(sums, "path", "left"), files, force).where("action != 'missing'")
        todo = materialise(plan.join(listing.select("path", "file_size"), "path"), "plan")
        work = todo.where("action in ('new', 'changed')")
        waiting = work.count()
        if waiting < found:
            run = self._note(run, files_skipped=found - waiting)
        tasks = max(1, self.config.workers, -(-waiting // max(1, self.config.batch)))
        texts = materialise(source.extract(work.select("path").repartition(tasks), self.config).join(work, "path"), "texts")
        good, bad = texts.where("error is null and checksum is not null"), texts.where("error is not null or checksum is null")
        top = files.agg(F.max("id")).head()[0] or 0
        order = [F.split("path", "/"), "path"]
        new = numbered(good.where("file_id is null"), order, "_new", top + 1)
        fresh = new.unionByName(good.where("file_id is not null").withColumn("_new", F.col("file_id")))
        pieces = fresh.select(F.col("_new").alias("file_id"), F.posexplode(windows(F.col("text"), self.config.chunk_size, self.config.chunk_overlap)).alias("chunk_index", "content"))
        pieces = materialise(pieces.withColumn("id", F.expr("(file_id << 24) | chunk_index")).withColumn("metadata", F.lit(None).cast("string")), "pieces")
        counts = pieces.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        rows = fresh.join(counts, fresh["_new"] == counts["file_id"], "left").select(
            F.col("_new").alias("id"), "path", "checksum", file_type(F.col("path")).alias("file_type"), "file_size", "mtime", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(began).cast("timestamp").alias("indexed_at")
        )
        log = self.store.read("errors")
        message = F.coalesce("error", F.lit("file vanished"))
        failures = numbered(bad, ["path"], "_id", (log.agg(F.max("id")).head()[0] or 0) + 1).select(F.col("_id").alias("id"), F.lit(run["id"]).cast("long").alias("run_id"), "path", message.alias("error_message"), classify_error(message).alias("error_type"), F.lit(began).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(0).alias("resolved"))
        results = todo.join(texts.select("path", "error", F.lit(True).alias("_tried")), "path", "left").join(rows.select("path", F.col("chunk_count").alias("_n")), "path", "left")
        status = F.when(F.col("_n").isNotNull(), "indexed").when(F.col("_tried").isNull(), "skipped").otherwise("error")
        results = results.select("path", status.alias("status"), F.coalesce("_n", F.lit(0)).alias("chunk_count"), "error")
        replaced = good.where("file_id is not null").select("file_id")
        if gone is not None:
            replaced = replaced.union(gone.select("file_id"))
            results = results.unionByName(gone.select("path", F.lit("removed").alias("status"), F.lit(0).alias("chunk_count"), F.lit("file_missing").alias("error")))
        results = materialise(results, "results")
        times = todo.where("action = 'backfill'").select("path", F.col("mtime").alias("_t"))
        add, tables = self._without(replaced) if replaced.head(1) else ({}, {})
        if times.head(1):
            tables["files"] = tables.get("files", files).join(times, "path", "left").withColumn("mtime", F.coalesce("mtime", "_t")).drop("_t")
        postings, corpus = fulltext.indexed(pieces, "id", "content"), fulltext.corpus(pieces, "content")
        vectors = embed(pieces, "id", "content", self.config.embedding_model)
        for name, more in (("files", rows), ("chunks", pieces), ("vectors", vectors), ("postings", postings), ("corpus", corpus), ("errors", failures)):
            if name in tables:
                tables[name] = tables[name].unionByName(more, allowMissingColumns=True)
            else:
                add[name] = add[name].unionByName(more) if name in add else more
        resolved = sync.resolvable(log, rows).count()
        if resolved:
            tables["errors"] = sync.resolve(log, rows.select("path"), began).unionByName(add.pop("errors"))
        s = catalog.summary(results).head()
        counted = {k: s[k] for k in ("files_indexed", "files_skipped", "files_errored", "total_chunks")}
        run = self._note(run, **counted)
        self.store.commit(add, **tables)
        self._note(run, status="completed", finished_at=_now())
        out = self._answer([r.asDict() for r in catalog.details(results).orderBy(F.split("path", "/")).toLocalIterator()], s, found)
        return out | {"files_removed": s.files_removed, "errors_resolved": resolved}

    def _answer(self, details: list[dict], s: Any, found: int = 0) -> dict[str, Any]:
        out = {"files_found": found, "files_indexed": 0, "files_skipped": 0, "files_errored": 0, "total_chunks": 0, "details": details}
        if s is not None:
            out |= {k: s[k] for k in ("files_indexed", "files_skipped", "files_errored", "total_chunks")}
            if found > catalog.DETAILS:
                out["note"] = f"{found} results; only errors are listed"
        return out

    # Questions

    def _known(self, path: str) -> None:
        if not self.store.read("files").where(F.col("path") == path).head(1):
            raise FileNotIndexed(path)

    def search(self, query: str, path: str | None = None, limit: int = 10, scoped: bool = False) -> DataFrame:
        params.Search(query, path, limit)
        index = self.store.read("postings"), self.store.read("corpus")
        return catalog.parsed(hybrid.search(self.store.read("vectors"), self.store.read("chunks"), self.store.read("files"), query, self.embedder.query(query), limit, path, scoped=scoped, unique=True, index=index))

    def similar(self, file_path: str, limit: int = 10) -> DataFrame:
        params.Similar(file_path, limit)
        self._known(file_path)
        return hybrid.similar(self.store.read("vectors"), self.store.read("chunks"), self.store.read("files"), file_path, limit, unique=True)

    def status(self) -> DataFrame:
        return catalog.status(self.store.read("files"), self._runs()).withColumn("embedding_model", F.lit(self.config.embedding_model)).withColumn("root", F.lit(self.config.root))

    def list_files(self, path: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        params.Listing(path, limit, offset)
        return catalog.list_files(self.store.read("files"), path, limit, offset)

    def log(self, limit: int = 20) -> DataFrame:
        params.whole("limit", limit, 1, params.LIST_MAX)
        return catalog.log(self._runs(), limit)

    def get_chunks(self, file_path: str, limit: int = 50) -> DataFrame:
        params.Chunks(file_path, limit)
        self._known(file_path)
        return catalog.parsed(catalog.get_chunks(self.store.read("chunks"), self.store.read("files"), file_path, limit))

    def quality(self, path: str | None = None, show_resolved: bool = False, limit: int = 100) -> dict[str, Any]:
        params.Quality(path, show_resolved, limit)
        log = self.store.read("errors")
        total = catalog.quality(log, path).head()
        return {"total": total.total, "resolved": total.resolved, "unresolved": total.unresolved, "by_type": {r.error_type: r.n for r in catalog.quality_by_type(log, path).toLocalIterator()}, "errors": catalog.errors(log, None if show_resolved else False, path, limit)}


def index_all(spark: SparkSession, config: Config) -> list[str]:
    """Indexes all configured directories; one line of report for each."""
    out, index = [], Index(spark, config)
    for path in config.paths:
        if not os.path.isdir(path):
            out.append(f"{path}: not a directory, skipped")
            continue
        r = index.index(path)
        out.append(f"{path}: {r['files_indexed']} indexed, {r['files_skipped']} skipped, {r['files_errored']} failed, {r['total_chunks']} chunks")
    return out
