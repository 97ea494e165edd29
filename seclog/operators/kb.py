"""Knowledge base: indexing (dedup by content hash, overlapping chunks, upsert,
delete, file listing, index report), query preparation and exact top-k search.

The KB is a table ``id, content, embedding, file_id, chunk_index,
content_hash, source``, kept as numbered versions in hash buckets of ``file_id``
(``KbStore``), so a ``file_id`` filter reads one bucket and a change rewrites only the buckets it touches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .. import rules
from ..session import cut_lineage
from ..functions.text import chunk_id, content_hash
from .chunking import chunk_text
from .funnel import extract_iocs

KB_COLUMNS = ["id", "content", "embedding", "file_id", "chunk_index", "content_hash", "source"]


# ---------------------------------------------------------------- indexing

def hash_files(files: DataFrame, content_col: str = "content") -> DataFrame:
    return files.withColumn("content_hash", content_hash(F.col(content_col)))


def kb_new_keys(files: DataFrame, existing: DataFrame | None = None, order: str = "file_order") -> DataFrame:
    """``content_hash`` and ``order`` of the files to index: non-empty, first of their content hash in ``order`` and
    not already present in ``existing``.

    Only hashes and keys are shuffled. First-per-hash is an aggregate (``min(order)``), so a hash that a third of
    all files share is collapsed on the map side.
    """
    h = hash_files(files).where(F.length("content") > 0).select("content_hash", order)
    winners = h.groupBy("content_hash").agg(F.min(order).alias(order))
    if existing is not None:
        winners = winners.join(existing.select("content_hash").distinct(), "content_hash", "left_anti")
    return winners


def kb_new_docs(files: DataFrame, existing: DataFrame | None = None, order: str = "file_order") -> DataFrame:
    """The rows of ``files`` that :func:`kb_new_keys` names, with their ``content_hash``. Texts are hashed once (the keys are
    written) and joined last."""
    return files.join(cut_lineage(kb_new_keys(files, existing, order)), order)


def kb_chunks(
    new_files: DataFrame,
    size: int = rules.KB_CHUNK_SIZE,
    overlap: int = rules.KB_CHUNK_OVERLAP,
    embed: Callable[[Column], Column] | None = None,
    order: str = "file_order",
) -> DataFrame:
    """Overlapping chunks with ids ``{file_id}_chunk_{i}`` and metadata.

    ``embed`` is the text→vector hook (e.g. a caller's Arrow ``pandas_udf``);
    without one the embedding stays null and vectors are joined in later.
    """
    ch = chunk_text(
        new_files,
        text_col="content",
        keys=(order, "file_id", "source", "content_hash"),
        size=size,
        overlap=overlap,
        out="content",
        index="chunk_index",
    )
    emb = embed(F.col("content")) if embed is not None else F.lit(None).cast("array<float>")
    return ch.select(
        chunk_id(F.col("file_id"), F.col("chunk_index")).alias("id"),
        "content",
        emb.alias("embedding"),
        "file_id",
        "chunk_index",
        "content_hash",
        "source",
        order,
    )


def embed_in_batches(make: Callable[[], Callable[[list[str]], list[list[float]]]], size: int = rules.EMBED_BATCH) -> Callable[[Column], Column]:
    """An ``embed`` function from one that takes texts in batches: ``make()`` runs once in a task (to load a model or open a
    client) and what it returns is called with at most ``size`` texts at a time. Null texts have no vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for texts in batches:
            some = texts[texts.notna()]
            vectors = [v for i in range(0, len(some), size) for v in embed(some.iloc[i : i + size].tolist())]
            yield pd.Series(vectors, index=some.index, dtype=object).reindex(texts.index).where(texts.notna(), None)

    return run


def kb_upsert(
    existing: DataFrame | None, new_chunks: DataFrame, order: str = "file_order", replace: bool = False
) -> DataFrame:
    """Upsert by ``id``: the last write of an id wins (in ``order``), untouched
    ids of ``existing`` stay. ``replace=True`` first drops every existing
    chunk of the re-indexed ``file_id``s (no stale tail chunks).

    Last-write-wins is found on ids and orders alone (a hash aggregate if ``order`` is a number); the texts are joined to
    the winners. The merge with ``existing`` is an anti-join on ``id`` plus a union.
    """
    last = new_chunks.groupBy(F.col("id").alias("_id")).agg(F.max(order).alias("_order"))
    new = new_chunks.join(last, (F.col("id") == F.col("_id")) & (F.col(order) == F.col("_order"))).select(*KB_COLUMNS)
    if existing is None:
        return new
    keep = existing.join(last.select(F.col("_id").alias("id")), "id", "left_anti")
    if replace:
        keep = keep.join(new_chunks.select("file_id").distinct(), "file_id", "left_anti")
    return keep.select(*KB_COLUMNS).unionByName(new)


def kb_delete(kb: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Remove every chunk of the given ``file_id`` values."""
    return kb.join(file_ids.select("file_id").distinct(), "file_id", "left_anti").select(*kb.columns)


def kb_files(kb: DataFrame) -> DataFrame:
    """Indexed files: chunk count, and source / content hash of the first chunk, joined to the file's least index."""
    fid = F.coalesce(F.col("file_id"), F.lit("unknown"))
    rows = kb.select(fid.alias("file_id"), "chunk_index", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("content_hash", F.lit("")).alias("content_hash"))
    found = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk_index").alias("_first"))
    first = rows.select(F.col("file_id").alias("_f"), F.col("chunk_index").alias("_i"), "source", "content_hash").distinct()
    return found.join(first, (F.col("file_id") == F.col("_f")) & (F.col("_first") == F.col("_i"))).select("file_id", "chunks", "source", "content_hash")


def kb_index_report(
    files: DataFrame,
    new_chunks: DataFrame,
    existing: DataFrame | None = None,
    order: str = "file_order",
) -> DataFrame:
    """One row per input file: success (chunk count), skipped (duplicate content,
    with the file_id holding it) or error (nothing to chunk)."""
    # the texts themselves are not joined
    h = hash_files(files).select(order, "file_id", "content_hash", (F.length("content") == 0).alias("empty"))
    counts = new_chunks.groupBy(order).agg(F.count(F.lit(1)).alias("chunks"))
    holders = new_chunks.groupBy("content_hash").agg(F.min_by("file_id", F.col(order)).alias("holder"))
    if existing is not None:
        old = existing.groupBy("content_hash").agg(F.min("file_id").alias("old_holder"))
        holders = holders.join(old, "content_hash", "full_outer").select(
            "content_hash", F.coalesce("old_holder", "holder").alias("holder")
        )
    r = h.join(counts, order, "left").join(holders, "content_hash", "left")
    status = (
        F.when(F.col("empty"), F.lit("error"))
        .when(F.col("chunks").isNotNull(), F.lit("success"))
        .otherwise(F.lit("skipped"))
    )
    return r.select(
        order,
        status.alias("status"),
        F.when(status == "skipped", F.coalesce("holder", F.lit("unknown"))).otherwise(F.col("file_id")).alias("file_id"),
        F.coalesce(F.col("chunks"), F.lit(0)).cast("long").alias("chunks"),
        "content_hash",
        F.when(status == "skipped", F.lit("duplicate content"))
        .when(status == "error", F.lit("No chunks generated"))
        .alias("reason"),
    )


KB_BUCKETS = 64


def _bucket(file_id: Column) -> Column:
    return F.pmod(F.xxhash64(file_id), F.lit(KB_BUCKETS)).cast("int")


KB_SCHEMA = "id string, content string, embedding array<float>, file_id string, chunk_index int, content_hash string, source string"


class KbConflict(RuntimeError):
    """Another writer has published the version first."""


class KbStore:
    """A knowledge base as numbered versions under a folder that all executors share.

    ``versions/N.json`` is the manifest of version N: for each hash bucket of ``file_id`` (at most ``KB_BUCKETS``) the folder with
    its rows. A write puts the rows of the buckets it touches into a new folder and then publishes a manifest
    that names it and, for all other buckets, the folders of the version before: these files are the same. The manifest appears
    by a rename that fails if there is one of that number, which is the switch: readers see the old version or the new
    one, a write that fails leaves the old one, and of two writers one gets :class:`KbConflict`.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- files, through Hadoop's own interface so that any store works

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/versions") if n.endswith(".json"))

    def current(self) -> int:
        """The newest version's number; 0 if there is none."""
        return max(self.versions(), default=0)

    def buckets(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that holds rows (a bounded number of them)."""
        version = self.current() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0]
        return {int(b): folder for b, folder in json.loads(text)["buckets"].items()}

    def _publish(self, base: int, buckets: dict[int, str]) -> int:
        new = self.spark._jvm.org.apache.hadoop.fs
        fs, temp = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.path}/versions/{base + 1}.json")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps({"version": base + 1, "buckets": buckets}).encode()))
        out.close()
        try:
            if fs.exists(final):
                raise KbConflict(f"version {base + 1} exists already")
            context = new.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            context.rename(temp, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise KbConflict(f"version {base + 1} exists already") from e
            raise
        finally:
            fs.delete(temp, False)
        return base + 1

    def _write(self, rows: DataFrame, base: int, touched: set[int]) -> int:
        """Publishes ``rows`` as the whole content of the ``touched`` buckets."""
        folder = f"data/{uuid.uuid4().hex}"
        bucketed = rows.select(*KB_COLUMNS, _bucket(F.col("file_id")).alias("bucket"))
        bucketed.repartition(max(1, len(touched)), "bucket").sortWithinPartitions("bucket", "file_id").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        kept = {b: f for b, f in self.buckets(base).items() if b not in touched}
        new = {int(n.split("=")[1]): f"{folder}/{n}" for n in self._names(f"{self.path}/{folder}") if n.startswith("bucket=")}
        return self._publish(base, kept | new)

    def _rows(self, base: int, touched: set[int]) -> DataFrame:
        return self._read({b: f for b, f in self.buckets(base).items() if b in touched})

    def _read(self, buckets: dict[int, str]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], KB_SCHEMA)
        return self.spark.read.schema(KB_SCHEMA).parquet(*[f"{self.path}/{f}" for _, f in sorted(buckets.items())])

    def _touched(self, file_ids: DataFrame) -> set[int]:
        return {r[0] for r in file_ids.select(_bucket(F.col("file_id"))).distinct().collect()}  # KB_BUCKETS numbers at most

    # -- what users call

    def read(self, version: int | None = None, file_id: str | None = None, with_embedding: bool = True) -> DataFrame:
        """Rows of a version (the newest by default). With ``file_id`` only its bucket is read; without embeddings their column
        is not."""
        buckets = self.buckets(version)
        if file_id is not None:
            own = self.spark.range(1).select(_bucket(F.lit(file_id))).first()[0]
            buckets = {b: f for b, f in buckets.items() if b == own}
        rows = self._read(buckets)
        rows = rows if file_id is None else rows.where(F.col("file_id") == file_id)
        return rows.select(*[c for c in KB_COLUMNS if with_embedding or c != "embedding"])

    def upsert(self, new_chunks: DataFrame, order: str = "file_order", replace: bool = False) -> int:
        """A version with these chunks upserted (see :func:`kb_upsert`); returns its number. An id belongs to one ``file_id``, so
        only the buckets of the new chunks' files are read and written."""
        base, touched = self.current(), self._touched(new_chunks)
        return self._write(kb_upsert(self._rows(base, touched), new_chunks, order, replace), base, touched) if touched else base

    def delete(self, file_ids: DataFrame) -> int:
        """A version without the chunks of these files; returns its number."""
        base = self.current()
        touched = self._touched(file_ids) & set(self.buckets(base))
        return self._write(kb_delete(self._rows(base, touched), file_ids), base, touched) if touched else base

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the newest ``keep`` versions and the folders that none of these names; returns how many
        folders went. Not for use while another session writes."""
        kept = self.versions()[-keep:]
        used = {f.split("/")[1] for v in kept for f in self.buckets(v).values()}
        for v in self.versions()[:-keep]:
            fs, p = self._fs(f"{self.path}/versions/{v}.json")
            fs.delete(p, False)
        gone = [n for n in self._names(f"{self.path}/data") if n not in used]
        for n in gone:
            fs, p = self._fs(f"{self.path}/data/{n}")
            fs.delete(p, True)
        return len(gone)


def write_kb(table: DataFrame, base_path: str) -> str:
    """A table as the first version of a new store below ``base_path``; returns the store's path."""
    path = f"{base_path.rstrip('/')}/kb-{uuid.uuid4().hex}"
    KbStore(table.sparkSession, path)._write(table, 0, set(range(KB_BUCKETS)))
    return path


def read_kb(spark, path: str, file_id: str | None = None, with_embedding: bool = True) -> DataFrame:
    """The newest version of a store: see :meth:`KbStore.read`."""
    return KbStore(spark, path).read(None, file_id, with_embedding)


# ---------------------------------------------------------------- querying

def enhance_query(df: DataFrame, query_col: str = "kb_query", out: str = "enhanced_query") -> DataFrame:
    """Query enhancement: blank → ''; with indicators → their first three values
    plus the IOC suffix; without any SOC word → query plus the plain suffix."""
    q = F.col(query_col)
    x = extract_iocs(df, text_col=query_col, out="_q_iocs")
    vals = F.slice(F.transform(F.col("_q_iocs"), lambda i: i["value"]), 1, rules.ENHANCE_IOC_VALUES)
    low = F.lower(q)
    has_kw = F.lit(False)
    for k in rules.SOC_QUERY_KEYWORDS:
        has_kw = has_kw | low.contains(k.lower())
    blank = q.isNull() | q.rlike(r"(?U)^\s*\z")
    enhanced = (
        F.when(blank, F.lit(""))
        .when(F.size("_q_iocs") > 0, F.concat(F.array_join(vals, " "), F.lit(" " + rules.ENHANCE_IOC_SUFFIX)))
        .when(~has_kw, F.concat(q, F.lit(" " + rules.ENHANCE_PLAIN_SUFFIX)))
        .otherwise(q)
    )
    return x.withColumn(out, enhanced).drop("_q_iocs")


#: Distances that numpy holds at a time: a slice of queries by a block of chunks that stays in a core's cache.
_SLICE = 1 << 17


def _block_topk(k: int):
    def run(qdf: pd.DataFrame, kdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", "id", "file_id", "distance"]
        if qdf.empty or kdf.empty:
            return pd.DataFrame({c: [] for c in cols})
        # by id, so that ties in distance are in the order of places
        kdf = kdf.iloc[np.argsort(kdf["id"].to_numpy(), kind="stable")]
        qv = np.stack(qdf["vector"].to_numpy()).astype(np.float64)
        kv = np.stack(kdf["embedding"].to_numpy()).astype(np.float64)
        qn = np.linalg.norm(qv, axis=1)
        kn = np.linalg.norm(kv, axis=1)
        kk = min(k, len(kv))
        step = max(1, _SLICE // len(kv))
        rows, places, dists = [], [], []
        for at in range(0, len(qv), step):
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = 1.0 - (qv[at : at + step] @ kv.T) / np.outer(qn[at : at + step], kn)
            # candidates: everything not beyond the k-th smallest rounded distance; no number comes last
            kth = np.partition(dist, kk - 1, axis=1)[:, kk - 1]
            row, place = np.nonzero(~(dist > (kth + 2e-6)[:, None]))
            d = dist[row, place]
            order = np.lexsort((place, np.round(d, 6), row))
            row = row[order]
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < kk]
            rows.append(np.repeat(np.arange(at, at + len(dist)), kk))
            places.append(place[order])
            dists.append(d[order])
        place = np.concatenate(places)
        out = [qdf["query_id"].to_numpy()[np.concatenate(rows)], kdf["id"].to_numpy()[place], [kdf["file_id"].iat[0]] * len(place), np.concatenate(dists)]
        return pd.DataFrame(dict(zip(cols, out)))

    return run


def kb_topk(
    queries: DataFrame,
    kb: DataFrame,
    k: int = rules.KB_TOP_K,
    block_rows: int = 2048,
    default_file_id: str = rules.KB_DEFAULT_FILE_ID,
    cell_rows: int = 2048,
) -> DataFrame:
    """Exact cosine top-k of each query among the KB chunks of its ``file_id``.

    ``queries``: ``query_id, file_id, vector``; ``kb``: ``id, file_id, embedding``.
    The chunks of a file are cut into cells by the nearest of its pivots (one chunk in ``cell_rows``, drawn by a hash of ids, at
    most ``MAX_PIVOTS`` in all). A query is first compared with the cell it falls into; the k-th distance found there
    leaves only cells that can hold a chunk as near (see :func:`_cells_within`), and it is compared with these: exact. Vectors
    whose directions have many dimensions let few cells be left out, then every chunk is compared. Of equal vectors the k with the least ids stand for all.
    A comparison is a blocked nested-loop join: chunks and queries of a cell are cut
    into hash blocks of about ``block_rows``; each (chunk block, query block)
    pair meets in one cogroup task, where numpy scores the block and keeps
    only the k best per query. No pair is ever emitted as a row; the final
    top-k merges ≤ k candidates per block. Order: distance rounded to 6
    digits, then id, within each (query, file). A null text ``file_id`` is the default file; a row
    without a vector is no query and no hit (a blank query has none). Returns ``query_id, rank, id, file_id, distance``.
    """
    queries, kb = _comparable(queries, kb, default_file_id)
    pivots = _pivots(kb, cell_rows)
    same = Window.partitionBy("file_id", "embedding").orderBy("id")
    kb = kb.withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= k).select("id", "file_id", "embedding")
    if not pivots:
        return _ranked(_block_hits(queries, kb, ["file_id"], k, block_rows), k)
    placed = cut_lineage(kb.select("*", _cell_of(pivots)("file_id", "embedding").alias("_at")).select("id", "file_id", "embedding", "_at.cell", "_at.away"))
    sizes = placed.where(F.col("file_id").isin(list(pivots))).groupBy("file_id", "cell").agg(F.count(F.lit(1)), F.max("away")).collect()  # a row for each pivot
    placed, on = placed.drop("away"), ["file_id", "cell"]
    own, others = _cells_of_query(pivots, sizes, k)
    # read for the limits and for the result
    first = cut_lineage(_block_hits(queries.select("*", own("file_id", "vector").alias("cell")), placed, on, k, block_rows))
    kth = _ranked(first, k).groupBy(F.col("query_id").alias("_q"), F.col("file_id").alias("_f")).agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("_kth"))
    known = queries.join(kth, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("file_id") == F.col("_f")), "left")
    limit = F.nanvl(F.coalesce("_kth", F.lit(float("inf"))), F.lit(float("inf")))
    more = known.select("query_id", "file_id", "vector", F.explode(others("file_id", "vector", limit)).alias("cell"))
    return _ranked(first.unionByName(_block_hits(more, placed, on, k, block_rows)), k)


#: Pivots of all files together, and the bytes of their vectors (they go to every task).
MAX_PIVOTS, _PIVOT_BYTES = 4096, 16 << 20
#: The cell of vectors without a direction (zero, or with entries that are no numbers).
_NO_CELL = -1


def _units(vectors: pd.Series) -> np.ndarray:
    """The vectors at length one; rows that are no numbers for those without a direction."""
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
    u[~np.isfinite(u).all(axis=1)] = np.nan
    return u


def _pivots(kb: DataFrame, cell_rows: int) -> dict:
    """``file_id`` → unit vectors of its pivots, for the files with two or more (a bounded number of rows)."""
    every = max(cell_rows, -(-kb.count() // MAX_PIVOTS))
    drawn = kb.where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(every)) == 0).select("file_id", "embedding").limit(2 * MAX_PIVOTS).toPandas()
    if drawn.empty:
        return {}
    drawn = drawn[: max(2, _PIVOT_BYTES // (8 * max(1, len(drawn["embedding"].iat[0]))))]
    units = {f: _units(rows) for f, rows in drawn.groupby("file_id")["embedding"]}
    units = {f.item() if isinstance(f, np.generic) else f: np.unique(u[~np.isnan(u).any(axis=1)], axis=0) for f, u in units.items()}
    return {f: u for f, u in units.items() if len(u) > 1}


def _by_file(files: pd.Series, units: np.ndarray, pivots: dict) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """``file_id``, places of a few rows, and their squared straight-line distances to the file's pivots; rows without a direction or pivots are
    left out."""
    has = ~np.isnan(units).any(axis=1)
    for f, at in pd.Series(np.arange(len(files))).groupby(files.to_numpy()):
        if f in pivots:
            at = at.to_numpy()[has[at.to_numpy()]]
            step = max(1, _SLICE // len(pivots[f]))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                yield f, some, np.maximum(2.0 - 2.0 * (units[some] @ pivots[f].T), 0.0)


def _cell_of(pivots: dict):
    """(file_id, vector) → the cell of the nearest pivot (0 in a file without pivots) and the distance to it."""

    @F.pandas_udf("cell int, away double")
    def run(files: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        cells, away = np.where(files.isin(list(pivots)), _NO_CELL, 0), np.zeros(len(files))
        if pivots and len(files):
            for _, at, d2 in _by_file(files, _units(vectors), pivots):
                cells[at] = d2.argmin(axis=1)
                away[at] = np.sqrt(d2.min(axis=1))
        return pd.DataFrame({"cell": cells.astype(np.int32), "away": away})

    return run


def _cells_of_query(pivots: dict, sizes: list, k: int):
    """Two functions: (file_id, vector) → the query's own cell, that of the nearest pivot with ``k`` vectors or more; and (file_id, vector, distance)
    → the other cells in which a vector within this distance can be.

    On the unit sphere a distance ``d`` is a straight line of ``sqrt(2 d)``. A vector of another cell is at most ``far`` from its
    pivot, and not nearer to the own cell's pivot: it lies beyond the plane half way between the two.
    """
    count, far, odd = ({f: np.zeros(len(u)) for f, u in pivots.items()} for _ in range(3))
    for f, c, n, away in sizes:
        if c == _NO_CELL:
            odd[f][:] = n
        else:
            count[f][c], far[f][c] = n, away

    def nearest(f, d2: np.ndarray) -> np.ndarray:
        full = count[f] >= k
        return np.where(full, d2, np.inf).argmin(axis=1) if full.any() else d2.argmin(axis=1)

    @F.pandas_udf("int")
    def own(files: pd.Series, vectors: pd.Series) -> pd.Series:
        cells = np.where(files.isin(list(pivots)), _NO_CELL, 0)
        for f, at, d2 in _by_file(files, _units(vectors), pivots) if len(files) else ():
            cells[at] = nearest(f, d2)
        return pd.Series(cells.astype(np.int32))

    @F.pandas_udf("array<int>")
    def others(files: pd.Series, vectors: pd.Series, limits: pd.Series) -> pd.Series:
        # a query without a direction is as far from every vector: all cells but its own
        out = [np.flatnonzero(count[f]).astype(np.int32) if f in pivots else np.empty(0, np.int32) for f in files]
        # room for ties in the rounded distance and for rounding here
        reach = np.sqrt(2.0 * (limits.to_numpy(np.float64) + 2e-6)) + 1e-6
        for f, at, d2 in _by_file(files, _units(vectors), pivots) if len(files) else ():
            mine = nearest(f, d2)
            gap = np.sqrt(np.maximum(2.0 - 2.0 * (pivots[f][mine] @ pivots[f].T), 0.0))
            plane = np.where(gap > 1e-4, (d2 - d2[np.arange(len(at)), mine][:, None]) / np.maximum(2.0 * gap, 1e-4), 0.0)
            within = (np.maximum(plane, np.sqrt(d2) - far[f]) <= reach[at][:, None]) & (count[f] > 0)
            within[np.arange(len(at)), mine] = False
            for i, row in zip(at, within):
                rest = [_NO_CELL] if reach[i] == np.inf and odd[f].any() else []
                out[i] = np.append(np.flatnonzero(row), rest).astype(np.int32)
        return pd.Series(out)

    return own, others


def _comparable(queries: DataFrame, kb: DataFrame, default_file_id: str) -> tuple[DataFrame, DataFrame]:
    """Queries and chunks that have a vector, under their file's name."""
    # fresh attribute ids: the query set may be derived from the KB itself
    of = F.col("file_id")
    if isinstance(kb.schema["file_id"].dataType, StringType):
        of = F.coalesce(of, F.lit(default_file_id))
    kb = kb.select(F.col("id").alias("id"), of.alias("file_id"), F.col("embedding").alias("embedding")).where("embedding is not null").alias("kb")
    queries = queries.select(F.col("query_id").alias("query_id"), of.alias("file_id"), F.col("vector").alias("vector")).where("vector is not null").alias("qs")
    return queries, kb


def _block_hits(queries: DataFrame, kb: DataFrame, on: list[str], k: int, block_rows: int) -> DataFrame:
    """``query_id, id, file_id, distance``: the k best of each query in each block of the chunks that share ``on`` with it."""
    kbn = kb.groupBy(*on).agg(F.count(F.lit(1)).alias("n_kb"))
    qn = queries.groupBy(*on).agg(F.count(F.lit(1)).alias("n_q"))
    sizes = kbn.join(qn, on).select(*on, F.ceil(F.col("n_kb") / block_rows).cast("int").alias("nk"), F.ceil(F.col("n_q") / block_rows).cast("int").alias("nq"))
    kb_b = kb.join(sizes, on).select(
        "id", "embedding", *on, F.pmod(F.xxhash64("id"), F.col("nk")).cast("int").alias("kblock"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qblock")
    )
    q_b = queries.join(sizes, on).select(
        "query_id", "vector", *on, F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("qblock"), F.explode(F.sequence(F.lit(0), F.col("nk") - 1)).alias("kblock")
    )
    kinds = [("query_id", queries.schema["query_id"].dataType), ("id", kb.schema["id"].dataType), ("file_id", kb.schema["file_id"].dataType), ("distance", DoubleType())]
    schema = StructType([StructField(n, t) for n, t in kinds])
    at = [*on, "kblock", "qblock"]
    return q_b.groupBy(*at).cogroup(kb_b.groupBy(*at)).applyInPandas(_block_topk(k), schema)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "file_id").orderBy(F.round("distance", 6), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "file_id", "distance")


def hyperplane_codes(vector: Column, dims: int, tables: int, bits: int, seed: int = 0) -> Column:
    """``array<int>``: for each table the signs of ``bits`` random projections (lengths do not count), numbered apart by table."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dims))
    place = 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def codes(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        above = np.stack(vectors.to_numpy()).astype(np.float64) @ planes.T > 0
        return pd.Series(list((above.reshape(-1, tables, bits) * place).sum(axis=2) + np.arange(tables) * (1 << bits)))

    return codes(vector)


def kb_topk_lsh(
    queries: DataFrame,
    kb: DataFrame,
    dims: int,
    k: int = rules.KB_TOP_K,
    tables: int = 10,
    bits: int = 3,
    block_rows: int = 2048,
    default_file_id: str = rules.KB_DEFAULT_FILE_ID,
    seed: int = 0,
) -> DataFrame:
    """Approximate :func:`kb_topk`: only chunks that share a bucket with the query in some table are compared, by their exact
    distances; distances and ranks of what is found are exact.

    A bucket is the signs of ``bits`` random hyperplanes within a file: two vectors at an angle of ``a`` degrees agree in a
    table with probability ``(1 - a / 180) ** bits``. More bits compare fewer chunks, more tables find more. Each vector is
    sent once for each table, never once for each block of queries; a bucket with more than ``block_rows`` is cut into blocks, so
    no task's memory grows with a hot one. ``dims``: the length of all vectors.
    """
    queries, kb = _comparable(queries, kb, default_file_id)
    by = lambda df, vector: df.withColumn("code", F.explode(hyperplane_codes(F.col(vector), dims, tables, bits, seed)))
    hits = _block_hits(by(queries, "vector"), by(kb, "embedding"), ["file_id", "code"], k, block_rows)
    return _ranked(hits.groupBy("query_id", "id", "file_id").agg(F.min("distance").alias("distance")), k)
