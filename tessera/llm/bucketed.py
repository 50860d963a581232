"""A pair of tables rewritten as co-bucketed sorted files: one Parquet file for each table and bucket.

A folder holds each table as numbered files, written by ``write_numbered``: ``repartitionById`` sends rows directly to the
partition of their file, ``sortWithinPartitions`` orders them by all columns, and each nonempty partition becomes one file.
``rewrite_pair`` brings such a folder into bucket layout:

1. Semi and anti joins with the parents' keys tell the children's orphans; two numbers beyond the buckets take orphans and
   rows of a null key. What moves from which file to which bucket is counted on the key column alone.
2. A file that is already exactly one bucket stays as it is. The rows of all others are joined again whole, sent to their
   buckets and written; then the old files go. Old files are removed only after the new ones are committed.
3. The final files are read back: digests of the keys in file order, and where each file's rows came from.

Both tables keep a child's bucket next to its parent's, so a join of the two on the key needs no shuffle of rows between buckets.
Joins are sort-merge joins that AQE splits where a key is hot; nothing that grows with the input is broadcast or sent to the driver,
which sees at most one row for each file. A hot bucket is one file, sorted with spilling and written by one task, as a stream.

Rows are sorted by the key descending, then by the other columns from left to right ascending, nulls first, strings by their UTF-8
bytes; columns that Spark cannot order (maps) are not supported. Repeated rows stay. A parent row of a null key goes where the
children's null keys go. An empty table has no files. Other columns may have any names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tessera.scratch import materialize

BUCKETS = 600
_NUMBER = r"part-(\d+)-"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with underscores behind it until no column has it."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def crc_bucket(value: Column, buckets: int, salt: str = "") -> Column:
    """Unsigned crc32 of ``salt`` and the decimal value, modulo ``buckets``; null stays null."""
    return (F.crc32(F.concat(F.lit(salt), value.cast("string"))) % buckets).cast("int")


def in_order(columns: list[str], key: str) -> list[Column]:
    return [quoted(key).desc_nulls_first(), *(quoted(c).asc_nulls_first() for c in columns if c != key)]


def write_numbered(rows: DataFrame, number: Column, files: int, key: str, path: str, columns: list[str] | None = None) -> None:
    """Add to the folder ``path`` one sorted file ``part-<number>-...`` of ``columns`` for each ``number`` (0 to ``files`` - 1) that has rows."""
    columns = columns or rows.columns
    (file,) = fresh(rows.columns, "file")
    dealt = rows.withColumn(file, number).repartitionById(files, file).select(*map(quoted, columns))
    before = set(_listed(rows.sparkSession, path))
    dealt.sortWithinPartitions(*in_order(columns, key)).write.mode("append").parquet(path)
    # Partition 0 writes a file even without rows.
    first = [f for f in _listed(rows.sparkSession, path) if f not in before and _number(f) == 0]
    if first and rows.sparkSession.read.parquet(f"{path}/{first[0]}").isEmpty():
        _remove(rows.sparkSession, path, first)


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Data files of a folder: as many as files were written, whatever their rows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(f.getPath().getName()) for f in (fs.listStatus(target) if fs.exists(target) else []) if f.getPath().getName().endswith(".parquet"))


def _remove(spark: SparkSession, path: str, names: list[str]) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in names:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name), False)


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as ``file:///...`` for local files."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub("^file:/(?!/)", "file:///", whole)


def _number(name: str) -> int:
    return int(re.search(_NUMBER, name)[1])


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The files that the folder has now; later ones are not seen."""
    return spark.read.schema(schema).parquet(path) if _listed(spark, path) else spark.createDataFrame([], schema)


def _numbered(spark: SparkSession, path: str, schema: StructType, name: str) -> DataFrame:
    """Rows of the folder's files with their file's number in the added column ``name``."""
    read = _read(spark, path, schema)
    number = F.regexp_extract(read.metadataColumn("_metadata")["file_name"], _NUMBER, 1).cast("int") if _listed(spark, path) else F.lit(0)
    return read.select(*map(quoted, schema.names), number.alias(name))


def placed(rows: DataFrame, key: str, parents: DataFrame | None, buckets: int, salt: str, name: str) -> DataFrame:
    """``rows`` with their bucket in the added column ``name``: by the key, or for children whose key no row of ``parents`` has ``buckets``; for null one more."""
    own, none = crc_bucket(quoted(key), buckets, salt), F.lit(buckets + 1)
    columns = [*map(quoted, rows.columns), quoted(name)]
    if parents is None:
        return rows.withColumn(name, F.coalesce(own, none)).select(*columns)
    known, keyed = parents.select(quoted(key)).where(quoted(key).isNotNull()).hint("merge"), rows.where(quoted(key).isNotNull())
    found = keyed.join(known, key, "left_semi").withColumn(name, own)
    orphans = keyed.join(known, key, "left_anti").withColumn(name, F.lit(buckets))
    nulls = rows.where(quoted(key).isNull()).withColumn(name, none)
    return found.select(*columns).unionByName(orphans.select(*columns)).unionByName(nulls.select(*columns))


def rewrite_pair(spark: SparkSession, path: str, parent: str, child: str, schemas: dict[str, StructType], key: str, buckets: int = BUCKETS, salt: str = "") -> DataFrame:
    """Rewrite the numbered files in ``path``/``parent`` and ``path``/``child`` into buckets of ``key``.

    Returns one row for each final file: table_name, path, columns (comma-joined), bucket, n_rows, ids_sha256 (of the keys in the file's
    order), lineage_sha256 (of ``<old file's number>:<rows from it>``, ascending), n_joined (rows of the bucket's inner join on the
    key; 0 for orphans and nulls), rewritten (false for a file that stayed).
    """
    folders = {name: f"{path}/{name}" for name in (parent, child)}
    old = {name: _listed(spark, folder) for name, folder in folders.items()}
    number, bucket = fresh([c for s in schemas.values() for c in s.names], "came_from", "bucket")
    rows = {name: _numbered(spark, folders[name], schemas[name], number) for name in folders}
    sides = {parent: None, child: rows[parent]}

    counts = []
    for name in folders:
        keys = placed(rows[name].select(quoted(key), number), key, sides[name], buckets, salt, bucket)
        counts.append(keys.groupBy(number, bucket).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.col(number).alias("came_from"), F.col(bucket).alias("bucket"), "n"))
    moves = materialize(counts[0].unionByName(counts[1]), "moves")  # at most files x buckets
    from_one = moves.groupBy("table_name", "came_from").agg(F.count("*").alias("to"), F.min("bucket").alias("bucket")).where("to = 1")
    into_one = moves.groupBy("table_name", "bucket").agg(F.count("*").alias("of"), F.min("came_from").alias("came_from")).where("of = 1")
    stay = {(r.table_name, r.came_from): r.bucket for r in from_one.join(into_one, ["table_name", "came_from", "bucket"]).collect()}  # at most one row a file

    final = [(name, f, stay[name, _number(f)], False) for name in folders for f in old[name] if (name, _number(f)) in stay]
    gone = {name: [f for f in old[name] if (name, _number(f)) not in stay] for name in folders}
    for name, folder in folders.items():
        if gone[name]:
            left = [_number(f) for f in old[name] if f not in set(gone[name])]
            moving = rows[name].where(~F.col(number).isin(left)) if left else rows[name]
            write_numbered(placed(moving.drop(number), key, sides[name], buckets, salt, bucket), quoted(bucket), buckets + 2, key, folder, schemas[name].names)
            final += [(name, f, _number(f), True) for f in _listed(spark, folder) if f not in set(old[name])]
    joined = _joined(rows[parent], rows[child], key, buckets, salt)
    joined = materialize(joined, "joined")  # at most one row a bucket
    for name, folder in folders.items():
        _remove(spark, folder, gone[name])
    return _described(spark, folders, schemas, key, final, moves, joined)


def _joined(parents: DataFrame, children: DataFrame, key: str, buckets: int, salt: str) -> DataFrame:
    """(bucket, n_joined): rows of the inner join, from the number of rows that each key has on either side."""
    many = [side.where(quoted(key).isNotNull()).groupBy(quoted(key).alias("key")).agg(F.count("*").alias(n)) for side, n in ((parents, "p"), (children, "c"))]
    both = many[0].join(many[1].hint("merge"), "key")
    return both.groupBy(crc_bucket(F.col("key"), buckets, salt).alias("bucket")).agg(F.sum(F.col("p") * F.col("c")).alias("n_joined"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, key) in order of the file and of the rows in it -> (file, n_rows, ids_sha256), one batch of rows in memory at a time."""
    file, n, digest = None, 0, None
    out = pa.schema([("file", pa.int32()), ("n_rows", pa.int64()), ("ids_sha256", pa.string())])
    for batch in batches:
        files, keys = batch.column("file").to_numpy(), batch.column("key")
        cuts = np.flatnonzero(np.diff(files, prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if file != files[a]:
                if file is not None:
                    yield pa.RecordBatch.from_pylist([{"file": file, "n_rows": n, "ids_sha256": digest.hexdigest()}], schema=out)
                file, n, digest = int(files[a]), 0, hashlib.sha256()
            text = ",".join(keys.slice(a, b - a).fill_null("").to_pylist())
            digest.update((("," if n else "") + text).encode())
            n += b - a
    if file is not None:
        yield pa.RecordBatch.from_pylist([{"file": file, "n_rows": n, "ids_sha256": digest.hexdigest()}], schema=out)


def _described(spark: SparkSession, folders: dict, schemas: dict, key: str, final: list[tuple[str, str, int, bool]], moves: DataFrame, joined: DataFrame) -> DataFrame:
    """The result of ``rewrite_pair`` for the files ``final``: (table, file name, bucket, rewritten)."""
    at = {name: _qualified(spark, folder) for name, folder in folders.items()}
    listed = [(k, name, f"{at[name]}/{f}", ",".join(schemas[name].names), bucket, rewritten) for k, (name, f, bucket, rewritten) in enumerate(sorted(final))]
    files = spark.createDataFrame(listed, "file int, table_name string, path string, columns string, bucket long, rewritten boolean")
    names = spark.createDataFrame([(k, name, f) for k, (name, f, _, _) in enumerate(sorted(final))], "file int, table_name string, name string")
    keys = []
    for name, folder in folders.items():
        read = _read(spark, folder, schemas[name])
        if any(t == name for t, _, _, _ in final):
            meta = read.metadataColumn("_metadata")
            keys.append(read.select(F.lit(name).alias("table_name"), meta["file_name"].alias("name"), meta["row_index"].alias("at"), quoted(key).cast("string").alias("key")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if keys:
        rows = functools.reduce(DataFrame.unionByName, keys).join(F.broadcast(names), ["table_name", "name"]).select("file", "at", "key")  # names: one row a file
        dealt = rows.repartitionById(tasks, F.col("file") % tasks).sortWithinPartitions("file", "at").select("file", "key")
        digests = dealt.mapInArrow(_digests, "file int, n_rows long, ids_sha256 string")
    else:
        digests = spark.createDataFrame([], "file int, n_rows long, ids_sha256 string")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("came_from", "n"))), lambda m: F.concat_ws(":", m["came_from"].cast("string"), m["n"].cast("string")))
    lineage = moves.groupBy("table_name", F.col("bucket").cast("long").alias("bucket")).agg(F.sha2(F.array_join(parts, ","), 256).alias("lineage_sha256"))
    out = files.join(digests, "file").join(lineage, ["table_name", "bucket"]).join(joined.withColumn("bucket", F.col("bucket").cast("long")), "bucket", "left")
    return out.select("table_name", "path", "columns", "bucket", "n_rows", "ids_sha256", "lineage_sha256", F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), "rewritten")
