"""Object copy and digests (K8, digest side of V4).

The listing DataFrame is the work list: each task copies or hashes the objects
of its partition, streaming them in chunks, so no object body passes through
the driver and objects larger than a Spark row (2 GB) are fine.  File systems
are opened with ``pyarrow.fs`` (local, HDFS, S3, GCS as available).
"""

from __future__ import annotations

import hashlib
import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import is_local, on_shared_folder, qualified, scratch_path
from ..sources.files import list_objects, open_fs

CHUNK_BYTES = 8 << 20
COPY_SCHEMA = "Key string, source string, target string, bytes bigint, error string"

# the functions tasks run travel with the job: executors need not have this package
register_pickle_by_value(sys.modules[__name__])


def _spread(listing: DataFrame) -> DataFrame:
    """The listing dealt object by object: a listing has a task per folder, however many objects lie in it."""
    return listing.repartition(2 * listing.sparkSession.sparkContext.defaultParallelism)


def _chunks(stream):
    while chunk := stream.read(CHUNK_BYTES):
        yield chunk


def _md5(uri: str) -> str:
    fs, path = open_fs(uri)
    h = hashlib.md5()
    with fs.open_input_stream(path) as f:
        for chunk in _chunks(f):
            h.update(chunk)
    return h.hexdigest()


def object_digests(listing: DataFrame, path_col: str = "path",
                   digest_col: str = "ETag") -> DataFrame:
    """Add an MD5 digest of each object's bytes, computed on the executors."""
    schema = StructType(listing.schema.fields + [StructField(digest_col, StringType())])

    def digest(batches):
        for pdf in batches:
            pdf[digest_col] = [_md5(p) for p in pdf[path_col]]
            yield pdf

    return _spread(listing).mapInPandas(digest, schema)


def _copy(source: str, target: str) -> int:
    sfs, spath = open_fs(source)
    tfs, tpath = open_fs(target)
    tfs.create_dir(tpath.rsplit("/", 1)[0], recursive=True)
    n = 0
    with sfs.open_input_stream(spath) as fin, tfs.open_output_stream(tpath) as fout:
        for chunk in _chunks(fin):
            fout.write(chunk)
            n += len(chunk)
    return n


def copy_objects(listing: DataFrame, target_root: str, key_col: str = "Key",
                 path_col: str = "path") -> DataFrame:
    """Copy every listed object to ``target_root/<Key>``, now and once (K8).

    Returns one row per object: Key, source path, target path, bytes copied and
    the error, if it could not be copied (the others are copied all the same).
    The result is read from a written table, so using it copies nothing again.
    Whether the target holds the right bytes is for ``verify_copy`` to say.  On a
    cluster a ``file:`` target must lie below ``spark.checkpoint.dir`` or the
    warehouse, the folders that executors share; any other raises.
    """
    spark = listing.sparkSession
    root = qualified(spark, target_root).rstrip("/")
    if root.startswith("file:") and not is_local(spark.sparkContext.master) and not on_shared_folder(spark, root):
        raise ValueError(f"{root} is another folder on every executor; name a shared store")

    def run(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for key, src in zip(pdf[key_col], pdf[path_col]):
                n, error = None, None
                try:
                    n = _copy(src, f"{root}/{key}")
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((key, src, f"{root}/{key}", n, error))
            yield pd.DataFrame(out, columns=["Key", "source", "target", "bytes", "error"])

    path = scratch_path(spark, "copied")
    _spread(listing.select(key_col, path_col)).mapInPandas(run, COPY_SCHEMA).write.parquet(path)
    return spark.read.schema(COPY_SCHEMA).parquet(path)


def verify_copy(listing: DataFrame, target_root: str) -> DataFrame:
    """What the target really holds against what was listed (V4).

    One row per object of the listing: Key, source_digest, target_digest,
    reason (``missing_in_target``, ``digest_mismatch`` or null) and ok.  Objects
    that only the target has are none of the copy's business.
    """
    from ..operators.verify import compare_listings
    there = list_objects(listing.sparkSession, target_root).join(listing.select("Key"), "Key", "left_semi") \
        .select("Key", F.col("Size"), "path")
    return compare_listings(object_digests(listing).select("Key", "ETag"), object_digests(there).select("Key", "ETag"))
