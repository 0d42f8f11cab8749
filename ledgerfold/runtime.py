"""Session-level services: shared work folders, small atomic files, column names."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors share, for checkpoints, state and written tables.

    It is the one named by ``spark.checkpoint.dir``. Only a session on a single
    machine (master ``local`` or ``local[...]``) may leave that unset, as tests do;
    it gets a temporary folder. On a cluster an unset folder is an error, since a
    machine-local path would lose data with the machine.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="ledgerfold-")
    return _OWN_ROOT[app]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below :func:`shared_root`. It stays while results may be read from it; see :func:`clear_work`."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_work(spark: SparkSession) -> None:
    """Delete the work folders that this session made; results that were not written elsewhere can't be read after it."""
    files = SharedFiles(spark)
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        files.delete(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    The written copy outlives any executor, so work after it survives the loss
    of the machines that made it.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SharedFiles:
    """Small files on whatever file system a path names, through Hadoop's API."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_file(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read_json(self, path: str):
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit_json(self, path: str, value) -> None:
        """Write ``value`` so that readers see all of it or nothing: a hidden file, then a rename."""
        fs, p = self._at(path)
        hidden = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(hidden, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if not fs.rename(hidden, p):
            fs.delete(hidden, False)
            raise FileExistsError(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
