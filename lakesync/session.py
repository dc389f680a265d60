"""Session helpers: a local builder for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "lakesync") -> SparkSession:
    """A local session configured like the cluster one (UTC, AQE, no UI)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at storage every executor can reach; it is
    read from the session, and a cluster session without it is an error.  Only
    a local session (tests) without it gets a folder of our own, created and
    registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        # a machine-local folder is not shared by the executors of a cluster
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="lakesync-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique location under the shared folder."""
    return "/".join([shared_dir(spark), "lakesync", uuid.uuid4().hex, *parts])


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` exists on its file system (one metadata call)."""
    p, fs = _hadoop_path(spark, path)
    return bool(fs.exists(p))


# up to this many paths under one parent are checked one by one; more are
# answered by one listing of the parent
_EXISTS_PER_PATH = 32


def existing_paths(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """Which of ``paths`` exist.

    A few paths under one parent cost one metadata call each (a batch that
    touches two days of a 100,000-day table does not list the table root);
    many paths under one parent cost one listing of the parent instead of a
    call per path (partition roots of one table share a parent, so a
    thousand roots cost one listing)."""
    by_parent: dict[str, list[tuple[str, object, object]]] = {}
    for raw in paths:
        p, fs = _hadoop_path(spark, raw.rstrip("/") or "/")
        q = fs.makeQualified(p)
        parent = q.getParent()
        by_parent.setdefault(str(parent) if parent is not None else "", []).append((raw, q, fs))
    out: dict[str, bool] = {}
    for parent, items in by_parent.items():
        fs = items[0][2]
        if not parent or len(items) <= _EXISTS_PER_PATH:
            out.update({raw: bool(fs.exists(q)) for raw, q, _ in items})
            continue
        jp = items[0][1].getParent()
        children = {str(st.getPath()) for st in fs.listStatus(jp)} if fs.exists(jp) else set()
        out.update({raw: str(q) in children for raw, q, _ in items})
    return out


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path`` (one listing; none if
    ``path`` does not exist)."""
    p, fs = _hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    return [str(st.getPath().getName()) for st in fs.listStatus(p) if st.isDirectory()]


def content_bytes(spark: SparkSession, path: str) -> int:
    """Bytes stored under ``path`` (one file-system metadata call)."""
    p, fs = _hadoop_path(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder this library created itself (e.g. a staged result)."""
    p, fs = _hadoop_path(spark, path)
    return bool(fs.delete(p, True))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of everything directly under ``path`` (one listing; none if it does not exist)."""
    p, fs = _hadoop_path(spark, path)
    return sorted(str(st.getPath().getName()) for st in fs.listStatus(p)) if fs.exists(p) else []


def same_store(spark: SparkSession, a: str, b: str) -> bool:
    """True if both paths lie on one file system, so that a rename moves no bytes."""
    (_, one), (_, two) = _hadoop_path(spark, a), _hadoop_path(spark, b)
    return str(one.getUri()) == str(two.getUri())


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder; the folders above ``target`` are created, ``target`` must not exist."""
    src, fs = _hadoop_path(spark, source)
    dst, _ = _hadoop_path(spark, target)
    fs.mkdirs(dst.getParent())
    if fs.exists(dst) or not fs.rename(src, dst):
        raise OSError(f"cannot move {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; it appears whole or not at all and never replaces another."""
    p, fs = _hadoop_path(spark, f"{path}.writing")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    move_path(spark, f"{path}.writing", path)


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    p, fs = _hadoop_path(spark, path)
    source = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def qualify(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, as Spark reports file paths."""
    p, fs = _hadoop_path(spark, path.rstrip("/") or "/")
    return str(fs.makeQualified(p).toString())


__all__ = ["local_session", "shared_dir", "scratch_path", "path_exists", "existing_paths", "child_folders", "content_bytes", "remove_path", "child_names", "same_store",
           "move_path", "write_text", "read_text", "qualify"]
