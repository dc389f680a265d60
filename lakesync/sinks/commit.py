"""Commits of a table: staged once, switched by renames or partition locations, and recorded.

The records lie beside the table, in ``<parent>/_lakesync/<table folder>``, which
Spark's readers skip:

* ``stage/``    the new content, written once by the job that computed it;
* ``pending/``  one record of a decided commit: what is staged, what it replaces.
  It is written after the staged content is complete and removed when
  everything is in place, so :func:`recover` finishes a commit that was cut
  short, from any point;
* ``journal/``  one record a commit, in order: kind, partition folders, schema.
  The schema of the last record is the table's schema.  Publication reads the
  records since the last published one, so it knows what to register without
  listing the table;
* ``old/``      replaced folders, kept until the commit is done.

Nothing is decided before the pending record: a run killed while it writes leaves
the table as it was.  Every step of :func:`apply` can be repeated.

A plain table keeps its hive layout; a commit renames whole partition folders (or
the whole table, for a full overwrite), one at a time.  A ``versioned`` table
moves nothing: the staged partition folders stay where they were written, in
``<table>/_versions/<number>``, and the catalog's partition locations are
switched to them.  A reader of the catalog table sees the old or the new rows of
a partition, never none and never both.
"""

from __future__ import annotations

import json
import logging
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakesync.session import child_names, move_path, path_exists, read_text, remove_path, same_store, write_text
from lakesync.spec import TableSpec

log = logging.getLogger("lakesync")
META = "_lakesync"
VERSIONS = "_versions"
# Fixed value: the folder name Spark and Hive give the null partition.
DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def meta_path(path: str, *parts: str) -> str:
    """A place in the records folder of the table at ``path``."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return "/".join([parent, META, name, *parts])


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    names = child_names(spark, meta_path(path, kind))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _record_path(path: str, kind: str, number: int) -> str:
    return meta_path(path, kind, f"{number:012d}.json")


def _record(spark: SparkSession, path: str, kind: str, number: int) -> dict:
    return json.loads(read_text(spark, _record_path(path, kind, number)))


def journal(spark: SparkSession, path: str, since: int = 0) -> list[dict]:
    """The records of the commits after number ``since``, in order."""
    return [_record(spark, path, "journal", n) for n in _numbers(spark, path, "journal") if n > since]


def recorded_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The table's schema by its last commit, None for a table without commits."""
    numbers = _numbers(spark, path, "journal")
    return T.StructType.fromJson(json.loads(_record(spark, path, "journal", numbers[-1])["schema"])) if numbers else None


def evolved(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """``old`` and the columns that ``new`` adds."""
    have = {f.name.lower() for f in old.fields} if old else set()
    return T.StructType([*(old.fields if old else []), *[f for f in new.fields if f.name.lower() not in have]])


def next_number(spark: SparkSession, path: str) -> int:
    return max([0, *_numbers(spark, path, "journal"), *_numbers(spark, path, "pending")]) + 1


def _content(names: list[str]) -> list[str]:
    return [n for n in names if not n.startswith(("_", "."))]


def partition_values(folders: list[str]) -> list[str]:
    """The partition values of folder names, as strings."""
    return [unquote(f.split("=", 1)[1]) for f in folders]


def commit(spark: SparkSession, spec: TableSpec, staged: str, schema: T.StructType, kind: str, number: int | None = None) -> dict:
    """Make the complete content staged in ``staged`` the table's; returns the journal record.

    ``kind``: ``merge`` replaces the partitions that are staged (or all of an
    unpartitioned table), ``overwrite`` the whole table, ``switch`` points the
    catalog's partitions at the staged folders."""
    number = number or next_number(spark, spec.path)
    if kind == "merge" and not spec.partition:
        kind = "overwrite"
    if kind != "switch" and not same_store(spark, staged, spec.path):
        raise ValueError(f"{staged} and {spec.path} lie on different file systems")
    record = {"number": number, "kind": kind, "staged": staged, "folders": _content(child_names(spark, staged)), "created": not path_exists(spark, spec.path),
              "partition": spec.partition, "name": spec.qualified_name if spec.table else None,
              "schema": evolved(None if kind == "overwrite" else recorded_schema(spark, spec.path), schema).json()}
    write_text(spark, _record_path(spec.path, "pending", number), json.dumps(record))
    return apply(spark, spec.path, record)


def apply(spark: SparkSession, path: str, record: dict) -> dict:
    """Put a decided commit in place; what an earlier attempt did is skipped."""
    number, staged = record["number"], record["staged"]
    old = meta_path(path, "old", str(number))
    if record["kind"] == "switch":
        record["superseded"] = _switch(spark, path, record)
    elif record["kind"] == "overwrite":
        if path_exists(spark, staged):
            if path_exists(spark, path):
                move_path(spark, path, f"{old}/table")
            move_path(spark, staged, path)
    else:
        for folder in record["folders"]:
            if path_exists(spark, f"{staged}/{folder}"):
                if path_exists(spark, f"{path}/{folder}"):
                    move_path(spark, f"{path}/{folder}", f"{old}/{folder}")
                move_path(spark, f"{staged}/{folder}", f"{path}/{folder}")
    if not path_exists(spark, _record_path(path, "journal", number)):
        write_text(spark, _record_path(path, "journal", number), json.dumps(record))
    remove_path(spark, _record_path(path, "pending", number))
    remove_path(spark, old)
    if record["kind"] != "switch":
        remove_path(spark, staged)
    return record


def recover(spark: SparkSession, path: str) -> list[int]:
    """Finish commits that were decided and cut short; their numbers."""
    numbers = _numbers(spark, path, "pending")
    for n in numbers:
        log.warning("finishing commit %s of %s", n, path)
        apply(spark, path, _record(spark, path, "pending", n))
    return numbers


# ------------------------------------------------------------- versioned tables
def version_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{VERSIONS}/{number:012d}"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def versions(spark: SparkSession, path: str) -> dict[str, str]:
    """Where each partition folder's rows lie: folder name to location, by the commits."""
    out: dict[str, str] = {}
    for record in journal(spark, path):
        out |= record.get("locations", {})
        out |= {f: f"{record['staged']}/{f}" for f in record["folders"]} if record["kind"] == "switch" else {}
    return out


def _switch(spark: SparkSession, path: str, record: dict) -> list[str]:
    """Point the catalog's partitions at the staged folders; the locations they had."""
    name = ".".join(f"`{p}`" for p in record["name"].split("."))
    before = versions(spark, path)
    for folder, value in zip(record["folders"], partition_values(record["folders"])):
        part, place = f"PARTITION (`{record['partition']}` = {_quoted(value)})", _quoted(f"{record['staged']}/{folder}")
        # two statements, so that a partition that is there and one that is not are served alike
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {part} LOCATION {place}")
        spark.sql(f"ALTER TABLE {name} {part} SET LOCATION {place}")
    spark.sql(f"REFRESH TABLE {name}")
    return [before[f] for f in record["folders"] if f in before and before[f] != f"{record['staged']}/{f}"]


def vacuum(spark: SparkSession, spec: TableSpec, keep: int = 1) -> int:
    """Remove the folders that commits before the last ``keep`` ones superseded; their number.

    The last superseded folders stay for readers that began before the switch."""
    recover(spark, spec.path)
    now, removed = set(versions(spark, spec.path).values()), 0
    records = journal(spark, spec.path)
    for record in records[:max(0, len(records) - keep)]:
        for place in record.get("superseded", []):
            if place not in now and path_exists(spark, place):
                removed += remove_path(spark, place)
    return removed


# ------------------------------------------------------------------ publication
def published_number(spark: SparkSession, path: str) -> int:
    """The last commit that the catalog knows."""
    return max([0, *_numbers(spark, path, "published")])


def unpublished(spark: SparkSession, path: str) -> list[dict]:
    return journal(spark, path, since=published_number(spark, path))


def mark_published(spark: SparkSession, path: str) -> None:
    """Note that the catalog knows all commits, and drop the records that nothing needs any more."""
    numbers = _numbers(spark, path, "journal")
    if not numbers:
        return
    last, known = numbers[-1], _numbers(spark, path, "published")
    if last not in known:
        write_text(spark, _record_path(path, "published", last), "{}")
    for n in known:
        if n < last:
            remove_path(spark, _record_path(path, "published", n))
    for n in numbers[:-1]:
        # the records of a versioned table say where its rows are
        if _record(spark, path, "journal", n)["kind"] != "switch":
            remove_path(spark, _record_path(path, "journal", n))


def journal_frame(spark: SparkSession, path: str) -> DataFrame:
    """The journal as rows: number, kind, folder."""
    rows = [(r["number"], r["kind"], f) for r in journal(spark, path) for f in r["folders"]]
    return spark.createDataFrame(rows, "number bigint, kind string, folder string")


__all__ = ["meta_path", "journal", "recorded_schema", "evolved", "next_number", "commit", "apply", "recover", "partition_values", "version_path", "versions", "vacuum",
           "published_number", "unpublished", "mark_published", "journal_frame"]
