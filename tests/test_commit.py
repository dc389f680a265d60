"""Commits: written once, switched whole, recorded, and finished from any point."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakesync.catalog.publish import catalog_partitions
from lakesync.plans import ingest, run_batch, run_inline, run_separate
from lakesync.sinks import commit as C
from lakesync.sinks import journal, recorded_schema, recover, upsert_to_path, vacuum, write_table
from lakesync.sources import read_table
from lakesync.spec import TableSpec

from ticks import write_lines

SCHEMA = "k string, p string, o int, v int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def spec_at(path, **kw):
    return TableSpec(path=str(path), keys=("k",), order="o", partition="p", **kw)


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def dying(monkeypatch, name, after):
    """The process ends at the ``after``-th call of a file-system step."""
    real, left = getattr(C, name), [after]

    def step(*a):
        left[0] -= 1
        if left[0] < 0:
            raise KeyboardInterrupt("killed")
        return real(*a)

    monkeypatch.setattr(C, name, step)


# ------------------------------------------------------------------ stored schema
@pytest.mark.parametrize("ptype", ["string", "int"])
def test_a_column_of_other_partitions_is_not_lost(spark, tmp_path, ptype):
    """A batch without a column that only one of its partitions holds fails before any write."""
    schema = f"k string, p {ptype}, o int"
    one, two = (1, 2) if ptype == "int" else ("x", "y")
    spec = spec_at(tmp_path / "t")
    upsert_to_path(frame(spark, [("a", one, 1)], schema), spec)
    upsert_to_path(frame(spark, [("b", two, 1, "W")], schema + ", w string"), spec)
    with pytest.raises(ValueError, match=r"columns missing \['w'\]"):
        upsert_to_path(frame(spark, [("a", one, 2), ("b", two, 2)], schema), spec)
    with pytest.raises(ValueError, match="of another type"):
        upsert_to_path(frame(spark, [("a", one, 2, 5)], schema + ", w int"), spec)
    upsert_to_path(frame(spark, [("a", one, 2, "V"), ("c", two, 2, None)], schema + ", w string"), spec)
    stored = recorded_schema(spark, spec.path)
    assert set(stored.fieldNames()) == {"k", "p", "o", "w"}
    assert rows(read_table(spark, spec.path, stored).select("k", "o", "w")) == [("a", 2, "V"), ("b", 1, "W"), ("c", 2, None)]


def test_a_table_without_records_is_judged_by_all_touched_folders(spark, tmp_path):
    spec = spec_at(tmp_path / "t")
    write_table(frame(spark, [("a", "1", 1)], "k string, p string, o int"), spec.path, "p")
    write_table(frame(spark, [("b", "2", 1, "W")], "k string, p string, o int, w string"), spec.path, "p", mode="append")
    assert recorded_schema(spark, spec.path) is None
    with pytest.raises(ValueError, match=r"columns missing \['w'\]"):
        upsert_to_path(frame(spark, [("a", "1", 2), ("b", "2", 2)], "k string, p string, o int"), spec)


# ------------------------------------------------------------------ plain tables
OLD = [("a", "x", 1, 1), ("b", "y", 1, 2), ("c", "z", 1, 3)]
NEW = [("a", "x", 2, 10), ("b", "y", 2, 20), ("d", "w", 2, 40)]
MERGED = sorted([NEW[0], NEW[1], NEW[2], OLD[2]], key=str)


def table(spark, spec):
    return rows(read_table(spark, spec.path, SCHEMA).select("k", "p", "o", "v"))


@pytest.mark.parametrize("step", [0, 1, 2, 3, 4, 5, 6, 7])
def test_killed_merge_is_finished(spark, tmp_path, monkeypatch, step):
    """At every rename: before the commit is decided nothing has changed, afterwards it is made whole."""
    spec = spec_at(tmp_path / "t")
    upsert_to_path(frame(spark, OLD), spec)
    killed = False
    with monkeypatch.context() as m:
        # write_text of the pending record, five renames for three partitions, write_text of the journal
        dying(m, "write_text" if step == 0 else "move_path", max(0, step - 1))
        try:
            upsert_to_path(frame(spark, NEW), spec)
        except KeyboardInterrupt:
            killed = True
    assert killed == (step < 6)
    if step == 0:
        assert table(spark, spec) == sorted(OLD, key=str) and recover(spark, spec.path) == []
        upsert_to_path(frame(spark, NEW), spec)
    else:
        assert recover(spark, spec.path) == ([2] if killed else [])
    assert table(spark, spec) == MERGED
    assert [r["kind"] for r in journal(spark, spec.path)] == ["overwrite", "merge"] and recover(spark, spec.path) == []
    left = [d for _, _, files in os.walk(C.meta_path(spec.path, "old")) for d in files]
    assert left == [] and os.listdir(C.meta_path(spec.path, "pending")) == []
    upsert_to_path(frame(spark, NEW), spec)  # a replay changes nothing
    assert table(spark, spec) == MERGED


def test_the_next_upsert_finishes_a_killed_one(spark, tmp_path, monkeypatch):
    spec = spec_at(tmp_path / "t")
    upsert_to_path(frame(spark, OLD), spec)
    with monkeypatch.context() as m:
        dying(m, "move_path", 2)
        with pytest.raises(KeyboardInterrupt):
            upsert_to_path(frame(spark, NEW), spec)
    upsert_to_path(frame(spark, [("c", "z", 5, 50)]), spec)
    assert table(spark, spec) == sorted([*NEW, ("c", "z", 5, 50)], key=str)


@pytest.mark.parametrize("name,after", [("_write", 0), ("write_text", 0), ("move_path", 0), ("move_path", 1), ("write_text", 1)])
def test_killed_overwrite(spark, tmp_path, monkeypatch, name, after):
    """Full overwrite (W2): the old rows, or after the decision the new ones, never a mixture."""
    from lakesync.sinks import table as tables

    spec = spec_at(tmp_path / "t")
    write_table(frame(spark, OLD), spec.path, "p", mode="overwrite")
    with monkeypatch.context() as m:
        if name == "_write":
            m.setattr(tables, "_write", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt("killed")))
        else:
            dying(m, name, after)
        with pytest.raises(KeyboardInterrupt):
            write_table(frame(spark, NEW), spec.path, "p", mode="overwrite")
    decided = (name, after) not in (("_write", 0), ("write_text", 0))
    if not decided:
        assert table(spark, spec) == sorted(OLD, key=str)
    recover(spark, spec.path)
    assert table(spark, spec) == sorted(NEW if decided else OLD, key=str)


def test_a_failing_job_leaves_the_old_rows(spark, tmp_path):
    spec = spec_at(tmp_path / "t")
    write_table(frame(spark, OLD), spec.path, "p", mode="overwrite")
    bad = frame(spark, NEW).withColumn("v", F.when(F.col("k") == "d", F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="no"):
        write_table(bad, spec.path, "p", mode="overwrite")
    assert table(spark, spec) == sorted(OLD, key=str)


def test_overwrite_by_a_batch_run_over_old_content(spark, tmp_path):
    spec = TableSpec(path=str(tmp_path / "t"), keys=("k",), order="o", partition="p", database="commits", table="batch")
    write_lines(str(tmp_path / "a"), [{"k": k, "p": p, "o": o, "v": v} for k, p, o, v in OLD])
    write_lines(str(tmp_path / "b"), [{"k": k, "p": p, "o": o, "v": v} for k, p, o, v in NEW])
    run_batch(spark, str(tmp_path / "a"), spec, schema=SCHEMA)
    second = run_batch(spark, str(tmp_path / "b"), spec, schema=SCHEMA)
    assert second.partitions == {"ADD": 1, "DROP": 1}
    assert rows(spark.table(spec.qualified_name).select("k", "p", "o", "v")) == sorted(NEW, key=str)


def test_parallelism_leaves_one_file_a_small_partition(spark, tmp_path):
    """Only partitions beyond a task's share of the rows are split."""
    data = spark.range(6000).selectExpr("cast(id as string) k", "if(id < 3000, 'hot', cast(id % 20 as string)) p", "cast(id as int) o", "1 v")
    spec = spec_at(tmp_path / "t", parallelism=6)
    for _ in range(2):
        upsert_to_path(data, spec)
        files = {d: len([f for f in os.listdir(f"{spec.path}/{d}") if f.endswith(".parquet")]) for d in os.listdir(spec.path) if d.startswith("p=")}
        assert 2 <= files.pop("p=hot") <= 3 and set(files.values()) == {1} and len(files) == 20
    assert read_table(spark, spec.path, SCHEMA).count() == 6000


# ------------------------------------------------------------------ versioned tables
def versioned(tmp_path, name):
    return spec_at(tmp_path / name, database="commits", table=name, versioned=True)


def test_versioned_reader_sees_old_or_new(spark, tmp_path, monkeypatch):
    spec = versioned(tmp_path, "v1")
    upsert_to_path(frame(spark, OLD), spec)
    assert rows(spark.table(spec.qualified_name).select("k", "p", "o", "v")) == sorted(OLD, key=str)
    seen = []
    real = spark.sql

    def sql(text, *a, **kw):
        out = real(text, *a, **kw)
        if text.startswith("ALTER TABLE"):
            real(f"REFRESH TABLE {spec.qualified_name}")
            seen.append(rows(spark.table(spec.qualified_name).select("k", "p", "o", "v")))
        return out

    monkeypatch.setattr(spark, "sql", sql)
    upsert_to_path(frame(spark, NEW), spec)
    monkeypatch.undo()
    assert len(seen) >= 6 and seen[-1] == MERGED
    for state in seen:  # per partition the old rows or the new ones
        for p in "xyz":
            part = [r for r in state if r[1] == p]
            assert part in ([r for r in OLD if r[1] == p], [r for r in MERGED if r[1] == p])
    assert sorted(os.listdir(f"{spec.path}/_versions")) == ["000000000001", "000000000002"]
    upsert_to_path(frame(spark, [("a", "x", 3, 100)]), spec)
    assert vacuum(spark, spec) == 2  # x and y of the first commit; the last superseded folder stays
    assert vacuum(spark, spec, keep=0) == 1
    want = sorted([("a", "x", 3, 100), *MERGED[1:]], key=str)
    assert rows(spark.table(spec.qualified_name).select("k", "p", "o", "v")) == want


def test_versioned_commit_is_finished(spark, tmp_path, monkeypatch):
    spec = versioned(tmp_path, "v2")
    upsert_to_path(frame(spark, OLD), spec)
    real, left = spark.sql, [3]

    def sql(text, *a, **kw):
        if text.startswith("ALTER TABLE"):
            left[0] -= 1
            if left[0] < 0:
                raise KeyboardInterrupt("killed")
        return real(text, *a, **kw)

    monkeypatch.setattr(spark, "sql", sql)
    with pytest.raises(KeyboardInterrupt):
        upsert_to_path(frame(spark, NEW), spec)
    monkeypatch.undo()
    assert recover(spark, spec.path) == [2]
    assert rows(spark.table(spec.qualified_name).select("k", "p", "o", "v")) == MERGED


def test_versioned_runs_and_new_columns(spark, tmp_path):
    spec = versioned(tmp_path, "v3")
    src = str(tmp_path / "in")
    write_lines(src, [{"k": k, "p": p, "o": o, "v": v} for k, p, o, v in OLD], "1.json")
    run_inline(spark, src, SCHEMA, spec)
    write_lines(src, [{"k": "a", "p": "x", "o": 2, "v": 7, "w": 8}], "2.json")
    run_inline(spark, src, SCHEMA + ", w int", spec)
    assert rows(spark.table(spec.qualified_name).select("k", "p", "o", "v", "w")) == [("a", "x", 2, 7, 8), ("b", "y", 1, 2, None), ("c", "z", 1, 3, None)]
    with pytest.raises(ValueError, match="versioned"):
        run_batch(spark, src, spec, schema=SCHEMA)
    with pytest.raises(ValueError, match="catalog name"):
        upsert_to_path(frame(spark, OLD), spec_at(tmp_path / "n", versioned=True))


# ------------------------------------------------------------------ publication
@pytest.mark.parametrize("run", [run_inline, run_separate])
def test_lost_publication_is_made_up_from_the_journal(spark, tmp_path, monkeypatch, run):
    src = str(tmp_path / "in")
    spec = spec_at(tmp_path / "t", database="commits", table=f"lost_{run.__name__}")
    write_lines(src, [{"k": "a", "p": "x", "o": 1, "v": 1}], "1.json")
    run(spark, src, SCHEMA, spec)
    assert len(journal(spark, spec.path)) == 1
    for i, p in ((2, "y"), (3, "a/b c")):
        write_lines(src, [{"k": "a", "p": p, "o": 1, "v": 1}], f"{i}.json")
        with monkeypatch.context() as m:
            m.setattr(ingest, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError):
                run(spark, src, SCHEMA, spec)
    pending = [f for r in C.unpublished(spark, spec.path) for f in r["folders"]]
    write_lines(src, [{"k": "b", "p": "y", "o": 1, "v": 1}, {"k": "a", "p": "z", "o": 1, "v": 1}], "4.json")
    import importlib
    monkeypatch.setattr(importlib.import_module("lakesync.catalog.publish"), "storage_partitions", lambda *a: pytest.fail("the table was listed"))
    assert run(spark, src, SCHEMA, spec).partitions == {"ADD": 3, "DROP": 0} and len(pending) == 2
    assert sorted(r[0] for r in catalog_partitions(spark, spec.qualified_name, "p").collect()) == ["a/b c", "x", "y", "z"]
    assert spark.table(spec.qualified_name).count() == 5
    assert C.unpublished(spark, spec.path) == [] and len(journal(spark, spec.path)) == 1


# ------------------------------------------------------------------ isolation
def test_core_works_without_the_training_data_package(spark, tmp_path):
    """The repository without ``llm`` (the pipeline file still there) imports and answers."""
    root = Path(__file__).resolve().parent.parent
    for part in ("lakesync", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / part).is_dir():
            shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (root / part).exists():
            shutil.copy(root / part, tmp_path / part)
    code = ("import __spark_entry__ as E\nq = E.queries()\n"
            "assert len(q) >= 36 and set(E.oracle_sql()) == set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q\n"
            "from lakesync.session import local_session\n"
            "s = local_session(2)\nassert q['parse_urn'](s, '/root/testdata/sf0.001').count() > 0\n")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=300, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
