import datetime
import os

from promptveil.schemas import AUDIT
from promptveil.sources import audit_store


def rows(spark, *made):
    """Audit rows of (id, day, status)."""
    full = [(i, datetime.datetime(2024, 1, day, 12), "u", "ip", "allowed", None, status, True, False, 0, 0, {}, "mock", 1.0, None)
            for i, day, status in made]
    return spark.createDataFrame(full, AUDIT)


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_only_touched_dates_are_written_anew(spark, tmp_path):
    path, target = str(tmp_path / "audit"), str(tmp_path / "compacted")
    now = lambda version=None: {(r["request_id"], r["date"].day, r["status_code"], r["write_seq"])
                                for r in audit_store.read_compacted_rows(spark, target, version).collect()}
    audit_store.write_audit(rows(spark, ("a", 1, 200), ("b", 1, 200), ("c", 2, 200)), path, 0)
    assert now() == set() and audit_store.compact_new(spark, path, target) == 1
    first = now()
    assert first == {("a", 1, 200, 0), ("b", 1, 200, 0), ("c", 2, 200, 0)}
    kept = files(target + "/rows")
    assert audit_store.compact_new(spark, path, target) == 1 and files(target + "/rows") == kept  # nothing new
    audit_store.write_audit(rows(spark, ("c", 2, 500), ("d", 3, 200)), path, 1)
    audit_store.write_audit(rows(spark, ("c", 2, 502)), path, 2)
    assert audit_store.compact_new(spark, path, target) == 2
    assert now() == {("a", 1, 200, 0), ("b", 1, 200, 0), ("c", 2, 502, 2), ("d", 3, 200, 1)}
    fresh = set(files(target + "/rows")) - set(kept)
    assert set(kept) <= set(files(target + "/rows")) and not any("date=2024-01-01" in f for f in fresh)
    assert now(1) == first  # a reader of the first version sees what it saw
    assert {(r["request_id"], r["status_code"]) for r in audit_store.read_audit(spark, path).collect()} == {r[0:3:2] for r in now()}


def test_a_date_is_written_by_few_tasks(spark, tmp_path):
    path, target = str(tmp_path / "audit"), str(tmp_path / "compacted")
    made = rows(spark, *[(f"r{n}", 1 + n % 5, 200) for n in range(40)]).repartition(8)
    audit_store.write_audit(made, path, 0)
    assert audit_store.compact_new(spark, path, target) == 1
    audit_store.write_audit(made.where("request_id < 'r3'"), path, 1)
    assert audit_store.compact_new(spark, path, target) == 2
    for folder in (f"{path}/batch=0", f"{path}/batch=1", f"{target}/rows/version=1", f"{target}/rows/version=2"):
        assert len(files(folder)) == 5  # one for each date, not one for each date and task
    assert sorted((r["request_id"], r["write_seq"]) for r in audit_store.read_compacted_rows(spark, target).collect()) == sorted(
        (f"r{n}", int(f"r{n}" < "r3")) for n in range(40))
