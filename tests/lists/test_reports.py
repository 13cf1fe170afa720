import json

import pytest

from winnow.plans import reports


@pytest.mark.parametrize("name", ["../a.txt", "/a.txt", "a.lst", ".."])
def test_unsafe_names(name):
    with pytest.raises(ValueError):
        reports.safe_name(name)


def test_frozen_runs(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.txt").write_text("||a.org^\n||b.a.org^\n")
    state = {"a.txt": {"url": "u", "status": "fresh_fetch"}}
    with pytest.raises(ValueError):
        reports.freeze_dataset(str(raw), {}, str(tmp_path), "d")
    with pytest.raises(ValueError):
        reports.freeze_dataset(str(raw), state, str(tmp_path), "../d")
    path = reports.freeze_dataset(str(raw), state, str(tmp_path), "d")
    assert json.loads(open(path).read())["sources"][0]["byte_size"] == 20
    run = reports.timed_runs(spark, path, 2)
    assert run["deterministic"] and run["rules"] == 1 and run["summary"]["min_seconds"] <= run["summary"]["p95_seconds"] and len(run["observed"]) == 2
    made = reports.synthetic_runs(spark, str(tmp_path), "syn-1", 2, 5, 1)
    assert made["rules"] == 10 and made["dataset_id"] == "syn-1"
    (tmp_path / "h.json").write_text(json.dumps({"sources": [{"filename": "a.txt", "url": "u", "status": "failed"}]}))
    assert json.loads(open(reports.freeze_from_report(str(raw), str(tmp_path / "h.json"), str(tmp_path), "e")).read())["sources"][0]["source_health_status"] == "failed"
    (tmp_path / "h.json").write_text(json.dumps({"sources": [{"filename": "a.txt"}, {"filename": "a.txt"}]}))
    with pytest.raises(ValueError):
        reports.freeze_from_report(str(raw), str(tmp_path / "h.json"), str(tmp_path), "f")
    seen = reports.profile_run(spark, str(raw), str(tmp_path / "profiles"), "one", 5)
    assert seen["statistics"]["lines_output"] == 1 and all((tmp_path / "profiles" / "one" / name).exists() for name in seen["artifacts"].values())
    (tmp_path / "d" / "raw" / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        reports.timed_runs(spark, path)
    reports.write_synthetic(spark, str(tmp_path / "syn"), 2, 5)
    assert spark.read.text(str(tmp_path / "syn")).count() == 10
