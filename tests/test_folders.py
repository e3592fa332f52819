"""A folder as a Spark source: every file once, conditions met while listing, errors as rows."""

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

from nearfield.sources import folders, ingest


@pytest.fixture
def tree(tmp_path):
    for n in range(40):
        for place in ("", "a", "a/deep/er", f"many/{n}", ".hidden", "b c"):
            (tmp_path / place).mkdir(parents=True, exist_ok=True)
            (tmp_path / place / f"{n}.{'WAV' if n % 2 else 'txt'}").write_text("x" * n)
    (tmp_path / "a" / "._3.wav").write_text("")
    (tmp_path / "a" / ".wav").write_text("")
    (tmp_path / "a" / "up").symlink_to(tmp_path)
    return str(tmp_path)


@pytest.mark.parametrize("tasks", [1, 8, 200])
def test_every_file_once(spark, tree, tasks):
    df = folders.registered(spark).read.format(folders.FORMAT).option("tasks", tasks).load(tree)
    want = ingest.listing(spark, tree)
    key = ["path", "folder", "filename", "ext", "file_size", "file_mtime"]
    assert sorted(map(tuple, df.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert df.count() == 242 and df.where("error is not null").count() == 0


def test_conditions_are_met_while_listing(spark, tree, monkeypatch):
    df = folders.registered(spark).read.format(folders.FORMAT).load(tree)
    whole = ingest.listing(spark, tree)
    for condition in ("ext = '.wav'", "folder = 'a/deep/er'", "folder in ('a', 'many/7', 'none')", "startswith(folder, 'many/1')", "ext in ('.txt') and startswith(folder, 'a')", "ext = '.wav' and ext = '.txt'", "folder = '' and file_size > 3"):
        got = df.where(condition)
        assert sorted(r.path for r in got.collect()) == sorted(r.path for r in whole.where(condition).collect()), condition
    reader = folders.FolderReader(tree, 4)
    left = list(reader.pushFilters([EqualTo(("folder",), "a/deep/er"), StringStartsWith(("folder",), "a/"), GreaterThan(("file_size",), 3)]))
    assert left == [GreaterThan(("file_size",), 3)]
    # folders beside the way to it aren't opened
    asked = []
    monkeypatch.setattr(folders, "listed_entries", lambda path, folder: asked.append(folder) or ingest.listed_entries(path, folder))
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 40 and set(asked) == {"", "a", "a/deep", "a/deep/er"}


def test_unlistable_folders_and_none(spark, tmp_path):
    load = folders.registered(spark).read.format(folders.FORMAT).load
    assert load(str(tmp_path)).count() == 0
    missing = load(str(tmp_path / "missing")).collect()
    assert len(missing) == 1 and missing[0].path == str(tmp_path / "missing") and missing[0].error
    with pytest.raises(Exception, match="needs a folder"):
        spark.read.format(folders.FORMAT).load().count()
