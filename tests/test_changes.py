"""Known answers of changes between trees with directories."""

import pytest

from cairn.operators import changes

OLD = {"bloba": "A", "blobb": "B", "subdir1/blobc": "C", "subdir1/blobd": "D", "subdir2/blobe": "E", "subdir2/blobf": "F"}
OLD2 = {"bloba": "A", "blobb": "B", "subdir4/blobe": "E", "subdir4/blobf": "F", "subdir4/subdir3/blobc": "C", "subdir4/subdir3/blobd": "D"}
NEW = {"bloba": "A", "blobb": "C", "subdir1/blobc": "C", "subdir1/blobd": "E", "subdir2a/blobe": "E", "subdir2a/blobf": "F"}


def tree(spark, files, *dirs):
    return changes.entries(spark.createDataFrame([*files.items()], "path string, urn string"), spark.createDataFrame([(d,) for d in dirs], "path string"))


def lines(df):
    return [f"{r['op']:<3}{r['path']}" for r in df.orderBy("place", "seq").collect()]


def rows(df):
    return {r["path"]: (r["urn"], r["conflict"]) if "conflict" in r else r["urn"] for r in df.collect()}


@pytest.mark.parametrize(("old", "want"), [
    (OLD, "D  blobb|A  blobb|D  subdir1/blobd|A  subdir1/blobd|D  subdir2/blobe|D  subdir2/blobf|DD subdir2|A  subdir2a/blobe|A  subdir2a/blobf"),
    (OLD2, "D  blobb|A  blobb|A  subdir1/blobc|A  subdir1/blobd|A  subdir2a/blobe|A  subdir2a/blobf|D  subdir4/blobe|D  subdir4/blobf|D  subdir4/subdir3/blobc|D  subdir4/subdir3/blobd|DD subdir4/subdir3|DD subdir4"),
])
def test_changes(spark, old, want):
    old, new = tree(spark, old), tree(spark, NEW)
    found = changes.changes(old, new)
    assert lines(found) == want.split("|")
    got = changes.apply_changes(old, found, new)
    assert {r["path"]: (r["is_dir"], r["urn"], r["conflict"]) for r in got.collect()} == {r["path"]: (r["is_dir"], r["urn"], None) for r in new.collect()}


def test_kinds_that_change(spark):
    """A directory that becomes a file, and back; an empty directory."""
    old, new = tree(spark, {"x/a": "A", "x/b/c": "B", "y": "C"}, "gone"), tree(spark, {"x": "D", "y/z": "E"}, "made")
    found = changes.changes(old, new)
    assert lines(found) == ["DD gone", "D  x/a", "D  x/b/c", "DD x/b", "DD x", "A  x", "D  y", "A  y/z"]
    assert rows(changes.apply_changes(old, found, new)) == {"x": ("D", None), "y": (None, None), "y/z": ("E", None)}
    assert {r["top"]: r["dump"] for r in changes.dump(found).collect()}["y"] == "D  y\nA  y/z"


def test_apply_to_another_tree(spark):
    """Deletes of what is missing, directories that are not empty, adds onto entries and below files."""
    found = spark.createDataFrame([("no", "D"), ("no/dir", "DD"), ("full", "DD"), ("full/a", "D"), ("file", "A"), ("plain/x", "A"), ("deep/er/x", "A"), ("full", "D")], "path string, op string")
    base, new = tree(spark, {"full/a": "A", "full/b": "B", "file": "C", "plain": "P"}), tree(spark, {"file": "N", "plain/x": "N", "deep/er/x": "N"})
    got = rows(changes.apply_changes(base, found, new))
    assert got == {"full": (None, "not a file"), "full/b": ("B", None), "file": ("C", "exists"), "plain": ("P", None), "plain/x": ("N", "not a directory"), "deep": (None, None), "deep/er": (None, None), "deep/er/x": ("N", None)}


def test_merge(spark):
    old, new = tree(spark, {"a": "1", "d/x": "1", "d/y": "1", "o/k": "1", "m": "1"}), tree(spark, {"a": "2", "d/x": "2", "d/z": "2", "n/k": "2", "m/q": "2"})
    m = lambda **k: {p: v for p, v in rows(changes.merge(old, new, **k)).items() if v[0] or v[1]}
    assert m(files="Replace") == {"a": ("2", None), "d/x": ("2", None), "d/y": ("1", None), "d/z": ("2", None), "o/k": ("1", None), "n/k": ("2", None), "m": ("1", "mixed")}
    assert m(files="Ignore", directories="Replace") == {"a": ("1", None), "d/x": ("2", None), "d/z": ("2", None), "o/k": ("1", None), "n/k": ("2", None), "m": ("1", "mixed")}
    assert m(files="Same?Ignore:Replace", directories="Ignore") == {"a": ("2", None), "d/x": ("1", None), "d/y": ("1", None), "o/k": ("1", None), "n/k": ("2", None), "m": ("1", "mixed")}
    assert m(directories="Fail")["d/x"] == ("1", "directory") and m()["d/x"] == ("1", "file")
    with pytest.raises(Exception, match="cannot merge"):
        changes.merge(old, new, fail=True).collect()


def test_merge_all(spark):
    trees = [tree(spark, {"a": "1"}), tree(spark, {"b/x": "2"}), tree(spark, {"a": "1", "b/y": "3"})]
    assert rows(changes.merge_all(trees, "Same?Ignore:Fail")) == {"a": ("1", None), "b": (None, None), "b/x": ("2", None), "b/y": ("3", None)}
    assert rows(changes.merge_all([trees[0], tree(spark, {"a": "9"}), trees[1]]))["a"] == ("1", "file")
