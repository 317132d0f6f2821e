"""Items as shown, on trees that the supplied tables don't hold."""

from lignum.operators.presentation import presentation

TREE = "id long, parent long, name string, kind string, size long, mode int, access int, target string, display string"
NAMES = "id long, display string"
LOCAL = "id long, hidden boolean, size long, path string"


def shown(spark, rows, overrides=(), local=(), root_path="/r", expose=True):
    out = presentation(spark.createDataFrame(rows, TREE), spark.createDataFrame(list(overrides), NAMES), spark.createDataFrame(list(local), LOCAL).withColumnsRenamed({"size": "tag", "path": "note"}), root_path, expose)
    return {r.id: r for r in out.collect()}


def item(id_, parent, name, kind="File", mode=0o755, access=7, target=None):
    return (id_, parent, name, kind, 10, mode, access, target, "clash")


def test_links_and_rights(spark):
    rows = [
        item(1, None, "", "Dir"), item(2, 1, "a", "Dir", access=1), item(3, 2, "b", "Dir"),
        item(10, 3, "in", "Symlink", target="../../x"), item(11, 3, "out", "Symlink", target="../../../x"), item(12, 3, "none", "Symlink"),
        item(13, 2, "abs", "Symlink", target="/r/é"), item(14, 99, "lost", "Symlink", target="x"), item(15, 1, "up", "Symlink", target="../x"),
        item(20, 2, "f"), item(21, 3, "f.Command"), item(22, 3, "plain", mode=0o655),
    ]
    got = shown(spark, rows, [(20, "f 2"), (1, "root 2")], [(20, True, 3, "n"), (21, None, None, None)])
    assert len(got) == len(rows)
    assert {i: (got[i].target, got[i].size, got[i].blocked) for i in (10, 11, 12, 13, 14, 15)} == {
        10: ("../../x", 7, False), 11: ("../../../x", 10, True), 12: ("", 0, True), 13: ("../é", 5, False), 14: ("x", 1, True), 15: ("../x", 4, True),
    }
    assert [got[i].kind for i in (11, 14)] == ["Symlink"] * 2
    assert got[20].display == "f 2" and got[1].display == "" and (got[20].hidden, got[20].tag, got[20].note) == (True, 3, "n")
    assert got[21].hidden is False and got[22].hidden is False and got[22].tag is None
    assert [got[i].executable for i in (20, 21, 22, 10)] == [True, False, False, False]
    # Folder 2 may not be written to, so its items can't be renamed, moved or removed; the root never can.
    assert got[20].caps & 112 == 0 and got[21].caps & 112 == 112 and got[1].caps & 112 == 0 and got[14].caps & 112 == 112
    assert got[11].caps & 3 == 1


def test_bundles_above_at_any_depth(spark):
    rows = [item(1, None, "", "Dir"), item(2, 1, "X.app", "Dir"), item(3, 2, "Contents", "Dir"), item(4, 3, "MACOS", "Dir"), item(5, 4, "deep", "Dir"), item(6, 5, "run"), item(7, 3, "run")]
    got = shown(spark, rows)
    assert not got[6].executable and got[7].executable
    assert not any(r.executable for r in shown(spark, rows, expose=False).values())


def test_without_root_path_and_empty(spark):
    rows = [item(1, None, "", "Dir"), item(2, 1, "l", "Symlink", target="/r/a")]
    assert shown(spark, rows, root_path=None)[2].blocked and not shown(spark, rows, root_path="/")[2].blocked
    assert shown(spark, []) == {}
