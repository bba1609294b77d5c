import random

from pyspark.sql import functions as F

from tidemark.operators import paths


def walk(names, entry, root):
    parts, seen, cur = [], set(), entry
    while cur != root and cur not in seen:
        seen.add(cur)
        if cur not in names:
            break
        name, parent = names[cur]
        parts.append(name)
        if parent in (cur, root, 0):
            break
        cur = parent
    return "\\" + "\\".join(reversed(parts))


def resolve(spark, names, root=5):
    rows = [("i", e, n, p) for e, (n, p) in names.items()]
    edges = spark.createDataFrame(rows, "image_id string, entry bigint, name string, parent bigint")
    return {r.entry: r.file_path for r in paths.resolve_paths(edges, root).collect()}


def test_fixture_tree(spark):
    names = {5: (".", 5), 10: ("Windows", 5), 11: ("System32", 10), 12: ("a.exe", 11), 20: ("x", 21), 21: ("y", 20),
             30: ("orphan", 999), 40: ("zero", 0), 50: ("self", 50), 51: ("below", 50)}
    names |= {1000 + i: (f"n{i}", 1001 + i if i < 69 else 5) for i in range(70)}
    got = resolve(spark, names)
    assert got[12] == "\\Windows\\System32\\a.exe" and got[20] == "\\y\\x" and got[21] == "\\x\\y"
    assert got[30] == "\\orphan" and got[40] == "\\zero" and got[5] == "\\" and got[51] == "\\self\\below"
    assert got[1000].count("\\") == 70
    assert got == {e: walk(names, e, 5) for e in names}


def test_random_trees_with_cycles(spark):
    rng = random.Random(7)
    for size, spread in ((400, 400), (150, 150)):
        names = {e: (f"f{e}", rng.randrange(0, spread)) for e in rng.sample(range(1, spread), size // 2)}
        assert resolve(spark, names) == {e: walk(names, e, 5) for e in names}


def test_long_cycles(spark):
    for length in (40, 64, 80):
        names = {100 + i: (f"c{i}", 100 + (i + 1) % length) for i in range(length)}
        names[7] = ("leaf", 100)
        assert resolve(spark, names) == {e: walk(names, e, 5) for e in names}


def test_registry_paths(spark):
    keys = [("h", "/x/NTUSER.DAT", 1, 0, "ROOT", 4), ("h", "/x/NTUSER.DAT", 2, 1, "Software", 0), ("h", "/x/NTUSER.DAT", 3, 2, "Run", 0),
            ("h", "/x/NTUSER.DAT", 4, 77, "Lost", 0), ("g", "C:\\y\\other", 2, 9, "Alone", 0)]
    df = spark.createDataFrame(keys, "hive_id string, hive_file string, rel_off bigint, parent_rel bigint, name string, flags int")
    got = {(r.hive_id, r.rel_off): r.full_path for r in paths.registry_paths(df).collect()}
    assert got == {("h", 1): "HKCU", ("h", 2): "HKCU\\Software", ("h", 3): "HKCU\\Software\\Run", ("h", 4): "HKCU\\Lost",
                   ("g", 2): "HIVE[OTHER]\\Alone"}


def test_shellbag_paths(spark):
    nodes = [("h", 0, 0, 0, True), ("h", 1, 0, 0, False), ("h", 2, 1, 3, False), ("h", 3, 0, 1, False), ("h", 4, 3, 0, False)]
    nodes += [("h", 100 + i, 99 + i if i else 0, 7 if i else 9, False) for i in range(35)]
    items = [("h", 0, 0, "My PC"), ("h", 1, 3, "C:"), ("h", 0, 1, None), ("h", 3, 0, "sub"), ("h", 0, 9, "d0")]
    items += [("h", 100 + i, 7, f"d{i + 1}") for i in range(34)]
    n = spark.createDataFrame(nodes, "hive_id string, node bigint, parent bigint, slot int, is_root boolean")
    i = spark.createDataFrame(items, "hive_id string, node bigint, slot int, item_name string")
    got = {r.node: r.path for r in paths.shellbag_paths(n, i).collect()}
    assert got[1] == "My PC" and got[2] == "My PC\\C:" and 3 not in got and 4 not in got
    assert max(p.count("\\") + 1 for p in got.values()) == 35 and len([k for k in got if k >= 100]) == 35


def test_snapshot_delta_is_led_by_a_hash(spark):
    """Hosts and paths begin alike, so the anti join sorts by a hash first; unknown hosts and repeated rows stay as they were."""
    from tidemark.operators import delta, timeline
    rows = [("h1", "\\a", 1), ("h1", "\\a", 2), ("h1", "\\b", 1), ("h2", "\\a", 1), (None, "\\a", 1), ("h1", "", 1), ("h1", None, 1), ("h1", "\\$x", 1)]
    snapshot = timeline.normalize(spark.createDataFrame(rows, "host_id string, file_path string, timestamp_ns long"))
    snapshot = snapshot.withColumn("snapshot_id", F.lit(1))
    current = spark.createDataFrame([("h1", "\\a"), (None, "\\a"), ("h2", "\\b")], "host_id string, file_path string")
    gone = delta.snapshot_file_delta(snapshot, current)
    assert sorted((r.host_id or "", r.file_path) for r in gone.collect()) == [("", "\\a"), ("h1", "\\b"), ("h2", "\\a")]
    assert "_led" not in gone.columns and "xxhash64(host_id" in gone._jdf.queryExecution().optimizedPlan().toString()
