import random

import pytest

from cairn.operators import catalog, delta, history, restore, select, validate
from cairn.operators.bytes import run_lengths
from pyspark.sql import functions as F

FOLDERS = ["lab", "lab/notes", "lab/notes/old", "tools", "void"]
FILES = ["lab/plan.odt", "lab/notes/day1.md", "lab/notes/old/day0.md", "tools/run.sh", "index.html"]
TREE = dict.fromkeys(FOLDERS, "directory") | dict.fromkeys(FILES, "file") | {"latest": "symlink"}


def _tree(spark):
    return spark.createDataFrame([(p, t) for p, t in TREE.items()], "path string, type string")


def _plainly(includes):
    """Entries that are chosen, below a chosen one or above one, by string prefixes."""
    clean = ["/".join(x for x in i.split("/") if x not in ("", ".")) for i in includes]
    return sorted(p for p in TREE for c in clean if c in TREE and (p == c or p.startswith(c + "/") or c.startswith(p + "/")))


@pytest.mark.parametrize("includes", [["lab/notes/day1.md"], ["tools/"], ["index.html", "lab/notes/old/day0.md"], ["void"], ["latest"], ["./lab//notes/./day1.md"], ["la"], ["lab/notes", "tools/run.sh", "nowhere"]])
def test_selection(spark, includes):
    chosen = spark.createDataFrame([(x,) for x in includes], "path string")
    assert sorted(r.path for r in select.select(_tree(spark), chosen).collect()) == sorted(set(_plainly(includes)))
    assert select.missing(_tree(spark), chosen).count() == sum(not _plainly([x]) for x in includes)


def test_visibility(spark):
    rows = [("docs", "directory", 0, 1000), ("docs/report.txt", "file", 10, 1000), ("images", "directory", 0, 1000), ("images/photo.jpg", "file", 5, 1000), ("images/big.raw", "file", 2 << 20, 1000), (".git", "directory", 0, 1000), (".git/a.jpg", "file", 1, 1000)]
    e = spark.createDataFrame(rows, "path string, type string, size long, mtime long")
    show = lambda hidden, **how: sorted(r.path for r in select.visible(select.matching(e, hidden=hidden, **how), hidden).collect())
    assert show(False, category_="image") == ["images", "images/photo.jpg"]
    assert show(True, category_="image") == [".git", ".git/a.jpg", "images", "images/photo.jpg"]
    assert show(True, size_band=3) == ["images", "images/big.raw"]
    assert show(True, search=" PHOTO ") == ["images", "images/photo.jpg"]


def test_ages(spark):
    day, now = 86_400, 1_000_000_000
    e = spark.createDataFrame([(f"f{k}", "file", 0, now - k * day - d) for k in (1, 7, 30, 90, 365) for d in (0, 1)], "path string, type string, size long, mtime long")
    got = {c: {r.path: r.n for r in select.matching(e, age=c, now=F.lit(now)).where("matches").groupBy("path").agg(F.count("*").alias("n")).collect()} for c in (1, 2, 3, 4)}
    assert got[1] == {"f1": 1} and got[2] == {"f1": 2, "f7": 1} and got[3]["f30"] == 1 and got[4] == {"f30": 1, "f90": 2, "f365": 2}


def test_hardlinks(spark):
    rows = [("b", 1, 9, 4, 10, 100), ("a", 1, 9, 4, 20, 100), ("c", 1, 9, 4, 30, 101), ("d", 2, 9, 4, 10, 100)]
    e = spark.createDataFrame(rows, "path string, dev long, inode long, size long, atime long, mtime long").selectExpr("*", "'file' type", "420 mode", "0 uid", "0 gid")
    folded = catalog.fold_hardlinks(e)
    got = {r.path: (r.type, r.link_target, r.size, r.atime, r.conflict) for r in folded.collect()}
    assert got == {"a": ("file", "", 4, 20, False), "b": ("hardlink", "a", 0, 20, False), "c": ("hardlink", "a", 0, 20, True), "d": ("file", "", 4, 10, False)}
    assert catalog.totals(folded).first().input_bytes == 8 and {r.path: r.size for r in catalog.listed(folded).collect()} == dict.fromkeys("abcd", 4)


def test_delta_over_versions(spark):
    blobs = [("s1", 1, "".join(c * 64 for c in "abcd")), ("s1", 2, "".join(c * 64 for c in "abXd")), ("s2", 3, "q" * 70), ("s1", 4, ""), ("", 5, "a" * 64)]
    v = spark.createDataFrame(blobs, "series string, id long, content string")
    cut = delta.blocks(v.select("id", "content"), 64)
    d = delta.delta(cut, cut, delta.choose_base(v))
    assert {r.id: (r.n_blocks, r.n_reused, r.reused_len) for r in delta.reuse(d).collect()} == {1: (4, 0, 0), 2: (4, 3, 192), 3: (2, 0, 0), 5: (1, 0, 0)}
    assert {r.id: r.content for r in delta.assembled(delta.apply_delta(d, cut)).collect()} == {i: c for _, i, c in blobs if c}
    with pytest.raises(Exception, match="missing base block"):
        delta.apply_delta(d, cut.where("id <> 1")).collect()


def test_binary_blocks(spark):
    raw = bytes(range(256)) * 5
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray())], "id long, content binary")
    rows = delta.blocks(df, 500).orderBy("block_no").collect()
    assert [(r.block_no, r.len, bytes(r.content)) for r in rows] == [(0, 500, raw[:500]), (1, 500, raw[500:1000]), (2, 280, raw[1000:])]
    text = spark.createDataFrame([(1, "é😀\n" * 50)], "id long, content string")
    assert [r.content for r in delta.blocks(text, 64).orderBy("block_no").collect()] == ["é😀\n" * 21 + "é", "😀\n" + "é😀\n" * 20 + "é😀", "\n" + "é😀\n" * 7]


def test_space_needed_equals_the_fold(spark):
    rng = random.Random(4)
    steps = [(v, k, rng.randrange(50), rng.choice([0, 0, 90])) for v in range(6) for k in range(40)]
    expected = {}
    for v in range(6):
        occupied = peak = 0
        for _, _, size, reclaimed in (s for s in steps if s[0] == v):
            occupied += size
            peak = max(peak, occupied)
            occupied -= min(occupied, reclaimed)
        expected[v] = peak
    df = spark.createDataFrame(steps, "volume long, ord long, size long, reclaimed long")
    assert {r.volume: r.needed for r in restore.space_needed(df).collect()} == expected


def test_run_lengths(spark):
    df = spark.createDataFrame([(bytearray(b"A" * 127 + b"B" * 128 + b"C" * 2 + b"D" * 3 + b"E" * 129),), (None,), (bytearray(),)], "content binary")
    assert {r.length: r.n for r in run_lengths(df).collect()} == {127: 1, 128: 2, 2: 1, 3: 1, 1: 1}


def test_validation_of_trees(spark):
    rows = [("r", 2, 0, ""), ("r/a", 1, 1, ""), ("r/b", 8, 2, "r/a"), ("r/c", 8, 0, "r/a"), ("r/e", 8, 9, "r/none"), ("r/x/y", 1, 3, ""), ("r/a/z", 1, 4, "")]
    e = spark.createDataFrame(rows, "path string, type_id int, ord int, link_target string").selectExpr("*", "0 mode", "0 uid", "0 gid", "0 mtime")
    bad = {(r.rule, r.key) for r in validate.entry_violations(e.where("path <> 'r/c'"), "r").collect()}
    assert bad == {("alias_target", "r/e"), ("parent_missing", "r/x/y"), ("parent_type", "r/a/z")}
    assert ("alias_order", "r/c") in {(r.rule, r.key) for r in validate.entry_violations(e, "r").collect()}
    assert {r.rule for r in validate.entry_violations(e.where("path = ''"), "r").collect()} == {"empty"}
    with pytest.raises(validate.Invalid, match="alias_target"):
        validate.assert_valid(validate.entry_violations(e.where("path IN ('r', 'r/e')"), "r"))
    validate.assert_valid(validate.entry_violations(e.where("path IN ('r', 'r/a', 'r/b')"), "r"))
    validate.check_automatic(1, 20, "/a", "/ab")
    for keep, every, out in ((0, 20, "/b"), (1, 10, "/b"), (1, 20, "/a/b"), (1, 20, "/a")):
        with pytest.raises(validate.Invalid):
            validate.check_automatic(keep, every, "/a", out)


def test_history(spark):
    h = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "a", 7), (4, "b", 1)], "id long, name string, timestamp long")
    assert {r.name: r.id for r in history.latest(h).collect()} == {"a": 2, "b": 4}
    assert [r.id for r in history.listing(h).collect()] == [2, 3, 1, 4]
    kept = history.retention(spark.createDataFrame([("s", f"n{k}") for k in range(5)] + [("t", "m")], "series string, name string"), 3)
    assert sorted(r.name for r in kept.where("kept").collect()) == ["m", "n2", "n3", "n4"]


def test_restore_order_and_tree_equality(spark):
    out = catalog.restore_order(_tree(spark)).orderBy("step", "rank", "path").collect()
    assert [r.path for r in out if r.step == 1][-2:] == ["lab/notes", "lab/notes/old"] and [r.path for r in out if r.step == 3][:2] == ["lab/notes/old", "lab/notes"]
    assert catalog.tree_difference(_tree(spark), _tree(spark)).count() == 0
    assert catalog.tree_difference(_tree(spark).unionByName(_tree(spark)), _tree(spark)).count() == len(TREE)


def test_rebuilt_versions_are_checked(spark):
    blobs = spark.createDataFrame([(1, "s", bytearray(bytes(range(256)) * 3)), (2, "s", bytearray(bytes(range(256)) * 3 + b"\xff")), (3, "s", bytearray(b""))], "id long, series string, content binary")
    cut = delta.blocks(blobs.select("id", "content"), 100)
    refs = delta.references(delta.delta(cut, cut, delta.choose_base(blobs)), 100)
    declared = blobs.select("id", F.octet_length("content").alias("declared_size"), F.sha2("content", 256).alias("declared_sha256"))
    want = {r.id: bytes(r.content) for r in blobs.collect()}
    assert {r.id: bytes(r.content) for r in delta.assembled(delta.resolved(refs, cut, 100), declared, by="place").collect()} == want
    assert {r.id for r in refs.where("copy IS NOT NULL").collect()} == {2}
    for wrong in (declared.withColumn("declared_size", F.col("declared_size") + 1), declared.withColumn("declared_sha256", F.lit("0"))):
        with pytest.raises(Exception, match="differs from its declaration"):
            delta.assembled(delta.resolved(refs, cut, 100), wrong, by="place").collect()


def test_copies_across_blocks(spark):
    base = bytes(range(250))
    cut = delta.blocks(spark.createDataFrame([(1, bytearray(base))], "id long, content binary"), 64)
    pieces = [(0, 0, 250), (250, 63, 2), (252, 64, 64), (316, 10, 200)]
    refs = spark.createDataFrame([(9, p, 1, (o, n), None) for p, o, n in pieces] + [(9, 516, None, None, bytearray(b"xyz"))], "id long, place long, base long, copy struct<offset:long,len:long>, content binary")
    got = delta.assembled(delta.resolved(refs, cut, 64), by="place").first().content
    assert bytes(got) == b"".join(base[o : o + n] for _, o, n in pieces) + b"xyz"
    beyond = spark.createDataFrame([(9, 0, 1, (240, 20), None)], refs.schema)
    with pytest.raises(Exception, match="missing base block"):
        delta.resolved(beyond, cut, 64).collect()


def test_versions_packed_whole(spark):
    """Packed rows hold the references that blocks as rows give, and come back as the versions."""
    one = bytes(range(256)) * 3
    data = [(1, "s", one), (2, "s", one[:300] + b"?" + one[301:] + b"\xff"), (3, "s", b""), (4, "s", one), (5, "t", b"\x00" * 100), (6, "", one), (7, "t", b"\x00" * 130)]
    blobs = spark.createDataFrame([(i, s, bytearray(c)) for i, s, c in data], "id long, series string, content binary")
    bases, cut = delta.choose_base(blobs), delta.blocks(blobs.select("id", "content"), 100)
    plain = lambda rows: sorted(((r.id, r.place, tuple(r.copy) if r.copy else None, r.content and bytes(r.content), r.base) for r in rows), key=lambda x: x[:2])
    for most in (delta.MOST_BLOCKS, 2):
        sent = delta.packed(blobs, bases, 100, most)
        want = plain(delta.references(delta.delta(cut, cut, bases, most), 100).collect())
        assert plain(sent.select("id", "base", F.inline("pieces")).collect()) == want and {x[0] for x in want if x[2]} == {2, 7}
        assert {r.id: bytes(r.content) for r in delta.unpacked(sent, blobs).collect()} == {i: c for i, _, c in data}
    declared = blobs.select("id", F.octet_length("content").alias("declared_size"), F.sha2("content", 256).alias("declared_sha256"))
    back = delta.unpacked(sent, blobs)
    assert {(r.id, r.len) for r in delta.held_against(back, declared).collect()} == {(i, len(c)) for i, _, c in data}
    for got, said in ((back, declared.withColumn("declared_sha256", F.lit("0"))), (back.where("id <> 3"), declared)):
        with pytest.raises(Exception, match="differs from its declaration"):
            delta.held_against(got, said).collect()
    with pytest.raises(Exception, match="missing base block of 2"):
        delta.unpacked(sent, blobs.where("id <> 1")).collect()


def test_limits_are_errors(spark):
    rows = spark.createDataFrame([("a", f"{k:032x}", k) for k in range(5)] + [("b", f"{9:032x}", 1)], "account string, id string, timestamp long")
    names = rows.select("account", F.concat("id", F.lit(".meta")).alias("name"))
    assert [r.timestamp for r in history.account_listing(names, rows).where("account = 'a'").collect()] == [4, 3, 2, 1, 0]
    with pytest.raises(Exception, match="too many backups of a"):
        history.account_listing(names, rows, most=4).collect()
    long = rows.select("account", F.repeat(F.lit("x"), 300_000).alias("name"))
    with pytest.raises(Exception, match="listing is too large: a"):
        history.within_capacity(long).collect()
    assert history.within_capacity(long.where("account = 'b'")).count() == 1


def test_downloads_are_checked(spark):
    held = spark.createDataFrame([("a", bytearray(b"\xff\x00")), ("b", bytearray(b"b"))], "id string, content binary")
    good = held.select("id", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"))
    assert {r.id: bytes(r.content) for r in history.download(good, held).collect()} == {"a": b"\xff\x00", "b": b"b"}
    with pytest.raises(Exception, match="differs from its record: b"):
        history.download(good.withColumn("size", F.when(F.col("id") == "b", 2).otherwise(F.col("size"))), held).collect()


def test_observed(spark):
    e, seen = catalog.observed(spark.createDataFrame([("a", "file", 5), ("b", "directory", 0), ("c", "file", 7)], "path string, type string, size long"))
    e.write.format("noop").mode("overwrite").save()
    assert seen.get == {"entry_count": 3, "input_bytes": 12}


def test_content_regions(spark):
    e = spark.createDataFrame([(1, "a", 1, 10, 8), (1, "b", 1, 5, 18), (1, "c", 1, 6, 18), (1, "d", 2, 0, 0), (1, "e", 2, 0, 9), (1, "f", 1, 0, 7)], "archive int, path string, type_id int, size long, offset long")
    got = {(r.rule, r.key) for r in validate.content_violations(e, spark.createDataFrame([(1, 23)], "archive int, content_end long")).collect()}
    assert got == {("content", "1:c"), ("offset", "1:e"), ("content", "1:f")}


def test_folds_over_ranges(spark):
    """Groups cut into ranges, one holding most rows, against the fold itself."""
    rng = random.Random(6)
    rows = [("hot" if k % 10 else f"v{k % 30}", k, rng.randrange(50), rng.choice([0, 0, rng.randrange(120)])) for k in range(900)]
    steps = spark.createDataFrame(rows, "volume string, ord int, size long, reclaimed long").repartition(5)
    want = {}
    for v in {r[0] for r in rows}:
        occupied = peak = 0
        for _, _, size, back in sorted((r for r in rows if r[0] == v), key=lambda r: r[1]):
            occupied += size
            peak = max(peak, occupied)
            occupied -= min(occupied, back)
        want[v] = peak
    assert {r.volume: r.needed for r in restore.space_needed(steps).collect()} == want
    e = steps.select("volume", F.lpad(F.col("ord").cast("string"), 4, "0").alias("path"), F.when(F.col("ord") % 4 == 0, "fifo").otherwise("file").alias("type"), "size")
    got = {(r.volume, r.path): r.offset for r in catalog.content_offsets(e, "volume").collect()}
    for v in want:
        at = 8
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: r[1]):
            assert got[v, f"{r[1]:04d}"] == at
            at += r[2] if r[1] % 4 else 0
