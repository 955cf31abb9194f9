import os
import stat
from dataclasses import replace

import pytest

from cairn.functions.codecs import Malformed
from cairn.sources import archive as A, register, stores
from cairn.sources.archive import Entry


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "testsrc"
    top.mkdir()
    (top / "empty.bin").write_bytes(b"")
    (top / "hello.txt").write_bytes(b"hello\n")
    os.chmod(top / "hello.txt", 0o600)
    (top / "all.bin").write_bytes(bytes(range(256)))
    (top / ".hidden").mkdir()
    (top / ".hidden" / "x").write_bytes(b"x" * 5000)
    (top / "中文目录").mkdir()
    (top / "中文目录" / "数据.txt").write_bytes(b"UTF-8\n")
    (top / "link").symlink_to("hello.txt")
    os.mkfifo(top / "pipe", 0o640)
    deep = top
    for k in range(8):
        deep = deep / f"depth-{k}"
        deep.mkdir()
    (deep / ("x" * 180 + ".bin")).write_bytes(b"long\n")
    os.utime(top / "all.bin", ns=(1700000000123456789, 1700000001987654321))
    return top


def _entries(df):
    rows = sorted(df.collect(), key=lambda r: (r.path != "testsrc", r.path.encode()))
    return [Entry(r.path, r.type_id, r.mode, r.uid, r.gid, r.size, tuple(r.atime), tuple(r.mtime), tuple(r.ctime), r.link_target, r.device, bytes(r.content or b"")) for r in rows]


def test_tree_source(spark, tree):
    register(spark)
    df = spark.read.format("tree").option("content", "true").load(str(tree))
    got = {e.path: e for e in _entries(df)}
    assert len(got) == 1 + sum(len(d) + len(f) for _, d, f in os.walk(tree))
    e = got["testsrc/all.bin"]
    assert e.content == bytes(range(256)) and e.mtime == (1700000001, 987654321)
    assert got["testsrc/hello.txt"].mode == 0o600 and got["testsrc/link"].link_target == "hello.txt" and got["testsrc/pipe"].type_id == 4
    some = spark.read.format("tree").option("includes", "hello.txt\ndepth-0/depth-1").load(str(tree))
    paths = {r.path for r in some.select("path").collect()}
    assert "testsrc/hello.txt" in paths and "testsrc/all.bin" not in paths and any(p.endswith(".bin") for p in paths) and "testsrc/depth-0" in paths


@pytest.mark.parametrize("pack", ["stream", "index"])
@pytest.mark.parametrize("compression", ["none", "rle", "huffman", "lz77"])
@pytest.mark.parametrize("encryption", ["none", "chacha20", "aes256"])
def test_pipelines(spark, tree, pack, compression, encryption):
    register(spark)
    entries = _entries(spark.read.format("tree").option("content", "true").load(str(tree)))
    data = A.build(entries, pack, compression, encryption, "pw", bytes(range(16)))
    header, back = A.decode(data, "pw")
    assert back == entries
    assert header.version == (4 if encryption != "none" else 3 if compression == "lz77" else 2)


def test_archive_source_and_sink(spark, tree, tmp_path):
    register(spark)
    df = spark.read.format("tree").option("content", "true").load(str(tree))
    out = str(tmp_path / "a.bak")
    for name, value in (("first", True), ("again", False)):
        write = lambda: df.coalesce(1).write.format("archive").option("compression", "lz77").option("encryption", "aes256").option("password", "pw").mode("append").save(out)
        if value:
            write()
        else:
            with pytest.raises(Exception):  # noqa: B017
                write()
    assert stat.S_IMODE(os.stat(out).st_mode) == 0o600
    back = spark.read.format("archive").option("password", "pw").load(out)
    still = lambda entries: [replace(e, atime=(0, 0)) for e in entries]  # noqa: E731  listing a directory touches its atime
    assert still(_entries(back)) == still(_entries(df))
    with pytest.raises(Exception, match="authentication"):
        spark.read.format("archive").option("password", "no").load(out).count()


def _small():
    t = (5, 7)
    return [Entry("r", 2, 0o755, mtime=t), Entry("r/a", 1, 0o644, size=3, mtime=t, content=b"abc"), Entry("r/b", 8, 0o644, mtime=t, link_target="r/a")]


@pytest.mark.parametrize("pack", ["stream", "index"])
def test_tampering_is_found(pack):
    for kind in ("none", "chacha20"):
        data = A.build(_small(), pack, "none", kind, "pw", bytes(16))
        for at in (0, 4, 8, 15, 32, 48, 80, 113, len(data) - 1):
            bad = bytearray(data)
            bad[at] ^= 1
            if kind == "none" and (at == 4 or 32 <= at < 48):
                continue  # version 3 may be without LZ77, and an archive without encryption does not use its salt
            with pytest.raises(Malformed):
                A.decode(bytes(bad), "pw")
    with pytest.raises(Malformed):
        A.decode(data[:-1], "pw")


def test_rules_across_entries():
    root, file, alias = _small()
    bad = [
        [], [file], [root, root], [root, replace(file, path="r/../x")], [root, replace(file, path="q/x")], [root, replace(file, path="r/d/x")], [root, file, replace(root, path="r/a/x")],
        [root, alias, file], [root, file, replace(alias, mode=0o600)], [root, replace(file, path="r//x")],
    ]
    for entries in bad:
        for pack in ("stream", "index"):
            with pytest.raises(Malformed):
                A.decode(A.build(entries, pack))


def test_stores():
    users = [stores.User("a.b", bytes(16), bytes(32)), stores.User("c", b"s" * 16, b"v" * 32)]
    data = stores.dump_users(users)
    assert stores.load_users(data) == users and stores.load_users(None) == []
    for bad in (data[:-1], data + b"x", b"USR2" + data[4:], stores.dump_users([users[0], users[0]]), stores.dump_users([stores.User("a/b", bytes(16), bytes(32))])):
        with pytest.raises(Malformed):
            stores.load_users(bad)
    b = stores.Backup("name", 1700000000, 42, "a" * 64)
    assert stores.load_backup(stores.dump_backup(b)) == b
    with pytest.raises(Malformed):
        stores.load_backup(stores.dump_backup(b)[:-1])
    assert stores.load_settings("# c\n[x]\nport = 70\nname= a b\n", {"port": int, "name": str}) == {"port": 70, "name": "a b"}
    for bad in ("port = x", "other = 1", "port"):
        with pytest.raises(Malformed):
            stores.load_settings(bad, {"port": int})


def test_round_trip_to_disk(spark, tree, tmp_path):
    from cairn import api

    os.link(tree / "hello.txt", tree / "same.txt")
    for k, (compression, encryption) in enumerate((("lz77", "none"), ("huffman", "aes256"))):
        out, to = str(tmp_path / f"{k}.bak"), tmp_path / f"to{k}"
        to.mkdir()
        made = api.backup(str(tree), out, "index", compression, encryption, "pw")
        assert made.entry_count == api.verify(out, "pw").entry_count and api.inspect(out).compression == compression
        assert api.restore(out, str(to), "pw").output_bytes == made.input_bytes
        for d, folders, files in os.walk(tree):
            for x in (*folders, *files):
                a = os.path.join(d, x)
                b = os.path.join(to, os.path.relpath(a, tree.parent))
                s, t = os.lstat(a), os.lstat(b)
                assert (s.st_mode, s.st_uid, s.st_gid, s.st_mtime_ns) == (t.st_mode, t.st_uid, t.st_gid, t.st_mtime_ns), x
                if stat.S_ISREG(s.st_mode):
                    assert open(a, "rb").read() == open(b, "rb").read() and s.st_nlink == t.st_nlink
        with pytest.raises(FileExistsError):
            api.restore(out, str(to), "pw")
        assert api.preview(spark, out, str(to), "pw")[1].count() == sum(len(f) for _, _, f in os.walk(tree))
        api.restore(out, str(to), "pw", overwrite=True)
    with pytest.raises(FileExistsError):
        api.backup(str(tree), out)
    with pytest.raises(ValueError, match="inside"):
        api.backup(str(tree), str(tree / "x.bak"))
    with pytest.raises(ValueError, match="selected"):
        api.backup(str(tree), str(tmp_path / "n.bak"), includes=["nothing"])


def test_restore_follows_no_link(tree, tmp_path):
    from cairn.sources.extract import extract

    (tmp_path / "to").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "to" / "r").symlink_to(tmp_path / "out")
    with pytest.raises(OSError):
        extract(_small(), str(tmp_path / "to"))
    assert not os.listdir(tmp_path / "out")


def test_snapshots_are_kept(tree, tmp_path):
    from cairn import api

    folder = tmp_path / "backups"
    folder.mkdir()
    (folder / "manual.bak").write_bytes(b"x")
    names = [api.snapshot(str(tree), str(folder), 2) for _ in range(4)]
    assert sorted(os.listdir(folder)) == sorted([*names[2:], "manual.bak"])


def test_bounded_memory(tmp_path):
    """A file far larger than what is held; the peak is that of another process, which does nothing else."""
    import subprocess
    import sys

    top = tmp_path / "big"
    (top / "sub").mkdir(parents=True)
    with open(top / "sub" / "f", "wb") as f:
        f.truncate(200 << 20)
    (tmp_path / "to").mkdir()
    run = "import resource, sys; from cairn import api; before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; a = sys.argv[1]; api.backup(a + '/big', a + '/x.bak'); r = api.restore(a + '/x.bak', a + '/to'); print(r.output_bytes, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    out = subprocess.run([sys.executable, "-c", run, str(tmp_path)], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stdout.split()
    assert int(out[0]) == 200 << 20 and int(out[1]) < 32 << 10


def test_progress_and_cancellation(tree, tmp_path):
    from cairn import api

    seen = []
    made = api.backup(str(tree), str(tmp_path / "p.bak"), compression="huffman", progress=lambda done, total: seen.append((done, total)))
    assert seen[-1][0] == seen[-1][1] and all(a[1] == seen[0][1] for a in seen) and made.entry_count > 10

    def stop(done, total):
        raise A.Cancelled("stopped")

    with pytest.raises(A.Cancelled):
        api.backup(str(tree), str(tmp_path / "q.bak"), progress=stop)
    assert sorted(os.listdir(tmp_path)) == ["p.bak", "testsrc"]
    seen.clear()
    assert api.verify(str(tmp_path / "p.bak"), progress=lambda *x: seen.append(x)).entry_count == made.entry_count and seen


def test_partial_restore_says_how_far_it_came(tree, tmp_path):
    from cairn import api
    from cairn.sources.extract import Partial

    api.backup(str(tree), str(tmp_path / "a.bak"))
    (tmp_path / "to").mkdir()

    def fail(done, total):
        if done:
            raise OSError("no more")

    with pytest.raises(Partial) as e:
        api.restore(str(tmp_path / "a.bak"), str(tmp_path / "to"), progress=fail)
    files = [os.path.join(d, x) for d, _, f in os.walk(tmp_path / "to") for x in f]
    assert e.value.committed == len(files) > 0 and not [x for x in files if x.endswith(".part")]


def test_no_room_and_locked_folders(tree, tmp_path, monkeypatch):
    from cairn import api
    from cairn.sources import extract

    api.backup(str(tree), str(tmp_path / "a.bak"))
    (tmp_path / "to").mkdir()
    plain = os.statvfs
    monkeypatch.setattr(extract.os, "statvfs", lambda p: os.statvfs_result((*plain(p)[:4], 0, *plain(p)[5:])))
    with pytest.raises(FileExistsError, match="space"):
        api.restore(str(tmp_path / "a.bak"), str(tmp_path / "to"))
    monkeypatch.setattr(extract.os, "statvfs", plain)
    monkeypatch.setattr(extract.os, "access", lambda *a: False)
    with pytest.raises(FileExistsError, match="locked"):
        api.restore(str(tmp_path / "a.bak"), str(tmp_path / "to"))
    assert not os.listdir(tmp_path / "to")


def test_archives_in_ranges(spark, tree, tmp_path):
    from cairn import api

    register(spark)
    out = str(tmp_path / "a.bak")
    api.backup(str(tree), out)
    whole = spark.read.format("archive").load(out)
    cut = spark.read.format("archive").option("splitBytes", "300").load(out)
    assert whole.rdd.getNumPartitions() == 1 < cut.rdd.getNumPartitions() and sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    raw = bytearray(open(out, "rb").read())
    raw[130] ^= 1
    bad = tmp_path / "b.bak"
    bad.write_bytes(raw)
    with pytest.raises(Exception, match="digest"):
        spark.read.format("archive").option("splitBytes", "300").load(str(bad)).count()


def test_listing_of_a_source(spark, tree):
    from cairn import api

    os.link(tree / "hello.txt", tree / "same.txt")
    got = {r.path: r for r in api.listing(spark, str(tree)).collect()}
    assert len(got) == sum(len(d) + len(f) for _, d, f in os.walk(tree)) and got["same.txt"].type == "file" and got["same.txt"].size == got["hello.txt"].size == 6
    assert got["中文目录/数据.txt"].size == 6 and got["pipe"].type == "fifo" and "testsrc" not in got


def test_watch_on_changes(tree, tmp_path):
    from cairn import api

    folder, waits = tmp_path / "out", []
    folder.mkdir()

    def wait(seconds):
        waits.append(seconds)
        if len(waits) == 3:
            (tree / "new").write_bytes(b"x")
        return len(waits) > 6

    assert api.watch(str(tree), str(folder), 5, 100, wait, realtime=True) == 2 and len(os.listdir(folder)) == 2
    waits.clear()
    assert api.watch(str(tree), str(folder), 3, 100, lambda s: waits.append(s) or len(waits) > 3) == 4 and len(os.listdir(folder)) == 3
    with pytest.raises(ValueError):
        api.watch(str(tree), str(tree / "x"), 3, 100, wait)


def test_saved_stores(tmp_path):
    users = [stores.User("a.b", bytes(16), bytes(32)), stores.User("c", b"s" * 16, b"v" * 32)]
    path = str(tmp_path / "users")
    assert stores.load_users(stores.held(path)) == []
    stores.save_users(path, users[:1])
    stores.save_users(path, users)
    assert stores.load_users(stores.held(path)) == users and os.listdir(tmp_path) == ["users"] and stat.S_IMODE(os.stat(path).st_mode) == 0o600
    assert stores.find_user(users, "c") == users[1] and stores.find_user(users, "d") is None
    with pytest.raises(Malformed):
        stores.save_users(path, [users[0], users[0]])
    assert stores.load_users(stores.held(path)) == users
    account = tmp_path / "account"
    account.mkdir()
    for k in range(5):
        stores.save_backup(str(account / f"{k:032x}.meta"), stores.Backup("n", 100 + k // 2, k, "a" * 64))
    (account / "x.meta").write_bytes(b"")
    (account / f"{9:032x}.bak").write_bytes(b"")
    assert [(int(i, 16), b.timestamp) for i, b in stores.account_history(str(account))] == [(4, 102), (2, 101), (3, 101), (0, 100), (1, 100)]


def test_wire_fields():
    data = stores.to_wire("BHIQs", 1, 2, 3, 4, "é\udcff")
    assert data == bytes([1, 0, 2, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 4, 0, 3]) + "é".encode() + b"\xff" and stores.from_wire("BHIQs", data) == (1, 2, 3, 4, "é\udcff")
    for bad in (data[:-1], data + b"x", data[:5], b""):
        with pytest.raises(Malformed):
            stores.from_wire("BHIQs", bad)
    with pytest.raises(Malformed):
        stores.to_wire("s", "x" * 70_000)


def test_legacy_archives():
    """Encrypted archives of versions 1 to 3 have no authentication and are read only where that is allowed; version 1 has no hard links."""
    import hashlib

    from cairn.functions.ciphers import crypt

    def legacy(entries, version, compression="none"):
        packed = b"".join(A.packed_pieces(entries, "stream"))
        payload = crypt("chacha20", "pw", bytes(16), A.PIECES[compression] and b"".join(A.PIECES[compression](lambda: iter([packed]), len(packed))))
        numbers = (1, {"none": 0, "rle": 1}[compression], 3)
        return A.HEADER.pack(A.MAGIC, version, A.HEADER.size, 1 | 2 * (compression != "none") | 4, *numbers, 0, len(packed), len(payload), bytes(16), hashlib.sha256(packed).digest(), hashlib.sha256(payload).digest()) + payload

    root, file, alias = _small()
    for version in (1, 2, 3):
        for compression in ("none", "rle"):
            data = legacy([root, file], version, compression)
            assert A.decode(data, "pw", allow_legacy_encryption=True)[1] == [root, file]
            with pytest.raises(Malformed, match="legacy"):
                A.decode(data, "pw")
            with pytest.raises(Malformed):
                A.decode(data, "no", allow_legacy_encryption=True)
    with pytest.raises(Malformed, match="hard links"):
        A.decode(legacy([root, file, alias], 1), "pw", allow_legacy_encryption=True)
    assert A.decode(legacy([root, file, alias], 2), "pw", allow_legacy_encryption=True)[1] == [root, file, alias]
