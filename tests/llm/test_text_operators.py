"""Secrets, repeated strings, tokens, quality rules, token files and media against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from cairn.llm import media, quality_rules as Q, queries, rans
from cairn.llm.near_duplicates import near_duplicates
from cairn.llm.quality_rules import quality_rules
from cairn.llm.secret_scan import digest, joined_spans, redacted, secret_scan
from cairn.llm.substring_dedup import without_repeats
from cairn.llm.suffix_array import repeated, suffix_array
from cairn.llm.token_counts import token_counts
from cairn.llm.token_files import read_token_files, read_token_range, write_token_files
from pyspark.sql import functions as F
from tests.llm import cases
from tests.oracle import check

SMALL = "/root/testdata/sf0.001"
PATH = queries.vocabulary_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def small(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


# --- secrets ------------------------------------------------------------------------------------
def _base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def _secrets(texts, found):
    for k, text in texts.items():
        base = _base(text)
        assert [found[k].n_assign, found[k].n_access, found[k].n_hex] == [sum(x[1] == j for x in base) for j in range(3)]
        joined = ",".join(f"{('assign', 'access', 'hex')[j]}:{a}:{z}" for a, j, z in base)
        assert found[k].b == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(found[k].s.split(","))


def test_secret_bases(spark):
    scan = lambda d: cases.by_id(secret_scan(d).select("*", digest(F.col("base_spans")).alias("b"), joined_spans(F.col("spans")).alias("s")))
    _secrets({r[0]: r[1] or "" for r in cases.rows()}, scan(cases.docs(spark)))
    _secrets(small(spark), scan(spark.read.parquet(f"{SMALL}/documents.parquet")))


def test_ownership(spark):
    own, wide = "Zk3vQ9xT7LmN2pRw8sYb", "Qr8sT2vW5xZ7bC9dF4gH"
    rows = [(1, f"see {own} here", "a"), (2, f"key {own}", "a"), (9, f"token={own}", "b")] + [(k, f"docs say {wide} ok", f"o{k}") for k in range(3, 8)] + [(20, f"secret = {wide}", "z"), (21, None, "a"), (22, f"{own} {own}", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = cases.by_id(secret_scan(d, most_owners=3).select("*", joined_spans(F.col("spans")).alias("s")))
    assert got[1].s == "owned:4:24" and got[1].n_owned == 1 and got[22].s == "owned:0:20,owned:21:41"
    assert got[9].s == "assign:0:26" and got[9].n_owner_specific == 1
    assert all(got[k].s == "" and got[k].n_widely_copied == 1 for k in range(3, 8)) and got[20].s == "assign:0:29"
    got = cases.by_id(secret_scan(d, most_owners=2).select("*", joined_spans(F.col("spans")).alias("s")))
    assert got[1].s == "" and got[1].n_widely_copied == 1  # a, b and the null owner
    clean = cases.by_id(redacted(d, secret_scan(d, most_owners=3)))
    assert clean[1].text == "see [SECRET] here" and clean[9].text == "[SECRET]" and clean[21].text is None and clean[22].text == "[SECRET] [SECRET]" and clean[3].text == rows[3][1]


def test_verdicts_against_plain_counts(spark):
    """Every candidate place of a table, with the distinct owners and repositories of its string."""
    from cairn.llm.secret_scan import RUN, looks_live

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    owners, repositories = collections.defaultdict(set), collections.defaultdict(set)
    for r in rows:
        for m in RUN.finditer(r.text or ""):
            owners[m[0]].add(r.source)
            repositories[m[0]].add((r.source, r.lang))
    want = {}
    for r in rows:
        live = [m for m in RUN.finditer(r.text or "") if looks_live(m[0])]
        few = lambda x: "owner" if len(owners[x]) <= 2 and len(repositories[x]) <= 6 else "copied"
        want[r.doc_id] = ",".join(f"{m.start()}:{m.end()}:{len(owners[m[0]])}:{len(repositories[m[0]])}:{few(m[0])}" for m in live)
    got = {r.doc_id: r.verdicts for r in queries.op1_secret_scans(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and any(want.values())


def test_redaction_of_many_spans(spark):
    """In time that grows with the text, not with its square."""
    import time

    text = "é token = abcdefghijkl0123 " * 20_000
    d = spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in redacted(d, secret_scan(d, owner=F.lit("o"))).collect()}
    assert got == {1: "é [SECRET] " * 20_000, 2: None, 3: "x"} and time.perf_counter() - began < 60


def test_redaction_beside_clashing_names(spark):
    d = cases.docs(spark)
    out = redacted(d, secret_scan(d))
    assert out.columns == d.columns
    for r in out.collect():
        assert not _base(r.text or "") and r.spans == "x"


def test_repeated_rows_and_empty_tables(spark):
    d = cases.docs(spark, [(3, "one", "s0"), (None, "token = abcdefghijklmnop", None)])
    assert secret_scan(d).count() == d.count() and quality_rules(d).count() == d.count() and token_counts(d, PATH).count() == d.count()
    e = cases.empty(spark)
    assert secret_scan(e).count() == quality_rules(e).count() == token_counts(e, PATH).count() == without_repeats(e).count() == media.media_features(media.stored_media(e)).count() == 0


# --- repeated strings ---------------------------------------------------------------------------
def _stripped(raws, width):
    seen = collections.Counter(r[k : k + width] for r in raws for k in range(len(r) - width + 1))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = True
        yield len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("width", [200, 40])
def test_removed_strings(spark, width):
    got = cases.by_id(without_repeats(cases.docs(spark), width))
    texts = [(r[0], (r[1] or "").encode()) for r in cases.rows()]
    for (k, _), want in zip(texts, _stripped([t for _, t in texts], width), strict=True):
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == want, k


def test_removed_strings_of_tables(spark):
    texts = small(spark)
    got = cases.by_id(queries.op2_suffix_array_dedup(spark, SMALL))
    for k, want in zip(texts, _stripped([t.encode() for t in texts.values()], 200), strict=True):
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == want, k


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_hot_keys(spark, monkeypatch, few):
    """Keys of more segments than a shard takes: cut into pieces, and those into windows, with the places broadcast or not."""
    import random

    from cairn.llm import substring_dedup as D

    monkeypatch.setattr(D, "KEY_SEGMENTS", 4)
    monkeypatch.setattr(D, "BROADCAST_SEGMENTS", few)
    rng = random.Random(5)
    passages = ["".join(chr(97 + k * 7 % 26) for k in range(260)), "".join(rng.choices("abcdefg ", k=205)), "".join(rng.choices("xyz", k=150)), "ab" * 300, "word " * 90]
    texts = [f"{k:040d}{passages[0]}{k * 37:050d}" for k in range(25)] + [passages[0], passages[0]]
    texts += ["".join(rng.choices("pqr", k=rng.randrange(60))) + passages[1 + k % 4][rng.randrange(30) : -rng.randrange(1, 30)] + "".join(rng.choices("pqr", k=rng.randrange(60))) for k in range(60)]
    d = spark.createDataFrame([(k // 2, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    for width in (200, 40):
        got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(d, width).collect())
        assert got == sorted(_stripped([t.encode() for t in texts], width))


def test_cores():
    """Equal windows are in pieces of one core, and a piece's windows differ."""
    import random

    from cairn.llm import substring_dedup as D

    rng = random.Random(9)
    for _ in range(40):
        raw = "".join(rng.choices("ab", k=rng.randrange(200, 420))).encode() if rng.random() < 0.5 else (b"abcdefghij" * 50)[: rng.randrange(200, 420)]
        one = np.frombuffer(raw, np.uint8)
        text, low, size, key, _ = D.segments(one, np.array([0, len(raw)]))
        seen = {}
        for a, n, k in zip(low.tolist(), size.tolist(), key.tolist()):
            covered = 0
            for first, windows, core in D.cores(raw[a : a + n + 199], k, 200):
                own = [raw[a + w : a + w + 200] for w in range(first, first + windows)]
                assert first == covered and len(set(own)) == windows and all(core[:-2] in w for w in own)
                covered += windows
                for w in own:
                    assert seen.setdefault(w, core) == core
            assert covered == n
        assert len(seen) <= len(raw) - 199


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)), 0)
        assert suffix_array(s, 8).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())
    for _ in range(200):  # long runs of one symbol, and strings that repeat
        s = np.append(np.tile(np.repeat(rng.integers(1, 7, 8), rng.integers(1, 9, 8)), rng.integers(1, 4)), 0)
        assert suffix_array(s, 8).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())
    assert [x.tolist() for x in repeated([b"abcabc", b"", b"xabc", b"ab"], 3)] == [[True, False, False, True], [], [False, True], []]


def test_names_are_sorted_by_recursion(spark, monkeypatch):
    """Real text, as much as a shard holds: every string of names is sorted by the same way, to the end."""
    from cairn.llm import suffix_array as A

    calls, plain = [], A.suffix_array
    monkeypatch.setattr(A, "suffix_array", lambda s, symbols: calls.append((len(s), symbols)) or plain(s, symbols))
    raw = "\n".join(small(spark).values()).encode()[: 512 << 10]
    s = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 1, 0)
    order = A.suffix_array(s, 257)
    assert len(calls) > 3 and calls[1][1] > 4000 and all(a[0] > 2 * b[0] for a, b in zip(calls, calls[1:]))
    assert sorted(order.tolist()) == list(range(len(s))) and all(raw[a:] < raw[b:] for a, b in zip(order[1:-1:37].tolist(), order[2::37].tolist()))


# --- tokens -------------------------------------------------------------------------------------
def test_token_counts(spark, tokenizer):
    for df in (cases.docs(spark), spark.read.parquet(f"{SMALL}/documents.parquet")):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        got = cases.by_id(token_counts(df, PATH, limit=100))
        for k, text in texts.items():
            n = len(tokenizer.encode(text, add_special_tokens=False).ids)
            assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len(text.encode()), n, n > 100), text


def test_contractions_and_marks(tokenizer):
    import random

    import pyarrow as pa

    from cairn.llm.common import utf8
    from cairn.llm.wordpieces import Pieces, read_vocabulary

    rng, table = random.Random(1), Pieces(read_vocabulary(PATH))
    texts = ["".join(rng.choices("aAzÉé'sStTlLrReEvVmdD 09!?-<|\n«–ß×œİ²", k=rng.randrange(40))) for _ in range(3000)] + ["", "it'", "'", "a<|endoftext|>b"]
    raw, at = utf8(pa.array(texts))
    ids, n, _ = table.encode(raw, at)
    for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert part.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def thue_morse(n, letters):
    """Words of n letters, one the other's complement: sums over positions weighted by powers of any odd number are equal for both."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_words_that_collide_under_polynomials(spark, tokenizer):
    import pyarrow as pa

    from cairn.llm.common import utf8, word_hashes
    from cairn.llm.wordpieces import Pieces, read_vocabulary

    texts = [x for n in (8, 16, 64, 512, 1024, 2048) for letters in ("ab", "ef", "xq") for x in thue_morse(n, letters)]
    raw, at = utf8(pa.array(texts))
    assert len(set(word_hashes(raw, at[:-1], at[1:]).tolist())) == len(texts)
    table = Pieces(read_vocabulary(PATH))
    for text, part in zip(texts, np.split(table.encode(raw, at)[0], np.cumsum(table.encode(raw, at)[1])[:-1]), strict=True):
        assert part.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_duplicates(d).where("NOT kept").count() == 0


def test_a_held_hash_of_another_string(tokenizer, monkeypatch):
    """Whatever collides, ids are the library's: hits are held against bytes."""
    import pyarrow as pa

    from cairn.llm import wordpieces
    from cairn.llm.common import utf8

    plain = wordpieces._hashes
    monkeypatch.setattr(wordpieces, "_hashes", lambda *a: plain(*a) % np.uint64(4099) + np.uint64(1))
    table = wordpieces.Pieces(wordpieces.read_vocabulary(PATH))
    texts = [(r[1] or "").replace("\0", "") for r in cases.rows()]
    for _ in range(2):
        ids, n, _ = table.encode(*utf8(pa.array(texts)))
        for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert part.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, tokenizer, tmp_path, monkeypatch):
    d = cases.docs(spark)
    write_token_files(d, str(tmp_path / "f"), PATH, end_id=2, block=500)
    got = cases.by_id(read_token_files(spark, str(tmp_path / "f")))
    start = 0
    for k, text, *_ in sorted(cases.rows()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())) and bytes(got[k].ids) == ids.tobytes()
        start += len(ids)
    every = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in sorted(got.values(), key=lambda r: r.start)])
    for begin, end in ((0, start), (3, 4), (700, 5300), (start - 1, start + 9), (5, 5)):
        out = np.zeros(max(0, min(end, start) - begin), np.uint32)
        for r in read_token_range(spark, str(tmp_path / "f"), begin, end).collect():
            piece = np.frombuffer(bytes(r.ids), "<u4")
            out[r.position - begin : r.position - begin + len(piece)] = piece
        assert (out == every[begin:end]).all()
    write_token_files(cases.empty(spark), str(tmp_path / "e"), PATH)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0
    write_token_files(spark.createDataFrame([(None, "a"), (5, "b"), (5, "b"), (None, None)], "doc_id long, text string"), str(tmp_path / "n"), PATH)
    assert [(r.doc_id, r.start) for r in read_token_files(spark, str(tmp_path / "n")).orderBy("start").collect()] == [(None, 0), (None, 1), (5, 3), (5, 5)]


def test_range_coder():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.4, 200_000), 49_407).astype(np.uint32)
    table = rans.Table(rans.normalised(np.bincount(ids, minlength=1 << 16)))
    for n in (0, 1, 7, 1024, 1025, 70_001):
        assert (table.decode(table.encode(ids[:n])) == ids[:n]).all()
    block = table.encode(ids, lanes=256)
    rows = rans.CHECKPOINT * 256
    assert (table.decode(block, 3, 5) == ids[3 * rows : 5 * rows]).all()
    assert (table.decode(block, 11) == ids[11 * rows :]).all() and (table.decode(block, 0, 1) == ids[:rows]).all()
    cut = bytearray(block)
    cut[-1] ^= 1  # a stretch is held against its own checksums, whatever is wrong in others
    assert (table.decode(bytes(cut), 3, 5) == ids[3 * rows : 5 * rows]).all()
    for at in (0, 8, 40, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises((ValueError, IndexError)):
            table.decode(bytes(bad))
    assert (rans.Table(rans.normalised(np.zeros(100))).decode(rans.Table(rans.normalised(np.zeros(100))).encode(np.arange(100))) == np.arange(100)).all()


# --- quality rules ------------------------------------------------------------------------------
def test_quality_counts(spark):
    got = cases.by_id(quality_rules(cases.docs(spark)))
    for k, text, *_ in cases.rows():
        text = text or ""
        words = cases.WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = collections.Counter(windows)
        repeat = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if cases.WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)), k
        assert r.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words)) and (not r.kept or not r.base_failed)


def test_quality_sql_and_labels(spark):
    check(spark, queries.op5_quality_rules, queries.ORACLE["op5_quality_rules"])
    rows = quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed")
    assert rows.where("quality = 1 AND NOT kept").count() == 0 and rows.where("quality = 0 AND kept").count() == 0


def test_quality_plan_is_native(spark):
    plan = Q.accepted(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    kept = {r.doc_id for r in quality_rules(cases.docs(spark)).where("kept").collect()}
    out = Q.accepted(cases.docs(spark))
    assert out.columns == cases.docs(spark).columns and {r.doc_id for r in out.collect()} == kept


# --- media --------------------------------------------------------------------------------------
def test_media_of_texts(spark):
    got = cases.by_id(media.media_features(media.stored_media(cases.docs(spark)), tile=32))
    for k, text, *_ in cases.rows():
        raw = (text or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(r.tiles) == 2 * -(-len(payload) // 2048)
    assert got[8].feature == got[9].feature != got[10].feature


def test_image_formats(spark):
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (7, 5), (9, 64), (6, 3, 3)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_netpbm(pixels)) == pixels).all() and (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert media.decode(b"P1 # note\n3 2\n1 0 1\n0 1 0\n").tolist() == [[1, 0, 1], [0, 1, 0]] == media.decode(b"P4\n3 2\n\xa0\x40").tolist()
    assert media.decode(b"P2\n2 1\n1000\n0 999\n").tolist() == [[0, 999]] and media.decode(b"P5 2 1 300\n\x00\x05\x01\x00").tolist() == [[5, 256]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P5\n2 2\n255\nab", b"P9\n1 1\n", b"BM", b"P5\n-1 2\n255\n", b"P2\n2 2\n255\n1 2 3", media.encode_bmp(np.zeros((4, 4), np.uint8))[:-1]):
        with pytest.raises(ValueError):
            media.decode(bad)
    x = rng.random((11, 7))
    assert np.allclose(media.area_resized(x, 11, 7), x) and np.allclose(media.area_resized(x, 1, 1), x.mean())
    fine = np.repeat(np.repeat(x, 6, axis=0), 10, axis=1)  # each target pixel is whole here
    assert np.allclose(media.area_resized(x, 6, 10), fine.reshape(6, 11, 10, 7).mean(axis=(1, 3)))
    assert (np.load(__import__("io").BytesIO(media.npy(x))) == x).all() and media.difference_hash(np.tile(np.arange(90), (8, 1))) == "ff" * 8
    clash = spark.createDataFrame([(1, bytearray(media.encode_netpbm(np.ones((2, 2), np.uint8))), "x", ("y",))], "id long, media binary, feature string, `a.b` struct<`c.d`:string>")
    row = media.media_features(clash).first()
    assert row["a.b"]["c.d"] == "y" and len(row.feature) == 32 and row.payload_bytes == 4
    rows = media.media_features(spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "id long, media binary")).collect()
    assert [(r.id, r.payload_bytes, r.feature) for r in rows] == [(1, None, None), (2, None, None)]


def test_features_against_plain_means(spark):
    """Each target pixel as the mean over its rectangle, pixel by pixel with their fractions; then neighbours and a digest."""
    import io

    def mean(pixels, y0, y1, x0, x1):
        total = 0.0
        for y in range(int(y0), -int(-y1 // 1)):
            for x in range(int(x0), -int(-x1 // 1)):
                total += pixels[y][x] * (min(y + 1, y1) - max(y, y0)) * (min(x + 1, x1) - max(x, x0))
        return total / ((y1 - y0) * (x1 - x0))

    def resized(pixels, height, width):
        rows, columns = len(pixels), len(pixels[0])
        return [[mean(pixels, y * rows / height, (y + 1) * rows / height, x * columns / width, (x + 1) * columns / width) for x in range(width)] for y in range(height)]

    texts = ["", "short", "word " * 90, "Überlänge é " * 40, "".join(chr(33 + k % 90) for k in range(1000))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.feature for r in media.media_features(media.stored_media(d, tile=64), tiles_col="npy_tiles").collect()}
    for k, text in enumerate(texts):
        raw = text.encode()
        raw += bytes(64 if not raw else -len(raw) % 64)
        pixels = [list(raw[a : a + 64]) for a in range(0, len(raw), 64)]
        small = resized(pixels, 8, 9)
        bits = "".join("01"[round(a, 6) < round(b, 6)] for row in small for a, b in zip(row, row[1:]))
        out = io.BytesIO()
        np.save(out, np.array([[round(round(x, 9)) for x in row] for row in resized(pixels, 32, 32)], np.uint8))
        assert got[k] == f"{int(bits, 2):016x}" + hashlib.sha256(out.getvalue()).hexdigest()[:16], k


def test_bands_of_the_integral_image(monkeypatch):
    """Tall images go through band by band."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (9001, 64)).astype(np.uint8)
    total = np.zeros((9002, 65))
    total[1:, 1:] = x.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    edge = np.arange(33) * (9001 / 32)
    low = np.minimum(edge.astype(int), 9000)
    rows = total[low] + (edge - low)[:, None] * (total[low + 1] - total[low])
    want = np.diff(np.diff(rows[:, ::2], axis=0), axis=1) * (32 * 32 / (9001 * 64))
    assert np.allclose(media.area_resized(x, 32, 32), want)


def test_stored_tiles(spark, monkeypatch):
    held = []
    monkeypatch.setattr(queries, "stored_media", lambda *a, **k: held.append(media.stored_media(*a, **k)) or held[-1])
    got = cases.by_id(queries.op9_media_columns(spark, "/root/testdata/sf0.001"))
    plain = cases.by_id(media.media_features(media.stored_media(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))).drop("tiles"))
    assert got == plain and all(r.feature for r in got.values())
    for r in held[0].collect():
        cut = [np.load(__import__("io").BytesIO(x)) for x in r.npy_tiles]
        assert all(x.shape[0] == 64 for x in cut[:-1]) and (np.concatenate(cut) == media.decode(r.media)).all()
    x = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert (media.untiled([media.npy(t) for t in media.tiles(x, 3)], 7) == x).all()


def test_bmp_of_masks():
    import struct

    def bmp(bits, packed, body, masks=()):
        head = struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, bits, packed, len(body), 0, 0, 0, 0) + struct.pack(f"<{len(masks)}I", *masks)
        return struct.pack("<2sIHHI", b"BM", 14 + len(head) + len(body), 0, 0, 14 + len(head)) + head + body

    assert media.decode(bmp(16, 0, struct.pack("<2H", 0x7C00, 0x001F))).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    assert media.decode(bmp(16, 3, struct.pack("<2H", 0x07E0, 0xF800), (0xF800, 0x07E0, 0x001F))).tolist() == [[[0, 255, 0], [255, 0, 0]]]
    assert media.decode(bmp(32, 3, struct.pack("<2I", 0x010203FF, 0xFF000000), (0xFF000000, 0xFF0000, 0xFF00))).tolist() == [[[1, 2, 3], [255, 0, 0]]]
