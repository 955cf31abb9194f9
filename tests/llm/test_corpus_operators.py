"""Near-duplicates, packing, mixing and the classifier against plain versions, exact rules or held-out labels."""

import collections
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import graph, queries, superminhash
from cairn.llm.common import shingles, utf8, word_hashes, words
from cairn.llm.near_duplicates import deduplicated, linked, near_duplicates
from cairn.llm.packing import fill_rate, pack
from cairn.llm.quality_rules import STOP_WORDS
from cairn.llm.source_mixing import apportioned, mix_sources, mixed_documents, targets
from cairn.llm.weak_labels import BUCKETS, LABELLERS, fitted_labels, fitted_scorer, quality_classifier, scorer_weights
from pyspark.sql import functions as F
from tests.llm import cases

SMALL = "/root/testdata/sf0.001"
queries_stop = set(STOP_WORDS)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- near-duplicates ----------------------------------------------------------------------------
def plain_groups(texts, width=3, per=85, of=100):
    """id: (size of its set, smallest id reachable), by comparing all pairs."""
    sets, whole = {}, {}
    for k, text in texts.items():
        w = tuple(cases.WORD.findall((text or "").translate(LOWER)))
        whole[k] = w
        sets[k] = {w[i : i + width] for i in range(len(w) - width + 1)} if len(w) >= width else {w} if w else set()
    up = {k: k for k in texts}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    by = collections.defaultdict(set)
    for k, s in sets.items():
        for x in s:
            by[x].add(k)
    for k, s in sets.items():
        shared = collections.Counter(j for x in s for j in by[x] if j < k)
        for j, n in shared.items():
            if of * n >= per * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                up[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.mark.parametrize(("width", "per"), [(3, 85), (5, 80), (2, 50)])
def test_groups(spark, width, per):
    texts = {r[0]: r[1] for r in cases.rows()}
    got = cases.by_id(near_duplicates(cases.docs(spark), width=width, per=per))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == plain_groups(texts, width, per)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_groups_of_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = cases.by_id(queries.op4_minhash_near_dedup(spark, "/root/testdata/sf0.01"))
    want = plain_groups(texts)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want and len({c for _, c in want.values()}) < len(want)


def test_large_groups_are_cut_without_loss(spark, monkeypatch):
    import random

    from cairn.llm import near_duplicates as N

    monkeypatch.setattr(N, "BUCKET", 8)
    monkeypatch.setattr(N, "FAMILY", 6)
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    texts = {k: " ".join(w if rng.random() > rng.choice((0.005, 0.03, 0.06)) else f"x{rng.randrange(9)}" for w in base) for k in range(60)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(d).collect()} == plain_groups(texts)


def test_awkward_rows(spark):
    d = spark.createDataFrame([(None, "same words in both"), (None, None), (7, "same words in both"), (7, "same words in both"), (3, ""), (5, "SAME words  in both")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(d).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (3, 3, True), (5, 5, True), (7, 5, False), (7, 5, False)]
    assert near_duplicates(cases.empty(spark)).count() == 0
    out = deduplicated(cases.docs(spark))
    assert out.columns == cases.docs(spark).columns and out.count() == near_duplicates(cases.docs(spark)).where("kept").count()


def grouped_rows(rows, width=3, per=85):
    """(id, size of its set, smallest id reachable) of each row, sorted; rows of one id are one document."""
    by_row = plain_groups({k: text for k, (i, text) in enumerate(rows) if i is not None}, width, per)
    up = {i: i for i, _ in rows if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (_, root) in by_row.items():
        a, b = find(rows[k][0]), find(rows[root][0])
        up[max(a, b)] = min(a, b)
    return sorted((rows[k][0], n, find(rows[k][0])) for k, (n, _) in by_row.items())


def test_repeated_rows_lose_no_link(spark):
    base = [(r[0], r[1]) for r in cases.rows()]
    texts = dict(base)
    # Every row twice; one row twice; ids of two texts, of near texts, of a text and none; the least of two classes.
    several = [(200, texts[8]), (200, texts[40]), (201, texts[41]), (201, texts[8] + " more"), (202, texts[42]), (202, ""), (-5, texts[43]), (-5, texts[44]), (-5, texts[8] + " tail"), (-6, "alone"), (-6, "apart")]
    for rows in (base * 2, [*base, base[13]], base + several, (base + several) * 3):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = near_duplicates(d).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == grouped_rows(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_linked_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    up = list(range(60))
    for a, b in linked(sets, 60, 100):
        up = [up[a] if x == up[b] else x for x in up]
    want = list(range(60))
    for a in range(60):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 60 * (len(sets[a]) + len(sets[b]) - n):
                want = [want[b] if x == want[a] else x for x in want]
    groups = lambda u: {tuple(k for k in range(60) if u[k] == x) for x in set(u)}
    assert groups(up) == groups(want)


def test_signatures():
    one = superminhash.signatures(np.array([99], np.uint64), np.array([1, 0]), 64)
    assert sorted((one[0] >> np.uint64(40)).tolist()) == list(range(64)) and (one[1] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    rng = np.random.default_rng(0)
    errors = []
    for n in (5, 40, 300):
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], pool[n // 4 : n + n // 4]
            s = superminhash.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), 240)
            together = superminhash.signatures(a, np.array([len(a)]), 240)
            assert (together[0] == s[0]).all()  # of its own elements only
            errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035


def test_words_and_shingles():
    texts = ["", "a", "a b", " a  b c ", "x y z x y z", "ab", "\x0babc\x0c", None, "é É a"]
    raw, at = utf8(pa.array(texts))
    starts, ends, counts = words(raw, at)
    assert counts.tolist() == [len(cases.WORD.findall(t or "")) for t in texts]
    hashes = word_hashes(raw, starts, ends)
    names = [w for t in texts for w in cases.WORD.findall((t or "").translate(LOWER))]
    assert len(set(hashes.tolist())) == len(set(names)) and len(dict(zip(names, hashes.tolist(), strict=True))) == len(set(names))
    _, n = shingles(hashes, counts, 3)
    assert n.tolist() == [0, 1, 1, 1, 4, 1, 1, 0, 1]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)] + [(2000, k) for k in range(2001, 2300)]
    up = {}

    def find(k):
        up.setdefault(k, k)
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_and_of_many(spark):
    """Few edges are one task's, in a few jobs, however long a chain is; rounds, which take more of them, give the same."""
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(3000 - k, 3001 - k) for k in range(90)] + [(7, 7), (7, -2), (1 << 40, -(1 << 40))] + [(int(a), int(b)) for a, b in zip(rng.permutation(500) + 5000, rng.permutation(500) + 5000, strict=True)]
    df = spark.createDataFrame(edges * 2, "a long, b long")
    found, jobs = [], []
    for few in (len(edges) * 2, 0):
        spark.sparkContext.setJobGroup(f"components-{few}", "")
        found.append(sorted((r.id, r.component) for r in graph.components(df, few=few).collect()))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{few}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and len(found[0]) == len({x for e in edges if e[0] != e[1] for x in e})
    assert dict(found[0])[1200] == 1000 and dict(found[0])[1 << 40] == -(1 << 40)
    assert jobs[0] <= 6 < jobs[1]
    assert graph.components(df.where("a = b"), few=0).count() == 0


# --- packing ------------------------------------------------------------------------------------
@pytest.mark.parametrize("rows_of_shard", [1024, 9])
def test_bins(spark, rows_of_shard):
    d = cases.docs(spark, [(500 + k, "copy of this text", "s0") for k in range(9)])
    out = pack(d, capacity=200, per_source=2, shard_rows=rows_of_shard).collect()
    known = {r.doc_id: r for r in d.collect()}
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        if r.bin is not None:
            bins[r.bin].append(r)
    for k, doc in known.items():
        n = len(cases.WORD.findall(doc.text or ""))
        own = sorted(pieces[k], key=lambda r: r.piece)
        assert own[0].begin == 0 and own[-1].end == n == own[0].size and all(a.end == b.begin for a, b in zip(own, own[1:])) and (n > 0) == (own[0].bin is not None)
    for rows in bins.values():
        filled = sum(r.end - r.begin for r in rows)
        assert 0 < filled <= 200 and all(r.filled == filled for r in rows) and sorted(r.place for r in rows) == list(range(len(rows)))
        assert max(collections.Counter(known[r.doc_id].source for r in rows).values()) <= 2 and len({known[r.doc_id].text for r in rows}) == len(rows)
    assert pack(cases.empty(spark)).count() == 0 and {tuple(r) for r in pack(d, capacity=200, per_source=2, shard_rows=rows_of_shard).collect()} == {tuple(r) for r in out}


def test_tightest_compatible_bin():
    from cairn.llm.packing import Packer

    p = Packer(10, 1)
    assert p.add(7, 1, 1) == (0, 0) and p.add(6, 2, 2) == (1, 0)
    assert p.add(3, 4, 4) == (0, 1)  # both fit; residual 3 is tighter than 4
    assert p.add(2, 2, 8) == (2, 0)  # bin 1 has the source already
    assert p.add(2, 8, 2) == (2, 1)  # bin 1 has the cluster already
    assert p.add(4, 8, 16) == (1, 1) and p.residual == [0, 0, 6]


def test_fill_rate(spark):
    row = fill_rate(queries.op6_best_fit_packing(spark, "/root/testdata/sf0.1")).first()
    assert row.rate > 0.97


# --- mixing -------------------------------------------------------------------------------------
def test_apportionment():
    def plain(votes, seats, most):
        got = [0] * len(votes)
        for _ in range(seats):
            best = [k for k in range(len(votes)) if votes[k] > 0 and got[k] < most[k]]
            if not best:
                break
            k = max(best, key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
            got[k] += 1
        return got

    rng = np.random.default_rng(1)
    for _ in range(300):
        n = rng.integers(1, 9)
        votes, most = rng.integers(0, 400, n).tolist(), rng.integers(0, 200, n).tolist()
        seats = int(rng.integers(0, 300))
        assert apportioned(votes, seats, most) == plain(votes, seats, most)
    assert apportioned([53, 24, 23], 7, [9, 9, 9]) == [3, 2, 2]


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1], Fraction(1)) == [Fraction(375, 2), 75, Fraction(75, 2)]
    assert targets([10, 100, 100], [5, 2, 1], Fraction(3, 2)) == [20, Fraction(590, 3), Fraction(295, 3)]
    assert targets([], [], Fraction(1)) == [] and targets([0, 0], [1, 2], Fraction(1)) == [0, 0]


def test_mix(spark):
    for d in (cases.docs(spark), spark.read.parquet("/root/testdata/sf0.1/documents.parquet")):
        rows = mix_sources(d).collect()
        sizes = {r.doc_id: len(cases.WORD.findall(r.text or "")) for r in d.select("doc_id", "text").collect()}
        assert {r.doc_id: r["size"] for r in rows} == sizes and len(rows) == len(sizes)
        by = collections.defaultdict(list)
        for r in rows:
            by[r.source].append(r)
            assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.passes * r["size"] + sum(p.end - p.begin for p in r.parts)
        names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by)
        want = targets([sum(r["size"] for r in by[s]) for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], Fraction(3, 2))
        for s, goal in zip(names, want, strict=True):
            assert by[s][0].target == pytest.approx(float(goal)) and by[s][0].source_size == sum(r["size"] for r in by[s])
            assert abs(sum(r.taken for r in by[s]) - goal) <= max(1, 0.01 * goal)
    again = {tuple(map(str, r)) for r in mix_sources(d.repartition(3)).collect()}
    assert again == {tuple(map(str, r)) for r in rows}
    assert mix_sources(cases.empty(spark)).count() == 0


def test_mix_of_many_rows(spark):
    """A cell must come whole to its task, also where adaptive execution reads the join before it in another way."""
    d = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 19)).alias("source"))
    got = mix_sources(d, size=F.expr("1 + doc_id % 700")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert len(got) == 20 and all(abs(r.t / r.g - 1) < 0.01 for r in got)


@pytest.mark.parametrize(("words", "sources", "rows"), [(5, 99, 20_000), (40, 199, 20_000), (1, 3, 30), (700, 40, 60)])
def test_mix_of_small_sources(spark, words, sources, rows):
    """Sizes measured in words; rounding to blocks does not add up over shards."""
    d = spark.range(rows).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), words).alias("text"), F.concat(F.lit("s"), F.col("id") % sources).alias("source"))
    got = mix_sources(d).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("n")).collect()
    assert len(got) == sources and all(abs(r.t - r.g) <= max(0.01 * r.g, 0.51) for r in got), [r for r in got if abs(r.t - r.g) > 0.01 * r.g]


def test_hot_shards_and_null_ids(spark, monkeypatch):
    """Rows of one id are dealt by their texts, groups of shards are cut, and many sources are joined without a broadcast; results are the same."""
    from cairn.llm import source_mixing as M

    d = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), (F.col("id") % 9 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    want = sorted(map(str, mix_sources(d, shard_rows=16).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mix_sources(d.repartition(3), shard_rows=16).collect())) == want
    monkeypatch.setattr(M, "GROUP", 8)
    rows = mix_sources(d, shard_rows=16).collect()
    by = collections.defaultdict(int)
    for r in rows:
        by[r.source, r.target] += r.taken
    assert all(abs(t - goal) <= 64 for (_, goal), t in by.items()) and max(collections.Counter((r.source, r.shard) for r in rows).values()) < 60


def test_quotas_of_sources(spark):
    from cairn.llm.source_mixing import source_quotas

    rng = np.random.default_rng(5)
    for n in (1, 4, 30):
        most = rng.integers(1, 40, n)
        votes = np.minimum(most, rng.random(n) * 30)
        d = spark.createDataFrame([(k, float(v), int(m)) for k, (v, m) in enumerate(zip(votes, most))], "rank long, votes double, most long")
        got = [r.quota for r in sorted(source_quotas(d).collect())]
        assert got == apportioned(votes, int(votes.sum() + 0.5), most.tolist())


def test_targets_without_the_driver(spark):
    from cairn.llm.source_mixing import source_targets

    rng = np.random.default_rng(2)
    for n, weights in ((1, (5, 2, 1)), (7, (5, 2, 1)), (40, (1, 3)), (60, (9, 1, 1, 1))):
        names = [f"s{k}é" for k in range(n - 1)] + [None]
        sizes = {s: int(x) for s, x in zip(names, rng.zipf(1.3, n) % 10_000)}
        d = spark.createDataFrame([(s, x) for s, x in sizes.items()] + [(names[0], 0)], "source string, size long")
        known, count = source_targets(d, weights, Fraction(3, 2))
        order = sorted(s for s in names if s is not None) + [None]
        goals = targets([sizes[s] for s in order], [weights[k % len(weights)] for k in range(n)], Fraction(3, 2))
        got = {r.source: (r.rank, r.source_size, r.target) for r in known.collect()}
        assert count == n and got == {s: (k, sizes[s], pytest.approx(float(goals[k]), rel=1e-12)) for k, s in enumerate(order)}


def test_picked_words_against_a_plain_choice():
    """Blocks of words one by one: whole passes, then the blocks of least seeded hash."""
    from cairn.llm.source_mixing import _picked, block_count

    rng = np.random.default_rng(11)
    for _ in range(60):
        sizes, block = rng.integers(0, 90, rng.integers(1, 12)), int(rng.integers(1, 70))
        n = int(sizes.sum())
        blocks = int(block_count(np.int64(n), block))
        quota, seed, key = int(rng.integers(0, 2 * blocks + 1)), int(rng.integers(0, 5)), int(rng.integers(0, 1000))
        passes, taken, parts = _picked(sizes, quota, block, seed, key)
        owner = [(k, j) for k, size in enumerate(sizes) for j in range(size)]  # every word of the shard
        edges = [b * n // blocks for b in range(blocks + 1)] if blocks else [0]
        times = collections.Counter({w: quota // blocks for w in owner}) if blocks else collections.Counter()

        def hash_of(b):
            h = (b + seed * 1_000_003 + key) * 0x9E3779B97F4A7C15 % 2**64
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            return h ^ h >> 32

        for b in sorted(range(blocks), key=hash_of)[: quota % blocks if blocks else 0]:
            times.update(owner[edges[b] : edges[b + 1]])
        got = collections.Counter({(k, j): int(passes[k]) for k, j in owner})
        for k, ranges in enumerate(parts):
            for a, z in ranges:
                got.update((k, j) for j in range(a, z))
        assert +got == +times and taken.tolist() == [sum(times[k, j] for j in range(size)) for k, size in enumerate(sizes)]
        assert blocks == 0 or max(z - a for a, z in zip(edges, edges[1:])) - min(z - a for a, z in zip(edges, edges[1:])) <= 1


def test_mixed_texts(spark):
    d = cases.docs(spark)
    mix = mix_sources(d)
    out = mixed_documents(d)
    assert out.columns == d.columns
    known = {r.doc_id: r.text for r in d.collect()}
    n = collections.Counter()
    for r in out.collect():
        got = cases.WORD.findall(r.text)
        n[r.doc_id] += len(got)
        whole = cases.WORD.findall(known[r.doc_id])
        assert got == whole or any(whole[k : k + len(got)] == got for k in range(len(whole)))
    assert n == collections.Counter({r.doc_id: r.taken for r in mix.collect() if r.taken})


# --- classifier ---------------------------------------------------------------------------------
def test_labels_from_votes():
    rng = np.random.default_rng(4)
    n, labellers = 20_000, len(LABELLERS)
    good = rng.random(n) < 0.8
    right = np.linspace(0.7, 0.95, labellers)
    votes = np.where(rng.random((n, labellers)) < 0.3, 1, np.where((rng.random((n, labellers)) < right) == good[:, None], 2, 0))
    keys = (votes * 3 ** np.arange(labellers - 1, -1, -1)).sum(axis=1)
    share, accuracy, posterior = fitted_labels(dict(zip(*(x.tolist() for x in np.unique(keys, return_counts=True)), strict=True)))
    assert abs(share[0] - 0.8) < 0.03
    assert np.abs(accuracy[:, 1, 2] / (accuracy[:, 1, 2] + accuracy[:, 1, 0]) - right).max() < 0.03
    assert np.mean([(posterior[k] > 0.5) == g for k, g in zip(keys.tolist(), good.tolist(), strict=True)]) > 0.95
    assert fitted_labels({})[2] == {}


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier(d).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.99 and all(r.kept for r in rows if r.quality == 1)


def test_classifier_rows(spark):
    d = cases.docs(spark, [(None, "text of no id", "s"), (3, "one", "s")])
    a = sorted(str(tuple(r)) for r in quality_classifier(d).collect())
    assert len(a) == d.count() and a == sorted(str(tuple(r)) for r in quality_classifier(d.repartition(2)).collect())
    assert quality_classifier(cases.empty(spark)).count() == 0


def plain_features(text):
    """Weight of each bucket of a text, feature by feature."""

    def bucket(code):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            code = (code ^ code >> shift) * by & 0xFFFFFFFFFFFFFFFF
        return (code ^ code >> 31) % BUCKETS

    raw, words_ = text.encode(), cases.WORD.findall(text.translate(LOWER))
    out = collections.defaultdict(float)
    for k in range(len(raw) - 2):
        out[bucket(int.from_bytes(raw[k : k + 3], "little"))] += 1 / (len(raw) - 2)
    runs = [tuple(words_[k : k + 3]) for k in range(len(words_) - 2)] if len(words_) >= 3 else [tuple(words_)] * bool(words_)
    letters, n = sum(c.isascii() and c.isalpha() for c in text), max(len(words_), 1)
    table = [sum(text.count(c) for c in "#*$%&|<>!") / n, len("".join(words_).encode()) / n, sum(w in queries_stop for w in words_) / n, len(set(words_)) / n, len(set(runs)) / max(len(runs), 1), sum("A" <= c <= "Z" for c in text) / max(letters, 1)]
    if len(words_) >= 20:
        for k, (x, by) in enumerate(zip(table, (20, 1, 20, 10, 10, 10))):
            out[bucket(min(20, int(x * by)) + (k + 1) * 1000)] += 0.2
    return out


def test_scores_are_those_of_plain_features(spark):
    rows = [(r[0], r[1] or "") for r in cases.rows()]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    posterior = {k: (k % 7) / 7 for k in range(3 ** len(LABELLERS))}
    w = scorer_weights(d, posterior, 0.5, 1.0)
    assert (scorer_weights(d.union(d), posterior, 0.5, 1.0) == pytest.approx(w, abs=1e-9)) and not scorer_weights(d.limit(0), posterior, 0.5, 1.0).any()
    features = {k: plain_features(t) for k, t in rows}
    got = {r.doc_id: r.score for r in quality_classifier(d, fit_rows=10**6).collect()}
    from unittest import mock

    from cairn.llm import weak_labels

    with mock.patch.object(weak_labels, "scorer_weights", lambda *a: w):
        scores = {r.doc_id: r.score for r in quality_classifier(d).collect()}
    for k, t in rows:
        if cases.WORD.search(t):
            assert scores[k] == pytest.approx(1 / (1 + np.exp(-sum(w[b] * x for b, x in features[k].items()) - w[-1]))), t[:40]
    assert all(0 <= s <= 1 for s in got.values())


def test_scorer_descends_to_the_least_loss():
    """The loss at the fitted weights is less than around them, by plain sums."""
    rng = np.random.default_rng(0)
    x = rng.random((60, 5)) < 0.4
    goal = 1 / (1 + np.exp(-(x @ np.array([3.0, -2, 1, 0, -1]) - 0.5)))
    owner, bucket = np.nonzero(x)
    w = fitted_scorer((bucket, np.ones(len(bucket)), owner), goal, np.ones(60), buckets=5, rounds=3000)
    loss = lambda w: sum(-g * np.log(p) - (1 - g) * np.log(1 - p) for g, p in zip(goal, 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))))) / 60 + 5e-6 * (w**2).sum()
    assert all(loss(w + step) > loss(w) - 1e-6 for step in 0.05 * np.concatenate([np.eye(6), -np.eye(6)])) and np.abs(w[:-1] - [3, -2, 1, 0, -1]).max() < 0.1


def test_best_fit_against_every_bin():
    """Packer against a search of all bins for each item."""
    from cairn.llm.packing import Packer

    rng = np.random.default_rng(8)
    for per_source in (1, 2, 3):
        for _ in range(30):
            capacity, packer, bins = 40, Packer(40, per_source), []
            items = sorted(((int(a), int(b), int(c)) for a, b, c in zip(rng.integers(1, 30, 80), rng.integers(0, 5, 80), rng.integers(0, 30, 80))), key=lambda x: -x[0])
            for size, source, cluster in items:
                able = [b for b in bins if b[0] >= size and b[1].count(source) < per_source and cluster not in b[2]]
                got, place = packer.add(size, 1 << source, 1 << cluster)
                if not able:
                    bins.append([capacity, [], set()])
                    assert got == len(bins) - 1 and place == 0
                else:
                    assert bins[got] in able and bins[got][0] == min(b[0] for b in able) and place == len(bins[got][1])
                bins[got][0] -= size
                bins[got][1].append(source)
                bins[got][2].add(cluster)
            assert packer.residual == [b[0] for b in bins]
