"""The pipeline against its stages by plain versions, each on its own input."""

import collections

import corpus_pipeline as P
import pytest

from cairn.llm.common import release, staged
from cairn.llm.quality_rules import quality_rules
from cairn.llm.source_mixing import mix_sources
from tests.llm import cases
from tests.llm.test_corpus_operators import grouped_rows, plain_groups
from tests.llm.test_text_operators import _base

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    out["documents"] = docs
    for name, f in P.STAGES:
        docs = out[name] = staged(f(spark, docs, DIR), name)
    return out


def test_columns(stages):
    names = [n for n, _ in P.STAGES]
    assert all(stages[n].dtypes == stages["documents"].dtypes for n in names[:-1])


def test_quality_and_groups(stages):
    kept = {r.doc_id for r in quality_rules(stages["documents"]).where("kept").collect()}
    first = {r.doc_id: r.text for r in stages["quality_rules"].collect()}
    assert set(first) == kept
    groups = plain_groups(first, 5, 80)
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == {k for k, (_, c) in groups.items() if k == c}


def test_secrets_are_masked(stages):
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    after = {r.doc_id: r for r in stages["secret_scans"].collect()}
    assert set(before) == set(after)
    for k, text in before.items():
        found = _base(text)
        assert not _base(after[k].text) and after[k].n_chars == len(after[k].text) and (found or "[SECRET]" in after[k].text or text == after[k].text)


def test_mix_and_bins(stages, spark):
    mixed = stages["source_mixing"].collect()
    words = collections.Counter()
    for r in mixed:
        words[r.doc_id] += len(cases.WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    total = sum(len(cases.WORD.findall(r.text)) for r in stages["secret_scans"].collect())
    assert abs(sum(words.values()) / (1.5 * total) - 1) < 0.02
    bins, packed = collections.Counter(), collections.Counter()
    for r in stages["best_fit_packing"].collect():
        packed[r.doc_id] += r.end - r.begin
        bins[r.bin] += r.end - r.begin
    assert +packed == +words and max(bins.values()) <= 2048


def test_run_equals_its_stages(stages, spark):
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(P.run(spark, DIR)) == order(stages["best_fit_packing"])


def test_null_and_repeated_ids(spark):
    secret = "password = hunter2hunter2 "
    rows = [(r[0], secret * (r[0] % 2) + (r[1] or ""), None, f"s{r[0] % 3}") for r in cases.rows()]
    rows += [(None, f"{secret}null {k} " * (k + 3), None, f"s{k % 3}") for k in range(4)] * 2
    rows += rows[8:20] + [(30, secret + "other text of an id", None, "s1"), (-3, "one", None, "s0"), (-3, "two", None, "s0")] * 2
    d = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    nulls = sum(r[0] is None for r in rows)

    out = P.near_duplicates(spark, d, None).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    pairs = [(r[0], r[1]) for r in rows]
    assert sorted(ids) == sorted({c for *_, c in grouped_rows(pairs, 5, 80)}) and len(out) - len(ids) == nulls
    assert all((r.doc_id, r.text) in pairs for r in out)

    out = P.secret_scans(spark, d, None).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(r[0] for r in rows)
    assert not any(_base(r.text) for r in out)

    out, want = collections.Counter(), collections.Counter()
    for r in P.source_mixing(spark, d, None).collect():
        out[r.source, r.doc_id is None] += len(cases.WORD.findall(r.text))
    for r in mix_sources(d).collect():
        want[r.source, r.doc_id is None] += r.taken
    assert out == +want and any(null for _, null in out)
    assert collections.Counter({r.doc_id: r.n for r in P.best_fit_packing(spark, d, None).groupBy("doc_id").agg(P.F.countDistinct("piece", "bin", "place").alias("n")).collect()}).keys() == {r[0] for r in rows}


def test_clashing_names(spark):
    """Columns with dots and with the names of helpers go through every stage as they are."""
    names = ["a.b", "_cairn_row", "_cairn_id", "_row", "_id", "_text", "_spans", "taken", "spans", "row", "size", "shard", "feature", "bin", "h0", "h1", "tie", "rank", "order", "here", "quota", "parts", "passes", "_copy", "_words", "_done"]
    rows = [(k, f"password = hunter2hunter{k} " + "of the words in this text number " + " ".join(f"w{k}x{j}" for j in range(60)), "en", f"s{k % 3}", 1, *(f"{k}{n}" for n in names)) for k in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    d = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[:-1]:
        out = staged(stage(spark, d, None), name)
        assert out.dtypes == d.dtypes, name
        got = out.collect()
        assert got and all(r[n] == f"{r.doc_id}{n}" for r in got for n in names), name
        d = out
    assert not any(_base(r.text) for r in d.collect()) and P.best_fit_packing(spark, d, None).count() > 0
    e = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        e = stage(spark, e, None)
        assert e.count() == 0


def test_ranges_of_a_document_share_no_bin(spark):
    rows = [(k % 30, f"w{k} " * (5 + k), "en", f"s{k}") for k in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    packed = P.best_fit_packing(spark, d, None).collect()
    assert len(packed) == 120 and len({(r.doc_id, r.bin) for r in packed}) == 120


def test_release(spark):
    kept = staged(spark.range(3), "gone")
    release(spark)
    with pytest.raises(Exception):  # noqa: B017
        kept.collect()
