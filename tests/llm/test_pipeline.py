"""The pipeline's stages on small tables with nulls, repeated ids and rows, empty tables and clashing names."""

import itertools
import random

import pytest

import corpus_pipeline as pipeline
from shalebed.llm import common, language_id

R = random.Random(21)
WORDS = [f"w{i}" for i in range(400)]
DDL = "doc_id long, text string, lang string, lang_pred string, score double, lang_score double, sha string, one int, _id int, _sha string, text_hash long, gone int, row int, copies int, h long, t long, f0 double, p0 double, at long"
EXTRA = ("lang_pred", 0.5, 0.25, "sha", 1, 2, "x", 3, 4, 5, 6, 7, 8, 0.125, 0.0625, 9)


def some(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(a, b):
    a, b = shingles(a), shingles(b)
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, *EXTRA) for i, t, lang in rows], DDL)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, int(i % 3 != 0), int(i % 11 == 0)) for i in range(60)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_language_stage_rejects_noise(spark, folder):
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "mnopqrs"}
    made = lambda cs, n: " ".join("".join(R.choice(cs) for _ in range(R.randint(2, 7))) for _ in range(n))
    good = [(i, made(letters[lang], R.randint(10, 60)), lang) for i, lang in enumerate(R.choice(list(letters)) for _ in range(600))]
    mixed = "abcdefghijkmnopqrs"  # words of all three
    bad = [(10_000 + i, made(mixed, 40), None) for i in range(30)] + [(20_000, None, "aa"), (20_001, "", "aa"), (20_002, "12 ½ !!", None), (None, "  ", None)]
    docs = table(spark, [*good, *bad, good[0], (None, good[1][1], None)])
    out = pipeline.language_stage(spark, docs, folder)
    assert out.columns == docs.columns
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert len([i for i in ids if i is not None and i < 10_000]) >= 0.99 * 601 and ids.count(0) == 2 and ids.count(None) == 1
    assert not [i for i in ids if i is not None and i >= 20_000] and len([i for i in ids if i is not None and i >= 10_000]) <= 10
    assert all(tuple(r)[3:] == EXTRA for r in rows)


def test_lowest_evidence():
    assert language_id.lowest_evidence([], 4) == 0 and language_id.lowest_evidence([1.0] * 9, 1) == 0
    assert language_id.lowest_evidence([2.0] * 9, 4) == pytest.approx(2 / 3) and language_id.lowest_evidence([-1.0, -2.0], 3) == 0


def test_language_model_comes_from_all_rows(spark, monkeypatch):
    """Every label is learned however rare, and the bound is the quantile of the rows that all groups hold back."""
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "mnopqrs", "zz": "tuvwxyz"}
    made = lambda cs, n: " ".join("".join(R.choice(cs) for _ in range(R.randint(2, 7))) for _ in range(n))
    langs = [R.choice(("aa", "bb", "cc")) for _ in range(900)] + ["zz"] * 9
    docs = spark.createDataFrame([(i, made(letters[lang], R.randint(10, 60)), lang) for i, lang in enumerate(langs)], "doc_id long, text string, lang string")
    judged = []
    monkeypatch.setattr(language_id, "least_of", lambda rows, f=language_id.least_of: (judged.append([r[0] for r in rows.collect()]), f(rows))[1])
    m = language_id.fit(docs, sample_rows=100)
    n = sum(common.crc_mod_py(i, 5) != 0 for i in range(len(langs)))
    assert m.labels == ["aa", "bb", "cc", "zz"]
    assert n / 5 - 10 <= len(judged[0]) <= n / 5 + 1
    assert m.lowest == pytest.approx(language_id.lowest_evidence(judged[0], 4)) and m.lowest > 0
    again = language_id.fit(docs.repartition(5, "text"), sample_rows=100)  # however the rows lie
    assert (again.w == m.w).all() and (again.t, again.lowest) == (m.t, m.lowest)
    hits = [m.predict(t)[0] == lang for t, lang in ((made(letters[lang], 40), lang) for lang in ("aa", "bb", "cc") for _ in range(20))]
    assert sum(hits) >= 58


def test_exact_stage(spark, folder):
    rows = [(1, "a b", "x"), (2, "a b", "y"), (2, "a b", "y"), (3, None, "x"), (4, "", "x"), (None, "a b", None), (None, "only null", None), (None, "only null", None), (5, "A b", "x"), (7, "x", "x"), (7, "y", "x")]
    out = pipeline.exact_stage(spark, table(spark, rows), folder)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted([("2", "a b"), ("4", ""), ("None", "only null"), ("5", "A b"), ("7", "x"), ("7", "y")])
    assert all(tuple(r)[3:] == EXTRA for r in out.collect())


def test_near_stage_tells_repeated_ids_apart(spark, folder):
    base, other = some(80), some(60)
    rows = [(3, base, "x"), (7, base + " end", "x"), (7, other, "x"), (9, None, "x"), (10, "", "x"), (None, base + " x y", "x"), (None, some(30), "x"), (11, "one two", "x"), (12, "ONE two", "x")]
    rows += [(20, some(40), "x")] * 2 + [(30, base + " tail", "x"), (30, some(20), "x"), (40, None, "x"), (40, None, "x")]
    out = pipeline.near_stage(spark, table(spark, rows), folder)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    want = [rows[0], rows[2], rows[3], rows[4], rows[6], rows[7], rows[9], rows[12], rows[13], rows[14]]
    assert sorted(map(str, kept)) == sorted(str((r[0], r[1])) for r in want)
    assert all(tuple(r)[3:] == EXTRA for r in out.collect())


def test_mixing_and_packing_stage(spark, folder):
    rows = [(i, some(R.randint(0, 40)), "x") for i in range(60)] + [(5, None, "x"), (None, some(9), "x"), (6, some(3), "x"), (6, "", "x")]
    docs = table(spark, rows)
    out = pipeline.mixing_stage(spark, docs, folder)
    assert out.columns == docs.columns and {(r["doc_id"], r["text"]) for r in out.collect()} <= {(i, t) for i, t, _ in rows}
    packed = pipeline.packing_stage(spark, docs, folder).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len((t or "").split()) for _, t, _ in rows) and len(packed) == len(rows)


def test_stages_of_an_empty_table(spark, folder):
    none = table(spark, [])
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, none, folder)
        assert out.columns == none.columns and out.count() == 0
    assert pipeline.packing_stage(spark, none, folder).count() == 0


def test_run_over_a_small_corpus(spark):
    """Stage by stage, what must hold of any right result; then run() packs what the stages kept."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [{(r["doc_id"], r["text"]) for r in docs.collect()}]
    at = docs
    for name, stage in pipeline.STAGES[:-1]:
        at = common.keep(stage(spark, at, d), name)
        rows = [(r["doc_id"], r["text"]) for r in at.collect()]
        assert at.columns == docs.columns and set(rows) <= kept[-1]
        if name in ("exact_dedup", "near_dedup"):
            texts = [t for _, t in rows]
            assert len(texts) == len(set(texts))
            assert name != "exact_dedup" or {t for _, t in kept[-1]} == set(texts)
        if name == "near_dedup":
            texts = [t for _, t in rows]
            assert not any(linked(a, b) for a, b in itertools.combinations(texts, 2))
            for i, t in kept[-1] - set(rows):  # what went was linked with something
                assert any(linked(t, u) for j, u in kept[-1] if j != i)
        kept.append(set(rows))
    tokens = sum(len(r["text"].encode().split()) for r in at.collect())
    out = pipeline.run(spark, d).collect()
    assert sum(r["n_tokens"] for r in out) == tokens and {r["doc_id"] for r in out} == {i for i, _ in kept[-1]}
