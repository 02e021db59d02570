"""Small tables with nulls, empty, long, equal and repeated rows, and clashing extra columns; brute force beside each operator."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shalebed.llm import exact_dedup, language_id, lm_scoring, mixing, ngram_join, packing, simhash, toxicity, url_filter, warc

DDL = "doc_id long, text string, lang string, source string, n_chars long, n int, sig string, label string, k int, h int, score double, row int"
R = random.Random(5)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "là", "mu"] + [f"w{i}" for i in range(300)]


def some(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def made_rows():
    base = some(60)
    texts = [None, "", "   ", "one two", "one two", "12 34 !!", base, base, base + " tail", "x " + base, base.upper(), "Ünï cödé퟿ text\n\nnew\tline", some(12000), some(4), some(5), some(6)] + [some(R.randint(1, 80)) for _ in range(25)]
    for i in range(12):  # near copies of one text: one word changed
        w = base.split()
        w[5 * i % 60] = f"new{i}"
        texts.append(" ".join(w))
    rows = [(i, t, ["en", "de", None][i % 3], "s", 0, 1, "s", "l", 1, 2, 0.5, 3) for i, t in enumerate(texts)]
    return rows + [(3, "one two", "en", "s", 0, 1, "s", "l", 1, 2, 0.5, 3), (None, base, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]


ROWS = made_rows()


def fixture_rows():
    return list(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), DDL).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0), "x") for i in range(40)] + [(None, 1, 1, "x"), (1, None, None, "x"), (2, 1, 0, "y")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def shingle_set(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_components(docs, none):
    rows = fixture_rows()
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None and sets[i]:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    want = sorted(str((r[0], len(sets[i]), ids.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in ngram_join.jaccard_components(docs).collect())
    assert got == want
    assert ngram_join.jaccard_components(none).count() == 0


def test_prefix_keys_lose_no_pair():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(2, 200))
        shared = r.integers(0, 2**64, n, dtype=np.uint64)
        a = np.unique(np.r_[shared, r.integers(0, 2**64, int(r.integers(0, n // 6 + 1)), dtype=np.uint64)])
        b = np.unique(np.r_[shared, r.integers(0, 2**64, int(r.integers(0, n // 6 + 1)), dtype=np.uint64)])
        common = len(np.intersect1d(a, b))
        if a.tobytes() == b.tobytes() or 100 * common < 75 * (len(a) + len(b) - common):
            continue
        classes = (r.random(1 << ngram_join.CLASS_BITS) < r.random()).astype(np.uint8) * r.integers(1, 5, 1 << ngram_join.CLASS_BITS).astype(np.uint8)
        ka, kb = ngram_join.prefix_keys(a, classes, 75), ngram_join.prefix_keys(b, classes, 75)
        assert set(ka[0][0]) & set(kb[0][0]) or set(ka[1][0]) & set(kb[1][0])


def test_neighbour_pairs_of_long_sets_pass_the_bound():
    r = np.random.default_rng(4)
    for _ in range(400):
        n = int(r.integers(3, 1500))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = a[r.random(len(a)) > r.random() * 0.2]
        b = np.unique(np.r_[b, r.integers(0, 2**63, int(r.integers(0, n // 8 + 1)), dtype=np.uint64)])
        both = np.intersect1d(a, b)
        common = len(both)
        if a.tobytes() == b.tobytes() or 100 * common < 75 * (len(a) + len(b) - common):
            continue
        classes = r.integers(1, 4, 1 << ngram_join.CLASS_BITS).astype(np.uint8)  # shingles are frequent, but for some that one set alone has
        own = np.setxor1d(a, b)
        classes[(own[r.random(len(own)) < r.random()] >> np.uint64(64 - ngram_join.CLASS_BITS)).astype(np.int64)] = 0
        rare = lambda x: int((classes[(x >> np.uint64(64 - ngram_join.CLASS_BITS)).astype(np.int64)] == 0).sum())  # noqa: B023, E731
        if rare(both):  # by its class a shared one became rare
            continue
        (_, (ka, pa_, qa)), (_, (kb, pb, qb)) = ngram_join.prefix_keys(a, classes, 75), ngram_join.prefix_keys(b, classes, 75)
        assert len(ka) <= n // 2 + 2
        at = {k: (x, q) for k, x, q in zip(kb, pb, qb, strict=True)}
        found = [ngram_join.most_common(len(a), len(a) - x, rare(a), len(b), len(b) - at[k][0], rare(b)) >= common for k, x, q in zip(ka, pa_, qa, strict=True) if k in at and (q != at[k][1] or q == 0)]
        assert any(found)


def test_small_sketches_lose_no_link():
    r = np.random.default_rng(8)
    for _ in range(300):
        n = int(r.integers(1, 1500))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[r.random(len(a)) > r.random() * 0.3], r.integers(0, 2**63, int(r.integers(1, n // 4 + 2)), dtype=np.uint64)])
        other = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        whole = [ngram_join.sketch_of(x) for x in (a, b, other)]
        small = [np.frombuffer(ngram_join.folded(x), np.uint8) for x in whole]
        assert all(len(x) <= max(8, len(y) // 4) for x, y in zip(small, whole, strict=True))
        assert ngram_join.most_shared(small[0], small[1], len(a), len(b)) >= len(np.intersect1d(a, b))
        if n >= 100:  # nothing in common
            assert 175 * ngram_join.most_shared(small[0], small[2], len(a), len(other)) < 75 * (len(a) + len(other))


def test_jaccard_components_when_names_clash(docs):
    key = lambda r: str((r["doc_id"], r["n_shingles"], r["component_id"]))
    assert sorted(map(key, ngram_join.jaccard_components(docs, sig_bits=5).collect())) == sorted(map(key, ngram_join.jaccard_components(docs).collect()))


def test_exact_groups(docs, none):
    rows = fixture_rows()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(str((r[0], best[r[1] or ""], len(groups[r[1] or ""]), r[0] == best[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest())) for r in rows)
    got = sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in exact_dedup.exact_groups(docs).collect())
    assert got == want
    assert exact_dedup.exact_groups(none).count() == 0


def test_perfect_hash():
    keys = exact_dedup.as_words([hashlib.sha256(str(i).encode()).digest() for i in range(5000)])
    mph = exact_dedup.PerfectHash(keys)
    assert sorted(mph(keys)) == list(range(5000))


def test_language(docs, none):
    rows = fixture_rows()
    got = language_id.predict_languages(docs, sample_rows=50).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (0, 1, 2, 5))
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert language_id.predict_languages(none).count() == 0


def test_gram_counts_in_pieces(monkeypatch):
    text = some(400)
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 37)
    assert (language_id.gram_counts(text) == whole).all()


def test_toxicity(docs, labels, none):
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(fixture_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert toxicity.toxicity_scores(none, labels.limit(0)).count() == 0


def test_toxicity_gradients():
    net = toxicity.Net({"ab": 1, "cd": 2})
    at, mask, y = np.array([[0, 1, 2] + [0] * 21, [2, 0] + [0] * 22]), np.array([[1.0] * 3 + [0] * 21, [1.0] * 2 + [0] * 22], np.float32), np.array([1.0, 0.0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradients(["ab", "cd", "unseen"], at, mask, y)
    for k in ("Uf", "Xb", "bf", "a", "o"):
        i = tuple(int(s // 2) for s in net.p[k].shape)
        old, e = net.p[k][i], 1e-3
        net.p[k][i] = old + e
        up, _ = net.gradients(["ab", "cd", "unseen"], at, mask, y)
        net.p[k][i] = old - e
        down, _ = net.gradients(["ab", "cd", "unseen"], at, mask, y)
        net.p[k][i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 2e-3


def test_windows_cover():
    for n in (0, 1, 24, 25, 36, 37, 100):
        start, length, _ = toxicity.windows(np.array([n]))
        assert {i for s, m in zip(start, length, strict=True) for i in range(s, s + m)} == set(range(n))


def test_toxicity_reads_long_words():
    for n in (1, 64, 65, 96, 97, 500):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        got = toxicity.words(word)
        assert all(any(word[i : i + 5] in p for p in got) for i in range(n)) and max(map(len, got)) <= 64
    assert toxicity.words("A " + "=" * 70 + "b" + "=" * 70) == ["a", "=" * 70 + "b" + "=" * 70]
    scorer, start = toxicity.Scorer(toxicity.Net({})), "好" * 200
    a, b = scorer.logits([toxicity.words(start + "天" * 50), toxicity.words(start + "坏" * 50)])[0]
    assert a != b


def test_mixing(docs, labels, none):
    got = mixing.mixing_rates(docs, labels).collect()
    assert len(got) == len(fixture_rows())
    assert all(abs(r["p_clean"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 and r["rate"] >= 0 for r in got)
    totals = [sum(r["rate"] * r["n_words"] * r[f"p_{k}"] for r in got) for k in mixing.DOMAINS]
    assert totals[0] == pytest.approx(sum(r["n_words"] * r["p_clean"] for r in got), rel=0.05)
    assert mixing.mixed(docs, labels).columns == docs.columns
    assert mixing.mixing_rates(none, labels.limit(0)).count() == 0


def test_simhash(docs, none):
    rows = sorted({(r[0], r[1] or "") for r in fixture_rows() if r[0] is not None}, key=lambda r: -r[0])
    got = simhash.edit_fingerprints(docs).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for (i, x), (_, y) in zip(rows, rows[1:], strict=False):
        n = len(x)
        assert by[i]["n_chars"] == n and by[i]["edited_sha256"] == hashlib.sha256((x[: n - n // 2] + y[: n // 2]).encode()).hexdigest()
    assert by[6]["fingerprint"] == by[7]["fingerprint"] and by[0]["fingerprint"] == "0" * 32
    assert simhash.edit_fingerprints(none).count() == 0


def test_simhash_search(spark):
    r = random.Random(1)
    base = [r.getrandbits(128) for _ in range(30)]
    prints = sorted({f"{b ^ sum(1 << p for p in r.sample(range(128), k)):032x}" for b in base for k in (0, 1, 3, 4, 5)})
    df = spark.createDataFrame([(p,) for p in prints], "f string")
    got = {(x["q"], x["f"]) for x in simhash.within(df.withColumnRenamed("f", "q"), df, 3).collect()}
    assert got == {(a, b) for a in prints for b in prints if (int(a, 16) ^ int(b, 16)).bit_count() <= 3}


def test_simhash_search_of_a_large_radius(spark):
    r = random.Random(2)
    base = [r.getrandbits(128) for _ in range(20)]
    prints = sorted({f"{b ^ sum(1 << p for p in r.sample(range(128), k)):032x}" for b in base for k in (0, 10, 20, 30)})
    df, radius = spark.createDataFrame([(p,) for p in prints], "f string"), simhash.radius_for()
    got = {(x["q"], x["f"]) for x in simhash.within(df.withColumnRenamed("f", "q"), df, radius).collect()}
    assert got == {(a, b) for a in prints for b in prints if (int(a, 16) ^ int(b, 16)).bit_count() <= radius}


def test_simhash_finds_near_copies(spark):
    r = random.Random(4)
    rows, of = [], {}
    for i in range(8):  # one word in a hundred changed, and a Jaccard similarity of about 0.75
        w = [f"t{i}w{r.randrange(10**6)}" for _ in range(400)]
        for k, changed in enumerate((0, 4, 12)):
            x = list(w)
            for at in range(changed):
                x[(at * 400) // max(1, changed)] = f"new{at}"
            rows.append((100 * i + k, " ".join(x)))
        of[100 * i] = [100 * i + 1, 100 * i + 2]
    rows += [(None, rows[0][1] + " "), (7, rows[0][1]), (0, rows[0][1] + "  ")]
    of[0] = [None, 0, *of[0], 7]
    got = simhash.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for x in got:
        asked = x["doc_id"] is not None and x["doc_id"] % 100 == 0
        assert x["within_ids"] == (of[x["doc_id"]] if asked else None) and x["n_within"] == (len(of[x["doc_id"]]) if asked else None)


def test_warc(spark):
    rows = [(i, u, h, "x") for i, (u, h) in enumerate([(None, None), ("", ""), ("http://B.example/x?q=1", "a" * 99), ("http://b.example/x?q=1", "a" * 99), ("http://é.example/", "é" * 200), ("nonsense", "é" * 200), ("http://a.example", "b" * 300_000), ("http://a.example", "é" * 200), ("http://a.example\r\nx", "\r\n\r\n" * 40)])]
    rows.append((8, "http://again.example", "z" * 200, "x"))
    pages = spark.createDataFrame([*rows, (None, "http://n.example", "n" * 10, "x")], "page_id long, url string, html string, digest string")
    got = {r["payload_digest"] + str(r["page_id"]): r for r in warc.round_trip(pages, block_rows=3).collect()}
    assert len(got) == len(rows) + 1
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        r = got[hashlib.sha256(raw).hexdigest() + str(i)]
        first = min(j for j, _, g, _ in rows if (g or "") == (h or ""))
        want = ("revisit", first) if len(raw) >= 100 and first != i else ("response", None)
        assert (r["payload_bytes"], r["record_type"], r["refers_to"]) == (len(raw), *want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_repeats_over_borders(spark):
    rows = [(i, f"http://a.example/{i}", f"page {i}") for i in range(4)] + [(9, "http://b.example/", f"copy {i}") for i in range(11)] + [(None, "http://c.example/", f"none {i}") for i in range(5)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), block_rows=3).collect()
    assert sorted(r["payload_digest"] for r in got) == sorted(hashlib.sha256(h.encode()).hexdigest() for _, _, h in rows)


def test_lm(docs, none):
    rows = fixture_rows()
    token = lambda t: (t or "").encode("utf-8", "surrogatepass").lower().split() + [b"\0end"]
    counts = {}
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            for w in token(r[1]):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(token(r[1])), sum(w in counts for w in token(r[1])), round(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in token(r[1])), 6)) for r in rows)
    for top in (196_608, 64):
        got = lm_scoring.lm_scores(docs, top_words=top).collect()
        assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm_scoring.lm_scores(none).count() == 0


def test_lm_filter_keeps_its_bits(docs):
    key = lambda r: (r["n_tokens"], r["n_known"], r["score"])
    whole = sorted(map(key, lm_scoring.lm_scores(docs).collect()))
    for most in (0, 1000):  # a filter too large for a broadcast gives the same scores
        assert sorted(map(key, lm_scoring.lm_scores(docs, max_filter_bytes=most).collect())) == whole


def test_lm_counts_of_hot_pairs():
    rows = pa.RecordBatch.from_pydict({"text": ["spam " * 200_001, "ham eggs", "spam spam"]})
    got = [r for b in lm_scoring._count(6)([rows]) for r in b.to_pylist() if r["kind"] == 1]
    keys, counts = lm_scoring._summed(lm_scoring._unpack48([r["keys"] for r in got]), np.frombuffer(b"".join(r["counts"] for r in got), np.uint16))
    assert sorted(counts)[-3:] == [2, 2, 200_001] and counts.sum() == 200_002 + 3 + 3


def test_url_rules(spark):
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("org", "/fr/"): "allow"}
    urls = [None, "", "x", "http://NET/", "http://a.net", "http://a.net/x", "https://www.example.net/en/1?x", "https://example.net/de/", "http://example.org/fr/#a", "http://planet/", "http://x.org/fr", "http://x.org:80/fr/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()}
    assert got[0] == ("", "", None, "allow") and got[3] == ("net", "/", "net/", "block") and got[4] == ("a.net", "", None, "allow")
    assert got[6] == ("www.example.net", "/en/1", "example.net/en/", "allow") and got[7][2:] == ("net/", "block") and got[8][2:] == ("org/fr/", "allow")
    assert got[9][2] is None and got[10][2] is None and got[11][2] is None
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_cascade_is_exact():
    listed, other = [f"l{i}" for i in range(300)], [f"o{i}" for i in range(5000)]
    levels, good, seed = [url_filter.Bloom(listed, 0.06, 1)], listed, 2
    bad = [k for k in other if k in levels[0]]
    while bad:
        levels.append(url_filter.Bloom(bad, 0.5, seed))
        good, bad, seed = bad, [k for k in good if k in levels[-1]], seed + 1
    c = url_filter.Cascade(levels)
    assert all(k in c for k in listed) and not any(k in c for k in other)


def test_packing(docs, none):
    got = packing.pack_batches(docs, max_len=64, budget=256, buckets=4).collect()
    words = [len((r[1] or "").encode("utf-8", "surrogatepass").split()) for r in fixture_rows()]
    assert sum(r["n_tokens"] for r in got) == sum(words) and len(got) == sum(max(1, -(-w // 64)) for w in words)
    held = {}
    for r in got:
        held.setdefault(r["batch_id"], []).append(r)
    for rows in held.values():
        assert len({r["padded_len"] for r in rows}) == 1 and sum(r["padded_len"] for r in rows) <= 256
        assert sorted(r["place"] for r in rows) == list(range(len(rows))) and all(r["n_tokens"] <= r["padded_len"] for r in rows)
    assert packing.pack_batches(none).count() == 0


def test_best_boundaries():
    r = random.Random(2)
    for _ in range(40):
        x = sorted(r.sample(range(1, 60), r.randint(1, 9)))
        c = [r.randint(1, 9) for _ in x]
        k = r.randint(1, 4)
        cost = lambda ends: sum(n * (min(e for e in ends if e >= a) - a) for a, n in zip(x, c, strict=True))  # noqa: B023, E731
        best = min(cost((*e, x[-1])) for m in range(min(k, len(x))) for e in itertools.combinations(x[:-1], m))
        assert cost(packing.best_boundaries(x, c, k)) == best and len(packing.best_boundaries(x, c, k)) <= k


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[1:3]:
        kept = stage(spark, kept, d)
        assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len(set(texts))
    sets = [shingle_set(t) for t in texts]
    assert not any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a, b in itertools.combinations(sets, 2))


def test_components_of_chains_and_rings(spark):
    r = random.Random(9)
    names = r.sample(range(1000), 120)
    edges = [(names[i], names[i + 1]) for i in range(60)] + [(names[70 + i], names[70 + (i + 1) % 20]) for i in range(20)] + [(names[100], n) for n in names[101:110]]
    got = {x["node"]: x["label"] for x in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: min(part) for part in (names[:61], names[70:90], names[100:110]) for n in part}
    assert got == want


def test_components_of_a_node_of_many_neighbours(spark):
    r = random.Random(10)
    names = r.sample(range(10**6), 1300)
    edges = [(names[0], n) for n in names[1:700]] + [(names[700], n) for n in names[701:1300]] + [(names[650], names[1200])]
    got = {x["node"]: x["label"] for x in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(names, min(names))
