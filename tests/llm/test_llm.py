"""The operators of quiltlens.llm on odd tables and against brute force."""

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quiltlens.llm import content_sort, feistel, fm_index, ftrl, latent, lsh_forest, pfair, token_orc, url_templates, warc

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_lsh_forest", "op5_feistel_shards", "op6_fm_substring", "op8_content_sort"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_url_filter_odd(spark):
    pages = spark.createDataFrame([(1, None), (1, "no scheme"), (2, "http://A.example.com/en/1?x"), (3, "http://www.EXAMPLE.com/en/1"), (4, "x://net/es/"), (None, "h://a.org")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "id long, bad int")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_templates.url_filter(pages, labels).collect()}
    assert got[2, "a.example.com", "/en/1"] == ("example.com/en/", "block")
    assert got[3, "www.example.com", "/en/1"] == ("www.example.com/en/", "allow")
    assert got[4, "net", "/es/"] == ("net/es/", "block")
    assert got[1, "", ""][0] is None and got[None, "a.org", ""] == (None, "allow")
    assert url_templates.url_filter(pages.limit(0), labels).count() == 0
    bad = spark.createDataFrame([(i, f"http://h.org/{'spam' if i % 2 else 'good'}/{i}") for i in range(100)], "page_id long, url string")
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, bad int")
    said = {r.path.split("/")[1]: r.verdict for r in url_templates.url_filter(bad, known).collect()}
    assert said == {"spam": "block", "good": "allow"}


def test_feistel(spark, odd_docs, no_docs):
    for n in (1, 2, 3, 10, 97, 1000):
        a, b = feistel.sides(n)
        assert n <= a * b < n + a + 1 and len({feistel.permute(x, a, b, 5) for x in range(a * b)}) == a * b
    rows = feistel.feistel_shards(odd_docs, shards=3).collect()
    assert sorted(r.place for r in rows) == list(range(11)) and {(r.shard, r.slot) for r in rows} == {(p % 3, p // 3) for p in range(11)}
    assert feistel.feistel_shards(no_docs).count() == 0


def test_content_sort(spark, odd_docs, no_docs):
    rows = content_sort.content_sort_dedup(odd_docs).collect()
    assert len(rows) == 11 and sum(r.kept for r in rows) == 8
    assert {r.keep_id for r in rows if r.doc_id in (1, 2)} == {1} and {r.group_size for r in rows if r.doc_id == 3} == {2}
    assert content_sort.content_sort_dedup(no_docs).count() == 0
    hot = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('t', id % 1000)) AS text")
    want = hot.toPandas().groupby("text")["doc_id"].agg(["max", "count"])
    for r in content_sort.content_sort_dedup(hot, keep="max", salts=8).join(hot, "doc_id").collect():
        assert (r.keep_id, r.group_size, r.kept) == (want.loc[r.text, "max"], want.loc[r.text, "count"], r.doc_id == want.loc[r.text, "max"])


def _sets(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in lsh_forest.near_duplicates(odd_docs, 75).collect()}
    assert got[2, 36] == (1, False) and got[7, 36] == (1, False) and got[9, 1] == (8, False) and got[3, 0] == (3, True) and got[5, 0] == (5, True)
    assert lsh_forest.near_duplicates(no_docs).count() == 0
    assert lsh_forest.keep_one(odd_docs).count() == 8
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(600):  # a family around the threshold and other texts
        w = list(base) if i % 3 else [f"x{i}_{j}" for j in range(60)]
        for j in rng.integers(0, len(w), 1 + i % 2):
            w[j] = f"n{i}_{j}"
        texts.append(" ".join(w))
    sets = [_sets(t) for t in texts]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(600):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(df).collect()} == {i: find(i) for i in range(600)}


def test_latent(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(40))), (2, None), (3, "")], "item_id long, text string")
    planted = spark.createDataFrame([(50, "lead words " * 30 + " ".join(f"Item{i}," for i in range(40)) + " tail" * 50)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(planted)
    assert [(r.doc_id, r.item_id, r.kind, r.overlap) for r in latent.leaks(docs, bench).collect()] == [(50, 1, "verbatim", 1.0)]
    assert latent.decontaminate(docs, bench).count() == 11
    assert latent.leaks(docs, bench.limit(0)).count() == 0 and latent.leaks(no_docs, bench).count() == 0
    a, b = b"a b c d e".split(), b"x b d e q".split()
    assert latent.lcs(latent.masks_of(a), b) == 3


def test_latent_short_paraphrase_and_null_ids(spark):
    """A short item's half and its answer are a leak, its half alone is none; rows without an id are searched each by itself."""
    item = [f"item{i}" for i in range(20)]
    half = " ".join(w if i >= 12 or i % 4 == 0 else f"o{i}" for i, w in enumerate(item))
    no_answer = " ".join(w if i < 11 else f"o{i}" for i, w in enumerate(item))
    lead = " ".join(f"lead{i}" for i in range(20))
    big = 2 ** 60 + 1
    rows = [(big, f"{lead} {half} tail"), (2, f"{lead} {no_answer} tail"), (None, f"{lead} {' '.join(item)}"), (None, "nothing of it"), (5, "no more")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.kind) for r in latent.leaks(docs, bench).collect()) == [(0, "verbatim"), (big, "paraphrase")]
    assert sorted((r.doc_id or 0, r.text) for r in latent.decontaminate(docs, bench).collect()) == [(0, "nothing of it"), rows[1], rows[4]]


def test_latent_low_cosine(spark):
    """Half items and paraphrases are all found by brute force's measure, also where no passage's cosine reaches the bound."""
    rng = np.random.default_rng(4)
    items = [[f"v{x}" for x in rng.integers(0, 3000, n)] for n in (12, 18, 30, 45, 60) for _ in range(12)]
    texts = []
    for i, t in enumerate(items):
        cut = [w if j >= len(t) - 8 or rng.random() < 0.5 else f"v{rng.integers(0, 3000)}" for j, w in enumerate(t)]
        texts.append([f"v{x}" for x in rng.integers(0, 3000, 40 + i)] + (cut if i % 2 else t) + [f"v{x}" for x in rng.integers(0, 3000, 50)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    held = latent.Items(list(range(len(items))), [" ".join(t).encode() for t in items], np.ones((latent.BUCKETS + 1, 2), np.float32))
    want = {(d, i) for d, t in enumerate(texts) for i in range(len(items)) if latent.judge(held, i, [w.encode() for w in t])[0]}
    assert len(want) > 40
    for cosine in (latent.COSINE, 2.0):  # 2: nothing comes by the cosine
        got = {(r.doc_id, r.item_id) for r in latent.leaks(docs, bench, cosine=cosine).collect()}
        assert len(want & got) >= 0.95 * len(want)


def test_latent_recall(spark):
    """Every item whose words all stand in a document in order, next to each other, is found (recall against brute force)."""
    d = "/root/testdata/sf0.01"
    plain = lambda t: b" ".join(p for w in (t or "").encode().split() if (p := latent.plain_word(w)))
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for i, t in items if t in plain(r.text)}
    got = {(r.doc_id, r.item_id) for r in latent.leaks(docs, bench).collect()}
    assert len(want) > 10 and len(want & got) >= 0.95 * len(want)


def test_pfair(spark, odd_docs, no_docs):
    quota = {"a": 7, "b": 2, "c": 1}
    slots = pfair.one_period(quota)
    for t in range(1, 11):
        assert all(abs(sum(x < t for x in slots[s]) - t * q / 10) < 1 for s, q in quota.items())
    docs = spark.range(2000).selectExpr("id AS doc_id", "IF(id % 4 = 0, 's1', IF(id % 4 = 1, 's2', 'hot')) AS source")
    rows = pfair.pfair_mix(docs, {"hot": 0.5, "s1": 0.3, "s2": 0.2}, block_rows=8).orderBy("mix_slot", "mix_offset").collect()
    assert len(rows) == 2000 and len({r.doc_id for r in rows}) == 2000
    order = list(dict.fromkeys((r.mix_slot, r.source) for r in rows if r.mix_phase == 0))
    assert [s for s, _ in order] == list(range(len(order)))
    for s, w in (("hot", 0.5), ("s1", 0.3), ("s2", 0.2)):
        assert all(abs(sum(x == s for _, x in order[:t]) - w * t) < 1 for t in range(1, len(order)))
    assert pfair.pfair_mix(odd_docs).count() == 11 and pfair.pfair_mix(no_docs).count() == 0


def _lags_under_one(sources, counts, weights):
    """Whether every source of every slot of the first phase is less than a block from its exact share."""
    total, done = sum(Fraction(w) for w in weights.values()), dict.fromkeys(weights, 0)
    share = {s: Fraction(w) / total for s, w in weights.items()}
    for t, s in enumerate(sources, 1):
        done[s] += 1
        if any(abs(done[x] - share[x] * t) >= 1 for x in (weights if t % 100 == 0 else (s,))):
            return False
        if done[s] == counts[s]:
            break
    return True


def test_pfair_exact_weights(spark):
    """Weights that are no multiples of a thousandth, over tens of thousands of slots, and one heavy source among many."""
    for counts, weights in (({"hot": 9000, "mid": 20_000, "rare": 9}, {"hot": 1 / 3, "mid": 2 / 3 - 1 / 4000, "rare": 1 / 4000}),
                            ({"hot": 21_000, "mid": 9_001, "rare": 17}, None)):
        docs = spark.createDataFrame([(i, s) for s, n in counts.items() for i in range(n)], "doc_id long, source string")
        rows = pfair.pfair_mix(docs, weights, block_rows=1).select("mix_slot", "source", "mix_phase").orderBy("mix_slot").collect()
        assert [r.mix_slot for r in rows] == list(range(sum(counts.values())))
        assert _lags_under_one([r.source for r in rows if r.mix_phase == 0], counts, weights or {s: n ** 0.7 for s, n in counts.items()})
    counts = {"hot": 2000} | {f"t{i}": 3 for i in range(2000)}
    weights = {"hot": 0.33} | {f"t{i}": 0.67 / 2000 for i in range(2000)}
    docs = spark.createDataFrame([(i, s) for s, n in counts.items() for i in range(n)], "doc_id long, source string")
    first = [r.source for r in pfair.pfair_mix(docs, weights, block_rows=1).select("mix_slot", "source").orderBy("mix_slot").limit(1000).collect()]
    share = Fraction(0.33) / (Fraction(0.33) + 2000 * Fraction(0.67 / 2000))
    assert all(abs(first[:t].count("hot") - share * t) < 1 for t in range(1, 1001))


def _family(size, rng, words=120, own=24):
    """Texts that share most of their words with one base and differ in places of their own; every tenth has a closer partner."""
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(size):
        text = list(base)
        for j in rng.choice(words // 6, own // 6, replace=False) * 6:
            text[j] = f"x{i}-{j}"
        out.append(text)
        if i % 10 == 0:
            near = list(text)
            for j in rng.choice(words - 10, 2, replace=False) + 5:
                near[j] = f"y{i}-{j}"
            out.append(near)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_large_family(spark, percent, monkeypatch):
    """A family of thousands in different components: regions are cut, and no link is lost."""
    monkeypatch.setattr(lsh_forest, "LEAF", 32)
    texts = _family(1500, np.random.default_rng(3))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    number = {s: i for i, s in enumerate(set().union(*sets))}
    held = np.zeros((len(texts), len(number)), dtype=np.float32)
    for r, s in enumerate(sets):
        held[r, [number[x] for x in s]] = 1
    both = held @ held.T
    size = held.sum(axis=1)
    linked = 100 * both >= percent * (size[:, None] + size[None] - both)
    lowest = np.arange(len(texts))
    while (new := np.array([lowest[row].min() for row in linked])).tolist() != lowest.tolist():
        lowest = new
    assert 100 < len(set(lowest.tolist())) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(df, percent).collect()}
    assert [got[i] for i in range(len(texts))] == lowest.tolist()


def test_fm_index_hot_seed(spark, monkeypatch):
    """One passage in many contexts: its stretches are dealt window by window, with the same result."""
    rng = np.random.default_rng(8)
    seed = [f"s{i}" for i in range(8)]
    texts = []
    for i in range(120):
        around = rng.integers(0, 6, 24)
        texts.append(" ".join([f"w{x}" for x in around[:12]] + seed + [f"w{x}" for x in around[12:]] + (["tail", *map(str, range(14))] if i % 7 == 0 else [])))
    first, want = {}, []
    for i, t in enumerate(texts):
        w = t.split()
        gone = set()
        for a in range(len(w) - 12):
            if first.setdefault(tuple(w[a:a + 13]), i) < i:
                gone.update(range(a, a + 13))
        want.append((i, len(w), len(gone)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for words in (fm_index.SHARD_WORDS, 200):
        monkeypatch.setattr(fm_index, "SHARD_WORDS", words)
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in fm_index.remove_repeats(df).collect()) == want


def test_fm_index(spark, odd_docs, no_docs):
    rng = np.random.default_rng(1)
    texts = [[f"v{x}" for x in rng.integers(0, 50, 200)] for _ in range(12)]
    for i in range(1, 12):  # passages of earlier documents
        texts[i][20:20 + 10 + i] = texts[i - 1][50:60 + i]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(20, " ".join(texts[0])), (21, None), (22, "a b")]
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j:j + 13]), i)
    for r in fm_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = (dict(rows)[r.doc_id] or "").split()
        off = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < r.doc_id:
                off |= set(range(j, j + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in off)
        assert (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) == (len(w), len(off), kept, hashlib.sha256(kept.encode()).hexdigest())
    got = [(r.doc_id, r.n_words, r.n_removed) for r in fm_index.remove_repeats(odd_docs).collect()]
    assert len(got) == 11 and (1, 40, 0) in got and got.count((2, 40, 40)) == 2 and (None, 3, 0) in got
    assert fm_index.remove_repeats(no_docs).count() == 0
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    shared = [(1, a), (5, b + " " + a), (5, c + " " + c + " " + b), (6, c)]  # two texts of one id keep their own places
    got = {(r.doc_id, r.n_words): r.spans for r in fm_index.remove_repeats(spark.createDataFrame(shared, "doc_id long, text string")).collect()}
    assert got == {(1, 30): [], (5, 60): [[30, 60]], (5, 90): [], (6, 30): [[0, 30]]}


def test_warc(spark):
    page = "<html><head><title>T &amp; u</title><script>x</script></head><body><p>One &lt;b&gt;</p><a href='/l'>two</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", page), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    responses = warc.response_records(pages)
    rows = warc.derive(responses).collect()
    assert len(rows) == 6 and warc.derive(responses.limit(0)).count() == 0
    source = {r.page_id: warc.parse_records(bytes(r.response))[0] for r in responses.collect()}
    for r in rows:
        ((head, block),) = warc.parse_records(bytes(r.record))
        assert head["WARC-Refers-To"] == r.refers_to == source[r.page_id][0]["WARC-Record-ID"] and head["WARC-Record-ID"] == r.record_id
        assert head["WARC-Source-Payload-Digest"] == source[r.page_id][0]["WARC-Payload-Digest"] and warc.sha1(block) == r.block_digest
        if r.page_id == 1:
            text = block.decode()
            assert text == "One <b>\ntwo" if r.kind == "conversion" else ("title: T & u" in text and "outlink: /l" in text and "source-header-content-type: text/html" in text)


def test_quality(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = ftrl.score(docs, ftrl.fit_quality(docs, labels)).filter(ftrl.held_out("doc_id")).join(labels, "doc_id").toPandas()
    bad, good = scored[scored.quality == 0].score.to_numpy(), scored[scored.quality == 1].score.to_numpy()
    assert (bad[:, None] < good[None, :]).mean() > 0.97 and ((scored.score >= 0.3) == (scored.quality == 1)).mean() > 0.95
    none = ftrl.fit_quality(no_docs, labels)
    assert not none.any() and {r.score for r in ftrl.score(odd_docs, none).collect()} == {0.5} and ftrl.score(no_docs, none).count() == 0


def test_tokens(spark, odd_docs, no_docs):
    enc = token_orc.ChunkEncoder(TOKENIZER)
    for t in ["a  b", " x", "x ", "a\n b", "a \nb", "don't 's  .,", "a.\n\nB c", "<|endoftext|> a", "é.\nÉ, ß", " ", "\n", "a\n\nb. c", "x\u00a0 y", "12, a1. ,", "Ab.\nCd ef,"]:
        assert list(np.frombuffer(enc.encode(t), "<u4")) == enc.tokenizer.encode(t, add_special_tokens=False).ids, t
    rows = sorted(token_orc.tokenize(odd_docs, TOKENIZER).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    texts, start = {r.doc_id: r.text for r in odd_docs.collect()}, 0
    for r in rows:
        ids = enc.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_orc.tokenize(no_docs, TOKENIZER).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    n = len(rows)
    assert n and sorted(r.place for r in rows) == list(range(n)) and len({r.doc_id for r in rows}) == n
    sets = [_sets(r.text) for r in rows]
    assert not any(s and 100 * len(s & t) >= 80 * len(s | t) for i, s in enumerate(sets) for t in sets[:i])


def test_pipeline_stages(spark, tmp_path):
    """Every stage against brute force, and the whole run against all of them: a stage left out or without effect fails."""
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    item = bench.orderBy("item_id").first().text
    kept = docs.filter("length(text) > 2000").orderBy("doc_id").limit(2).collect()
    near = " ".join(w if i != 50 else "other" for i, w in enumerate(kept[0].text.split()))
    planted = [(10**6, near, "en", kept[0].source), (10**6 + 1, kept[1].text[:1000] + " " + item, "en", kept[1].source)]
    docs.unionByName(spark.createDataFrame([(*p, len(p[1])) for p in planted], docs.schema)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    scores = {r.doc_id: r.score for r in ftrl.score(docs, ftrl.fit_quality(docs, labels)).collect()}
    good = {d for d, s in scores.items() if s >= 0.3}
    left = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    assert 0 < len(left) < len(scores)
    ids = sorted(left)
    sets, low = {d: _sets(left[d].text) for d in ids}, {d: d for d in ids}
    links = [(a, b) for i, b in enumerate(ids) for a in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    one = {d for d in ids if low[d] == d}
    assert 0 < len(one) < len(left)
    plain = lambda t: [p for w in (t or "").encode().split() if (p := latent.plain_word(w))]
    items = [plain(r.text) for r in bench.collect()]
    leaked = set()
    for d in one:
        words = plain(left[d].text)
        for t in filter(None, items):
            index = latent.Items.__new__(latent.Items)
            index.whole, index.answer = [latent.masks_of(t)], [latent.masks_of(t[-latent.ANSWER_WORDS:])]
            if latent.judge(index, 0, words)[0]:
                leaked.add(d)
    clean = one - leaked
    assert 0 < len(clean) < len(one)

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == clean and len(out) == len(clean)
    n = len(out)
    order = sorted(out, key=lambda r: (r.mix_slot, r.mix_offset))
    assert [r.row_no for r in order] == list(range(n)) and [r.doc_id for r in order] != sorted(clean)
    mixed = corpus_pipeline.mix(spark, docs.filter(docs.doc_id.isin(sorted(clean))), str(tmp_path)).collect()
    assert {r.doc_id: (r.mix_slot, r.mix_offset) for r in mixed} == {r.doc_id: (r.mix_slot, r.mix_offset) for r in out}
    slot_source = {}
    for r in order:
        assert slot_source.setdefault(r.mix_slot, r.source) == r.source
    assert sorted(slot_source) == list(range(len(slot_source)))
    a, b = feistel.sides(n)
    for r in out:
        x = feistel.permute(r.row_no, a, b, feistel.KEY)
        while x >= n:
            x = feistel.permute(x, a, b, feistel.KEY)
        assert (r.place, r.shard, r.slot) == (x, x % feistel.SHARDS, x // feistel.SHARDS)
