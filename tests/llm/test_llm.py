"""The operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""
import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from emberlake.llm import bpe, mixing, ngram_join, pitman_yor, quotient, substring_dedup, token_counts, topk, toxicity, url_filter
from emberlake.llm.exact_dedup import drop_copies, exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = P.path("byte_bpe_50k.tiktoken")


def corpus() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ta", "Ko", "ri", "ß", "é", "mu", "ne", "lo"]) for _ in range(rng.randint(1, 4)))
    words = [word() for _ in range(300)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t "]) for _ in range(n))
    texts = [text(rng.choice([1, 2, 3, 4, 5, 20, 60, 200])) for _ in range(60)]
    long = text(4000)
    passage = text(40)
    texts += [None, "", " \n\t ", "A", "a", "é" * 500, "x" * 3000, long, long.upper(), long + " end"]
    texts += [texts[7], texts[7], texts[8].upper(), texts[9] + " more", "one " + passage + " two", text(10) + passage + text(9), passage * 3]
    for k in range(6):  # a group of near copies
        w = texts[11].split()
        w[k * len(w) // 6 : k * len(w) // 6 + 1] = [f"edit{k}"]
        texts.append(" ".join(w))
    rows = [(k, t, "en", rng.choice(["a", "b", "Z", None, "hot", "hot", "hot"]), len(t) if t is not None else None) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[61]]  # repeated rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs):
    norm = [(r[0], (r[1] or "").translate(LOW)) for r in ROWS]
    best, size = {}, Counter()
    for k, t in norm:
        best[t] = max(best.get(t, -1), k)
        size[t] += 1
    got = exact_dedup(docs.withColumn("sha", docs.text).withColumn("norm", docs.lang)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted((k, best[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for k, t in norm)
    assert sum(r.kept for r in got) == len(best) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = drop_copies(docs).collect()
    assert sorted(r.doc_id for r in left) == sorted(best.values())


def test_quotient_filter_merges_losslessly():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2) for _ in range(2))
    a[:50] = b[:50]
    f = quotient.CountingQuotientFilter
    both = f.from_bytes(f.of(a).to_bytes()).merge(f.of(b, q=3))
    want = Counter(a.tolist()) + Counter(b.tolist())
    assert dict(zip(both.fingerprints().tolist(), both.counts.tolist())) == want
    assert sorted(both.repeated().tolist()) == sorted(k for k, n in want.items() if n > 1)
    assert both.count(int(a[0])) == want[int(a[0])] and both.count(12345) == want.get(12345, 0)


def test_repeated_counts(spark):
    got = quotient.counts(spark.createDataFrame([(k % 40 - 5,) for k in range(100)], "fp long")).collect()
    assert {r.fp: r.n for r in got} == Counter(k % 40 - 5 for k in range(100))


def test_mixing(docs):
    got = mixing.mix(docs.withColumn("size", docs.lang).withColumn("target", docs.lang)).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda rows: sorted((r.doc_id, r.size, r.target, r.taken) for r in rows)
    assert key(got) == key(again)
    size = {k: len(WORD.findall(t or "")) for k, t, *_ in ROWS}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in got)
    by, taken = defaultdict(int), defaultdict(int)
    for r in ROWS:
        by[r[3]] += size[r[0]]
    order = sorted(k for k in by if k is not None) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    stopped: set = set()
    while True:
        level = (sum(by.values()) - sum(3 * by[s] for s in stopped)) / max(1, sum(weight[s] for s in order if s not in stopped))
        more = {s for s in order if s not in stopped and weight[s] * level > 3 * by[s]}
        if not more:
            break
        stopped |= more
    target = {s: 3 * by[s] if s in stopped else weight[s] * level for s in order}
    for r in got:
        assert r.source_size == by[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(128, 0.03 * target[s]) for s in order)


def test_sainte_lague_is_highest_quotients(spark):
    from emberlake.llm.workspace import Workspace

    votes = [53.0, 24.0, 23.0, 24.0, 1.0, 0.0]
    df = spark.createDataFrame([(k, v, 9) for k, v in enumerate(votes)], "id int, v double, cap long")
    for seats in (0, 1, 7, 20, 500):
        got = {r.id: r.quota for r in mixing.sainte_lague(df, seats, "v", "cap", ["id"], Workspace(spark, "t")).collect()}
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(9) if v > 0))[:seats]
        want = Counter(i for _, i in quotients)
        assert got == {k: want.get(k, 0) for k in range(len(votes))}


def test_mixed_rows_follow_taken(docs):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got, text = Counter(), {k: t for k, t, *_ in ROWS}
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.text in text[r.doc_id]
    assert got == +taken


def test_bpe(docs, none):
    ranks = bpe.load_ranks(VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = bpe.encoder(VOCABULARY, P.PATTERN)
    texts = [t or "" for _, t, *_ in ROWS] + ["<|endoftext|>", "a" * 1000, "ab" * 700, " " * 600 + "x", "日本語のテキスト" * 40, "\x00\x1f\x85", "🙂" * 90, "don't we'LL"]
    assert e.encode(texts) == [own.encode_ordinary(t) for t in texts]
    assert [e.decode(x) for x in e.encode(texts)] == [t.encode() for t in texts]
    got = {r.doc_id: r for r in bpe.round_trip(docs, VOCABULARY, P.PATTERN).collect()}
    for k, t, *_ in ROWS:
        ids = own.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    both = bpe.decode(bpe.encode(docs, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN).collect()
    assert len(both) == len(ROWS) and all(bytes(r.bytes) == (r.text or "").encode() for r in both)
    assert bpe.round_trip(none, VOCABULARY, P.PATTERN).count() == 0


def test_token_counts(docs, spark, tmp_path):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(900, "a<|endoftext|><|endoftext|> b", "", "", 0), (901, " " * 3000 + "x", "", "", 0), (902, "y" * 2000, "", "", 0), (903, "\x1c\u180e\u200b tab\t\u3000", "", "", 0)], SCHEMA)
    every = docs.union(extra)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time all are hits
        got = token_counts.token_counts(every.withColumn("content", every.lang), path, P.PATTERN, cache=cache).collect()
        for r in got:
            t = next((t for k, t, *_ in [*ROWS, *extra.collect()] if k == r.doc_id), None) or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
        assert len(got) == len(ROWS) + 4
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in [*ROWS, *extra.collect()]})


def test_token_counts_refuses_other_tokenizers(tmp_path):
    import json

    with open(P.path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    assert token_counts.unlike(spec) == []
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"truncation": {"max_length": 9}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        assert token_counts.unlike(spec | change)
    with pytest.raises(ValueError):
        token_counts.Counter(P.path("word_bpe_49k.json"), P.PATTERN)


def test_token_counts_query_finds_its_counts_again(spark, tmp_path):
    from emberlake.llm import queries

    docs = spark.createDataFrame([(k, f"one {k % 7} text of its own") for k in range(30)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    cache = lambda: token_counts.read_cache(spark, token_counts.default_cache(spark)).count()
    before = cache()
    first = sorted(queries.op8_token_counts(spark, str(tmp_path)).collect())
    assert cache() == before + 7
    assert sorted(queries.op8_token_counts(spark, str(tmp_path)).collect()) == first and cache() == before + 7


def test_url_filter(spark):
    rng = random.Random(2)
    hosts = ["net", "a.net", "NET", "example.net", "w.Example.NET", "example.com", "x.example.com", "myexample.com", "org", "a.b.org", "xorg", "", "example.net:80", "u@example.com"]
    paths = ["", "/", "/en/", "/en", "/en/1?x", "/de/2#f", "/fr/", "/EN/x", "?/en/", "#/de/", "/a\nb"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a.net/x", "x://y://net/", "://net/"]
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}

    def want(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = re.split(r"[?#]", u.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        host, path = host.translate(LOW), slash + path
        fit = [(len(h + q), h + q, v) for (h, q), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(q)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    rows = [(k, u, "x") for k, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.url_filter(pages, url_filter.rule_table(spark)).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((k, *want(u)) for k, u, _ in rows)
    none = url_filter.rule_table(spark).limit(0)
    assert all(r.verdict == "allow" for r in url_filter.url_filter(pages, none).collect())
    assert url_filter.url_filter(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def brute_top_k(rows, k=20):
    """query_id: [(vec_id, score)], in whole numbers of any size; a score beyond a long comes back as the nearest."""
    good = {i: [int(math.floor(64 * float(c))) for c in v] for i, v, *_ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = {}
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:k]
        out[q] = [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in best]
    return out


def found_top_k(df):
    found = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return dict(found)


@pytest.mark.parametrize("shard,block", [(64, 8), (16, 3), (4096, 8192)])
def test_top_k(spark, monkeypatch, shard, block):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[100:220] = x[100]  # a common vector: ties
    x[300:] += 9 * rng.standard_normal((10, 8)).astype(np.float32)[np.arange(100) % 10]  # clusters, so shards are left out
    rows = [(k, v.tolist(), "c") for k, v in enumerate(x)]
    rows += [(400, None, "c"), (420, [1.0, None] * 4, "c"), (440, [math.nan] * 8, "c"), (460, [math.inf] * 8, "c"), (480, [], "c"), (481, [1.0, 2.0], "c"), (500, [float(np.float32(1e30))] * 8, "c"), (None, [1.0] * 8, "c"), (None, None, "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string").repartition(3)
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    assert found_top_k(topk.top_k(vectors, lambda c: c % 20 == 0)) == brute_top_k(rows)
    if shard == 64:
        assert topk.top_k(vectors.limit(0), lambda c: c % 20 == 0).count() == 0


def test_top_k_of_great_numbers(spark):
    """Components beyond 32 bits, sums beyond 53 and beyond 63."""
    big = [[1e9, 1.0], [1e9, 2.0], [2e9, 0.0], [3e9, 1.0], [-3e9, 1.0], [1e200, -5.0], [1e200, -4.0], [-1e200, 3.0], [2.0**53, 1.0], [2.0**53, -1.0], [0.0, 1.0]]
    rows = [(20 * k, v, "") for k, v in enumerate(big)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string")
    got, want = found_top_k(topk.top_k(vectors, lambda c: c % 20 == 0)), brute_top_k(rows)
    assert got == want
    assert [k for k, _ in got[0]][:4] == [120, 100, 160, 180] or got[0] == want[0]


def sets(n):
    out = []
    for _, t, *_ in ROWS:
        w = WORD.findall((t or "").translate(LOW))
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, none, n, percent):
    s = sets(n)
    up = {k: k for k, *_ in ROWS}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(ROWS)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = find(ROWS[i][0]), find(ROWS[j][0])
                up[max(a, b)] = min(a, b)
    got = ngram_join.ngram_join(docs.withColumn("id", docs.lang), n, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((r[0], len(x), find(r[0])) for r, x in zip(ROWS, s))
    kept = ngram_join.one_of_each(docs, n, percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in up if find(k) == k}
    assert ngram_join.ngram_join(none).count() == 0


def test_pigeonhole_loses_no_pair():
    rng = np.random.default_rng(5)
    scheme = ngram_join.Scheme(85, 10**6)
    for size in [1, 3, 6, 7, 9, 12, 15, 18, 21, 40, 100, 333]:
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        for _ in range(20):
            drop = rng.integers(0, size + 1)
            add = rng.integers(0, size + 1)
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
            if len(b) and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                keys, ids = scheme.signatures([np.unique(a), np.unique(b)], np.array([1, 2]))
                probe = (keys & np.uint64(1)).astype(bool)  # the last bit; a shared key counts only if one of the two probes with it
                keys >>= np.uint64(1)
                x, y = (set(keys[ids == k].tolist()) for k in (1, 2))
                equal = len(a) == len(b) and len(np.union1d(a, b)) == len(a)  # copies are told by digest
                assert equal or x & y & set(keys[probe].tolist())
                assert not (x & y) or (x & y & set(keys[probe].tolist()))


def brute_substrings(rows, length):
    first = {}
    for k, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, (k, i)), (k, i))
    out = []
    for k, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (k, i):
                gone[i : i + length] = b"\1" * length
        out.append((k, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [100, 50])
def test_substring_dedup(docs, none, length):
    got = substring_dedup.substring_dedup(docs.withColumn("mark", docs.lang).withColumn("spans", docs.lang), length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter(brute_substrings(ROWS, length))
    assert sum(r.n_removed for r in got) > 5000
    assert substring_dedup.substring_dedup(none).count() == 0


def test_texts_that_lose_nothing_are_not_joined(spark):
    """Of 500 rows those that may lose bytes go on to the join, null ids too, and hardly any others; no row is lost."""
    docs = spark.createDataFrame([(None if k == 7 else k, f"text {k}") for k in range(500)], "doc_id long, text string")
    spans = spark.createDataFrame([(k, 0, b"") for k in (3, 250, substring_dedup.FIRST)], "doc_id long, mark long, spans binary")
    whole, rest = ([r.doc_id for r in x.collect()] for x in substring_dedup._parted(docs, spans))
    assert {3, 250, None} <= set(rest) and len(rest) < 10
    assert Counter(whole + rest) == Counter(None if k == 7 else k for k in range(500))


def test_a_task_has_one_worker(docs):
    """Texts are cut in one Python worker a task: no two steps in Python follow each other in the plan."""
    plan = substring_dedup.substring_dedup(docs)._jdf.queryExecution().sparkPlan().toString().splitlines()
    steps = [(re.search(r"\w", line).start(), bool(re.search("ArrowEvalPython|MapInArrow", line))) for line in plan]
    above: list[tuple[int, bool]] = []
    for depth, python in steps:
        while above and above[-1][0] >= depth:
            above.pop()
        if python and not any("Join" in plan[k] for k in range(len(plan)) if steps[k] in above):
            assert not any(p for _, p in above)
        above.append((depth, python))
    assert sum(p for _, p in steps) == 3


def test_triggers_are_dealt_evenly():
    """Triggers have small hashes, yet each range of fingerprints gets its share of them."""
    text = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 1 << 20)))
    [made] = substring_dedup._trigger_filters.__wrapped__([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])], 100, 6)
    sizes = [len(quotient.CountingQuotientFilter.from_bytes(x.as_buffer()).remainders) for x in made.column("filter")]
    assert len(sizes) == 64 and max(sizes) < 2 * sum(sizes) / 64


def test_phrases_with_one_key_are_told_apart(docs):
    """Phrases whose first keys clash all the time: the other half of their digests decides."""
    got = substring_dedup.substring_dedup(docs, 100, key_bits=3)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == Counter(brute_substrings(ROWS, 100))


def test_pitman_yor(docs, none):
    got = pitman_yor.pitman_yor(docs.withColumn("row", docs.lang).withColumn("score", docs.lang)).collect()
    tokens = {k: [*WORD.findall((t or "").translate(LOW)), None] for k, t, *_ in ROWS}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    count = Counter(w for r in ROWS if not held[r[0]] for w in tokens[r[0]])
    n = sum(count.values())
    for r in got:
        t = tokens[r.doc_id]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (len(count) + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert len(got) == len(ROWS)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert pitman_yor.pitman_yor(none).count() == 0


def test_pitman_yor_is_the_same_for_any_slices(docs, monkeypatch):
    scores = []
    for p in (3, 50):
        monkeypatch.setattr(pitman_yor, "slices_by_size", lambda *a, p=p, **k: p)
        scores.append(sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in pitman_yor.pitman_yor(docs).collect()))
    assert scores[0] == scores[1]


def test_a_cell_is_seated_as_its_posterior_says():
    """Customers that leave and are seated again, against the odds of each number of tables by generalised Stirling numbers."""
    c, d, strength, others, base, cells = 6, 0.8, 2.0, 3, 0.25, 20_000
    stirling = {(0, 0): 1.0}
    for n in range(c):
        for t in range(n + 2):
            stirling[n + 1, t] = stirling.get((n, t - 1), 0.0) + (n - t * d) * stirling.get((n, t), 0.0)
    odds = np.array([stirling[c, t] * math.prod((strength + d * (others + i)) * base for i in range(t)) for t in range(1, c + 1)])
    key = pitman_yor.mix(np.arange(1, cells + 1, dtype=np.uint64))
    many, flat = np.ones(cells, np.int64), np.full(cells, c)
    for sweep in range(12):
        many, flat = pitman_yor.reseat(pitman_yor.mix(key + np.uint64(sweep)), np.full(cells, c), many, flat, np.full(cells, base), strength, d, others + many)
        assert flat.sum() == c * cells and (flat > 0).all()
    assert np.abs(np.bincount(many, minlength=c + 1)[1:] / cells - odds / odds.sum()).max() < 0.015


def test_indexing_sets_takes_little_memory():
    """Some megabytes of texts as the pipeline's third stage indexes them: a worker holds few index entries at once."""
    import tracemalloc

    rng = np.random.default_rng(2)
    batch = pa.record_batch({"doc_id": np.arange(4000), "text": [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 300)) for _ in range(4000)]})
    scheme = ngram_join.Scheme(80, 250_000)
    tracemalloc.start()
    rows = sum(b.column(2).is_valid().to_numpy(zero_copy_only=False).sum() for b in ngram_join._index.__wrapped__([batch], scheme, 5, 64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and peak < 60 << 20


def test_rounds_of_a_bucket_offer_each_pair_once():
    """30 sets that might link and don't: a round offers `width` pairs an id at most, a mark for each id says which are left, and all pairs come once."""
    sketch = ngram_join.sketch(np.arange(1, 101, dtype=np.uint64), 85).tobytes()
    ids, marks, width, seen = np.arange(100, 130), np.full(30, -(2**63)), 4, []
    for _ in range(5):
        table = pa.table({"slice": [0] * 30, "key": [5] * 30, "id": ids, "probe": [True] * 30, "lead": [100] * 30, "comp": ids, "n": [100] * 30, "sketch": [sketch] * 30, "mark": marks})
        offered = list(zip(*ngram_join._open_pairs(table, 85, width).to_pydict().values(), strict=True))
        assert max(Counter(a for a, _ in offered).values(), default=0) <= width
        for a, b in offered:
            marks[a - 100] = max(marks[a - 100], b)
        seen += offered
    assert sorted(seen) == [(a, b) for a in range(101, 130) for b in range(a + 1, min(a + 21, 130))]
    assert len(seen) == len(set(seen)) == sum(min(20, 129 - a) for a in range(101, 130))


def test_only_buckets_with_pairs_left_go_on(spark):
    """Each bucket's lead has been tried: a bucket of a lead and one other id has no pair left, nor has one whose other ids are one component, or of whom none probes."""
    buckets = {1: (10, {11: 11}), 2: (10, {11: 11, 12: 12}), 3: (20, {21: 21, 22: 21}), 4: (30, {31: 31, 32: 32})}
    rows = [(key, k, probe, lead, comp) for key, (lead, others) in buckets.items() for k, comp in {lead: lead, **others}.items() for probe in (False, key != 4)]
    left = ngram_join.unsettled(spark.createDataFrame(rows, "key long, id long, probe boolean, lead long, comp long"))
    assert sorted(map(tuple, left.collect())) == [(2, 11, True, 10, 11), (2, 12, True, 10, 12)]


def test_rows_without_pairs_left_leave_their_bucket():
    """60 sets of which only 10 may link with each other: the others go after the first round, and so do all rows once the last pair has been offered."""
    rng, size = np.random.default_rng(6), 60
    alike = ngram_join.sketch(np.arange(1, 101, dtype=np.uint64), 85).tobytes()
    sketches = [alike] * 10 + [ngram_join.sketch(rng.integers(1, 2**63, 100, dtype=np.uint64), 85).tobytes() for _ in range(size - 10)]
    ids = np.arange(100, 100 + size)
    table = pa.table({"slice": [0] * size, "key": [5] * size, "id": ids, "probe": [True] * size, "lead": [99] * size, "comp": ids, "n": [100] * size, "sketch": pa.array(sketches, pa.binary()), "mark": [-(2**63)] * size})
    for width, left in ((4, set(range(100, 110))), (8, {100, 109}), (9, set())):
        out = ngram_join._open_pairs(table, 85, width, rest=True)
        kept = out.filter(out["id"].is_valid())
        assert set(kept["id"].to_pylist()) == left and set(kept["sketch"].to_pylist()) <= {alike}
        assert out.filter(out["a"].is_valid()).select(["a", "b"]).equals(ngram_join._open_pairs(table, 85, width))


def test_rounds_carry_only_rows_with_pairs_left(spark, monkeypatch):
    """30 texts that nearly link, and 60 that share their buckets and never do: later rounds hold next to none of the 60, and all rounds together offer the pairs that one round of any width does, each once."""
    core = " ".join(f"c{i}" for i in range(140))
    texts = {k: " ".join([core, *(f"x{k}_{i}" for i in range(13 if k < 30 else 26))]) for k in range(90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2).localCheckpoint()
    save, saved = ngram_join.Workspace.save, []

    def spy(self, df):
        out = save(self, df)
        if {"mark", "key"} <= set(out.columns):
            saved.append(("rows", {r.id for r in out.select("id").collect()}))
        elif {"a", "b", "turn"} == set(out.columns):
            saved.append(("pairs", [tuple(r) for r in out.select("turn", "a", "b").collect()]))
        return out

    monkeypatch.setattr(ngram_join.Workspace, "save", spy)
    offered, carried = [], []
    for width in (2, 10**6):
        saved.clear()
        monkeypatch.setattr(ngram_join, "FIRST_WIDTH", width)
        assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()} == {k: k for k in range(90)}
        carried.append([x for kind, x in saved if kind == "rows"])
        offered.append([(a, b) for k, pairs in enumerate(x for kind, x in saved if kind == "pairs") for turn, a, b in pairs if turn <= width * ngram_join.WIDER**k])
    others = [len(rows - set(range(30))) for rows in carried[0]]
    assert others[0] > 40 and len(others) > 2 and max(others[1:]) <= 5, others
    assert len(offered[0]) == len(set(offered[0])) > 100 and set(offered[0]) == set(offered[1])


def test_near_dedup_and_mixing_leave_no_tables(docs, monkeypatch, tmp_path):
    """What a stage of the pipeline returns holds no tables but those it is read from."""
    monkeypatch.setattr("emberlake.llm.workspace.shared_dir", lambda spark: str(tmp_path))
    assert ngram_join.one_of_each(docs, 5, 80).count() and mixing.mixed(docs).count()
    assert {p.relative_to(tmp_path).parts[0].rsplit("-", 1)[0] for p in tmp_path.rglob("*.parquet")} == {"mixed", "one-of-each"}


def test_pairs_of_many_buckets_are_offered_once_a_slice():
    """20 sets that meet in 10 buckets of one slice: each pair comes once, and `width` pairs an id at most in all."""
    sketch = ngram_join.sketch(np.arange(1, 101, dtype=np.uint64), 85).tobytes()
    ids = np.tile(np.arange(100, 120), 10)
    table = pa.table({"slice": [0] * 200, "key": np.repeat(np.arange(10), 20), "id": ids, "probe": [True] * 200, "lead": [100] * 200, "comp": ids, "n": [100] * 200, "sketch": [sketch] * 200, "mark": [-(2**63)] * 200})
    for width in (4, 100):
        offered = list(zip(*ngram_join._open_pairs(table, 85, width).to_pydict().values(), strict=True))
        assert offered == [(a, b) for a in range(101, 120) for b in range(a + 1, min(a + 1 + width, 120))]


def test_sketches_reject_sets_that_differ_in_a_few_more():
    """Copies that differ from each other in 1.4 times the elements that links may: few of their pairs need their texts, and no pair that links is lost."""
    rng, size = np.random.default_rng(4), 150
    for times, least, most in ((1.0, 1.0, 1.0), (1.4, 0.0, 0.15)):
        whole = rng.integers(1, 2**63, size, dtype=np.uint64)
        changed = int(times * ngram_join.differences(2 * size, 85)) // 2  # by so many elements on either side
        copies = [np.concatenate([whole[changed:], rng.integers(1, 2**63, changed, dtype=np.uint64)]) for _ in range(300)]
        sketches = [ngram_join.sketch(s, 85) for s in (whole, *copies)]
        j = np.arange(1, 301)
        passed = ngram_join.plausible_pairs(sketches, np.zeros(300, np.int64), j, np.full(300, 2 * size), 85).mean()
        assert least <= passed <= most


def test_all_customers_of_large_cells_are_seated():
    """300 and 1500 customers of one dish: numbers of tables as the recurrence of Stirling numbers gives them, from the first sweep on."""
    d, strength, others = pitman_yor.DISCOUNT[1], pitman_yor.STRENGTH[1], 100
    for c in (300, 1500):
        s = pitman_yor.Slice(np.full(400, 7, np.uint64), np.arange(400, dtype=np.uint64), np.full(400, c))
        s.start(3)
        base = s.root(s.root_customers().sum(), s.root_many.sum(), 1)[0]
        s.sweep(others + s.many, s.root_customers().sum(), s.root_many.sum(), 1, 3, 0)
        stirling = np.full(c + 1, -np.inf)
        stirling[0] = 0.0
        with np.errstate(divide="ignore"):
            for n in range(c):
                stirling = np.logaddexp(np.log(np.maximum(n - d * np.arange(c + 1), 0)) + stirling, np.concatenate([[-np.inf], stirling[:-1]]))
        odds = stirling[1:] + np.cumsum(np.log(base * (strength + d * (others + np.arange(c)))))
        odds = np.exp(odds - odds.max()) / np.exp(odds - odds.max()).sum()
        mean = (odds * np.arange(1, c + 1)).sum()
        deviation = math.sqrt((odds * (np.arange(1, c + 1) - mean) ** 2).sum())
        assert abs(s.many.mean() - mean) < 4 * deviation / 20 and 0.8 < s.many.std() / deviation < 1.2


def test_tokens_travel_by_cell():
    """A text that repeats two words asks for its cells once each."""
    texts = pa.record_batch({"text": ["ab cd " * 5000], "doc_id": [1], "held_out": [False], "print": [7]})
    packed = [x for b in pitman_yor._asked([texts], 1) for k, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist()) if not k]
    dishes, cells, low, high, tokens, of = pitman_yor.unpack(pitman_yor.unsqueezed(packed[0]))
    assert (len(dishes), sorted(cells), len(low), len(high), sorted(tokens)) == (3, [1, 1, 2], 4, 4, [1, 1, 4999, 5000])
    assert len(packed[0]) < 1000 and tokens.sum() == 10_001 == len(of)


class Plain:
    """The same model by one sequential sampler: every customer in turn, root and restaurants as they are at that moment."""

    def __init__(self, pairs, seed):
        self.rng, self.pairs = random.Random(seed), pairs
        self.tables, self.root = defaultdict(list), defaultdict(list)  # (context, dish): sizes; dish: sizes
        self.size, self.served = Counter(u for u, _ in pairs), Counter()
        self.words = len({w for _, w in pairs})
        for u, w in pairs:
            self.enter(u, w)

    def root_p(self, w):
        d, s = pitman_yor.DISCOUNT[0], pitman_yor.STRENGTH[0]
        every, tables = sum(map(sum, self.root.values())), sum(map(len, self.root.values()))
        return (sum(self.root[w]) - d * len(self.root[w]) + (s + d * tables) / (self.words + 1)) / (s + every)

    def choose(self, sizes, d, new):
        x = self.rng.random() * (sum(n - d for n in sizes) + new)
        for k, n in enumerate(sizes):
            x -= n - d
            if x < 0:
                sizes[k] += 1
                return False
        sizes.append(1)
        return True

    def leave(self, sizes):
        k = self.rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    def enter(self, u, w):
        d, s = pitman_yor.DISCOUNT[1], pitman_yor.STRENGTH[1]
        if self.choose(self.tables[u, w], d, (s + d * self.served[u]) * self.root_p(w)):
            self.served[u] += 1
            d, s = pitman_yor.DISCOUNT[0], pitman_yor.STRENGTH[0]
            self.choose(self.root[w], d, (s + d * sum(map(len, self.root.values()))) / (self.words + 1))

    def sweep(self):
        for u, w in self.pairs:
            if self.leave(self.tables[u, w]):
                self.served[u] -= 1
                self.leave(self.root[w])
            self.enter(u, w)

    def p(self, u, w):
        d, s = pitman_yor.DISCOUNT[1], pitman_yor.STRENGTH[1]
        t = self.tables.get((u, w), [])
        return (sum(t) - d * len(t) + (s + d * self.served[u]) * self.root_p(w)) / (s + self.size[u])


def test_pitman_yor_scores_as_a_sequential_sampler(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["aa", "bb", "cc"] if rng.random() < 0.7 else ["dd", "ee", "ff", "gg"]) for _ in range(rng.randint(4, 9))) for _ in range(30)]
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    tokens = [list(zip([None, *t.split()], [*t.split(), "END"])) for t in texts]
    pairs = [x for k, t in enumerate(tokens) if not held(k) for x in t]
    total = Counter()
    for seed in range(25):
        plain = Plain(pairs, seed)
        for sweep in range(12):
            plain.sweep()
            if sweep >= 8:
                for x in {y for t in tokens for y in t}:
                    total[x] += plain.p(*x) / 100
    want = {k: sum(math.log10(total[x]) for x in t) for k, t in enumerate(tokens)}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = [{r.doc_id: r.score for r in pitman_yor.pitman_yor(docs, seed=s).collect()} for s in range(2)]
    for k, x in want.items():
        mine = sum(g[k] for g in got) / len(got)
        assert abs(mine - x) < 0.03 * len(tokens[k]), (k, mine, x)


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(6)
    dish, context = rng.integers(1, 40, 3000).astype(np.uint64) ** 2 % np.uint64(41) + np.uint64(1), rng.integers(0, 12, 3000).astype(np.uint64)
    of = np.zeros(3000, np.int64)
    batch = pitman_yor._dealt_out(dish[(o := np.lexsort((context, dish)))], context[o], of + 1, 1)
    s = pitman_yor.Slice(*pitman_yor._cells([x.as_buffer() for x in batch.column(1)]))
    assert s.count.sum() == 3000 and len(s.context) == len(set(zip(dish.tolist(), context.tolist())))
    s.start(0)
    n = len(s.dishes)
    for sweep in range(4):
        us, _ = s.contexts()
        served = np.bincount(np.searchsorted(us, s.context), s.tables(), len(us)).astype(np.int64)
        assert (us == np.unique(s.context)).all()
        s.sweep(served, s.root_customers().sum(), s.root_many.sum(), n, 0, sweep)
        s = pitman_yor.Slice.load(s.save())
        assert (s.many >= 1).all() and s.flat.sum() == s.count[s.multi].sum() and (s.flat > 0).all()
        assert s.root_flat.sum() == s.root_customers().sum() == s.tables().sum()
        root = s.root(s.root_customers().sum(), s.root_many.sum(), n)
        assert math.isclose(root.sum(), 1.0, rel_tol=1e-9)
        served = np.bincount(np.searchsorted(us, s.context), s.tables(), len(us))
        for k, u in enumerate(us):  # every restaurant: all known dishes and one unknown
            here = s.context == u
            d, strength = pitman_yor.DISCOUNT[1], pitman_yor.STRENGTH[1]
            own = (s.count - d * s.tables())[here].sum()
            whole = (own + (strength + d * served[k]) * root.sum()) / (strength + s.count[here].sum())
            assert math.isclose(whole, 1.0, rel_tol=1e-9)


LONG = "".join(random.Random(1).choice(["lorem ", "Ipsum ", "do\n", "sit, "]) + str(random.Random(k).randrange(10**5)) + " " for k in range(400_000))[:5_000_000]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(1, LONG, "en", "s", len(LONG)), (2, "short one", "en", "s", 9), (3, LONG, "en", "t", len(LONG))], SCHEMA)


def test_texts_of_megabytes(spark, long):
    size = len(WORD.findall(LONG))
    assert {r.doc_id: r.keep_id for r in exact_dedup(long).collect()} == {1: 3, 2: 2, 3: 3}
    assert {r.doc_id: r.size for r in mixing.mix(long).collect()} == {1: size, 2: 2, 3: size}
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(long).collect()} == {1: 1, 2: 2, 3: 1}
    left = {r.doc_id: (r.n_bytes, r.n_removed) for r in substring_dedup.substring_dedup(long).collect()}
    assert left[3] == (len(LONG), len(LONG)) and left[1][0] == len(LONG) and left[2] == (9, 0)
    scores = {r.doc_id: r for r in pitman_yor.pitman_yor(long).collect()}
    assert scores[1].n_tokens == size + 1 and math.isclose(scores[1].score, scores[3].score)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(long, labels).count() == 3


def test_long_texts_are_encoded(long):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})
    ids = own.encode_ordinary(LONG)
    got = {r.doc_id: r for r in bpe.round_trip(long, VOCABULARY, P.PATTERN).collect()}
    assert (got[1].n_tokens, got[1].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(long, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert counts[1] == counts[3] == len(ids)


def test_one_piece_of_a_megabyte():
    e = bpe.encoder(VOCABULARY, P.PATTERN)
    text = "ab" * 150_000
    [ids] = e.encode([text])
    assert e.decode(ids) == text.encode() and len(ids) < len(text)


def test_empty_tables(none, spark):
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0
    assert exact_dedup(none).count() == drop_copies(none).count() == 0
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert ngram_join.one_of_each(none).count() == 0
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(none, labels).count() == 0


def test_clashing_columns_are_replaced(docs):
    clash = docs.withColumn("ids", docs.lang).withColumn("bytes", docs.lang)
    out = bpe.decode(bpe.encode(clash, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN)
    assert sorted(out.columns) == sorted([*docs.columns, "ids", "bytes"])
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in out.collect())


def test_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, "en", "s", 0), (None, text + " more", "en", "s", 0), (7, text + " and", "en", "s", 0), (None, None, None, None, None), (9, "other", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect())
    assert got == Counter([(5, 57, 5), (None, 58, None), (7, 58, 5), (None, 0, None), (9, 1, 9)])
    assert ngram_join.one_of_each(docs).count() == 4
    assert exact_dedup(docs).where("kept").count() == 5
    assert pitman_yor.pitman_yor(docs).where("doc_id IS NULL AND NOT held_out").count() == 2
    assert mixing.mix(docs).count() == 5


def test_a_document_of_several_texts_links_by_any(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (2, b), (3, a + " x"), (3, b + " y"), (4, b), (5, "z"), (6, a), (6, "z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(docs).collect()} == {(k, 1) for k in range(1, 7)}


def test_toxicity(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(1200):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = k % 6 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["Nasty!", "vile", "rotten,"])
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(bad)))
    rows += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (5002, "vile " * 5000, "en", "s", 0), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("label", __import__("pyspark").sql.functions.lit("x"))
    labels = spark.createDataFrame([*labels, (5003, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    right = sum(r.predicted == int(r.doc_id % 6 == 0) for r in held)
    assert right > 0.95 * len(held)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.78 < kept.count() / len(rows) < 0.9
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_factors_learn_a_pair():
    """Two words that say nothing alone: the label says whether a text has both or neither. Linear weights can't tell."""
    rng = np.random.default_rng(9)
    each, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        each.append(np.unique(np.array([1] * int(a) + [2] * int(b) + rng.integers(10, 60, 4).tolist(), np.int64)))
        y.append(float(a == b))
    y = np.array(y)
    packed = lambda part: (np.concatenate([[0], np.cumsum([len(x) for x in part])]), np.concatenate(part))
    m = toxicity.FactorizationMachine.fit(*packed(each[:2400]), y[:2400])
    m = toxicity.FactorizationMachine.from_bytes(m.to_bytes())
    right = lambda machine: ((machine.logits(*packed(each[2400:])) >= 0) == (y[2400:] > 0)).mean()
    assert right(m) >= 0.95
    assert 0.4 < right(toxicity.FactorizationMachine(m.bias, m.w, np.zeros_like(m.v))) < 0.6


def test_scores_are_the_formula():
    """Scores against the machine's definition, summed over all pairs of terms."""
    rng = np.random.default_rng(2)
    size = 1 << toxicity.BITS
    m = toxicity.FactorizationMachine(0.3, rng.standard_normal(size).astype(np.float32), rng.standard_normal((size, toxicity.FACTORS)).astype(np.float32) * 0.3)
    each = [np.unique(rng.integers(0, size, n)) for n in (0, 1, 2, 7, 40)]
    got = m.logits(np.concatenate([[0], np.cumsum([len(x) for x in each])]), np.concatenate(each))
    for x, z in zip(each, got):
        scale = 1 / max(len(x), 1) ** toxicity.POWER
        pairs = sum(float(m.v[i] @ m.v[j]) for a, i in enumerate(x) for j in x[:a]) * scale**2
        assert math.isclose(z, 0.3 + float(m.w[x].sum()) * scale + pairs, rel_tol=1e-3, abs_tol=1e-3)


def test_decoded_base64_ranks():
    ranks = bpe.load_ranks(VOCABULARY)
    assert len(ranks) == 50_256 and all(bytes([k]) in ranks for k in range(256)) and base64.b64encode(b"a")
