"""The pipeline's stages against plain versions, each on what the one before it kept; and the SQL of queries that have it."""
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from emberlake.llm import bpe, mixing, queries, toxicity

from tests.conftest import DATA
from tests.test_entry import TABLES, frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    got = frame(queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas())
    pd.testing.assert_frame_equal(got, frame(c.execute(queries.ORACLE_SQL[name]).df()), check_dtype=False)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """sf0.001 with some rows that are hard: nulls, empty texts, rows that repeat, near copies."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    extra = [(9000, None, "en", "web", None), (9001, "", None, None, 0), (9002, rows[3][1], "en", rows[3][3], 1), (9003, rows[3][1].upper(), "en", None, 1), rows[5], (9004, " ".join(rows[7][1].split()[:-1]), "en", rows[7][3], 5), (None, "a text without a number", "en", "web", 23)]
    spark.createDataFrame(rows + extra, docs.schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def near_groups(docs, n=5, percent=80):
    """For each row the least doc_id that links lead to; None without an id."""
    sets = []
    for r in docs:
        w = WORD.findall((r.text or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w and r.doc_id is not None else set())
    up = {r.doc_id: r.doc_id for r in docs if r.doc_id is not None}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(docs[i].doc_id), find(docs[j].doc_id)
                up[max(a, b)] = min(a, b)
    return [None if r.doc_id is None else find(r.doc_id) for r in docs]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        done = spark.read.parquet(str(tmp_path / str(k)))
        after, count = done.collect(), lambda rows: Counter(map(tuple, rows))
        if name != "byte_bpe":
            assert done.columns == columns
        if name == "toxicity":
            machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            good = [r for r, x in zip(before, scores(machine, before)) if x <= 0.0]
            assert count(after) == count(good) and len(good) < len(before)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                t = (r.text or "").translate(LOW)
                best[t] = max((best.get(t, (-(2**63),))), (-(2**63) if r.doc_id is None else r.doc_id,))
            assert len(after) == len(best) == len({(r.text or "").translate(LOW) for r in after})
            assert all((r.doc_id,) == best[(r.text or "").translate(LOW)] or r.doc_id is None for r in after)
        elif name == "near_dedup":
            least = near_groups(before)
            assert count(after) == count(r for r, m in zip(before, least) if r.doc_id is None or m == r.doc_id) and len(after) < len(before)
        elif name == "mixing":
            taken, got = Counter(), Counter()
            for r in mixing.mix(docs).collect():
                taken[r.doc_id] += r.taken
            whole = defaultdict(str)
            for r in before:
                whole[r.doc_id] += r.text or ""
            for r in after:
                got[r.doc_id] += len(WORD.findall(r.text))
                assert r.text in whole[r.doc_id] and r.n_chars in (len(r.text), next(x.n_chars for x in before if x.doc_id == r.doc_id))
            assert got == +taken and max(got.values()) > 0
        else:
            own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.RANKS), special_tokens={})
            want = Counter((r.doc_id, tuple(own.encode_ordinary(r.text or ""))) for r in before)
            assert Counter((r.doc_id, tuple(r.ids)) for r in after) == want
            assert all(r.decodes and r.n_tokens == len(r.ids) for r in after)
        docs = done
    assert Counter(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(str, docs.collect()))


def scores(machine, rows):
    """Logits by the machine's definition, from each text by itself."""
    import numpy as np

    out = []
    for r in rows:
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        _, term, _ = toxicity.terms(raw, np.array([0, len(raw)]))
        scale = 1 / max(len(term), 1) ** toxicity.POWER
        v = machine.v[term].astype(float) * scale
        out.append(machine.bias + machine.w[term].astype(float).sum() * scale + ((v.sum(0) ** 2).sum() - (v**2).sum()) / 2)
    return out


def test_byte_bpe_takes_one_worker_a_task(spark):
    """Encoded and decoded in one pass, as two workers a task took an executor's memory; nulls, empty texts and repeated rows stay."""
    rows = [(1, "Ein Wort, zwei \u00df\u4e16\u754c", "de", "web"), (1, "Ein Wort, zwei \u00df\u4e16\u754c", "de", "web"), (2, None, None, None), (3, "", "en", "web"), (None, "a  b\n" * 50, "en", None)]
    done = corpus_pipeline.byte_bpe(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1), "")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.RANKS), special_tokens={})
    ids = [plain.encode_ordinary(r[1] or "") for r in rows]
    assert [tuple(r) for r in done.collect()] == [(r[0], r[2], r[3], x, len(x), True) for r, x in zip(rows, ids, strict=True)]
