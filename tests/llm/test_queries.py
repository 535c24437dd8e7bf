"""The registered queries over whole small tables, against plain computations of what they must return."""

import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from spindrift.llm import toxicity
from spindrift.llm.queries import BYTE_BPE, ORACLE_SQL, QUERIES, WORD_BPE
from tests.llm.test_lm_score import PlainPpm, tokens
from tests.llm.test_pii import plain
from tests.llm.test_simhash import plain_fingerprint, smallest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.execute("select doc_id, text from documents").fetchall()}


def got(spark, name, key="doc_id"):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    return {r[key]: r for r in rows}, rows, dict(df.dtypes)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    _, rows, kinds = got(spark, "op1_best_fit_packing")
    assert {k: kinds[k] for k in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")} == {"piece": "int"} | dict.fromkeys(("start", "length", "ids_crc32", "sequence_id", "offset"), "bigint")
    library = Tokenizer.from_file(WORD_BPE)
    want = {}
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            want[i, p] = (at, len(ids[at : at + 4096]), crc(ids[at : at + 4096]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
    assert len(bins) <= -(-sum(n for _, n, _ in want.values()) // 4096) + 1


def test_op2(spark, texts):
    by, rows, _ = got(spark, "op2_bpe_round_trip")
    library = Tokenizer.from_file(BYTE_BPE)
    assert len(rows) == len(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (by[i].n_tokens, by[i].ids_sha256, by[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    q = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(q.fetchall(), key=str)


def test_op4(spark, texts):
    by, rows, _ = got(spark, "op4_lm_score")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    train = [tokens(t) for i, t in texts.items() if not held[i]]
    counts, model = Counter(w for t in train for w in t), PlainPpm([t[:-1] for t in train])
    n, v = sum(counts.values()), len(counts)
    assert {r.train_tokens for r in rows} == {n} and len(rows) == len(texts)
    for i, t in texts.items():
        own = tokens(t)
        assert (by[i].held_out, by[i].n_tokens, by[i].n_known) == (held[i], len(own), sum(counts[w] > 0 for w in own))
        assert by[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert by[i].score == pytest.approx(model.log10(own[:-1]), rel=1e-9)


def test_op5(spark, texts):
    by, _, _ = got(spark, "op5_simhash_dedup")
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    near = smallest([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3], list(fp))
    assert {i: (r.fingerprint, r.component_id) for i, r in by.items()} == {i: (f"{fp[i]:016x}", near[i]) for i in fp}


def test_op7(spark, duck):
    _, rows, kinds = got(spark, "op7_nearest_neighbours", "query_id")
    assert kinds == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    x = {i: np.array(v, dtype=float) for i, v in duck.execute("select vec_id, embedding from embeddings").fetchall()}
    hits = 0
    queries = [i for i in x if i % 100 == 0]
    for q in queries:
        best = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
        mine = [(r.score, r.vec_id) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == 10 and mine == sorted(mine)
        hits += len({v for _, v in mine} & {v for _, v in best})
    assert hits / (10 * len(queries)) >= 0.9


def test_op8(spark, texts):
    by, rows, _ = got(spark, "op8_contextual_pii")
    assert len(rows) == len(texts)
    for i, t in texts.items():
        base = plain(t)
        listed = [s for s in base.split(",") if s]
        assert by[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(listed) <= set(by[i].spans.split(","))
        assert [by[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in listed) for k in ("email", "ip", "card", "phone")]


def test_op9(spark, duck, texts):
    by, rows, kinds = got(spark, "op9_toxicity")
    assert len(rows) == len(texts) and kinds["predicted"] == "int"
    for i, r in by.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    # The voters, counted plainly; then the two fits on what they vote.
    label = {}
    for i, toxic in duck.execute("select doc_id, toxic from labels where toxic is not null").fetchall():
        if zlib.crc32(str(i).encode()) % 4 != 2 and i in texts:
            label[texts[i]] = max(label.get(texts[i], 0), toxic)
    n = Counter(label.values())
    seen = {1: Counter(), 0: Counter()}
    for t, y in label.items():
        seen[y].update(toxicity.units(t))
    rate_t = {u: c / max(n[1], 1) for u, c in seen[1].items()}
    rate_o = {u: (seen[0][u] + 0.5) / (n[0] + 1) for u in rate_t}
    surprise = {u: 2 * c * math.log(rate_t[u] / rate_o[u]) for u, c in seen[1].items() if c >= 5}
    good = sorted((-x, u) for u, x in surprise.items() if rate_t[u] > 8 * rate_o[u] and rate_t[u] >= 0.02 and x > 36)
    names = tuple(toxicity.apart([(u, seen[1][u]) for _, u in good[: 40 * toxicity.VOTERS]], toxicity.VOTERS))
    voted = sorted((sorted(names.index(u) for u in toxicity.units(t) & set(names)), toxicity.style(t)) for t in label)
    votes = np.zeros((len(voted), len(names)))
    for k, (fired, _) in enumerate(voted):
        votes[k, fired] = 1
    prior = float(np.clip((n[1] + 0.5) / (sum(n.values()) + 1), 0.001, 0.5))
    if names:
        model = toxicity.fitted(names, votes, np.array([s for _, s in voted]), prior, toxicity.mined_rates([(seen[0][u], seen[1][u]) for u in names], n[0], n[1]))
        assert np.allclose([by[i].score for i in texts], model.score(list(texts.values())), rtol=1e-6, atol=1e-9)
    else:
        assert np.allclose([r.score for r in rows], prior)


def test_op10(spark, texts):
    by, rows, _ = got(spark, "op10_token_files")
    library, at = Tokenizer.from_file(WORD_BPE), 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (by[i].start, by[i].n_tokens, by[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(rows) == len(texts)
