import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


CASES = [
    None, "", "a@b.c", "é😀 x@y.z_q@r.s 1.2.3.4.5.6.7.8", "mail a.b%c+d@ex-am.ple.org.", "256.1.1.1 001.002.003.255 1.1.1 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "x4111 1111 1111 1111 2",
    "+1 (743) 555-3824 and +12 +1-2-3-4-5-6-7-8-9 +", "+1..9 +49 170 1234567)", "@a.b c@d e@f.", "a@@b.c a@b.c@d.e", "1" * 40, "1-" * 30 + "1", "5 " * 4000, "a.b." * 20_000 + "@x.y", "w" * 100_000, "1.2.3.4" * 3000, "99999999999999999999.1.1.1", "a@b.c," * 500, "4-111-1111 11111-1-1111 4111 1111 1111 1111",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return CASES + ["".join(rng.choice(["1", "23", ".", " ", "-", "@", "a", "b.c", "+", "(", "4111111111111111", "é", "%"]) for _ in range(60)) for _ in range(400)]


def test_base_equals_plain_patterns(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string").repartition(4)
    got = {r.doc_id: r for r in pii.find_pii(df).withColumn("listed", pii.span_list(F.col("base"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].listed == plain(t), t[:80]
        assert set(got[i].base) <= set(got[i].spans)


def story(n=40):
    rng = random.Random(1)
    docs = []
    for i in range(n):
        w = [rng.choice(["oak", "elm", "ash", "fir"]) for _ in range(20)]
        docs.append(" ".join(w) + f" please write to user{i}@mail{i}.org today, reach us on Tel: +1 (555) 200-{1000 + i} now, order 77{i} is late")
    docs += ["oak elm please write to someone-at-host77 today", "ash Tel: 555-0199-77x fir", "order 7712345 is late", "fir oak ash nr77 and someone-at-host77 again"]
    return docs


def test_contexts_discover_unseen_identifiers(spark):
    docs = story()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    found = {(i, s.kind, docs[i][s.start : s.stop]) for i, r in rows.items() for s in set(r.spans) - set(r.base)}
    assert (40, "email", "someone-at-host77") in found and (41, "phone", "555-0199-77x") in found
    assert not [f for f in found if f[0] in (42, *range(40))]
    red = {r.doc_id: r.text for r in pii.redact(pii.find_pii(df)).collect()}
    assert "<EMAIL> today" in red[0] and "<PHONE> now, order 770 is late" in red[0] and "@" not in red[0]
    assert red[42] == docs[42]


def test_groups_of_digits_and_long_words(spark):
    """Numbers written in groups are found whole, brackets before them don't hide the cue, and three long words count."""
    long = [f"{c * 90}{i}" for i, c in enumerate("xyz")]
    docs = [f"oak Tel: +1 (555) 200-{1000 + i} and " + " ".join(long) + f" a{i}@mail{i}.org end" for i in range(20)]
    docs += ["ash Tel: 555 200 1000 elm", "ash Tel: (555) 200-1000, elm", "fir " + " ".join(long) + " who-at-host9 end", "no cue 555 200 1001 here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    found = [{docs[i][s.start : s.stop] for s in set(rows[i].spans) - set(rows[i].base)} for i in range(20, 24)]
    assert found == [{"555 200 1000"}, {"(555) 200-1000"}, {"who-at-host9"}, set()]


def test_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a@b.c x", "keep", 3), (1, "a@b.c x", "keep", 3), (None, None, None, None)], "doc_id long, text string, ip string, base int")
    out = pii.find_pii(df).collect()
    assert len(out) == 3 and sorted(str(r.ip) for r in out) == ["None", "keep", "keep"] and sorted(len(r.base) for r in out) == [0, 1, 1]
    assert pii.find_pii(df.limit(0)).collect() == []
    digest = hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(df.where("doc_id IS NULL")).select(F.sha2(pii.span_list(F.col("base")), 256)).collect()[0][0] == digest


def test_rounds_go_on_until_nothing_is_new(spark):
    """Values of one context lead to the next context, three times; then one stands under no context of its own."""
    docs = [f"Tel: +1 (555) 200-{1000 + i}" for i in range(200)]
    for w, after, k, n in [("Tel:", "Fon:", 0, 40), ("Fon:", "Mob:", 1, 10), ("Mob:", "Dial:", 2, 2)]:
        docs += [f"{c} {k}55-{i}a" for i in range(n) for c in (w, after)]
    docs += ["155-1a alone"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    found = {docs[i][s.start : s.stop] for i, r in rows.items() for s in set(r.spans) - set(r.base)}
    assert found == {f"{k}55-{i}a" for k, n in ((0, 40), (1, 10), (2, 2)) for i in range(n)}
    last = rows[len(docs) - 1].spans
    assert [(s.kind, s.start, s.stop) for s in last] == [("phone", 0, 6)]
