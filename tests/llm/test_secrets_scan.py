import hashlib
import random
import re
import string

from isobath.llm.secrets_scan import KINDS, op3_secrets, scan

PATTERNS = [
    (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 12),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in p.finditer(text) if ok(m))


def base_of(row):
    return [(s.start, KINDS.index(s.kind), s.end) for s in row.spans if s.kind != "random"]


def test_base_equals_plain_patterns(spark):
    rng = random.Random(4)
    bits = ["token", "TOKEN=", "secret: ", "api_key", "password", '"', "'", " ", "=", ":", "abcdef0123456789", "AKIA", "ABCDEFGH01234567", "xyz", "🙂", "é", "\n", "-", "key_", "0f" * 9, "AKIAZ"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 16)))) for i in range(1500)]
    rows += [(2000, "token=abcdefghijkl " * 900), (2001, "f" * 100_000), (2002, "AKIA" + "B" * 100_000), (2003, "a1" * 60_000 + " 🙂 secret='aaaaaaaaaaaa'")]
    texts = dict(rows)
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert base_of(r) == plain(texts[r.doc_id]), texts[r.doc_id][:200]


def test_battery_tells_random_from_text(spark):
    rng = random.Random(7)
    alphabet = string.ascii_letters + string.digits
    rows, secret = [], set()
    for i in range(400):
        word = "".join(rng.choice(["the", "ing", "tion", "er", "an", "re", "on", "st", "en"]) for _ in range(rng.randrange(6, 14)))
        name = "_".join(rng.choice(["user", "value", "index", "count", "total", "page"]) for _ in range(4)) + str(rng.randrange(100))
        rows.append((i, f"some {word} and {name} end"))
        if i % 4 == 0:
            own = "".join(rng.choice(alphabet) for _ in range(32))
            rows[-1] = (i, rows[-1][1] + " " + own)
            secret.add(i)
    texts = dict(rows)
    hits, false = 0, 0
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for s in r.spans:
            if s.kind == "random":
                own = texts[r.doc_id][s.start : s.end]
                ok = r.doc_id in secret and own == texts[r.doc_id].split()[-1]
                hits, false = hits + ok, false + (not ok)
    assert hits > 0.9 * len(secret) and false <= 0.03 * len(secret)


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_secrets(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_edge_cases(spark):
    rows = [(1, None, 3), (2, "", 3), (None, "token=abcdefghijkl", None), (3, "x", 1), (3, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r.doc_id, base_of(r)) for r in scan(df).collect()), key=str)
    assert got == [(1, []), (2, []), (3, []), (3, []), (None, [(0, 0, 18)])]
    assert scan(df.limit(0)).count() == 0
    clash = scan(spark.createDataFrame([("token=abcdefghijkl", 3, 4)], "text string, Spans int, `a.b` int"))
    assert clash.columns == ["a.b", "spans"] and (clash.first()["a.b"], len(clash.first().spans)) == (4, 1)
