import hashlib
import random
import re

from isobath.llm.pii import KINDS, base_spans, candidates, detect, learn, luhn, op1_pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]
TESTS = [
    lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s)), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15,
]


def plain(text):
    return [(k, *m.span()) for k, (p, ok) in enumerate(zip(PATTERNS, TESTS)) for m in re.finditer(p, text) if ok(m[0])]


def test_base_equals_plain_patterns():
    rng = random.Random(3)
    bits = ["a", "x.y", "@", ".", "com", "1", "25", "255", "300", "4111111111111111", "+1 (269) 555-3296", " ", "-", "+", "(", ")", "%", "é", "\n", "10.0.0.1", "378282246310005"]
    for _ in range(6000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))
        assert sorted(base_spans(t)[0]) == sorted(plain(t)), t


def test_long_runs_are_quick():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 200_000, "+1" + "(" * 300_000, "@a.b" * 50_000):
        base_spans(t)
        candidates(t)


def test_learning_prefers_agreeing_votes():
    # patterns of (pattern, checksum, gazetteer, context, boundary, variety), 2 for and 0 against
    def code(*v):
        n = 0
        for x in v:
            n = n * 3 + x
        return n

    counts = {(2, code(2, 2, 2, 1, 2, 1)): 900, (2, code(0, 0, 0, 1, 2, 1)): 700, (2, code(0, 2, 2, 2, 2, 1)): 30, (2, code(0, 0, 0, 0, 0, 0)): 400}
    p = learn(counts)
    assert p[(2, code(2, 2, 2, 1, 2, 1))] > 0.9 > 0.5 > p[(2, code(0, 0, 0, 1, 2, 1))]
    assert p[(2, code(0, 2, 2, 2, 2, 1))] > p[(2, code(0, 0, 0, 1, 2, 1))] > p[(2, code(0, 0, 0, 0, 0, 0))] - 1e-9
    assert learn({}) == {}


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = sorted(plain(texts[r.doc_id] or ""))
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_edge_cases(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "mail a@b.co", None), (3, "mail a@b.co", None), (None, "é +49 30 1234567", 1)]
    got = detect(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    mail = [("email", 5, 11, True)]
    want = [(1, []), (2, []), (3, mail), (3, mail), (None, [("phone", 2, 16, True)])]
    assert sorted(((r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in got), key=str) == want
    assert detect(spark.createDataFrame(rows, "doc_id long, text string, spans int").limit(0)).count() == 0
    clash = detect(spark.createDataFrame([(1, "a@b.co", 3, 4)], "doc_id long, text string, Spans int, `a.b` int"))
    assert clash.columns == ["doc_id", "a.b", "spans"] and clash.first()["a.b"] == 4


def test_classifier_adds_planted_spans_and_leaves_decoys(spark):
    rng = random.Random(6)
    first, last = ["maria", "peter", "laura", "hans", "emma", "carlos"], ["lopez", "meyer", "dubois", "smith", "rossi"]
    rows, planted, decoys = [], set(), set()
    for i in range(900):
        a, b = rng.choice(first), rng.choice(last)
        head, tail = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(rng.randrange(1, 9))), " and so on"
        part = rng.choice(["mail", "at", "at", "ssn", "name", "card", "badcard", "order"])
        text = {
            "mail": f"{head} contact {a}.{b}@example.org{tail}", "at": f"{head} contact {a}.{b} [at] example [dot] org{tail}", "ssn": f"{head} national id 523-45-{rng.randrange(1000, 9999)}{tail}",
            "name": f"{head} signed Dr. {a.title()} {b.title()}{tail}", "card": f"{head} card 4111111111111111{tail}", "badcard": f"{head} order 4111111111111112{tail}", "order": f"{head} order model 000-00-{rng.randrange(1000, 9999)}{tail}",
        }[part]
        rows.append((i, text))
        planted |= {i} if part in ("at", "name") else set()
        decoys |= {i} if part in ("badcard", "order") else set()
    got = {r.doc_id: [s for s in r.spans if not s.base] for r in detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {i for i, own in got.items() if own}
    assert len(added & planted) >= 0.9 * len(planted)
    assert not added & decoys
    assert {s.kind for i in added & planted for s in got[i]} == {"email", "person"}


def test_failed_matches_are_not_reported(spark):
    rows = [(1, "ip 300.1.1.1 card 4111111111111112 call +12 34"), (2, "card 4111111111111111")]
    got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in detect(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.0).collect()}
    assert got == {1: [], 2: [("card", True)]}


def test_every_key_of_the_gazetteer_counts(spark, monkeypatch):
    """Also beyond any number of keys, and joined without a broadcast."""
    from isobath.llm import common, pii

    name = lambda i: "".join(chr(97 + int(d)) for d in str(1000 + i))
    rows = [(i, f"mail {name(i // 3)}@host.{name(i // 3)} now") for i in range(600)] + [(1000 + i, f"write to {name(i)} [at] host.{name(i)} today") for i in range(250)] + [(None, None), (7, ""), (7, "Dr Ada Byron")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def voted():
        return sorted((str(r.doc_id), [(s.kind, s.start, s.end, s.base, round(s.score, 9)) for s in r.spans]) for r in detect(df, threshold=0.0).collect())

    want = voted()
    # addresses of hosts 0 to 199 are known, whatever their number; those of the others are not
    known, unknown = ({s[4] for i, own in want if i.isdigit() and int(i) in ids for s in own if s[0] == "email"} for ids in (range(1000, 1200), range(1200, 1250)))
    assert len(known) == len(unknown) == 1 and min(known) > max(unknown)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(pii, "join_checked", lambda a, b, on, how="inner": common.join_checked(a, b, on, how, 3))
    assert voted() == want
