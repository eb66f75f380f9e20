"""Personal data by weak supervision.

Candidates come from strict patterns (the base, always kept), from strict matches
that fail their test (never reported, but they show how labelers err) and from
looser patterns.  Six labelers vote on each candidate: pattern, checksum,
gazetteer, context, boundary and variety.  The gazetteer is counted over the
corpus: names, top-level domains, calling codes and the like that stand in the
base or in titled names of several documents.  Votes are counted over the whole
corpus by kind and vote pattern, a table of bounded size, on which
expectation-maximisation estimates every labeler's reliability.  Its posteriors
are the soft labels that train the final classifier of spans, a logistic model
over votes and kinds, which scores base spans as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from isobath.llm.common import join_checked, map_arrow, materialise, quoted, with_fields

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "person"]
LABELERS = ["pattern", "checksum", "gazetteer", "context", "boundary", "variety"]
#: Probability from which a candidate outside the base is reported.
THRESHOLD = 0.8
#: Characters before a candidate that the context labeler reads.
CONTEXT = 48
#: Rows that must hold a key of the gazetteer.
GAZETTEER_DOCS = 3
#: The place of the gazetteer's vote in the vote code.
GAZETTEER_DIGIT = 3**3

CUES = {
    "email": r"e-?mail|mail|contact|correo|courriel", "ip": r"\bip\b|host|server|addr", "card": r"card|visa|master|amex|karte|carte|tarjeta|credit",
    "phone": r"phone|tel\b|tel[.:]|call|mobile|cell|fax|fon\b", "ssn": r"ssn|social security|national id", "iban": r"iban|account|konto|compte|cuenta", "person": r"name|contact|author|patient|customer|signed",
}
AGAINST = r"version|isbn|issn|order|invoice|serial|model|build|sku|port|article|page|chapter"

_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z]{2,}+"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "person": re.compile(r"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?|[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo) (\p)(?: (\p))?".replace(r"\p", "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++")),
}
_WORD = re.compile(r"[A-Za-zß-öø-ÿÀ-ÖØ-Þ]{3,}+")
_CUES = {k: re.compile(v, re.I) for k, v in CUES.items()}
_AGAINST = re.compile(AGAINST, re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in s.split("."))


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """((kind, start, end) of the base, those of matches that fail its tests), leftmost and non-overlapping in each kind."""
    good, failed = [], []
    end = 0
    if "@" in text:
        for m in _TAIL.finditer(text):
            s = m.start()
            while s > end and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                end = m.end()
                good.append((0, s, end))
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                (good if _octets(m[0]) else failed).append((1, *m.span()))
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() >= 9 else ""
            if 13 <= len(d) <= 19:
                (good if luhn(d) else failed).append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 9 <= len(_digits(m[0])) <= 15 else failed).append((3, *m.span()))
    return good, failed


def _keys(kind: str, own: str, digits: str) -> list[str]:
    """What the gazetteer may know of a candidate."""
    if kind == "email":
        local, _, host = _parted(own)
        return ["top:" + re.split(r"[^A-Za-z]+", host)[-1].lower()] + ["name:" + w.lower() for w in _WORD.findall(local)]
    if kind == "person":
        m = _LOOSE["person"].fullmatch(own)
        return ["name:" + w.lower() for w in (m.groups() if m else ()) if w]
    if kind == "phone":
        return ["call:" + digits[:2]] if own[0] == "+" else ["area:" + digits[:3]]
    return [{"ip": "net:", "card": "bin:", "iban": "land:", "ssn": "area:"}[kind] + (own[:2] if kind == "iban" else digits[:1] if kind == "card" else own.split(".")[0] if kind == "ip" else digits[:3])]


def _parted(own: str) -> tuple[str, str, str]:
    m = re.search(r"@| ?[\[(](?:at|AT)[\])] ?", own)
    return own[: m.start()], m[0], own[m.end() :]


def _votes(text: str, kind: str, s: int, e: int, strict: bool) -> int:
    """The labelers' votes (0 against, 1 none, 2 for) as digits to base 3; the gazetteer's digit is left 0."""
    own = text[s:e]
    digits = _digits(own)
    before = text[max(0, s - CONTEXT) : s]
    checksum = 1
    if kind == "ip":
        checksum = 2 if _octets(own) else 0
    elif kind == "card":
        checksum = 2 if luhn(digits) else 0
    elif kind == "phone":
        checksum = 2 if 9 <= len(digits) <= 15 else 0
    elif kind == "ssn":
        checksum = 0 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "iban":
        checksum = 2 if _iban(own) else 0
    context = 2 if _CUES[kind].search(before) else 0 if _AGAINST.search(before) else 1
    free = (s == 0 or not (text[s - 1].isalnum() or text[s - 1] in "._-")) and (e == len(text) or not (text[e].isalnum() or text[e] in "_-"))
    variety = 0 if digits and len(set(digits)) <= 2 and len(digits) > 6 else 1
    out = 0
    for v in (2 if strict else 0, checksum, 0, context, 2 if free else 0, variety):
        out = out * 3 + v
    return out


BASE, FAILED, LOOSE = 0, 1, 2


def candidates(text: str) -> list[tuple[int, int, int, int, int, list[str]]]:
    """(kind, start, end, sort, votes, keys) of every candidate; sort is BASE, FAILED or LOOSE, and loose ones overlap no base span."""
    base, failed = base_spans(text)
    loose = []
    digit = bool(base) or bool(_DIGIT.search(text))
    for kind, pattern in _LOOSE.items():
        needed = digit if kind in ("phone", "ssn", "iban") else ("at" in text or "AT" in text) and ("[" in text or "(" in text) if kind == "email" else True
        if needed:
            loose += [(KINDS.index(kind), *m.span()) for m in pattern.finditer(text)]

    def judged(k: int, s: int, e: int, sort: int) -> tuple[int, int, int, int, int, list[str]]:
        return k, s, e, sort, _votes(text, KINDS[k], s, e, sort != LOOSE), _keys(KINDS[k], text[s:e], _digits(text[s:e]))

    out = [judged(k, s, e, BASE) for k, s, e in base] + [judged(k, s, e, FAILED) for k, s, e in failed]
    if loose:
        # one sweep over spans sorted by their start: base spans first win, then earlier ones
        taken = sorted((s, e) for _, s, e in base)
        starts, reach, high = [s for s, _ in taken], [], 0
        for _, e in taken:
            high = max(high, e)
            reach.append(high)
        last = 0
        for k, s, e in sorted(set(loose), key=lambda x: (x[1], -x[2], x[0])):
            i = int(np.searchsorted(starts, e)) - 1
            if s >= last and not (i >= 0 and reach[i] > s):
                out.append(judged(k, s, e, LOOSE))
                last = e
    return out


def learn(counts: dict[tuple[int, int], int], rounds: int = 60) -> dict[tuple[int, int], float]:
    """The probability that a candidate of each (kind, votes) is personal data, from the counts of such patterns.

    Expectation-maximisation over labelers that err independently, then a
    logistic model trained on its posteriors.
    """
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([k for k, _ in keys])
    votes = np.array([[v // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))] for _, v in keys])
    # start from the majority, labelers above chance
    post = 1 / (1 + np.exp(-2.0 * (votes - 1).sum(1) + 1.0))
    for _ in range(rounds):
        prior = np.array([((post * n)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) if (kind == k).any() else 0.5 for k in range(len(KINDS))])
        odds = np.log(prior / (1 - prior))[kind]
        for j in range(len(LABELERS)):
            yes = np.array([(post * n)[votes[:, j] == v].sum() for v in range(3)]) + [1.0, 2.0, 4.0]
            no = np.array([((1 - post) * n)[votes[:, j] == v].sum() for v in range(3)]) + [4.0, 2.0, 1.0]
            yes, no = yes / yes.sum(), no / no.sum()
            odds = odds + np.log(yes / no)[votes[:, j]]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    x = np.concatenate([np.eye(3)[votes].reshape(len(keys), -1), np.eye(len(KINDS))[kind]], 1)
    w = np.zeros(x.shape[1])
    weight = np.sqrt(n) / np.sqrt(n).sum()  # frequent patterns count more, without drowning the others
    for _ in range(25):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - post)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


_CANDIDATE = StructType(
    [StructField(n, IntegerType()) for n in ("kind", "start", "end", "sort", "votes")] + [StructField("keys", ArrayType(StringType()))]
)


def _held_keys(rows: DataFrame, found: Column) -> DataFrame:
    """(__row, key): the different keys of some candidates of each row."""
    return rows.select("__row", F.explode(F.array_distinct(F.flatten(F.transform(found, lambda c: c["keys"])))).alias("key"))


def gazetteer(rows: DataFrame, docs: int = GAZETTEER_DOCS) -> DataFrame:
    """(key): every key of base spans and titled names that at least docs rows hold."""
    sure = F.filter("__found", lambda c: (c["sort"] == BASE) | (c["kind"] == KINDS.index("person")))
    return _held_keys(rows, sure).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= docs).select("key")


def detect(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the text, with ``spans``: array of (kind, start, end, base, score), by kind as in KINDS, then start.

    Offsets are code points, ends exclusive.  Base spans are all there; the others
    have a probability of at least threshold and overlap no base span.  Strict
    matches that fail their test are never reported.  A null or empty text has none;
    very long texts are taken whole.  Rows are judged one by one by the votes of the
    whole table, repeated rows alike; other columns stay, a column named spans is
    replaced, an empty table gives an empty one.
    """
    added = StructType([StructField("__found", ArrayType(_CANDIDATE))])
    source = docs.withColumn("__text", quoted(text))
    source = source.select(*[quoted(c) for c in source.columns if c != text and c.lower() != "spans"])
    kept, schema = with_fields(source, added)
    schema = StructType([f for f in schema if f.name != "__text"])
    names = [f.name for f in _CANDIDATE]
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in names[:-1]] + [("keys", pa.list_(pa.string()))]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            found = [[dict(zip(names, c)) for c in candidates(t.as_py() or "")] for t in batch.column(at)]
            arrays = [batch.column(i) for i in range(batch.num_columns) if i != at] + [pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(arrays, [n for n in batch.schema.names if n != "__text"] + ["__found"])

    rows = materialise(map_arrow(kept, find, schema).withColumn("__row", F.monotonically_increasing_id()), "candidates")
    # a row's known keys, which are some of its own; keys that are not in the gazetteer say no
    known = materialise(join_checked(_held_keys(rows, F.col("__found")), gazetteer(rows), ["key"]).groupBy("__row").agg(F.collect_set("key").alias("__known")), "known")
    rows = join_checked(rows, known, ["__row"], "left").drop("__row")

    def voted(c: Column) -> Column:
        vote = F.when(F.size(c["keys"]) == 0, 1).when(F.coalesce(F.arrays_overlap(c["keys"], F.col("__known")), F.lit(False)), 2).otherwise(0)
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["sort"].alias("sort"), (c["votes"] + vote * GAZETTEER_DIGIT).alias("votes"))

    rows = rows.withColumn("__found", F.transform("__found", voted)).drop("__known")
    table = rows.select(F.explode("__found").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    # at most len(KINDS) * 3 ** len(LABELERS) rows
    score = learn({(r.kind, r.votes): r.n for r in table.collect()})
    scores = F.create_map(*[x for (k, v), p in score.items() for x in (F.lit(k * 1000 + v), F.lit(p))]) if score else F.create_map(F.lit(-1), F.lit(0.0))
    kinds = F.array(*map(F.lit, KINDS))

    def scored(c: Column) -> Column:
        return F.struct(F.get(kinds, c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (c["sort"] == BASE).alias("base"), scores[c["kind"] * 1000 + c["votes"]].alias("score"))

    every = F.transform(F.sort_array(F.filter("__found", lambda c: c["sort"] != FAILED)), scored)
    return rows.withColumn("spans", F.filter(every, lambda s: s["base"] | (s["score"] >= threshold))).drop("__found")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = detect(docs).withColumn("base", F.filter("spans", lambda s: s["base"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
