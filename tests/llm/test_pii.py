import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def good(kind, hit):
    n = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")), "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


HARD = [
    None, "", "a@b.c_d@e.f", "x@y", "a@b.c@d.e", "1.2.3.4.5.6.7.8 and 0255.01.1.1 256.1.1.1 1.2.3", "4111 1111-1111 1111 4111111111111112", "+1 (988) 555-2485x+49 30 1234567+1((((", "é+1 234 567 890 ü me@é.com me@x.é.com z@q-r.st.",
    "9" * 20000, "a" * 20000 + "@x.y", "1 " * 8000, "4012888888881881 4012 8888 8888 1881 00", "+12345678+1", "..@a.b %+-@a.b-",
]


def listed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.detect(docs).select("doc_id", pii.listed(*pii.KINDS).alias("s")).collect()
    return {r["doc_id"]: r["s"] for r in rows}


def test_base_spans_of_hard_texts(spark):
    got = listed(spark, HARD)
    for i, t in enumerate(HARD):
        assert got[i] == ",".join(brute(t)), t[:60]


def test_base_spans_of_random_texts(spark):
    found = []

    @given(st.lists(st.text(alphabet="0123456789.@+- ()aB_%é\n", max_size=60), max_size=20))
    @settings(max_examples=60, deadline=None)
    def gather(texts):
        found.extend(texts)

    gather()
    got = listed(spark, found)
    for i, t in enumerate(found):
        assert got[i] == ",".join(brute(t)), t


def corpus():
    rows = [(i, f"Call Zimbelmann at +1 202 555 01{i:02d} today please, the house is red.") for i in range(4)]
    rows += [(10 + i, f"Doctor Quarrelsome uses quarrel@mail{0}.example.com for the ward, note {i}.") for i in range(3)]
    rows += [(100 + i, "the house is red and the ward is for please today note doctor uses call") for i in range(40)]
    return rows


def test_disclosing_terms_by_hand(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = pii.detect(docs)
    near = pii.contexts(found)
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosures(docs, found, near).collect()}
    # quarrelsome stands in the three documents of its address and nowhere else; house stands everywhere
    assert abs(got[("email:quarrel@mail0.example.com", "quarrelsome")] - 1) < 1e-9
    assert all(term not in ("house", "the", "doctor") for _, term in got)
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert [corpus()[4][1][t["start"] : t["end"]] for t in rows[10]["terms"]] == ["Quarrelsome"]
    assert all(not r["terms"] for i, r in rows.items() if i >= 100)


def test_sanitised_texts(spark):
    docs = spark.createDataFrame([(i, t, len(t), "x") for i, t in corpus()] + [(None, None, 0, "x"), (500, "é mail a@b.c, 1.2.3.4", 21, "x")], "doc_id long, text string, n_chars long, terms string")
    got = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert got[10]["text"] == "Doctor  uses [EMAIL] for the ward, note 0."
    assert got[500]["text"] == "é mail [EMAIL], [IP]" and got[500]["n_chars"] == 20
    assert got[100]["text"] == corpus()[7][1] and got[None]["text"] is None and got[100]["terms"] == "x"
    assert got[0]["text"].startswith("Call Zimbelmann at [PHONE] today")


def test_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "m a@b.c"), (1, "m a@b.c"), (None, "m a@b.c")], "doc_id long, text string")
    assert [len(r["email"]) for r in pii.find(docs).collect()] == [1, 1, 1]
    assert [r["text"] for r in pii.sanitise(docs).collect()] == ["m [EMAIL]"] * 3
    assert pii.find(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_query_digests(spark):
    from tidewatch.llm.queries import op7_disclosure

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op7_disclosure(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and r["spans"].startswith(",".join(spans))
        assert r["n_email"] == sum(s.startswith("email") for s in spans)
    assert "Python" not in op7_disclosure(spark, d)._jdf.queryExecution().executedPlan().toString()


def test_terms_far_from_their_entity_and_behind_other_numbers(spark):
    far = " the house is red and the ward is for please" * 4
    rows = [(i, f"Dear Quarrelsome,{far} born 1984, card 4111111111111111,{far} yours Quarrelsome") for i in range(3)]
    rows += [(10 + i, "Maria Zimbelmann, born 1984, at 10.0.0.7 then, 1999, with Oddfellow.") for i in range(3)]
    rows += [(20 + i, "dear maria born with card yours at then the house is red and the ward is for please") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Quarrelsome" not in got[0] and got[0].startswith("Dear ,") and "[CARD]" in got[0]
    assert got[10] == "Maria , born 1984, at [IP] then, 1999, with ."
    assert got[20] == rows[6][1]


def by_hand(rows):
    """Disclosures and broader terms of all pairs, by sets of documents."""
    term = re.compile(r"(?:(?<=[\s(\['\"])|^)([^\W\d_]{3,})(?=[.,;:!?)\]'\"]*(?:\s|$))")
    words, entities = {}, {}
    for i, t in rows:
        clean = t
        for k, p in PATTERNS.items():
            for m in re.finditer(p, t):
                if good(k, m[0]):
                    value = m[0].lower() if k == "email" else m[0] if k == "ip" else re.sub("[^0-9]", "", m[0])
                    entities.setdefault(f"{k}:{value}", set()).add(i)
                    clean = clean[: m.start()] + " " * (m.end() - m.start()) + clean[m.end() :]
        for w in {x.lower() for x in term.findall(clean)}:
            words.setdefault(w, set()).add(i)
    n, told, broad = len(rows), {}, {}
    rate = lambda w, e: math.log2(n * len(words[w] & entities[e]) / (len(words[w]) * len(entities[e]))) / math.log2(n / len(entities[e])) if words[w] & entities[e] else -math.inf
    for e, held in entities.items():
        for w, docs in words.items():
            if len(held) >= 2 and len(docs & held) >= 2 and rate(w, e) >= pii.GENERALISE:
                told[e, w] = rate(w, e)
                wide = [(len(words[b]), b) for b in words if b != w and len(words[b] & held) >= pii.SUBSUMED * len(held) and len(words[b]) > len(docs) and rate(b, e) < pii.GENERALISE]
                if rate(w, e) < pii.REMOVE and wide:
                    broad[e, w] = min(wide)[1]
    return told, broad


def generalised():
    rows = [(i, f"The nurse Amara of the ward in Juba calls +12025550143 on day {i}.") for i in range(4)]
    rows += [(10 + i, "Doctor Amara writes of the ward.") for i in range(2)] + [(20 + i, "A nurse in Juba rests.") for i in range(9)]
    return rows + [(40 + i, "the house is red and doctor calls the day of a ward") for i in range(180)]


def test_disclosures_and_broader_terms_equal_brute_force(spark):
    for rows in (generalised(), corpus()):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = pii.detect(docs)
        near = pii.contexts(found)
        rated = pii.disclosures(docs, found, near)
        told, broad = by_hand(rows)
        got = {(r["entity"], r["term"]): r["disclosure"] for r in rated.collect()}
        assert got.keys() == told.keys() and all(abs(got[k] - v) < 1e-9 for k, v in told.items())
        assert {(r["entity"], r["term"]): r["broader"] for r in pii.broader_terms(found, rated).collect()} == broad
    told, broad = by_hand(generalised())
    assert pii.GENERALISE <= told["phone:12025550143", "amara"] < pii.REMOVE and broad["phone:12025550143", "amara"] in ("nurse", "juba")


def test_generalised_term_takes_the_broader_one(spark):
    docs = spark.createDataFrame(generalised(), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert got[0] == "The nurse juba of the ward in Juba calls [PHONE] on day 0." and got[10] == "Doctor Amara writes of the ward."
