import random
import re
from hashlib import sha256

from provenia.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PLAIN[k], text or "") if passes(k, m[0])]


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(docs).collect():
        want = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == sha256(said.encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, *_ in want) for k in pii.KINDS)
        assert r.spans.startswith(said)


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(6)
    texts = ["", None, "a.b@c.d_e@f.g", "x@y.z@w.v", "é😀 me@site.org, 1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.0255.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (0)30 123456-78. +1", "1234567 4111111111111111", "+1.2.3.4 (5) 6-7 +"]
    alphabet = ["a", "b.", "@", "x@y.z", ".", "-", " ", "1", "25", "255", ".0", "+", "(", "4111 1111 1111 1111", "_", "é", "😀", "\n", "%"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(1500)]
    digits = "0123456789 -.+()@a"
    texts += ["".join(rng.choices(digits, weights=[3] * 10 + [2, 1, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 60))) for _ in range(1500)]
    check(spark, texts)


def test_long_runs_match_plain_patterns(spark):
    check(spark, ["a" * 900, "1" * 900, "1." * 400, "a@" * 400, "+1" + "(" * 400, "1 " * 400, "a@b.c " * 100, "a.b@" + "c." * 300 + "d", "12," * 300 + "4111111111111111"])


def test_very_long_runs_take_linear_time(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1." * 12_000, "a@" * 60_000, "+1" + "(" * 100_000, "1 " * 100_000, "12," * 60_000 + "4111111111111111", "a.b@" + "c." * 50_000 + "d"]
    got = sorted(pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(0, 0, 0, 0)] * 2 + [(0, 3_000, 0, 0)] + [(0, 0, 0, 0)] * 3 + [(0, 0, 1, 0), (1, 0, 0, 0)]


def corpus():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("river stone house lantern copper window meadow signal".split(), k=60))) for i in range(200)]
    for i in range(6):
        rows.append((300 + i, f"window number{'x' * i} the Zanzibarian meadow ann@corp.example lantern {'stone ' * (i + 1)}" + "house " * 40 * (i == 3) + "Zanzibarian" * (i == 3)))
    rows += [(400 + i, "copies mention Quixotical bob@corp.example here") for i in range(5)]  # one text: no support
    rows += [(500, None), (501, ""), (None, "signal ann@corp.example Zanzibarian"), (300, rows[200][1]), (502, "word " * 40_000)]
    return rows


def brute_terms(rows):
    import math
    from collections import Counter, defaultdict

    near, has_term, has_entity = defaultdict(set), Counter(), Counter()
    keys = defaultdict(set)
    spans = defaultdict(set)
    seen_entity = defaultdict(set)
    for i, text in rows:
        text = text or ""
        base = brute(text)
        for term in set(re.findall(r"(?<![^\W\d_])[^\W\d_]{4,40}(?![^\W\d_])", text.lower())):
            has_term[term] += 1
        for kind, s, e in base:
            value = f"{kind}:{text[s:e].lower() if kind == 'email' else text[s:e]}"
            seen_entity[value].add((i, text))
            for m in re.finditer(r"(?<![^\W\d_])[^\W\d_]{4,40}(?![^\W\d_])", text):
                if not any(m.start() < q and m.end() > p for _, p, q in base):
                    keys[value, m[0].lower()].add((i, text))
                    spans[i, text].add((value, m[0].lower(), m.start(), m.end()))
    out = {}
    for (i, text), found in spans.items():
        good = set()
        for value, term, x, y in found:
            both = keys[value, term]
            if len({t for _, t in both}) >= pii.SUPPORT:
                content = math.log(len(rows) / len(seen_entity[value]))
                if content > 0 and math.log(len(both) * len(rows) / (len(seen_entity[value]) * has_term[term])) >= pii.DISCLOSED * content:
                    good.add((x, y))
        out[i, text] = sorted(good)
    return out


def test_terms_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, content string, base int").repartition(3)
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    want = brute_terms(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    flagged = set()
    for r in got:
        terms = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term")]
        assert terms == want.get((r.doc_id, texts[r.doc_id] or ""), [])
        flagged |= {texts[r.doc_id][a:b] for a, b in terms}
    assert flagged == {"Zanzibarian"}


def test_sanitised_text(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert out[300] == "window number the [TERM] meadow [EMAIL] lantern stone "
    assert out[400] == "copies mention Quixotical [EMAIL] here" and out[500] == "" and out[0] == rows[0][1]
    assert out[None] == "signal [EMAIL] [TERM]"


def test_no_python_on_the_executors(spark, docs):
    plan = pii.personal_data(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(empty):
    assert pii.personal_data(empty).collect() == []
