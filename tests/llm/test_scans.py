"""Licence and personal data scans against plain loops."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueweave.llm import licenses, pii

MIT = licenses.NOTICES["mit"]
LICENSED = [
    (1, None), (2, ""), (3, "..."), (4, "the MIT License and the mit-license; MIT license"), (5, "General Public License, APACHE license"),
    (6, "general public general public license"), (7, "mit é license"), (8, "mit license " * 4000), (9, "words " * 50_000 + "Apache License"),
    (10, "mitlicense mit licenses"), (10, "mitlicense mit licenses"), (11, "a mit license"), (11, "b"), (None, "GNU general PUBLIC license"),
    (12, "Start. " + MIT + " End."), (13, "x " + MIT.replace("free of charge, ", "at no charge at all, ") + " y"), (14, " ".join(MIT.split()[:20])),
    (15, "Licensed under CC BY-NC 4.0."), (16, "mit\x00license mıt license MİT license"),
]


def license_loop(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base_rows(docs):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()), key=str)


def test_base_phrases(make, real):
    clash = make(LICENSED).withColumn("label", F.lit("x")).withColumn("at_word", F.lit(1)).withColumn("words", F.lit(2))
    assert base_rows(clash) == sorted(((i, *license_loop(t)) for i, t in LICENSED), key=str)
    assert base_rows(real) == sorted(((r.doc_id, *license_loop(r.text)) for r in real.collect()), key=str)
    assert licenses.scan(make([])).count() == 0


def test_notices(make):
    rows = {r.doc_id: r for r in licenses.scan(make(LICENSED)).collect()}
    assert rows[12].labels == rows[13].labels == "mit" and rows[12].score == 1.0 and 0.6 <= rows[13].score < 1 and rows[12].n_base == 0
    assert rows[14].labels == "" and rows[15].labels == "cc-by-nc" and rows[15].base_labels == "" and rows[1].score == 0
    spans = {(r.doc_id, r.label): (r.first_word, r.last_word) for r in licenses.spans(make(LICENSED[14:16])).collect()}
    assert spans[12, "mit"] == (1, 1 + len(re.findall("[A-Za-z0-9]+", MIT)))
    assert 1 <= spans[13, "mit"][0] < spans[13, "mit"][1] <= 80


# ---- personal data ----------------------------------------------------------------

def small(part):
    return len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255


def base_loop(text):
    out = [("email", *m.span()) for m in re.finditer(pii.EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(pii.IP, text) if all(small(g) for g in m.group().split("."))]
    for kind, pattern, low, high in (("card", pii.CARD, 14, 19), ("phone", pii.PHONE, 10, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return pii.in_order(out)


PERSONAL = [
    (1, None), (2, ""), (3, "x@y"), (4, "a.b+c@d-e.fg.hi. j@k.l@m.n"), (5, "1.2.3.4.5.6.7.8.9 300.1.1.1 01.002.0003.4 1..2.3.4.5"),
    (6, "4111 1111 1111 1111, 4111-1111-1111-1112 +1 (017) 555-7713."), (7, "4111111111111111 4111111111111111"), (8, "+1 23 (4) +49.89.123456-78 "),
    (9, "9 " * 20_000), (10, "a" * 5_000 + "@"), (11, "1" * 50_000 + ".1.1.1"), (12, "+12345678901234 x"), (13, "x@y.z" * 2000), (None, "é ü@x.de ☎ +1 (017) 555-7713"),
    (14, "call (017) 555-7713 now"), (14, "call (017) 555-7713 now"), (15, "0" * 5000 + ".0.0.0"), (16, "@" * 3000), (17, "+" * 3000 + "1"), (18, "1.2.3.4@h.de"),
]


def test_base_spans(real):
    for text in [t or "" for _, t in PERSONAL] + [r.text for r in real.collect()]:
        assert pii.find(text, pii.Field())[0] == base_loop(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("12 34.-()+@a_%é4")), max_size=60))
def test_base_spans_of_any_text(text):
    base, every = pii.find(text, pii.Field({("phone", "groups 2"): 1.0, ("email", "letters True"): 2.0}))
    assert base == base_loop(text)
    added = [s for s in every if s not in base]
    assert set(base) <= set(every) and every == pii.in_order(every)
    assert all(b <= c or d <= a for _, a, b in added for x, c, d in every if (x, c, d) != (_, a, b))


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_field_finds_what_the_patterns_teach(spark, model):
    """Without fixed segments, on texts it was fitted on and (sf0.1) mostly not."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    found = wanted = right = 0
    for text in texts:
        for a, b, base in pii.regions(text):
            got = set(pii.best_path(text, pii.lattice(text, a, b), model, []))
            found, wanted, right = found + len(got), wanted + len(base), right + len(got & set(base))
    assert wanted > 500 and right / wanted > 0.95 and right / found > 0.95


def test_added_spans(make, model):
    rows = {r.doc_id: r for r in pii.scan(make(PERSONAL).withColumn("spans", F.lit(1)), model).collect()}
    assert rows[14].spans == "phone:5:19" and rows[14].n_phone == 0 and rows[14].base_spans == ""
    assert rows[7].base_spans == "" and {s[:4] for s in rows[7].spans.split(",") if s} <= {"card"}
    assert rows[1].spans == "" and pii.scan(make([]), model).count() == 0


def best_by_trying(text, found, model):
    """The highest score of any set of segments that don't overlap."""
    values = {}
    for _, _, a, b in found.segments:
        values[a, b] = max(sum(model.weights.get((k, f), 0.0) for f in pii.span_features(text, a, b)) for k in pii.KINDS)

    def best(at):
        return max([0.0] + [v + best(b) for (a, b), v in values.items() if a >= at])

    return best(0)


def test_path_is_the_best(model):
    for text in ("+1 (017) 555-7713", "4111111111111111 4111111111111111", "1.2.3.4 5.6.7.8", "a@b.cd x@y.zz", "12 345 678 9012"):
        found = pii.lattice(text, 0, len(text))
        path = pii.best_path(text, found, model, [])
        score = sum(sum(model.weights.get((k, f), 0.0) for f in pii.span_features(text, a, b)) for k, a, b in path)
        assert score == pytest.approx(best_by_trying(text, found, model))


def test_redaction(make, model):
    docs = make(PERSONAL).withColumn("end", F.lit("é"))
    rows = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert pii.redact(docs, model).columns == docs.columns
    assert rows[1].text is None and rows[14].text == "call [PHONE] now" and rows[14].n_chars == len("call [PHONE] now")
    assert rows[None].text == "é ü@x.de ☎ [PHONE]".replace("ü@x.de", "ü@x.de") and rows[14].end == "é"
    assert pii.redacted("abcdef", [("ip", 1, 3), ("card", 2, 4)]) == "a[IP]ef"
