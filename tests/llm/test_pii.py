from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import pytest
from pyspark.sql import Row

from stridelab.llm import pii, queries

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = [True, kind != 1 or all(int(p) <= 255 for p in m[0].split(".")), 16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15]
            if fits[kind]:
                out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def field():
    return pii.Field()


def test_base_spans_are_the_rules():
    rng = random.Random(5)
    for _ in range(8000):
        text = "".join(rng.choice("01 9.@+-()a_ \n") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("a@b.c@d.e 0.0.0.0000001.5") == plain_spans("a@b.c@d.e 0.0.0.0000001.5")


def test_long_runs_take_linear_time():
    assert pii.base_spans("1.2." + "0" * 6000 + "3.4") == [(1, 0, 6007)]
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000):
        pii.base_spans(text)


def test_field_adds_what_the_rules_miss(field):
    def found(text):
        return [(pii.KINDS[k], text[s:e]) for k, s, e, base in pii.spans(text, field) if not base]

    assert found("call (017) 555-7713 now") == [("phone", "(017) 555-7713")]
    assert ("card", "4111.1111.1111.1111") in found("paid by 4111.1111.1111.1111 then")
    assert found("ring +1 (743) 555-3824 4111111111111111") == [("card", "4111111111111111"), ("phone", "+1 (743) 555-3824")]
    for text in ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "on 2024-01-02 at 10:30:22", "CC BY-NC 4.0.", "no numbers here", "page 12 of 300"):
        assert found(text) == []


def test_any_marks_side_by_side(field):
    """Dots, digits and marks in any order: no failure, and the base spans stay."""
    rng = random.Random(8)
    texts = ["1...5", "10..20.5", "1..2.3", "::1::2:3:", "1.2.3.", ".1.2.3.4", "²..³.5"]
    texts += ["".join(rng.choice("012 ..:@-+()a²") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    for text in texts:
        assert [s[:3] for s in pii.spans(text, field) if s[3]] == plain_spans(text)


def test_long_islands_are_decoded_whole_in_little_memory(field):
    rng = random.Random(3)
    text = " ".join(pii._island(rng)[0] for _ in range(400))
    atoms, segments = pii._lattice(text)
    best, back = {0: 0.0}, {}
    for a, b, kind, f in segments:
        score = best[a] + sum(field.table.get(i, 0.0) for i in f)
        if score > best.get(b, float("-inf")):
            best[b], back[b] = score, (a, kind)
    want, at = [], len(atoms)
    while at:
        a, kind = back[at]
        want += [(kind, atoms[a][0], atoms[at - 1][1])] * (kind >= 0)
        at = a
    assert field._decode(text) == want[::-1] and len(want) > 200
    tracemalloc.start()
    field._decode("1 " * 10_000)
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()


def test_best_path_beats_every_other_path(field):
    """Dynamic programming against all segmentations of a short island."""
    text = "+44 20 7946 0958 x"
    atoms, segments = pii._lattice(text)
    table = field._weight()
    score = {s[:3]: sum(table.get(i, 0.0) for i in s[3]) for s in segments}

    def best(at: int) -> float:
        return 0.0 if at == len(atoms) else max(v + best(b) for (a, b, _), v in score.items() if a == at)

    path, at = 0.0, 0
    spans = {(s, e): k for k, s, e in field._decode(text)}
    while at < len(atoms):
        hit = next(((e, k) for (s, e), k in spans.items() if s == atoms[at][0]), None)
        end, kind = (next(i for i, a in enumerate(atoms) if a[1] == hit[0]) + 1, hit[1]) if hit else (at + 1, -1)
        path += score[at, end, kind]
        at = end
    assert abs(path - best(0)) < 1e-9


def test_base_spans_stay_and_added_ones_do_not_overlap_them(spark, sf_dir, field):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        spans = pii.spans(r.text, field)
        base = [s[:3] for s in spans if s[3]]
        assert base == plain_spans(r.text)
        assert not any(s < e2 and s2 < e for _, s, e, b in spans if not b for _, s2, e2 in base)


def test_query_digest(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.queries()["op1_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in base) for i in range(4)]


def test_nulls_repeats_clashing_columns_and_redaction(spark):
    rows = [Row(doc_id=1, text=None, found=None, n_chars=5, pii="x"), Row(doc_id=1, text="", found="y", n_chars=None, pii="x"), Row(doc_id=None, text="mail a.b@c.org, +1 (743) 555-3824.", found="y", n_chars=3, pii="x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, n_chars long, pii string")
    assert pii.find(docs, "spans").columns == [*docs.columns, "spans"]
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(((r.text, r.n_chars) for r in out.collect()), key=str) == sorted([(None, None), ("", 0), ("mail <EMAIL>, <PHONE>.", 22)], key=str)
    assert pii.redact(docs.limit(0)).count() == 0
