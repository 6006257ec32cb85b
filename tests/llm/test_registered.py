"""Queries under their registered names, over their whole tables, against plain code."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from stridelab.llm import decontam, queries
from stridelab.llm.common import read
from tests.llm.test_simhash import components, plain_simhash


def texts(spark, sf_dir) -> dict[int, str | None]:
    return {r.doc_id: r.text for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def test_op8_equals_all_pairs(spark, sf_dir):
    docs = texts(spark, sf_dir)
    ids = sorted(docs)
    prints = [plain_simhash(docs[i]) for i in ids]
    near = [(i, j) for i in range(len(ids)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, components(len(ids), near), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.queries()["op8_simhash"](spark, sf_dir).collect()}
    assert got == want and len(near) > 0


def least_distance(item: str, text: str) -> int:
    """The least edit distance of the whole item to any stretch of the text, a row at a time."""
    other = np.array([ord(c) for c in text], dtype=np.int64)
    row, places = np.zeros(len(other) + 1, dtype=np.int64), np.arange(len(other) + 1)
    for i, a in enumerate(item, 1):
        new = np.r_[i, np.minimum(row[:-1] + (other != ord(a)), row[1:] + 1)]
        row = np.minimum.accumulate(new - places) + places  # what a step to the right adds
    return int(row.min())


def test_op5_equals_alignment_of_all_items(spark, sf_dir):
    docs = {i: decontam.normalise(t) for i, t in sorted(texts(spark, sf_dir).items())[:60] if t and len(t) < 6000}
    items = {r.item_id: decontam.normalise(r.text) for r in read(spark, sf_dir, "benchmark").collect() if r.text}
    bounds = decontam.Bounds()
    want = {i for i, text in docs.items() if any(least_distance(item, text) <= bounds.edits(len(item)) for item in items.values())}
    rows = queries.queries()["op5_decontamination"](spark, sf_dir).collect()
    got = {r.doc_id for r in rows if r.doc_id in docs}
    assert got == want


def test_op7_budgets_follow_the_exponent(spark, sf_dir):
    """Every document appears; a source's tokens reach its budget; epochs are at most two."""
    rows = queries.queries()["op7_mixing"](spark, sf_dir).collect()
    docs = {r.doc_id: (r.source, len([w for w in (r.text or "").replace("\t", " ").split() if w])) for r in read(spark, sf_dir, "documents").collect()}
    own, used, weight, seen = defaultdict(int), defaultdict(int), {}, defaultdict(set)
    for source, n in docs.values():
        own[source] += n
    for r in rows:
        used[r.source] += r.mix_tokens
        weight[r.source] = r.mix_weight
        assert r.epoch not in seen[r.doc_id] and r.source == docs[r.doc_id][0]
        seen[r.doc_id].add(r.epoch)
    assert set(seen) == set(docs) and all(epochs <= {0, 1} and 0 in epochs for epochs in seen.values())
    # Weights are one power of the shares: all pairs of sources give the same exponent.
    common = max(own, key=own.get)
    powers = [np.log(weight[s] / weight[common]) / np.log(own[s] / own[common]) for s in own if own[s] not in (0, own[common])]
    assert np.ptp(powers) < 1e-4 and 0 <= powers[0] <= 1
    longest = max(n for _, n in docs.values())
    budget = {s: weight[s] / weight[common] * own[common] for s in own}
    assert all(-1e-3 * budget[s] - 1 <= used[s] - budget[s] <= longest + 1 + 1e-3 * budget[s] for s in own if own[s])
