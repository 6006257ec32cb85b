"""Fill-in-the-middle against a plain version, and the bit vector against counting."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelab.llm import fim
from stridelab.llm import queries as Q
from tests.oracle import compare, connect

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def test_rank_and_select_count_bits():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        for density in (0.0, 0.02, 0.5, 1.0):
            bits = rng.random(size) < density
            vector = fim.BoundaryBits(bits)
            assert vector.total == bits.sum()
            places = np.arange(size + 1)
            assert vector.rank(places).tolist() == np.r_[0, np.cumsum(bits)].tolist()
            assert vector.select(np.arange(bits.sum())).tolist() == np.flatnonzero(bits).tolist()


ODD = [None, "", " ", "\n\n", "one", " two ", "é ü 中文 \U0001f600 x", "a\tb\x0bc\x0cd\re\x1ff", "has <P> a mark", "<M>", "x" * 70_000 + " y", " a" * 40_000, "<S", "< P>", "tail  ", " not space　here"]


def test_equals_a_plain_version(spark):
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice("ab \n\té中\U0001f600<>PSM") for _ in range(rng.randrange(60))) for _ in range(400))]
    rows = [(i, t, "kept", i) for i, t in enumerate(texts)] + [(None, "null id here", "kept", 0), (3, texts[7], "kept", 1), (3, texts[7], "kept", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, __cut int").repartition(5)
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows) and out[0]["__cut"] is not None
    kinds = set()
    for r in out:
        want = plain(r.doc_id, r.text)
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == want
        assert r.back == (r.text or "")
        kinds.add(r.form)
    assert kinds == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("name", ["op11_fim"])
def test_registered_query_equals_its_sql(spark, sf_dir, name):
    assert compare(Q.queries()[name](spark, sf_dir), connect(sf_dir), Q.ORACLES[name]) is None
