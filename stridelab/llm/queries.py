"""The registered queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import byte_bpe, decontam, fim, htmlwrap, langid, media, mixing, pii, simhash, spelling, token_counts, toxicity, urlfilter
from .common import id_bucket, read

#: The url rules (host, path, action).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: The mix of op7 and of the pipeline: no source goes through more than this many epochs.
MIX_TARGET = mixing.Target(max_repeats=2.0)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    found = pii.find(docs, "found").drop("text")
    base = F.filter("found", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    return found.select(
        "doc_id",
        *((F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


#: The vocabulary that op2 counts with, unless ``spark.stridelab.vocabulary`` names another; read on the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get("spark.stridelab.vocabulary", VOCABULARY)
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path}; set spark.stridelab.vocabulary")
    return token_counts.token_counts(read(spark, sf_dir, "documents"), path)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    bucket = id_bucket("doc_id", 3)
    model = langid.fit(docs, bucket != 1)
    return langid.identify(docs, model, F.coalesce(bucket == 1, F.lit(False)))


#: Vectors that a task draws and describes.
VECTORS_A_TASK = 1500


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has pictures, so each vector is drawn as one.

    Every twentieth row instead carries a cropped and darkened copy of the
    picture before it.
    """
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    copied = F.col("vec_id") % 20 == 7
    before = vectors.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other")).filter(copied)
    # A vector takes little room and its picture much work: spread by rows, not by bytes.
    shown = vectors.join(before, "vec_id", "left").repartition(1 + vectors.count() // VECTORS_A_TASK, "vec_id")
    edited = F.col("other").isNotNull()
    pictures = shown.select("vec_id", media.drawn_column(F.coalesce("other", "embedding"), edited).alias("picture"))
    return media.copies(pictures, "vec_id", "picture")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, action)")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_hash"), mixing.word_count(F.col("text")).alias("n_words"))
    mixed = mixing.mix(docs, MIX_TARGET, text_col="text_hash", tokens=F.col("n_words"))
    return mixed.select("doc_id", "source", "epoch", "mix_block", "mix_tokens", "mix_weight")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmlwrap.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    bucket = id_bucket("doc_id", 5)
    model = toxicity.fit(docs, labels, bucket != 0)
    return toxicity.scored(docs, model, F.coalesce(bucket == 0, F.lit(False)))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = lambda text: F.sha2(text.cast("binary"), 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(back).alias("restored_sha256"))


#: Letters of op12's words, and the fewest that a word has.
WORD_LETTERS, WORD_LEAST = "A-Za-z\u00c0-\u00ff", 7


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    runs = docs.select("doc_id", F.explode(spelling.long_runs(F.col("text"), WORD_LETTERS, WORD_LEAST)).alias("run"))
    # One run in 31 loses a letter, as its digest says.
    digest = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (digest % F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substr(F.col("run"), at + 2))
    words = runs.select(F.when(digest % 31 == 0, slipped).otherwise(F.col("run")).alias("word"))
    counts = spelling.counted(words.filter(F.length("word") >= WORD_LEAST)).filter("n >= 2")
    return spelling.variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = byte_bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tokens = tokenizer.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_media": op4_media,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_html": op9_html,
    "op10_toxicity": op10_toxicity,
    "op11_fim": op11_fim,
    "op12_spelling": op12_spelling,
    "op13_byte_bpe": op13_byte_bpe,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(q) for name, q in QUERIES.items()}


ORACLES = {
    "op6_url_filter": """
        WITH rules(host, path, action) AS (
          VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                 ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        placed AS (
          SELECT page_id,
                 coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
          FROM pages),
        fitting AS (
          SELECT p.*, r.host || r.path AS rule, r.action,
                 row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS nth
          FROM placed p LEFT JOIN rules r
            ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fitting WHERE nth = 1
    """,
    # Holds for pages that mark their article, as those of `pages` do, and for the references that occur in them.
    "op9_html": """
        WITH marked AS (
          SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '<[^>]*>', ' ', 'g') AS body FROM pages),
        decoded AS (
          SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(body, '&quot;?', '"', 'g'), '&(lt|gt);', '', 'g'), '&amp;?', '&', 'g') AS body FROM marked)
        SELECT page_id, url, trim(regexp_replace(body, '[[:space:]]+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(body, '[[:space:]]+', ' ', 'g'))) AS BIGINT) AS n_chars FROM decoded
    """,
    "op11_fim": """
        WITH cut AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ \\t-\\r]*[^ \\t-\\r]+|[ \\t-\\r]+') AS tokens, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
          FROM documents),
        drawn AS (
          SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n,
                 CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
          FROM cut),
        parts AS (
          SELECT doc_id, text, n,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
                 array_to_string(tokens[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
                 array_to_string(tokens[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
                 array_to_string(tokens[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix
          FROM drawn)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
    # crc32 is written out bit by bit: DuckDB has none. Neighbours share what is left when a letter goes from one, or the same place from both.
    "op12_spelling": """
        WITH RECURSIVE octets AS (
          SELECT b, list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(b)),
        crc_table AS (SELECT list(v ORDER BY b) AS v FROM octets),
        runs AS (
          SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents),
        low AS (
          SELECT translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, doc_id FROM runs WHERE length(run) >= 7),
        spelt AS (
          SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM low),
        hashed AS (
          SELECT run, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(h), 2), lambda i: CAST('0x' || h[i + 1:i + 2] AS BIGINT))),
                          lambda c, o: xor(c // 256, v[CAST(xor(c % 256, o) AS INTEGER) + 1])), CAST(4294967295 AS BIGINT)) AS h
          FROM spelt, crc_table),
        slipped AS (
          SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed),
        words AS (SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
        gone AS (
          SELECT word, n, i, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        met AS (
          SELECT a.word, a.n, b.word AS near, b.n AS m FROM gone a JOIN gone b USING (rest, i) WHERE a.word <> b.word
          UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN gone b ON b.rest = a.word
          UNION SELECT a.word, a.n, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word),
        best AS (
          SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM met GROUP BY word),
        formed AS (
          SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.near END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
          FROM words w LEFT JOIN best b USING (word)),
        chains AS (
          SELECT word, word AS root, form AS next FROM formed
          UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN formed f ON f.word = c.next)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c ON c.word = f.word AND c.next IS NULL
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
