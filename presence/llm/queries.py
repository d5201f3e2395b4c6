"""The thirteen operators over their whole tables, and SQL where it can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from presence.llm import (
    collocations,
    decontaminate,
    hyperminhash,
    langid,
    ledger,
    licences,
    packing,
    pagediff,
    paragraphs,
    pu_quality,
    simhash,
    toxgrammar,
    whitening,
)

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op3_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces)


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_text(_read(spark, sf_dir, "pages"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.apply_policy(ledger.ledger(_read(spark, sf_dir, "documents")), version=2)


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op6's policy does to the whole table."""
    return ledger.ablations(ledger.ledger(_read(spark, sf_dir, "documents")), version=2)


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=3, held=1)


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxgrammar.score_texts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=4, held=2)


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.duplicate_spans(_read(spark, sf_dir, "documents"))


def op10_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


def op11_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op13_fm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


OPERATORS = (
    op1_template_leaks, op2_language_fusion, op3_bin_slack, op4_hyperminhash, op5_page_differencing,
    op6_rule_ledger, op7_pu_quality, op8_toxicity_grammar, op9_paragraph_dedup, op10_licence_dice,
    op11_spectrum_whitening, op12_simhash_bytes, op13_fm_collocations,
)

QUERIES = {f.__name__: f for f in (*OPERATORS, rule_ablations)}

NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+3], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, k) AS node
        FROM (SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS k FROM s GROUP BY doc_id)),
u AS (SELECT s.doc_id, g FROM s JOIN cls ON s.doc_id = cls.doc_id AND s.doc_id = cls.node),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM u GROUP BY doc_id UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS root FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(cls.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id,
       coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN cls USING (doc_id) LEFT JOIN c ON c.node = cls.node
"""

ORACLES = {"op4_hyperminhash": NEAR_SQL, "op6_rule_ledger": ledger.SQL, "rule_ablations": ledger.ABLATIONS_SQL, "op13_fm_collocations": collocations.SQL}
