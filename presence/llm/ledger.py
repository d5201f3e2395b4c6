"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document from the same measurements; the
ledger keeps the measurements and one integer of failure bits. A policy is a
version and a mask of the bits it obeys: applying another policy, or leaving
one rule out, is arithmetic on the stored bits and reads no text.

Column expressions only. Each measurement stage is a projection of its own,
so an array that a lambda reads is computed once per row. Repeated windows
are found by sorting (hash, place) pairs within the row, and only for rows
that hold an equal pair at all.

Nulls: a null text has no words; a null id is kept. Repeated rows are judged
each. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
# Spelt out: the pattern compiler keeps single Latin-1 characters in one bit
# table, ranges of them in a chain of tests.
CAPITALS = "".join(chr(c) for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])
WINDOW = 5



def rules() -> list[tuple[str, Column]]:
    """(name, failure condition over the measurements); the bit is the place here."""
    n = F.col("n_words")
    return [
        ("too_few_words", n < 10),
        ("repeated_windows", 100 * F.col("n_repeat_words") > 20 * n),
        ("symbols", 100 * F.col("n_symbols") > 10 * n),
        ("short_words", F.col("word_chars") < 2 * n),
        ("long_words", F.col("word_chars") > 20 * n),
        ("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.greatest(F.col("n_lines"), F.lit(1))),
        ("capitals", 2 * F.col("n_capitals") > F.col("word_chars")),
    ]


BASE_BITS = 0b11
# Policy versions: later versions may add rules, never reinterpret a bit.
POLICIES = {1: BASE_BITS, 2: 0b1100111, 3: 0b1111111}


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("t"))
    # One pass keeps the few marks that are counted; the counts read those.
    marks = base.select(
        "doc_id",
        F.regexp_replace("t", f"[^{SYMBOLS}{CAPITALS}]+", "").alias("marks"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.split("t", BLANKS + "+").alias("w"),
    )
    tokens = marks.select(
        "doc_id",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("marks") - F.length(F.regexp_replace("marks", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("marks", f"[{SYMBOLS}]+", "")).cast("long").alias("n_capitals"),
        "lines",
        F.transform(F.array_remove("w", ""), lambda x: F.xxhash64(x)).alias("h"),
    )
    windows = tokens.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("h").cast("long").alias("n_words"),
        F.expr(
            f"if(size(h) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(h) - {WINDOW}),"
            f" i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(WINDOW))})))"
        ).alias("win"),
    )
    ordered = windows.withColumn(
        "s",
        F.expr("if(size(array_distinct(win)) < size(win), sort_array(transform(win, (x, i) -> struct(x as x, i as i))), null)"),
    ).drop("win")
    twice = "filter(s, (e, k) -> (k > 0 and s[k - 1].x = e.x) or (k < size(s) - 1 and s[k + 1].x = e.x))"
    places = ordered.withColumn("p", F.expr(f"sort_array(transform({twice}, e -> e.i))")).drop("s")
    covered = (
        f"aggregate(p, named_struct('last', {-WINDOW}, 'sum', 0L),"
        f" (a, x) -> named_struct('last', x, 'sum', a.sum + least({WINDOW}, x - a.last)), a -> a.sum)"
    )
    return places.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("p")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failures``, bit i set where rule i fails."""
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(rules())]
    return measurements(docs).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits))


def apply_policy(rows: DataFrame, version: int) -> DataFrame:
    """Adds base_failed, policy and kept to ledger rows."""
    return rows.select(
        "*",
        (F.col("failures").bitwiseAND(F.lit(BASE_BITS)) != 0).alias("base_failed"),
        F.lit(version).alias("policy"),
        (F.col("failures").bitwiseAND(F.lit(POLICIES[version] | BASE_BITS)) == 0).alias("kept"),
    )


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: documents that fail it, documents that only it
    rejects (so leaving it out would keep them), and the union and
    intersection of what else fails with it. Ledger rows are first counted
    by their bits: at most one row per distinct pattern is shuffled."""
    mask = POLICIES[version] | BASE_BITS
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("f")).agg(F.count("*").alias("n"))
    names = [(i, name) for i, (name, _) in enumerate(rules()) if mask >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(name).alias("rule")) for i, name in names]))
    hit = patterns.select("f", "n", each.alias("r")).filter("(f & shiftleft(1L, r.bit)) != 0")
    return hit.groupBy(F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n_failed"),
        F.sum(F.when(F.bit_count("f") == 1, F.col("n")).otherwise(0)).alias("n_only_this"),
        F.bit_or("f").alias("any_with"),
        F.bit_and("f").alias("all_with"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t,
        [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
        [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
win AS (SELECT rid, i, ws[i:i+4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(t) - length(regexp_replace(t, '[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]', '', 'g')) AS BIGINT) AS n_capitals,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN 100 * n_dup_lines > 30 * greatest(n_lines, 1) THEN 32 ELSE 0 END)
        + (CASE WHEN 2 * n_capitals > word_chars THEN 64 ELSE 0 END) AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, failures,
       (failures & 3) <> 0 AS base_failed, 2 AS policy, (failures & 103) = 0 AS kept FROM f
"""

# bits of policy 2 and their names, as in rules()
ABLATIONS_SQL = f"""
SELECT CAST(bit AS INTEGER) AS bit, rule, CAST(sum(n) AS BIGINT) AS n_failed, CAST(sum(CASE WHEN bit_count(f) = 1 THEN n ELSE 0 END) AS BIGINT) AS n_only_this,
       bit_or(f) AS any_with, bit_and(f) AS all_with
FROM (SELECT failures & 103 AS f, count(*) AS n FROM ({SQL}) GROUP BY 1),
     (VALUES (0, 'too_few_words'), (1, 'repeated_windows'), (2, 'symbols'), (5, 'repeated_lines'), (6, 'capitals')) r(bit, rule)
WHERE (f >> bit) & 1 = 1 GROUP BY bit, rule
"""
