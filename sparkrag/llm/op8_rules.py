"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger holds one failure bit per rule and the measurements.
Policies (named versions: which bits reject) and ablations (which documents one rule alone rejects) are bit
operations on the ledger, without another pass over texts. Null and empty texts have no words and fail
`few_words`; repeated rows are judged alike; an empty table gives no rows; further columns are kept under their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words

SYMBOLS = "#*$%&|<>"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measurements(text: Column) -> Column:
    """Struct of the base measurements of a text."""
    text = F.coalesce(text, F.lit(""))

    def repeated(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(0))
        grams = F.transform(F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c")), lambda x, i: F.struct(F.concat_ws(" ", x["a"], x["b"], x["c"]).alias("g"), i.alias("i")))

        def spread(s: Column) -> Column:
            # In sorted order equal windows are neighbours; each such pair marks the words of both.
            m = F.greatest(F.size(s) - 1, F.lit(0))
            pairs = F.filter(F.arrays_zip(F.slice(s, 1, m).alias("p"), F.slice(s, 2, m).alias("q")), lambda x: x["p"]["g"] == x["q"]["g"])
            starts = F.array_distinct(F.flatten(F.transform(pairs, lambda x: F.array(x["p"]["i"], x["q"]["i"]))))
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        return let(F.sort_array(grams), spread)

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    plain = F.translate(text, " \t\n\x0b\x0c\r", "")
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(plain).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )


#: Rules in bit order: name and failing condition over the measurements.
RULES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: (5 * m["n_symbols"] > m["n_words"]) & (m["n_symbols"] >= 20)),
    ("long_words", lambda m: m["word_chars"] > 25 * m["n_words"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("repeated_lines", lambda m: (m["n_dup_lines"] > 5) & (100 * m["n_dup_lines"] > m["n_words"] * 5)),
)
#: Policies by version: the rules whose failure rejects.
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": ("few_words", "repeated_windows", "symbols", "long_words", "short_words", "repeated_lines")}


def mask(names) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in names)


def ledger(docs: DataFrame, out: str = "ledger") -> DataFrame:
    """docs with the struct `out`: the measurements FIELDS and `failures`, a bitmask over RULES. `out` must be no column of docs."""
    bits = lambda m: reduce(lambda a, b: a.bitwiseOR(b), [F.when(rule(m), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)])
    full = lambda m: F.struct(*[m[x].alias(x) for x in FIELDS], bits(m).cast("long").alias("failures"))
    return docs.select("*", let(measurements(F.col("text")), full).alias(out))


def fails(version: str, of: str = "ledger") -> Column:
    """Whether a policy rejects a row, by its ledger alone."""
    return F.col(of)["failures"].bitwiseAND(F.lit(mask(POLICIES[version]))) != 0


def ablation(rows: DataFrame, version: str = "v1", of: str = "ledger") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects; plus bit_or and bit_and of all failures."""
    chosen = mask(POLICIES[version])
    failures = F.col(of)["failures"]
    masked = failures.bitwiseAND(F.lit(chosen))
    sums = [F.count_if(masked.bitwiseAND(F.lit(1 << i)) != 0).alias(f"fails_{n}") for i, (n, _) in enumerate(RULES) if chosen >> i & 1]
    alone = [F.count_if(masked == (1 << i)).alias(f"only_{n}") for i, (n, _) in enumerate(RULES) if chosen >> i & 1]
    return rows.agg(*sums, *alone, F.bit_or(failures).alias("any_failed"), F.bit_and(failures).alias("all_failed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[f"ledger.{x}" for x in FIELDS], fails("base").alias("base_failed"), (~fails("v1")).alias("kept"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
k AS (SELECT rid, count(DISTINCT i + o) AS n FROM h, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
 FROM w LEFT JOIN k USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT *, NOT (base_failed OR (5 * n_symbols > n_words AND n_symbols >= 20) OR word_chars > 25 * n_words OR word_chars < 2 * n_words
 OR (n_dup_lines > 5 AND 100 * n_dup_lines > n_words * 5)) AS kept FROM b
"""
