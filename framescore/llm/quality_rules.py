"""Operator 9: a rule ledger.  Every rule is evaluated once per document; its failures
are bits of one number, its measurements are columns.  Policies are masks over those
bits, and ablations are counts over them, so neither reads a text again.

Native: SQL expressions only, one pass, no shuffle before the ledger.

Repeated windows: the 8-word windows of a text are hashed (64 bits) in place; only a
text that holds an equal pair sorts its windows to find which.  The cost is linear in
the text (n log n where windows repeat), also for very long texts.

Defined cases: a null or empty text has no words and fails ``few_words``; a text of
fewer than eight words has no window; repeated rows and null ids are rows of their
own; an empty table gives an empty ledger.  Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8

#: name -> failure, over the measurements; the position in this list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
    ("shouting", "100 * n_upper > 60 * word_chars"),
    ("echoed_words", "100 * n_echo_words > 30 * n_words"),
    ("digits", "100 * n_digits > 50 * word_chars"),
]
BASE_RULES = ("few_words", "repeated_windows")
#: version -> the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "markup": (*BASE_RULES, "symbols", "duplicate_lines"),
    "full": tuple(name for name, _ in RULES),
}
POLICY = "full"


def mask_of(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def _kept_only(text: Column, chars: str) -> Column:
    """How many characters of the class there are."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
            ) -> DataFrame:
    """doc_id and every measurement the rules use (``carry``: and the whole row as ``row``)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = ["doc_id", "row"] if carry else ["doc_id"]
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    split = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *row, text.alias("text")).select(
        *own, "text",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    hashed = split.select(
        *own, "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _kept_only(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _kept_only(F.col("text"), "A-Z").alias("n_upper"),
        _kept_only(F.col("text"), "0-9").alias("n_digits"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    windows = hashed.select(
        *[c for c in hashed.columns if c not in ("words", "hashes")],
        F.expr("cast(size(filter(hashes, (h, i) -> i > 0 AND h = hashes[i - 1])) as bigint)"
               ).alias("n_echo_words"),
        F.expr(f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(1, cast(n_words as int) - "
               f"{WINDOW - 1}), i -> xxhash64(slice(hashes, i, {WINDOW}))) "
               "ELSE array() END").cast("array<bigint>").alias("windows"))
    # positions of windows that occur again, in order of hash and then of position
    again = windows.select(
        *[c for c in windows.columns if c != "windows"],
        F.expr("""CASE WHEN size(array_distinct(windows)) = size(windows) THEN NULL
                  ELSE array_sort(transform(windows, (h, i) -> struct(h, i))) END""").alias("ordered"))
    starts = again.select(
        *[c for c in again.columns if c != "ordered"],
        F.expr("""array_sort(transform(filter(transform(ordered, (x, j) -> struct(
                    x.i AS i, (j > 0 AND ordered[greatest(j - 1, 0)].h = x.h) OR
                    (j < size(ordered) - 1 AND ordered[least(j + 1, size(ordered) - 1)].h = x.h) AS twice)),
                  y -> y.twice), z -> z.i))""").alias("starts"))
    covered = F.expr(f"""coalesce(aggregate(starts, struct(cast(-{WINDOW} as bigint) AS last,
                         cast(0 as bigint) AS n), (a, s) -> struct(cast(s as bigint) AS last,
                         a.n + least({WINDOW}, s - a.last) AS n), a -> a.n), 0L)""")
    return starts.select(*[c for c in starts.columns if c != "starts"],
                         covered.alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
           ) -> DataFrame:
    """Measurements and ``failed``, the bits of the rules a document fails."""
    bits = F.lit(0).cast("long")
    for k, (_, failure) in enumerate(RULES):
        bits = bits + F.expr(f"CASE WHEN {failure} THEN {1 << k}L ELSE 0L END")
    return measure(docs, id_col, text_col, carry).withColumn("failed", bits)


def apply_policy(rows: DataFrame, version: str = POLICY) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under the policy of that version."""
    base, mask = mask_of(BASE_RULES), mask_of(POLICIES[version])
    return rows.select("*", (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
                       (F.col("failed").bitwiseAND(F.lit(base | mask)) == 0).alias("kept"),
                       F.lit(version).alias("policy"))


def keep(docs: DataFrame, version: str = POLICY, id_col: str = "doc_id", text_col: str = "text"
         ) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the policy.

    A generator gives a row that passes and nothing for one that fails.  A filter would not do:
    the optimiser pushes it below the ledger's projections and puts each alias in its place, so
    that a text is split again for every element of its nested lambdas."""
    judged = apply_policy(ledger(docs, id_col, text_col, carry=True), version)
    return judged.select(F.inline(F.when(F.col("kept"), F.array("row"))))


def ablation(rows: DataFrame, version: str = POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it rejects.

    Counted over the distinct bit patterns, at most 2 ** len(RULES) rows."""
    mask = mask_of(POLICIES[version])
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count("*").alias("n"))
    bit = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit"))
                                 for n, b in bit])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return patterns.select("bits", "n", listed).groupBy("r.rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed_docs"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this_rule"))


#: The ledger in DuckDB's SQL.
ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text,
        list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\x0C\\r]+'), lambda w: w <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\x0C\\r]')) AS lines
      FROM t),
m AS (SELECT doc_id, words, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
        length(regexp_replace(text, '[^0-9]+', '', 'g'))::BIGINT AS n_digits,
        len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_echo_words
      FROM s),
w AS (SELECT doc_id, unnest(range(1, greatest(n_words - 6, 1))) AS i, words FROM m),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(words, i, i + 7)) AS c FROM w),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM h WHERE c > 1),
r AS (SELECT doc_id, sum(least(8, i - coalesce(last, i - 8)))::BIGINT AS n FROM p GROUP BY doc_id),
l AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       failed = 0 AS kept, failed, n_lines, n_upper, n_digits, n_echo_words, 'full' AS policy
FROM (SELECT *, {bits} AS failed FROM l)
""".replace("{bits}", " + ".join(
    f"CASE WHEN {failure} THEN {1 << k}::BIGINT ELSE 0::BIGINT END" for k, (_, failure) in enumerate(RULES)))


def contract(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "failed", "n_lines", "n_upper", "n_digits",
                       "n_echo_words", "policy")
