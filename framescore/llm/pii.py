"""Operator 1: personal data by weak supervision.

Native: SQL expressions only; each text is read once, nothing but vote counts moves.

*Candidates* are the base spans (fixed patterns with their checks) and what the labelers
propose beyond them: disguised, spaced and defanged forms (patterns), digit runs in national
forms or with any separator (gazetteer prefixes decide later), and digit runs behind a cue word
(context).  *Labelers* vote +1, 0 or -1 on each: strict form (the kind's check on the digits or
the ending), gazetteer (known endings, issuers, prefixes), a cue word before it, a misleading
cue before it, and variety of its characters; on proposals they disagree.
*Expectation-maximisation* over the counts of vote patterns estimates each labeler's
reliability for true and false spans, and the posteriors train the *final classifier*,
a logistic model over votes and kind, which scores every candidate.  Base spans stay
whatever it says; a weak one stays at ``THRESHOLD`` or more.

The counts are at most kinds x 3 ** labelers rows, whatever the corpus's size; the
driver's arithmetic is over those alone.  Positions come from the lengths of the pieces
between matches, so a text's cost grows with its length, not with its square.  The
patterns take runs possessively and start a run only at its beginning (or where the
last match ended), which gives the leftmost greedy matches without backtracking.

Defined cases: a null or empty text has no spans; overlapping spans of different kinds
all stay; repeated rows and null ids are rows of their own; an empty table (or no
candidates) trains nothing and gives an empty result.  Only the two named columns are
read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.llm.tables import dropped, stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns, in possessive form.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DOT = r"(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++"
WEAK = {
    "email": (rf"(?<![{_LOCAL}])[{_LOCAL}]++(?: ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++{_DOT}"
              rf"| @ ?[A-Za-z0-9-]++{_DOT}| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)"),
    "ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])"
           r"|(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)| \. |\[dot\]| dot )[0-9]{1,3}+){3}(?![0-9])"),
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ ._/-]?[0-9]){12,18}+(?![0-9A-Za-z])",
    "phone": (r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"
              r"|(?<![0-9A-Za-z+(.-])\(?0[0-9][0-9 ()/.-]{6,16}[0-9](?![0-9A-Za-z-])"
              r"|(?i)(?<=\b(?:tel|phone|call|fax|mobile|cell|telefon)[:. ]{1,2})[0-9][0-9 ()/.-]{5,16}[0-9](?![0-9A-Za-z-])"),
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "%@%", "ip": "%.%", "phone": "%+%"}
#: The pattern (for ``RLIKE``) without which no proposal of the kind is tried.
WEAK_NEEDS = {"email": r"[(\[]at[)\]]| @| dot ",
              "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|[\[( ](?:\.|dot)[\]) ]",
              "card": "[0-9][ ._/-]?[0-9]", "phone": "[0-9][0-9 ()/.-]*[0-9]"}
GAZETTEER = {
    "email": r"(?i)[.](com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$",
    "ip": r"^(10|127|172|192|[1-9]?[0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(\+(1|33|34|39|44|49)[ (]|\(?[2-9])",
}
CUES = {
    "email": r"(?i)(mail|contact|write|correo|courriel|kontakt)[^A-Za-z]*([a-z]+[^A-Za-z]+)?$",
    "ip": r"(?i)\b(ip|address|host|server|client|from)[^A-Za-z]*$",
    "card": r"(?i)\b(card|visa|mastercard|credit|karte|carte|tarjeta)[^A-Za-z]*([a-z]+[^A-Za-z]+)?$",
    "phone": r"(?i)\b(tel|phone|call|fax|mobile|cell|telefon|tel[eé]fono|t[eé]l[eé]phone)[^A-Za-z]*"
             r"([a-z]+[^A-Za-z]+)?$",
}
MISLEADING = r"(?i)\b(version|release|section|isbn|order|invoice|id|no|nr|sku|serial|part)[^A-Za-z]*$"
LABELERS = ("strict", "gazetteer", "cue", "misleading", "variety")
CONTEXT = 40
THRESHOLD = 0.9
EM_STEPS, FIT_STEPS = 30, 300


def _luhn(digits: str) -> str:
    """Luhn check of an expression of digits only."""
    return f"""(aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE
        WHEN i % 2 = 1 THEN cast(substr({digits}, length({digits}) - i + 1, 1) AS int)
        WHEN substr({digits}, length({digits}) - i + 1, 1) >= '5'
          THEN 2 * cast(substr({digits}, length({digits}) - i + 1, 1) AS int) - 9
        ELSE 2 * cast(substr({digits}, length({digits}) - i + 1, 1) AS int) END) % 10 = 0)"""


def _valid(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]+', '')"
    if kind == "ip":       # leading zeros do not count: compare by the significant digits
        part = "regexp_replace(p, '^0+(?=[0-9])', '')"
        return (f"forall(split({m}, '[.]'), p -> length({part}) <= 3 "
                f"AND cast(right({part}, 3) AS int) <= 255)")
    if kind == "card":
        return f"(length({digits}) BETWEEN 14 AND 19 AND CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {_luhn(digits)} ELSE false END)"
    if kind == "phone":
        return f"(length({digits}) BETWEEN 10 AND 15)"
    return "true"


def _strict(kind: str, m: str) -> str:
    """The vote of the strict form on a proposal."""
    digits = f"regexp_replace({m}, '[^0-9]+', '')"
    passes = {
        # blanks around a plain dot end a sentence rather than a label
        "email": f"{m} RLIKE '[A-Za-z]{{2,6}}$' AND NOT {m} RLIKE '[.] | [.]'",
        "ip": (f"contains({m}, ':') OR forall(filter(split({m}, '[^0-9]+'), p -> p <> ''), "
               "p -> cast(p AS int) <= 255)"),
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {_luhn(digits)} ELSE false END",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }
    return f"CASE WHEN {passes[kind]} THEN 1 ELSE -1 END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _step(name: str) -> str:
    return f"greatest(16, cast(sqrt(size({name})) AS int))"


def _located(kind: str, base: bool, n: str) -> str:
    m, before = "x.m", "x.b"
    votes = {
        "strict": "1" if base else _strict(kind, m),
        "gazetteer": f"CASE WHEN {m} RLIKE {_quoted(GAZETTEER[kind])} THEN 1 ELSE -1 END",
        "cue": f"CASE WHEN {before} RLIKE {_quoted(CUES[kind])} THEN 1 ELSE 0 END",
        "misleading": f"CASE WHEN {before} RLIKE {_quoted(MISLEADING)} THEN -1 ELSE 0 END",
        "variety": f"CASE WHEN size(array_distinct(split({m}, ''))) >= 5 THEN 1 ELSE -1 END",
    }
    fields = ", ".join(f"{votes[v]} AS {v}" for v in LABELERS)
    step = _step(n)
    return f"""transform(filter(
      transform({n}, (m, i) -> struct(m, right({n}_p[i], {CONTEXT}) AS b, length({n}_p[i])
        + aggregate(slice({n}_sum, 1, i div {step}), 0L, (a, z) -> a + z)
        + aggregate(slice({n}_len, (i div {step}) * {step} + 1, i % {step}), 0L, (a, z) -> a + z) AS s)),
      x -> {_valid(kind, m) if base else "true"}),
      x -> struct(x.s AS start, {KINDS.index(kind)} AS kind, x.s + length(x.m) AS end,
                  {str(base).lower()} AS base, {fields}))"""


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
               ) -> DataFrame:
    """doc_id and its candidates: array of (start, kind, end, base, votes), by start, kind
    (``carry``: and the whole row as ``row``)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = ["doc_id", "row"] if carry else ["doc_id"]
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *row, text.alias("text"))
    held = F.col("text")
    tried = ([(k, True, p, held.like(NEEDS[k]) if k in NEEDS else None) for k, p in BASE.items()]
             + [(k, False, p, held.rlike(WEAK_NEEDS[k]) if k in WEAK_NEEDS else None) for k, p in WEAK.items()])
    names = []
    none = F.array().cast("array<string>")
    for kind, base, pattern, needs in tried:
        name = f"{kind}_{'base' if base else 'weak'}"
        names.append((kind, base, name))
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(name, found if needs is None
                               else F.when(needs, found).otherwise(none))
    pieces = rows.select("*", *[
        F.when(F.size(n) > 0, F.split("text", pattern, -1)).otherwise(none).alias(f"{n}_p")
        for (_, _, n), (_, _, pattern, _) in zip(names, tried, strict=True)])
    lens = pieces.drop("text").select("*", *[
        F.expr(f"transform({n}, (y, j) -> cast(length(y) + length({n}_p[j]) AS bigint))").alias(f"{n}_len")
        for _, _, n in names])
    sums = lens.select("*", *[
        F.expr(f"""CASE WHEN size({n}) = 0 THEN array() ELSE transform(
            sequence(0, size({n}) div {_step(n)}), q -> aggregate(
              slice({n}_len, q * {_step(n)} + 1, {_step(n)}), 0L, (a, z) -> a + z)) END"""
               ).cast("array<bigint>").alias(f"{n}_sum") for _, _, n in names])
    spans = sums.select(*own, *[
        F.expr(f"CASE WHEN size({n}) = 0 THEN NULL ELSE {_located(k, b, n)} END").alias(n)
        for k, b, n in names])
    bases = [n for _, b, n in names if b]
    weak = [n for _, b, n in names if not b]

    def joined(cols: list[str]) -> str:
        return f"flatten(filter(array({', '.join(cols)}), c -> c IS NOT NULL))"
    both = spans.select(*own, F.expr(joined(bases)).alias("strong"), F.expr(joined(weak)).alias("soft"))
    return both.select(*own, F.expr("""array_sort(concat(strong, filter(soft, w ->
        NOT exists(strong, s -> s.start < w.end AND w.start < s.end))))""").alias("found"))


def estimate(patterns: list[tuple[int, tuple[int, ...], int]]) -> tuple[list[float], list[float]]:
    """(weights of the labelers, bias per kind) from (kind, votes, count) rows.

    Expectation-maximisation of a two-class model with votes independent given the
    class, started from the majority vote; then a logistic model fitted to the posteriors.
    """
    votes = (-1, 0, 1)
    posterior = [1 / (1 + math.exp(-sum(v))) for _, v, _ in patterns]
    for _ in range(EM_STEPS):
        prior = [[0.5, 0.5] for _ in KINDS]
        table = [[[0.5] * 3 for _ in LABELERS] for _ in range(2)]
        for (kind, v, n), p in zip(patterns, posterior, strict=True):
            for c, w in ((1, p * n), (0, (1 - p) * n)):
                prior[kind][c] += w
                for j, vote in enumerate(v):
                    table[c][j][vote + 1] += w
        for c in range(2):
            for j in range(len(LABELERS)):
                total = sum(table[c][j])
                table[c][j] = [x / total for x in table[c][j]]
        posterior = []
        for kind, v, _ in patterns:
            odds = math.log(prior[kind][1] / prior[kind][0]) + sum(
                math.log(table[1][j][votes.index(x)] / table[0][j][votes.index(x)]) for j, x in enumerate(v))
            posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    weights, bias = [0.0] * len(LABELERS), [0.0] * len(KINDS)
    total = float(sum(n for _, _, n in patterns))
    for _ in range(FIT_STEPS):
        grad_w, grad_b = [0.01 * w for w in weights], [0.01 * b for b in bias]
        for (kind, v, n), p in zip(patterns, posterior, strict=True):
            z = bias[kind] + sum(w * x for w, x in zip(weights, v, strict=True))
            miss = (1 / (1 + math.exp(-z)) - p) * n / total
            grad_b[kind] += miss
            for j, x in enumerate(v):
                grad_w[j] += miss * x
        weights = [w - g for w, g in zip(weights, grad_w, strict=True)]
        bias = [b - g for b, g in zip(bias, grad_b, strict=True)]
    return weights, bias


def train(found: DataFrame) -> tuple[list[float], list[float]]:
    """Vote patterns over all candidates of all documents, counted; then the estimate."""
    rows = (found.select(F.explode("found").alias("c")).groupBy("c.kind", *[f"c.{v}" for v in LABELERS])
            .agg(F.count("*").alias("n")).collect())          # <= kinds * 3 ** labelers rows
    return estimate(sorted((r["kind"], tuple(r[v] for v in LABELERS), r["n"]) for r in rows)
                    ) if rows else ([0.0] * len(LABELERS), [0.0] * len(KINDS))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``: array of (start, kind, end, base, probability), by start and kind."""
    found = stored(candidates(docs, id_col, text_col), "pii-candidates")
    return found.select("doc_id", _kept(*train(found)).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with every span of the text replaced by its kind in brackets.

    The classifier is trained on the candidates of all rows; a second pass over the texts
    finds and replaces the spans in place, so no text is joined or shuffled."""
    found = stored(candidates(docs, id_col, text_col), "pii-candidates")
    kept = _kept(*train(found))
    dropped(found)
    rows = candidates(docs, id_col, text_col, carry=True).select(
        "row", F.col("row")[text_col].cast("string").alias("text"), kept.alias("spans"))
    return rows.select(*[redacted().alias(c) if c == text_col else F.col("row")[c].alias(c)
                         for c in docs.columns])


def _kept(weights: list[float], bias: list[float]) -> Column:
    """The candidates that stay, with their probability."""
    z = " + ".join([f"element_at(array({', '.join(f'{b!r}D' for b in bias)}), c.kind + 1)"]
                   + [f"c.{v} * {w!r}D" for v, w in zip(LABELERS, weights, strict=True)])
    return F.expr(f"filter(transform(found, c -> struct(c.start AS start, c.kind AS kind, c.end AS end, "
                  f"c.base AS base, 1D / (1D + exp(-({z}))) AS probability)), "
                  f"c -> c.base OR c.probability >= {THRESHOLD})")


def redacted() -> Column:
    """Column ``text`` with every one of ``spans`` replaced by its kind in brackets; of
    overlapping spans the first one's kind stands for all."""
    kinds = f"array({', '.join(repr(k) for k in KINDS)})"
    return F.expr(f"""CASE WHEN text IS NULL OR spans IS NULL OR size(spans) = 0 THEN text ELSE
        aggregate(spans, struct('' AS done, 0L AS at), (a, s) -> CASE
            WHEN s.start < a.at THEN struct(a.done AS done, greatest(a.at, s.end) AS at)
            ELSE struct(concat(a.done, substr(text, cast(a.at AS int) + 1, cast(s.start - a.at AS int)), '[',
                        {kinds}[s.kind], ']') AS done, s.end AS at) END,
          a -> concat(a.done, substr(text, cast(a.at AS int) + 1))) END""")


def _listed(spans: str) -> str:
    kinds = f"array({', '.join(repr(k) for k in KINDS)})"
    return f"array_join(transform({spans}, s -> concat({kinds}[s.kind], ':', s.start, ':', s.end)), ',')"


def contract(found: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base AND s.kind = {k})) AS bigint)").alias(f"n_{name}")
              for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts,
                        F.sha2(F.expr(_listed("filter(spans, s -> s.base)")), 256).alias("base_sha256"),
                        F.expr(_listed("spans")).alias("spans"))
