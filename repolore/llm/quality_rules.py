"""Quality rules: statistics of whole texts, and decision lists learned from labelled documents, in DataFrame functions only.

``statistics`` gives a row per document. ``learn`` fits an ordered list of threshold conjunctions for rejected documents by
sequential covering: a rule grows by the condition with the highest information gain on two thirds of the labelled cells, is pruned on
the other third, and covers its cells for the rules after it. ``verdict`` turns the list into one conditional expression.

Labelled documents are sampled down to ``sample`` rows by hash (a documented bound, as for any classifier here); their
statistics are cut at quantiles, and equal cells are counted together by Spark. The driver sees at most ``sample`` cell counts.
Without usable labels the list is empty and keeps everything. A document with several labels counts as bad if one says so.

Null and empty texts have no words, so they fail the base rule. Repeated rows and null ids pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolore.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Holds the caller's columns while statistics are worked out.
ROW = "row\x01"

#: Ratios that rules may test; all are defined for texts without words.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "shouts_per_word": "n_shouts / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts, n_upper and FEATURES.

    ``n_repeat_words`` counts words inside five-word windows found twice in the text: hashes of the windows are compared as a
    set first; only texts with a repeat sort them and merge the places. Columns of ``docs`` keep their values, but for those that have
    the name of a statistic, which are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = docs.select(row.alias(ROW), text.alias("_text")).withColumn("_trim", F.btrim("_text", F.lit(SPACE)))
    df = df.withColumn("_w", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", GAP)))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("_lines", lines)
    width = 5
    hashes = F.expr(f"transform(sequence(0, size(_w) - {width}), i -> xxhash64({', '.join(f'_w[i + {k}]' for k in range(width))}))")
    df = df.withColumn("_h", F.when(F.col("n_words") > width, hashes))
    df = df.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.expr("transform(_h, (x, i) -> struct(x as h, i as i))"))))
    again = "(k > 0 and _p[k - 1].h = x.h) or (k < size(_p) - 1 and _p[k + 1].h = x.h)"
    df = df.withColumn("_q", F.when(F.col("_p").isNotNull(), F.sort_array(F.expr(f"filter(transform(_p, (x, k) -> if({again}, x.i, -1)), v -> v >= 0)"))))
    covered = F.expr(f"aggregate(transform(_q, (x, k) -> if(k < size(_q) - 1, least({width}, _q[k + 1] - x), {width})), 0, (a, x) -> a + x)")
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.withColumn("word_chars", _without(F.col("_text"), SPACE).cast("long"))
    df = df.withColumn("n_symbols", (F.length("_text") - _without(F.col("_text"), SYMBOLS)).cast("long"))
    df = df.withColumn("n_shouts", (F.length("_text") - _without(F.col("_text"), "!")).cast("long"))
    df = df.withColumn("n_upper", F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long"))
    df = df.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # a generator, so that filters on the statistics stay above them instead of repeating their expressions
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_upper"]
    own = [F.col(f"`{ROW}`.`{c}`").alias(c) for c in docs.columns if c not in names and c not in FEATURES]
    df = df.select(*own, F.inline(F.array(F.struct(*names))))
    return df.withColumns({name: F.expr(rule).cast("double") for name, rule in FEATURES.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _cells(docs: DataFrame, labels: DataFrame, sample: int, bins: int) -> tuple[list, dict[str, list[float]]]:
    """Counts of (bad, part) by cell, and each feature's thresholds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    lot = known.withColumn("lot", F.xxhash64("doc_id", F.lit(17)))
    lot = cut_lineage(lot.orderBy("lot", "doc_id").limit(sample))  # at most ``sample`` narrow rows, so the join may broadcast them
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lot), "doc_id")
    seen = cut_lineage(statistics(picked).filter(~base_failed()).select("quality", (F.pmod("lot", F.lit(3)) == 0).alias("prune"), *FEATURES))
    fractions = [i / bins for i in range(1, bins)]
    at = seen.agg(*[F.percentile_approx(f, fractions, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(at[f] or ())) for f in FEATURES}
    number = {f: sum((F.when(F.col(f) > t, 1).otherwise(0) for t in c), F.lit(0)) for f, c in cuts.items()}
    cells = seen.groupBy(*[n.alias(f) for f, n in number.items()]).agg(
        *[F.count_if(((F.col("quality") == 0) if bad else (F.col("quality") != 0)) & (F.col("prune") == prune)).alias(f"n{int(bad)}{int(prune)}") for bad in (True, False) for prune in (False, True)]
    )
    return cells.collect(), cuts


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, bins: int = 24, precision: float = 0.97, most_rules: int = 12) -> list[list[Condition]]:
    """Ordered rules for documents to reject (``quality`` 0 in ``labels``), each a conjunction."""
    cells, cuts = _cells(docs, labels, sample, bins)
    tests = [(f, above, i) for f in FEATURES for above in (True, False) for i in range(len(cuts[f]))]
    holds = lambda c, t: (c[t[0]] > t[2]) == t[1]  # noqa: E731  bin number above i: value above cut i
    count = lambda rows, kind: (sum(c[f"n1{kind}"] for c in rows), sum(c[f"n0{kind}"] for c in rows))
    rules = []
    while len(rules) < most_rules:
        body, rows = [], cells
        p0, n0 = count(rows, 0)
        p, n = p0, n0
        while p and n and len(body) < 4:
            best = max(tests, key=lambda t: (_gain(p, n, *count([c for c in rows if holds(c, t)], 0))), default=None)
            after = [c for c in rows if best and holds(c, best)]
            if best is None or _gain(p, n, *count(after, 0)) <= 0:
                break
            body.append(best)
            rows = after
            p, n = count(rows, 0)

        def worth(k, body=body):
            good, wrong = count([c for c in cells if all(holds(c, t) for t in body[:k])], 1)
            return (good - wrong) / (good + wrong) if good + wrong else -1.0

        if not body:
            break
        body = body[: max(range(1, len(body) + 1), key=lambda k: (worth(k), -k))]
        covered = [c for c in cells if all(holds(c, t) for t in body)]
        good, wrong = (x + y for x, y in zip(count(covered, 0), count(covered, 1), strict=True))
        if not good or good < precision * (good + wrong) or good < 3:
            break
        rules.append([Condition(f, above, cuts[f][i]) for f, above, i in body])
        cells = [c for c in cells if not all(holds(c, t) for t in body)]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Whether the list keeps a document: the first rule that fits rejects it."""
    out = None
    for body in rules:
        fits = body[0].column()
        for c in body[1:]:
            fits = fits & c.column()
        out = F.when(fits, F.lit(False)) if out is None else out.when(fits, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with their statistics, ``base_failed`` and ``kept``."""
    rules = learn(docs, labels, **options)
    seen = statistics(docs).withColumn("base_failed", base_failed())
    return seen.withColumn("kept", ~F.col("base_failed") & verdict(rules))
