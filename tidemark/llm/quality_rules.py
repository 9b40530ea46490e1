"""Quality rules: a decision list learned by sequential covering.

Statistics of every text are DataFrame expressions. Rules for the low class grow one
threshold at a time on a growing part of a labelled sample, are pruned on the rest, and are
emitted in order as one Spark conditional expression.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle, split_words

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct_words")


def with_statistics(docs: DataFrame, *, text_col: str = "text", window: int = 8) -> DataFrame:
    """``docs`` with a long column for each of STATISTICS, columns of these names being
    replaced. All count over the whole text; null counts as empty.

    ``n_repeat_words`` counts the words in windows of ``window`` words that occur at least
    twice in the text. Windows are compared by a 64-bit hash within one text. Cost is
    n log n in a text's words, with no quadratic step, and no shuffle.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() in STATISTICS])
    w, v, h, s, p, t = (fresh(c, base) for c in ("_words", "_hashes", "_windows", "_sorted", "_starts", "_text"))
    out = base.withColumn(t, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    out = out.withColumn(w, split_words(F.col(t)))
    n = F.size(w)
    # A slice would copy the whole array for each word; reading single elements doesn't.
    out = out.withColumn(v, F.transform(w, lambda x: F.xxhash64(x)))
    places = F.sequence(F.lit(0), n - window)
    out = out.withColumn(h, F.when(n >= window, F.transform(places, lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(window)]))))
    # Only texts in which a window comes back are sorted: by hash, then place.
    again = F.size(F.array_distinct(h)) < F.size(h)
    out = out.withColumn(s, F.when(again, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    out = out.withColumn(
        p,
        F.sort_array(
            F.transform(
                F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size = F.char_length(t)
    stats = {
        "n_words": n,
        "word_chars": F.char_length(F.array_join(w, "")),
        "n_symbols": size - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]+", "")),
        "n_dup_lines": F.when(F.contains(F.col(t), F.lit("\n")), F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_upper": size - F.char_length(F.regexp_replace(t, r"[A-Z]+", "")),
        "n_distinct_words": F.size(F.array_distinct(w)),
    }
    return settle(out, **{k: c.cast("long") for k, c in stats.items()}).drop(w, v, h, s, p, t)


def features() -> dict[str, Column]:
    """The ratios in which rules set thresholds, from the columns of STATISTICS."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    over = lambda c: F.round(F.col(c) / words, 6)
    return {
        "mean_word_chars": over("word_chars"),
        "symbols_per_word": over("n_symbols"),
        "dup_lines_per_word": over("n_dup_lines"),
        "repeat_ratio": over("n_repeat_words"),
        "upper_per_word": over("n_upper"),
        "distinct_ratio": over("n_distinct_words"),
    }


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold``, or ``feature < threshold`` if ``below``."""

    feature: str
    threshold: float
    below: bool

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] < self.threshold) == self.below

    def column(self, feats: dict[str, Column]) -> Column:
        c = feats[self.feature]
        return c < self.threshold if self.below else c >= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'<' if self.below else '>='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a text that one of them covers is rejected."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule_column(self) -> Column:
        """The first rule that fits, as text, else null: one conditional expression."""
        feats, out = features(), None
        for rule in self.rules:
            test = rule[0].column(feats)
            for c in rule[1:]:
                test = test & c.column(feats)
            label = F.lit(" and ".join(map(str, rule)))
            out = F.when(test, label) if out is None else out.when(test, label)
        return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


Row = tuple[dict[str, float], bool]


def _thresholds(rows: list[Row], names: list[str], n: int) -> dict[str, list[float]]:
    out = {}
    for f in names:
        values = sorted(r[f] for r, _ in rows)
        cuts = {values[min(len(values) - 1, k * len(values) // n)] for k in range(1, n)}
        bad = sorted(r[f] for r, low in rows if low)
        cuts |= {bad[min(len(bad) - 1, k * len(bad) // n)] for k in range(1, n)} if bad else set()
        out[f] = sorted(cuts)
    return out


def _grow(rows: list[Row], cuts: dict[str, list[float]], most: int) -> list[Condition]:
    """Add the condition of the largest information gain, until no good row is covered."""
    rule: list[Condition] = []
    while rows and len(rule) < most:
        p = sum(low for _, low in rows)
        q = len(rows) - p
        if not p or not q:
            break
        best, gain = None, 1e-9
        for f, at in cuts.items():
            bins = [[0, 0] for _ in range(len(at) + 1)]
            for r, low in rows:  # a row in bin k is at or over the first k thresholds
                v = r[f]
                k = bisect_left(at, v)
                bins[k + (k < len(at) and at[k] == v)][low] += 1
            goods = bads = 0
            for k, cut in enumerate(at):
                goods, bads = goods + bins[k][0], bads + bins[k][1]
                for below, (good, bad) in ((True, (goods, bads)), (False, (q - goods, p - bads))):
                    if bad:
                        g = bad * (math.log2(bad / (bad + good)) - math.log2(p / (p + q)))
                        if g > gain:
                            best, gain = Condition(f, cut, below), g
        if best is None:
            break
        rule.append(best)
        rows = [x for x in rows if best.holds(x[0])]
    return rule


def _counts(rule: list[Condition], rows: list[Row]) -> tuple[int, int]:
    hit = [low for r, low in rows if all(c.holds(r) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def learn(rows: list[Row], *, max_rules: int = 12, max_conditions: int = 3, cuts: int = 48, precision: float = 0.95, least: int = 3) -> DecisionList:
    """Sequential covering over (features, is low) rows.

    Two rows of three grow rules, the third prunes them: trailing conditions go while
    (p - n) / (p + n) on the pruning rows doesn't fall. A rule stays if at least ``least``
    low rows are under it and ``precision`` of all its rows are low. Without rows of both
    classes the list is empty and keeps everything.
    """
    rules: list[tuple[Condition, ...]] = []
    names = sorted(rows[0][0]) if rows else []
    left = rows
    while len(rules) < max_rules and any(low for _, low in left) and not all(low for _, low in left):
        grow, prune = [x for i, x in enumerate(left) if i % 3], left[::3]
        rule = _grow(grow, _thresholds(grow, names, cuts), max_conditions)
        if not rule:
            break

        def worth(k: int) -> float:
            p, n = _counts(rule[:k], prune)
            return (p - n) / (p + n) if p + n else -1.0

        best = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        rule = rule[:best]
        p, n = _counts(rule, left)
        if p < least or p < precision * (p + n):
            break
        rules.append(tuple(rule))
        left = [x for x in left if not all(c.holds(x[0]) for c in rule)]
    return DecisionList(tuple(rules))


def labelled_statistics(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> list[Row]:
    """Features and class (low: label 0) of a bounded sample of labelled documents.

    The sample is the ``max_labelled`` labels of least id hash; it bounds what is
    broadcast and what comes to the driver. Labels or ids that are null are left out;
    a document with two labels counts with each, up to that bound.
    """
    named = labels.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{label_col}`").alias("y")).dropna()
    picked = named.orderBy(F.xxhash64("d"), "d", "y").limit(max_labelled)
    text = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("text"))
    feats = features()
    some = with_statistics(text.join(F.broadcast(picked), "d")).select((F.col("y") == 0).alias("low"), "d", "n_words", *[c.alias(k) for k, c in feats.items()])
    got = some.where("n_words > 0").orderBy(F.xxhash64("d"), "d", *feats, "low").limit(max_labelled).collect()
    return [({k: float(r[k]) for k in feats}, bool(r["low"])) for r in got]


def apply_rules(docs: DataFrame, rules: DecisionList, *, text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """``docs`` with STATISTICS, ``base_failed`` (fewer than ``min_words`` words, or over
    ``max_repeat_percent`` percent of them in repeated windows), ``rule`` (the rule that
    rejects the text, else null) and ``kept``. Columns of these names are replaced.

    A null or empty text fails the base rules. Rows, repeated ones too, are judged one by
    one; an empty table gives an empty table.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("base_failed", "rule", "kept")])
    out = with_statistics(docs, text_col=text_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "rule": rules.rule_column()}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


__all__ = ["STATISTICS", "Condition", "DecisionList", "apply_rules", "features", "labelled_statistics", "learn", "with_statistics"]
