"""Learned decision list over text statistics, in DataFrame functions only.

The statistics of a text are native columns. Sequential covering learns the list from labelled documents: a rule is
grown by adding the threshold with the best information gain, pruned on held-back rows, and kept while it is precise;
the rows it covers are then set aside and the next rule is learned. Every step is one aggregation over the labelled
rows whose result has a fixed size (features x bins). The list becomes one ordered conditional expression.

Defined results: a null text counts as empty (no words, base rules fail); a document labelled several times takes its
lowest label; null labels and labels of unknown documents are ignored; without labelled rows of both kinds the list is
empty and only the base rules decide; repeated rows are judged one by one; other columns of the input stay untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import stored, words_of

SYMBOLS = "[#*$%&|<>]"
UPPER = "[A-ZÀ-ÖØ-Þ]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
FEATURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "shout_rate", "mean_word", "distinct_rate", "n_words")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text, the first place included."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, j: F.when(
            j < F.size(starts) - 1, F.least(F.lit(WINDOW), F.get(starts, j + 1) - p)).otherwise(F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

    def places(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = lambda j, k: F.get(ordered, j)["h"] == F.get(ordered, k)["h"]
        doubled = F.filter(ordered, lambda e, j: ((j > 0) & same(j, j - 1)) | ((j < last) & same(j, j + 1)))
        return F.sort_array(F.transform(doubled, lambda e: e["i"]))

    def of_windows(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(ordered, lambda o: let(places(o), covered)))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, of_windows))


def text_statistics(text: Column) -> Column:
    """Struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit("[^\\x20\\x09-\\x0D]")))
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.regexp_count(text, F.lit(UPPER)).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_shouts"),
    ))


def features(s: Column) -> dict[str, Column]:
    share = lambda part, whole: F.coalesce(F.try_divide(s[part].cast("double"), s[whole].cast("double")), F.lit(0.0))
    return {
        "symbol_rate": share("n_symbols", "n_words"), "dup_line_rate": share("n_dup_lines", "n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"), "upper_rate": share("n_upper", "word_chars"),
        "shout_rate": share("n_shouts", "n_words"), "mean_word": share("word_chars", "n_words"),
        "distinct_rate": share("n_distinct", "n_words"), "n_words": s["n_words"].cast("double"),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    found = F.lit(True)
    for condition in rule:
        found = found & condition.column()
    return found


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Features and label of at most ``sample`` labelled documents (those with the smallest hash of doc_id)."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_bad"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a top-k: bounded, so it may be broadcast
    kept = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        (F.col("_bad") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("held"), text_statistics(F.col("text")).alias("s"))
    # Stored before the filter, which the optimizer would push below the projection and so compute the statistics anew.
    rows = stored(kept, "quality-train").filter(~base_failed(F.col("s")))
    return rows.select("bad", "held", *[c.alias(n) for n, c in features(F.col("s")).items()]).coalesce(1)


def best_condition(rows: DataFrame, bins: dict[str, list[float]], least: int) -> tuple[Condition, float] | None:
    """The threshold with the highest gain for finding bad rows, from one aggregation of fixed size."""
    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.lit(bins[f]), lambda cut: cut < F.col(f)))

    placed = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in bins]))
    counts = rows.select("bad", placed.alias("x")).groupBy("x.f", "x.b").agg(
        F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    table = {(r["f"], r["b"]): (r["p"], r["n"]) for r in counts}
    best = None
    for f, cuts in bins.items():
        cells = [table.get((f, b), (0, 0)) for b in range(len(cuts) + 1)]
        pos, neg = sum(p for p, _ in cells), sum(n for _, n in cells)
        if not pos:
            return None
        low_p = low_n = 0
        for b, cut in enumerate(cuts):
            low_p, low_n = low_p + cells[b][0], low_n + cells[b][1]
            for above, p, n in ((True, pos - low_p, neg - low_n), (False, low_p, low_n)):
                if p >= least and (p + n) < pos + neg:
                    gain = p * (math.log2(p / (p + n)) - math.log2(pos / (pos + neg)))
                    if gain > 1e-9 and (best is None or gain > best[1] + 1e-9):
                        middle = (cut + cuts[b + 1]) / 2 if b + 1 < len(cuts) else cut  # halfway to the next seen cut
                        best = (Condition(f, above, middle), gain)
    return best


def learn_rules(
    docs: DataFrame, labels: DataFrame, sample: int = 10_000, bins: int = 24, max_rules: int = 6, max_conditions: int = 3,
    least: int = 8, precision: float = 0.97,
) -> list[Rule]:
    """Ordered rules that reject. At most ``sample`` labelled documents are used; a third of them only prunes."""
    rows = labelled_rows(docs, labels, sample)
    steps = [i / bins for i in range(1, bins)]
    probes = rows.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES],
                      *[F.percentile_approx(F.when(F.col("bad"), F.col(f)), steps, 10_000).alias(f"bad_{f}") for f in FEATURES]).first()
    if probes is None or probes[f"bad_{FEATURES[0]}"] is None:
        return []
    cuts = {f: sorted({float(v) for v in (*probes[f], *probes[f"bad_{f}"])}) for f in FEATURES}
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows
        for rule in rules:
            left = left.filter(~holds(rule))
        grow, rule = left.filter("NOT held"), ()
        while len(rule) < max_conditions and (found := best_condition(grow.filter(holds(rule)), cuts, least)):
            rule += (found[0],)
        if not rule:
            break
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        tested = left.filter("held").agg(*[x for k, head in enumerate(heads) for x in (
            F.count_if(holds(head) & F.col("bad")).alias(f"p{k}"), F.count_if(holds(head) & ~F.col("bad")).alias(f"n{k}"))]).first()
        scored = [((tested[f"p{k}"] + 1) / (tested[f"p{k}"] + tested[f"n{k}"] + 1), -k) for k in range(len(heads))]
        # Prune: the shortest head whose precision on held rows is (nearly) the best one.
        top = max(scored)[0]
        k = next(k for k in range(len(heads)) if scored[k][0] >= top - 0.002)
        if scored[k][0] < precision or tested[f"p{k}"] < 2:
            break
        rules.append(heads[k])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects, or null; expects the feature columns."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(holds(rule), F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None, **learning) -> DataFrame:
    """``docs`` with the struct ``quality_stats`` and the columns ``quality_base_failed``, ``quality_rule`` (the rule that
    rejects) and ``quality_kept``; columns of these names are replaced."""
    rules = learn_rules(docs, labels, **learning) if rules is None else rules
    own = [c for c in docs.columns if c not in ("quality_stats", "quality_base_failed", "quality_rule", "quality_kept")]
    rows = docs.select(F.struct(*own).alias("_row"), text_statistics(F.col("text")).alias("quality_stats"))
    s = F.col("quality_stats")
    with_features = rows.select("_row", "quality_stats", *[c.alias(n) for n, c in features(s).items()])
    judged = with_features.select("_row", "quality_stats", base_failed(s).alias("quality_base_failed"), verdict(rules).alias("quality_rule"))
    kept = ~F.col("quality_base_failed") & F.col("quality_rule").isNull()
    return judged.select("_row.*", "quality_stats", "quality_base_failed", "quality_rule", kept.alias("quality_kept"))
