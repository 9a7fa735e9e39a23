"""Quality rules: base heuristics plus a learned decision list.

Everything is DataFrame expressions.  Per document a handful of counts are
computed inside the row (no explode, no shuffle).  The decision list is
learned by sequential covering from the labelled rows: conditions
``feature <= t`` or ``feature > t`` are added to a conjunction while they raise
the precision on a growing set, the conjunction is pruned on a separate
pruning set, the documents it covers are set aside, and the next rule is
learned on the rest.  Only per-bin label counts reach the driver: thresholds
are quantiles, so one round of growing is one grouped count of at most
``features * bins`` rows, whatever the number of documents.  The result is
an ordered list of conjunctions that becomes one ``CASE WHEN`` expression.

A rule rejects documents; a document no rule covers is kept.  A rule is
accepted only if its precision on the pruning set reaches ``min_precision``
on at least ``min_cover`` documents.

Edge cases: null text counts as empty; null or missing labels do not train;
null ids join no label; repeated label rows count each; without usable labels
the list is empty and only the base rules decide; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecount.llm.common import bare_words, keyed_text, let, same_row, text_hash

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits"]


def repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more."""

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))

    def covered(w: Column) -> Column:
        """Sum over flagged starts of the distance to the next one, at most a window."""

        def flagged(s: Column) -> Column:
            def same(k: Column) -> Column:
                h = F.get(s, k)["h"]
                return F.coalesce(h == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(
                    h == F.get(s, k + 1)["h"], F.lit(False)
                )

            at = F.sequence(F.lit(0), F.size(s) - 1)
            return F.sort_array(F.transform(F.filter(at, same), lambda k: F.get(s, k)["i"]))

        paired = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        starts = let(F.sort_array(paired), flagged)
        return let(
            starts,
            lambda p: F.aggregate(
                F.sequence(F.lit(0), F.size(p) - 1),
                F.lit(0),
                lambda a, k: a + F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW))),
            ),
        )

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(let(hashes, windows), count)).otherwise(F.lit(0)).cast("long")


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash`` and the counts of ``COUNTS`` for every row."""
    words, lines = F.col("words"), F.col("lines")
    split = keyed_text(docs, id_col, text_col).select(
        "id", "text", bare_words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return split.select(
        "id", text_hash(F.col("text")).alias("text_hash"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("n_digits"),
    )


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def feature_columns() -> dict[str, Column]:
    """What the learner may set thresholds on."""
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "distinct_share": _share("n_distinct", "n_words"),
        "digit_share": _share("n_digits", "word_chars"),
    }


def base_failed() -> Column:
    """Too short, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold


def condition(c: Condition) -> Column:
    value = feature_columns()[c[0]]
    return value <= c[2] if c[1] == "<=" else value > c[2]


def conjunction(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & condition(c)
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """Kept or not, as one ordered conditional expression; first match decides."""
    out = None
    for rule in rules:
        out = F.when(conjunction(rule), False) if out is None else out.when(conjunction(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _precision(bad: float, good: float, prior: float) -> float:
    """Laplace-style estimate pulled towards the prior by two documents."""
    return (bad + 2 * prior) / (bad + good + 2)


def learn_rules(
    labelled: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 4,
    min_precision: float = 0.95, min_cover: int = 10,
) -> list[list[Condition]]:
    """Sequential covering over ``labelled``: columns of ``COUNTS``, ``bad``
    (0/1) and ``grow`` (boolean: growing or pruning set).

    Thresholds are quantiles of all rows and of the bad ones, so a small bad kind
    in one tail has thresholds of its own.  What a rule covers that fails on the
    pruning set is set aside, and the next rule grows from the other rows; its
    precision counts the rows set aside, since the list will meet them too."""
    names = list(feature_columns())
    probs = [i / bins for i in range(1, bins)]
    cuts = labelled.select([
        F.percentile_approx(F.when(F.col("bad") >= least, c), probs, 10000).alias(f"{n}_{least}")
        for n, c in feature_columns().items() for least in (0, 1)
    ]).first()
    cuts = {n: sorted(set(cuts[f"{n}_0"] or []) | set(cuts[f"{n}_1"] or [])) for n in names}

    def bin_of(name: str) -> Column:
        """Number of thresholds below the value: value <= cuts[b] iff bin <= b."""
        value, out = feature_columns()[name], F.lit(0)
        for t in cuts[name]:
            out = out + F.when(value > t, 1).otherwise(0)
        return out

    def counts_by_bin(rows: DataFrame) -> dict[str, list[list[int]]]:
        pairs = F.explode(F.array(*[
            F.struct(F.lit(n).alias("f"), F.col("b_" + n).alias("b")) for n in names
        ])).alias("p")
        got = rows.select(pairs, "bad", "n").groupBy("p.f", "p.b", "bad").agg(F.sum("n").alias("n")).collect()
        table = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
        for r in got:
            table[r.f][r.b][r.bad] += r.n
        return table

    def holds(rule) -> Column:
        out = F.lit(True)
        for name, op, b in rule:
            out = out & (F.col("b_" + name) <= b if op == "<=" else F.col("b_" + name) > b)
        return out

    def middle(name: str, cut: float) -> float:
        """Halfway between the values on the two sides of a threshold."""
        value = feature_columns()[name]
        low, high = labelled.agg(F.max(F.when(value <= cut, value)), F.min(F.when(value > cut, value))).first()
        return float(cut if low is None or high is None else (low + high) / 2)

    # documents that fall into the same bins everywhere are one weighted row
    rest = (
        labelled.select("bad", "grow", *[bin_of(n).alias("b_" + n) for n in names])
        .groupBy("bad", "grow", *["b_" + n for n in names]).agg(F.count("*").alias("n")).checkpoint()
    )
    rules = []
    untried = rest.where("grow")
    for _ in range(2 * max_rules):
        rule, best_score = [], None
        while len(rule) < max_conditions:
            table = counts_by_bin(untried.where(holds(rule)))
            good, bad = (sum(t[i] for t in table[names[0]]) for i in (0, 1))
            if not bad or not good:
                break
            prior = bad / (bad + good)
            if best_score is None:
                best_score = prior
            found = None
            for name in names:
                below = [0, 0]
                for b, (g, x) in enumerate(table[name][:-1]):
                    below = [below[0] + g, below[1] + x]
                    for op, (cg, cx) in (("<=", below), (">", [good - below[0], bad - below[1]])):
                        if cx < min_cover:
                            continue
                        score = _precision(cx, cg, prior)
                        # the most precise condition; the estimate already favours coverage
                        if score > best_score + 1e-9 and (found is None or (score, cx) > found[0]):
                            found = ((score, cx), score, (name, op, b))
            if found is None:
                break
            best_score = found[1]
            rule.append(found[2])
        if not rule:
            break
        # prune: the shortest prefix that is as precise as any on the pruning set
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        sums = [
            F.coalesce(F.sum(F.when(holds(p) & (F.col("bad") == v), F.col("n"))), F.lit(0)).alias(f"s{i}_{v}")
            for i, p in enumerate(prefixes) for v in (0, 1)
        ]
        got = rest.where(~F.col("grow")).select(*sums).first()
        scored = [(got[f"s{i}_1"] / max(1, got[f"s{i}_0"] + got[f"s{i}_1"]), -i) for i in range(len(prefixes))]
        precision, at = max(scored)
        if precision < min_precision or got[f"s{-at}_1"] < min_cover:
            untried = untried.where(~holds(rule))
            continue
        rule = prefixes[-at]
        rules.append([(n, op, middle(n, cuts[n][b])) for n, op, b in rule])
        if len(rules) == max_rules:
            break
        rest, untried = rest.where(~holds(rule)), untried.where(~holds(rule))
    return rules


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
    **learning,
) -> DataFrame:
    """``id, text_hash``, ``COUNTS``, ``base_failed``, ``kept`` for every row of
    ``docs``."""
    counts = document_counts(docs, id_col, text_col).checkpoint()
    marks = labels.select(labels[id_col].cast("long").alias("id"), labels[quality_col].alias("q")).where("q in (0, 1)")
    labelled = (
        counts.where(~base_failed()).join(marks, "id")
        .withColumn("bad", 1 - F.col("q").cast("int"))
        .withColumn("grow", F.pmod(F.xxhash64("id"), F.lit(3)) != 0)
    )
    rules = learn_rules(labelled, **learning)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def passing(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
    **learning,
) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    judged = judge(docs, labels, id_col, text_col, quality_col, **learning)
    keep = judged.where("kept").select("id", "text_hash").distinct()
    return docs.join(keep.hint("shuffle_hash"), same_row(docs, id_col, text_col, keep), "left_semi")


def op8(spark, sf_dir):
    from grovecount.sources.tables import read_table

    out = judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )
