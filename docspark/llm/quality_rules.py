"""Quality rules as weak supervision (operator 9): rules vote or abstain, EM weighs them.

Counts come from whole texts with built-in functions only. Seven rules vote bad (0), good
(2) or abstain (1); some read the same faults, so their agreement tells how far each is to be trusted. Documents are
counted by vote pattern (at most 3**7 rows, whatever the corpus). Expectation-maximisation over these counts estimates the share of good
documents and, for each rule, how often it votes bad on bad and on good documents when it votes; a rule is held to be no
worse than chance, each rate has one pseudo-document of either vote, and of several starts the likeliest end counts. A document is kept
when its posterior probability of being good is at least `threshold` and the base rule does not reject it. A single
bad vote of a rule that seldom agrees with the others does not reject.

Null and empty texts have no words and are rejected by the base rule. Every input row gives one row, repeated ones too; null ids stay null;
texts may have any length; other columns are ignored, whatever their names. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.plans.storage import written

from .common import WORD, column, word_array

RULES = ("length", "word_length", "symbols", "repetition", "shouting", "marks", "variety")
ROUNDS = 50
WINDOW = 8
#: A character that is no letter, digit or usual punctuation.
ODD_MARK = r"[^\p{L}\p{M}\p{N}_.,;:'\"()\-\u2010-\u2015\u2018-\u201f\u2026\u00ab\u00bb?\u00bf\u00a1]"


def _repeat_words(windows: Column) -> Column:
    """Words under the windows whose hash occurs twice or more: sort, keep equal neighbours, add up."""
    dealt = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda j: F.coalesce(F.get(s, j)["h"] == F.get(s, j + F.lit(1))["h"], F.lit(False))
        starts = F.array_sort(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j) | F.coalesce(F.get(s, j - F.lit(1))["h"] == F.get(s, j)["h"], F.lit(False))),
                lambda j: F.get(s, j)["i"],
            )
        )
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    return F.get(F.transform(F.array(dealt), covered), F.lit(0))


def features(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """The base counts of each row, and those that the other rules read; with `whole_rows`, the row as struct `row`."""
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * whole_rows
    d = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"), *row)
    d = d.withColumn("words", word_array(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    # Hashes of 8 words by doubling: 2, then 4, then 8 in a row.
    d = d.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        d = d.withColumn("h", F.when(F.col("n_words") >= WINDOW, F.zip_with("h", F.slice("h", F.lit(step + 1), F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b))))
    d = d.withColumn("windows", F.slice("h", F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))))
    only = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]+", "")).cast("long")
    return d.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeat_words(F.col("windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        only(r"\p{Lu}").alias("n_capitals"),
        only("!").alias("n_exclaims"),
        F.size(F.filter("words", lambda w: w.rlike(ODD_MARK))).cast("long").alias("n_marked"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        *["row"] * whole_rows,
    )


def votes() -> Column:
    """Array of one vote a rule: 0 bad, 1 abstains, 2 good."""
    words = F.greatest(F.col("n_words"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 2).otherwise(1)

    length = F.col("word_chars") / words
    return F.array(
        vote(F.col("n_words") < 30, F.col("n_words") >= 60),
        vote((length < 2.5) | (length > 14), length.between(3.5, 10)),
        vote(10 * F.col("n_symbols") > words, 50 * F.col("n_symbols") <= words),
        vote((100 * F.col("n_repeat_words") > 25 * words) | ((2 * F.col("n_dup_lines") > F.col("n_lines")) & (F.col("n_dup_lines") >= 3)), 100 * F.col("n_repeat_words") <= 5 * words),
        vote((2 * F.col("n_capitals") > F.col("word_chars")) | (10 * F.col("n_exclaims") > 3 * words), 4 * F.col("n_capitals") <= F.col("word_chars")),
        vote(4 * F.col("n_marked") > words, 20 * F.col("n_marked") <= words),
        vote((F.col("n_words") >= 20) & (4 * F.col("n_distinct") < words), (2 * F.col("n_distinct") >= words) | ((F.col("n_words") >= 400) & (4 * F.col("n_distinct") >= words))),
    )


def fitted(seen: DataFrame, rounds: int = ROUNDS, rules: int = len(RULES)) -> DataFrame:
    """One row (likelihood, prior, rules): log odds of good, and for each rule its rates and the log odds of its votes.

    seen(votes): the patterns, at most 3**rules, go with their counts into one array, and all rounds of
    expectation-maximisation run in one expression over it.
    """
    one = seen.groupBy("votes").agg(F.count("*").cast("double").alias("c")).agg(F.array_sort(F.collect_list(F.struct("votes", "c"))).alias("p"))
    one = one.withColumn("total", F.expr("aggregate(p, 1e-9D, (a, x) -> a + x.c)"))
    n_bad, n_good = (f"size(filter(x.votes, v -> v = {v}))" for v in (0, 2))
    starts = f"""array(transform(p, x -> IF({n_bad} > 0, 0.2D, 0.95D)), transform(p, x -> ({n_good} + 0.5D) / ({n_bad} + {n_good} + 1D)),
        transform(p, x -> IF({n_bad} >= {n_good}, 0.1D, 0.9D)))"""
    # How many good (g) and bad (b) documents a rule votes bad (b) or good (g) on.
    votes_ = """aggregate(zip_with(p, q, (x, y) -> named_struct('v', x.votes[r], 'b', x.c * (1 - y), 'g', x.c * y)),
        named_struct('bb', 0D, 'bg', 0D, 'gb', 0D, 'gg', 0D), (a, t) -> named_struct('bb', a.bb + IF(t.v = 0, t.b, 0D), 'bg', a.bg + IF(t.v = 2, t.b, 0D),
        'gb', a.gb + IF(t.v = 0, t.g, 0D), 'gg', a.gg + IF(t.v = 2, t.g, 0D)))"""
    rates = """transform(array(s), n -> transform(array((n.bb + n.gb + 1) / (n.bb + n.bg + n.gb + n.gg + 2)), m -> named_struct(
        'bad', greatest((n.bb + 1) / (n.bb + n.bg + 2), m), 'good', least((n.gb + 1) / (n.gb + n.gg + 2), m)))[0])[0]"""
    rule = f"transform(array({votes_}), s -> {rates})[0]"
    odds = "transform(array({}), e -> named_struct('bad', e.bad, 'good', e.good, 'weights', array(ln(e.good / e.bad), 0D, ln((1 - e.good) / (1 - e.bad))), 'own', array(ln(e.bad), 0D, ln(1 - e.bad))))[0]"
    model = f"""transform(array(aggregate(zip_with(p, q, (x, y) -> x.c * y), 0D, (a, y) -> a + y)), g -> named_struct(
        'good', (g + 1) / (total + 2), 'rules', transform(sequence(0, {rules - 1}), r -> {odds.format(rule)})))[0]"""
    of = f"ln(m.good / (1 - m.good)) + aggregate(sequence(0, {rules - 1}), 0D, (a, r) -> a + m.rules[r].weights[x.votes[r]])"
    step = f"transform(array({model}), m -> transform(p, x -> 1 / (1 + exp(-({of})))))[0]"
    own = f"ln(1 - m.good) + aggregate(sequence(0, {rules - 1}), 0D, (a, r) -> a + m.rules[r].own[x.votes[r]])"
    likelihood = f"aggregate(transform(p, x -> x.c * ({own} + ln(1 + exp({of})))), 0D, (a, y) -> a + y)"
    ends = f"transform({starts}, s0 -> aggregate(sequence(1, {rounds}), s0, (q, i) -> {step}))"
    return one.selectExpr("p", "total", f"{ends} AS ends").selectExpr("p", f"transform(ends, q -> {model}) AS models").selectExpr(
        f"array_max(transform(models, m -> named_struct('likelihood', {likelihood}, 'prior', ln(m.good / (1 - m.good)), 'rules', m.rules))) AS m"
    ).select("m.*")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _judged(marked: DataFrame, model: DataFrame, threshold: float) -> DataFrame:
    """marked (features and votes) with base_failed, posterior and kept."""
    odds = F.col("m")["prior"] + F.aggregate(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), F.lit(0.0), lambda a, r: a + F.get(F.get(F.col("m")["rules"], r)["weights"], F.get(F.col("votes"), r)))
    d = marked.withColumn("m", model.select(F.struct("prior", "rules")).scalar()).withColumn("base_failed", base_failed()).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and posterior, one row a document."""
    seen = written(features(docs).withColumn("votes", votes()), "features")
    return _judged(seen, fitted(seen), threshold).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior")
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept. Rows that the base rule lets pass are written once beside their counts, and never shuffled."""
    row = F.when(~base_failed(), F.col("row")).alias("row")
    seen = written(features(docs, True).withColumn("votes", votes()).select("n_words", "n_repeat_words", "votes", row), "features")
    return _judged(seen, fitted(seen), threshold).where("kept").select("row.*")
