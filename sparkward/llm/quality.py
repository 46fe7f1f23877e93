"""Quality by weak supervision, in built-in functions only.

Each rule votes keep (1), reject (-1) or abstains (0) on one measured feature.
Nobody labels anything: expectation-maximisation over the corpus's table of
vote patterns estimates how often each rule is right about good and about bad
documents, and a document is kept if its posterior probability of being good
is at least a half. With k rules the pattern table has at most 3**k rows at
any corpus size; the iterations run over it as one SQL expression, and k + k + 1
numbers come back as literals.

Repeated 8-word windows are found inside the row: word hashes are folded
pairwise three times into window hashes; only where the set of windows is
smaller than the list are they sorted and the covered words summed up. No text
is exploded or shuffled.

Defined cases: a null text has no words and fails the base rules; a null
doc_id is kept as it is; repeated rows are judged each; extra columns pass
through ``keep_good`` whatever their names and are ignored by ``judge``; on an
empty table the initial accuracies stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written
from .names import fresh

SPACES = r"[\x20\x09-\x0D]+"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_ended"]

#: rule -> (rejects if, keeps if), over the features; otherwise it abstains. Most junk is bad in one way and
#: ordinary in all others, so a rule that finds nothing wrong abstains; only three rules vote to keep.
RULES = {
    "length": ("n_words < 20", "false"),
    "word_length": ("word_chars < 2.2 * n_words or word_chars > 14 * n_words", "false"),
    "symbols": ("n_symbols > 0.15 * n_words", "n_symbols = 0"),
    "symbol_share": ("n_symbols > 0.05 * word_chars", "false"),
    "repeated_lines": ("n_dup_lines > 0.4 * n_lines", "false"),
    "repeated_windows": ("n_repeat_words > 0.3 * n_words", "false"),
    "capitals": ("n_upper > 0.5 * word_chars", "false"),
    "shouts": ("n_shouts > 0.2 * n_words", "false"),
    "line_ends": ("false", "n_ended >= 0.6 * n_lines"),
    "line_words": ("n_words < 2 * n_lines", "n_words >= 6 * n_lines"),
}
#: Rounds of expectation-maximisation; the share of good documents at first.
ROUNDS, GOOD = 40, 0.9
#: First, least and greatest probability that a rule rejects a good and a bad document. A rule need not see
#: most bad documents, but it may reject few good ones: that tells the two classes apart.
REJECTS_GOOD, REJECTS_BAD = (0.005, 0.0002, 0.01), (0.3, 0.01, 0.98)
#: The same for keeping one; whatever is left, at least ABSTAINS, is the probability that it abstains.
KEEPS, ABSTAINS = (0.5, 0.005, 0.98), 0.005


def _with_features(docs: DataFrame, own: str) -> DataFrame:
    """``docs`` with the features as columns named after ``own``."""
    o = own
    base = docs.withColumn(f"{o}t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = base.withColumn(f"{o}w", F.array_remove(F.split(f"{o}t", SPACES), ""))
    base = base.withColumn(f"{o}l", F.filter(F.split(f"{o}t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    sized = base.withColumns({
        f"{o}n_words": F.size(f"{o}w").cast("long"),
        f"{o}word_chars": F.length(F.array_join(f"{o}w", "")).cast("long"),
        f"{o}n_symbols": F.length(F.regexp_replace(f"{o}t", r"[^#*$%&|<>]+", "")).cast("long"),
        f"{o}n_upper": F.length(F.regexp_replace(f"{o}t", r"[^A-Z]+", "")).cast("long"),
        f"{o}n_shouts": F.length(F.regexp_replace(f"{o}t", r"[^!]+", "")).cast("long"),
        f"{o}n_lines": F.size(f"{o}l").cast("long"),
        f"{o}n_dup_lines": (F.size(f"{o}l") - F.size(F.array_distinct(f"{o}l"))).cast("long"),
        f"{o}n_ended": F.size(F.filter(f"{o}l", lambda x: x.rlike(r"[.!?:;\"')][\x20\x09-\x0D]*\z"))).cast("long"),
        f"{o}h": F.transform(f"{o}w", lambda x: F.xxhash64(x)),
    }).drop(f"{o}t", f"{o}w", f"{o}l")

    def fold(column: str, step: int) -> Column:
        n = f"greatest(size({column}) - {step}, 0)"
        return F.expr(f"zip_with(slice({column}, 1, {n}), slice({column}, {step + 1}, {n}), (a, b) -> xxhash64(a, b))")

    folded = sized.withColumn(f"{o}h", fold(f"{o}h", 1)).withColumn(f"{o}h", fold(f"{o}h", 2)).withColumn(f"{o}h", fold(f"{o}h", 4))
    # from here on only documents with a window found twice carry anything
    folded = folded.withColumn(f"{o}h", F.expr(f"case when size(array_distinct({o}h)) < size({o}h) then sort_array(transform({o}h, (h, i) -> struct(h, i))) end"))
    folded = folded.withColumn(f"{o}h", F.expr(
        f"sort_array(transform(filter({o}h, (x, i) -> (i > 0 and {o}h[greatest(i - 1, 0)].h = x.h) or (i < size({o}h) - 1 and {o}h[least(i + 1, size({o}h) - 1)].h = x.h)), x -> x.i))"
    ))
    covered = f"aggregate(zip_with(slice({o}h, 1, size({o}h) - 1), slice({o}h, 2, size({o}h) - 1), (a, b) -> least(8, b - a)), 8L, (s, x) -> s + x)"
    return folded.withColumn(f"{o}n_repeat_words", F.expr(f"case when {o}h is null then 0L else {covered} end")).drop(f"{o}h")


def _votes(prefix: str) -> Column:
    def one(rejects: str, keeps: str) -> str:
        return f"case when {rejects} then -1 when {keeps} then 1 else 0 end"

    text = "array(" + ", ".join(one(*r) for r in RULES.values()) + ")"
    for f in FEATURES:
        text = text.replace(f, f"`{prefix}{f}`")
    return F.expr(text)


def _likelihood(votes: str, rejects: str, keeps: str) -> str:
    pair = f"zip_with({rejects}, {keeps}, (r, k) -> struct(r, k))"
    return f"aggregate(zip_with({votes}, {pair}, (v, c) -> case v when -1 then c.r when 1 then c.k else greatest({ABSTAINS}D, 1 - c.r - c.k) end), 1D, (x, y) -> x * y)"


def fit(patterns: DataFrame) -> dict:
    """(votes, n) rows -> p, the share of good documents, and each rule's gr, gk, br, bk: probabilities to reject or keep good and bad ones."""
    k = len(RULES)
    start = {"gr": REJECTS_GOOD[0], "gk": KEEPS[0], "br": REJECTS_BAD[0], "bk": KEEPS[0]}

    def rate(share: str, vote: int, limits: tuple[float, float, float]) -> str:
        first, least, most = limits
        hit = f"aggregate(z.w, 0D, (x, q) -> x + case when q.votes[j] = {vote} then q.n * {share} else 0 end)"
        cast = f"aggregate(z.w, 0D, (x, q) -> x + q.n * {share})"
        return f"transform(sequence(0, {k - 1}), j -> least({most}D, greatest({least}D, ({hit} + 5 * {first}D) / ({cast} + 5))))"

    good = "s.p * " + _likelihood("q.votes", "s.gr", "s.gk")
    bad = "(1 - s.p) * " + _likelihood("q.votes", "s.br", "s.bk")
    weighed = f"transform(rows, q -> struct(q.votes as votes, q.n as n, {good} as g, {bad} as b))"
    weighed = f"transform({weighed}, q -> struct(q.votes as votes, q.n as n, q.g / (q.g + q.b) as y))"
    share = "least(0.99D, greatest(0.5D, aggregate(z.w, 0D, (x, q) -> x + q.n * q.y) / aggregate(z.w, 0D, (x, q) -> x + q.n)))"
    new = (
        f"struct({share} as p, {rate('q.y', -1, REJECTS_GOOD)} as gr, {rate('q.y', 1, KEEPS)} as gk, "
        f"{rate('(1 - q.y)', -1, REJECTS_BAD)} as br, {rate('(1 - q.y)', 1, KEEPS)} as bk)"
    )
    step = f"transform(array(struct({weighed} as w)), z -> {new})[0]"
    begin = f"struct({GOOD}D as p, " + ", ".join(f"array_repeat({v}D, {k}) as {n}" for n, v in start.items()) + ")"
    rows = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows")).where("size(rows) > 0")
    found = rows.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {begin}, (s, i) -> {step})").alias("s")).select("s.*").first()
    return found.asDict() if found else {"p": GOOD} | {n: [v] * k for n, v in start.items()}


def _posterior(votes: str, model: dict) -> Column:
    arrays = {n: "array(" + ", ".join(f"{x!r}D" for x in v) + ")" for n, v in model.items() if n != "p"}
    good = f"{model['p']!r}D * " + _likelihood(f"`{votes}`", arrays["gr"], arrays["gk"])
    bad = f"{1 - model['p']!r}D * " + _likelihood(f"`{votes}`", arrays["br"], arrays["bk"])
    return F.expr(f"({good}) / (({good}) + ({bad}))")


def _base_failed(prefix: str) -> Column:
    return F.expr(f"`{prefix}n_words` < 20 or 100 * `{prefix}n_repeat_words` > 30 * `{prefix}n_words`")


def _model(scored: DataFrame, own: str) -> dict:
    return fit(scored.groupBy(F.col(f"{own}votes").alias("votes")).agg(F.count("*").alias("n")))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the features, base_failed, posterior and kept, a row for each document."""
    own = "__quality_"
    scored = written(_with_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), own).drop("text").withColumn(f"{own}votes", _votes(own)))
    posterior = _posterior(f"{own}votes", _model(scored, own))
    return scored.withColumn("posterior", posterior).select(
        "doc_id", *[F.col(f"{own}{f}").alias(f) for f in FEATURES], _base_failed(own).alias("base_failed"), "posterior",
        (~_base_failed(own) & (F.col("posterior") >= 0.5)).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they came with; features are worked out twice rather than texts written."""
    own = fresh(docs, "quality")
    scored = _with_features(docs, own).withColumn(f"{own}votes", _votes(own))
    # the row number keeps Catalyst from copying the features' expressions into the filter, over and over
    scored = scored.withColumn(f"{own}row", F.monotonically_increasing_id())
    posterior = _posterior(f"{own}votes", _model(scored, own))
    good = (F.col(f"{own}row") >= 0) & ~_base_failed(own) & (posterior >= 0.5)
    return scored.where(good).select(*[F.col(f"`{c}`") for c in docs.columns])
