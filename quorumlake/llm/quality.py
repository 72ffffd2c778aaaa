"""Quality rules with risk-controlled thresholds [native].

Every document gets exact base counts and a junk score in [0, 1].  Per stratum (language) the
rejection cutoff is chosen on labelled holdout documents: a cutoff is admissible when the exact
binomial (Clopper-Pearson) test rejects "more than ``alpha`` of the good documents score at or
above it" at level ``delta / (strata * cutoffs)`` (Bonferroni), and the smallest admissible cutoff
is used.  The score is fixed in advance and not fitted, so all labelled rows serve as the holdout.
A stratum that certifies no cutoff of its own rejects nothing beyond the base rule: the cutoff of
the pooled stratum bounds rejections over all languages together, not within one.

The guarantee is on the cutoff: with confidence 1 - ``delta``, over all strata together, at most ``alpha``
of the good documents that pass the base rule are rejected by it.  The base rule is fixed and has no
such bound; what it rejects of the good documents comes on top (``rejections`` tells both apart).

Defined cases: null or empty text has zero words and fails the base rule; a null language is a
stratum of its own; labels with null ids or null quality are ignored; several labels for one id
count once, as bad if any says so; an empty label table rejects nothing beyond the base rule; an
empty document table gives an empty result; repeated rows are each judged alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, materialize, small_side, text_of, words_of

BASE_MIN_WORDS = 20
BASE_MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Candidate cutoffs of the junk score.
CUTOFFS = tuple(i / 20 for i in range(4, 20))
#: Strata beyond this many are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_STRATA = 10_000
POOLED = "*"


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in the text."""

    def starts(p: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(p, at)["h"] == x["h"], F.lit(False))
        marked = F.transform(p, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda s: s.isNotNull()))

    # Each start adds the words up to the next start, WINDOW at most; the last one adds WINDOW.
    first = lambda s: F.struct(F.lit(WINDOW).alias("n"), s.alias("at"))
    more = lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["at"])).alias("n"), s.alias("at"))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("at"))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(let(pairs, starts), nothing, lambda acc, s: F.when(acc["at"].isNull(), first(s)).otherwise(more(acc, s)), lambda acc: acc["n"])

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(n <= WINDOW, 0).otherwise(let(words, of)).cast("long")


def with_features(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the base counts and the junk score; column names take ``prefix``."""
    p = prefix
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    df = docs.withColumns({f"{p}w": words_of(text), f"{p}l": lines})
    df = df.withColumns({
        f"{p}n_words": F.size(f"{p}w").cast("long"),
        f"{p}word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        f"{p}n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        f"{p}n_upper": (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long"),
        f"{p}n_bangs": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
        f"{p}n_lines": F.size(f"{p}l").cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long"),
        f"{p}n_repeat_words": _repeat_words(F.col(f"{p}w"), F.size(f"{p}w")),
    })
    c = lambda name: F.col(f"{p}{name}")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    part = lambda x, scale: F.lit(1.0) - F.least(x / scale, F.lit(1.0))
    clean = part(share(c("n_symbols"), c("word_chars")), 0.25) * part(F.greatest(share(c("n_upper"), c("word_chars")) - 0.15, F.lit(0.0)), 0.6) * part(share(c("n_bangs"), c("n_words")), 0.6) * part(share(c("n_dup_lines"), c("n_lines")), 0.75) * part(share(c("n_repeat_words"), c("n_words")), 0.5)
    failed = (c("n_words") < BASE_MIN_WORDS) | (100 * c("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * c("n_words"))
    return df.withColumns({f"{p}score": F.lit(1.0) - clean, f"{p}base_failed": failed}).drop(f"{p}w", f"{p}l", f"{p}n_upper", f"{p}n_bangs", f"{p}n_lines")


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact; terms below the smallest double count as 0."""
    odds = F.lit(p / (1 - p))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i * odds)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    return F.when(k < 1, start["s"]).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step, lambda acc: acc["s"]))


def risk_controlled_cutoffs(scored: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, cutoff) from labelled rows (stratum, score, good); strata that certify nothing are absent.

    The rows that reach one task are at most one per stratum and cutoff: counts are taken before.
    """
    both = F.explode(F.array(F.coalesce("stratum", F.lit("")), F.lit(POOLED)))
    grid = F.array(*[F.lit(c) for c in CUTOFFS])
    # one row per stratum and number of cutoffs reached
    reached = F.size(F.filter(grid, lambda c: c <= F.col("score")))
    good = scored.where("good").select(both.alias("stratum"), reached.alias("reached")).groupBy("stratum", "reached").agg(F.count("*").alias("n"))
    counted = good.groupBy("stratum").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("reached") > i, F.col("n")).otherwise(0)).alias(f"k{i}") for i in range(len(CUTOFFS))])
    strata = counted.agg(F.count("*").alias("strata"))
    tests = counted.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata", F.posexplode(F.array(*[F.col(f"k{i}") for i in range(len(CUTOFFS))])).alias("i", "k"))
    tests = tests.where(F.col("k") <= F.col("n") * alpha)  # above its mean the test never rejects
    passed = tests.where(binomial_cdf(F.col("n"), F.col("k"), alpha) <= F.lit(delta) / (F.col("strata") * len(CUTOFFS)))
    return passed.groupBy("stratum").agg(F.min(F.get(grid, F.col("i"))).alias("cutoff"))


def calibrate(features: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Cutoffs per stratum from ``features`` (doc_id, stratum, score, base_failed) and ``labels`` (doc_id, quality)."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    scored = features.where(~F.col("base_failed")).select("doc_id", "stratum", "score").join(marks, "doc_id")
    return materialize(risk_controlled_cutoffs(scored, alpha, delta), "quality-cutoffs")


def with_verdict(features: DataFrame, cutoffs: DataFrame, stratum: str, score: str, failed: str, out: str) -> DataFrame:
    """``features`` plus the boolean ``out``: not failed and below the stratum's cutoff."""
    own = small_side(cutoffs.where(F.col("stratum") != POOLED).select(F.col("stratum").alias("__stratum"), F.col("cutoff").alias("__cutoff")), MAX_BROADCAST_STRATA)
    df = features.join(own, F.coalesce(stratum, F.lit("")) == F.col("__stratum"), "left")
    limit = F.coalesce("__cutoff", F.lit(2.0))
    return df.withColumn(out, ~F.col(failed) & (F.col(score) < limit)).drop("__stratum", "__cutoff")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): counts, score, base_failed, kept."""
    base = docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), "text")
    features = materialize(with_features(base).select("doc_id", "stratum", *COUNTS, "score", "base_failed"), "quality-features")
    cutoffs = calibrate(features, labels, alpha, delta)
    return with_verdict(features, cutoffs, "stratum", "score", "base_failed", "kept")


def rejections(judged: DataFrame) -> DataFrame:
    """(stratum, n, rejected_by_base, rejected_by_cutoff) of ``judge``'s rows."""
    base, cut = F.col("base_failed"), ~F.col("base_failed") & ~F.col("kept")
    return judged.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(base).alias("rejected_by_base"), F.count_if(cut).alias("rejected_by_cutoff"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged.

    Features are computed once and stored beside the rows; calibration reads the features alone, and
    the verdict is a filter on the stored rows, so no text is shuffled.
    """
    at = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in at.items()])
    featured = with_features(named, at["text"], "q_").withColumn("q_stratum", F.col(at["lang"]).cast("string"))
    stored = materialize(featured.select(*at.values(), "q_stratum", "q_score", "q_base_failed"), "quality-rows")
    features = stored.select(F.col(at["doc_id"]).alias("doc_id"), F.col("q_stratum").alias("stratum"), F.col("q_score").alias("score"), F.col("q_base_failed").alias("base_failed"))
    judged = with_verdict(stored, calibrate(features, labels, alpha, delta), "q_stratum", "q_score", "q_base_failed", "q_kept")
    return judged.where("q_kept").select(*[F.col(a).alias(c) for c, a in at.items()])


def oracle_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    """The same in DuckDB: counts, score, exact binomial cutoffs and verdict."""
    grid = [float(c) for c in CUTOFFS]
    part = lambda x, scale: f"(1.0::DOUBLE - least({x} / {scale}::DOUBLE, 1.0::DOUBLE))"
    share = lambda a, b: f"coalesce({a}::DOUBLE / nullif({b}, 0), 0.0::DOUBLE)"
    clean = " * ".join([part(share("n_symbols", "word_chars"), 0.25), part(f"greatest({share('n_upper', 'word_chars')} - 0.15::DOUBLE, 0.0::DOUBLE)", 0.6), part(share("n_bangs", "n_words"), 0.6), part(share("n_dup_lines", "n_lines"), 0.75), part(share("n_repeat_words", "n_words"), 0.5)])
    count = lambda cls: f"length(t) - length(regexp_replace(t, '[{cls}]', '', 'g'))"
    space = "[ \\t\\n\\x0B\\f\\r]"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{space}', '', 'g') <> '') AS l
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
b AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM b, range(0, {WINDOW}) q(k) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
    ({count('#*$%&|<>')})::BIGINT AS n_symbols, {count('A-Z')} AS n_upper, {count('!')} AS n_bangs, len(l) AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
f AS (SELECT *, 1.0::DOUBLE - ({clean}) AS score, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
m AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT unnest([stratum, '{POOLED}']) AS stratum, score FROM f JOIN m USING (doc_id) WHERE good AND NOT base_failed),
k AS (SELECT stratum, c AS cutoff, count(*) AS n, count(*) FILTER (score >= c) AS k FROM h, (SELECT unnest({grid}::DOUBLE[]) AS c) GROUP BY 1, 2),
p AS (
  SELECT stratum, cutoff, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}::DOUBLE) + (n - i) * ln(1 - {alpha}::DOUBLE))) FROM (SELECT unnest(range(0, k + 1)) AS i)) AS tail,
    (SELECT count(DISTINCT stratum) FROM k) AS strata
  FROM k WHERE k <= n * {alpha}::DOUBLE),
u AS (SELECT stratum, min(cutoff) AS cutoff FROM p WHERE tail <= {delta}::DOUBLE / (strata * {len(grid)}) GROUP BY 1)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score,
  NOT base_failed AND score < coalesce(u.cutoff, 2) AS kept
FROM f LEFT JOIN u ON f.stratum = u.stratum AND u.stratum <> '{POOLED}'
"""
