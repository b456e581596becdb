"""Quality rules: base rules, and robust multivariate outliers per language and source.

Every statistic is a DataFrame expression; no Python runs on the executors.
For each (language, source) the location and scatter of the transformed
statistic vectors come from minimum-covariance-determinant steps: from
three starts about the medians, keep the fraction ``core`` of the rows with the least
Mahalanobis distance, take their mean and covariance, and again until the
determinant stops falling; the start that ends with the least one is used. Documents
farther than ``cutoff`` are rejected. Sources with few documents take the
estimate of their language, and languages with few that of all documents.

Null texts have no words and fail the base rule; null languages or sources
are groups of their own. Repeated rows count each, and rows tied at the core's edge
are all in it. Texts are taken whole, however long; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import SPACE, fresh, saved

MIN_WORDS = 50
CORE = 0.75
#: Starts, and steps from each at most; a group stops earlier, once the logarithm of its
#: determinant falls by less than LEAST_FALL.
STARTS = 3
STEPS = 30
LEAST_FALL = 1e-3
#: Squared distance beyond which a document is rejected: far out in the tail
#: of the chi-squared law, as honest statistics have heavier tails than it.
CUTOFF = 60.0
MIN_GROUP = 200
VECTOR = ("v_word", "v_symbol", "v_upper", "v_repeat", "v_lines")
#: Spread that each coordinate has at least: without it, statistics that are
#: nearly always zero would make any other value infinitely far.
FLOOR = (0.05, 0.1, 0.12, 0.12, 0.1)
#: 0.75 quantile of |x| under the normal law, and the factor that makes the
#: scatter of a normal sample's inner 75 % in five dimensions that of the whole.
_MAD = 1.4826
_CONSISTENCY = 1.55


def _repeated_words(hashes: Column) -> Column:
    """Words in 3-word windows found twice or more: the windows' hashes with
    their places, sorted, tell the repeated places; each covers three words,
    less what the next place covers."""
    n = F.size(hashes)
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = F.filter(F.transform(s, lambda x, j: F.when(
            ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
        return F.array_sort(same)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    # arrays are bound once by one-element transforms, not computed again for each use
    whole = F.element_at(F.transform(F.transform(F.array(placed), places), covered), 1)
    return F.when(n == F.size(F.array_distinct(hashes)), 0).otherwise(whole).cast("long")


def statistics(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_upper (A-Z) and n_lines (lines with a word) of each text."""
    text, words, hashes, lines = fresh(docs, "t0", "w0", "h0", "l0")
    long = lambda c: c.cast("long")
    df = docs.select(*keep, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))
    t = F.col(text)
    df = df.select(*keep, text, F.array_remove(F.split(t, SPACE + "+"), "").alias(words),
                   F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias(lines))
    w = F.col(words)
    df = df.select("*", F.when(F.size(w) < 3, F.array().cast("array<long>")).otherwise(
        F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).alias(hashes))
    return df.select(
        *keep, long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"),
        long(F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        _repeated_words(F.col(hashes)).alias("n_repeat_words"),
        long(F.length(F.regexp_replace(t, r"[^A-Z]+", ""))).alias("n_upper"), long(F.size(lines)).alias("n_lines"))


def _vector(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return df.withColumns(dict(zip(VECTOR, (
        F.log1p(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_upper") / chars),
        F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))))))


def _distance() -> Column:
    """Squared Mahalanobis distance by the Cholesky factor of the group's scatter,
    written out for the vector's few coordinates."""
    p = len(VECTOR)
    low: dict[tuple[int, int], Column] = {(i, j): F.col(f"l_{i}_{j}") for i in range(p) for j in range(i + 1)}
    y: list[Column] = []
    for i in range(p):
        rest = F.col(VECTOR[i]) - F.col(f"mu_{i}")
        for j in range(i):
            rest = rest - low[i, j] * y[j]
        y.append(rest / low[i, i])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factor(model: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the scatter s_i_j."""
    for j in range(len(VECTOR)):
        square = F.col(f"s_{j}_{j}")
        for k in range(j):
            square = square - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        model = model.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(square, F.lit(FLOOR[j] ** 2 / 4))))
        columns = {}
        for i in range(j + 1, len(VECTOR)):
            rest = F.col(f"s_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            columns[f"l_{i}_{j}"] = rest / F.col(f"l_{j}_{j}")
        if columns:
            model = model.withColumns(columns)
    return model


#: Groups up to which a table with a row for each (some 200 bytes) is broadcast.
FEW_GROUPS = 100_000


def _by_group(df: DataFrame) -> DataFrame:
    """A written table with a row for each group: broadcast if these are few,
    so that rows of a large group stay where they are."""
    df = saved(df, "rules-groups")
    return F.broadcast(df) if df.count() <= FEW_GROUPS else df


def _start(rows: DataFrame) -> DataFrame:
    """Median and MAD of each coordinate, as a diagonal scatter."""
    p = range(len(VECTOR))
    mid = _by_group(rows.groupBy("grp").agg(*[F.percentile_approx(v, 0.5, 1000).alias(f"mu_{i}") for i, v in enumerate(VECTOR)]))
    off = rows.join(mid, "grp").groupBy("grp").agg(
        *[F.first(f"mu_{i}").alias(f"mu_{i}") for i in p],
        *[F.percentile_approx(F.abs(F.col(v) - F.col(f"mu_{i}")), 0.5, 1000).alias(f"mad_{i}") for i, v in enumerate(VECTOR)])
    return off.select("grp", *[f"mu_{i}" for i in p], *[
        (F.pow(F.lit(_MAD) * F.col(f"mad_{i}"), 2) + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i in p for j in range(i + 1)])


def _starts(rows: DataFrame, plain: DataFrame) -> DataFrame:
    """Deterministic starts, all about the medians: the MADs alone (0), and with the
    correlations of the hyperbolic tangents (1) and of the directions (2) of the standardised rows."""
    p = range(len(VECTOR))
    z = rows.join(plain, "grp").select("grp", *[((F.col(v) - F.col(f"mu_{i}")) / F.sqrt(F.col(f"s_{i}_{i}"))).alias(f"z_{i}") for i, v in enumerate(VECTOR)])
    norm = F.sqrt(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in p), F.lit(0.0)))
    z = z.select("grp", *[F.tanh(f"z_{i}").alias(f"a1_{i}") for i in p], *[F.when(norm > 0, F.col(f"z_{i}") / norm).otherwise(0.0).alias(f"a2_{i}") for i in p])
    cov = z.groupBy("grp").agg(*[F.covar_pop(f"a{k}_{i}", f"a{k}_{j}").alias(f"c{k}_{i}_{j}") for k in (1, 2) for i in p for j in range(i + 1)])
    both = plain.join(_by_group(cov), "grp")

    def scatter(k: int, i: int, j: int) -> Column:
        if i == j or k == 0:
            return F.col(f"s_{i}_{j}")
        spread = F.col(f"c{k}_{i}_{i}") * F.col(f"c{k}_{j}_{j}")
        return F.when(spread > 0, F.col(f"c{k}_{i}_{j}") / F.sqrt(spread)).otherwise(0.0) * F.sqrt(F.col(f"s_{i}_{i}") * F.col(f"s_{j}_{j}"))

    return both.select("grp", *[f"mu_{i}" for i in p], F.explode(F.array(*[
        F.struct(F.lit(k).alias("start"), *[scatter(k, i, j).alias(f"s_{i}_{j}") for i in p for j in range(i + 1)]) for k in range(STARTS)])).alias("s")
        ).select("grp", *[f"mu_{i}" for i in p], "s.*")


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance of the core rows, the latter with the floor on its diagonal."""
    p = range(len(VECTOR))
    return rows.groupBy("grp", "start").agg(
        *[F.avg(v).alias(f"mu_{i}") for i, v in enumerate(VECTOR)],
        *[(F.covar_pop(VECTOR[i], VECTOR[j]) * _CONSISTENCY + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"s_{i}_{j}") for i in p for j in range(i + 1)])


def _fitted(model: DataFrame) -> DataFrame:
    """The model with its factor and the logarithm of its determinant."""
    model = _factor(model)
    return model.withColumn("logdet", sum((2 * F.log(f"l_{j}_{j}") for j in range(1, len(VECTOR))), 2 * F.log("l_0_0")))


def _edges(fit: DataFrame, model: DataFrame, core: float) -> DataFrame:
    """The distance that holds the fraction ``core`` of each group's rows, up to the next of
    fixed steps of 1/64 in its logarithm: counts, so the order of the rows does not matter."""
    step = F.ceil(F.log(F.greatest(_distance(), F.lit(1e-12))) * 64).cast("int")
    counts = fit.join(model, "grp").groupBy("grp", "start", step.alias("b")).agg(F.count("*").alias("n"))
    steps = counts.groupBy("grp", "start").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("h"), F.sum("n").alias("all"))
    # at most a few thousand steps for each, from 1e-12 up
    found = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("b")), lambda a, x: F.struct(
        (a["n"] + x["n"]).alias("n"), F.coalesce(a["b"], F.when(a["n"] + x["n"] >= F.lit(core) * F.col("all"), x["b"])).alias("b")))
    return steps.select("grp", "start", found["b"].alias("edge"))


def _determinants(fit: DataFrame, core: float, steps: int) -> DataFrame:
    """Steps from every start until no determinant falls any more, all groups in the
    same aggregations; each group's fit of least determinant (ties: the first start)."""
    step = F.ceil(F.log(F.greatest(_distance(), F.lit(1e-12))) * 64).cast("int")
    model = _by_group(_fitted(_starts(fit, _by_group(_start(fit)))))
    best = None
    for _ in range(steps):
        edges = _by_group(_edges(fit, model, core))
        near = fit.join(model, "grp").join(edges, ["grp", "start"]).where(step <= F.col("edge"))
        new = _by_group(_fitted(_moments(near.select("grp", "start", *VECTOR))))
        if best is None:
            best, model = new, new
            continue
        was = best.select("grp", "start", F.col("logdet").alias("was"))
        falls = new.join(was, ["grp", "start"]).where(F.col("logdet") < F.col("was") - LEAST_FALL)
        model = _by_group(falls.select(*new.columns))
        if model.isEmpty():
            break
        best = _by_group(best.join(model.select("grp", "start"), ["grp", "start"], "left_anti").unionByName(model))
    cols = [c for c in best.columns if c != "grp"]
    return best.groupBy("grp").agg(F.min_by(F.struct(*cols), F.struct("logdet", "start")).alias("m")).select("grp", "m.*")


def _grouped(rows: DataFrame, lang_col: str, source_col: str, min_group: int) -> DataFrame:
    """Adds grps, the names of the (language, source), the language and all rows,
    and grp, the first of these with enough rows."""
    sizes = rows.groupBy(lang_col, source_col).agg(F.count("*").alias("n"))
    langs = sizes.groupBy(lang_col).agg(F.sum("n").alias("m"))
    pairs = sizes.alias("a").join(langs.alias("b"), F.col(f"a.{lang_col}").eqNullSafe(F.col(f"b.{lang_col}"))).select(
        F.col(f"a.{lang_col}").alias("g_lang"), F.col(f"a.{source_col}").alias("g_source"), "n", "m")
    by_lang = F.to_json(F.struct(F.lit(1).alias("by"), F.col("g_lang").alias("l")))
    names = pairs.select("g_lang", "g_source", "n", "m", F.array(
        F.to_json(F.struct(F.lit(2).alias("by"), F.col("g_lang").alias("l"), F.col("g_source").alias("s"))), by_lang, F.lit("all")).alias("grps"))
    names = names.select("g_lang", "g_source", "grps", F.when(F.col("n") >= min_group, F.col("grps")[0]).when(
        F.col("m") >= min_group, F.col("grps")[1]).otherwise(F.lit("all")).alias("grp"))
    return rows.join(names, F.col(lang_col).eqNullSafe(F.col("g_lang")) & F.col(source_col).eqNullSafe(F.col("g_source"))).drop("g_lang", "g_source")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
           min_words: int = MIN_WORDS, core: float = CORE, steps: int = STEPS, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """A row for each row: the id, the statistics, base_failed, distance2 and kept.

    Scatter is estimated from documents that pass the base rules.
    """
    rows = statistics(docs, text_col, id_col, lang_col, source_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = saved(_vector(_grouped(saved(rows, "rules-stats"), lang_col, source_col, min_group).withColumn("base_failed", failed)), "rules-vectors")
    # each estimate in use is fitted on all rows of its language, or of the table, not on those of small sources alone
    fit = (rows.where(~F.col("base_failed")).select(F.explode("grps").alias("grp"), *VECTOR)
           .join(_by_group(rows.select("grp").distinct()), "grp", "left_semi"))
    model = _by_group(_determinants(saved(fit, "rules-fit"), core, steps))
    scored = rows.join(model, "grp", "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff)
    return scored.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", kept.alias("kept"))
