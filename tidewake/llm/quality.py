"""Robust multivariate outlier rejection of documents, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import SPACE_PATTERN, settled

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of counts for each row of ``docs``, with the columns in ``keep``.

    All counts are over the whole text; null counts as empty.  Windows of three
    words of a text are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.trim(text, F.lit(BLANKS))
    held = [F.col(c) for c in keep]
    one = docs.select(
        F.col(id_col).alias("__id"),
        *held,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN)).alias("__words"),
        F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)) != "").alias("__lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n = F.size("__words")
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i")))
    two = one.select(
        "__id",
        *held,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(hashed)).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")).alias("__sorted"),
    )
    # Windows with an equal neighbour in the order of their hashes, and the words that these cover, by position.
    last = F.size("__sorted")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform("__sorted", lambda w: w["h"]))
    after = F.concat(F.slice(F.transform("__sorted", lambda w: w["h"]), F.lit(2), F.greatest(last - 1, F.lit(0))), F.array(F.lit(None).cast("bigint")))
    beside = F.zip_with("__sorted", F.arrays_zip(F.slice(before, F.lit(1), last).alias("b"), after.alias("a")), lambda w, s: F.when((w["h"] == s["b"]) | (w["h"] == s["a"]), w["i"]))
    at = F.sort_array(F.array_compact(beside))
    counted = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")),
        lambda s: s["n"],
    )
    covered = F.when(last > 0, counted).otherwise(F.lit(0))
    return two.select(F.col("__id").alias(id_col), *held, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


# ---------------------------------------------------------------- verdicts

#: Statistics of the distance: transformed vector, its unit (2**-16) and the
#: least standard deviation that a coordinate is taken to have.  The last two
#: are at most 1 and 0.71, so each may still reach the cutoff by itself.
COORDINATES = {
    "x1": ("ln((word_chars + 1.0D) / (n_words + 1.0D))", 0.08),
    "x2": ("sqrt(n_symbols / (word_chars + 1.0D))", 0.05),
    "x3": ("sqrt(n_dup_lines / (n_lines + 1.0D))", 0.15),
    "x4": ("sqrt(n_repeat_words / (n_words + 1.0D))", 0.13),
}
UNIT = 65536
#: Part of a stratum whose covariance has the least determinant, and the factor
#: that makes that covariance consistent for normal data in four dimensions.
CORE, CONSISTENT = 0.75, 1.487
#: 0.9999 quantile of chi-squared with four degrees of freedom.
CUTOFF = 23.51
#: Concentration steps end when no estimate changes, or after so many.
MOST_STEPS = 12
#: Starts of the steps: 0 from the medians by the sum of squares, 1 from the mean
#: and covariance of all rows, 2 from the medians by the largest coordinate.
STARTS = (0, 1, 2)
#: A language and source with fewer rows takes its language's estimate, and that all rows'.
LEAST_ROWS = 100
_NAMES = list(COORDINATES)
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[: i + 1]]


def sql_vectors(source: str) -> str:
    """Transformed vectors in whole units, so that sums don't depend on their order."""
    xs = ", ".join(f"cast(round({e} * {UNIT}) as bigint) as {x}" for x, (e, _) in COORDINATES.items())
    # Lengths keep names apart whatever they hold; null is none of them.
    lang = "coalesce(concat(length(lang), '=', lang), 'none')"
    return f"""select *, {xs}, concat({lang}, '/', coalesce(concat('=', source), 'none')) as s3, {lang} as s2 from {source}
        where not base_failed"""


def sql_groups(vectors: str) -> str:
    """For each language and source, the stratum that judges it and all strata whose estimates its rows take part in.

    A language's estimate is made of all its rows, the one of all rows of all,
    but only if some language and source is judged by it.
    """
    counts = f"select s3, s2, count(*) as n3 from {vectors} group by s3, s2"
    judged_by = f"""select s3, s2, case when n3 >= {LEAST_ROWS} then concat('source ', s3) when n2 >= {LEAST_ROWS} then concat('lang ', s2) else 'all' end as stratum
        from (select s3, s2, n3, sum(n3) over (partition by s2) as n2 from ({counts}) a) b"""
    return f"""with g as ({judged_by}) select s3, s2, stratum, filter(array(
            case when stratum like 'source %' then stratum end, case when max(stratum = concat('lang ', s2)) over (partition by s2) then concat('lang ', s2) end, case when of_all then 'all' end), x -> x is not null) as strata
        from g cross join (select count(*) > 0 as of_all from g where stratum = 'all') h"""


#: Strata up to so many are joined by broadcast: a row of each is under 300 bytes.
MOST_BROADCAST = 100_000


def sql_first_distance(vectors: str, centres: str) -> str:
    """Distance from the medians in least standard deviations, for the starts that begin there."""
    squares = [f"({x} - {x}m) / {sd * UNIT!r}D * (({x} - {x}m) / {sd * UNIT!r}D)" for x, (_, sd) in COORDINATES.items()]
    return f"""select v.*, case when start = {STARTS[0]} then {' + '.join(squares)} else greatest({', '.join(squares)}) end as d2
        from {vectors} v join {centres} c on v.stratum = c.stratum"""


def sql_centres(vectors: str) -> str:
    """Each coordinate's median, to a 64th of its least standard deviation, from counts by cell."""
    parts = []
    for x, (_, sd) in COORDINATES.items():
        w = sd * UNIT / 64
        parts.append(f"""select stratum, min(mid) as m, '{x}' as x from (select stratum, (cell + 0.5D) * {w!r}D as mid, sum(n) over (partition by stratum order by cell) as up, sum(n) over (partition by stratum) as total
            from (select stratum, cast(floor({x} / {w!r}D) as bigint) as cell, count(*) as n from {vectors} group by stratum, cast(floor({x} / {w!r}D) as bigint)) a) b where 2 * up >= total group by stratum""")
    wide = ", ".join(f"max(case when x = '{x}' then m end) as {x}m" for x in _NAMES)
    return f"select stratum, {wide} from ({' union all '.join(parts)}) u group by stratum"


#: Cells of equal ratio of the squared distance, for its quantile.
CELL = "cast(floor(ln(1.0D + d2) * 256.0D) as bigint)"


def sql_core(distances: str) -> str:
    """For each stratum, the last cell of the nearest CORE of its rows."""
    return f"""select stratum, min(cell) as edge from (select stratum, cell, sum(n) over (partition by stratum order by cell) as up, sum(n) over (partition by stratum) as total
        from (select stratum, {CELL} as cell, count(*) as n from {distances} group by stratum, {CELL}) a) b where up >= {CORE!r}D * total group by stratum"""


def sql_estimate(distances: str, core: str, whole: str) -> str:
    """Mean and Cholesky factor of the core's covariance; ``whole`` is the type of exact sums."""
    sums = ", ".join([f"cast(sum(cast({x} as {whole})) as double) as t_{x}" for x in _NAMES] + [f"cast(sum(cast({a} as {whole}) * {b}) as double) as t_{a}_{b}" for a, b in _PAIRS])
    floor = {x: (sd * UNIT) ** 2 for x, (_, sd) in COORDINATES.items()}
    means = ", ".join(f"t_{x} / n as {x}m" for x in _NAMES)
    cov = ", ".join(f"{CONSISTENT!r}D * (t_{a}_{b} / n - (t_{a} / n) * (t_{b} / n))" + (f" + {floor[a]!r}D" if a == b else "") + f" as c_{a}_{b}" for a, b in _PAIRS)
    text = f"select stratum, count(*) as n, {sums} from (select d.* from {distances} d join {core} k on d.stratum = k.stratum where {CELL.replace('d2', 'd.d2')} <= k.edge) e group by stratum"
    text = f"select stratum, {means}, {cov} from ({text}) f"
    for i, a in enumerate(_NAMES):  # one row of the factor at a time
        for j, b in enumerate(_NAMES[: i + 1]):
            rest = "".join(f" - l_{a}_{c} * l_{b}_{c}" for c in _NAMES[:j])
            value = f"sqrt(greatest(c_{a}_{a}{rest}, {floor[a] / 1e6!r}D))" if a == b else f"(c_{a}_{b}{rest}) / l_{b}_{b}"
            text = f"select *, {value} as l_{a}_{b} from ({text}) g"
    return text


def sql_distance(vectors: str, estimate: str) -> str:
    """Squared Mahalanobis distance, by forward substitution."""
    text = f"select v.*, {', '.join(f'{x}m' for x in _NAMES)}, {', '.join(f'l_{a}_{b}' for a, b in _PAIRS)} from {vectors} v join {estimate} e on v.stratum = e.stratum"
    for i, a in enumerate(_NAMES):
        rest = "".join(f" - l_{a}_{b} * z_{b}" for b in _NAMES[:i])
        text = f"select *, ({a} - {a}m{rest}) / l_{a}_{a} as z_{a} from ({text}) h"
    drop = ", ".join([*(f"{x}m" for x in _NAMES), *(f"l_{a}_{b}" for a, b in _PAIRS), *(f"z_{x}" for x in _NAMES)])
    return f"select * except ({drop}), {' + '.join(f'z_{x} * z_{x}' for x in _NAMES)} as d2 from ({text}) k"


#: What an estimate is: means and factor of the covariance.
_ESTIMATE = [f"{x}m" for x in _NAMES] + [f"l_{a}_{b}" for a, b in _PAIRS]


def _concentrated(members: DataFrame, small) -> DataFrame:
    """(stratum, means, factor) of each stratum's core of least determinant among those that the starts lead to.

    Every start of a stratum is a stratum of its own on the way, so all of them
    take their steps together.
    """
    spark = members.sparkSession

    def run(text: str, **frames: DataFrame) -> DataFrame:
        return spark.sql(text, **frames)

    def begun(frame: DataFrame, *starts: int) -> DataFrame:
        out = frame.withColumn("start", F.explode(F.array(*map(F.lit, starts))))
        return out.withColumn("stratum", F.concat("stratum", F.lit(" #"), F.col("start").cast("string")))

    centres = settled(run(sql_centres("{v}"), v=members))
    first = run(sql_first_distance("{v}", "{c}"), v=begun(members, STARTS[0], STARTS[2]), c=small(begun(centres, STARTS[0], STARTS[2]).drop("start")))
    by_all = begun(members, STARTS[1])
    everyone = run("select stratum, 0 as edge from {v} group by stratum", v=by_all)
    whole = settled(run(sql_estimate("{d}", "{k}", "decimal(20, 0)"), d=by_all.withColumn("d2", F.lit(0.0)), k=small(everyone)))
    kept = ["__row", "stratum", *_NAMES, "d2"]
    d = first.select(*kept).unionByName(run(sql_distance("{v}", "{e}"), v=by_all, e=small(whole)).select(*kept))
    vectors = begun(members, *STARTS).drop("start")
    before = None
    for _ in range(MOST_STEPS):
        core = settled(run(sql_core("{d}"), d=d))
        estimate = settled(run(sql_estimate("{d}", "{k}", "decimal(20, 0)"), d=d, k=small(core)))
        if before is not None:
            same = " and ".join(f"a.{c} = b.{c}" for c in _ESTIMATE)
            if not run(f"select 1 from {{a}} a join {{b}} b on a.stratum = b.stratum where not ({same}) limit 1", a=estimate, b=before).count():
                break
        before = estimate
        d = run(sql_distance("{v}", "{e}"), v=vectors, e=small(estimate))
    size = " + ".join(f"ln(l_{x}_{x})" for x in _NAMES)  # half the logarithm of the determinant
    best = run(f"select substring(stratum, 1, length(stratum) - 3) as stratum, min_by(struct({', '.join(_ESTIMATE)}), struct(round({size}, 12) as size, substring(stratum, -1) as start)) as e from {{e}} group by 1", e=estimate)
    return best.select("stratum", "e.*")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, counts, base_failed, distance2, kept) of every row of ``docs``.

    A row that fails the base rules is rejected.  For the others a regularised
    minimum-covariance-determinant estimate is made of each language and source
    by concentration steps from three starts: the nearest CORE of the rows give
    mean and covariance, these the distances, and so on until nothing changes.
    The estimate of least determinant stays.  Rows beyond CUTOFF are rejected.  A stratum of under LEAST_ROWS rows is judged
    by the estimate of all its language's rows, or by that of all rows.

    Null language and source are strata like any other; null texts count as
    empty and fail.  Repeated rows count as often as they are given.  A table
    without rows, or without rows that pass the base rules, needs no estimate.
    Only the named columns, ``lang`` and ``source`` are read.  ``row`` is the
    row's monotonically_increasing_id in ``docs``.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.monotonically_increasing_id().alias("__row"))
    stats = base_statistics(read, "__key", "__text", ("lang", "source", "__row"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = settled(stats.withColumn("base_failed", failed))

    def run(text: str, **frames: DataFrame) -> DataFrame:
        return spark.sql(text, **frames)

    one = run(sql_vectors("{stats}"), stats=stats.select("__row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "lang", "source", "base_failed")).select("__row", "s2", "s3", *_NAMES)
    groups = settled(run(sql_groups("{v}"), v=one))
    vectors = settled(one.join(F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups, ["s2", "s3"]).select("__row", "stratum", "strata", *_NAMES))
    members = vectors.select("__row", F.explode("strata").alias("stratum"), *_NAMES)
    groups_small = groups.select("stratum").distinct().count() <= MOST_BROADCAST

    def small(frame: DataFrame) -> DataFrame:
        """One row a stratum: by broadcast a hot stratum stays where its rows are."""
        return F.broadcast(frame) if groups_small else frame

    estimate = settled(_concentrated(members, small))
    verdict = run(sql_distance("{v}", "{e}"), v=vectors.drop("strata"), e=small(estimate)).select("__row", F.col("d2").alias("distance2"))
    out = stats.join(verdict, "__row", "left")
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUTOFF)
    return out.select(F.col("__row").alias("row"), F.col("__key").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", kept.alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that aren't rejected, each by itself, whatever ids are null or repeated.

    ``docs`` is read twice and must give its rows in the same partitions both
    times, as a Parquet table does.
    """
    rejected = judged(docs, id_col, text_col).where("not kept").select(F.col("row").alias("__rejected"))
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(rejected, F.col("__row") == F.col("__rejected"), "left_anti").drop("__row")
