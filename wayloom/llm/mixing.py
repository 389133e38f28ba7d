"""Mixing by iterative proportional fitting, with DataFrame operations only.

Documents are counted into cells of (source, language, topic) by their tokens. Raking then scales
the cells' weights to the target share of every source, of every language and of every topic in
turn, ``ROUNDS`` times, which comes to weights that fit all three marginals and otherwise keep the
corpus's own associations. A document's sampling probability is ``min(1, scale * weight / tokens)``
of its cell, where ``scale`` makes the expected sample ``budget`` of all tokens; cells whose
probability would exceed 1 are taken whole and the rest of the budget goes to the others.

Only cells are raked: their number is the product of the label sets, not that of the documents.
Documents meet their cell in a join that Spark broadcasts or splits by the cells' size.

Defined results: a null label is a label of its own. A null or empty text has no tokens, weight
and probability 0. Draws are hashes of id and seed, so lost executors or another partitioning give
the same sample, repeated rows share their fate, and null ids share one draw. An empty table gives
an empty sample.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import documents, free, whole
from wayloom.session import stage

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 8
BUDGET = 0.6
SEED = 17
DIMENSIONS = ("source", "lang", "topic")
#: Target shares of each dimension: a mapping of labels to shares, or an exponent that flattens the
#: corpus's own shares (1 keeps them, 0 makes them equal). Labels without a share split the rest.
TARGETS: dict[str, float | dict[str, float]] = {
    "source": 0.7,
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.8, "brief": 0.1, "marked": 0.05, "notice": 0.05},
}


def topic_of(text: str) -> Column:
    """A rough topic where documents carry none: license notices, marked-up or short texts, prose."""
    body = whole(text)
    marks = F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))
    return (
        F.when(F.contains(F.lower(body), F.lit("license")), "notice")
        .when(marks * 50 > F.length(body), "marked")
        .when(F.length(body) < 500, "brief")
        .otherwise("prose")
    )


def n_tokens(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) for each id, the same on every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(2**32)


def _share(dimension: str, target: float | dict[str, float]) -> Column:
    """Unnormalised target share of a cell's label, from ``own``, the label's tokens."""
    if not isinstance(target, dict):
        return F.when(F.col("own") > 0, F.pow("own", F.lit(float(target)))).otherwise(0.0)
    rest = max(0.0, 1 - sum(target.values()))
    listed = reduce(
        lambda found, item: found.when(F.col(dimension) == item[0], float(item[1])),
        target.items(),
        F.when(F.lit(False), 0.0),
    )
    others = F.sum(F.when(listed.isNull(), F.col("tokens"))).over(Window.partitionBy(F.lit(0)))
    return F.when(listed.isNotNull(), listed).when(others > 0, rest * F.col("own") / others).otherwise(0.0)


def rake(
    cells: DataFrame, targets: dict[str, float | dict[str, float]] = TARGETS, rounds: int = ROUNDS
) -> DataFrame:
    """Cells ``(labels …, tokens)`` with ``weight``, fitted to the targets' shares of all tokens."""
    spark, names = cells.sparkSession, list(targets)
    total = Window.partitionBy(F.lit(0))
    for name, target in targets.items():
        labels = cells.groupBy(name).agg(F.sum("tokens").alias("own"), F.sum("tokens").alias("tokens"))
        shares = labels.select(name, _share(name, target).alias("share"))
        # One row for each label; the join below is null-safe because a null label is a label.
        shares = shares.select(
            F.col(name).alias("label"), (F.col("share") / F.sum("share").over(total)).alias(f"share_{name}")
        )
        cells = cells.join(shares, F.col(name).eqNullSafe(F.col("label"))).drop("label")
    cells = stage(cells.withColumn("weight", F.col("tokens").cast("double")))
    for at in range(rounds):
        for name in names:
            held = F.sum("weight").over(Window.partitionBy(name))
            cells = cells.withColumn(
                "weight", F.when(held > 0, F.col("weight") * F.col(f"share_{name}") / held).otherwise(0.0)
            )
        if at % 4 == 3:
            cells = stage(cells)
    tokens = F.sum("tokens").over(total)
    return cells.select(*names, "tokens", (F.col("weight") * tokens).alias("weight"))


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Raked cells with ``rate`` (weight per token) and ``probability``.

    Cells are taken whole in descending order of their rate as long as the scale of the others
    would put the next one above 1.
    """
    names = [c for c in cells.columns if c not in ("tokens", "weight")]
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    cells = cells.withColumn("rate", rate)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rate"), *[F.asc_nulls_first(n) for n in names])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = budget * F.sum("tokens").over(everything) - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    scale = F.when(F.sum("weight").over(onward) > 0, left / F.sum("weight").over(onward))
    cells = cells.withColumn("scale", scale)
    # The first scale that fits its own cell holds for it and all after it.
    fits = F.when(F.col("scale") * F.col("rate") <= 1, F.struct("rate", "scale"))
    chosen = F.max(fits).over(everything)["scale"]
    return cells.select(
        *names,
        "tokens",
        "weight",
        "rate",
        # If no scale fits, the budget takes every cell whole.
        F.when(F.col("rate") <= 0, 0.0)
        .otherwise(F.coalesce(F.least(F.lit(1.0), chosen * F.col("rate")), F.lit(1.0)))
        .alias("probability"),
    )


def sample(
    docs: DataFrame,
    dimensions: dict[str, Column],
    targets: dict[str, float | dict[str, float]] = TARGETS,
    budget: float = BUDGET,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Every document with its labels, ``n_tokens``, ``weight``, ``probability`` and ``selected``.

    ``dimensions`` gives the labels as expressions; ``keep`` names the columns that go along, the
    id alone by default.
    """
    names = list(dimensions)
    labelled = docs.select(
        F.struct(*(keep or [id_col])).alias("row"),
        draw(id_col, seed).alias("draw"),
        n_tokens(text_col).alias("n_tokens"),
        *[column.alias(name) for name, column in dimensions.items()],
    )
    if not keep:
        labelled = stage(labelled)
    cells = labelled.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    fitted = stage(probabilities(rake(stage(cells), targets), budget))
    fitted = fitted.select(*[F.col(n).alias(f"cell_{n}") for n in names], "rate", "probability")
    same = [F.col(n).eqNullSafe(F.col(f"cell_{n}")) for n in names]
    return labelled.join(fitted, reduce(lambda a, b: a & b, same)).select(
        "row",
        *names,
        "n_tokens",
        F.when(F.col("n_tokens") > 0, F.col("rate")).otherwise(0.0).alias("weight"),
        F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(0.0).alias("probability"),
        ((F.col("n_tokens") > 0) & (F.col("draw") < F.col("probability"))).alias("selected"),
    )


def document_labels() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of("text")}


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = sample(documents(spark, folder), document_labels())
    return found.select(
        "row.doc_id",
        *DIMENSIONS,
        "n_tokens",
        F.round("weight", 9).alias("weight"),
        F.round("probability", 9).alias("probability"),
        "selected",
    )


def _sql_share(name: str, target: float | dict[str, float]) -> str:
    if not isinstance(target, dict):
        return f"CASE WHEN own > 0 THEN pow(own, {float(target)}) ELSE 0 END"
    listed = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {float(v)}" for k, v in target.items()) + " END"
    others = f"sum(CASE WHEN {listed} IS NULL THEN own END) OVER ()"
    rest = max(0.0, 1 - sum(target.values()))
    return f"CASE WHEN {listed} IS NOT NULL THEN {listed} WHEN {others} > 0 THEN {rest} * own / {others} ELSE 0 END"


def _sql() -> str:
    parts = [
        f"""d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS body,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)
             / 4294967296.0 AS draw
  FROM documents)""",
        """l AS (
  SELECT *, CASE WHEN contains(lower(body), 'license') THEN 'notice'
                 WHEN (length(body) - length(translate(body, '#*$%&|<>', ''))) * 50 > length(body) THEN 'marked'
                 WHEN length(body) < 500 THEN 'brief' ELSE 'prose' END AS topic
  FROM d)""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM l GROUP BY ALL)",
    ]
    for name, target in TARGETS.items():
        parts.append(
            f"m_{name} AS (SELECT {name}, share / sum(share) OVER () AS share_{name} FROM (SELECT {name}, "
            f"{_sql_share(name, target)} AS share FROM (SELECT {name}, sum(tokens) AS own FROM c GROUP BY 1)))"
        )
    joins = " ".join(f"JOIN m_{n} ON c.{n} IS NOT DISTINCT FROM m_{n}.{n}" for n in TARGETS)
    shares = ", ".join(f"share_{n}" for n in TARGETS)
    parts.append(f"w0 AS (SELECT c.*, {shares}, tokens AS weight FROM c {joins})")
    at = 0
    for _ in range(ROUNDS):
        for name in TARGETS:
            held = f"sum(weight) OVER (PARTITION BY {name})"
            parts.append(
                f"w{at + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {held} > 0 THEN weight * share_{name} / {held} "
                f"ELSE 0 END AS weight) FROM w{at})"
            )
            at += 1
    labels = ", ".join(TARGETS)
    order = "ORDER BY rate DESC, " + ", ".join(f"{n} NULLS FIRST" for n in TARGETS)
    parts += [
        f"r AS (SELECT {labels}, tokens, weight * sum(tokens) OVER () AS weight FROM w{at})",
        "q AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS rate FROM r)",
        f"""s AS (SELECT *, ({BUDGET} * sum(tokens) OVER () - coalesce(sum(tokens) OVER
    ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(weight) OVER
    ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale FROM q)""",
        "k AS (SELECT arg_max(scale, rate) AS chosen FROM s WHERE scale * rate <= 1)",
        """p AS (SELECT s.*, CASE WHEN rate <= 0 THEN 0
    ELSE coalesce(CASE WHEN chosen IS NULL THEN NULL ELSE least(1.0, chosen * rate) END, 1.0) END
    AS probability FROM s, k)""",
    ]
    same = " AND ".join(f"l.{n} IS NOT DISTINCT FROM p.{n}" for n in TARGETS)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, l.source, l.lang, l.topic, CAST(n_tokens AS BIGINT) AS n_tokens,
       CASE WHEN n_tokens > 0 THEN round(rate, 9) ELSE 0.0 END AS weight,
       CASE WHEN n_tokens > 0 THEN round(probability, 9) ELSE 0.0 END AS probability,
       n_tokens > 0 AND draw < probability AS selected
FROM l JOIN p ON {same}"""


SQL_OP5 = _sql()
