"""Mixing to target weights by iterative proportional fitting.

Tokens are counted for each cell of source, language and topic. The cells' weights
are then raked: scaled so that each source's sum is its target, then each
language's, then each topic's, for SWEEPS rounds. A document's calibration g
is its cell's raked weight over its tokens, with a mean of one; it is sampled
with probability min(1, fraction * g), and one sampled at 1 counts
sample_weight = max(1, fraction * g) times, so that weighted tokens meet the
targets. repeated() makes the weight take effect: a document comes
floor(fraction * g) times, and once more with the probability of the rest.
Draws are a hash of the document's id, the same on every run.

DataFrame functions only. Only cells are iterated on; each sweep is written
and read again, so plans stay short and a lost executor costs one reread. A
category's sum is aggregated with partial results. Where a dimension has at
most FEW categories, by count, their factors are literals of the next step;
else a window over the cells of a category, as many as combinations of the
other dimensions, gives the sum. So no hot category gathers cells in a task.

Defined cases: null source, language and topic are the category `none`; a
document without a token has probability 0; targets are relative, for the
categories that occur, and a category that isn't named has the dimension's
default; a null doc_id draws as the empty string; rows of one doc_id are kept
or left together; an empty table gives no rows; other columns are passed on,
whatever their names, but for topic if it isn't given, tokens, probability,
sample_weight and kept, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import drop_path, few, fresh, table, written

NONE = "none"
SWEEPS = 8
FEW = 500


@dataclass(frozen=True)
class Targets:
    """Relative weights by category, and that of categories without one."""

    named: dict[str, float] = field(default_factory=dict)
    default: float = 1.0

    def column(self, of: Column) -> Column:
        out = F.lit(float(self.default))
        for name, weight in self.named.items():
            out = F.when(of == name, F.lit(float(weight))).otherwise(out)
        return out


#: Production targets: sources alike, languages and topics as named.
TARGETS = {
    "source": Targets(default=1.0),
    "lang": Targets({"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, default=0.05),
    "topic": Targets({"prose": 0.85, "notice": 0.05, "contact": 0.05, "table": 0.05}, default=0.05),
}


def topic(text: Column) -> Column:
    """What a text has most to do with, by marks that decide in this order."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.contains(t, F.lit(" | ")), "table").when(F.contains(t, F.lit("@")), "contact").when(F.contains(t, F.lit("icense")), "notice").otherwise("prose")


def token_count(text: Column) -> Column:
    """Blanks and line breaks plus one; none for null and empty texts."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    gaps = 2 * F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def draw(id_: Column) -> Column:
    """A number from 0 up to 1 by the id: 52 bits of its MD5."""
    digest = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":mix")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(cells: DataFrame, targets: dict[str, Targets], sweeps: int = SWEEPS) -> DataFrame:
    """cells (the dimensions, tokens) with g, the calibration."""
    spark = cells.sparkSession
    now, path = written(cells.where("tokens > 0").withColumn("w", F.col("tokens").cast("double")), "cells")
    tokens = now.agg(F.sum("tokens")).first()[0] or 0
    totals = {x: now.select(x).distinct().agg(F.sum(t.column(F.col(x)))).first()[0] or 1.0 for x, t in targets.items()}
    many = {x: now.select(x).distinct().limit(FEW + 1).count() > FEW for x in targets}
    for _ in range(sweeps):
        for name, target in targets.items():
            share = target.column(F.col(name)) / F.lit(float(totals[name]))
            if many[name]:
                now = now.withColumn("w", F.col("w") * (share / F.sum("w").over(Window.partitionBy(name))))
                continue
            sums = now.groupBy(name).agg(F.sum("w").alias("w")).select(name, (share / F.col("w")).alias("f")).collect()  # at most FEW rows
            factors = F.create_map(*[F.lit(x) for r in sums for x in (r[name], float(r["f"]))]) if sums else F.create_map()
            now = now.withColumn("w", F.col("w") * factors[F.col(name)]) if sums else now
        now, new = written(now, "cells")
        drop_path(spark, path)
        path = new
    # the weights sum to one, as the last targets do
    return now.withColumn("g", F.col("w") * F.lit(float(tokens)) / F.col("tokens")).drop("w")


def mix(docs: DataFrame, targets: dict[str, Targets] | None = None, fraction: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with topic, tokens, probability, sample_weight and kept."""
    targets = targets or TARGETS
    added = ["tokens", "probability", "sample_weight", "kept"]
    plain = docs.drop(*added)
    made = "topic" in targets and "topic" not in docs.columns
    names = dict(zip(targets, fresh([*plain.columns, *added, "topic", "g", "w"], *(f"_{x}" for x in targets)), strict=True))
    g = fresh([*plain.columns, *added, "topic", *names.values()], "g")[0]
    dims = {names[x]: F.coalesce(topic(F.col(text_col)) if x == "topic" and made else F.col(x).cast("string"), F.lit(NONE)) for x in targets}
    rows = plain.withColumns({**dims, "tokens": token_count(F.col(text_col))})
    cells = rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens"))
    raked, _ = written(rake(cells, {names[x]: t for x, t in targets.items()}).select(*dims, F.col("g").alias(g)), "raked")
    share = F.when(F.col("tokens") > 0, fraction * F.coalesce(g, F.lit(0.0))).otherwise(F.lit(0.0))
    out = rows.join(few(raked), [*dims], "left").withColumn("probability", F.least(F.lit(1.0), share)).withColumn("sample_weight", F.greatest(F.lit(1.0), share))
    out = out.withColumn("kept", draw(F.col(id_col)) < F.col("probability"))
    kept = [F.col(f"`{x}`") for x in plain.columns] + ([F.col(names["topic"]).alias("topic")] if made else [])
    return out.select(*kept, *added)


def repeated(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The kept rows of mix(), each as often as its weight asks for, so that plain token counts meet the targets.

    Tokens stay about fraction times those of all documents, whatever the weights.
    """
    weight = F.col("probability") * F.col("sample_weight")
    times = F.floor(weight) + (draw(F.col(id_col)) < weight - F.floor(weight)).cast("int")
    time = fresh(mixed.columns, "time")[0]
    return mixed.where("kept").withColumn(time, F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), times).cast("int")))).drop(time)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), F.round("sample_weight", 6).alias("sample_weight"), "kept")


def _case(name: str, target: Targets) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}::DOUBLE" for k, v in target.named.items()) + f" ELSE {target.default}::DOUBLE END" if target.named else f"{target.default}::DOUBLE"


def sql(docs: str = "documents", targets: dict[str, Targets] | None = None, sweeps: int = SWEEPS) -> str:
    """The same in DuckDB SQL, sweep by sweep."""
    targets = targets or TARGETS
    parts = [
        f"""d AS (SELECT *, coalesce(source, 'none') AS _source, coalesce(lang, 'none') AS _lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), 'icense') THEN 'notice' ELSE 'prose' END AS _topic,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 2 * length(text) - length(replace(text, ' ', '')) - length(replace(text, chr(10), '')) + 1 END::BIGINT AS tokens FROM {docs})""",
        "w0 AS MATERIALIZED (SELECT _source, _lang, _topic, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS w FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    last = "w0"
    for k in range(sweeps):
        for name, target in targets.items():
            new = f"w{k + 1}_{name}"
            parts.append(f"""{new} AS MATERIALIZED (SELECT _source, _lang, _topic, tokens, w * f AS w FROM {last} JOIN
  (SELECT _{name}, t / sum(t) OVER () / s AS f FROM (SELECT _{name}, sum(w) AS s, {_case('_' + name, target)} AS t FROM {last} GROUP BY _{name})) USING (_{name}))""")
            last = new
    parts.append(f"g AS MATERIALIZED (SELECT _source, _lang, _topic, w / (SELECT sum(w) FROM {last}) * (SELECT sum(tokens) FROM {last}) / tokens AS g FROM {last})")
    parts.append("""m AS (SELECT d.*, CASE WHEN tokens > 0 THEN coalesce(g, 0) ELSE 0 END::DOUBLE AS share FROM d LEFT JOIN g USING (_source, _lang, _topic))""")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, _topic AS topic, tokens, round(least(1.0, share), 6) AS probability, round(greatest(1.0, share), 6) AS sample_weight,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < least(1.0, share) AS kept FROM m"""


ORACLE_SQL = sql()
