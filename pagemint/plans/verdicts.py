"""Queries over verdicts: summary slices, headline, coverage, bootstrap, pairing, ranks, residuals, reliability, layout.

Verdicts are made from labels and documents by plain arithmetic on ids, so a second engine can make the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemint import vocab
from pagemint.operators import layout, statistics, summary
from pagemint.plans.registry import query

TYPES = list(vocab.TEST_TYPES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def verdicts(spark: SparkSession, folder: str, passed: str = "quality = 1") -> DataFrame:
    labelled = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang", "source"), "doc_id")
    listed = lambda names: "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    return labelled.selectExpr(
        "cast(doc_id as string) as test_id",
        "doc_id div 3 as page_id",
        "concat(source, '-', doc_id % 10) as document",
        "lang as suite",
        f"{listed(TYPES)}[cast(doc_id % 7 as int)] as test_type",
        f"{listed(['', *vocab.DERIVATIONS[:3]])}[cast(doc_id % 4 as int)] as derivation",
        "filter(array(if(doc_id % 2 = 0, 'heading', null), if(doc_id % 2 = 0, 'table', null), if(doc_id % 3 = 0, 'math', null)), x -> x is not null) as tags",
        "case when doc_id % 5 < 3 then array('text') when doc_id % 5 = 3 then array('number') else array('text', 'latex') end as arg_kinds",
        f"{passed} as passed",
    )


def verdicts_sql(passed: str = "quality = 1") -> str:
    listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"""
    SELECT cast(l.doc_id AS varchar) AS test_id, l.doc_id // 3 AS page_id, source || '-' || (l.doc_id % 10) AS document, lang AS suite,
      {listed(TYPES)}[l.doc_id % 7 + 1] AS test_type, {listed(['', *vocab.DERIVATIONS[:3]])}[l.doc_id % 4 + 1] AS derivation,
      list_filter([CASE WHEN l.doc_id % 2 = 0 THEN 'heading' END, CASE WHEN l.doc_id % 2 = 0 THEN 'table' END,
                   CASE WHEN l.doc_id % 3 = 0 THEN 'math' END], lambda x: x IS NOT NULL) AS tags,
      CASE WHEN l.doc_id % 5 < 3 THEN ['text'] WHEN l.doc_id % 5 = 3 THEN ['number'] ELSE ['text', 'latex'] END AS arg_kinds,
      {passed} AS passed
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def family_sql(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{t}' THEN '{f}'" for t, (f, _) in vocab.TEST_TYPES.items()) + " END"


def keyed_sql(passed: str = "quality = 1") -> str:
    return f"""
    SELECT page_id, document, test_id, passed, slice, key FROM (
      SELECT *, 'families' AS slice, {family_sql('test_type')} AS key FROM v UNION ALL
      SELECT *, 'per_suite', suite FROM v UNION ALL
      SELECT *, 'per_test_type', test_type FROM v UNION ALL
      SELECT *, 'per_tag', unnest(tags) FROM v WHERE test_type <> 'format' UNION ALL
      SELECT *, 'per_arg_kind', unnest(arg_kinds) FROM v WHERE test_type <> 'format' UNION ALL
      SELECT *, 'per_derivation', derivation FROM v WHERE test_type <> 'format' AND derivation <> '')"""


def counts_sql(name: str, passed: str) -> str:
    """CTEs v_name and name: (slice, key, document, tests, passed)."""
    return f"""v_{name} AS ({verdicts_sql(passed)}),
    {name} AS (SELECT slice, key, document, count(*) AS tests, count(*) FILTER (passed) AS passed
      FROM ({keyed_sql().replace('FROM v ', f'FROM v_{name} ').replace('FROM v)', f'FROM v_{name})')}) GROUP BY ALL)"""


def document_counts(spark: SparkSession, folder: str, passed: str = "quality = 1") -> DataFrame:
    return summary.document_counts(summary.page_counts(verdicts(spark, folder, passed)))


@query(
    "page_counts",
    f"WITH v AS ({verdicts_sql()}) SELECT page_id, document, slice, key, count(*) AS tests, count(*) FILTER (passed) AS passed FROM ({keyed_sql()}) GROUP BY ALL",
)
def page_counts(spark: SparkSession, folder: str) -> DataFrame:
    return summary.page_counts(verdicts(spark, folder)).drop("ids")


ENTRIES_SQL = f"""WITH {counts_sql('c', 'quality = 1')},
  e AS (SELECT slice, key, sum(passed) / sum(tests) AS score, cast(sum(tests) AS bigint) AS tests, count(*) AS documents,
          round(sum(tests) ^ 2 / sum(tests * tests), 1) AS effective_documents FROM c GROUP BY ALL)"""


@query(
    "summary_slices",
    ENTRIES_SQL
    + f""",
  s AS (SELECT slice, key, string_agg(test_id, ',' ORDER BY test_id) AS ids FROM ({keyed_sql().replace('FROM v ', 'FROM v_c ').replace('FROM v)', 'FROM v_c)')})
        WHERE slice IN ('per_tag', 'per_arg_kind') GROUP BY ALL)
  SELECT e.slice, e.key, round(score, 9) AS score, tests, documents, effective_documents,
    (SELECT string_agg(o.key, ',' ORDER BY o.key) FROM s o JOIN s m ON m.slice = o.slice AND m.ids = o.ids AND m.key <> o.key
     WHERE m.slice = e.slice AND m.key = e.key) AS same_tests_as
  FROM e""",
)
def summary_slices(spark: SparkSession, folder: str) -> DataFrame:
    rows = summary.summary(verdicts(spark, folder))
    return rows.select(
        "slice", "key", F.round("score", 9).alias("score"), "tests", "documents", "effective_documents",
        F.array_join("same_tests_as", ",").alias("same_tests_as"),
    )


@query(
    "headline",
    ENTRIES_SQL + " SELECT round(avg(score), 9) AS score FROM e WHERE slice = 'families' AND key IN ('text', 'tables', 'layout')",
)
def headline(spark: SparkSession, folder: str) -> DataFrame:
    return summary.headline(summary.summary(verdicts(spark, folder))).select(F.round("score", 9).alias("score"))


@query(
    "coverage",
    """WITH p AS (SELECT doc_id AS page_id FROM documents),
    a AS (SELECT doc_id AS page_id, CASE WHEN toxic = 1 THEN 'system' WHEN quality = 0 THEN 'unusable' END AS error FROM labels)
    SELECT count(*) AS pages, count(*) FILTER (a.page_id IS NOT NULL AND error IS NULL) AS scored,
      count(*) FILTER (error = 'system') AS failed_system, count(*) FILTER (error = 'unusable') AS failed_unusable,
      count(*) FILTER (a.page_id IS NULL) AS failed_no_answer, count(*) FILTER (error = 'not_scored') AS failed_not_scored,
      round(count(*) FILTER (a.page_id IS NOT NULL AND error IS NULL) / count(*), 9) AS coverage
    FROM p LEFT JOIN a ON p.page_id = a.page_id""",
)
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    answers = table(spark, folder, "labels").selectExpr(
        "doc_id as page_id", "case when toxic = 1 then 'system' when quality = 0 then 'unusable' end as error"
    )
    pages = table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"))
    return summary.coverage(pages, answers).withColumn("coverage", F.round("coverage", 9))


#: Draws that a second engine can make too: weights by arithmetic on the document's number and the draw.
DRAW_WEIGHT = "(nth * (draw + 3) * 7 + draw * 5 + nth) % 3"


def arithmetic_draws(counts: DataFrame, draws: int = 100) -> DataFrame:
    documents = counts.select("document").distinct().selectExpr("document", "row_number() over (order by document) as nth")
    return documents.selectExpr("document", "nth", f"explode(sequence(0, {draws - 1})) as draw").selectExpr(
        "document", "draw", f"cast({DRAW_WEIGHT} as bigint) as weight"
    ).where("weight > 0")


def hashed_sql(*parts: str) -> str:
    """``statistics.hashed`` for a second engine."""
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 13))::BIGINT"


def seeded_draws_sql(source: str, draws: int, seed: int = 0) -> str:
    weight = " + ".join(f"cast(u >= {b} AS bigint)" for b in statistics.poisson_bounds())
    return f"""w AS (SELECT document, draw, {weight} AS weight FROM (SELECT document, draw, {hashed_sql('document', 'draw', f"'{seed}'")} AS u
      FROM (SELECT DISTINCT document FROM {source}), range({draws}) r(draw)))"""


def draws_sql(source: str) -> str:
    return f"""w AS (SELECT document, draw, {DRAW_WEIGHT} AS weight FROM (
      SELECT document, row_number() OVER (ORDER BY document) AS nth FROM (SELECT DISTINCT document FROM {source})), range(100) r(draw))"""


def scores_sql(name: str) -> str:
    return f"""s_{name} AS (SELECT draw, slice, key, sum(weight * passed) / sum(weight * tests) AS score FROM {name} JOIN w USING (document) WHERE weight > 0 GROUP BY ALL),
    d_{name} AS (SELECT * FROM s_{name} UNION ALL SELECT draw, 'headline', '', avg(score) FROM s_{name}
      WHERE slice = 'families' AND key IN ('text', 'tables', 'layout') GROUP BY draw HAVING count(*) = 3),
    h_{name} AS (SELECT slice, key, document, tests, passed FROM {name} UNION ALL
      SELECT 'headline', '', document, sum(tests), sum(passed) FROM {name} WHERE slice = 'families' AND key IN ('text', 'tables', 'layout') GROUP BY document),
    m_{name} AS (SELECT avg(x) AS mean FROM (SELECT sum(passed) / sum(tests) AS x FROM {name}
      WHERE slice = 'families' AND key IN ('text', 'tables', 'layout') GROUP BY key)),
    q_{name} AS (SELECT slice, key, sum(passed) / sum(tests) AS pooled, cast(sum(tests) AS bigint) AS tests, count(*) AS documents,
      round(sum(tests) ^ 2 / sum(tests * tests), 1) AS effective_documents FROM h_{name} GROUP BY slice, key),
    p_{name} AS (SELECT slice, key, CASE WHEN slice = 'headline' THEN (SELECT mean FROM m_{name}) ELSE pooled END AS score,
      tests, documents, effective_documents FROM q_{name})"""


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 9) for c in columns})


def intervals_sql(draws_of: str, draws: int) -> str:
    return f"""WITH {counts_sql('c', 'quality = 1')}, {draws_of}, {scores_sql('c')},
    b AS (SELECT slice, key, count(*) AS draws, quantile_cont(score, 0.025) AS low, quantile_cont(score, 0.975) AS high FROM d_c GROUP BY ALL)
    SELECT slice, key, round(score, 9) AS score, CASE WHEN documents >= 5 AND draws >= {0.95 * draws} THEN round(low, 9) END AS low,
      CASE WHEN documents >= 5 AND draws >= {0.95 * draws} THEN round(high, 9) END AS high, tests, documents, effective_documents, coalesce(draws, 0) AS draws
    FROM p_c LEFT JOIN b USING (slice, key)"""


@query("intervals", intervals_sql(draws_sql("c"), 100))
def intervals(spark: SparkSession, folder: str) -> DataFrame:
    counts = document_counts(spark, folder)
    return rounded(statistics.intervals(counts, resamples=100, draws=arithmetic_draws(counts)), "score", "low", "high")


@query("intervals_seeded", intervals_sql(seeded_draws_sql("c", 1000), 1000))
def intervals_seeded(spark: SparkSession, folder: str) -> DataFrame:
    """1,000 draws by hashes."""
    return rounded(statistics.intervals(document_counts(spark, folder), resamples=1000, seed=0), "score", "low", "high")


@query(
    "paired",
    f"""WITH {counts_sql('a', 'quality = 1')}, {counts_sql('b', 'toxic = 0')}, {draws_sql('a')}, {scores_sql('a')}, {scores_sql('b')},
    g AS (SELECT slice, key, count(*) AS draws, quantile_cont(x.score - y.score, 0.025) AS low, quantile_cont(x.score - y.score, 0.975) AS high
      FROM d_a x JOIN d_b y USING (draw, slice, key) GROUP BY ALL),
    r AS (SELECT slice, key, x.score AS a, y.score AS b, CASE WHEN x.documents >= 5 AND draws >= 95 THEN low END AS low,
      CASE WHEN x.documents >= 5 AND draws >= 95 THEN high END AS high, x.documents, x.effective_documents, coalesce(draws, 0) AS draws
      FROM p_a x JOIN p_b y USING (slice, key) LEFT JOIN g USING (slice, key))
    SELECT slice, key, round(a, 9) AS a, round(b, 9) AS b, round(a - b, 9) AS gap, round(low, 9) AS low, round(high, 9) AS high,
      coalesce(low > 0 OR high < 0, false) AS excludes_zero, documents, effective_documents, draws FROM r""",
)
def paired(spark: SparkSession, folder: str) -> DataFrame:
    a, b = document_counts(spark, folder), document_counts(spark, folder, "toxic = 0")
    return rounded(statistics.paired(a, b, resamples=100, draws=arithmetic_draws(a)), "a", "b", "gap", "low", "high")


@query(
    "pairing",
    f"""WITH v AS ({verdicts_sql()}), a AS (SELECT document, count(*) AS n FROM v WHERE page_id % 5 <> 0 GROUP BY ALL),
    b AS (SELECT document, count(*) AS n FROM v WHERE page_id % 5 <> 1 GROUP BY ALL)
    SELECT count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS documents_paired, count(*) FILTER (b.n IS NULL) AS unpaired_a,
      count(*) FILTER (a.n IS NULL) AS unpaired_b, count(*) FILTER (a.n <> b.n) AS documents_mismatched
    FROM a FULL JOIN b ON a.document = b.document""",
)
def pairing(spark: SparkSession, folder: str) -> DataFrame:
    counts = lambda but: summary.document_counts(summary.page_counts(verdicts(spark, folder).where(f"page_id % 5 <> {but}")))
    return statistics.pairing(counts(0), counts(1))


@query(
    "average_ranks",
    """SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal / 100))
      + (count(*) OVER (PARTITION BY c_mktsegment, round(c_acctbal / 100)) - 1) / 2 AS rank FROM customer""",
)
def average_ranks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal") / 100).alias("v"))
    return statistics.average_ranks(rows, "v", ["c_mktsegment"]).drop("v")


@query(
    "spearman",
    """WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS x,
      rank() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice)) + (count(*) OVER (PARTITION BY p_brand, round(p_retailprice)) - 1) / 2 AS y FROM part)
    SELECT p_brand, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 9) END AS spearman FROM r GROUP BY p_brand""",
)
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_brand", "p_size", F.round("p_retailprice").alias("price"))
    return rounded(statistics.spearman(rows, "p_size", "price", ["p_brand"]), "spearman")


@query(
    "residuals",
    """SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER g - covar_pop(p_retailprice, p_size) OVER g
      / nullif(var_pop(p_size) OVER g, 0) * (p_size - avg(p_size) OVER g), 6) AS residual FROM part WINDOW g AS (PARTITION BY p_brand)""",
)
def residuals(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    left = statistics.residuals(rows, "p_retailprice", "p_size", ["p_brand"])
    return left.select("p_partkey", F.round("residual", 6).alias("residual"))


SYSTEMS, SPLITS = 6, 20


def ranks_sql(x: str, y: str, name: str) -> str:
    """(slice, key, n, value): the median over splits of the stepped-up correlation of ranks of x and y."""
    g = "PARTITION BY slice, key, split"
    rank = lambda c: f"rank() OVER ({g} ORDER BY {c}) + (count(*) OVER ({g}, {c}) - 1) / 2"
    return f"""r_{name} AS (SELECT slice, key, split, {rank(x)} AS rx, {rank(y)} AS ry FROM sides WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    c_{name} AS (SELECT slice, key, split, greatest(-1.0, least(1.0, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)))) AS c
      FROM r_{name} GROUP BY slice, key, split HAVING stddev_pop(rx) > 0 AND stddev_pop(ry) > 0),
    {name} AS (SELECT slice, key, count(*) AS n, median(CASE WHEN c = -1 THEN -1.0 ELSE greatest(-1.0, least(1.0, 2 * c / (1 + c))) END) AS value FROM c_{name} GROUP BY slice, key)"""


@query(
    "reliability",
    f"""WITH v AS ({verdicts_sql()}),
    x AS (SELECT v.*, 's' || k AS system, passed AND {hashed_sql('test_id', 'k')} % 20 >= 2 * k AS ok FROM v, range({SYSTEMS}) s(k)),
    kv AS ({keyed_sql()}),
    c AS (SELECT system, slice, key, kv.document, count(*) AS tests, count(*) FILTER (ok) AS passed FROM kv JOIN x USING (test_id) GROUP BY ALL),
    t AS (SELECT system, document, count(*) AS tests, count(*) FILTER (ok) AS passed FROM x GROUP BY ALL),
    u AS (SELECT document, min(tests) AS tests FROM t GROUP BY document HAVING count(*) = {SYSTEMS} AND min(tests) = max(tests)),
    o AS (SELECT document, split, row_number() OVER (PARTITION BY split ORDER BY tests, {hashed_sql('document', 'split', "'0'")}, document) - 1 AS nth FROM u, range({SPLITS}) s(split)),
    h AS (SELECT document, split, CASE WHEN (nth + {hashed_sql('split', '(nth // 2)', "'0'")} % 2) % 2 = 0 THEN 'A' ELSE 'B' END AS half FROM o),
    d AS (SELECT slice, key, count(*) AS documents, cast(sum(tests) AS bigint) AS tests, sum(tests) ^ 2 / sum(tests * tests) AS worth
      FROM (SELECT slice, key, document, max(c.tests) AS tests FROM c SEMI JOIN u USING (document) GROUP BY ALL) GROUP BY slice, key),
    ih AS (SELECT slice, key, split, half, system, sum(tests) AS n, sum(passed) AS p FROM c JOIN h USING (document) GROUP BY ALL),
    ah AS (SELECT split, half, system, sum(tests) AS tn, sum(passed) AS tp FROM t JOIN h USING (document) GROUP BY ALL),
    rates AS (SELECT slice, key, split, half, system, p / n AS rate, (tp - p) / nullif(tn - n, 0) AS rest FROM ih JOIN ah USING (split, half, system)),
    e AS (SELECT *, round(rate - avg(rate) OVER g - covar_pop(rate, rest) OVER g / nullif(var_pop(rest) OVER g, 0) * (rest - avg(rest) OVER g), 12) AS residual
      FROM rates WINDOW g AS (PARTITION BY slice, key, split, half)),
    sides AS (SELECT slice, key, split, system, any_value(rate) FILTER (half = 'A') AS a1, any_value(rate) FILTER (half = 'B') AS b1,
      any_value(residual) FILTER (half = 'A') AS a2, any_value(residual) FILTER (half = 'B') AS b2 FROM e GROUP BY ALL),
    {ranks_sql('a1', 'b1', 'agree')}, {ranks_sql('a2', 'b2', 'beyond')},
    j AS (SELECT d.slice, d.key, documents, round(worth, 1) AS effective_documents, tests,
      CASE WHEN worth < 10 THEN 'worth less than 10 documents' WHEN tests >= (SELECT sum(tests) FROM u) THEN 'the slice is everything' END AS why,
      coalesce(agree.n, 0) AS an, coalesce(beyond.n, 0) AS bn, agree.value AS av, beyond.value AS bv
      FROM d LEFT JOIN agree USING (slice, key) LEFT JOIN beyond USING (slice, key)),
    q AS (SELECT *, CASE WHEN why IS NULL AND an >= {0.8 * SPLITS} THEN av END AS agreement, CASE WHEN why IS NULL AND bn >= {0.8 * SPLITS} THEN bv END AS beyond_headline FROM j)
    SELECT slice, key, documents, effective_documents, tests, round(agreement, 9) AS agreement, round(beyond_headline, 9) AS beyond_headline,
      CASE WHEN why IS NULL THEN an ELSE 0 END AS agreement_splits, CASE WHEN why IS NULL THEN bn ELSE 0 END AS beyond_splits,
      coalesce(beyond_headline < 0.7, false) AS flag,
      CASE WHEN beyond_headline < 0.7 AND (agreement IS NULL OR agreement < 0.7) THEN 'noisy' WHEN beyond_headline < 0.7 THEN 'redundant' END AS kind,
      coalesce(why, CASE WHEN agreement IS NULL AND beyond_headline IS NULL THEN 'agreement and beyond_headline: no value in over a fifth of the splits'
        WHEN agreement IS NULL THEN 'agreement: no value in over a fifth of the splits'
        WHEN beyond_headline IS NULL THEN 'beyond_headline: no value in over a fifth of the splits' END) AS reason FROM q""",
)
def reliability(spark: SparkSession, folder: str) -> DataFrame:
    """Six systems whose verdicts are labels turned over for ever more documents."""
    k = F.explode(F.sequence(F.lit(0), F.lit(SYSTEMS - 1)))
    own = verdicts(spark, folder).withColumn("k", k).withColumn("system", F.concat(F.lit("s"), F.col("k")))
    own = own.withColumn("passed", F.col("passed") & (statistics.hashed(F.col("test_id"), F.col("k")) % 20 >= 2 * F.col("k")))
    counted = F.count("*").alias("tests"), F.count_if("passed").alias("passed")
    counts = summary.slice_keys(own).groupBy("system", "slice", "key", "document").agg(*counted)
    totals = own.groupBy("system", "document").agg(*counted)
    return rounded(statistics.reliability(counts, totals, splits=SPLITS), "agreement", "beyond_headline")


#: Boxes by arithmetic on part keys: three blocks and a place of two lines for each part.
PLACE = "array(array(0.1, 0.1, 0.1 + (p_size % 7 + 1) / 10.0, 0.2), array(0.1, 0.2, 0.3, 0.3))"
BLOCK_ROWS = [
    ("p_size % 11", "array(0.0, 0.0, 1.0, 1.0)"),
    ("(p_partkey) % 11", "array(0.05, 0.05, 0.1 + (p_partkey % 9) / 10.0, 0.35)"),
    ("(p_partkey + 3) % 11", "array(0.1, 0.05, 0.1 + (p_partkey % 6) / 10.0, 0.25)"),
]


@query(
    "layout_kind",
    "WITH p AS (SELECT p_partkey, p_size, "
    + f"{list(vocab.LABELS)}[p_partkey % 3 + 1] AS kind, [[0.1, 0.1, 0.1 + (p_size % 7 + 1) / 10.0, 0.2], [0.1, 0.2, 0.3, 0.3]]::double[][] AS place FROM part), "
    + "b AS ("
    + " UNION ALL ".join(
        f"SELECT p_partkey, {i} AS pos, {list(vocab.LABELS)}[{n} + 1] AS label, {b.replace('array(', '[').replace(')', ']', 1) if b.count('(') == 1 else '[' + b[6:-1] + ']'}::double[] AS bbox FROM part"
        for i, (n, b) in enumerate(BLOCK_ROWS)
    )
    + """),
    c AS (SELECT p.p_partkey, kind, pos, label, greatest(0, bbox[3] - bbox[1]) * greatest(0, bbox[4] - bbox[2]) AS size,
      list_sum(list_transform(place, lambda q: greatest(0, least(q[3], bbox[3]) - greatest(q[1], bbox[1])) * greatest(0, least(q[4], bbox[4]) - greatest(q[2], bbox[2]))))
      / list_sum(list_transform(place, lambda q: (q[3] - q[1]) * (q[4] - q[2]))) AS cover FROM p JOIN b USING (p_partkey)),
    h AS (SELECT p_partkey, arg_min(label, round(size, 12) + pos * 1e-14) AS held_by FROM c WHERE cover >= 0.5 - 1e-9 GROUP BY p_partkey)
    SELECT p.p_partkey, p.kind, held_by, coalesce(CASE WHEN p.kind = 'text' THEN held_by IN ('text', 'list', 'form') ELSE held_by = p.kind END, false) AS passed
    FROM p LEFT JOIN h USING (p_partkey)""",
)
def layout_kind(spark: SparkSession, folder: str) -> DataFrame:
    labels = "array(" + ", ".join(f"'{x}'" for x in vocab.LABELS) + ")"
    blocks = ", ".join(
        f"named_struct('label', {labels}[cast({n} as int)], 'bbox', cast({b} as array<double>))" for n, b in BLOCK_ROWS
    )
    rows = table(spark, folder, "part").selectExpr(
        "p_partkey", f"{labels}[cast(p_partkey % 3 as int)] as kind", f"cast({PLACE} as array<array<double>>) as place", f"array({blocks}) as blocks"
    )
    return layout.layout_kind(rows).select("p_partkey", "kind", "held_by", "passed")
