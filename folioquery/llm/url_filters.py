"""URL rules, and a ratio of character language models for URLs that no rule covers.

URLs that the rules allow or block train two variable-order Markov models over
the characters of host and path. The probability of a character after up to
``ORDER`` characters is interpolated with that after one character less, down to
a uniform one, so unseen contexts fall back by themselves. A URL's score is the
mean over its characters of log P(allowed) - log P(blocked), in whole millionths
so that sums don't depend on their order. The decision threshold comes from
labelled URLs that trained nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import durable, table

#: (host, path, verdict): a rule fits its host and all subdomains, and paths that start with its path.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
ORDER = 4
#: Weight of the shorter context, in characters seen.
PRIOR = 4.0
#: Characters outside printable ASCII are one; with the two ends that makes the alphabet.
ALPHABET = 96
FOLDS = 5
UNIT = 1_000_000.0
#: A model of at most so many grams of five characters (under 50 MB) is broadcast.
BROADCAST_GRAMS = 400_000
START, END = "\x01", "\x02"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path) with the longest fitting rule and its verdict, or nulls."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    fits = F.lit(None).cast("struct<rule:string,ruling:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        own = (F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("ruling"))
        fits = F.when(own & F.col("path").startswith(rule_path), hit).otherwise(fits)
    return parts.withColumn("fit", fits).select("page_id", "host", "path", "fit.rule", "fit.ruling")


def _fold() -> Column:
    """Fold of a page by its host and path, so that copies of a URL share one."""
    return F.conv(F.substring(F.md5(F.concat("host", "path")), 1, 7), 16, 10).cast("long") % FOLDS


def _grams() -> Column:
    """Each character of host and path, and the end, with the ORDER characters before it; the characters are bound, so the text is split once."""
    text = F.regexp_replace(F.concat("host", "path"), "[^!-~]", "?")
    bound = F.array(F.split(F.concat(F.lit(START * ORDER), text, F.lit(END)), ""))

    def of(chars: Column) -> Column:
        places = F.sequence(F.lit(0), F.array_position(chars, END).cast("int") - 1 - ORDER)
        return F.transform(places, lambda i: F.concat(*[F.get(chars, i + k) for k in range(ORDER + 1)]))

    return F.transform(bound, of)[0]


def language_model(judged: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """(gram, llr): for each gram of the pages, the log ratio of its last character's probabilities, in millionths.

    Counts are summed per gram before they are shuffled. Lower orders are sums
    of the higher ones' rows: tables of distinct grams, of which those of one and
    two characters have at most ALPHABET**2 rows and are broadcast.
    """
    trains = _fold() > 0
    # what is carried beside the grams is computed before: a URL isn't copied for each of its characters
    marks = judged.select(_grams().alias("grams"), *[(trains & (F.col("ruling") == v)).cast("long").alias(k) for k, v in (("a", "allow"), ("b", "block"))])
    counted = (
        marks.select("a", "b", F.explode("grams").alias("gram"))
        .groupBy("gram")
        .agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    )
    counted = durable(counted)
    lower = None
    for k in range(order + 1):
        rows = counted.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = rows.groupBy(F.expr(f"left(g, {k})").alias("c")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
        small = F.broadcast if k < 2 else (lambda df: df)
        rows = rows.join(small(context), F.expr(f"left(g, {k})") == F.col("c"))
        if lower is None:
            rows = rows.withColumns({"pa": F.lit(1.0 / ALPHABET), "pb": F.lit(1.0 / ALPHABET)})
        else:
            small = F.broadcast if k < 3 else (lambda df: df)
            rows = rows.join(small(lower), F.expr(f"right(g, {k})") == F.col("l"))
        lower = rows.select(
            F.col("g").alias("l"),
            *[((F.col(x) + prior * F.col(f"p{x}")) / (F.col(f"c{x}") + prior)).alias(f"p{x}") for x in "ab"],
        )
    return durable(lower.select(F.col("l").alias("gram"), F.round(F.ln(F.col("pa") / F.col("pb")) * UNIT).cast("long").alias("llr")))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page.

    ``score`` is the mean log ratio less the threshold, in millionths; the
    verdict of a page without a rule is allow if it is 0 or more. The threshold
    lies between the two means of the labelled pages of fold 0, nearer to the
    class that varies less; without pages of both classes there it is 0. Pages
    keep their rows: ids may be null or repeat, null URLs have empty parts.
    Whole URLs are scored, however long: grams go by two hashes of the URL, which
    stays in its row. An empty table gives no rows; further columns aren't read.
    """
    urls = {"u1": F.xxhash64("host", "path"), "u2": F.xxhash64(F.lit(7), "path", "host")}
    judged = with_rules(pages, rules).withColumns(urls)
    model = language_model(judged)
    if model.count() <= BROADCAST_GRAMS:
        model = F.broadcast(model)
    # copies of a URL add up to the same mean
    grams = judged.select("u1", "u2", _grams().alias("grams")).select("u1", "u2", F.explode("grams").alias("gram")).join(model, "gram")
    sums = grams.groupBy("u1", "u2").agg(F.sum("llr").alias("total"), F.count(F.lit(1)).alias("n"))
    means = sums.select("u1", "u2", F.round(F.col("total") / F.col("n")).cast("long").alias("mean"))
    scored = durable(judged.join(means, ["u1", "u2"]).drop("u1", "u2"))
    verdict = F.coalesce("ruling", F.when(F.col("mean") >= F.col("threshold"), F.lit("allow")).otherwise(F.lit("block")))
    return (
        scored.crossJoin(F.broadcast(threshold(scored.where(_fold() == 0))))  # one row
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("mean") - F.col("threshold")).alias("score"))
    )


def threshold(labelled: DataFrame) -> DataFrame:
    """One row: where normal curves through both classes' scores have equal tails."""
    square = F.col("mean").cast("decimal(19,0)") * F.col("mean").cast("decimal(19,0)")
    stats = []
    for name in ("allow", "block"):
        mine = F.col("ruling") == name
        stats += [
            F.count_if(mine).cast("double").alias(f"n_{name}"),
            F.sum(F.when(mine, F.col("mean"))).cast("double").alias(f"s_{name}"),
            F.sum(F.when(mine, square)).cast("double").alias(f"q_{name}"),
        ]
    one = labelled.agg(*stats)
    mean = {k: F.expr(f"s_{k} / nullif(n_{k}, 0)") for k in ("allow", "block")}
    spread = {k: F.expr(f"sqrt(greatest(0, q_{k} / nullif(n_{k}, 0) - (s_{k} / nullif(n_{k}, 0)) * (s_{k} / nullif(n_{k}, 0))))") for k in mean}
    one = one.select(mean["allow"].alias("ma"), mean["block"].alias("mb"), spread["allow"].alias("sa"), spread["block"].alias("sb"))
    between = F.when(F.col("sa") + F.col("sb") > 0, F.expr("(ma * sb + mb * sa) / nullif(sa + sb, 0)")).otherwise(F.expr("(ma + mb) / 2"))
    return one.select(F.coalesce(between, F.lit(0.0)).alias("threshold"))


def op9_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql() -> str:
    cases = []
    for host, path, verdict in sorted(RULES, key=lambda r: -(len(r[0]) + len(r[1]))):
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, verdict))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    ruling = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    return f"CASE {rule} END AS rule, CASE {ruling} END AS ruling"


def _levels_sql() -> str:
    out = []
    for k in range(ORDER + 1):
        lower_a, lower_b, join = f"{1.0 / ALPHABET!r}::DOUBLE", f"{1.0 / ALPHABET!r}::DOUBLE", ""
        if k:
            lower_a, lower_b, join = "l.pa", "l.pb", f"JOIN p{k - 1} l ON right(r.g, {k}) = l.g"
        out.append(f"""
r{k} AS (SELECT right(gram, {k + 1}) AS g, sum(a) AS a, sum(b) AS b FROM counted GROUP BY 1),
c{k} AS (SELECT left(g, {k}) AS c, sum(a) AS ca, sum(b) AS cb FROM r{k} GROUP BY 1),
p{k} AS (
  SELECT r.g, (r.a::DOUBLE + {PRIOR}::DOUBLE * {lower_a}) / (c.ca::DOUBLE + {PRIOR}::DOUBLE) AS pa,
         (r.b::DOUBLE + {PRIOR}::DOUBLE * {lower_b}) / (c.cb::DOUBLE + {PRIOR}::DOUBLE) AS pb
  FROM r{k} r JOIN c{k} c ON left(r.g, {k}) = c.c {join}
)""")
    return ",".join(out)


OP9_SQL = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
),
judged AS (
  SELECT page_id, host, path, {_rule_sql()}, ('0x' || substr(md5(host || path), 1, 7))::BIGINT % {FOLDS} AS fold,
         repeat(chr(1), {ORDER}) || regexp_replace(host || path, '[^!-~]', '?', 'g') || chr(2) AS s
  FROM parts
),
numbered AS (SELECT row_number() OVER () AS row_no, * FROM judged),
exploded AS (
  SELECT row_no, ruling, fold, substr(s, i, {ORDER + 1}) AS gram
  FROM numbered, unnest(range(1, len(s)::BIGINT - {ORDER} + 1)) AS t(i)
),
counted AS (
  SELECT gram, coalesce(sum((fold > 0 AND ruling = 'allow')::BIGINT), 0) AS a, coalesce(sum((fold > 0 AND ruling = 'block')::BIGINT), 0) AS b
  FROM exploded GROUP BY gram
),{_levels_sql()},
model AS (SELECT g AS gram, round(ln(pa / pb) * {UNIT})::BIGINT AS llr FROM p{ORDER}),
sums AS (SELECT row_no, round(sum(llr)::DOUBLE / count(*))::BIGINT AS mean FROM exploded JOIN model USING (gram) GROUP BY row_no),
scored AS (SELECT * FROM numbered JOIN sums USING (row_no)),
stats AS (
  SELECT ruling, count(*)::DOUBLE AS n, sum(mean)::DOUBLE AS s, sum(mean::HUGEINT * mean)::DOUBLE AS q FROM scored
  WHERE fold = 0 AND ruling IS NOT NULL GROUP BY ruling
),
moments AS (
  SELECT max(CASE WHEN ruling = 'allow' THEN s / n END) AS ma, max(CASE WHEN ruling = 'block' THEN s / n END) AS mb,
         max(CASE WHEN ruling = 'allow' THEN sqrt(greatest(0, q / n - (s / n) * (s / n))) END) AS sa,
         max(CASE WHEN ruling = 'block' THEN sqrt(greatest(0, q / n - (s / n) * (s / n))) END) AS sb
  FROM stats
),
cut AS (SELECT coalesce(CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END, 0.0) AS threshold FROM moments)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN mean >= threshold THEN 'allow' ELSE 'block' END) AS verdict
FROM scored CROSS JOIN cut
"""
