"""Generated items, and the structure of a small corpus of programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.perturb import SEVERITIES
from ..functions.prng import uniform_sql
from ..operators import generators as G
from ..operators import structure as X
from .registry import query, table

#: (repository, program, source); small enough to read, with loops, branches, rebinding and nested scopes.
PROGRAMS = [
    ("sums", "running", "def running(xs):\n    total = 0\n    out = []\n    for x in xs:\n        total = total + x\n        out.append(total)\n    return out\n"),
    ("sums", "clipped", "def clipped(xs, low, high):\n    out = []\n    for x in xs:\n        if x < low:\n            x = low\n        elif x > high:\n            x = high\n        out.append(x)\n    return out\n"),
    ("search", "bisect", "def bisect(xs, y):\n    low = 0\n    high = len(xs)\n    while low < high:\n        middle = (low + high) // 2\n        if xs[middle] < y:\n            low = middle + 1\n        else:\n            high = middle\n    return low\n"),
    ("search", "first", "def first(xs, test):\n    for k, x in enumerate(xs):\n        if test(x):\n            return k\n    return None\n"),
    ("text", "vowels", "def vowels(s):\n    n = 0\n    for c in s:\n        if c in 'aeiou':\n            n += 1\n    return n\n"),
    ("text", "straight", "def straight(a, b):\n    c = a + b\n    d = c * a\n    return d - b\n"),
    ("nested", "counter", "def counter():\n    n = 0\n    def step(k):\n        m = n + k\n        return m\n    return step\n"),
]


def programs(spark, sf_dir):
    """A program for each part: the key picks a pattern and names the function, the size is the number that counters start from, the brand its repository."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in PROGRAMS)), (F.col("p_partkey") % len(PROGRAMS) + 1).cast("int"))
    rows = part.select(F.col("p_brand").alias("repository"), "p_partkey", "p_size", pick(1).alias("name"), pick(2).alias("source"))
    named = rows.withColumn("program", F.concat_ws("_", "name", "p_partkey"))
    source = F.regexp_replace(F.regexp_replace("source", F.concat(F.lit(r"\bdef "), "name", F.lit(r"\b")), F.concat(F.lit("def "), "program")), F.lit(r"\b0\b"), F.col("p_size").cast("string"))
    return named.select("repository", "program", source.alias("source"))


@query()
def program_bindings(spark, sf_dir):
    """Each use of a name with the place of the definition that it is bound to."""
    names = X.program_names(programs(spark, sf_dir)).withColumn("use", (~F.col("is_definition")).cast("int"))
    return X.asof(names, ["program", "scope", "name"], ["start", "use"], F.col("is_definition"), "start", ["program", "name"]).select("program", "name", "start", "bound")


@query()
def program_graphs(spark, sf_dir):
    edges = X.program_graph(programs(spark, sf_dir))
    nodes = edges.select("program", F.col("a").alias("node")).union(edges.select("program", "b")).distinct()
    return X.graph_features(edges, nodes, "program")


@query(f"""WITH g AS (SELECT DISTINCT p_brand AS b FROM part), k AS (SELECT b, row_number() OVER (ORDER BY {uniform_sql('42', 'b')}, b) AS k, count(*) OVER () AS n FROM g)
SELECT ['running', 'clipped', 'bisect', 'first', 'vowels', 'straight', 'counter'][p_partkey % 7 + 1] || '_' || p_partkey AS program, p_brand AS repository, CASE WHEN k <= round_even(n * 0.4, 0) THEN 'train' WHEN k <= round_even(n * (0.4 + 0.3), 0) THEN 'validation' ELSE 'test' END AS split FROM part JOIN k ON b = p_brand""")
def repository_split(spark, sf_dir):
    from ..operators.curation import split_groups

    return split_groups(programs(spark, sf_dir), "repository", [("train", 0.4), ("validation", 0.3), ("test", 0.3)]).select("program", "repository", "split")


@query(f"""WITH bank AS (SELECT n_nationkey AS place, n_name AS word, x.r_name AS sense_a, y.r_name AS sense_b FROM nation JOIN region x ON n_regionkey = x.r_regionkey JOIN region y ON (n_regionkey + 1) % 5 = y.r_regionkey),
i AS (SELECT s_suppkey AS item, floor({uniform_sql('42', 's_suppkey', "'word'")} * (SELECT count(*) FROM bank)) AS place, {uniform_sql('42', 's_suppkey', "'swap'")} < 0.5 AS swap, {uniform_sql('42', 's_suppkey', "'kind'")} < 0.75 AS open FROM supplier)
SELECT item, word, CASE WHEN swap THEN [sense_b, sense_a] ELSE [sense_a, sense_b] END AS choices, CASE WHEN open THEN 'AMBIGUOUS' ELSE 'NOT_AMBIGUOUS' END AS gold_status, CASE WHEN NOT open THEN CASE WHEN swap THEN 'B' ELSE 'A' END END AS gold_answer FROM i JOIN bank USING (place)""")
def choice_items(spark, sf_dir):
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    sense = lambda name, shift: region.select(F.pmod(F.col("r_regionkey") - shift, F.lit(5)).alias("n_regionkey"), F.col("r_name").alias(name))
    bank = table(spark, sf_dir, "nation").join(sense("sense_a", 0), "n_regionkey").join(sense("sense_b", 1), "n_regionkey")
    bank = bank.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("word"), "sense_a", "sense_b")
    return G.choice_items(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item")), bank)


_V = lambda name: uniform_sql("42", "family", "attempt", f"'{name}'")


@query(f"""WITH t AS (SELECT s_suppkey AS family, s_nationkey AS h, unnest(range(100)) AS attempt FROM supplier), v AS (SELECT family, attempt, (2 + floor({_V('a')} * 8))::BIGINT AS a, (3 + floor({_V('b')} * (h + 1)))::BIGINT AS b, (1 + floor({_V('c')} * 10))::BIGINT AS c FROM t),
k AS (SELECT family, a, b, c, min(attempt) AS attempt FROM v WHERE c < a * b AND a <> b GROUP BY ALL)
SELECT family, attempt::INT AS attempt, a || ' boxes of ' || b || ' pens, ' || c || ' lost. How many are left?' AS prompt, CAST(a * b - c AS VARCHAR) AS answer FROM k QUALIFY row_number() OVER (PARTITION BY family ORDER BY attempt) <= 5""")
def template_variants(spark, sf_dir):
    families = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("family"), (3 + F.col("s_nationkey")).alias("high"))
    return G.template_variants(families, "{a} boxes of {b} pens, {c} lost. How many are left?", {"a": (2, 9), "b": (3, F.col("high")), "c": (1, 10)}, "a * b - c", ["c < a * b", "a != b"], n=5, tries=100)


_D = lambda name: uniform_sql("0", "c_custkey", "level", f"'{name}'")


@query(f"""WITH s AS (SELECT unnest(range({len(SEVERITIES)})) AS level, unnest({SEVERITIES})::DOUBLE AS severity), r AS (SELECT level::INT AS level, 1 + 2 * severity + 0.2 * sqrt(-2 * ln(greatest({_D('a')}, 1e-12))) * cos(2 * pi() * {_D('b')}) AS e FROM customer, s),
m AS (SELECT level, count(e) AS n, avg(e) AS mean, stddev_pop(e) AS sd FROM r GROUP BY level), z AS (SELECT mean AS m0, sd AS s0 FROM m WHERE level = 0) SELECT level, n, round(mean, 9) AS mean, round((mean - m0) / s0, 9) AS z FROM m, z""")
def synthetic_drift_levels(spark, sf_dir):
    from ..operators.drift import level_means

    rows = G.synthetic_drift(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample")), SEVERITIES)
    return level_means(rows, "entropy").select("level", "n", F.round("mean", 9).alias("mean"), F.round("z", 9).alias("z"))


@query()
def contrast_pairs(spark, sf_dir):
    from ..operators.rewrites import contrast_pairs as run

    return run(programs(spark, sf_dir)).select("program", "kind", "rewritten", "same_shape")


@query()
def injected_bugs(spark, sf_dir):
    from ..operators.rewrites import injected_bugs as run

    return run(programs(spark, sf_dir))


@query()
def styled_turns(spark, sf_dir):
    from ..functions.noise import style

    rows = table(spark, sf_dir, "conversations").withColumn("item", F.col("conv_id") * 1000 + F.col("turn"))
    return rows.select("conv_id", "turn", F.md5(style(F.col("text"), F.col("item"), {"plain": 3, "lower": 2, "typo": 2, "short": 1, "polite": 1, "no_mark": 1})).alias("text_md5"))
