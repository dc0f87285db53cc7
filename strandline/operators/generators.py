"""Items made from the ids of rows: letter sequences, choices, template families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prng import uniform
from .dealing import dealt

RULES = ["alternation", "mirror", "progression", "modular_increment", "nested"]


def letter_items(items: DataFrame, seed: int = 42, length: int = 12, masked: int = 3) -> DataFrame:
    """item, rule, sequence (its end masked) and gold for each ``item``, the rules in turn over the letters A to F."""
    start = F.floor(uniform(seed, F.col("item"), "start") * 6)
    step = F.floor(uniform(seed, F.col("item"), "step") * 2) + 1
    other = (start + step) % 6

    def letter(i: Column) -> Column:
        mirrored = F.least(i, F.lit(length - 1) - i)
        number = (
            F.when(F.col("rule") == "alternation", F.when(i % 2 == 0, start).otherwise(other))
            .when(F.col("rule") == "mirror", (start + mirrored) % 6)
            .when(F.col("rule") == "progression", (start + F.floor(i / 2)) % 6)
            .when(F.col("rule") == "modular_increment", (start + i * step) % 6)
            .otherwise(F.when(F.floor(i / 3) % 2 == 0, (start + i % 3) % 6).otherwise((other + i % 3) % 6))
        )
        return F.substring(F.lit("ABCDEF"), (number + 1).cast("int"), F.lit(1))

    names = F.element_at(F.array(*map(F.lit, RULES)), (F.col("item") % len(RULES) + 1).cast("int"))
    rows = items.select("item").withColumn("rule", names)
    full = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), letter), "")
    return rows.withColumn("full", full).select("item", "rule", F.substring("full", 1, length - masked).alias("sequence"), F.substring("full", length - masked + 1, masked).alias("gold"))


def choice_items(items: DataFrame, bank: DataFrame, ambiguous: float = 0.75, seed: int = 42, most: int = 100_000) -> DataFrame:
    """For each ``item`` one of a bank of words with two senses (place from 0, word, sense_a, sense_b): ambiguous or settled, the choices in random order.

    A bank of up to ``most`` words is broadcast.
    """
    size = bank.count()
    rows = items.select("item")
    rows = rows.withColumn("place", F.floor(uniform(seed, F.col("item"), "word") * size)).withColumn("swap", uniform(seed, F.col("item"), "swap") < 0.5).withColumn("open", uniform(seed, F.col("item"), "kind") < ambiguous)
    joined = rows.join(F.broadcast(bank) if size <= most else bank, "place")
    choices = F.when(F.col("swap"), F.array("sense_b", "sense_a")).otherwise(F.array("sense_a", "sense_b"))
    return joined.select("item", "word", choices.alias("choices"), F.when(F.col("open"), "AMBIGUOUS").otherwise("NOT_AMBIGUOUS").alias("gold_status"), F.when(~F.col("open"), F.when(F.col("swap"), "B").otherwise("A")).alias("gold_answer"))


OPERATORS = {"Add": lambda a, b: a + b, "Sub": lambda a, b: a - b, "Mult": lambda a, b: a * b, "Div": lambda a, b: a / b}


def expression(text: str, columns: dict[str, Column]) -> Column:
    """A Column for an arithmetic or comparing expression over named columns; anything else is refused.

    Division is a float's, ``//`` and ``%`` floor, ``and`` and ``or`` give
    booleans.
    """
    import ast

    compare = {"Lt": lambda a, b: a < b, "LtE": lambda a, b: a <= b, "Gt": lambda a, b: a > b, "GtE": lambda a, b: a >= b, "Eq": lambda a, b: a == b, "NotEq": lambda a, b: a != b}
    calls = {"min": F.least, "max": F.greatest, "abs": F.abs, "round": lambda x, d=None: F.bround(x) if d is None else F.bround(x, 0)}

    def of(node) -> Column:
        match node:
            case ast.Expression(body=body):
                return of(body)
            case ast.Constant(value=bool() | int() | float() as value):
                return F.lit(value)
            case ast.Name(id=name) if name in columns:
                return columns[name]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -of(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return of(x)
            case ast.BinOp(left=a, op=op, right=b):
                left, right = of(a), of(b)
                name = type(op).__name__
                if name in OPERATORS:
                    return OPERATORS[name](left, right)
                if name == "FloorDiv":
                    return F.floor(left / right)
                if name == "Mod":
                    return left - right * F.floor(left / right)
                if name == "Pow":
                    return F.pow(left, right)
            case ast.Compare(left=a, ops=ops, comparators=others):
                sides = [of(a), *map(of, others)]
                out = F.lit(True)
                for op, x, y in zip(ops, sides, sides[1:], strict=False):
                    out = out & compare[type(op).__name__](x, y)
                return out
            case ast.BoolOp(op=op, values=values):
                out = of(values[0]).cast("boolean")
                for x in values[1:]:
                    out = out & of(x).cast("boolean") if isinstance(op, ast.And) else out | of(x).cast("boolean")
                return out
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in calls:
                return calls[name](*map(of, args))
        raise ValueError(f"not allowed in an expression: {ast.dump(node)}")

    return of(ast.parse(text, mode="eval"))


def template_variants(families: DataFrame, template: str, variables: dict[str, tuple[Column | int, Column | int]], answer: str, constraints: list[str] = (), n: int = 5, tries: int = 500, seed: int = 42) -> DataFrame:
    """family, attempt, prompt, answer: of each ``family`` up to n different fillings of a template that meet its constraints, of ``tries`` candidates the first.

    A variable's bounds are numbers or columns of ``families``.
    """
    # few families make many candidates, so they are dealt before that
    rows = dealt(families, "family").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    bound = lambda x: x if isinstance(x, Column) else F.lit(x)
    for name, (low, high) in variables.items():
        rows = rows.withColumn(name, (bound(low) + F.floor(uniform(seed, F.col("family"), F.col("attempt"), name) * (bound(high) - bound(low) + 1))).cast("long"))
    columns = {name: F.col(name) for name in variables}
    for rule in constraints:
        rows = rows.filter(expression(rule, columns))
    from ..functions.text import number_text, render

    # a family has ``tries`` candidates at most
    order = Window.partitionBy("family").orderBy("attempt")
    first = rows.groupBy("family", *variables).agg(F.min("attempt").alias("attempt")).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n)
    values = F.map_from_arrays(F.array(*map(F.lit, variables)), F.array(*(F.col(v).cast("string") for v in variables)))
    return first.select("family", "attempt", render(F.lit(template), values).alias("prompt"), number_text(expression(answer, columns).cast("double")).alias("answer"))


def synthetic_drift(samples: DataFrame, severities: list[float], seed: int = 0) -> DataFrame:
    """level, sample, correct and entropy of a made-up model that gets worse with severity, for each ``sample``; noise by Box-Muller."""
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(float(x)).alias("severity")) for k, x in enumerate(severities)))
    rows = samples.select("sample", F.inline(levels))
    key = lambda name: uniform(seed, F.col("sample"), F.col("level"), name)
    normal = F.sqrt(-2 * F.ln(F.greatest(key("a"), F.lit(1e-12)))) * F.cos(2 * F.pi() * key("b"))
    difficulty = uniform(seed, F.col("sample"), "difficulty")
    return rows.select("level", "severity", "sample", (difficulty < 0.9 - F.col("severity")).cast("int").alias("correct"), (1 + 2 * F.col("severity") + 0.2 * normal).alias("entropy"))


def unique_utterances(rows: DataFrame, by: str, text: str, n: int, seed: int = 42) -> DataFrame:
    """n different texts of each class, in a hash order; an error where a class has fewer.

    Keys are ranked as hashes, by class and with ties, and only the texts of
    those that are among the first of their class are moved and ranked whole.
    """
    from ..functions.text import dedup_key
    from .checkpoints import saved

    key = dedup_key(F.col(text))
    own = F.struct(F.col(by).alias("by"), F.md5(F.col("_key")).alias("md5"))
    hashed = rows.withColumn("_key", key).select(own.alias("_id"), F.col(by).alias("_by"), uniform(seed, F.col("_key")).alias("_u"))
    hashed = saved(hashed.distinct())
    rank = F.rank().over(Window.partitionBy("_by").orderBy("_u"))
    chosen = saved(hashed.withColumn("_r", rank).filter(F.col("_r") <= n).select("_id", "_u"))
    sizes = hashed.groupBy("_by").agg(F.count("*").alias("_n"))
    here = F.broadcast(chosen) if chosen.count() <= MOST_CHOSEN else chosen
    met = rows.withColumn("_key", key).withColumn("_own", own).join(here, F.col("_own").eqNullSafe(F.col("_id")))
    first = met.groupBy(by, "_key").agg(F.min(text).alias(text), F.first("_u").alias("_u"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_u", "_key"))
    ranked = first.withColumn("_k", place).filter(F.col("_k") <= n).join(sizes, F.col(by).eqNullSafe(F.col("_by")))
    short = F.when(F.col("_n") < n, F.raise_error(F.concat(F.lit("too few different texts: "), F.coalesce(F.col(by).cast("string"), F.lit("null"))))).otherwise(F.col(text))
    return ranked.select(by, short.alias(text))


#: So many chosen texts' hashes are broadcast at most; more are joined.
MOST_CHOSEN = 100_000
