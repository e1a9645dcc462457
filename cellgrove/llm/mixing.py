"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed over cells of source, language and topic. The cells' draws are raked in turn to each target
marginal, no cell above what it has, until a whole round moves nothing by more than ``SETTLED`` (or ``ROUNDS`` rounds are over). That is done at several
rates side by side, from the largest that the categories' own tokens allow (at most ``rate``) down to a tenth of it; the largest rate counts at which the
expected draw meets every marginal within ``ERROR``, else that with the least error. A document's chance of being drawn is its cell's
draw over the cell's tokens; it is drawn if a hash of its id, as a number in [0, 1), is below that. ``rate`` and ``off`` tell the part of all
tokens that is expected to be drawn and the largest difference of an expected share from its target; ``marginals`` reports all of them.

A document's form stands for its topic: prose, table, marked up or shouted, by counts of bars, capitals and signs; ``topic`` takes any other column.

Categories are those that the targets name and ``other`` for all the rest, so the cells are at most the product of
the targets' lengths: their size is bounded by the specification, whatever the data, and they alone are sent to tasks.
Sums over cells are partial sums first, so a source with a third of all rows is no hot task.

Defined results: null sources, languages and topics are ``other``; a null text has no tokens and topic ``prose``; a cell without tokens has
chance 1 if anything is drawn at all (its documents cost nothing); targets of categories without tokens are spread over the others in
proportion; without tokens, or with targets that are all zero, all others have chance 0; equal hashes are drawn alike, as are rows that repeat an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.llm.common import free_name

ROUNDS, RATE, SEED = 300, 0.5, "mix-1"
SETTLED, ERROR = 1e-12, 0.002
#: Rates that are tried, as parts of the largest.
STEPS = [1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]
OTHER = "other"

#: The query's targets.
TARGETS = {
    "source": {"src0": 0.15, "src1": 0.10, "src2": 0.10, OTHER: 0.65},
    "lang": {"en": 0.40, "de": 0.20, "fr": 0.20, "es": 0.15, OTHER: 0.05},
    "topic": {"prose": 0.70, "table": 0.10, "marked": 0.15, "shout": 0.05, OTHER: 0.0},
}
CAPITALS, SIGNS = "[A-Z]{2,}+", "[#$%&*+=<>{}\\[\\]^~`@/_\\\\]++"
WHITE, BLACK = "[ \\x09-\\x0D]", "[^ \\x09-\\x0D]"


def form_of(text: Column) -> Column:
    """A table has two bars or tabs a line and four at least; a shouted text a third of its characters in runs of capitals; a marked one a tenth in signs."""
    without = lambda x: F.length(text) - F.length(x)
    times = lambda *xs: sum(without(F.replace(text, F.lit(x))) for x in xs)
    run = lambda x: without(F.regexp_replace(text, x, ""))
    return F.when((times("|", "\t") >= 4) & (times("|", "\t") >= 2 * times("\n") + 2), "table").when((F.length(text) > 0) & (3 * run(CAPITALS) >= F.length(text)), "shout").when((F.length(text) > 0) & (10 * run(SIGNS) >= F.length(text)), "marked").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Words between white space: each is replaced by one character, so that no list of words is built."""
    return F.when(F.rlike(text, F.lit(BLACK)), F.length(F.regexp_replace(text, f"{WHITE}*+{BLACK}++{WHITE}*+", "."))).otherwise(0).cast("long")


def _category(column: Column, target: dict[str, float]) -> Column:
    return F.when(column.isin([k for k in target if k != OTHER]), column).otherwise(OTHER)


def _position(names: list[str], dim: str) -> Callable[[Column], Column]:
    return lambda cell: F.array_position(F.array(*map(F.lit, names)), cell[dim]).cast("int") - 1


def cells_of(df: DataFrame, columns: dict[str, Column], tokens: Column, targets: dict[str, dict[str, float]]) -> DataFrame:
    """One row per cell: its categories and tokens."""
    return df.select(*(_category(columns[d], targets[d]).alias(d) for d in targets), tokens.alias("tokens")).groupBy(*targets).agg(F.sum("tokens").alias("tokens"))


def calibrate(cells: DataFrame, targets: dict[str, dict[str, float]], rate: float = RATE, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with weight (share of the draw), probability, rate and off. The cells, bounded by the targets, are arrays of one row; each rate is a row of its own."""
    dims = list(targets)
    names = [[*targets[d], *([] if OTHER in targets[d] else [OTHER])] for d in dims]
    one = cells.agg(F.sort_array(F.collect_list(F.struct(*dims, "tokens"))).alias("c")).select("c", F.transform("c", lambda x: x["tokens"].cast("double")).alias("s"))
    place = F.array(*(F.transform("c", _position(names[i], dims[i])) for i in range(len(dims))))
    add = lambda a, first=0.0: F.aggregate(a, F.lit(first), lambda u, v: u + v)
    one = one.select("c", "s", place.alias("p"), add(F.col("s")).alias("total"))

    def sums(x: Column, where: Column, k: Column) -> Column:
        return add(F.zip_with(x, where, lambda v, p: F.when(p == k, v).otherwise(0.0)))

    def totals(x: Column, i: int) -> Column:
        return F.transform(F.array(*map(F.lit, range(len(names[i])))), lambda k: sums(x, F.col("p")[i], k))

    one = one.select("*", F.array(*(totals(F.col("s"), i) for i in range(len(dims)))).alias("supply"))
    wanted = [F.zip_with(F.array(*(F.lit(float(targets[d].get(k, 0.0))) for k in names[i])), F.col("supply")[i], lambda w, s: F.when(s > 0, w).otherwise(0.0)) for i, d in enumerate(dims)]
    one = one.select("*", F.array(*wanted).alias("w"))
    one = one.select("*", F.transform("w", lambda w: F.transform(w, lambda x: F.when(add(w) > 0, x / add(w)).otherwise(0.0))).alias("goal"))
    most = F.least(F.lit(float(rate)), F.lit(1.0), *(F.array_min(F.zip_with(F.col("goal")[i], F.col("supply")[i], lambda g, s: F.when(g > 0, s / (g * F.col("total"))))) for i in range(len(dims))))
    on = (F.col("total") > 0) & F.forall("goal", lambda g: add(g) > 0)
    tried = one.select("*", F.when(on, F.coalesce(most, F.lit(0.0))).otherwise(0.0).alias("most")).select("*", F.explode(F.array(*map(F.lit, STEPS))).alias("part"))
    tried = tried.withColumn("r", F.col("most") * F.col("part"))

    # a step is two phases: the factors of one marginal's categories, then the draws; a settled state stays
    n = len(dims)
    state = F.struct(F.transform("s", lambda v: v * F.col("r")).alias("x"), F.array().cast("array<double>").alias("f"), F.lit(0.0).alias("moved"), F.lit(False).alias("done"))

    def step(a: Column, j: Column) -> Column:
        d = F.floor(j / 2).cast("int") % n
        where, goal = F.get(F.col("p"), d), F.get(F.col("goal"), d)
        factors = F.transform(goal, lambda g, k: (lambda t: F.when(t > 0, g * F.col("r") * F.col("total") / t).otherwise(0.0))(sums(a["x"], where, k)))
        far = F.greatest(F.when(d == 0, 0.0).otherwise(a["moved"]), F.array_max(F.zip_with(a["f"], goal, lambda f, g: F.when(g > 0, F.abs(f - 1)).otherwise(0.0))))
        draws = F.transform(F.arrays_zip(a["x"].alias("x"), where.alias("p"), F.col("s").alias("s")), lambda z: F.least(z["s"], z["x"] * F.get(a["f"], z["p"])))
        first = F.struct(a["x"].alias("x"), factors.alias("f"), a["moved"].alias("moved"), a["done"].alias("done"))
        second = F.struct(draws.alias("x"), a["f"].alias("f"), far.alias("moved"), ((d == n - 1) & (far < SETTLED)).alias("done"))
        return F.when(a["done"], a).when(j % 2 == 0, first).otherwise(second)

    tried = tried.withColumn("x", F.aggregate(F.sequence(F.lit(0), F.lit(2 * n * rounds - 1)), state, step, lambda a: a["x"]))
    whole = add(F.col("x"))
    tried = tried.withColumn("drawn", whole)
    far = F.greatest(*(F.array_max(F.zip_with(totals(F.col("x"), i), F.col("goal")[i], lambda t, g: F.abs(t / F.greatest(F.col("drawn"), F.lit(1e-300)) - g))) for i in range(n)), F.abs(F.col("drawn") / F.greatest(F.col("r") * F.col("total"), F.lit(1e-300)) - 1))
    tried = tried.withColumn("off", F.when(F.col("drawn") > 0, far).otherwise(0.0))
    best = tried.groupBy().agg(F.min_by(F.struct("c", "s", "x", "total", "drawn", "off"), F.struct(F.when(F.col("off") <= ERROR, 0.0).otherwise(F.col("off")), -F.col("part"))).alias("b")).select("b.*")
    rows = best.select(F.explode(F.arrays_zip("c", "x", "s")).alias("z"), "total", "drawn", "off")
    some = F.col("drawn") > 0
    chance = F.when(F.col("z.s") > 0, F.least(F.lit(1.0), F.col("z.x") / F.col("z.s"))).otherwise(1.0 if rate > 0 else 0.0)
    return rows.select(*(F.col(f"z.c.{d}").alias(d) for d in dims), F.col("z.c.tokens").alias("tokens"), F.when(some, F.col("z.x") / F.col("drawn")).otherwise(0.0).alias("weight"), chance.alias("probability"), F.when(some, F.col("drawn") / F.col("total")).otherwise(0.0).alias("rate"), "off")


def marginals(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(dim, category, target, expected, drawn): shares of the tokens of a mixture that ``mix`` returned, as wanted, by the chances, and as selected."""
    targets = targets or TARGETS
    cells = mixed.groupBy(*(f"{d}_group" for d in targets)).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("selected"), F.col("n_tokens")).otherwise(0)).alias("s"))
    kinds = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"{d}_group").alias("category")) for d in targets)))
    sums = cells.select(kinds.alias("k"), "e", "s").groupBy("k.dim", "k.category").agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
    goal = F.create_map(*(x for d in targets for k, v in targets[d].items() for x in (F.lit(f"{d}={k}"), F.lit(float(v)))))
    w = Window.partitionBy("dim")
    return sums.select("dim", "category", goal[F.concat("dim", F.lit("="), "category")].alias("target"), (F.col("e") / F.sum("e").over(w)).alias("expected"), (F.col("s") / F.sum("s").over(w)).alias("drawn"))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """``df`` with n_tokens, source_group, lang_group, topic_group, weight (the cell's share of the mixture), probability, rate, off and selected. ``rate`` is the wanted part of all tokens, the most that is drawn."""
    targets = targets or TARGETS
    columns = {"source": F.col(source), "lang": F.col(lang), "topic": form_of(F.col(text)) if topic is None else topic}
    n = free_name(df, "_n")
    df = df.withColumn(n, tokens_of(F.col(text)))
    cells = calibrate(cells_of(df, columns, F.col(n), targets), targets, rate, rounds)
    added = {x: free_name(df, f"_{x}") for x in ("weight", "probability", "rate", "off")}
    cells = cells.select(*(F.col(d).alias(f"_{d}_cell") for d in targets), *(F.col(x).alias(y) for x, y in added.items()))
    groups = {d: _category(columns[d], targets[d]) for d in targets}
    # at most the product of the targets' lengths
    joined = df.join(F.broadcast(cells), [groups[d] == F.col(f"_{d}_cell") for d in targets])
    kept = [c for c in df.columns if c != n and c not in {"n_tokens", "selected", *added, *(f"{d}_group" for d in targets)}]
    return joined.select(*kept, F.col(n).alias("n_tokens"), *(F.col(f"_{d}_cell").alias(f"{d}_group") for d in targets), *(F.col(y).alias(x) for x, y in added.items()), (uniform(F.col(key), seed) < F.col(added["probability"])).alias("selected"))


def mix_sql(documents: str = "documents", targets: dict | None = None, rate: float = RATE, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """Common table expressions for DuckDB, the last named ``mixed``: every row of ``documents`` with what ``mix`` adds. The rounds are a recursion over cells and rates, without an early end."""
    targets = targets or TARGETS
    dims = list(targets)
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    without = lambda x: f"length(text) - length({x})"
    times = lambda *xs: "(" + " + ".join(without(f"replace(text, chr({ord(x)}), '')") for x in xs) + ")"
    run = lambda x: "(" + without(f"regexp_replace(text, '{x[:-1]}', '', 'g')") + ")"
    form = f"CASE WHEN {times('|', chr(9))} >= 4 AND {times('|', chr(9))} >= 2 * {times(chr(10))} + 2 THEN 'table' WHEN length(text) > 0 AND 3 * {run(CAPITALS)} >= length(text) THEN 'shout' WHEN length(text) > 0 AND 10 * {run(SIGNS)} >= length(text) THEN 'marked' ELSE 'prose' END"
    value = {"source": "source", "lang": "lang", "topic": form}
    group = ", ".join(f"CASE WHEN ({value[d]}) IN ({quoted(k for k in targets[d] if k != OTHER)}) THEN ({value[d]}) ELSE '{OTHER}' END AS {d}_group" for d in dims)
    keys = ", ".join(f"{d}_group" for d in dims)
    wanted = ", ".join(f"CASE {d}_group " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in targets[d].items()) + f" ELSE 0 END AS w_{d}" for d in dims)
    supply = ", ".join(f"sum(s) OVER (PARTITION BY {d}_group) AS supply_{d}" for d in dims)
    goal = ", ".join(f"CASE WHEN supply_{d} > 0 THEN w_{d} / (SELECT sum(w) FROM (SELECT DISTINCT {d}_group, w_{d} AS w FROM c1 WHERE supply_{d} > 0)) ELSE 0 END AS goal_{d}" for d in dims)
    most = ", ".join(f"min(supply_{d} / (goal_{d} * total)) FILTER (goal_{d} > 0)" for d in dims)
    step = "tried"
    for d in dims:
        total = f"sum(x) OVER (PARTITION BY part, {d}_group)"
        step = f"(SELECT * REPLACE (least(s, CASE WHEN {total} > 0 THEN x * (goal_{d} * r * total / {total}) ELSE 0 END) AS x) FROM {step})"
    off = ", ".join(f"max(abs(sum_{d} / drawn - goal_{d}))" for d in dims)
    out = [
        f"grouped AS (SELECT *, coalesce(len(regexp_extract_all(text, '{BLACK}+')), 0)::BIGINT AS n_tokens, {group} FROM {documents})",
        f"c0 AS (SELECT {keys}, sum(n_tokens)::DOUBLE AS s FROM grouped GROUP BY ALL)",
        f"c1 AS (SELECT *, {wanted}, {supply}, sum(s) OVER () AS total FROM c0)",
        f"c2 AS (SELECT *, {goal} FROM c1)",
        f"most AS (SELECT least({rate}::DOUBLE, 1.0::DOUBLE, {most}) AS m FROM c2)",
        f"tried(round, part, {keys}, s, total, {', '.join(f'goal_{d}' for d in dims)}, r, x) AS (SELECT 0, part, {keys}, s, total, {', '.join(f'goal_{d}' for d in dims)}, m * part, s * (m * part) FROM c2, most, unnest([{', '.join(f'{x}::DOUBLE' for x in STEPS)}]) u(part) UNION ALL SELECT round + 1, * EXCLUDE (round) FROM {step} WHERE round < {rounds})",
        f"ended AS (SELECT *, sum(x) OVER (PARTITION BY part) AS drawn, {', '.join(f'sum(x) OVER (PARTITION BY part, {d}_group) AS sum_{d}' for d in dims)} FROM tried WHERE round = {rounds})",
        f"judged AS (SELECT part, greatest({off}, max(abs(drawn / (r * total) - 1))) AS off FROM ended GROUP BY part)",
        f"best AS (SELECT * FROM judged ORDER BY CASE WHEN off <= {ERROR} THEN 0 ELSE off END, part DESC LIMIT 1)",
        f"cells AS (SELECT {keys}, x / drawn AS weight, CASE WHEN s > 0 THEN least(1.0::DOUBLE, x / s) ELSE 1 END AS probability, drawn / total AS rate, off FROM ended JOIN best USING (part))",
        f"mixed AS (SELECT grouped.*, weight, probability, rate, off, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < probability AS selected FROM grouped JOIN cells USING ({keys}))",
    ]
    return "RECURSIVE " + ", ".join(out)
