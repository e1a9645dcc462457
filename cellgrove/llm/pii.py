"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base: e-mail, IP, card and phone spans by linear-time regular expressions (possessive, anchored at the start of a run),
then checks of parts, digits and Luhn sums. Candidates are white-space-delimited tokens with a digit or an at sign. Seeds are the
candidates that touch a base span, and those in the form of a key or digest (``SECRETS``). Seeds induce lexical patterns: the word before or the
word after with the token's shape, the two words before, the words on both sides, or the token's own lead-in (such as ``password=``). Spark scores
the graph of patterns and instances in ``ROUNDS`` rounds: a pattern's trust is the mean confidence of its distinct instances, one doubtful
instance added, and counts from ``LEAST_KNOWN`` known ones on; an instance's confidence is one less the product of its patterns' doubts. Instances of at
least ``SURE`` are new identifiers; their tokens become spans of kind ``learned`` where they touch no base span. A secret's form alone makes no
span: it has to stand where a trusted pattern says so.

Positions are running sums of the lengths between and of matches, by a window over each text's matches; spans and tokens are merged by one
pass in order of position, so a document with very many matches costs no more than sorting them. The text is read once;
later steps work on matches only. A word or an instance that is very frequent is counted with partial sums.

Defined results: a null text is empty; a text without matches has zero counts, empty spans and the digest of the empty
string; every row has its own result, repeated or not. The base spans never change with what is learned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.llm.common import written

ROUNDS, SURE, LEAST_KNOWN = 3, 0.75, 3
KINDS = ["email", "ip", "card", "phone"]

# The four forms. A local part or a run of digits begins where no such character stands before it, or where the last match ended.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a form to be looked for.
HINTS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "[+][0-9]"}
#: Forms of keys and digests, as seeds only: hexadecimal digests of 32, 40 and 64 digits, and prefixes of well-known access keys.
SECRETS = r"^(?:(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]+\\.[0-9A-Za-z_-]+\\.[0-9A-Za-z_-]+)$"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass: from the right, every second is doubled, and the sum ends in 0."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    values = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: Column, match: Column) -> Column:
    """Whether a match passes its kind's check."""
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    octets = F.forall(F.split(match, "[.]"), lambda x: (F.length(F.regexp_replace(x, "^0+(?=.)", "")) <= 3) & (F.substring(F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 4, "0"), 1, 4).cast("int") <= 255))
    return F.when(kind == "ip", octets).when(kind == "card", digits.between(16, 19) & luhn(match)).when(kind == "phone", digits.between(8, 15)).otherwise(F.lit(True))


def _cut(text: Column, form: str, hint: str) -> Column:
    """The matches and, before each, the piece since the last; nothing if the hint is not there."""
    none = F.array().cast("array<struct<gap:string,match:string>>")
    both = F.arrays_zip(F.split(text, form, -1).alias("gap"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("match"))
    seen = F.contains(text, F.lit(hint)) if len(hint) == 1 else F.rlike(text, F.lit(hint))
    return F.when(seen, both).otherwise(none)


def _places(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with start and end in code points, from each match's place, gap and length."""
    w = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))


def find_matches(df: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of ``df``: row, key), (base spans: row, kind, start, end, match) and (candidate tokens: row, start, end, match, before, before2, after, touches: a base span)."""
    body = F.coalesce(F.col(text), F.lit(""))
    plain = lambda g: F.lower(F.translate(g, "\t\n\x0b\x0c\r", "     "))
    last_words = lambda g: F.regexp_extract(g, r"((?:[^ ]++ ++)?[^ ]++) *+$", 1)
    # of a long gap only its ends matter
    near_end = lambda g: plain(F.substring(g, -200, 200))
    near_start = lambda g: F.substring_index(F.ltrim(plain(F.substring(g, 1, 200))), " ", 1)
    tokens = _cut(body, TOKEN, "[0-9@]")
    slim = lambda a: F.transform(F.filter(a, lambda x: x["match"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["match"].alias("match")))
    near = F.transform(tokens, lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["match"].alias("match"), near_end(x["gap"]).alias("tail"), near_start(x["gap"]).alias("first")))
    found = df.select(F.col(key).alias("key"), *(slim(_cut(body, FORMS[k], HINTS[k])).alias(k) for k in KINDS), near.alias("tokens"))
    found = written(found.withColumn("row", F.monotonically_increasing_id()))
    base = None
    for k in KINDS:
        rows = found.filter(F.size(k) > 0).select("row", F.lit(k).alias("kind"), F.posexplode(k).alias("place", "m")).select("row", "kind", "place", "m.gap", "m.match")
        base = rows if base is None else base.unionByName(rows)
    base = written(_places(base, ["row", "kind"]).filter(holds(F.col("kind"), F.col("match"))).select("row", "kind", "start", "end", "match"))
    rows = found.filter(F.size("tokens") > 1).select("row", F.posexplode("tokens").alias("place", "m")).select("row", "place", "m.*")
    after = F.lead("first").over(Window.partitionBy("row").orderBy("place"))
    rows = _places(rows.withColumn("after", after).filter(F.col("match").isNotNull()), ["row"])
    rows = rows.withColumn("before2", last_words(F.col("tail"))).withColumn("before", F.substring_index("before2", " ", -1))
    # what closes or opens a token is no part of it
    head, tail = r"^[\"'(\[<{]+", r"[\"')\]>},;:.!?]+$"
    lead = F.length("match") - F.length(F.regexp_replace("match", head, ""))
    core = F.regexp_replace(F.regexp_replace("match", head, ""), tail, "")
    rows = rows.select("row", (F.col("start") + lead).alias("start"), (F.col("start") + lead + F.length(core)).alias("end"), core.alias("match"), "before", "before2", "after").filter(F.col("match") != "")
    return found.select("row", "key"), base, written(_touching(rows, base))


def _touching(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """``tokens`` with ``touches``: by order of position, whether a span that began earlier reaches in, or one begins before the token ends."""
    spans = base.select("row", "start", "end", *(F.lit(None).cast("string").alias(c) for c in ("match", "before", "before2", "after")), F.lit(True).alias("span"))
    both = tokens.withColumn("span", F.lit(False)).unionByName(spans)
    order = Window.partitionBy("row").orderBy("start", F.desc("span"))
    reach = F.max(F.when(F.col("span"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("span"), F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), "span").rowsBetween(Window.unboundedPreceding, 0))
    touches = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("ahead") < F.col("end"), F.lit(False))
    return both.withColumn("reach", reach).withColumn("ahead", ahead).filter("not span").withColumn("touches", touches).drop("span", "reach", "ahead")


def shape_of(token: Column) -> Column:
    """Letters to a or A, runs of letters folded, digits to 9; of 6 and more digits the number stands instead."""
    folded = F.regexp_replace(F.regexp_replace(token, r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    digits = F.regexp_replace(folded, "[0-9]{6,}", "9+")
    own = F.concat_ws("~", F.regexp_replace(digits, "[0-9]", "9"), F.when(F.rlike(token, F.lit("[0-9]{6}")), F.length(F.regexp_replace(token, "[^0-9]", ""))))
    return F.when(F.rlike(token, F.lit("^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{16,}$")), F.concat(F.lit("hex~"), F.length(token))).otherwise(own)


def learn(tokens: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """(match, confidence) of the instances that confident patterns discover and that are in no base span."""
    seen = tokens.groupBy("match").agg(F.max("touches").alias("spanned"))
    base = written(seen.filter("spanned").select("match"))
    shape = shape_of(F.col("match"))
    lead = F.regexp_extract("match", r"^([\p{L}_-]+[=:])", 1)
    say = lambda kind, *cols: F.concat_ws("\x01", F.lit(kind), *cols)
    patterns = F.array(F.when(F.col("before") != "", say("before", "before", shape)), F.when(F.col("after") != "", say("after", "after", shape)), F.when(F.col("before2").contains(" "), say("two", "before2")), F.when((F.col("before") != "") & (F.col("after") != ""), say("both", "before", "after")), F.when(lead != "", say("lead", lead)))
    edges = written(tokens.filter(F.length("match") >= 4).select("match", F.explode(patterns).alias("pattern")).filter("pattern is not null").distinct())
    secrets = seen.filter(~F.col("spanned") & F.rlike("match", F.lit(SECRETS))).select("match")
    seeds = written(base.unionByName(secrets).withColumn("conf", F.lit(1.0)))
    known = seeds
    for _ in range(rounds):
        support = edges.join(known, "match", "left").groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.coalesce("conf", F.lit(0.0))).alias("c"))
        # each doubtful instance more counts against a pattern with few
        trusted = written(support.filter(F.col("c") >= LEAST_KNOWN).select("pattern", (F.col("c") / (F.col("n") + 1)).alias("trust")).filter(F.col("trust") >= 0.5))
        doubt = edges.join(trusted, "pattern").groupBy("match").agg(F.exp(F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999))))).alias("doubt"))
        found = written(doubt.select("match", (1 - F.col("doubt")).alias("conf")).filter(F.col("conf") >= sure).join(base, "match", "left_anti"))
        known = seeds.unionByName(found.join(seeds, "match", "left_anti"))
    return found


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned, n_spans) of every row; counts and digest are of the base spans, ``n_spans`` of all."""
    rows, base, tokens = find_matches(df, text, key)
    new = tokens.filter("not touches").join(learn(tokens).select("match"), "match").select("row", "start", "end").withColumn("kind", F.lit("learned"))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"), F.lit(0))
    spans = base.select("row", "kind", "start", "end").unionByName(new.select("row", "kind", "start", "end")).withColumn("order", F.when(order == 0, 9).otherwise(order))
    lists = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("order", "start", "end", "kind"))).alias("x"))
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.coalesce(F.col("x"), F.array().cast("array<struct<order:int,start:long,end:long,kind:string>>"))
    count = lambda k: F.size(F.filter(own, lambda s: s["kind"] == k)).cast("long")
    out = rows.join(written(lists), "row", "left")
    return out.select(F.col("key").alias(key), *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(show(F.filter(own, lambda s: s["order"] < 9)), 256).alias("base_sha256"), show(own).alias("spans"), count("learned").alias("n_learned"), F.size(own).cast("long").alias("n_spans"))
