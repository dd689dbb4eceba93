"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources. At each node the children share by
weight; a child that cannot use its share (its capacity is ``epochs`` times its tokens) is filled up and
its shortage goes to its siblings. What siblings cannot take either shows in their parent's capacity,
so it goes to the parent's siblings. A leaf's budget is spent in seeded epochs: whole passes over its
documents, then a token-prefix of one more pass in the order of a keyed hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.shared import WORD, documents, durable, fresh, whole

LEVELS = ("domain", "lang", "source")
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 1, "es": 1}
SHARE, EPOCHS, SEED = 0.8, 2, 7


def domain_of(source: Column, domains: dict[str, str] = {}) -> Column:
    """The source's domain in ``domains``; of a source that this lacks, one of three by its name's hash."""
    first = F.substring(F.md5(source.cast("binary")), 1, 1)
    other = F.when(first < "5", "web").when(first < "a", "books").otherwise("code")
    if not domains:
        return other
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in domains.items() for x in pair)), source), other)


def _named(c: str, docs: DataFrame) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to children (columns parent..., name, weight, capacity, given = the parent's budget).

    Filled in the order of capacity per weight, a child is full if the rest of the budget would give it its
    capacity or more; the others divide what the full ones leave. All in whole numbers, rounded down.
    """
    siblings = W.partitionBy(*parent)
    before = siblings.orderBy(F.col("capacity") / F.col("weight"), name).rowsBetween(W.unboundedPreceding, -1)
    ranked = children.select(
        "*",
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("capacity_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.sum("weight").over(siblings).alias("weights"),
    ).withColumn("full", F.expr("capacity * (weights - weight_before) <= weight * (given - capacity_before)"))
    divided = ranked.select(
        "*",
        F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(siblings).alias("full_capacity"),
        F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(siblings).alias("full_weight"),
    )
    return divided.select(*children.columns, F.expr("CASE WHEN full THEN capacity ELSE (given - full_capacity) * weight div (weights - full_weight) END").alias("budget"))


def leaf_budgets(leaves: DataFrame, share: float, epochs: int, domain_weights: dict, lang_weights: dict, source_weights: dict) -> DataFrame:
    """leaves (domain, lang, source, tokens) with each leaf's budget."""
    sized = leaves.withColumn("capacity", F.col("tokens") * epochs)
    percent = round(share * 100)
    top = sized.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    whole_budget = F.expr(f"sum(tokens) OVER (PARTITION BY root) * {percent} div 100")
    top = share_out(top.withColumn("weight", _weight("domain", domain_weights)).withColumn("root", F.lit(0)).withColumn("given", whole_budget), ["root"], "domain")
    middle = sized.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    middle = middle.join(top.select("domain", F.col("budget").alias("given")), "domain").withColumn("weight", _weight("lang", lang_weights))
    middle = share_out(middle, ["domain"], "lang")
    low = sized.join(middle.select("domain", "lang", F.col("budget").alias("given")), ["domain", "lang"]).withColumn("weight", _weight("source", source_weights))
    return share_out(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", "budget")


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def plan(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS, source_weights={}, domains: dict[str, str] = {}) -> DataFrame:
    """A row per leaf: the tree's names, tokens, budget, whole passes, and where the last pass ends.

    The last pass is not sorted: each leaf's tokens are summed by the first three hex digits of the order,
    and only the one slice in which the prefix ends is looked at document by document.
    """
    light = durable(
        docs.select("doc_id", domain_of(_named("source", docs), domains).alias("domain"), _named("lang", docs).alias("lang"), _named("source", docs).alias("source"), F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("words")),
        "mix-tokens",
    )
    leaves = light.groupBy(*LEVELS).agg(F.sum("words").alias("tokens"))
    budgets = leaf_budgets(leaves, share, epochs, domain_weights, lang_weights, source_weights)
    budgets = durable(
        budgets.withColumn("passes", F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget div tokens END")).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens")),
        "mix-budgets",
    )
    ordered = light.join(budgets.where("rest > 0").select(*LEVELS, "passes", "rest"), list(LEVELS)).withColumn("place", _order(seed, F.col("passes"), F.col("doc_id")))
    slices = ordered.groupBy(*LEVELS, F.substring("place", 1, 3).alias("slice")).agg(F.sum("words").alias("n"), F.max("rest").alias("rest"))
    so_far = W.partitionBy(*LEVELS).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    cut = slices.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).where("before < rest AND rest <= before + n").select(*LEVELS, "slice", "before")
    near = ordered.withColumn("slice", F.substring("place", 1, 3)).join(cut, [*LEVELS, "slice"]).groupBy(*LEVELS, "place").agg(F.sum("words").alias("n"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    within = W.partitionBy(*LEVELS).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    last = near.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).where("before < rest AND rest <= before + n")
    ends = last.select(*LEVELS, F.col("place").alias("last_place"), (F.col("rest") - F.col("before")).alias("last_take"))
    return budgets.join(ends, list(LEVELS), "left")


def mix(docs: DataFrame, seed: int = SEED, name: str = "mix", domains: dict[str, str] = {}, **options) -> DataFrame:
    """All columns of docs and one more (``name``): a struct of domain, lang, source, tokens, epoch (from 0), and take,
    the tokens that count of this row in this epoch. A row comes once for each epoch that has it.

    take is below tokens only for the document in which a leaf's prefix ends. Tokens are words of
    ``[^\\x20\\x09-\\x0D]+``. Null names are the leaf named ''. Documents without words come with whole passes
    or inside a prefix. Rows that repeat a doc_id stand at one place of the order and come together. An
    empty table gives no rows. Texts are not shuffled: a row's epochs follow from its leaf's plan.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {name} already")
    leaf = fresh(docs, "leaf")
    ends = plan(docs, seed=seed, domains=domains, **options)
    ends = ends.select(F.struct(*LEVELS).alias(leaf), F.struct("passes", "rest", "last_place", "last_take").alias(fresh(docs, "plan")))
    p, words = F.col(fresh(docs, "plan")), F.col(fresh(docs, "words"))
    own = docs.withColumn(leaf, F.struct(domain_of(_named("source", docs), domains).alias("domain"), _named("lang", docs).alias("lang"), _named("source", docs).alias("source")))
    own = own.withColumn(fresh(docs, "words"), F.regexp_count(whole("text"), F.lit(WORD)).cast("long")).join(ends, leaf)
    place = _order(seed, p["passes"], F.col("doc_id"))

    def one(epoch: Column, take: Column) -> Column:
        names = F.col(leaf)
        return F.struct(*(names[x].alias(x) for x in LEVELS), words.alias("tokens"), epoch.cast("int").alias("epoch"), take.alias("take"))

    passes = F.when(p["passes"] > 0, F.transform(F.sequence(F.lit(0).cast("long"), p["passes"] - 1), lambda e: one(e, words)))
    none = F.slice(F.array(one(F.lit(0), words)), 1, 0)
    prefix = F.when((p["rest"] > 0) & (place < p["last_place"]), F.array(one(p["passes"], words))).when((p["rest"] > 0) & (place == p["last_place"]), F.array(one(p["passes"], F.least(words, p["last_take"]))))
    return own.select(*docs.columns, F.explode(F.concat(F.coalesce(passes, none), F.coalesce(prefix, none))).alias(name))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each epoch that has it. Where a leaf's prefix ends inside
    a document, its text is cut after the words that count (and n_chars, if there is one, is what is left).
    """
    name = fresh(docs, "mix")
    mixed = mix(docs, name=name, **options)
    m = F.col(name)
    with_space = F.regexp_extract_all(whole("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(m["take"] < m["tokens"], F.array_join(F.slice(with_space, 1, m["take"].cast("int")), "")).otherwise(F.col("text"))
    mixed = mixed.withColumn("text", cut)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.when(m["take"] < m["tokens"], F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return mixed.select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    name = fresh(docs, "mix")
    return mix(docs, name=name).select("doc_id", f"{name}.*")


def _level_sql(table: str, out: str, parent: str, name: str) -> str:
    return f"""
{out}0 AS (SELECT *, coalesce(sum(capacity) OVER w, 0)::bigint AS capacity_before, coalesce(sum(weight) OVER w, 0)::bigint AS weight_before,
    (sum(weight) OVER (PARTITION BY {parent}))::bigint AS weights FROM {table}
  WINDOW w AS (PARTITION BY {parent} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{out}1 AS (SELECT *, capacity * (weights - weight_before) <= weight * (given - capacity_before) AS filled FROM {out}0),
{out}2 AS (SELECT *, (sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER (PARTITION BY {parent}))::bigint AS fc,
    (sum(CASE WHEN filled THEN weight ELSE 0 END) OVER (PARTITION BY {parent}))::bigint AS fw FROM {out}1),
{out} AS (SELECT *, CASE WHEN filled THEN capacity ELSE (given - fc) * weight // (weights - fw) END AS budget FROM {out}2)"""


def _weight_sql(column: str, weights: dict[str, int]) -> str:
    return "(CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END)::bigint"


OP4_SQL = f"""
WITH light AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint AS tokens,
    CASE WHEN md5(coalesce(source, ''))[1] < '5' THEN 'web' WHEN md5(coalesce(source, ''))[1] < 'a' THEN 'books' ELSE 'code' END AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::bigint AS tokens, (sum(tokens) * {EPOCHS})::bigint AS capacity FROM light GROUP BY ALL),
t AS (SELECT domain, 0 AS root, sum(capacity)::bigint AS capacity, ((SELECT sum(tokens) FROM light)::bigint * {round(SHARE * 100)} // 100) AS given,
    {_weight_sql("domain", DOMAIN_WEIGHTS)} AS weight FROM leaves GROUP BY domain),
{_level_sql("t", "top", "root", "domain")},
m AS (SELECT l.domain, lang, sum(l.capacity)::bigint AS capacity, any_value(budget) AS given, {_weight_sql("lang", LANG_WEIGHTS)} AS weight
  FROM leaves l JOIN top USING (domain) GROUP BY l.domain, lang),
{_level_sql("m", "mid", "domain", "lang")},
s AS (SELECT l.domain, l.lang, l.source, l.tokens, l.capacity, budget AS given, 1::bigint AS weight FROM leaves l JOIN mid USING (domain, lang)),
{_level_sql("s", "low", "domain, lang", "source")},
b AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS passes,
    budget - CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END * tokens AS rest FROM low),
o AS (SELECT light.*, passes, rest, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('{SEED}|' || passes || '|' || coalesce(doc_id::varchar, 'null')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
  FROM light JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, e::int AS epoch, tokens AS take FROM o, range(0, {EPOCHS}) r(e) WHERE e < passes
UNION ALL
SELECT doc_id, domain, lang, source, tokens, passes::int AS epoch, least(tokens, rest - before) AS take FROM o WHERE rest > 0 AND before < rest
"""
