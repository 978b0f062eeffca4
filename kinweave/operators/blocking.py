"""Candidate retrieval: all channels and countries in one token join and one aggregation by pair.

Tokens above their channel's document-frequency cap are dropped before the join, which bounds every key and its list of targets; counts of a token within a record are taken in
the row, so nothing is shuffled before the first aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave import values as V
from kinweave.functions import block as B


@dataclass(frozen=True)
class Profile:
    """Caps, weights' limits and budgets; the defaults are the method's own, for millions of records; ``SMALL`` is for tests on small tables."""

    caps: dict = field(default_factory=lambda: {"name": V.NAME_CAP, "prefix": V.PREFIX_CAP, "addr": V.ADDR_CAP, "num": V.NUM_CAP, "gram": V.GRAM_CAP})
    rare: int = V.RARE_DF
    medium: int = V.MEDIUM_DF
    base: int = V.BUDGET_BASE
    most: int = V.BUDGET_MAX
    trigger: int = V.FALLBACK_TRIGGER
    add: int = V.FALLBACK_ADD


SMALL = Profile(caps={"name": 200, "prefix": 200, "addr": 60, "num": 60, "gram": 60}, rare=5, medium=50, base=8, most=12, trigger=3, add=5)


def token_table(entities: DataFrame, query: bool = False) -> DataFrame:
    """country, channel, token, entity_id, tf of entities (entity_id, name, addr, country). Prefixes are a set on the target side and a bag on the query side."""
    df = entities.where(F.trim("country") != "").select("entity_id", F.trim("country").alias("country"), "addr", B.name_tokens(F.col("name")).alias("names"))
    own = B.prefixes(F.col("names"))
    bags = {"name": F.col("names"), "prefix": own if query else F.array_distinct(own), "addr": B.addr_tokens(F.col("addr")), "num": B.numeric_tokens(F.col("addr"))}
    df = df.withColumns({f"b_{k}": v for k, v in bags.items()})
    tagged = [_tagged(k) for k in bags]
    return df.select("country", "entity_id", F.explode(F.concat(*tagged)).alias("t")).select("country", "t.channel", "t.token", "entity_id", "t.tf")


def _tagged(channel: str):
    return F.transform(B.counted(F.col(f"b_{channel}")), lambda t: F.struct(F.lit(channel).alias("channel"), t["token"].alias("token"), t["tf"].alias("tf")))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("country", "channel", "token").agg(F.sum("tf").alias("df"))


def capped(df: DataFrame, profile: Profile) -> DataFrame:
    limit = F.lit(0)
    for channel, cap in profile.caps.items():
        limit = F.when(F.col("channel") == channel, F.lit(cap)).otherwise(limit)
    return df.where(F.col("df") <= limit)


KEYS = ["country", "channel", "token"]
#: Postings (about 50 bytes each) up to which the targets' index is broadcast, and hits for one task.
BROADCAST_POSTINGS, TASK_HITS = 4_000_000, 500_000


@dataclass
class Index:
    """The target side, worked out once: ``postings`` with each capped key's document frequency and its targets as one list (no longer than the cap), and capped 3-grams."""

    postings: DataFrame
    grams: DataFrame


def index(targets: DataFrame, profile: Profile = Profile(), keep=lambda df: df) -> Index:
    """``keep`` may write what it is given and read it back (``sinks.stored``), for targets that are asked more than once."""
    return Index(keep(_postings(targets, profile)), keep(_grams(targets, profile)))


def _postings(targets: DataFrame, profile: Profile) -> DataFrame:
    postings = token_table(targets)
    kept = postings.join(capped(document_frequency(postings), profile), KEYS)
    return kept.groupBy(*KEYS, "df").agg(F.collect_list(F.struct(F.col("entity_id").alias("cand_id"), F.col("tf").alias("t_tf"))).alias("posts"))


def _grams(targets: DataFrame, profile: Profile) -> DataFrame:
    grams = gram_table(targets)
    rare = grams.groupBy("country", "token").count().where(F.col("count") <= profile.caps["gram"]).select("country", "token")
    return grams.join(rare, ["country", "token"]).select("country", "token", F.col("entity_id").alias("cand_id"))


def _asked(queries: DataFrame) -> DataFrame:
    return token_table(queries, query=True).withColumnRenamed("entity_id", "s1_id")


def pair_scores(queries: DataFrame, targets: DataFrame | Index, profile: Profile = Profile()) -> DataFrame:
    """s1_id, cand_id with sa, sb, hits, postal, composite and score, boosts included.

    The target side of a key is bounded by its cap, the query side is not: keys that many queries share are left to AQE, which splits skewed partitions of the join.
    """
    kept = targets.postings if isinstance(targets, Index) else _postings(targets, profile)
    hits = _asked(queries).join(kept, KEYS).select("s1_id", "channel", "tf", "df", F.explode("posts").alias("t"))
    return boosted(_summed(hits, profile)).drop("gram_score")


def _summed(hits: DataFrame, profile: Profile) -> DataFrame:
    """One row for each pair of hits (s1_id, channel, tf, df, t: cand_id and t_tf)."""
    n, channel = F.col("tf") * F.col("t.t_tf"), F.col("channel")
    name, gram, first = channel == "name", channel == "gram", channel.isin("name", "prefix")
    weight = F.when(name, F.when(F.col("df") <= profile.rare, V.W_RARE).when(F.col("df") <= profile.medium, V.W_NAME).otherwise(V.W_COMMON)).when(channel == "prefix", V.W_PREFIX).when(channel == "addr", V.W_ADDR).otherwise(V.W_NUM)
    return hits.groupBy("s1_id", F.col("t.cand_id").alias("cand_id")).agg(
        F.sum(F.when(first, n * weight).otherwise(0)).alias("sa"), F.sum(F.when(~first & ~gram, n * weight).otherwise(0)).alias("sb"),
        F.sum(F.when(name, n).otherwise(0)).alias("hits"), F.max(channel == "num").alias("postal"), F.sum(F.when(gram, n).otherwise(0)).alias("gram_score"),
    )


def boosted(pairs: DataFrame) -> DataFrame:
    both = (F.col("sa") > 0) & (F.col("sb") > 0)
    df = pairs.withColumn("composite", F.when(both, F.col("sa") + F.col("sb") + V.W_COMPOSITE).otherwise(0))
    base = F.when(F.col("composite") > 0, F.col("composite")).otherwise(F.col("sa") + F.col("sb"))
    plus = F.when(F.col("hits") >= 2, V.BOOST_NAMES).otherwise(0) + F.when((F.col("sa") >= 6) & F.col("postal"), V.BOOST_POSTAL).otherwise(0) + F.when(F.col("composite") >= 22, V.BOOST_COMPOSITE).otherwise(0)
    return df.withColumn("score", base + plus)


def gram_table(entities: DataFrame) -> DataFrame:
    df = entities.where(F.trim("country") != "")
    return df.select(F.trim("country").alias("country"), "entity_id", F.explode(B.name_grams(F.col("name"))).alias("token"))


def fallback(queries: DataFrame, targets: DataFrame | Index, scored: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """s1_id, cand_id, gram_score: by shared 3-grams, for queries with few candidates by name only."""
    kept = targets.grams if isinstance(targets, Index) else _grams(targets, profile)
    named = scored.where("sa > 0")
    many = named.groupBy("s1_id").count().where(F.col("count") >= profile.trigger).select(F.col("s1_id").alias("entity_id"))
    return _by_grams(queries.join(many, "entity_id", "left_anti"), kept, named, profile)


def _by_grams(few: DataFrame, kept: DataFrame, named: DataFrame, profile: Profile) -> DataFrame:
    asked = gram_table(few).withColumnRenamed("entity_id", "s1_id")
    shared = asked.join(kept, ["country", "token"]).groupBy("s1_id", "cand_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    shared = shared.join(named.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").withColumn("gram_score", F.col("n") * V.W_GRAM)
    best = Window.partitionBy("s1_id").orderBy(F.desc("gram_score"), "cand_id")
    return shared.withColumn("k", F.row_number().over(best)).where(F.col("k") <= profile.add).select("s1_id", "cand_id", "gram_score")


def _short(asked: DataFrame, postings: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """The queries (entity_id) with enough candidates by name, and the named pairs of the others, found without making the former's pairs: one key with enough targets is enough; else
    each key has fewer than the trigger, and the pairs are counted."""
    asked = asked.where(F.col("channel").isin("name", "prefix"))
    most = asked.join(postings.select(*KEYS, F.size(F.array_distinct("posts.cand_id")).alias("n")), KEYS).groupBy("s1_id").agg(F.max("n").alias("most"))
    sure = most.where(F.col("most") >= profile.trigger).select("s1_id")
    named = asked.join(sure, "s1_id", "left_anti").join(postings, KEYS).select("s1_id", F.explode("posts.cand_id").alias("cand_id")).distinct()
    counted = named.groupBy("s1_id").count().where(F.col("count") >= profile.trigger).select("s1_id")
    return sure.union(counted).withColumnRenamed("s1_id", "entity_id"), named


def budgeted(pairs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Pairs within each query's budget: half for each source, then the best of the rest. Order: score, then candidate id."""
    base, most = min(profile.base, profile.most), profile.most
    by_query, order = Window.partitionBy("s1_id"), [F.desc("score"), F.asc("cand_id")]
    df = pairs.withColumn("source", B.source_of(F.col("cand_id")))
    df = df.withColumn("by_source", F.row_number().over(Window.partitionBy("s1_id", "source").orderBy(*order)))
    # The rank is counted so that these stay above it and need no order of their own.
    df = df.withColumns({"n": F.count("by_source").over(by_query), "good": F.sum(F.when(F.col("by_source").isNotNull(), (F.col("score") >= V.QUALITY).cast("int"))).over(by_query)})
    df = df.withColumn("budget", F.when(F.col("good") <= base, F.lit(base)).otherwise(F.least(F.col("good"), F.lit(most))))
    half = F.floor(F.col("budget") / 2)
    # Pairs that no budget can hold go before the last order: a source's k-th pair has k - half before it in the rest.
    df = df.where(F.col("by_source") <= F.col("budget")).withColumn("quota", F.col("by_source") <= half)
    df = df.withColumn("taken", F.sum(F.col("quota").cast("int")).over(by_query))
    df = df.where((F.col("n") <= F.col("budget")) | (F.col("by_source") <= half + F.col("budget") - F.col("taken")))
    df = df.withColumn("by_rest", F.row_number().over(Window.partitionBy("s1_id", "quota").orderBy(*order)))
    keep = (F.col("n") <= F.col("budget")) | F.col("quota") | (F.col("by_rest") <= F.col("budget") - F.col("taken"))
    return df.where(keep).drop("n", "good", "by_source", "quota", "taken", "by_rest")


def candidates(queries: DataFrame, targets: DataFrame | Index, profile: Profile = Profile(), keep=lambda df: df) -> DataFrame:
    """The whole retrieval: channels, boosts, 3-gram fallback and budget. ``keep`` should write the queries' tokens and the targets' index (``sinks.stored``).

    Pairs are written nowhere, and not shuffled either: queries' tokens are dealt out by query and meet the broadcast lists of targets there, so a query's pairs are made, summed
    and cut to its budget within one task; a task has about ``TASK_HITS`` hits. An index of more than ``BROADCAST_POSTINGS`` is joined by a shuffle of keys, and its pairs are shuffled.
    """
    own = isinstance(targets, Index)
    postings = targets.postings if own else keep(_postings(targets, profile))
    asked = keep(_asked(queries))
    many, named = _short(asked, postings, profile)
    few = keep(queries.join(many, "entity_id", "left_anti"))
    none = F.lit(None).cast(postings.schema["posts"].dataType)
    rows = asked.select("s1_id", *KEYS, "tf", none.alias("own"))
    if not few.isEmpty():
        named = named.join(few.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
        grams = _by_grams(few, targets.grams if own else _grams(targets, profile), named, profile)
        found = F.array(F.struct("cand_id", F.col("gram_score").alias("t_tf")))
        rows = rows.union(grams.select("s1_id", F.lit(""), F.lit("gram"), F.lit(""), F.lit(1).cast("long"), found))
    sizes = postings.select(*KEYS, F.size("posts").cast("long").alias("n"))
    if (sizes.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_POSTINGS:
        hits = asked.join(sizes, KEYS).agg(F.sum("n")).first()[0] or 0
        parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hits // TASK_HITS))
        rows, postings = rows.repartition(parts, "s1_id"), F.broadcast(postings)
    hits = rows.join(postings, KEYS, "left").select("s1_id", "channel", "tf", "df", F.explode(F.coalesce("own", "posts")).alias("t"))
    pairs = boosted(_summed(hits, profile)).withColumn("score", F.col("score") + F.col("gram_score"))
    return budgeted(pairs.select("s1_id", "cand_id", *[F.col(c).cast("long").alias(c) for c in ("sa", "sb", "hits")], "postal", *[F.col(c).cast("long").alias(c) for c in ("composite", "gram_score", "score")]), profile)


def place(cand_id):
    """Sorts a query's candidates: source three first by falling number, then source two by rising number."""
    number = F.split(cand_id, "-")[1].cast("long")
    return F.when(F.substring(cand_id, 1, 2) == "S3", -number).otherwise(number)


def candidate_lists(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per query, with an empty list where it has no candidate; see ``place`` for the order. A list holds at most the budget."""
    lists = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct(place("cand_id").alias("place"), "cand_id"))).alias("c"))
    ids = F.array_join(F.transform("c", lambda c: c["cand_id"]), ",")
    return queries.select(F.col("entity_id").alias("source1_entity_id")).join(lists, F.col("source1_entity_id") == F.col("s1_id"), "left").select("source1_entity_id", F.coalesce(ids, F.lit("")).alias("candidate_entity_ids"))
