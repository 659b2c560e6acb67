"""Entity matching (MATCH-01 to MATCH-06, MATCH-10, JOIN-11, JOIN-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matching_name
from .graph import checkpointed


def compare_identifiers(left: DataFrame, right: DataFrame) -> DataFrame:
    """MATCH-01: (left_id, right_id, outcome) of pairs that share an identifier; rows: id, type, value, is_primary.

    A conflict in any type beats a match in another: primaries of a type that differ, or disjoint values.
    A pair is shuffled once, with how many types both have and whether primaries of one differ: values are disjoint
    in a type that both have if the pair met in fewer types than that.
    """
    def told(df: DataFrame, side: str) -> DataFrame:
        types = df.groupBy("id", "type").agg(F.max(F.when(F.col("is_primary"), F.col("value"))).alias("primary"))
        types = types.where(F.col("type").isNotNull()).groupBy("id").agg(F.collect_list(F.struct("type", "primary")).alias("types"))
        return df.select("id", "type", "value").distinct().join(types, "id").select(F.col("id").alias(f"{side}_id"), "type", "value", F.col("types").alias(f"{side}_types"))

    met = told(left, "left").join(told(right, "right"), ["type", "value"])
    both = F.size(F.array_intersect(F.col("left_types.type"), F.col("right_types.type")))
    other = lambda x, y: (x["type"] == y["type"]) & F.coalesce(x["primary"] != y["primary"], F.lit(False))
    primaries = F.exists("left_types", lambda x: F.exists("right_types", lambda y: other(x, y)))
    pairs = met.select("left_id", "right_id", "type", both.alias("both"), primaries.alias("apart"))
    found = pairs.groupBy("left_id", "right_id").agg(F.size(F.collect_set("type")).alias("met"), F.max("both").alias("both"), F.bool_or("apart").alias("apart"))
    conflict = (F.col("met") < F.col("both")) | F.col("apart")
    return found.select("left_id", "right_id", F.when(conflict, "blocked").otherwise("matched").alias("outcome"))


def name_score(a: Column, b: Column, trade_a: Column, trade_b: Column) -> Column:
    """MATCH-02: 70 for equal legal names, 45 for equal trade names, 40 for a legal name equal to a trade name, else 0."""
    x, y, u, v = (matching_name(c) for c in (a, b, trade_a, trade_b))
    same = lambda p, q: (p == q) & (p != "")
    return F.when(same(x, y), 70).when(same(u, v), 45).when(same(x, v) | same(u, y), 40).otherwise(0)


def either_key(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """JOIN-11: (left_id, right_id) of rows equal in any key: a union of equal joins, never a join on OR."""
    found = None
    for a, b in keys:
        met = left.where(F.col(a).isNotNull()).join(right, F.col(a) == F.col(b)).select(left_id, right_id)
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def best_name_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """MATCH-02: (id, score, n_candidates, first_candidate): the best tier of each of ``left`` and who reaches it.

    rows: id, name, trade. Names are compared as classes of equal names, so a row meets a class once, not its
    members: 70 for equal legal names, 45 for equal trade names, 40 for a legal name equal to a trade name.
    """
    keyed = lambda df: df.select("id", matching_name(F.col("name")).alias("n"), matching_name(F.col("trade")).alias("t"))
    members = keyed(right)
    classes = lambda c, tag: members.where(F.col(c) != "").groupBy(F.col(c).alias("k")).agg(F.struct(F.count("*").alias("rows"), F.min("id").alias("first")).alias(tag))
    rows = keyed(left)
    for c, by, tag in (("n", "n", "legal"), ("t", "t", "trade"), ("n", "t", "cross_a"), ("t", "n", "cross_b")):
        rows = rows.join(classes(by, tag), F.col(c) == F.col("k"), "left").drop("k")
    n = lambda tag: F.coalesce(F.col(f"{tag}.rows"), F.lit(0))
    crossed = F.struct((n("cross_a") + n("cross_b")).alias("rows"), F.least("cross_a.first", "cross_b.first").alias("first"))
    score = F.when(n("legal") > 0, 70).when(n("trade") > 0, 45).when(n("cross_a") + n("cross_b") > 0, 40).otherwise(0)
    best = F.when(n("legal") > 0, F.col("legal")).when(n("trade") > 0, F.col("trade")).when(n("cross_a") + n("cross_b") > 0, crossed)
    return rows.select("id", score.alias("score"), F.coalesce(best["rows"], F.lit(0)).cast("long").alias("n_candidates"), best["first"].alias("first_candidate"))


def single_match(candidates: DataFrame, key: str, target: str) -> DataFrame:
    """JOIN-15, MATCH-05: (key, target, outcome): matched if one target, blocked if several."""
    found = candidates.groupBy(key).agg(F.countDistinct(target).alias("n"), F.min(target).alias(target))
    return found.select(key, F.when(F.col("n") == 1, F.col(target)).alias(target), F.when(F.col("n") == 1, "matched").otherwise("blocked").alias("outcome"))


def import_decisions(batch: DataFrame, entities: DataFrame) -> DataFrame:
    """MATCH-03: matched by identifier, else review where a name of the type is known, else created.

    batch: id, cnpj, name, type; entities: entity_id, cnpj, name, type. Each row meets the stored entities alone;
    ``import_in_order`` lets the rows that a batch creates be candidates for later ones.
    """
    named = lambda df: df.withColumn("key", matching_name(F.col("name")))
    by_id = batch.alias("b").join(entities.where("cnpj is not null").groupBy("cnpj").agg(F.min("entity_id").alias("entity_id")).alias("e"), "cnpj", "left")
    names = named(entities).where("key <> ''").groupBy("key", "type").agg(F.count("*").alias("n_names"))
    found = named(by_id).join(names, ["key", "type"], "left")
    outcome = F.when(F.col("entity_id").isNotNull(), "matched").when(F.col("n_names") > 1, "blocked").when(F.col("n_names") == 1, "review").otherwise("created")
    return found.select("id", "entity_id", outcome.alias("outcome"))


def import_in_order(batch: DataFrame, entities: DataFrame) -> DataFrame:
    """MATCH-03: (id, outcome, entity_id, created_by) as if rows were imported one by one in the order of their ids.

    batch: id, cnpj, name, type; entities: entity_id, cnpj, name, type. A row is matched by its identifier, else it goes
    to review where an entity of its type has its name, blocked if both have an identifier (they differ), else it
    is created and from then on a candidate: created_by is the id of the row that made the entity.

    A row creates an entity if nothing stored and no earlier creating row has its identifier or its name. Each round
    settles the rows that are the first of those still open in both their groups, and with them all that share
    one; only chains that go from identifier to name and back take another round.
    """
    named = lambda df: df.withColumn("key", F.nullif(matching_name(F.col("name")), F.lit("")))
    ids = entities.where("cnpj is not null").groupBy("cnpj").agg(F.min("entity_id").alias("by_id"))
    names = named(entities).where("key is not null").groupBy("key", "type").agg(F.min_by(F.struct("entity_id", "cnpj"), "entity_id").alias("by_name"))
    rows = checkpointed(named(batch).select("id", "cnpj", "key", "type").join(ids, "cnpj", "left").join(names, ["key", "type"], "left"))
    open_ = rows.where("by_id is null and by_name is null").select("id", "cnpj", "key", "type")
    created = open_.limit(0)
    while not open_.isEmpty():
        by_cnpj = open_.where("cnpj is not null").groupBy("cnpj").agg(F.min("id").alias("first_cnpj"))
        by_key = open_.where("key is not null").groupBy("key", "type").agg(F.min("id").alias("first_key"))
        marked = open_.join(by_cnpj, "cnpj", "left").join(by_key, ["key", "type"], "left")
        first = (F.col("id") == F.coalesce("first_cnpj", "id")) & (F.col("id") == F.coalesce("first_key", "id"))
        marked = checkpointed(marked.select("id", "cnpj", "key", "type", first.alias("is_first")))
        new = marked.where("is_first").drop("is_first")
        created = created.unionByName(new)
        open_ = checkpointed(marked.where("not is_first").drop("is_first").join(new.select("cnpj"), "cnpj", "left_anti").join(new.select("key", "type"), ["key", "type"], "left_anti"))
    made = created.select(F.col("id").alias("made_by"), "cnpj", "key", "type")
    own = made.select("cnpj", F.col("made_by").alias("id_maker")).where("cnpj is not null")
    namesake = made.where("key is not null").select("key", "type", F.struct("made_by", "cnpj").alias("maker"))
    found = rows.join(own, "cnpj", "left").join(namesake, ["key", "type"], "left")
    earlier = F.when(F.col("id_maker") < F.col("id"), F.col("id_maker"))
    maker = F.when(F.col("maker.made_by") < F.col("id"), F.col("maker"))
    other_cnpj = F.when(F.col("by_name").isNotNull(), F.col("by_name.cnpj")).otherwise(maker["cnpj"])
    matched = F.col("by_id").isNotNull() | earlier.isNotNull()
    candidate = F.col("by_name").isNotNull() | maker.isNotNull()
    outcome = F.when(matched, "matched").when(candidate & other_cnpj.isNotNull() & F.col("cnpj").isNotNull(), "blocked").when(candidate, "review").otherwise("created")
    entity = F.when(matched, F.col("by_id")).otherwise(F.col("by_name.entity_id"))
    by = F.when(matched, F.when(F.col("by_id").isNull(), earlier)).when(F.col("by_name").isNull(), F.coalesce(maker["made_by"], F.col("id")))
    return found.select("id", outcome.alias("outcome"), entity.alias("entity_id"), by.alias("created_by"))


def by_priority(rows: DataFrame, key: str, priority: str, fields: list[str]) -> DataFrame:
    """MATCH-10: for each field the value of the highest priority that has one."""
    return rows.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(priority))).alias(f) for f in fields])


def first_alias(rows: DataFrame, key: str, aliases: Column, stated: DataFrame, code: str) -> DataFrame:
    """JOIN-17: (key, alias, the other columns of ``stated``): what is stated of the first of a row's aliases that has any.

    ``aliases``: an array in order of preference. Of several statements of one alias the smallest by its columns is
    taken; a row without any is left out; null aliases are passed over.
    """
    others = [c for c in stated.columns if c != code]
    tried = rows.select(key, F.posexplode(aliases).alias("place", "alias"))
    said = stated.select(F.col(code).alias("alias"), F.struct("*").alias("said"))
    found = tried.join(said, "alias").groupBy(key).agg(F.min(F.struct("place", "alias", "said")).alias("found"))
    return found.select(key, "found.alias", *[F.col(f"found.said.{c}").alias(c) for c in others])
