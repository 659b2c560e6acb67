"""Rules of the monthly market analysis (AGG-*, RULE-*, WIN-09, WIN-10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, fold
from ..functions.values import money_or_null, months_between, rate_numbers, rating_key, share, trusted_balance
from .graph import checkpointed

#: Weight of each review flag.
WEIGHTS = {
    "em_atraso": 5,
    "vencido_com_saldo_adimplente": 4,
    "informe_defasado": 3,
    "vencimento_fora_mes_base": 2,
    "isin_repetido": 3,
    "serie_sem_isin": 1,
    "identificador_duplicado": 1,
    "isin_invalido": 2,
    "saldo_incompativel": 3,
    "situacao_mista_na_classe": 3,
}


def reference_month(filings: DataFrame, month: str, certificate: str, full: float = 0.9) -> DataFrame:
    """AGG-01, AGG-03: the last month with at least 90% of the certificates of the month before, else the first.

    The months' counts are a row a month, so their one-partition window stays small at any size.
    """
    counts = filings.groupBy(F.col(month).alias("month")).agg(F.countDistinct(certificate).alias("n"))
    before = F.lag("n").over(Window.orderBy("month"))
    return counts.withColumn("before", before).agg(F.coalesce(F.max(F.when(F.col("n") >= full * F.col("before"), F.col("month"))), F.min("month")).alias("reference_month"))


def flags(conditions: dict[str, Column]) -> Column:
    """RULE-01: the names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]), lambda x: x.isNotNull())


def score_by_flags(rows: DataFrame, key: str, flag_column: str, balance: Column, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """AGG-04: (key, n_series, balance, flags, score): each distinct flag of a key counts its weight once.

    One pass: an owner's flags are a bounded set, so their union is an aggregate and needs no join back.
    """
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    found = rows.groupBy(key).agg(F.count("*").alias("n_series"), F.sum(balance).alias("balance"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(flag_column)))).alias("flags"))
    return found.withColumn("score", F.aggregate("flags", F.lit(0), lambda s, f: s + F.element_at(weight, f)))


def exposure(links: DataFrame, certificates: DataFrame) -> DataFrame:
    """AGG-07: per debtor, the share-weighted trusted balance, certificates, late ones, contagion and invalid shares.

    links: debtor, certificate, share, position (the first line of a pair counts); certificates: certificate, balance, late.
    """
    first = links.withColumn("nth", F.row_number().over(Window.partitionBy("debtor", "certificate").orderBy("position"))).where("nth = 1")
    held = first.join(certificates, "certificate").withColumn("valid_share", share(F.col("share")))
    found = held.groupBy("debtor").agg(
        F.count("*").alias("n_certificates"),
        F.count_if("late").alias("n_late"),
        F.count_if(F.col("valid_share").isNull()).alias("n_invalid_share"),
        F.coalesce(F.sum(F.col("valid_share") * F.col("balance")), F.lit(0)).alias("exposure"),
    )
    return found.withColumn("contagion", (F.col("n_late") > 0) & (F.col("n_late") < F.col("n_certificates")))


def month_changes(rows: DataFrame, keys: list[str], month: str, value: str, drop: float = 0.1) -> DataFrame:
    """RULE-05, WIN-08: each reported month against the one reported before; dropped: fell by over ``drop``."""
    w = Window.partitionBy(*keys).orderBy(month)
    found = rows.withColumns({"previous_month": F.lag(month).over(w), "previous_value": F.lag(value).over(w)}).where("previous_month is not null")
    return found.withColumn("dropped", F.try_divide(F.col("previous_value") - F.col(value), F.col("previous_value")) > drop)


#: The states of a series, and the events that tell them apart.
IN_TIME, LATE = "adimplente", "em atraso"
EVENTS = ("entrou_em_atraso", "saiu_do_atraso", "rating_mudou", "vencimento_mudou", "taxa_mudou", "saldo_zerou", "saldo_caiu_sem_amortizacao")
DROP_THRESHOLD = 0.10


def series_events(rows: DataFrame, keys: list[str], month: str, threshold: float = DROP_THRESHOLD) -> DataFrame:
    """RULE-05: (keys, month, previous_month, event): each reported month against the one reported before.

    rows: keys, month, status, rating, due, rate, balance, amortised, as texts; a text that says nothing makes no event.
    """
    read = rows.select(*keys, month, collapse(fold(F.col("status"))).alias("s"), rating_key(F.col("rating")).alias("r"), F.substring(F.coalesce("due", F.lit("")), 1, 10).alias("d"), rate_numbers(F.col("rate")).alias("n"), money_or_null(F.col("balance")).alias("b"), money_or_null(F.col("amortised")).alias("a"))
    w = Window.partitionBy(*keys).orderBy(month)
    was = read.withColumns({"p": F.lag(F.struct("s", "r", "d", "n", "b")).over(w), "previous_month": F.lag(month).over(w)}).where("p is not null")
    both = lambda c: (F.col(f"p.{c}") != "") & (F.col(c) != "") & (F.col(f"p.{c}") != F.col(c))
    held = F.col("p.b") > 0
    unexplained = F.try_divide(F.col("p.b") - F.col("b") - F.coalesce("a", F.lit(0)), F.col("p.b"))
    conditions = dict(
        zip(
            EVENTS,
            (
                (F.col("p.s") == IN_TIME) & (F.col("s") == LATE),
                (F.col("p.s") == LATE) & (F.col("s") == IN_TIME),
                both("r"),
                both("d"),
                (F.size("p.n") > 0) & (F.size("n") > 0) & (F.col("p.n") != F.col("n")),
                held & (F.col("b") == 0),
                held & (F.col("b") != 0) & (unexplained > threshold),
            ),
            strict=True,
        )
    )
    return was.select(*keys, month, "previous_month", F.explode(flags(conditions)).alias("event"))


def gaps(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """WIN-09: rows whose month doesn't follow the month of the row before."""
    w = Window.partitionBy(*keys).orderBy(date)
    found = rows.withColumn("months", months_between(F.lag(date).over(w), F.col(date)))
    return found.where("months <> 1")


def rolled(balance: str, rate: Column, paid: Column, w) -> Column:
    """WIN-10: the balance before with its interest, less what was paid."""
    return F.lag(balance).over(w) * (1 + rate) - paid


def counted_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, v, c): how often each key has each value, nulls left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("c"))


def counted_medians(counts: DataFrame, key: str) -> DataFrame:
    """(key, median, n) of (key, v, c): exact medians of keys of any size.

    A key's values are cut by rank into range partitions, each of which knows how many rows lie before it, so a key is
    spread over as many tasks as its values need. The cut is written down: read twice from a plan it could be drawn
    twice, in other places.
    """
    parts = checkpointed(counts.repartitionByRange(key, "v").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy(key, "part").agg(F.sum("c").alias("held"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(whole).alias("n"))  # a row for each key and partition
    here = Window.partitionBy(key, "part").orderBy("v")
    upto = parts.withColumn("upto", F.sum("c").over(here)).join(sums, [key, "part"]).withColumn("upto", F.col("upto") + F.col("start"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda at: (F.col("upto") - F.col("c") <= at) & (at < F.col("upto"))
    middle = upto.where(holds(low) | holds(high))
    return middle.groupBy(key).agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median"), F.first("n").alias("n"))


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, n): exact medians of keys of any size; equal values are counted before they are shuffled."""
    return counted_medians(counted_values(rows, key, value), key)


def outliers(rows: DataFrame, key: str, value: str, threshold: float, minimum: int = 12) -> DataFrame:
    """AGG-13, RULE-07: robust z over the median absolute deviation; keys of too few rows or deviation 0 are left out.

    Both medians come from one count of the values and are joined back (a row a key), so no task holds a key's rows.
    """
    counts = checkpointed(counted_values(rows, key, value))
    middle = counted_medians(counts, key)
    away = counts.join(middle, key).groupBy(key, F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("c").alias("c"))
    spread = counted_medians(away, key).select(key, F.col("median").alias("mad"))
    usable = middle.where(F.col("n") >= minimum).join(spread.where("mad > 0"), key)
    found = rows.join(usable, key).withColumn("off", F.abs(F.col(value) - F.col("median")))
    return found.withColumn("z", F.col("off") / (1.4826 * F.col("mad"))).where(F.col("z") > threshold)


def watch_level(conditions: list[Column]) -> Column:
    """RULE-13: the first condition that holds is level 1, and so on; none is the level after the last."""
    level = F.lit(len(conditions) + 1)
    for at, condition in reversed(list(enumerate(conditions, 1))):
        level = F.when(condition, at).otherwise(level)
    return level


def watch_reasons(level_one: dict[str, Column], level_two: dict[str, Column], level_three: dict[str, Column], level_four: dict[str, Column]) -> dict[str, Column]:
    """RULE-13, RULE-19: level 1 to 5 and its reasons, in order: all that hold from the level's own on."""
    sets = [flags(x) for x in (level_one, level_two, level_three, level_four)]
    level = F.lit(len(sets) + 1)
    for at, names in reversed(list(enumerate(sets, 1))):
        level = F.when(F.size(names) > 0, at).otherwise(level)
    # the first two levels give their own reason alone, then those of the last two
    first, second, third, fourth = sets
    shown = F.when(F.size(first) > 0, F.concat(F.slice(first, 1, 1), third, fourth)).otherwise(F.concat(second, third, fourth))
    return {"level": level, "reasons": shown}


def consensus(values: Column) -> Column:
    """AGG-20: none, one or divergent, from a set of values."""
    n = F.size(values)
    return F.when(n == 0, "none").when(n == 1, "one").otherwise("divergent")


def quality_status(errors: Column, warnings: Column) -> Column:
    """AGG-22, RULE-21."""
    return F.when(errors > 0, "invalid").when(warnings > 0, "warning").otherwise("valid")


def band(value: Column, edges: list[float], names: list[str]) -> Column:
    """AGG-17: the name of the first edge that the value doesn't pass; the last name beyond all."""
    found = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        found = F.when(value <= edge, name).otherwise(found)
    return found


def issue(df: DataFrame, rule: str, severity: str, row_id: Column, found: Column) -> DataFrame:
    """RULE-08: rows that break a rule, in the form that all rules share."""
    return df.where(found).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), row_id.cast("string").alias("row_id"))


#: Codes, severities and fields of the quality checks.
POSITIVE_FIELDS = ("valor_nominal", "quantidade_emitida", "quantidade_em_mercado")
CRITICAL, WARNING = "critical", "warning"


def debenture_quality(assets: DataFrame, observations: DataFrame, current: DataFrame, conflicts: DataFrame, runs: DataFrame, stale_before: Column) -> DataFrame:
    """RULE-08: (rule, severity, row_id) of seven checks.

    assets: id, issuer_id; observations: id, asset_id, field_name, value_type, value_numeric, confidence;
    current: id, observed_at; conflicts: id, status; runs: id, status.
    """
    unseen = assets.join(observations.select(F.col("asset_id").alias("id")), "id", "left_anti")
    not_positive = (F.col("value_type") == "numeric") & F.col("field_name").isin(*POSITIVE_FIELDS) & (F.col("value_numeric") <= 0)
    found = (
        issue(assets, "DEBENTURE_WITHOUT_ISSUER", WARNING, F.col("id"), F.col("issuer_id").isNull()),
        issue(unseen, "DEBENTURE_WITHOUT_OBSERVATIONS", WARNING, F.col("id"), F.lit(True)),
        issue(observations, "NON_POSITIVE_FINANCIAL_VALUE", CRITICAL, F.col("id"), not_positive),
        issue(observations, "SUSPECT_OBSERVATION", WARNING, F.col("id"), F.col("confidence") == "suspect"),
        issue(current, "STALE_CURRENT_OBSERVATION", WARNING, F.col("id"), F.col("observed_at") < stale_before),
        issue(conflicts, "OPEN_DATA_CONFLICT", CRITICAL, F.col("id"), F.col("status") == "open"),
        issue(runs, "FAILED_COLLECTION", WARNING, F.col("id"), F.col("status") == "failed"),
    )
    return reduce(DataFrame.unionByName, found)


def health(critical: Column, warnings: Column) -> Column:
    """RULE-08: the report's status from its counts."""
    return F.when(critical > 0, "critical").when(warnings > 0, "attention").otherwise("healthy")


#: Words that tell a covenant's group, the first that fits.
COVENANT_GROUPS = (
    ("fundo", r"fundo"),
    ("covenant", r"covenant|[íi]ndice|ltv|d[íi]vida|ebitda|liquidez|cobertura|raz[ãa]o|alavanc|subordina"),
    ("garantia", r"garantia|aliena|cess[ãa]o|fian|aval"),
)
OTHER_GROUP = "obrigacao"


def covenant_group(kind: Column, text: Column) -> Column:
    """RULE-25: fund, covenant, guarantee or obligation, by the words of a monitored item."""
    words, found = F.lower(F.concat_ws(" ", F.coalesce(kind, F.lit("")), F.coalesce(text, F.lit("")))), F.lit(OTHER_GROUP)
    for name, pattern in reversed(COVENANT_GROUPS):
        found = F.when(words.rlike(pattern), name).otherwise(found)
    return found


def monthly_covenants(monitors: DataFrame, registry: DataFrame) -> DataFrame:
    """RULE-25: a row for each monitored item, month and certificate code, with the registry's issuer and debtor.

    monitors: codes, isins (lists in one text each, by position), month, kind, group_title, item, reference,
    condition, measured, status, debtor; registry: code, isin, issuer, debtor. Balances without any requirement
    or status are no monitored item; a title in capitals is a heading, not a group; a code that is not
    registered keeps its row with what the report says.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = monitors.where(~(blank("kind") & F.coalesce("item", F.lit("")).startswith("(")) & ~(blank("reference") & blank("status") & blank("condition")))
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s,;]+"), lambda x: x != "")
    rows = rows.withColumn("isin_list", split("isins")).select("*", F.posexplode(split("codes")).alias("at", "code"))
    heading = F.coalesce("group_title", F.lit(""))
    shown = F.when((F.upper(heading) == heading) & (F.lower(heading) != heading), "").otherwise(heading)
    item = F.concat_ws(" · ", *[F.nullif(c, F.lit("")) for c in (shown, F.coalesce("item", F.lit("")))])
    required = F.trim(F.concat(F.coalesce("reference", F.lit("")), F.lit(" "), F.coalesce("condition_text", F.lit(""))))
    group = covenant_group(F.col("kind"), F.concat_ws(" ", heading, F.coalesce("item", F.lit(""))))
    rows = rows.select("code", F.coalesce(F.try_element_at("isin_list", F.col("at") + 1), F.lit("")).alias("own_isin"), "month", group.alias("item_group"), item.alias("item"), required.alias("required"), "measured", "status", F.col("debtor").alias("own_debtor"))
    known = registry.select("code", F.col("isin").alias("known_isin"), "issuer", F.col("debtor").alias("known_debtor"))
    joined = rows.join(known, "code", "left")
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")), F.lit(""))
    return joined.select("code", first("own_isin", "known_isin").alias("isin"), F.coalesce("issuer", F.lit("")).alias("issuer"), first("known_debtor", "own_debtor").alias("debtor"), "month", "item_group", "item", "required", "measured", "status")


def trusted(balance: str, paid_in: str) -> Column:
    return trusted_balance(F.col(balance), F.col(paid_in))


#: A portal's word for a failed operation, the market's for one in arrears.
PORTAL_FAILED, IN_ARREARS, NO_MARKET_DATA, NO_SITUATION = "Default", "atraso", "sem dado na CVM", "vazio"


def portal_against_market(series: DataFrame, filings: DataFrame) -> DataFrame:
    """RULE-18: (operation, status, codes, late, situation, divergent): a portal's status beside the market's newest filing.

    series: operation, status, place, code; filings: code, reference, situation. An operation is late if any of its
    series is; else its situation is that of its first series. Divergent: failed by the portal, not late by the
    market. What only the portal has keeps its row.
    """
    newest = filings.where(F.col("code").isNotNull()).groupBy("code").agg(F.max(F.struct("reference", "situation")).alias("newest"))
    situation = F.when(F.col("newest").isNull(), NO_MARKET_DATA).otherwise(F.coalesce("newest.situation", F.lit("")))
    joined = series.join(newest, "code", "left").select("operation", "status", "place", "code", situation.alias("situation"))
    late = F.coalesce(F.bool_or(F.lower("situation").contains(IN_ARREARS)), F.lit(False))
    found = joined.groupBy("operation").agg(F.min("status").alias("status"), F.array_sort(F.collect_set("code")).alias("codes"), late.alias("late"), F.min(F.struct("place", "code", "situation")).alias("first"))
    told = F.when(F.col("late"), "Em atraso").when(F.col("first.situation") == "", NO_SITUATION).otherwise(F.col("first.situation"))
    return found.select("operation", "status", "codes", "late", told.alias("situation"), ((F.col("status") == PORTAL_FAILED) & ~F.col("late")).alias("divergent"))
