"""Small decision rules on reports, statements, imports and projections (RULE-*, MATCH-*, PROJ-02, EAV-07, UPS-05, SCAN-16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, fold, matching_name
from ..functions.values import months_between

#: The severity of an auditor's opinion, by its folded text.
OPINIONS = {"sem ressalva": 0, "com ressalva": 2, "adversa": 3, "opiniao adversa": 3, "abstencao de opiniao": 3, "abstencao": 3}
LATE_DAYS = 90
#: What a review proposes for a report.
APPROVE, DECIDE, SUPERSEDED = "aprovar", "decidir", "nao_usar_substituida"
#: The statuses of series.
LATE, IN_TIME = "Em atraso", "Adimplente"


def stale_filing(month: Column, reference: Column, balance: Column, maturity: Column) -> Column:
    """RULE-02: two months or more behind the reference while there is a balance and the maturity is not over."""
    return (balance > 0) & (maturity >= reference) & (months_between(month, reference) >= 2)


def opinion_severity(text: Column) -> Column:
    """RULE-11: 0 unqualified, 2 qualified, 3 adverse or disclaimed; null where nothing known is said."""
    t = collapse(fold(text))
    exact = reduce(lambda c, kv: F.when(t == kv[0], kv[1]).otherwise(c), OPINIONS.items(), F.lit(None).cast("int"))
    return F.coalesce(exact, F.when(t.contains("abstenc") | t.contains("advers"), 3).when(t.contains("com ressalva"), 2).when(t.contains("sem ressalva"), 0))


def statement_signals(statements: DataFrame, key: str) -> DataFrame:
    """RULE-11: (key, signals) of the newest statement of each key: opinion, worsened opinion, late delivery.

    statements: key, reference (date), version, opinion, delivered (date); a reference counts by its highest version.
    """
    best = statements.groupBy(key, "reference").agg(F.max_by(F.struct("opinion", "delivered"), "version").alias("s"))
    w = Window.partitionBy(key).orderBy(F.col("reference").desc())
    rows = best.select(key, "reference", opinion_severity(F.col("s.opinion")).alias("severity"), F.datediff("s.delivered", "reference").alias("days"))
    rows = rows.withColumns({"nth": F.row_number().over(w), "before": F.lead("severity").over(w)}).where("nth = 1")
    found = F.array(
        F.when(F.col("severity") == 2, "df_com_ressalva"),
        F.when(F.col("severity") == 3, "df_abstencao_ou_adversa"),
        F.when(F.col("severity") > F.col("before"), "opiniao_piorou"),
        F.when(F.col("days") > LATE_DAYS, "df_entregue_apos_prazo"),
    )
    return rows.select(key, F.filter(found, lambda x: x.isNotNull()).alias("signals"))


def without_recent(live: DataFrame, statements: DataFrame, key: str, today: Column, months: int = 15) -> DataFrame:
    """RULE-12: live emissions older than ``months`` that have no statement of the last ``months``; live: key, balance, issued."""
    limit = F.add_months(F.trunc(today, "month"), -months)
    recent = statements.where(F.trunc("reference", "month") >= limit).select(key)
    return live.where((F.col("balance") > 0) & (F.col("issued") <= limit)).join(recent, key, "left_anti")


def review_proposals(reports: DataFrame, keys: list[str], month: Column, version: Column, status: Column) -> DataFrame:
    """RULE-20: ``reports`` with action: the highest version of a month is approved if valid, else decided; others are superseded."""
    top = F.max(version).over(Window.partitionBy(*keys, month))
    return reports.withColumn("action", F.when(version < top, SUPERSEDED).when(status == "valid", APPROVE).otherwise(DECIDE))


def status_against_delinquency(statuses: Column, amounts: Column) -> Column:
    """RULE-06: a late status without late amounts, or the reverse; null if they agree.

    statuses: the set of a report's series statuses; amounts: its delinquency amounts, null where absent or empty.
    """
    nothing = F.forall(amounts, lambda x: x.isNull() | (x == 0))
    return F.when(F.array_contains(statuses, LATE) & nothing, "late_without_amounts").when((F.size(statuses) == 1) & F.array_contains(statuses, IN_TIME) & ~nothing, "amounts_without_late")


def validation_status(values: Column, findings: Column, refusal: Column) -> Column:
    """RULE-21: struct<status, code>: a refused run keeps its code; else invalid, warning or valid by the worst value or finding."""
    worst = lambda x: F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(x, lambda v: F.when(v == "invalid", 2).when(v == "warning", 1).otherwise(0))), F.lit(0)))
    level = F.greatest(worst(values), worst(findings))
    return F.struct(F.when(refusal.isNotNull(), "failed").when(level == 2, "invalid").when(level == 1, "warning").otherwise("valid").alias("status"), refusal.alias("code"))


def fixed_columns(df: DataFrame, identity: list[str], fields: str, columns: list[str], default: str = "") -> DataFrame:
    """PROJ-02: a fixed list of columns from a map of fields; an identity column wins over a field of its name."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in identity else F.coalesce(F.try_element_at(F.col(fields), F.lit(c)), F.lit(default)).alias(c) for c in columns])


def mapped(label: Column, names: dict[str, str]) -> Column:
    """MAP-01: a label's column name; null for a label that isn't mapped."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), label)


def resolve_series(rows: DataFrame, series: DataFrame) -> DataFrame:
    """EAV-07: (row_id, series_id, outcome) of rows (row_id, parent, label_key, subclass_id) against series of the same columns.

    Found by label, by subclass, or by both if they agree; two different series are a conflict, none is new.
    """
    by = lambda c, name: series.where(F.col(c).isNotNull()).groupBy("parent", c).agg(F.min("series_id").alias(name))
    found = rows.join(by("label_key", "by_label"), ["parent", "label_key"], "left").join(by("subclass_id", "by_subclass"), ["parent", "subclass_id"], "left")
    disagree = F.col("by_label") != F.col("by_subclass")
    chosen = F.when(F.coalesce(disagree, F.lit(False)), None).otherwise(F.coalesce("by_label", "by_subclass"))
    outcome = F.when(disagree, "conflict").when(F.col("by_label").isNotNull() & F.col("by_subclass").isNotNull(), "both").when(F.col("by_label").isNotNull(), "label").when(F.col("by_subclass").isNotNull(), "subclass").otherwise("new")
    return found.select("row_id", chosen.alias("series_id"), outcome.alias("outcome"))


def with_units(observations: DataFrame, units: dict[str, str]) -> DataFrame:
    """EAV-02: the unit that a field's name declares; null for fields without one."""
    return observations.withColumn("unit", mapped(F.col("field_name"), units))


def mark_current(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """UPS-05: versions of both sides, a repeated content once, with is_current for each key's newest."""
    every = stored.unionByName(new).dropDuplicates([*keys, "sha256"])
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return every.withColumn("is_current", newest == 1)


def refuse_older(snapshot: DataFrame, applied: DataFrame, date: str) -> DataFrame:
    """MATCH-12: the snapshot, or an error if any row is older than what was applied last."""
    last = applied.agg(F.max(date)).scalar()
    refused = F.raise_error(F.concat(F.lit("older than the snapshot applied last: "), F.col(date).cast("string"))).cast("boolean")
    return snapshot.where(F.when(last.isNull() | (F.col(date) >= last), True).otherwise(refused))


def import_instruments(records: DataFrame, issuers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """MATCH-05: (id, instrument_id, action, reason) of records (id, issuer, keys: array) to import.

    issuers: issuer; identifiers: key, instrument_id, issuer. No issuer: review; several candidates or another
    issuer's: blocked; none: created. A record meets a key once, with the least and the largest of what has it: these tell
    several from one, so the work doesn't grow with the instruments that share a key.
    """
    known = records.join(issuers.select("issuer", F.lit(True).alias("known")).distinct(), "issuer", "left")
    held = identifiers.groupBy("key").agg(F.min("instrument_id").alias("least"), F.max("instrument_id").alias("most"), F.min("issuer").alias("issuer"), F.max("issuer").alias("last_issuer"))
    met = records.select("id", F.col("issuer").alias("own"), F.explode("keys").alias("key")).join(held, "key")
    other = F.bool_or((F.col("own") != F.col("issuer")) | (F.col("own") != F.col("last_issuer")))
    met = met.groupBy("id").agg(F.lit(True).alias("met"), F.min("least").alias("instrument_id"), F.max("most").alias("most"), other.alias("other"))
    found = known.join(met, "id", "left")
    reason = F.when(F.col("known").isNull(), "issuer_not_found").when(F.col("instrument_id") != F.col("most"), "conflicting_candidates").when(F.col("met").isNull(), "no_candidate").when(F.col("other"), "issuer_mismatch").otherwise("one_candidate")
    actions = {"issuer_not_found": "review", "conflicting_candidates": "blocked", "issuer_mismatch": "blocked", "no_candidate": "created", "one_candidate": "matched"}
    action = mapped(reason, actions)
    return found.select("id", F.when(action == "matched", F.col("instrument_id")).alias("instrument_id"), action.alias("action"), reason.alias("reason"))


def fund_phases(funds: DataFrame, providers: DataFrame) -> DataFrame:
    """MATCH-06: (kind, key, name, outcome): funds first, then the providers of funds that were resolved.

    funds: cnpj, name, type, status (several rows a fund); providers: fund, cnpj, name. A fund is resolved if it
    is in normal operation and its rows agree on name and type; a provider if its rows of resolved funds agree
    on the name.
    """
    agreed = lambda c: F.countDistinct(matching_name(F.col(c))) == 1
    one = funds.groupBy(F.col("cnpj").alias("key")).agg(F.min("name").alias("name"), agreed("name").alias("same_name"), (F.countDistinct("type") == 1).alias("same_type"), F.bool_and(F.col("status") == "normal").alias("normal"))
    outcome = F.when(~F.col("normal"), "not_in_operation").when(~F.col("same_name"), "names_diverge").when(~F.col("same_type"), "types_diverge").otherwise("resolved")
    first = one.select(F.lit("fund").alias("kind"), "key", "name", outcome.alias("outcome"))
    linked = providers.join(first.where("outcome = 'resolved'").select(F.col("key").alias("fund")), "fund", "left_semi")
    second = linked.groupBy(F.col("cnpj").alias("key")).agg(F.min("name").alias("name"), agreed("name").alias("same"))
    return first.unionByName(second.select(F.lit("provider").alias("kind"), "key", "name", F.when(F.col("same"), "resolved").otherwise("names_diverge").alias("outcome")))


def any_within(values: Column, target: Column, share: float = 0.01) -> Column:
    """JOIN-18: any value of an array within a share of the target."""
    return F.exists(values, lambda x: F.abs(x - target) <= share * F.abs(target))


def merged_signals(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """AGG-24: (key, sources, n_sources, signals) of alerts (key, text) from several sources, in the order of source and text."""
    tagged = [df.select(key, F.lit(name).alias("source"), "text") for name, df in sources.items()]
    every = reduce(DataFrame.unionByName, tagged)
    found = every.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("s"), F.array_sort(F.collect_set(F.concat(F.lit("["), "source", F.lit("] "), "text"))).alias("t"))
    return found.select(key, F.array_join("s", " + ").alias("sources"), F.size("s").cast("long").alias("n_sources"), F.array_join("t", " | ").alias("signals"))


def good_and_bad(rows: DataFrame, kinds: dict[str, str], key: str) -> DataFrame:
    """SCAN-16: (key, error): null for rows whose fields all convert, else the fields that don't."""
    casts = {"text": "string", "date": "date", "numeric": "decimal(28,8)", "integer": "bigint"}
    bad = F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(casts[k]).isNull(), F.lit(c)) for c, k in kinds.items()])
    fields = F.filter(bad, lambda x: x.isNotNull())
    return rows.select(key, F.when(F.size(fields) > 0, F.array_join(fields, ", ")).alias("error"))


#: Verdicts on the values that several documents give for one thing.
AGREE, COMPATIBLE, DIVERGE, ONE_SOURCE = "concordam", "compativeis", "divergem", "uma_fonte"


def document_verdicts(entries: DataFrame, keys: list[str], slots: bool) -> DataFrame:
    """RULE-16: (keys, verdict) of entries (keys, source, tokens: array or null).

    Entries without tokens don't count. With ``slots`` (rates) two entries diverge where both fill a slot, the part
    of a token before =, with different values; without (names) where neither's tokens hold the other's.
    """
    told = entries.where(F.col("tokens").isNotNull() & (F.size("tokens") > 0)).select(*keys, "source", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    sets = told.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.array_sort(F.collect_set(F.struct(F.size("tokens").alias("size"), "tokens"))).alias("sets"))
    if slots:
        slot = lambda t: F.substring_index(t, "=", 1)
        filled = F.flatten(F.transform("sets", lambda s: F.transform(F.array_distinct(F.transform(s["tokens"], slot)), lambda k: F.struct(k.alias("slot"), F.filter(s["tokens"], lambda t: slot(t) == k).alias("values")))))
        filled = F.array_distinct(filled)
        apart = F.size(filled) > F.size(F.array_distinct(F.transform(filled, lambda x: x["slot"])))
    else:
        # sets of growing size hold one another in pairs only if each holds the one before
        steps = F.zip_with(F.slice("sets", 1, F.greatest(F.size("sets") - 1, F.lit(0))), F.slice("sets", 2, F.greatest(F.size("sets") - 1, F.lit(0))), lambda a, b: F.size(F.array_except(a["tokens"], b["tokens"])) > 0)
        apart = F.exists(steps, lambda x: x)
    verdict = F.when((F.col("n") < 2) | (F.col("sources") < 2), ONE_SOURCE).when(F.size("sets") == 1, AGREE).when(apart, DIVERGE).otherwise(COMPATIBLE)
    every = entries.select(*keys).distinct()
    return every.join(sets, keys, "left").select(*keys, F.coalesce(F.when(F.col("n").isNotNull(), verdict), F.lit(ONE_SOURCE)).alias("verdict"))


#: Why an issuer or a debtor is not resolved.
INVALID, SEVERAL, NO_DEBTOR, PARTIAL, CONFLICT = "cnpj_invalido_na_fonte", "varios_devedores", "sem_devedor_informado", "devedor_parcial", "conflito"


def resolved_issuers(filings: DataFrame, asset: str) -> DataFrame:
    """RULE-14: (asset, cnpj, reason): the one valid issuer that all filings of an asset name; filings: asset, cnpj (normalised, null if invalid)."""
    found = filings.groupBy(asset).agg(F.count_if(F.col("cnpj").isNull()).alias("invalid"), F.countDistinct("cnpj").alias("n"), F.min("cnpj").alias("cnpj"))
    reason = F.when(F.col("invalid") > 0, INVALID).when(F.col("n") > 1, CONFLICT)
    return found.select(asset, F.when(reason.isNull(), F.col("cnpj")).alias("cnpj"), reason.alias("reason"))


def resolved_debtors(parties: DataFrame, asset: str, order: str, full: float = 1.0) -> DataFrame:
    """RULE-14: (asset, cnpj, reason): the one debtor of all filings, whole in the newest.

    parties: asset, order (of the filing), cnpj (normalised, null if invalid), share; a filing without a debtor
    has one row with both null. A share of zero or none is no debtor.
    """
    held = F.col("share") > 0
    cnpj, bad = F.when(held, F.col("cnpj")), held & F.col("cnpj").isNull()
    # a filing at a time, then the asset's newest: no window holds all its rows
    filings = parties.groupBy(asset, order).agg(
        F.min(cnpj).alias("cnpj"), F.max(cnpj).alias("other"), F.count_if(bad).alias("invalid"), F.count_if(held).alias("n_held"), F.max(F.when(held & F.col("cnpj").isNotNull(), F.col("share"))).alias("share")
    )
    newest = F.max(F.when(F.col(order).isNotNull(), F.struct(order, F.col("n_held").alias("n_last"), F.col("invalid").alias("invalid_last"), "share")))
    found = filings.groupBy(asset).agg(F.min("cnpj").alias("cnpj"), F.max("other").alias("other"), F.sum("invalid").alias("invalid"), newest.alias("last"))
    n = F.when(F.col("cnpj").isNull(), 0).when(F.col("cnpj") == F.col("other"), 1).otherwise(2)
    last = lambda c: F.coalesce(F.col(f"last.{c}"), F.lit(0))
    found = found.select(asset, "cnpj", "invalid", n.alias("n"), last("n_last").alias("n_last"), last("invalid_last").alias("invalid_last"), "last.share")
    reason = (
        F.when(F.col("n") == 0, F.when(F.col("invalid") > 0, INVALID).otherwise(NO_DEBTOR))
        .when(F.col("n") > 1, SEVERAL)
        .when(F.col("n_last") == 0, NO_DEBTOR)
        .when((F.col("invalid_last") > 0) | F.col("share").isNull() | (F.col("share") < full), PARTIAL)
    )
    return found.select(asset, F.when(reason.isNull(), F.col("cnpj")).alias("cnpj"), reason.alias("reason"))


def resolution_decision(resolved: Column, stored: Column, apply_allowed: bool) -> Column:
    """RULE-14: applied or candidate where nothing is stored, confirmed or conflict against what is; null if unresolved."""
    empty = F.trim(F.coalesce(stored, F.lit(""))) == ""
    return F.when(resolved.isNull(), None).when(empty, "applied" if apply_allowed else "candidate").when(stored == resolved, "confirmed").otherwise("conflict")


def totals_consistency(leaves: DataFrame, doc: str, inverted: list[str] = ()) -> DataFrame:
    """AGG-14: (doc, container, chain, declared, leaf_sum) of declared totals that differ from the sum of the leaves below.

    leaves: doc, xml_path, chain (the numbers of the blocks that hold a leaf), raw_text. A total is an attribute
    path container/@total. Each leaf is handed to all the containers that hold it, so the join is by equality.
    """
    value = F.trim("raw_text").try_cast("decimal(28,8)")
    parts = F.split("xml_path", "/")
    levels = F.sequence(F.lit(1), F.size(parts) - 1)
    above = F.transform(levels, lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("container"), F.slice("chain", 1, n).alias("at")))
    plain = leaves.where(~F.col("xml_path").contains("/@") & value.isNotNull() & (F.size(parts) > 1))
    signed = F.when(F.col("xml_path").isin(*inverted), -value).otherwise(value) if inverted else value
    sums = plain.select(doc, signed.alias("v"), F.explode(above).alias("a")).groupBy(doc, "a").agg(F.sum("v").alias("leaf_sum")).select(doc, "a.container", "a.at", "leaf_sum")
    totals = leaves.where(F.col("xml_path").endswith("/@total") & value.isNotNull())
    totals = totals.select(doc, F.expr("left(xml_path, length(xml_path) - 7)").alias("container"), F.col("chain").alias("at"), value.alias("declared"))
    found = totals.join(sums, [doc, "container", "at"], "left").withColumn("leaf_sum", F.coalesce("leaf_sum", F.lit(0).cast("decimal(28,8)")))
    return found.where("declared <> leaf_sum").select(doc, "container", F.col("at").alias("chain"), "declared", "leaf_sum")


def against_market(extracted: DataFrame, market: DataFrame, aliases: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """JOIN-14: (code, keys, outcome): extracted values against the market's of the same code or any of its aliases.

    extracted: code, keys, value; market: code, keys, value; aliases: code, alias.
    """
    names = extracted.select("code").distinct()
    names = names.select("code", F.col("code").alias("alias")).unionByName(aliases.select("code", "alias")).distinct()
    there = market.select(F.col("code").alias("alias"), *keys, F.col("value").alias("market"))
    found = extracted.join(names, "code").join(there, ["alias", *keys], "left")
    met = found.groupBy("code", *keys, "value").agg(F.count("market").alias("n"), F.coalesce(F.bool_or(F.abs(F.col("market") - F.col("value")) <= share * F.greatest(F.lit(1.0), F.abs("value"))), F.lit(False)).alias("close"))
    return met.select("code", *keys, F.when(F.col("n") == 0, "no_row").when(F.col("close"), "equal").otherwise("different").alias("outcome"))
