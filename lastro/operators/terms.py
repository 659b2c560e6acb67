"""Values of securitisation terms against the market's monthly report, field by field (RULE-17).

Candidates are what the extractors found in each document of an asset. Each field says which of them speak for the
asset, what the market says, and when the two agree; a field with several values agrees if one of them does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The verdicts.
AGREES, DIFFERS, NO_TERM, NO_MARKET, BACKING_DATE = "concorda", "diverge", "sem_valor_no_termo", "sem_dado_cvm", "informe_usa_data_do_lastro"
#: Fixed value: the share of the market's value that a term's value may be away from it.
TOLERANCE = 0.01


def near(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.coalesce((b != 0) & (F.abs(a - b) <= F.abs(b) * F.lit(tolerance).cast("decimal(3,2)")), F.lit(False))


def _counting(candidates: DataFrame) -> DataFrame:
    """The candidates that count, repeats with them; shuffled by asset once, for what follows too."""
    by = ["asset", "doc", "doc_rank", "field"]
    group = Window.partitionBy(*by)
    strongest = F.min(F.when(F.col("strength").isNotNull(), F.struct("strength", F.col("page").isNull(), "page"))).over(group)
    joined = candidates.dropna(subset=by).repartition("asset").withColumns({"loose": strongest, "first": F.min(F.struct("page", "strength", "value")).over(group)})
    issue, due, least = F.col("field") == "data_emissao", F.col("field") == "data_vencimento", F.col("loose.strength")
    first = (F.col("page") == F.col("first.page")) & (F.col("strength") == F.col("first.strength")) & (F.col("value") == F.col("first.value"))
    chosen = F.when(issue, first).otherwise((F.col("strength") == least) & (~due | (least == 0) | (F.col("page") == F.col("loose.page"))))
    return joined.where(chosen).select(*by, "strength", "page", "value")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """The candidates of each document and field that count (asset, doc, doc_rank, field, strength, page, value).

    The date of issue: the first page's; other fields: those of the strongest pattern (0 is the strongest), and for a due date of
    a weaker pattern those of the first page that has one. Repeats go.
    """
    return _counting(candidates).distinct()


def term_values(candidates: DataFrame) -> DataFrame:
    """One row an asset: issued (date, doc, page) of the first document that has it, and the values of all documents for other fields."""
    # sets and the least, which repeats don't change
    best = _counting(candidates)
    of = lambda field: F.array_sort(F.collect_set(F.when(F.col("field") == field, F.col("value"))))
    numbers = lambda field: F.array_sort(F.collect_set(F.when(F.col("field") == field, F.col("value").try_cast("decimal(30,10)"))))
    issued = F.min(F.when(F.col("field") == "data_emissao", F.struct("doc_rank", "doc", "page", "value")))
    return best.groupBy("asset").agg(
        issued.alias("issued"), of("data_vencimento").alias("due"), of("data_vencimento_lastro").alias("backing_due"),
        numbers("valor_total").alias("totals"), numbers("quantidade").alias("quantities"), numbers("valor_nominal_unitario").alias("units"),
        of("remuneracao").alias("rates"), of("devedor").alias("debtors"),
    )


def market_values(series: DataFrame, debtors: DataFrame) -> DataFrame:
    """One row an asset: issue date, its series (name, due, paid_in, quantity, rate, rate_numbers) by name, and debtors."""
    each = F.struct(F.col("series").alias("name"), "due", "paid_in", "quantity", "rate", "rate_numbers")
    held = series.groupBy("asset").agg(F.max("issued").alias("market_issued"), F.array_sort(F.collect_list(each)).alias("series"))
    named = debtors.where("debtor is not null").groupBy("asset").agg(F.array_sort(F.collect_set("debtor")).alias("market_debtors"))
    return held.join(named, "asset", "left").withColumn("market_debtors", F.coalesce("market_debtors", F.array().cast("array<string>")))


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), "; ")


def _amounts(values: Column, places: int = 2) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast(f"decimal(30,{places})").cast("string")), "; ")


def _verdict(field: Column | str, outcome: Column, term: Column, market: Column, source: Column | None = None) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(field.alias("field"), outcome.alias("outcome"), text(term).alias("term"), text(market).alias("market"), text(F.lit("") if source is None else source).alias("source"))


def _by_series(verdict) -> Column:
    """A verdict for each series, those that are null left out."""
    return F.array_compact(F.transform(F.col("series"), verdict))


def term_verdicts(candidates: DataFrame, series: DataFrame, debtors: DataFrame) -> DataFrame:
    """RULE-17: (asset, field, outcome, term, market, source) for every asset with candidates.

    candidates: asset, doc, doc_rank (terms before amendments, old before new), field, strength, page, value; fields: data_emissao,
    data_vencimento, data_vencimento_lastro, valor_total, quantidade, valor_nominal_unitario, remuneracao (``slot=number``),
    devedor. series: asset, issued, series, due, paid_in, quantity, rate, rate_numbers; debtors: asset, debtor.

    An asset without market rows has one verdict, ``emissao``. Dates: equal. Due dates and rates go series by series; a
    due date that only the backing title has is told apart, and a rate agrees if all its numbers are in the terms, the
    usual ``mult=100`` left aside. The total agrees with the whole paid in or with one series', quantities with
    the sum or series by series, the unit value with that of the first series that has one. Fields that either side
    lacks are told or, for amounts, left out.
    """
    both = term_values(candidates).join(market_values(series, debtors), "asset", "left")
    empty = lambda c: F.size(c) == 0
    agree = lambda condition: F.when(condition, AGREES).otherwise(DIFFERS)
    issued = F.when(F.col("issued").isNull(), NO_TERM).otherwise(agree(F.coalesce(F.col("issued.value") == F.col("market_issued"), F.lit(False))))
    source = F.concat(F.col("issued.doc").cast("string"), F.lit(" p."), F.col("issued.page").cast("string"))
    dates = F.concat("due", F.transform("backing_due", lambda x: F.concat(F.lit("lastro "), x)))

    def due(s: Column) -> Column:
        known = lambda c: F.coalesce(F.array_contains(c, F.coalesce(s["due"], F.lit(""))), F.lit(False))
        outcome = F.when(empty("due") & empty("backing_due"), NO_TERM).when(known("due"), AGREES).when(known("backing_due"), BACKING_DATE).otherwise(DIFFERS)
        shown = F.when(outcome == DIFFERS, _joined(F.array_sort(dates))).otherwise(_joined(F.col("due")))
        return _verdict(F.concat(F.lit("vencimento "), s["name"]), outcome, shown, s["due"])

    def rate(s: Column) -> Column:
        decisive = F.filter(s["rate_numbers"], lambda x: x != "mult=100")
        outcome = F.when(empty("rates"), NO_TERM).otherwise(agree(F.size(F.array_except(decisive, F.col("rates"))) == 0))
        return F.when(F.size(decisive) > 0, _verdict(F.concat(F.lit("remuneracao "), s["name"]), outcome, F.substring(_joined(F.col("rates")), 1, 120), s["rate"]))

    number = lambda c: F.transform("series", lambda s: s[c])
    total = lambda values: F.aggregate(values, F.lit(0).cast("decimal(30,10)"), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("decimal(30,10)"))
    paid = F.filter(number("paid_in"), lambda x: x > 0)
    whole = total(number("paid_in"))
    total_agrees = F.exists("totals", lambda t: near(t, whole) | F.exists(paid, lambda x: near(t, x)))
    sums = total(number("quantity"))
    held = lambda q: F.coalesce(F.array_contains("quantities", q.cast("decimal(30,10)")), F.lit(False))
    quantity_agrees = held(sums) | F.forall(number("quantity"), held)
    priced = F.filter("series", lambda s: (s["quantity"] > 0) & (s["paid_in"] > 0))
    unit = F.when(F.size(priced) > 0, F.get(priced, F.lit(0))["paid_in"] / F.get(priced, F.lit(0))["quantity"]).cast("decimal(30,10)")
    own, named = F.col("debtors"), F.col("market_debtors")
    debtor = F.when(empty(own), NO_TERM).otherwise(agree(F.arrays_overlap(own, named)))
    verdicts = F.concat(
        F.array(_verdict("data_emissao", issued, F.col("issued.value"), F.col("market_issued"), source)),
        _by_series(due),
        F.array_compact(
            F.array(
                F.when(~empty("totals") & (whole != 0), _verdict("valor_total", agree(total_agrees), _amounts(F.col("totals")), whole.cast("decimal(30,2)"))),
                F.when(~empty("quantities"), _verdict("quantidade", agree(quantity_agrees), _amounts(F.col("quantities"), 0), sums.cast("decimal(30,0)"))),
                F.when(~empty("units") & unit.isNotNull(), _verdict("valor_nominal_unitario", agree(F.exists("units", lambda u: near(u, unit))), _amounts(F.col("units")), unit.cast("decimal(30,2)"))),
                F.when(~empty(named), _verdict("devedor", debtor, F.substring(_joined(own), 1, 120), _joined(named))),
            )
        ),
        _by_series(rate),
    )
    missing = F.array(_verdict("emissao", F.lit(NO_MARKET), F.lit(""), F.lit("")))
    return both.select("asset", F.inline(F.when(F.col("series").isNull(), missing).otherwise(verdicts)))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """(field, outcome, n) over all assets, series of a field together."""
    return verdicts.groupBy(F.substring_index("field", " ", 1).alias("field"), "outcome").agg(F.count("*").alias("n"))
