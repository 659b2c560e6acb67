"""The passages of a contract that speak for a field (TXT-09): its definition, its clause, and where else it is named.

Documents of an asset are numbered from the oldest to the newest. All that is read from a page is read in its own
row, so no page's text is shuffled; choices are aggregates, so an asset of very many pages is no group of one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .graph import checkpointed
from .text_rules import ANNEX_TITLE, FIRST_ANNEX_PAGE, GLOSSARY_LINES, MEANING, TOC_LINE, TOC_LINES
from .versions import first_rows

#: How a definition and a labelled item are written, what makes an annex the text in force.
OPENED = r'(?:(?<=[“"][^”"\n]{0,60})|(?=[“"]))'
MEANS = r'(?:(?<=[”"])|(?<![”"])[^”"\n]{0,60}[”"])\s*(?iu:[:\-–—]|,?\s*(?:significa|tem o significado|ter[áa]o? o significado|corresponde|refere-se))'
ITEM = r"^\s*(?i:\(?[ivxlc]{1,6}\)|\(?[a-z]\)|\d+(?:\.\d+)*\.?|[-•])\s+.{0,50}?"
ITEM_END = r"[^.:;—–\n]{0,60}?\s*[.:—–]"
CONSOLIDATED = r"consolida"
CONSOLIDATED_TITLE = r"^(?:termo de secur?t?izacao|\w+ aditamento ao termo)"
UPDATED_ANNEX = r"redacao atualizada do anexo"
#: Most letters of an excerpt, pages of a clause and references listed for a field.
EXCERPT, RANGE, REFERENCES = 420, 6, 8


def _page_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _filled(lines: Column) -> Column:
    return F.filter(F.transform(lines, F.trim), lambda x: x != "")


def page_flags(text: Column, page: Column) -> dict[str, Column]:
    """is_toc, is_glossary, and opens_annex: whether an annex begins here, its text in force begins again, or neither (null)."""
    lines, folded = _filled(_page_lines(text)), _filled(_page_lines(fold(text)))
    count = lambda c, test: F.size(F.filter(c, test))
    meanings = count(folded, lambda x: F.regexp_replace(x, "^.*? {3,}", "").rlike(MEANING) | F.substring(x, 1, 120).contains("significa"))
    top = F.slice(F.filter(lines, lambda x: ~F.lower(x).contains("docusign")), 1, 5)
    heading = F.transform(F.slice(F.filter(folded, lambda x: ~x.contains("docusign")), 1, 5), lambda x: F.regexp_replace(x, r"\s+", " "))
    whole = F.array_join(heading, " ")
    in_force = (whole.rlike(CONSOLIDATED) | F.exists(heading, lambda x: x.rlike(CONSOLIDATED_TITLE))) & ~whole.rlike(UPDATED_ANNEX)
    title = (page >= FIRST_ANNEX_PAGE) & F.exists(F.slice(top, 1, 2), lambda x: x.rlike(ANNEX_TITLE))
    return {
        "is_toc": count(lines, lambda x: x.rlike(TOC_LINE)) >= TOC_LINES,
        "is_glossary": (count(lines, lambda x: x.rlike('^[“"]')) >= GLOSSARY_LINES) & (meanings >= GLOSSARY_LINES - 1),
        "opens_annex": F.when(title, ~in_force),
    }


def in_annex(doc: list[str], page: str) -> Column:
    """Whether a page lies in an annex, from ``opens_annex`` of it and the pages before."""
    return F.coalesce(F.last("opens_annex", True).over(Window.partitionBy(*doc).orderBy(page)), F.lit(False))


def shortened(text: Column, most: int = EXCERPT) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def excerpt_at(lines: Column, line: Column, before: int = 1, after: int = 6, most: int = EXCERPT) -> Column:
    """The lines around ``line`` (from 0), blanks collapsed."""
    first = F.greatest(line - before, F.lit(0))
    chosen = F.transform(F.slice(lines, first + 1, line + after + 1 - first), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return shortened(F.array_join(F.filter(chosen, lambda x: x != ""), " "), most)


def _once(value: Column, of) -> Column:
    """``of`` a value that is made once, however often ``of`` names it: Spark shares no expressions with lambdas in them."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def field_hits(lines: Column, patterns: list[str]) -> Column:
    """struct<n, first, definition: struct<line, at>, label> of a page's lines; lines from 0, columns from 1, null if there is none.

    Only lines that name the field are searched for a definition, which looks back from every letter.
    """
    any_of = "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    n = lambda x: sum((F.regexp_count(x, F.lit(p)) for p in patterns[1:]), F.regexp_count(x, F.lit(patterns[0])))
    named = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("text"), i.alias("line"), n(x).alias("n"))), lambda h: h["n"] > 0)
    seen = F.transform(
        named,
        lambda h: F.struct(
            h["line"].alias("line"),
            h["n"].alias("n"),
            F.regexp_instr(h["text"], F.lit(OPENED + any_of + MEANS)).alias("at"),
            h["text"].rlike(ITEM + any_of + ITEM_END).alias("label"),
        ),
    )
    head = lambda c: F.try_element_at(c, F.lit(1))
    return _once(
        seen,
        lambda s: F.struct(
            F.aggregate(s, F.lit(0), lambda n, h: n + h["n"]).alias("n"),
            head(s)["line"].alias("first"),
            head(F.transform(F.filter(s, lambda h: h["at"] > 0), lambda h: F.struct(h["line"].alias("line"), h["at"].alias("at")))).alias("definition"),
            head(F.filter(s, lambda h: h["label"]))["line"].alias("label"),
        ),
    )


def _plain(text: str) -> str:
    return " ".join("".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().split())


def two_columns(text: str) -> list[tuple[str, str]]:
    """The rows of a page as (left, right) columns; none where fewer than three rows agree on where the right one begins."""
    rows = text.split("\n")
    begins = Counter()
    for row in rows:
        gap = re.search(r"(?<=\S) {3,}(?=\S)", row)
        if gap and gap.start() <= 45:
            begins[gap.end()] += 1
    (at, votes), = begins.most_common(1) or [(0, 0)]
    if votes < 3:
        return []
    parted = []
    for row in rows:
        near = [g for g in re.finditer(" {2,}(?=.)", row) if abs(g.end() - at) <= 4]
        if near:
            parted.append((row[: near[0].start()].strip(), row[near[0].end() :].strip()))
        elif row[: max(at - 3, 0)].strip():
            parted.append((row.strip(), ""))
        else:
            parted.append(("", row.strip()))
    return parted


def paired_definition(text: str, line: int) -> str | None:
    """Term and meaning of a table of two columns, for the term that begins on ``line``; None where they can't be told.

    Such tables are read with the columns shifted, so the n-th term has the n-th meaning. A meaning before the first term
    belongs to a page before, a last term without one to the page after.
    """
    rows = two_columns(text)
    terms = [i for i, (left, _) in enumerate(rows) if left.startswith(("“", '"'))]
    meanings = [i for i, (_, right) in enumerate(rows) if re.match(MEANING, _plain(right))]
    if terms and len(meanings) - len(terms) == 1 and meanings[0] < terms[0]:
        del meanings[0]
    elif len(terms) - len(meanings) == 1 and (not meanings or meanings[-1] < terms[-1]):
        del terms[-1]
    if line not in terms or len(terms) != len(meanings):
        return None
    k = terms.index(line)
    upto = lambda found: found[k + 1] if k + 1 < len(found) else len(rows)
    words = lambda side, first, end: " ".join(" ".join(r[side] for r in rows[first:end]).split())
    return f"{words(0, line, upto(terms))}: {words(1, meanings[k], upto(meanings))}"


def _paired(text: pa.Array, line: pa.Array) -> pa.Array:
    # the text is null but on pages with a definition
    return pa.array([None if t is None or n is None else paired_definition(t, n) for t, n in zip(text.to_pylist(), line.to_pylist(), strict=True)], pa.string())


def page_hits(pages: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """A row for each page of (asset, doc, doc_rank, page, text, ocr) and each field that it names; written down once."""
    lines = _page_lines(F.coalesce("text", F.lit("")))
    marked = pages.select("asset", "doc", "doc_rank", "page", "ocr", "text", lines.alias("lines"))
    named = F.array(*[F.struct(F.lit(name).alias("field"), field_hits(F.col("lines"), patterns).alias("h")) for name, patterns in fields.items()])
    flags = page_flags(F.coalesce("text", F.lit("")), F.col("page"))
    marked = marked.select("*", F.filter(named, lambda x: x["h"]["n"] > 0).alias("named"), *[c.alias(n) for n, c in flags.items()])
    # what leaves the row: for each field its two excerpts, and the text only where a definition may lie in a table
    marked = marked.select(
        "asset", "doc", "doc_rank", "page", "ocr", "is_toc", "is_glossary", "opens_annex",
        F.transform("named", lambda x: F.struct(x["field"].alias("field"), x["h"].alias("h"), excerpt_at(F.col("lines"), x["h"]["definition"]["line"]).alias("definition_text"), excerpt_at(F.col("lines"), F.coalesce(x["h"]["label"], x["h"]["first"])).alias("clause_text"))).alias("named"),
        F.when(F.exists("named", lambda x: x["h"]["definition"].isNotNull()) & F.col("text").rlike(r"\S {3,}\S"), F.col("text")).alias("table_text"),
    )
    marked = marked.withColumn("is_annex", in_annex(["asset", "doc"], "page"))
    found = marked.select("asset", "doc", "doc_rank", "page", "ocr", "is_toc", "is_glossary", "is_annex", "table_text", F.inline("named"))
    found = found.withColumn("paired", F.arrow_udf(_paired, "string")(F.when(F.col("h.definition").isNotNull(), F.col("table_text")), F.col("h.definition.line")))
    text = F.coalesce(shortened(F.col("paired")), F.col("definition_text"))
    return checkpointed(found.select("asset", "field", "doc", "doc_rank", "page", "ocr", "is_toc", "is_glossary", "is_annex", "h.*", text.alias("definition_text"), "clause_text"))


def _run(pages: Column, page: Column, step: int) -> Column:
    """How many of the next pages in one direction are there without a gap, up to what a clause may take."""
    missing = F.array_position(F.transform(F.sequence(F.lit(1), F.lit(RANGE - 1)), lambda d: F.array_contains(pages, page + step * d)), F.lit(False))
    return F.when(missing == 0, RANGE - 1).otherwise(missing - 1).cast("int")


def chosen_excerpts(hits: DataFrame) -> DataFrame:
    """TXT-09: (asset, field, kind, doc, page, line, text, ocr, is_annex, first_page, last_page): at most a ``definicao`` and a ``clausula`` a field.

    The definition: outside tables of contents, the body before annexes, the newest document, its first page. The
    clause, on another page: the body before annexes, other pages before glossaries, a labelled item before plain mentions,
    then the most mentions, the newest document, the first page; with the pages on both sides that name the field too, six at most.
    Equal page numbers of a document are one page to the range; the row taken is then the one whose excerpt is smaller.
    """
    usable = hits.where("not is_toc")
    own = ["doc", "page", "ocr", "is_annex", "is_glossary"]
    definition = usable.where("definition is not null").groupBy("asset", "field").agg(
        F.min_by(F.struct(*own, F.col("definition.line").alias("line"), F.col("definition_text").alias("text")), F.struct("is_annex", -F.col("doc_rank"), "page", "definition_text")).alias("d")
    )
    rest = usable.join(definition, ["asset", "field"], "left").where("d is null or d.doc <> doc or d.page <> page").drop("d")
    clause = rest.groupBy("asset", "field").agg(
        F.min_by(
            F.struct(*own, F.coalesce("label", "first").alias("line"), F.col("clause_text").alias("text")),
            F.struct("is_annex", "is_glossary", F.col("label").isNull(), -F.col("n"), -F.col("doc_rank"), "page", "clause_text"),
        ).alias("c")
    )
    near = rest.join(clause, ["asset", "field"]).where(f"doc = c.doc and is_annex = c.is_annex and is_glossary = c.is_glossary and abs(page - c.page) < {RANGE}")
    spans = near.groupBy("asset", "field").agg(F.first("c").alias("c"), F.collect_set("page").alias("pages"))
    spans = spans.select("asset", "field", "c", _run(F.col("pages"), F.col("c.page"), -1).alias("a"), _run(F.col("pages"), F.col("c.page"), 1).alias("b"))
    # both sides take turns, the one before first; what one lacks the other may take
    before = F.least("a", F.greatest(F.lit(RANGE // 2), F.lit(RANGE - 1) - F.col("b")))
    after = F.least(F.col("b"), F.lit(RANGE - 1) - before)
    shown = lambda s, first, last: [F.col(f"{s}.doc").alias("doc"), F.col(f"{s}.page").alias("page"), (F.col(f"{s}.line") + 1).alias("line"), F.col(f"{s}.text").alias("text"), F.col(f"{s}.ocr").alias("ocr"), F.col(f"{s}.is_annex").alias("is_annex"), first.alias("first_page"), last.alias("last_page")]
    first = definition.select("asset", "field", F.lit("definicao").alias("kind"), *shown("d", F.col("d.page"), F.col("d.page")))
    return first.unionByName(spans.select("asset", "field", F.lit("clausula").alias("kind"), *shown("c", F.col("c.page") - before, F.col("c.page") + after)))


def other_references(hits: DataFrame, chosen: DataFrame) -> DataFrame:
    """TXT-09: (asset, field, kind, doc, page, pages): other pages that name the field, the first eight ``outra`` and ``anexo``; pages: of the field, in all.

    Annex pages are kept apart once the body has an excerpt.
    """
    total = hits.groupBy("asset", "field").agg(F.count("*").alias("pages"))
    spans = chosen.groupBy("asset", "field").agg(F.collect_list(F.struct("doc", "first_page", "last_page")).alias("spans"), F.bool_or(~F.col("is_annex")).alias("has_body"))
    joined = hits.join(total, ["asset", "field"]).join(spans, ["asset", "field"], "left")
    inside = F.coalesce(F.exists("spans", lambda s: (s["doc"] == F.col("doc")) & F.col("page").between(s["first_page"], s["last_page"])), F.lit(False))
    left = joined.where(~inside).withColumn("kind", F.when(F.col("is_annex") & F.coalesce("has_body", F.lit(False)), "anexo").otherwise("outra"))
    return first_rows(left, ["asset", "field", "kind"], ["doc_rank", "page"], REFERENCES).select("asset", "field", "kind", "doc", "page", "pages")
