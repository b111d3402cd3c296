"""Pages: reading order, quality, running headers, sections, figures, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lists
from ..functions import pages as P
from ..functions.text import squeeze, strip
from ..plans.scans import carry_forward, running_sum
from ..plans.sizing import bounded_broadcast
from ..session import cut, stored

TEXT_RICH = 1400
SHORT_PAGE = 60
MIN_FIGURE_AREA = 0.05


def reading_order(blocks: DataFrame) -> DataFrame:
    """Page text from layout blocks: text blocks by (snapped y, x), joined by blank lines."""
    text = strip(F.coalesce("text", F.lit("")))
    kept = blocks.filter("block_type = 0").withColumn("text", text).filter(F.length("text") >= 2)
    place = F.struct((F.bround(F.col("y0") / 4.0) * 4.0).alias("y"), F.col("x0").alias("x"), "seq", "text")
    return kept.groupBy("source", "page").agg(strip(F.array_join(
        F.transform(F.array_sort(F.collect_list(place)), lambda b: b["text"]), "\n\n")).alias("text"))


def choose_text(pages: DataFrame, digital: str = "digital", ocr: str = "ocr") -> DataFrame:
    """Digital text, or the alternative where the digital text is bad and the alternative is not."""
    rows = pages.withColumn("_d", P.light_clean(F.coalesce(digital, F.lit("")))).withColumn(
        "_o", P.light_clean(F.coalesce(ocr, F.lit(""))))
    rows = rows.withColumn("_bad", P.is_bad_extraction("_d"))
    ran = F.col("_bad") & (F.coalesce(F.length(ocr), F.lit(0)) > 0)
    swap = ran & ~P.is_bad_extraction("_o") & (F.length("_o") >= 20)
    rows = rows.withColumn("_swap", swap).withColumn("ran_ocr", ran)
    return rows.withColumn("text", F.when(F.col("_swap"), F.col("_o")).otherwise(F.col("_d"))).withColumn(
        "used_digital", ~F.col("_swap") & (F.length("_d") > 0)).withColumn(
        "replaced_bad", F.col("_swap") & (F.length("_d") > 0)).drop("_d", "_o", "_bad", "_swap")


def header_candidates(text, exclude_end_marks: bool = True) -> Column:
    """Distinct trimmed lines of a page that could be a running header."""
    lines = F.array_distinct(F.transform(F.split(text, "\n", -1), strip))
    fits = lambda s: F.length(s).between(3, 60)
    ends = lambda s: ~s.rlike(r"[.?!]$") if exclude_end_marks else F.lit(True)
    return F.filter(lines, lambda s: fits(s) & ends(s))


def running_headers(pages: DataFrame, text: str = "text", ratio: float = 0.3, min_pages: int = 4,
                    exclude_end_marks: bool = True) -> DataFrame:
    """Lines on at least ``max(2, floor(ratio * pages))`` pages of a source with ``min_pages`` pages or more.

    Lines are distinct within their page before they are counted, so the count
    combines in every task and a source of any size spreads over its lines.
    """
    totals = pages.groupBy("source").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    lines = pages.select("source", F.explode(header_candidates(F.col(text), exclude_end_marks)).alias("line"))
    counts = lines.groupBy("source", "line").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(2), F.floor(F.col("pages") * ratio + 1e-9))
    return counts.join(totals, "source").filter(F.col("n") >= least).select("source", "line", "n")


def header_lists(headers: DataFrame) -> DataFrame:
    """Headers of a source as one list. At most (lines per page / ratio) lines can be headers."""
    return headers.groupBy("source").agg(F.collect_set("line").alias("headers"))


def strip_furniture(text, headers, patterns=lists.BOILERPLATE_LINES, credits=lists.CREDIT_MARKS) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda s: ~P.is_boilerplate(s, patterns, credits) & ~(
        F.array_contains(headers, strip(s)) & (strip(s) != "") & ~s.rlike(r"^\s*\[(Figure|Page Visual) Description\]")))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def annotated(text, headers) -> Column:
    """Remaining lines with their tags; header lines go, blank lines stay empty."""
    rows = F.filter(F.split(text, "\n", -1), lambda s: ~F.array_contains(headers, strip(s)) | (strip(s) == ""))
    return strip(F.array_join(F.transform(rows, lambda s: F.when(strip(s) == "", F.lit("")).otherwise(P.tagged_line(s))), "\n"))


def page_heading(text, headers) -> Column:
    """First line of the page that reads like a heading and is not a running header."""
    bare = F.transform(F.split(text, "\n", -1), strip)
    return F.get(F.filter(bare, lambda s: ~F.array_contains(headers, s) & P.is_heading(s)), F.lit(0))


def section_pages(pages: DataFrame, steps=P.STEPS, ratio: float = 0.3, min_pages: int = 4,
                  exclude_end_marks: bool = True, clean: bool = True) -> DataFrame:
    """The whole page job: clean, drop running headers and furniture, tag lines, carry sections forward.

    ``pages``: source, page, text. One shuffle counts headers, one blocked scan
    carries the section; pages left empty still move the section on.
    """
    base = cut(pages.withColumn("text", P.heavy_clean("text", steps))) if clean else pages  # cleaned once, read three times
    headers = cut(header_lists(running_headers(base, "text", ratio, min_pages, exclude_end_marks)))
    none = F.array().cast("array<string>")
    rows = base.join(bounded_broadcast(headers), "source", "left").withColumn("headers", F.coalesce("headers", none))
    rows = rows.withColumn("text", strip_furniture(F.col("text"), F.col("headers")))
    rows = rows.withColumn("heading", page_heading(F.col("text"), F.col("headers"))).withColumn(
        "text", annotated(F.col("text"), F.col("headers"))).drop("headers")
    rows = stored(rows)  # read twice by the scan
    rows = carry_forward(rows, ["source"], "page", "heading", "section")
    return rows.filter(F.length("text") > 0)


def page_rows(sectioned: DataFrame) -> DataFrame:
    visual = F.col("visual_text") if "visual_text" in sectioned.columns else F.lit("")
    return sectioned.select("source", "page", "section", "text", visual.alias("visual_text"),
                            (F.length(visual) > 0).alias("has_visual_description"))


def extraction_report(chosen: DataFrame, kept: DataFrame, headers: DataFrame) -> DataFrame:
    """Totals of one run as a single row."""
    read = chosen.agg(
        F.count("*").alias("total_pages"), F.count_if("used_digital").alias("digital_pages"),
        F.count_if("ran_ocr").alias("ocr_pages"), F.count_if("replaced_bad").alias("ocr_replaced_bad"))
    out = kept.agg(F.count("*").alias("pages_kept"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("output_chars"))
    lines = headers.agg(F.count("*").alias("running_headers"))
    # three one-row results side by side
    return read.withColumn("_k", F.lit(1)).join(out.withColumn("_k", F.lit(1)), "_k").join(
        lines.withColumn("_k", F.lit(1)), "_k").drop("_k")


# -- figures ---------------------------------------------------------------------------------

def image_stats(images: DataFrame) -> DataFrame:
    """Per page: distinct images, largest and total share of the page (largest placement per image)."""
    once = images.groupBy("source", "page", "xref").agg(F.max("area_ratio").alias("area"))
    return once.groupBy("source", "page").agg(
        F.count("*").alias("image_count"), F.max("area").alias("largest_ratio"), F.sum("area").alias("total_ratio"))


def visual_heavy(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """Pages better read as a picture."""
    rows = pages.join(stats, ["source", "page"], "left").na.fill(
        {"image_count": 0, "largest_ratio": 0.0, "total_ratio": 0.0})
    compact = squeeze(F.coalesce("text", F.lit("")))
    dominant = (F.col("largest_ratio") >= 0.35) | (F.col("total_ratio") >= 0.60)
    keyword = compact.rlike("(?iU)" + lists.VISUAL_WORDS) & (F.col("image_count") > 0)
    return rows.withColumn("visual_heavy", (F.length(compact) < TEXT_RICH) & (
        (F.length(compact) < SHORT_PAGE) | dominant | keyword))


def figure_order(images: DataFrame, least: float = MIN_FIGURE_AREA) -> DataFrame:
    """Candidate figures of a page by size; an unplaced image (area 0) stays in."""
    once = images.groupBy("source", "page", "xref").agg(F.max("area_ratio").alias("area"))
    kept = once.filter((F.col("area") >= least) | (F.col("area") == 0))
    order = Window.partitionBy("source", "page").orderBy(F.desc("area"), "xref")
    return kept.withColumn("figure_no", F.row_number().over(order))


def figure_budget(figures: DataFrame, pages: DataFrame, budget: int, rich_figures: int = 1) -> DataFrame:
    """Figures within the source's budget, page by page; text-rich pages get at most ``rich_figures``.

    ``pages``: source, page, text_rich.
    """
    rows = figures.join(pages.select("source", "page", "text_rich"), ["source", "page"])
    rows = rows.filter(~F.col("text_rich") | (F.col("figure_no") <= rich_figures))
    per_page = rows.groupBy("source", "page").agg(F.count("*").alias("n"))
    upto = running_sum(per_page, ["source"], "page", F.col("n"), "upto")
    before = upto.select("source", "page", (F.col("upto") - F.col("n")).alias("before"))
    return rows.join(before, ["source", "page"]).withColumn(
        "running", F.col("before") + F.col("figure_no")).filter(F.col("running") <= budget).drop("before")
