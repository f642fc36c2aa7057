"""Stored web pages to rows: titles, link lists, label/value pairs and per-round stat cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.functions.text import strip_label


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag_text(html: Column | str, tag: str) -> Column:
    """Text of the first such element."""
    return F.regexp_extract(_c(html), f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1)


def attribute(html: Column | str, tag: str, name: str) -> Column:
    return F.regexp_extract(_c(html), f'<{tag}[^>]*\\s{name}="([^"]*)"', 1)


def plain_text(html: Column) -> Column:
    """Markup removed, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", " "))


def links(pages: DataFrame, key: Sequence[str], html: str = "html") -> DataFrame:
    """Every link of a page with its place, target and text."""
    targets = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>.*?</a>'), 1)
    texts = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<a\s[^>]*?href="[^"]*"[^>]*>(.*?)</a>'), 1)
    return pages.select(*key, F.posexplode(F.arrays_zip(targets.alias("href"), texts.alias("text"))).alias("place", "_l")).select(
        *key, "place", F.col("_l.href").alias("href"), plain_text(F.col("_l.text")).alias("text")
    )


def label_values(pages: DataFrame, key: Sequence[str], html: str = "html", item: str = "li") -> DataFrame:
    """"Label: value" items of a page."""
    items = F.regexp_extract_all(F.col(html), F.lit(f"(?s)<{item}(?:\\s[^>]*)?>(.*?)</{item}>"), 1)
    rows = pages.select(*key, F.posexplode(items).alias("place", "_i")).withColumn("_i", plain_text(F.col("_i")))
    return rows.where(F.contains(F.col("_i"), F.lit(":"))).select(
        *key, "place", F.trim(F.split_part("_i", F.lit(":"), F.lit(1))).alias("label"), F.trim(strip_label("_i")).alias("value")
    )


def stat_cells(pages: DataFrame, key: Sequence[str], html: str = "html", cell_class: str | None = None, inner: str = "p") -> DataFrame:
    """Stat cells in page order: the lines of a cell belong to side A and B in turn."""
    opening = f'<td[^>]*class="[^"]*{cell_class}[^"]*"[^>]*>' if cell_class else "<td(?:\\s[^>]*)?>"
    cells = F.regexp_extract_all(F.col(html), F.lit(f"(?s){opening}(.*?)</td>"), 1)
    rows = pages.select(*key, F.posexplode(cells).alias("cell", "_c"))
    lines = F.regexp_extract_all(F.col("_c"), F.lit(f"(?s)<{inner}(?:\\s[^>]*)?>(.*?)</{inner}>"), 1)
    return rows.select(*key, "cell", F.posexplode(lines).alias("line", "_v")).select(
        *key, "cell", (F.col("line") % 2).alias("side"), F.floor(F.col("line") / 2).cast("int").alias("pair"), plain_text(F.col("_v")).alias("value")
    )


def stat_records(cells: DataFrame, key: Sequence[str], width: int | None = None) -> DataFrame:
    """Split each side's cells into records: a new one starts whenever the side's first cell (the name) repeats.

    One page and side hold a handful of cells, so the window is short.
    """
    w = Window.partitionBy(*key, "side").orderBy("cell", "pair")
    named = cells.withColumn("_name", F.first("value").over(w))
    starts = named.withColumn("record", F.sum((F.col("value") == F.col("_name")).cast("int")).over(w) - 1)
    return starts.withColumn("place", F.row_number().over(Window.partitionBy(*key, "side", "record").orderBy("cell", "pair")) - 1).select(
        *key, "side", F.col("_name").alias("name"), "record", "place", "value"
    )


def pivot_records(records: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per record with its cells in named columns; a record with more cells than names is an error."""
    wide = records.groupBy(*key, "side", "name", "record").agg(
        F.max("place").alias("_last"), *[F.max(F.when(F.col("place") == i, F.col("value"))).alias(c) for i, c in enumerate(columns)]
    )
    extra = F.concat(F.lit("a record has cells beyond the named ones: "), F.col("_last").cast("string"))
    first = columns[0]
    return wide.withColumn(first, F.when(F.col("_last") >= len(columns), F.raise_error(extra)).otherwise(F.col(first))).drop("_last")


# Cells of one totals record and one strikes record, in page order.
TOTALS_CELLS = ["FIGHTER", "KD", "SIG.STR.", "SIG.STR. %", "TOTAL STR.", "TD", "TD %", "SUB.ATT", "REV.", "CTRL"]
STRIKE_CELLS = ["FIGHTER", "SIG.STR.", "SIG.STR. %", "HEAD", "BODY", "LEG", "DISTANCE", "CLINCH", "GROUND"]


def round_stats(records: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per-round table from record groups: summary totals, totals per round, summary strikes, strikes per round."""
    per_side = records.groupBy(*key, "side").agg((F.max("record") + 1).alias("_n"))
    r = records.join(per_side, [*key, "side"])
    half = F.floor(F.col("_n") / 2)
    totals = pivot_records(r.where((F.col("record") >= 1) & (F.col("record") < half)), key, TOTALS_CELLS)
    strikes = pivot_records(
        r.where(F.col("record") > half).withColumn("record", (F.col("record") - half).cast("int")), key, STRIKE_CELLS
    ).drop("FIGHTER", "SIG.STR.", "SIG.STR. %", "name")
    out = totals.join(strikes, [*key, "side", "record"], "left")
    return out.withColumn("ROUND", F.concat(F.lit("Round "), F.col("record"))).drop("record", "side", "name")


def irregular_items(pages: DataFrame, schema: str, parse, key: Sequence[str], html: str = "html") -> DataFrame:
    """Pages no pattern covers: ``parse(key values..., html)`` yields tuples, batch by batch."""
    def run(batches):
        import pandas as pd

        names = [part.split()[0] for part in schema.split(",")]
        for pdf in batches:
            rows = [row for rec in pdf.itertuples(index=False) for row in parse(*rec)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(*key, html).mapInPandas(run, schema)
