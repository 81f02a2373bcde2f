"""Weights and constituents out of factsheet texts, as column functions: one row for each document, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sector names in full and in short, words that are no part of a name, labels that are no country.
SECTORS = ("Information Technology", "Financials", "Industrials", "Consumer Discretionary", "Health Care", "Communication Services", "Consumer Staples", "Materials", "Energy", "Utilities", "Real Estate")
SECTORS_SHORT = ("Info Tech", "Industrials", "Health Care", "Financials", "Cons Discr", "Comm Srvcs", "Cons Staples", "Materials", "Energy", "Utilities", "Real Estate")
NOISE = ("Constituents", "Number", "of", "Weight", "Largest", "Smallest", "Average", "Median", "Cap", "Float", "Adj", "Mkt", "Millions", "Billions", "USD", "Index")
NO_LABEL, NO_LABEL_PART = ("Since", "Dec"), ("WEIGHT", "SECTOR", "COUNTRY")
_TOTALS = ("TOTAL", "NUMBER OF", "")

#: Fixed values too: expressions of the sheets' layouts, which decide what text counts: "label nn.n%", and "name CC mktcap weight sector".
PAIR = r"([A-Za-z][A-Za-z\.\&\-\s]+?)\s+(\d{1,2}(?:\.\d{1,2})?)%"
LEADING = r"^(?:(?:" + "|".join(NOISE) + r"|[\d,]+\.?\d*) )+"
_WITH_COUNTRY = r"^(.+?)\s+([A-Z]{2})\s+([\d,]+\.\d+)\s+(\d+\.\d+)\s+([A-Za-z].+)$"


def clean_name(name: Column) -> Column:
    """A name without the statistics' words and numbers before it; the last word always stays."""
    return F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), LEADING, "")


def extract_weight_pairs(texts: DataFrame, sectors: tuple[str, ...] = SECTORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kind (sector or country), label, weight_pct: the pairs "label nn.n%" after "SECTOR WEIGHTS", or of the whole text where that is missing.

    Null and empty texts and texts without a pair give no rows.
    """
    at = F.instr(F.col(text_col), "SECTOR WEIGHTS")
    block = F.when(at > 0, F.substring(F.col(text_col), at, F.length(text_col))).otherwise(F.col(text_col))
    found = F.arrays_zip(F.regexp_extract_all(block, F.lit(PAIR), 1).alias("label"), F.regexp_extract_all(block, F.lit(PAIR), 2).alias("pct"))
    rows = texts.select(F.col(id_col), F.explode(found).alias("p")).select(id_col, F.trim(F.regexp_replace("p.label", r"^\s+|\s+$", "")).alias("label"), F.col("p.pct").cast("double").alias("weight_pct"))
    noise = F.col("label").isin(*NO_LABEL) | F.upper("label").rlike("|".join(NO_LABEL_PART))
    kind = F.when(F.col("label").isin(*sectors), "sector").when(F.length("label") >= 2, "country")
    return rows.filter(~noise).withColumn("kind", kind).filter("kind IS NOT NULL").select(id_col, "kind", "label", "weight_pct")


def _amount(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").cast("double")


def extract_constituents(texts: DataFrame, sectors: tuple[str, ...] = SECTORS_SHORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, place, name, country, mktcap, weight_pct, sector of the constituents that a page lists in one of three layouts.

    Lines "name CC mktcap weight sector" count first, all of them. Without any, pages of one country are read as "name weight
    weight sector" and as "name mktcap weight sector", each name once and ten at most; the reading with more rows counts,
    the first on a tie. Null and empty texts give no rows.
    """
    short = "|".join(sectors)
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = lambda line, i: F.regexp_extract(line, _WITH_COUNTRY, i)
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x.rlike(_WITH_COUNTRY))
    row = lambda name, country, cap, weight, sector: F.struct(name.alias("name"), country.alias("country"), cap.alias("mktcap"), weight.alias("weight_pct"), sector.alias("sector"))
    first = F.filter(
        F.transform(lines, lambda x: row(clean_name(part(x, 1)), part(x, 2), _amount(part(x, 3)), _amount(part(x, 4)), F.trim(part(x, 5)))), lambda r: ~F.upper(r["name"]).isin(*_TOTALS)
    )

    def listed(number: str, with_cap: bool) -> Column:
        pattern = F.lit(rf"([A-Z][A-Za-z&\.\-' ]+?)\s+({number})\s+(\d+\.\d+)\s+({short})")
        a, b, c, d = (F.regexp_extract_all(text, pattern, i) for i in (1, 2, 3, 4))
        rows = F.transform(
            F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")),
            lambda x: row(clean_name(x["a"]), F.lit("US"), _amount(x["b"]) if with_cap else F.lit(None).cast("double"), _amount(x["c"] if with_cap else x["b"]), x["d"]),
        )
        names = F.transform(rows, lambda r: r["name"])
        once = F.filter(rows, lambda r, i: (r["name"] != "") & (F.array_position(names, r["name"]) == i + 1))
        return F.slice(once, 1, 10)

    second, third = listed(r"\d+\.\d+", False), listed(r"[\d,]+\.\d+", True)
    chosen = texts.select(F.col(id_col), first.alias("f"), second.alias("s"), third.alias("t")).select(
        id_col, F.posexplode(F.when(F.size("f") > 0, F.col("f")).when(F.size("s") >= F.size("t"), F.col("s")).otherwise(F.col("t"))).alias("place", "r")
    )
    return chosen.select(id_col, (F.col("place") + 1).alias("place"), "r.*")
