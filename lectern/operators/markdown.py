"""Tables inside Markdown texts: rows out of them, and cells put back without touching anything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell

#: The line under a table's header.
RULE = r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"
#: A pipe that is not escaped.
PIPE = r"(?<!\\)\|"


def plain(x: Column) -> Column:
    """The text of a cell: no blanks or backticks around it, pipes unescaped."""
    return F.replace(F.regexp_replace(x, r"^[\s`]+|[\s`]+$", ""), F.lit("\\|"), F.lit("|"))


def table_lines(docs: DataFrame) -> DataFrame:
    """(id, line, text, header, cells) of every line of docs(id, text).

    header holds the lowered names of the table that a row belongs to, cells its raw pieces between pipes (the first and the
    last are what stands before the first pipe and after the last); both are null for lines that are no rows of a table.  A table is a header line, a rule
    line and the lines with a leading pipe after it.
    """
    each = docs.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    w = Window.partitionBy("id").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    piped = F.ltrim("text").startswith("|")
    cells = F.split("text", PIPE)
    names = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0))), lambda c: F.lower(plain(c)))
    marked = each.withColumns({"_p": piped, "_h": piped & F.coalesce(F.lead("text").over(w).rlike(RULE), F.lit(False)), "_n": names})
    at = marked.withColumns({"_gap": F.coalesce(F.max(F.when(~F.col("_p"), F.col("line"))).over(upto), F.lit(-1)), "_head": F.max(F.when(F.col("_h"), F.struct("line", "_n"))).over(upto)})
    row = F.col("_p") & F.col("_head").isNotNull() & (F.col("_head.line") > F.col("_gap")) & (F.col("line") > F.col("_head.line") + 1)
    return at.select("id", "line", "text", F.when(row, F.col("_head._n")).alias("header"), F.when(row, cells).alias("cells"))


def table_rows(docs: DataFrame) -> DataFrame:
    """(id, line, column, value): the cells of all tables in docs(id, text), as plain texts."""
    rows = table_lines(docs).where("header is not null")
    pairs = F.zip_with("header", F.slice("cells", 2, F.least(F.size("header"), F.greatest(F.size("cells") - 2, F.lit(0)))), lambda h, c: F.struct(h.alias("column"), plain(c).alias("value")))
    return rows.select("id", "line", F.explode(pairs).alias("x")).select("id", "line", "x.*").where("value is not null")


def patch_tables(docs: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """docs(id, text) with cells replaced, and `patched`, the number of cells that changed.

    patches(row_key, column, value[, id]): the cell of `column` in the rows whose key cell (the first of the columns
    `keys` that a table has) is row_key, in all texts or in text `id` alone.  Values are escaped; a null is an empty
    cell; of several patches of one cell the largest value counts.  Every other cell and every other line stays byte for byte; texts without a table
    that is patched pass through.
    """
    own = ["id"] if "id" in patches.columns else []
    lines = table_lines(docs)
    key = F.coalesce(*[F.when(F.array_contains("header", k), plain(F.get("cells", F.array_position("header", k).cast("int")))) for k in keys])
    rows = lines.where("header is not null").withColumn("row_key", key).where("row_key is not null")
    each = patches.groupBy(*own, "row_key", F.lower("column").alias("column")).agg(F.max(F.coalesce("value", F.lit(""))).alias("value"))
    per_row = each.groupBy(*own, "row_key").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("new"))
    met = rows.join(per_row, [*own, "row_key"])

    def put(c: Column, i: Column) -> Column:
        name = F.get("header", i - 1)
        value = F.try_element_at("new", name)
        inside = (i > 0) & (i < F.size("cells") - 1)
        return F.when(inside & name.isNotNull() & value.isNotNull() & (value != plain(c)), F.concat(F.lit(" "), cell(value), F.when(value == "", "").otherwise(" "))).otherwise(c)
    patched = met.withColumn("put", F.transform("cells", put)).select("id", "line", F.array_join("put", "|").alias("put"), F.size(F.filter(F.zip_with("cells", "put", lambda a, b: a != b), lambda x: x)).alias("n")).where("n > 0")
    touched = patched.select("id").distinct()
    again = lines.join(touched, "id", "left_semi").select("id", "line", "text").join(patched, ["id", "line"], "left")
    whole = again.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", F.coalesce("put", "text").alias("t")))).alias("l"), F.sum(F.coalesce("n", F.lit(0))).alias("patched"))
    new = whole.select("id", F.array_join(F.transform("l", lambda r: r["t"]), "\n").alias("_new"), F.col("patched"))
    return docs.join(new, "id", "left").withColumns({"text": F.coalesce("_new", "text"), "patched": F.coalesce("patched", F.lit(0)).cast("long")}).drop("_new")
