"""Text sources: documents as lines, dumps, directory listings, table profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.scalars import SUPERSCRIPTS


def digits_of_superscripts(text: Column) -> Column:
    """Most texts have none, which one pattern tells; searches of the whole text do the rest, since translate would make a value of every character."""
    plain = text
    for old, new in zip(*SUPERSCRIPTS):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.when(text.rlike("[\u2070-\u2079\u00b2\u00b3\u00b9]"), plain).otherwise(text)


def manuscript_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): trimmed lines, superscript digits as digits, numbered from 1."""
    text = digits_of_superscripts(F.col(text_col))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(F.split(text, "\n")).alias("pos", "line"))
    # An outer one, without the texts that are null: else the text would be cut for a filter on the number of its lines too.
    return lines.filter("pos IS NOT NULL").select("doc_id", (F.col("pos") + 1).alias("line_no"), F.trim("line").alias("line"))


# Tables of the dump and the number of columns that a row must have.
DUMP_TABLES = {"journals": 5, "nomera": 4, "razdel_numbers": 4, "articles": 12}
#: Possessive throughout: Java's backtracking would need stack for every character of a long value.
_QUOTED = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_TUPLE = rf"\(((?:{_QUOTED}|\([^()']*+\)|[^()']++)*+)\)"
_VALUE = rf"{_QUOTED}|[^,'\s](?:\([^()']*+\)|[^,'(])*+"


def sql_dump_ingest(lines: DataFrame, column: str = "value") -> DataFrame:
    """(table, cols) of the INSERT lines of a dump: quoted values unescaped, NULL as null; rows too short for their table are dropped.

    One line may hold any number of tuples; each line is read where it lies.
    """
    inserts = lines.filter(F.col(column).startswith("INSERT INTO"))
    table = F.regexp_extract(column, r"^INSERT INTO `?([A-Za-z_]+)`?", 1)
    rows = inserts.select(table.alias("table"), F.explode(F.regexp_extract_all(F.regexp_replace(column, r"^INSERT INTO `?[A-Za-z_]+`?\s*(\([^)]*\)\s*)?VALUES\s*", ""), F.lit(_TUPLE), F.lit(1))).alias("tuple"))
    raw = F.regexp_extract_all("tuple", F.lit(_VALUE), F.lit(0))

    def plain(x):
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        unescaped = F.replace(F.replace(F.replace(F.replace(F.replace(inner, F.lit("\\\\"), F.lit("\0")), F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))
        return F.when(F.startswith(x, F.lit("'")), unescaped).when(F.upper(F.trim(x)) == "NULL", F.lit(None)).otherwise(F.trim(x))

    least = F.create_map(*[F.lit(y) for pair in DUMP_TABLES.items() for y in pair])
    return rows.select("table", F.transform(raw, plain).alias("cols")).filter(F.size("cols") >= F.coalesce(least[F.col("table")], F.lit(1 << 30)))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def listing_parse(lines: DataFrame, today: str, column: str = "line") -> DataFrame:
    """(name, is_dir, size, mtime) of directory listings in unix or DOS form; other lines are dropped.

    Lines are read as fields between blanks. Without a year the date is the last one not after today; two-digit years from 70 on are of
    the last century; DOS times have 24 hours or AM / PM. Of links the name without the target is given.
    """
    number = lambda c: c.try_cast("int")
    matches = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False))
    u, d = F.split(F.ltrim(column), r"\s+", 9), F.split(F.ltrim(column), r"\s+", 4)
    # mode, links, owner, group, size, month, day, year or time, name
    mode, size, day, when = (F.get(u, F.lit(i)) for i in (0, 4, 6, 7))
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.get(u, F.lit(5)))), F.lit(0)).cast("int")
    unix = (F.size(u) == 9) & matches(mode, "^[-bcdlps][-rwxsStT]{9}[.+@]?$") & month.isNotNull() & matches(size, "^[0-9]+$") & matches(day, "^[0-9]{1,2}$") & matches(when, "^([0-9]{4}|[0-9]{1,2}:[0-9]{2})$")
    year_now, no_year, clock = F.year(F.lit(today).cast("date")), F.contains(when, F.lit(":")), F.split(when, ":")
    this = F.try_to_date(F.concat_ws("-", year_now.cast("string"), month.cast("string"), day), "y-M-d")
    u_year = F.when(~no_year, number(when)).when(this > F.lit(today).cast("date"), year_now - 1).otherwise(year_now)
    u_time = F.try_make_timestamp_ntz(u_year, month, number(day), F.when(no_year, number(clock[0])).otherwise(0), F.when(no_year, number(F.get(clock, F.lit(1)))).otherwise(0), F.lit(0))
    # month-day-year, time, <DIR> or size, name
    date, time, what = F.split(d[0], "-"), F.get(d, F.lit(1)), F.get(d, F.lit(2))
    dos = (F.size(d) == 4) & matches(d[0], "^[0-9]{2}-[0-9]{2}-[0-9]{2}([0-9]{2})?$") & matches(time, "^(?i)[0-9]{2}:[0-9]{2}([ap]m)?$") & matches(what, "^(?i)(<DIR>|[0-9]+)$")
    raw_year = number(F.get(date, F.lit(2)))
    d_year = F.when(raw_year >= 100, raw_year).when(raw_year >= 70, raw_year + 1900).otherwise(raw_year + 2000)
    hour, half = number(F.left(time, F.lit(2))), F.lower(F.substring(time, 6, 2))
    d_time = F.try_make_timestamp_ntz(d_year, number(date[0]), number(F.get(date, F.lit(1))), F.when(half == "", hour).otherwise(F.pmod(hour, F.lit(12)) + F.when(half == "pm", 12).otherwise(0)), number(F.substring(time, 4, 2)), F.lit(0))
    name = F.get(u, F.lit(8))
    name = F.when(F.startswith(mode, F.lit("l")), F.substring_index(name, " -> ", 1)).otherwise(name)
    return lines.filter(unix | dos).select(
        F.when(unix, name).otherwise(F.get(d, F.lit(3))).alias("name"), F.when(unix, F.startswith(mode, F.lit("d"))).otherwise(F.lower(what) == "<dir>").alias("is_dir"),
        F.when(unix, size.try_cast("bigint")).otherwise(F.coalesce(what.try_cast("bigint"), F.lit(0))).alias("size"), F.when(unix, u_time).otherwise(d_time).alias("mtime"),
    )


def table_profile(tables: dict[str, DataFrame], sample: int = 3) -> DataFrame:
    """(table, n_rows, sample): row counts and the first rows as JSON."""
    parts = []
    for name, df in tables.items():
        counted = df.agg(F.count("*").alias("n_rows"))
        few = df.limit(sample).agg(F.collect_list(F.to_json(F.struct("*"))).alias("sample"))
        parts.append(counted.crossJoin(few).select(F.lit(name).alias("table"), "n_rows", "sample"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
