"""The macro calendar as YAML files, kept by hand: a mapping whose ``events`` are a list of date, kind and description.

What such calendars use of YAML is read with expressions: comments, blank lines, a block list of block mappings, plain,
single-quoted and double-quoted scalars, and ``[]`` for no entries.  Anything else names its file and entry in a
ValueError, so no entry is lost in silence.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluence.sources.federation import MACRO_KINDS

EVENTS = "date date, kind string, description string"
# The parts of the subset, as patterns.
SECTION = r"(?ms)^events[ ]*:[ ]*(?:#[^\n]*)?$\n?(.*?)(?=^[^\s#-]|\z)"
INLINE = r"(?m)^events[ ]*:[ ]*(?!\[[ ]*\][ ]*(?:#[^\n]*)?$|~[ ]*$|null[ ]*$)([^\s#][^\n]*)$"
ITEM = r"(?m)^[ ]*-(?:[ ]+|$)"
NO_LINE = r"^\s*(?:#.*)?$"
FIELD = r"^[ ]*([A-Za-z_]+)[ ]*:(?:[ ]+(.*))?$"
DOUBLE, SINGLE = r'^"((?:[^"\\]|\\["\\/])*)"[ ]*(?:#.*)?$', r"^'((?:[^']|'')*)'[ ]*(?:#.*)?$"
# A plain scalar begins with no sign that means something else and holds neither ': ' nor a comment.
PLAIN = r"^(?:(?![&*!|>%@`\[\]{}\"'#,?-])(?:(?!:[ ]|:$|[ ]#).)*)(?:[ ]+#.*)?$"


def scalar(text: Column) -> Column:
    """The value of a scalar; null where it is none of the subset."""
    text = F.trim(text)
    double = F.regexp_replace(F.regexp_extract(text, DOUBLE, 1), r'\\(["\\/])', "$1")
    single = F.replace(F.regexp_extract(text, SINGLE, 1), F.lit("''"), F.lit("'"))
    plain = F.trim(F.regexp_replace(text, r"(?:^|[ ]+)#.*$", ""))
    return F.when(text.rlike(DOUBLE), double).when(text.rlike(SINGLE), single).when(text.rlike(PLAIN), plain)


def parsed(texts: DataFrame, text: str = "value", name: str = "file") -> DataFrame:
    """(name, entry, date, kind, description, error) of the entries of calendars, numbered from 1; error is null for good ones."""
    value = F.regexp_replace(text, r"\r\n?", "\n")
    section = F.regexp_extract(value, SECTION, 1)
    # what stands before the first item can only be comments
    parts = F.split(section, ITEM)
    lead = F.exists(F.split(F.element_at(parts, 1), "\n"), lambda line: ~line.rlike(NO_LINE))
    odd = F.when(value.rlike(INLINE), "events is no list").when(value.rlike(r"\t"), "a tab").when(lead, "a line before the first entry")
    items = F.when(odd.isNotNull(), F.array(F.lit(""))).otherwise(F.slice(parts, 2, F.size(parts)))
    rows = texts.select(name, odd.alias("odd"), F.posexplode(items).alias("at", "item"))
    lines = F.filter(F.split("item", "\n"), lambda line: ~line.rlike(NO_LINE))
    field = lambda line: F.struct(F.regexp_extract(line, FIELD, 1).alias("key"), scalar(F.regexp_extract(line, FIELD, 2)).alias("value"))
    rows = rows.withColumn("lines", lines).withColumn("fields", F.transform("lines", field))
    get = lambda key: F.try_element_at(F.filter("fields", lambda f: f["key"] == key), F.lit(-1))["value"]
    date = F.when(get("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(get("date"), "yyyy-MM-dd"))
    error = (
        F.when(F.col("odd").isNotNull(), F.col("odd"))
        .when(F.exists("lines", lambda line: ~line.rlike(FIELD)), "a line that is no field")
        .when(F.exists("fields", lambda f: f["value"].isNull()), "a value that can't be read")
        .when(date.isNull(), F.concat(F.lit("bad date: "), F.coalesce(get("date"), F.lit("none"))))
        .when(~F.coalesce(get("kind").isin(*MACRO_KINDS), F.lit(False)), F.concat(F.lit("unknown kind: "), F.coalesce(get("kind"), F.lit("none"))))
    )
    return rows.select(name, (F.col("at") + 1).alias("entry"), date.alias("date"), get("kind").alias("kind"), F.coalesce(get("description"), F.lit("")).alias("description"), error.alias("error"))


def macro_yaml(spark: SparkSession, path: str) -> DataFrame:
    """date, kind, description of all calendars at ``path``; none where there is no file, or one without events.

    An entry without a date or of an unknown kind, and YAML beyond the subset, raise a ValueError that names file and entry.
    """
    try:
        texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], EVENTS)
        raise
    rows = parsed(texts)
    odd = rows.filter("error is not null").orderBy("file", "entry").first()
    if odd is not None:
        raise ValueError(f"{odd.file}, entry {odd.entry}: {odd.error}")
    return rows.select("date", "kind", "description")


def write_yaml(events: DataFrame, path: str) -> None:
    """A calendar file for each year of (date, kind, description)."""
    quoted = F.concat(F.lit('"'), F.regexp_replace("description", r'([\\"])', r"\\$1"), F.lit('"'))
    entry = F.concat(F.lit("  - date: "), F.col("date").cast("string"), F.lit("\n    kind: "), F.col("kind"), F.lit("\n    description: "), quoted)
    files = events.groupBy(F.year("date").alias("year")).agg(F.array_sort(F.collect_list(F.struct("date", "kind", entry.alias("entry")))).alias("own"))
    text = F.concat(F.lit("# by day\nevents:\n"), F.array_join(F.transform("own", lambda e: e["entry"]), "\n"))
    files.select("year", text.alias("value")).write.partitionBy("year").text(path)
