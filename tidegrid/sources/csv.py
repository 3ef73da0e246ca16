"""CSV scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.columns import RAW_HEADER, raw_type


#: Up to so many files that are no UTF-8 are named in the plan; beyond, the files' encodings are joined.
NAMED_FILES = 1_000
_BOM = "\ufeff"


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first file, whatever its encoding."""
    names = spark.read.options(header=True, encoding="ISO-8859-1").csv(path).columns
    try:
        names = [n.encode("latin-1").decode() for n in names]
    except UnicodeError:
        pass
    return [n.removeprefix(_BOM) for n in names]


def _decoded(lines: DataFrame) -> DataFrame:
    """``line`` in the encoding of its file: UTF-8, or latin-1 where any line of the file is not UTF-8."""
    kept = lines.withColumn("_file", F.col("_metadata.file_path"))
    odd = kept.where("NOT is_valid_utf8(value)").select("_file").distinct()
    files = [r[0] for r in odd.limit(NAMED_FILES + 1).collect()]
    if not files:
        return kept.withColumnRenamed("value", "line").drop("_file")
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    if len(files) <= NAMED_FILES:
        line = F.when(F.col("_file").isin(files), latin).otherwise(F.col("value"))
        return kept.withColumn("line", line).drop("_file", "value")
    marked = kept.join(odd.withColumn("_odd", F.lit(True)), "_file", "left")
    return marked.withColumn("line", F.when(F.col("_odd"), latin).otherwise(F.col("value"))).drop("_file", "_odd", "value")


def read_raw_csv(
    spark: SparkSession, path: str, extra: dict[str, str] | None = None, unparsed: str | None = None
) -> DataFrame:
    """The raw hourly table under our names, with ``date`` parsed.

    Known headers get their type; ``extra`` types further columns such as the series
    key, anything else stays text. The files of ``path`` share a header; each is read as
    UTF-8 or latin-1 for itself. A value that does not parse is NULL and leaves the rest
    of its line alone; ``unparsed`` names a column that holds the line in that case.
    Quoted values may not hold line breaks.
    """
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    names = [n for n in _header(spark, path) if n not in folders]
    fields = [f"c{i}" for i in range(len(names))]
    parsed = F.from_csv("line", ", ".join(f"{f} string" for f in fields), {"mode": "PERMISSIVE"})
    rows = _decoded(lines).where("length(trim(line)) > 0").select(*folders, "line", parsed.alias("_row"))
    # a first line that is the header again, in each file
    title = F.lit(True)
    for name, field in zip(names, fields):
        found = F.col(f"_row.{field}")
        title &= F.when(F.lit(field == "c0"), F.ltrim(found, F.lit(_BOM))).otherwise(found).eqNullSafe(F.lit(name))
    rows = rows.where(~title)
    values, bad = [], F.lit(False)
    for name, field in zip(names, fields):
        ours = RAW_HEADER.get(name, name)
        kind = raw_type(ours) if name in RAW_HEADER else (extra or {}).get(name, "string")
        text = F.col(f"_row.{field}")
        value = F.try_to_date(text, "dd/MM/yyyy") if ours == "date" else text.try_cast(kind)
        bad |= text.isNotNull() & value.isNull()
        values.append(value.alias(ours))
    line = [F.when(bad, F.col("line")).alias(unparsed)] if unparsed else []
    return rows.select(*values, *folders, *line)


def read_hourly_csv(spark: SparkSession, path: str, extra: dict[str, str] | None = None) -> DataFrame:
    """The raw table with ``ts`` from date and hour, ready for ``plans.features.model_table``."""
    time = "make_timestamp_ntz(year(date), month(date), day(date), CAST(hour AS INT), 0, 0)"
    return read_raw_csv(spark, path, extra).withColumn("ts", F.expr(time))


def read_typed_csv(spark: SparkSession, path: str, schema: str, date: str | None = None) -> DataFrame:
    """A CSV with a declared schema; ``date`` names a text column to cast to date."""
    df = spark.read.options(header=True).schema(schema).csv(path)
    return df.withColumn(date, F.to_date(date)) if date else df


def read_feature_pair(
    spark: SparkSession, train_path: str, test_path: str, schema: str
) -> tuple[DataFrame, DataFrame]:
    """The two engineered files; ``True``/``False`` columns come back as 0/1."""

    def one(path: str) -> DataFrame:
        df = spark.read.options(header=True).schema(schema).csv(path)
        booleans = {f.name: F.col(f.name).cast("int") for f in df.schema.fields if f.dataType.typeName() == "boolean"}
        df = df.withColumns(booleans) if booleans else df
        return df.withColumnsRenamed({t: o for t, o in RAW_HEADER.items() if t in df.columns})

    return one(train_path), one(test_path)
