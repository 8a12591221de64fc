"""File sources and sinks for trial, judgement and draw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from latencylab.operators.sizing import broadcast_checked, cut_lineage
from latencylab.sources import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """The columns of a schema by name, typed; further columns of the file are ignored, missing ones are named.

    All files of a CSV folder must have the same header: the names are read once and every file is checked.
    """
    if fmt == "csv":
        reader = spark.read.option("header", True).option("nullValue", "NA")
        header = T.StructType([T.StructField(c, T.StringType()) for c in reader.csv(path).columns])
        found = reader.schema(header).option("enforceSchema", False).csv(path)
    else:
        found = spark.read.format(fmt).load(path)
    if missing := [f.name for f in schema.fields if f.name not in found.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(found.columns)}")
    return found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


MOST_COLUMNS = 64  # columns of a file that are looked at
_WIDTHS = (8, 16, 32, MOST_COLUMNS)  # schemas for records with quotes; the reader is slow on each column a record lacks


def _tokens(line: str) -> str:
    """SQL for the values of a CSV record, as the CSV reader gives them; empty values and ``NA`` are null.

    A record without quotes is cut at its commas: no error is raised and caught for the columns it lacks.
    """

    def parsed(width):
        names = [f"_c{i}" for i in range(width)]
        record = f"from_csv({line}, '{', '.join(f'{n} string' for n in names)}', map('nullValue', 'NA'))"
        # through a lambda, so that a record is parsed once and not once a column
        return f"transform(array({record}), r -> array({', '.join(f'r.{n}' for n in names)}))[0]"

    commas = f"length({line}) - length(replace({line}, ',', ''))"
    quoted = " ".join(f"when {commas} < {w} then {parsed(w)}" for w in _WIDTHS[:-1])
    plain = f"transform(slice(split({line}, ',', {MOST_COLUMNS + 1}), 1, {MOST_COLUMNS}), t -> if(t in ('', 'NA'), null, t))"
    return f"case when not contains({line}, '\"') then {plain} {quoted} else {parsed(MOST_COLUMNS)} end"


def read_folder(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """CSV files with headers of their own: the rows that fit a schema, and the values that don't.

    Columns are found by name, file by file, so files may differ in order and in further columns; a header repeated
    inside a file is no row.  The first table has the rows all of whose values can be read; the second, ``file,
    record, column, raw``, has each value that can't, with the whole record.  Records of a file without a header that
    names all columns are rejected with an empty column.  Nothing raises and no record is in neither table; empty values and
    ``NA`` are null, and so are values that a short record lacks.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.expr("make_valid_utf8(value)").alias("line"))
    raw = raw.where(r"line rlike r'[^\x00-\x20]'")  # the CSV reader passes over blank lines too
    wanted = F.array(*[F.lit(f.name) for f in schema.fields])
    # a name without quotes and escapes stands as it is in a header: few other lines are parsed to see if they are one
    as_is = [f.name for f in schema.fields if not set(f.name) & set('"\\')]
    is_header = F.lit(True)
    for name in as_is:
        is_header &= F.contains("line", F.lit(name))
    is_header &= F.size(F.array_except(wanted, F.expr(_tokens("line")))) == 0
    headers = raw.where(is_header).groupBy("file").agg(F.first(F.expr(_tokens("line"))).alias("names"))
    places = [f"cast(array_position(names, '{f.name}') as int) as at_{f.name}" for f in schema.fields]
    headers = headers.selectExpr("file", "array_size(array_compact(names)) as named", *places)
    rows = raw.where(~is_header).join(broadcast_checked(headers), "file", "left")
    # out of a generator, since a filter on values would else be moved before the parsing and parse again for each
    rows = rows.select("*", F.explode(F.array(F.expr(_tokens("line")))).alias("v"))
    rows = rows.withColumns({f"raw_{f.name}": F.expr(f"get(v, at_{f.name} - 1)") for f in schema.fields})
    rows = rows.withColumns({f"val_{f.name}": F.expr(f"try_cast(raw_{f.name} as {f.dataType.simpleString()})") for f in schema.fields})
    wrong = {f.name: f"(raw_{f.name} is not null and val_{f.name} is null)" for f in schema.fields}
    unfit = F.expr(f"named is null or {' or '.join(wrong.values())}")
    accepted = rows.where(~unfit).select(*[F.col(f"val_{f.name}").alias(f.name) for f in schema.fields])
    bad = ", ".join(f"if({w}, struct('{name}' as column, raw_{name} as raw), null)" for name, w in wrong.items())
    bad = F.expr(f"if(named is null, array(struct('' as column, cast(null as string) as raw)), array_compact(array({bad})))")
    padded = f"concat(v, array_repeat(cast(null as string), {MOST_COLUMNS} - size(v)))"
    record = F.array_join(F.expr(f"slice({padded}, 1, greatest(array_size(array_compact(v)), coalesce(named, 0)))"), ",", "NA")
    rejected = rows.where(unfit).select("file", record.alias("record"), F.explode(bad).alias("b")).select("file", "record", "b.column", "b.raw")
    return accepted, rejected


def attach_key(df: DataFrame, name: str = "draw") -> DataFrame:
    """Number the rows from 0 in the order of all their columns.

    Rows are range-partitioned and numbered by place in the partition plus the sizes of those before, so only
    the sizes are ordered as a whole.  Partitions are stored first, since the range borders are sampled.
    """
    ordered = df.repartitionByRange(*[F.col(f"`{c}`") for c in df.columns])
    held = cut_lineage(ordered.withColumn("_part", F.spark_partition_id()))
    before = "over (order by _part rows between unbounded preceding and 1 preceding)"
    skips = held.groupBy("_part").count().selectExpr("_part", f"coalesce(sum(count) {before}, 0L) as _skip")
    order = ", ".join(f"`{c}`" for c in df.columns)
    numbered = held.selectExpr("*", f"row_number() over (partition by _part order by {order}) - 1 as _place")
    numbered = numbered.join(broadcast_checked(skips), "_part")
    return numbered.selectExpr(f"_skip + _place as `{name}`", *[f"`{c}`" for c in df.columns])


def read_trials(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.TRIALS, fmt)


def read_judgements(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.JUDGEMENTS, fmt)


def read_draws(spark: SparkSession, path: str, parameters: list[str], fmt: str = "csv", keyed: bool = True) -> DataFrame:
    """Draws of some parameters; a file without a draw key (``keyed=False``) gets one by the order of its values."""
    found = read_table(spark, path, schemas.wide_draws(parameters, keyed=keyed), fmt)
    return found if keyed else attach_key(found)


def read_derived(spark: SparkSession, path: str, name: str, fmt: str = "csv") -> DataFrame:
    """One of the stored result tables named in ``schemas.DERIVED``."""
    return read_table(spark, path, schemas.DERIVED[name], fmt)


def tag_cohort(df: DataFrame, cohort: str) -> DataFrame:
    return df.withColumn("group", F.lit(cohort))


def read_cohorts(spark: SparkSession, paths: dict[str, str], fmt: str = "csv") -> DataFrame:
    """Read one trial file per cohort, tag each and stack them by column name."""
    frames = [tag_cohort(read_trials(spark, p, fmt), g) for g, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite"
) -> None:
    """Write a result; one file set per partition value, never a single driver-side file."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    writer.format(fmt).save(path)
