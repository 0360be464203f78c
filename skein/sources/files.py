"""Readers and writers of the corpus' file formats, all through Spark's own sources (any store that Spark reads)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import csv_field, pipe_field, tokens
from skein.operators.qc import as_flag

SEGMENTS = (
    "id string, book string, text string, wav string, start double, end double, dur double, score double, min_wscore double, n_weak int, char_rate double, "
    "has_digit boolean, n_words int, text_cyr string, text_lat string"
)
#: The same as text files hold it after types have drifted.
SEGMENTS_QC = SEGMENTS + ", reason string, keep string"
MANIFEST = "seg string, book string, chapter string, start_s double, end_s double, dur double, sim double, lufs_in double, transcript string"


def jsonl(spark: SparkSession, path: str, schema: str = SEGMENTS) -> DataFrame:
    """JSON lines under a path or glob; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def segments_qc(spark: SparkSession, path: str) -> DataFrame:
    """Segments after the gate; keep may be a boolean or the text True."""
    return jsonl(spark, path, SEGMENTS_QC).withColumn("keep", as_flag(F.col("keep")))


def metrics_as_segments(spark: SparkSession, path: str) -> DataFrame:
    """Metrics without a book, in the shape of segments."""
    rows = spark.read.schema("id string, text string, score double, min_wscore double, n_weak int, char_rate double, dur double, n_words int").json(path)
    return rows.withColumns({"book": F.lit(""), "text_cyr": F.lit("")})


def json_array(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """The rows of an array in a JSON document."""
    return spark.read.schema(f"{field} array<struct<{element}>>").option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def verdict_map(spark: SparkSession, path: str) -> DataFrame:
    """id, verdict, comment of a JSON document that maps ids to structs."""
    doc = spark.read.option("wholetext", True).text(path)
    kind = "map<string, struct<verdict: string, comment: string>>"
    return doc.select(F.explode(F.from_json("value", kind)).alias("id", "v")).select("id", "v.verdict", "v.comment")


def pipe_raw(spark: SparkSession, path: str) -> DataFrame:
    """id|text|text lines without quoting; a line without three parts is an error."""
    parts = F.split("value", r"\|", 3)
    lines = spark.read.text(path).filter("value != ''")
    ok = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not three parts: "), F.col("value"))).cast("array<string>"))
    return lines.select(ok.alias("p")).select(F.col("p")[0].alias("id"), F.col("p")[1].alias("text"), F.col("p")[2].alias("text2"))


def pipe_quoted(spark: SparkSession, path: str) -> DataFrame:
    """id|text|text lines with doubled quotes; rows need an id and a text."""
    rows = spark.read.schema("id string, text string, text2 string").options(sep="|", quote='"', escape='"', multiLine=True).csv(path)
    return rows.withColumns({c: F.trim(c) for c in rows.columns}).filter("id != '' and text is not null")


def csv_header(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).options(header=True, sep=sep, quote='"', escape='"', multiLine=True).csv(path)


def numeric_split(spark: SparkSession, path: str, schema: str, target: str) -> tuple[DataFrame, str]:
    """A numeric table and its target's name, which must be there."""
    rows = csv_header(spark, path, schema)
    if target not in rows.columns:
        raise ValueError(f"no column {target}")
    return rows, target


def utterances(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text; of .csv and .tsv files the last column of each row (a header is a row like others)."""
    sep = {"csv": ",", "tsv": "\t"}.get(path.lower().rsplit(".", 1)[-1])
    lines = spark.read.text(path).filter("trim(value) != ''")
    if sep is None:
        return lines.select(F.trim("value").alias("line"))
    width = lines.select(F.max(F.size(F.split("value", sep)))).first()[0] or 1
    rows = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).options(sep=sep, quote='"', escape='"', multiLine=True).csv(path)
    return rows.select(F.coalesce(*[F.col(f"c{i}") for i in reversed(range(width))]).alias("line")).filter("line is not null")


def splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The splits that exist, as one table with the split's name and its place in the order given."""
    got = []
    for i, (name, path) in enumerate(paths.items()):
        try:
            got.append(spark.read.parquet(path).withColumns({"split": F.lit(name), "split_pos": F.lit(i)}))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not got:
        raise ValueError("no split was found")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), got)


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path, length, name, parent of the files below a folder, hidden ones left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = files.withColumns({"name": name, "parent": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)}).filter(~F.startswith("name", F.lit(".")))
    return out.filter(reduce(lambda a, b: a | b, [F.endswith(F.lower("name"), F.lit(s)) for s in suffixes])) if suffixes else out


def library(spark: SparkSession, path: str, suffixes: tuple[str, ...], skip: tuple[str, ...] = ()) -> DataFrame:
    """Books of a folder: path, name, tokens of the name; whole top folders may be left out."""
    files = listing(spark, path, suffixes)
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    top = F.regexp_extract("path", path.rstrip("/").rsplit("/", 1)[-1] + r"/([^/]+)/", 1)
    return files.filter(~top.isin(*skip) if skip else F.lit(True)).select("path", "name", tokens(stem).alias("tokens"))


def labelled_files(spark: SparkSession, path: str) -> DataFrame:
    """path, label of files in folders named by label."""
    return listing(spark, path).select("path", F.col("parent").alias("label"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def run_states(spark: SparkSession, glob: str) -> DataFrame:
    """exp_id, state of runs from their status files."""
    rows = spark.read.option("wholetext", True).text(glob)
    return rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("exp_id"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("state"))


def log_tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n of numbered lines, in order."""
    return lines.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def parts_list(lines: DataFrame) -> DataFrame:
    """Names in lines like file 'name'."""
    return lines.select(F.regexp_extract("value", r"^file '(.*)'", 1).alias("file")).filter("file != ''")


def markdown_fields(lines: DataFrame) -> DataFrame:
    """key, value of lines like - key: `value`."""
    got = lines.select(F.regexp_extract("value", r"^- (\w+): `([^`]*)`", 1).alias("key"), F.regexp_extract("value", r"^- (\w+): `([^`]*)`", 2).alias("v"))
    return got.filter("key != ''").select("key", F.col("v").alias("value"))


def memory_line(c: Column) -> Column:
    """used and free of a tool's line `used, free`; nulls if it is none."""
    p = F.split(c, ",")
    n = lambda i: F.trim(F.get(p, F.lit(i))).try_cast("int")
    return F.when(n(0).isNotNull() & n(1).isNotNull(), F.struct(n(0).alias("used_mb"), n(1).alias("free_mb")))


def status_progress(doc: Column) -> Column:
    """A field of the first running job in a status document, 0 if there is none."""
    return F.coalesce(F.get_json_object(doc, "$.running[0].progress.epoch").try_cast("int"), F.lit(0))


def query(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """A statement over named tables with named parameters."""
    return spark.sql(sql, args=args or {}, **tables)


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document with stale = false, or one row of nulls with stale = true if it cannot be read."""
    kind = T.DataType.fromDDL(schema)
    try:
        got = spark.read.schema(kind).option("multiLine", True).json(path)
        got.limit(1).count()
        return got.withColumn("stale", F.lit(False))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([(None,) * len(kind)], kind).withColumn("stale", F.lit(True))


# sinks


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; columns that begin with _ stay out."""
    df.drop(*[c for c in df.columns if c.startswith("_")]).write.mode(mode).json(path)


def pipe_line(*fields: Column) -> Column:
    """A line of the sanitising dialect: no pipes in fields, white space collapsed, no quotes."""
    return F.concat_ws("|", *[pipe_field(F.coalesce(f, F.lit(""))) for f in fields])


def quoted_line(*fields: Column) -> Column:
    """A line of the quoting dialect."""
    return F.concat_ws("|", *[csv_field(F.coalesce(f, F.lit(""))) for f in fields])


def write_metadata(df: DataFrame, path: str, key: str = "id", text: str = "text", quoted: bool = False) -> None:
    line = quoted_line if quoted else pipe_line
    df.select(line(F.col(key), F.col(text), F.col(text)).alias("value")).write.text(path)


def write_groups(df: DataFrame, path: str, *by: str) -> None:
    """One folder for each group (and variant); rows of a group are dealt over tasks, not gathered."""
    df.write.partitionBy(*by).parquet(path)


def write_audiofolder(df: DataFrame, path: str) -> None:
    """file_name, transcription with a header, a folder for each split."""
    df.select(F.concat("id", F.lit(".wav")).alias("file_name"), F.col("text").alias("transcription"), "split").write.partitionBy("split").options(header=True, escape='"').csv(path)


def result_document(counts: DataFrame, **lists: DataFrame) -> DataFrame:
    """One row: the counts, and each report's rows as an array (reports, so small by what they are)."""
    out = counts
    for name, rows in lists.items():
        out = out.crossJoin(rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name)))
    return out


def markdown_table(df: DataFrame, title: str, most: int = 40) -> str:
    """A report's first rows as a Markdown table."""
    from skein.functions.text import cell

    rows = df.limit(most).select(*[cell(F.col(c).cast("string")).alias(c) for c in df.columns]).collect()
    head = f"## {title}\n\n| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(r) + " |" for r in rows)]) + "\n"


def staging_plan(df: DataFrame) -> DataFrame:
    """What a staging run would do, as rows: folder, action, note."""
    action = F.when(F.col("kind") == "skip", "skip").when(F.col("parts") > 1, "concat").otherwise("link")
    return df.select("folder", action.alias("action"), "note")


