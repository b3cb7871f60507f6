"""CSV/JSON in: cells are read as text and cast from the declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle import policy as P
from fettle.sources.schemas import TABLES, Table

# fixed values: accepted date layouts, each with the shape of the text it reads
DATE_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
)
TRUE_WORDS = ("true", "1", "yes")
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no")


def read_text_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every cell as text; only the empty string is missing."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, nullValue="", enforceSchema=False)


def parse_date(text: Column, formats: Sequence[tuple[str, str]] = DATE_FORMATS) -> Column:
    """First layout whose shape fits. The shape is tested first: a failed parse throws inside the JVM."""
    trimmed, parsed = F.trim(text), F.lit(None).cast("date")
    for layout, shape in reversed(formats):
        parsed = F.when(trimmed.rlike(shape), F.to_date(F.try_to_timestamp(trimmed, F.lit(layout)))).otherwise(parsed)
    return parsed


def parse_boolean(text: Column) -> Column:
    """Missing reads as false, as does any other word."""
    return F.coalesce(F.lower(F.trim(text)).isin(*TRUE_WORDS), F.lit(False))


def parse_number(text: Column) -> Column:
    """Double or NULL; NaN text is missing, never kept."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number), number)


def typed(text: Column, kind: str) -> Column:
    if kind == "date":
        return parse_date(text)
    if kind == "boolean":
        return parse_boolean(text)
    if kind == "float":
        return parse_number(text)
    if kind == "integer":
        number = parse_number(text)
        return F.when(number % 1 == 0, number.cast("long"))
    return text


def cast_table(text: DataFrame, table: Table) -> DataFrame:
    have = set(text.columns)
    return text.select(*[typed(F.col(c.name), c.kind).alias(c.name) for c in table.columns if c.name in have])


def read_table_csv(spark: SparkSession, path: str, table: Table) -> DataFrame:
    return cast_table(read_text_csv(spark, path, table.names), table)


def header_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, inferSchema=False).columns


class InvalidTables(ValueError):
    """Raised by a strict load; ``report`` holds the failing checks as rows."""

    def __init__(self, report: DataFrame):
        super().__init__("tables failed validation")
        self.report = report


def load_tables(spark: SparkSession, folder: str, names: Sequence[str], strict: bool = True,
                ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Typed tables plus one validation row per table."""
    from fettle.operators import quality

    texts = {n: read_text_csv(spark, f"{folder}/{n}.csv", header_of(spark, f"{folder}/{n}.csv")) for n in names}
    report = quality.table_reports(texts, {n: TABLES[n] for n in names})
    if strict and not report.filter(~F.col("is_valid")).isEmpty():
        raise InvalidTables(report.filter(~F.col("is_valid")))
    return {n: cast_table(texts[n], TABLES[n]) for n in names}, report


def load_uploaded(spark: SparkSession, path: str, table: Table) -> tuple[DataFrame, DataFrame]:
    """One uploaded table and its report, also when it is valid."""
    from fettle.operators import quality

    text = read_text_csv(spark, path, header_of(spark, path))
    return cast_table(text, table), quality.table_reports({table.name: text}, {table.name: table})


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels have their own reader so that no scoring plan can reach them."""
    return read_table_csv(spark, path, TABLES["ground_truth_labels"])


def drop_generation_only(frame: DataFrame) -> DataFrame:
    return frame.drop(*P.GENERATION_ONLY_COLUMNS)


def load_voice_index(spark: SparkSession, path: str) -> DataFrame:
    table = TABLES["voice_samples"]
    header = header_of(spark, path)
    return drop_generation_only(cast_table(read_text_csv(spark, path, header), table))


def usable_samples(index: DataFrame, waveform: str = "waveform", rate: int = P.SAMPLE_RATE) -> DataFrame:
    """Consent given and long enough; over-long recordings are cut at the limit."""
    least, most = int(P.MIN_AUDIO_SECONDS * rate), int(P.MAX_AUDIO_SECONDS * rate)
    return index.filter(
        (F.trim(F.coalesce("consent_version", F.lit(""))) != "") & (F.size(waveform) >= least)
    ).withColumn(waveform, F.slice(waveform, 1, most))


def samples_of(index: DataFrame, personnel_id: str) -> DataFrame:
    return index.filter(F.col("personnel_id") == personnel_id).orderBy("sample_date", "sample_id")


def read_checkins(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines; an unreadable line costs only itself."""
    return spark.read.schema(CHECKIN_SCHEMA).option("mode", "DROPMALFORMED").json(path)


CHECKIN_SCHEMA = T.StructType([
    T.StructField("pseudonym_id", T.StringType()),
    T.StructField("submitted_at", T.StringType()),
    T.StructField("answers", T.ArrayType(T.StructType([
        T.StructField("question_id", T.StringType()),
        T.StructField("value", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]))),
])


def read_interventions(spark: SparkSession, path: str) -> DataFrame:
    """A nested intervention document, one row per entry in document order."""
    doc = spark.read.json(path, multiLine=True)
    return doc.select(F.posexplode("interventions").alias("position", "e")).select("position", "e.*")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A nested question bank flattened to (id, text, kind, signal, reverse)."""
    q = "id string, text string, reverse_scored boolean, maps_to_signal string, free_text boolean"
    doc = spark.read.schema(
        f"general array<struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in q.split(','))}>>, "
        f"by_signal map<string, array<struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in q.split(','))}>>>"
    ).json(path, multiLine=True)
    general = doc.select(F.posexplode("general").alias("position", "q"), F.lit("").alias("group_signal"))
    tagged = doc.select(F.explode("by_signal").alias("group_signal", "qs")).select(
        F.posexplode("qs").alias("position", "q"), "group_signal")
    return general.unionByName(tagged).select(
        F.col("q.id").alias("question_id"), F.col("q.text").alias("text"),
        F.when(F.coalesce(F.col("q.free_text"), F.lit(False)), "free_text").otherwise("scale").alias("kind"),
        F.coalesce(F.col("q.maps_to_signal"), F.col("group_signal")).alias("signal_name"),
        F.coalesce(F.col("q.reverse_scored"), F.lit(False)).alias("reverse_scored"),
        F.col("group_signal"), F.col("position"),
    )


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Collected ratings; a blank rating is absent, not zero."""
    header = set(header_of(spark, path))
    missing = {"profile_id", "rater_id", "rating"} - header
    if missing:
        raise ValueError(f"ratings file lacks {sorted(missing)}")
    text = read_text_csv(spark, path, header_of(spark, path))
    return text.filter(F.trim(F.coalesce("rating", F.lit(""))) != "").select(
        F.trim("rater_id").alias("rater_id"), F.trim("profile_id").alias("profile_id"),
        F.trim("rating").cast("double").alias("rating"),
    )
