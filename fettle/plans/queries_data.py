"""Sources, quality checks, cleaning, scales and privacy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions import scales as N
from fettle.functions.scales import code
from fettle.functions.keyed_hash import pseudonym
from fettle.operators import cleaning, privacy, quality, spread
from fettle.operators import features as feat
from fettle.plans.catalog import query
from fettle.plans.oracle_views import REF, VIEWS, hmac
from fettle.plans.workload import Workload
from fettle.sources import adapter, ingest, schemas, sinks
from fettle.sources.schemas import Column, Table


def scratch(w: Workload, name: str) -> str:
    """A fresh place in the folder all executors share."""
    return f"{spread.shared_folder(w.spark)}/{name}-{uuid.uuid4().hex}"


# --- a text table with every kind of defect, from lineitem and orders ----------
LINES = Table("lines", (
    Column("order_id", "integer"), Column("line_no", "integer"), Column("quantity", "float", non_negative=True),
    Column("flag", "string", allowed=("A", "N")), Column("is_open", "boolean"), Column("note", "string"),
    Column("start_date", "date"), Column("end_date", "date"),
), ("order_id", "line_no"))


def line_texts(w: Workload) -> DataFrame:
    li, o = w.table("lineitem"), w.table("orders")
    c = F.col
    return li.join(o, c("o_orderkey") == c("l_orderkey")).select(
        F.when(c("l_suppkey") % 50 != 0, c("l_orderkey").cast("string")).alias("order_id"),
        c("l_linenumber").cast("string").alias("line_no"),
        F.when(c("l_partkey") % 97 == 0, "n/a").when(c("l_partkey") % 89 == 0, F.concat(F.lit("-"), c("l_quantity")))
        .otherwise(c("l_quantity").cast("string")).alias("quantity"),
        c("l_returnflag").alias("flag"),
        F.when(c("l_suppkey") % 33 == 0, "maybe").when(c("l_linestatus") == "O", "Yes").otherwise("0").alias("is_open"),
        F.when(c("l_tax") == 0, " ").otherwise("ok").alias("note"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
        F.when(c("l_partkey") % 101 == 0, "soon").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("end_date"),
    )


VIEWS["v_lines"] = """
SELECT CASE WHEN l_suppkey % 50 <> 0 THEN l_orderkey END AS order_id, l_linenumber AS line_no, l_quantity, l_partkey,
       l_suppkey, l_returnflag AS flag, l_tax, CAST(o_orderdate AS DATE) AS start_date,
       CASE WHEN l_partkey % 101 <> 0 THEN CAST(l_shipdate AS DATE) END AS end_date
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
COUNTS = "column_name check_name problem_count#"
#: columns of two schema tables that the SQL views derive too
DERIVED = {"leave_records": ("leave_id", "personnel_id", "start_date", "end_date", "days_availed"),
           "duty_logs": ("personnel_id", "month_start", "days_on_duty", "mean_daily_duty_hours", "total_duty_hours",
                         "weekly_offs_entitled", "weekly_offs_availed")}


@query("csv_as_text_then_cast_s01", "o_orderkey# o_custkey# o_orderstatus o_totalprice* o_orderdate",
       "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def s01(w):
    table = Table("orders", (Column("o_orderkey", "integer"), Column("o_custkey", "integer"),
                             Column("o_orderstatus", "string"), Column("o_totalprice", "float"),
                             Column("o_orderdate", "date")))
    path = sinks.write_csv(w.table("orders").withColumn("o_orderdate", F.to_date("o_orderdate")).select(*table.names),
                           scratch(w, "orders"))
    return ingest.read_table_csv(w.spark, path, table)


@query("mixed_date_formats_s02", "o_orderkey# parsed",
       """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def s02(w):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(
        k == 2, F.date_format(d, "MMM d, yyyy")).otherwise("not a date")
    return w.table("orders").select("o_orderkey", ingest.parse_date(text).alias("parsed"))


@query("load_tables_lenient_s03", "table_name row_count# error_count# is_valid", """
SELECT table_name, n AS row_count, e AS error_count, e = 0 AS is_valid FROM (
  SELECT 'personnel' AS table_name, count(*) AS n, 1 AS e FROM v_roster_raw UNION ALL
  SELECT 'unit_capacity', count(*), 3 FROM v_capacity UNION ALL SELECT 'duty_logs', count(*), 0 FROM v_duty_raw UNION ALL
  SELECT 'leave_records', count(*), CAST(count(*) FILTER (end_date < start_date) > 0 AS INT) FROM v_leave_raw UNION ALL
  SELECT 'training_records', count(*), 0 FROM v_ev WHERE event_type = 'click' UNION ALL
  SELECT 'transfer_records', count(*), 0 FROM v_ev WHERE event_type = 'signup' AND k % 5 = 0 UNION ALL
  SELECT 'deployment_history', count(*), CAST(count(*) FILTER (end_date < start_date) > 0 AS INT) FROM v_deploy_raw)""")
def s03(w):
    """All seven tables written as text and loaded; columns that a table lacks and keys that do not resolve are errors."""
    folder = scratch(w, "raw")
    for n, frame in w.raw.items():
        sinks.write_csv(frame, f"{folder}/{n}.csv")
    return ingest.load_tables(w.spark, folder, list(w.raw), strict=False)[1]


@query("labels_read_apart_s04", "personnel_id snapshot_date synthetic_welfare_risk_score*",
       """SELECT r.personnel_id, l.snapshot_date, l.label AS synthetic_welfare_risk_score
          FROM v_label l JOIN v_roster r USING (pseudonym_id)""")
def s04(w):
    rows = w.labels.join(w.roster_keys, "pseudonym_id").select(
        "personnel_id", "snapshot_date", F.col("label").alias("synthetic_welfare_risk_score"))
    return ingest.load_labels(w.spark, sinks.write_csv(rows, scratch(w, "labels")))


@query("uploaded_table_with_report_s05", "table_name row_count# error_count# warning_count# is_valid", """
SELECT 'leave_records' AS table_name, count(*) AS row_count, CAST(e AS INT) AS error_count, 1 AS warning_count, NOT e AS is_valid
FROM v_leave_raw, (SELECT count(*) FILTER (end_date < start_date) > 0 AS e FROM v_leave_raw) GROUP BY e""")
def s05(w):
    path = sinks.write_csv(w.raw["leave_records"].withColumn("extra", F.lit("x")), scratch(w, "upload"))
    return ingest.load_uploaded(w.spark, path, schemas.TABLES["leave_records"])[1]


VIEWS["v_voice_index"] = f"""
SELECT printf('V%d', vec_id) AS sample_id, printf('P%05d', label) AS personnel_id,
       {REF} - CAST((vec_id * 7) % 170 AS INT) AS sample_date,
       CASE WHEN vec_id % 23 = 0 THEN ' ' ELSE 'v1' END AS consent_version, vec_id % 65 AS samples, vec_id FROM embeddings"""


@query("voice_index_s06", "sample_id personnel_id sample_date consent_version",
       "SELECT * FROM v_voice_index")
def s06(w):
    raw = adapter.acoustic_samples(w.spark, w.folder)
    index = raw.select("sample_id", "personnel_id", "sample_date", "consent_version", F.lit(4.0).alias("duration_sec"),
                       F.lit("a.wav").alias("audio_path"), F.lit(0.5).alias("latent_strain"))
    path = scratch(w, "voice")
    index.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return privacy.assert_absent(ingest.load_voice_index(w.spark, path))


@query("consent_and_duration_gate_s07", "sample_id kept_length#",
       """SELECT sample_id, least(samples, 60) AS kept_length FROM v_voice_index
          WHERE trim(consent_version) <> '' AND samples >= 3""")
def s07(w):
    raw = adapter.acoustic_samples(w.spark, w.folder).withColumn(
        "waveform", F.slice("waveform", 1, (F.col("vec_id") % 65).cast("int")))
    return ingest.usable_samples(raw, rate=1).select("sample_id", F.size("waveform").alias("kept_length"))


@query("samples_of_one_person_s08", "sample_id sample_date",
       "SELECT sample_id, sample_date FROM v_voice_index WHERE personnel_id = 'P00003'")
def s08(w):
    return ingest.samples_of(adapter.acoustic_samples(w.spark, w.folder), "P00003")


@query("schema_of_tables_s09", "table_name column_name kind nullable filled#", " UNION ALL ".join(f"""
SELECT '{t}' AS table_name, '{c.name}' AS column_name, '{c.kind}' AS kind, {c.nullable} AS nullable, count({c.name}) AS filled
FROM {view}""" for t, view in (("leave_records", "v_leave_raw"), ("duty_logs", "v_duty_raw"))
    for c in schemas.TABLES[t].columns if c.name in DERIVED[t]))
def s09(w):
    """The exported schema document read back, with how many values of each column are filled."""
    import json
    from functools import reduce
    document = json.loads(schemas.schema_document())
    out = []
    for name in DERIVED:
        columns = [c for c in document[name]["columns"] if c["name"] in DERIVED[name]]
        entries = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c["name"]).alias("column_name"), F.lit(c["kind"]).alias("kind"),
                                     F.lit(c["nullable"]).alias("nullable"), F.col(c["name"]).alias("filled")) for c in columns])
        counts = w.raw[name].agg(*[F.count(c["name"]).alias(c["name"]) for c in columns])
        out.append(counts.select(F.inline(entries)))
    return reduce(DataFrame.unionByName, out)


@query("seven_result_datasets_s10", "dataset row_count#", """
SELECT 'cases' AS dataset, count(*) AS row_count FROM v_cases UNION ALL
SELECT 'history', count(DISTINCT pseudonym_id) FROM v_scored UNION ALL SELECT 'units', count(*) FROM v_units UNION ALL
SELECT 'near_misses', count(*) FROM v_find UNION ALL SELECT 'explanations', count(*) FROM v_latest UNION ALL
SELECT 'meta', 1 UNION ALL SELECT 'alerts', count(*) FROM v_alerts""")
def s10(w):
    folder = scratch(w, "results")
    sinks.write_results(w.results(), folder)
    from fettle.operators.booking import table_counts
    return table_counts(**sinks.load_results(w.spark, folder)).select(
        F.col("table_name").alias("dataset"), F.col("n").alias("row_count"))


@query("results_loaded_by_id_s11", "pseudonym_id points#", """
SELECT pseudonym_id, count(*) AS points FROM v_scored WHERE pseudonym_id = (SELECT min(pseudonym_id) FROM v_roster)
GROUP BY pseudonym_id""")
def s11(w):
    from fettle.operators import results
    folder = scratch(w, "history")
    results.history(w.classified).write.parquet(f"{folder}/history")
    loaded = {"history": w.spark.read.parquet(f"{folder}/history")}
    someone = w.roster_keys.agg(F.min("pseudonym_id")).scalar()
    return sinks.by_id(loaded, "history", someone).select("pseudonym_id", F.size("points").alias("points"))


@query("checkins_from_json_lines_s12", "pseudonym_id submissions# answers#", """
SELECT pseudonym_id, count(DISTINCT submission_id) AS submissions, count(*) AS answers FROM v_checkins GROUP BY pseudonym_id""")
def s12(w):
    path = scratch(w, "checkins")
    w.checkins.select("pseudonym_id", F.col("submitted_at").cast("string").alias("submitted_at"), "answers") \
        .write.json(path)
    broken = w.events.filter(F.col("event_type") == "signup").select(F.lit('{"pseudonym_id": "x"').alias("value"))
    broken.write.mode("append").text(path)
    return ingest.read_checkins(w.spark, path).groupBy("pseudonym_id").agg(
        F.count(F.lit(1)).alias("submissions"), F.sum(F.size("answers")).alias("answers"))


@query("question_bank_flattened_s13", "question_id kind signal_name reverse_scored answers#",
       """SELECT q.question_id, q.kind, q.signal_name, q.reverse_scored, count(c.submission_id) AS answers
          FROM v_questions q LEFT JOIN v_checkins c USING (question_id) GROUP BY ALL""")
def s13(w):
    import json

    from fettle.sources import library
    bank: dict = {"general": [], "by_signal": {}}
    for qid, group, signal, rev, free, text in library.QUESTIONS:
        q = {"id": qid, "text": text, "reverse_scored": rev, "free_text": free}
        if group == "":
            bank["general"].append({**q, **({"maps_to_signal": signal} if signal else {})})
        else:
            bank["by_signal"].setdefault(group, []).append(q)
    path = scratch(w, "bank")
    w.spark.createDataFrame([(json.dumps(bank),)], "value string").coalesce(1).write.text(path)
    used = w.checkins.select(F.inline("answers")).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    return ingest.read_questions(w.spark, path).join(used, "question_id", "left").withColumn(
        "answers", F.coalesce("n", F.lit(0)))


@query("intervention_library_s14", "id title description priority# recommended#",
       """SELECT l.id, l.title, l.description, l.priority, count(r.pseudonym_id) AS recommended
          FROM v_library l LEFT JOIN v_rec r ON r.id = l.id GROUP BY ALL""")
def s14(w):
    used = w.recommendations.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return w.interventions.join(used, "id", "left").withColumn("recommended", F.coalesce("n", F.lit(0)))


VIEWS["v_ratings"] = """
SELECT event_type AS rater_id, personnel_id AS profile_id, least(10e0, greatest(0e0, round_even(avg(value) / 4e0, 0)))
  AS rating FROM v_ev GROUP BY event_type, personnel_id"""


def ratings(w: Workload) -> DataFrame:
    """Each event type rates each person 0-10: the mean value over four, rounded."""
    mean = F.bround(F.avg("value") / F.lit(4.0), 0)
    return w.events.groupBy(
        F.col("event_type").alias("rater_id"), adapter.person_key(F.col("user_id")).alias("profile_id")
    ).agg(F.least(F.lit(10.0), F.greatest(F.lit(0.0), mean)).alias("rating"))


@query("rating_sheet_round_trip_s15", "rater_id profile_id rating*",
       "SELECT * FROM v_ratings WHERE rating <> 7")
def s15(w):
    sheet = ratings(w).select("profile_id", "rater_id", F.when(F.col("rating") != 7, F.col("rating")).alias("rating"))
    return ingest.read_ratings(w.spark, sinks.write_csv(sheet, scratch(w, "ratings")))


@query("missing_optional_table_s16", "pseudonym_id snapshot_date transfer_count_past_2yrs* time_since_last_transfer_days*",
       """SELECT pseudonym_id, snapshot_date, 0e0 AS transfer_count_past_2yrs, 730.56e0 AS time_since_last_transfer_days
          FROM v_grid""")
def s16(w):
    return feat.hr_features({"personnel": w.private["personnel"]}, w.snapshots)


# --- V ------------------------------------------------------------------------
@query("missing_and_unexpected_columns_v01", "table_name severity check_name column_name row_count#", """
SELECT 'lines' AS table_name, severity, check_name, column_name, (SELECT count(*) FROM v_lines) AS row_count
FROM (VALUES ('error', 'missing_column', 'note'), ('warning', 'unexpected_column', 'stray')) t(severity, check_name, column_name)""")
def v01(w):
    frame = line_texts(w).drop("note").withColumn("stray", F.lit("x"))
    n = frame.agg(F.count(F.lit(1)).alias("row_count"))
    return quality.column_set_report(frame, LINES).crossJoin(F.broadcast(n))


def _counts(w, check):
    return quality.column_counts(line_texts(w), LINES).filter(F.col("check_name") == check)


@query("unreadable_values_v02", COUNTS, """
SELECT 'order_id' AS column_name, 'unreadable' AS check_name, 0 AS problem_count UNION ALL
SELECT 'line_no', 'unreadable', 0 UNION ALL SELECT 'flag', 'unreadable', 0 UNION ALL SELECT 'note', 'unreadable', 0
UNION ALL SELECT 'start_date', 'unreadable', 0 UNION ALL
SELECT 'quantity', 'unreadable', count(*) FROM v_lines WHERE l_partkey % 97 = 0 UNION ALL
SELECT 'is_open', 'unreadable', count(*) FROM v_lines WHERE l_suppkey % 33 = 0 UNION ALL
SELECT 'end_date', 'unreadable', count(*) FROM v_lines WHERE l_partkey % 101 = 0""")
def v02(w):
    return _counts(w, "unreadable")


@query("empty_values_v03", COUNTS, """
SELECT 'order_id' AS column_name, 'empty' AS check_name, count(*) FILTER (order_id IS NULL) AS problem_count FROM v_lines
UNION ALL SELECT 'note', 'empty', count(*) FILTER (l_tax = 0) FROM v_lines
UNION ALL SELECT c, 'empty', 0 FROM (VALUES ('line_no'), ('quantity'), ('flag'), ('is_open'), ('start_date'),
  ('end_date')) t(c)""")
def v03(w):
    return _counts(w, "empty")


@query("negative_values_v04", COUNTS, """
SELECT 'quantity' AS column_name, 'negative' AS check_name,
       count(*) FILTER (l_partkey % 97 <> 0 AND l_partkey % 89 = 0 AND l_quantity > 0) AS problem_count FROM v_lines""")
def v04(w):
    return _counts(w, "negative")


@query("values_outside_allowed_set_v05", "problem_count# examples", """
SELECT count(*) AS problem_count, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v
  FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') ORDER BY v LIMIT 5)) AS examples
FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))""")
def v05(w):
    return quality.unexpected_values(w.table("orders"), "o_orderpriority", ("1-URGENT", "2-HIGH"))


@query("duplicate_primary_keys_v06", "problem_count#", """
SELECT sum(n - 1) AS problem_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def v06(w):
    return quality.duplicate_keys(w.table("lineitem"), ("l_orderkey", "l_linenumber"))


@query("end_before_start_v07", COUNTS, """
SELECT 'end_date' AS column_name, 'inverted' AS check_name, count(*) FILTER (end_date < start_date) AS problem_count
FROM v_lines""")
def v07(w):
    return _counts(w, "inverted")


@query("foreign_key_orphans_v08", "problem_count# examples", """
SELECT count(*) AS problem_count, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT v FROM v_orph ORDER BY v LIMIT 3))
  AS examples FROM v_orph""")
def v08(w):
    solvent = w.table("customer").filter(F.col("c_acctbal") >= 0)
    return quality.orphans(w.table("orders"), "o_custkey", solvent, "c_custkey")


VIEWS["v_orph"] = """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""


@query("one_report_per_table_v09", "table_name row_count# error_count# warning_count# is_valid", """
SELECT 'lines' AS table_name, n AS row_count, e AS error_count, 0 AS warning_count, e = 0 AS is_valid
FROM (SELECT count(*) AS n, CAST(bool_or(l_partkey % 97 = 0) AS INT) + CAST(bool_or(l_suppkey % 33 = 0) AS INT)
  + CAST(bool_or(l_partkey % 101 = 0) AS INT) + CAST(bool_or(order_id IS NULL) AS INT) + CAST(bool_or(l_tax = 0) AS INT)
  + CAST(bool_or(l_partkey % 97 <> 0 AND l_partkey % 89 = 0 AND l_quantity > 0) AS INT)
  + CAST(coalesce(bool_or(end_date < start_date), false) AS INT) + CAST(bool_or(flag NOT IN ('A', 'N')) AS INT)
  + CAST(count(*) > count(DISTINCT (order_id, line_no)) AS INT) AS e FROM v_lines)""")
def v09(w):
    return quality.table_reports({"lines": line_texts(w)}, {"lines": LINES})


# --- C ------------------------------------------------------------------------
def _keyed_lines(w):
    c = F.col
    return w.table("lineitem").select(
        F.when(c("l_suppkey") % 50 != 0, c("l_orderkey")).alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice")


@query("null_keys_dropped_c01", "l_orderkey# l_linenumber# l_partkey#",
       "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey % 50 <> 0")
def c01(w):
    return cleaning.drop_null_keys(_keyed_lines(w), ["l_orderkey", "l_linenumber"])


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("first_row_per_key_c02", "l_orderkey# l_linenumber# l_partkey# l_extendedprice*", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) AS rn
FROM lineitem) WHERE rn = 1""")
def c02(w):
    return cleaning.keep_first(w.table("lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)


@query("capped_columns_c03", "personnel_id month_start mean_daily_duty_hours* days_on_duty#", """
SELECT personnel_id, month_start, least(mean_daily_duty_hours, 20e0) AS mean_daily_duty_hours,
       least(days_on_duty, 31) AS days_on_duty FROM v_duty_raw""")
def c03(w):
    return w.raw["duty_logs"].withColumn(
        "mean_daily_duty_hours", cleaning.cap("mean_daily_duty_hours", P.MAX_DAILY_DUTY_HOURS)
    ).withColumn("days_on_duty", cleaning.cap("days_on_duty", P.MAX_DUTY_DAYS))


DUTY_SPEC = "pseudonym_id month_start total_duty_hours*"


@query("total_hours_recomputed_c04", DUTY_SPEC, "SELECT * FROM v_duty")
def c04(w):
    return w.private["duty_logs"]


@query("offs_clamped_to_entitlement_c05", "pseudonym_id month_start weekly_offs_availed#", "SELECT * FROM v_duty")
def c05(w):
    return w.private["duty_logs"]


@query("inverted_leave_dropped_c06", "leave_id start_date end_date",
       "SELECT leave_id, start_date, end_date FROM v_leave_raw WHERE NOT coalesce(end_date < start_date, false)")
def c06(w):
    return cleaning.drop_inverted(w.raw["leave_records"])


@query("leave_days_rederived_c07", "leave_id days_availed*", "SELECT leave_id, days_availed FROM v_leave")
def c07(w):
    return w.private["leave_records"]


@query("impossible_postings_dropped_c08", "personnel_id unit_id rank is_jawan_rank date_of_joining benign_profile",
       "SELECT * FROM v_roster")
def c08(w):
    return w.clean["personnel"]


@query("generic_key_cleaning_c09", "training_id start_date end_date training_hours*", "SELECT * FROM v_training")
def c09(w):
    return w.private["training_records"]


@query("children_of_missing_people_dropped_c10", "deployment_id start_date end_date", "SELECT * FROM v_deploy")
def c10(w):
    return w.private["deployment_history"]


@query("cleaning_log_c11", "table_name action detail affected#", """
SELECT 'personnel' AS table_name, 'drop' AS action, 'null key' AS detail, 0 AS affected UNION ALL
SELECT 'personnel', 'drop', 'duplicate on personnel_id', 0 UNION ALL
SELECT 'personnel', 'drop', 'posting before joining', count(*) FROM v_roster_raw
  WHERE current_posting_start_date < date_of_joining UNION ALL
SELECT 'duty_logs', 'drop', 'null key', 0 UNION ALL
SELECT 'duty_logs', 'drop', 'duplicate on personnel_id,month_start', 0 UNION ALL
SELECT 'duty_logs', 'cap', 'mean_daily_duty_hours', count(*) FROM v_duty_raw WHERE mean_daily_duty_hours > 20 UNION ALL
SELECT 'duty_logs', 'cap', 'days_on_duty', count(*) FROM v_duty_raw WHERE days_on_duty > 31 UNION ALL
SELECT 'duty_logs', 'recompute', 'total_duty_hours', count(*) FROM v_duty_raw
  WHERE abs(least(mean_daily_duty_hours, 20e0) * least(days_on_duty, 31) - total_duty_hours) > 1 UNION ALL
SELECT 'duty_logs', 'clamp', 'weekly_offs_availed', count(*) FROM v_duty_raw
  WHERE weekly_offs_availed > weekly_offs_entitled UNION ALL
SELECT 'duty_logs', 'drop', 'person not on roster', count(*) FROM v_duty_raw
  WHERE personnel_id NOT IN (SELECT personnel_id FROM v_roster) UNION ALL
SELECT 'leave_records', 'drop', 'null key', 0 UNION ALL SELECT 'leave_records', 'drop', 'duplicate on leave_id', 0
UNION ALL SELECT 'leave_records', 'drop', 'end before start', count(*) FROM v_leave_raw WHERE end_date < start_date
UNION ALL SELECT 'leave_records', 'recompute', 'days_availed', count(*) FROM v_leave_raw
  WHERE end_date >= start_date AND abs(end_date - start_date - days_availed) > 1
UNION ALL SELECT 'leave_records', 'cap', 'days_availed', 0
UNION ALL SELECT 'leave_records', 'drop', 'person not on roster', count(*) FROM v_leave_raw
  WHERE end_date >= start_date AND personnel_id NOT IN (SELECT personnel_id FROM v_roster)
UNION ALL SELECT t, 'drop', d, 0 FROM (VALUES ('unit_capacity', 'unit_id'), ('deployment_history', 'deployment_id'),
  ('transfer_records', 'transfer_id'), ('training_records', 'training_id')) g(t, k), (VALUES ('null key'), ('duplicate on ')) e(x),
  LATERAL (SELECT CASE WHEN x = 'null key' THEN x ELSE x || k END AS d)
UNION ALL SELECT 'deployment_history', 'drop', 'person not on roster', count(*) FROM v_deploy_raw
  WHERE personnel_id NOT IN (SELECT personnel_id FROM v_roster)
UNION ALL SELECT 'transfer_records', 'drop', 'person not on roster', count(*) FROM v_ev
  WHERE event_type = 'signup' AND k % 5 = 0 AND personnel_id NOT IN (SELECT personnel_id FROM v_roster)
UNION ALL SELECT 'training_records', 'drop', 'person not on roster', count(*) FROM v_ev
  WHERE event_type = 'click' AND personnel_id NOT IN (SELECT personnel_id FROM v_roster)""")
def c11(w):
    return cleaning.cleaning_log(w.raw)


# --- N ------------------------------------------------------------------------
def _clip01(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE least(1e0, greatest(0e0, {x})) END"


@query("saturating_scale_n01", "l_orderkey# l_linenumber# l_partkey# scaled*", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
       10e0 + ({_clip01("(CASE WHEN l_tax > 0 THEN l_quantity END - 5e0) / 35e0")}) * 80e0 AS scaled FROM lineitem""")
def n01(w):
    q = F.when(F.col("l_tax") > 0, F.col("l_quantity"))
    return w.table("lineitem").withColumn("scaled", N.saturate(q, 40.0, 5.0, 10.0, 90.0))


@query("inverse_saturating_scale_n02", "o_orderkey# scaled*", f"""
SELECT o_orderkey, 100e0 - ({_clip01("o_totalprice / 250000e0")}) * 100e0 AS scaled FROM orders""")
def n02(w):
    return w.table("orders").withColumn("scaled", N.saturate_inverse(F.col("o_totalprice"), 250000.0))


@query("zscore_with_floor_n03", "event_id# z*", """
SELECT event_id, (value - m) / CASE WHEN s < 0.000001 THEN 0.000001e0 ELSE s END AS z FROM events JOIN (
  SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY user_id) USING (user_id)""")
def n03(w):
    stats = w.events.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return w.events.join(stats, "user_id").withColumn("z", N.zscore(F.col("value"), F.col("m"), F.col("s")))


@query("robust_zscore_n04", "event_id# z*", """
SELECT event_id, (value - q[2]) / greatest((q[3] - q[1]) / 1.349e0, 0.000001e0) AS z FROM events JOIN (
  SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events GROUP BY event_type) USING (event_type)""")
def n04(w):
    q = spread.exact_quantiles(w.events, ["event_type"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return w.events.join(q, "event_type").withColumn(
        "z", N.robust_zscore(F.col("value"), F.col("q50"), F.col("q75") - F.col("q25")))


@query("clip_to_range_n05", "event_id# clipped*",
       "SELECT event_id, CASE WHEN k > 90 THEN NULL ELSE least(100e0, greatest(0e0, value - 20e0)) END AS clipped FROM v_ev")
def n05(w):
    v = F.when(F.col("k") <= 90, F.col("value") - F.lit(20.0))
    return w.events.withColumn("clipped", N.to_signal_range(v))


@query("percent_with_default_n06", "event_id# pct* pct_or_zero*", """
SELECT event_id, 100e0 * value / nullif(k, 0) AS pct, coalesce(100e0 * value / nullif(k, 0), 0e0) AS pct_or_zero
FROM v_ev""")
def n06(w):
    return w.events.withColumn("pct", N.percent(F.col("value"), F.col("k"))).withColumn(
        "pct_or_zero", N.percent(F.col("value"), F.col("k"), 0.0))


@query("row_completeness_n07", "deployment_id share*", """
SELECT deployment_id, (CAST(start_date IS NOT NULL AS INT) + CAST(end_date IS NOT NULL AS INT)) / 3e0 AS share
FROM v_deploy""")
def n07(w):
    frame = w.private["deployment_history"]
    return frame.withColumn("share", N.completeness(frame.columns, ["start_date", "end_date", "no_such_column"]))


@query("weighted_blend_n08", "event_id# blended*", """
SELECT event_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE
  least(100e0, (coalesce(a, 0e0) * 0.7e0 + coalesce(b, 0e0) * 0.3e0)
    / (CASE WHEN a IS NULL THEN 0e0 ELSE 0.7e0 END + CASE WHEN b IS NULL THEN 0e0 ELSE 0.3e0 END)) END AS blended
FROM (SELECT event_id, CASE WHEN k % 3 <> 0 THEN value END AS a, CASE WHEN k % 4 <> 0 THEN CAST(k AS DOUBLE) END AS b
      FROM v_ev)""")
def n08(w):
    a = F.when(F.col("k") % 3 != 0, F.col("value"))
    b = F.when(F.col("k") % 4 != 0, F.col("k").cast("double"))
    return w.events.withColumn("blended", N.blend((a, 0.7), (b, 0.3)))


@query("positive_z_scale_n09", "event_id# scaled*",
       "SELECT event_id, least(1e0, greatest(0e0, (value - 30e0) / 20e0 / 2.5e0)) * 100e0 AS scaled FROM v_ev")
def n09(w):
    return w.events.withColumn("scaled", N.positive_z((F.col("value") - F.lit(30.0)) / F.lit(20.0)))


@query("ranks_with_ties_averaged_n10", "event_id# avg_rank*", """
SELECT event_id, rank() OVER (ORDER BY round_even(value, 0)) + (count(*) OVER (PARTITION BY round_even(value, 0)) - 1)
  / 2e0 AS avg_rank FROM events""")
def n10(w):
    rows = w.events.select("event_id", F.bround("value", 0).alias("v"))
    return rows.join(spread.tied_ranks(rows, "v", "avg_rank"), "v")


# --- P ------------------------------------------------------------------------
@query("keyed_pseudonym_p01", "personnel_id pseudonym_id",
       f"SELECT DISTINCT personnel_id, {hmac('personnel_id')} AS pseudonym_id FROM v_ev")
def p01(w):
    return privacy.identity_map(w.raw["personnel"], w.key)


@query("identities_registered_once_p02", "pseudonym_id personnel_id", f"""
SELECT DISTINCT {hmac('personnel_id')} AS pseudonym_id, personnel_id FROM v_ev WHERE event_type = 'error'
  AND personnel_id NOT IN (SELECT personnel_id FROM v_ev WHERE event_type = 'signup' AND k < 30)""")
def p02(w):
    def ids(cond):
        return privacy.identity_map(w.events.filter(cond).select(
            adapter.person_key(F.col("user_id")).alias("personnel_id")), w.key)
    known = ids((F.col("event_type") == "signup") & (F.col("k") < 30))
    return privacy.newly_registered(known, ids(F.col("event_type") == "error"))


@query("direct_identifiers_stripped_p03", "unit_id posting_type n#",
       "SELECT unit_id, posting_type, count(*) AS n FROM v_roster_raw GROUP BY ALL")
def p03(w):
    stripped = privacy.strip_identifiers(w.raw["personnel"])
    assert not set(stripped.columns) & set(P.DIRECT_IDENTIFIERS)
    return stripped.groupBy("unit_id", "posting_type").agg(F.count(F.lit(1)).alias("n"))


@query("tables_pseudonymised_p04", "table_name n# people#", """
SELECT 'personnel' AS table_name, count(*) AS n, count(DISTINCT pseudonym_id) AS people FROM v_roster UNION ALL
SELECT 'duty_logs', count(*), count(DISTINCT pseudonym_id) FROM v_duty UNION ALL
SELECT 'leave_records', count(*), count(DISTINCT pseudonym_id) FROM v_leave UNION ALL
SELECT 'training_records', count(*), count(DISTINCT pseudonym_id) FROM v_training UNION ALL
SELECT 'transfer_records', count(*), count(DISTINCT pseudonym_id) FROM v_transfer UNION ALL
SELECT 'deployment_history', count(*), count(DISTINCT pseudonym_id) FROM v_deploy""")
def p04(w):
    from functools import reduce
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pseudonym_id").alias("people"))
        .withColumn("table_name", F.lit(name)) for name, df in w.private.items() if name != "unit_capacity"])


def requests(w: Workload) -> DataFrame:
    role = F.when(F.col("k") % 4 == 0, P.ROLE_COMMANDER).otherwise(P.ROLE_OFFICER)
    who = F.when(F.col("k") % 9 == 0, "PSN0000000000000000").otherwise(
        pseudonym(adapter.person_key(F.col("user_id")), w.key))
    return w.events.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), who.alias("pseudonym_id"),
        code("S", F.col("k"), 3).alias("requester_id"), role.alias("requester_role"),
        F.when(F.col("k") % 5 == 0, "  ").otherwise("welfare follow-up").alias("purpose"),
        F.col("ts").alias("requested_at"))


VIEWS["v_requests"] = f"""
SELECT event_id AS id, CASE WHEN k % 9 = 0 THEN 'PSN0000000000000000' ELSE {hmac('personnel_id')} END AS pseudonym_id,
       personnel_id AS person, CASE WHEN k % 4 = 0 THEN 'role not permitted' WHEN k % 5 = 0 THEN 'purpose required'
       WHEN k % 9 = 0 THEN 'unknown pseudonym' ELSE 'granted' END AS decision, ts AS requested_at
FROM v_ev WHERE event_type = 'error'"""


@query("reidentification_requests_p05", "id# pseudonym_id decision granted personnel_id", """
SELECT id, pseudonym_id, decision, decision = 'granted' AS granted, CASE WHEN decision = 'granted' THEN person END
  AS personnel_id FROM v_requests""")
def p05(w):
    return privacy.resolve_requests(requests(w), privacy.identity_map(w.raw["personnel"], w.key))


@query("audit_summary_p06", "pseudonym_id attempts# granted# refused# first_resolved_at last_resolved_at", """
SELECT pseudonym_id, count(*) AS attempts, count(*) FILTER (decision = 'granted') AS granted,
       count(*) FILTER (decision <> 'granted') AS refused, min(requested_at) FILTER (decision = 'granted')
         AS first_resolved_at, max(requested_at) FILTER (decision = 'granted') AS last_resolved_at
FROM v_requests GROUP BY pseudonym_id""")
def p06(w):
    return privacy.audit_summary(p05(w))


@query("newest_audit_rows_p07", "id# pseudonym_id decision",
       "SELECT id, pseudonym_id, decision FROM v_requests ORDER BY id DESC LIMIT 100")
def p07(w):
    return privacy.newest(p05(w), 100, "id")


@query("registered_identities_p08", "n#", "SELECT count(DISTINCT user_id) AS n FROM v_roster_raw")
def p08(w):
    return privacy.identity_map(w.raw["personnel"], w.key).agg(F.count(F.lit(1)).alias("n"))


@query("identifier_namespaces_p09", "event_id# kind", """
SELECT event_id, CASE k % 4 WHEN 0 THEN 'service_identity' WHEN 1 THEN 'pseudonym' WHEN 2 THEN 'blank' ELSE 'unknown' END
  AS kind FROM v_ev""")
def p09(w):
    person = adapter.person_key(F.col("user_id"))
    subject = F.when(F.col("k") % 4 == 0, F.concat(F.lit(" "), person)).when(
        F.col("k") % 4 == 1, pseudonym(person, w.key)).when(F.col("k") % 4 == 2, "  ").otherwise(F.concat(person, person))
    return w.events.select("event_id", privacy.namespace(subject).alias("kind"))


@query("unit_level_leak_guard_p10", "unit_id mean_risk* is_near_miss", """
SELECT u.unit_id, mean_risk, f.unit_id IS NOT NULL AS is_near_miss FROM v_units u LEFT JOIN v_find f ON f.unit_id = u.unit_id""")
def p10(w):
    from fettle.operators import results
    from fettle.operators.privacy import IndividualDataLeak
    try:
        privacy.assert_unit_level(results.nested_cases(w.cases))
    except IndividualDataLeak:
        return privacy.assert_unit_level(results.unit_payload(w.unit_stats, w.pressure, w.findings))
    raise AssertionError("the guard let a case through")


@query("small_units_suppressed_p11", "unit_id personnel_count# mean_balance* is_suppressed", """
SELECT unit_id, n AS personnel_count, CASE WHEN n >= 10 THEN b END AS mean_balance, n < 10 AS is_suppressed
FROM (SELECT unit_id, count(*) AS n, avg(c_acctbal) AS b FROM v_roster_small JOIN customer ON c_custkey = user_id
      GROUP BY unit_id)""")
def p11(w):
    small = adapter.personnel(w.spark, w.folder, "n_nationkey").withColumn(
        "c_custkey", F.substring("personnel_id", 2, 12).cast("long"))
    stats = small.join(w.table("customer").select("c_custkey", "c_acctbal"), "c_custkey").groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("personnel_count"), F.avg("c_acctbal").alias("mean_balance"))
    return privacy.suppress_small(stats, "personnel_count", ["mean_balance"])


@query("generation_only_columns_absent_p12", "column_name filled#", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS filled FROM v_with_voice" for c in P.MODEL_INPUTS))
def p12(w):
    """The columns that reach a model, each with its filled values."""
    frame = privacy.assert_absent(w.behaviour).select(*P.MODEL_INPUTS)
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in frame.columns])
    return frame.agg(*[F.count(c).alias(c) for c in frame.columns]).select(F.inline(entries))


@query("row_scope_p13", "pseudonym_id scope welfare_risk_score*", """
SELECT pseudonym_id, 'officer' AS scope, welfare_risk_score FROM v_cases WHERE is_officer_visible UNION ALL
SELECT pseudonym_id, 'own', welfare_risk_score FROM v_cases WHERE pseudonym_id = (SELECT min(pseudonym_id) FROM v_roster)""")
def p13(w):
    someone = w.roster_keys.agg(F.min("pseudonym_id")).scalar()
    return privacy.officer_rows(w.cases).withColumn("scope", F.lit("officer")).unionByName(
        privacy.own_rows(w.cases, someone).withColumn("scope", F.lit("own")))
