"""Built-in intervention library and question bank (small, fixed dimensions).

The fixed values lie in ``documents/*.json`` beside this module. A deployment may read its
own documents with ``ingest.read_interventions`` / ``ingest.read_questions`` instead.
"""

from __future__ import annotations

import json
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _document(name: str) -> dict:
    return json.loads(files("fettle.sources").joinpath("documents", name).read_text(encoding="utf-8"))


#: id, title, signals, levels, attribution, priority, recipient, owner, description, in library order
INTERVENTIONS = tuple(
    (e["id"], e["title"], tuple(e["applicable_signals"]), tuple(e["applicable_risk_levels"]),
     tuple(e["applicable_attribution"]), e["priority"], e["recipient"], e["action_owner"], e["description"])
    for e in _document("interventions.json")["interventions"])

#: id, group ("" = general), signal, reverse scored, free text, wording
QUESTIONS = tuple(
    (q["id"], q["group"], q["signal"], q["reverse_scored"], q["free_text"], q["text"])
    for q in _document("questions.json")["questions"])


def interventions(spark: SparkSession) -> DataFrame:
    rows = [(i, *(list(x) if isinstance(x, tuple) else x for x in row)) for i, row in enumerate(INTERVENTIONS)]
    return spark.createDataFrame(rows, (
        "position int, id string, title string, applicable_signals array<string>, "
        "applicable_risk_levels array<string>, applicable_attribution array<string>, priority int, "
        "recipient string, action_owner string, description string"))


def questions(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(QUESTIONS)]
    return spark.createDataFrame(rows, (
        "position int, question_id string, group_signal string, signal_name string, reverse_scored boolean, "
        "free_text boolean, text string"
    )).withColumn("kind", F.when(F.col("free_text"), "free_text").otherwise("scale")).drop("free_text")
