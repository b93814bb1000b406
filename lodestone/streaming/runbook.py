"""Runbooks: ordered stages of inserts, replaces, deletes and searches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutate import live_set
from ..operators.search import knn

# The operations and the keys each needs.
OPERATIONS = {"insert": ("start", "end"), "delete": ("start", "end"), "search": (), "replace": ("ids_start", "ids_end", "tags_start", "tags_end")}


class RunbookError(ValueError):
    """A runbook that can't be run."""


def _scalar(text: str):
    text = text.strip().strip("\"'")
    try:
        return int(text)
    except ValueError:
        return text


def parse_yaml(text: str) -> dict:
    """Nested mappings by indentation: what runbooks use of YAML."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise RunbookError(f"no key in line: {line.strip()!r}")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][_scalar(key)] = _scalar(value)
        else:
            stack[-1][1][_scalar(key)] = child = {}
            stack.append((depth, child))
    return root


def load(text: str, dataset: str) -> list[dict]:
    """The stages of a dataset in order, checked; ``max_pts`` is the key of the first (else computed)."""
    tree = json.loads(text) if text.lstrip().startswith("{") else parse_yaml(text)
    if dataset not in tree:
        raise RunbookError(f"no dataset {dataset!r}; there are {sorted(map(str, tree))}")
    body = {str(k): v for k, v in tree[dataset].items()}
    numbers = sorted(int(k) for k in body if k.isdigit())
    if not numbers:
        raise RunbookError("no stages")
    first = numbers[0]
    if first not in (0, 1) or numbers != list(range(first, first + len(numbers))):
        raise RunbookError("stages must be numbered from 0 without gaps")
    stages, live, most = [], {}, 0
    for n in numbers:
        stage = dict(body[str(n)])
        op = stage.get("operation")
        if op not in OPERATIONS:
            raise RunbookError(f"stage {n}: unknown operation {op!r}")
        for key in OPERATIONS[op]:
            if not isinstance(stage.get(key), int) or stage[key] < 0:
                raise RunbookError(f"stage {n}: {op} needs {key}")
        spans = [("start", "end")] if op in ("insert", "delete") else [("ids_start", "ids_end"), ("tags_start", "tags_end")] if op == "replace" else []
        for a, z in spans:
            if stage[a] >= stage[z]:
                raise RunbookError(f"stage {n}: the range from {a} is empty")
        if op == "replace" and stage["ids_end"] - stage["ids_start"] != stage["tags_end"] - stage["tags_start"]:
            raise RunbookError(f"stage {n}: ids and tags differ in number")
        if op == "insert":
            live |= dict.fromkeys(range(stage["start"], stage["end"]), True)
        if op == "delete":
            for x in range(stage["start"], stage["end"]):
                if not live.pop(x, None):
                    raise RunbookError(f"stage {n}: {x} isn't there to delete")
        if op == "replace" and any(x not in live for x in range(stage["tags_start"], stage["tags_end"])):
            raise RunbookError(f"stage {n}: a tag isn't there to replace")
        most = max(most, len(live))
        stages.append({"stage": n} | stage)
    given = body.get("max_pts")
    stages[0]["max_pts"] = max(most, given) if isinstance(given, int) else most
    return stages


def change_log(spark: SparkSession, stages: list[dict], source: DataFrame) -> DataFrame:
    """(stage, seq, op, id, vec): one row for each changed id; ranges are joined with the source, not collected."""
    spans = []
    for s in stages:
        if s["operation"] == "insert":
            spans.append((s["stage"], "insert", s["start"], s["end"], 0))
        elif s["operation"] == "delete":
            spans.append((s["stage"], "delete", s["start"], s["end"], 0))
        elif s["operation"] == "replace":
            spans.append((s["stage"], "replace", s["ids_start"], s["ids_end"], s["tags_start"] - s["ids_start"]))
    table = spark.createDataFrame(spans, "stage int, op string, low long, high long, shift long")
    ids = table.select("stage", "op", "shift", F.explode(F.sequence("low", F.col("high") - 1)).alias("source_id"))
    rows = ids.join(source.select(F.col("id").alias("source_id"), "vec"), "source_id", "left")
    return rows.select("stage", F.col("source_id").alias("seq"), "op", (F.col("source_id") + F.col("shift")).alias("id"), F.when(F.col("op") != "delete", F.col("vec")).alias("vec"))


def run(spark: SparkSession, stages: list[dict], source: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """(stage, qid, id, rank, distance): the results of every search stage on the rows alive then."""
    log, out = change_log(spark, stages, source), None
    for s in stages:
        if s["operation"] == "search":
            found = knn(live_set(log, s["stage"]), queries, k, metric).select(F.lit(s["stage"]).alias("stage"), "qid", "id", "rank", "distance")
            out = found if out is None else out.unionByName(found)
    return out
