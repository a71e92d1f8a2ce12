"""Readers of the input layouts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHATS = "id string, conversations array<struct<`from`: string, value: string>>"
ANSWERS = (
    "answer_generation struct<valid_data: boolean, finish_type: string, query: string,"
    " `function`: array<struct<name: string, description: string>>>"
)
API_LOG = "input string, output string"
API_TRACES = "requirement string, apis array<struct<api_name: string, output: string>>"
TRAJECTORIES = (
    "task_id string, task_description string, tool_sequence array<string>, tool_details array<struct<name: string,"
    " category: string, description: string, call_success: boolean>>, num_steps int, source_split string"
)
EDGES = "source string, target string, weight double, count double, pmi double, transition_prob double"


def chats(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of chat samples; a missing file gives no rows, and so does one that is no array of samples."""
    try:
        rows = spark.read.schema(CHATS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHATS)
    return rows.where("conversations IS NOT NULL")


def answers(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """A folder of one JSON object a query, by file name; unreadable files are left out."""
    rows = spark.read.schema(ANSWERS).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    rows = rows.select("*", F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("task_id")).where("answer_generation IS NOT NULL")
    return rows if most is None else rows.orderBy("task_id").limit(most)


def api_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of steps, numbered as they are in the file."""
    rows = spark.read.schema(API_LOG).option("multiLine", True).json(path)
    return rows.select(F.monotonically_increasing_id().alias("ord"), "input", "output")


def api_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(API_TRACES).option("multiLine", True).json(path)


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines and empty sequences are left out."""
    return spark.read.schema(TRAJECTORIES).json(path).where(F.size("tool_sequence") > 0)


def edges(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(EDGES).option("header", True).csv(path)
    return rows.withColumnsRenamed({"source": "src", "target": "dst"})


def mapping(spark: SparkSession, path: str, value: str = "int", key: str = "tool", name: str = "value") -> DataFrame:
    """A JSON object of one value a key, such as communities or a registry, as rows (key, value)."""
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias(key, name))


def split(spark: SparkSession, path: str) -> DataFrame:
    """{train_idx, test_idx} as rows (idx, is_test)."""
    row = spark.read.schema("train_idx array<int>, test_idx array<int>").option("multiLine", True).json(path)
    one = lambda c, t: row.select(F.explode(c).alias("idx"), F.lit(t).alias("is_test"))
    return one("train_idx", False).unionByName(one("test_idx", True))


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """Hyper-parameters: one row of structs."""
    return spark.read.option("multiLine", True).json(path)


#: Keys under which samples may be wrapped.
WRAPPERS = ("data", "samples", "trajectories", "train", "test")


def inspect(spark: SparkSession, path: str) -> dict:
    """Layout, columns, count and mean length of a file of samples of any of three layouts."""
    rows = spark.read.option("multiLine", not path.endswith("l")).json(path)
    wrapper = next((w for w in WRAPPERS if w in rows.columns and rows.schema[w].dataType.typeName() == "array"), None)
    if wrapper:
        rows = rows.select(F.explode(wrapper).alias("_r")).select("_r.*")
    layouts = {"process": "process", "answer": "answer.train_messages", "conversations": "conversations"}
    layout = next((c for c in layouts if c in rows.columns), None)
    size = F.size(layouts[layout]) if layout else F.lit(None).cast("int")
    n, mean = rows.agg(F.count(F.lit(1)), F.avg(size)).first()
    return {"layout": layout, "wrapper": wrapper, "schema": rows.schema.treeString(5), "count": n, "mean_length": mean}


#: What a sample of each layout has, as the path to its turns.
LAYOUTS = {"process": ("process",), "answer": ("answer", "train_messages"), "conversations": ("conversations",)}
_SAMPLE = "file string, place int, layout string, id string, n_turns int, sample string"


def _objects(raw: bytes) -> list | None:
    """The samples of a file: a JSON array, an object that holds one under a wrapper's name, one object, or JSON lines; None if it is none of them."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    try:
        whole = json.loads(text)
    except ValueError:
        try:
            return [json.loads(line) for line in text.splitlines() if line.strip()]
        except ValueError:
            return None
    if isinstance(whole, dict):
        wrapper = next((w for w in WRAPPERS if isinstance(whole.get(w), list)), None)
        return whole[wrapper] if wrapper else [whole]
    return whole if isinstance(whole, list) else None


def _turns(sample) -> tuple[str | None, int | None]:
    for layout, path in LAYOUTS.items():
        at = sample
        for key in path:
            at = at.get(key) if isinstance(at, dict) else None
        if isinstance(at, list):
            return layout, len(at)
    return None, None


def samples(spark: SparkSession, folder: str, pattern: str = "*.json*") -> DataFrame:
    """(file, place, layout, id, n_turns, sample): the samples of all files of a folder, whichever of the layouts each has.

    Spark finds the files, wherever they lie, and deals them in groups; a task reads one after the other. A file that cannot
    be read makes one row of nulls beside its name, an empty one makes none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                found = _objects(bytes(raw))
                rows = [(path, None, None, None, None, None)] if found is None else []
                for i, s in enumerate(found or []):
                    layout, n = _turns(s)
                    key = s.get("id") if isinstance(s, dict) else None
                    rows.append((path, i, layout, None if key is None else str(key), n, json.dumps(s, ensure_ascii=False)))
                out = pd.DataFrame(rows, columns=["file", "place", "layout", "id", "n_turns", "sample"])
                yield out.astype({"place": "Int32", "n_turns": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(run, _SAMPLE)


def newest(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, modified, bytes): files of a folder, those changed last first; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    found = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return found.orderBy(F.desc("modified"), "path")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result file with a header, by the names of its columns: those of the schema that it lacks are null."""
    there = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in there.columns}
    wanted = spark.createDataFrame([], schema).schema
    cast = lambda f: F.expr(f"try_cast(`{names[f.name.lower()]}` AS {f.dataType.simpleString()})") if f.name.lower() in names else F.lit(None).cast(f.dataType)
    return there.select(*[cast(f).alias(f.name) for f in wanted])
