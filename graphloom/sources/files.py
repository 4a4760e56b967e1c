"""Text folders, JSON key-value files, example files, graph files, settings."""

from __future__ import annotations

import dataclasses
import html
import json
import re
import typing
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_texts(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, text) of all files below a folder, one row a file, optionally by suffix; read as UTF-8."""
    reader = spark.read.option("recursiveFileLookup", True)
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    return reader.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_json_store(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of id -> value as (id, ...value). ``value`` is the SQL type of a value, e.g. ``struct<...>`` or ``string``."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("id", "v"))
    return rows.select("id", "v.*") if value.startswith("struct") else rows.select("id", F.col("v").alias("value"))


def write_json_store(rows: DataFrame, folder: str, key: str = "id") -> None:
    """Lines of JSON, one row each, over the former content."""
    rows.select(F.col(key).alias("id"), F.struct(*[c for c in rows.columns if c != key]).alias("value")).write.mode("overwrite").json(folder)


def read_examples(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """(id, input_text, output, metadata, language, quality_rating) of an ``{"examples": [...]}`` file; output stays JSON."""
    schema = "examples array<struct<id:string,input_text:string,output:string,metadata:map<string,string>,quality_rating:int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("examples").alias("e")).select("e.*")
    rows = rows.withColumn("language", F.col("metadata")["language"])
    return rows if language is None else rows.filter(F.col("language") == language)


_TOKEN = re.compile(r'"([^"]*)"|([\[\]])|([^\s"\[\]]+)')


def _gml(text: str) -> Iterator[tuple[str, dict[str, list]]]:
    """Top level records of a GML graph as (kind, attributes); repeated attributes make a list."""
    stack: list[tuple[str, dict[str, list]]] = []
    key: str | None = None
    for quoted, bracket, bare in _TOKEN.findall(text):
        if bracket == "[":
            stack.append((key or "", {}))
            key = None
        elif bracket == "]":
            name, attributes = stack.pop()
            if name in ("node", "edge"):
                yield name, attributes
            elif stack:
                stack[-1][1].setdefault(name, []).append(attributes)
        elif key is None:
            key = bare or quoted
        else:
            value = html.unescape(quoted) if not bare else bare
            if stack:
                stack[-1][1].setdefault(key, []).append(value)
            key = None


def _texts(attributes: dict[str, list], name: str) -> list[str]:
    """A list attribute: ``"[]"`` stands for none, ``_networkx_list_start`` marks a list of one."""
    return [v for v in attributes.get(name, []) if v not in ("[]", "_networkx_list_start")]


NODES = "id string, entity_name string, entity_type string, description string, source_chunk_id array<string>, documents_id array<string>"
EDGES = (
    "id string, subject_id string, object_id string, subject_name string, object_name string, relation_type string,"
    " description string, relation_strength double, source_chunk_id array<string>"
)


def read_graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GML multigraph. A graph file is one unsplittable text, parsed by one executor task per file."""
    files = spark.read.text(path, wholetext=True)
    nodes, edges = T._parse_datatype_string(NODES), T._parse_datatype_string(EDGES)

    def one(a: dict[str, list], name: str) -> str | None:
        return a[name][0] if a.get(name) else None

    def run(kind: str):
        def parse(frames):
            import pandas as pd

            for frame in frames:
                rows = []
                for text in frame["value"]:
                    records = list(_gml(text))
                    label = {one(a, "id"): one(a, "label") or one(a, "id") for k, a in records if k == "node"}
                    for k, a in records:
                        if k == kind == "node":
                            rows.append((label[one(a, "id")], one(a, "entity_name"), one(a, "entity_type"), one(a, "description"), _texts(a, "source_chunk_id"), _texts(a, "documents_id")))
                        elif k == kind == "edge":
                            rows.append((one(a, "key") or one(a, "id"), label.get(one(a, "source")), label.get(one(a, "target")), one(a, "subject_name"), one(a, "object_name"), one(a, "relation_type"), one(a, "description"), float(one(a, "relation_strength") or 1.0), _texts(a, "source_chunk_id")))
                yield pd.DataFrame(rows, columns=(nodes if kind == "node" else edges).names)

        return parse

    return files.mapInPandas(run("node"), nodes), files.mapInPandas(run("edge"), edges)


def graph_export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit for a property graph: nulls as empty text, arrays as JSON."""

    def plain(rows: DataFrame) -> DataFrame:
        out = []
        for f in rows.schema:
            kind = f.dataType.typeName()
            c = F.to_json(f.name) if kind in ("array", "struct", "map") else F.col(f.name)
            out.append((F.coalesce(c, F.lit("")) if kind in ("array", "struct", "map", "string") else c).alias(f.name))
        return rows.select(*out)

    return plain(nodes), plain(edges)


@dataclasses.dataclass
class Settings:
    """Engine settings, saved as JSON. Unknown keys warn, wrong types and counts below one raise."""

    storage_folder: str = "graphloom_index"
    language: typing.Literal["english", "russian"] = "english"
    max_cluster_size: int = 128
    summarize_above: int = 7
    cluster_above: int = 10_000
    embed_batch: int = 500
    context_tokens: int = 30_000
    top_k: int = 20
    cosine_threshold: float = 0.2

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            value = getattr(self, f.name)
            kind = typing.get_type_hints(type(self))[f.name]
            if typing.get_origin(kind) is typing.Literal:
                if value not in typing.get_args(kind):
                    raise ValueError(f"{f.name} must be one of {typing.get_args(kind)}")
            elif kind is float and isinstance(value, int | float) and not isinstance(value, bool):
                pass
            elif not isinstance(value, kind) or isinstance(value, bool):
                raise TypeError(f"{f.name} must be {kind.__name__}")
            elif kind is int and value < 1:
                raise ValueError(f"{f.name} must be positive")

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(dataclasses.asdict(self), f, indent=2)

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        names = {f.name for f in dataclasses.fields(cls)}
        for unknown in sorted(stored.keys() - names):
            warnings.warn(f"unknown setting {unknown}", stacklevel=2)
        return cls(**{k: v for k, v in stored.items() if k in names})


def write_graph_file(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GML multigraph that :func:`read_graph_file` reads back; such a file is one text, written row by row on the driver."""

    def attributes(row: dict, skip: tuple[str, ...]) -> Iterator[str]:
        for name, value in row.items():
            if name in skip or value is None:
                continue
            if isinstance(value, list):
                many = ["_networkx_list_start", *value] if len(value) == 1 else value or ["[]"]
                yield from (f'    {name} "{quoted(v)}"' for v in many)
            else:
                yield f"    {name} {value}" if isinstance(value, int | float) else f'    {name} "{quoted(value)}"'

    def quoted(value: object) -> str:
        plain = html.escape(str(value), quote=False).replace('"', "&quot;")
        return "".join(c if c.isascii() else f"&#{ord(c)};" for c in plain)

    place: dict[str, int] = {}
    with open(path, "w", encoding="utf-8") as out:
        out.write("graph [\n  directed 1\n  multigraph 1\n")
        for row in nodes.orderBy("id").toLocalIterator():
            place[row["id"]] = len(place)
            lines = attributes({k: v for k, v in row.asDict(True).items() if k != "clusters"}, ("id",))
            out.write("\n".join(["  node [", f"    id {place[row['id']]}", f'    label "{quoted(row["id"])}"', *lines, "  ]\n"]))
        for row in edges.orderBy("id").toLocalIterator():
            ends = [place[row[c]] for c in ("subject_id", "object_id")]
            lines = attributes(row.asDict(True), ("id", "subject_id", "object_id"))
            out.write("\n".join(["  edge [", f"    source {ends[0]}", f"    target {ends[1]}", f'    key "{quoted(row["id"])}"', *lines, "  ]\n"]))
        out.write("]\n")


def read_vector_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, payload) of a vector file: JSON with ``data`` (a list of records with ``__id__``) and ``matrix`` (base64 of 32-bit floats).

    ``payload`` is the rest of the record as JSON. A file whose matrix does not
    fit its dimension raises.
    """
    files = spark.read.text(path, wholetext=True)

    def parse(frames):
        import base64

        import numpy as np
        import pandas as pd

        for frame in frames:
            rows = []
            for text in frame["value"]:
                store = json.loads(text)
                matrix = np.frombuffer(base64.b64decode(store.get("matrix") or ""), dtype="<f4")
                data, dim = store.get("data") or [], int(store["embedding_dim"])
                if len(matrix) != len(data) * dim:
                    raise ValueError(f"the matrix holds {len(matrix)} numbers, not {len(data)} x {dim}")
                for record, vector in zip(data, matrix.reshape(len(data), dim), strict=True):
                    rest = {k: v for k, v in record.items() if k not in ("__id__", "__vector__")}
                    rows.append((record.get("__id__"), vector.tolist(), json.dumps(rest, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["id", "vector", "payload"])

    return files.mapInPandas(parse, "id string, vector array<float>, payload string")


def check_collection(found: dict[str, object], dim: int, metric: str = "cosine", sparse: str | None = None, idf: bool = True) -> None:
    """Raises where a vector collection's settings (size, distance, sparse, modifier) are not those expected."""
    wanted: dict[str, object] = {"size": dim, "distance": metric}
    if sparse is not None:
        wanted |= {"sparse": sparse, "modifier": "idf" if idf else None}
    for name, value in wanted.items():
        own = found.get(name)
        if (own.lower() if isinstance(own, str) else own) != value:
            raise ValueError(f"the collection's {name} is {own!r}, not {value!r}")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text, language) of text files and of JSON files with a list of texts or of records with ``text`` and ``language``.

    A text without a language is Russian if most of its letters are Cyrillic,
    otherwise English; blank texts are left out.
    """
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    plain = whole.filter(~F.col("path").endswith(".json")).select(F.col("value").alias("text"), F.lit(None).cast("string").alias("language"))
    items = whole.filter(F.col("path").endswith(".json")).select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    record = F.from_json("item", "struct<text:string,language:string>")
    listed = items.select(F.coalesce(record["text"], F.when(~F.col("item").startswith("{"), F.col("item"))).alias("text"), record["language"].alias("language"))
    rows = plain.unionAll(listed).filter(F.trim("text") != "")
    cyrillic, letters = (F.regexp_count("text", F.lit(p)) for p in (r"[а-яА-ЯёЁ]", r"\p{L}"))
    guess = F.when(cyrillic * 2 > letters, F.lit("russian")).otherwise(F.lit("english"))
    return rows.withColumn("language", F.coalesce("language", guess))


def export_batches(rows: DataFrame, write, size: int = 500) -> None:
    """Hands the rows of each partition to ``write`` (a list of dicts) in batches; it runs on the executors and may be repeated there."""

    def run(partition):
        batch = []
        for row in partition:
            batch.append(row.asDict(True))
            if len(batch) == size:
                write(batch)
                batch = []
        if batch:
            write(batch)

    rows.foreachPartition(run)
