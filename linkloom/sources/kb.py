"""Knowledge base readers: JSON layouts to one entity schema.

entity_id, standard_name, aliases, entity_type, description, metadata (map of
strings), entity_ord. A missing file is an empty knowledge base.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

_TEXT = T.StringType()
_FIELDS = {"entity_id": _TEXT, "standard_name": _TEXT, "aliases": T.ArrayType(_TEXT), "entity_type": _TEXT, "description": _TEXT, "metadata": T.MapType(_TEXT, _TEXT), "entity_ord": T.LongType()}
ENTITY_SCHEMA = T.StructType([T.StructField(n, k) for n, k in _FIELDS.items()])


def _records(node: object) -> Iterator[dict]:
    """Every object at any depth that has an id and a name; what is inside one is not looked at."""
    if isinstance(node, dict):
        if "entity_id" in node and ("standard_name" in node or "entity_name" in node):
            yield node
        else:
            for child in node.values():
                yield from _records(child)
    elif isinstance(node, list):
        for child in node:
            yield from _records(child)


def _entity(r: dict) -> dict:
    names = [a.get("name") if isinstance(a, dict) else a for a in r.get("aliases") or []]
    own = {"industry": r.get("industry", ""), "abbreviation": r.get("abbreviation", ""), "source": r.get("source", ""), "tags": r.get("tags", [])} | (r.get("metadata") or {})
    return {
        "entity_id": r.get("entity_id") or "",
        "standard_name": r.get("standard_name", r.get("entity_name", "")) or "",
        "aliases": [a for a in names if isinstance(a, str) and a],
        "entity_type": r.get("entity_type", r.get("type", "UNKNOWN")),
        "description": r.get("description", r.get("summary", "")) or "",
        "metadata": {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in own.items()},
    }


def read_json_kb(spark: SparkSession, path: str) -> DataFrame:
    """Entities of JSON files of any layout; each file is one value. entity_ord follows the files' names, then the place in a
    file (2 ** 31 files and 2 ** 32 entities a file at most)."""

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for text, at in zip(pdf["value"], pdf["file"], strict=True):
                rows += [_entity(r) | {"entity_ord": (at << 32) + i} for i, r in enumerate(_records(json.loads(text)))]
            yield pd.DataFrame(rows, columns=ENTITY_SCHEMA.names)

    try:
        files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("name"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ENTITY_SCHEMA)
        raise
    names = files.select("name").distinct().withColumn("file", F.row_number().over(Window.orderBy("name")).cast("long") - 1)  # a row for each file
    got = files.join(F.broadcast(names), "name").select("value", "file").mapInPandas(run, ENTITY_SCHEMA)
    return normalised(got)


def normalised(entities: DataFrame) -> DataFrame:
    """Types mapped to standard ones; rows without id or name left out."""
    return entities.withColumn("entity_type", tx.standard_type(F.col("entity_type"))).where("entity_id <> '' and standard_name <> ''")


def from_table(df: DataFrame, **columns: str) -> DataFrame:
    """Entities of a table: which column is which; the others are empty. entity_ord is the column named so (``entity_ord=``), else
    a hash of the id: the same each time, but in no order that means anything."""
    pick = lambda c, kind: F.col(columns[c]).cast(kind) if c in columns else F.lit(None).cast(kind)
    keep = [F.col(columns["entity_ord"]).cast("long").alias("_ord")] if "entity_ord" in columns else []
    order = F.col("_ord") if keep else F.xxhash64("entity_id")
    rows = df.select(*keep, *[pick(f.name, f.dataType.simpleString()).alias(f.name) for f in ENTITY_SCHEMA.fields if f.name != "entity_ord"])
    out = normalised(rows.withColumn("entity_type", F.coalesce("entity_type", F.lit("UNKNOWN")))).withColumn("entity_ord", order)
    return out.select(*ENTITY_SCHEMA.names)


def read_expansion(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """New entities and alias updates (entity_id, aliases) of an expansion file."""
    alias = T.StructType([T.StructField("name", T.StringType())])
    update = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))])
    schema = T.StructType([T.StructField("alias_updates", T.ArrayType(update))])
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("alias_updates").alias("u"))
    name = lambda a: F.coalesce(F.from_json(a, alias)["name"], a)
    return read_json_kb(spark, path), raw.select("u.entity_id", F.transform("u.aliases", name).alias("aliases"))


READERS = {"json": read_json_kb}


def reader(kind: str):
    """The reader of a kind of knowledge base; graph stores have none."""
    if kind not in READERS:
        raise NotImplementedError(f"no knowledge base reader for {kind}")
    return READERS[kind]
