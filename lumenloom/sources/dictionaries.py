"""Tag dictionaries, model metadata and caption presets."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions.tags import normalize_category
from lumenloom.operators.ordered import row_number
from lumenloom.params import PRESET_DEFAULTS, CaptionOptions
from lumenloom.sources.scan import BATCH_BYTES, folder_of, listed, shared_folder

# --- fixed values: where model metadata keeps its tables, first match wins ------
CONTAINERS = ("$.dataset_info.tag_mapping", "$.tag_mapping", "$")
NAME_KEYS = ("idx_to_tag", "idx2tag", "id_to_tag", "tags")
CATEGORY_KEYS = ("tag_to_category", "tag2category", "categories")
PACKED = r"[.](gz|bz2|deflate|snappy|lz4|zst|zstd|xz)$"
# ---------------------------------------------------------------------------------


#: columns of a CSV dictionary that are read
_CSV_WIDTH = 32


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): whole files of a path, which may be a folder."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last one counts
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))


def _items(docs: DataFrame, doc: str) -> DataFrame:
    """(file, place, key, value) of a JSON list or object in ``doc``; ``key`` is NULL for lists."""
    parsed = docs.select("file", F.try_parse_json(doc).alias("_doc"))
    return parsed.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_doc").outer())).select("file", F.col("pos").alias("place"), "key", "value")


def _text(value: Column, at: str = "$") -> Column:
    return F.try_variant_get(value, at, "string")


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _entry_name(value: Column) -> Column:
    named = F.coalesce(F.nullif(_text(value, "$.name"), F.lit("")), _text(value, "$.tag"), F.lit(""))
    return F.when(_is_text(value), _text(value)).otherwise(named)


def _entry_category(value: Column) -> Column:
    return F.when(_is_text(value), F.lit("unknown")).otherwise(normalize_category(_text(value, "$.category")))


def _placed(items: DataFrame) -> DataFrame:
    """Items in the order of the list, or of the object's integer keys (others are skipped), numbered per file from 0."""
    at = F.when(F.col("key").isNull(), F.col("place")).otherwise(F.trim("key").try_cast("int"))
    kept = items.withColumn("_at", at).where("_at is not null")
    return row_number(kept, ["file"], [F.col("_at"), F.col("place")], "tag_idx").withColumn("tag_idx", (F.col("tag_idx") - 1).cast("int"))


def read_tag_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, tag_idx, name, category) of every dictionary file under a path.

    JSON list, JSON object by index, CSV with a name column, or one-column CSV.
    Tags are numbered per file by windows; no file's tags are gathered again
    once they were taken apart.
    """
    files = _whole(spark, path)
    is_json = F.lower("file").endswith(".json")
    json = _placed(_items(files.where(is_json), "value"))
    json = json.select("file", "tag_idx", _entry_name(F.col("value")).alias("name"), _entry_category(F.col("value")).alias("category"))

    as_row = "from_csv({}, '" + ", ".join(f"c{i} string" for i in range(_CSV_WIDTH)) + "', map('escape', '\"'))"
    cells = "array(" + ", ".join(f"{{0}}.c{i}" for i in range(_CSV_WIDTH)) + ")"
    lines = files.where(~is_json).withColumn("_lines", F.split("value", "\r?\n")).withColumn("_head", F.expr(as_row.format("_lines[0]")))
    titles = F.expr(cells.format("_head"))
    has_header = F.col("_lines")[0].contains(",") & F.lower(F.col("_lines")[0]).contains("name")
    at = F.when(has_header, F.greatest(F.lit(1), F.array_position(titles, "name"))).otherwise(1)
    category_at = F.when(has_header, F.nullif(F.array_position(titles, "category"), F.lit(0)))
    each = lines.select("file", has_header.alias("_header"), at.cast("int").alias("_at"), category_at.cast("int").alias("_cat"), F.posexplode("_lines").alias("place", "_line"))
    each = each.where((F.col("_line") != "") & ((F.col("place") > 0) | ~F.col("_header"))).withColumn("_row", F.expr(as_row.format("_line")))
    values = F.expr(cells.format("_row"))
    category = F.when(F.col("_cat").isNull(), F.lit("unknown")).otherwise(normalize_category(F.try_element_at(values, F.col("_cat"))))
    csv = each.select("file", "place", F.coalesce(F.try_element_at(values, F.col("_at")), F.lit("")).alias("name"), category.alias("category"))
    csv = row_number(csv, ["file"], [F.col("place")], "tag_idx").select("file", (F.col("tag_idx") - 1).cast("int").alias("tag_idx"), "name", "category")
    return json.unionByName(csv)


def read_tag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(tag_idx, name, category) of one dictionary file."""
    return read_tag_dictionaries(spark, path).drop("file")


def read_model_metadata_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, tag_idx, name, category) from nested model metadata; tags without a category are ``general``."""
    def pick(keys: tuple[str, ...]) -> Column:
        hits = [F.get_json_object("value", f"{c}.{k}") for c in CONTAINERS for k in keys]
        return F.coalesce(*[F.when(~h.isin("", "{}", "[]"), h) for h in hits])

    raw = _whole(spark, path).select("file", pick(NAME_KEYS).alias("names"), pick(CATEGORY_KEYS).alias("cats"))
    tags = _placed(_items(raw, "names")).select("file", "tag_idx", _entry_name(F.col("value")).alias("name"))
    cats = _items(raw, "cats").select("file", "key", "place", _text(F.col("value")).alias("named"))
    by_name = cats.where("key is not null").select("file", F.col("key").alias("name"), "named")
    by_place = cats.where("key is null").select("file", F.col("place").alias("tag_idx"), F.col("named").alias("placed"))
    found = tags.join(by_name, ["file", "name"], "left").join(by_place, ["file", "tag_idx"], "left")
    return found.select("file", "tag_idx", "name", normalize_category(F.coalesce("named", "placed", F.lit("general"))).alias("category"))


def read_model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(tag_idx, name, category) of one metadata file."""
    return read_model_metadata_files(spark, path).drop("file")


def _preset_texts(uris: DataFrame) -> DataFrame:
    """(text) of JSON files, in the encoding that they show; NULL if they do not keep to it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            size = 0
            for uri in batch.column("uri").to_pylist():
                with open(uri, "rb") as f:
                    body = f.read()
                try:
                    texts.append(body.decode(json.detect_encoding(body)))
                except UnicodeDecodeError:
                    texts.append(None)
                size += len(body)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
                    texts, size = [], 0
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    return uris.mapInArrow(read, "text string")


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """Caption presets from JSON files: unknown keys dropped, missing ones defaulted.

    In a folder that all tasks share, tasks list and read the files. Other
    stores, patterns, and folders with packed files or with folders of
    partitions go through Spark's reader, whose list of files the driver holds.
    """
    kinds = {"str": "string", "float": "double", "int": "int", "bool": "boolean"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(CaptionOptions))
    folder = shared_folder(path)
    uris = None if folder is None else listed(spark, folder, enter=lambda name: "=" in name)
    if uris is None or not uris.where((folder_of(F.col("uri")) != folder.rstrip("/")) | F.col("uri").rlike(PACKED)).isEmpty():
        return with_preset_defaults(spark.read.schema(schema).option("multiLine", "true").json(path))
    texts = _preset_texts(uris).where("text is null or text rlike '[^ \\\\t\\\\r\\\\n]'")
    # a file may hold a list of presets; one that cannot be read, or with an entry that is null, is a preset without settings
    none = F.array(F.struct(*[F.lit(None).cast(kinds[f.type]).alias(f.name) for f in fields(CaptionOptions)]))
    parsed = texts.select(F.from_json("text", f"array<struct<{schema}>>").alias("parsed"))
    raw = parsed.select(F.inline(F.when(~F.exists("parsed", lambda p: p.isNull()), F.col("parsed")).otherwise(none)))
    return with_preset_defaults(raw)


def with_preset_defaults(raw: DataFrame) -> DataFrame:
    """Settings that a preset leaves out, filled in."""
    default = CaptionOptions()
    value = {f.name: PRESET_DEFAULTS.get(f.name, getattr(default, f.name)) for f in fields(CaptionOptions)}
    return raw.select(*[(F.coalesce(F.col(n), F.lit(v)) if n in raw.columns else F.lit(v)).alias(n) for n, v in value.items()])
