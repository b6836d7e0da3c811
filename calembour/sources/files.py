"""Reading and writing text tables.

Every reader takes a schema or finds columns by name; missing strings become '' only
where asked for. Between stages Parquet is used; TSV and CSV stand at the edges.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORTHOGRAPHY = ("ortho", "orth", "word", "lemme")
PHONOLOGY = ("phon", "phonology", "phon_ortho", "ipa", "phono")
#: Texts that a data frame library reads as missing.
MISSING = ("", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "nan", "null", "n/a")


def filled(df: DataFrame) -> DataFrame:
    """Null strings become ''; other types stay null."""
    return df.na.fill("", [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])


def _one_object_a_line(spark: SparkSession, path: str) -> bool:
    """Whether the first written line of JSON is a whole object; only its ends come to the driver."""
    line = F.trim(F.regexp_replace("value", r"^\x{FEFF}", ""))
    ends = spark.read.text(path).where(line != "").select(F.left(line, F.lit(1)), F.right(line, F.lit(1))).first()
    return ends is None or tuple(ends) == ("{", "}")


def load(spark: SparkSession, path: str, schema: str | None = None, fill: bool = True, missing: bool = False) -> DataFrame:
    """A table from ``.json`` (an array or one object a line), ``.csv``, ``.tsv``, ``.parquet``; any other file as one text.

    ``missing``: texts such as ``NA`` and ``null`` count as missing.
    """
    kind = path.rstrip("/").rpartition(".")[2].lower()
    read = spark.read if schema is None else spark.read.schema(schema)
    if kind == "json":
        df = read.option("multiLine", "false" if _one_object_a_line(spark, path) else "true").json(path)
    elif kind in ("csv", "tsv"):
        df = read.option("header", "true").option("sep", "\t" if kind == "tsv" else ",").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    elif kind == "parquet":
        df = read.parquet(path)
    else:
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    if missing:
        df = df.select(*(F.when(F.col(f"`{c}`").isin(*MISSING), None).otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))
    return filled(df) if fill else df


def load_chunks(spark: SparkSession, folder: str, schema: str, kind: str = "tsv") -> DataFrame:
    """All chunk files of a folder with ``chunk_no``, the last number in a file's path; an empty folder gives an empty table."""
    read = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}" if kind != "parquet" else "*.parquet")
    df = read.parquet(folder) if kind == "parquet" else read.option("header", "true").option("sep", "\t" if kind == "tsv" else ",").csv(folder)
    name = F.col("_metadata.file_path")
    return filled(df.select("*", F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).try_cast("int").alias("chunk_no")))


def load_flat_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array of objects; nested objects become dotted columns."""
    df = load(spark, path, schema, fill=False)

    def leaves(struct, prefix: str = "") -> list:
        out = []
        for f in struct.fields:
            name = f"{prefix}{f.name}"
            if f.dataType.typeName() == "struct":
                out += leaves(f.dataType, f"{name}.")
            else:
                out.append(F.col(".".join(f"`{p}`" for p in name.split("."))).alias(name) if prefix else F.col(f"`{name}`"))
        return out

    return df.select(*leaves(df.schema))


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word``, ``phon``, ``ord`` from a TSV or CSV with any of the usual column names."""
    head = spark.read.option("header", "false").text(path).first()
    if head is None:
        raise ValueError(f"empty lexicon: {path}")
    sep = "\t" if "\t" in head[0] else ","
    df = spark.read.option("header", "true").option("sep", sep).csv(path)
    names = {c.lower().strip(): c for c in df.columns}
    phon = next((names[n] for n in PHONOLOGY if n in names), None)
    if phon is None:
        raise ValueError(f"no phonetic column in {path}: {df.columns}")
    word = next((names[n] for n in ORTHOGRAPHY if n in names), df.columns[0])
    rows = df.select(F.lower(F.trim(F.col(f"`{word}`"))).alias("word"), F.trim(F.col(f"`{phon}`")).alias("phon"), F.monotonically_increasing_id().alias("ord"))
    return rows.dropna(subset=["word", "phon"]).where("word <> '' AND phon <> ''")


def load_matrix(spark: SparkSession, path: str, words: DataFrame | None = None) -> DataFrame:
    """``vec_id``, ``embedding`` (and ``word`` by position) of a saved two-dimensional array.

    The file is memory-mapped on the driver and sent in slices; for matrices beyond the
    driver write Parquet instead.
    """
    import numpy as np

    m = np.load(path, mmap_mode="r", allow_pickle=False)
    step = max(1, 64_000_000 // max(1, m.shape[1] * 8))
    parts = [spark.createDataFrame([(i, m[i].astype(float).tolist()) for i in range(a, min(a + step, len(m)))], "vec_id bigint, embedding array<float>") for a in range(0, len(m), step)]
    df = parts[0] if parts else spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    for p in parts[1:]:
        df = df.unionByName(p)
    return df if words is None else df.join(words, "vec_id")


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By extension: ``.tsv`` unquoted with ``\\`` escapes, ``.csv`` quoted, ``.json`` one object a line, ``.parquet``, else text."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    w = df.write.mode(mode)
    if kind == "tsv":
        w.option("header", "true").option("sep", "\t").option("quote", "").option("escape", "\\").csv(path)
    elif kind == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    elif kind == "json":
        w.json(path)
    elif kind == "parquet":
        w.parquet(path)
    else:
        w.text(path)


def save_chunks(df: DataFrame, folder: str, model: str, chunk: str = "chunk_id") -> None:
    """One folder per model and chunk; only the chunks in ``df`` are replaced."""
    df.withColumn("model", F.lit(model)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", chunk).parquet(folder)


def append_rows(df: DataFrame, folder: str) -> None:
    """Checkpoint rows, added to what is there."""
    df.write.mode("append").parquet(folder)


def resume(spark: SparkSession, df: DataFrame, folder: str, key: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows still to do, rows done before). A folder that isn't there means nothing is done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    done = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
    return df.join(done.select(key).distinct(), key, "left_anti"), done


def cached_lookup(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(known rows of the cache, keys that miss)."""
    keys = wanted.select(key).distinct()
    return cache.join(keys, key, "left_semi"), keys.join(cache.select(key).distinct(), key, "left_anti")


def chunk_number(name: str) -> int | None:
    """The last number in a path."""
    found = re.findall(r"\d+", name)
    return int(found[-1]) if found else None
