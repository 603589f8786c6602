"""Message and parsed-sentence tables as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = (
    "date string, sender string, id string, next_thread string, prev_thread string, "
    "next_url string, subject string, text string"
)
# words and tiles are mixed arrays on disk
PARSED_RAW = (
    "id string, size int, sha1 string, polr double, subj double, graf array<array<string>>, tile array<array<bigint>>"
)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON lines, one message each; the schema is declared, not inferred."""
    return spark.read.schema(MESSAGE).json(path)


def decode_messages(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", MESSAGE).alias("m")).select("m.*")


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    return decode_parsed(spark.read.text(path))


def decode_parsed(lines: DataFrame) -> DataFrame:
    """Parsed sentences from JSON lines, words and tiles as typed structs."""
    raw = lines.select(F.from_json("value", PARSED_RAW).alias("s")).select("s.*")
    word = lambda w: F.struct(
        F.get(w, F.lit(0)).cast("long").alias("node_id"),
        F.get(w, F.lit(1)).alias("raw"),
        F.get(w, F.lit(2)).alias("root"),
        F.get(w, F.lit(3)).alias("pos"),
        F.get(w, F.lit(4)).cast("int").alias("keep"),
        F.get(w, F.lit(5)).cast("int").alias("num"),
    )
    pair = lambda p: F.struct(F.get(p, F.lit(0)).alias("n0"), F.get(p, F.lit(1)).alias("n1"))
    return raw.withColumn("graf", F.transform("graf", word)).withColumn("tile", F.transform("tile", pair))


def _inlined(parsed: DataFrame, column: str, names: list[str]) -> DataFrame:
    """One row per struct of an array column: (id, names).

    The outer form and a filter on the elements: the inner form makes the optimizer add a filter on the array
    below it, which writes and reads the sentences' JSON again.
    """
    rows = parsed.select("id", F.explode_outer(column).alias("_e")).filter(F.col("_e").isNotNull())
    return rows.select("id", *[F.col("_e")[n].alias(n) for n in names])


def parsed_nodes(parsed: DataFrame) -> DataFrame:
    """Every word of every parsed sentence: (id, node_id, raw, root, pos, keep, num)."""
    return _inlined(parsed, "graf", ["node_id", "raw", "root", "pos", "keep", "num"])


def parsed_edges(parsed: DataFrame) -> DataFrame:
    """Every tile with two real ids, in both directions: (id, node0, node1)."""
    pairs = _inlined(parsed, "tile", ["n0", "n1"]).filter((F.col("n0") > 0) & (F.col("n1") > 0))
    ends = F.array(
        F.struct(F.col("n0").alias("node0"), F.col("n1").alias("node1")),
        F.struct(F.col("n1").alias("node0"), F.col("n0").alias("node1")),
    )
    return pairs.select("id", F.inline(ends))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row with its keys in order: (value)."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def parsed_lines(records: DataFrame) -> DataFrame:
    """Sentence records (id, size, sha1, polr, subj, graf, tile) in their on-disk form."""
    word = lambda t: F.array(
        t["node_id"].cast("string"), t["raw"], t["root"], t["pos"], t["keep"].cast("string"), t["num"].cast("string")
    )
    shaped = records.select(
        "id", "size", "sha1", "polr", "subj",
        F.transform("graf", word).alias("graf"),
        F.transform("tile", lambda p: F.array(p["n0"], p["n1"])).alias("tile"),
    )
    return json_lines(shaped)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Replace the JSON-lines table at ``path``."""
    json_lines(df).write.mode("overwrite").text(path)
