"""Shape profile of landed JSON and its drift between landings.

A profile counts, per path of the documents, what kinds of values stand there.
Cleaning trusts shapes (an object or a list of them, a string or a number); a
profile shows before a load where a landing departs from them.

Documents are opened level by level: the containers of a level are written to
the shared checkpoint folder, exploded once to count what they hold and once
for the containers among it. There are as many rounds as the deepest document
has levels, scalars are never written, and counts are combined in the task, so
a path that every document has costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import vkind
from ..session import ensure_checkpoint_dir

CONTAINERS = ("OBJECT", "ARRAY")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, NUMBER, BOOLEAN, NULL of a VARIANT; INVALID where
    there is none (the text was no JSON)."""
    return F.when(v.isNull(), "INVALID").otherwise(F.upper(vkind(v)))


def _step(key: Column) -> Column:
    """``.key``, quoted unless it is a plain word; ``[*]`` for an array's elements."""
    plain = key.rlike("^[A-Za-z0-9_]+$")
    quoted = F.concat(F.lit('."'), F.replace(key, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(key.isNull(), "[*]").when(plain, F.concat(F.lit("."), key)).otherwise(quoted)


def shape_profile(docs: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, path, kind, n) over the JSON texts of ``value``.

    ``$`` is the document. A null text is INVALID, as is one that is no JSON;
    a repeated key of an object counts once (its last value)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    keys = [*by, "path"]

    def counted(level: DataFrame) -> DataFrame:
        return level.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))

    level = docs.select(*by, F.lit("$").alias("path"), F.try_parse_json(value).alias("v"))
    level = level.withColumn("kind", kind(F.col("v")))
    out = counted(level).checkpoint()
    while True:
        held = level.where(F.col("kind").isin(*CONTAINERS)).select(*keys, "v").checkpoint()
        if held.isEmpty():
            return out.groupBy(*keys, "kind").agg(F.sum("n").alias("n"))
        inner = spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_v"))
        level = held.lateralJoin(inner).select(
            *by, F.concat("path", _step(F.col("_key"))).alias("path"), F.col("_v").alias("v"))
        level = level.withColumn("kind", kind(F.col("v")))
        out = out.unionByName(counted(level).checkpoint())


def drift(profile: DataFrame, landing: str, before: str, after: str) -> DataFrame:
    """(path, kinds_before, kinds_after, change) of the paths whose kinds differ
    between two landings of a profile: ``new``, ``gone`` or ``changed``. Kinds are
    sorted and comma-joined, '' for a path that a landing does not have."""
    def kinds(name):
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col(landing) == name, F.col("kind")))), ",")

    both = profile.where(F.col(landing).isin(before, after)).groupBy("path").agg(
        kinds(before).alias("kinds_before"), kinds(after).alias("kinds_after"))
    return both.where("kinds_before <> kinds_after").withColumn(
        "change", F.when(F.col("kinds_before") == "", "new").when(F.col("kinds_after") == "", "gone").otherwise("changed"))
