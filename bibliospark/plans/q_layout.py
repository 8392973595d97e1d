"""Queries on the bucketed star and on the shape of landed JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import shape
from ..operators.bucketed_star import BucketedStar
from ..session import scratch_path
from ..sources import star
from ..sources.tables import table
from .catalog import register

BUCKETS = 16


def _store(spark, base, bridge):
    dims = {"article_auteur": {"auteurs": star.authors}, "auteur_affiliation": {"affiliations": star.affiliations}}
    rows = {"article_auteur": star.article_author, "auteur_affiliation": star.author_affiliation}
    store = BucketedStar(spark, scratch_path(spark, "bucketed-star"), BUCKETS, f"star_{uuid.uuid4().hex}")
    return store.write({k: f(spark, base) for k, f in dims[bridge].items()}, {bridge: rows[bridge](spark, base)})


@register("bucketed_article_authors", """
SELECT l_orderkey AS article_id, p_name AS nom_complet FROM lineitem JOIN part ON l_partkey = p_partkey""")
def bucketed_article_authors(spark, base):
    return _store(spark, base, "article_auteur").joined("article_auteur").select("article_id", "nom_complet")


@register("bucketed_top_authors", """
SELECT p_name AS author, count(*) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_name
QUALIFY row_number() OVER (ORDER BY count(*) DESC, p_name NULLS FIRST) <= 10""")
def bucketed_top_authors(spark, base):
    counts = _store(spark, base, "article_auteur").mentions("article_auteur", "nom_complet")
    return R._top(R._collated_count(counts, "nom_complet", "author", None), "author", 10)


@register("bucketed_top_countries", """
SELECT n_name AS country, count(*) AS total
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name
QUALIFY row_number() OVER (ORDER BY count(*) DESC, n_name NULLS FIRST) <= 10""")
def bucketed_top_countries(spark, base):
    counts = _store(spark, base, "auteur_affiliation").mentions("auteur_affiliation", "pays")
    return R._top(R._collated_count(counts, "pays", "country", None), "country", 10)


# The landed events: later ones write the user as a string and carry tags; the
# value of an error is null.
def _landed_events(spark, base):
    late = F.dayofmonth("ts") > 15
    user = F.col("user_id").cast("string")
    value = F.when(F.col("event_type") == "error", "null").otherwise(F.coalesce(F.col("value").cast("string"), F.lit("null")))
    tags = F.concat(F.lit(',"tags":["'), "event_type", F.lit('",'), user, F.lit(',{"of":{"user":'), user, F.lit("}}]"))
    return table(spark, base, "events").select(
        F.when(late, "late").otherwise("early").alias("landing"),
        F.concat(F.lit('{"user":'), F.when(late, F.concat(F.lit('"u'), user, F.lit('"'))).otherwise(user),
                 F.lit(',"value":'), value, F.lit(',"props":'), F.coalesce("props", F.lit("null")),
                 F.when(late, tags).otherwise(""), F.lit("}")).alias("value"))


_SHAPES = """
WITH landed AS (
  SELECT CASE WHEN day(ts) > 15 THEN 'late' ELSE 'early' END AS landing,
         '{"user":' || CASE WHEN day(ts) > 15 THEN '"u' || user_id || '"' ELSE user_id::VARCHAR END
         || ',"value":' || CASE WHEN event_type = 'error' THEN 'null' ELSE coalesce(value::VARCHAR, 'null') END
         || ',"props":' || coalesce(props, 'null')
         || CASE WHEN day(ts) > 15 THEN ',"tags":["' || event_type || '",' || user_id || ',{"of":{"user":' || user_id || '}}]'
            ELSE '' END || '}' AS value
  FROM events
), shapes AS (
  SELECT landing, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path,
         CASE WHEN t.type IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'NUMBER'
              WHEN t.type = 'VARCHAR' THEN 'STRING' ELSE t.type END AS kind
  FROM landed, json_tree(landed.value) t
)"""


@register("landed_shapes", _SHAPES + """
SELECT landing, path, kind, count(*) AS n FROM shapes GROUP BY ALL""")
def landed_shapes(spark, base):
    return shape.shape_profile(_landed_events(spark, base), by=("landing",))


@register("landed_shape_drift", _SHAPES + """,
kinds AS (
  SELECT path, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (WHERE landing = 'early'), '') AS kinds_before,
         coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (WHERE landing = 'late'), '') AS kinds_after
  FROM shapes GROUP BY path)
SELECT path, kinds_before, kinds_after,
       CASE WHEN kinds_before = '' THEN 'new' WHEN kinds_after = '' THEN 'gone' ELSE 'changed' END AS change
FROM kinds WHERE kinds_before <> kinds_after""")
def landed_shape_drift(spark, base):
    profile = shape.shape_profile(_landed_events(spark, base), by=("landing",))
    return shape.drift(profile, "landing", "early", "late")
